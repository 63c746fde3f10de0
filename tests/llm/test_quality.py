import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sweetframe.llm import quality

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


TEXTS = [None, "", " \n \t", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z q x y z\nx y z\n\nx y z\n é ü é ü", "#*$%&|<> !! \x1c a\x0bb\x0cc\rd", "w " * 30_000, "z" * 200_000, " ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w4"]


def test_measures_equal_the_plain_ones(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_lines_", F.lit(1))
    for r in quality.measures(docs).collect():
        assert tuple(r[n] for n in NAMES) == plain(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]] and TEXTS[r["doc_id"]][:40]


def plain_fit(rows, names, ways, rounds=40, enough=1e-4):
    """Expectation-maximisation over (votes..., n) rows: (shares of bad votes by class, shares of classes, posteriors)."""
    first = acc = [[quality.START[c in way] for c in names] for way in ((), *ways)]
    start = share = [quality.SHARE_GOOD, *[(1 - quality.SHARE_GOOD) / len(ways)] * len(ways)]
    w, total = quality.WEIGHT, sum(r[-1] for r in rows)

    def posts():
        for *v, _n in rows:
            like = [s * math.prod(b if x < 0 else 1 - b if x > 0 else 1 for b, x in zip(a, v)) for a, s in zip(acc, share)]
            yield [x / sum(like) for x in like]

    for _ in range(rounds):
        post, last = list(posts()), (share, *acc)
        counts = [[[sum(p[k] * r[-1] for p, r in zip(post, rows) if r[j] == v) for v in (1, -1)] for j in range(len(names))] for k in range(len(acc))]
        acc = [[(bad + w * f) / (good + bad + w) for (good, bad), f in zip(c, own)] for c, own in zip(counts, first)]
        share = [(sum(p[k] * r[-1] for p, r in zip(post, rows)) + w * s) / (total + w) for k, s in enumerate(start)]
        if max(abs(x - y) for a, b in zip((share, *acc), last) for x, y in zip(a, b)) <= enough:
            break
    return acc, share, [p[0] for p in posts()]


def test_estimation_equals_plain_expectation_maximisation(spark):
    rows = [(1, 1, 0, 50), (1, -1, 1, 9), (-1, -1, -1, 20), (-1, 1, -1, 4), (0, 1, 1, 30), (0, 0, 0, 2)]
    ways = (("a", "b"), ("b", "c"))
    got = quality.estimate(spark.createDataFrame(rows, "a int, b int, c int, n long"), ["a", "b", "c"], ways)
    acc, share, _ = plain_fit(rows, "abc", ways)
    assert all(abs(x - y) < 1e-9 for x, y in zip(got.share, share))
    assert all(abs(mine[c] - x) < 1e-9 for mine, a in zip(got.bad_votes, acc) for c, x in zip("abc", a))


def test_lone_bad_votes_fall_on_both_sides(spark):
    # a and b mostly agree on the bad tenth, c votes bad on a tenth of everything
    rows = [(1, 1, 1, 7900), (1, 1, -1, 870), (-1, -1, 1, 800), (-1, -1, -1, 90), (-1, 1, 1, 30), (1, -1, 1, 30)]
    patterns = spark.createDataFrame(rows, "a int, b int, c int, n long")
    fit = quality.estimate(patterns, ["a", "b", "c"], (("a", "b"), ("b", "c")))
    good = {(r.a, r.b, r.c): r.p >= 0.5 for r in patterns.withColumn("p", quality.posterior(fit, ["a", "b", "c"])).collect()}
    assert good[1, 1, -1] and not good[-1, 1, 1] and not good[1, -1, 1] and not good[-1, -1, 1]


def test_columns_with_the_names_of_results_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, 7, "x", "y", None)], "doc_id long, text string, n_words int, kept string, POSTERIOR string, __text string")
    (r,) = quality.assess(docs).collect()
    assert r["n_words"] == 120 and r["n_words_"] == 7 and r["kept_"] == "x" and r["POSTERIOR_"] == "y" and r["kept"] is False


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)) + ".\n"
    rows = [(i, prose()) for i in range(300)] + [(1000 + i, " ".join(w + "%%$" for w in prose().split())) for i in range(20)] + [(2000 + i, prose().upper()) for i in range(20)]
    kept = {r["doc_id"] for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(300))


def test_query_equals_brute_force_and_uses_no_python(spark):
    from sweetframe.llm.queries import op7_quality_rules

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op7_quality_rules(spark, d)
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == plain(docs[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    votes = [c.alias(k) for k, c in quality.rules().items()]
    measured = quality.measures(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).where(~quality.hard_fail()).select("doc_id", *votes).collect()
    patterns = sorted(Counter(tuple(r)[1:] for r in measured).items())
    good = dict(zip((v for v, _ in patterns), plain_fit([(*v, n) for v, n in patterns], list(quality.rules()), quality.WAYS)[2]))
    of = {r["doc_id"]: good[tuple(r)[1:]] for r in measured}
    for r in rows:
        assert r["kept"] == (r["doc_id"] in of and of[r["doc_id"]] >= 0.5)
        assert r["doc_id"] not in of or abs(r["posterior"] - of[r["doc_id"]]) < 1e-6
    empty = quality.assess(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
