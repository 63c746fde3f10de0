import random

import pytest

from sweetframe.llm import decontaminate as d


def sellers(probe, text):
    """Fewest edits from probe to any stretch of text."""
    row = [0] * (len(text) + 1)
    for c in probe:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        i, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:i] + ("" if kind == 0 else rng.choice("abcdé")) + text[i + (kind != 1) :]
    return text


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))


@pytest.mark.parametrize("seed", range(6))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    prose = lambda n: d.plain(" ".join(word(rng) for _ in range(n)))
    items = [(i, prose(rng.randint(6, 40))) for i in range(8)]
    texts = []
    for _ in range(30):
        t = prose(rng.randint(0, 60))
        if rng.random() < 0.8:
            item = rng.choice(items)[1]
            part = item[:] if rng.random() < 0.5 else item[rng.randint(0, 30) :]
            t = d.plain(t + " " + edited(rng, part, rng.randint(0, 14)) + " " + prose(rng.randint(0, 20)))
        texts.append(t)
    probes = d.Probes(items, d.Settings())
    got = {(n, item) for n, item, edits, a, b, _ in probes.matches(texts)}
    want = {(n, probes.item[i]) for i, p in enumerate(probes.text) for n, t in enumerate(texts) if sellers(p, t) <= probes.edits[i]}
    assert got == want
    for n, item, edits, a, b, _ in probes.matches(texts):
        assert any(sellers(p, texts[n][a:b]) == edits for i, p in enumerate(probes.text) if probes.item[i] == item)


def test_bounded_work_changes_nothing(monkeypatch):
    rng = random.Random(99)
    prose = lambda n: d.plain(" ".join(word(rng) for _ in range(n)))
    shared = prose(30)
    probes = d.Probes([(i, d.plain(f"{prose(8)} {shared} {prose(8)}")) for i in range(20)], d.Settings())
    texts = [d.plain(f"{prose(5)} {edited(rng, shared, i % 8)} {prose(9)}") for i in range(20)] + [" ".join([shared] * 5)]
    whole = list(probes.matches(texts))
    assert len(whole) > 200
    for work in (1, 1_000, 30_000):
        monkeypatch.setattr(d, "_WORK", work)
        assert list(probes.matches(texts)) == whole


def test_source_spans_and_plain_form():
    text = "  Ab-C_d  İx É!!9"
    assert d.plain(text) == " ".join(d._WORD.findall(d.lowered(text))) and len(d.lowered(text)) == len(text)
    p = d.plain(text)
    for t in (text, "", "a", "\U0001d49c b\U0001f600c \ud800x", "İİ é1_2²"):
        assert d.word_starts(t).tolist() == [m.start() for m in d._WORD.finditer(d.lowered(t))]
    for a in range(len(p)):
        for b in range(a + 1, len(p) + 1):
            if p[a] != " " and p[b - 1] != " ":
                s, e = d.source_span([m.start() for m in d._WORD.finditer(d.lowered(text))], p, a, b)
                assert d.plain(text[s:e]) == p[a:b]


def test_query_finds_planted_passages_only(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix bright potions under a pale moon"
    rows = [(1, None), (2, ""), (3, "clean text " * 3000), (4, "x " * 500 + item.upper().replace(" ", " -- ") + " y" * 9), (4, "x " * 500 + item), (5, item.replace("wizards", "wizord").replace("lazy", "lay")), (6, "z" * 200_000), (None, item)]
    docs = spark.createDataFrame([(*r, "e", 0) for r in rows], "doc_id long, text string, edits string, item_id int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "short"), (9, None), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or -1, r["edits"]) for r in d.leaks(docs, bench).collect())
    assert got == [(0, -1, 0), (0, 7, 0), (4, -1, 0), (4, -1, 0), (4, 7, 0), (4, 7, 0), (5, -1, got[-1][2]), (5, 7, got[-1][2])] and got[-1][2] <= 3
    assert sorted(r["doc_id"] for r in d.without_leaks(docs, bench).collect()) == [1, 2, 3, 6]
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.without_leaks(docs.limit(0), bench).count() == 0


def test_every_excerpt_of_a_probes_length_is_found():
    rng = random.Random(8)
    item = d.plain(" ".join(word(rng) for _ in range(60)))
    probes = d.Probes([(1, item)], d.Settings())
    clean = lambda: " ".join("".join(rng.choice("vwxyz") for _ in range(6)) for _ in range(20))
    for n in (80, 83, 95):
        texts = [clean() + " " + item[a : a + n] + " " + clean() for a in range(len(item) - n + 1)]
        assert {m[0] for m in probes.matches(texts)} == set(range(len(texts)))


def test_short_items_match_exact_copies_of_their_words(spark):
    docs = spark.createDataFrame([(1, "Seven-Wizards mix, potions!"), (2, "seven wizards mix potionsx"), (3, "seven wizards"), (4, "mix seven wizards mix potions seven wizards mix potions")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "seven wizards mix potions")], "item_id long, text string")
    got = sorted(tuple(r) for r in d.leaks(docs, bench).collect())
    assert got == [(1, 7, 0, 1, 0, 26), (4, 7, 0, 2, 4, 55)]
    assert sorted(r["doc_id"] for r in d.without_leaks(docs, bench).collect()) == [2, 3]


@pytest.mark.parametrize("size", [40, 60, 80, 100])
def test_every_excerpt_from_the_inside_of_items_is_found(spark, size):
    rng = random.Random(size)
    items = [(f"item {i}", d.plain(" ".join(word(rng) for _ in range(60)))) for i in range(20)]
    clean = lambda: " ".join("".join(rng.choice("vwxyz") for _ in range(6)) for _ in range(30))
    planted = [(i, f"{clean()} {t[a : a + size].upper()} {clean()}") for i, (_, t) in enumerate(items) for a in (0, 13, 29, 71)]
    docs = spark.createDataFrame([*planted, *((100 + i, clean()) for i in range(20))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()]
    assert sorted(got) == sorted((i, f"item {i}") for i, _ in planted)
    assert {r["doc_id"] for r in d.without_leaks(docs, bench).collect()} == set(range(100, 120))


def test_query_equals_brute_force_over_whole_texts(spark):
    from sweetframe.llm.queries import op5_benchmark_leaks

    sf = "/root/testdata/sf0.001"
    bench = sorted({(r["item_id"], d.plain(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()})
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    probes, want = d.Probes(bench, d.Settings()), {}
    for i, t in docs:  # each text whole, against all items at once
        p = d.plain(t)
        for _, item, edits, a, b, _ in probes.matches([p]):
            span = d.source_span([m.start() for m in d._WORD.finditer(d.lowered(t))], p, a, b)
            e, n, x, y = want.get((i, item), (99, 0, 10**9, 0))
            want[i, item] = (min(e, edits), n + 1, min(x, span[0]), max(y, span[1]))
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["stretches"], r["start"], r["end"]) for r in op5_benchmark_leaks(spark, sf).collect()}
    assert got == want and want
    # all exact excerpts of 40 characters, by plain search
    excerpts = {t[a : a + 40] for _, t in bench for a in range(len(t) - 39)}
    holds = lambda p: any(p[a : a + 40] in excerpts for a in range(len(p) - 39))
    assert {i for i, t in docs if holds(d.plain(t))} <= {i for i, _ in got}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([("seven wizards mix potions", 1, 2, 3, 4), ("clean", 5, 6, 7, 8), (None, 0, 0, 0, 0)], "text string, __leaks int, h0 int, own int, row int")
    bench = spark.createDataFrame([("a", "seven wizards mix potions")], "item_id string, text string")
    out = d.without_leaks(docs, bench)
    assert out.columns == docs.columns and sorted(out.collect(), key=str) == sorted(docs.where("__leaks <> 1").collect(), key=str)
