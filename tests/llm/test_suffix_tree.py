import math
import re
from collections import Counter

import numpy as np
import pytest

from sweetframe.llm import suffix_tree as t

TEXTS = ["the cat sat on the mat", "The  cat\n\nate", None, "", " \t", "é ü \x1c x", "the the the the", "zebra! " * 400, "a\x00b c\x00", "q" * 3000] * 3


def plain_runs(texts, depth):
    out = Counter()
    for x in texts:
        b = b"\n" + b" ".join(t.split_words(x)).replace(b"\0", b"\xff") + b"\n"
        for i in range(1, len(b)):
            out[b[max(0, i - depth) : i + 1]] += 1
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_run_counts_equal_the_plain_ones(depth):
    got = Counter(t.runs_of(t._joined([t.split_words(x) for x in TEXTS]), depth).tolist())
    assert got == {int.from_bytes(k, "big"): n for k, n in plain_runs(TEXTS, depth).items()}


class PlainTree:
    """The tree with dictionaries: next bytes by context, and probabilities by recursion over suffixes."""

    def __init__(self, texts, depth, least, prior=0.5, floor=1e-6):
        self.next, self.prior = {}, prior
        for run, n in plain_runs(texts, depth).items():
            for d in range(len(run)):
                self.next.setdefault(run[len(run) - 1 - d : -1], Counter())[run[-1]] += n
        own = self.next.get(b"", Counter())
        total, back = sum(own.values()), prior * len(own)
        raw = [max((own[b] + back / 256) / (total + back), floor) if total else 1 / 256 for b in range(256)]
        self.bottom = [x / sum(raw) for x in raw]
        self.kept = {b""}
        for c, own in self.next.items():
            n = sum(own.values())
            if c and n >= least and sum(k * math.log(k / n / self.smooth(c[1:], b)) for b, k in own.items()) > 2 * len(own):
                self.kept.add(c)

    def smooth(self, context, byte):
        if not context:
            return self.bottom[byte]
        below, own = self.smooth(context[1:], byte), self.next.get(context)
        if own is None:
            return below
        back = self.prior * len(own)
        return (own[byte] + back * below) / (sum(own.values()) + back)

    def score(self, text, depth):
        b, out = b"\n" + b" ".join(t.split_words(text)).replace(b"\0", b"\xff") + b"\n", 0.0
        for i in range(1, len(b)):
            context = b[max(0, i - depth) : i]
            while context not in self.kept:
                context = context[1:]
            out += math.log10(self.smooth(context, b[i]))
        return out


@pytest.mark.parametrize(("depth", "least", "few"), [(3, 1, 0), (5, 4, 7), (5, 4, 10**6)])
def test_scores_equal_the_plain_tree_under_any_partitioning(spark, depth, least, few):
    train, held = [x for x in TEXTS if x != TEXTS[0]], [*TEXTS[:9], "the zebra! cat sat on \x00 qqqqe ünseen ZZ top", "xyzzy"]
    plain = PlainTree(train, depth, least)
    make = lambda texts, n: spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(n)
    got = [{r["id"]: r["tree_score"] for r in t.assess(make(held, n), make(train, n), depth=depth, least=least, frequent_runs=few).collect()} for n in (1, 3)]
    assert got[0] == got[1]
    for i, x in enumerate(held):
        assert math.isclose(got[0][i], plain.score(x, depth), abs_tol=1e-9 * 4000, rel_tol=1e-9), x
    for c in plain.kept:  # each context's distribution sums to one
        assert math.isclose(sum(plain.smooth(c, b) for b in range(256)), 1, abs_tol=1e-9)


def test_pieces_of_long_texts_give_the_same_sums():
    joined = t._joined([t.split_words(x) for x in TEXTS])
    runs, n = np.unique(t.runs_of(joined, 5), return_counts=True)
    lookup = t.Lookup(runs[::2], np.arange(len(runs))[::2], n[::2], bits=6)
    whole = t.known_scores(lookup, joined, 5)
    for piece in (1, 7, 1000):
        assert all((a == b).all() for a, b in zip(whole, t.known_scores(lookup, joined, 5, piece)))
    values = dict(zip(runs[::2].tolist(), np.arange(len(runs))[::2].tolist()))
    assert whole[0].sum() == sum(values.get(r, 0) for r in t.runs_of(joined, 5).tolist())
    assert len(whole[2]) == sum(r not in values for r in t.runs_of(joined, 5).tolist())


def test_columns_with_the_names_of_results_are_kept(spark):
    docs = spark.createDataFrame([(7, "a b", "x")], "n_tokens int, text string, Tree_Score string")
    (r,) = t.assess(docs, docs).collect()
    assert (r["n_tokens"], r["n_tokens_"], r["Tree_Score_"]) == (3, 7, "x")


def test_query_equals_brute_force_and_contexts_help_on_held_out_texts(spark):
    from pyspark.sql import functions as F

    from sweetframe.llm.queries import op6_lm_score

    import zlib

    d = "/root/testdata/sf0.001"
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    tokens = {r["doc_id"]: [*re.findall("[^\\x20\\x09-\\x0D]+", low(r["text"])), ""] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = op6_lm_score(spark, d).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    flat = {r["doc_id"]: r["tree_score"] for r in t.assess(docs, docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0), depth=1).collect()}
    assert sum(r["score"] - flat[r["doc_id"]] for r in rows if r["held_out"]) > 0


def test_small_frequent_list_and_empty_training(spark):
    docs = spark.createDataFrame([(i, x, "a") for i, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens_ string")
    some = {r["doc_id"]: r for r in t.assess(docs, docs, frequent_words=2).collect()}
    for r in t.assess(docs, docs).collect():
        assert r["n_known"] == some[r["doc_id"]]["n_known"] == r["n_tokens"] and math.isclose(r["base_score"], some[r["doc_id"]]["base_score"])
    none = t.assess(docs, docs.limit(0)).collect()
    assert len(none) == len(TEXTS) and {r["n_known"] for r in none} == {0}
    assert t.assess(docs.limit(0), docs).count() == 0
