import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetframe.llm import language_id as li
from sweetframe.llm.queries import TOKENIZERS, op1_language_id

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
PIECES = sorted(["▁", "▁a", "a", "ab", "b", "▁ab", "ba", "bab", "c"])


def segmentations(word, pieces):
    """All ways to part the marked word into pieces; letters outside count as the unknown piece."""
    word = "▁" + word

    def parts(i):
        if i == len(word):
            yield []
        for k in range(1, 9):
            piece = word[i : i + k]
            if i + k <= len(word) and (piece in pieces or k == 1):
                for rest in parts(i + k):
                    yield [piece if piece in pieces else None, *rest]

    return list(parts(0))


@pytest.fixture(scope="module")
def prob():
    p = np.random.default_rng(1).random((len(PIECES) + 1, 3))
    return p / p.sum(axis=0)


WORDS = ["a", "ab", "abab", "babab", "xaby", "ccc", "ababababab"]


def test_marginals_equal_the_sum_over_segmentations(prob):
    ids = {p: i for i, p in enumerate(PIECES)} | {None: len(PIECES)}
    got = li.log_marginals(li.Lattice(PIECES), prob, WORDS)
    for w, row in zip(WORDS, got):
        want = sum(np.prod([prob[ids[p]] for p in s], axis=0) for s in segmentations(w, PIECES))
        assert np.allclose(row, np.log(want))


def test_long_words_neither_vanish_nor_overflow(prob):
    one, two = li.log_marginals(li.Lattice(PIECES), prob, ["ab" * 128, "ab" * 256])
    assert np.isfinite(two).all() and np.all(two < one)


def test_expected_counts_equal_the_sum_over_segmentations(prob):
    ids = {p: i for i, p in enumerate(PIECES)} | {None: len(PIECES)}
    weight = np.arange(3 * len(WORDS), dtype=float).reshape(-1, 3)
    want = np.zeros(prob.shape)
    for w, n in zip(WORDS, weight):
        all_ = segmentations(w, PIECES)
        p = np.array([np.prod([prob[ids[x]] for x in s], axis=0) for s in all_])
        for s, share in zip(all_, p / p.sum(axis=0)):
            for x in s:
                want[ids[x]] += share * n
    assert np.allclose(li.expected_counts(li.Lattice(PIECES), prob, WORDS, weight), want)


def test_letter_runs():
    assert li.letter_runs("It's É1ö_x ²a²b") == ["it", "s", "é", "ö", "x", "a", "b"]
    assert li.letter_runs(None) == li.letter_runs("12 %&") == []
    assert list(map(len, li.letter_runs("z" * 1100))) == [1100]


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_defined_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "123 !!", "fr"), (6, "a" * 5000, None), (6, "a" * 5000, None), (None, "the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = li.fit(docs, VOCABULARY)
    found = docs.withColumn("x", li.identify(spark, model, F.col("text"))).select("doc_id", "score", "x.lang").collect()
    got = [(r["doc_id"], r["lang"]) for r in found]
    assert got[:5] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")] and got[5] == got[6] and {r["score"] for r in found} == {"clash"}
    none = li.fit(docs.limit(0), VOCABULARY)
    assert [r["x"]["lang"] for r in docs.select(li.identify(spark, none, F.col("text")).alias("x")).collect()] == ["und"] * 8


def test_runs_of_letters_of_any_length_are_whole():
    assert list(map(len, li.letter_runs("a" * 5000 + " b²c " + "é" * 40))) == [5000, 1, 1, 40]
    pieces, rng = sorted({"a", "b", "ab", "ba", "aab", "▁a"}), np.random.default_rng(1)
    lattice, prob = li.Lattice(pieces), rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["ab" * n + "xa" for n in (3, 10, 15, 16, 40, 300)]
    weight = rng.integers(1, 5, (len(words), 2)).astype(float)
    for i, w in enumerate(words):  # both ways of counting agree where both can be used
        total = np.zeros(prob.shape)
        li._add_scaled(lattice, prob, w, weight[i], total)
        if len(w) <= 32:
            assert np.allclose(total, li.expected_counts(lattice, prob, [w], weight[i : i + 1]), rtol=1e-9)
        assert np.isfinite(total).all()
        # pieces of each segmentation cover the word and its mark once
        sizes = np.array([*map(len, pieces), 1])
        assert np.allclose((total * sizes[:, None]).sum(axis=0), weight[i] * (len(w) + 1))
    parts = [np.zeros(prob.shape) for _ in words]
    for i, w in enumerate(words):
        li._add_scaled(lattice, prob, w, weight[i], parts[i])
    assert np.allclose(li.expected_counts(lattice, prob, words, weight), sum(parts), rtol=1e-9)
    assert np.isfinite(li.log_marginals(lattice, prob, ["ab" * 20_000])).all()
