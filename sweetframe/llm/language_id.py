"""Language identification with segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary. A word's probability in a
language is the sum over all its segmentations into pieces, which a forward pass over the letters gives; a text's is the
product over its words. The distributions are fitted by expectation-maximisation on word counts of labelled rows.

Defined cases: null text or a text without a letter gives ``und`` and score 0; equal likelihoods go to the first
language by name; repeated rows get the same answer each; with no labelled rows every text is ``und``; letters outside
the vocabulary count as one unknown piece each; very long texts and runs of letters are scored whole; an empty table gives
no rows. The columns of the table are not touched, so that no name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut

MARK = "▁"  # starts each word in the vocabulary's pieces
_RUN = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def letter_runs(text: str | None) -> list[str]:
    """Lower-cased runs of letters, in order."""
    out = []
    for run in _RUN.findall(text.lower()) if text else ():
        if run.isalpha():
            out.append(run)
        else:  # numerals such as superscripts are no letters
            out.extend("".join(c if c.isalpha() else " " for c in run).split())
    return out


def read_pieces(vocabulary: str, longest: int = 8) -> list[str]:
    """The vocabulary's lower-case letter pieces of up to ``longest`` characters, the word mark included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= longest and p == p.lower() and (p == MARK or p.replace(MARK, "", 1).isalpha()))


class Lattice:
    """For a list of words, the piece that spans each (position, length), found by hash in the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)  # the id n is the unknown piece, n + 1 is no piece at all
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash(np.array([list(map(ord, p))], np.uint64))[0] for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in rows.T:
            h = (h + c + np.uint64(1)) * _MIX
        return h

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids by position and length - 1, where each word starts, each word's length), marks included."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(text))  # characters up to the word's end
        ids = np.full((len(text), self.longest), self.n + 1, np.int32)
        h = np.zeros(len(text), np.uint64)
        for k in range(self.longest):
            at = len(text) - k
            if at <= 0:
                break
            h = (h[:at] + text[k:] + np.uint64(1)) * _MIX
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & (left[:at] > k))
            if len(maybe) and self.n:
                slot = np.minimum(np.searchsorted(self.keys, h[maybe]), self.n - 1)
                hit = self.keys[slot] == h[maybe]
                ids[maybe[hit], k] = self.ids[slot[hit]]
        ids[ids[:, 0] == self.n + 1, 0] = self.n
        return ids, starts, lengths


def log_marginals(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log of each word's probability, summed over all segmentations, by language. prob: by piece id and language."""
    out = np.empty((len(words), prob.shape[1]))
    if not words:
        return out
    ids, starts, lengths = lattice.spans(words)
    table = np.vstack([prob, np.zeros(prob.shape[1])])  # the last row: no piece
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    scale = np.zeros(out.shape)
    ring = [np.ones((len(words), prob.shape[1]))]  # forward sums at the last few positions, the newest first
    for j in range(1, int(lengths[0]) + 1):
        active = int(np.searchsorted(-lengths, -j, side="right"))
        now = np.zeros((active, prob.shape[1]))
        for k, before in enumerate(ring[: lattice.longest]):
            now += before[:active] * table[ids[starts[:active] + (j - k - 1), k]]
        ring = [now, *ring[: lattice.longest - 1]]
        if j % 16 == 0:  # keeps the sums within range; exact up to rounding
            scale[:active] += np.log(now)
            ring = [x[:active] / now for x in ring]
        done = int(np.searchsorted(-lengths, -j, side="left"))
        if done < active:
            out[order[done:active]] = np.log(ring[0][done:active]) + scale[done:active]
    return out


def expected_counts(lattice: Lattice, prob: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, by language; weight: the words' counts by language."""
    k_langs, total = prob.shape[1], np.zeros(prob.shape)
    long = [i for i, w in enumerate(words) if len(w) > _SCALED]
    for i in long:
        _add_scaled(lattice, prob, words[i], weight[i], total)
    if long:
        short = sorted(set(range(len(words))) - set(long))
        words, weight = [words[i] for i in short], weight[short]
    if not words:
        return total
    ids, starts, lengths = lattice.spans(words)
    table = np.vstack([prob, np.zeros(k_langs)])
    node = starts + np.arange(len(words))  # each word has a node more than characters
    forward, backward = (np.zeros((len(ids) + len(words), k_langs)) for _ in range(2))
    forward[node], backward[node + lengths] = 1, 1
    for j in range(1, int(lengths.max()) + 1):
        for k in range(min(j, lattice.longest)):
            w = lengths >= j
            forward[node[w] + j] += forward[node[w] + j - k - 1] * table[ids[starts[w] + j - k - 1, k]]
            i = lengths[w] - j
            ok = i + k + 1 <= lengths[w]
            n, s, i = node[w][ok], starts[w][ok], i[ok]
            backward[n + i] += backward[n + i + k + 1] * table[ids[s + i, k]]
    whole = forward[node + lengths]
    share = np.divide(weight, whole, out=np.zeros_like(whole), where=whole > 0)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(ids)) + owner
    for k in range(lattice.longest):
        has = np.flatnonzero(ids[:, k] <= lattice.n)
        use = forward[at[has]] * table[ids[has, k]] * backward[np.minimum(at[has] + k + 1, len(backward) - 1)] * share[owner[has]]
        for lang in range(k_langs):
            total[:, lang] += np.bincount(ids[has, k], use[:, lang], minlength=lattice.n + 1)[: lattice.n + 1]
    return total


_SCALED = 32  # longer runs of letters need sums in logarithms


def _add_scaled(lattice: Lattice, prob: np.ndarray, word: str, weight: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses in one word of any length; sums are kept in logarithms by language."""
    ids = lattice.spans([word])[0]
    table, n = np.vstack([prob, np.zeros(prob.shape[1])]), len(ids)
    forward, backward = np.zeros((n + 1, prob.shape[1])), np.zeros((n + 1, prob.shape[1]))
    for j in range(1, n + 1):  # the shortest piece leads to each place, so that no sum is zero
        k = np.arange(min(j, lattice.longest))
        forward[j] = forward[j - 1] + np.log((np.exp(forward[j - k - 1] - forward[j - 1]) * table[ids[j - k - 1, k]]).sum(axis=0))
    for i in range(n - 1, -1, -1):
        k = np.arange(min(n - i, lattice.longest))
        backward[i] = backward[i + 1] + np.log((np.exp(backward[i + k + 1] - backward[i + 1]) * table[ids[i, k]]).sum(axis=0))
    for k in range(min(n, lattice.longest)):
        has = np.flatnonzero(ids[: n - k, k] <= lattice.n)
        np.add.at(total, ids[has, k], np.exp(forward[has] + backward[has + k + 1] - forward[n]) * table[ids[has, k]] * weight)


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # by piece id (the unknown piece last) and language


def fit(
    labelled: DataFrame,
    vocabulary: str,
    *,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = 1500,
    rounds: int = 3,
    smoothing: float = 0.05,
    longest_piece: int = 8,
    most_languages: int = 4096,
) -> LanguageModel:
    """Piece probabilities by language, from labelled rows.

    The classifier is fitted on a bounded sample, of about ``rows_per_language`` rows of each language drawn by a hash of
    the key. Only (piece, language) sums come to the driver, at most the vocabulary's size for each language.
    """
    spark = labelled.sparkSession
    bounded_batches(spark, rows=500, mb=2)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {str(r["l"]): r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages, pieces = sorted(sizes), read_pieces(vocabulary, longest_piece)
    prob = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    if not languages:
        return LanguageModel([], pieces, prob)
    million = 1_000_000
    shares = [(name, min(million, -(-rows_per_language * million // sizes[name]))) for name in languages]
    share = F.broadcast(spark.createDataFrame(shares, "l string, share int"))  # a row for each language
    sample = rows.withColumn("l", F.col("l").cast("string")).join(share, "l").where(F.pmod(F.xxhash64("k"), F.lit(million)) < F.col("share"))
    runs = F.pandas_udf(lambda s: s.map(letter_runs), "array<string>")
    words = cut(sample.select("l", F.explode(runs("t")).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n")))
    index, lattice_of = {name: i for i, name in enumerate(languages)}, Lattice
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, prob))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces, prob = shared.value
            lattice, total = lattice_of(pieces), np.zeros(prob.shape)
            for pdf in batches:
                names, inverse = np.unique(pdf["w"].to_numpy(object), return_inverse=True)
                weight = np.zeros((len(names), prob.shape[1]))
                np.add.at(weight, (inverse, pdf["l"].map(index).to_numpy()), pdf["n"].to_numpy())
                for i in range(0, len(names), 20_000):
                    total += expected_counts(lattice, prob, list(names[i : i + 20_000]), weight[i : i + 20_000])
            piece, lang_at = np.nonzero(total)
            yield pd.DataFrame({"p": piece, "k": lang_at, "c": total[piece, lang_at]})

        sums = words.mapInPandas(expect, "p int, k int, c double").groupBy("p", "k").agg(F.sum("c").alias("c")).toPandas()
        count = np.zeros(prob.shape)
        count[sums["p"], sums["k"]] = sums["c"]
        prob = (count + smoothing) / (count + smoothing).sum(axis=0)
        shared.unpersist()
    return LanguageModel(languages, pieces, prob)


def identify(spark: SparkSession, model: LanguageModel, text: Column, cache_words: int = 100_000) -> Column:
    """struct<lang, score> of each text: the likeliest language and its share of the summed likelihoods (equal priors)."""
    bounded_batches(spark, rows=500, mb=2)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names, lattice = np.array([*m.languages, "und"], object), Lattice(m.pieces)
        known: dict[str, int] = {}
        logs = np.empty((0, len(m.languages)))
        for texts in batches:
            runs = [letter_runs(t) for t in texts]
            flat = [w for r in runs for w in r]
            new = list(set(flat) - known.keys())
            if len(known) + len(new) > cache_words:
                known, logs, new = {}, logs[:0], list(set(flat))
            if new and m.languages:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                logs = np.vstack([logs, *(log_marginals(lattice, m.prob, new[i : i + 4_000]) for i in range(0, len(new), 4_000))])
            counts = np.array([len(r) for r in runs], np.int64)
            best, score = np.full(len(runs), len(m.languages)), np.zeros(len(runs))
            if flat and m.languages:
                at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                has = np.flatnonzero(counts)
                sums = np.add.reduceat(logs[at], (np.cumsum(counts) - counts)[has])
                best[has] = sums.argmax(axis=1)
                score[has] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang": names[best], "score": score})

    return predict.asNondeterministic()(text)
