"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is taken as its words, parted by one blank, between an end mark and another one. The tree holds variable-length
contexts: a context of up to ``depth`` bytes stays if it occurs at least ``least`` times and its next-byte distribution
diverges from that of its own suffix. Next-byte distributions are smoothed towards the suffix's, down to a uniform floor,
so that each byte has a positive probability. A byte's probability is that in the longest suffix of its context that the
tree holds; the sum of log10 probabilities is that of the whole text.

The tree grows with the corpus and lies in tables, one for each length of context: workers count what they read, Spark sums
by byte run, and each level's divergence tests are a join with the level below it and a window over the at most 256 next
bytes of a context. A byte run (a byte with its context) has one score, so that a text's score is a join of its runs with
the tree. The most frequent runs, a bounded number, are looked up in the workers instead; all others are joined, and those
that the corpus has not at all are resolved level by level. Frequent words are treated in the same way.

Scores are summed as whole numbers of 1e-9, so that neither the partitioning nor the order of rows changes them.

Beside the tree, the plain word model that texts are compared with is counted in the same pass.

Defined cases: null and empty texts are the end mark alone; an untrained model has N = V = 0 and uniform bytes; repeated
rows get the same answer each, also for repeated keys; words may hold any byte but white space; ties don't arise; very long
texts are scored in pieces; a column of the table with the name of a result is kept with ``_`` appended.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut, freed, spare

_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = 10  # the end mark, which no word holds
_MOST_COUNTED = 600_000  # distinct items that a worker counts before it hands them on


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split() if text else []


def _joined(words: list[list[bytes]]) -> np.ndarray:
    """End mark, words, end mark, words, ..., end mark; a zero byte becomes 255, which no UTF-8 text has."""
    return np.frombuffer(b"".join([b"\n", *(b" ".join(w) + b"\n" for w in words)]).replace(b"\0", b"\xff"), np.uint8)


def runs_of(text: np.ndarray, depth: int) -> np.ndarray:
    """Each byte but the first with the up to ``depth`` bytes before it, not past an end mark; packed, the byte last.

    A run of fewer bytes begins with an end mark, so packing is unambiguous.
    """
    packed = np.zeros(max(0, len(text) - 1), np.int64)
    closed = np.zeros(len(packed), bool)
    for back in range(depth + 1):
        at = text[max(0, 1 - back) : len(text) - back].astype(np.int64)
        at = np.concatenate([np.zeros(len(packed) - len(at), np.int64), at])
        packed |= np.where(closed, 0, at) << (8 * back)
        if back:
            closed |= at == END
    return packed


def count(docs: DataFrame, text: str = "text", depth: int = 5) -> DataFrame:
    """(word, run, n): counts of each word (run null; an empty word is the end) and of each byte run (word null)."""
    bounded_batches(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        runs, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for keys, n, which in ((list(words), list(words.values()), 0), (runs, times, 1)):
                for i in range(0, len(keys), 100_000):
                    part = n[i : i + 100_000]
                    nulls = pa.nulls(len(part), pa.int64()) if which == 0 else pa.nulls(len(part), pa.binary())
                    own = pa.array(keys[i : i + 100_000], pa.binary() if which == 0 else pa.int64())
                    yield pa.RecordBatch.from_arrays([own, nulls, pa.array(part, pa.int64())] if which == 0 else [nulls, own, pa.array(part, pa.int64())], ["word", "run", "n"])

        for batch in batches:
            split = [split_words(t) for t in batch.column(0).to_pylist()]
            for w in split:
                words.update(w)
            words[b""] += len(split)
            new, n = np.unique(runs_of(_joined(split), depth), return_counts=True)
            runs, inverse = np.unique(np.concatenate([runs, new]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, n])).astype(np.int64)
            if len(words) > _MOST_COUNTED or len(runs) > 2 * _MOST_COUNTED:
                yield from told()
                words.clear()
                runs, times = runs[:0], times[:0]
        yield from told()

    return docs.select(text).mapInArrow(counts, "word binary, run bigint, n bigint").groupBy("word", "run").agg(F.sum("n").alias("n"))


UNIT = 1e9  # scores are whole numbers of 1 / UNIT


@dataclass(frozen=True)
class Tree:
    """By length of context, 0 to depth: its rows of context and byte.

    Columns: context (packed, the nearest byte lowest), byte, n, p (smoothed), used (of the longest suffix in the tree), and
    of the context: all, back (the weight of the suffix's distribution), kept, and lead, true in one of its rows.
    """

    levels: tuple[DataFrame, ...]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def runs(self) -> DataFrame:
        """(run, n, score) of each run of the corpus: whole contexts are of full depth, or begin with an end mark."""
        out = None
        for d, level in enumerate(self.levels[1:], 1):
            whole = level if d == self.depth else level.where(F.shiftright("context", 8 * (d - 1)) == END)
            rows = whole.select((F.shiftleft("context", 8) + F.col("byte")).alias("run"), "n", _units(F.col("used")).alias("score"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def unseen(self, runs: DataFrame) -> DataFrame:
        """(run, score) of distinct runs that the corpus may not have; runs: run."""
        now = runs.select("run", F.shiftright("run", 8).alias("whole"), F.col("run").bitwiseAND(255).alias("last"), F.lit(1.0).alias("factor"), F.lit(False).alias("on"), F.lit(None).cast("double").alias("value"))
        for d in range(self.depth, 0, -1):
            level, at = self.levels[d], F.col("whole").bitwiseAND((1 << (8 * d)) - 1)
            contexts = level.where("lead").select(F.col("context").alias("context_"), "all", "back", "kept")
            now = now.withColumn("at", at)
            now = now.join(level.select("context", "byte", "p", "used"), (F.col("at") == F.col("context")) & (F.col("last") == F.col("byte")), "left").drop("context", "byte")
            now = now.join(contexts, F.col("at") == F.col("context_"), "left").drop("context_")
            # once in a context of the tree, its distribution goes on along the suffixes that it is smoothed with
            on = F.col("on") | F.coalesce("kept", F.lit(False))
            step = F.when(on & F.col("all").isNotNull(), F.col("back") / (F.col("all") + F.col("back"))).otherwise(1.0)
            value = F.coalesce("value", F.col("factor") * F.when(F.col("on"), F.col("p")).otherwise(F.col("used")))
            now = now.select("run", "whole", "last", (F.col("factor") * step).alias("factor"), on.alias("on"), value.alias("value"))
        floor = F.broadcast(self.levels[0].select("byte", "p"))  # 256 rows
        return now.join(floor, F.col("last") == F.col("byte")).select("run", _units(F.coalesce("value", F.col("factor") * F.col("p"))).alias("score"))


def _units(p: Column) -> Column:
    return F.round(F.log10(p) * UNIT).cast("long")


def grow(counts: DataFrame, depth: int = 5, least: int = 4, divergence: float = 0.0, floor: float = 1e-6, prior: float = 0.5) -> Tree:
    """The tree of a count() result.

    A context stays if it occurs ``least`` times and its count times its divergence from its suffix's distribution exceeds
    what chance gives: 2 nats for each kind of next byte, and ``divergence`` nats for each byte counted.
    """
    full = counts.where("run is not null").select(F.shiftright("run", 8).alias("context"), F.col("run").bitwiseAND(255).alias("byte"), "n")
    sums = [full]
    for d in range(depth - 1, -1, -1):
        sums.insert(0, cut(sums[0].groupBy(F.col("context").bitwiseAND((1 << (8 * d)) - 1).alias("context"), "byte").agg(F.sum("n").alias("n"))))
    level = _bottom(sums[0], floor, prior)
    levels = [level]
    for d in range(1, depth + 1):
        suffix = F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1)
        below = level.select(F.col("context").alias("suffix"), F.col("byte").alias("suffix_byte"), F.col("p").alias("parent"), F.col("used").alias("parent_used"))
        # contexts that an end mark makes shorter than d belong to other levels
        own = sums[d].where(F.shiftright("context", 8 * (d - 1)) > 0).withColumn("at", suffix)
        own = own.join(F.broadcast(below) if d == 1 else below, (F.col("at") == F.col("suffix")) & (F.col("byte") == F.col("suffix_byte")))
        of = Window.partitionBy("context")
        own = own.withColumn("all", F.sum("n").over(of)).withColumn("kinds", F.count("*").over(of)).withColumn("first", F.min("byte").over(of))
        own = own.withColumn("told", F.round(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("parent")) * 1e6).cast("long"))
        own = own.withColumn("told", F.sum("told").over(of) / 1e6).withColumn("back", prior * F.col("kinds"))
        kept = (F.col("all") >= least) & (F.col("told") > divergence * F.col("all") + 2 * F.col("kinds"))
        own = own.withColumn("p", (F.col("n") + F.col("back") * F.col("parent")) / (F.col("all") + F.col("back"))).withColumn("kept", kept)
        used = F.when(F.col("kept"), F.col("p")).otherwise(F.col("parent_used"))
        level = cut(own.select("context", "byte", "n", "p", used.alias("used"), "all", "back", "kept", (F.col("byte") == F.col("first")).alias("lead")))
        levels.append(level)
    return Tree(tuple(levels))


def _bottom(sums: DataFrame, floor: float, prior: float) -> DataFrame:
    """The level of the empty context: all 256 bytes, each with at least about ``floor``."""
    spark, of = sums.sparkSession, Window.partitionBy(F.lit(0))
    rows = spark.range(256).select(F.col("id").alias("byte")).join(F.broadcast(sums.select(F.col("byte").alias("seen"), "n")), F.col("byte") == F.col("seen"), "left")
    rows = rows.select("byte", F.coalesce("n", F.lit(0)).alias("n")).withColumn("all", F.sum("n").over(of)).withColumn("back", prior * F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(of))
    raw = F.when(F.col("all") > 0, F.greatest((F.col("n") + F.col("back") / 256) / (F.col("all") + F.col("back")), F.lit(floor))).otherwise(1 / 256)
    # the sum of 256 numbers in order, so that it is the same in each run
    whole = F.aggregate(F.sort_array(F.collect_list("raw").over(of)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("raw", raw).withColumn("p", F.col("raw") / whole)
    return cut(rows.select(F.lit(0).cast("long").alias("context"), "byte", "n", "p", F.col("p").alias("used"), "all", "back", F.lit(True).alias("kept"), (F.col("byte") == 0).alias("lead")))


class Lookup:
    """Whole numbers by key: the most frequent keys have a slot of their own, those that lose it are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, times: np.ndarray, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        order = np.lexsort((keys, times))
        keys, values = keys[order], values[order]
        slot = self._slot(keys)
        self.key[slot], self.value[slot] = keys, values  # of equal slots the last one stays
        lost = np.flatnonzero(self.key[slot] != keys)
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_value = keys[lost], values[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; places of the keys without one)."""
        slot = self._slot(keys)
        has = self.key[slot] == keys
        out = np.where(has, self.value[slot], 0)
        rest = np.flatnonzero(~has)
        if len(self.lost) and len(rest):
            at = np.minimum(np.searchsorted(self.lost, keys[rest]), len(self.lost) - 1)
            same = self.lost[at] == keys[rest]
            out[rest[same]] = self.lost_value[at[same]]
            rest = rest[~same]
        return out, rest


def known_scores(lookup: Lookup, joined: np.ndarray, depth: int, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the known scores by text; text and run of each byte whose run the lookup doesn't have)."""
    ends = np.flatnonzero(joined == END)
    sums, texts, rare = np.zeros(len(ends) - 1, np.int64), [], []
    for a in range(1, len(joined), piece):
        begin = max(0, a - depth)
        runs = runs_of(joined[begin : a + piece], depth)[a - begin - 1 :]
        score, missing = lookup(runs)
        text = np.searchsorted(ends, np.arange(a, a + len(runs))) - 1
        edges = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        np.add.at(sums, text[edges], np.add.reduceat(score, edges))
        texts.append(text[missing])
        rare.append(runs[missing])
    return sums, np.concatenate([*texts, np.empty(0, np.int64)]), np.concatenate([*rare, np.empty(0, np.int64)])


SHAPE = (
    "struct<n_tokens: bigint, known: bigint, known_log: double, rare: array<struct<word: binary, n: bigint>>, "
    "tree_known: bigint, runs: array<bigint>, times: array<bigint>>"
)


def _frequent(counted: DataFrame, most: int) -> pa.Table:
    """The most frequent rows by n, at most ``most``, all those above one count. As Arrow: rows would take the driver's memory."""
    level = F.floor(F.log2("n") * 16)
    sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    taken, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        taken += r["rows"]
        if taken > most:
            break
        least = r["level"]
    return (counted.where(level >= least) if least is not None else counted.limit(0)).toArrow()


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "tree_score")


def assess(docs: DataFrame, train: DataFrame, *, text: str = "text", depth: int = 5, least: int = 4, frequent_words: int = 100_000, frequent_runs: int = 500_000) -> DataFrame:
    """docs' columns but the text, and n_tokens, n_known, train_tokens, base_score and tree_score.

    train has the texts to learn from. base_score is the word model's log10 probability with 0.1 added to each count.
    """
    spark = docs.sparkSession
    counts = cut(count(train, text, depth))
    tree = grow(counts, depth, least)
    scores = cut(tree.runs())
    words = counts.where("word is not null").select("word", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n_train = int(facts["N"])
    below = float(np.log10(n_train + 0.1 * (facts["V"] + 1)))
    often, runs = _frequent(words, frequent_words), _frequent(scores, frequent_runs)
    shared = spark.sparkContext.broadcast(({w.as_py(): i for i, w in enumerate(often["word"])}, often["n"].to_numpy(), *(runs[c].to_numpy() for c in ("run", "score", "n"))))

    @F.pandas_udf(SHAPE)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, n, *known = shared.value
        lookup, logs = Lookup(*known), np.append(np.log10(n + 0.1), 0.0)
        for texts in batches:
            split = [split_words(t) for t in texts]
            sums, of, run = known_scores(lookup, _joined(split), depth)
            order = np.lexsort((run, of))
            of, run = of[order], run[order]
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (run[1:] != run[:-1])))) if len(of) else np.empty(0, np.int64)
            times, run, place = np.diff(np.append(first, len(of))), run[first], np.searchsorted(of[first], np.arange(len(split) + 1))
            rows, get, none = [], index.get, len(n)
            for w in split:
                w = [*w, b""]
                ids = [get(x, none) for x in w]
                rare = Counter(x for x, i in zip(w, ids, strict=True) if i == none)
                rows.append((len(w), len(w) - sum(rare.values()), float(logs[ids].sum()), [{"word": k, "n": v} for k, v in sorted(rare.items())]))
            cuts = list(zip(place[:-1].tolist(), place[1:].tolist(), strict=True))
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "known", "known_log", "rare"))} | {"tree_known": sums, "runs": [run[a:b] for a, b in cuts], "times": [times[a:b] for a, b in cuts]})

    bounded_batches(spark)
    own = spare(docs.columns, "__text")
    docs = freed(docs.withColumnRenamed(text, own), RESULTS)
    others = [F.col(f"`{c}`") for c in docs.columns if c != own]
    row = F.struct(*others) if others else F.lit(None)
    keyed = docs.select(row.alias("row"), scored.asNondeterministic()(F.col(own)).alias("s")).withColumn("id", F.monotonically_increasing_id())
    first = cut(keyed.select("id", "row", "s.*"))
    rare = first.select("id", F.explode("rare").alias("r")).select("id", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    found = rare.join(words.withColumnRenamed("n", "c"), "word", "left")
    log = (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).cast("decimal(30,15)")  # sums don't depend on the order
    found = found.groupBy("id").agg(F.sum(log).cast("double").alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    told = first.select("id", F.explode(F.arrays_zip("runs", "times")).alias("r")).select("id", F.col("r.runs").alias("run"), F.col("r.times").alias("times"))
    told = cut(told.join(scores.select("run", "score"), "run", "left"))
    new = told.where("score is null")
    late = new.join(tree.unseen(cut(new.select("run").distinct())).withColumnRenamed("score", "late"), "run").select("id", "times", F.col("late").alias("score"))
    tree_rare = told.where("score is not null").select("id", "times", "score").unionByName(late).groupBy("id").agg(F.sum(F.col("times") * F.col("score")).alias("tree_rare"))
    whole = first.select("id", "row", "n_tokens", "known", "known_log", "tree_known").join(found, "id", "left").join(tree_rare, "id", "left")
    base = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)
    return whole.select(
        *(["row.*"] if others else []),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("tree_known") + F.coalesce("tree_rare", F.lit(0))) / UNIT).alias("tree_score"),
    )
