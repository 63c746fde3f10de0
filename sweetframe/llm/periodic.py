"""Periodic run detection: stretches of a text whose words repeat with one period three times or more.

A run is a maximal stretch of words with smallest period q that is at least ``max(least, times * q)`` words long. Its
matches, the places i whose word equals the one at i + q, are an interval of ``max(least - q, (times - 1) * q)`` places or
more. Periods are searched by octaves P .. 2 P - 1, and places are dealt into cells of C = P words, 8 at least: a run's
matches fill at least one cell whole. Whether period q fills the cell that begins at boundary b is told by the boundary's
Z-function, Z(q) >= C, the words from b against those from b + q. That is asked of all boundaries and all periods of the
octave at once, by names of stretches (64-bit hashes of 2 ** k words, by doubling): n comparisons an octave. Full cells
whose stretch has a smaller period, which then divides q, are part of that period's run and are passed over. The others
are extended to both sides by comparing words, as far as a cell more, so that no run is told by hashes alone.

Documents are exploded into overlapping tiles: one set for all small octaves, and one for each larger octave, whose tiles
grow with the period. A tile is solved by itself, in memory of its own size, and yields intervals of matches that end
inside it or at its edge. These fragments are shuffled by (document, period) and stitched where they overlap. Tiles of
texts of ``deal_from`` bytes or more are dealt over the cluster; those of others are solved where the text was read, as
dealing them out would only move all texts once more.

Defined cases: null, empty and blank texts have no words and no runs; rows that repeat have the same runs each; ties don't
arise, as a stretch has one smallest period; very long texts are searched whole, by tiles; an empty table gives no rows; a
null id is an id like any other, and rows of one id with different texts are told apart; other columns stay as they are,
and those named like a result are kept with ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut, freed

_CELL = 8  # words of the smallest cell
_CORE = 1 << 13  # words of a tile of the small octaves, besides its margins
_CELLS = 16  # cells of a tile of a larger octave
_TILE = "key string, hash bigint, low int, high int, start bigint, core bigint, core_end bigint, ends boolean, words binary"
_FRAGMENT = "key string, hash bigint, period bigint, first bigint, last bigint"
_HELD = 1 << 19  # words of tiles in one batch, besides its last tile
_COMPARED = 1 << 18  # boundaries and periods that are compared at once
_SMALL = 64 << 20  # bytes of runs up to which they are broadcast


def octaves(words: int, times: int) -> list[int]:
    """The first periods P of the octaves that a document of so many words can have runs of; 1 .. 15 are one octave."""
    return [1, *(1 << k for k in range(4, 63) if (1 << k) * times <= words)] if words else []


def _cell(octave: int) -> int:
    return max(_CELL, octave)


def _last(octave: int) -> int:
    """The largest period of the octave."""
    return 2 * _CELL - 1 if octave == 1 else 2 * octave - 1


def tiles(words: int, times: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first octave, last octave, begin, end, core begin, core end) of a document's tiles, in words.

    The core's cells are searched; a cell more to the left, and one more and a period to the right, are there to extend
    into. All octaves whose tile would be the whole document share it.
    """
    sets: dict[int, list[int]] = {}
    for p in octaves(words, times):
        sets.setdefault(min(max(_CORE, _cell(p) * _CELLS), max(_CORE, words)), []).append(p)
    for own in sets.values():
        low, high = own[0], own[-1]
        core = max(_CORE, _cell(high) * _CELLS)
        for a in range(0, words, core):
            yield low, high, max(0, a - _cell(high)), min(words, a + core + _cell(high) + _last(high)), a, min(words, a + core)


@lru_cache(1 << 16)
def _primes(n: int) -> tuple[int, ...]:
    """The prime factors of n."""
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*found, n) if n > 1 else tuple(found)


class Names:
    """Names of stretches of 2 ** k words: equal stretches have one name."""

    def __init__(self, words: np.ndarray):
        x = words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        self.levels = [_mix(x)]

    def of(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mix(h[: max(0, len(h) - half)] * np.uint64(0xD6E8FEB86659FD93) + h[half:]))
        return self.levels[k]

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of that length (1 or more) from a and from b are equal."""
        out = np.zeros(len(a), bool)
        power = np.frexp(length)[1] - 1
        for k in np.unique(power).tolist():
            own = power == k
            h, end = self.of(k), length[own] - (1 << k)
            out[own] = (h[a[own]] == h[b[own]]) & (h[a[own] + end] == h[b[own] + end])
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _full_cells(names: Names, n: int, octave: int, begin: int, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) of the cells with boundaries in begin .. end that a period of the octave fills.

    Boundaries are multiples of the cell's size in the document, where the tile begins at ``start``.
    """
    c, periods = _cell(octave), np.arange(octave, _last(octave) + 1)
    h = names.of(c.bit_length() - 1)
    boundary = np.arange(-(-(start + begin) // c) * c - start, end, c)
    boundary = boundary[boundary + c + octave <= n]
    at, period = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, _COMPARED // len(periods))
    for b in (boundary[i : i + step, None] for i in range(0, len(boundary), step)):
        to = b + periods
        i, j = np.nonzero((h[np.minimum(to, len(h) - 1)] == h[b]) & (to < len(h)))
        at.append(b[i, 0])
        period.append(periods[j])
    return np.concatenate(at), np.concatenate(period)


def _primitive(names: Names, at: np.ndarray, period: np.ndarray, cell: int) -> np.ndarray:
    """Whether the stretch of a full cell and one period more has no smaller period that divides its period."""
    own, of = np.unique(period, return_inverse=True)
    parts = [[q // prime for prime in _primes(q)] for q in own.tolist()]
    times = np.array([len(x) for x in parts], np.int64)
    first = np.cumsum(times) - times
    row = np.repeat(np.arange(len(at)), times[of])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times[of]) - times[of], times[of])
    d = np.array([x for part in parts for x in part], np.int64)[first[of[row]] + nth]
    same = names.equal(at[row], at[row] + d, cell + period[row] - d)
    return np.bincount(row[same], minlength=len(at)) == 0


def fragments(words: np.ndarray, low: int, high: int, begin: int, end: int, start: int, ends: bool, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(period, first, last) intervals of matches, in places of the tile and without ``last``, about cells in begin .. end.

    start: the tile's place in the document; ends: whether it ends with the document. Intervals that end inside the tile
    and are too short for a run are left out.
    """
    names, n = Names(words), len(words)
    for octave in (p for p in octaves(start + n, times) if low <= p <= high):
        c = _cell(octave)
        if n < c + octave:
            continue
        at, period = _full_cells(names, n, octave, begin, end, start)
        keep = _primitive(names, at, period, c)
        order = np.lexsort((at[keep], period[keep]))
        at, period = at[keep][order], period[keep][order]
        row = np.flatnonzero((period[1:] != period[:-1]) | (at[1:] - at[:-1] != c)) + 1
        for i, j in pairwise([0, *row.tolist(), len(at)] if len(at) else []):
            q = int(period[i])
            a, b = int(at[i]), int(at[j - 1]) + c  # the full cells
            lo, hi = max(0, a - c), min(n - q, b + c)
            same = words[lo:hi] == words[lo + q : hi + q]
            if not same[a - lo : b - lo].all():
                continue  # two stretches with one name
            before, after = np.flatnonzero(~same[: a - lo]), np.flatnonzero(~same[b - lo :])
            a = lo + int(before[-1]) + 1 if len(before) else lo
            b += int(after[0]) if len(after) else hi - b
            cut_off = a == lo and start + lo > 0 or b == hi and not (ends and hi == n - q)
            if cut_off or b - a >= max(least - q, (times - 1) * q):
                yield q, a, b


def _ids(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))


def _arrow(shape: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in shape.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _explode(least: int, times: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of key, hash and text in; tiles out, a bounded number of words at a time."""
        rows, held = [], 0
        for batch in batches:
            for key, own, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = text.as_py().split() if text.is_valid else []
                ids = _ids(words) if len(words) >= least else np.empty(0, np.int32)
                for low, high, a, b, core, core_end in tiles(len(ids), times):
                    rows.append((key.as_py(), own.as_py(), low, high, a, core, core_end, b == len(ids), ids[a:b].tobytes()))
                    held += b - a
                    if held >= _HELD:
                        yield _arrow(_TILE, rows)
                        rows, held = [], 0
        yield _arrow(_TILE, rows)

    return explode


def _solve(least: int, times: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile in batch.to_pylist():
                words, start = np.frombuffer(tile["words"], np.int32), tile["start"]
                found = fragments(words, tile["low"], tile["high"], tile["core"] - start, tile["core_end"] - start, start, tile["ends"], least, times)
                rows += [(tile["key"], tile["hash"], q, start + a, start + b) for q, a, b in found]
            yield _arrow(_FRAGMENT, rows)

    return solve


def _id(docs: DataFrame, text: str, key: str) -> list[Column]:
    return [F.col(f"`{key}`").cast("string").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash")]


def runs_of(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: int = 24, times: int = 3, deal_from: int = 8 << 20) -> DataFrame:
    """(key, hash, runs) of the texts with a run. runs: array of struct<start, length, period> by start, then period."""
    if times < 3 or least < 22:
        raise ValueError("runs repeat three times or more and have 22 words or more: shorter ones may fill no cell")
    bounded_batches(docs.sparkSession, rows=500, mb=4)
    rows = docs.select(*_id(docs, text, key), F.col(f"`{text}`").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= deal_from, F.lit(False))
    explode = _explode(least, times)
    own = rows.where(~is_long).mapInArrow(explode, _TILE)
    dealt = rows.where(is_long).mapInArrow(explode, _TILE).repartition("key", "hash", "low", "start")
    found = own.mapInArrow(_solve(least, times), _FRAGMENT).unionByName(dealt.mapInArrow(_solve(least, times), _FRAGMENT))

    by = Window.partitionBy("key", "hash", "period").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("apart", F.when(F.col("first") <= before, 0).otherwise(1))
    stitched = apart.withColumn("island", F.sum("apart").over(by)).groupBy("key", "hash", "period", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    length = F.col("last") - F.col("first") + F.col("period")
    runs = stitched.where((length >= least) & (length >= times * F.col("period"))).select("key", "hash", F.struct(F.col("first").alias("start"), length.alias("length"), "period").alias("run"))
    return runs.groupBy("key", "hash").agg(F.array_sort(F.transform(F.collect_list("run"), lambda r: F.struct(r["start"], r["period"], r["length"]))).alias("runs")).select(
        "key", "hash", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs")
    )


def periodic_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """docs with ``runs``, an array of struct<start, length, period>, empty where there are none; settings: those of runs_of.

    Runs are far fewer than texts; they are broadcast if the table of them is small, and else joined by a shuffle.
    """
    runs = cut(runs_of(docs, text=text, key=key, **settings)).withColumnsRenamed({"key": "run_key", "hash": "run_hash", "runs": "own_runs"})
    weight = runs.agg(F.sum(F.size("own_runs") * 24 + F.coalesce(F.octet_length("run_key"), F.lit(0)) + 64)).first()[0] or 0
    docs = freed(docs, ["runs"])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_id(docs, text, key))
    same = F.col("key").eqNullSafe(F.col("run_key")) & (F.col("hash") == F.col("run_hash"))
    told = whole.join(F.broadcast(runs) if weight <= _SMALL else runs.hint("shuffle_hash"), same, "left")
    none = F.array().cast("array<struct<start: bigint, length: bigint, period: bigint>>")
    return told.select("row.*", F.coalesce("own_runs", none).alias("runs"))


def collapsed_words(words: list[str], runs: list[dict]) -> list[str]:
    """The words but those in a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    return [w for w, n in zip(words, np.cumsum(gone).tolist(), strict=False) if not n] if len(runs) else words


def collapsed(text: Column, runs: Column) -> Column:
    """The text's words joined by one blank, of each run the first period only; empty for a null text."""

    @F.pandas_udf("binary")
    def shorter(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([b" ".join(collapsed_words(t.split() if t else [], r)) for t, r in zip(texts, found, strict=True)])

    return shorter(text.cast("binary"), runs).cast("string")
