"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping probes of ``probe`` characters, one every ``stride``, and shorter ones of ``short``
characters that must match exactly. Any excerpt of an item that is as long as a probe lies within stride / 2 characters of
one, each of which takes an edit: with the settings given, all excerpts of 40 characters are found if unchanged, all of 80
with up to 2 edits, and all of 87 with up to 6. A stretch of text within e edits of a probe of m characters shares at least
m + 1 - q * (e + 1) character q-grams with it, all near one diagonal. Hits are counted by probe in overlapping diagonal
bands, stretches that meet the bound are kept, and each is verified by a banded alignment. Both sides are compared in a
plain form: lower case, runs of letters and digits, one blank between them.

Texts are scanned once. The workers have a table of bits for the benchmark's q-grams (of bounded size; a full one costs
time, not results) and keep the pieces of a text where enough of them crowd. Pieces are joined with the items by q-gram in
Spark and counted by diagonal band; each pair of a piece and an item with a full band is verified on its own, by probe.

Defined cases: null and empty texts and items match nothing; items of fewer than ``least`` plain characters match exact
copies of all their words; other items shorter than a probe are one probe; items may have ids of any type that a string can
be cast to, null ones too; equal items are one; repeated rows get the same answer each; very long texts are scanned whole;
ties of the alignment go to the least start; empty tables give no rows, or, as a benchmark, leave all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut

_WORD = re.compile(r"[^\W_]+")
_MIX = 0x9E3779B97F4A7C15
_BITS, _CHUNK, _STEP = 22, 1 << 18, 8
_WORK = 1 << 17  # places of probes that are told apart by band at once
_ITEMS = 1 << 16  # characters of items whose probes are held at once
_SEPARATOR = 10  # between texts; plain texts don't hold it


def lowered(text: str) -> str:
    """Lower case, with a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def plain(text: str | None) -> str:
    return " ".join(_WORD.findall(lowered(text))) if text else ""


def source_span(starts: list[int], text: str, start: int, end: int) -> tuple[int, int]:
    """Where text[start:end], plain words whose source places are ``starts``, stands in the source."""
    at, first, last = 0, None, 0
    for place, word in zip(starts, text.split(" "), strict=True):
        if first is None and start < at + len(word) + 1:
            first = place + min(len(word), max(0, start - at))
        if at < end:
            last = place + min(len(word), end - at)
        at += len(word) + 1
    return first or 0, last


def align(probes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the stretch of each window nearest to its probe; both by row, of one length each.

    Starts lie at 0 .. windows' length - probes' length, which is the band's width. A stretch can't hold a separator.
    """
    length, width = probes.shape[1], windows.shape[1] - probes.shape[1]
    p, x = np.ascontiguousarray(probes.T), np.ascontiguousarray(windows.T)
    one, barred = np.int64(1 << 20), np.int64(1 << 40)  # an edit; the start is kept in the lower bits
    row = np.repeat(np.arange(width + 1, dtype=np.int64)[:, None], len(probes), axis=1)
    stop = np.where(x == _SEPARATOR, barred, one)
    for i in range(length):
        new = row + np.where(x[i : i + width + 1] == p[i], 0, stop[i : i + width + 1])
        np.minimum(new[:-1], row[1:] + one, out=new[:-1])
        for d in range(1, width + 1):
            np.minimum(new[d], new[d - 1] + stop[i + d], out=new[d])
        row = new
    d = (row >> 20).argmin(axis=0)
    best = row[d, np.arange(len(probes))]
    return best >> 20, best & (one - 1), length + d


@dataclass
class Settings:
    probe: int = 80
    rate: float = 0.075  # edits by character of a probe
    q: int = 10
    least: int = 30
    stride: int = 8  # from one probe of an item to the next
    short: int = 32  # of the probes without edits

    def edits(self, size: np.ndarray) -> np.ndarray:
        return np.minimum((size * self.rate).astype(np.int64), (size + 1) // self.q - 2).clip(0)

    def bounds(self) -> tuple[int, int]:
        """(fewest q-grams that a match shares with its probe, widest reach of its q-grams' places)."""
        size = np.arange(min(self.least, self.probe), self.probe + 1)
        edits = self.edits(size)
        return int(min((size + 1 - self.q * (edits + 1)).min(), self.short + 1 - self.q)), int(max((size + edits).max(), self.short) - self.q)


class Probes:
    """The probes of a block of items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.q, self.text, self.item, exact = s.q, [], [], []
        for item, text in items:
            for size in (s.probe, s.short):
                if len(text) >= s.least and (size == s.probe or len(text) > size):
                    starts = range(0, max(1, len(text) - size + 1), s.stride)
                    for a in sorted({*starts, max(0, len(text) - size)}):
                        self.text.append(text[a : a + size])
                        self.item.append(item)
                        exact.append(size == s.short)
        size = self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.where(np.array(exact, bool), 0, s.edits(size))
        self.need = size + 1 - s.q * (self.edits + 1)
        self.reach = size + self.edits - s.q
        grams = [gram_hashes(codes(t), s.q) for t in self.text]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hash, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.probe = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.empty(0, np.int32)])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, gram) of each q-gram that a probe has."""
        places, grams = [], []
        for a in range(0, len(text), _CHUNK):
            h = gram_hashes(text[a : a + _CHUNK + self.q - 1], self.q)
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
            same = self.hash[slot] == h[maybe]
            places.append(maybe[same] + a)
            grams.append(slot[same])
        return np.concatenate(places), np.concatenate(grams)

    def stretches(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(probe, band start) of each band where enough q-grams of a probe stand close enough together."""
        if not len(self.hash) or not len(text):
            return []
        places, grams = self.hits(text)
        near = _crowded(places, np.zeros(len(places), np.int64), int(self.need.min()), int(self.reach.max()))
        places, grams = places[near], grams[near]
        out, work, reach, i = set(), np.cumsum(self.times[grams]), int(self.reach.max()), 0
        while i < len(places):
            # places of bounded work, and those that a crowd beginning among them can reach
            j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + _WORK, side="right")))
            end = int(np.searchsorted(places, places[j - 1] + reach, side="right"))
            out |= self._full(places[i:end], grams[i:end], len(text))
            i = j
        return sorted(out)

    def _full(self, places: np.ndarray, grams: np.ndarray, length: int) -> set[tuple[int, int]]:
        """The bands in which enough of these places crowd, of a text of that length."""
        times = self.times[grams]
        entry = np.repeat(self.first[grams] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place, probe = np.repeat(places, times), self.probe[entry].astype(np.int64)
        band = (place - self.at[entry]) // _STEP
        # band b covers the diagonals 8 b .. 8 b + 15, so that each diagonal lies in two and any 9 in a row in one
        least, wide = int(band.min()) - 1, int(band.max() - band.min()) + 2
        row = (probe * wide + band - least) * (length + 1) + place
        row = np.unique(np.concatenate([row, row - (length + 1)]))
        key, place = row // (length + 1), row % (length + 1)
        probe, out = key // wide, set()
        for need in np.unique(self.need):
            for reach in np.unique(self.reach[self.need == need]):
                own = (self.need[probe] == need) & (self.reach[probe] == reach)
                full = np.unique(key[own][_crowded(place[own], key[own], int(need), int(reach))])
                out |= set(zip((full // wide).tolist(), ((full % wide + least) * _STEP).tolist(), strict=True))
        return out

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, edits, start, end, probe) of the best stretch for each text and probe that has one."""
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        text = codes("\n".join(texts))
        found = np.array(self.stretches(text), np.int64).reshape(-1, 2)
        margin = 2 * _STEP + int(self.edits.max(initial=0)) + max(map(len, self.text), default=0)
        text = np.concatenate([np.full(margin, _SEPARATOR, np.uint32), text, np.full(2 * margin, _SEPARATOR, np.uint32)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size, e in sorted({(len(t), int(e)) for t, e in zip(self.text, self.edits, strict=True)}):
            own = found[(self.sizes[found[:, 0]] == size) & (self.edits[found[:, 0]] == e)]
            for i in range(0, len(own), 2_048):
                probe, base = own[i : i + 2_048, 0], own[i : i + 2_048, 1] - e
                windows = text[(base + margin)[:, None] + np.arange(size + 2 * _STEP + 2 * e)]
                edits, a, b = align(np.stack([codes(self.text[p]) for p in probe]), windows)
                ok = np.flatnonzero(edits <= e)
                at = np.searchsorted(starts, (base + a)[ok], side="right") - 1
                for k, n in zip(ok.tolist(), at.tolist(), strict=True):
                    one = (int(edits[k]), int(base[k] + a[k] - starts[n]), int(base[k] + b[k] - starts[n]))
                    best[n, int(probe[k])] = min(best.get((n, int(probe[k])), one), one)
        for (n, probe), (edits, a, b) in sorted(best.items()):
            yield n, self.item[probe], edits, a, b, probe


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q characters, by doubling."""
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = {1: text.astype(np.uint64) + np.uint64(1)}
    size, whole, done = 1, None, 0
    while True:
        h = powers[size]
        if q & size:
            whole = h[:n] if whole is None else whole * np.uint64(pow(_MIX, size, 1 << 64)) + h[done : done + n]
            done += size
        if size * 2 > q:
            return whole * np.uint64(0xD6E8FEB86659FD93)
        powers = {size * 2: h[:-size] * np.uint64(pow(_MIX, size, 1 << 64)) + h[size:]}
        size *= 2


def _crowded(places: np.ndarray, key: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Which of the places, sorted by key and place, are among ``need`` of one key within ``reach``."""
    full = np.zeros(len(places) + 1, np.int64)
    if len(places) >= need:
        last = need - 1
        first = np.flatnonzero((places[last:] - places[: len(places) - last] <= reach) & (key[last:] == key[: len(key) - last]))
        np.add.at(full, first, 1)
        np.subtract.at(full, first + need, 1)
    return np.cumsum(full[:-1]) > 0


class Sieve:
    """Bits of the benchmark's q-grams and, by length, of its short items between blanks."""

    def __init__(self, bits: np.ndarray, size: int, lengths: list[int], s: Settings):
        self.bits, self.size, self.lengths, self.s = bits, size, lengths, s
        self.need, self.reach = s.bounds()

    def _has(self, h: np.ndarray) -> np.ndarray:
        at = slots(h, self.size)
        return np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def pieces(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text the pieces in which the benchmark's q-grams crowd, and the copies that a short item may have."""
        found: list[list[dict]] = [[] for _ in texts]
        plains = [plain(t) for t in texts]
        begin, size = 0, 0
        for i, p in enumerate(plains):
            size += len(p) + 3
            if size >= _CHUNK or i + 1 == len(plains):
                self._scan(texts[begin : i + 1], plains[begin : i + 1], found[begin : i + 1])
                begin, size = i + 1, 0
        return found

    def _scan(self, texts: list[str | None], plains: list[str], found: list[list[dict]]) -> None:
        joined = codes("".join(f" {p} \n" for p in plains))
        starts = np.cumsum([0] + [len(p) + 3 for p in plains])
        places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a in range(0, len(joined), _CHUNK):
            h = gram_hashes(joined[a : a + _CHUNK + self.s.q - 1], self.s.q)
            at = self._has(h)
            places.append(at + a)
            hashes.append(h[at])
        place, h = np.concatenate(places), np.concatenate(hashes)
        near = _crowded(place, np.zeros(len(place), np.int64), self.need, self.reach)
        place, h = place[near], h[near]
        margin = self.s.probe + 6 * _STEP + 2 * int(self.s.probe * self.s.rate)
        spans = []  # text, first and last place, q-grams and their places
        if len(place):
            of = np.searchsorted(starts, place, side="right") - 1
            edges = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (place[1:] - place[:-1] > margin), [True])))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n = int(of[i])
                base = int(starts[n]) + 1
                spans.append((n, int(place[i]) - base - margin, int(place[j - 1]) - base + self.s.q + margin, h[i:j], place[i:j] - base))
        for k in self.lengths:
            w = gram_hashes(joined, k)
            at = self._has(w)
            at = at[(joined[at] == 32) & (joined[at + k - 1] == 32)]
            for i in at.tolist():
                n = int(np.searchsorted(starts, i, side="right")) - 1
                spans.append((n, i - int(starts[n]), i - int(starts[n]) + k - 2, w[i : i + 1], np.zeros(1, np.int64)))
        sources: dict[int, np.ndarray] = {}
        for n, a, b, grams, at in spans:
            if n not in sources:
                sources[n] = word_starts(texts[n])
            own = plains[n]
            i = own.rfind(" ", 0, max(0, a) + 1) + 1  # whole words
            j = own.find(" ", b)
            piece = own[i : j if j >= 0 else len(own)]
            first = own.count(" ", 0, i)
            found[n].append({"piece": piece, "starts": sources[n][first : first + piece.count(" ") + 1], "grams": grams.view(np.int64), "places": at})


def _wordlike(code: int) -> bool:
    return _WORD.match(chr(code)) is not None


@cache
def _low_codes() -> np.ndarray:
    return np.array([_wordlike(c) for c in range(1 << 16)])


def word_starts(text: str) -> np.ndarray:
    """Where the words of plain(text) begin in text."""
    c = codes(lowered(text))
    inside = _low_codes()[np.minimum(c, (1 << 16) - 1)]
    high = np.flatnonzero(c >> 16)
    inside[high] = [_wordlike(x) for x in c[high].tolist()]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


def slots(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - size)).astype(np.int64)


def item_grams(text: str, s: Settings) -> np.ndarray:
    """Of a short item its hash between blanks, of others all q-grams in order."""
    closed = len(text) < s.least
    return gram_hashes(codes(f" {text} " if closed else text), len(text) + 2 if closed else s.q)


_SEGMENT = 17  # bits of a place within a segment of the table


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(no, item as a string, plain) of the distinct items that have a word."""
    as_plain = F.pandas_udf(lambda texts: texts.map(plain), "string")
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), as_plain(F.col(text)).alias("plain"))
    return cut(rows.where("plain <> ''").distinct().withColumn("no", F.monotonically_increasing_id()))


def _sieve(items: DataFrame, s: Settings) -> Sieve:
    """The table of bits: 64 for each character of the benchmark, but at most 2 ** 27."""
    facts = items.agg(F.coalesce(F.sum(F.length("plain")), F.lit(0)).alias("n"), F.collect_set(F.when(F.length("plain") < s.least, F.length("plain") + 2)).alias("lengths")).first()
    size = min(27, max(20, int(facts["n"] * 64).bit_length()))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([slots(item_grams(t, s), size) for t in batch.column(0).to_pylist()] or [np.empty(0, np.int64)]))
            which, first = np.unique(at >> _SEGMENT, return_index=True)
            yield pa.RecordBatch.from_pydict({"segment": which.tolist(), "bits": [_packed(part) for part in np.split(at, first[1:])] if len(at) else []}, pa.schema([("segment", pa.int64()), ("bits", pa.binary())]))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"segment": pdf["segment"][:1], "bits": [whole.tobytes()]})

    shape = "segment bigint, bits binary"
    bits = np.zeros(1 << (size - 3), np.uint8)
    for r in items.select("plain").mapInArrow(segments, shape).groupBy("segment").applyInPandas(merged, shape).collect():
        a = r["segment"] << (_SEGMENT - 3)
        bits[a : a + (1 << (_SEGMENT - 3))] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits, size, sorted(facts["lengths"]), s)


def _packed(at: np.ndarray) -> bytes:
    bits = np.zeros(1 << _SEGMENT, bool)
    bits[at & ((1 << _SEGMENT) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


PIECES = "array<struct<piece: string, starts: array<int>, grams: array<bigint>, places: array<int>>>"


def _pieces(docs: DataFrame, text: str, items: DataFrame, s: Settings, *keys: Column) -> DataFrame:
    """(row, keys, at, piece, starts, grams, places) of the pieces of texts that the benchmark may be in; row numbers the rows of docs."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(items, s))

    @F.pandas_udf(PIECES)
    def sieved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.pieces(list(texts)))

    some = docs.select(*keys, sieved.asNondeterministic()(F.col(text)).alias("pieces")).where(F.size("pieces") > 0)
    kept = some.columns[:-1]
    return cut(some.withColumn("row", F.monotonically_increasing_id()).select("row", *kept, F.posexplode("pieces").alias("at", "p")).select("row", *kept, "at", "p.*"))


FOUND = "row bigint, item string, probe string, edits int, start int, end int"


def _verified(pieces: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """FOUND, of each probe of an item (of a short item: each copy) in a piece."""
    need = s.bounds()[0]

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1_000):
                part = pdf[i : i + 1_000]
                own = [item_grams(t, s).view(np.int64) for t in part["plain"]]
                yield pd.DataFrame({"no": np.repeat(part["no"].to_numpy(), [len(g) for g in own]), "h": np.concatenate(own), "own": np.concatenate([np.arange(len(g)) for g in own])})

    table = items.select("no", "plain").mapInPandas(grams, "no bigint, h bigint, own int")
    hits = pieces.select("row", "at", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("row", "at", F.col("g.grams").alias("h"), F.col("g.places").alias("place")).join(table, "h")
    # band b covers the diagonals 8 b .. 8 b + 15, so that any 9 in a row, more than a probe's edits move it, lie in one
    band = F.floor((F.col("place") - F.col("own")) / _STEP)
    counted = hits.select("row", "at", "no", F.explode(F.array(band, band - 1)).alias("band")).groupBy("row", "at", "no", "band").agg(F.count("*").alias("shared"))
    pairs = counted.groupBy("row", "at", "no").agg(F.max("shared").alias("shared")).join(items, "no")
    pairs = pairs.where((F.col("shared") >= need) | (F.length("plain") < s.least))
    told = pairs.select("row", "at", "no", "item", "plain").join(pieces.select("row", "at", "piece", "starts"), ["row", "at"])

    def of_items(pairs: pd.DataFrame) -> list[tuple]:
        """All pieces and items of the pairs at once; what isn't among the pairs belongs to other rows."""
        out = []
        wanted = dict(zip(zip(pairs["row"], pairs["at"], pairs["no"], strict=True), pairs["item"], strict=True))
        items = pairs.drop_duplicates("no")
        probes = Probes(list(zip(items["no"], items["plain"], strict=True)), s)
        first = dict(zip(reversed(probes.item), range(len(probes.item) - 1, -1, -1), strict=True))
        pieces = pairs.drop_duplicates(["row", "at"])
        pieces = list(zip(pieces["row"], pieces["at"], pieces["piece"], pieces["starts"], strict=True))
        for i in range(0, len(pieces), 1_000):
            for n, no, edits, a, b, probe in probes.matches([p[2] for p in pieces[i : i + 1_000]]):
                row, at, piece, starts = pieces[i + n]
                if (row, at, no) in wanted:
                    out.append((row, wanted[row, at, no], f"{no} {probe - first[no]}", edits, *source_span(starts, piece, a, b)))
        return out

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, long = [], pdf["plain"].str.len() >= s.least
            for row, item, piece, starts, text in pdf.loc[~long, ["row", "item", "piece", "starts", "plain"]].itertuples(index=False):
                if piece == text:
                    out.append((row, item, f"at {starts[0]}", 0, *source_span(starts, piece, 0, len(piece))))
            pairs = pdf[long]
            each = pairs.drop_duplicates("no")
            portion = dict(zip(each["no"], each["plain"].str.len().cumsum() // _ITEMS, strict=True))
            for _, some in pairs.groupby(pairs["no"].map(portion)):
                out += of_items(some)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return told.mapInPandas(verify, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, item, edits, stretches, start, end) for each row of docs and each item with a verified stretch in it.

    stretches counts the item's probes (of a short item: the copies) that are found, edits are the fewest of theirs; start and end, in code points of the text, span them all.
    """
    items = _items(benchmark, item, item_text)
    pieces = _pieces(docs, text, items, settings, F.col(key).alias("key"))
    found = _verified(pieces, items, settings).groupBy("row", "item").agg(F.min("edits").alias("edits"), F.count_distinct("probe").alias("stretches"), F.min("start").alias("start"), F.max("end").alias("end"))
    rows = pieces.where("at = 0").select("row", "key")
    own = F.col("item").cast(benchmark.schema[item].dataType).alias(item)
    return found.join(rows, "row").select(F.col("key").alias(key), own, "edits", F.col("stretches").cast("int").alias("stretches"), "start", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs in which no stretch of the benchmark is found; columns unchanged, whatever their names.

    What a text holds doesn't depend on its row: texts are told apart by 128 bits of hashes and their length.
    """
    told = lambda c: (F.xxhash64(c).alias("h0"), F.xxhash64(F.lit(1), c).alias("h1"), F.length(c).alias("n"))
    items = _items(benchmark, item, item_text)
    pieces = _pieces(docs, text, items, settings, *told(F.col(text)))
    found = _verified(pieces, items, settings).select("row").distinct()
    leaky = cut(pieces.where("at = 0").join(found, "row", "left_semi").select("h0", "h1", "n").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *told(F.col(text)))
    return whole.join(leaky, (whole["h0"] == leaky["h0"]) & (whole["h1"] == leaky["h1"]) & whole["n"].eqNullSafe(leaky["n"]), "left_anti").select("own.*")
