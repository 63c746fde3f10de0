"""MinHash near-duplicate groups with odd sketches.

A text is the set of its distinct word shingles; two texts are linked if the Jaccard similarity of their sets is
``similar`` or more. Of each set 175 or 180 MinHash samples are taken. Sets that share a band of samples (30 bands of six
for 0.85, 35 of five for 0.8) are candidates, which a pair at ``similar`` misses once in a million and nearer ones less
often. The samples are also folded into an odd sketch, 1,024 bits of which each sample flips one: samples that two sets
share cancel in the XOR of their sketches, so that its population count tells how many differ, and with it the similarity,
the more precisely the higher it is. Candidates whose count lies beyond what a pair at ``similar`` shows, but for one pair
in a million, are let go. A second parity bitmap, of 2,048 bits, has the set itself as its sample: two sets that differ in
d shingles differ in d bits at most, so that it lets no similar pair go, and tells sets of up to some hundred differing
shingles nearly exactly. What passes is confirmed on the full sets, so that no link is false.

Equal sets are one node (told by 128 bits), so that copies cost nothing. Large groups of near copies are linked by stars
first: each node meets one hub, that of most of its bands, if their sketches allow it; a band's hub is its node with the most band
mates, as the text that copies were made from shares more bands with each of them than they do with each other. Nodes of a
band that lie in different components are then compared by sketch, inside the tasks, in rounds in which each node names its
nearest node of another component only; a last round confirms all pairs that are still in question. So the pairs that are
shuffled grow with the nodes and not with the links of a group. A band of more than ``_BLOCK`` nodes in question is compared
in pairs of blocks, each in a task of its own.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and stay alone even if their id is shared; a
text with fewer words than a shingle has one, all its words; repeated rows stay, each with the same answer; a null id never
becomes a group's id unless all ids of the group are null, and is then kept; very long texts are hashed whole; ties don't
arise, as a group's id is its least one; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweetframe.llm import simhash
from sweetframe.llm._common import bounded_batches, cut
from sweetframe.llm.components import components
from sweetframe.llm.simhash import shingle_hashes

_BITS, _SET_BITS, _MISS = 1024, 2048, 1e-6
_FACTORS = np.random.default_rng(20240613).integers(0, 2**63, 180, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 11  # nodes of a band that are compared in one task
_ROUNDS = 3  # in which nodes name their nearest only
_SHORT = 32  # slots of up to so many rows are compared all at once
_SMALL = 1 << 20  # rows of ids and hashes up to which they are broadcast


@cache
def bands_for(similar: tuple[int, int]) -> tuple[int, int]:
    """(bands, samples of a band) with which a pair that similar shares no band once in a million."""
    s = similar[0] / similar[1]
    if not 0.8 <= s <= 1:
        raise ValueError("bands of few samples are for similarities of 0.8 or more")
    rows = 6 if s >= 0.85 else 5
    return (ceil(log(_MISS) / log1p(-(s**rows))) if s < 1 else 1), rows


def samples(shingles: np.ndarray, n: int = 180) -> np.ndarray:
    """The least of the set's hashes under each of n hash functions."""
    factors = _FACTORS[:n]
    least = np.full(n, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * factors).min(axis=0), out=least)
    return least


def band_keys(own: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key of each band of so many samples."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(own.reshape(-1, rows))], np.uint64).view(np.int64)


def _parity(values: np.ndarray, bits: int) -> bytes:
    """Of hashed values, each of which flips one bit."""
    x = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def odd_sketch(own: np.ndarray) -> bytes:
    """The samples' parity bitmap: each sample, with its place, flips one bit."""
    return _parity((own ^ (own >> np.uint64(31))) + _FACTORS[: len(own)], _BITS)


def set_parity(shingles: np.ndarray) -> bytes:
    """The set's own parity bitmap."""
    return _parity(shingles, _SET_BITS)


def estimate(differing: np.ndarray | int, n: int = 180) -> np.ndarray | float:
    """The similarity that a population count of the XOR of two sketches of n samples stands for."""
    flips = np.log1p(-np.minimum(2 * np.asarray(differing) / _BITS, 1 - 1 / _BITS)) / np.log1p(-2 / _BITS)
    return 1 - flips / 2 / n


@cache
def most_differing(similar: float, samples: int = 180) -> int:
    """The least count that a pair with that similarity exceeds once in a million at most.

    The number of differing samples is binomial, each flips two bits at random places.
    """
    k, n = samples, _BITS
    up, down = (n - np.arange(n + 1)) / n, np.arange(n + 1) / n
    now, total = np.zeros(n + 1), np.zeros(n + 1)
    now[0] = 1
    for d in range(k + 1):
        total += comb(k, d) * (1 - similar) ** d * similar ** (k - d) * now
        for _ in range(2):
            new = np.zeros(n + 1)
            new[1:] += now[:-1] * up[:-1]
            new[:-1] += now[1:] * down[1:]
            now = new
    beyond = total[::-1].cumsum()[::-1]  # P(count >= i)
    return int(np.flatnonzero(beyond <= _MISS)[0]) - 1


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def signature(text: Column, size: int, similar: tuple[int, int], prints: bool = False) -> Column:
    """struct<node, n_shingles, bands, sketch, parity, print> of the set of the text's shingles; without words, a null node and no bands.

    print: the set's SimHash fingerprint, if asked for.
    """
    bands, of_band = bands_for(similar)
    bounded_batches(SparkSession.active(), rows=500, mb=2)

    @F.pandas_udf("struct<node: binary, n_shingles: bigint, bands: array<bigint>, sketch: binary, parity: binary, print: bigint>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for texts in batches:
            rows = []
            for t in texts:
                own = shingle_set(t, size)
                if len(own):
                    least = samples(own, bands * of_band)
                    rows.append((xxh3_128_digest(own.tobytes()), len(own), band_keys(least, of_band), odd_sketch(least), set_parity(own), simhash.majority(own) if prints else None))
                else:
                    rows.append((None, 0, [], None, None, None))
            out = pd.DataFrame([r[:-1] for r in rows], columns=["node", "n_shingles", "bands", "sketch", "parity"])
            yield out.assign(print=pd.array([r[-1] for r in rows], "Int64"))  # not as floats, which are rounded

    return signed.asNondeterministic()(text)


def _words(bitmaps: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


class Near:
    """Tells by sizes and bitmaps which pairs of sets may be similar, and how far apart they seem."""

    def __init__(self, similar: tuple[int, int]):
        bands, of_band = bands_for(similar)
        self.part, self.whole = similar
        self.samples = bands * of_band
        self.most = most_differing(similar[0] / similar[1], self.samples)

    def __call__(self, sizes: tuple[np.ndarray, np.ndarray], sketches: tuple[np.ndarray, np.ndarray], sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The seeming distance, 1 less the similarity, of each pair; infinite where it can't be a link."""
        (m, n), both = sizes, sizes[0] + sizes[1]
        out = np.full(len(both), np.inf)
        own = np.flatnonzero(np.minimum(m, n) * self.whole >= np.maximum(m, n) * self.part)
        row = lambda x: x[own] if len(x) > 1 or len(both) == 1 else x  # noqa: E731  a single row meets all of the other side
        of_set = np.bitwise_count(row(sets[0]) ^ row(sets[1])).sum(axis=1, dtype=np.int64)
        of_samples = np.bitwise_count(row(sketches[0]) ^ row(sketches[1])).sum(axis=1, dtype=np.int64)
        most = both[own] * (self.whole - self.part) // (self.whole + self.part)  # shingles that similar sets differ in
        ok = (of_set <= most) & (of_samples <= self.most)
        own, of_set, of_samples, most = own[ok], of_set[ok], of_samples[ok], most[ok]
        differ = -_SET_BITS / 2 * np.log1p(-np.minimum(2 * of_set / _SET_BITS, 0.999))
        small = most <= _SET_BITS / 8
        out[own] = np.where(small, 2 * differ / (both[own] + differ), 1 - estimate(of_samples, self.samples))
        return out


def apart(u: list[str], v: list[str], similar: tuple[int, int]) -> Column:
    """The seeming distance of two nodes by their columns size, sketch and parity; null where they can't be linked."""
    near = Near(similar)

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        found = near((a.to_numpy(), d.to_numpy()), (_words(b), _words(e)), (_words(c), _words(f)))
        return pd.Series([None if x == np.inf else x for x in found.tolist()], dtype="float64")

    return distance(*u, *v)


class Slots:
    """Rows of slots, by slot and group: which of a slot's nodes of two groups seem similar.

    Rows of side 2 meet all of their slot; a slot of two blocks has sides 0 and 1, which meet each other only.
    """

    def __init__(self, near: Near, slot: np.ndarray, side: np.ndarray, group: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, sets: np.ndarray):
        self.near, self.slot, self.side, self.group, self.sizes, self.sketches, self.sets = near, slot, side, group, sizes, sketches, sets

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, other rows, distances) of pairs, in parts in which no row occurs twice on one side, or one row is alone on a side."""
        if not len(self.slot):
            return
        starts = np.concatenate(([0], np.flatnonzero(self.slot[1:] != self.slot[:-1]) + 1))
        n = np.diff(np.append(starts, len(self.slot)))
        for k in range(1, _SHORT):
            some = (n > k) & (n <= _SHORT)
            if some.any():
                c = n[some] - k
                at = np.repeat(starts[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                yield self._pairs(at, at + k)
        for s, e in zip(starts[n > _SHORT].tolist(), (starts + n)[n > _SHORT].tolist(), strict=True):
            edges = [s, *(np.flatnonzero(self.group[s + 1 : e] != self.group[s : e - 1]) + s + 1).tolist(), e]
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                others = np.arange(b, e)
                for i in range(a, b):
                    yield self._pairs(np.array([i]), others)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        meet = (self.group[a] != self.group[b]) & ((self.side[a] != self.side[b]) | (self.side[b] == 2))
        a, b = np.broadcast_arrays(a, b)
        a, b = a[meet], b[meet]
        if not len(b):
            return a, b, np.empty(0)
        one = a[:1] if (a == a[0]).all() else a
        d = self.near((np.broadcast_to(self.sizes[one], b.shape), self.sizes[b]), (self.sketches[one], self.sketches[b]), (self.sets[one], self.sets[b]))
        ok = d < np.inf
        return a[ok], b[ok], d[ok]

    def every(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(a, b) for a, b, _ in self.found() if len(a)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty(0, np.int64),) * 2

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row that has a partner, and its nearest one."""
        best, partner = np.full(len(self.slot), np.inf), np.full(len(self.slot), -1)
        for a, b, d in self.found():
            if len(a):
                if len(a) > 1 and a[0] == a[-1]:
                    i = int(d.argmin())
                    if d[i] < best[a[0]]:
                        best[a[0]], partner[a[0]] = d[i], b[i]
                else:
                    less = d < best[a]
                    best[a[less]], partner[a[less]] = d[less], b[less]
                less = d < best[b]
                best[b[less]], partner[b[less]] = d[less], a[less]
        rows = np.flatnonzero(partner >= 0)
        return rows, partner[rows]


def _compare(near: Near, nearest: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of slot, side, group, size, node, sketch and parity, sorted by slot and group; pairs of nodes out.

        The last slot of a batch waits for the next batch.
        """
        kept = None

        def told(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(i).to_numpy() for i in range(4)]
            slots = Slots(near, *columns, *(_words(rows.column(i).to_pylist()) for i in (5, 6)))
            both = (rows.column(4).take(pa.array(x)).combine_chunks() for x in (slots.nearest() if nearest else slots.every()))
            return pa.RecordBatch.from_arrays(list(both), ["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            if len(rows):
                slot = rows.column(0).to_numpy()
                last = int(np.flatnonzero(slot[1:] != slot[:-1])[-1]) + 1 if slot[0] != slot[-1] else 0
                kept = rows.slice(last)
                if last:
                    yield told(rows.slice(0, last))
        if kept is not None and len(kept):
            yield told(kept)

    return compare


def _bounded(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(_SMALL + 1).count() <= _SMALL else df


class _Sets:
    """The texts' sets, to confirm pairs of nodes on."""

    def __init__(self, texts: DataFrame, signed: DataFrame, size: int, similar: tuple[int, int]):
        self.texts, self.signed, self.size, self.similar = texts, signed, size, similar

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles), from one text of each."""
        size = self.size

        @F.pandas_udf("array<bigint>")
        def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([shingle_set(t, size).view(np.int64) for t in texts])

        one = self.signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("one")).select("node", F.col("one.id").alias("own_id"), F.col("one.hash").alias("own_hash"))
        same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
        return self.texts.join(_bounded(cut(one)), same).select("node", sets.asNondeterministic()("text").alias("shingles")).dropDuplicates(["node"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are similar, counted on their full sets."""
        sets = cut(self.of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
        u, v = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
        common = F.size(F.array_intersect("u_set", "v_set"))
        part, whole = self.similar
        return pairs.join(u, "u").join(v, "v").where(common * whole >= (F.size("u_set") + F.size("v_set") - common) * part).select("u", "v")


def _in_question(entries: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of slots for ``_compare``: the nodes of each band that has nodes of several components."""
    now = entries.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = now.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("mates")).where("low < high").select("band", "mates")
    blocks = F.ceil(F.col("mates") / _BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    # rows of a block that meet another are sides 0 and 1; those that meet their own, and slots of one block, side 2
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"), F.when(block == o, 2).otherwise((block > o).cast("int")).alias("side")))
    split = now.join(mixed, "band").select("band", "node", "component", F.explode(others).alias("to"))
    rows = split.join(own, "node").select(F.xxhash64("band", "to.i", "to.j").alias("slot"), F.col("to.side").alias("side"), F.xxhash64("component").alias("group"), F.col("n_shingles").alias("size"), "node", "sketch", "parity")
    return rows.repartition("slot").sortWithinPartitions("slot", "group")


def _by_prints(signed: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose SimHash prints differ in 4 bits at most, such that they connect just what all those pairs would.

    Multi-index hashing of the distinct prints; nodes of one print meet the least of them.
    """
    nodes = signed.where("node is not null").select("node", "print").distinct()
    one = cut(nodes.groupBy("print").agg(F.min("node").alias("least")))
    same = nodes.join(one, "print").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    links = simhash.near_links(one.select(F.col("print").alias("node"), F.col("print").alias("w0")), simhash.NARROW)
    u, v = (one.select(F.col("print").alias(f"{c}_print"), F.col("least").alias(c)) for c in "uv")
    near = links.select(F.col("u").alias("u_print"), F.col("v").alias("v_print")).join(u, "u_print").join(v, "v_print").select("u", "v")
    return near.unionByName(same)


def _linked(signed: DataFrame, sets: _Sets, similar: tuple[int, int], first: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that have a similar one. first: pairs (u, v) of nodes that are confirmed with the stars."""
    near = Near(similar)
    entries = signed.select("node", F.explode("bands").alias("band")).distinct()
    shared = entries.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    entries = cut(entries.join(shared, "band"))
    weights = entries.groupBy("node").agg(F.sum("mates").alias("weight"))
    own = cut(signed.select("node", "n_shingles", "sketch", "parity").join(weights, "node").dropDuplicates(["node"]))  # nodes with band mates only

    hubs = entries.join(own.select("node", "weight"), "node").groupBy("band").agg(F.max(F.struct("weight", F.xxhash64("node"), "node")).alias("hub")).select("band", F.col("hub.node").alias("v"))
    met = entries.select("band", F.col("node").alias("u")).join(hubs, "band").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("shared"))
    stars = met.groupBy("u").agg(F.max(F.struct("shared", F.xxhash64("v"), "v")).alias("best")).select("u", "best.v")
    u, v = (own.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n_shingles", "sketch", "parity")]) for c in "uv")
    distance = apart(*[[f"{c}_{x}" for x in ("n_shingles", "sketch", "parity")] for c in "uv"], similar)
    pairs = stars.join(u, "u").join(v, "v").select("u", "v", distance.alias("apart")).where("apart is not null").select("u", "v")
    pairs = cut(pairs if first is None else pairs.unionByName(first).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    tested = None
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    turn, last = 0, False
    while True:  # the stars, rounds of nearest nodes, and all that is left
        untested = not pairs.isEmpty()
        if untested:
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = sets.confirmed(pairs)
            found = cut(components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))))
        if last:
            break
        last = turn >= _ROUNDS or turn > 0 and not untested  # a round that tests nothing new would name the same again
        turn += 1
        named = _in_question(entries, own, found).mapInArrow(_compare(near, not last), "u binary, v binary")
        named = named.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        known = pairs.limit(0) if tested is None else tested
        known = known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("known"))
        named = cut(named.join(known, ["u", "v"], "left"))
        if named.isEmpty():  # no two nodes of two components seem similar
            break
        pairs = named.where("known is null").select("u", "v")
    return found


def _signed(docs: DataFrame, text: str, key: str, size: int, similar: tuple[int, int], prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, hash, node, n_shingles, bands, sketch, parity, print) of the rows, written; and the nodes' components."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    signed = cut(texts.select("id", "hash", signature(F.col("text"), size, similar, prints).alias("s")).select("id", "hash", "s.*"))
    first = _by_prints(signed) if prints else None
    return signed, _linked(signed, _Sets(texts, signed.select("id", "hash", "node"), size, similar), similar, first)


def near_groups(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 3, similar: tuple[int, int] = (85, 100)) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs.

    component_id: the least key that the row's text reaches over links; kept: whether that is the row's own key.
    similar: the least Jaccard similarity of a link as a fraction, 0.8 or more.
    """
    signed, found = _signed(docs, text, key, size, similar)
    least = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "component").select(F.col("node").alias("own_node"), "component_id")
    out = signed.join(named, F.col("node") == F.col("own_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least key (nulls first, then the least text hash).

    Pairs are found by multi-index hashing of the sets' SimHash prints and confirmed; what differs in more bits than that
    finds, by bands and odd sketches. Texts without words are a group of their own. Only keys and hashes are grouped; texts move once, to meet the rows that
    go, if those are too many to broadcast. Columns of any name stay.
    """
    signed, found = _signed(docs, text, key, size, similar, prints=True)
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["hash"].eqNullSafe(b["hash"])
    rows = signed.join(found, "node", "left").select(F.col("id").alias("key"), "hash", F.coalesce("component", "node", F.lit(b"")).alias("component"))
    rows = cut(rows.groupBy("component", "key", "hash").agg(F.count("*").alias("times")))
    first = rows.groupBy("component").agg(F.min(F.struct("key", "hash")).alias("first"))
    times = rows.join(first, "component").select("key", "hash", F.struct("key", "hash").eqNullSafe(F.col("first")).alias("stays"), "times")
    times = cut(times.where("not stays or times > 1"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    gone, twice = times.where("not stays").select("key", "hash"), times.where("stays").select("key", "hash")
    kept = whole.join(gone, same(whole, gone), "left_anti")
    if not twice.isEmpty():  # rows repeated in full: one of them stays
        nth = F.row_number().over(Window.partitionBy("key", "hash").orderBy("key"))
        copies = kept.join(twice, same(kept, twice), "left_semi").withColumn("n", nth).where("n = 1").drop("n")
        kept = kept.join(twice, same(kept, twice), "left_anti").unionByName(copies)
    return kept.select("row.*")
