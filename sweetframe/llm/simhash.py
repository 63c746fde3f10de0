"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Texts become fingerprints by a majority vote over the hashes of their word shingles. Tables on segments of the bits find
near fingerprints: each is entered under the small Hamming ball around each of its segments, whatever shares a table entry
is compared in full, and pairs within a given distance are linked. Groups are the connected components of those links.

``NARROW`` has 64 bits in two segments of 32: at most 4 differing bits leave at most 2 in one half, and balls of radius 1
around both halves meet, so that no link is missed.

Equal fingerprints are merged first, so that copies cost nothing; a table entry yields a spanning forest of its links, not
all its pairs. An entry's memory is a few words for each distinct fingerprint in it.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text with fewer words
than a shingle has one shingle, the whole sequence; repeated rows stay, each with the same group; a null id never becomes
a group's id unless all ids of the group are null; very long texts are hashed whole; ties don't arise, as a group's id is
the least one; an empty table gives no rows; other columns come out as they are, whatever their names, but for a column
``component_id`` of group's rows, which is kept with ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut, freed
from sweetframe.llm.components import components

_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, ends[size - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if it is set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, size: int = 5, seed: int = 42) -> Column:
    """The text's 64-bit fingerprint as a signed bigint, over shingles of ``size`` words, repeats included."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([majority(shingle_hashes(t, size, seed)) for t in texts], dtype="int64")

    return prints.asNondeterministic()(text)


@dataclass(frozen=True)
class Layout:
    """words: 64-bit words of a fingerprint. segments: (word, first bit, bits). Two balls of ``radius`` meet at twice that."""

    words: int
    segments: tuple[tuple[int, int, int], ...]
    radius: int
    most: int


NARROW = Layout(1, ((0, 0, 32), (0, 32, 32)), 1, 4)


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of that many bits with at most ``radius`` set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    masks = np.zeros(1, np.uint64)
    for _ in range(radius):
        masks = np.unique(np.concatenate([masks, (masks[:, None] ^ one).ravel()]))
    return masks


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(nodes: np.ndarray, prints: np.ndarray, most: int, pairs: list[np.ndarray]) -> None:
    """Appends edges that link the run's nodes within ``most`` bits just as all such pairs would."""
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _distance(prints[left], prints[x]) <= most
            if near.any():
                found = left[near]
                pairs.append(np.stack([np.full(len(found), nodes[x]), nodes[found]], axis=1))
                queue.extend(found)
                left = left[~near]


_SHORT = 32  # runs of up to so many are compared all at once


def _run_edges(rows: np.ndarray, most: int) -> np.ndarray:
    """Edges within the runs of equal keys of rows: key, node, then the fingerprint's words."""
    starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1))
    sizes = np.diff(np.append(starts, len(rows)))
    pairs = []
    for k in range(1, _SHORT):
        some = (sizes > k) & (sizes <= _SHORT)
        if not some.any():
            continue
        c = sizes[some] - k
        at = np.repeat(starts[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        near = at[_distance(rows[at, 2:], rows[at + k, 2:]) <= most]
        pairs.append(np.stack([rows[near, 1], rows[near + k, 1]], axis=1))
    for s, n in zip(starts[sizes > _SHORT], sizes[sizes > _SHORT], strict=True):
        _forest(rows[s : s + n, 1], rows[s : s + n, 2:], most, pairs)
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.uint64)


def _links(most: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key in; edges out. The last run of a batch waits for the next batch."""
        kept = None

        def told(rows: np.ndarray) -> pa.RecordBatch:
            out = _run_edges(rows, most)
            return pa.RecordBatch.from_arrays([pa.array(out[:, i].astype(np.int64)) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(batch.num_columns)], axis=1)
            rows = rows if kept is None else np.concatenate([kept, rows])
            if len(rows):
                last = int(np.flatnonzero(rows[1:, 0] != rows[:-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
                kept = rows[last:]
                if last:
                    yield told(rows[:last])
        if kept is not None and len(kept):
            yield told(kept)

    return links


def near_links(prints: DataFrame, layout: Layout) -> DataFrame:
    """(u, v) links between nodes. prints: node and w0, w1, ... of distinct fingerprints."""
    words = [f"w{i}" for i in range(layout.words)]
    balls = [_ball(bits, layout.radius) for _, _, bits in layout.segments]
    names = ["key", "node", *words]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                part = batch.slice(i, 10_000)
                node, *own = (part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ["node", *words])
                for s, ((word, shift, bits), masks) in enumerate(zip(layout.segments, balls, strict=True)):
                    segment = (own[word] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    key = ((segment[:, None] ^ masks) | np.uint64(s << 48)).ravel()
                    columns = [key, *(np.repeat(c, len(masks)) for c in (node, *own))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

    shape = ", ".join(f"{c} bigint" for c in names)
    entries = prints.select("node", *words).mapInArrow(enter, shape)
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(_links(layout.most), "u bigint, v bigint").distinct()


def group(rows: DataFrame, layout: Layout = NARROW, key: str = "doc_id") -> DataFrame:
    """rows (with columns ``key`` and fp, a bigint or an array of them) and component_id, the least key that the row reaches over links."""
    fp = [F.col("fp")] if layout.words == 1 else [F.col("fp")[i] for i in range(layout.words)]
    node = fp[0] if layout.words == 1 else F.xxhash64(*fp)
    least = cut(rows.groupBy(node.alias("node"), *[c.alias(f"w{i}") for i, c in enumerate(fp)]).agg(F.min(key).alias("least")))
    linked = components(near_links(least, layout)).withColumnRenamed("node", "linked")
    named = least.join(linked, least["node"] == linked["linked"], "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "component").select(F.col("node").alias("label_node"), "component_id")
    rows = freed(rows, ["component_id"])
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), node.alias("own_node"))
    return whole.join(labels, F.col("own_node") == F.col("label_node")).select("row.*", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
