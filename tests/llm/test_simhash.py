import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sweetframe.llm import simhash
from sweetframe.llm._common import cut


def plain_fingerprint(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", low)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(prints, most):
    """prints: id -> fingerprint; brute force over all pairs."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "A b C d", "a b c d e f a b c d e f", "é Ü x y z\x1cw q", "x" * 5000, "w " * 300])
def test_fingerprint_equals_the_plain_one(text):
    assert simhash.majority(simhash.shingle_hashes(text, 4)) % 2**64 == plain_fingerprint(text, 4)


def test_groups_equal_brute_force_on_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {}
    for i in range(900):
        fp = int(centres[i % 12])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            fp ^= 1 << int(b)
        prints[i] = fp
    prints |= {900 + i: int(x) for i, x in enumerate(rng.integers(0, 2**63, 300, dtype=np.uint64))}
    rows = spark.createDataFrame([(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in prints.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.group(rows).collect()}
    assert got == plain_groups(prints, 4)


def test_run_edges_connect_as_all_pairs_do():
    rng = np.random.default_rng(5)
    for n in (3, 31, 33, 200):
        prints = rng.integers(0, 2**63, (4, 2), dtype=np.uint64)[rng.integers(0, 4, n)]
        for i in range(n):
            for b in rng.integers(0, 128, rng.integers(0, 9)):
                prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows = np.column_stack([np.full(n, 7, np.uint64), np.arange(n, dtype=np.uint64), prints])
        edges = simhash._run_edges(rows, 9)
        linked = lambda pairs: plain_components(n, pairs)
        every = [(i, j) for i in range(n) for j in range(i) if simhash._distance(prints[i], prints[j]) <= 9]
        assert linked([(int(a), int(b)) for a, b in edges]) == linked(every)


def plain_components(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_query_on_whole_small_table(spark):
    from sweetframe.llm.queries import op9_simhash_groups

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t, 4) for i, t in texts.items()}
    groups = plain_groups(prints, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash_groups(spark, d).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_scratch_tables_keep_their_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert cut(df).collect() and cut(df).count() == 10


def test_columns_of_any_name_stay(spark):
    prints = spark.createDataFrame([(1, 0, 9, 8), (2, 1, 9, 8)], "doc_id long, fp long, component_id int, __node int")
    assert sorted(map(tuple, simhash.group(prints).collect())) == [(1, 0, 9, 8, 1), (2, 1, 9, 8, 1)]
