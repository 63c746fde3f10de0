import hashlib

import pytest
from pyspark.sql import functions as F

from sweetframe.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares the total by weight; whoever exceeds twice its size is held there, and the rest is shared anew."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, held = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in held]
        left = total - sum(held.values())
        level = left / sum(w[n] for n in free) if free else 0
        over = [n for n in free if w[n] * level > 2 * sizes[n]]
        if not over:
            return held | {n: w[n] * level for n in free}
        held |= {n: 2.0 * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 1, None: 70}, {"a": 0, "b": 7}, {"a": 0, "b": 0}, {"x": 9}, {f"s{i:02d}": (i * 37) % 101 for i in range(20)}])
def test_targets_equal_resharing_by_rounds(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_copies_and_rows(spark):
    rows = [(i if i % 50 else None, "w " * (i % 7) or None, "abc"[i % 3] if i % 11 else None, "keep") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)
    rated = mixing.rates(docs).collect()
    assert len(rated) == 1500
    for r in rated:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        draw = int(hashlib.md5(f"20240229:{'' if r['key'] is None else r['key']}".encode()).hexdigest()[:12], 16) / 16**12
        assert r["copies"] == int(rate) + (draw < rate - int(rate)) and r["copies"] <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "__copy"]
    assert mixed.count() == sum(r["copies"] for r in rated)
    assert mixed.exceptAll(mixing.mix(docs)).count() == 0
    by = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    want = {r["source"]: r["target"] for r in rated}
    assert all(abs(r["n"] - want[r["source"]]) <= 0.15 * want[r["source"]] for r in by)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay_and_long_texts_are_counted_whole(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000, "s", 5), (2, "b", "s", 6)], "doc_id long, text string, source string, __COPY int")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "__copy_"]
    assert {r["__COPY"] for r in out.collect()} <= {5, 6}
    assert {r["size"] for r in mixing.rates(docs).collect()} == {300_000, 1}
