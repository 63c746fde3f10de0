"""Source divergence audit: how far the sources of a language lie apart, and the terms that set each one off.

A group is a source within a language. Each kept term (one in at least ``least_docs`` documents of the language) has a
price in each group, a smoothed share in billionths that follows from its count there alone; the distance of two groups is
f(p, q) = floor((p - q) ** 2 / (p + q)), summed over all kept terms. As a price follows from the count level, the terms
needn't be compared one by one: with a 0/1 column for each (group, level) and a row for each term, the matrix times its
transpose holds, for each two groups, the joint table of how many terms have which two levels, and each cell is priced
once. Terms are multiplied in blocks, dense and exact (sums of ones below 2 ** 24 in float32), each block's tables are
priced where they arise, and only sums by pair of groups are shuffled. Level zero has no column: its cells are what the
margins leave, so that a term costs as many cells as groups that have it.

All numbers are whole: counts are bigints, products that may pass 64 bits are decimals. Counting is done in Python with a
table of bounded size, emptied into Spark whenever it is full. Rows are dealt by (language, term), never by group, so that
a source with a third of all rows is spread like any other; groups of a language are paired because their pairs are the
result.

Defined cases: null texts, languages and sources are read as empty strings; a group without terms is told like any other;
a language without kept terms has all distances 0 and no terms; repeated rows count each; very long texts are counted
whole; ties of values go by the item's bytes; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches, cut

#: Letters A-Z become lower case; other ASCII but letters ends a term; bytes of longer characters belong to terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_HELD = 200_000  # entries of a worker's table before it is emptied
_ROWS, _COLUMNS = 1 << 13, 512  # of a block: terms, and (group, level) columns
_UNIT = 1_000_000_000  # a whole share; prices are at most one more
_SHIFT = np.int64(1 << 30)  # a column's number is its group's times this, plus its price


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, source and text in; counts of a part of the rows out, and a row with a null term for each group."""
    names = ["lang", "source", "term", "n", "docs"]
    times: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in times.items():
            words, with_term = list(own), docs[lang, source]
            n = len(words)
            arrays = [[lang] * (n + 1), [source] * (n + 1), [None, *words], [0, *own.values()], [0, *(with_term[w] for w in words)]]
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names)
        times.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own, found = times.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            before, words = len(own), terms_of(text)
            own.update(words)
            found.update(set(words))
            held += len(own) - before
            if held >= _HELD:
                yield from told()
                held = 0
    yield from told()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, total, first) of kept terms, and a row with a null term and n = 0 for each group.

    n: occurrences in the group; total: in the language; first: on one of the term's rows in its language.
    """
    bounded_batches(docs.sparkSession)
    empty = F.lit("")
    read = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"), F.col(text).cast("binary").alias("text"))
    parts = read.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    # one exchange: counts by group, and then windows over all groups of a term, lie within it
    dealt = parts.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"all_docs": F.sum("docs").over(same), "total": F.sum("n").over(same), "first": F.row_number().over(same.orderBy("source")) == 1})
    return whole.where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "n", "total", "first")


def _price(n: str, size: str) -> Column:
    """1 + floor(10**9 * (n + 2) / size); the product may pass 64 bits."""
    return F.expr(f"1 + (cast({_UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({size} as decimal(20,0))").cast("long")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_sums(rows: list[np.ndarray], zeros: dict[int, int]) -> Counter:
    """What the terms of a block add for each pair of groups (lesser number first) that both have them.

    rows: of each term, its columns' numbers. zeros: by group, the price of a count of zero. Each term adds f of its two
    prices less what the margins say of it: f with either price at zero; and f of both zeros, which the margins take twice.
    The product is made by stripes of columns, so that it stays small for terms that very many groups have.
    """
    columns, at = np.unique(np.concatenate(rows), return_inverse=True)
    hot = np.zeros((len(rows), len(columns)), np.float32)
    hot[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at] = 1
    group, price = columns // _SHIFT, columns % _SHIFT
    zero = np.array([zeros[g] for g in group.tolist()], np.int64)
    sums: Counter = Counter()
    stripes = range(0, len(columns), _COLUMNS)
    for a, b in ((a, b) for a in stripes for b in stripes if a <= b):
        joint = hot[:, a : a + _COLUMNS].T @ hot[:, b : b + _COLUMNS]  # [i, j]: terms with levels i and j
        i, j = np.nonzero(joint)
        n = joint[i, j].astype(np.int64)
        i, j = i + a, j + b
        once = group[i] < group[j]
        i, j, n = i[once], j[once], n[once]
        p, q, zp, zq = price[i], price[j], zero[i], zero[j]
        value = n * (_f(p, q) - _f(p, zq) - _f(zp, q) + _f(zp, zq))
        pairs, own = np.unique(np.stack([group[i], group[j]], axis=1), axis=0, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, own.ravel(), value)
        sums.update(dict(zip(map(tuple, pairs.tolist()), total.tolist(), strict=True)))
    return sums


def blocks(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The rows in blocks of bounded height and, but for single rows that are wider, bounded width."""
    now: list[np.ndarray] = []
    seen: set[int] = set()
    for row in rows:
        new = seen.union(row.tolist())
        if now and (len(now) == _ROWS or len(new) > _COLUMNS):
            yield now
            now, new = [], set(row.tolist())
        now.append(row)
        seen = new
    if now:
        yield now


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, columns and zeros, by lang, in; (lang, g, h, value) sums of blocks out."""
    sums: Counter = Counter()
    lang, held, zeros = None, [], {}

    def close() -> None:
        for block in blocks(held):
            sums.update(block_sums(block, zeros))
        held.clear()

    def told() -> pa.RecordBatch:
        g, h = zip(*sums, strict=True) if sums else ((), ())
        arrays = [pa.array([lang] * len(sums), pa.string()), pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, ["lang", "g", "h", "value"])

    for batch in batches:
        for own, columns, zero in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != lang or len(sums) > _HELD:
                close()
                yield told()
                lang, zeros = own, {}
            columns = np.array(columns, np.int64)
            zeros.update(zip((columns // _SHIFT).tolist(), zero, strict=True))
            held.append(columns)
            if len(held) >= _ROWS:
                close()
    close()
    yield told()


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the language's other sources by distance, part ``term``
    the terms that are more frequent in the group than in its language, up to rank ``top``."""
    counts = cut(term_counts(docs, text=text, lang=lang, source=source, least_docs=least_docs))
    cells = counts.where("term is not null")
    langs = counts.groupBy("lang").agg(F.count(F.when(F.col("first") & F.col("term").isNotNull(), 1)).alias("terms"), F.sum(F.when(F.col("first"), F.col("total")).otherwise(0)).alias("lang_size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size")).withColumn("g", number).join(langs, "lang")
    priced = groups.withColumn("zero", F.when(F.col("terms") > 0, _price("0", "(size + 2 * terms)")))
    groups = cut(priced.select("lang", "source", "g", "size", "terms", "lang_size", "zero"))

    own = cells.join(groups, ["lang", "source"]).withColumns({"p": _price("n", "(size + 2 * terms)"), "q": _price("total", "(lang_size + 2 * terms)")})
    own = cut(own.select("lang", "source", "term", "total", "g", "zero", "p", "q"))
    of_group = Window.partitionBy("lang", "source")
    best = own.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    terms = best.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    rows = own.groupBy("lang", "term").agg(F.max("total").alias("total"), F.collect_list(F.struct((F.col("g") * F.lit(int(_SHIFT)) + F.col("p")).alias("column"), "zero")).alias("cells"))
    rows = rows.sortWithinPartitions("lang", "total").select("lang", "cells.column", "cells.zero")  # terms alike in count share levels
    both = rows.mapInArrow(_multiply, "lang string, g bigint, h bigint, value bigint").groupBy("lang", "g", "h").agg(F.sum("value").alias("both"))
    both = both.unionByName(both.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "both"))

    one = groups.select("lang", "source", "g", "terms", F.col("zero").alias("zg"))
    other = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("zero").alias("zh"))
    pairs = one.join(other, "lang").where("g <> h")
    levels = own.groupBy("lang", "g", "p").agg(F.count("*").alias("n"))
    margin = levels.join(pairs.select("lang", "g", "h", "zg", "zh"), ["lang", "g"]).groupBy("lang", "g", "h").agg(F.sum(F.col("n") * (_apart("p", "zh") - _apart("zg", "zh"))).alias("margin"))
    margin = cut(margin)
    turned = margin.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), F.col("margin").alias("turned"))
    sums = margin.unionByName(turned.withColumnRenamed("turned", "margin")).unionByName(both.withColumnRenamed("both", "margin")).groupBy("lang", "g", "h").agg(F.sum("margin").alias("more"))
    value = F.when(F.col("terms") > 0, F.col("terms") * _apart("zg", "zh")).otherwise(0) + F.coalesce("more", F.lit(0))
    far = pairs.join(sums, ["lang", "g", "h"], "left").select("lang", "source", "item", value.cast("long").alias("value"))
    far = far.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item")))

    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(far, "pair").unionByName(shape(terms, "term"))
