import random
import re
from collections import Counter, defaultdict

import numpy as np

from sweetframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_docs=10, top=10):
    counts, lang_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        lang_docs[lang or ""].update(set(words))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in lang_docs[lang].items() if n >= least_docs]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        whole = price(sum((counts[g] for g in counts if g[0] == lang), Counter()))
        prices = {g[1]: price(counts[g]) for g in counts if g[0] == lang}
        for source, p in prices.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, q in prices.items() if o != source]
            terms = [(t, f(p[t], whole[t])) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def run(spark, rows, extra="", **settings):
    df = spark.createDataFrame(rows, "text string, lang string, source string" + extra)
    return sorted(map(tuple, divergence.audit(df, **settings).collect()))


def made(n, seed=1):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzé"] + ["日本", "ÀB", "Ab"]
    text = lambda: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=rnd.randint(0, 60)))
    rows = [(text(), rnd.choice(["en", "fr", None]), rnd.choice(["s0"] * 4 + ["s1", "s2", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "silent"), ("", "en", "s1"), ("only here", "xx", "lone"), ("9 _ -", "xx", "other"), *[("Same same, SAME's", "en", "s2")] * 3]


def test_equals_brute_force_with_nulls_and_repeated_rows(spark):
    rows = made(120)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_docs=2, top=3) == brute(rows, 2, 3)


def test_blocks_of_any_size_give_equal_sums(spark, monkeypatch):
    rnd = random.Random(3)
    zeros = {g: rnd.randint(1, 50) for g in range(9)}
    rows = [np.array([g * int(divergence._SHIFT) + rnd.randint(60, 70) for g in rnd.sample(range(9), rnd.randint(1, 9))]) for _ in range(200)]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for row in rows:
        own = {int(x) // int(divergence._SHIFT): int(x) % int(divergence._SHIFT) for x in row}
        for g in own:
            for h in own:
                if g < h:
                    want[g, h] += f(own[g], own[h]) - f(own[g], zeros[h]) - f(zeros[g], own[h]) + f(zeros[g], zeros[h])
    for rows_, columns in ((1 << 13, 512), (7, 512), (50, 3)):
        monkeypatch.setattr(divergence, "_ROWS", rows_)
        monkeypatch.setattr(divergence, "_COLUMNS", columns)
        got = Counter()
        for block in divergence.blocks(rows):
            got.update(divergence.block_sums(block, zeros))
        assert got == want


def test_a_full_table_is_emptied_and_counted_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "b", "a", "a"]), pa.array([b"x y z", b"x", None, b"X w v u"], pa.binary())], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["a", b"x"] == docs["a", b"x"] == 2 and n["b", b"x"] == 1 and ("a", None) in n and ("b", None) in n


def test_counts_beyond_64_bits_are_priced_exactly(spark):
    n, size = 5 * 10**17, 10**18 + 7
    assert spark.range(1).select(divergence._price(f"{n}L", f"{size}L").alias("p")).first()["p"] == 1 + 10**9 * (n + 2) // size


def test_empty_table_and_columns_with_the_names_of_results(spark):
    assert run(spark, []) == []
    rows = made(40, 5)
    extra = ", term string, n long, total int, g string, rank int, value double"
    assert run(spark, [(*r, "q", 1, 2, "g", 3, 0.5) for r in rows], extra, least_docs=2) == brute(rows, 2)
