import hashlib
import random
import zlib

import numpy as np
import pytest

from sweetframe.llm import periodic
from sweetframe.llm.queries import op12_periodic_runs


def brute(words, least=24, times=3):
    """(start, length, period) of all runs, by comparing the words with themselves at each distance."""
    ids = periodic._ids([w.encode() for w in words])
    found = {}
    for q in range(1, len(ids) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids[:-q] == ids[q:], [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def repeated(rnd, alphabet, n):
    """A text with loops in it, some of them of loops."""
    words = []
    while len(words) < n:
        part = rnd.choices(alphabet, k=rnd.randint(1, max(1, n // 8)))
        if rnd.random() < 0.4:
            part = part[: rnd.randint(1, 9)] * rnd.randint(2, 6)
        words += part * rnd.choice([1, 1, 2, 3, 4, 7]) + part[: rnd.randint(0, len(part))]
    return words[:n]


def by_tiles(words, times=3, least=24):
    ids = periodic._ids([w.encode() for w in words])
    parts = {}
    for low, high, a, b, core, core_end in periodic.tiles(len(ids), times):
        for q, x, y in periodic.fragments(ids[a:b], low, high, core - a, core_end - a, a, b == len(ids), least, times):
            parts.setdefault(q, []).append((x + a, y + a))
    runs = []
    for q, own in parts.items():
        merged = []
        for x, y in sorted(own):
            if merged and x <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
        runs += [(x, y - x + q, q) for x, y in merged if y - x + q >= max(least, times * q)]
    return sorted(runs)


@pytest.mark.parametrize("core, cells", [(1 << 13, 16), (16, 1), (32, 2), (8, 1), (64, 4)])
def test_tiles_of_any_size_find_what_brute_force_finds(monkeypatch, core, cells):
    monkeypatch.setattr(periodic, "_CORE", core)
    monkeypatch.setattr(periodic, "_CELLS", cells)
    rnd = random.Random(core)
    for k in range(150):
        words = repeated(rnd, "ab" if k % 3 == 0 else "abcdefghijk", rnd.choice([0, 5, 23, 24, 25, 90, 300, 700]))
        assert by_tiles(words) == brute(words), words
    for words in (["a"] * 500, ["a", "b"] * 300, list("abcabcabd") * 60, [str(i) for i in range(200)] * 3, [str(i) for i in range(200)] * 2):
        assert by_tiles(words) == brute(words)


def test_number_of_tiles_grows_in_proportion_to_the_document():
    for n in (100, 10_000, 1_000_000):
        own = list(periodic.tiles(n, 3))
        sets = len({x[0] for x in own})
        assert sets <= max(1, len(periodic.octaves(n, 3)) - 6)
        assert sum(b - a for _, _, a, b, _, _ in own) < 1.3 * n * sets
        assert max(b - a for low, high, a, b, _, _ in own) <= max(1.3 * (1 << 13), 24 * own[-1][0], 1.3 * n * (n <= 1 << 13))


def long_text(seed):
    rnd = random.Random(seed)
    filler = lambda n: [f"w{rnd.randint(0, 60)}" for _ in range(n)]
    loop = filler(3_000)
    return filler(5_000) + loop * 4 + loop[:700] + filler(900) + ["x", "y", "z"] * 4_000 + filler(3_000) + filler(777) * 5


@pytest.mark.parametrize("deal_from", [0, 8 << 20])
def test_documents_of_many_tiles_nulls_and_repeated_rows(spark, deal_from):
    rnd = random.Random(5)
    texts = {i: " ".join(repeated(rnd, "abc", 200)) for i in range(20)} | {100: " ".join(long_text(1)), 101: "same \t" * 30_000}
    rows = [(i, t, "kept", 1) for i, t in texts.items()] + [(3, texts[3], "again", 1), (3, "other text", "id again", 1), (7, "", "", 1), (8, None, "", 1), (9, " \n ", "", 1), (None, "a b " * 20, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, key int").repartition(3)
    got = periodic.periodic_runs(df, deal_from=deal_from).collect()
    assert len(got) == len(rows) and {r["runs_"] for r in got} >= {"kept", "again", "id again", "no id"}
    for r in got:
        assert [tuple(x) for x in r["runs"]] == brute((r["text"] or "").split()), r["doc_id"]


def test_collapsed_text_keeps_the_first_period(spark):
    rows = [("x " + "a b c " * 9 + "y", [(1, 27, 3)]), ("", []), (None, []), ("p  q", [])]
    df = spark.createDataFrame(rows, "text string, runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] for r in df.select(periodic.collapsed(df["text"], df["runs"])).collect()] == ["x a b c y", "", "", "p q"]


def test_short_settings_are_refused_and_an_empty_table_gives_none(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(df).collect() == []
    for bad in ({"times": 2}, {"least": 10}):
        with pytest.raises(ValueError):
            periodic.runs_of(df, **bad)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join(repeated(rnd, "abcdefgh", rnd.randint(0, 400))) for _ in range(60)] + [None, "", "one", " a\tb "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op12_periodic_runs(spark, str(tmp_path)).collect():
        words = (texts[r["doc_id"]] or "").split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a, k = h // 10 % n, 3 + h // 10 % 8
            words = [words[a + (i - a) % (1 + (n - a) // k)] if i >= a else words[i] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + m for a, m, q in runs)]
        want = (r["doc_id"], len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(kept)))
        assert tuple(r) == want
