import random

import numpy as np
import pytest

from sweetframe.llm import oddsketch

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=3):
    w = (text or "").translate(LOWER).split()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, part=85, whole=100):
    """By row: (key, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and whole * both >= part * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((key, len(sets[i]), least, key == least))
    return out


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, oddsketch.near_groups(df, **settings).collect()), key=str)


def copies(rnd, n, words=120, spread=14):
    """A text and n copies, each with some words replaced."""
    base = [f"w{rnd.randint(0, 5_000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, spread)):
            own[rnd.randrange(words)] = f"x{rnd.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1 << 11, 8])
def test_equals_brute_force_with_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(oddsketch, "_BLOCK", block)
    rnd = random.Random(block)
    texts = [t for k in (40, 3, 1, 0, 0, 25) for t in copies(rnd, k)] + copies(rnd, 12, words=9, spread=1)
    form = [f"f{i}" for i in range(80)]
    texts += [" ".join(form + [f"y{rnd.random()}" for _ in range(25)]) for _ in range(30)]  # share bands, not similar
    texts += ["one two", "One  TWO", "one two three", "a", "a", *texts[:3]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 10))
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert 5 < sum(r[3] for r in got) < len(rows)


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (3, " "), (None, "p q r s"), (None, "p q r s"), (9, "z z z z z"), (None, "z z z z"), (5, "P q R s t u"), (5, "P q R s t u"), (None, None)]
    got = run(spark, rows)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True), (None, 2, None, True), (None, 2, None, True), (9, 1, 9, True), (None, 1, 9, False), (5, 4, 5, True), (5, 4, 5, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    df = spark.createDataFrame([(7, "a b c", "n", 1)], "node long, hash string, band string, kept int")
    assert [tuple(r) for r in oddsketch.near_groups(df, text="hash", key="node").collect()] == [(7, 1, 7, True)]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [], similar=(7, 10))


def test_sketches_estimate_similarities_and_the_limit_holds():
    rnd = np.random.default_rng(4)
    sketch = lambda x: np.frombuffer(oddsketch.odd_sketch(oddsketch.samples(np.unique(x))), np.uint8)
    most, counts = oddsketch.most_differing(0.85), {}
    for j in (0.5, 0.85, 0.95):
        own = []
        for _ in range(150):
            n = 400
            common = round(2 * n * j / (1 + j))
            pool = rnd.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
            own.append(int(np.bitwise_count(sketch(a) ^ sketch(b)).sum()))
        counts[j] = np.array(own)
        assert abs(np.mean(oddsketch.estimate(counts[j])) - j) < 0.02
    assert oddsketch.bands_for((85, 100)) == (30, 6) and oddsketch.bands_for((4, 5)) == (35, 5)
    assert counts[0.85].max() <= most and counts[0.95].max() < counts[0.5].min() and (counts[0.5] > most).mean() > 0.9
    assert np.std(oddsketch.estimate(counts[0.95])) < np.std(oddsketch.estimate(counts[0.5]))


def test_slots_give_just_the_near_pairs_of_two_groups_and_each_row_its_nearest():
    rng = np.random.default_rng(9)
    n = 400
    base = [rng.integers(0, 2**63, 140, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[rng.random(140) < 0.95], rng.integers(0, 2**63, 6, dtype=np.uint64)])) for b in (base[i] for i in rng.integers(0, 4, n))]
    slot = np.sort(rng.choice([1, 2, 3, 4, 5, 60], n, p=[0.02, 0.02, 0.02, 0.04, 0.4, 0.5]))
    group = rng.integers(0, 9, n)
    order = np.lexsort((group, slot))
    slot, group = slot[order], group[order]
    side = np.where(slot == 60, rng.integers(0, 2, n), 2)
    near = oddsketch.Near((85, 100))
    sketches, whole = (oddsketch._words([f(x) for x in sets]) for f in (lambda x: oddsketch.odd_sketch(oddsketch.samples(x)), oddsketch.set_parity))
    slots = oddsketch.Slots(near, slot, side, group, np.array([len(x) for x in sets]), sketches, whole)
    meet = lambda i, j: slot[i] == slot[j] and group[i] != group[j] and (side[i] == 2 or side[i] != side[j])
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    all_ = {(i, j): jaccard(i, j) for j in range(n) for i in range(j) if meet(i, j)}
    similar = {p for p, x in all_.items() if x >= 0.85}
    got = {(min(x), max(x)) for x in zip(*(x.tolist() for x in slots.every()), strict=True)}
    assert 100 < len(similar) and similar <= got <= set(all_) and len(got) < 1.25 * len(similar)
    rows, partner = slots.nearest()
    assert set(rows.tolist()) == {i for p in got for i in p} and all(tuple(sorted(p)) in got for p in zip(rows.tolist(), partner.tolist(), strict=True))
    best = {i: max(x for p, x in all_.items() if i in p) for i in rows.tolist()}
    assert all(jaccard(i, j) >= best[i] - 0.05 for i, j in zip(rows.tolist(), partner.tolist(), strict=True))


def test_one_of_each_keeps_clean_rows_and_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long, "a"), (3, long, "b"), (9, long.replace("w7 ", "w8 "), "c"), (4, "quite another text", "d"), (4, "quite another text", "d"), (None, None, "e"), (7, "", "f"), (8, "a b c d e f g h i j", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    out = oddsketch.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"]) for r in out.collect())
    assert got == [(False, 3, "b"), (False, 4, "d"), (False, 8, None), (True, 0, "e")]
    assert oddsketch.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_decides_by_exact_similarity(spark):
    rng = np.random.default_rng(11)
    texts, want = {}, {}
    for i in range(400):  # pairs of 100 shingles that share 89 (0.802) or 88 (0.786): words cut at both ends
        w = [f"w{x}" for x in rng.integers(0, 10**9, 115)]
        shift = 11 if i % 2 else 12
        texts[2 * i], texts[2 * i + 1] = " ".join(w[:104]), " ".join(w[shift : shift + 104])
        a, b = shingles(texts[2 * i], 5), shingles(texts[2 * i + 1], 5)
        want[i] = len(a & b) >= 0.8 * len(a | b)
        assert want[i] == bool(i % 2)
    texts |= {900: "a b c d e f g h", 901: "a b c d e f g h i"}  # 4 of 5 shingles
    chain = [f"c{i}" for i in range(400)]  # neighbours at 0.9, ends apart: one group
    texts |= {1000 + k: " ".join(chain[5 * k : 5 * k + 104]) for k in range(40)}
    for i in range(100):  # two of three are similar, the third shares bands with them
        w = [f"t{x}" for x in rng.integers(0, 10**9, 130)]
        texts |= {2000 + 3 * i + k: " ".join(w[a : a + 104]) for k, a in enumerate((0, 14, 18))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in oddsketch.one_of_each(docs).collect()}
    missed = [i for i in range(400) if want[i] and 2 * i + 1 in kept]
    assert not missed and all(2 * i in kept for i in range(400))
    assert all(2 * i + 1 in kept for i in range(400) if not want[i])
    assert {k for k in kept if k >= 900} == {900, 1000} | {2000 + 3 * i + k for i in range(100) for k in (0, 1)}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2, 3, 4), (2, "a b c d e f g", 1, 2, 3, 4), (3, "x y", 5, 6, 7, 8)], "doc_id long, text string, times int, key int, hash int, row int")
    out = oddsketch.one_of_each(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.where("doc_id <> 2").collect()))


def test_one_of_each_pairs_by_multi_index_hashing_and_confirms(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [t for _ in range(6) for t in copies(rnd, 4, words=400, spread=2)] + ["a b c d e f", "A b c D e f", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints, asked = {i: oddsketch.simhash.majority(oddsketch.shingle_set(t, 5)) for i, t in enumerate(texts) if t}, []
    linked = oddsketch._linked
    monkeypatch.setattr(oddsketch, "_linked", lambda *a: asked.append(a) or linked(*a))
    oddsketch.one_of_each(docs).collect()
    (signed, _, _, first) = asked[0]
    node = {r["id"]: bytes(r["node"]) for r in signed.collect() if r["node"] is not None}
    assert {r["id"]: r["print"] for r in signed.collect()} == {**dict.fromkeys(range(len(texts))), **prints}
    root = {n: n for n in node.values()}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in first.collect():
        root[find(bytes(r["u"]))] = find(bytes(r["v"]))
    got = {(i, j) for i in prints for j in prints if i < j and find(node[i]) == find(node[j])}
    group = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4:
                group = {k: group[i] if g == group[j] else g for k, g in group.items()}
    assert got == {(i, j) for i in prints for j in prints if i < j and group[i] == group[j]} and len(got) > 10


def test_components_of_stars_take_no_round_and_others_end_as_stars(spark, monkeypatch):
    from sweetframe.llm import components

    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    edges = lambda x: spark.createDataFrame(x, "u long, v long")
    got = components.components(edges([(5, 1), (6, 1), (1, 7), (9, 8)])).collect()
    assert not rounds and {tuple(r) for r in got} == {(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)}
    got = components.components(edges([(i, i + 1) for i in range(40)] + [(50, 51)])).collect()
    assert rounds and {tuple(r) for r in got} == {(i, 0) for i in range(41)} | {(50, 50), (51, 50)} and len(got) == 43
