import re

import numpy as np
import pytest

from sweetframe.llm import licenses

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w = plain_words(text)
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, sorted(found)


@pytest.mark.parametrize("text", [None, "", "MIT-License mit license MIT License", "a General Public License; Apache license", "x" * 100_000, "mit license " * 2000, "ÀMIT license_mit licenſe K"])
def test_base_equals_the_plain_one(text):
    w, base = plain_base(text)
    got = licenses.default_scanner().scan(text)
    assert (got["n_words"], got["n_base"]) == (len(w), len(base))
    assert (got["first_word"], got["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
    assert got["base_labels"] == sorted({x for _, x in base}) and set(got["base_labels"]) <= set(got["labels"])
    assert 0 <= got["score"] <= 1


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 4, n).tolist() for n in (30, 17, 5, 40)]
    text = rng.integers(0, 4, 400).tolist() + sequences[1] + sequences[3]
    automaton = licenses.SuffixAutomaton(sequences)
    lengths, states = automaton.statistics(text)
    runs = {tuple(s[i:j]): 0 for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i in range(len(text)):
        longest = next((n for n in range(min(i + 1, 40), 0, -1) if tuple(text[i - n + 1 : i + 1]) in runs), 0)
        assert lengths[i] == longest
        ends = {(t, j - 1) for t, s in enumerate(sequences) for j in range(longest, len(s) + 1) if longest and s[j - longest : j] == text[i - longest + 1 : i + 1]}
        got = automaton.matches(states[i], longest, 1)
        assert {e for e, n in got.items() if n == longest} == ends
        for (t, j), n in got.items():  # the longest run that ends at both places
            same = next((k for k in range(min(i, j) + 1) if text[i - k] != sequences[t][j - k]), min(i, j) + 1)
            assert n == same
        assert set(got) == {(t, j) for t, s in enumerate(sequences) for j, x in enumerate(s) if x == text[i]}


def plain_runs(scanner, text, templates, least):
    """Each run along a diagonal of text and template that no word prolongs."""
    ids = {w: i for i, w in enumerate({w for _, t in templates for w in plain_words(t)})}
    x = np.array([ids.get(w, -1) for w in plain_words(text)] + [-2])
    out = []
    for t, (_, words) in enumerate(templates):
        last = np.zeros(len(x), int)
        for j, w in enumerate([*plain_words(words), None]):
            now = np.where(x == ids.get(w, -3), np.concatenate(([0], last[:-1])) + 1, 0)
            done = np.flatnonzero((last >= least) & (np.append(now[1:], 0) == 0))
            out += [(t, int(i) - int(last[i]) + 1, j - int(last[i]), int(last[i])) for i in done]
            last = now
    return sorted(out)


def plain_spans(runs, templates, sizes, gap=8, cover=0.5, long_run=12, least=5):
    spans = []
    words = [" ".join(plain_words(t)) for _, t in templates]

    def tells(t, b, n):
        w = words[t].split()[b : b + n]
        return any(all(label == templates[t][0] for (label, _), other in zip(templates, words, strict=True) if f" {' '.join(w[i : i + least])} " in f" {other} ") for i in range(n - least + 1))

    for t in {r[0] for r in runs}:
        chains = []
        for _, a, b, n in sorted(r for r in runs if r[0] == t):
            fit = [c for c in chains if 0 <= a - c["end"] <= gap and 0 <= b - c["at"] <= gap]
            if fit:
                fit[-1].update(end=a + n, at=b + n, words=fit[-1]["words"] + n, most=max(fit[-1]["most"], n), tells=fit[-1]["tells"] or tells(t, b, n))
            else:
                chains.append({"first": a, "end": a + n, "at": b + n, "words": n, "most": n, "tells": tells(t, b, n)})
        spans += [(templates[t][0], c["first"], c["end"], c["words"], c["words"] / sizes[t]) for c in chains if c["tells"] and (c["words"] >= cover * sizes[t] or c["most"] >= long_run)]
    inside = lambda x, y: y[1] <= x[1] and x[2] <= y[2] and y[3] >= x[3] and y[4] > x[4]
    return sorted((x[0], x[1], x[2], x[4]) for x in spans if not any(inside(x, y) for y in spans))


ALL = (*licenses.TEMPLATES, *licenses.creative_commons())


def plain_scan(text):
    sizes = [len(plain_words(t)) for _, t in ALL]
    return plain_spans(plain_runs(None, text, ALL, 5), ALL, sizes)


def test_spans_equal_brute_force_on_shared_wording():
    rng = np.random.default_rng(5)
    templates = tuple((f"l{k % 3}", " ".join(f"w{x}" for x in rng.integers(0, 6, n))) for k, n in enumerate((30, 25, 12, 40)))
    templates += (("l4", templates[0][1] + " w9 w9"),)
    scanner = licenses.Scanner(templates, (), least=3, cover=0.3, long_run=9)
    for _ in range(30):
        parts = [templates[k][1].split()[a : a + 14] for k, a in zip(rng.integers(0, 5, 6), rng.integers(0, 12, 6))]
        text = " ".join(w for p in parts for w in [*p, *(f"w{x}" for x in rng.integers(0, 12, 3))])
        ids = np.array([scanner.ids.get(w.encode(), -1) for w in text.split()], np.int32)
        runs = plain_runs(scanner, text, templates, 3)
        assert scanner.runs(ids) == runs
        assert scanner.spans(ids) == plain_spans(runs, templates, scanner.sizes, cover=0.3, long_run=9, least=3)


def test_method_adds_templates_without_their_names():
    text = dict(licenses.TEMPLATES[:9])["bsd"]
    got = licenses.default_scanner().scan("Some words first. " + text.replace("retain", "always keep") + " And after.")
    assert got["labels"] == ["bsd"] and got["base_labels"] == [] and got["score"] > 0.6
    assert [s["label"] for s in got["spans"]] == ["bsd"]
    assert licenses.default_scanner().scan("the rights to use this list of words and the copy of the story")["labels"] == []


@pytest.mark.parametrize("variant", ["by", "by-sa", "by-nc", "by-nc-nd"])
def test_a_marking_gives_its_own_variant_only(variant):
    for text in (f"This work is licensed under CC {variant.upper()} 4.0.", f"licensed under CC {variant.upper()} 4.0", *(t for label, t in licenses.creative_commons() if label == f"cc-{variant}")):
        assert licenses.default_scanner().scan("Foo bar. " + text + " Baz.")["labels"] == [f"cc-{variant}"], text


def test_query_equals_brute_force(spark):
    from sweetframe.llm.queries import op4_license_scan

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op4_license_scan(spark, d).collect()
    assert len(rows) == len(texts)
    added = set()
    for r in rows:
        w, base = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(base), ",".join(sorted({x for _, x in base})))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        spans = plain_scan(texts[r["doc_id"]])
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {s[0] for s in spans}))
        assert abs(r["score"] - min(1.0, max([s[3] for s in spans], default=0.0))) < 1e-12
        added |= {s[0] for s in spans} - {x for _, x in base}
    assert added


def test_planted_notices_and_the_empty_table(spark):
    notices = [(i, f"Ünsinn wörd {i}. " * 40 + t + " " + "more text here " * 30) for i, (_, t) in enumerate(ALL)]
    docs = spark.createDataFrame([*notices, (900, None), (901, ""), (902, "of the and to " * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", licenses.scan(spark, docs["text"]).alias("s")).collect()}
    for i, (label, t) in enumerate(ALL):
        assert label in found[i]["labels"] and set(found[i]["labels"]) == {s[0] for s in plain_scan(t)} | set(found[i]["base_labels"])
    assert all(not found[i]["labels"] and found[i]["score"] == 0 for i in (900, 901, 902))
    assert docs.limit(0).select(licenses.scan(spark, docs["text"])).count() == 0


def test_a_clause_repeated_often_does_not_part_a_chain():
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    clause, first, last = words("c", 5), words("u", 10), words("v", 10)
    template = [*first, *clause, *last, *(w for i in range(11) for w in [*words(f"f{i}x", 9), *clause])]
    scanner = licenses.Scanner((("often", " ".join(template)),), (), cover=0.1)
    found = scanner.scan(" ".join(["x", *first, "x", *clause, "x", *last, "x"]))["spans"]
    assert [(f["first"], f["end"], f["cover"]) for f in found] == [(1, 28, 25 / len(template))]


def test_every_template_has_telling_runs_and_openings_alone_tell_nothing():
    scanner = licenses.default_scanner()
    assert all(t[-1] > 0 for t in scanner.telling)
    clean = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl"], "This work is licensed under the MIT License.": ["mit"], "This work is licensed under a commercial agreement with the publisher.": [],
        "This work is licensed under a Creative Commons license of the author's choice.": [], "To view a copy of this license, visit our office.": [], "This program is free software; you can redistribute it and/or modify it as you like.": [],
        "Permission is hereby granted, free of charge, to any person who visits the museum on Sunday.": [], "THE SOFTWARE IS PROVIDED AS IS and we are glad about that.": [], "The above copyright notice and this permission notice hang on the wall.": [],
    }
    for text, labels in clean.items():
        assert scanner.scan("Some words. " + text + " And more words.")["labels"] == labels, text
