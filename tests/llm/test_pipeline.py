import corpus_pipeline
from sweetframe.llm import decontaminate, language_id, mixing, secrets


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_stages_equal_brute_force_on_a_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    bench = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    now = docs
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.cut(stage(spark, now, d))
        assert now.columns == docs.columns
        results[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(results["language ID"]) == {i for i, r in rows.items() if language_id.letter_runs(r["text"])}

    # brute force over all pairs: of each group linked by similar sets the least id stays
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, r in results["language ID"].items() if (w := lower(r["text"]).split())}
    group = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and group[x] != group[y] and len(sets[x] & sets[y]) * 5 >= 4 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if g == old else g for k, g in group.items()}
    kept = set(results["near-dedup"])
    assert kept == set(group.values()) and len(kept) < len(group)

    probes = decontaminate.Probes(bench, decontaminate.Settings())
    leaky = {i for i in kept for p in probes.text if p in decontaminate.plain(rows[i]["text"])}
    assert leaky and not leaky & set(results["decontamination"])
    assert all(next(probes.matches([decontaminate.plain(rows[i]["text"])]), None) for i in kept - set(results["decontamination"]))

    for i, r in results["secret scan"].items():
        assert not secrets.strong_spans(r["text"].replace("[SECRET]", " "))
        if not any(secrets.find_secrets(rows[i]["text"])):
            assert r == rows[i]
    assert set(results["secret scan"]) == set(results["decontamination"])

    mixed = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    want = {r["key"]: r["copies"] for r in mixing.rates(now).collect()}
    got = {}
    for r in mixed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}

    # and run() gives just what the stages give one by one
    whole = {}
    for r in corpus_pipeline.run(spark, d).collect():
        assert r["text"] == results["secret scan"][r["doc_id"]]["text"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + 1
    assert whole == got


def test_columns_of_any_name_come_through_the_stages(spark):
    texts = ["The cat sat on the mat and looked at the dog in the garden.", "password = hunter22secret and more of the words", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, found int, spans int")
    out = corpus_pipeline.redact_secrets(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {(2, 3)}
    assert [r["text"] for r in out.orderBy("doc_id").collect()][2:] == ["", None] and "hunter22secret" not in str(out.collect())
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(r)[5:] for r in kept.collect()} <= {(2, 3)}
    assert corpus_pipeline.redact_secrets(spark, docs.limit(0), "").count() == 0
