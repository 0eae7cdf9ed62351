import corpus_pipeline as cp
from factloom.llm import secret_scan, sentencepiece_scan, simhash_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, step = docs.columns, {}
    d = docs
    for name, stage in cp.STAGES:
        d = spark.createDataFrame(stage(spark, d, SF).toPandas()) if name != "sentencepiece" else stage(spark, d, SF)
        step[name] = d
        assert name == "sentencepiece" or d.columns == names
    rejected = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in step["toxicity"].collect()} == {r.doc_id for r in docs.collect()} - rejected
    classes = simhash_dedup.near_duplicates(step["toxicity"]).collect()
    assert {r.doc_id for r in step["near_duplicates"].collect()} == {r.component_id for r in classes}
    assert all(secret_scan.base_spans(r.text) == [] for r in step["secrets"].collect())
    mixed = step["mixing"].collect()
    p = sentencepiece_scan.pieces()
    want = sorted((r.doc_id, p.sp.encode(r.text)) for r in mixed)
    assert sorted((r.doc_id, r.ids) for r in step["sentencepiece"].collect()) == want


def test_run(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    assert cp.run(spark, SF).count() > 0


def written(spark, path, documents, labels):
    documents.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def toxic_rows(n, start):
    """Rows of which every third is toxic, and its label."""
    import random

    rng = random.Random(start)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(start, start + n):
        words = [word() for _ in range(80)]
        if i % 3 == 0:
            words[::6] = [rng.choice(["grom", "blarg", "snurf"]) for _ in words[::6]]
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_run_on_odd_repeated_and_clashing_rows(spark, documents, labels, clashing, tmp_path):
    data = toxic_rows(120, 1000)
    rows = [*map(tuple, documents().collect()), *((i, t, "en", "a", len(t)) for i, t, _ in data), (None, "a text of its own with password: hunter2hunter2xx", "en", "b", 1), (None, "another text of its own entirely", "en", "b", 1), (1000, "the same id and other words here", "en", "a", 1)]
    docs = clashing(spark.createDataFrame(rows, documents().schema))
    sf = written(spark, tmp_path / "odd", docs, labels([(i, 1, y) for i, _, y in data]))
    step, d = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf).collect(), d.schema)
        assert d.columns == docs.columns
        step[name] = [(r.doc_id, r.text) for r in d.collect()]
    toxic = {i for i, _, y in data if y}
    assert len(toxic & {i for i, _ in step["toxicity"]}) <= 1 and {i for i, _, y in data if not y} <= {i for i, _ in step["toxicity"]}
    texts = [t for _, t in step["near_duplicates"]]
    assert len([t for t in texts if not (t or "").strip()]) == 1 and len(texts) == len({(t or "").strip() for t in texts})
    assert {"the same id and other words here", "another text of its own entirely"} <= set(texts)
    assert "a text of its own with [SECRET]" in {t for _, t in step["secrets"]}
    assert set(step["mixing"]) <= set(step["secrets"])
    out = cp.run(spark, sf).collect()
    p = sentencepiece_scan.pieces()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in out))) == sorted(str((i, p.sp.encode(t or ""))) for i, t in step["mixing"])


def test_run_on_empty_tables(spark, documents, labels, tmp_path):
    sf = written(spark, tmp_path / "empty", documents([]), labels([]))
    assert cp.run(spark, sf).collect() == []
