"""The pipeline's stages, each on its own input, against brute force."""

import shutil

import pytest

import corpus_pipeline

from .test_ops import SCHEMA, SMALL, brute_components, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, " ".join("abcdefghij"))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_named_and_whole(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"'own' AS {n}" for n in ("toxicity", "kept_id", "kept_text", "gone_id", "leaks", "h", "size", "node")])
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {("own",) * 8}
        assert step(spark, docs.limit(0), folder).count() == 0


def test_toxicity_stage(spark):
    """What the operator scores as toxic goes, all else stays, row by row."""
    from markerflow.llm import toxicity
    from markerflow.llm.common import table

    docs = table(spark, SMALL, "documents")
    scored = toxicity.toxicity(docs, table(spark, SMALL, "labels")).collect()
    want = sorted(r.doc_id for r in scored if r.toxicity < toxicity.TOXIC)
    kept = stage("toxicity")(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns


def test_mixing_stage(spark, folder):
    from markerflow.llm import mixing

    from ..compare import same

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    same(stage("mixing sources")(spark, docs, folder), mixing.ORACLE, folder)


def test_exact_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(r.doc_id, (r.text or "").encode().lower()) for r in stage("exact dedup")(spark, docs, folder).collect()]
    best = {}
    for i, t, *_ in corpus():
        k = (t or "").encode().lower()
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    assert sorted((i if i is not None else -1, t) for i, t in kept) == sorted((v, k) for k, v in best.items())


def test_near_stage(spark, folder):
    docs = stage("exact dedup")(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).cache()
    rows = [tuple(r) for r in docs.collect()]
    found = brute_components(rows)
    gone = {i for i, _, c in found if i != c}
    want = sorted(str(i) for i, _, _ in found if i not in gone)
    assert sorted(str(r.doc_id) for r in stage("n-gram Jaccard join")(spark, docs, folder).collect()) == want


def test_leak_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in stage("benchmark decontamination")(spark, docs, folder).collect()}
    assert {i for i, *_ in corpus()} - left == {18, 19}


def test_run_with_the_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and rows
    assert len({r.doc_id for r in rows}) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in rows)
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_near_stage_keeps_one_row_of_each_component(spark):
    from .test_ops import sentence

    first, second, third, clean = (sentence(i, 60) for i in (31, 32, 33, 34))
    rows = [
        *[(5, first), (None, first + " more"), (None, clean), (7, sentence(35, 60)), (8, first + " end"), (8, sentence(36, 60))],  # a null id and a repeated one beside clean rows
        *[(None, second), (None, second + " more")],
        *[(9, third), (9, third + " more"), (9, third)],
        *[(None, None), (None, None), (None, ""), (9, " ")],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in stage("n-gram Jaccard join")(spark, docs, "").collect()]
    assert len(kept) == 10 and sorted(map(str, kept)) == sorted(map(str, [r for r in kept if r in rows]))
    assert {(5, first), (None, clean), rows[3], rows[5]} <= set(kept) and not {rows[1], rows[4]} & set(kept)
    assert [sum(t.startswith(s) for _, t in kept if t) for s in (first, second, third)] == [1, 1, 1]
    assert sum(1 for _, t in kept if not (t or "").strip()) == 4


def test_without_toxic_labels_nothing_goes(spark):
    from markerflow.llm import toxicity

    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(8)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(i, 0, 0) for i in range(8)]):
        scored = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert scored.where(f"toxicity >= {toxicity.TOXIC}").count() == 0 and scored.count() == 9
