import corpus_pipeline as P
from fixtures import DOC_SCHEMA, TEXTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_their_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, seen = {r.doc_id for r in docs.collect()}, []
    for number, (_, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, sf_dir), f"test-{number}")
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows) and ids <= before
        if number + 1 < len(P.STAGES):
            assert docs.columns == COLUMNS
        seen.append(len(ids))
        before = ids
    assert seen[0] > seen[2] and seen[3] == seen[4] > 50
    assert all(r.round_trip for r in rows)
    assert sorted(map(repr, P.run(spark, sf_dir).collect())) == sorted(map(repr, rows))


def test_awkward_documents(spark, sf_dir):
    rows = [(i if i != 3 else None, t, [None, "en"][i % 2], "s", 1, 7, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows, DOC_SCHEMA)
    for number, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 < len(P.STAGES):
            assert out.columns == docs.columns
            docs = P.written(out, f"awkward-{number}")
        out.count()
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
