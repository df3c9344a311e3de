"""Queries that SQL can express, and the pipeline's stages, on the smallest tables."""

from compare import connect, same

SF = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    from sparkloom.llm import queries

    duck = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert same(queries.queries()[name](spark, SF), sql, duck), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "token_output":
            assert docs.columns == columns, name
        if name in ("language_id", "near_dedup", "decontamination"):
            assert docs.count() <= before
            before = docs.count()
    assert docs.count() > 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(docs.columns)
