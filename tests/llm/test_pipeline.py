import corpus_pipeline


def test_stages_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(spark, stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == {r[0] for r in docs.select("doc_id").collect()}


def test_stages_on_empty_and_null_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf_dir).collect()
