import corpus_pipeline


def test_decontamination_judges_each_row(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item} y"), (None, "clean one"), (7, f"z {item}"), (7, "clean two"), (8, None), (None, None), (9, item)]
    docs = spark.createDataFrame([(k, t, "k") for k, t in rows], "doc_id long, text string, key string")
    got = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
