import ragtide as rt


def test_a_stream_gives_what_files_give(spark, tmp_path):
    a = rt.from_lists([[{"k": 1, "x": [1, 2, 3]}, {"k": 2, "x": []}], [{"k": 3, "x": [5]}]], spark=spark)
    path = rt.to_parquet(a, str(tmp_path / "in"))
    s = rt.read_parquet_stream(path, spark.read.parquet(path).schema, spark=spark, max_files=1)
    kept = s[rt.num(s.x) > 0]
    made = rt.zip({"k": kept.k, "total": rt.sum(kept.x[kept.x > 1], axis=1)}, depth_limit=1)
    for _ in range(2):  # the second run finds nothing new
        rt.write_stream(made, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 5), (3, 5)]
