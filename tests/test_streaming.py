from graphloom.streaming import patterns


def test_two_hop_counts_over_batches(spark, tmp_path):
    rels = [(1, 1, 2), (2, 2, 3), (3, 3, 2), (4, 2, 2), (5, 5, 1), (6, 2, 1)]
    source = str(tmp_path / "in")
    for part in (rels[:2], rels[2:4], rels[4:]):
        spark.createDataFrame(part, "_id long, _src long, _dst long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("_id long, _src long, _dst long").option("maxFilesPerTrigger", 1).parquet(source)
        patterns.count_two_hops(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.b: r.n for r in patterns.current(spark, str(tmp_path / "out" / "counts"), "b").collect() if r.n}
    want = {}
    for i, _, b in rels:
        for j, a, _ in rels:
            if i != j and b == a:
                want[b] = want.get(b, 0) + 1
    assert got == want


def test_hop_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("R", 1), ("R", 2), ("S", 3)], "_type string, _id long").write.parquet(source)
    stream = spark.readStream.schema("_type string, _id long").parquet(source)
    patterns.count_hops(stream, "_type", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r._type: r.n for r in patterns.current(spark, str(tmp_path / "out"), "_type").collect()} == {"R": 2, "S": 1}
