"""Running counts of a stream."""

from fgspark.streaming.counts import count_stream, energies


def test_counts_add_up(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = count_stream(stream, ["x", "y"], str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {(r.x, r.y): r.n for r in energies(spark, str(tmp_path / "out"), ["x", "y"]).collect()}
    assert got == {("a", 1): 3, ("b", 2): 1}
