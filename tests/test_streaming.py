from terrastrata import breaks, SpatialRaster
from terrastrata.streaming import stratified


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([(k // 5, k % 5, float(k), None if k == 7 else float(k % 4)) for k in range(20)], "row int, col int, a double, b double")
    rows.write.parquet(f"{tmp_path}/in")
    cuts = {"a": [12, 4.0], "b": [1.5]}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = stratified(stream, cuts, map=True).writeStream.format("memory").queryName("strata").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("strata").select("row", "col", "strat_a", "strat_b", "strat_map").collect()), key=str)
    want = breaks(SpatialRaster.from_dataframe(rows, 5, 4, (0, 1, 0, 0, 0, -1)), cuts, map=True).df
    assert got == sorted(map(tuple, want.collect()), key=str)
