"""Streams of files against the same counts over the table."""

from kindred.functions.hashes import coefficients, minhash
from kindred.operators.frequencies import frequencies
from kindred.streaming.counts import stream_frequencies, stream_signatures


def test_stream_counts_and_signatures(spark, tmp_path):
    rows = [(i, f"w{i % 7}", f"2024-01-01 00:{i % 60:02d}:00") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, w string, t string").selectExpr("id", "w", "cast(t as timestamp) AS t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stream_frequencies(stream, "w").writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("freq").collect())) == sorted(map(tuple, frequencies(df, "w").collect()))
    q = stream_frequencies(stream, "w", "t", "30 minutes").writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for r in spark.table("windows").collect()) == 200
    pairs = coefficients(8)
    q = stream_signatures(stream, "w", pairs).writeStream.format("memory").queryName("signed").start()
    q.processAllAvailable()
    q.stop()
    want = {r.w: r.s for r in df.select("w", minhash("w", pairs).alias("s")).distinct().collect()}
    assert all(r.signature == want[r.w] for r in spark.table("signed").collect())
