import time

from pyspark.sql import functions as F

from halyard.streaming import ingest, listeners, progress


def test_sessions_of_a_stream_equal_those_of_the_table(spark, small, tmp_path):
    like = spark.read.parquet(f"{small}/events.parquet")
    stream = ingest.idle_sessions(ingest.arrivals(spark, small, like, "events.parquet"), "user_id", "ts", "6 hours", "0 seconds")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = like.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start"), F.col("w.end"), "n")
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, want.collect()))


def test_forwarding_sets_refused_rows_aside(spark, small, tmp_path):
    like = spark.read.parquet(f"{small}/events.parquet")
    run = ingest.forward(ingest.arrivals(spark, small, like, "events.parquet"), [lambda d: d.withColumn("value", F.lit(0.0))], F.col("event_type") == "error", str(tmp_path / "sink"), str(tmp_path / "aside"), str(tmp_path / "state"))
    run.awaitTermination()
    read = lambda p: spark.read.option("recursiveFileLookup", True).schema(like.schema).parquet(str(tmp_path / p))
    assert read("sink").count() + read("aside").count() == like.count()
    assert read("aside").where("event_type <> 'error'").isEmpty() and read("sink").where("value <> 0").isEmpty()


def test_messages(spark):
    m = progress.message(F.lit(3), F.lit(2), F.lit(0), F.lit(5), F.lit(" "))
    assert spark.range(1).select(progress.message(F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("broken"))).first()[0] == "broken"
    assert spark.range(1).select(m).first()[0] == "2 of 10 failed, 5 remaining"


def test_late_rows_and_open_sessions_of_a_stream(spark, tmp_path):
    """In append mode a session comes out when the watermark has passed it; a row behind the watermark is left out."""
    folder, schema = tmp_path / "in", "user_id long, ts timestamp"
    write = lambda name, *rows: spark.createDataFrame([(u, t) for u, t in rows], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(folder / name))
    spark.createDataFrame([], schema).write.parquet(str(folder / "0"))

    def run():
        like = spark.createDataFrame([], schema)
        source = spark.readStream.schema(like.schema).option("recursiveFileLookup", True).parquet(str(folder))
        s = ingest.idle_sessions(source, "user_id", "ts", "1 hour", "30 minutes")
        s.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    write("1", (1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"))
    run()
    write("2", (2, "2024-01-01 06:00:00"))
    run()
    write("3", (1, "2024-01-01 00:40:00"), (3, "2024-01-01 12:00:00"))  # the first is over five hours late
    run()
    got = sorted((r.user_id, str(r.opened)[11:16], str(r.closed)[11:16], r.n) for r in spark.read.schema("user_id long, opened timestamp, closed timestamp, n long").parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "00:00", "01:30", 2), (2, "06:00", "07:00", 1)]


def test_running_counts_of_a_stream(spark, small, tmp_path):
    like = spark.read.parquet(f"{small}/events.parquet")
    counts = ingest.running_counts(ingest.arrivals(spark, small, like, "events.parquet"), "user_id", progress.status(F.col("event_type")))
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    want = like.groupBy("user_id", progress.status(F.col("event_type")).alias("status")).count()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_status_codes(spark):
    codes = [0x0000, 0xB000, 0xB007, 0xA700, 0xFE00]
    got = spark.range(1).select(*(progress.dimse_status(F.lit(c)) for c in codes)).first()
    assert list(got) == ["completed", "warning", "warning", "failed", "failed"]


def test_progress_reaches_a_callback(spark, small, tmp_path):
    seen = []
    listener = listeners.ProgressListener(lambda name, batch, rows: seen.append((name, batch, rows)))
    spark.streams.addListener(listener)
    try:
        like = spark.read.parquet(f"{small}/events.parquet")
        stream = ingest.arrivals(spark, small, like, "events.parquet")
        stream.writeStream.format("noop").queryName("watched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
        end = time.time() + 30
        while time.time() < end and not (seen and seen[-1][2] == -1):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    mine = [x for x in seen if x[0] == "watched"]
    assert sum(rows for _, _, rows in mine if rows > 0) == like.count() and mine[-1][2] == -1
