"""Benchmark analytics and transfer accounting: A/B comparison, gates, medians, trends, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.operators import comparison as C
from halyard.operators.ranking import ranked
from halyard.operators import hanging
from halyard.registry import query
from halyard.shared import shared_folder
from halyard.streaming import connections, ingest
from halyard.streaming import progress as P

from .common import table

_SIDE = "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS v, max(l_quantity) AS q, max(l_returnflag) AS digest FROM lineitem WHERE l_linenumber % 2 = {k} GROUP BY ALL"


def _side(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == k)
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("v"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("digest"))


@query(
    "ab_diff_full_outer",
    f"""WITH a AS ({_SIDE.format(k=0)}), b AS ({_SIDE.format(k=1)})
        SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN b.l_partkey IS NULL THEN 'base' WHEN a.l_partkey IS NULL THEN 'candidate' ELSE 'both' END AS side,
          round((b.v - a.v) / a.v * 100, 6) AS change FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""",
)
def ab_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.compare(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1), ["l_partkey", "l_suppkey"])
    return d.select("l_partkey", "l_suppkey", "side", F.round(C.percent_change(F.col("base_v"), F.col("candidate_v")), 6).alias("change"))


@query(
    "ab_gates",
    f"""WITH a AS ({_SIDE.format(k=0)}), b AS ({_SIDE.format(k=1)})
        SELECT l_suppkey, bool_or(a.digest <> b.digest) AS digest_changed, bool_or(b.q < a.q) AS quality_dropped, bool_or((b.v - a.v) / a.v * 100 < -8) AS slower
        FROM a JOIN b USING (l_partkey, l_suppkey) GROUP BY 1""",
)
def ab_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.compare(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1), ["l_partkey", "l_suppkey"]).where("side = 'both'")
    gates = C.gates(digest=("base_digest", "candidate_digest"), quality=("base_q", "candidate_q"), speed=("base_v", "candidate_v"), slower_by=8.0)
    return d.groupBy("l_suppkey").agg(*(F.bool_or(c).alias(n) for n, c in gates.items()))


@query("median_upper", "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median: the n/2-th of the sorted values from 0."""
    return C.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "median")


@query("median_true", "SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def median_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"))


@query("p95_nearest", "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def p95_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by nearest rank."""
    return C.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.95, "p95")


@query("throughput", "SELECT l_suppkey, round(sum(l_quantity) / (list_sort(list(l_extendedprice))[count(*) // 2 + 1] / 1000), 6) AS rate FROM lineitem GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total work over the upper median of the times."""
    got = C.throughput(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", "rate")
    return got.select("l_suppkey", F.round("rate", 6).alias("rate"))


@query(
    "trend_prev",
    """WITH m AS (SELECT c_nationkey AS platform, date_trunc('month', o_orderdate) AS run, median(o_totalprice) AS v, min(c_mktsegment) AS cpu FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
       SELECT platform, CAST(run AS DATE) AS run, round((v - lag(v) OVER w) / lag(v) OVER w * 100, 6) AS change, cpu = lag(cpu) OVER w AS comparable FROM m WINDOW w AS (PARTITION BY platform ORDER BY run)""",
)
def trend_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the platform's run before; comparable if the hardware is the same."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_nationkey").alias("platform"), F.date_trunc("month", "o_orderdate").cast("date").alias("run")).agg(F.median("o_totalprice").alias("v"), F.min("c_mktsegment").alias("cpu"))
    w = Window.partitionBy("platform").orderBy("run")
    return m.select("platform", "run", F.round(C.percent_change(F.lag("v").over(w), F.col("v")), 6).alias("change"), (F.col("cpu") == F.lag("cpu").over(w)).alias("comparable"))


@query("report_sort", "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END ASC NULLS LAST, s_name) AS position FROM supplier")
def report_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's rows by change, unknown ones last."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("change"), "s_name")
    return ranked(rows, [F.col("change").asc_nulls_last(), F.col("s_name")], "position").select("s_suppkey", "position")


@query("report_sort_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS position FROM orders")
def report_sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same order over a table that grows with the archive."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("change"))
    return ranked(rows, [F.col("change").desc_nulls_last(), F.col("o_orderkey")], "position").select("o_orderkey", "position")


@query("prior_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-20' - INTERVAL 2 DAY")
def prior_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors between two relative times before a given now."""
    return C.relative_window(table(spark, sf_dir, "events"), "ts", "2024-01-20 00:00:00", 10, 2, "DAY").select("event_id")


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'warning' ELSE 'completed' END"


@query(
    "progress_counts",
    f"""SELECT user_id, count(*) FILTER ({_STATUS} = 'completed') AS completed, count(*) FILTER ({_STATUS} = 'failed') AS failed, count(*) FILTER ({_STATUS} = 'warning') AS warning,
        greatest(100 - count(*), 1) - 1 AS remaining, round(sum(CASE WHEN {_STATUS} = 'completed' THEN value END), 4) AS bytes FROM events GROUP BY 1""",
)
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", P.status(F.col("event_type")))
    got = e.groupBy("user_id").agg(*P.counters("status", total=100), F.round(F.sum(F.when(F.col("status") == "completed", F.col("value"))), 4).alias("bytes"))
    return got.select("user_id", "completed", "failed", "warning", "remaining", "bytes")


@query("in_flight", "SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS open FROM events GROUP BY 1 HAVING sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) <> 0")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open transfers: starts less ends, gone at zero."""
    return P.in_flight(table(spark, sf_dir, "events"), "user_id", F.col("event_id") % 2 == 0)


@query(
    "idle_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, k""",
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection closes when nothing has come for a while."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


@query(
    "idle_close",
    """WITH e AS (SELECT user_id, date_trunc('milliseconds', ts) AS s, date_trunc('milliseconds', ts) + (event_id % 5) * INTERVAL 40 MINUTE AS e FROM events),
       g AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e),
       k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g),
       c AS (SELECT user_id, k, min(s) AS opened, max(e) + INTERVAL 6 HOUR AS closed, count(*) AS transfers, max(k) OVER (PARTITION BY user_id) AS last FROM k GROUP BY user_id, k)
       SELECT CAST(user_id AS VARCHAR) AS connection, opened, closed, transfers FROM c WHERE k < last OR closed < (SELECT max(e) - INTERVAL 1 SECOND FROM e)""",
)
def idle_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of a stream that closed when no transfer was open for six hours: timers and counts in flight as its state."""
    like = table(spark, sf_dir, "events")
    start = F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))
    end = F.timestamp_millis(F.unix_millis(start) + F.col("event_id") % 5 * 2_400_000)
    rows = ingest.arrivals(spark, sf_dir, like, "events.parquet").select(F.col("user_id").cast("string").alias("connection"), F.col("event_id").cast("string").alias("instance"), F.explode(F.array(F.struct(F.lit("start").alias("kind"), start.alias("at")), F.struct(F.lit("end").alias("kind"), end.alias("at")))).alias("x"))
    closing = connections.idle_close(rows.select("connection", "x.kind", "instance", "x.at"), 6 * 3_600_000, "1 second")
    place = shared_folder(spark, "idle-close")
    with connections.state_in_rocksdb(spark):
        closing.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/closed").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(connections.CLOSED).parquet(f"{place}/closed")
    return got.select("connection", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("closed").cast("timestamp_ntz").alias("closed"), "transfers")


@query(
    "status_throttle",
    f"""WITH s AS (SELECT event_id, user_id, ts, {_STATUS} AS status FROM events), c AS (SELECT *, coalesce(status <> lag(status) OVER w, true) AS changed FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        k AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM c) SELECT event_id, user_id, status FROM k WHERE changed AND n <= 3""",
)
def status_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log entry on a change of status only, three at most."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", P.status(F.col("event_type")).alias("status"))
    return P.throttled(e, "user_id", ["ts", "event_id"], "status", 3).select("event_id", "user_id", "status")


@query(
    "last_failed",
    f"""WITH f AS (SELECT event_id, user_id, ts, sum(CASE WHEN {_STATUS} = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failed FROM events)
        SELECT event_id, coalesce(failed > lag(failed) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS last_failed FROM f""",
)
def last_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the failed counter has grown since the update before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", P.status(F.col("event_type")).alias("status"))
    return P.last_failed(e, "user_id", ["ts", "event_id"]).select("event_id", "last_failed")


@query(
    "prior_numbers",
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS prior FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01') SELECT o_orderkey, o_custkey FROM r WHERE prior BETWEEN 1 AND 2""",
)
def prior_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two studies before the current one of each patient."""
    item = {"abstract_prior": (1, 2)}
    return hanging.time_based_set(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "1997-06-01 00:00:00", item, ["o_orderkey"]).select("o_orderkey", "o_custkey")
