"""Queries on the event feed, the batch forms of the streaming module among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.sources.tables import table
from veinstone.streaming import feed


def _events(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")


def rate_limit_windows(spark, sf):
    """Calls of each user in fixed windows of an hour, and whether the limit of 2 allows them."""
    w = F.window("ts", "3600 seconds")
    return _events(spark, sf).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "user_id", "n", (F.col("n") <= 2).alias("allowed"))


def rate_windows_stream(spark, sf):
    """Events of users and types in windows of an hour, through the stream (complete output)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = feed.read_feed(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = stream.groupBy(F.window("ts", "3600 seconds"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")
    return feed.run_once(counted, "complete").select("begin", "event_type", "n")


def stale_tasks(spark, sf):
    """Users whose last event is more than 12 hours before the newest of all."""
    e = _events(spark, sf)
    newest = F.broadcast(e.agg(F.max("ts").alias("now")))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.crossJoin(newest).where(F.col("last") < F.col("now") - F.expr("INTERVAL 12 HOURS")).select("user_id", "event_type")


def queue_depth(spark, sf):
    """Depth of each user's queue: a click adds, any other event takes; highest depth reached."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = _events(spark, sf).withColumn("depth", F.sum(F.when(F.col("event_type") == "click", 1).otherwise(-1)).over(order))
    return d.groupBy("user_id").agg(F.max("depth").alias("highest"))


def nearest_rank(df: DataFrame, by: str, value: str, points: dict[str, float], cells: int = 4096) -> DataFrame:
    """(by, points..., n): exact percentiles by nearest rank, of groups of any size.

    A histogram of ``cells`` equal cells a group tells in which cell each rank lies; only those cells are ordered.
    """
    v = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    ends = v.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells))).otherwise(0).cast("int")
    placed = v.join(F.broadcast(ends), by).withColumn("cell", cell)  # one row a group
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("cell"))
    histogram = placed.groupBy(by, "cell").agg(F.count("*").alias("c")).withColumn("before", upto - F.col("c")).join(ends.select(by, "n"), by)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("point"), F.floor(F.lit(p) * (F.col("n") - 1)).alias("rank")) for name, p in points.items()])).alias("x")
    asked = histogram.select(by, "cell", "c", "before", wanted).select(by, "cell", "before", "x.*", "c").where("rank >= before AND rank < before + c").drop("c")
    inside = placed.join(asked.select(by, "cell").distinct(), [by, "cell"], "left_semi").groupBy(by, "cell", "v").agg(F.count("*").alias("m"))
    ordered = inside.withColumn("upto", F.sum("m").over(Window.partitionBy(by, "cell").orderBy("v")))
    found = ordered.join(asked, [by, "cell"]).where("before + upto > rank").groupBy(by, "point").agg(F.min("v").alias("v"))
    return found.groupBy(by).pivot("point", list(points)).agg(F.first("v")).join(ends.select(by, "n"), by)


def duration_percentiles(spark, sf):
    """p50, p95 and p99 of the values of each type by nearest rank: the value at floor(p (n - 1))."""
    return nearest_rank(_events(spark, sf), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def task_page(spark, sf):
    """The 200 newest events of one type, by time and id."""
    return _events(spark, sf).where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


def event_details(spark, sf):
    """A number of the JSON details, by type; what is no number is left out."""
    e = _events(spark, sf).select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.where("k IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def sessions(spark, sf):
    """Sessions of users with a gap of 30 minutes: an extension by Spark's own window."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf).withColumn("new", (F.coalesce(F.col("ts") - F.lag("ts").over(order) > F.expr("INTERVAL 30 MINUTES"), F.lit(True))).cast("int"))
    return e.groupBy("user_id").agg(F.sum("new").alias("sessions"))


def metric_summary(spark, sf):
    """Count, sum, least and greatest of numeric columns, unpivoted."""
    l = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = l.unpivot([], list(l.columns), "column", "value")
    return long.groupBy("column").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def column_type_vote(spark, sf):
    """Type of text columns: number or date if at least 80 % of the values look like it."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    long = o.unpivot([], list(o.columns), "column", "value").where("value <> ''")
    number, date = F.avg(F.col("value").rlike("^-?[0-9,]+(\\.[0-9]+)?$").cast("int")), F.avg(F.col("value").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$").cast("int"))
    return long.groupBy("column").agg(F.when(number >= 0.8, "number").when(date >= 0.8, "date").otherwise("string").alias("kind"))


def table_search(spark, sf):
    """Parts whose name or type holds one of the terms, with how many do."""
    terms = F.array(F.lit("steel"), F.lit("brass"), F.lit("part"), F.lit("promo"))
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    hits = F.size(F.filter(terms, lambda t: F.lower(F.concat_ws(" ", "p_name", "p_type")).contains(t)))
    return p.select("p_partkey", hits.alias("hits")).where("hits > 0")


CATALOGUE = {
    "rate_limit_windows": (rate_limit_windows, "SELECT date_trunc('hour', ts) AS begin, user_id, count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY ALL"),
    "rate_windows_stream": (rate_windows_stream, "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stale_tasks": (stale_tasks, "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type FROM l WHERE n = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR"),
    "queue_depth": (queue_depth, "SELECT user_id, max(d) AS highest FROM (SELECT user_id, sum(CASE event_type WHEN 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id"),
    "duration_percentiles": (
        duration_percentiles,
        "WITH v AS (SELECT event_type, list_sort(list(value)) AS x, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, x[1 + floor(0.5 * (n - 1))::INT] AS p50, x[1 + floor(0.95 * (n - 1))::INT] AS p95, x[1 + floor(0.99 * (n - 1))::INT] AS p99, n FROM v",
    ),
    "task_page": (task_page, "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "event_details": (event_details, "SELECT event_type, count(*) AS n, sum(k) AS total FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY event_type"),
    "sessions": (sessions, "SELECT user_id, sum(new) AS sessions FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true)::INT AS new FROM events) GROUP BY user_id"),
    "metric_summary": (metric_summary, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(sum({c}), 2) AS total, min({c}) AS least, max({c}) AS most FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),
    "column_type_vote": (
        column_type_vote,
        "WITH v AS (SELECT 'o_orderkey' AS c, o_orderkey::VARCHAR AS x FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) SELECT c AS \"column\", CASE WHEN avg(regexp_matches(x, '^-?[0-9,]+(\\.[0-9]+)?$')::INT) >= 0.8 THEN 'number' WHEN avg(regexp_matches(x, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')::INT) >= 0.8 THEN 'date' ELSE 'string' END AS kind FROM v WHERE x <> '' GROUP BY c",
    ),
    "table_search": (table_search, "SELECT * FROM (SELECT p_partkey, " + " + ".join(f"(lower(p_name || ' ' || p_type) LIKE '%{t}%')::INT" for t in ("steel", "brass", "part", "promo")) + " AS hits FROM part) WHERE hits > 0"),
}
