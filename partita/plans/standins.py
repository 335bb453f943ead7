"""Records of the domain made from the star-schema tables, once for Spark and once for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.sequences import next_start
from partita.session import table


def _micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000 + hour({ts}) * 3600000000 + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, us, label): a label sequence per user, ordered by (us, event_id); us in whole microseconds."""
    return table(spark, d, "events").select("user_id", "event_id", _micros("ts").alias("us"), F.col("event_type").alias("label"), "value")


def intervals(df: DataFrame) -> DataFrame:
    """(user_id, event_id, s, e, label): from an event to the user's next; the last has no end and is dropped."""
    return next_start(df, "user_id", ["us", "event_id"], "us").where("e is not null").select("user_id", "event_id", F.col("us").alias("s"), "e", "label")


def ref_est(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference and estimated annotations: intervals of the even and of the odd events."""
    e = events(spark, d)
    return intervals(e.where("event_id % 2 = 0")), intervals(e.where("event_id % 2 = 1"))


def chord_steps(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, idx): chord classes 0-156 in the order of an order's lines; equal line numbers go by part."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("cast((l_partkey * 7 + l_linenumber) % 157 as int)").alias("idx"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(track, frame, vec_id, x array<double>): vectors in blocks of fifty."""
    return table(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("track"), F.expr("cast(vec_id % 50 as int)").alias("frame"), "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS label, value FROM events)"
IV = EV + ", iv AS (SELECT user_id, event_id, us AS s, e, label FROM (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e FROM ev) WHERE e IS NOT NULL)"


def _half(name: str, rest: int) -> str:
    return f"{name} AS (SELECT user_id, event_id, us AS s, e, label FROM (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e FROM ev WHERE event_id % 2 = {rest}) WHERE e IS NOT NULL)"


RE = EV + ", " + _half("ref", 0) + ", " + _half("est", 1)
RUNS = EV + ", num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, label ORDER BY us, event_id) AS g FROM ev)"
STEPS = "st AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_partkey * 7 + l_linenumber) % 157 AS INT) AS idx FROM lineitem)"
FRAMES = "fr AS (SELECT vec_id // 50 AS track, CAST(vec_id % 50 AS INT) AS frame, vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
