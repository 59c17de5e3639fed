"""Conversation-graph views over the test tables, as DataFrames and as the same SQL.

Everything is keyed by `conv`, the unit that the engine partitions by: windows and joins never leave a
conversation, so the plans scale with the number of conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.shared import ship


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """conv, note_id, note_pos (dense, per conversation), role, speaker, text, content."""
    from evograph.functions.text import normalize_role, render_note

    rows = table(spark, sf, "conversations")
    speaker = normalize_role(F.col("role"))
    return rows.select(
        F.col("conv_id").alias("conv"), F.concat_ws("_", F.lit("n"), "conv_id", "turn").alias("note_id"),
        (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("note_pos"),
        "turn", "role", speaker.alias("speaker"), "text", render_note(speaker, F.col("text")).alias("content"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """conv, event_id, event_seq, kind, u, k, participants, event_date, value."""
    rows = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        F.expr("user_id div 15").alias("conv"), "event_id", F.col("event_id").alias("event_seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("u"), k.alias("k"),
        F.array_sort(F.array(F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("k"), k))).alias("participants"), F.to_date("ts").alias("event_date"), "value",
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """conv, session_num (by date), session_id, event_date, n_events, topic_num (chunks of five sessions)."""
    per_day = events(spark, sf).groupBy("conv", "event_date").agg(F.count(F.lit(1)).alias("n_events"))
    num = F.row_number().over(W.partitionBy("conv").orderBy("event_date")).cast("long")
    return per_day.withColumn("session_num", num).select("conv", "session_num", F.concat(F.lit("session_"), "conv", F.lit("_"), "session_num").alias("session_id"), "event_date", "n_events", F.expr("(session_num - 1) div 5").alias("topic_num"))


def events_in_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their session_num and topic_num. A conversation's dates are ranked, a row a session, not its events."""
    rows = events(spark, sf)
    days = rows.select("conv", "event_date").distinct().withColumn("session_num", F.row_number().over(W.partitionBy("conv").orderBy("event_date")).cast("long"))
    return rows.join(days, ["conv", "event_date"]).withColumn("topic_num", F.expr("(session_num - 1) div 5"))


def supersessions(spark: SparkSession, sf: str) -> DataFrame:
    """conv, src, dst, edge_type: each event and the latest earlier event of the same participants.

    The latest earlier one is a lag in the window of (conv, user, k): an as-of join without a join.
    """
    w = W.partitionBy("conv", "u", "k").orderBy("event_seq")
    prev = lambda c: F.lag(c).over(w)
    rows = events(spark, sf).select("conv", F.col("event_id").alias("src"), prev("event_id").alias("dst"), "kind", prev("kind").alias("prev_kind"), "value", prev("value").alias("prev_value"), "event_date")
    kind = F.when(F.col("kind") == F.col("prev_kind"), "updates").when(F.abs(F.col("value") - F.col("prev_value")) > 50, "contradicts")
    return rows.where("dst IS NOT NULL").select("conv", "src", "dst", kind.alias("edge_type"), ((F.col("src") + F.col("dst")) % 100 / 200.0 + 0.5).alias("confidence"), "event_date").where("edge_type IS NOT NULL")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, v (array of double), norm (0 counts as 1)."""
    from evograph.functions.vector import norm

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", "label", v.alias("v"), norm(v).alias("norm"))


#: The same views in SQL; each query's SQL starts with those it names.
SQL = {
    "notes": "SELECT conv_id AS conv, 'n_' || conv_id || '_' || turn AS note_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS note_pos, turn, role, text, CASE WHEN lower(trim(role)) = 'assistant' THEN 'Assistant' WHEN lower(trim(role)) = 'user' THEN 'User' WHEN trim(role) = '' THEN 'Unknown' ELSE upper(left(trim(role), 1)) || lower(substr(trim(role), 2)) END AS speaker FROM conversations",
    "ev": "SELECT user_id // 15 AS conv, event_id, event_id AS event_seq, event_type AS kind, user_id AS u, json_extract_string(props, '$.k')::BIGINT AS k, ts::DATE AS event_date, value FROM events",
    "evs": "SELECT *, dense_rank() OVER (PARTITION BY conv ORDER BY event_date) AS session_num, (dense_rank() OVER (PARTITION BY conv ORDER BY event_date) - 1) // 5 AS topic_num FROM ev",
    "sess": "SELECT conv, session_num, 'session_' || conv || '_' || session_num AS session_id, event_date, n_events, (session_num - 1) // 5 AS topic_num FROM (SELECT conv, event_date, count(*) AS n_events, row_number() OVER (PARTITION BY conv ORDER BY event_date) AS session_num FROM ev GROUP BY conv, event_date)",
    "sup": "SELECT conv, src, dst, edge_type, 0.5 + ((src + dst) % 100) / 200.0 AS confidence, event_date FROM (SELECT conv, event_id AS src, lag(event_id) OVER w AS dst, event_date, CASE WHEN kind = lag(kind) OVER w THEN 'updates' WHEN abs(value - lag(value) OVER w) > 50 THEN 'contradicts' END AS edge_type FROM ev WINDOW w AS (PARTITION BY conv, u, k ORDER BY event_seq)) WHERE dst IS NOT NULL AND edge_type IS NOT NULL",
    "vec": "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings",
}
_NEEDS = {"evs": ["ev"], "sess": ["ev"], "sup": ["ev"]}


def with_views(names: str, sql: str, more: str = "") -> str:
    """`WITH <views> <sql>`; more: further CTEs of the query."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    ctes = ", ".join([f"{n} AS ({SQL[n]})" for n in order] + ([more] if more else []))
    return f"WITH {ctes} {sql}" if ctes else sql
