"""Sessions and topics for graphs that were built without them, from notes, summaries and a model's groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.text import session_number
from evograph.operators import graph


def align_sessions(times: DataFrame, summaries: DataFrame, scope: str = "conv", order: str = "timestamp") -> DataFrame:
    """scope, place, the columns of both: the i-th time of a scope meets its i-th summary, up to the shorter of the two.

    times: scope, timestamp, ...; summaries: scope, summary_key, ... Times go by `order` (as texts, which need not be the order in time; a column with
    readable dates makes it that), summaries by the number in their key.
    """
    left = times.withColumn("place", F.row_number().over(W.partitionBy(scope).orderBy(order)))
    right = summaries.withColumn("place", F.row_number().over(W.partitionBy(scope).orderBy(session_number(F.col("summary_key")), "summary_key")))
    return left.join(right, [scope, "place"])


def inject_sessions(notes: DataFrame, note_events: DataFrame, summaries: DataFrame, there: DataFrame | None = None, dates: DataFrame | None = None, scope: str = "conv", order: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(sessions, edges of their chain) of the scopes that have none (there: sessions so far).

    notes: scope, note_id, note_pos, timestamp; note_events: scope, note_id, event_id, event_seq; summaries: scope, summary_key, summary; dates: scope,
    session_num, date_time. Notes of one time are a session; its events are those of its notes, each once, at its first place.
    A session without events is left out, and the chain goes on from the one before it.
    """
    if there is not None:
        notes = notes.join(there.select(scope).distinct(), scope, "left_anti")
    said = notes.where(F.coalesce("timestamp", F.lit("")) != "")
    extra = [F.first(order).alias(order)] if order != "timestamp" else []
    times = said.groupBy(scope, "timestamp").agg(F.array_sort(F.collect_list(F.struct("note_pos", "note_id"))).alias("_n"), *extra)  # a session's notes
    met = align_sessions(times, summaries, scope, order)
    first = said.join(note_events, [scope, "note_id"]).groupBy(scope, "timestamp", "event_id").agg(F.min(F.struct("note_pos", "event_seq")).alias("at"))
    events = first.groupBy(scope, "timestamp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    rows = met.join(events, [scope, "timestamp"]).withColumn("session_num", session_number(F.col("summary_key")))
    rows = rows.join(dates.select(scope, "session_num", "date_time"), [scope, "session_num"], "left") if dates is not None else rows.withColumn("date_time", F.lit(None).cast("string"))
    sessions = rows.select(
        scope, F.concat_ws("_", F.lit("sess"), scope, "session_num").alias("session_id"), F.col("summary_key").alias("session_key"), "session_num", "summary", F.coalesce("date_time", "timestamp").alias("date_time"),
        "event_ids", F.transform("_n", lambda x: x["note_id"]).alias("note_ids"), "place",
    )
    return sessions.drop("place"), graph.chain(sessions, scope, order="place").withColumn("confidence", F.lit(1.0))


def inject_topics(sessions: DataFrame, groups: DataFrame, there: DataFrame | None = None, scope: str = "conv") -> DataFrame:
    """topics (scope, topic_id, label, session_ids, description) of the scopes that have none (there: topics so far) but have sessions.

    groups: scope, and place, label, session_ids, description of each group (functions.parsers.clusters); sessions that aren't known drop out of a group.
    """
    rows = groups if there is None else groups.join(there.select(scope).distinct(), scope, "left_anti")
    known = sessions.select(scope, F.col("session_id").alias("member"))
    named = rows.withColumn("topic_id", F.concat_ws("_", F.lit("topic"), scope, "place"))
    lists = graph._trimmed(named, "topic_id", "session_ids", known, scope)
    return named.drop("session_ids", "place").join(lists, [scope, "topic_id"]).select(scope, "topic_id", "label", "session_ids", "description")


def set_graph(built: dict[str, DataFrame], notes: DataFrame, note_events: DataFrame, summaries: DataFrame, groups: DataFrame | None = None, hierarchy: bool = True, scope: str = "conv") -> dict[str, DataFrame]:
    """built (events, edges, and sessions, chain and topics if there are any) with sessions and topics for the scopes that lack them; as it is with hierarchy off."""
    if not hierarchy:
        return built
    out, had = dict(built), built.get("sessions")
    new, chain = inject_sessions(notes, note_events, summaries, had, scope=scope)
    both = lambda old, more: more if old is None else old.unionByName(more, allowMissingColumns=True)
    out["sessions"], out["chain"] = both(had, new), both(built.get("chain"), chain)
    if groups is not None:
        out["topics"] = both(built.get("topics"), inject_topics(out["sessions"], groups, built.get("topics"), scope))
    return out
