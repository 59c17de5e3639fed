"""The typed graph as tables: events, edges, sessions, topics.

An ordered pair of nodes has one edge: the last write wins, at the place of the first. Edges with an
unknown end are dropped. Star edges (event - session - topic) run both ways with labels of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The types of events and edges.
EVENT_TYPES = ["action", "state_change", "preference", "plan"]
EDGE_TYPES = ["causes", "enables", "prevents", "temporal_before", "updates", "contradicts", "belongs_to", "contains", "belongs_to_topic", "topic_contains"]


def upsert_edges(writes: DataFrame, scope: str = "conv", seq: str = "edge_seq") -> DataFrame:
    """One edge per (src, dst): the attributes of the last write, the place (adj_pos) of the first."""
    names = [c for c in writes.columns if c not in (scope, "src", "dst", seq)]
    last = F.max_by(F.struct(*names), seq).alias("x")
    return writes.groupBy(scope, "src", "dst").agg(F.min(seq).alias("adj_pos"), last).select(scope, "src", "dst", "adj_pos", "x.*")


def insert_if_absent(there: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """there, and the rows of new whose key is not there (of several, the first by seq if there is one)."""
    if "seq" in new.columns:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("seq"))).where("_n = 1").drop("_n")
    return there.unionByName(new.join(there.select(*key), key, "left_anti"), allowMissingColumns=True)


def known_ends(edges: DataFrame, nodes: DataFrame, scope: str = "conv", node: str = "node") -> DataFrame:
    """Edges both of whose ends are nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(scope, F.col(node).alias(end)), [scope, end], "left_semi")
    return edges


def star(members: DataFrame, child: str, parent: str, up: str, down: str, scope: str = "conv") -> DataFrame:
    """Both edges of each (child, parent) row, confidence 1."""
    both = F.array(F.struct(F.col(child).alias("src"), F.col(parent).alias("dst"), F.lit(up).alias("edge_type")), F.struct(F.col(parent).alias("src"), F.col(child).alias("dst"), F.lit(down).alias("edge_type")))
    return members.select(scope, F.explode(both).alias("e")).select(scope, "e.*", F.lit(1.0).alias("confidence"))


def chain(sessions: DataFrame, scope: str = "conv", node: str = "session_id", order: str = "session_num") -> DataFrame:
    """temporal_before edges between each session and the one before it."""
    prev = F.lag(node).over(W.partitionBy(scope).orderBy(order))
    return sessions.select(scope, prev.alias("src"), F.col(node).alias("dst"), F.lit("temporal_before").alias("edge_type")).where("src IS NOT NULL")


def remove_event(events: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Events and edges without the events of `gone` and what is incident to them."""
    ids = gone.select(F.col(key).alias("_g"))
    kept = edges.join(ids, F.col("src") == F.col("_g"), "left_anti").join(ids, F.col("dst") == F.col("_g"), "left_anti")
    return events.join(ids, F.col(key) == F.col("_g"), "left_anti"), kept


def induced(events: DataFrame, edges: DataFrame, allowed: DataFrame, note: str = "source_note_ids") -> tuple[DataFrame, DataFrame]:
    """The subgraph of the events that have an allowed note (allowed: note_id)."""
    hit = events.select("event_id", F.explode(note).alias("note_id")).join(allowed.select("note_id"), "note_id", "left_semi").select("event_id").distinct()
    kept = events.join(hit, "event_id", "left_semi")
    return kept, known_ends(edges, kept.select("conv", F.col("event_id").alias("node")))


def _trimmed(rows: DataFrame, key: str, members: str, kept: DataFrame, scope: str = "conv") -> DataFrame:
    """key and its list of members cut to those of `kept` (scope, member), in order; keys with none are left out."""
    long = rows.select(scope, key, F.posexplode(members).alias("pos", "member")).join(kept, [scope, "member"], "left_semi")
    lists = long.groupBy(scope, key).agg(F.array_sort(F.collect_list(F.struct("pos", "member"))).alias("x"))
    return lists.select(scope, key, F.transform("x", lambda x: x["member"]).alias(members))


def induced_hierarchy(sessions: DataFrame, topics: DataFrame, kept_events: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with an allowed note and a kept event, and topics with such a session, their lists cut to what is kept.

    sessions: conv, session_id, note_ids, event_ids, ...; topics: conv, topic_id, session_ids, ...; kept_events: of induced(); allowed: note_id.
    """
    named = sessions.select("conv", F.explode("note_ids").alias("member")).join(allowed.select(F.col("note_id").alias("member")), "member", "left_semi").distinct()
    notes = _trimmed(sessions, "session_id", "note_ids", named)
    events = _trimmed(sessions, "session_id", "event_ids", kept_events.select("conv", F.col("event_id").alias("member")))
    new = sessions.drop("note_ids", "event_ids").join(notes, ["conv", "session_id"]).join(events, ["conv", "session_id"])
    lists = _trimmed(topics, "topic_id", "session_ids", new.select("conv", F.col("session_id").alias("member")))
    return new, topics.drop("session_ids").join(lists, ["conv", "topic_id"])


def events_of_notes(events: DataFrame, note: str = "source_note_ids", scope: str = "conv") -> DataFrame:
    """scope, note_id, event_id: each note's events (in the order of event_seq, where it matters to the reader)."""
    return events.select(scope, F.explode(note).alias("note_id"), "event_id", "event_seq")


def with_kind(events: DataFrame, sessions: DataFrame, topics: DataFrame, scope: str = "conv") -> DataFrame:
    """scope, node, kind of all nodes."""
    one = lambda df, c, kind: df.select(scope, F.col(c).cast("string").alias("node"), F.lit(kind).alias("kind"))
    return one(events, "event_id", "event").unionByName(one(sessions, "session_id", "session")).unionByName(one(topics, "topic_id", "topic"))


def summary(events: DataFrame, edges: DataFrame, scope: str = "conv") -> DataFrame:
    """scope, n_events, n_edges, n_invalidated: a graph's size."""
    n = events.groupBy(scope).agg(F.count(F.lit(1)).alias("n_events"))
    m = edges.groupBy(scope).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("t_invalid_at").isNotNull()).alias("n_invalidated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(m, scope, "full").select(scope, zero("n_events"), zero("n_edges"), zero("n_invalidated"))


def stats(edges: DataFrame, scope: str = "conv") -> DataFrame:
    return edges.groupBy(scope, F.coalesce("edge_type", F.lit("unknown")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))
