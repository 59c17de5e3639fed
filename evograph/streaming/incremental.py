"""Structured Streaming: append-only ingest per conversation, and time-windowed counts.

State is kept per conversation and is bounded by its different participant sets: of each, the first k events
(no others are ever screened), which of them are superseded, and how many there are. A session that comes
after a later one of its conversation is late; it is not folded in but reported, so history isn't rewritten.

An event is screened against the first k earlier events with its participants, of earlier sessions; the cap comes
first, and what is superseded by then drops out of both numbers, pool (all earlier ones) and screened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv bigint, src bigint, dst bigint, edge_type string, pool int, screened int, late boolean"
STATE = "seen string"


def rule_verdict(kind: str, value: float, old_kind: str, old_value: float) -> str | None:
    """The deterministic stand-in for a model: the same kind updates, another kind with a far value contradicts."""
    if kind == old_kind:
        return "updates"
    return "contradicts" if abs(value - old_value) > 50 else None


def fold_session(seen: dict, rows: list[dict], k: int) -> list[tuple]:
    """Folds one arriving session into a conversation's state; the edges it makes, and a report row (dst null)."""
    out = []
    num = rows[0]["session_num"]
    if num <= seen["last"]:
        return [(r["conv"], r["event_id"], None, None, 0, 0, True) for r in rows]
    fresh = []
    for r in sorted(rows, key=lambda x: x["event_id"]):
        key = f"{r['u']}/{r['k']}"
        own = seen["events"].get(key, {"n": 0, "first": []})  # of earlier sessions alone
        valid = [e for e in own["first"] if not e[3]]
        pool = own["n"] - (len(own["first"]) - len(valid))
        made = 0
        for e in valid:
            kind = rule_verdict(r["kind"], r["value"], e[1], e[2])
            if kind:
                out.append((r["conv"], r["event_id"], e[0], kind, pool, len(valid), False))
                made += 1
            if kind == "updates":
                e[3] = 1
        if not made:
            out.append((r["conv"], r["event_id"], None, None, pool, len(valid), False))
        fresh.append((key, [r["event_id"], r["kind"], r["value"], 0]))
    for key, e in fresh:
        own = seen["events"].setdefault(key, {"n": 0, "first": []})
        own["n"] += 1
        if len(own["first"]) < k:
            own["first"].append(e)
    seen["last"] = num
    return out


def ingest(events: DataFrame, k: int = 10, mode: str = "append") -> DataFrame:
    """events: conv, event_id, session_num, u, k, kind, value; a stream or a table. Gives OUT rows."""
    names = [c.split()[0] for c in OUT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = json.loads(state.get[0]) if state.exists else {"last": 0, "events": {}}
        rows = pd.concat(list(batches))
        for _, session in rows.sort_values(["session_num", "event_id"]).groupby("session_num", sort=True):
            out = fold_session(seen, session.to_dict("records"), k)
            frame = pd.DataFrame(out, columns=names)
            frame["dst"] = frame["dst"].astype("Int64")
            yield frame
        state.update((json.dumps(seen),))

    return events.groupBy("conv").applyInPandasWithState(step, OUT, STATE, mode, GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, k: int = 10) -> DataFrame:
    """The same result over a table, without folding: windows and a join of each event with at most k earlier ones.

    An event is superseded by the first later one (of a later session) with its participants and its kind, if it is among
    the first k; so what is valid when an event arrives follows from that one's place, and no conversation is a task.
    """
    key = ["conv", "u", "k"]
    at = F.struct("session_num", "event_id").alias("at")
    by = W.partitionBy(*key).orderBy("session_num", "event_id")
    rows = events.select(*key, "event_id", "session_num", "kind", "value", at).withColumn("n", F.row_number().over(by)).withColumn("own", F.row_number().over(W.partitionBy(*key, "session_num").orderBy("event_id")))
    rows = rows.withColumn("earlier", F.col("n") - F.col("own"))
    first = rows.where(F.col("n") <= k).select(*key, F.col("event_id").alias("old"), F.col("session_num").alias("old_session"), F.col("kind").alias("old_kind"), F.col("value").alias("old_value"))
    pairs = rows.join(first, key, "left").where(F.col("old").isNull() | (F.col("old_session") < F.col("session_num")) | (F.col("n") == F.col("own")))
    pairs = pairs.withColumn("met", F.col("old").isNotNull() & (F.col("old_session") < F.col("session_num")))
    same = F.col("met") & (F.col("kind") == F.col("old_kind"))
    pairs = pairs.withColumn("ends", F.min(F.when(same, F.col("at"))).over(W.partitionBy("conv", "old")))  # when the old event is superseded
    gone = F.col("met") & F.col("ends").isNotNull() & (F.col("ends") < F.col("at"))
    far = F.abs(F.col("value") - F.col("old_value")) > 50
    verdict = F.when(~F.col("met") | gone, F.lit(None)).when(same, "updates").when(far, "contradicts")
    per = pairs.withColumn("edge_type", verdict).groupBy("conv", "event_id").agg(
        F.max("earlier").alias("earlier"), F.count_if("met").alias("screened"), F.count_if(gone).alias("gone"), F.collect_list(F.when(F.col("edge_type").isNotNull(), F.struct("old", "edge_type"))).alias("made"),
    )
    out = per.select("conv", F.col("event_id").alias("src"), F.explode_outer("made").alias("x"), (F.col("earlier") - F.col("gone")).cast("int").alias("pool"), (F.col("screened") - F.col("gone")).cast("int").alias("screened"))
    return out.select("conv", "src", F.col("x.old").alias("dst"), F.col("x.edge_type").alias("edge_type"), "pool", "screened", F.lit(False).alias("late"))


def support_links(events: DataFrame, k: int = 5) -> DataFrame:
    """conv, src, dst: support candidates as events arrive: of each event the first k earlier ones of other sessions with its participants,
    capped first; then those of its topic stay (an event without a topic isn't restricted). events as for replay(), and topic."""
    key = ["conv", "u", "k"]
    rows = events.select(*key, "event_id", "session_num", "topic").withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("session_num", "event_id")))
    first = rows.where(F.col("n") <= k).select(*key, F.col("event_id").alias("src"), F.col("session_num").alias("s"), F.col("topic").alias("t"))
    met = rows.join(first, key).where((F.col("s") < F.col("session_num")) & (F.col("topic").isNull() | (F.col("topic") == F.col("t"))))
    return met.select("conv", "src", F.col("event_id").alias("dst"))


def ingest_sessions(sessions: DataFrame, mode: str = "append") -> DataFrame:
    """A stream of sessions (conv, seq, v): the topic of each as it arrives, and the session before it. State: the conversation's topics."""
    from evograph.operators.hierarchy import ASSIGNED, TopicMaps, Topics

    schema = f"conv bigint, seq bigint, previous bigint, {ASSIGNED}"
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"topics": None, "last": None}
        topics, last, out = Topics(TopicMaps(held["topics"])), held["last"], []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if last is not None and r.seq <= last:  # late: history isn't rewritten
                continue
            out.append({"conv": key[0], "seq": int(r.seq), "previous": last} | topics.assign(r.v))
            last = int(r.seq)
        state.update((json.dumps({"topics": topics.state(), "last": last}),))
        frame = pd.DataFrame(out, columns=names)
        frame["previous"] = frame["previous"].astype("Int64")
        yield frame

    return sessions.groupBy("conv").applyInPandasWithState(step, schema, STATE, mode, GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; on a stream, rows later than `late` are dropped by the watermark."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after `gap` without an event."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
