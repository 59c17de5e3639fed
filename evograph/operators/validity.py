"""Supersession: what an update does to its target, the target's edges and its direct consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evograph.shared import merge_join


def propagate_updates(events: DataFrame, edges: DataFrame, updates: DataFrame, scope: str = "conv") -> tuple[DataFrame, DataFrame]:
    """One hop, in one pass over a batch of updates (scope, src, dst, anchor; of several on a target the first by src wins).

    A target gets valid_until (the updater's anchor) and update_val 0; its causes/prevents edges become
    invalid from there on; what it directly causes or enables is half valid. An updater without an anchor ends its target, at no date.
    """
    hit = updates.groupBy(scope, F.col("dst").alias("event_id")).agg(F.min_by("anchor", "src").alias("anchor"), F.lit(True).alias("_hit"))
    soft = edges.where(F.col("edge_type").isin("causes", "enables")).join(hit.select(scope, F.col("event_id").alias("src")), [scope, "src"], "left_semi").select(scope, F.col("dst").alias("event_id")).distinct().withColumn("soft", F.lit(True))
    new = events.join(hit, [scope, "event_id"], "left").join(soft, [scope, "event_id"], "left")
    val = F.when(F.col("_hit"), 0.0).when(F.col("soft") & (F.col("update_val") > 0.5), 0.5).otherwise(F.col("update_val"))
    new = new.select(*[c for c in events.columns if c not in ("valid_until", "update_val")], F.coalesce("anchor", "valid_until").alias("valid_until"), val.alias("update_val"))
    a, b = hit.select(scope, F.col("event_id").alias("src"), F.col("anchor").alias("_a")), hit.select(scope, F.col("event_id").alias("dst"), F.col("anchor").alias("_b"))
    touched = edges.join(a, [scope, "src"], "left").join(b, [scope, "dst"], "left")
    since = F.when(F.col("edge_type").isin("causes", "prevents"), F.coalesce("t_invalid_at", "_a", "_b")).otherwise(F.col("t_invalid_at"))
    return new, touched.withColumn("t_invalid_at", since).select(*edges.columns)


def settle(pairs: DataFrame, scope: str = "conv") -> DataFrame:
    """pairs (scope, src, dst, at (what src is ordered by), verdict (null: none), ...) whose older event is still valid when the new one comes.

    Candidates are capped before validity is looked at, so who is held against whom doesn't depend on verdicts. The first
    event in order that updates another one ends it, whatever else would have: what comes after that is left out. So any
    recorded verdicts are replayed by one aggregate and a join, with no fold over a conversation and no rounds.
    """
    ends = pairs.where("verdict = 'updates'").groupBy(scope, "dst").agg(F.min("at").alias("_end"))
    return merge_join(pairs, ends, [scope, "dst"], "left").where(F.col("_end").isNull() | (F.col("at") <= F.col("_end"))).drop("_end")


def replay(arrivals: DataFrame, recorded: DataFrame, k: int = 10, min_jaccard: float = 0.5, scope: str = "conv") -> DataFrame:
    """scope, src, dst, edge_type, anchor: each arriving event against the k most similar events of earlier sessions, by recorded verdicts.

    arrivals: scope, event_id, event_seq, participants, session_num, anchor; recorded: scope, src, dst, edge_type (updates, contradicts, or any
    other for neither), for any pairs. A verdict on a pair that isn't screened, or whose older event is no longer valid, has no effect.
    """
    from evograph.operators import overlap

    near = overlap.overlap_topk(arrivals, min_jaccard, k, scope, "session_num", ("session_num", "event_seq", "anchor"), past=True)
    pairs = near.select(scope, F.col("event_id").alias("src"), F.col("cand_id").alias("dst"), F.struct("session_num", "event_seq").alias("at"), "anchor")
    known = recorded.where(F.col("edge_type").isin("updates", "contradicts")).select(scope, "src", "dst", F.col("edge_type").alias("verdict"))
    return settle(merge_join(pairs, known, [scope, "src", "dst"]), scope).select(scope, "src", "dst", F.col("verdict").alias("edge_type"), "anchor")
