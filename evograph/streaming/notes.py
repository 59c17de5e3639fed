"""Notes that arrive one after another: appending, rebuilding the index, and caches of summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions import parsers, prompts
from evograph.functions.text import render_note_fields
from evograph.operators import retrieval
from evograph.shared import cut

#: Fixed value: neighbours that a new note is held against.
NEIGHBOURS = 5


def evolve(notes: DataFrame, new: DataFrame, complete: Callable[[Column], Column], k: int = NEIGHBOURS, scope: str = "conv") -> tuple[DataFrame, DataFrame]:
    """(notes with changed neighbours, new with its links, tags and `evolved`): one arriving note of each conversation is held against its k nearest.

    Both: scope, note_id, note_pos, content, timestamp, context, keywords, tags, links (array of int), v, norm; new has at most a
    note a conversation (several arrive one batch after another, as each may change what the next one sees). complete: a model as
    a column function (providers.completion); asked up to three times, and only where the answer before calls for it. A
    conversation without notes, or an answer that can't be read, changes nothing.
    """
    asked = new.select(F.col("note_id").alias("qid"), scope, F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    near = cut(retrieval.knn_scoped(notes, asked, k, "note_id", scope).select("qid", "note_id", (F.col("rank") - 1).cast("int").alias("place")))
    shown = render_note_fields(F.col("timestamp"), F.col("content"), F.col("context"), F.col("keywords"), F.col("tags"))
    told = near.join(notes.select("note_id", shown.alias("shown")), "note_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("x"))  # k at most
    rows = new.select("note_id", "links", "tags", shown.alias("note")).join(told, F.col("note_id") == F.col("qid")).withColumn("neighbours", prompts.numbered(F.transform("x", lambda x: x["shown"])))
    fields = {"note": F.col("note"), "neighbours": F.col("neighbours")}
    decided = cut(rows.withColumn("decision", parsers.evolution(complete(prompts.filled(prompts.EVOLUTION, **fields)))["decision"]))
    strong = decided.where(F.col("decision").isin("STRENGTHEN", "STRENGTHEN_AND_UPDATE")).select("note_id", parsers.strengthen_details(complete(prompts.filled(prompts.STRENGTHEN, **fields))).alias("s"))
    changed = decided.where(F.col("decision").isin("UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE")).select("qid", F.posexplode(parsers.update_neighbours(complete(prompts.filled(prompts.UPDATE_NEIGHBOURS, count=F.size("x"), **fields)), k)).alias("place", "u"))
    links = F.when(F.col("s").isNotNull(), F.concat("links", F.col("s.connections"))).otherwise(F.col("links"))
    tags = F.when(F.size("s.tags") > 0, F.col("s.tags")).otherwise(F.col("tags"))
    evolved = decided.select("note_id", (F.col("decision") != "NO_EVOLUTION").alias("evolved"))
    out = new.join(strong, "note_id", "left").withColumn("links", links).withColumn("tags", tags).drop("s").join(evolved, "note_id", "left").withColumn("evolved", F.coalesce("evolved", F.lit(False)))
    say = changed.join(near, ["qid", "place"]).groupBy("note_id").agg(F.max_by("u", "qid").alias("u"))
    told_anew = notes.join(say, "note_id", "left").withColumn("context", F.when(F.col("u.context") != "", F.col("u.context")).otherwise(F.col("context"))).withColumn("tags", F.when(F.size("u.tags") > 0, F.col("u.tags")).otherwise(F.col("tags")))
    return told_anew.select(*notes.columns), out.select(*new.columns, "evolved")


def evolve_in_order(notes: DataFrame, new: DataFrame, complete: Callable[[Column], Column], k: int = NEIGHBOURS, scope: str = "conv") -> tuple[DataFrame, DataFrame]:
    """As evolve(), for any number of arriving notes a conversation: as if they came one by one, in the order of note_pos.

    The i-th notes of all conversations evolve together, and are among the neighbours of the next ones. There are as many rounds as the
    busiest conversation has new notes; what a round has changed is written before the next.
    """
    turn = cut(new.withColumn("_turn", F.row_number().over(W.partitionBy(scope).orderBy("note_pos", "note_id"))))
    done, known = None, notes
    for i in range(1, (turn.agg(F.max("_turn")).first()[0] or 0) + 1):
        told, out = evolve(known, turn.where(F.col("_turn") == i).drop("_turn"), complete, k, scope)
        out = cut(out)
        flags = out.select("note_id", "evolved")
        done = flags if done is None else done.unionByName(flags)
        known = cut(told.unionByName(out.select(*told.columns)))
    arrived = new.select("note_id")
    after = known.join(arrived, "note_id", "left_semi")
    after = after.join(done, "note_id") if done is not None else after.withColumn("evolved", F.lit(False))
    return known.join(arrived, "note_id", "left_anti").select(*notes.columns), after.select(*new.columns, "evolved")


def by_time(notes: DataFrame, scope: str = "conv") -> DataFrame:
    """scope, timestamp, note_ids: the notes of each time that have content, in the order of their places."""
    kept = notes.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    lists = kept.groupBy(scope, "timestamp").agg(F.array_sort(F.collect_list(F.struct("note_pos", "note_id"))).alias("x"))  # the notes of one session
    return lists.select(scope, "timestamp", F.transform("x", lambda x: x["note_id"]).alias("note_ids"))


def append_notes(notes: DataFrame, new: DataFrame, scope: str = "conv") -> DataFrame:
    """new behind notes; places go on where a conversation's notes end. new has a column `seq`."""
    last = notes.groupBy(scope).agg(F.max("note_pos").alias("_last"))
    n = F.row_number().over(W.partitionBy(scope).orderBy("seq"))
    placed = new.withColumn("_n", n).join(last, scope, "left").withColumn("note_pos", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long")).drop("_n", "_last", "seq")
    return notes.unionByName(placed, allowMissingColumns=True)


def rebuild_points(evolutions: DataFrame, threshold: int = 100, scope: str = "conv") -> DataFrame:
    """Evolutions after which a conversation's index is rebuilt: every threshold-th. evolutions: scope, seq, evolved."""
    n = F.sum(F.col("evolved").cast("int")).over(W.partitionBy(scope).orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return evolutions.withColumn("n", n).where(F.col("evolved") & (F.col("n") % threshold == 0)).select(scope, "seq", (F.col("n") / threshold).cast("int").alias("rebuild"))


def to_summarise(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """Sessions whose summary isn't cached."""
    return sessions.join(cache.select("session_id"), "session_id", "left_anti")


def add_summaries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache and what is new in it; a cached summary stays."""
    return cache.unionByName(new.join(cache.select("session_id"), "session_id", "left_anti"))


def short_or_summary(text, summary, limit: int = 1000):
    """A dialogue of at most `limit` characters is its own summary."""
    return F.when(F.char_length(text) <= limit, text).otherwise(summary)


def last_positions(notes: DataFrame, scope: str = "conv") -> DataFrame:
    """content -> place: of equal contents the last place."""
    return notes.groupBy(scope, "content").agg(F.max("note_pos").alias("note_pos"))
