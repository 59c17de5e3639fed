"""Context assembly: parts of text, deduplicated and cut to token budgets by running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(parts: DataFrame, by: list[str], order: list[str], size: str = "tokens") -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return parts.withColumn("used", F.sum(size).over(w).cast("long"))


def budget_prefix(parts: DataFrame, budget: int, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The longest prefix whose tokens fit (sizes are not negative, so that is where the running sum still fits)."""
    return running(parts, by or ["qid"], order or ["seq"]).where(F.col("used") <= budget)


def two_sections(parts: DataFrame, notes_budget: int, paths_budget: int, total: int) -> DataFrame:
    """Section 1 fills its budget; section 2 its own and what section 1 left, its header always stays; then the
    total cap takes parts off section 2's end, but never its first one. parts: qid, section, seq, tokens, header."""
    first = budget_prefix(parts.where("section = 1"), notes_budget)
    used = first.groupBy("qid").agg(F.max("used").alias("spent"))
    second = running(parts.where("section = 2"), ["qid"], ["seq"]).join(used, "qid", "left").withColumn("spent", F.coalesce("spent", F.lit(0)))
    fits = (F.col("used") <= paths_budget + (notes_budget - F.col("spent"))) | F.col("header")
    second = second.where(fits)
    place = F.row_number().over(W.partitionBy("qid").orderBy("seq"))
    second = second.withColumn("place", place).where((F.col("place") == 1) | (F.col("spent") + F.col("used") <= total))
    names = ["qid", "section", "seq", "tokens"]
    return first.select(*names).unionByName(second.select(*names))


def dedup_notes(parts: DataFrame, mode: str) -> DataFrame:
    """First mention of a note stays, by id or by content hash; any other mode keeps all."""
    key = {"note_id": F.col("note_id"), "content": F.md5("text")}.get(mode)
    if key is None:
        return parts
    w = W.partitionBy("qid", key).orderBy("section", "seq")
    return parts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """is_first: is this path the first of the question to mention the event? (Within one path all count as first.)"""
    return mentions.withColumn("is_first", F.col("path_rank") == F.min("path_rank").over(W.partitionBy("qid", "event_id")))


def assemble(parts: DataFrame) -> DataFrame:
    """qid, context: the parts in order, a line each."""
    listed = F.array_sort(F.collect_list(F.struct("section", "seq", "text")))
    return parts.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("context"))


def neighbours(near: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """qid, note_id, rank, step: the retrieved notes (qid, note_id, rank), each followed by the notes that it links to, `most` at most (links: note_id, pos, linked)."""
    own = near.select("qid", "note_id", "rank", F.lit(0).alias("step"))
    met = near.select("qid", "note_id", "rank").join(links, "note_id")
    step = F.row_number().over(W.partitionBy("qid", "rank").orderBy("pos"))
    return own.unionByName(met.select("qid", F.col("linked").alias("note_id"), "rank", step.alias("step")).where(F.col("step") <= most))


def path_section(shown: DataFrame, path_notes: DataFrame, first: DataFrame, header: str = "=== Causal Evidence ===") -> DataFrame:
    """qid, seq, text, note_id, header: a header, then each path's line followed by the notes of its events that neither section 1 nor an earlier path has shown.

    shown: qid, place, text; path_notes: qid, place, pos (of the note within the path), note_id, text; first: qid, note_id of section 1.
    """
    none = F.lit(None).cast(path_notes.schema["note_id"].dataType)
    head = shown.select("qid").distinct().select("qid", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("seq"), F.lit(header).alias("text"), none.alias("note_id"), F.lit(True).alias("header"))
    line = shown.select("qid", F.struct(F.col("place").cast("int").alias("a"), F.lit(0).alias("b")).alias("seq"), F.concat(F.lit("Path "), F.col("place"), F.lit(": "), F.col("text")).alias("text"), none.alias("note_id"), F.lit(False).alias("header"))
    new = path_notes.join(first.select("qid", "note_id").distinct(), ["qid", "note_id"], "left_anti")
    once = new.withColumn("_n", F.row_number().over(W.partitionBy("qid", "note_id").orderBy("place", "pos"))).where("_n = 1")
    notes = once.select("qid", F.struct(F.col("place").cast("int").alias("a"), (F.col("pos") + 1).cast("int").alias("b")).alias("seq"), "text", "note_id", F.lit(False).alias("header"))
    return head.unionByName(line).unionByName(notes)


def paths_only(path_notes: DataFrame, near: DataFrame, supplements: int = 3, header: str = "=== Evidence from reasoning paths ===") -> DataFrame:
    """qid, seq, text: a context of the paths' notes alone, each once, and up to three retrieved notes that they lack. near: qid, note_id, rank, text."""
    once = path_notes.withColumn("_n", F.row_number().over(W.partitionBy("qid", "note_id").orderBy("place", "pos"))).where("_n = 1")
    seq = lambda part, a, b: F.struct(F.lit(part).alias("part"), F.col(a).cast("int").alias("a") if a else F.lit(0).alias("a"), F.col(b).cast("int").alias("b") if b else F.lit(0).alias("b")).alias("seq")
    more = near.join(path_notes.select("qid", "note_id").distinct(), ["qid", "note_id"], "left_anti")
    more = more.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("_n") <= supplements)
    head = path_notes.select("qid").distinct().select("qid", seq(0, None, None), F.lit(header).alias("text"))
    return head.unionByName(once.select("qid", seq(1, "place", "pos"), "text")).unionByName(more.select("qid", seq(2, "rank", None), "text"))
