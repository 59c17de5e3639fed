"""Readers: conversation samples, haystack records, graph files, notes, caches.

Every reader gives tables keyed by sample or record, so that one job covers all samples.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evograph import schemas
from evograph.functions import dates
from evograph.functions.text import normalize_role, render_dialogue, session_number, with_caption
from evograph.shared import cut
from evograph.sources import json_array

#: Question types and their categories.
CATEGORIES = {"single-session-user": 1, "single-session-assistant": 1, "single-session-preference": 1, "multi-session": 2, "temporal-reasoning": 3, "knowledge-update": 4}


class Source(Protocol):
    """What every reader of samples gives, as DataFrames: its sessions with their turns, its questions, and its sessions' summaries."""

    def sessions(self) -> DataFrame: ...

    def questions(self) -> DataFrame: ...

    def summaries(self) -> DataFrame: ...


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a dense number from 0 in the given order, without a window over all of them: rows are dealt to ranges in
    order, each range is numbered by itself, and goes on where the ranges before it end (a count a range)."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p")))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    ends = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    before = ends.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return placed.withColumn("_i", own).join(before, "_p").withColumn(name, (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_p", "_i", "_before")


def _objects(spark: SparkSession, path: str, schema, large: bool) -> DataFrame:
    """The objects of JSON files; large: of arrays, each read by many tasks (one file after another, in the order of their names)."""
    if not large:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return json_array.read_array(spark, path, schema)


def _numbered(raw: DataFrame, name: str) -> DataFrame:
    """raw with its rows numbered from 0 in the order of files and rows. Only row ids are ranked: Spark numbers them within partitions."""
    if {"file", "number"} <= set(raw.columns):  # the place in an array is known
        return ranked(raw, ["file", "number"], name).drop("file", "number")
    rows = cut(raw.withColumn("_o", F.monotonically_increasing_id()))
    return rows.join(ranked(rows.select("_o"), ["_o"], name), "_o").drop("_o")


class Samples:
    """Conversation samples from JSON (an array of objects, or one per line). large: files are arrays that are read by many tasks."""

    def __init__(self, spark: SparkSession, path: str, sample: int | None = None, limit: int | None = None, large: bool = False):
        raw = _objects(spark, path, schemas.SAMPLES, large)
        numbered = _numbered(raw, "sample_id")
        if sample is not None:
            numbered = numbered.where(F.col("sample_id") == sample)
        self.rows = numbered.where(F.col("sample_id") < limit) if limit is not None else numbered

    def sessions(self) -> DataFrame:
        """sample_id, session_num, date_time, turns: the session_N keys with a date and at least a turn."""
        entry = self.rows.select("sample_id", F.explode("conversation").alias("key", "raw"))
        num = F.regexp_extract("key", r"^session_(\d+)$", 1).try_cast("int")
        turns = F.from_json("raw", "array<struct<speaker:string,dia_id:string,text:string,img_url:string,blip_caption:string>>")
        body = entry.where(num.isNotNull()).select("sample_id", num.alias("session_num"), turns.alias("turns")).where(F.size("turns") > 0)
        date = entry.select("sample_id", F.regexp_extract("key", r"^session_(\d+)_date_time$", 1).try_cast("int").alias("session_num"), F.col("raw").alias("date_time")).where("session_num IS NOT NULL")
        return body.join(date, ["sample_id", "session_num"]).select("sample_id", "session_num", "date_time", "turns")

    def turns(self) -> DataFrame:
        t = self.sessions().select("sample_id", "session_num", "date_time", F.posexplode("turns").alias("turn", "t"))
        return t.select("sample_id", "session_num", "date_time", "turn", "t.speaker", "t.dia_id", with_caption(F.col("t.text"), F.col("t.img_url"), F.col("t.blip_caption")).alias("text"), F.col("t.img_url").isNotNull().alias("has_image"))

    def questions(self) -> DataFrame:
        """sample_id, q, question, final_answer, category, has_image_evidence (an evidence id is a turn's with an image)."""
        q = self.rows.select("sample_id", F.posexplode("qa").alias("q", "x")).select("sample_id", "q", "x.*")
        final = F.when(F.col("category") == 5, F.col("adversarial_answer")).otherwise(F.col("answer"))
        parts = q.select("sample_id", "q", F.explode("evidence").alias("e")).where(F.contains("e", F.lit(":"))).select("sample_id", "q", F.element_at(F.split("e", ":", 2), 2).alias("suffix"))
        images = self.turns().where("has_image").select("sample_id", F.col("dia_id"))
        hit = parts.join(images, "sample_id").where(F.col("dia_id").endswith(F.col("suffix"))).select("sample_id", "q").distinct().withColumn("has_image_evidence", F.lit(True))
        return q.join(hit, ["sample_id", "q"], "left").select("sample_id", "q", "question", final.alias("final_answer"), "category", "evidence", F.coalesce("has_image_evidence", F.lit(False)).alias("has_image_evidence"))

    def summaries(self) -> DataFrame:
        """sample_id, summary_key, session_num, summary, in the order of the number."""
        return self.rows.select("sample_id", F.explode("session_summary").alias("summary_key", "summary")).withColumn("session_num", session_number(F.col("summary_key")))

    def image_counts(self) -> DataFrame:
        per = self.questions().groupBy("sample_id").agg(F.count_if("has_image_evidence").alias("n"))
        return per.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


class Haystacks:
    """Question records that each bring dated sessions; sessions are unique by id, the first one wins."""

    def __init__(self, spark: SparkSession, path: str, sample: int | None = None, limit: int | None = None, large: bool = False):
        raw = _objects(spark, path, schemas.HAYSTACKS, large)
        rows = _numbered(raw, "rec")
        rows = rows.where(F.col("rec") == sample) if sample is not None else rows
        self.rows = rows.where(F.col("rec") < limit) if limit is not None else rows

    def sessions(self) -> DataFrame:
        """session_id, ordinal (by date, then id), date_time, ts, turns, num_turns. Unequal arrays are an error."""
        same = (F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
        zipped = self.rows.where(F.assert_true(same, F.lit("the haystack arrays differ in length")).isNull()).select("rec", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("pos", "x"))
        flat = zipped.select("rec", "pos", F.col("x.haystack_session_ids").alias("session_id"), F.col("x.haystack_dates").alias("date_time"), F.col("x.haystack_sessions").alias("turns"))
        first = flat.withColumn("_n", F.row_number().over(W.partitionBy("session_id").orderBy("rec", "pos"))).where("_n = 1").drop("_n", "rec", "pos")
        dated = first.withColumn("ts", dates.session_date(F.col("date_time"))).withColumn("num_turns", F.size("turns"))
        # Only (ts, session_id) is ranked, over ranges of it; the turns are joined to their rank.
        return dated.join(ranked(dated.select("ts", "session_id"), ["ts", "session_id"], "ordinal").select("session_id", "ordinal"), "session_id")

    def summaries(self, cache: DataFrame | None = None) -> DataFrame:
        """session_id, summary_key, summary, and metadata: a cached summary if there is one, else the session's dialogue."""
        rows = self.sessions().withColumn("summary_key", summary_key(F.col("ordinal"))).withColumn("dialogue", render_dialogue(F.col("turns"), F.col("date_time")))
        known = cache if cache is not None else rows.select("session_id", F.lit(None).cast("string").alias("summary")).limit(0)
        return rows.join(known.select("session_id", "summary"), "session_id", "left").select("session_id", "summary_key", F.coalesce("summary", "dialogue").alias("summary"), "date_time", (F.col("ordinal") + 1).alias("summary_index"), "num_turns")

    def questions(self) -> DataFrame:
        """rec, question_id, question (with its date before it), question_type, category, adversarial."""
        cat = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("question_type")), F.lit(1))
        dated = F.when(F.coalesce("question_date", F.lit("")) != "", F.concat(F.lit("Date of user query: "), "question_date", F.lit("\nUser: "), "question")).otherwise(F.concat(F.lit("User: "), "question"))
        return self.rows.select("rec", "question_id", dated.alias("question"), F.col("question").alias("raw_question"), F.col("answer").cast("string").alias("answer"), "question_type", cat.alias("category"), F.col("question_id").endswith("_abs").alias("adversarial"), "haystack_session_ids", "answer_session_ids")

    def notes(self) -> DataFrame:
        """session_id, note_id, note_pos, content: a note per turn, in the order of the sessions."""
        t = self.sessions().select("session_id", "ordinal", F.posexplode("turns").alias("turn", "t"))
        content = F.concat(normalize_role(F.col("t.role")), F.lit(" said: "), F.col("t.content"))
        return t.select("session_id", F.concat_ws("_", "session_id", F.col("turn")).alias("note_id"), F.struct("ordinal", "turn").alias("note_pos"), content.alias("content"))


def summary_key(ordinal):
    return F.format_string("session_%d_summary", ordinal + 1)


def node_id(sample, ordinal):
    return F.format_string("session_%d_%d", sample, ordinal + 1)


def sessions_of_keys(keys: DataFrame, sessions: DataFrame, key: str = "summary_key") -> DataFrame:
    """keys with the session_id that each summary key stands for; null for a key that is none or is out of range."""
    at = sessions.select("session_id", (F.col("ordinal") + 1).alias("_n"))
    return keys.withColumn("_n", F.regexp_extract(key, r"^session_(\d+)_summary$", 1).try_cast("int")).join(at, "_n", "left").drop("_n")


def subset_tag(sample: int | None, limit: int | None) -> str:
    return f"sample_{sample}" if sample is not None else f"first_{limit}" if limit is not None else "all"


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """events, edges, sessions, topics of graph files; conv is a hash of the file's name. Edges without both ends are dropped."""
    raw = spark.read.schema(schemas.GRAPH_FILE).option("multiLine", True).json(path).withColumn("conv", F.xxhash64(F.input_file_name()))
    events = raw.select("conv", F.explode("events").alias("k", "e")).select("conv", "e.*")
    edges = raw.select("conv", F.posexplode("edges").alias("edge_seq", "e")).select("conv", F.col("e.source_event_id").alias("src"), F.col("e.target_event_id").alias("dst"), "e.edge_type", "e.confidence", "e.reason", "e.t_invalid_at", "edge_seq")
    from evograph.operators.graph import known_ends

    edges = known_ends(edges, events.select("conv", F.col("event_id").alias("node")))
    inline = lambda c: raw.select("conv", F.explode(c).alias("x")).select("conv", "x.*")
    return {"events": events, "edges": edges, "sessions": inline("sessions"), "topics": inline("topics")}


def read_documents(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """events, edges, sessions, topics of graph files as sinks.write_documents writes them: by lines, so that one file is read by many tasks."""
    from evograph.operators.graph import known_ends

    lines = spark.read.text(folder).select("conv", F.regexp_replace("value", "^,", "").alias("x"))
    kind = schemas.GRAPH_FILE
    parts = {f.name: f.dataType for f in (kind if isinstance(kind, StructType) else StructType.fromDDL(kind))}
    parsed = lambda rows, schema: rows.select("conv", F.from_json("x", schema).alias("e")).select("conv", "e.*")
    value = r'^"(?:[^"\\]|\\.)*":'
    events = parsed(lines.where(F.col("x").rlike(value + r"\{")).withColumn("x", F.regexp_replace("x", value, "")), parts["events"].valueType)
    having = lambda key: lines.where(F.col("x").startswith("{") & F.get_json_object("x", f"$.{key}").isNotNull())
    edge = StructType([*parts["edges"].elementType.fields, StructField("edge_seq", LongType())])
    edges = parsed(having("source_event_id"), edge).withColumnsRenamed({"source_event_id": "src", "target_event_id": "dst"}).select("conv", "src", "dst", "edge_type", "confidence", "reason", "t_invalid_at", "edge_seq")
    edges = known_ends(edges, events.select("conv", F.col("event_id").alias("node")))
    return {"events": events, "edges": edges, "sessions": parsed(having("session_id"), parts["sessions"].elementType), "topics": parsed(having("topic_id"), parts["topics"].elementType)}


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Notes, embeddings and caches that sinks.write_tables wrote; a missing one is an error of the read."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
