"""Writers: tables, graph files, logs, results; and the check whether a stored build is still good."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evograph.operators.metrics import aggregate_metrics

SCHEMA_VERSION = "1.1"


def _path(spark: SparkSession, where: str) -> tuple:
    """(the store, the path) of a name, as Spark sees it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_tables(tables: dict[str, DataFrame], folder: str, by: str | None = None) -> None:
    """Each table under its name. A table that is there stays whole until the new one is: that is written beside it and then renamed."""
    for name, df in tables.items():
        spark, new = df.sparkSession, f"{folder}/_{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(new)
        store, target = _path(spark, f"{folder}/{name}")
        old = _path(spark, f"{folder}/_{name}-old-{uuid.uuid4().hex}")[1]
        if store.exists(target):
            store.rename(target, old)
        if not store.rename(_path(spark, new)[1], target):
            if store.exists(old):
                store.rename(old, target)
            raise OSError(f"could not put {new} in the place of {folder}/{name}")
        store.delete(old, True)


def graph_documents(events: DataFrame, edges: DataFrame, sessions: DataFrame, topics: DataFrame) -> DataFrame:
    """conv, json: a graph file's text per conversation (a conversation fits in a row; the tables are the scalable form)."""
    ev = events.groupBy("conv").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_id", F.struct(*[c for c in events.columns if c != "conv"]))))).alias("events"))
    named = {"src": "source_event_id", "dst": "target_event_id"}
    ed = edges.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("edge_seq", *[F.col(c).alias(named.get(c, c)) for c in edges.columns if c not in ("conv", "edge_seq")]))).alias("edges"))
    rest = [(sessions, "sessions"), (topics, "topics")]
    out = ev.join(ed, "conv", "left")
    for df, name in rest:
        out = out.join(df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "conv"]))).alias(name)), "conv", "left")
    # What a session or a topic holds is a hyperedge over its members.
    over = lambda rows, kind, key, members: F.transform(F.coalesce(rows, F.array()), lambda x: F.struct(x[key].alias("h_id"), F.lit(kind).alias("edge_type"), x[members].alias("member_ids"), F.lit(1.0).alias("confidence")))
    hyper = F.array().cast("array<struct<h_id:string,edge_type:string,member_ids:array<string>,confidence:double>>")
    if "event_ids" in sessions.columns:
        hyper = F.concat(hyper, over(F.col("sessions"), "session", "session_id", "event_ids"))
    if "session_ids" in topics.columns:
        hyper = F.concat(hyper, over(F.col("topics"), "topic", "topic_id", "session_ids"))
    hyper = F.when(F.size(hyper) > 0, hyper)  # to_json leaves a null out
    body = F.struct(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version")).alias("metadata"), "events", *[F.coalesce(c, F.array()).alias(c) for c in ("edges", "sessions", "topics")], hyper.alias("hyperedges"))
    return out.select("conv", F.to_json(body).alias("json"))


def document_pieces(events: DataFrame, edges: DataFrame, sessions: DataFrame, topics: DataFrame) -> DataFrame:
    """conv, section, pos, piece: a graph file of each conversation in pieces, one for every event, edge, session and topic; in order they are its text."""
    named = {"src": "source_event_id", "dst": "target_event_id"}
    whole = lambda df, **names: F.to_json(F.struct(*(F.col(c).alias(names.get(c, c)) for c in df.columns if c != "conv")))
    over = lambda kind, key, members: F.to_json(F.struct(F.col(key).alias("h_id"), F.lit(kind).alias("edge_type"), F.col(members).alias("member_ids"), F.lit(1.0).alias("confidence")))
    rows = lambda df, section, pos, piece: df.select("conv", F.lit(section).alias("section"), F.struct(F.lit(0).alias("kind"), pos.cast("string").alias("at")).alias("pos"), piece.alias("piece"))
    by_id = lambda c: F.col(c)
    parts = [
        rows(events, 1, by_id("event_id"), F.concat(F.to_json(F.array(F.col("event_id").cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("event_id").cast("string")))) - 2), F.lit(":"), whole(events))),
        rows(edges, 3, F.lpad(F.col("edge_seq").cast("string"), 20, "0"), whole(edges, **named)), rows(sessions, 5, by_id("session_id"), whole(sessions)), rows(topics, 7, by_id("topic_id"), whole(topics)),
    ]
    if "event_ids" in sessions.columns:
        parts.append(rows(sessions, 9, by_id("session_id"), over("session", "session_id", "event_ids")))
    if "session_ids" in topics.columns:
        parts.append(rows(topics, 9, by_id("topic_id"), over("topic", "topic_id", "session_ids")))
    body = parts[0]
    for part in parts[1:]:
        body = body.unionByName(part)
    # An element that isn't its section's first has a comma before it.
    first = body.groupBy("conv", "section").agg(F.min(F.struct("pos", "piece")).alias("_first"))
    body = body.join(first, ["conv", "section"]).withColumn("piece", F.when(F.struct("pos", "piece") == F.col("_first"), F.col("piece")).otherwise(F.concat(F.lit(","), "piece"))).drop("_first")
    marks = [(0, '{"metadata":{"schema_version":"%s"},"events":{' % SCHEMA_VERSION), (2, '},"edges":['), (4, '],"sessions":['), (6, '],"topics":['), (8, '],"hyperedges":['), (10, "]}")]
    frame = F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.lit(t).alias("piece")) for n, t in marks)))
    frame = events.select("conv").distinct().select("conv", frame.alias("x")).select("conv", "x.section", F.struct(F.lit(0).alias("kind"), F.lit("").alias("at")).alias("pos"), "x.piece")
    return body.unionByName(frame)


def write_documents(events: DataFrame, edges: DataFrame, sessions: DataFrame, topics: DataFrame, folder: str) -> None:
    """A graph file for each conversation, at <folder>/conv=<its id>: an element a line, in order. A file is written piece by piece, so it may be of any size."""
    pieces = document_pieces(events, edges, sessions, topics).repartition("conv").sortWithinPartitions("conv", "section", "pos", "piece")
    pieces.select("conv", "piece").write.mode("overwrite").partitionBy("conv").text(folder)


def write_log(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("append").json(path)


def result_rows(rows: DataFrame) -> DataFrame:
    """Explanations are cut at 2000 characters."""
    return rows.withColumn("path_explanation", F.substring("path_explanation", 1, 2000))


def write_results(rows: DataFrame, folder: str, header: dict, metrics: list[str]) -> None:
    """A run: its rows (explanations cut), the metrics' aggregates by category, and a header row as JSON."""
    spark = rows.sparkSession
    tables = {"rows": result_rows(rows), "aggregates": aggregate_metrics(rows, metrics), "header": spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "header string").coalesce(1)}
    write_tables(tables, folder)


def still_good(spark: SparkSession, folder: str, prompt_hash: str, force: bool = False) -> bool:
    """Is there a stored build with this hash? (An unreadable or missing one is not.)"""
    if force:
        return False
    store, path = _path(spark, f"{folder}/metadata")
    if not store.exists(path):
        return False
    row = spark.read.parquet(f"{folder}/metadata").first()
    return row is not None and row["prompt_hash"] == prompt_hash
