"""What the operators share: tables in the shared folder, Arrow batches of bounded size, samples of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evograph.shared import cut, shared_dir, ship

__all__ = ["WORD", "arrow_schema", "bounded_ids", "chunks", "cut", "keep_rows", "load", "over_texts", "remove", "shared_dir", "table", "text_each"]

#: What a word is in the word-based contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python step holds at a time, besides the row that crosses the line.
CHUNK_BYTES = 1 << 20


def table(df: DataFrame) -> DataFrame:
    """As cut(), but a Parquet table: its size is known, so the planner may broadcast it if small."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (at least a row). text: the column's name or place."""
    for batch in batches:
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def over_texts(df: DataFrame, id_col: str | Column, text_col: str | Column, schema: str, make: Callable[[list], dict]) -> DataFrame:
    """A row per row of df: `id`, then what make(texts: list of str) gives as columns by name.

    Only id and text travel to Python, so further columns of df can't clash. A null text is passed
    as an empty one. Chunks are cut by bytes, so that very long texts don't add up.
    """
    src = df.select(F.col(id_col).alias("doc_id") if isinstance(id_col, str) else id_col.alias("doc_id"), F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    full = f"doc_id {kind}, {schema}"
    target = arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            made = make(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(target.field(0).type), *(pa.array(made[f.name], type=f.type) for f in list(target)[1:])], schema=target)

    return src.mapInArrow(run, full)


def keep_rows(df: DataFrame, text_col: str, verdict: Callable[[list], list]) -> DataFrame:
    """The rows of df whose text passes verdict(texts: list of str), a null one as an empty one; all columns stay."""
    target = arrow_schema(df.schema)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, at):
            mask = pa.array(list(map(bool, verdict(part.column(at).fill_null("").to_pylist()))), pa.bool_())
            kept = part.filter(mask)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, df.schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def bounded_ids(labels: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` rows of labels, those with the least hash of the id: a sample that is the same each time."""
    return labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(limit)


def text_each(df: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, known's other columns, text: a row for each _id of known (a bounded sample) that df has; of an id's texts the one with the least hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("x")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    more = [c for c in known.columns if c != "_id"]
    return rows.groupBy("doc_id", *more).agg(F.min("x").alias("x")).select("doc_id", *more, "x.text")
