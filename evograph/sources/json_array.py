"""Large JSON arrays of objects, read by many tasks.

Spark's multi-line JSON reader gives a whole file to one task. Here a file is read as text that ends at each `}`, which Spark
splits by byte ranges. Whether such a brace is structure or part of a string, and at what depth, depends on all that
stands before it; but of a piece only two numbers matter for that: whether it has an odd number of quotes, and by how
much it goes up or down, for either state at its beginning. Running sums of these (within a byte range, then over the
ranges, of which there are few) tell where the array's objects end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evograph.shared import cut


def _depth(plain: Column, inside: bool) -> Column:
    """How far a piece (without escapes) goes up, before the brace that ends it. inside: it begins within a string."""
    outside = F.regexp_replace(F.concat(F.lit('"'), plain) if inside else plain, r'"[^"]*("|\z)', "")
    n = lambda c: F.length(outside) - F.length(F.replace(outside, F.lit(c), F.lit("")))
    return n("{") + n("[") - n("]")


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over all pieces of the file that come before."""
    own = F.coalesce(F.sum(value).over(W.partitionBy("file", "start").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = rows.groupBy("file", "start").agg(F.sum(value).alias("_t"))  # a row a byte range
    earlier = F.coalesce(F.sum("_t").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut(rows.withColumn("_own", own).join(ends.withColumn("_off", earlier).drop("_t"), ["file", "start"]).withColumn(name, F.col("_own") + F.col("_off")).drop("_own", "_off"))


def array_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0, within the file), text of each object of the JSON arrays in the files of path. Elements that are no objects are passed over.

    An object must fit a row, a file needn't fit a task. A file that is no array of objects gives no rows, or wrong ones.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    pieces = cut(raw)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = (F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))) % 2
    rows = pieces.select("file", "start", "i", plain.alias("plain")).select("file", "start", "i", quotes.alias("odd"), _depth(F.col("plain"), False).alias("up0"), _depth(F.col("plain"), True).alias("up1"))
    rows = _before(rows, "odd", "quotes")
    inside = F.col("quotes") % 2 == 1
    closes = (F.col("quotes") + F.col("odd")) % 2 == 0
    rows = _before(rows.withColumn("closes", closes).withColumn("step", F.when(inside, F.col("up1")).otherwise(F.col("up0")) - closes.cast("int")), "step", "depth")
    at = rows.groupBy("file").agg(F.max(F.struct("start", "i")).alias("final"))  # what follows a file's last brace ends nothing
    done = F.col("closes") & (F.col("depth") + F.col("step") == 1) & (F.struct("start", "i") != F.col("final"))
    rows = _before(rows.join(at, "file").select("file", "start", "i", done.cast("int").alias("done")), "done", "number")
    parts = pieces.join(rows, ["file", "start", "i"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "i", "value"))).alias("x"), F.max("done").alias("done"))
    text = F.concat(F.array_join(F.transform("x", lambda p: p["value"]), "}"), F.lit("}"))
    # What stands before an object: the array's beginning, a comma, elements that are no objects.
    return parts.where("done = 1").select("file", F.col("number").cast("long").alias("number"), F.regexp_replace(text, r'^(?:[^{"]|"(?:[^"\\]|\\.)*")*', "").alias("text"))


def read_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """file, number and the columns of schema, a row an object; an object that can't be read gives nulls."""
    return array_texts(spark, path).select("file", "number", F.from_json("text", schema).alias("_x")).select("file", "number", "_x.*")
