"""What the two vector searches share: which rows take part, a padded form, and a search within cells.

A cell is a slice of an inverted list or of a hash bucket. Its members and the questions that visit it meet in
one exchange: members come first, so a task holds the members of one cell at a time and answers the questions
as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.llm.common import arrow_schema

#: Members of a cell; questions that are multiplied at a time.
SLICE, CHUNK = 16384, 256


def finite(v: Column) -> Column:
    """Is it a vector without null, NaN or infinite components?"""
    x = lambda x: x.cast("double")
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf"))), F.lit(False))


def padded(rows: DataFrame, v: str = "v") -> tuple[DataFrame, int]:
    """rows with vectors filled with zeros to the length of the longest, and that length (at least one)."""
    d = max(1, rows.agg(F.max(F.size(v))).first()[0] or 0)
    return rows.withColumn(v, F.concat(v, F.array_repeat(F.lit(0.0), F.lit(d) - F.size(v)))), d


def one_each(rows: DataFrame, more: list[str]) -> DataFrame:
    """A row per id: of several the least by `more`."""
    return rows.groupBy("id").agg(F.min(F.struct(*more)).alias("x")).select("id", *(f"x.{c}" for c in more))


def first_copies(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """Of rows that are equal in `by` the first `most`: ties go to the smaller id, so no other copy is among so many nearest. Each task keeps that many before the exchange."""
    h = F.xxhash64(*by).alias("_h")
    n = F.row_number().over(W.partitionBy("_h", *by).orderBy(order))
    return rows.select("*", h).withColumn("_n", n).where(F.col("_n") <= most).drop("_h", "_n")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A row a list, each of d doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def best(values: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest values of each row, ties by smaller id; -inf is none. slack: what is nearer than that to the k-th is given, too."""
    if not values.size:
        return np.zeros(0, int), np.zeros(0, int)
    at = max(0, values.shape[1] - k)
    least = np.partition(values, at, axis=1)[:, at]
    row, col = np.nonzero((values >= least[:, None] - slack) & (values > -np.inf))
    if slack:
        return row, col
    order = np.lexsort((ids[col], -values[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def in_cells(members: DataFrame, asks: DataFrame, schema: str, answer: Callable[[dict[str, np.ndarray | pa.Array], pa.RecordBatch], Iterator[pa.RecordBatch]], d: int) -> DataFrame:
    """Rows of `schema` from answer(members of a cell, a batch of its questions) for each cell (a long, in both).

    members: cell, id, v and more; asks: cell, v and more; both know all columns by name (those of one side are null in
    the other). Members of a cell come by columns, v as a matrix, in the order of their ids.
    """
    left, right = members.withColumn("_ask", F.lit(False)), asks.withColumn("_ask", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True)
    names, target = both.columns, arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, built = None, [], None
        for batch in batches:
            keys, asked = batch.column(names.index("cell")).to_numpy(), batch.column(names.index("_ask")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != cell:
                    cell, held, built = keys[a], [], None
                part = batch.slice(a, b - a)
                if not asked[a]:
                    held.append(part)
                    continue
                if built is None:
                    if not held:  # nothing is in this cell
                        continue
                    rows = pa.Table.from_batches(held).combine_chunks()
                    built = {c: rows[c].combine_chunks() for c in names} | {"v": matrix(pa.concat_arrays(rows["v"].chunks), d), "id": rows["id"].to_numpy()}
                    held = []
                for start in range(0, part.num_rows, CHUNK):
                    for out in answer(built, part.slice(start, CHUNK)):
                        if out.num_rows:
                            yield out.cast(target)

    kept = both.repartition("cell").sortWithinPartitions("cell", "_ask", "id")
    return kept.mapInArrow(run, schema)


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each key the k best (score, then smaller id)."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")
