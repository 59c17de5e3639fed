"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the signed axis that is
nearest. TABLES tables of one such hash (of two, when there are many rows) hold every row. A probe's loss is how much farther its
axis is than the nearest one, in squares (summed over the hashes); a question visits, over all tables, every bucket with
a loss of at most `reach`. That is fitted: CALIBRATION questions are answered by brute force over all rows, and
reach is the least loss that finds the share TARGET of their true neighbours. So recall is held at every size and for
any data, and falls out of the number of probes, not the other way round. What buckets give is ranked by the exact
product. A question for which they give too few rows visits all of one table's buckets: an exact search.

Vectors of different lengths: a row gets one more component that fills it up to the greatest norm, a question a zero, so
that the greatest product is the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.llm import vectors
from evograph.llm.common import arrow_schema, table

#: Tables; rows from which a table has two hashes; questions that are answered by brute force, and the share of their neighbours that must be found.
TABLES, TWO_FROM, CALIBRATION, TARGET = 8, 1 << 22, 256, 0.95
#: Neighbours of a question; products nearer than this count as a tie until they are summed anew, in one order.
NEAREST, SLACK = 20, 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


class Hashes:
    """The rotations of all tables, for vectors of d components; longest: the greatest norm, or 0 if norms are alike."""

    def __init__(self, d: int, tables: int, functions: int, longest: float, seed: int = 0):
        self.d, self.tables, self.functions, self.longest = d, tables, functions, longest
        self.width = 1 << max(1, (d + (longest > 0) - 1).bit_length())
        self.axes = 2 * self.width
        self.space = self.axes**functions
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, self.width))

    def lifted(self, x: np.ndarray, ask: bool) -> np.ndarray:
        """Unit vectors of `width` components."""
        out = np.zeros((len(x), self.width))
        norm = np.sqrt((x**2).sum(1))
        if ask or not self.longest:
            out[:, : self.d] = x / norm[:, None]
        else:
            out[:, : self.d] = x / self.longest
            out[:, self.d] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        return out

    def turned(self, x: np.ndarray, t: int) -> np.ndarray:
        """(rows, functions, axes): how near each signed axis is, in table t."""
        out = np.empty((len(x), self.functions, self.axes))
        for f in range(self.functions):
            y = x
            for s in self.signs[t, f]:
                y = hadamard(y * s)
            out[:, f, : self.width], out[:, f, self.width :] = y, -y
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row (not a question) in each table."""
        x = self.lifted(x, False)
        power = self.axes ** np.arange(self.functions)
        return np.stack([(self.turned(x, t).argmax(2) * power).sum(1) for t in range(self.tables)], 1)

    def losses(self, q: np.ndarray, t: int) -> np.ndarray:
        """(rows, functions, axes): a question's loss at each axis of table t."""
        y = self.turned(self.lifted(q, True), t)
        return (y.max(2, keepdims=True) - y) ** 2

    def loss_of(self, loss: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(questions, rows): the loss of each row's bucket, from losses() of its table."""
        out = loss[:, 0, codes % self.axes]
        for f in range(1, self.functions):
            out = out + loss[:, f, codes // self.axes**f % self.axes]
        return out

    def probes(self, q: np.ndarray, t: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(question, bucket) pairs of table t within reach."""
        loss = self.losses(q, t)
        if self.functions == 1:
            return np.nonzero(loss[:, 0] <= reach)
        at = [(np.full(len(first), i), first + self.axes * second) for i, x in enumerate(loss) for second, first in [np.nonzero(x[1][:, None] + x[0][None] <= reach)]]
        return np.concatenate([a for a, _ in at]), np.concatenate([b for _, b in at])


class Index:
    """All rows (id, v) with their buckets in every table, and the reach that finds TARGET of the true neighbours."""

    def __init__(self, rows: DataFrame, asks: DataFrame, d: int, k: int, tables: int = TABLES, functions: int | None = None, target: float = TARGET, calibration: int = CALIBRATION, size: int = vectors.SLICE):
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(length), F.max(length)).first()
        functions = functions or (1 if n < TWO_FROM else 2)
        self.d, self.k, self.n = d, k, n
        self.hashes = hashes = Hashes(d, tables, functions, high if n and high > 1.001 * low else 0.0)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = hashes.codes(vectors.matrix(b.column(1), d))
                    offsets = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "v", "codes"]).cast(target_schema)

        target_schema = arrow_schema("id bigint, v array<double>, codes array<bigint>")
        self.rows = table(rows.select("id", "v").mapInArrow(code, "id bigint, v array<double>, codes array<bigint>"))
        buckets = self.rows.select("id", "v", "codes", F.posexplode("codes").alias("t", "code"))
        per = buckets.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n"))
        self.slices = np.zeros((tables, hashes.space), int)
        for r in per.collect():  # tables * space at most, whatever the rows
            self.slices[r["t"], r["code"]] = -(-r["n"] // size)
        parts = F.broadcast(per.select("t", "code", F.ceil(F.col("n") / size).alias("parts")))
        cell = F.shiftleft(F.col("t") * F.lit(hashes.space) + F.col("code"), 20) + F.pmod(F.xxhash64("id"), F.col("parts"))
        self.members = buckets.join(parts, ["t", "code"]).select(cell.alias("cell"), "id", "v", "codes", "t")
        self.reach = self._reach(asks, target, calibration)

    def _reach(self, asks: DataFrame, target: float, calibration: int) -> float:
        chosen = asks.orderBy(F.xxhash64("gid"), "gid").limit(calibration).select("v").toPandas()["v"]  # a bounded sample
        q, d, k, hashes = np.array(chosen.tolist(), float).reshape(-1, self.d), self.d, self.k, self.hashes
        if not len(q):
            return 0.0
        schema = "gid bigint, id bigint, score double, codes array<bigint>"
        target_schema = arrow_schema(schema)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k nearest of each question among a task's rows."""
            score, ids, codes = np.zeros((len(q), 0)), np.zeros((len(q), 0), int), np.zeros((len(q), 0, hashes.tables), int)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    own, s = vectors.matrix(part.column(2), hashes.tables).astype(int), q @ vectors.matrix(part.column(1), d).T
                    score = np.concatenate([score, s], 1)
                    ids = np.concatenate([ids, np.broadcast_to(part.column(0).to_numpy(), s.shape)], 1)
                    codes = np.concatenate([codes, np.broadcast_to(own, (*s.shape, hashes.tables))], 1)
                    keep = np.argsort(-score, 1, kind="stable")[:, :k]
                    score, ids, codes = np.take_along_axis(score, keep, 1), np.take_along_axis(ids, keep, 1), np.take_along_axis(codes, keep[:, :, None], 1)
            row = np.repeat(np.arange(len(q)), score.shape[1])
            offsets = pa.array(np.arange(0, codes.size + 1, hashes.tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids.ravel()), pa.array(score.ravel()), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["gid", "id", "score", "codes"]).cast(target_schema)

        true = vectors.top(self.rows.select("id", "v", "codes").mapInArrow(scan, schema), ["gid"], k).toPandas()  # calibration * k rows
        of, codes = true["gid"].to_numpy(), np.array(true["codes"].tolist(), int).reshape(-1, hashes.tables)
        least = np.full(len(of), np.inf)
        for t in range(hashes.tables):
            loss = hashes.losses(q, t)
            least = np.minimum(least, sum(loss[of, f, codes[:, t] // hashes.axes**f % hashes.axes] for f in range(hashes.functions)))
        return float(np.quantile(least, target, method="higher"))

    def visits(self, asks: DataFrame, everywhere: bool = False) -> DataFrame:
        """asks (gid, v) with the cells they visit: buckets within reach, or all of table 0."""
        hashes, slices, reach, d = self.hashes, self.slices, np.inf if everywhere else self.reach, self.d
        schema = "cell bigint, gid bigint, v array<double>"
        target = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    b = whole.slice(at, 64)
                    q = vectors.matrix(b.column(1), d)
                    for t in range(1 if everywhere else hashes.tables):
                        row, code = hashes.probes(q, t, reach)
                        again = slices[t, code]
                        part = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                        row, code = np.repeat(row, again), np.repeat(code, again)
                        yield pa.RecordBatch.from_arrays([pa.array(((t * hashes.space + code) << 20) + part), *b.take(pa.array(row)).columns], names=["cell", "gid", "v"]).cast(target)

        return asks.select("gid", "v").mapInArrow(run, schema)

    def nearest(self, asks: DataFrame, everywhere: bool = False) -> DataFrame:
        """gid, id, score: the k greatest products among what each question visits."""
        hashes, reach, d, k = self.hashes, self.reach, self.d, self.k
        schema = "gid bigint, id bigint, score double"

        def answer(m: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            q = vectors.matrix(b.column("v"), d)
            s = q @ m["v"].T
            if not everywhere:  # a row that an earlier table has shown isn't shown again
                codes = vectors.matrix(m["codes"], hashes.tables).astype(int)
                for t in range(m["t"][0].as_py()):
                    s[hashes.loss_of(hashes.losses(q, t), codes[:, t]) <= reach] = -np.inf
            row, col = vectors.best(s, m["id"], k, SLACK * max(1.0, float(np.abs(s[s > -np.inf]).max(initial=0))))
            exact = (q[row] * m["v"][col]).sum(1)
            order = np.lexsort((m["id"][col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([b.column("gid").take(pa.array(row[kept])), pa.array(m["id"][col[kept]]), pa.array(exact[kept])], names=["gid", "id", "score"])

        members = self.members.where("t = 0") if everywhere else self.members
        return vectors.top(vectors.in_cells(members, self.visits(asks, everywhere), schema, answer, d), ["gid"], k)


def search(rows: DataFrame, queries: Column, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", **index) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that `queries`, a condition on rows, chooses, against all rows: the k nearest found, of all but the query's own.

    A query has min(k, number of other rows) results. Rows with a null id, a null or zero vector, or with null or
    non-finite components, take no part; further columns don't count. A shorter vector counts as filled with zeros. Rows
    are told apart by their ids: an id that several rows have stands for the least vector of them. Ties go to the smaller id. An
    empty table gives no rows. index: parameters of Index.
    """
    took = rows.where(F.col(id_col).isNotNull() & vectors.finite(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0))
    took = took.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("asks"))
    took, d = vectors.padded(took)
    kept = table(vectors.one_each(took, ["v", "asks"]))
    asked = kept.where("asks").withColumn("h", F.xxhash64("v"))
    groups = table(asked.groupBy("h", "v").agg(F.min("id").alias("gid")))  # equal questions are asked once
    of = table(asked.join(groups, ["h", "v"]).select(F.col("id").alias("query_id"), "gid"))
    made = Index(vectors.first_copies(kept, ["v"], "id", k + 1), groups, d, k + 1, **index)
    found = table(made.nearest(groups))
    enough = found.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, made.n))
    short = groups.join(enough, "gid", "left_anti")
    if not short.isEmpty():
        found = found.join(enough, "gid", "left_semi").unionByName(made.nearest(short, everywhere=True))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = of.join(found, "gid").where("query_id <> id").withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
