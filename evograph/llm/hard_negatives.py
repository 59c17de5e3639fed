"""Hard negatives over inverted lists, exact.

Centroids come from k-means over a bounded sample; each row goes to the list of its nearest centroid, and each list
keeps its radius, the greatest distance of a member. By the Cauchy-Schwarz inequality a member's product with an
anchor a is within |a| * radius of the centroid's. So an anchor visits lists in the order of their upper bounds, passes
over those that can't meet its window of scores, and stops where the bound falls strictly below the k-th score it has.

Anchors go their way side by side, in waves of more and more lists (4, 16, 64, ...); between waves the k-th scores
are brought up to date. Lists are cut into slices, so no list is a task; equal vectors of a label are kept as often as
an answer can hold them, and equal anchors ask once, so a vector that a third of all rows have costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.llm import vectors
from evograph.llm.common import arrow_schema, remove, shared_dir, table

#: Rows that k-means sees; lists, at most, and their number as a power of the rows; rounds of k-means.
SAMPLE, LISTS, POWER, ROUNDS = 16384, 1024, 0.5, 12
#: Lists of the first wave; times more in each next one.
FIRST, GROWTH = 4, 4
#: Positives and negatives an anchor, the window in hundredths of the positive's score, and the scale of components.
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Sums of products of doubles are exact below this.
EXACT = 2.0**53


def quantised(v: Column) -> Column:
    """floor(256 * x) of each component, as doubles, which hold them exactly at any size."""

    def floor(x: Column) -> Column:
        y = SCALE * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, floor)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids at most, by Lloyd's rounds from rows spread evenly over the sample (which is in the order of a hash)."""
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        at = nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it, in slices of rows."""
    at, far = np.zeros(len(x), int), np.zeros(len(x))
    own = (centres**2).sum(1)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        at[i : i + 4096] = c = (own - 2 * part @ centres.T).argmin(1)
        far[i : i + 4096] = np.sqrt(((part - centres[c]) ** 2).sum(1))
    return at, far


class Lists:
    """The index: `members` (a table: cell, id, label, v), centres, radii and the number of slices of each list."""

    def __init__(self, rows: DataFrame, d: int, sample: int = SAMPLE, lists: int = LISTS, copies: int = POSITIVES + 1, size: int = vectors.SLICE):
        self.d = d
        n = rows.count()
        seen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]  # a bounded sample
        x = np.array(seen.tolist(), float).reshape(-1, d)
        if len(x) and float(np.abs(x).max()) ** 2 * d >= EXACT:
            raise ValueError("components are so large that their products are no longer exact")
        self.centres = centres = kmeans(x, max(1, min(lists, round(n**POWER)))) if len(x) else np.zeros((1, d))
        kinds = arrow_schema("cell bigint, far double, id bigint, label bigint, v array<double>")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = vectors.matrix(b.column(2), d)
                if float(np.abs(x).max()) ** 2 * d >= EXACT:
                    raise ValueError("components are so large that their products are no longer exact")
                at, far = nearest(x, centres)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far), *b.columns], schema=kinds)

        kept = vectors.first_copies(rows.select("id", "label", "v"), ["label", "v"], "id", copies)
        dealt = table(kept.mapInArrow(deal, "cell bigint, far double, id bigint, label bigint, v array<double>"))
        per = dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # a row a list
        self.radii, self.slices = np.full(len(centres), -1.0), np.zeros(len(centres), int)
        for r in per:
            self.radii[r["cell"]], self.slices[r["cell"]] = r["far"], -(-r["n"] // size)
        parts = F.array(*(F.lit(int(s)) for s in self.slices))
        cut = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.element_at(parts, F.col("cell").cast("int") + 1))).cast("long")
        self.members = dealt.select((F.shiftleft("cell", 20) + cut).alias("cell"), "id", "label", "v")

    def visits(self, asks: DataFrame, start: int, end: int) -> DataFrame:
        """asks (gid, label, v, windows, kth) with the cells they visit: of the lists by upper bound those at the places start to end that can hold an answer."""
        centres, radii, slices, d = self.centres, self.radii, self.slices, self.d
        schema = f"cell bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in asks.schema)}"
        target, names = arrow_schema(schema), asks.columns
        size = np.sqrt((centres**2).sum(1)) + np.maximum(radii, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, vectors.CHUNK):
                    b = whole.slice(at, vectors.CHUNK)
                    a = vectors.matrix(b.column(names.index("v")), d)
                    norm = np.sqrt((a**2).sum(1))[:, None]
                    mid, slack = a @ centres.T, 1e-6 + 1e-9 * norm * size  # for rounding
                    high, low = mid + norm * radii + slack, mid - norm * radii - slack
                    fits = np.zeros(high.shape, bool)
                    for lo, hi, kth in windows_of(b, names):
                        fits |= (high >= np.maximum(lo, kth)[:, None]) & (low <= hi[:, None])
                    order = np.argsort(np.where(radii < 0, np.inf, -high), axis=1, kind="stable")[:, start:end]
                    row, place = np.nonzero(np.take_along_axis(fits & (radii >= 0), order, 1))
                    cell = order[row, place]
                    again = slices[cell]
                    row, cell = np.repeat(row, again), np.repeat(cell, again)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
                    yield pa.RecordBatch.from_arrays([pa.array((cell << 20) + part), *b.take(pa.array(row)).columns], names=["cell", *names]).cast(target)

        return asks.mapInArrow(run, schema)


def windows_of(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, k-th score so far) of each window of a batch of questions; where a question has fewer windows, one that nothing meets."""
    windows, kth = (batch.column(names.index(c)).to_pylist() for c in ("windows", "kth"))
    for w in range(max(map(len, windows), default=0)):
        pick = lambda f, other: np.array([f(x[w], k[w]) if w < len(x) else other for x, k in zip(windows, kth, strict=True)], float)  # noqa: E731, B023
        yield pick(lambda x, k: x["lo"], np.inf), pick(lambda x, k: x["hi"], -np.inf), pick(lambda x, k: -np.inf if k is None else k, np.inf)


def search(index: Lists, asks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """gid, w, id, score (a table): the first k members of each window of each question. asks: gid, label, v, windows (array of lo, hi)."""
    schema, d, names = "gid bigint, w int, id bigint, score bigint", index.d, None
    spark, lists = asks.sparkSession, len(index.centres)

    def answer(m: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = vectors.matrix(b.column("v"), d) @ m["v"].T
        alike = b.column("label").to_numpy()[:, None] == m["label"].to_numpy()[None]
        scores[alike != same_label] = -np.inf
        for w, (lo, hi, kth) in enumerate(windows_of(b, b.schema.names)):
            s = np.where((scores >= np.maximum(lo, kth)[:, None]) & (scores <= hi[:, None]), scores, -np.inf)
            row, col = vectors.best(s, m["id"], k)
            yield pa.RecordBatch.from_arrays([b.column("gid").take(pa.array(row)), pa.array(np.full(len(row), w, np.int32)), pa.array(m["id"][col]), pa.array(s[row, col].astype(np.int64))], names=["gid", "w", "id", "score"])

    path = None
    found = spark.createDataFrame([], schema)
    start, end = 0, FIRST
    while start < lists:
        full = found.groupBy("gid", "w").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        kth = full.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("m"))  # a few windows each
        each = F.transform("windows", lambda _, i: F.element_at(F.coalesce("m", F.create_map().cast("map<int,bigint>")), i))
        visits = index.visits(asks.join(kth, "gid", "left").withColumn("kth", each).drop("m"), start, end)
        if start and index.visits(asks.join(kth, "gid", "left").withColumn("kth", each).drop("m"), start, lists).isEmpty():
            break
        more = vectors.in_cells(index.members.withColumn("gid", F.lit(None).cast("bigint")), visits, schema, answer, d)
        last, path = path, f"{shared_dir(spark)}/hard-negatives-{np.random.default_rng().integers(2**62):x}"
        vectors.top(found.unionByName(more), ["gid", "w"], k).write.parquet(path)
        found = spark.read.schema(schema).parquet(path)
        if last:
            remove(spark, last)
        start, end = end, end * GROWTH + FIRST
    return found


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that `anchors`, a condition on rows, chooses.

    Rows with a null label, id or vector, or with a null or non-finite component, take no part; further columns don't
    count. A shorter vector counts as filled with zeros. Components so large that products aren't exact (about 10 ** 5
    at 64 dimensions) are an error, not a wrong score. Rows are told apart by their ids: an id that several rows have stands
    for the least (label, vector) of them, so a repeated row counts once. A positive of a score below zero has an empty
    window. Empty tables, and anchors without positives or negatives, give no rows. index: parameters of Lists.
    """
    label = F.col(label) if isinstance(label, str) else label
    took = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & vectors.finite(F.col(vec_col)))
    took = took.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col(vec_col)).alias("v"), anchors.alias("asks"))
    took, d = vectors.padded(took)
    kept = table(vectors.one_each(took, ["label", "v", "asks"]))
    lists = Lists(kept, d, copies=max(positives + 1, negatives), **index)

    asked = kept.where("asks").withColumn("h", F.xxhash64("label", "v"))
    alike = ["h", "label", "v"]
    groups = table(asked.groupBy(*alike).agg(F.min("id").alias("gid")))  # equal anchors ask once
    of = table(asked.join(groups, alike).select(F.col("id").alias("anchor_id"), "gid"))
    wide = F.array(F.struct(F.lit(-(2**62)).alias("lo"), F.lit(2**62).alias("hi")))
    near = search(lists, groups.select("gid", "label", "v", wide.alias("windows")), positives + 1, True)
    own = of.join(near, "gid").where("anchor_id <> id")  # at most positives + 1 rows an anchor
    chosen = vectors.top(own, ["anchor_id"], positives).select("anchor_id", "gid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    window = F.struct(F.expr(f"({low} * score + 99) div 100").alias("lo"), F.expr(f"({high} * score) div 100").alias("hi"), F.col("score").alias("of"))
    windows = near.where("score >= 0").select("gid", window.alias("x")).distinct().groupBy("gid").agg(F.array_sort(F.collect_list("x")).alias("windows"))  # positives + 1 at most
    asks = table(groups.join(windows, "gid").select("gid", "label", "v", "windows"))
    far = search(lists, asks, negatives, False).join(asks.select("gid", F.posexplode("windows").alias("w", "x")), ["gid", "w"])
    place = F.row_number().over(W.partitionBy("gid", "w").orderBy(F.desc("score"), "id"))
    listed = far.select("gid", F.col("x.of").alias("positive_score"), place.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(listed, ["gid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Every pair's score by SQL; floor() of a double and products of whole numbers are exact.
ORACLE_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
