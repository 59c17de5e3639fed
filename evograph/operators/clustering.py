"""k-means of many scopes at once (a conversation's sessions, say), each with its own number of clusters.

A scope of at most SLICE rows is clustered in a task, the best of ten starts. For larger ones seeding is k-means||: a few rounds, in each of which every row may become a candidate with a probability by its share of the
cost so far; candidates get the rows that are nearest to them as weights, and weighted far-apart ones of them are the first
centres. Then come Lloyd's rounds. Rows meet centres in blocks (SLICE rows, BLOCK centres), so neither a large scope
nor many clusters are a task; what is random comes from hashes, so a run can be repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.operators.hierarchy import far_apart, seeded_kmeans
from evograph.shared import cut

#: Rows and centres of a block; candidates that are thinned out in one task, about; rounds of seeding, candidates a round in times of k, and rounds of Lloyd's.
SLICE, BLOCK, CELL, SEEDING, OVER, ROUNDS = 4096, 4096, 4096, 3, 2, 10


def _blocks(df: DataFrame, by: str, item: str, size: int, name: str) -> DataFrame:
    """df with a block number (name) of about `size` rows, and the number of blocks of the scope (name + 's')."""
    n = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return df.join(n, by).withColumn(name, F.pmod(F.xxhash64(item), F.col(f"{name}s")).cast("int"))


def nearest(rows: DataFrame, centres: DataFrame, scope: str, item: str) -> DataFrame:
    """scope, item, centre, gap: of each row the nearest centre of its scope (the first one on a tie) and the squared distance. centres: scope, centre, c."""
    a, b = _blocks(rows.select(scope, item, "v"), scope, item, SLICE, "slice"), _blocks(centres, scope, "centre", BLOCK, "part")
    parts, slices = b.select(scope, "parts").distinct(), a.select(scope, "slices").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(parts, scope).withColumn("part", every("parts")).select(scope, "slice", "part", item, "v")
    right = b.join(slices, scope).withColumn("slice", every("slices")).select(F.col(scope).alias("_scope"), F.col("slice").alias("_slice"), F.col("part").alias("_part"), "centre", "c")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    numbers = lambda column, d: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def meet(x: pa.Table, c: pa.Table) -> pa.Table:
        if not x.num_rows or not c.num_rows:
            return pa.table({scope: x[scope][:0], item: x[item][:0], "centre": pa.array([], pa.int64()), "gap": pa.array([], pa.float64())})
        c = c.sort_by("centre")
        d = len(x["v"][0])
        rows, centre = numbers(x["v"], d), numbers(c["c"], d)
        at, gap, own = np.zeros(len(rows), int), np.zeros(len(rows)), (centre**2).sum(1)
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            at[i : i + 512] = best = (own - 2 * part @ centre.T).argmin(1)
            gap[i : i + 512] = ((part - centre[best]) ** 2).sum(1)
        return pa.table({scope: x[scope], item: x[item], "centre": c["centre"].to_numpy()[at], "gap": gap})

    met = left.groupBy(scope, "slice", "part").cogroup(right.groupBy("_scope", "_slice", "_part")).applyInArrow(meet, f"{scope} {kinds[scope]}, {item} {kinds[item]}, centre bigint, gap double")
    return met.groupBy(scope, item).agg(F.min(F.struct("gap", "centre")).alias("x")).select(scope, item, "x.centre", "x.gap")


def _unit_hash(*by) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / float(1 << 30)


def seeds(rows: DataFrame, scope: str, item: str, rounds: int = SEEDING) -> DataFrame:
    """scope, centre, c: k first centres of each scope (fewer, if it has fewer different rows). rows: scope, item, v, k."""
    first = F.row_number().over(W.partitionBy(scope).orderBy(F.xxhash64(item), item))
    chosen = cut(rows.withColumn("_n", first).where("_n = 1").select(scope, F.lit(0).cast("long").alias("centre"), F.col("v").alias("c")))
    for r in range(rounds):
        near = cut(nearest(rows, chosen, scope, item))
        total = near.groupBy(scope).agg(F.sum("gap").alias("total"))
        odds = near.join(total, scope).join(rows.select(scope, item, "k", "v"), [scope, item])
        fresh = odds.where((F.col("gap") > 0) & (_unit_hash(item, F.lit(r)) < OVER * F.col("gap") * F.col("k") / F.col("total")))
        number = F.row_number().over(W.partitionBy(scope).orderBy(item)) + F.lit((r + 1) << 40)
        chosen = cut(chosen.unionByName(fresh.select(scope, number.cast("long").alias("centre"), F.col("v").alias("c"))))
    weight = nearest(rows, chosen, scope, item).groupBy(scope, "centre").agg(F.count(F.lit(1)).alias("w"))
    # Neighbours are thinned out together: cells are around a few of the candidates.
    order = F.row_number().over(W.partitionBy(scope).orderBy(F.xxhash64("centre"), "centre"))
    sizes = chosen.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    coarse = chosen.withColumn("_n", order).join(sizes, scope).where(F.col("_n") <= F.col("cells")).select(scope, "centre", "c")
    near = nearest(chosen.select(scope, F.col("centre").alias("_item"), F.col("c").alias("v")), coarse, scope, "_item").select(scope, F.col("_item").alias("centre"), F.col("centre").alias("cell"))
    cells = chosen.join(weight, [scope, "centre"]).join(near, [scope, "centre"])
    share = cells.groupBy(scope, "cell").agg(F.sum("w").alias("own")).withColumn("upto", F.sum("own").over(W.partitionBy(scope).orderBy("cell")))
    ks = rows.groupBy(scope).agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n"))
    upto = lambda x: F.round(F.col("k") * x / F.col("n")).cast("int")
    share = share.join(ks, scope).select(scope, "cell", (upto(F.col("upto")) - upto(F.col("upto") - F.col("own"))).alias("take"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        """`take` of a cell's candidates, each far from those before it, by weight."""
        pdf = pdf.sort_values("centre")
        x, w, take = np.array(pdf["c"].tolist(), float), pdf["w"].to_numpy(float), int(pdf["take"].iloc[0])
        return pdf.iloc[far_apart(x, take, np.random.default_rng(0), w) if take else []][[scope, "centre", "c"]]

    return cells.join(share, [scope, "cell"]).groupBy(scope, "cell").applyInPandas(thin, f"{scope} {kinds[scope]}, centre bigint, c array<double>")


def kmeans_scopes(points: DataFrame, scope: str = "conv", item: str = "session_id", target: int | None = None, k: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """scope, item, centre, gap: each row's cluster, and its squared distance from the centroid; k clusters a scope, or one for every `target` rows.

    points: scope, item, v (arrays of one length). A scope with fewer different rows than clusters has a cluster for each.
    """
    rows = cut(points.select(scope, item, F.col("v").cast("array<double>").alias("v")))
    size = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.lit(k) if k is not None else F.rint(F.col("n") / target)
    all_rows = rows.join(size.select(scope, "n", F.greatest(F.lit(1), F.least(F.col("n"), wanted.cast("long"))).alias("k")), scope)
    small, rows = all_rows.where(F.col("n") <= SLICE), all_rows.where(F.col("n") > SLICE)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.array(pdf["v"].tolist(), float)
        labels = seeded_kmeans(x, int(pdf["k"].iloc[0]))
        gap = np.zeros(len(x))
        for j in set(labels.tolist()):
            gap[labels == j] = ((x[labels == j] - x[labels == j].mean(0)) ** 2).sum(1)
        return pd.DataFrame({scope: pdf[scope].to_numpy(), item: pdf[item].to_numpy(), "centre": labels, "gap": gap})

    whole = small.groupBy(scope).applyInPandas(one, f"{scope} {kinds[scope]}, {item} {kinds[item]}, centre bigint, gap double")
    if rows.isEmpty():
        return whole
    centres = cut(seeds(rows, scope, item))
    for _ in range(rounds):
        near = nearest(rows, centres, scope, item).join(rows.select(scope, item, "v"), [scope, item])
        means = near.select(scope, "centre", F.posexplode("v").alias("i", "x")).groupBy(scope, "centre", "i").agg(F.avg("x").alias("x"))
        centres = cut(means.groupBy(scope, "centre").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(scope, "centre", F.transform("s", lambda p: p["x"]).alias("c")))
    return whole.unionByName(nearest(rows, centres, scope, item))


def recluster(sessions: DataFrame, generation: int, scope: str = "conv", item: str = "session_id", target: int = 5) -> DataFrame:
    """scope, item, topic: all conversations' topics anew, under names of the given generation, numbered by their first session."""
    found = kmeans_scopes(sessions, scope, item, target)
    first = found.groupBy(scope, "centre").agg(F.min(item).alias("first"))
    named = first.withColumn("topic", F.concat_ws("_", F.lit(generation), F.row_number().over(W.partitionBy(scope).orderBy("first")) - 1))
    return found.join(named, [scope, "centre"]).select(scope, item, "topic")
