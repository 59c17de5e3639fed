"""Similarity search and seed selection, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.vector import dot, matrix
from evograph.operators.clustering import nearest as nearest_centre
from evograph.shared import cut

#: Queries of a block; and how many queries may be sent to all tasks (4096 of 64 doubles are 2 MB).
QUERY_BLOCK, BROADCAST_QUERIES = 256, 4096
#: Rows of a scope up to which its queries are multiplied with all of it; pivots of a larger one, at most.
WHOLE_SCOPE, PIVOTS = 4096, 256
#: How many scopes' numbers of blocks (16 bytes each) may be sent to all tasks.
BROADCAST_SCOPES = 1 << 16
#: Rows and queries of a block of products; blocks that fewer rows than that are dealt to, and rows of one of those at least.
ROWS, QUERIES, SPREAD, LEAST = 16384, 16384, 24, 1024


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from left to right as functions.vector.dot does: the same doubles."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.cumsum(a[i : i + (1 << 16)] * b[i : i + (1 << 16)], axis=1)[:, -1]
    return out


def _block_best(x: pa.Table, q: pa.Table, item: str, k: int, least: float | None, exclude_self: bool, where: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of rows and one of queries: places of queries and rows, their cosine, and whether it is null: all pairs that rounding to six places may leave among a query's k best."""
    d = pc.max(pc.list_value_length(q["qv"])).as_py() or 1
    (v, no_v), (u, no_u) = matrix(x["v"], d), matrix(q["qv"], d)
    n, m = (pc.fill_null(t, float("nan")).to_numpy() for t in (x["norm"], q["qnorm"]))
    ids, asked = x[item].to_numpy(), q["qid"].to_numpy()
    if exclude_self:
        kind = q["qid"].type
        own = pc.index_in(q["qid"], pc.unique(x[item].cast(kind))).combine_chunks()
        own, codes = pc.fill_null(own, -1).to_numpy(), pc.index_in(x[item].cast(kind), pc.unique(x[item].cast(kind))).combine_chunks().to_numpy()
    out = []
    for i in range(0, len(u), 256):
        to = slice(i, i + 256)
        with np.errstate(all="ignore"):
            sims = (u[to] @ v.T) / (m[to, None] * n[None, :])
        free = np.ones(sims.shape, bool)
        if exclude_self:
            free &= own[to, None] != codes[None, :]
        if where is not None:
            free &= where(asked[to, None], ids[None, :])
        told = free & ~no_u[to, None] & ~no_v[None, :]
        sims = np.where(told, sims, -np.inf)  # not a number counts as more than any number, here and in Spark
        floor = np.full(len(sims), -np.inf if least is None else least - 2e-6)
        if sims.shape[1] > k:
            floor = np.fmax(floor, np.nan_to_num(np.partition(sims, -k, axis=1)[:, -k], nan=np.inf, posinf=np.inf, neginf=-np.inf) - 2e-6)
        row, col = np.nonzero(told & ~(sims < floor[:, None]))
        with np.errstate(all="ignore"):
            sim = _dots(u[to][row], v[col]) / (n[col] * m[to][row])
        null = np.zeros(len(row), bool)
        if least is None and (no_u.any() or no_v.any()):
            r, c = np.nonzero(free & ~told)
            row, col, sim, null = np.r_[row, r], np.r_[col, c], np.r_[sim, np.zeros(len(r))], np.r_[null, np.ones(len(r), bool)]
        # Of equal cosines the first k by item are enough.
        order = np.lexsort((col, -sim, null, row))
        row, col, sim, null = row[order], col[order], sim[order], null[order]
        same = np.r_[False, (row[1:] == row[:-1]) & ((sim[1:] == sim[:-1]) | (np.isnan(sim[1:]) & np.isnan(sim[:-1]))) & (null[1:] == null[:-1])]
        at = np.arange(len(row))
        kept = at - np.maximum.accumulate(np.where(same, 0, at)) < k
        out.append((row[kept] + i, col[kept], sim[kept], null[kept]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def block_sims(corpus: DataFrame, queries: DataFrame, k: int, item: str, scope: str | None = None, min_similarity: float | None = None, exclude_self: bool = False, where: Callable | None = None) -> DataFrame:
    """(scope,) qid, item, sim: pairs of queries (qid, qv, qnorm) and rows (item, v, norm; of one scope, if given) with at least the k best of each query.

    Rows meet queries in blocks of ROWS and QUERIES, a task each, as a product of two matrices. A block gives what rounding may
    leave among a query's k best in it, with cosines that are summed as Spark would, so that results don't hang on the matrix library.
    """
    name = scope or "_scope"
    x, q = corpus.select(*([scope] if scope else []), item, "v", "norm"), queries.select(*([scope] if scope else []), "qid", "qv", "qnorm")
    slices = lambda n: F.greatest(F.ceil(n / ROWS), F.least(F.lit(SPREAD), F.ceil(n / LEAST))).cast("int")
    if scope is None:
        counts = x.agg(slices(F.count(F.lit(1))).alias("slices")), q.agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        s, p = (max(1, c.first()[0]) for c in counts)
        x, q = (t.withColumn("_scope", F.lit(0)).withColumn("slices", F.lit(s)).withColumn("parts", F.lit(p)) for t in (x, q))
    else:
        counts = x.groupBy(scope).agg(slices(F.count(F.lit(1))).alias("slices")).join(q.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")), scope)
        counts = cut(counts)
        counts = F.broadcast(counts) if counts.count() <= BROADCAST_SCOPES else counts.hint("merge")
        x, q = x.join(counts, scope), q.join(counts, scope)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = x.withColumn("slice", F.pmod(F.xxhash64(item), F.col("slices")).cast("int")).withColumn("part", every("parts")).drop("slices", "parts")
    right = q.withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).withColumn("slice", every("slices")).drop("slices", "parts")
    right = right.withColumnsRenamed({name: "_of", "slice": "_slice", "part": "_part"})
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({name: x[name][:0], "qid": q["qid"][:0], item: x[item][:0], "sim": pa.array([], pa.float64())})
        x = x.sort_by(item)
        row, col, sim, null = _block_best(x, q, item, k, min_similarity, exclude_self, where)
        return pa.table({name: x[name].take(col), "qid": q["qid"].take(row), item: x[item].take(col), "sim": pa.array(sim, mask=null)})

    found = left.groupBy(name, "slice", "part").cogroup(right.groupBy("_of", "_slice", "_part")).applyInArrow(meet, f"{name} {kinds[name]}, qid {kinds['qid']}, {item} {kinds[item]}, sim double")
    return found.select(*([scope] if scope else []), "qid", item, F.round("sim", 6).alias("sim"))


def knn(corpus: DataFrame, queries: DataFrame, k: int, item: str, min_similarity: float | None = None, exclude_self: bool = False, where: Callable | None = None) -> DataFrame:
    """qid, item, sim, rank: exact cosine top-k of each query (qid, qv, qnorm) over the corpus (item, v, norm), by blocks (see block_sims).

    where: a condition on arrays of qid and item (Numpy's) that holds before ranking.
    """
    sims = block_sims(corpus, queries, k, item, None, min_similarity, exclude_self, where)
    return _first(sims if min_similarity is None else sims.where(F.col("sim") >= min_similarity), k, item)


def _products(corpus: DataFrame, queries: DataFrame, on: list[str], item: str) -> DataFrame:
    """qid, item, sim of the rows and queries that meet on the given columns."""
    return corpus.join(queries, on).select("qid", item, F.round(dot(F.col("v"), F.col("qv")) / (F.col("norm") * F.col("qnorm")), 6).alias("sim"))


def _first(sims: DataFrame, k: int, item: str) -> DataFrame:
    return sims.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), item)).cast("long")).where(F.col("rank") <= k)


class Cells:
    """A corpus (scope, item, v, norm) in cells: each row goes to the nearest of its scope's pivots, about the root of its size in number.

    A row is within its cell's radius of the pivot, so by the Cauchy-Schwarz inequality its cosine with a query is at most the
    pivot's plus the radius. A query first takes the nearest cells that hold k rows; then those cells alone whose
    bound reaches the k-th similarity it has, or the least one that is asked for. members, cells: tables.
    """

    def __init__(self, corpus: DataFrame, item: str, scope: str = "conv", pivots: int = PIVOTS):
        unit = corpus.select(scope, item, "v", "norm", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
        n = F.least(F.lit(pivots), F.ceil(F.sqrt(F.count(F.lit(1)).over(W.partitionBy(scope)))))
        chosen = unit.withColumn("_n", F.row_number().over(W.partitionBy(scope).orderBy(F.xxhash64(item), item))).withColumn("_most", n).where(F.col("_n") <= F.col("_most"))
        chosen = cut(chosen.select(scope, F.col("_n").cast("long").alias("centre"), F.col("u").alias("c")))
        at = nearest_centre(unit.select(scope, item, F.col("u").alias("v")), chosen, scope, item)
        self.item, self.scope = item, scope
        self.members = cut(corpus.select(scope, item, "v", "norm").join(at.select(scope, item, F.col("centre").alias("cell"), "gap"), [scope, item]))
        sizes = self.members.groupBy(scope, "cell").agg(F.sqrt(F.max("gap")).alias("radius"), F.count(F.lit(1)).alias("n"))
        self.cells = cut(sizes.join(chosen.withColumnRenamed("centre", "cell"), [scope, "cell"]))

    def visits(self, queries: DataFrame, k: int, min_similarity: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(what each query finds in its nearest cells, those cells, the further cells that may hold more: qid, scope, cell)."""
        scope = self.scope
        near = queries.join(self.cells, scope).select("qid", scope, "cell", "n", "radius", (dot(F.col("c"), F.col("qv")) / F.col("qnorm")).alias("mid"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("qid").orderBy(F.desc("mid"), "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        near = cut(near.select("qid", scope, "cell", (F.col("mid") + F.col("radius") + 2e-6).alias("bound"), (before < k).alias("first")))
        members = self.members.select(scope, self.item, "cell", "v", "norm")
        found = cut(_first(_products(members, near.where("first").join(queries, ["qid", scope]), [scope, "cell"], self.item), k, self.item))
        kth = found.where(F.col("rank") == k).select("qid", F.col("sim").alias("kth"))
        least = F.greatest(F.coalesce("kth", F.lit(-2.0)), F.lit(-2.0 if min_similarity is None else min_similarity))
        more = near.where("NOT first").join(kth, "qid", "left").where(F.col("bound") >= least).select("qid", scope, "cell")
        return found, near.where("first").select("qid", scope, "cell"), more

    def knn(self, queries: DataFrame, k: int, min_similarity: float | None = None) -> DataFrame:
        """qid, item, sim, rank: exact cosine top-k of each query (qid, scope, qv, qnorm) over its scope."""
        found, _, more = self.visits(queries, k, min_similarity)
        rest = _products(self.members.select(self.scope, self.item, "cell", "v", "norm"), more.join(queries, ["qid", self.scope]), [self.scope, "cell"], self.item)
        sims = found.drop("rank").unionByName(rest)
        return _first(sims if min_similarity is None else sims.where(F.col("sim") >= min_similarity), k, self.item)

    def skipped(self, queries: DataFrame, k: int, min_similarity: float | None = None) -> float:
        """The share of the products of queries and rows that the bounds spare."""
        _, first, more = self.visits(queries, k, min_similarity)
        sizes = self.cells.select(self.scope, "cell", "n")
        total = lambda rows: rows.agg(F.sum("n")).first()[0] or 0
        whole = total(queries.join(sizes, self.scope))
        return 1 - total(first.unionByName(more).join(sizes, [self.scope, "cell"])) / whole if whole else 0.0


def knn_scoped(corpus: DataFrame, queries: DataFrame, k: int, item: str, scope: str = "conv", min_similarity: float | None = None, whole: int = WHOLE_SCOPE) -> DataFrame:
    """qid, item, sim, rank: exact cosine top-k of each query over the rows of its own scope (corpus: scope, item, v, norm; queries: qid, scope, qv, qnorm).

    A scope of up to `whole` rows is multiplied with its queries; a larger one goes into cells, most of which a query skips. Both ways give the same.
    """
    rows = corpus.select(scope, item, "v", "norm")
    large = cut(rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(scope))
    if large.isEmpty():
        sims = _products(rows, queries, [scope], item)
        return _first(sims if min_similarity is None else sims.where(F.col("sim") >= min_similarity), k, item)
    small, small_queries = rows.join(large, scope, "left_anti"), queries.join(large, scope, "left_anti")
    sims = _products(small, small_queries, [scope], item)
    near = _first(sims if min_similarity is None else sims.where(F.col("sim") >= min_similarity), k, item)
    return near.unionByName(Cells(rows.join(large, scope, "left_semi"), item, scope).knn(queries.join(large, scope, "left_semi"), k, min_similarity))


def update_versions(seeds: DataFrame, edges: DataFrame, scope: str = "conv") -> DataFrame:
    """qid, scope, node, ord: for each seed (qid, scope, node, ord) the events that update it, then those that it updates or contradicts, in the seeds' order."""
    newer = seeds.join(edges.where("edge_type = 'updates'").select(scope, F.col("dst").alias("node"), F.col("src").alias("to"), "adj_pos"), [scope, "node"]).withColumn("side", F.lit(0))
    older = seeds.join(edges.where("edge_type IN ('updates', 'contradicts')").select(scope, F.col("src").alias("node"), F.col("dst").alias("to"), "adj_pos"), [scope, "node"]).withColumn("side", F.lit(1))
    place = F.row_number().over(W.partitionBy("qid").orderBy("ord", "side", "adj_pos"))
    return newer.unionByName(older).select("qid", scope, F.col("to").alias("node"), place.cast("long").alias("ord"))


def entity_events(entities: DataFrame, participants: DataFrame, most: int = 8, scope: str = "conv") -> DataFrame:
    """qid, scope, node, ord: for each entity of a question (qid, scope, entity, n) the events that it takes part in, in their order (seq);
    of more than `most` those that are most similar to the question (sim), or of the latest anchors where sim is null.

    participants: qid, scope, member (lower case), node, seq, sim, anchor.
    """
    met = entities.withColumn("member", F.lower("entity")).join(participants, ["qid", scope, "member"])
    by = W.partitionBy("qid", "n")
    many = F.count(F.lit(1)).over(by) > most
    order = by.orderBy(F.desc_nulls_last(F.when(F.col("many"), F.col("sim"))), F.desc_nulls_last(F.when(F.col("many"), F.col("anchor"))), "seq")
    kept = met.withColumn("many", many).withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    return kept.select("qid", scope, "node", F.row_number().over(W.partitionBy("qid").orderBy("n", "i")).cast("long").alias("ord"))


def hierarchical_events(queries: DataFrame, topics: DataFrame, sessions: DataFrame, events: DataFrame, seen: DataFrame, n_topics: int = 2, n_sessions: int = 3, most: int = 20) -> DataFrame:
    """qid, event_id, ord: events of the nearest sessions in the nearest topics, in the sessions' order; those of `seen` (qid, event_id) don't count.

    topics: topic, v, norm; sessions: session, topic, v, norm; events: session, event_id, seq. knn() ranks topics, which need not be few.
    """
    top = knn(topics, queries, n_topics, "topic").select("qid", "topic")
    inner = block_sims(sessions, top.join(queries, "qid"), n_sessions, "session", "topic")
    near = _first(inner, n_sessions, "session").select("qid", "session", F.col("rank").alias("place"))
    new = near.join(events, "session").join(seen.select("qid", "event_id"), ["qid", "event_id"], "left_anti")
    order = F.row_number().over(W.partitionBy("qid").orderBy("place", "seq", "event_id"))
    return new.select("qid", "event_id", order.cast("long").alias("ord")).where(F.col("ord") <= most)


def first_seen(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order: distinct, but in a defined order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def union_ordered(channels: list[DataFrame], key: list[str], order: str = "ord") -> DataFrame:
    """Channels one after another (each with qid, key and ord), duplicates at their first place; place is dense per question, ties are in the order of the key."""
    both = None
    for i, c in enumerate(channels):
        c = c.select("qid", *key, order).withColumn("channel", F.lit(i))
        both = c if both is None else both.unionByName(c)
    out = first_seen(both, ["qid", *key], ["channel", order])
    return out.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("channel", order, *key)).cast("long"))


def capped_expansion(neighbours: DataFrame, cap: int, scope: str = "qid", size: str = "n_notes", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Neighbours are taken whole while fewer than `cap` notes came before them, so the last may overshoot."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(scope).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return neighbours.withColumn("before", before).where(F.col("before") < cap)


def nearest(points: DataFrame, centroids: DataFrame, item: str) -> DataFrame:
    """item, topic, sim: the centroid of the greatest cosine, the first one on a tie. Centroids: topic, cv, cnorm.

    Points meet the centroids in blocks of QUERY_BLOCK; up to BROADCAST_QUERIES of them (checked) are sent to all
    tasks, beyond that a block goes to the points' tasks by its number. The best of a block is found in its row.
    """
    n = centroids.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int")
    rows = centroids.groupBy(block.alias("block")).agg(F.collect_list(F.struct("topic", "cv", "cnorm")).alias("all"))
    rows = F.broadcast(rows) if n <= BROADCAST_QUERIES else rows
    pairs = points.select(item, "v", "norm", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(rows, "block")
    best = F.array_max(F.transform("all", lambda c: F.struct(F.round(dot(F.col("v"), c["cv"]) / (F.col("norm") * c["cnorm"]), 6).alias("sim"), (-c["topic"]).alias("neg"))))
    found = pairs.select(item, best.alias("best"))
    found = found if blocks == 1 else found.groupBy(item).agg(F.max("best").alias("best"))
    return found.select(item, (-F.col("best.neg")).alias("topic"), F.col("best.sim").alias("sim"))
