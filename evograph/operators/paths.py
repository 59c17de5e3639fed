"""Bounded path enumeration and scoring.

The search is a loop of one join per level over all questions at once. The fan-out rank is taken before a
level is kept, and the cap on paths holds per question: once it is reached, deeper levels add nothing.
Order is explicit throughout: (depth, parent's rank, neighbour's rank). The adjacency and each level are
written to the shared folder, so that no level's plan holds those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.shared import cut

#: Fan-out and hops by kind of node, and the weights of a path's score.
LIMITS = {"event": (5, None), "session": (3, 1), "topic": (2, 1)}
WEIGHTS = {"neural": 0.4, "conf": 0.3, "temporal": 0.15, "update": 0.15}
#: What a link counts in a path's confidence, by what an edge of a type is multiplied, and a contradiction's share.
LINKS = {"belongs_to": 0.7, "contains": 0.7, "belongs_to_topic": 0.5, "topic_contains": 0.5}
DISCOUNTS, CONTRADICTED = {"enables": 0.5}, 0.5
#: Direct evidence: how many events, from what similarity on, and what that counts in a score.
DIRECT, DIRECT_MIN, DIRECT_SHARE = 3, 0.45, 0.9
#: Characters of a session's summary that a path keeps, and that its explanation shows.
SUMMARY, SNIPPET = 200, 80


def adjacency(edges: DataFrame, scope: str = "conv") -> DataFrame:
    """Neighbours of each node in order: successors, then predecessors, with a label for the direction walked.

    walked: the confidence of the edge in the direction walked, if there is one (valid or not), else of the one walked against.
    """
    live = "t_invalid_at" if "t_invalid_at" in edges.columns else None
    alive = F.col(live).isNull() if live else F.lit(True)
    flip = F.when(F.col("edge_type") == "temporal_before", "temporal_after").when(F.col("edge_type") == "temporal_after", "temporal_before").otherwise(F.col("edge_type"))
    side = lambda node, to, label, n: F.struct(F.col(node).alias("node"), F.col(to).alias("next"), label.alias("label"), F.lit(n).alias("side"))
    both = edges.select(scope, F.explode(F.array(side("src", "dst", F.col("edge_type"), 0), side("dst", "src", flip, 1))).alias("x"), "edge_type", "confidence", "adj_pos", alive.alias("_alive"))
    forward = F.max(F.when(F.col("side") == 0, F.col("confidence"))).over(W.partitionBy(scope, "node", "next"))
    return both.select(scope, "x.*", "edge_type", "confidence", "adj_pos", "_alive").withColumn("walked", F.coalesce(forward, "confidence")).where("_alive").drop("_alive")


def _lists(adj: DataFrame, fan: int, depth: int, scope: str) -> DataFrame:
    """scope, node, degree, near, strong: each node's first neighbours, in adjacency order and by strength.

    A path rules out at most the `depth` nodes before its end (of each, at most two entries, one a direction), so a
    node that has more than fan + 2 * depth entries is over its limit whatever the path, and takes its neighbours from the
    first fan + 2 * depth by strength. A node of fewer has them all in both lists. So a hub costs a path a short list.
    """
    most = fan + 2 * depth
    strength = (F.desc(F.col("edge_type").isin("updates", "contradicts").cast("int")), F.desc("confidence"))
    by = W.partitionBy(scope, "node")
    entry = lambda n: F.struct(n, "next", "label", "next_kind", "walked")
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col(n) <= most, entry(n)))), lambda x: F.struct(x["next"].alias("next"), x["label"].alias("label"), x["next_kind"].alias("next_kind"), x["walked"].alias("walked")))
    rows = adj.withColumn("_near", F.row_number().over(by.orderBy("side", "adj_pos", "next"))).withColumn("_strong", F.row_number().over(by.orderBy(*strength, "side", "adj_pos", "next")))
    return rows.groupBy(scope, "node").agg(F.count(F.lit(1)).alias("degree"), listed("_near").alias("near"), listed("_strong").alias("strong"))


def bfs_paths(seeds: DataFrame, edges: DataFrame, kinds: DataFrame, max_depth: int = 3, max_paths: int = 30, limits: dict | None = None, scope: str = "conv") -> DataFrame:
    """Every prefix path from each seed in breadth-first order, at most max_paths a question.

    seeds: qid, scope, node, seed_rank; kinds: scope, node, kind. Gives qid, scope, path_rank, depth,
    nodes, labels, kinds (of the nodes), confs (of the edges as walked). A node of a path is not entered
    again; both edges of a star count as neighbours.
    """
    limits = LIMITS if limits is None else limits
    adj = cut(_lists(adjacency(edges, scope).join(kinds.select(scope, F.col("node").alias("next"), F.col("kind").alias("next_kind")), [scope, "next"]), max(x[0] for x in limits.values()), max_depth, scope))
    level = seeds.join(kinds, [scope, "node"]).where("kind = 'event'").select(
        "qid", scope, F.col("seed_rank").cast("long").alias("rank"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("labels"), F.array("kind").alias("kinds"), F.array().cast("array<double>").alias("confs"), F.col("node").alias("at"), "kind", F.lit(0).alias("ses"), F.lit(0).alias("top")
    )
    fan = lambda i: F.when(F.col("kind") == "session", limits["session"][i]).when(F.col("kind") == "topic", limits["topic"][i]).otherwise(limits["event"][i])
    out = None
    for depth in range(1, max_depth + 1):
        step = level.join(adj.withColumnRenamed("node", "at"), [scope, "at"])
        free = lambda list_: F.filter(list_, lambda x: ~F.array_contains("nodes", x["next"]))
        # Only a node over its limit has its neighbours sorted by strength; else they stay in adjacency order. A short list holds all neighbours.
        near = free(F.col("near"))
        over = F.when(F.col("degree") > F.size("near"), True).otherwise(F.size(near) > fan(0))
        taken = F.slice(F.when(over, free(F.col("strong"))).otherwise(near), 1, fan(0).cast("int"))
        step = step.select(*level.columns, F.posexplode(taken).alias("n", "x")).select(*level.columns, "n", "x.*")
        ses, top = F.col("ses") + (F.col("next_kind") == "session").cast("int"), F.col("top") + (F.col("next_kind") == "topic").cast("int")
        step = step.where((ses <= limits["session"][1]) & (top <= limits["topic"][1]))
        ranked = F.row_number().over(W.partitionBy("qid").orderBy("rank", "n"))
        level = step.select(
            "qid", scope, ranked.cast("long").alias("rank"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("labels", F.array("label")).alias("labels"), F.concat("kinds", F.array("next_kind")).alias("kinds"),
            F.concat("confs", F.array(F.col("walked").cast("double"))).alias("confs"), F.col("next").alias("at"), F.col("next_kind").alias("kind"), ses.alias("ses"), top.alias("top"),
        ).where(F.col("rank") <= max_paths)
        level = cut(level)
        found = level.select("qid", scope, F.lit(depth).alias("depth"), "rank", "nodes", "labels", "kinds", "confs")
        out = found if out is None else out.unionByName(found)
    final = F.row_number().over(W.partitionBy("qid").orderBy("depth", "rank"))
    return out.select("qid", scope, final.cast("long").alias("path_rank"), "depth", "nodes", "labels", "kinds", "confs").where(F.col("path_rank") <= max_paths)


def double_contradiction(labels):
    """Do two neighbouring edges of a path both contradict?"""
    n = F.size(labels)
    return F.when(n < 2, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.element_at(labels, i) == "contradicts") & (F.get(labels, i) == "contradicts")))


def score(neural, conf, temporal, update, weights: dict | None = None):
    w = WEIGHTS if weights is None else weights
    return w["neural"] * neural + w["conf"] * conf + w["temporal"] * temporal + w["update"] * update


def path_confidence(confs: Column, labels: Column) -> Column:
    """The product of the walked edges' confidences, links and discounts by their labels, halved if any edge contradicts."""

    def step(c: Column, label: Column) -> Column:
        out = c
        for t, x in DISCOUNTS.items():
            out = F.when(label == t, c * x).otherwise(out)
        for t, x in LINKS.items():
            out = F.when(label == t, F.lit(x)).otherwise(out)
        return out

    product = F.aggregate(F.zip_with(confs, labels, step), F.lit(1.0), lambda a, x: a * x)
    return F.when(F.array_contains(labels, "contradicts"), product * CONTRADICTED).otherwise(product)


def in_order(days: Column, labels: Column, kinds: Column) -> Column:
    """Do no temporal edges between two events with readable dates run against those dates? (days, kinds: of the nodes)"""

    def wrong(label: Column, i: Column) -> Column:
        a, b = F.get(days, i), F.get(days, i + 1)
        events = (F.get(kinds, i) == "event") & (F.get(kinds, i + 1) == "event")
        return events & F.coalesce(((label == "temporal_before") & (a > b)) | ((label == "temporal_after") & (a < b)), F.lit(False))

    return ~F.exists(F.transform(labels, wrong), lambda x: x)


def link_types(labels: Column, kinds: Column) -> Column:
    """What a path's edges are called where it is shown: links to sessions and topics by their kind, others by their label."""
    kind = lambda i: F.get(kinds, i)
    link = lambda k: F.when(k == "topic", "topic_link").when(k == "session", "session_link")
    return F.transform(labels, lambda t, i: F.coalesce(link(kind(i)), link(kind(i + 1)), t))


def with_nodes(found: DataFrame, nodes: DataFrame, scope: str = "conv") -> DataFrame:
    """found with `steps`: for each node of a path, in order, the columns of nodes (scope, node, ...); null for a node that nodes lacks."""
    own = [c for c in nodes.columns if c not in (scope, "node")]
    long = found.select("qid", scope, "path_rank", F.posexplode("nodes").alias("i", "node")).join(nodes.withColumn("known", F.lit(True)), [scope, "node"], "left")
    steps = long.groupBy("qid", "path_rank").agg(F.array_sort(F.collect_list(F.struct("i", "node", "known", *own))).alias("steps"))  # at most max_depth + 1 rows a path
    return found.join(steps, ["qid", "path_rank"])


def score_paths(found: DataFrame, nodes: DataFrame, sims: DataFrame | None = None, scope: str = "conv", aggregator: str = "mean", weights: dict | None = None) -> DataFrame:
    """The paths that survive pruning, with neural, conf, temporal, upd, score and steps.

    found: of bfs_paths; nodes: scope, node, day (of the event's anchor), update_val, and what is to be shown;
    sims: qid, node, sim (the greatest cosine of an event's notes to the question). Paths whose temporal edges run
    against their events' dates, with two contradictions in a row, or with an unknown event are dropped.
    """
    rows = with_nodes(found, nodes, scope)
    if sims is None:
        rows = rows.withColumn("neural", F.lit(0.0))
    else:
        long = found.select("qid", "path_rank", F.explode(F.filter(F.arrays_zip("nodes", "kinds"), lambda x: x["kinds"] == "event")["nodes"]).alias("node"))
        best = F.max("sim") if aggregator == "max" else F.avg("sim")
        near = long.join(sims.where("sim > 0").select("qid", "node", "sim"), ["qid", "node"]).groupBy("qid", "path_rank").agg(best.alias("neural"))
        rows = rows.join(near, ["qid", "path_rank"], "left").withColumn("neural", F.coalesce("neural", F.lit(0.0)))
    known = F.forall(F.arrays_zip("kinds", F.col("steps")["known"].alias("known")), lambda x: (x["kinds"] != "event") | F.coalesce(x["known"], F.lit(False)))
    temporal = in_order(F.col("steps")["day"], F.col("labels"), F.col("kinds"))
    kept = rows.where(temporal & ~double_contradiction(F.col("labels")) & known)
    upd = F.least(F.lit(1.0), F.coalesce(F.array_min(F.col("steps")["update_val"]), F.lit(1.0)))
    kept = kept.withColumn("conf", path_confidence(F.col("confs"), F.col("labels"))).withColumn("temporal", F.lit(1.0)).withColumn("upd", upd)
    return kept.withColumn("score", score(F.col("neural"), F.col("conf"), F.col("temporal"), F.col("upd"), weights))


def direct_evidence(event_sims: DataFrame, covered: DataFrame, most: int = DIRECT, least: float = DIRECT_MIN) -> DataFrame:
    """qid, node, sim, score, ord: each question's most similar events that neither its paths nor its seeds have (covered: qid, node)."""
    free = event_sims.where(F.col("sim") >= least).join(covered.select("qid", "node").distinct(), ["qid", "node"], "left_anti")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "node"))
    return free.withColumn("ord", place.cast("long")).where(F.col("ord") <= most).select("qid", "node", "sim", (F.col("sim") * DIRECT_SHARE).alias("score"), "ord")


def merge_direct(scored: DataFrame, direct: DataFrame, top_k: int) -> DataFrame:
    """The best paths, with room left for direct evidence: first max(1, top_k - n) paths, then the n direct ones. Both: qid, score, ord."""
    n = direct.groupBy("qid").agg(F.count(F.lit(1)).alias("n_direct"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "ord")
    ranked = scored.withColumn("r", F.row_number().over(w)).join(n, "qid", "left")
    room = F.when(F.col("n_direct").isNull(), top_k).otherwise(F.greatest(F.lit(1), F.lit(top_k) - F.col("n_direct")))
    kept = ranked.where(F.col("r") <= room).select(*scored.columns, F.lit("path").alias("origin"), F.lit(0).alias("part"))
    both = kept.unionByName(direct.select(*scored.columns, F.lit("direct").alias("origin"), F.lit(1).alias("part")))
    place = F.row_number().over(W.partitionBy("qid").orderBy("part", F.desc("score"), "ord"))
    return both.withColumn("place", place.cast("long")).drop("part")


# How paths are shown. steps: structs with kind, state_change, time_anchor, event_type, update_val, and text (a session's summary, a topic's label).


def _events(steps: Column) -> Column:
    return F.filter(steps, lambda x: x["kind"] == "event")


def _summaries(steps: Column) -> Column:
    """What a path's sessions and topics say, in order: a summary's beginning, or a topic's label in brackets; none for an empty one."""
    said = F.filter(steps, lambda x: (x["kind"] != "event") & (F.coalesce(x["text"], F.lit("")) != ""))
    return F.transform(said, lambda x: F.when(x["kind"] == "topic", F.concat(F.lit("[Topic: "), x["text"], F.lit("]"))).otherwise(F.substring(x["text"], 1, SUMMARY)))


def explanation(steps: Column, types: Column, total: Column, neural: Column, conf: Column, temporal: Column, upd: Column, details: Column | None = None) -> Column:
    """A path's lines: each event, the link after it (a session's with its summary), a detail if given (by event), and the score with its parts."""

    def line(e: Column, i: Column) -> Column:
        said = F.concat(F.lit("E"), i + 1, F.lit(" ("), e["state_change"], F.lit(", "), e["time_anchor"], F.lit(", "), e["event_type"], F.lit(")"))
        if details is not None:
            more = F.get(details, i)
            said = F.concat(said, F.when(F.coalesce(more, F.lit("")) == "", "").otherwise(F.concat(F.lit('\n  [Detail: "'), more, F.lit('"]'))))
        at = F.get(types, i)
        before = F.size(F.filter(F.slice(types, 1, i), lambda t: t == "session_link"))
        snippet = F.when(at == "session_link", F.get(_summaries(steps), before))
        link = F.when(snippet.isNotNull(), F.concat(F.lit('\n  ==[Session: "'), F.substring(snippet, 1, SNIPPET), F.lit('..."]==>'))).when(at.isNotNull(), F.concat(F.lit("\n  --["), at, F.lit("]-->"))).otherwise("")
        return F.concat(said, link)

    two = lambda c: F.format_string("%.2f", c)
    foot = F.concat(F.lit("Score: "), two(total), F.lit(" (neural="), two(neural), F.lit(", conf="), two(conf), F.lit(", temporal="), F.format_string("%.0f", temporal), F.lit(", update="), F.format_string("%.1f", upd), F.lit(")"))
    return F.concat(F.array_join(F.transform(_events(steps), line), "\n"), F.lit("\n"), foot)


def direct_explanation(event: Column, sim: Column) -> Column:
    return F.concat(F.lit("[Direct Evidence] "), event["state_change"], F.lit(" ("), event["time_anchor"], F.lit(", "), event["event_type"], F.lit(")\nScore: "), F.format_string("%.2f", sim), F.lit(" (direct match)"))


def summary_line(steps: Column, types: Column, seen: Column | None = None) -> Column:
    """A path in a line; superseded events are marked. seen: ids of events (as text) that an earlier path has shown: those become a reference."""
    mark = lambda e: F.when(e["update_val"] == 0.0, " [OUTDATED]").when(e["update_val"] == 0.5, " [PARTIALLY UPDATED]").otherwise("")

    def piece(e: Column, i: Column) -> Column:
        full = F.concat(e["state_change"], mark(e), F.lit(" ("), e["time_anchor"], F.lit(")"))
        if seen is not None:
            name = e["node"].cast("string")
            full = F.when(F.array_contains(seen, name), F.concat(F.lit("[event "), name, F.lit(": see above]"))).otherwise(full)
        at = F.get(types, i)
        return F.concat(full, F.when(at.isNull(), "").otherwise(F.concat(F.lit(" --["), at, F.lit("]--> "))))

    return F.array_join(F.transform(_events(steps), piece), "")
