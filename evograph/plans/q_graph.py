"""Graph queries: upserts, stars, path search and scoring, validity."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.vector import clamp, cosine
from evograph.operators import graph, paths, retrieval, validity
from evograph.plans import views as V
from evograph.plans.views import with_views
from evograph.shared import cut

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Writes of edges: an event towards the earlier ones of its user, in rounds, so that pairs are written again.
_WRITES = """writes AS (SELECT conv, u AS src, k AS dst, event_seq AS edge_seq, kind AS edge_type, least(greatest(value / 100.0, 0), 1) AS confidence FROM ev)"""


@query("edge_upsert", with_views("ev", "SELECT conv, src, dst, min(edge_seq) AS adj_pos, arg_max(edge_type, edge_seq) AS edge_type, round(arg_max(confidence, edge_seq), 6) AS confidence FROM writes GROUP BY 1, 2, 3", _WRITES))
def edge_upsert(spark, sf):
    ev = V.events(spark, sf)
    writes = ev.select("conv", F.col("u").alias("src"), F.col("k").alias("dst"), F.col("event_seq").alias("edge_seq"), F.col("kind").alias("edge_type"), clamp(F.col("value") / 100.0).alias("confidence"))
    return graph.upsert_edges(writes).select("conv", "src", "dst", "adj_pos", "edge_type", F.round("confidence", 6).alias("confidence"))


_STAR = """star AS (SELECT e.conv, 'e' || e.event_id AS src, s.session_id AS dst, 'belongs_to' AS edge_type FROM evs e JOIN sess s USING (conv, session_num)
  UNION ALL SELECT e.conv, s.session_id, 'e' || e.event_id, 'contains' FROM evs e JOIN sess s USING (conv, session_num)
  UNION ALL SELECT conv, session_id, 'topic_' || conv || '_' || topic_num, 'belongs_to_topic' FROM sess
  UNION ALL SELECT conv, 'topic_' || conv || '_' || topic_num, session_id, 'topic_contains' FROM sess)"""


def _star(spark, sf):
    s = V.sessions(spark, sf)
    ev = V.events(spark, sf).join(s.select("conv", "event_date", "session_id"), ["conv", "event_date"]).select("conv", F.concat(F.lit("e"), "event_id").alias("node"), "session_id")
    topics = s.select("conv", "session_id", F.concat_ws("_", F.lit("topic"), "conv", "topic_num").alias("topic_id"))
    return graph.star(ev, "node", "session_id", "belongs_to", "contains").unionByName(graph.star(topics, "session_id", "topic_id", "belongs_to_topic", "topic_contains"))


@query("star_expansion", with_views("evs sess", "SELECT conv, src, dst, edge_type, 1.0::DOUBLE AS confidence FROM star", _STAR))
def star_expansion(spark, sf):
    return _star(spark, sf)


def _edges(spark, sf):
    """Typed edges between events, with their place in adjacency order: supersessions and the chain of a user's events."""
    sup = V.supersessions(spark, sf).select("conv", "src", "dst", "edge_type", "confidence")
    ev = V.events(spark, sf)
    prev = F.lag("event_id").over(W.partitionBy("u").orderBy("event_seq"))
    chain = ev.select("conv", prev.alias("src"), F.col("event_id").alias("dst"), F.lit("temporal_before").alias("edge_type"), F.lit(1.0).alias("confidence")).where("src IS NOT NULL")
    both = sup.withColumn("part", F.lit(0)).unionByName(chain.withColumn("part", F.lit(1)))
    # An ordered pair has one edge; ids and the part give every edge a place of its own without a global sort.
    return both.groupBy("conv", "src", "dst").agg(F.max_by(F.struct("edge_type", "confidence"), "part").alias("x"), F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).alias("adj_pos")).select("conv", "src", "dst", "x.edge_type", "x.confidence", "adj_pos")


_EDGES = """chain AS (SELECT * FROM (SELECT conv, lag(event_id) OVER (PARTITION BY u ORDER BY event_seq) AS src, event_id AS dst, 'temporal_before' AS edge_type, 1.0 AS confidence FROM ev) WHERE src IS NOT NULL),
  alledges AS (SELECT conv, src, dst, edge_type, confidence::DOUBLE AS confidence, 0 AS part FROM sup UNION ALL SELECT conv, src, dst, edge_type, confidence::DOUBLE, 1 FROM chain),
  edges AS MATERIALIZED (SELECT conv, src, dst, arg_max(edge_type, part) AS edge_type, arg_max(confidence, part) AS confidence, {'a': least(src, dst), 'b': greatest(src, dst)} AS adj_pos FROM alledges GROUP BY 1, 2, 3),
  adj AS (SELECT conv, src AS node, dst AS next, edge_type AS label, edge_type, confidence, 0 AS side, adj_pos FROM edges UNION ALL
    SELECT conv, dst, src, CASE WHEN edge_type = 'temporal_before' THEN 'temporal_after' ELSE edge_type END, edge_type, confidence, 1, adj_pos FROM edges),
  l0 AS (SELECT u AS qid, conv, row_number() OVER (PARTITION BY u ORDER BY event_id DESC) AS rank, [event_id] AS nodes, []::VARCHAR[] AS labels, event_id AS at FROM ev QUALIFY rank <= 2)"""


def _level(i: int, cap: int) -> str:
    return f"""j{i} AS (SELECT l.qid, l.conv, l.rank, l.nodes, l.labels, a.*, count(*) OVER (PARTITION BY l.qid, l.rank) > 5 AS over FROM l{i - 1} l JOIN adj a ON a.conv = l.conv AND a.node = l.at WHERE NOT list_contains(l.nodes, a.next)),
  r{i} AS (SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY CASE WHEN over THEN (edge_type IN ('updates', 'contradicts'))::INT ELSE 0 END DESC, CASE WHEN over THEN confidence ELSE 0 END DESC, side, adj_pos, next) AS n FROM j{i}),
  l{i} AS (SELECT qid, conv, row_number() OVER (PARTITION BY qid ORDER BY rank, n) AS rank, list_append(nodes, next) AS nodes, list_append(labels, label) AS labels, next AS at FROM r{i} WHERE n <= 5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, n) <= {cap})"""


def _bfs_sql(depth: int, cap: int) -> str:
    levels = ", ".join(_level(i, cap) for i in range(1, depth + 1))
    union = " UNION ALL ".join(f"SELECT qid, {i} AS depth, rank, nodes, labels FROM l{i}" for i in range(1, depth + 1))
    return f"{_EDGES}, {levels}, found AS MATERIALIZED (SELECT qid, depth, nodes, labels, row_number() OVER (PARTITION BY qid ORDER BY depth, rank) AS path_rank FROM ({union}) QUALIFY path_rank <= {cap})"


def _seeds(spark, sf):
    """A question for each user, with the user's two latest events as seeds."""
    last = F.row_number().over(W.partitionBy("u").orderBy(F.desc("event_id")))
    return V.events(spark, sf).withColumn("seed_rank", last).where("seed_rank <= 2").select(F.col("u").alias("qid"), "conv", F.col("event_id").alias("node"), "seed_rank")


def _bfs(spark, sf, depth, cap):
    kinds = V.events(spark, sf).select("conv", F.col("event_id").alias("node"), F.lit("event").alias("kind"))
    return paths.bfs_paths(_seeds(spark, sf), _edges(spark, sf), kinds, depth, cap)


_SHOW = "SELECT qid, depth, path_rank, array_to_string(nodes, ',') AS nodes, array_to_string(labels, ',') AS labels FROM found"


def _shown(found):
    return found.select("qid", F.col("depth").cast("int").alias("depth"), "path_rank", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), F.array_join("labels", ",").alias("labels"))


@query("bfs_depth2", with_views("ev sup", _SHOW, _bfs_sql(2, 30)))
def bfs_depth2(spark, sf):
    return _shown(_bfs(spark, sf, 2, 30))


@query("bfs_depth3", with_views("ev sup", _SHOW, _bfs_sql(3, 50)))
def bfs_depth3(spark, sf):
    return _shown(_bfs(spark, sf, 3, 50))


@query("double_contradiction_prune", with_views("ev sup", "SELECT qid, path_rank FROM found WHERE NOT contains(',' || array_to_string(labels, ',') || ',', ',contradicts,contradicts,')", _bfs_sql(3, 50)))
def double_contradiction_prune(spark, sf):
    return _bfs(spark, sf, 3, 50).where(~paths.double_contradiction(F.col("labels"))).select("qid", "path_rank")


_UPD = "hit AS (SELECT conv, dst, arg_min(event_date, src) AS anchor FROM sup WHERE edge_type = 'updates' GROUP BY 1, 2), causal AS (SELECT conv, src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 'causes' ELSE 'enables' END AS edge_type FROM chain0), chain0 AS (SELECT * FROM (SELECT conv, lag(event_id) OVER (PARTITION BY u ORDER BY event_seq) AS src, event_id AS dst FROM ev) WHERE src IS NOT NULL)"


def _causal(spark, sf):
    prev = F.lag("event_id").over(W.partitionBy("u").orderBy("event_seq"))
    kind = F.when((F.col("src") + F.col("dst")) % 2 == 0, "causes").otherwise("enables")
    return V.events(spark, sf).select("conv", prev.alias("src"), F.col("event_id").alias("dst")).where("src IS NOT NULL").withColumn("edge_type", kind).withColumn("t_invalid_at", F.lit(None).cast("date"))


def _propagated(spark, sf):
    ev = V.events(spark, sf).select("conv", "event_id", F.lit(None).cast("date").alias("valid_until"), F.lit(1.0).alias("update_val"))
    updates = V.supersessions(spark, sf).where("edge_type = 'updates'").select("conv", "src", "dst", F.col("event_date").alias("anchor"))
    return validity.propagate_updates(ev, _causal(spark, sf), updates)


_UPD = _UPD.split(", chain0 AS")
_UPD = "chain0 AS" + _UPD[1] + ", " + _UPD[0]


# Event e has the vector and the notes of number e mod the number of vectors, and so has a question.
_SCORED = """nvec AS (SELECT count(*) AS n FROM vec),
  soft AS (SELECT DISTINCT c.dst AS event_id FROM causal c JOIN hit g ON g.dst = c.src),
  val AS (SELECT e.event_id, e.event_date, CASE WHEN h.dst IS NOT NULL THEN 0.0 WHEN s.event_id IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS update_val FROM ev e LEFT JOIN hit h ON h.dst = e.event_id LEFT JOIN soft s ON s.event_id = e.event_id),
  step AS (SELECT qid, path_rank, labels, labels[i] AS label, nodes[i] AS a, nodes[i + 1] AS b FROM (SELECT qid, path_rank, nodes, labels, unnest(range(1, len(nodes))) AS i FROM found)),
  along AS (SELECT t.qid, t.path_rank, product(coalesce(x.confidence, y.confidence) * CASE WHEN label = 'enables' THEN 0.5 ELSE 1 END) * CASE WHEN list_contains(any_value(labels), 'contradicts') THEN 0.5 ELSE 1 END AS conf,
    bool_and(NOT ((label = 'temporal_before' AND da.event_date > db.event_date) OR (label = 'temporal_after' AND da.event_date < db.event_date))) AS in_order
    FROM step t LEFT JOIN edges x ON x.src = t.a AND x.dst = t.b LEFT JOIN edges y ON y.src = t.b AND y.dst = t.a JOIN ev da ON da.event_id = t.a JOIN ev db ON db.event_id = t.b GROUP BY 1, 2),
  member AS (SELECT qid, path_rank, unnest(nodes) AS event_id FROM found),
  msim AS (SELECT p.qid, p.event_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM (SELECT m.qid, m.event_id, m.qid % n AS i, m.event_id % n AS j FROM (SELECT DISTINCT qid, event_id FROM member) m CROSS JOIN nvec) p JOIN vec a ON a.vec_id = p.i JOIN vec b ON b.vec_id = p.j),
  per AS (SELECT m.qid, m.path_rank, min(v.update_val) AS upd, coalesce(avg(s.sim) FILTER (s.sim > 0), 0) AS neural FROM member m JOIN val v USING (event_id) JOIN msim s USING (qid, event_id) GROUP BY 1, 2),
  scored AS (SELECT f.qid, f.path_rank, f.nodes, round(0.4 * per.neural + 0.3 * along.conf + 0.15 + 0.15 * per.upd, 6) AS score FROM found f JOIN along USING (qid, path_rank) JOIN per USING (qid, path_rank)
    WHERE along.in_order AND NOT contains(',' || array_to_string(f.labels, ',') || ',', ',contradicts,contradicts,'))"""


def _event_nodes(spark, sf):
    """conv, node, kind, day, update_val of all events."""
    val = _propagated(spark, sf)[0].select("event_id", "update_val")
    return V.events(spark, sf).join(val, "event_id").select("conv", F.col("event_id").alias("node"), F.lit("event").alias("kind"), F.col("event_date").alias("day"), "update_val")


def _event_sims(spark, sf, pairs):
    """qid, node, sim for the given (qid, node) pairs."""
    vec = V.vectors(spark, sf)
    n = vec.count()
    side = lambda p: vec.select(F.col("vec_id").alias(f"{p}_id"), _narrow("v").alias(f"{p}_v"), F.col("norm").alias(f"{p}_n"))
    rows = pairs.select("qid", "node", (F.col("qid") % n).alias("q_id"), (F.col("node") % n).alias("e_id")).join(side("q"), "q_id").join(side("e"), "e_id")
    return rows.select("qid", "node", F.round(cosine(F.col("q_v").cast("array<double>"), F.col("e_v").cast("array<double>"), F.col("q_n"), F.col("e_n")), 6).alias("sim"))


def _narrow(v):
    """Vectors are stored as floats: as such they are moved in half the space, and nothing is lost."""
    return F.col(v).cast("array<float>")


def _nearest_events(spark, sf, questions, most, least):
    """qid, node, sim: at least the `most` nearest events of each question's conversation, from `least` on. An event's vector goes to its conversation once, not to each question."""
    vec = V.vectors(spark, sf)
    n = vec.count()
    narrow = vec.select("vec_id", _narrow("v").alias("v"), "norm")
    events = V.events(spark, sf).select("conv", F.col("event_id").alias("node"), (F.col("event_id") % n).alias("vec_id")).join(narrow, "vec_id")
    asked = questions.select("qid", "conv", (F.col("qid") % n).alias("vec_id")).join(narrow, "vec_id").select("qid", "conv", F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    return retrieval.block_sims(events, asked, most, "node", "conv", least).where(F.col("sim") >= least).select("qid", "node", "sim")


def _scored(spark, sf, depth, cap):
    found = cut(_bfs(spark, sf, depth, cap))
    pairs = found.select("qid", F.explode("nodes").alias("node")).distinct()
    return paths.score_paths(found, _event_nodes(spark, sf), _event_sims(spark, sf, pairs)).withColumn("score", F.round("score", 6))


@query("path_score", with_views("ev sup vec", "SELECT qid, path_rank, score FROM scored", _bfs_sql(2, 30) + ", " + _UPD + ", " + _SCORED))
def path_score(spark, sf):
    """Paths that survive pruning: similarity of the events' notes, confidence, order in time and validity, weighted."""
    return _scored(spark, sf, 2, 30).select("qid", "path_rank", "score")


@query(
    "evidence_paths",
    with_views(
        "ev sup vec",
        """SELECT qid, origin, nodes, score, row_number() OVER (PARTITION BY qid ORDER BY part, score DESC, ord) AS place FROM (
           SELECT b.qid, 'path' AS origin, 0 AS part, array_to_string(nodes, ',') AS nodes, score, path_rank AS ord FROM best b LEFT JOIN (SELECT qid, count(*) AS n FROM direct GROUP BY 1) d ON d.qid = b.qid WHERE r <= CASE WHEN n IS NULL THEN 10 ELSE greatest(1, 10 - n) END
           UNION ALL SELECT qid, 'direct', 1, event_id::VARCHAR, round(0.9 * sim, 6), ord FROM direct)""",
        _bfs_sql(3, 50) + ", " + _UPD + ", " + _SCORED + """,
  best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path_rank) AS r FROM scored),
  covered AS (SELECT l0.qid, l0.at AS event_id FROM l0 UNION SELECT qid, unnest(nodes) FROM scored),
  esim AS (SELECT p.qid, p.event_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM (SELECT q.qid, e.event_id, q.qid % n AS i, e.event_id % n AS j FROM (SELECT DISTINCT qid, conv FROM l0) q JOIN ev e ON e.conv = q.conv CROSS JOIN nvec) p JOIN vec a ON a.vec_id = p.i JOIN vec b ON b.vec_id = p.j),
  direct AS (SELECT * FROM (SELECT s.qid, s.event_id, s.sim, row_number() OVER (PARTITION BY s.qid ORDER BY s.sim DESC, s.event_id) AS ord FROM esim s ANTI JOIN covered c ON c.qid = s.qid AND c.event_id = s.event_id WHERE s.sim >= 0.2) WHERE ord <= 3)""",
    ),
)
def evidence_paths(spark, sf):
    """The best paths of each user's question, and the most similar events of the conversation that paths and seeds lack (here from 0.2 on)."""
    scored = cut(_scored(spark, sf, 3, 50))
    seeds = _seeds(spark, sf)
    covered = scored.select("qid", F.explode("nodes").alias("node")).unionByName(seeds.select("qid", "node"))
    known = 50 * 4 + 2  # events that a question's paths and seeds can cover
    near = _nearest_events(spark, sf, seeds.select("qid", "conv").distinct(), paths.DIRECT + known, 0.2)
    direct = paths.direct_evidence(near, covered, least=0.2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    a = scored.select("qid", text(F.col("nodes")).alias("nodes"), "score", F.col("path_rank").alias("ord"))
    b = direct.select("qid", F.col("node").cast("string").alias("nodes"), F.round("score", 6).alias("score"), "ord")
    return paths.merge_direct(a, b, 10).select("qid", "origin", "nodes", "score", "place")


@query("propagate_update", with_views("ev sup", "SELECT e.event_id, h.anchor AS valid_until, CASE WHEN h.dst IS NOT NULL THEN 0.0 WHEN EXISTS (SELECT 1 FROM causal c JOIN hit g ON g.dst = c.src WHERE c.dst = e.event_id) THEN 0.5 ELSE 1.0 END::DOUBLE AS update_val FROM ev e LEFT JOIN hit h ON h.dst = e.event_id", _UPD))
def propagate_update(spark, sf):
    return _propagated(spark, sf)[0].select("event_id", "valid_until", "update_val")


@query("invalidated_edges", with_views("ev sup", "SELECT c.src, c.dst, CASE WHEN c.edge_type = 'causes' THEN coalesce(a.anchor, b.anchor) END AS t_invalid_at FROM causal c LEFT JOIN hit a ON a.dst = c.src LEFT JOIN hit b ON b.dst = c.dst", _UPD))
def invalidated_edges(spark, sf):
    return _propagated(spark, sf)[1].select("src", "dst", "t_invalid_at")
