"""Joins: set similarity with caps, gates, alignment, seeds and expansion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.operators import graph, hierarchy, inject, overlap, retrieval
from evograph.plans import views as V
from evograph.plans.views import with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Jaccard of {u, k} sets: 1 if both agree, 1/3 if one does.
_PAIRS = """pairs AS (SELECT a.conv, a.event_id, b.event_id AS cand_id, CASE WHEN a.u = b.u AND a.k = b.k THEN 1.0 ELSE 1.0 / 3 END AS jaccard,
  a.session_num AS s1, b.session_num AS s2, a.topic_num AS t1, b.topic_num AS t2, a.event_date AS d1, b.event_date AS d2
  FROM evs a JOIN evs b ON a.conv = b.conv AND a.event_id <> b.event_id AND (a.u = b.u OR a.k = b.k))"""


def _top(where: str, k: int) -> str:
    return _PAIRS + f", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY jaccard DESC, cand_id) AS rank FROM pairs WHERE {where}) WHERE rank <= {k})"


@query("jaccard_topk", with_views("evs", "SELECT conv, event_id, cand_id, round(jaccard, 6)::DOUBLE AS jaccard, rank FROM top", _top("jaccard >= 0.3", 5)))
def jaccard_topk(spark, sf):
    top = overlap.overlap_topk(V.events(spark, sf), 0.3, 5)
    return top.select("conv", "event_id", "cand_id", F.round("jaccard", 6).alias("jaccard"), "rank")


_GONE = "gone AS (SELECT DISTINCT dst FROM sup WHERE edge_type = 'updates')"


@query("supersession_candidates", with_views("evs sup", "SELECT event_id, cand_id, rank FROM top WHERE cand_id NOT IN (SELECT dst FROM gone)", _top("jaccard >= 0.5 AND s1 <> s2", 10) + ", " + _GONE))
def supersession_candidates(spark, sf):
    """Candidates of other sessions, capped at 10 first; then those that are still valid."""
    ev = V.events_in_sessions(spark, sf)
    gone = V.supersessions(spark, sf).where("edge_type = 'updates'").select(F.col("dst").alias("cand_id")).distinct()
    top = overlap.overlap_topk(ev, 0.5, 10, group="session_num")
    return top.join(gone, "cand_id", "left_anti").select("event_id", "cand_id", "rank")


@query("support_candidates", with_views("evs", "SELECT event_id, cand_id, rank FROM top WHERE t1 = t2", _top("jaccard >= 0.3 AND s1 <> s2", 10)))
def support_candidates(spark, sf):
    """Capped first, then the gate: candidates of the same topic."""
    top = overlap.overlap_topk(V.events_in_sessions(spark, sf), 0.3, 10, group="session_num", keep=("topic_num",))
    return overlap.gated(top, "topic_num").select("event_id", "cand_id", "rank")


@query(
    "auto_temporal_edges",
    with_views("evs", "SELECT DISTINCT conv, CASE WHEN d2 < d1 THEN cand_id ELSE event_id END AS src, CASE WHEN d2 < d1 THEN event_id ELSE cand_id END AS dst, 'temporal_before' AS edge_type FROM top WHERE d1 <> d2 AND t1 = t2", _top("jaccard >= 0.3 AND s1 <> s2", 20)),
)
def auto_temporal_edges(spark, sf):
    """Candidates of other sessions, capped first; then the topic gate; then the order of the dates."""
    top = overlap.overlap_topk(V.events_in_sessions(spark, sf), 0.3, 20, group="session_num", keep=("event_date", "topic_num"))
    return overlap.temporal_edges(overlap.gated(top, "topic_num"), "event_date", "cand_event_date").select("conv", "src", "dst", "edge_type").distinct()


@query("topic_gated_pairs", with_views("evs", "SELECT conv, topic_num, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END)::BIGINT * sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END)::BIGINT AS pairs FROM evs GROUP BY 1, 2"))
def topic_gated_pairs(spark, sf):
    """How many (purchase, error) pairs the topic gate lets through: a product of counts, no pair is made."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return V.events_in_sessions(spark, sf).groupBy("conv", "topic_num").agg((of("purchase") * of("error")).alias("pairs"))


@query("session_window_pairs", with_views("sess", "SELECT a.conv, a.topic_num, a.session_id, b.session_id AS other FROM sess a JOIN sess b ON a.conv = b.conv AND a.topic_num = b.topic_num AND a.session_id <> b.session_id AND abs(a.session_num - b.session_num) <= 2"))
def session_window_pairs(spark, sf):
    return overlap.within_window(V.sessions(spark, sf), ["conv", "topic_num"], ["session_num"], 2, "session_id")


# Vectors stand for notes; event e belongs to vector e mod the number of vectors.
_KNN = """knn AS (SELECT * FROM (SELECT q.vec_id AS qid, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.vec_id) AS rank FROM vec q JOIN vec c ON q.vec_id % 50 = 0) WHERE rank <= 10),
  nvec AS (SELECT count(*) AS n FROM vec), seeds AS (SELECT k.qid, e.event_id, min((k.rank, e.event_id)) AS o FROM knn k, nvec JOIN ev e ON e.event_id % nvec.n = k.vec_id GROUP BY 1, 2)"""


def _seeds(spark, sf):
    vec = V.vectors(spark, sf)
    q = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    near = retrieval.knn(vec, q, 10, "vec_id")
    n = vec.agg(F.count(F.lit(1)).alias("n_vec"))
    ev = V.events(spark, sf).select("event_id").join(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n_vec")).alias("vec_id"))
    rows = ev.join(near, "vec_id")  # near grows with the queries: the planner decides
    return retrieval.first_seen(rows, ["qid", "event_id"], ["rank"]).withColumn("seed_rank", F.row_number().over(W.partitionBy("qid").orderBy("rank", "event_id")).cast("long"))


@query("seed_events", with_views("vec ev", "SELECT qid, event_id, row_number() OVER (PARTITION BY qid ORDER BY o) AS seed_rank FROM seeds", _KNN))
def seed_events(spark, sf):
    return _seeds(spark, sf).select("qid", "event_id", "seed_rank")


_MORE = """more AS (SELECT DISTINCT qid, event_id FROM (
  SELECT s.qid, u.src AS event_id FROM seeds s JOIN sup u ON u.dst = s.event_id AND u.edge_type = 'updates'
  UNION ALL SELECT s.qid, u.dst FROM seeds s JOIN sup u ON u.src = s.event_id) WHERE (qid, event_id) NOT IN (SELECT qid, event_id FROM seeds))"""


def _update_aware(spark, sf):
    seeds, sup = _seeds(spark, sf).select("qid", "event_id"), V.supersessions(spark, sf)
    newer = seeds.join(sup.where("edge_type = 'updates'"), F.col("event_id") == F.col("dst")).select("qid", F.col("src").alias("event_id"))
    older = seeds.join(sup, F.col("event_id") == F.col("src")).select("qid", F.col("dst").alias("event_id"))
    return newer.unionByName(older).distinct().join(seeds, ["qid", "event_id"], "left_anti")


@query("update_aware_seeds", with_views("vec ev sup", "SELECT qid, event_id FROM more", _KNN + ", " + _MORE))
def update_aware_seeds(spark, sf):
    return _update_aware(spark, sf)


@query("entry_seed_supersession", with_views("vec ev sup", "SELECT s.qid, s.event_id, u.dst AS superseded, u.edge_type, u.confidence FROM seeds s JOIN sup u ON u.src = s.event_id", _KNN))
def entry_seed_supersession(spark, sf):
    seeds = _seeds(spark, sf).select("qid", "event_id")
    return V.supersessions(spark, sf).join(seeds, F.col("src") == F.col("event_id")).select("qid", "event_id", F.col("dst").alias("superseded"), "edge_type", "confidence")


@query(
    "graph_expand",
    with_views(
        "ev sup",
        """SELECT src, dst, before FROM (SELECT src, dst, coalesce(sum(n) OVER (PARTITION BY src ORDER BY ord, dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM nb) WHERE before < 8""",
        """both_ways AS (SELECT src, dst, 0 AS ord FROM sup UNION ALL SELECT dst, src, 1 FROM sup), nb AS (SELECT b.src, b.dst, b.ord, 1 + e.event_id % 4 AS n FROM both_ways b JOIN ev e ON e.event_id = b.dst)""",
    ),
)
def graph_expand(spark, sf):
    """Neighbours of an event (successors first) are taken while fewer than 8 notes came before; here an event has 1 to 4."""
    sup = V.supersessions(spark, sf)
    both = sup.select("src", "dst", F.lit(0).alias("ord")).unionByName(sup.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("ord")))
    return retrieval.capped_expansion(both.withColumn("n_notes", 1 + F.col("dst") % 4), 8, "src", order=("ord", "dst")).select("src", "dst", "before")


@query("neighbour_expand", with_views("notes", "SELECT a.note_id, b.note_id AS neighbour FROM notes a CROSS JOIN (SELECT unnest([1, 2, 3]) AS step) s JOIN notes b ON b.conv = a.conv AND b.note_pos = a.note_pos + step WHERE step <= 2"))
def neighbour_expand(spark, sf):
    """A note links to the next three of its conversation; two at most are followed."""
    n = V.notes(spark, sf)
    links = n.select("conv", "note_id", F.posexplode(F.array(*[F.col("note_pos") + i for i in (1, 2, 3)])).alias("i", "note_pos")).where("i < 2")
    return links.join(n.select("conv", "note_pos", F.col("note_id").alias("neighbour")), ["conv", "note_pos"]).select("note_id", "neighbour")


@query(
    "ordinal_alignment",
    with_views(
        "sess",
        """SELECT a.conv, a.event_date, b.summary_key FROM (SELECT conv, event_date, row_number() OVER (PARTITION BY conv ORDER BY strftime(event_date, '%d %m %Y')) AS r FROM sess) a
        JOIN (SELECT conv, 'session_' || session_num || '_summary' AS summary_key, row_number() OVER (PARTITION BY conv ORDER BY session_num) AS r FROM sess WHERE session_num % 4 <> 0) b USING (conv, r)""",
    ),
)
def ordinal_alignment(spark, sf):
    """The i-th date in text order meets the i-th summary in number order, up to the shorter of the two."""
    s = V.sessions(spark, sf)
    times = s.select("conv", "event_date", F.date_format("event_date", "dd MM yyyy").alias("timestamp"))
    summaries = s.where("session_num % 4 <> 0").select("conv", F.format_string("session_%d_summary", "session_num").alias("summary_key"))
    return inject.align_sessions(times, summaries).select("conv", "event_date", "summary_key")


@query("asof_previous_event", with_views("ev", "SELECT a.event_id, b.event_id AS previous FROM ev a ASOF JOIN (SELECT * FROM ev WHERE kind = 'purchase') b ON a.u = b.u AND a.event_seq > b.event_seq"))
def asof_previous_event(spark, sf):
    """The latest earlier purchase of the same user: the last value in a window, no join."""
    prev = F.last(F.when(F.col("kind") == "purchase", F.col("event_id")), ignorenulls=True).over(W.partitionBy("u").orderBy("event_seq").rowsBetween(W.unboundedPreceding, -1))
    return V.events(spark, sf).select("event_id", prev.alias("previous")).where("previous IS NOT NULL")


@query(
    "extraction_edges",
    with_views("ev", """SELECT a.conv, a.event_id AS src, b.event_id AS dst FROM numbered a JOIN numbered b ON a.conv = b.conv AND a.event_date = b.event_date AND b.i = a.i + (a.event_id % 3) WHERE a.event_id % 3 > 0""", "numbered AS (SELECT *, row_number() OVER (PARTITION BY conv, event_date ORDER BY event_seq) - 1 AS i FROM ev)"),
)
def extraction_edges(spark, sf):
    """Edges given by places in a session's batch become edges of ids; self loops and places out of range are dropped."""
    n = V.events(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("conv", "event_date").orderBy("event_seq")) - 1)
    step = F.col("event_id") % 3
    ends = n.select("conv", "event_date", F.col("event_id").alias("src"), (F.col("i") + step).alias("i"), step.alias("step")).where("step > 0")
    return ends.join(n.select("conv", "event_date", F.col("event_id").alias("dst"), F.col("i").cast("long").alias("i")), ["conv", "event_date", "i"]).select("conv", "src", "dst")


@query("session_of_event", with_views("evs sess", "SELECT e.event_id, s.session_id FROM evs e JOIN sess s ON s.conv = e.conv AND s.session_num = e.session_num"))
def session_of_event(spark, sf):
    """By the links between an event's node and its session."""
    s = V.sessions(spark, sf).select("conv", "event_date", "session_id")
    node = F.col("event_id").cast("string").alias("node")
    stars = graph.star(V.events(spark, sf).join(s, ["conv", "event_date"]).select("conv", node, "session_id"), "node", "session_id", "belongs_to", "contains").withColumn("adj_pos", F.xxhash64("src", "dst"))
    return hierarchy.event_session(V.events(spark, sf).select("conv", node), stars).select(F.col("node").cast("long").alias("event_id"), "session_id")


@query("topic_event_ids", with_views("evs", "SELECT conv, topic_num, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM evs GROUP BY 1, 2"))
def topic_event_ids(spark, sf):
    """Events of the sessions that a topic lists."""
    s = V.sessions(spark, sf)
    topics = s.groupBy("conv", F.col("topic_num").alias("topic_id")).agg(F.collect_list("session_id").alias("session_ids"), F.min("session_num").alias("seq"))  # five sessions
    of = hierarchy.topic_of_session(topics).join(s.select("conv", "session_id", "event_date"), ["conv", "session_id"]).select("conv", "event_date", F.col("topic_id").alias("topic_num"))
    return V.events(spark, sf).join(of, ["conv", "event_date"]).groupBy("conv", "topic_num").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
