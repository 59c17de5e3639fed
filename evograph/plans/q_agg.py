"""Aggregations, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.text import STOP_WORDS, key_terms
from evograph.operators import context, graph, hierarchy, metrics, retrieval, support
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


@query("edge_type_counts", with_views("sup", "SELECT conv, edge_type, count(*) AS n FROM sup GROUP BY 1, 2"))
def edge_type_counts(spark, sf):
    return graph.stats(V.supersessions(spark, sf))


@query("session_rollup", with_views("evs", "SELECT conv, session_num, count(*) AS n_events, min(event_id) AS first_event, count(DISTINCT u) AS users, array_to_string(list(event_id ORDER BY event_id), ',') AS event_ids FROM evs GROUP BY 1, 2"))
def session_rollup(spark, sf):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return V.events_in_sessions(spark, sf).groupBy("conv", "session_num").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.countDistinct("u").alias("users"), ids.alias("event_ids"))


_SCORED = "scored AS (SELECT conv_id, turn % 5 + 1 AS category, length(text)::DOUBLE AS chars, (turn * 7 % 11) / 10.0::DOUBLE AS f1 FROM conversations)"


def _scored(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", (F.col("turn") % 5 + 1).alias("category"), F.char_length("text").cast("double").alias("chars"), (F.col("turn") * 7 % 11 / 10.0).alias("f1"))


_STATS = "round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, count(*) AS count"


@query(
    "metric_grouping_sets",
    f"WITH {_SCORED}, long AS (SELECT category, 'chars' AS metric, chars AS value FROM scored UNION ALL SELECT category, 'f1', f1 FROM scored) SELECT metric, category, {_STATS} FROM long GROUP BY 1, 2 UNION ALL SELECT metric, NULL, {_STATS} FROM long WHERE category <> 5 GROUP BY 1",
)
def metric_grouping_sets(spark, sf):
    return metrics.aggregate_metrics(_scored(spark, sf), ["chars", "f1"])


@query("judge_mean_std", "WITH r AS (SELECT turn % 3 AS run, conv_id % 4 AS category, CASE WHEN turn % 10 = 9 THEN NULL ELSE (turn * 3 % 5 > 1)::INT END AS score FROM conversations), p AS (SELECT run, category, avg(score) AS m FROM r WHERE score IS NOT NULL GROUP BY 1, 2) SELECT category, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std, count(*) AS runs FROM p GROUP BY 1")
def judge_mean_std(spark, sf):
    score = F.when(F.col("turn") % 10 != 9, (F.col("turn") * 3 % 5 > 1).cast("int"))
    return metrics.judge_runs(V.table(spark, sf, "conversations").select((F.col("turn") % 3).alias("run"), (F.col("conv_id") % 4).alias("category"), score.alias("score")))


@query("judge_rollup", "SELECT conv_id % 4 AS category, turn % 3 AS run, round(avg((turn * 3 % 5 > 1)::INT), 6) AS mean, count(*) AS n, sum((turn * 3 % 5 > 1)::INT)::BIGINT AS correct FROM conversations GROUP BY ROLLUP (1, 2)")
def judge_rollup(spark, sf):
    rows = V.table(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("category"), (F.col("turn") % 3).alias("run"), (F.col("turn") * 3 % 5 > 1).cast("int").alias("ok"))
    return rows.rollup("category", "run").agg(F.round(F.avg("ok"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("ok").alias("correct"))


@query("cond_counts", with_views("ev", "SELECT conv, count(*) AS n, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (value > 50) AS large, round(avg(value) FILTER (kind = 'purchase'), 6) AS purchase_mean FROM ev GROUP BY 1"))
def cond_counts(spark, sf):
    return V.events(spark, sf).groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.avg(F.when(F.col("kind") == "purchase", F.col("value"))), 6).alias("purchase_mean"))


# Pool of an event: earlier events of its (user, k) in other sessions; screened: at most 10 of them.
_POOL = "pool AS (SELECT event_id, session_num, rn - in_session AS pool FROM (SELECT event_id, session_num, row_number() OVER (PARTITION BY conv, u, k ORDER BY event_seq) - 1 AS rn, row_number() OVER (PARTITION BY conv, u, k, session_num ORDER BY event_seq) - 1 AS in_session FROM evs))"


def _pool(spark, sf):
    ev = V.events_in_sessions(spark, sf)
    n = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("event_seq"))
    return ev.select("event_id", "session_num", (n("conv", "u", "k") - n("conv", "u", "k", "session_num")).alias("pool"))


@query("marginal_cost", with_views("evs", "SELECT session_num - 1 AS prior_sessions, count(*) AS n_events, round(avg(pool), 2) AS mean_pool, round(avg(least(pool, 10)), 2) AS mean_cost FROM pool GROUP BY 1", _POOL))
def marginal_cost(spark, sf):
    return _pool(spark, sf).groupBy((F.col("session_num") - 1).alias("prior_sessions")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("pool"), 2).alias("mean_pool"), F.round(F.avg(F.least("pool", F.lit(10))), 2).alias("mean_cost"))


@query("marginal_growth", with_views("evs", "SELECT round(avg(pool) FILTER (session_num - 1 BETWEEN 1 AND 3), 6) AS early, round(avg(pool) FILTER (session_num - 1 >= 10), 6) AS late, round(avg(pool) FILTER (session_num - 1 >= 10) / nullif(avg(pool) FILTER (session_num - 1 BETWEEN 1 AND 3), 0), 6) AS growth FROM pool", _POOL))
def marginal_growth(spark, sf):
    prior = F.col("session_num") - 1
    early, late = F.avg(F.when(prior.between(1, 3), F.col("pool"))), F.avg(F.when(prior >= 10, F.col("pool")))
    return _pool(spark, sf).agg(F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), F.round(late / F.nullif(early, F.lit(0.0)), 6).alias("growth"))


_CENT = "dims AS (SELECT label, i, avg(v[i]) AS x FROM vec, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2), lens AS (SELECT label, sqrt(sum(x * x)) AS n FROM dims GROUP BY 1), cent AS (SELECT label, list(x / n ORDER BY i) AS cv FROM dims JOIN lens USING (label) GROUP BY label)"


def _cents(spark, sf):
    return hierarchy.centroids(V.vectors(spark, sf), "label")


@query("topic_centroid_dim", with_views("vec", "SELECT label, i - 1 AS dim, round(x / n, 6) AS x FROM dims JOIN lens USING (label)", _CENT))
def topic_centroid_dim(spark, sf):
    return _cents(spark, sf).select("label", F.posexplode("cv").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("cohesion", with_views("vec", "SELECT label, round(CASE WHEN count(*) < 2 THEN -1 ELSE min(list_cosine_similarity(v, cv)) END, 6) AS cohesion, count(*) AS members FROM vec JOIN cent USING (label) GROUP BY 1", _CENT))
def cohesion(spark, sf):
    return hierarchy.cohesion(V.vectors(spark, sf), _cents(spark, sf), "label")


@query("medoid", with_views("vec", "SELECT label, arg_max(vec_id, (round(list_cosine_similarity(v, cv), 9), -vec_id)) AS vec_id FROM vec JOIN cent USING (label) GROUP BY 1", _CENT))
def medoid(spark, sf):
    return hierarchy.medoids(V.vectors(spark, sf), _cents(spark, sf), "label", "vec_id")


@query("session_chain", with_views("sess", "SELECT conv, src, dst, edge_type FROM (SELECT conv, lag(session_id) OVER (PARTITION BY conv ORDER BY session_num) AS src, session_id AS dst, 'temporal_before' AS edge_type FROM sess) WHERE src IS NOT NULL"))
def session_chain(spark, sf):
    return graph.chain(V.sessions(spark, sf))


# Parts of a context: section 1 holds a conversation's user turns, section 2 a header and the other turns.
_PARTS = """parts AS (SELECT conv_id AS qid, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS section, turn AS seq, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::BIGINT AS tokens, false AS header FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 2, -1, 3, true FROM conversations)"""
_FIRST = "first_ AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY seq) AS used FROM parts WHERE section = 1), one AS (SELECT * FROM first_ WHERE used <= 120), spent AS (SELECT qid, max(used) AS spent FROM one GROUP BY 1)"
_SECOND = "second_ AS (SELECT p.*, coalesce(s.spent, 0) AS spent, sum(tokens) OVER (PARTITION BY p.qid ORDER BY seq) AS used FROM parts p LEFT JOIN spent s USING (qid) WHERE section = 2), two AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS place FROM second_ WHERE used <= 60 + 120 - spent OR header)"


def _parts(spark, sf):
    from evograph.functions.text import token_count

    c = V.table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("qid"), F.when(F.col("role") == "user", 1).otherwise(2).alias("section"), F.col("turn").alias("seq"), token_count(F.col("text")).cast("long").alias("tokens"), F.lit(False).alias("header"))
    heads = c.select(F.col("conv_id").alias("qid")).distinct().select("qid", F.lit(2).alias("section"), F.lit(-1).cast("long").alias("seq"), F.lit(3).cast("long").alias("tokens"), F.lit(True).alias("header"))
    return rows.unionByName(heads)


@query("token_budget_prefix", f"WITH {_PARTS}, {_FIRST} SELECT qid, seq, tokens, used::BIGINT AS used FROM one")
def token_budget_prefix(spark, sf):
    return context.budget_prefix(_parts(spark, sf).where("section = 1"), 120).select("qid", "seq", "tokens", "used")


@query("budget_spill", f"WITH {_PARTS}, {_FIRST}, {_SECOND} SELECT qid, section::INT AS section, seq, tokens FROM one UNION ALL SELECT qid, section, seq, tokens FROM two")
def budget_spill(spark, sf):
    return context.two_sections(_parts(spark, sf), 120, 60, 10**9)


@query("total_cap", f"WITH {_PARTS}, {_FIRST}, {_SECOND} SELECT qid, section::INT AS section, seq, tokens FROM one UNION ALL SELECT qid, section, seq, tokens FROM two WHERE place = 1 OR spent + used <= 140")
def total_cap(spark, sf):
    return context.two_sections(_parts(spark, sf), 120, 60, 140)


@query("event_first_mention", with_views("ev", "SELECT u AS qid, event_date, k AS mentioned, event_date = min(event_date) OVER (PARTITION BY u, k) AS is_first FROM (SELECT DISTINCT u, event_date, k FROM ev)"))
def event_first_mention(spark, sf):
    rows = V.events(spark, sf).select(F.col("u").alias("qid"), F.col("event_date").alias("path_rank"), F.col("k").alias("event_id")).distinct()
    return context.first_mentions(rows).select("qid", F.col("path_rank").alias("event_date"), F.col("event_id").alias("mentioned"), "is_first")


@query("chunk_windows", with_views("sess", 'SELECT session_id, ((row_number() OVER (PARTITION BY conv ORDER BY event_date, session_id) - 1) // 7)::BIGINT AS "window" FROM sess'))
def chunk_windows(spark, sf):
    return hierarchy.chunk_windows(V.sessions(spark, sf), 7).select("session_id", "window")


@query("arrival_index", with_views("evs", "SELECT event_id, session_num AS arrival FROM evs"))
def arrival_index(spark, sf):
    return V.events_in_sessions(spark, sf).select("event_id", F.col("session_num").alias("arrival"))


_Q = "q AS (SELECT vec_id AS qid, v AS qv FROM vec WHERE vec_id % 50 = 0), sims AS (SELECT qid, vec_id, label, round(list_cosine_similarity(qv, v), 6) AS sim FROM q, vec WHERE qid <> vec_id)"


def _queries(spark, sf):
    return V.vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"))


@query("knn", with_views("vec", "SELECT * FROM (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM sims) WHERE rank <= 10", _Q))
def knn(spark, sf):
    return retrieval.knn(V.vectors(spark, sf), _queries(spark, sf), 10, "vec_id", exclude_self=True)


@query("knn_cells", with_views("vec", "SELECT * FROM (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS sim FROM vec q JOIN vec c ON q.vec_id % 50 = 0 AND q.label = c.label)) WHERE rank <= 10"))
def knn_cells(spark, sf):
    """The nearest vectors of a query's own label, by cells and bounds: the same rows as all products give."""
    vec = V.vectors(spark, sf)
    q = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    return retrieval.knn_scoped(vec, q, 10, "vec_id", scope="label", whole=20)


@query("knn_threshold", with_views("vec", "SELECT * FROM (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE sim >= 0.35) WHERE rank <= 5", _Q))
def knn_threshold(spark, sf):
    return retrieval.knn(V.vectors(spark, sf), _queries(spark, sf), 5, "vec_id", 0.35, exclude_self=True)


@query("direct_evidence", with_views("vec", "SELECT * FROM (SELECT qid, vec_id, round(0.9 * sim, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE sim >= 0.2 AND (qid + vec_id) % 3 <> 0) WHERE rank <= 3", _Q))
def direct_evidence(spark, sf):
    """The best three uncovered items of each query (here those with an id sum that 3 divides are covered)."""
    near = retrieval.knn(V.vectors(spark, sf), _queries(spark, sf), 3, "vec_id", 0.2, exclude_self=True, where=lambda qid, vec_id: (qid + vec_id) % 3 != 0)
    return near.select("qid", "vec_id", F.round(0.9 * F.col("sim"), 6).alias("score"), "rank")


@query("participant_seeds", with_views("ev", "SELECT entity, event_id FROM (SELECT 'u' || u AS entity, event_id, row_number() OVER (PARTITION BY u ORDER BY event_date DESC, event_id) AS n FROM ev) WHERE n <= 8"))
def participant_seeds(spark, sf):
    """A question for each user that names it: the latest eight of its events (there are no similarities)."""
    ev, name = V.events(spark, sf), F.concat(F.lit("u"), "u")
    entities = ev.select(F.col("u").alias("qid"), "conv", name.alias("entity"), F.lit(1).alias("n")).distinct()
    members = ev.select(F.col("u").alias("qid"), "conv", name.alias("member"), F.col("event_id").alias("node"), F.col("event_seq").alias("seq"), F.lit(None).cast("double").alias("sim"), F.col("event_date").cast("string").alias("anchor"))
    return retrieval.entity_events(entities, members, 8).select(F.concat(F.lit("u"), "qid").alias("entity"), F.col("node").alias("event_id"))


@query(
    "hierarchical_seeds",
    with_views("vec", "SELECT qid, label, vec_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.label ORDER BY sim DESC, vec_id) AS n FROM sims s JOIN (SELECT qid, label FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, cv), 6) DESC, label) AS t FROM q, cent) WHERE t <= 2) USING (qid, label)) WHERE n <= 3", _CENT + ", " + _Q),
)
def hierarchical_seeds(spark, sf):
    """The two nearest topics of a query, and in each the three nearest items."""
    q, vec = _queries(spark, sf), V.vectors(spark, sf)
    cents = _cents(spark, sf).select("label", F.col("cv").alias("v"), F.lit(1.0).alias("norm"))
    topics = retrieval.knn(cents, q, 2, "label").select("qid", "label")
    items = retrieval.block_sims(vec, topics.join(q, "qid"), 3, "vec_id", "label", exclude_self=True)
    return items.withColumn("n", F.row_number().over(W.partitionBy("qid", "label").orderBy(F.desc("sim"), "vec_id"))).where("n <= 3").select("qid", "label", "vec_id")


_HIER = """nvec AS (SELECT count(*) AS n FROM vec), tops AS (SELECT qid, label FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, cv), 6) DESC, label) AS t FROM q, cent) WHERE t <= 2),
  near AS (SELECT * FROM (SELECT s.qid, v.vec_id AS session, row_number() OVER (PARTITION BY s.qid ORDER BY round(list_cosine_similarity(q.qv, v.v), 6) DESC, v.vec_id) AS place FROM tops s JOIN q USING (qid) JOIN vec v USING (label)) WHERE place <= 3)"""


@query(
    "hierarchical_events",
    with_views("vec ev", "SELECT qid, event_id, ord FROM (SELECT qid, event_id, row_number() OVER (PARTITION BY qid ORDER BY place, event_seq) AS ord FROM near, nvec JOIN ev ON ev.event_id % nvec.n = near.session WHERE ev.kind <> 'error') WHERE ord <= 20", _CENT + ", " + _Q + ", " + _HIER),
)
def hierarchical_events(spark, sf):
    """Topics are labels, sessions are vectors, and a session's events those whose id leaves its number (errors apart)."""
    vec, q = V.vectors(spark, sf), _queries(spark, sf)
    topics = _cents(spark, sf).select(F.col("label").alias("topic"), F.col("cv").alias("v"), F.lit(1.0).alias("norm"))
    sessions = vec.select(F.col("vec_id").alias("session"), F.col("label").alias("topic"), "v", "norm")
    ev = V.events(spark, sf)
    events = ev.select((F.col("event_id") % vec.count()).alias("session"), "event_id", F.col("event_seq").alias("seq"), "kind")
    return retrieval.hierarchical_events(q, topics, sessions, events.where("kind <> 'error'").drop("kind"), q.select("qid", F.lit(-1).cast("long").alias("event_id")))


@query("nearest_centroid", with_views("vec", "SELECT vec_id, arg_max(c.label, (round(list_cosine_similarity(v, cv), 6), -c.label)) AS topic, max(round(list_cosine_similarity(v, cv), 6)) AS sim FROM vec, cent c GROUP BY 1", _CENT))
def nearest_centroid(spark, sf):
    cents = _cents(spark, sf).select(F.col("label").alias("topic"), "cv", F.lit(1.0).alias("cnorm"))
    return retrieval.nearest(V.vectors(spark, sf), cents, "vec_id")


@query(
    "relevant_sentences",
    """WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS s, generate_subscripts(string_split_regex(text, '[.!?]+'), 1) - 1 AS i FROM documents), c AS (SELECT doc_id, i, trim(s, ' ') AS s FROM s WHERE length(trim(s, ' ')) >= 10),
    h AS (SELECT *, (contains(lower(s), 'the'))::INT + (contains(lower(s), 'and'))::INT + (contains(lower(s), 'der'))::INT AS hits FROM c)
    SELECT doc_id, i, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS n FROM h WHERE hits >= 1) WHERE n <= 2""",
)
def relevant_sentences(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "[.!?]+")).alias("i", "s")).withColumn("s", F.trim("s")).where(F.char_length("s") >= 10)
    hits = sum((F.contains(F.lower("s"), F.lit(w)).cast("int") for w in ("the", "and", "der")), F.lit(0))
    rows = rows.withColumn("hits", hits).where("hits >= 1")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("hits"), "i"))).where("n <= 2").select("doc_id", "i", "hits")


_TERMS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND NOT list_contains({1}, t))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query(
    "session_detail",
    f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER w AS answer, lead(text, 2) OVER w AS later FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT conv_id, turn, later, list_distinct(list_concat({_TERMS.format("answer", _STOPS)}, {_TERMS.format("text", _STOPS)})) AS terms FROM t WHERE later IS NOT NULL),
    s AS (SELECT conv_id, turn, terms, generate_subscripts(string_split_regex(later, '[.!?]+'), 1) AS i, regexp_replace(unnest(string_split_regex(later, '[.!?]+')), '^\\s+|\\s+$', '', 'g') AS s FROM k),
    h AS (SELECT *, len(list_filter(terms, lambda x: contains(lower(s), x))) AS hits FROM s WHERE length(s) >= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, i) AS n FROM h WHERE hits > 0)
    SELECT conv_id, turn, left(string_agg(s, '; ' ORDER BY n), 150) AS detail FROM r WHERE n <= 2 GROUP BY 1, 2""",
)
def session_detail(spark, sf):
    """A turn is a question, the next one its answer, the one after that what is searched: the two sentences with most of their key terms."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("answer"), F.lead("text", 2).over(w).alias("later")).where("later IS NOT NULL")
    terms = F.array_union(key_terms(F.col("answer")), key_terms(F.col("text")))
    return rows.select("conv_id", "turn", F.substring(support.relevant_sentences(F.col("later"), terms), 1, support.DETAIL).alias("detail")).where("detail <> ''")
