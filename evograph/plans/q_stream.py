"""Incremental ingest, time windows, clustering and text metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.operators import clustering, hierarchy, metrics, validity
from evograph.plans import views as V
from evograph.plans.views import with_views
from evograph.shared import cut
from evograph.streaming import incremental, memory

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _arrivals(spark, sf):
    return V.events_in_sessions(spark, sf).select("conv", "event_id", "session_num", "u", "k", "kind", "value")


_FOLD = """num AS (SELECT *, row_number() OVER (PARTITION BY conv, u, k ORDER BY session_num, event_id) AS n FROM evs),
  met AS (SELECT r.conv, r.event_id AS src, r.session_num, f.event_id AS dst, r.kind = f.kind AS same, abs(r.value - f.value) > 50 AS far FROM num r JOIN num f ON f.conv = r.conv AND f.u = r.u AND f.k = r.k AND f.n <= 10 AND f.session_num < r.session_num),
  ends AS (SELECT dst, min((session_num, src)) AS at FROM met WHERE same GROUP BY 1),
  seen AS (SELECT m.*, e.at IS NOT NULL AND e.at < (m.session_num, m.src) AS gone FROM met m LEFT JOIN ends e USING (dst)),
  made AS (SELECT src, dst, CASE WHEN same THEN 'updates' ELSE 'contradicts' END AS edge_type FROM seen WHERE NOT gone AND (same OR far)),
  counts AS (SELECT e.conv, e.event_id, e.session_num, (SELECT count(*) FROM evs o WHERE o.conv = e.conv AND o.u = e.u AND o.k = e.k AND o.session_num < e.session_num) AS earlier FROM evs e),
  report AS (SELECT c.conv, c.event_id, c.session_num, any_value(earlier) - count(*) FILTER (gone) AS pool, count(*) FILTER (NOT gone) AS screened FROM counts c LEFT JOIN seen s ON s.src = c.event_id GROUP BY 1, 2, 3)"""


@query(
    "incremental_replay",
    with_views("evs", "SELECT r.conv, r.event_id AS src, m.dst, m.edge_type, r.pool::INT AS pool, r.screened::INT AS screened, false AS late FROM report r LEFT JOIN made m ON m.src = r.event_id", _FOLD),
)
def incremental_replay(spark, sf):
    """What the streaming fold gives, over a table; the tests hold it against the stream and a plain fold, too."""
    return incremental.replay(_arrivals(spark, sf))


@query(
    "arrival_support",
    with_views("evs", "SELECT r.conv, f.event_id AS src, r.event_id AS dst FROM evs r JOIN num f ON f.conv = r.conv AND f.u = r.u AND f.k = r.k AND f.n <= 5 AND f.session_num < r.session_num AND f.topic_num = r.topic_num", _FOLD),
)
def arrival_support(spark, sf):
    return incremental.support_links(V.events_in_sessions(spark, sf).withColumn("topic", F.col("topic_num")))


def _talk(spark, sf):
    """Events as they arrive, with three participants each; an event causes, enables or prevents its user's next one of the session."""
    ev = V.events_in_sessions(spark, sf)
    after = F.lead("event_id").over(W.partitionBy("conv", "u", "session_num").orderBy("event_id"))
    kind = F.element_at(F.array(F.lit("causes"), F.lit("enables"), F.lit("prevents")), ((F.col("event_id") + after) % 3 + 1).cast("int"))
    people = F.array(F.concat(F.lit("u"), "u"), F.concat(F.lit("k"), "k"), F.col("kind"))
    causes = F.when(after.isNotNull(), F.array(F.struct(after.alias("dst"), kind.alias("edge_type")))).otherwise(F.array().cast("array<struct<dst:bigint,edge_type:string>>"))
    return ev.select("conv", "session_num", "event_id", "event_seq", people.alias("participants"), F.col("topic_num").cast("string").alias("topic"), "event_date", "kind", "value", causes.alias("causes"))


# Two of three members shared are a similarity of a half, one is a fifth.
_TALK = """pairs AS (SELECT a.conv, a.event_id AS src, b.event_id AS dst, (a.session_num, a.event_id) AS moment, a.kind = b.kind AS same, abs(a.value - b.value) > 50 AS far, a.topic_num = b.topic_num AS gate, a.event_date AS day,
    row_number() OVER (PARTITION BY a.event_id ORDER BY (a.u = b.u)::INT + (a.k = b.k)::INT + (a.kind = b.kind)::INT DESC, b.session_num, b.event_id) AS rank
    FROM evs a JOIN evs b ON a.conv = b.conv AND b.session_num < a.session_num AND (a.u = b.u)::INT + (a.k = b.k)::INT + (a.kind = b.kind)::INT >= 2),
  verdicts AS (SELECT *, CASE WHEN same THEN 'updates' WHEN far THEN 'contradicts' END AS verdict FROM pairs WHERE rank <= 10),
  ends AS (SELECT dst, min(moment) AS finish FROM verdicts WHERE verdict = 'updates' GROUP BY 1),
  made AS (SELECT v.* FROM verdicts v LEFT JOIN ends e USING (dst) WHERE verdict IS NOT NULL AND (finish IS NULL OR moment <= finish)),
  causal AS (SELECT conv, src, dst, ['causes', 'enables', 'prevents'][(src + dst) % 3 + 1] AS edge_type FROM (SELECT conv, event_id AS src, lead(event_id) OVER (PARTITION BY conv, u, session_num ORDER BY event_id) AS dst FROM evs) WHERE dst IS NOT NULL)"""


@query(
    "memory_edges",
    with_views(
        "evs",
        """SELECT conv, src, dst, verdict AS edge_type FROM made UNION ALL SELECT conv, dst, src, 'supports' FROM pairs WHERE rank <= 5 AND gate
        UNION ALL SELECT conv, dst, src, 'temporal_before' FROM pairs WHERE rank <= 20 AND gate UNION ALL SELECT conv, src, dst, edge_type FROM causal""",
        _TALK,
    ),
)
def memory_edges(spark, sf):
    """All edges of the one-pass ingest; the tests hold the stream against the same fold."""
    return memory.replayed(_talk(spark, sf))[0]


@query(
    "memory_validity",
    with_views(
        "evs",
        """SELECT e.conv, e.event_id, h.day AS valid_until, CASE WHEN h.dst IS NOT NULL THEN 0.0 WHEN s.dst IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS update_val FROM evs e
        LEFT JOIN (SELECT dst, day FROM made WHERE verdict = 'updates') h ON h.dst = e.event_id LEFT JOIN (SELECT DISTINCT c.dst FROM causal c JOIN made m ON m.dst = c.src AND m.verdict = 'updates' WHERE c.edge_type <> 'prevents') s ON s.dst = e.event_id""",
        _TALK,
    ),
)
def memory_validity(spark, sf):
    return memory.replayed(_talk(spark, sf))[1]


@query(
    "recorded_replay",
    with_views(
        "evs",
        "SELECT m.conv, m.src, m.dst, m.verdict AS edge_type, m.day AS anchor FROM recorded m LEFT JOIN last l USING (dst) WHERE finish IS NULL OR moment <= finish",
        _TALK + """, recorded AS (SELECT *, CASE (7 * src + 13 * dst) % 5 WHEN 0 THEN 'updates' ELSE 'contradicts' END AS verdict FROM pairs WHERE rank <= 10 AND (7 * src + 13 * dst) % 5 IN (0, 1)),
  last AS (SELECT dst, min(moment) AS finish FROM recorded WHERE verdict = 'updates' GROUP BY 1)""",
    ),
)
def recorded_replay(spark, sf):
    """Ingest by verdicts from elsewhere: here recorded for all candidate pairs, by a rule on the ids."""
    talk = _talk(spark, sf).withColumn("anchor", F.col("event_date"))
    pairs = memory.screened(talk, memory.EVOLUTION, ("anchor",)).select("conv", F.col("event_id").alias("src"), F.col("cand_id").alias("dst"))
    kind = F.element_at(F.array(*map(F.lit, ("updates", "contradicts", "independent", "independent", "none"))), ((7 * F.col("src") + 13 * F.col("dst")) % 5 + 1).cast("int"))
    return validity.replay(talk, pairs.withColumn("edge_type", kind))


@query("ingest_report", with_views("evs", "SELECT conv, session_num, count(*) AS events, sum(pool)::BIGINT AS pool, sum(screened)::BIGINT AS screened FROM report GROUP BY 1, 2", _FOLD))
def ingest_report(spark, sf):
    """Per arriving session: its events, the valid pool before the cap and what of it is screened."""
    rows = incremental.replay(_arrivals(spark, sf)).groupBy("conv", F.col("src").alias("event_id")).agg(F.max("pool").alias("pool"), F.max("screened").alias("screened"))
    num = V.events_in_sessions(spark, sf).select("event_id", "session_num")
    return rows.join(num, "event_id").groupBy("conv", "session_num").agg(F.count(F.lit(1)).alias("events"), F.sum("pool").alias("pool"), F.sum("screened").alias("screened"))


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return incremental.tumbling(V.table(spark, sf, "events"))


@query(
    "session_window_counts",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, g""",
)
def session_window_counts(spark, sf):
    return incremental.gap_sessions(V.table(spark, sf, "events"), "6 hours")


@query("kmeans_topics")
def kmeans_topics(spark, sf):
    return hierarchy.kmeans_topics(V.vectors(spark, sf).select("vec_id", "v"), 10)


@query("session_topics")
def session_topics(spark, sf):
    """All conversations' topics at once, a topic for every five vectors; the tests hold its inertia against seeded starts."""
    rows = V.vectors(spark, sf).select(F.expr("vec_id div 50").alias("conv"), F.col("vec_id").alias("session_id"), "v")
    return clustering.recluster(rows, 1)


@query("centroid_assign_stream")
def centroid_assign_stream(spark, sf):
    """Online topic admission over vectors, dealt to conversations of 50 in order of their ids."""
    rows = V.vectors(spark, sf).select(F.expr("vec_id div 50").alias("conv"), F.col("vec_id").alias("seq"), "v")
    return hierarchy.assign_topics(rows)


@query(
    "aligned_similarity",
    with_views(
        "vec",
        """SELECT p.conv_id, p.turn, round(coalesce(a.s, 0), 6)::DOUBLE AS precision, round(coalesce(b.s, 0), 6)::DOUBLE AS recall FROM texts p LEFT JOIN share1 a USING (conv_id, turn) LEFT JOIN share2 b USING (conv_id, turn)""",
        """texts AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(ref), '[^a-z]+'), lambda x: x <> '') AS b
    FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations) WHERE ref IS NOT NULL),
  size AS (SELECT count(*) AS n FROM vec), df AS (SELECT token, ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)) AS idf FROM (SELECT conv_id, turn, unnest(list_distinct(b)) AS token FROM texts) GROUP BY 1),
  words AS (SELECT DISTINCT unnest(list_concat(a, b)) AS token FROM texts), tv AS (SELECT token, v FROM words, size JOIN vec ON vec_id = ('0x' || substr(md5(token), 1, 6))::BIGINT % n),
  s1 AS (SELECT conv_id, turn, unnest(a) AS token FROM texts), s2 AS (SELECT conv_id, turn, unnest(b) AS token FROM texts),
  d1 AS (SELECT DISTINCT * FROM s1), d2 AS (SELECT DISTINCT * FROM s2),
  met AS (SELECT x.conv_id, x.turn, x.token AS t1, y.token AS t2, list_cosine_similarity(p.v, q.v) AS sim FROM d1 x JOIN d2 y USING (conv_id, turn) JOIN tv p ON p.token = x.token JOIN tv q ON q.token = y.token),
  best1 AS (SELECT conv_id, turn, t1 AS token, max(sim) AS sim FROM met GROUP BY ALL), best2 AS (SELECT conv_id, turn, t2 AS token, max(sim) AS sim FROM met GROUP BY ALL),
  share1 AS (SELECT conv_id, turn, sum(coalesce(idf, 0) * coalesce(sim, 0)) / nullif(sum(coalesce(idf, 0)), 0) AS s FROM s1 LEFT JOIN best1 USING (conv_id, turn, token) LEFT JOIN df USING (token) WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM s2) GROUP BY 1, 2),
  share2 AS (SELECT conv_id, turn, sum(coalesce(idf, 0) * coalesce(sim, 0)) / nullif(sum(coalesce(idf, 0)), 0) AS s FROM s2 LEFT JOIN best2 USING (conv_id, turn, token) LEFT JOIN df USING (token) WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM s1) GROUP BY 1, 2)""",
    ),
)
def aligned_similarity(spark, sf):
    """Each turn against the next one of its conversation; a word's vector is the one of number (a hash of the word) mod the number of vectors."""
    rows = V.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")
    pairs = cut(rows.select("conv_id", "turn", words("text").alias("prediction"), words("ref").alias("reference")))
    vec = V.vectors(spark, sf)
    token = pairs.select(F.explode(F.concat("prediction", "reference")).alias("token")).distinct()
    number = (F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long") % vec.count()).alias("vec_id")
    vectors = token.select("token", number).join(vec, "vec_id")
    out = metrics.aligned_similarity(pairs, vectors, metrics.token_weights(pairs, "reference"), ("conv_id", "turn"))
    return out.select("conv_id", "turn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("bleu_rouge")
def bleu_rouge(spark, sf):
    """BLEU and ROUGE of each turn against the next one of its conversation."""
    rows = V.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    return rows.select("conv_id", "turn", metrics.text_metrics("text", "ref").alias("m")).select("conv_id", "turn", "m.*")
