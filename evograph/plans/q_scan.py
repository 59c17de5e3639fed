"""Scans, projections, filters, set operations and text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions import dates, text
from evograph.operators import graph, retrieval
from evograph.plans import views as V
from evograph.plans.views import with_views
from evograph.streaming.notes import by_time

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("note_render", with_views("notes", "SELECT note_id, note_pos, speaker, 'Speaker ' || speaker || ' says: ' || coalesce(text, '') AS content FROM notes"))
def note_render(spark, sf):
    return V.notes(spark, sf).select("note_id", "note_pos", "speaker", "content")


@query("event_kind_filter", with_views("ev", "SELECT event_id, kind, value FROM ev WHERE kind IN ('click', 'view', 'purchase', 'signup')"))
def event_kind_filter(spark, sf):
    return V.events(spark, sf).where(F.col("kind").isin("click", "view", "purchase", "signup")).select("event_id", "kind", "value")


@query("id_suffix_drop", "SELECT 'q' || conv_id || CASE WHEN conv_id % 7 = 0 THEN '_abs' ELSE '' END AS question_id, count(*) AS turns FROM conversations WHERE NOT ends_with('q' || conv_id || CASE WHEN conv_id % 7 = 0 THEN '_abs' ELSE '' END, '_abs') GROUP BY 1")
def id_suffix_drop(spark, sf):
    qid = F.concat(F.lit("q"), F.col("conv_id"), F.when(F.col("conv_id") % 7 == 0, "_abs").otherwise(""))
    rows = V.table(spark, sf, "conversations").select(qid.alias("question_id"))
    return rows.where(~F.col("question_id").endswith("_abs")).groupBy("question_id").agg(F.count(F.lit(1)).alias("turns"))


# A question of conversation c may use the notes of conversations c and c + 1.
_ALLOWED = "allowed AS (SELECT DISTINCT q.conv_id AS qid, n.note_id, n.conv, n.note_pos FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') q JOIN notes n ON n.conv = q.conv_id OR n.conv = q.conv_id + 1)"


def _allowed(spark, sf):
    asked = V.table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("qid")).distinct()
    haystack = asked.select("qid", F.explode(F.array("qid", F.col("qid") + 1)).alias("conv"))
    return haystack.join(V.notes(spark, sf), "conv").select("qid", "note_id", "conv", "note_pos")


@query("allowed_notes_semi", with_views("notes", "SELECT qid, note_id FROM allowed", _ALLOWED))
def allowed_notes_semi(spark, sf):
    return _allowed(spark, sf).select("qid", "note_id")


@query("redensified_view", with_views("notes", "SELECT qid, note_id, row_number() OVER (PARTITION BY qid ORDER BY conv, note_pos) - 1 AS view_pos FROM allowed", _ALLOWED))
def redensified_view(spark, sf):
    pos = F.row_number().over(W.partitionBy("qid").orderBy("conv", "note_pos")) - 1
    return _allowed(spark, sf).select("qid", "note_id", pos.cast("long").alias("view_pos"))


@query(
    "view_links",
    with_views(
        "notes",
        """SELECT a.qid, a.note_id, b.view_pos AS link FROM placed a JOIN notes n USING (note_id) CROSS JOIN (SELECT unnest([1, 2]) AS step) s
           JOIN placed b ON b.qid = a.qid AND b.conv = n.conv AND b.note_pos = n.note_pos + step""",
        _ALLOWED + ", placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY conv, note_pos) - 1 AS view_pos FROM allowed)",
    ),
)
def view_links(spark, sf):
    """Links of a note (to the next two of its conversation) as positions of the question's view; others are dropped."""
    placed = _allowed(spark, sf).withColumn("view_pos", (F.row_number().over(W.partitionBy("qid").orderBy("conv", "note_pos")) - 1).cast("long"))
    links = placed.select("qid", "note_id", "conv", F.explode(F.array(F.col("note_pos") + 1, F.col("note_pos") + 2)).alias("to"))
    return links.join(placed.select("qid", "conv", F.col("note_pos").alias("to"), F.col("view_pos").alias("link")), ["qid", "conv", "to"]).select("qid", "note_id", "link")


@query(
    "induced_subgraph",
    with_views("ev sup", "SELECT s.src, s.dst, s.edge_type FROM sup s JOIN ev a ON a.event_id = s.src JOIN ev b ON b.event_id = s.dst WHERE a.event_id % 10 < 7 AND b.event_id % 10 < 7"),
)
def induced_subgraph(spark, sf):
    """Edges between events that have an allowed note (an event's notes are numbered by its id's last digit here)."""
    ev = V.events(spark, sf).withColumn("source_note_ids", F.array(F.col("event_id") % 10))
    allowed = spark.range(7).withColumnRenamed("id", "note_id")
    return graph.induced(ev, V.supersessions(spark, sf), allowed)[1].select("src", "dst", "edge_type")


@query(
    "notes_by_time",
    with_views("notes", "SELECT conv, turn // 4 AS slot, string_agg(note_id, ',' ORDER BY note_pos) AS note_ids FROM notes WHERE trim(coalesce(text, '')) <> '' AND length(text) % 5 <> 0 GROUP BY 1, 2"),
)
def notes_by_time(spark, sf):
    """Notes by time (here a slot of four turns); those without content (here each text whose length 5 divides) are left out."""
    rows = V.notes(spark, sf).withColumn("timestamp", F.expr("turn div 4")).withColumn("content", F.when(F.length("text") % 5 != 0, F.col("text")))
    return by_time(rows).select("conv", F.col("timestamp").alias("slot"), F.array_join("note_ids", ",").alias("note_ids"))


@query(
    "graph_summary",
    with_views("ev sup", "SELECT conv, coalesce(n, 0) AS n_events, coalesce(m, 0) AS n_edges, coalesce(g, 0) AS n_invalidated FROM (SELECT conv, count(*) AS n FROM ev GROUP BY 1) FULL JOIN (SELECT conv, count(*) AS m, count(*) FILTER (edge_type = 'updates') AS g FROM sup GROUP BY 1) USING (conv)"),
)
def graph_summary(spark, sf):
    """Events, edges and invalid edges of each conversation (here the updates are)."""
    edges = V.supersessions(spark, sf).withColumn("t_invalid_at", F.when(F.col("edge_type") == "updates", F.col("event_date")))
    return graph.summary(V.events(spark, sf), edges)


@query("first_wins_dedup", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_dedup(spark, sf):
    return retrieval.first_seen(V.table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])


@query("content_hash_dedup", "SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf):
    return V.table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "session_order",
    with_views("sess", "SELECT session_id, row_number() OVER (PARTITION BY conv ORDER BY event_date, session_id) - 1 AS ordinal, 'session_' || (row_number() OVER (PARTITION BY conv ORDER BY event_date, session_id)) || '_summary' AS summary_key FROM sess"),
)
def session_order(spark, sf):
    n = F.row_number().over(W.partitionBy("conv").orderBy("event_date", "session_id")).cast("long")
    return V.sessions(spark, sf).select("session_id", (n - 1).alias("ordinal"), F.format_string("session_%d_summary", n).alias("summary_key"))


@query(
    "turn_metadata",
    "SELECT conv_id, count(*) AS num_turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS user_turns, max(length(text))::BIGINT AS longest FROM conversations GROUP BY 1",
)
def turn_metadata(spark, sf):
    return V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max(F.char_length("text")).cast("long").alias("longest"))


@query("json_props", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return V.table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    "seed_union_ordered",
    with_views(
        "ev",
        "SELECT qid, event_id, row_number() OVER (PARTITION BY qid ORDER BY channel, ord, event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid, event_id ORDER BY channel, ord) AS n FROM (SELECT u AS qid, event_id, value AS ord, 0 AS channel FROM ev WHERE kind = 'purchase' UNION ALL SELECT u, event_id, event_id::DOUBLE, 1 FROM ev WHERE value > 50)) WHERE n = 1",
    ),
)
def seed_union_ordered(spark, sf):
    ev = V.events(spark, sf)
    a = ev.where("kind = 'purchase'").select(F.col("u").alias("qid"), "event_id", F.col("value").alias("ord"))
    b = ev.where("value > 50").select(F.col("u").alias("qid"), "event_id", F.col("event_id").cast("double").alias("ord"))
    return retrieval.union_ordered([a, b], ["event_id"]).select("qid", "event_id", "place")


@query("hyperedge_view", with_views("sess", "SELECT session_id AS h_id, 'session' AS edge_type, n_events AS members FROM sess UNION ALL SELECT 'topic_' || conv || '_' || topic_num, 'topic', count(*) FROM sess GROUP BY conv, topic_num"))
def hyperedge_view(spark, sf):
    s = V.sessions(spark, sf)
    topics = s.groupBy("conv", "topic_num").agg(F.count(F.lit(1)).alias("members")).select(F.concat_ws("_", F.lit("topic"), "conv", "topic_num").alias("h_id"), F.lit("topic").alias("edge_type"), "members")
    return s.select(F.col("session_id").alias("h_id"), F.lit("session").alias("edge_type"), F.col("n_events").alias("members")).unionByName(topics)


@query("uncovered_except", with_views("ev sup", "SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM sup WHERE src = event_id) AND NOT EXISTS (SELECT 1 FROM sup WHERE dst = event_id)"))
def uncovered_except(spark, sf):
    covered = V.supersessions(spark, sf).select(F.explode(F.array("src", "dst")).alias("event_id"))
    return V.events(spark, sf).select("event_id").join(covered, "event_id", "left_anti")


_TOK = "list_filter(string_split_regex(translate(lower({0}), '.,!?', '    '), '\\s+'), lambda t: t <> '')"


@query(
    "token_f1",
    f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
    s AS (SELECT conv_id, turn, lower(trim(text)) = lower(trim(ref)) AS same, list_distinct({_TOK.format("text")}) AS a, list_distinct({_TOK.format("ref")}) AS b FROM t WHERE ref IS NOT NULL)
    SELECT conv_id, turn, same AS exact_match, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) END::DOUBLE AS f1 FROM s""",
)
def token_f1(spark, sf):
    from evograph.operators.metrics import exact_match, token_f1

    rows = V.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    return rows.select("conv_id", "turn", exact_match(F.col("text"), F.col("ref")).alias("exact_match"), F.round(token_f1(F.col("text"), F.col("ref")), 6).alias("f1"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query("key_terms", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))), ' ') AS terms FROM benchmark")
def key_terms(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", F.array_join(text.key_terms(F.col("text")), " ").alias("terms"))


_KW_STOP = "[" + ", ".join(f"'{w}'" for w in text.KEYWORD_STOP_WORDS) + "]"


@query(
    "keyword_heuristic",
    f"""WITH p AS (SELECT item_id, unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM benchmark),
    d AS (SELECT item_id, lower(w) AS word, arg_min(w, i) AS w, min(i) AS i FROM p WHERE regexp_full_match(w, '[A-Za-z]{{3,}}') AND NOT list_contains({_KW_STOP}, lower(w)) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN regexp_matches(w, '^[A-Z]') THEN 0 ELSE 1 END, i) AS n FROM d)
    SELECT item_id, string_agg(word, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 5 GROUP BY 1""",
)
def keyword_heuristic(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", F.array_join(text.heuristic_keywords(F.col("text")), " ").alias("keywords")).where("keywords <> ''")


@query("context_heuristic", "SELECT item_id, trim(CASE WHEN regexp_matches(text, '^[^\\n]+?[.!?]\\s') THEN regexp_extract(text, '^([^\\n]+?[.!?])\\s', 1) ELSE left(text, 200) END, ' ' || chr(10) || chr(9) || chr(13)) AS context FROM benchmark")
def context_heuristic(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", text.heuristic_context(F.col("text")).alias("context"))


@query(
    "answer_normalise",
    r"""WITH f AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations),
    a AS (SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Reasoning.' || chr(10) || 'ANSWER: "' || t || '"' WHEN 1 THEN t WHEN 2 THEN 'see Answer: ' || turn || '.' WHEN 3 THEN 'so' || chr(10) || 'ANSWER:' || chr(10) || '  ' || t || chr(10) || 'the end'
      WHEN 4 THEN '```json' || chr(10) || '{"answer": "in ' || turn || '.", "why": 1}' || chr(10) || '```' WHEN 5 THEN 'Answer : ' || t || '..' WHEN 6 THEN t || chr(10) || 'answer:' WHEN 7 THEN 'Answer: no' || chr(10) || ' answer	: “' || t || '”.' END AS raw FROM f),
    -- The last tag that something follows: at a line's start, or else anywhere.
    l AS (SELECT conv_id, turn, raw, regexp_extract_all(raw, '(?:^|\n)[ \t]*(?i:answer)\s*:\s*([^\n]+)', 1) AS s, regexp_extract_all(raw, '(?i:answer)\s*:\s*([^\n]+)', 1) AS i FROM a),
    c AS (SELECT conv_id, turn, CASE WHEN len(s) > 0 THEN s[-1] WHEN len(i) > 0 THEN i[-1] WHEN starts_with(raw, '```') THEN json_extract_string(regexp_extract(raw, '\{.*\}'), '$.answer') ELSE raw END AS v FROM l),
    q AS (SELECT conv_id, turn, trim(trim(trim(v, ' ' || chr(9) || chr(10)), '"''“”‘’'), ' ' || chr(9) || chr(10)) AS v FROM c)
    SELECT conv_id, turn, CASE WHEN ends_with(v, '.') AND NOT regexp_matches(v, '[0-9]\.$') THEN trim(left(v, length(v) - 1)) ELSE v END AS answer FROM q""",
)
def answer_normalise(spark, sf):
    """Answers in eight forms: a quoted tag, plain, a tag in a line, before a line end, JSON in fences, white space before the colon, an empty tag, two tags."""
    flat, turn = F.translate("text", "\n", " "), F.col("turn")
    forms = ['Reasoning.\nANSWER: "%s"', "%s", "see Answer: #.", "so\nANSWER:\n  %s\nthe end", '```json\n{"answer": "in #.", "why": 1}\n```', "Answer : %s..", "%s\nanswer:", "Answer: no\n answer\t: “%s”."]
    raw = F.get(F.array(*(F.replace(F.replace(F.lit(f), F.lit("#"), turn.cast("string")), F.lit("%s"), flat) for f in forms)), (turn % 8).cast("int"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", text.parse_answer(raw).alias("answer"))


@query(
    "date_parse_multi",
    """SELECT o_orderkey, o_orderdate::TIMESTAMP AS parsed, o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 6 < 5
    UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 6 = 5""",
)
def date_parse_multi(spark, sf):
    """Each order's date is written in one of five formats (a sixth is none) and read again."""
    d, r = F.col("o_orderdate"), F.col("o_orderkey") % 6
    written = F.when(r == 0, F.date_format(d, "yyyy-MM-dd")).when(r == 1, F.date_format(d, "yyyyMMdd")).when(r == 2, F.date_format(d, "yyyy/M/d")).when(r == 3, F.date_format(d, "MMMM d, yyyy")).when(r == 4, F.date_format(d, "MMM d, yyyy")).otherwise("some day")
    parsed = dates.try_parse_date(written)
    return V.table(spark, sf, "orders").select("o_orderkey", parsed.alias("parsed"), F.when(r != 5, F.coalesce(dates.day_prefix(written), parsed.cast("date"))).alias("day"))


@query(
    "nickname_prefix",
    """WITH names AS (SELECT DISTINCT lower(n_name) AS name FROM nation), p AS (SELECT name, left(name, i::BIGINT) AS prefix FROM names, unnest(range(3, length(name))) AS u(i)),
    one AS (SELECT prefix, min(name) AS name FROM p GROUP BY 1 HAVING count(DISTINCT name) = 1)
    SELECT prefix, name FROM one WHERE prefix NOT IN (SELECT name FROM names) UNION ALL SELECT name, name FROM names""",
)
def nickname_prefix(spark, sf):
    from evograph.operators.hierarchy import nickname_map

    return nickname_map(V.table(spark, sf, "nation").select(F.lower("n_name").alias("name")))


_QTYPE = " OR ".join([f"starts_with(q, '{x}')" for x in text.TEMPORAL_STARTS] + [f"contains(q, '{x}')" for x in text.TEMPORAL_PARTS])


@query(
    "question_type",
    f"""WITH asked AS (SELECT conv_id, turn, lower(trim(CASE turn % 6 WHEN 0 THEN 'When ' WHEN 1 THEN 'and in what year ' WHEN 2 THEN 'Since when ' WHEN 3 THEN 'first ' ELSE '' END || text)) AS q FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN {_QTYPE} THEN 'temporal' ELSE 'default' END AS qtype FROM asked""",
)
def question_type(spark, sf):
    """Users' turns, some with the beginning of a question before them."""
    n = F.col("turn") % 6
    head = F.when(n == 0, "When ").when(n == 1, "and in what year ").when(n == 2, "Since when ").when(n == 3, "first ").otherwise("")
    return V.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.question_type(F.concat(head, "text")).alias("qtype"))


@query("hash_functions", "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS prompt_hash, md5(text) AS content_hash, (strpos('0123456789abcdef', substr(sha256(text), 64, 1)) - 1) % 2 AS parity FROM conversations")
def hash_functions(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "conversations").select("conv_id", "turn", text.prompt_hash(t).alias("prompt_hash"), F.md5("text").alias("content_hash"), text.parity_bit(t).cast("long").alias("parity"))
