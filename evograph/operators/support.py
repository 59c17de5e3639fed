"""Answer-aware evidence: paths that support a given answer, and how well they ground it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions.text import key_terms
from evograph.operators import paths, retrieval

#: Weights of a support path's score, and what an answer event adds.
WEIGHTS = {"answer": 0.35, "query": 0.25, "conf": 0.25, "temporal": 0.15}
ANSWER_BONUS, MIN_SIMILARITY, SEEDS, DETAIL = 0.15, 0.35, 5, 150


def grounding(answer: Column, query: Column, event_text: Column) -> Column:
    """The share of the answer's and the question's key terms that the events' text has; 0.5 if there are none."""
    terms = F.array_union(key_terms(answer), key_terms(query))
    n = F.size(terms)
    return F.when(n == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect(terms, key_terms(event_text))) / n)


def relevant_sentences(text: Column, terms: Column, most: int = 2, least: int = 10) -> Column:
    """The sentences (of `least` characters or more) that contain most of the terms, at least one, joined by semicolons; ties in their order."""
    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.char_length(x) >= least)
    hits = lambda x: F.size(F.filter(terms, lambda t: F.contains(F.lower(x), t)))
    ranked = F.array_sort(F.filter(F.transform(sentences, lambda x, i: F.struct((-hits(x)).alias("neg"), i.alias("i"), x.alias("x"))), lambda s: s["neg"] < 0))
    return F.array_join(F.transform(F.slice(ranked, 1, most), lambda s: s["x"]), "; ")


def session_details(steps: Column, summaries: Column, terms: Column) -> Column:
    """For each event of a path (steps: with kind, node) what its session's summary says about the terms, at most DETAIL characters. summaries: map of node -> summary."""
    events = F.filter(steps, lambda x: x["kind"] == "event")
    return F.transform(events, lambda e: F.substring(F.coalesce(relevant_sentences(F.try_element_at(summaries, e["node"]), terms), F.lit("")), 1, DETAIL))


def seeds(events: DataFrame, queries: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, event_id, place: the events nearest to the question, then those nearest to the answer, each once."""
    near = lambda q: retrieval.knn(events, q, SEEDS, "event_id", MIN_SIMILARITY).withColumnRenamed("rank", "ord")
    return retrieval.union_ordered([near(queries), near(answers)], ["event_id"])


def support_score(answer_sim: Column, query_sim: Column, conf: Column, temporal: Column, has_answer_event: Column) -> Column:
    base = WEIGHTS["answer"] * answer_sim + WEIGHTS["query"] * query_sim + WEIGHTS["conf"] * conf + WEIGHTS["temporal"] * temporal
    return base + F.when(has_answer_event, ANSWER_BONUS).otherwise(0.0)


def support_paths(seeded: DataFrame, edges: DataFrame, nodes: DataFrame, node_sims: DataFrame, answers: DataFrame, top_k: int = 5, depth: int = 4) -> DataFrame:
    """The best grounded paths: qid, path_rank, score, grounding, place, and nodes, labels, kinds, steps, conf, answer_sim, query_sim.

    seeded: qid, conv, node, seed_rank; nodes: conv, node, kind, day, update_val, state_change; node_sims: qid, node,
    answer_sim, query_sim, is_answer; answers: qid, answer, query. Paths are pruned as any (dates, contradictions in
    a row), and those that ground nothing are dropped.
    """
    found = paths.bfs_paths(seeded, edges, nodes.select("conv", "node", "kind"), depth, 8 * top_k)
    pruned = paths.score_paths(found, nodes)
    steps = pruned.select("qid", "path_rank", F.explode("nodes").alias("node"))
    top = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    per = steps.join(node_sims, ["qid", "node"], "left").groupBy("qid", "path_rank").agg(top("answer_sim").alias("answer_sim"), top("query_sim").alias("query_sim"), F.coalesce(F.bool_or("is_answer"), F.lit(False)).alias("hit"))
    said = F.array_join(F.transform(F.filter("steps", lambda x: x["kind"] == "event"), lambda x: F.coalesce(x["state_change"], F.lit(""))), " ")
    scored = pruned.join(per, ["qid", "path_rank"]).join(answers, "qid").withColumn("grounding", grounding(F.col("answer"), F.col("query"), said)).where("grounding > 0")
    scored = scored.withColumn("score", F.round(support_score(F.col("answer_sim"), F.col("query_sim"), F.col("conf"), F.col("temporal"), F.col("hit")), 6))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "path_rank"))
    kept = scored.withColumn("place", rank.cast("long")).where(F.col("place") <= top_k)
    return kept.select("qid", "conv", "path_rank", "score", F.round("grounding", 6).alias("grounding"), "place", "nodes", "labels", "kinds", "steps", "conf", "temporal", "answer_sim", "query_sim", "answer", "query")


def explained(support: DataFrame, event_summaries: DataFrame) -> DataFrame:
    """qid, place, explanation of support paths, with details from the summaries of their events' sessions (conv, node, summary)."""
    long = support.select("qid", "place", "conv", F.explode("nodes").alias("node")).join(event_summaries, ["conv", "node"])
    about = long.groupBy("qid", "place").agg(F.map_from_entries(F.collect_list(F.struct("node", "summary"))).alias("summaries"))  # at most a row a node of the path
    rows = support.join(about, ["qid", "place"], "left").withColumn("terms", F.array_union(key_terms(F.col("answer")), key_terms(F.col("query"))))
    details = F.when(F.col("summaries").isNotNull(), session_details(F.col("steps"), F.col("summaries"), F.col("terms")))
    return rows.select("qid", "place", paths.explanation(F.col("steps"), paths.link_types(F.col("labels"), F.col("kinds")), F.col("score"), F.col("answer_sim"), F.col("conf"), F.col("temporal"), F.col("query_sim"), details).alias("explanation"))


def explanation_pick(rows: DataFrame, paths_most: int = 2, direct_most: int = 2, most: int = 3) -> DataFrame:
    """At most two paths, then at most two direct pieces, three in all: so a direct piece stays if there is any. rows: qid, origin, score, ord."""
    by_kind = F.row_number().over(W.partitionBy("qid", "origin").orderBy(F.desc("score"), "ord"))
    limit = F.when(F.col("origin") == "direct", direct_most).otherwise(paths_most)
    kept = rows.withColumn("k", by_kind).where(F.col("k") <= limit)
    place = F.row_number().over(W.partitionBy("qid").orderBy((F.col("origin") == "direct").cast("int"), "k"))
    return kept.withColumn("p", place).where(F.col("p") <= most).drop("p")


def expansion_notes(notes: DataFrame, min_similarity: float = 0.4) -> DataFrame:
    """Notes of a path that are similar enough to the question; those without a vector (sim null) are dropped."""
    return notes.where(F.col("sim") >= min_similarity)
