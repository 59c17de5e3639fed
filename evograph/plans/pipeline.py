"""The three entry points: build a graph, ask questions, ingest sessions as they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.functions import dates
from evograph.functions.text import token_count
from evograph.functions.vector import cosine
from evograph.operators import context, graph, hierarchy, overlap, paths, retrieval, support, validity
from evograph.shared import cut


@dataclass(frozen=True)
class Config:
    """Knobs of build and ask; with augmentation off, sessions and topics aren't walked. count: a text's tokens, as a column function (a tokenizer's, say)."""

    support_jaccard: float = 0.5
    support_k: int = 5
    temporal_jaccard: float = 0.3
    temporal_k: int = 20
    supersede_jaccard: float = 0.5
    supersede_k: int = 10
    past_only: bool = True
    topic_gate: bool = True
    window: int | None = None
    hierarchy: bool = True
    top_k: int = 10
    max_depth: int = 3
    notes_budget: int = 3000
    paths_budget: int = 1500
    total_budget: int = 5000
    note_dedup: str = "note_id"
    min_path_score: float = 0.3
    note_min_similarity: float = 0.4
    paths_shown: int = 3
    expand: bool = False
    expand_notes: int = 8
    update_aware: bool = True
    fallback_dedup: str = "off"
    paths_alone: bool = False
    count: Callable[[Column], Column] = token_count
    limits: dict = field(default_factory=lambda: dict(paths.LIMITS))
    category_overrides: dict = field(default_factory=dict)

    def without_hierarchy(self) -> Config:
        return replace(self, hierarchy=False, limits={**self.limits, "session": (0, 0), "topic": (0, 0)})

    def for_category(self, category: str) -> Config:
        return replace(self, **self.category_overrides.get(category, {}))

    @classmethod
    def read(cls, path: str) -> Config:
        """A JSON file's values over the defaults; keys that are no knob are an error."""
        with open(path, encoding="utf-8") as f:
            out = cls(**json.load(f))
        return out if out.hierarchy else out.without_hierarchy()


def build(events: DataFrame, verdicts: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """events: conv, event_id, event_seq, participants, event_date, session_num, topic_num; verdicts: conv, src, dst,
    edge_type, confidence, event_date (recorded or by rule). Gives events, edges, sessions, chain.

    Candidates for support and for temporal edges are events of other sessions, capped before the topic gate; verdicts of the
    model come from the candidates' pairs; temporal edges need no model. Edges are written event by event (of an
    event the temporal ones first, in the order of their candidates), then the verdicts. Only updates propagate. Write the tables (sources.sinks) before asking:
    the path search reads them once a level.
    """
    config = config or Config()
    gate = (lambda df: overlap.gated(df, "topic_num")) if config.topic_gate else (lambda df: df)
    near = gate(overlap.overlap_topk(events, config.support_jaccard, config.support_k, group="session_num", keep=("topic_num", "event_seq")))
    supports = near.select("conv", F.col("cand_id").alias("src"), F.col("event_id").alias("dst"), F.lit("supports").alias("edge_type"), F.col("jaccard").alias("confidence"), "event_seq", "rank")
    if config.past_only:
        supports = supports.where("src < dst")
    dated = gate(overlap.overlap_topk(events, config.temporal_jaccard, config.temporal_k, group="session_num", keep=("event_date", "topic_num", "event_seq")))
    temporal = overlap.temporal_edges(dated, "event_date", "cand_event_date", ("event_seq", "rank"))
    updates = verdicts.join(events.select("conv", F.col("event_id").alias("src"), "event_seq"), ["conv", "src"], "left").select("conv", "src", "dst", "edge_type", "confidence", F.coalesce("event_seq", F.lit(0)).alias("event_seq"), F.lit(1).alias("rank"))
    # Of an ordered pair the last write's edge stays, at the place of the first one: by phase, event, kind and candidate.
    writes = None
    for phase, kind, df in ((0, 0, temporal), (0, 1, supports), (1, 0, updates)):
        place = F.lit(phase * PHASE) + F.col("event_seq") * 128 + kind * 64 + F.least("rank", F.lit(63))
        df = df.select("conv", "src", "dst", "edge_type", "confidence", place.alias("edge_seq"))
        writes = df if writes is None else writes.unionByName(df)
    edges = graph.upsert_edges(writes).withColumn("t_invalid_at", F.lit(None).cast("date"))
    fresh = events.withColumn("valid_until", F.lit(None).cast("date")).withColumn("update_val", F.lit(1.0))
    anchors = verdicts.where("edge_type = 'updates'").select("conv", "src", "dst", F.col("event_date").alias("anchor"))
    new_events, new_edges = validity.propagate_updates(fresh, edges, anchors)
    sessions = events.groupBy("conv", "session_num").agg(F.min("event_date").alias("date_time"), F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.min("topic_num").alias("topic_num"))
    sessions = sessions.withColumn("session_id", F.concat_ws("_", F.lit("session"), "conv", "session_num"))
    out = {"events": new_events, "edges": new_edges, "sessions": sessions, "chain": graph.chain(sessions)}
    if config.hierarchy:
        members = sessions.select("conv", "session_id", F.explode("event_ids").alias("node"))
        stars = graph.star(members.select("conv", F.col("node").cast("string").alias("node"), "session_id"), "node", "session_id", "belongs_to", "contains")
        topics = sessions.select("conv", "session_id", F.concat_ws("_", F.lit("topic"), "conv", "topic_num").alias("topic_id"))
        out["stars"] = stars.unionByName(graph.star(topics, "session_id", "topic_id", "belongs_to_topic", "topic_contains"))
    return out


def _nodes(built: dict[str, DataFrame], walk: bool) -> DataFrame:
    """conv, node (text), kind, day, update_val, and what is shown of a node: state_change, time_anchor, event_type, text."""
    ev = built["events"]
    text = lambda df, c, other: F.coalesce(F.col(c).cast("string"), other) if c in df.columns else other
    anchor = text(ev, "time_anchor", text(ev, "event_date", F.lit("unknown")))
    day = F.col("event_date").cast("date") if "event_date" in ev.columns else dates.day_prefix(anchor)
    name = F.col("event_id").cast("string")
    rows = ev.select("conv", name.alias("node"), F.lit("event").alias("kind"), day.alias("day"), "update_val", text(ev, "state_change", F.concat(F.lit("event "), name)).alias("state_change"), anchor.alias("time_anchor"), text(ev, "event_type", text(ev, "kind", F.lit("action"))).alias("event_type"), F.lit(None).cast("string").alias("text"))
    if walk and "stars" in built:
        stars, sessions = built["stars"], built["sessions"]
        null = lambda kind: F.lit(None).cast(kind)
        inner = lambda up, kind: stars.where(F.col("edge_type") == up).select("conv", F.col("dst").alias("node")).distinct().withColumn("kind", F.lit(kind))
        said = sessions.select("conv", F.col("session_id").alias("node"), text(sessions, "summary", null("string")).alias("text"))
        if "topics" in built:
            said = said.unionByName(built["topics"].select("conv", F.col("topic_id").alias("node"), F.col("label").alias("text")))
        more = inner("belongs_to", "session").unionByName(inner("belongs_to_topic", "topic")).join(said, ["conv", "node"], "left")
        blank = {"day": "date", "update_val": "double", "state_change": "string", "time_anchor": "string", "event_type": "string"}
        rows = rows.unionByName(more.select("conv", "node", "kind", *(null(k).alias(c) for c, k in blank.items()), "text"))
    return rows


def _walked(built: dict[str, DataFrame], walk: bool) -> DataFrame:
    """All edges with their ends as text, in adjacency order; stars after the others."""
    edges = built["edges"].select("conv", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "edge_type", "confidence", "adj_pos", "t_invalid_at")
    if walk and "stars" in built:
        edges = edges.unionByName(built["stars"].select("conv", "src", "dst", "edge_type", "confidence", (F.lit(2 * PHASE) + F.pmod(F.xxhash64("src", "dst"), F.lit(10**12))).alias("adj_pos"), F.lit(None).cast(edges.schema["t_invalid_at"].dataType).alias("t_invalid_at")))
    return edges


def _seeds(questions: DataFrame, near: DataFrame, note_events: DataFrame, events: DataFrame, edges: DataFrame, config: Config, event_vectors, entities, concepts, hierarchical) -> DataFrame:
    """qid, conv, node, seed_rank: events of the retrieved notes, then their other versions, then those of the question's entities
    and concepts, then those that the hierarchy gives; each once, at its first place."""
    own = near.join(note_events, "note_id").join(events.select("event_id", "conv", "event_seq"), "event_id")
    place = F.row_number().over(W.partitionBy("qid").orderBy("rank", "event_seq"))
    first = retrieval.first_seen(own, ["qid", "event_id"], ["rank"]).select("qid", "conv", F.col("event_id").cast("string").alias("node"), place.cast("long").alias("ord"))
    channels = [first]
    if config.update_aware:
        channels.append(retrieval.update_versions(first, edges))
    if entities is not None:
        member = events.select("conv", F.col("event_id"), F.col("event_id").cast("string").alias("node"), F.col("event_seq").alias("seq"), F.explode("participants").alias("member"), (F.col("time_anchor") if "time_anchor" in events.columns else F.col("event_date").cast("string")).alias("anchor"))
        met = entities.select("qid", "conv").distinct().join(member.withColumn("member", F.lower("member")), "conv")
        if event_vectors is not None:
            met = met.join(event_vectors.select("event_id", "v", "norm"), "event_id", "left").join(questions.select("qid", "qv", "qnorm"), "qid").withColumn("sim", cosine(F.col("v"), F.col("qv"), F.col("norm"), F.col("qnorm")))
        else:
            met = met.withColumn("sim", F.lit(None).cast("double"))
        channels.append(retrieval.entity_events(entities, met.select("qid", "conv", "member", "node", "seq", "sim", "anchor")))
    if concepts is not None and event_vectors is not None:
        hit = retrieval.knn_scoped(event_vectors, concepts, CONCEPTS, "event_id", min_similarity=CONCEPT_MIN)
        channels.append(hit.join(questions.select("qid", "conv"), "qid").select("qid", "conv", F.col("event_id").cast("string").alias("node"), F.col("rank").alias("ord")))
    if hierarchical is not None:
        topics, sessions, session_events = hierarchical
        hit = retrieval.hierarchical_events(questions, topics, sessions, session_events, first.select("qid", F.col("node").cast(events.schema["event_id"].dataType).alias("event_id")))
        channels.append(hit.join(events.select("event_id", "conv"), "event_id").select("qid", "conv", F.col("event_id").cast("string").alias("node"), "ord"))
    return retrieval.union_ordered(channels, ["conv", "node"]).select("qid", "conv", "node", F.col("place").alias("seed_rank"))


#: Places of a phase's writes.
PHASE = 1 << 60
#: Concept seeds of a question, at most, and their least similarity.
CONCEPTS, CONCEPT_MIN = 8, 0.3


def ask(
    questions: DataFrame, notes: DataFrame, note_events: DataFrame, built: dict[str, DataFrame], config: Config | None = None, links: DataFrame | None = None, event_vectors: DataFrame | None = None,
    entities: DataFrame | None = None, concepts: DataFrame | None = None, hierarchical: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """qid, context, explanation, n_paths, n_seeds, fallback: one batched plan for all questions.

    questions: qid, conv, qv, qnorm; notes: note_id, v, norm, text, and conv if a question may use its conversation's alone;
    note_events: note_id, event_id; built: of build(); links: note_id, pos, linked; event_vectors: conv, event_id, v, norm (of
    the events' descriptions; for direct evidence); entities: qid, conv, entity, n; concepts: qid, conv, qv, qnorm;
    hierarchical: topics, sessions and events as for retrieval.hierarchical_events.

    Retrieved notes give seed events, further channels add to them, paths from the seeds are pruned and scored, direct
    evidence joins the best ones, and the context holds the notes, then the paths with their notes, within the
    budgets. A question without seeds gets its retrieved notes alone.
    """
    config = config or Config()
    walk = config.hierarchy
    events = built["events"]
    find = retrieval.knn_scoped if "conv" in notes.columns else retrieval.knn
    near = cut(find(notes, questions, config.top_k, "note_id").select("qid", "note_id", "rank"))
    edges, nodes = _walked(built, walk), cut(_nodes(built, walk))
    seeds = cut(_seeds(questions, near, note_events, events, edges.where("edge_type IN ('updates', 'contradicts')"), config, event_vectors, entities, concepts, hierarchical))
    found = paths.bfs_paths(seeds, edges, nodes.select("conv", "node", "kind"), config.max_depth, 5 * config.top_k, config.limits)

    # Similarity of an event: the best of its notes; only of events on paths.
    on_path = found.select("qid", F.explode("nodes").alias("node")).distinct()
    of_notes = on_path.join(note_events.select("note_id", F.col("event_id").cast("string").alias("node")), "node")
    sims = of_notes.join(notes.select("note_id", "v", "norm"), "note_id").join(questions.select("qid", "qv", "qnorm"), "qid")
    sims = sims.groupBy("qid", "node").agg(F.max(cosine(F.col("v"), F.col("qv"), F.col("norm"), F.col("qnorm"))).alias("sim"))
    scored = cut(paths.score_paths(found, nodes, sims).withColumn("ord", F.col("path_rank")))
    columns = ["qid", "conv", "nodes", "labels", "kinds", "steps", "neural", "conf", "temporal", "upd", "score", "ord"]
    direct = scored.select(*columns).limit(0)
    if event_vectors is not None:
        near_events = event_vectors.select("conv", F.col("event_id").cast("string").alias("node"), "v", "norm").join(questions.join(seeds.select("qid").distinct(), "qid", "left_semi"), "conv")
        near_events = near_events.select("qid", "node", cosine(F.col("v"), F.col("qv"), F.col("norm"), F.col("qnorm")).alias("sim"))
        covered = scored.select("qid", F.explode("nodes").alias("node")).unionByName(seeds.select("qid", "node"))
        alone = paths.direct_evidence(near_events, covered).join(questions.select("qid", "conv"), "qid")
        alone = alone.select("qid", "conv", F.col("ord").alias("path_rank"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("labels"), F.array(F.lit("event")).alias("kinds"), "sim", "score", "ord")
        alone = paths.with_nodes(alone, nodes).withColumn("upd", F.col("steps")[0]["update_val"])
        direct = alone.select("qid", "conv", "nodes", "labels", "kinds", "steps", F.col("sim").alias("neural"), F.lit(1.0).alias("conf"), F.lit(1.0).alias("temporal"), "upd", "score", "ord")
    best = cut(paths.merge_direct(scored.select(*columns), direct, config.top_k))

    # Section 1: retrieved notes and what they link to; section 2: the best paths, each with its notes.
    listed = near
    if config.expand:
        listed = near.unionByName(_expanded(near, seeds, edges, note_events, config.expand_notes))
    first = context.neighbours(listed, links, config.top_k) if links is not None else listed.withColumn("step", F.lit(0))
    texts = notes.select("note_id", "text")
    place = lambda a, b: F.struct(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).alias("seq")
    none = F.lit(None).cast("string")
    section1 = first.join(texts, "note_id").select("qid", F.lit(1).alias("section"), place("rank", "step"), "text", F.col("note_id").cast("string").alias("note_id"), F.lit(False).alias("header"))
    good = best.where(F.col("score") >= config.min_path_score)
    good = good.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("place"))).where(F.col("place") <= config.paths_shown)
    earlier = F.flatten(F.collect_list("nodes").over(W.partitionBy("qid").orderBy("place").rowsBetween(W.unboundedPreceding, -1)))  # a few paths a question
    shown = good.select("qid", "place", paths.summary_line(F.col("steps"), paths.link_types(F.col("labels"), F.col("kinds")), earlier).alias("text"))
    path_notes = _path_notes(good, note_events, notes, questions, config.note_min_similarity)
    section2 = context.path_section(shown, path_notes, section1).select("qid", F.lit(2).alias("section"), "seq", "text", F.col("note_id").cast("string").alias("note_id"), "header")
    seeded = seeds.select("qid").distinct()
    normal = context.dedup_notes(section1, config.note_dedup).join(seeded, "qid", "left_semi").unionByName(context.dedup_notes(section2.where("note_id IS NOT NULL"), config.note_dedup).unionByName(section2.where("note_id IS NULL")))
    parts = cut(normal.withColumn("tokens", config.count(F.col("text")).cast("long")))
    kept = context.two_sections(parts, config.notes_budget, config.paths_budget, config.total_budget).join(parts.select("qid", "section", "seq", "text"), ["qid", "section", "seq"])
    alone = context.dedup_notes(section1, config.fallback_dedup).join(seeded, "qid", "left_anti")
    whole = context.assemble(kept.select("qid", "section", "seq", "text").unionByName(alone.select("qid", "section", "seq", "text")))

    if config.paths_alone:  # the older form: the paths' notes and a few retrieved ones, without budgets
        every = _path_notes(best.where(F.col("place") <= config.paths_shown), note_events, notes, questions, -1.0)
        form = context.paths_only(every, near.join(texts, "note_id")).select("qid", F.lit(1).alias("section"), "seq", "text")
        whole = context.assemble(form).unionByName(context.assemble(section1.join(every.select("qid").distinct(), "qid", "left_anti").select("qid", "section", "seq", "text")))

    told = support.explanation_pick(best)
    lines = F.when(F.col("origin") == "direct", paths.direct_explanation(F.col("steps")[0], F.col("neural"))).otherwise(paths.explanation(F.col("steps"), paths.link_types(F.col("labels"), F.col("kinds")), F.col("score"), F.col("neural"), F.col("conf"), F.col("temporal"), F.col("upd")))
    title = F.concat(F.when(F.col("origin") == "direct", "--- Direct Evidence ").otherwise("--- Path "), F.col("k"), F.lit(" ---\n"))
    said = told.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((F.col("origin") == "direct").alias("a"), "k", F.concat(title, lines).alias("text")))).alias("x"))  # three at most
    said = said.select("qid", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("explanation"))
    n = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n_paths"))
    m = seeds.groupBy("qid").agg(F.count(F.lit(1)).alias("n_seeds"))
    out = questions.select("qid").join(whole, "qid", "left").join(said, "qid", "left").join(n, "qid", "left").join(m, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("qid", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("explanation", F.lit("")).alias("explanation"), zero(F.col("n_paths")).alias("n_paths"), zero(F.col("n_seeds")).alias("n_seeds"), F.col("n_seeds").isNull().alias("fallback"))


def _path_notes(good: DataFrame, note_events: DataFrame, notes: DataFrame, questions: DataFrame, least: float) -> DataFrame:
    """qid, place, pos, note_id, text: the notes of the paths' events, in order, that are similar enough to the question."""
    events = good.select("qid", "place", F.posexplode(F.filter("steps", lambda x: x["kind"] == "event")).alias("i", "x")).select("qid", "place", "i", F.col("x.node").alias("node"))
    rows = events.join(note_events.select("note_id", F.col("event_id").cast("string").alias("node")), "node").join(notes.select("note_id", "v", "norm", "text"), "note_id").join(questions.select("qid", "qv", "qnorm"), "qid")
    near = support.expansion_notes(rows.withColumn("sim", cosine(F.col("v"), F.col("qv"), F.col("norm"), F.col("qnorm"))), least)
    return near.select("qid", "place", F.row_number().over(W.partitionBy("qid", "place").orderBy("i", "note_id")).alias("pos"), "note_id", "text")


def _expanded(near: DataFrame, seeds: DataFrame, edges: DataFrame, note_events: DataFrame, most: int) -> DataFrame:
    """qid, note_id, rank: notes of the seeds' neighbours that were not retrieved; neighbours are taken whole while fewer than `most` notes came before."""
    side = lambda a, b, n: edges.select("conv", F.col(a).alias("node"), F.col(b).alias("to"), F.lit(n).alias("side"), "adj_pos")
    met = seeds.join(side("src", "dst", 0).unionByName(side("dst", "src", 1)), ["conv", "node"])
    met = met.withColumn("ord", F.row_number().over(W.partitionBy("qid").orderBy("seed_rank", "side", "adj_pos")))
    new = met.join(note_events.select("note_id", F.col("event_id").cast("string").alias("to")), "to").join(near.select("qid", "note_id"), ["qid", "note_id"], "left_anti")
    new = retrieval.first_seen(new.select("qid", "note_id", "ord"), ["qid", "note_id"], ["ord"])
    sizes = new.groupBy("qid", "ord").agg(F.count(F.lit(1)).alias("n_notes"))
    kept = new.join(retrieval.capped_expansion(sizes, most).select("qid", "ord"), ["qid", "ord"])
    last = near.groupBy("qid").agg(F.max("rank").alias("last"))
    return kept.join(last, "qid").select("qid", "note_id", (F.col("last") + F.row_number().over(W.partitionBy("qid").orderBy("ord", "note_id"))).alias("rank"))


def graph_report(built: dict[str, DataFrame]) -> DataFrame:
    """conv, n_events, n_superseded, n_edges, n_invalidated and an edge count by type: what was built."""
    ev = built["events"].groupBy("conv").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("valid_until").isNotNull()).alias("n_superseded"))
    types = built["edges"].groupBy("conv", F.coalesce("edge_type", F.lit("unknown")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t_invalid_at").isNotNull()).alias("gone"))
    ed = types.groupBy("conv").agg(F.sum("n").alias("n_edges"), F.sum("gone").alias("n_invalidated"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("edge_types"))
    return ev.join(ed, "conv", "full")


def ingest(stream: DataFrame, k: int = 10) -> DataFrame:
    """Sessions as they arrive: streaming.incremental.ingest, or its replay for a table."""
    from evograph.streaming import incremental

    return incremental.ingest(stream, k) if stream.isStreaming else incremental.replay(stream, k)


def remember(events: DataFrame) -> DataFrame:
    """Whole sessions as they arrive, in one pass on keyed state: streaming.memory.remember; of a table, the edges that it gives."""
    from evograph.streaming import memory

    return memory.remember(events) if events.isStreaming else memory.replayed(events)[0]


def topics_of(sessions: DataFrame, summary: str, k: int | None = None, seed: int = 0) -> DataFrame:
    """Topics of sessions by their summaries' vectors: k-means, by default a fifth as many topics as sessions."""
    points = hierarchy.encode_texts(sessions, summary)
    n = points.count()
    k = max(1, min(n, round(n / 5))) if k is None else k
    return hierarchy.kmeans_topics(points.withColumnRenamed("session_id", "vec_id").select("vec_id", "v"), max(2, k), seed)
