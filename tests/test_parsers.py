"""Model-output readers, support paths and note streams on hand-made input."""

import pytest
from pyspark.sql import functions as F

from evograph.functions import parsers, prompts
from evograph.operators import support
from evograph.streaming import notes


def read(spark, column, raw):
    return spark.createDataFrame([(raw,)], "x string").select(column(F.col("x")).alias("v")).first().v


def test_json_answers(spark):
    got = read(spark, lambda x: parsers.extraction(x, F.repeat(F.lit("p"), 300)), 'Sure:\n```json\n{"events": [{"event_type": "PLAN", "participants": ["b", " a "]}, {"event_type": "State Change", "participants": "ann"}, {"event_type": "odd"}]}\n```')
    assert [e.event_type for e in got] == ["plan", "state_change", "action"] and [e.participants for e in got] == [["b", "a"], ["ann"], []]
    assert len(got[0].provenance) == 200 and got[2].time_anchor == "unknown"
    assert read(spark, parsers.extraction, "nothing") == [] and read(spark, parsers.extraction, None) == []
    inner = '{"events": [{}, {}], "edges": [{"source_event_idx": 0, "target_event_idx": 1, "edge_type": "causes", "confidence": 3, "reason": "r"}, {"source_event_idx": 1, "target_event_idx": 1, "edge_type": "causes"}, {"source_event_idx": 0, "target_event_idx": 2, "edge_type": "causes"}, {"source_event_idx": 1, "target_event_idx": 0, "edge_type": "supports"}, {"source_event_idx": 1, "target_event_idx": 0, "edge_type": "updates", "confidence": "much"}]}'
    assert [(e.source, e.target, e.edge_type, e.confidence) for e in read(spark, parsers.extraction_edges, inner)] == [(0, 1, "causes", 1.0), (1, 0, "updates", 0.5)]
    cross = '{"edges": [{"existing_event_idx": 1, "direction": "new_to_existing", "edge_type": "causes", "confidence": 0.9}, {"existing_event_idx": 0, "edge_type": "enables", "confidence": 0.7}, {"existing_event_idx": 0, "edge_type": "enables"}, {"existing_event_idx": 2, "edge_type": "enables", "confidence": 1}]}'
    assert [(e.candidate, e.from_new, e.edge_type) for e in read(spark, lambda x: parsers.inferred_edges(x, F.lit(2)), cross)] == [(1, True, "causes"), (0, False, "enables")]
    groups = lambda x: parsers.clusters(x, F.array(F.lit("s"), F.lit("t")))
    assert [(t.place, t.label) for t in read(spark, groups, '{"groups": [{"label": "a", "session_ids": ["s"]}, {"label": "b", "session_ids": []}, {"session_ids": ["t"]}]}')] == [(0, "a"), (2, "Topic 2")]
    assert [(t.label, t.session_ids) for t in read(spark, groups, "no groups")] == [("General", ["s", "t"])]


@pytest.mark.parametrize(("raw", "want"), [('Here: ["Ann", " tea "]', ["Ann", "tea"]), ("Ann, 'tea'\n- trip", ["Ann", "tea", "trip"]), ("", []), (None, [])])
def test_entities(spark, raw, want):
    assert read(spark, parsers.entities, raw) == want


def test_note_answers(spark):
    a = read(spark, parsers.note_analysis, "Keywords: a, b\nContext: some words\nTags: - c")
    assert a.keywords == ["a", "b"] and a.context == "some words" and a.tags == ["c"]
    b = read(spark, lambda x: parsers.note_analysis(x, F.lit("Ann saw a red kite. It flew.")), "no sections")
    assert b.keywords == ["ann", "saw", "red", "kite", "flew"] and b.context == "Ann saw a red kite." and b.tags == ["ann", "saw", "red"]
    decide = lambda x: read(spark, parsers.evolution, x).decision
    assert [decide(x) for x in ("DECISION: STRENGTHEN\nREASON: near", "decision: strengthen and update", "we update it", "nothing to do", '{"should_evolve": true, "actions": ["update_neighbor"]}', '{"should_evolve": false, "actions": ["strengthen"]}')] == ["STRENGTHEN", "STRENGTHEN_AND_UPDATE", "UPDATE_NEIGHBOR", "NO_EVOLUTION", "UPDATE_NEIGHBOR", "NO_EVOLUTION"]
    assert read(spark, parsers.evolution, "DECISION: STRENGTHEN\nREASON: near").reason == "near"
    more = read(spark, parsers.strengthen_details, "CONNECTIONS: 0, x, 3\nTAGS: a, b")
    assert more.connections == [0, 3] and more.tags == ["a", "b"]
    assert read(spark, parsers.strengthen_details, '{"suggested_connections": [1], "tags_to_update": ["t"]}') == ([1], ["t"])
    near = read(spark, lambda x: parsers.update_neighbours(x, 3), "NEIGHBOR 0:\nCONTEXT: one\nTAGS: a, b\n\nNEIGHBOR 1:\nCONTEXT: two\nTAGS: c")
    assert [(x.context, x.tags) for x in near] == [("one", ["a", "b"]), ("two", ["c"]), ("", [])]
    assert [x.context for x in read(spark, lambda x: parsers.update_neighbours(x, 2), '{"new_context_neighborhood": ["k"], "new_tags_neighborhood": [["t"]]}')] == ["k", ""]
    assert [tuple(read(spark, parsers.judged, x)) for x in ('{"label": " correct "}', '{"label": "wrong"}', "{}", "It is WRONG.", None)] == [("CORRECT", 1.0), ("WRONG", 0.0), ("WRONG", 0.0), ("ERROR", 0.0), ("ERROR", 0.0)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("RELATIONSHIP: update\nREASON: newer", "updates"), ("relationship: Contradiction", "contradicts"), ("RELATIONSHIP: odd\nRELATIONSHIP: independent", "independent"), ("it is an update", "updates"), ("it contradicts that", "contradicts"), ("an update, or independent", "independent"), ("no idea", None), ("", None)],
)
def test_verdicts(spark, raw, want):
    assert read(spark, parsers.verdict, raw) == want


def test_first_of_two(spark):
    q = "Which event happened first, the trip or the wedding?"
    said = "ANSWER: the wedding took place first, and the trip followed in June."
    book = "Which book did I read first, 'The Sea' or 'The Land'?"
    cases = [
        (q, said, None, "the wedding"), (q, "the trip", None, "the trip"), (q, "It is not specified whether the wedding was first.", "none", "none"),
        ("Which trip have I never done first, A b or C d?", "A b first", "none", "none"), (q, "the wedding " + "x" * 100 + " first", "none", "none"),
        ("Who came first, it or the old man from the house on the far hill?", "the old man from the house on the far hill first", "none", "none"),
        (book, "You read The Land first", None, "'The Land'"), (q, "why\n\nAnswer: The Trip was earlier\n\nthe wedding was first", None, "the trip"), (q, None, None, ""), (None, "a", None, "a"),
        (q, "the wedding" + "x" * 68 + " first", "none", "the wedding"), (q, "the wedding" + "x" * 69 + " first", "none", "none"), (q, "the wedding" + " " * 69 + "first", "none", "the wedding"), (q, "first" + " " * 75 + "the wedding", "none", "the wedding"), (q, "first" + " " * 76 + "the wedding", "none", "none"),
        (q, "xfirst the wedding", "none", "none"), ("Who was first, Ann, Bob or Cy?", "Cy came first", "none", "Cy"), ("Who was first, Ann?", "Ann first", "none", "none"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, a string, f string, want string")
    got = df.select("i", "want", parsers.choose_first(F.col("q"), F.col("a"), F.coalesce("f", "a", F.lit(""))).alias("v")).collect()
    assert [(r.i, r.v) for r in got] == [(r.i, r.want) for r in got]
    listed = {x: read(spark, parsers.order_options, x) for x in (book, q, "Which came first, it or 'A' or B b?", "no comma or none?", None)}
    assert list(listed.values()) == [["'The Sea'", "'The Land'"], ["the trip", "the wedding"], ["'A' or B b"], [], []]
    assert read(spark, lambda x: parsers.choose_first(F.lit(q), x), said) == "the wedding"


@pytest.mark.parametrize(
    ("text", "want"),
    [("on 2021-03-09.", "on 9 march 2021."), ("Sep 4, 1999", "4 september 1999"), ("4 Febuary 2001", "4 february 2001"), ("2021/13/01 and Xyz 3, 2020", "2021/13/01 and Xyz 3, 2020"), ("in June, 2010 or 2011-02", "in june 2010 or february 2011"), ("3 May 1850", "3 May 1850"), (None, "")],
)
def test_canonical_dates(spark, text, want):
    assert parsers.canonical_dates(text) == want
    assert read(spark, parsers.with_canonical_dates(), text) == want


def test_support_paths(spark):
    s = spark.createDataFrame([(1, 1, "a", 1)], "qid int, conv int, node string, seed_rank int")
    e = spark.createDataFrame([(1, "a", "b", "causes", 0.9, 1), (1, "a", "c", "causes", 0.9, 2)], "conv int, src string, dst string, edge_type string, confidence double, adj_pos long")
    k = spark.createDataFrame([(1, n, "event", 1.0, t) for n, t in (("a", "a start"), ("b", "a red bicycle"), ("c", "blue"))], "conv int, node string, kind string, update_val double, state_change string")
    k = k.select("conv", "node", "kind", F.lit(None).cast("date").alias("day"), "update_val", "state_change", F.lit("2020-01-01").alias("time_anchor"), F.lit("action").alias("event_type"), F.lit(None).cast("string").alias("text"))
    sims = spark.createDataFrame([(1, "a", 0.1, 0.2, False), (1, "b", 0.9, 0.2, True), (1, "c", 0.3, 0.2, False)], "qid int, node string, answer_sim double, query_sim double, is_answer boolean")
    found = support.support_paths(s, e, k, sims, spark.createDataFrame([(1, "the red bicycle", "which bicycle?")], "qid int, answer string, query string"), depth=1)
    assert [(r.path_rank, r.score, r.grounding) for r in found.collect()] == [(1, round(0.35 * 0.9 + 0.05 + 0.25 * 0.9 + 0.15 + 0.15, 6), 1.0)]
    told = spark.createDataFrame([(1, "b", "He sold it. The bicycle was red and new! Red.")], "conv int, node string, summary string")
    assert support.explained(found, told).first().explanation == "E1 (a start, 2020-01-01, action)\n  --[causes]-->\nE2 (a red bicycle, 2020-01-01, action)\n  [Detail: \"The bicycle was red and new\"]\nScore: 0.89 (neural=0.90, conf=0.90, temporal=1, update=0.2)"
    rows = spark.createDataFrame([(1, "path", 0.9, 0), (1, "path", 0.8, 1), (1, "path", 0.7, 2), (1, "direct", 0.1, 0), (1, "direct", 0.05, 1)], "qid int, origin string, score double, ord int")
    assert sorted(r.score for r in support.explanation_pick(rows).collect()) == [0.1, 0.8, 0.9]
    n = spark.createDataFrame([(0.5,), (0.1,), (None,)], "sim double")
    assert support.expansion_notes(n).count() == 1


def test_note_streams(spark):
    old = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "conv int, note_pos long, content string")
    new = spark.createDataFrame([(1, 7, "x"), (2, 3, "z"), (1, 5, "w")], "conv int, seq int, content string")
    got = notes.append_notes(old, new)
    assert sorted((r.conv, r.note_pos, r.content) for r in got.collect()) == [(1, 0, "x"), (1, 1, "y"), (1, 2, "w"), (1, 3, "x"), (2, 0, "z")]
    assert {(r.conv, r.content): r.note_pos for r in notes.last_positions(got).collect()}[1, "x"] == 3
    ev = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(12)], "conv int, seq int, evolved boolean")
    assert [(r.seq, r.rebuild) for r in notes.rebuild_points(ev, 3).orderBy("seq").collect()] == [(4, 1), (10, 2)]
    cache = spark.createDataFrame([("a", "old")], "session_id string, summary string")
    more = spark.createDataFrame([("a", "new"), ("b", "new")], "session_id string, summary string")
    assert sorted(tuple(r) for r in notes.add_summaries(cache, more).collect()) == [("a", "old"), ("b", "new")]
    assert [r.session_id for r in notes.to_summarise(more, cache).collect()] == ["b"]


def test_prompts_keep_braces_and_fill_fields(spark):
    got = read(spark, lambda x: prompts.filled(prompts.JUDGE, question=x, reference=F.lit("{question}"), prediction=F.lit(None).cast("string")), "Q")
    assert got.startswith("Question: Q\nRight answer: {question}\nGiven answer: \n") and got.endswith('{"label": "CORRECT or WRONG"}')
    assert read(spark, lambda x: prompts.answer_prompt(x, F.lit("c"), F.lit("q")), "open") == prompts.ANSWERS["open"].replace("{context}", "c").replace("{question}", "q")
    assert read(spark, lambda x: prompts.described(x, F.array().cast("array<string>"), F.lit("2020"), F.lit("s")), "plan") == "plan; none; 2020; s"


def test_notes_evolve(spark):
    """Conversation 1 strengthens and updates, 2 has no notes, 3 is left as it is."""
    note = "conv int, note_id string, note_pos long, content string, timestamp string, context string, keywords array<string>, tags array<string>, links array<int>, v array<double>, norm double"
    old = spark.createDataFrame([(1, "a", 0, "old a", "t", "was", ["k"], ["x"], [], [1.0, 0.0], 1.0), (1, "b", 1, "old b", "t", "was", [], [], [], [0.6, 0.8], 1.0), (3, "c", 0, "old c", "t", "was", [], [], [], [1.0, 0.0], 1.0)], note)
    new = spark.createDataFrame([(1, "n", 2, "new one", "t", "", [], ["y"], [7], [1.0, 0.0], 1.0), (2, "m", 0, "alone", "t", "", [], [], [], [1.0, 0.0], 1.0), (3, "o", 1, "plain", "t", "", [], [], [], [1.0, 0.0], 1.0)], note)
    says = lambda p: F.when(~F.contains(p, F.lit("new one")), "DECISION: NO_EVOLUTION").when(F.contains(p, F.lit("DECISION")), "DECISION: STRENGTHEN_AND_UPDATE").when(F.contains(p, F.lit("CONNECTIONS")), "CONNECTIONS: 0\nTAGS: z").otherwise("NEIGHBOR 0:\nCONTEXT: is now\nTAGS:\nNEIGHBOR 1:\nCONTEXT:\nTAGS: w")
    kept, came = notes.evolve(old, new, says)
    assert {r.note_id: (r.context, r.tags) for r in kept.collect()} == {"a": ("is now", ["x"]), "b": ("was", ["w"]), "c": ("was", [])}
    assert {r.note_id: (r.links, r.tags, r.evolved) for r in came.collect()} == {"n": ([7, 0], ["z"], True), "m": ([], [], False), "o": ([], [], False)}


def test_many_notes_evolve_in_order(spark):
    """A batch of several notes a conversation gives what the same notes give one by one."""
    note = "conv int, note_id string, note_pos long, content string, timestamp string, context string, keywords array<string>, tags array<string>, links array<int>, v array<double>, norm double"
    row = lambda c, i, v: (c, f"{c}{i}", i, f"note {i}", "t", "", [], [], [], v, 1.0)
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [0.8, 0.6]]
    old = spark.createDataFrame([row(1, 0, vectors[0]), row(2, 0, vectors[2])], note)
    new = spark.createDataFrame([row(1, 1, vectors[1]), row(1, 2, vectors[2]), row(1, 3, vectors[3]), row(2, 1, vectors[0]), row(3, 0, vectors[0]), row(3, 1, vectors[1])], note)
    number = lambda p: F.regexp_extract(p, r"(?s).*note (\\d)", 1)
    says = lambda p: F.when(F.contains(p, F.lit("DECISION")), "DECISION: STRENGTHEN_AND_UPDATE").when(F.contains(p, F.lit("CONNECTIONS")), "CONNECTIONS: 0\nTAGS: z").otherwise(F.concat(F.lit("NEIGHBOR 0:\nCONTEXT: seen with "), number(p), F.lit("\nTAGS: w")))
    known, arrived = old, {}
    for i in (1, 2, 3):
        turn = new.where((F.col("note_pos") == i) & (F.col("conv") < 3) | (F.col("note_pos") == i - 1) & (F.col("conv") == 3))
        known, came = notes.evolve(known, turn, says)
        arrived |= {r.note_id: r.evolved for r in came.collect()}
        known = spark.createDataFrame(known.unionByName(came.drop("evolved")).collect(), note)
    kept, came = notes.evolve_in_order(old, new, says)
    show = lambda r: (r.note_id, r.context, tuple(r.tags), tuple(r.links))
    assert sorted(map(show, [*kept.collect(), *came.collect()])) == sorted(map(show, known.collect()))
    assert {r.note_id: r.evolved for r in came.collect()} == arrived and sorted(r.note_id for r in kept.collect()) == ["10", "20"]
    assert any(r.context.startswith("seen with") for r in known.collect())
    assert [x.count() for x in notes.evolve_in_order(old, new.limit(0), says)] == [2, 0]


def test_command_line(spark, tmp_path):
    from evograph import __main__ as cli
    from evograph.plans import views as V

    sf = "/root/testdata/sf0.001"
    V.events_in_sessions(spark, sf).write.parquet(f"{tmp_path}/e")
    V.supersessions(spark, sf).write.parquet(f"{tmp_path}/v")
    for _ in range(2):  # again over what is there
        cli.main(["build", "--events", f"{tmp_path}/e", "--verdicts", f"{tmp_path}/v", "--out", f"{tmp_path}/g"])
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == ["chain", "edges", "events", "sessions", "stars"]
    vec = V.vectors(spark, sf)
    vec.where("vec_id < 2").select(F.col("vec_id").alias("qid"), F.lit(0).cast("long").alias("conv"), F.col("v").alias("qv"), F.col("norm").alias("qnorm")).write.parquet(f"{tmp_path}/q")
    vec.select(F.col("vec_id").alias("note_id"), "v", "norm", F.col("vec_id").cast("string").alias("text")).write.parquet(f"{tmp_path}/n")
    V.events(spark, sf).select((F.col("event_id") % 500).alias("note_id"), "event_id").write.parquet(f"{tmp_path}/l")
    (tmp_path / "c.json").write_text('{"max_depth": 1}')
    cli.main(["ask", "--graph", f"{tmp_path}/g", "--questions", f"{tmp_path}/q", "--notes", f"{tmp_path}/n", "--note-events", f"{tmp_path}/l", "--out", f"{tmp_path}/a", "--config", f"{tmp_path}/c.json"])
    assert spark.read.parquet(f"{tmp_path}/a/answers").count() == 2
    cli.main(["replay", "--events", f"{tmp_path}/e", "--out", f"{tmp_path}/r"])
    assert spark.read.parquet(f"{tmp_path}/r/edges").count() > 0
