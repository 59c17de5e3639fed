"""Readers, writers, providers, text and date functions on hand-made input."""

import datetime as dt
import json
import math
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evograph import providers
from evograph.functions import dates, stem, text, vector
from evograph.operators import hierarchy, metrics
from evograph.sources import json_array, readers, sinks


@pytest.fixture
def samples(tmp_path):
    turn = lambda s, d, t, **x: {"speaker": s, "dia_id": d, "text": t, **x}
    one = {
        "qa": [
            {"question": "q0", "answer": "a0", "evidence": ["D1:1"], "category": 1},
            {"question": "q1", "answer": None, "adversarial_answer": "adv", "evidence": ["D2:1", "bad"], "category": 5},
        ],
        "conversation": {
            "speaker_a": "Ann", "session_2": [turn("Ann", "D2:1", "see", img_url="u", blip_caption="a cat")], "session_2_date_time": "2 May", "session_1": [turn("Bo", "D1:1", "hi", img_url="u")],
            "session_1_date_time": "1 May", "session_3": [], "session_3_date_time": "3 May", "session_4": [turn("Bo", "D4:1", "no date")],
        },
        "session_summary": {"session_2_summary": "two", "session_10_summary": "ten"},
    }
    path = tmp_path / "s.json"
    path.write_text(json.dumps([one, one | {"qa": []}]))
    return str(path)


def test_samples(spark, samples):
    s = readers.Samples(spark, samples)
    got = {(r.sample_id, r.session_num): r.date_time for r in s.sessions().collect()}
    assert got == {(i, n): f"{n} May" for i in (0, 1) for n in (1, 2)}
    assert {r.dia_id: r.text for r in s.turns().where("sample_id = 0").collect()} == {"D1:1": "hi", "D2:1": "[Image: a cat] see"}
    q = {r.q: r for r in s.questions().collect()}
    assert (q[0].final_answer, q[1].final_answer) == ("a0", "adv") and q[1].has_image_evidence
    assert [r.session_num for r in s.summaries().where("sample_id = 0").orderBy("session_num").collect()] == [2, 10]
    assert readers.Samples(spark, samples, sample=1).rows.count() == readers.Samples(spark, samples, limit=1).rows.count() == 1


@pytest.mark.parametrize("indent", [None, 2])
def test_a_large_array_is_read_by_many_tasks(spark, tmp_path, indent):
    """Braces, brackets, quotes and escapes in strings, at any place of a split; the rows of the reader that takes a file whole."""
    rng = random.Random(indent)
    odd = ['}', '{', '"', '\\', '[', ']', ',', 'a', ' ', '\n', 'é', '\\"', '}}', '"}', 'x' * 30]
    said = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    for name in ("a", "b"):
        rows = [{"id": i, "t": said(), "inner": [{"k": said(), "l": [said(), {}]} for _ in range(rng.randint(0, 3))], "m": {said(): {"x": said()}}} for i in range(120)]
        (tmp_path / f"{name}.json").write_text((" \n" if indent else "") + json.dumps(rows if name == "a" else [1, "}{", *rows, "x"], indent=indent, ensure_ascii=name == "a") + "\n")
    schema = "id long, t string, inner array<struct<k:string,l:array<string>>>, m string"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = json_array.read_array(spark, str(tmp_path), schema)
        rows = got.orderBy("file", "number").collect()
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.number for r in rows] == [*range(120)] * 2
    texts = {(r.file[-6:], r.number): r.text for r in json_array.array_texts(spark, str(tmp_path)).collect()}
    for name in ("a", "b"):
        want = [x for x in json.loads((tmp_path / f"{name}.json").read_text()) if isinstance(x, dict)]
        assert [json.loads(texts[f"{name}.json", i]) for i in range(120)] == want
        assert [(r.id, r.t, [x.k for x in r.inner]) for r in rows if r.file.endswith(f"{name}.json")] == [(x["id"], x["t"], [y["k"] for y in x["inner"]]) for x in want]


def test_large_samples(spark, samples):
    """The same tables, whichever way the file is read."""
    a, b = readers.Samples(spark, samples), readers.Samples(spark, samples, large=True)
    for table in ("sessions", "turns", "questions", "summaries"):
        assert sorted(map(repr, getattr(a, table)().collect())) == sorted(map(repr, getattr(b, table)().collect()))


def haystack(ids, ds, qid="q1"):
    return {"question_id": qid, "question": "Q?", "question_type": "temporal-reasoning", "question_date": "2023/05/30 (Tue) 10:00", "answer": 5, "haystack_session_ids": ids, "haystack_dates": ds, "haystack_sessions": [[{"role": "user", "content": i}] for i in ids], "answer_session_ids": ids[:1]}


def test_haystacks(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps([haystack(["b", "a"], ["2023/05/21 (Sun) 02:00", "2023/05/20 (Sat) 02:21"]), haystack(["a", "c"], ["1999/01/01 (Fri) 00:00", "no date"], "q2_abs")]))
    h = readers.Haystacks(spark, str(path))
    got = h.sessions().withColumn("ts", F.col("ts").cast("string")).orderBy("ordinal").collect()
    assert [(r.session_id, r.ordinal, r.num_turns) for r in got] == [("c", 0, 1), ("a", 1, 1), ("b", 2, 1)]
    assert got[1].ts == "2023-05-20 02:21:00"
    q = h.questions().orderBy("rec").collect()
    assert q[0].category == 3 and q[0].question == "Date of user query: 2023/05/30 (Tue) 10:00\nUser: Q?" and q[0].answer == "5" and [r.adversarial for r in q] == [False, True]
    assert {r.content for r in h.notes().collect()} == {f"User said: {x}" for x in "abc"}
    cache = spark.createDataFrame([("b", "short")], "session_id string, summary string")
    said = {r.session_id: (r.summary_key, r.summary) for r in h.summaries(cache).collect()}
    assert said["b"] == ("session_3_summary", "short") and said["a"] == ("session_2_summary", "On 2023/05/20 (Sat) 02:21, the session contained these exchanges: User said: a")
    keys = spark.createDataFrame([("session_1_summary",), ("session_9_summary",), ("odd",)], "summary_key string")
    assert {r.summary_key: r.session_id for r in readers.sessions_of_keys(keys, h.sessions()).collect()} == {"session_1_summary": "c", "session_9_summary": None, "odd": None}
    path.write_text(json.dumps([haystack(["b", "a"], ["2023/05/21 (Sun) 02:00"])]))
    with pytest.raises(PySparkException):
        readers.Haystacks(spark, str(path)).sessions().collect()
    assert readers.subset_tag(3, None) == "sample_3" and readers.subset_tag(None, None) == "all"


def test_graph_file_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([(1, "a", ["x"], None, 1.0), (1, "b", [], "d", 0.0)], "conv long, event_id string, participants array<string>, valid_until string, update_val double")
    ed = spark.createDataFrame([(1, 0, "a", "b", "causes", 0.5, None), (1, 1, "a", "zz", "causes", 0.5, None)], "conv long, edge_seq int, src string, dst string, edge_type string, confidence double, t_invalid_at string")
    se = spark.createDataFrame([(1, "s1", ["a", "b"])], "conv long, session_id string, event_ids array<string>")
    doc = sinks.graph_documents(ev, ed, se, se.select("conv", F.col("session_id").alias("topic_id"), F.array("session_id").alias("session_ids"))).first().json
    (tmp_path / "g.json").write_text(doc)
    back = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert {(r.event_id, r.update_val, r.valid_until) for r in back["events"].collect()} == {("a", 1.0, None), ("b", 0.0, "d")}
    assert [(r.src, r.dst) for r in back["edges"].collect()] == [("a", "b")]  # the one with an unknown end is gone
    assert back["sessions"].first().event_ids == ["a", "b"] and json.loads(doc)["metadata"]["schema_version"] == sinks.SCHEMA_VERSION


def test_aligned_similarity(spark):
    """By hand: repeated tokens, one without a vector, an empty side, weights."""
    vec = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("b", [0.0, 2.0], 2.0), ("c", [3.0, 4.0], 5.0)], "token string, v array<double>, norm double")
    pairs = spark.createDataFrame([(1, ["a", "a", "c"], ["b", "c"]), (2, ["x"], ["a"]), (3, [], ["a"]), (4, ["b"], ["b", "x"])], "pair int, prediction array<string>, reference array<string>")
    got = {r.pair: (round(r.precision, 6), round(r.recall, 6)) for r in metrics.aligned_similarity(pairs, vec).collect()}
    assert got == {1: (round((0.6 + 0.6 + 1) / 3, 6), round((0.8 + 1) / 2, 6)), 2: (0, 0), 3: (0, 0), 4: (1, 0.5)}
    idf = {r.token: r.idf for r in metrics.token_weights(pairs, "reference").collect()}
    assert idf == {"a": pytest.approx(math.log(5 / 3)), "b": pytest.approx(math.log(5 / 3)), "c": pytest.approx(math.log(5 / 2)), "x": pytest.approx(math.log(5 / 2))}
    one = metrics.aligned_similarity(pairs, vec, metrics.token_weights(pairs, "reference")).where("pair = 1").first()
    w = (math.log(5 / 3), math.log(5 / 2))
    assert one.precision == pytest.approx((2 * w[0] * 0.6 + w[1]) / (2 * w[0] + w[1])) and one.f1 == pytest.approx(2 * one.precision * one.recall / (one.precision + one.recall))


def test_documents_in_pieces(spark, tmp_path):
    """Many elements, odd ids, empty sections: each file is JSON, says what the one-row form says, and comes back by lines and as a whole."""
    odd = lambda i: ['e"%d', "e\\\\%d", "{e%d}", "e,%d"][i % 4] % i
    ev = spark.createDataFrame([(c, odd(i), ["x", "}"], None if i % 3 else "d", float(i)) for c in (1, 2) for i in range(300 * (c == 1) + 1)], "conv long, event_id string, participants array<string>, valid_until string, update_val double")
    ed = spark.createDataFrame([(1, i, odd(i), odd(i + 1) if i % 7 else "zz", "causes", 0.5, None) for i in range(200)], "conv long, edge_seq int, src string, dst string, edge_type string, confidence double, t_invalid_at string")
    se = spark.createDataFrame([(1, f"s{i}", [odd(i)]) for i in range(40)], "conv long, session_id string, event_ids array<string>")
    to = spark.createDataFrame([(1, "t", ["s1", "s2"])], "conv long, topic_id string, session_ids array<string>")
    folder = str(tmp_path / "g")
    sinks.write_documents(ev, ed, se, to, folder)
    whole = {r.conv: json.loads(r.json) for r in sinks.graph_documents(ev, ed, se, to).collect()}
    for c in (1, 2):
        [file] = (tmp_path / "g" / f"conv={c}").glob("*.txt")
        doc = json.loads(file.read_text())
        assert doc["events"] == whole[c]["events"] and doc["edges"] == whole[c]["edges"]
        assert sorted(map(str, doc["sessions"])) == sorted(map(str, whole[c]["sessions"])) and doc["topics"] == whole[c]["topics"] and sorted(map(str, doc["hyperedges"])) == sorted(map(str, whole[c].get("hyperedges", [])))
    back, other = readers.read_documents(spark, folder), readers.read_graph(spark, folder)
    for name in ("events", "edges", "sessions", "topics"):
        show = lambda df: sorted(map(repr, df.drop("conv", "edge_seq").collect()))
        assert show(back[name]) == show(other[name]) != [], name
    assert [r.src for r in back["edges"].orderBy("edge_seq").collect()] == [odd(i) for i in range(200) if i % 7]


def test_tables_and_cache(spark, tmp_path):
    folder = str(tmp_path / "b")
    assert not sinks.still_good(spark, folder, "h")
    sinks.write_tables({"metadata": spark.createDataFrame([("h",)], "prompt_hash string")}, folder)
    assert sinks.still_good(spark, folder, "h") and not sinks.still_good(spark, folder, "x") and not sinks.still_good(spark, folder, "h", force=True)
    assert readers.read_tables(spark, folder, ["metadata"])["metadata"].count() == 1


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("written", "day"),
    [("2023-05-07", "2023-05-07"), ("20230507", "2023-05-07"), ("2023/5/7", "2023-05-07"), ("May 7, 2023", "2023-05-07"), ("Feb 3, 2021", "2021-02-03"), ("2023-05-07T10:11", "2023-05-07"), ("202305071011", "2023-05-07"), ("last week", None), ("10:31 am on 13 October, 2023", None), ("2023-13-40", None)],
)
def test_dates(spark, written, day):
    got = value(spark, dates.try_parse_date(F.col("x")), x=written)
    assert (got and got.date().isoformat()) == day


def test_other_date_readers(spark):
    assert value(spark, dates.day_prefix(F.col("x")), x="2023/5/7 and later") == dt.date(2023, 5, 7)
    assert value(spark, dates.day_prefix(F.col("x")), x="on 2023/5/7") is None
    assert value(spark, dates.session_date(F.col("x")), x="2023/05/20 (Sat) 02:21") == dt.datetime(2023, 5, 20, 2, 21)
    assert value(spark, dates.session_date(F.col("x")).cast("string"), x="?") == "0001-01-01 00:00:00"
    assert value(spark, dates.anchor_or(F.col("x"), F.col("y")), x="unknown", y="d") == "d"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('"quoted"', "quoted"), ("“curly”", "curly"), ("a sentence.", "a sentence"), ("in 2023.", "in 2023."), ("x\nANSWER: one\nANSWER: two.", "two"), ("so the answer: three", "three"), ("so\nANSWER:\n the next line\nmore", "the next line"), ("Answer : Rome", "Rome"), ('```json\n{"answer": "fenced."}\n```', "fenced"), ("the text.\nANSWER:", "the text.\nANSWER:"), ("ANSWER: \n", "ANSWER:"), ("x..", "x."), ("\u00a0.", ""), ("answer\t:\u00a0 four\nAnswer: ", "answer\t:\u00a0 four\nAnswer:"), ("answer\t:\u00a0 four\n", "four"), ('{"answer": "four"}', "four"), ("plain", "plain")],
)
def test_answers(spark, raw, want):
    assert value(spark, text.parse_answer(F.col("x")), x=raw) == want


def test_text_functions(spark):
    v = lambda c, x: value(spark, c(F.col("x")), x=x)
    assert v(text.tokens, "Hello, World! it.is") == ["hello", "world", "it", "is"]
    assert v(text.key_terms, "The cat's a Über cat") == ["cat", "über"]
    assert v(text.heuristic_keywords, "the big Apple fell on Newton and big head") == ["apple", "newton", "big", "fell", "head"]
    assert v(text.heuristic_keywords, "over abc1 été big_one it's The Thing thing") == ["thing"]
    assert v(text.heuristic_context, "Costs 3.5 now. Then more.") == "Costs 3.5 now." and v(text.heuristic_context, "no end" + "x" * 300) == "no end" + "x" * 194
    assert v(text.list_items, '- "a"\n2) b\n* c, d') == ["a", "b", "c", "d"]
    assert v(text.strip_fences, "```json\n{}\n```") == "{}" and v(text.json_block, 'x {"a": {}} y') == '{"a": {}}'
    assert value(spark, text.section(F.col("x"), "context", "tags"), x="Keywords: a\nContext: b c\nTags: d") == "b c"
    assert v(text.normalize_role, " assistant ") == "Assistant" and v(text.normalize_role, "") == "Unknown"
    kinds = {"When did he go?": "temporal", "What time is it?": "temporal", "How old is she?": "temporal", "Since when?": "temporal", "In what year was it?": "temporal", "Who went first?": "default", "What came before?": "default", "Whenever": "default"}
    assert {q: v(text.question_type, q) for q in kinds} == kinds
    assert v(text.session_number, "session_12_summary") == 12 and v(text.session_number, "none") == 0 and v(text.session_number, "session_3") == 0
    assert not v(text.is_order_question, "Which did she never see first?") and v(text.is_order_question, "which event took place?")
    pick = lambda c, q, o: value(spark, text.prompt_template(F.lit(c), F.lit(q), F.lit(o)), x="")
    assert [pick(3, "temporal", ""), pick(1, "temporal", "single-session-preference"), pick(2, "temporal", "x"), pick(1, "default", None)] == ["open", "preference", "temporal", "default"]
    assert v(text.token_count, " a  b ") == 2 and v(text.is_order_question, "Which came first, A or B?")
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", " hi "), ("", ""), (None, "x"))))
    assert value(spark, text.render_turns(turns), x="") == "user: hi\nunknown: \nunknown: x"
    assert value(spark, text.render_dialogue(turns, F.lit("2020/01/02")), x="") == "On 2020/01/02, the session contained these exchanges: User said: hi Unknown said: x"
    note = lambda m: value(spark, text.render_note_fields(F.lit("t"), F.lit("c"), F.lit("k"), F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), m), x="")
    assert note("full") == "talk start time:tmemory content: cmemory context: kmemory keywords: ['a', 'b']memory tags: []" == note("odd")
    assert note("no_context") == "talk start time:tmemory content: cmemory keywords: ['a', 'b']memory tags: []" and note("minimal") == "talk start time:tmemory content: c"
    assert text.safe_name("a/b") == "a_b"
    assert v(text.is_abstention, "This is not mentioned.") and len(v(text.prompt_hash, "p")) == 16


def test_vectors_and_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], ["a", "b"], ["b"])], "a array<double>, b array<double>, s array<string>, t array<string>")
    r = df.select(vector.norm(F.col("a")).alias("n"), vector.cosine(F.col("a"), F.col("a")).alias("one"), vector.cosine(F.col("a"), F.col("b")).alias("zero"), vector.jaccard(F.col("s"), F.col("t")).alias("j"), vector.clamp(F.lit(1.7)).alias("c"), vector.normalize(F.col("a")).alias("u")).first()
    assert (r.n, r.one, r.zero, r.j, r.c, r.u) == (5, 1, 0, 0.5, 1, [0.6, 0.8])
    s = metrics.text_scores("the cat sat", "the cat sat")
    assert all(abs(s[k] - 1) < 1e-9 for k in ("bleu1", "bleu2", "bleu3", "rouge1", "rouge2", "rougeL")) and abs(s["bleu4"] - 0.1**0.25) < 1e-9 and abs(s["meteor"] - (1 - 0.5 / 27)) < 1e-9
    assert set(metrics.text_scores("", "x").values()) == {0.0} == set(metrics.text_scores("y", None).values())
    t = metrics.text_scores("the cat sat on a mat", "a cat was running on the mats today")  # 4 of 6 words; no pair of words
    assert abs(t["bleu1"] - math.exp(1 - 8 / 6) * 4 / 6) < 1e-9 and abs(t["bleu2"] - math.exp(1 - 8 / 6) * (4 / 6 * 0.1 / 5) ** 0.5) < 1e-9
    assert abs(t["rouge1"] - 2 * 5 / 14) < 1e-9 and t["rouge2"] == 0 and abs(t["rougeL"] - 2 * 3 / 14) < 1e-9
    assert metrics.bleu_tokens("I'm gonna pay 1,000... at 12:30 -- cannot, e.g. and/or a,b") == ["i", "'m", "gon", "na", "pay", "1,000", "...", "at", "12:30", "--", "can", "not", ",", "e.g", ".", "and/or", "a", ",", "b"]
    assert metrics.bleu_tokens("He didn't pay $3.50, it's well-known.") == ["he", "did", "n't", "pay", "$", "3.50", ",", "it", "'s", "well-known", "."]
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "electrical": "electr", "goodness": "good", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control", "is": "is", "dying": "die", "ties": "tie", "tied": "tie", "cried": "cri", "news": "news", "enjoy": "enjoy", "skies": "sky", "possibly": "possibl", "hopefully": "hope", "geology": "geolog", "proceed": "proceed"}
    assert {w: stem.stem(w) for w in words} == words
    assert abs(metrics.text_scores("a b c d", "a x c d")["rougeL"] - 0.75) < 1e-9
    rows = spark.createDataFrame([(c, float(c)) for c in range(1, 6)], "category int, f1 double")
    got = {r.category: r for r in metrics.aggregate_metrics(rows, ["f1"]).collect()}
    assert got[None]["count"] == 4 and got[None].mean == 2.5 and got[5].std == 0


def test_categories_are_the_fixed_ones():
    assert [readers.CATEGORIES[k] for k in ("single-session-user", "single-session-assistant", "single-session-preference", "multi-session", "temporal-reasoning", "knowledge-update")] == [1, 1, 1, 2, 3, 4]


def test_dense_numbers_without_one_window(spark):
    import random

    rows = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(x, f"k{x}") for x in rows], "x int, k string").repartition(7)
    got = readers.ranked(df, ["x"], "n")
    assert [(r.x, r.n) for r in got.orderBy("x").collect()] == [(x, i) for i, x in enumerate(sorted(rows))]
    assert readers.ranked(df.limit(0), ["x"], "n").count() == 0


def test_topics(spark):
    rows = [(0, i, [1.0, 0.05 * i]) for i in range(4)] + [(0, 4 + i, [-1.0, 0.1 * i]) for i in range(9)]
    got = hierarchy.assign_topics(spark.createDataFrame(rows, "conv int, seq int, v array<double>")).orderBy("seq").collect()
    assert len(got) == 13 and got[0].topic == "0_0" and max(r.generation for r in got) >= 1  # drifts start a new generation
    assert {r.prefix: r.name for r in hierarchy.nickname_map(spark.createDataFrame([("anna",), ("annabel",), ("bob",)], "name string")).collect()} == {"anna": "anna", "annabel": "annabel", "annab": "annabel", "annabe": "annabel", "bob": "bob"}
    assert hierarchy.encode_texts(spark.createDataFrame([("a b",), (None,)], "x string"), "x").count() == 2


def test_providers(spark):
    rec = providers.Recorded({providers.Recorded.key("p"): "yes"}, "no")
    df = spark.createDataFrame([("p",), ("q",)], "x string").select(providers.completion(rec)(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["yes", "no"]

    def fails(prompts):
        raise OSError

    assert providers.Retrying(fails, tries=2, wait=0).complete(pd.Series(["a"])).tolist() == ["ERROR"]


@pytest.mark.parametrize("tokens", [1 << 17, 7])
def test_alignment_by_blocks(spark, monkeypatch, tokens):
    """Pairs in blocks against each on its own: missing vectors and weights, empty and null sides, repeated tokens, few cosines held at a time."""
    monkeypatch.setattr(metrics, "TOKENS", tokens)
    monkeypatch.setattr(metrics, "HELD", 5)
    rng = random.Random(5)
    v = {w: [rng.gauss(0, 1) for _ in range(5)] for w in "abcdefg"}
    idf = {w: rng.random() for w in "abcdeh"}
    side = lambda: rng.choice([None, []]) if rng.random() < 0.2 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
    rows = [(i, side(), side()) for i in range(60)]
    norm = lambda x: sum(c * c for c in x) ** 0.5
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True)) / norm(v[a]) / norm(v[b])
    pairs = spark.createDataFrame(rows, "pair int, prediction array<string>, reference array<string>").repartition(3)
    vec = spark.createDataFrame([(w, x, norm(x)) for w, x in v.items()], "token string, v array<double>, norm double")
    weights = spark.createDataFrame(list(idf.items()), "token string, idf double")
    for given in (None, weights):
        w = (lambda t: 1.0) if given is None else (lambda t: idf.get(t, 0.0))

        def share(a, b, w=w):
            near = [max((cos(x, y) for y in b or [] if y in v), default=0.0) if x in v else 0.0 for x in a or []]
            total = sum(w(x) for x in a or [])
            return sum(w(x) * s for x, s in zip(a or [], near, strict=True)) / total if a and b and total else 0.0

        got = {r.pair: (r.precision, r.recall) for r in metrics.aligned_similarity(pairs, vec, given).collect()}
        assert got == {i: (pytest.approx(share(a, b)), pytest.approx(share(b, a))) for i, a, b in rows}
