"""Tokenizers, packing, rules, fingerprints, licences: against libraries, SQL and brute force."""

import base64
import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import oracle
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evograph.llm import bpe, license_scan, multiset_hash, packing, pretoken, quality_rules, queries, token_counts

SF = "/root/testdata/sf0.001"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  \n\n  x", "it's we'll 'tis ''re  'd", "<|endoftext|>a<|endoftext|>", "<|endoftext|", "ÄÖ ñ 漢字 　\x85\xa0 ½² ٣ \U0001f600 é", "a" * 5000, " " * 5000 + "!", "word " * 40_000, "\x00\x1c\x1f", "ᲉꟋ\U000105c0"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("'streldvm   \n\tab12!."), max_size=60), max_size=5))
def test_slices_are_the_librarys(texts):
    ref = library()
    codec = bpe.codec(RANKS, P.PATTERN)
    ids, counts = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in ref.encode_ordinary(t)]
    assert counts.tolist() == [len(ref.encode_ordinary(t)) for t in texts]
    assert codec.decode(ids)[0] == "".join(texts).encode()


def test_every_code_point_is_classed_as_the_library_does():
    ref, codec = library(), bpe.codec(RANKS, P.PATTERN)
    for start in range(0, sys.maxunicode, 1 << 16):
        text = "a".join(chr(c) + "1" for c in range(start, min(start + (1 << 16), sys.maxunicode), 7) if not 0xD800 <= c < 0xE000)
        assert codec.encode([text])[0].tolist() == ref.encode_ordinary(text)


def test_merge_one_by_one_and_side_by_side():
    ranks = bpe.read_ranks(RANKS)
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"abcdeth in"), rng.integers(1, 90))) for _ in range(300)]
    ids, sizes = bpe.merge_many(pieces, ranks, bpe.PairTable(ranks))
    cuts = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [bpe.merge(p, ranks) for p in pieces]


def test_bpe_round_trip(spark, odd):
    ref = library()
    for r in bpe.round_trip_digests(odd, RANKS, P.PATTERN).collect():
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = ref.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text)), r
    encoded = bpe.encode(odd, RANKS, P.PATTERN)
    assert encoded.where(F.element_at("offsets", -1) < 0).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


def test_token_counts(spark, odd):
    ref = Tokenizer.from_file(JSON)
    rows = token_counts.count_tokens(odd, JSON).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        n = len(ref.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), r


def test_queries_on_documents(spark):
    ref, tok = library(), Tokenizer.from_file(JSON)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    a, b = queries.op10_byte_bpe(spark, SF).collect(), queries.op3_token_counts(spark, SF).collect()
    assert len(a) == len(b) == len(docs)
    assert all(r.ids_sha256 == sha(" ".join(map(str, ref.encode_ordinary(docs[r.doc_id])))) and r.decoded_sha256 == sha(docs[r.doc_id]) for r in a)
    assert all(r.n_tokens == len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in b)


def test_a_small_cache_changes_nothing():
    texts = [f"some w{i} words x{i * 7}" for i in range(300)]
    ids = bpe.Ids(bpe.read_ranks(RANKS), limit=40)
    kinds = bpe.codec(RANKS, P.PATTERN).kinds
    ref = library()
    for t in texts:
        raw, bounds, _ = pretoken.split([t], kinds)
        slot = ids.slots(raw, bounds)
        assert ids.ids[bpe.ragged(ids.start[slot], ids.size[slot])].tolist() == ref.encode_ordinary(t)


def thue_morse(n):
    """Two words of n letters whose running polynomial hashes modulo 2^64 agree from about 1,024 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_colliding_hashes_are_told_apart(spark, n):
    a, b = thue_morse(n)
    texts = [a, b, f"x {a} {b} {a}", f"{b} {b}", f" {a}", f" {b}"]
    key, check = pretoken.Hashes()((a + b).encode(), np.array([0, n, 2 * n]))
    assert n < 1024 or key[0] == key[1] and check[0] == check[1]  # else this tests nothing
    ref, tok, codec = library(), Tokenizer.from_file(JSON), bpe.Codec(RANKS, P.PATTERN)
    want = [ref.encode_ordinary(t) for t in texts]
    for part in (texts, texts[:1], texts[1:2], texts[::-1], texts):  # one after another through one cache
        ids, counts = codec.encode(part)
        assert ids.tolist() == [i for t in part for i in want[texts.index(t)]]
        assert codec.decode(ids)[0] == "".join(part).encode()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.round_trip_digests(df, RANKS, P.PATTERN).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), sha(" ".join(map(str, want[r.doc_id]))), sha(texts[r.doc_id]))
    for r in token_counts.count_tokens(df, JSON).collect():
        assert r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_only_what_the_scan_stands_for(tmp_path):
    with pytest.raises(ValueError):
        bpe.Codec(RANKS, r"\w+|\W+")
    import json

    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        (tmp_path / "t.json").write_text(json.dumps(json.load(open(JSON)) | change))
        with pytest.raises(ValueError):
            token_counts.Encoder(str(tmp_path / "t.json"))


# Packing


def brute_pack(items, capacity):
    """Bins (lists of positions) by looking at every bin for every item. items: (length, source, cluster), None for none."""
    bins = []
    for turn, i in enumerate(sorted(range(len(items)), key=lambda i: (-items[i][0], i))):
        n, source, cluster = items[i]
        fits = [b for b in bins if b["room"] >= n and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        b = min(fits, key=lambda b: (b["room"], -b["turn"]), default=None)  # of equally tight ones that used last
        if b is None:
            bins.append(b := {"room": capacity, "sources": set(), "clusters": set(), "in": []})
        b["room"] -= n
        b["turn"] = turn
        b["sources"].add(source)
        b["clusters"].add(cluster)
        b["in"].append(i)
    return [b["in"] for b in bins]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(-1, 6), st.integers(-1, 90)), min_size=1, max_size=80))
def test_tightest_compatible_bin(items):
    lengths, sources, clusters = (np.array(x) for x in zip(*items))
    bins = packing.pack(lengths, sources, clusters, 30)
    room = {b: 30 for b in bins.tolist()}
    for b in set(bins.tolist()):
        at = np.flatnonzero(bins == b)
        room[b] -= lengths[at].sum()
        assert room[b] >= 0
        for codes in (sources, clusters):
            assert max(Counter(c for c in codes[at].tolist() if c >= 0).values(), default=0) <= 1
    # An item's bin was the tightest that could take it: replay the choice.
    state: dict = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [b for b, (r, s, c) in state.items() if r >= lengths[i] and sources[i] not in s and clusters[i] not in c]
        b = int(bins[i])
        if fits:
            assert b in state and state[b][0] == min(state[x][0] for x in fits)
        else:
            assert b not in state
        r, s, c = state.get(b, (30, set(), set()))
        state[b] = (r - lengths[i], s | ({int(sources[i])} - {-1}), c | ({int(clusters[i])} - {-1}))


def check_packed(rows, capacity):
    by_bin: dict = {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
    for members in by_bin.values():
        assert sum(m.piece_length for m in members) <= capacity
        named = [m.source for m in members if m.source is not None]
        assert len(named) == len(set(named))


def test_packing_query(spark):
    rows = queries.op4_packing(spark, SF).collect()
    check_packed(rows, packing.CAPACITY)
    want = oracle.connect(SF).execute(r"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM documents").fetchall()
    total: Counter = Counter()
    for r in rows:
        total[r.doc_id] += r.piece_length
    assert dict(total) == dict(want)
    # The bins themselves, by brute force: one shard at this size, in order of the ids.
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    plain = [" ".join(r.text.lower().replace("\x0b", " ").split()) or None for r in docs]
    n = [len(r.text.split()) for r in docs]
    items = [(k - max(0, (k - 1) // packing.CAPACITY) * packing.CAPACITY, r.source, p) for k, r, p in zip(n, docs, plain)]
    expected = sorted(sorted(docs[i].doc_id for i in b) for b in brute_pack(items, packing.CAPACITY))
    got: dict = {}
    for r in rows:
        if r.piece == max(0, (r.length - 1) // packing.CAPACITY):
            got.setdefault(r.bin, []).append(r.doc_id)
    assert len(docs) < packing.SHARD and sorted(map(sorted, got.values())) == expected


def test_packing_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "c " * 25, "t"), (None, None, None), (3, "", "s"), (4, "x " * 10, None), (5, "X  " * 10, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("length", F.lit("clash")).withColumn("shard", F.lit(1))
    got = packing.pack_documents(df, 10).collect()
    check_packed(got, 10)
    assert sum(r.piece_length for r in got if r.doc_id is None) == 25
    bins = [r.bin for r in got if r.doc_id in (4, 5)]
    assert len(set(bins)) == 2  # equal but for case and space: one cluster
    assert packing.pack_documents(df.limit(0)).count() == 0
    small = packing.assign(df, packing.words_in(F.col("text")), "source", packing.cluster_of(F.col("text")), 10, shard=2).collect()
    check_packed(small, 10)
    assert len(small) == len(got)


# Rules


def brute_counts(text):
    text = text or ""
    words, cur = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #|é　\n \t"), max_size=80))
def test_counts(text):
    assert quality_rules.counts(text)[:5] == brute_counts(text)


def test_rules_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    # The verdict, rule by rule in plain Python over counts of its own.
    rules = quality_rules.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in rows:
        text = docs[r.doc_id] or ""
        n, chars, symbols, dup, repeat = brute_counts(text)
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        lines = sum(1 for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        per = lambda k, m: k / max(m, 1)
        value = {
            "n_words": n, "word_length": per(chars, n), "symbol_rate": per(symbols, chars), "dup_line_rate": per(dup, lines), "repeat_rate": per(repeat, n),
            "upper_rate": per(sum("A" <= c <= "Z" for c in text), chars), "digit_rate": per(sum("0" <= c <= "9" for c in text), chars), "mark_rate": per(sum(c in "!?" for c in text), n),
            "distinct_rate": per(len(set(words)), n), "line_length": per(n, lines),
        }
        bad = any(all(value[c.feature] >= c.threshold if c.at_least else value[c.feature] <= c.threshold for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not bad)


def test_learned_list_and_its_expression(spark):
    rng = np.random.default_rng(2)
    x = {n: rng.random(900) for n in quality_rules.FEATURES}
    bad = (x["symbol_rate"] > 0.7) & (x["upper_rate"] > 0.4) | (x["n_words"] < 0.1)
    rules = quality_rules.learn(x, bad, np.arange(900) % 3)
    said = np.zeros(900, bool)
    for r in rules:
        said |= quality_rules._covered(r, x, 900)
    assert (said == bad).mean() > 0.97 and all(len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    assert quality_rules.learn(x, np.zeros(900, bool), np.arange(900) % 3) == []
    df = spark.createDataFrame([(1, "")], "doc_id long, text string")
    rule = [(quality_rules.Condition("n_words", False, 0.0),)]
    assert quality_rules.statistics(df).select(quality_rules.verdict(rule).alias("v")).first().v is False
    assert quality_rules.statistics(df).select(quality_rules.verdict([]).alias("v")).first().v is True


def test_rules_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 0), (3, 1)], "doc_id long, quality int")
    rows = quality_rules.apply(odd, quality_rules.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) + 2 and all(r.base_failed for r in rows if r.n_words < 50)
    assert quality_rules.apply(odd.limit(0), []).count() == 0


# Fingerprints


def test_fingerprints_sql(spark):
    assert oracle.check(queries.op6_multiset_hash(spark, SF), queries.ORACLE_SQL["op6_multiset_hash"], SF) == 200


def test_fingerprint_algebra(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "c\na\nb", "b"), ("", None, "x")], "x string, y string, z string")
    vec = lambda c: multiset_hash.vector(F.col(c))
    both = multiset_hash.insert(vec("x"), vec("z"))
    r = df.select(
        (vec("x") == vec("y")).alias("same"), (multiset_hash.delete(both, vec("z")) == vec("x")).alias("back"), multiset_hash.likeness(vec("x"), vec("y")).alias("one"),
        (both == multiset_hash.vector(F.concat_ws("\n", "x", "z"))).alias("joined"), multiset_hash.likeness(vec("x"), vec("z")).alias("part"),
    ).collect()
    assert all(x.same and x.back and x.joined and x.one == 1 for x in r)
    assert 0 < r[0].part < 1 and r[1].part == 0


def dice(a, b):
    a, b = Counter(a), Counter(b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_likeness_is_the_share_of_lines_at_any_size(spark):
    rng, rows = np.random.default_rng(4), []
    for n in (100, 400, 2000, 8000):
        for share in (0.0, 0.25, 0.5, 0.75, 0.95):
            own = [f"line {x} of {y}" for x, y in rng.integers(0, 1 << 40, (n, 2))]
            other = [x if i < share * n else f"changed {x}" for i, x in enumerate(own)]
            rows.append((dice(own, other), "\n".join(own), "\n".join(rng.permutation(other))))
    often = ["one line that comes again", "and another one"]
    unlike = [f"word{i} alone here" for i in range(9)]
    rows += [(0.0, "\n".join(often * 60), "\n".join(unlike)), (dice(often * 60, often * 45), "\n".join(often * 60), "\n".join(often * 45)), (0.0, "\n".join(often * 40), "\n".join(["a third", "a fourth"] * 40))]
    df = spark.createDataFrame(rows, "want double, x string, y string").repartition(4)
    for r in df.select("want", multiset_hash.likeness(multiset_hash.vector(F.col("x")), multiset_hash.vector(F.col("y"))).alias("got")).collect():
        assert abs(r.got - r.want) < 0.1, r


def test_likeness_of_one_long_paragraph(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(600)]
    rows = [(" ".join(words), " ".join(words[:-1] + ["changed"])), (" ".join(words), " ".join(words[:450] + [f"z{i}" for i in range(150)])), (" ".join(words), " ".join(f"z{i}" for i in range(600))), ("a" * 200_000, "b" * 200_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(multiset_hash.likeness(multiset_hash.vector(F.col("x")), multiset_hash.vector(F.col("y")))).collect()]
    assert got[0] > 0.95 and 0.65 < got[1] < 0.85 and got[2] < 0.05 and got[3] == 0


def test_fingerprints_of_text_ids_and_a_hot_id(spark):
    rows = [(f"id{i:03d}", f"text {i}") for i in range(60)] + [("id007", f"again {i}") for i in range(60)] + [(None, "first")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = {r.text: r.next_text for r in multiset_hash.with_next(df, "doc_id", "text").collect()}
    plain = [r.text for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    assert got == dict(zip(plain, plain[1:] + plain[:1]))


def test_fingerprints_odd_rows(spark, odd):
    rows = multiset_hash.fingerprint_pairs(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fingerprint == by_id[1].fingerprint and by_id[0].n_chars == 0
    last, first = ODD[12], "no id"  # ids ascending with null first: after the last comes the one without an id
    cut = len(last) // 4
    assert by_id[12].edited_sha256 == sha(last[: len(last) - cut] + first[:cut])
    assert multiset_hash.fingerprint_pairs(odd.limit(0)).count() == 0
    one = multiset_hash.fingerprint_pairs(odd.where("doc_id = 4")).first()
    assert one.near_next == 1


# Licences


def test_licences_sql(spark):
    assert oracle.check(queries.op7_license_scan(spark, SF), queries.ORACLE_SQL["op7_license_scan"], SF) == 200


def test_automata():
    a = license_scan.Automaton("x", "<<var;match=a|b;max=2>> one <<beginOptional>>of the<<endOptional>> two <<var>>")
    spans = lambda t: a.spans(license_scan.words(t))
    assert spans("A one two z") == [(0, 4)]
    assert spans("a b one of the two z") == [(0, 7), (1, 7)]
    assert spans("a one of two z") == [] and spans("one two z") == [] and spans("a one two") == []
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    assert [s[2] for s in license_scan.scan(text).spans] == ["mit-grant"]
    assert license_scan.scan(text.replace("free of", "for no")).spans == []


def test_regions_without_an_end_are_an_error(spark):
    for markup in ("a <<beginOptional>>b", "a b<<endOptional>>", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>>", "a <<what>> b"):
        with pytest.raises(ValueError):
            license_scan.parse(markup)
        with pytest.raises(ValueError):
            license_scan.matches(spark.createDataFrame([(1, "a")], "doc_id long, text string"), templates={"x": markup})


def ends(part, text, i):
    """Where the template's part may end in the words, if it begins at word i: a plain search of its tree."""
    if not part:
        return {i}
    head, rest = part[0], part[1:]
    if isinstance(head, list):
        return ends(head + rest, text, i) | ends(rest, text, i)
    if head.word:
        return ends(rest, text, i + 1) if i < len(text) and text[i] == head.word else set()
    out = set()
    for k in range(i, min(i + head.most, len(text))):
        if not re.fullmatch(head.match.encode(), text[k]):
            break
        out |= ends(rest, text, k + 1)
    return out


def said(part, rng, skip):
    """A text that the template accepts; regions are left out with probability skip."""
    out = []
    for t in part:
        if isinstance(t, list):
            out += said(t, rng, skip) if rng.random() >= skip else []
        elif t.word:
            out.append(t.word.decode())
        else:
            names = ["7"] if "[0-9]" in t.match else t.match.split("|") if "|" in t.match else ["thing"]
            out += [rng.choice(names) for _ in range(rng.randint(1, t.most))]
    return out


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_every_region_in_and_out(label):
    """Each template with its regions in and out; with a mandatory word changed it isn't accepted any more."""
    rng, a = random.Random(label), next(a for a in license_scan.AUTOMATA if a.label == label)
    for skip in (0, 1, 0.5, 0.5, 0.5):
        text = said(a.tokens, rng, skip)
        whole = " ".join(["before", *text, "after"])
        assert label in [x[2] for x in license_scan.scan(whole).spans] and re.search(a.regex(), f" {whole} ")
        must = [i for i, w in enumerate(text) if text.count(w) == 1 and w.encode() in a.mandatory]
        bad = " ".join([*text[: must[-1]], "wrong", *text[must[-1] + 1 :]])
        assert label not in [x[2] for x in license_scan.scan(bad).spans] and not re.search(a.regex(), f" {bad} ")


def test_random_templates_by_plain_search():
    """Regions in regions, at the ends, empty, repeated words: runs as a search of the tree finds them."""
    rng = random.Random(8)

    def part(depth):
        out = []
        for _ in range(rng.randint(0 if depth else 1, 4)):
            kind = rng.random()
            out.append(f"<<beginOptional>>{part(depth + 1)}<<endOptional>>" if kind < 0.3 and depth < 3 else f"<<var;match=a|b;max={rng.randint(1, 3)}>>" if kind < 0.45 else rng.choice("abc"))
        return " ".join(out)

    hits = 0
    for _ in range(300):
        a = license_scan.Automaton("x", part(0))
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(12)]
        want = [(i, min(e)) for i in range(len(text)) if (e := {k for k in ends(a.tokens, text, i) if k > i})]
        assert a.spans(text) == want
        hits += len(want)
    assert hits > 300


def test_templates_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Free as in Beer, MIT license"), (2, "free as beer")], "doc_id long, text string")
    rows = license_scan.labelled(df, templates={"beer": "free as <<beginOptional>>in <<beginOptional>>cold<<endOptional>><<endOptional>> beer"}).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in rows] == [("beer,mit", 1.0), ("beer", 1.0)]


def test_licences_odd_rows(spark, odd):
    rows = license_scan.labelled(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(r.labels == "" and r.first_word is None for r in rows)
    assert license_scan.labelled(odd.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "the MIT License and mit license; MIT; licensed under CC BY-SA 4.0")], "doc_id long, text string")
    r = license_scan.labelled(df).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 1, 4, "mit", "cc-notice,mit", 1.0)
    assert license_scan.matches(df).first().spans[0].label == "cc-notice"
