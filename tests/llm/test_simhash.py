"""SimHash near-duplicates against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evograph.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows, radius=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= radius:
                of[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((d, f"{fp[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op1_simhash(spark, SF)) == brute_components(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "One two"), (None, "one TWO"), (5, "a b c d " * 3000), (6, "Ä b c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert got(simhash.components(df)) == brute_components(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.components(df).count() == 0
    assert simhash.keep_one(df).columns == ["doc_id", "text", "lang"]
    assert simhash.keep_one(df).count() == 0


def test_trees_and_slices(spark):
    """Slices of a hot shard lose no link, and a dense group comes out as one."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)])
    fps = sorted(set(near.view(np.int64).tolist()))
    df = spark.createDataFrame([((f,),) for f in fps], "fp struct<f0:bigint>")
    for size in (simhash.SLICE, 3):
        edges = [(r.a.f0, r.b.f0) for r in simhash.links(df, 3, simhash.blocks(3), slice_size=size).collect()]
        groups = simhash.Groups(len(fps))
        at = {f: i for i, f in enumerate(fps)}
        groups.join(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
        want = simhash.Groups(len(fps))
        u = np.array(fps).view(np.uint64)
        i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
        want.join(i, j)
        assert np.array_equal(groups.of, want.of)


def test_blocks_lose_no_link():
    """Fingerprints within the radius agree on one list of bits, at every number of blocks; shards get smaller as fingerprints grow."""
    rng = np.random.default_rng(9)
    for n, keys in ((0, 4), (1 << 32, 10), (1 << 42, 20)):
        cuts = simhash.blocks(3, 1, n)
        assert len(cuts) == keys
        for _ in range(300):
            flipped = set(rng.choice(64, 3, replace=False).tolist())
            assert any(not flipped & set(bits) for bits in cuts)


def test_long_chains_are_one_component(spark):
    n = 60
    edges = spark.createDataFrame([((i,), (i + 1,)) for i in range(n)], "a struct<f0:bigint>, b struct<f0:bigint>")
    labels = simhash.groups_of(edges).select("fp.f0", "lab.f0").collect()
    assert len(labels) == n + 1 and len({r[1] for r in labels}) == 1


def test_keep_one(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [[word() for _ in range(300)] for _ in range(8)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((10 * i, " ".join(t)))
        for k in (1, 2):
            copy = list(t)
            copy[40 * k] = word()  # one word of 300: Jaccard of five-word shingles 0.97
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[3][1]), (None, "alone in the world without an id"), (None, "alone in the world without an id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(0, 80, 10), None], key=repr)
    assert kept.columns == ["doc_id", "text", "n_chars"]


def test_recall_of_samples():
    assert simhash.recall(0.8, simhash.N_SAMPLES, simhash.SAMPLE) > 0.95


def jaccard_components(rows, similarity=0.8, width=5):
    """The ids that stay, by exact Jaccard of five-word shingle sets over all pairs."""

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}

    sets, groups = [shingles(t) for _, t in rows], simhash.Groups(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                groups.join(np.array([i]), np.array([j]))
    return sorted(min(d for (d, _), g in zip(rows, groups.of, strict=True) if g == k) for k in set(groups.of.tolist()))


def pairs_from_06_to_095():
    """Texts and edited copies of them: 160 pairs with similarities from 0.6 to 0.95, and a family whose copies are near its base alone."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    rows = []
    for i in range(160):
        text = [word() for _ in range(int(rng.integers(120, 400)))]
        copy = list(text)
        want = 0.6 + 0.35 * i / 160
        drop = int(len(text) * (1 - want) / (1 + want) / 5 + 0.5)  # an edited word takes five shingles of each side
        for k in range(drop):
            copy[4 + k * (len(text) - 9) // max(1, drop)] = word()
        rows += [(1000 + 2 * i, " ".join(copy)), (1001 + 2 * i, " ".join(text))]
    base = [word() for _ in range(300)]
    for k in range(12):
        copy = list(base)
        for j in range(6):
            copy[10 + 24 * k + 3 * j] = word()
        rows.append((k, " ".join(copy)))
    return [*rows, (5000, " ".join(base))]


def test_keep_one_is_brute_force(spark):
    """Pairs near the bound: none of 0.8 or more is lost, none below is linked."""
    rows = pairs_from_06_to_095()
    want = jaccard_components(rows)
    assert 200 < len(want) < len(rows) - 50
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


def family(n, words=200, low=0.5, high=0.79, seed=4):
    """n texts that differ from a base each in words of its own, so that two are alike at `low` to `high`."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        want = low + (high - low) * rng.random()
        for k, at in enumerate(rng.permutation(words // 5)[: max(1, round(words / 5 * (1 - want) / (1 + want)))]):
            text[5 * at + 2] = f"own{i}x{k}"
        out.append((i, " ".join(text)))
    return out


def test_families_below_the_bound(spark):
    """Many texts that are alike, but not enough: they stay, and no pair of them is compared."""
    rows = family(150)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == jaccard_components(rows)
    sets = spark.createDataFrame([((i, 0), len(s), (i, 0), s.view(np.int64).tolist()) for i, s in ((i, simhash.shingle_set(t, 5)) for i, t in rows)], "fp struct<f0:bigint,f1:bigint>, n int, lab struct<f0:bigint,f1:bigint>, items array<bigint>")
    assert simhash._prefix_pairs(sets, 0.8).count() < 150


def test_prefix_pairs_are_all_similar_ones(spark):
    """Random sets of sizes 1 to 60 with common and rare members: no pair of 0.8 or more is missing."""
    rng = np.random.default_rng(11)
    sets = [set(rng.choice(300, int(rng.integers(1, 60)), replace=False).tolist()) for _ in range(40)]
    sets += [set(list(s)[int(rng.integers(0, 3)) :]) | set(rng.choice(400, int(rng.integers(0, 4))).tolist()) for s in sets for _ in range(3)]
    rows = [((i, 0), len(s), (i, 0), [int(x) for x in s]) for i, s in enumerate(sets) if s]
    found = simhash._prefix_pairs(spark.createDataFrame(rows, "fp struct<f0:bigint,f1:bigint>, n int, lab struct<f0:bigint,f1:bigint>, items array<bigint>"), 0.8)
    got = {frozenset((r.a.f0, r.b.f0)) for r in found.collect()}
    want = {frozenset((i, j)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and len(a & b) >= 0.8 * len(a | b)}
    assert want <= got and len(want) > 40 and len(got) < 5 * len(want)
