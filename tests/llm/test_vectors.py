"""Hard negatives against all pairs; neighbours by hashing against brute force."""

import math

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from evograph.llm import cross_polytope, hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def kept(rows, zero=True):
    """id -> (label, vector), of repeated ids the least."""
    out = {}
    for i, v, lab in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        x = (lab, [float(np.float32(c)) for c in v])
        out[i] = min(out.get(i, x), x)
    return out


def brute_negatives(rows):
    of = {i: ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * c) for c in v]) for i, (lab, v) in kept([r for r in rows if r[2] is not None]).items()}
    out = []
    for a, (lab, v) in of.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m == lab) for i, (m, w) in of.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fits = [(n, -s) for s, n, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(a, p, r, n, -ps, s) for r, (n, s) in enumerate(fits, 1)]
    return sorted(out)


def negatives(df, **index):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label=label, **index)
    return sorted(tuple(r) for r in out.collect())


def data(n, d=8, labels=3, seed=0, step=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i * step, [float(c) for c in np.float32(v)], int(rng.integers(labels))) for i, v in enumerate(x)]


ODD = [(50, None, 1), (100, [1.0, None], 1), (150, [float("nan"), 1.0], 1), (200, [float("inf")], 2), (250, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (300, [0.0, 0.0], 1), (350, [], 1), (400, [0.5], 2), (450, [0.5, 0.25, 0.25], 1), (450, [0.5, 0.25, 0.25], 1), (450, [0.1, 0.25], 1), (-50, [0.4, 0.3], 1), (3, [0.3, 0.2], 2), (4, [0.3, 0.2], 2), (5, [0.6, 0.2], 1), (8, [-0.6, -0.2], 1)]


def test_negatives_are_the_sql(spark):
    assert check(queries.op11_hard_negatives(spark, SF), queries.ORACLE_SQL["op11_hard_negatives"], SF) > 100


def test_negatives_by_lists(spark):
    """Many small lists and slices, several waves; and equal vectors that most rows have."""
    rows = data(400)
    rows += [(4000 + 5 * i, rows[0][1], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gid", F.lit(1)).withColumn("cell", F.lit("x"))
    want = brute_negatives(rows)
    assert len(want) > 300 and negatives(df, lists=60, size=7, sample=200) == want


def test_lists_are_skipped(spark):
    """Tight groups: an anchor visits few lists, and loses nothing."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(c) for c in centres[i % 40] + 0.01 * rng.normal(size=16)], int(i // 40 % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert negatives(df) == brute_negatives(rows)
    lists = hard_negatives.Lists(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), hard_negatives.quantised(F.col("embedding")).alias("v")), 16, lists=40)
    asks = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("gid"), F.col("label").cast("long").alias("label"), hard_negatives.quantised(F.col("embedding")).alias("v"))
    asks = asks.withColumn("windows", F.expr("array(struct(500000L as lo, 4611686018427387904L as hi))")).withColumn("kth", F.expr("array(cast(null as bigint))"))
    assert lists.visits(asks, 0, 40).count() < 24 * len(lists.centres) / 4


def test_negatives_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert negatives(df) == brute_negatives(ODD) != []
    assert negatives(df.limit(0)) == [] == negatives(df.where("vec_id = 450"))
    with pytest.raises(Exception, match="no longer exact"):
        negatives(spark.createDataFrame([(50, [1e9], 1), (1, [1.0], 1)], SCHEMA))


def brute_near(rows, k=20, every=20):
    of = {i: np.array(v) for i, (_, v) in kept([(i, v, 0) for i, v, _ in rows], zero=False).items()}
    d = max(map(len, of.values()), default=0)
    of = {i: np.pad(v, (0, d - len(v))) for i, v in of.items()}
    return {q: sorted(((-float((of[q] * v).sum()), i) for i, v in of.items() if i != q))[:k] for q in of if q % every == 0}


def recall(out, rows, k=20, every=20):
    """Share of the true neighbours found; asserts form, order and exact scores."""
    want, got = brute_near(rows, k, every), {}
    vecs = {i: np.array(v) for i, (_, v) in kept([(i, v, 0) for i, v, _ in rows], zero=False).items()}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {q for q, x in want.items() if x}
    hit = 0
    for q, x in got.items():
        x = sorted(x, key=lambda r: r["rank"])
        assert [r["rank"] for r in x] == list(range(1, len(want[q]) + 1))
        assert [(-r["score"], r["vec_id"]) for r in x] == sorted((-r["score"], r["vec_id"]) for r in x) and len({r["vec_id"] for r in x}) == len(x)
        for r in x:
            a, b = vecs[q], vecs[r["vec_id"]]
            n = min(len(a), len(b))
            assert abs(r["score"] - float((a[:n] * b[:n]).sum())) < 1e-12
        hit += len({i for _, i in want[q]} & {r["vec_id"] for r in x})
    return hit / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert recall(queries.op13_cross_polytope(spark, f"/root/testdata/{sf}"), rows) >= 0.93


@pytest.mark.parametrize("functions", [1, 2])
def test_recall_of_any_lengths(spark, functions):
    """Vectors of different norms, two hashes a table, small slices, and equal vectors that a third of the rows have."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(c * s) for c in v], lab) for (i, v, lab), s in zip(data(600, 12, step=1), rng.uniform(0.5, 2, 600), strict=True)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.lit(1)).withColumn("codes", F.lit("x"))
    out = cross_polytope.search(df, F.col("vec_id") % 20 == 0, functions=functions, size=16, tables=6)
    assert recall(out, rows) >= 0.9


def test_too_few_found(spark):
    """Buckets that give less than k rows are made up for by an exact search."""
    rows = data(90, 8, step=1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert recall(cross_polytope.search(df, F.col("vec_id") % 20 == 0, target=0.0, tables=1), rows) > 0.5
    assert recall(cross_polytope.search(df.where("vec_id < 12"), F.col("vec_id") % 20 == 0), rows[:12]) == 1


def test_near_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert recall(cross_polytope.search(df, F.col("vec_id") % 50 == 0), ODD, every=50) == 1
    assert cross_polytope.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == [] == cross_polytope.search(df.where("vec_id = 400"), F.lit(True)).collect()
