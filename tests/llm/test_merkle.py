"""The manifest against plain hashing, row by row."""

import hashlib
import random
import zlib

from oracle import check
from pyspark.sql import functions as F

from evograph.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The levels of a tree of threes, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
    return levels


def siblings(levels, i):
    out = []
    for x in levels[:-1]:
        start = i - i % 3
        out.append(("".join(x[start:i]), "".join(x[i + 1 : start + 3])))
        i //= 3
    return out


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf_of((*r[:4], text))
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(queries.op12_merkle(spark, SF)) == brute(rows)


def test_query_is_its_sql(spark):
    assert check(queries.op12_merkle(spark, SF), queries.ORACLE_SQL["op12_merkle"], SF) == 200


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "b", "en", 1, "x\ny"), (-5, "b", None, 3, ""), (7, "b", "en", 2, "a\n"), (7, "b", "en", 2, "a\n"), (7, "b", "en", 3, "other"),
            (2**62, "b", "en", 4, "far\n" * 5000), (-(2**63), "b", "é", 4, "low"), (1, "", "en", 5, "no name"), (2, "Z", "en", 6, "\n\n"), (3, "é", "en", 6, "ü\n"), (4, "a" * 60, "en", 6, "long"), (5, "a" * 60 + "b", "en", 6, "longer")]
    df = table_of(spark, rows).withColumn("g", F.lit("x")).withColumn("rank", F.lit(None)).withColumn("root", F.lit(3))
    assert got(merkle.manifest(df)) == brute(rows)
    assert merkle.manifest(df.limit(0)).collect() == []
    assert got(merkle.manifest(table_of(spark, rows[:1]))) == brute(rows[:1])


def test_trees_of_any_size(spark):
    """Blocks of nine, so that trees have several steps; every number of leaves from one to eighty two, and small buckets."""
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82, 250]
    rows = [(i * 37 % 1009 if s % 2 else i * 10**14 - 5, f"s{s}", "en", i, f"text {i}\n") for s in sizes for i in range(s)]
    random.Random(1).shuffle(rows)
    assert got(merkle.manifest(table_of(spark, rows), levels=2, limit=5)) == brute(rows)


def test_hot_id_is_split(spark):
    """One id and one row hold most of a source; their ranks stay whole."""
    rows = [(9, "s", "en", i, f"t{i}") for i in range(60)] + [(9, "s", "en", 1, "same")] * 60 + [(i, "s", "en", 1, "x") for i in range(20)]
    assert got(merkle.manifest(table_of(spark, rows), levels=2, limit=7)) == brute(rows)


def test_ranks_are_places(spark):
    rows = [(g, k) for g in "ab" for k in [None, None, -(2**63), 2**63 - 1, 0, 1, 2, -1, *range(100, 400, 3)]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, k long, n long")
    out = merkle.radix_ranks(df, "g", ["k", "n"], limit=4, bits=3).collect()
    want = {}
    for g in "ab":
        own = sorted(((k is not None, k or 0, n) for n, (h, k) in enumerate(rows) if h == g))
        want |= {n: i for i, (_, _, n) in enumerate(own)}
    assert {r.n: r["rank"] for r in out} == want
