"""A Merkle manifest of a dataset: a leaf a document, a tree a source, a tree over the sources.

Places within a source come from a radix trie, not from a global sort: digits of the id make histograms, one
hierarchy level after another; a bucket's first rank is the sum of what stands before it, and only buckets
of more than LIMIT rows are split by further digits (of the id, then of the leaf, then of a row number, so that
a repeated id is split, too). What is left in a bucket is ranked there. No source is a task.

The rank's digits to the base of the fanout then key the nodes of the tree: rows that share all digits but the
last LEVELS are a block (at most FANOUT ** LEVELS rows), whose levels are reduced in one task; the blocks'
nodes are the rows of the next step. Proofs go the other way, each block's path joined behind its rows' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.llm.common import table

#: Nodes that become one; levels that a task reduces at a time.
FANOUT, LEVELS = 3, 6
#: Bits of a radix digit; rows of a bucket that is ranked as it is.
BITS, LIMIT = 10, 4096


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in row)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Where 2 divides the id's crc32, the text without its line feeds; else the text."""
    return F.when(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def radix_ranks(rows: DataFrame, group: str, keys: list[str], limit: int = LIMIT, bits: int = BITS, tail: tuple[str, ...] = ()) -> DataFrame:
    """rows with `rank`, from 0, of each within its group, by the columns keys (long, nulls first), in order, then by those of tail.

    group isn't null. Buckets of more than `limit` rows are split as long as the keys have digits. Digits are read from the first bit in which a key's least and
    greatest value differ, so that dense ids need few levels.
    """
    ends = rows.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    levels = []
    for i in range(len(keys)):
        if ends[f"lo{i}"] is not None:
            span = ((ends[f"lo{i}"] ^ ends[f"hi{i}"]) & (2**64 - 1)).bit_length()
            levels += [(i, s) for s in [*range(span - bits, 0, -bits), 0]]
    levels = levels or [(0, 0)]

    def prefix(level: int) -> list[Column]:
        """The key's beginning at a level: whole keys, then the leading bits of the next one. A null key comes before all."""
        at, shift = levels[level]
        out = [group]
        for i, k in enumerate(keys):
            out += [(F.col(k).isNotNull() if i <= at else F.lit(False)).alias(f"_h{i}")]
            out += [F.coalesce(F.col(k) if i < at else F.shiftright(k, shift) if i == at else F.lit(0), F.lit(0)).cast("long").alias(f"_p{i}")]
        return out

    names = [f"_{c}{i}" for i in range(len(keys)) for c in "hp"]
    parents, placed = None, []
    for level in range(len(levels)):
        inner = rows.select("*", *prefix(level)[1:])
        if parents is None:
            counted = inner.groupBy(group, *names).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit(0))
            within = [group]
        else:  # rows of the buckets that are too large, counted by their next digit
            up = [c.alias(f"{n}u") for n, c in zip(names, prefix(level - 1)[1:], strict=True)]
            large = parents.select(group, *(F.col(n).alias(f"{n}u") for n in names), "base")
            met = inner.select("*", *up).join(large, [group, *(f"{n}u" for n in names)])
            counted = met.groupBy(group, *names, *(f"{n}u" for n in names)).agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"))
            within = [group, *(f"{n}u" for n in names)]
        before = F.coalesce(F.sum("n").over(W.partitionBy(*within).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = table(counted.select(group, *names, "n", (F.col("base") + before).cast("long").alias("base")))
        last = level == len(levels) - 1
        small = counts if last else counts.where(F.col("n") <= limit)
        if last or not small.isEmpty():
            placed.append(inner.join(small.drop("n"), [group, *names]).withColumn("_l", F.lit(level)))
        parents = counts.where(F.col("n") > limit)
        if last or parents.isEmpty():
            break
    order = W.partitionBy(group, *names).orderBy(*keys, *tail)
    out = None
    for df in placed:  # a bucket is ranked after the exchange of its join, without another one
        df = df.withColumn("rank", F.col("base") + F.row_number().over(order) - 1).select(*rows.columns, "rank")
        out = df if out is None else out.unionByName(df)
    return out


def _depth(n: Column, fanout: int) -> Column:
    """Levels above n nodes: the least d with fanout ** d >= n."""
    out = None
    for d in range(64):
        if fanout**d > 2**62:
            break
        out = F.when(n <= fanout**d, d) if out is None else out.when(n <= fanout**d, d)
    return out.otherwise(64)


def _blocks(nodes: DataFrame, more: tuple[str, ...], fanout: int, levels: int) -> DataFrame:
    """g, block, steps, items (idx, h and more, in order), nodes (arrays of digests, the block's own ones first, then level by level). nodes: g, idx, h, depth."""
    made = nodes.groupBy("g", F.expr(f"idx div {fanout**levels}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "h", *more))).alias("items"), F.first("depth").alias("depth"))  # fanout ** levels at most
    up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fanout).cast("int")), lambda i: F.sha2(F.array_join(F.slice(x, i * fanout + 1, fanout), ""), 256))
    steps = F.greatest(F.lit(0), F.least(F.lit(levels), F.col("depth"))).alias("steps")
    base = made.select("g", "block", "items", "depth", steps, F.transform("items", lambda x: x["h"]).alias("own"))
    start = F.array(F.col("own"))
    grown = F.aggregate(F.sequence(F.lit(1), F.col("steps")), start, lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))
    return base.withColumn("levels", F.when(F.col("steps") == 0, start).otherwise(grown)).drop("own")


def _own_path(at: Column, fanout: int, levels: int) -> Column:
    """For the row at this place (from 0) of a block: what stands left and right of it in its run, level by level."""
    powers = F.array(*(F.lit(fanout**j) for j in range(levels + 1)))

    def beside(j: Column) -> Column:
        x = F.element_at("levels", j + 1)
        place = F.floor(at / F.element_at(powers, j + 1)).cast("int")
        return F.struct(F.array_join(F.slice(x, place - place % fanout + 1, place % fanout), "").alias("left"), F.array_join(F.slice(x, place + 2, fanout - 1 - place % fanout), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(levels - 1)), 1, F.col("steps")), beside)


def reduce_up(nodes: DataFrame, deepest: int, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of g, idx, h, depth: the given one, then those of each step's blocks; the last has one row a group, its root."""
    out = [nodes]
    while deepest > 0:
        blocks = _blocks(out[-1].select("g", "idx", "h", "depth"), (), fanout, levels)
        top = F.element_at(F.element_at("levels", -1), 1)
        out.append(table(blocks.select("g", F.col("block").alias("idx"), top.alias("h"), (F.col("depth") - levels).alias("depth"))))
        deepest -= levels
    return out


def paths_down(steps: list[DataFrame], above: DataFrame, more: tuple[str, ...], fanout: int, levels: int) -> DataFrame:
    """g, idx, h, more, path (left and right siblings, from the row up) for the rows of steps[0]. above: g, path, of each group's root."""
    path = above.select("g", F.lit(0).cast("long").alias("block"), F.col("path").alias("over"))
    for i in range(len(steps) - 2, -1, -1):
        carried = more if i == 0 else ()
        blocks = _blocks(steps[i], carried, fanout, levels).join(path, ["g", "block"])
        rows = F.transform("items", lambda x, k: F.struct(*(x[c].alias(c) for c in ("idx", "h", *carried)), F.concat(_own_path(k, fanout, levels), F.col("over")).alias("path")))  # noqa: B023
        path = blocks.select("g", F.inline(rows))
        if i:
            path = table(path.select("g", F.col("idx").alias("block"), F.col("path").alias("over")))
    if len(steps) == 1:  # groups of one row each
        path = steps[0].join(path.drop("block"), "g").withColumnRenamed("over", "path").select("g", "idx", "h", *more, "path")
    return path


def _with_depth(rows: DataFrame, fanout: int) -> tuple[DataFrame, int]:
    """rows (g, idx, ...) with the depth of their group's tree, and the deepest."""
    sizes = table(rows.groupBy("g").agg(_depth(F.count(F.lit(1)), fanout).alias("depth")))
    return rows.join(sizes, "g"), sizes.agg(F.max("depth")).first()[0] or 0


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified: each document's leaf, its roots, its proof and what the proof makes of a tampered text.

    Null ids come first in their source, equal ids stand in the order of their leaves, and equal rows are leaves
    of their own, side by side. A null source is a source, before all others. Nulls of any column have their own mark in
    the leaf. Texts are hashed whole. Further columns of docs, whatever their names, don't count. An empty table gives no rows.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    whole, other = leaf([*columns, F.col("text")]), leaf([*columns, tampered_text(F.col("doc_id"), F.col("text"))])
    g = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))  # null before all; strings compare by bytes
    made = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("id"), F.unhex(whole).alias("leaf"), F.unhex(other).alias("bent"))
    bits = lambda c, a, n: F.conv(F.substring(F.hex(c), a, n), 16, 10).cast("long")
    rows = table(made.select("g", "id", "leaf", F.nullif("bent", "leaf").alias("bent"), bits("leaf", 1, 15).alias("key"), F.monotonically_increasing_id().alias("n")))
    ranked = radix_ranks(rows, "g", ["id", "key", "n"], limit)
    hexed = lambda c: F.lower(F.hex(c))
    ranked = table(ranked.select("g", F.col("rank").alias("idx"), "id", "leaf", "bent"))
    of, deepest = _with_depth(ranked, fanout)
    steps = reduce_up(of.withColumn("h", hexed("leaf")), deepest, fanout, levels)

    # The tree over the sources: their roots, ranked by the bytes of the name.
    roots = steps[-1].select("g", F.col("h").alias("subroot"))
    chunk = lambda i: bits(F.rpad(F.substring(F.encode("g", "utf-8"), 7 * i + 1, 7), 7, F.lit(b"\0")), 1, 14).alias(f"c{i}")
    named = table(roots.select(F.lit("").alias("all"), "g", "subroot", *(chunk(i) for i in range(6))))
    order = radix_ranks(named, "all", [f"c{i}" for i in range(6)], limit, tail=("g",))
    top = table(order.select(F.lit("").alias("g"), F.col("rank").alias("idx"), F.col("subroot").alias("h"), F.col("g").alias("name")))
    tops, top_depth = _with_depth(top, fanout)
    tops = reduce_up(tops, top_depth, fanout, levels)
    root = tops[-1].first()  # a row, or none of an empty table
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = paths_down(tops, tops[-1].select("g", none.alias("path")), ("name",), fanout, levels)
    over = table(over.select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path", F.lit(root["h"] if root else None).cast("string").alias("root")))

    ends = paths_down(steps, over.select("g", "path"), ("id", "leaf", "bent"), fanout, levels)
    own, given = hexed("leaf"), hexed(F.coalesce("bent", "leaf"))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = F.aggregate("path", given, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))
    out = ends.join(over.drop("path"), "g").select(F.col("id").alias("doc_id"), F.expr("substring(g, 2)").alias("name"), "g", own.alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.select("doc_id", F.when(F.col("g") != "0", F.col("name")).alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(inner: int = 14, outer: int = 7) -> str:
    """The manifest by plain grouping, level by level: trees of up to 3 ** inner documents and 3 ** outer sources."""
    hashed = lambda text: "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    ctes = [
        f"d AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed('bent')} AS given FROM (SELECT *, CASE WHEN crc32(doc_id::VARCHAR) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bent FROM documents))".replace("crc32(doc_id::VARCHAR)", _CRC32_SQL),
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)", "a0 AS (SELECT source AS g, i, leaf AS h FROM n0)", "p0 AS (SELECT doc_id, source AS g, i, leaf, given AS h, '' AS proof FROM n0)",
    ]

    def climb(a: str, p: str, steps: int) -> None:
        """Nodes and paths of each level; a tree that has one node stays as it is."""
        for j in range(steps):
            ctes.append(f"{a}r{j} AS (SELECT g, i // 3 AS i, list(h ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {a}{j}) GROUP BY g, i // 3)")
            ctes.append(f"{a}{j + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {a}r{j})")
            left, right = "array_to_string(run[1:p.i % 3], '')", "array_to_string(run[p.i % 3 + 2:], '')"
            ctes.append(f"{p}{j + 1} AS (SELECT p.* REPLACE (p.i // 3 AS i, CASE WHEN n = 1 THEN p.h ELSE sha256(concat({left}, p.h, {right})) END AS h, CASE WHEN n = 1 THEN proof ELSE concat(proof, {left}, {right}) END AS proof) FROM {p}{j} p JOIN {a}r{j} r ON r.g IS NOT DISTINCT FROM p.g AND r.i = p.i // 3)")

    climb("a", "p", inner)
    ctes.append(f"s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS source FROM a{inner})")
    ctes.append(f"t0 AS (SELECT p.doc_id, 0 AS g, s.i, p.leaf, p.h, p.proof, s.source, s.h AS subroot FROM p{inner} p JOIN s0 s ON s.source IS NOT DISTINCT FROM p.g)")
    climb("s", "t", outer)
    return f"WITH {', '.join(ctes)} SELECT t.doc_id, t.source, t.leaf, t.subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified FROM t{outer} t, s{outer} r"


#: DuckDB has no crc32: bit by bit over the digits of an id (a sign, too).
_CRC32_SQL = """CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, c:
  list_reduce(list_prepend(xor(acc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) END"""

ORACLE_SQL = _sql()
