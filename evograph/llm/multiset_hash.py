"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (a non-empty line) is hashed to a wide vector, and a text's fingerprint is the sum of its
paragraphs' vectors modulo powers of two:

* 1 lane that counts paragraphs and DENSE lanes of 32 bits that every paragraph adds to: equal sums stand
  for equal multisets of paragraphs, in whatever order;
* SPARSE signed lanes, of which each piece of a paragraph adds 1 to or takes 1 from one. A paragraph is
  cut in pieces after words that end in a mark, after PIECE words at the latest; so a text of one long
  paragraph has many. Only lanes that aren't zero are held, in order.

likeness is 1 - size(a - b) / (size(a) + size(b)), where size() estimates how many pieces a vector stands for from
the sum of its lanes' absolute values. While lanes are few to a piece, that sum is the number itself, repeats
included, so likeness is the share of common pieces (Dice); where many pieces meet in a lane, the sum grows as
the root of their number, and size() turns that back. So it doesn't saturate, whatever a text's length.

Sums make it incremental: insert() adds the vector of what is new, delete() subtracts what has gone.
Everything is an expression of built-in functions; nothing here runs Python on an executor.

Defined cases: a null or empty text has the zero fingerprint; likeness of equal fingerprints is 1, and of
an empty text with another 0; a text of any length is hashed whole; rows with equal texts have equal
fingerprints (near_next hangs on the neighbour), a row each; ids may be of any type that can be ordered;
an empty table gives an empty result; only id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DENSE, SPARSE = 6, 4096
WIDE = 1 << 32
#: Words of a piece, at most, and a piece with the spaces after it: up to the next mark, or else PIECE words. Every match takes all that it has looked at.
PIECE = 8
PIECES = r"((?:[^ \n]+ +){0,%d}?[^ \n]*[.,;:!?|] +|(?:[^ \n]+ *){1,%d})" % (PIECE - 1, PIECE)
#: Ids that the bounds of a range are taken from, per range.
IDS_A_RANGE = 50

#: dense: array of long; sparse: array of (lane, value), lanes ascending, no value 0.
VECTOR = "struct<dense:array<bigint>,sparse:array<struct<lane:int,value:bigint>>>"


def _number(hex_digits: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(hex_digits, first, n), 16, 10).cast("long")


def _dense(text: Column) -> Column:
    """The count and the dense lanes: of each paragraph's SHA-256, 8 digits make a lane."""
    digests = F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.sha2(p, 256))
    one = lambda h: F.array(F.lit(1).cast("long"), *(_number(h, 8 * i + 1, 8) for i in range(DENSE)))
    return _wide(F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), 1 + DENSE), lambda acc, h: F.zip_with(acc, one(h), lambda a, b: a + b)))


def _wide(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: F.pmod(x, F.lit(WIDE)))


def _entry(lane: Column, value: Column) -> Column:
    return F.struct(lane.cast("int").alias("lane"), value.cast("long").alias("value"))


def _bound(columns: dict[str, Column], make) -> Column:
    """make() of columns that are evaluated once."""
    return F.transform(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))), make)[0]


def _summed(entries: Column) -> Column:
    """Entries with one value a lane, lanes ascending, no value 0: they are sorted, and each run is added up."""
    n = lambda v: F.size(v["e"])
    at = lambda v: F.filter(F.slice(F.sequence(F.lit(0), n(v)), F.lit(1), n(v)), lambda i: ~F.get(v["e"], i)["lane"].eqNullSafe(F.get(v["e"], i - 1)["lane"]))
    run = lambda v, i, k: F.slice(v["e"], i + 1, F.coalesce(F.get(v["at"], k + 1), n(v)) - i)
    total = lambda v, i, k: F.aggregate(run(v, i, k), F.lit(0).cast("long"), lambda acc, e: acc + e["value"])
    sums = lambda v: F.transform(v["at"], lambda i, k: _entry(F.get(v["e"], i)["lane"], total(v, i, k)))
    return _bound({"e": F.sort_array(entries)}, lambda v: _bound({"e": v["e"], "at": at(v)}, lambda w: F.filter(sums(w), lambda e: e["value"] != 0)))


def _sparse(text: Column) -> Column:
    """The signed lanes: of each piece's MD5, 3 digits name the lane and the fourth the sign."""
    pieces = F.filter(F.split(F.regexp_replace(text, PIECES, "$1\n"), "\n"), lambda p: p != "")
    codes = F.transform(pieces, lambda p: _number(F.md5(p), 1, 4))
    return _summed(F.transform(codes, lambda c: _entry(F.floor(c / 16), 2 * (c % 2) - 1)))


def zero() -> Column:
    return F.struct(F.array_repeat(F.lit(0).cast("long"), 1 + DENSE).alias("dense"), F.array().cast("array<struct<lane:int,value:bigint>>").alias("sparse"))


def vector(text: Column) -> Column:
    """The summed vector of a text's paragraphs, a VECTOR."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(_dense(text).alias("dense"), _sparse(text).alias("sparse"))


def insert(fingerprint: Column, added: Column) -> Column:
    """The vector of a text and of what is added to it."""
    return _bound({"a": fingerprint, "b": added}, lambda v: F.struct(
        _wide(F.zip_with(v["a"]["dense"], v["b"]["dense"], lambda a, b: a + b)).alias("dense"), _summed(F.concat(v["a"]["sparse"], v["b"]["sparse"])).alias("sparse"),
    ))


def delete(fingerprint: Column, removed: Column) -> Column:
    """The vector of a text without what is removed from it."""
    return _bound({"a": fingerprint, "b": removed}, lambda v: F.struct(
        _wide(F.zip_with(v["a"]["dense"], v["b"]["dense"], lambda a, b: a - b)).alias("dense"),
        _summed(F.concat(v["a"]["sparse"], F.transform(v["b"]["sparse"], lambda e: _entry(e["lane"], -e["value"])))).alias("sparse"),
    ))


def digits(vec: Column) -> Column:
    """A vector as text: 8 hex digits for each dense lane, a colon, then 3 for each sparse lane with its signed value."""
    dense = F.array_join(F.transform(vec["dense"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    sparse = F.array_join(F.transform(vec["sparse"], lambda e: F.concat(F.lower(F.lpad(F.hex(e["lane"]), 3, "0")), F.when(e["value"] > 0, "+").otherwise(""), e["value"].cast("string"))), "")
    return F.concat(dense, F.lit(":"), sparse)


#: Half of pi: for many pieces a lane, the mean absolute value of a lane is the root of pieces a lane over this.
_HALF_PI = 1.5707963267948966


def _size(entries: Column) -> Column:
    """Pieces a lane, from h, the mean absolute value of a lane: x with x / sqrt(1 + pi x / 2) = h."""
    h = F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + F.abs(e["value"])) / F.lit(float(SPARSE))
    c = lambda v: v["h"] * v["h"] * _HALF_PI
    return _bound({"h": h}, lambda v: (c(v) + F.sqrt(c(v) * c(v) + v["h"] * v["h"] * 4.0)) / 2.0)


def likeness(a: Column, b: Column) -> Column:
    """Common pieces as a share of all (Dice), as the sparse lanes estimate it, 0 to 1; 1 for equal vectors."""

    def of(v: Column) -> Column:
        apart = _summed(F.concat(v["a"]["sparse"], F.transform(v["b"]["sparse"], lambda e: _entry(e["lane"], -e["value"]))))
        return _bound({"d": _size(apart), "n": _size(v["a"]["sparse"]) + _size(v["b"]["sparse"])}, lambda w: F.when(v["a"] == v["b"], F.lit(1.0)).when(w["n"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(1 - w["d"] / w["n"], 6))))

    return _bound({"a": a, "b": b}, of)


def _range_of(value: Column, cuts: Column, n: int) -> Column:
    """How many of the n ascending cuts (an array) are below the value, found in two steps of about the square root of their number."""
    step = math.isqrt(n) + 1
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    ends = F.filter(cuts, lambda _, i: i % step == step - 1)
    first = below(ends) * step
    return first + below(F.slice(cuts, first + 1, step))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, vec and next_text, next_vec of the next row in ascending order of id, after the last one the first.

    Rows are cut in ranges at places in the order (id, hash of the text), so that each range is a window of
    its own and no task sees all rows, also if an id repeats very often. The places come from the ids with
    the least hashes, IDS_A_RANGE a range: a bounded sample, which decides where ranges end and nothing
    else. The plan holds them as one constant array, so it is as large for a thousand ranges as for two. What follows
    a range's last row is the first row of the next range, found through one narrow minimum a range, which stays in
    Spark. Nulls come first; equal ids are in order of their texts' hash, and only rows equal in both share a range for certain.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    place = lambda: F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = src.select(place().alias("x")).orderBy(F.xxhash64("x"), "x").limit(IDS_A_RANGE * ranges)
    picked = few.withColumn("i", F.row_number().over(W.orderBy("x"))).where(F.col("i") % IDS_A_RANGE == 0)
    told = picked.agg(F.to_json(F.array_sort(F.collect_set("x"))).alias("x"), F.count_distinct("x").alias("n")).first()  # a constant of the plan: a place a range
    cuts = F.from_json(F.lit(told["x"]), f"array<struct<has_id:boolean,id:{kind},h:bigint>>")
    rows = src.withColumn("place", place()).withColumn("bucket", _range_of(F.col("place"), cuts, told["n"]) if told["n"] else F.lit(0))
    firsts = rows.groupBy("bucket").agg(F.min("place").alias("x"))
    following = F.coalesce(F.lead("x").over(W.orderBy("bucket")), F.first("x").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = F.broadcast(firsts.select(F.col("bucket").alias("for_bucket"), following.alias("y")).select("for_bucket", F.col("y.id").alias("head_id"), F.col("y.h").alias("head_h")))  # a row a range
    head = src.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("head_h"))).select("for_bucket", F.col("text").alias("head_text")).dropDuplicates(["for_bucket"])
    rows = rows.withColumn("next_text", F.lead("text").over(W.partitionBy("bucket").orderBy("place")))
    # The vector is made after the rows are dealt, so that it isn't moved with them; the second window needs no exchange.
    rows = rows.withColumn("vec", vector(F.col("text"))).withColumn("next_vec", F.lead("vec").over(W.partitionBy("bucket").orderBy("place")))
    rows = rows.join(head.withColumn("head_vec", vector(F.col("head_text"))), (F.col("bucket") == F.col("for_bucket")) & F.col("next_text").isNull(), "left")
    return rows.select("doc_id", "text", "vec", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_vec", "head_vec").alias("next_vec"))


def fingerprint_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and the next document's (see the query's contract)."""
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - tail).cast("int")), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.select("doc_id", "n_chars", "vec", "next_vec", F.transform(F.array(edited), lambda e: F.struct(F.sha2(e, 256).alias("sha"), vector(e).alias("vec")))[0].alias("edited"))
    return rows.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), digits(F.col("vec")).alias("fingerprint"), digits(F.col("edited.vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited.vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def _side(name: str, text: str) -> str:
    """Lanes of a column of texts, by grouping: paragraphs and pieces become rows."""
    number = lambda first, n: f"('0x' || substr(h, {first}, {n}))::BIGINT"
    dense = ", ".join(f"lpad(lower(hex((coalesce(sum({number(8 * i + 1, 8)}), 0) % {WIDE})::BIGINT)), 8, '0')" for i in range(DENSE))
    return f"""
{name}_p AS (SELECT k, sha256(p) AS h FROM (SELECT k, unnest(string_split({text}, chr(10))) AS p FROM texts) WHERE p <> ''),
{name}_d AS (SELECT k, lpad(lower(hex((count(*) % {WIDE})::BIGINT)), 8, '0') || concat({dense}) AS d FROM {name}_p GROUP BY k),
{name}_q AS (SELECT k, substr(md5(p), 1, 4) AS h FROM (SELECT k, unnest(string_split(regexp_replace({text}, '{PIECES}', '\\1' || chr(10), 'g'), chr(10))) AS p FROM texts) WHERE p <> ''),
{name}_l AS (SELECT k, substr(h, 1, 3) AS lane, sum(CASE WHEN {number(4, 1)} % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS v FROM {name}_q GROUP BY ALL HAVING v <> 0),
{name}_s AS (SELECT k, string_agg(lane || CASE WHEN v > 0 THEN '+' ELSE '' END || v, '' ORDER BY lane) AS s, sum(abs(v))::DOUBLE AS norm FROM {name}_l GROUP BY k),
{name} AS (SELECT t.k, coalesce(d, '{"0" * 8 * (1 + DENSE)}') || ':' || coalesce(s, '') AS fp, coalesce(norm, 0) AS norm FROM texts t LEFT JOIN {name}_d USING (k) LEFT JOIN {name}_s USING (k))"""


def _sql_size(total: str) -> str:
    h = f"({total} / {float(SPARSE)}::DOUBLE)"
    c = f"({h} * {h} * {_HALF_PI}::DOUBLE)"
    return f"(({c} + sqrt({c} * {c} + {h} * {h} * 4.0::DOUBLE)) / 2.0::DOUBLE)"


def _near(a: str, b: str) -> str:
    return f"""gap_{b} AS (SELECT k, sum(abs(v))::DOUBLE AS gap FROM (SELECT k, lane, sum(v) AS v FROM (SELECT k, lane, v FROM {a}_l UNION ALL SELECT k, lane, -v FROM {b}_l) GROUP BY k, lane) GROUP BY k),
near_{b} AS (SELECT x.k, CASE WHEN x.fp = y.fp THEN 1.0::DOUBLE WHEN x.norm + y.norm = 0 THEN 0.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, round(1 - {_sql_size("coalesce(gap, 0)")} / ({_sql_size("x.norm")} + {_sql_size("y.norm")}), 6)) END::DOUBLE AS near
  FROM {a} x JOIN {b} y USING (k) LEFT JOIN gap_{b} g USING (k))"""


ORACLE_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k FROM documents),
nexts AS (SELECT *, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS nt, length(t) AS n FROM base),
texts AS (SELECT *, left(t, (n - n // 4)::BIGINT) || left(nt, (n // 4)::BIGINT) AS e FROM nexts),{_side("own", "t")},{_side("edit", "e")},{_side("foll", "nt")},
{_near("own", "edit")},
{_near("own", "foll")}
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, own.fp AS fingerprint, edit.fp AS edited_fingerprint, near_edit.near AS near_edited, near_foll.near AS near_next
FROM texts JOIN own USING (k) JOIN edit USING (k) JOIN near_edit USING (k) JOIN near_foll USING (k)
"""
