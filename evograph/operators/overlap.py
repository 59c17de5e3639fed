"""Set-similarity joins over participants, capped per probe.

Nothing grows with the square of a hot participant's events, nor with that of the different sets that it is in:

* Sets of up to SMALL members meet by the subsets that they share. Events of one set size that share a subset with the probe are as
  similar to it, at least, as that subset makes them, so of each subset and size only the first few events can be among
  the k best; those are the subset's list, and a probe reads the lists of its own subsets.
* Where one of two sets is larger, classes of equal sets meet by a prefix filter: members are ordered by rarity, the smaller set shows
  its first few, the larger one somewhat more, and a pair that shares none of these can't be similar enough; hot members come last.
  Of a class only the first k events (per group, where a probe's own group is excluded) can be among the k best.

Ties are broken by event_seq.

Sides grow by what explode() makes of them, which the planner's sizes don't tell, so all joins here are merge joins: none is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.shared import cut, merge_join


#: Members of a set up to which it meets others by its subsets (2 ** SMALL - 1 of them).
SMALL = 6


def subsets(members: Column) -> Column:
    """All subsets of an array but the empty one, each in the array's order."""
    bit = lambda mask, i: F.call_function("shiftright", mask, i) % 2 == 1
    return F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(members)) - 1), lambda mask: F.filter(members, lambda _, i: bit(mask, i)))


def small_pairs(classes: DataFrame, scope: str, min_jaccard: float, most: int, grouped: bool, small: int) -> DataFrame:
    """scope, c, d, jaccard: for each small class those that may be among its best. classes: scope, c, members, starts (array of seq, group: the
    first event, and the first one of another group).

    With groups a probe passes over the starts of its own one. Before the start that counts for a class among its `most` best stand, of
    other groups, starts of better classes alone (two of each at most, in different groups): so lists hold `most` starts of any
    group, and 3 * most in all.
    """
    told = F.transform("members", lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"), x))  # joined, they say which members they are
    few = classes.where(F.size("members").between(1, small)).select(scope, "c", "starts", F.size("members").alias("n"), F.explode(subsets(told)).alias("x"))
    few = few.select(scope, "c", "starts", "n", F.size("x").alias("k"), F.array_join("x", "").alias("key")).where(F.col("k") >= F.col("n") * min_jaccard - 1e-9)
    starts = few.select(scope, "key", "n", F.col("c").alias("d"), F.explode("starts").alias("at"))
    limit = most
    if grouped:
        own = F.row_number().over(W.partitionBy(scope, "key", "n", F.col("at.group")).orderBy("at.seq"))
        starts, limit = starts.withColumn("_n", own).where(F.col("_n") <= most), 3 * most
    first = starts.withColumn("_n", F.row_number().over(W.partitionBy(scope, "key", "n").orderBy("at.seq"))).where(F.col("_n") <= limit)
    lists = first.groupBy(scope, "key").agg(F.collect_list(F.struct("n", "d")).alias("list"))  # at most small * limit
    met = merge_join(few.select(scope, "c", F.col("n").alias("m"), "k", "key"), lists, [scope, "key"])
    pairs = met.select(scope, "c", "m", F.col("k").alias("both"), F.inline("list"))
    jaccard = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return pairs.select(scope, "c", "d", jaccard.alias("jaccard")).where(F.col("jaccard") >= min_jaccard).groupBy(scope, "c", "d").agg(F.max("jaccard").alias("jaccard"))


def large_pairs(classes: DataFrame, scope: str, min_jaccard: float, small: int) -> DataFrame:
    """scope, c, d, jaccard, both ways, for all similar pairs of which one set at least has more than `small` members (with itself, too)."""
    rows = classes.select(scope, "c", F.size("members").alias("n"), F.explode("members").alias("member"))
    common = rows.groupBy(scope, "member").agg(F.count(F.lit(1)).alias("df"))
    ordered = merge_join(rows, common, [scope, "member"]).groupBy(scope, "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "member"))).alias("x"))  # a set's own members
    kept = lambda share: F.slice("x", 1, (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"))
    shown = ordered.select(scope, F.col("c").alias("d"), F.col("n").alias("m"), F.explode(kept(2 * min_jaccard / (1 + min_jaccard))).alias("at"))
    asked = ordered.where(F.col("n") > small).select(scope, "c", "n", F.explode(kept(min_jaccard)).alias("at"))
    shorter = (F.col("m") >= F.col("n") * min_jaccard - 1e-9) & (F.struct("m", "d") < F.struct("n", "c"))
    met = merge_join(asked, shown, [scope, "at"]).where(shorter).select(scope, "c", "d").distinct()
    sets = classes.select(scope, "c", "members")
    both = merge_join(merge_join(met, sets, [scope, "c"]), sets.select(scope, F.col("c").alias("d"), F.col("members").alias("other")), [scope, "d"])
    shared = F.size(F.array_intersect("members", "other"))
    pairs = both.select(scope, "c", "d", (shared / (F.size("members") + F.size("other") - shared)).alias("jaccard")).where(F.col("jaccard") >= min_jaccard)
    own = classes.where(F.size("members") > small).select(scope, "c", F.col("c").alias("d"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(pairs.select(scope, F.col("d").alias("c"), F.col("c").alias("d"), "jaccard")).unionByName(own)


def similar_classes(classes: DataFrame, scope: str, min_jaccard: float, most: int, grouped: bool = False, small: int = SMALL) -> DataFrame:
    """scope, c, d, jaccard: for each class (scope, c, members, starts) those that can hold one of its `most` best events, itself among them."""
    near = small_pairs(classes, scope, min_jaccard, most, grouped, small)
    if classes.where(F.size("members") > small).isEmpty():
        return near
    return near.unionByName(large_pairs(classes, scope, min_jaccard, small))


def _lists(rows: DataFrame, scope: str, min_jaccard: float, most: int, own: list[str], each: int | None, more: list[str], sizes: list[int]) -> DataFrame:
    """scope, key, n, list: for each subset of a small set (key) and each size n of sets that have it the first `most` events, of one group `each` at most."""
    at = ["seq", F.col("event_id").alias("id")]
    entries = keyed(rows, min_jaccard, sizes).select(scope, "key", "n", *at, *more, "rest")
    first = lambda *by: F.row_number().over(W.partitionBy(scope, "key", "n", *by).orderBy("seq", "id"))
    if each is not None:
        entries = entries.withColumn("_n", first(*own)).where(F.col("_n") <= each)
    entries = entries.withColumn("_n", first()).where(F.col("_n") <= most)
    return entries.groupBy(scope, "key", "n").agg(F.array_sort(F.collect_list(F.struct("seq", "id", *more, "rest"))).alias("list"))  # at most `most`


def keyed(rows: DataFrame, min_jaccard: float, sizes: list[int]) -> DataFrame:
    """rows (with c, a sorted set) for each subset that may make one similar enough to a set of one of the sizes: key, both (its size), rest (the other members), n (the set's size)."""
    told = F.transform("c", lambda x: F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")))  # joined, they say which members they are
    few = rows.where(F.size("c").isin(sizes)).withColumn("told", told).withColumn("n", F.size("told")).withColumn("x", F.explode(subsets(F.col("told"))))
    few = few.withColumn("both", F.size("x"))
    enough = [f"n = {n} AND both >= {min((b for b in range(1, n + 1) if any(b <= m and b >= (n + m - b) * min_jaccard - 1e-9 for m in sizes)), default=n + 1)}" for n in sizes]
    few = few.where(" OR ".join(enough) or "false")
    return few.withColumn("key", F.array_join("x", "")).withColumn("rest", F.array_except("told", "x")).drop("told", "x", "c")


def _large_items(rows: DataFrame, carried: list[str], scope: str, min_jaccard: float, k: int, most: int, group: str | None, past: bool, more: list[str], shown: list[str], small: int) -> DataFrame:
    """carried, neg, items of the pairs of which one set at least is large. Classes of equal sets carry their first events as an array."""
    own = [group] if group else []
    place = lambda *by: F.row_number().over(W.partitionBy(scope, "c", *by).orderBy("seq", "event_id"))
    first = rows.withColumn("_n", place(*own)).where(F.col("_n") <= (k if group else most))
    if group:
        first = first.withColumn("_n", place()).where(F.col("_n") <= most)
    head = first.groupBy(scope, "c").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("event_id").alias("id"), *more))).alias("head"))
    # Classes get numbers, which the checkpoint makes lasting: what is joined and ranked from here on is narrow.
    named = cut(head.withColumn("number", F.monotonically_increasing_id()))
    classes = named.select(scope, F.col("number").alias("c"), F.col("c").alias("members"))
    near = large_pairs(classes, scope, min_jaccard, small)
    ours = merge_join(rows, named.select(scope, "c", "number"), [scope, "c"]).drop("c").withColumnRenamed("number", "c")
    probes = ours.select(scope, "c", *own).distinct()
    heads = named.select(scope, F.col("number").alias("d"), "head")
    pairs = merge_join(merge_join(probes, near, [scope, "c"]), heads, [scope, "d"])
    if group:
        pairs = pairs.withColumn("head", F.filter("head", lambda x: x[group] < F.col(group) if past else ~x[group].eqNullSafe(F.col(group))))
    pairs = pairs.where(F.size("head") > 0).withColumn("_start", F.get("head", F.lit(0))["seq"])
    by = W.partitionBy(scope, "c", *own).orderBy(F.desc("jaccard"), "_start")
    pairs = pairs.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= (k if group else most))
    items = F.transform(F.slice("head", 1, k if group else most), lambda x: F.struct(x["seq"].alias("seq"), x["id"].alias("id"), *(x[m].alias(m) for m in shown)))
    pairs = pairs.select(scope, "c", *own, (-F.col("jaccard")).alias("neg"), items.alias("items"))
    same = [F.col(f"p.{x}").eqNullSafe(F.col(f"b.{x}")) for x in own]
    out = merge_join(ours.alias("p"), pairs.alias("b"), [F.col(f"p.{scope}") == F.col(f"b.{scope}"), F.col("p.c") == F.col("b.c"), *same])
    out = out.select(*[F.col(f"p.{x}").alias(x) for x in carried], "b.neg", "b.items")
    return out if group else out.withColumn("items", F.filter("items", lambda x: x["id"] != F.col("event_id")))


def overlap_topk(events: DataFrame, min_jaccard: float, k: int, scope: str = "conv", group: str | None = None, keep: tuple[str, ...] = (), past: bool = False, small: int = SMALL) -> DataFrame:
    """For each event its k most similar others: scope, event_id, cand_id, jaccard, rank, and <name> and cand_<name> for `keep`.

    group: candidates of the probe's own group are left out (default: the event itself alone). past: those of later
    groups are left out, too, and order is by group, then event_seq: what was there when the probe's group arrived.

    A subset's list holds the first events that have it. One of a probe's k best is among the first k admissible ones in the list
    of the very members that they share, as all before it are at least as similar: so a probe takes k of each list of its own
    subsets, without those that share more (another list has them), and no pair is moved before that.
    """
    own = [group] if group else []
    names = [x for x in keep if x not in (group, "event_seq")]
    more, shown = [*own, *names], [x for x in keep if x != "event_seq"]
    c = F.array_sort(F.array_distinct(F.transform("participants", F.lower))).alias("c")
    seq = (F.struct(group, "event_seq") if past else F.col("event_seq")).alias("seq")
    rows = events.select(scope, "event_id", *(["event_seq"] if "event_seq" in keep else []), seq, c, *more)
    most = k if past else 2 * k if group else k + 1  # with k of a group at most, k of any other groups are among the first 2 k
    listed = rows.where(F.col(group).isNotNull()) if past else rows
    found = [r[0] for r in rows.select(F.least(F.coalesce(F.size("c"), F.lit(0)), F.lit(small + 1))).distinct().collect()]  # at most small + 2
    sizes = sorted(n for n in found if 1 <= n <= small)
    lists = _lists(listed, scope, min_jaccard, most, own, k if group and not past else None, more, sizes)
    # Rows that agree in all that is told of them are told apart by a number.
    probes = rows.withColumn("twin", F.row_number().over(W.partitionBy(scope, "event_id").orderBy("seq", "c", *more)))
    carried = list(dict.fromkeys([scope, "event_id", "twin", *more, *keep]))
    asked = keyed(probes.select(*carried, "c"), min_jaccard, sizes).withColumnRenamed("n", "m").withColumnRenamed("rest", "lacking")
    jaccard = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    met = merge_join(asked, lists, [scope, "key"]).withColumn("neg", -jaccard).where(jaccard >= min_jaccard)
    admissible = (lambda x: x[group] < F.col(group)) if past else (lambda x: ~x[group].eqNullSafe(F.col(group))) if group else (lambda x: x["id"] != F.col("event_id"))
    taken = F.slice(F.filter("list", lambda x: admissible(x) & ~F.arrays_overlap(x["rest"], F.col("lacking"))), 1, k)
    items = F.transform(taken, lambda x: F.struct(x["seq"].alias("seq"), x["id"].alias("id"), *(x[m].alias(m) for m in shown)))
    met = met.select(*carried, "neg", items.alias("items"))
    if small + 1 in found:
        met = met.unionByName(_large_items(probes, carried, scope, min_jaccard, k, most, group, past, more, shown, small))
    parts = met.where(F.size("items") > 0).groupBy(*carried).agg(F.collect_list(F.struct("neg", "items")).alias("parts"))
    told = lambda p: F.transform(p["items"], lambda x: F.struct(p["neg"].alias("neg"), x["seq"].alias("seq"), x["id"].alias("id"), *(x[m].alias(m) for m in shown)))
    best = F.slice(F.array_sort(F.flatten(F.transform("parts", told))), 1, k)
    out = parts.select(scope, "event_id", *keep, F.posexplode(best).alias("rank", "x"))
    seq_of = F.col("x.seq.event_seq" if past else "x.seq")
    return out.select(scope, "event_id", F.col("x.id").alias("cand_id"), (-F.col("x.neg")).alias("jaccard"), (F.col("rank") + 1).cast("long").alias("rank"), *keep, *[(seq_of if x == "event_seq" else F.col(f"x.{x}")).alias(f"cand_{x}") for x in keep])


def cap_then_filter(candidates: DataFrame, condition: Column) -> DataFrame:
    """A filter after the cap: it never moves below the rank, so a filtered-out candidate still uses its place."""
    return candidates.where(condition)


def gated(candidates: DataFrame, topic: str) -> DataFrame:
    """Capped candidates of the probe's topic; an event without a topic isn't restricted."""
    return cap_then_filter(candidates, F.col(topic).isNull() | (F.col(topic) == F.col(f"cand_{topic}")))


def temporal_edges(candidates: DataFrame, date: str, cand_date: str, more: tuple[str, ...] = ()) -> DataFrame:
    """src, dst of temporal_before edges from candidate pairs with two readable, different dates; and the columns of more."""
    before, after = F.col(cand_date) < F.col(date), F.col(cand_date) > F.col(date)
    return candidates.where(before | after).select("conv", F.when(before, F.col("cand_id")).otherwise(F.col("event_id")).alias("src"), F.when(before, F.col("event_id")).otherwise(F.col("cand_id")).alias("dst"), F.lit("temporal_before").alias("edge_type"), F.lit(1.0).alias("confidence"), *more)


def within_window(rows: DataFrame, scope: list[str], order: list[str], width: int, item: str) -> DataFrame:
    """Pairs of items of a scope at most `width` places apart: the frame of each item's window, exploded."""
    frame = F.collect_list(item).over(W.partitionBy(*scope).orderBy(*order).rowsBetween(-width, width))
    return rows.withColumn("_frame", frame).withColumn("other", F.explode("_frame")).where(F.col("other") != F.col(item)).select(*scope, item, "other")
