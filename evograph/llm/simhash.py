"""Near-duplicates by SimHash and BK-trees.

Fingerprints within the radius r of each other agree on at least one of r + 1 blocks of their bits. So each block's value names a shard, and each shard holds a BK-tree of its distinct fingerprints: a node's
children are keyed by their integer Hamming distance to it, and a search at distance d from a node
follows only the edges d - r to d + r. No link is lost, and no pair of documents is made.

A shard's trees are broadcast to every slice of the shard's probes through a keyed exchange, not through
the driver, which must not hold all fingerprints: a shard of more than SLICE fingerprints is dealt in
slices, and the tree of each slice goes to the tasks of all later slices. So what a task holds is
bounded, also for a shard with a third of all fingerprints. A task builds the trees of many shards at a
time, level by level in arrays, and walks all probes side by side.

A task emits no links but a spanning forest of them (each fingerprint with a least one linked to it),
so a group of n near copies makes n rows, not n squared. Components then come from contraction rounds
over that forest, in DataFrames; only a count per round reaches the driver.

keep_one() is for whole near copies by Jaccard similarity. BK-trees over the SimHash of shingle sets give the
first links; a SimHash can't tell all pairs of that similarity from others, so bands of least hashes give
what the radius doesn't reach. Each link is checked on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evograph.llm.common import cut, over_texts, table

#: Fingerprints of a shard's slice.
SLICE = 32_768
#: Rows of shards that a task takes up at a time (a shard's slice pair is never divided).
FOREST = 100_000
#: (probe, node) pairs that a walk holds at a time.
FRONTIER = 1 << 20


def shingles_of(text: str, width: int) -> list[bytes]:
    """Runs of `width` words (all words if there are fewer), each time they occur."""
    words = text.encode("utf-8").lower().split()  # bytes: lower() changes A-Z alone, split() is at ASCII white space
    if 0 < len(words) < width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(text: str, width: int = 3, seeds: tuple[int, ...] = (42,), repeats: bool = True) -> list[int]:
    """SimHash of the text's word shingles (repeats: each time it occurs, else once): 64 bits for each seed; 0 for a text without words."""
    shingles = shingles_of(text, width)
    if not shingles:
        return [0] * len(seeds)
    shingles = shingles if repeats else set(shingles)
    digest = xxhash.xxh64_intdigest
    return [majority(np.array([digest(s, seed) for s in shingles], "<u8")) for seed in seeds]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = 3, seeds: tuple[int, ...] = (42,), repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: a struct f0, f1, ... of 64 bits each, as signed longs. A null text counts as an empty one."""
    names = [f"f{i}" for i in range(len(seeds))]

    def make(texts: list[str]) -> dict[str, np.ndarray]:
        return dict(zip(names, np.array([fingerprint(t, width, seeds, repeats) for t in texts], np.uint64).reshape(-1, len(seeds)).T.copy().view(np.int64), strict=True))

    return over_texts(df, id_col, text_col, ", ".join(f"{n} bigint" for n in names), make).select("doc_id", F.struct(*names).alias("fp"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints; each is a row of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Groups:
    """Union-find over numbers, many unions at a time; a group's name is its least number."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


class Forest:
    """BK-trees of many shards in arrays. shard: dense numbers, ascending; fp: rows of words, distinct within each shard.

    What comes to a node within the radius while the trees are built is joined to it at once.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        self.fp, self.radius, self.base = fp, radius, 64 * fp.shape[1] + 1
        self.groups = Groups(len(fp))
        first = np.append(True, shard[1:] != shard[:-1])
        self.root = np.flatnonzero(first)
        codes, children, self.levels = [], [], []
        left = np.flatnonzero(~first)
        at = self.root[shard[left]]
        while len(left):  # all that is not placed has come to the node `at`; a level of the trees a round
            d = distance(fp[left], fp[at])
            self.groups.join(left[d <= radius], at[d <= radius])
            code = at * self.base + d
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            new = np.append(True, ranked[1:] != ranked[:-1])
            child = left[order[new]]
            codes.append(ranked[new])
            children.append(child)
            self.levels.append((at[order[new]], child))
            group = np.cumsum(new) - 1
            stay = order[~new]
            at = child[group[~new]]
            left = left[stay]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.child = code[order], (np.concatenate(children) if children else code)[order]

    def whole(self) -> np.ndarray:
        """For each node the group that it and all below it are in, -1 if there is more than one."""
        out = self.groups.of.copy()
        for parent, child in reversed(self.levels):
            mixed = out[child] != self.groups.of[parent]
            out[parent[mixed]] = -1
        return out

    def near(self, probe: np.ndarray, shard: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (probe number, node) within the radius; probe: fingerprints, shard: the number of each one's tree.

        known: the groups that probes are in (changed as they are found in others); subtrees of that group alone
        are not entered, as they add no union.
        """
        todo = [(np.arange(i, min(i + FRONTIER, len(probe))), self.root[shard[i : i + FRONTIER]]) for i in range(0, len(probe), FRONTIER)]
        whole = None if known is None else self.whole()
        while todo:
            who, node = todo.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                todo += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            if known is not None:
                go = whole[node] != known[who]
                who, node = who[go], node[go]
            d = distance(probe[who], self.fp[node])
            hit = d <= self.radius
            if hit.any():
                yield who[hit], node[hit]
                if known is not None:
                    known[who[hit]] = self.groups.of[node[hit]]
            lo = np.searchsorted(self.code, node * self.base + np.maximum(d - self.radius, 0), "left")
            hi = np.searchsorted(self.code, node * self.base + np.minimum(d + self.radius, self.base - 1), "right")
            n = hi - lo
            if total := int(n.sum()):
                ends = np.cumsum(n)
                todo.append((np.repeat(who, n), self.child[np.arange(total) + np.repeat(lo - (ends - n), n)]))


def _local_forest(shard: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, the row that names their group), for those not alone. role: 0 tree and probe, 1 tree, 2 probe."""
    dense = np.cumsum(np.append(False, shard[1:] != shard[:-1]))
    tree, probe = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    usable = np.isin(dense, dense[tree]) & np.isin(dense, dense[probe])  # a shard of probes or of trees alone has no links
    usable &= (np.bincount(dense) > 1)[dense]
    tree, probe = tree[usable[tree]], probe[usable[probe]]
    groups = Groups(len(fp))
    if len(tree):
        names, of_tree = np.unique(dense[tree], return_inverse=True)
        forest = Forest(of_tree, fp[tree], radius)
        groups.join(tree, tree[forest.groups.of])
        place = np.full(len(fp), -1)
        place[tree] = np.arange(len(tree))
        known = np.where(place[probe] >= 0, forest.groups.of[place[probe]], -2)
        for who, node in forest.near(fp[probe], np.searchsorted(names, dense[probe]), known):
            groups.join(probe[who], tree[node])
    other = np.flatnonzero(groups.of != np.arange(len(fp)))
    return other, groups.of[other]


def blocks(radius: int, words: int = 1, n: int = 0) -> list[list[int]]:
    """Lists of bits: fingerprints within the radius agree on all bits of one of them, so no link is lost.

    Of radius + 1 + e blocks, two such fingerprints agree on 1 + e at least, so each choice of 1 + e blocks is
    a list. e is 0 unless shards of so few bits would hold more than SLICE of n fingerprints on the mean.
    """
    bits, more = 64 * words, 0
    while more < 3 and n > SLICE << (1 + more) * bits // (radius + 1 + more):
        more += 1
    m = radius + 1 + more
    parts = [list(range(bits * i // m, bits * (i + 1) // m)) for i in range(m)]
    return [sum(chosen, []) for chosen in combinations(parts, 1 + more)]


def _banded(fps: DataFrame, words: list[str], cuts: list[list[int]]) -> DataFrame:
    """The words of each fingerprint with band (the number of a list of bits) and value (those bits of it), a row per list."""
    kinds = [(w, pa.int64()) for w in words] + [("band", pa.int32()), ("value", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.column_stack([c.to_numpy() for c in batch.columns]).view(np.uint64)
            for band, bits in enumerate(cuts):
                value = np.zeros(len(fp), np.uint64)
                for k, i in enumerate(bits):
                    value |= (fp[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) << np.uint64(k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(fp), band, np.int32)), pa.array(value.view(np.int64))], schema=pa.schema(kinds))

    return fps.select("fp.*").mapInArrow(run, ", ".join(f"{w} bigint" for w in words) + ", band int, value bigint")


def links(fps: DataFrame, radius: int, cuts: list[list[int]], slice_size: int = SLICE) -> DataFrame:
    """a, b: a spanning forest of the links within each shard, over the distinct values of fps.fp.

    cuts: bits (up to 63) whose values name the shards, a table for each list.
    """
    words = [f.name for f in fps.schema["fp"].dataType.fields]
    banded = _banded(fps, words, cuts)
    large = banded.groupBy("band", "value").count().where(F.col("count") > slice_size).select("band", "value", F.ceil(F.col("count") / slice_size).cast("int").alias("slices"))
    dealt = banded.join(cut(large), ["band", "value"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64(*words), F.col("slices")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("s"), F.greatest(k, F.col("own")).alias("p"), F.when(k == F.col("own"), 0).when(k > F.col("own"), 1).otherwise(2).alias("role")),
    )
    sharded = dealt.withColumn("own", own).select(*words, "band", "value", F.explode(pairs).alias("x")).select(*words, "band", "value", "x.s", "x.p", "x.role")
    keys = ["band", "value", "s", "p"]
    names = [f"{end}{i}" for end in "ab" for i in range(len(words))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: dict[str, np.ndarray], end: int) -> pa.RecordBatch:
            shard = np.cumsum(np.any([np.append(False, rows[k][1:end] != rows[k][: end - 1]) for k in keys], axis=0))
            fp = np.column_stack([rows[w][:end] for w in words]).view(np.uint64)
            a, b = _local_forest(shard, fp, rows["role"][:end], radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[w][:end][side]) for side in (a, b) for w in words], names=names)

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
            held = {k: np.append(held[k], v) for k, v in new.items()} if held else new
            if len(held["role"]) >= FOREST:
                last = np.flatnonzero(np.any([held[k] != held[k][-1] for k in keys], axis=0))
                if len(last):  # all but the shard that may go on
                    end = int(last[-1]) + 1
                    yield done(held, end)
                    held = {k: v[end:].copy() for k, v in held.items()}
        if held and len(held["role"]):
            yield done(held, len(held["role"]))

    rows = sharded.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, ", ".join(f"{n} bigint" for n in names))
    side = lambda end: F.struct(*[F.col(f"{end}{i}").alias(w) for i, w in enumerate(words)]).alias(end)
    return rows.select(side("a"), side("b"))


def groups_of(edges: DataFrame) -> DataFrame:
    """fp, lab: of each end of an edge, the name of its component (one of the component's fingerprints).

    Each round every node takes the least name among itself and its neighbours (in the order of a hash
    that is new each round, so that chains shrink by a factor, too), and edges are drawn again between
    the names. Minima are pre-aggregated, so a hub with a third of all edges costs a row per task.
    """
    edges = cut(edges.where("a <> b").distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct().select("fp", F.col("fp").alias("lab")))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("lab"))  # noqa: B023, E731
        least = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), ranked("b").alias("w")), F.struct(F.col("b").alias("v"), ranked("a").alias("w")))).alias("x"))
        up = least.select("x.v", F.col("x.w").alias("w")).groupBy("v").agg(F.min("w").alias("w")).select("v", F.least(F.col("w"), ranked("v"))["lab"].alias("to"))
        up = cut(up)
        labels = cut(labels.join(up, F.col("lab") == F.col("v"), "left").select("fp", F.coalesce("to", "lab").alias("lab")))
        ends = edges.join(up.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def _named(df: DataFrame, radius: int, width: int, seeds: tuple[int, ...], repeats: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, component_id for each row of df."""
    fps = cut(fingerprints(df, width, seeds, repeats, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = groups_of(links(distinct.select("fp"), radius, blocks(radius, len(seeds), distinct.count())))
    named = cut(distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("lab", "fp").alias("lab")))
    least = cut(named.groupBy("lab").agg(F.min("least").alias("component_id")))
    member = cut(named.select("fp", "lab").join(least, "lab").select("fp", "component_id"))
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def components(df: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for each row of df.

    Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like
    any other; equal rows are one component, a row each; a row with a null id takes part and passes
    links on, and a component of null ids alone has a null component_id; an empty table gives an empty
    result; only id and text are read, so other columns don't matter.
    """
    found = _named(df, radius, width, (seed,), True, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp.f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Whole near copies (five words, Jaccard 0.8 or more) are met within RADIUS bits of SimHash, or else in N_SAMPLES bands of SAMPLE least hashes each.
RADIUS, N_SAMPLES, SAMPLE = 3, 32, 5
#: Words of the bits that tell how far apart two sets are, at least.
PARITY = 8
#: Links over which labels travel before what is left apart is compared pair by pair (more or fewer: the same result).
STEPS = 3
_TURNS = np.random.default_rng(5).integers(0, 1 << 63, (2, N_SAMPLES * SAMPLE), np.uint64)


def recall(similarity: float, n: int, size: int) -> float:
    """Share of pairs of that Jaccard similarity that agree on one of n bands of `size` least hashes."""
    return float(1 - (1 - similarity**size) ** n)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The text's distinct shingles as ascending hashes of 64 bits."""
    return np.array(sorted({xxhash.xxh64_intdigest(s, 42) for s in shingles_of(text, width)}), "<u8")


def bands_of(hashes: np.ndarray) -> list[int]:
    """A number for each band: equal if the least hashes in the band's SAMPLE orders are. None for an empty set."""
    if not len(hashes):
        return []
    least = np.full(N_SAMPLES * SAMPLE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None]
        least = np.minimum(least, ((h ^ _TURNS[0]) * (_TURNS[1] | np.uint64(1))).min(axis=0))
    rows = least.astype("<u8").reshape(N_SAMPLES, SAMPLE)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def _sketches(df: DataFrame, width: int) -> DataFrame:
    """doc_id, fp: the name of the text's shingle set in 128 bits, n: its size, simhash, bands."""

    def make(texts: list[str]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in texts]
        names = [[xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for x in sets] for k in (1, 2)]
        simhash = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
        return {"f0": names[0], "f1": names[1], "n": list(map(len, sets)), "simhash": simhash, "bands": list(map(bands_of, sets))}

    return over_texts(df, "id", "text", "f0 bigint, f1 bigint, n int, simhash bigint, bands array<bigint>", make).select("doc_id", F.struct("f0", "f1").alias("fp"), "n", "simhash", "bands")


def _tree_stars(distinct: DataFrame) -> DataFrame:
    """fp, n, and to, its size m: pairs of sets that the BK-trees over SimHashes link. The largest set of a SimHash stands for it: the
    other sets of that SimHash meet it, and it meets those of the SimHashes that the trees' forest of links joins it with."""
    tops = cut(distinct.groupBy("simhash").agg(F.max(F.struct("n", "fp")).alias("top")).select("simhash", F.col("top.fp").alias("to"), F.col("top.n").alias("m")))
    same = distinct.join(tops, "simhash").select("fp", "n", "to", "m")
    forest = links(tops.select(F.struct(F.col("simhash").alias("f0")).alias("fp")), RADIUS, blocks(RADIUS, 1, tops.count())).select(F.col("a.f0").alias("simhash"), F.col("b.f0").alias("other"))
    near = forest.join(tops.select("simhash", F.col("to").alias("fp"), F.col("m").alias("n")), "simhash").join(tops.withColumnRenamed("simhash", "other"), "other").select("fp", "n", "to", "m")
    return cut(same.unionByName(near).where("fp <> to"))


def _alike(similarity: float) -> Column:
    """Have items_a and items_b, two shingle sets, at least that Jaccard similarity?"""
    both = F.size(F.array_intersect("items_a", "items_b"))
    return both / (F.size("items_a") + F.size("items_b") - both) >= F.lit(similarity)


def _prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of sets (fp, n, lab, items) of different labels that can be that similar, and few others.

    Shingles are ordered by rarity among these sets. Two sets that are similar enough share one of the first n - ceil(similarity * n) + 1
    of the larger and of a yet shorter beginning of the smaller one, at places after which enough can follow. So what
    a large family of texts has in common, at less than the similarity, doesn't bring them together: it comes last. What gets by
    that is looked at in PARITY * 64 bits, of which every shingle turns one over: two sets differ in as many shingles as their bits do, at least.
    """
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    word = lambda w: F.aggregate(F.filter("items", lambda h: F.pmod(F.call_function("shiftright", h, F.lit(6)), F.lit(PARITY)) == w), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))
    bits = [f"bits{w}" for w in range(PARITY)]
    # What goes through the exchanges is narrow: a set's number (half of its name), its size, a shingle and its place.
    items = rows.select(F.col("fp.f0").alias("id"), "n", F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one set alone come first and meet nothing: their number tells the places of the others.
    shared = items.join(common, "item").withColumn("i", F.row_number().over(W.partitionBy("id").orderBy("df", "item")))
    first = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("id"))
    placed = shared.withColumn("at", (F.col("i") + first).cast("int"))
    upto = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    told = rows.select(F.col("fp.f0").alias("id"), F.col("lab.f0").alias("lab"), *(word(w).alias(b) for w, b in enumerate(bits)))
    long = table(placed.where(F.col("at") <= upto(similarity)).select("id", "n", "item", "at").join(told, "id"))
    short = long.where(F.col("at") <= upto(2 * similarity / (1 + similarity))).select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("lab").alias("label"), "item", F.col("at").alias("place"), *(F.col(b).alias(f"x{b}") for b in bits))
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) + F.least("at", "place") >= (F.col("n") + F.col("m")) * F.lit(similarity / (1 + similarity)) - 1e-9
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x{b}"))) for b in bits), F.lit(0))
    near = apart <= (F.col("n") + F.col("m")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
    fits = (F.col("m") >= F.col("n") * similarity - 1e-9) & (F.struct("m", "other") < F.struct("n", "id")) & (F.col("lab") != F.col("label")) & enough & near
    pairs = long.join(short, "item").where(fits).select("id", "other").distinct()
    names = rows.select(F.col("fp.f0").alias("id"), "fp")
    return pairs.join(names.withColumnRenamed("fp", "a"), "id").join(names.select(F.col("id").alias("other"), F.col("fp").alias("b")), "other").select("a", "b")


def _near(df: DataFrame, similarity: float, width: int) -> DataFrame:
    """doc_id, component_id for each row of df (id, text): components of the links between shingle sets that are alike.

    Sets that the BK-trees over their SimHashes link, or that agree on a band, are candidates. Those of one
    SimHash or of a band's value are first compared with one of them (the largest, or the one that
    meets most others); what is linked with that gets its label, so in a group of n near
    copies about n pairs are compared. Then the sets of values that still have several labels meet anew, by a
    prefix filter. A pair is left out only if its ends are linked already, so no link is lost.
    """
    rows = cut(_sketches(df, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("simhash").alias("simhash"), F.any_value("bands").alias("bands")))
    trees = _tree_stars(distinct)
    at = ["band", "value"]
    members = distinct.select("fp", "n", F.posexplode("bands").alias(*at))
    met = members.groupBy(*at).agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    mates = cut(members.join(met, at))
    weight = mates.groupBy("fp").agg(F.sum("met").alias("weight"))
    pivot = mates.join(weight, "fp").groupBy(*at).agg(F.max(F.struct("weight", "fp", "n")).alias("top")).select(*at, F.col("top.weight").alias("weight"), F.col("top.fp").alias("to"), F.col("top.n").alias("m"))
    sized = lambda x, y: (F.least(x, y) >= F.floor(F.greatest(x, y) * F.lit(similarity)))
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    met_at = mates.join(pivot, at).select("fp", "n", "weight", "to", "m").unionByName(trees.withColumn("weight", F.lit(0).cast("long")))
    stars = met_at.where((F.col("fp") != F.col("to")) & sized(F.col("n"), F.col("m"))).select(*ends(F.col("fp"), F.col("to")), "weight", "to")
    stars = cut(stars.distinct())

    def listed(texts: list[str]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in texts]
        return {"items": [x.view(np.int64) for x in sets]}

    # Only sets that have a candidate are made again from their texts, each by the row of least id.
    named = distinct.join(weight.select("fp").unionByName(trees.select(F.explode(F.array("fp", "to")).alias("fp"))), "fp", "left_semi").select("fp", F.col("least").alias("id"))
    texts = df.join(named, "id").dropDuplicates(["fp"])
    sets = cut(over_texts(texts, "fp", "text", "items array<bigint>", listed).select(F.col("doc_id").alias("fp"), "items"))
    side = lambda end: sets.select(F.col("fp").alias(end), F.col("items").alias(f"items_{end}"))
    linked = cut(stars.join(side("a"), "a").join(side("b"), "b").where(_alike(similarity)).drop("items_a", "items_b"))
    # A set's label is the greatest that comes to it over a few links: equal labels are one component.
    both_ways = cut(linked.select(F.explode(F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("by")), F.struct(F.col("b").alias("fp"), F.col("a").alias("by")))).alias("x")).select("x.*"))
    labels = linked.select(F.explode(F.array("a", "b")).alias("fp"), F.struct("weight", "to").alias("top")).groupBy("fp").agg(F.max("top").alias("top"))
    for _ in range(STEPS):
        come = both_ways.join(labels.select(F.col("fp").alias("by"), "top"), "by").select("fp", "top")
        labels = cut(labels.unionByName(come).groupBy("fp").agg(F.max("top").alias("top")))
    labels = labels.select("fp", F.col("top.to").alias("lab"))
    mates = mates.join(labels, "fp", "left").withColumn("lab", F.coalesce("lab", "fp"))
    several = mates.groupBy(*at).agg(F.min("lab").alias("x"), F.max("lab").alias("y")).where("x <> y").select(*at)
    apart = cut(mates.join(several, at).select("fp", "n", "lab").distinct())
    met_again = _prefix_pairs(apart.join(sets, "fp"), similarity)
    rest = met_again.join(side("a"), "a").join(side("b"), "b").where(_alike(similarity)).select("a", "b")
    labels = groups_of(linked.select("a", "b").unionByName(rest))
    member = distinct.select("fp", "least").join(labels, "fp", "left").select("fp", "least", F.coalesce("lab", "fp").alias("lab"))
    member = cut(member)
    least = member.groupBy("lab").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp").join(member.join(least, "lab").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def keep_one(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each component the one with the least id stays (null ids last).

    Shingles count once, as similarity is that of sets. Every link is checked on the whole shingle sets, so
    none is below the similarity. A pair of similarity 0.8 becomes a candidate with probability recall()
    (0.999997), nearer pairs more surely; equal sets always are one.
    Rows are told apart by id and text, so rows without an id take part, too; of rows that agree in
    both, one stays. Columns and their names stay as they are.

    Defined cases: null and empty texts and those without words have one empty set and are one group; a text
    of fewer words than `width` is one shingle; texts of any length are taken whole; an empty table gives
    an empty result; further columns, whatever their names, pass through.
    """
    whole = lambda: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), whole().alias("h"))
    found = _near(df.select(key.alias("id"), F.col(text_col).alias("text")), similarity, width)
    stay = found.where("doc_id = component_id").groupBy("doc_id").count().select(F.col("doc_id.id").alias("_kept_id"), F.col("doc_id.h").alias("_kept_h"), F.col("count").alias("_kept_n"))
    stay = cut(stay)
    at = lambda x: df.join(x, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (whole() == F.col("_kept_h")), "left_semi")
    return at(stay.where("_kept_n = 1")).unionByName(at(stay.where("_kept_n > 1")).dropDuplicates([id_col, text_col]))
