"""Best-fit packing with conflicts.

Items (texts by their length) go into bins of a fixed capacity. Two items of one source never share a
bin, nor do two of one duplicate cluster. Bins are kept in order of what is left in them, and each
carries a bitmap of its sources and one of its clusters. An item, longest first, looks for the bin with
the least room that is enough; if that one conflicts, the search goes on to its successors until the
tightest compatible bin is found, and else a new bin is opened.

A text longer than a bin fills bins of its own with its first pieces, and its last piece is an item: no
length is lost. Items are dealt by a hash of the id to shards of about SHARD items; a task streams its
shards in the order of their ids and packs at most 2 * SHARD items at a time, whatever the hot source.

Defined cases: a null or negative length counts as 0 and a text without length is an item as any other;
a null source or cluster never conflicts; rows with a null id are dealt by source, cluster and length;
equal rows are items of their own (of one cluster, hence in different bins, if they have one); an empty
table gives an empty result; only id, length, source and cluster are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 4096
CAPACITY = 2048


class Bins:
    """Open bins in order of room; what an item needs is one binary search and a walk over successors."""

    def __init__(self, capacity: int, n: int, n_sources: int, n_clusters: int):
        self.capacity, self.n = capacity, 0
        self.room = np.empty(n, np.int64)  # ascending
        self.name = np.empty(n, np.int64)
        self.maps = np.zeros((n, 2 + n_sources // 64 + n_clusters // 64), np.uint64)  # by name: sources, then clusters
        self.first_cluster = 1 + n_sources // 64

    def _free(self, names: np.ndarray, source: int, cluster: int) -> np.ndarray:
        out = np.ones(len(names), bool)
        for bit, first in ((source, 0), (cluster, self.first_cluster)):
            if bit >= 0:
                out &= self.maps[names, first + bit // 64] >> np.uint64(bit % 64) & np.uint64(1) == 0
        return out

    def put(self, length: int, source: int, cluster: int) -> int:
        """The bin of an item. source, cluster: a number, -1 for none."""
        at, found, step = int(np.searchsorted(self.room[: self.n], length)), -1, 16
        while at < self.n:  # successors, in blocks
            free = self._free(self.name[at : min(at + step, self.n)], source, cluster)
            if free.any():
                found = at + int(free.argmax())
                break
            at, step = at + step, 4 * step
        if found < 0:
            name, room = self.n, self.capacity
            self.n += 1
            found = self.n - 1
        else:
            name, room = int(self.name[found]), int(self.room[found])
        left = room - length
        to = int(np.searchsorted(self.room[:found], left))  # less room now: it moves to the front
        self.room[to + 1 : found + 1] = self.room[to:found].copy()
        self.name[to + 1 : found + 1] = self.name[to:found].copy()
        self.room[to], self.name[to] = left, name
        for bit, first in ((source, 0), (cluster, self.first_cluster)):
            if bit >= 0:
                self.maps[name, first + bit // 64] |= np.uint64(1 << bit % 64)
        return name


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item (lengths of 0 to capacity; sources and clusters: small numbers, -1 for none)."""
    bins = Bins(capacity, len(lengths), int(sources.max(initial=0)) + 1, int(clusters.max(initial=0)) + 1)
    out = np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        out[i] = bins.put(int(lengths[i]), int(sources[i]), int(clusters[i]))
    return out


def _numbers(values: pa.Array, again: bool = False) -> np.ndarray:
    """Values as small numbers, null as -1; with again, values that occur once are -1, too, as they conflict with none."""
    codes = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    if again and len(codes):
        often = np.bincount(codes + 1)
        new = np.where(often > 1, np.cumsum(often > 1) - 1, -1)
        new[0] = -1
        codes = np.where(codes < 0, -1, (new - (often[0] > 1))[codes + 1])
    return codes


def assign(df: DataFrame, length: str | Column, source: str | Column, cluster: str | Column, capacity: int = CAPACITY, id_col: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """doc_id, piece, bin, piece_length, length, source for each piece of each row of df.

    Pieces of a row are numbered from 0; all but the last have the capacity's length. bin is a text that
    is unique over all shards.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    items = df.select(column(id_col).alias("doc_id"), F.greatest(F.coalesce(column(length).cast("long"), F.lit(0)), F.lit(0)).alias("length"), column(source).cast("string").alias("source"), F.xxhash64(column(cluster)).alias("cluster"), column(cluster).isNull().alias("_none"))
    items = items.select("doc_id", "length", "source", F.when(~F.col("_none"), F.col("cluster")).alias("cluster"))
    shards = max(1, -(-df.count() // shard))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("source", "cluster", "length")).otherwise(F.xxhash64("doc_id"))
    items = items.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))
    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, bin string, piece_length bigint, length bigint, source string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: dict[int, int] = {}
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * shard:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            numbers = rows["shard"].to_numpy()
            ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            start = 0
            for end in ends:  # whole shards; of the last, whole groups, so that no group grows with the input
                while end - start >= 2 * shard or (end < len(numbers) and end > start):
                    stop = min(end, start + 2 * shard)
                    yield packed(rows.slice(start, stop - start), made)
                    start = stop
            held = [b for b in rows.slice(start).to_batches() if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            numbers = rows["shard"].to_numpy()
            for start, end in zip([0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()], [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)], strict=True):
                yield packed(rows.slice(start, end - start), made)

    def packed(rows: pa.Table, made: dict[int, int]) -> pa.RecordBatch:
        number = rows["shard"][0].as_py()
        made[number] = turn = made.get(number, -1) + 1
        length = rows["length"].to_numpy()
        whole = np.maximum(0, (length - 1) // capacity)  # full bins before the last piece
        last = length - whole * capacity
        bins = pack(last, _numbers(rows["source"].combine_chunks()), _numbers(rows["cluster"].combine_chunks(), again=True), capacity)
        row = np.repeat(np.arange(len(length)), whole + 1)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + 1) - whole - 1, whole + 1)
        final = piece == whole[row]
        alone = np.cumsum(~final) - 1
        names = [f"{number}-{turn}-{'' if f else 'w'}{b if f else a}" for f, b, a in zip(final.tolist(), bins[row].tolist(), alone.tolist(), strict=True)]
        of = pa.array(row)
        return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(of), pa.array(piece.astype(np.int32)), pa.array(names, pa.string()), pa.array(np.where(final, last[row], capacity)), pa.array(length[row]), rows["source"].combine_chunks().take(of)], names=["doc_id", "piece", "bin", "piece_length", "length", "source"])

    return items.repartition("shard").sortWithinPartitions("shard", "doc_id", "length", "source", "cluster").mapInArrow(run, schema)


def words_in(text: Column) -> Column:
    """Words of a text, the length that bins are measured in here (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def cluster_of(text: Column) -> Column:
    """Texts that differ in case and white space alone are one duplicate cluster; texts without words are none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """assign() for a table of documents: lengths in words, conflicts of source and of equal texts."""
    return assign(docs, words_in(F.col("text")), "source", cluster_of(F.col("text")), capacity)
