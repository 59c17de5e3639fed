"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by the array scan of `pretoken` (no regular expressions). The slices feed
pair merging behind a cache per worker, whose lookups are array operations too; from then on a text is an
array of cache slots, and its ids come from a gather over the cache. The byte offsets of the tokens are kept, so decoding is one gather from
the vocabulary's bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; a text of any length is encoded
whole; equal rows give equal results, a row each; an empty table gives an empty result; only id and text
are read, so other columns don't matter. A pattern other than pretoken.PATTERN is an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evograph.llm import pretoken
from evograph.llm.common import over_texts

#: Distinct pre-tokens that a worker remembers; beyond that it starts anew, which costs time only.
CACHE_ENTRIES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the leftmost adjacent pair of least rank becomes one token.

    A heap of candidate pairs over a linked list, so that a long run takes n log n steps.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, token = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != token:
            continue
        parts[i], parts[j] = token, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(token + parts[k])) is not None:
                heapq.heappush(heap, (r, i, token + parts[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + token)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + token))
    return [ranks[p] for p in parts if p is not None]


def asks_tiktoken(pattern: str):
    """joins(a, c): does the library keep a and c in one pre-token? A probe vocabulary has all pairs that start with a."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for a in b"a1!":
        ranks.update({bytes([a, i]): len(ranks) + i for i in range(256)})
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda a, c: len(probe.encode_ordinary(a + c)) == len(c.encode("utf-8"))


class PairTable:
    """Ranks of pairs of ids: for each token, every cut of it in two tokens."""

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        codes, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    codes.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.made = np.array(codes, np.int64)[order], np.array(made, np.int64)[order]
        self.byte = np.fromiter((ranks[bytes([i])] for i in range(256)), np.int64, 256)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], self.NONE)


#: Pre-tokens of more bytes are merged one by one with a heap.
SIDE_BY_SIDE = 64


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """merge() of many pre-tokens side by side: (all ids, ids of each). A round merges the leftmost least pair of every unfinished one."""
    whole = np.fromiter((ranks.get(p, -1) if len(p) <= SIDE_BY_SIDE else -2 for p in pieces), np.int64, len(pieces))
    done_owner, done_ids = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
    for i in np.flatnonzero(whole == -2).tolist():
        done_ids.append(np.array(merge(pieces[i], ranks), np.int64))
        done_owner.append(np.full(len(done_ids[-1]), i))
    name = np.flatnonzero(whole == -1)
    short = [pieces[i] for i in name.tolist()]
    size = np.fromiter(map(len, short), np.int64, len(short))
    ids = pairs.byte[np.frombuffer(b"".join(short), np.uint8)]
    rank = np.full(len(ids), PairTable.NONE)
    if len(ids):
        rank[:-1] = pairs(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = PairTable.NONE
    while len(size):
        least = np.minimum.reduceat(rank, np.cumsum(size) - size)
        done = least == PairTable.NONE
        if done.any():
            keep = np.repeat(~done, size)
            done_owner.append(np.repeat(name[done], size[done]))
            done_ids.append(ids[~keep])
            ids, rank = ids[keep], rank[keep]
            name, size, least = name[~done], size[~done], least[~done]
            if not len(size):
                break
        owner = np.repeat(np.arange(len(size)), size)
        hit = np.flatnonzero(rank == least[owner])
        at = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]  # the leftmost of each pre-token
        ids[at] = least
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))
        ids, rank, size = ids[keep], rank[keep], size - 1
        start = np.cumsum(size) - size
        rank[at] = PairTable.NONE
        inner = at[at < start + size - 1]
        rank[inner] = pairs(ids[inner], ids[inner + 1])
        inner = at[at > start]
        rank[inner - 1] = pairs(ids[inner - 1], ids[inner])
    owner, flat = np.concatenate(done_owner), np.concatenate(done_ids)
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces)).astype(np.int64)


class Ids:
    """Ids of the pre-tokens that a worker remembers: one flat array, with start and size by slot."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_ENTRIES):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.ids = self.start = self.size = np.zeros(0, np.int64)
        self.slots = pretoken.Memo(limit, self._make)

    def _make(self, pieces: list[bytes], anew: bool) -> np.ndarray:
        if anew:
            self.ids = self.start = self.size = np.zeros(0, np.int64)
        ids, size = merge_many(pieces, self.ranks, self.pairs)
        first = len(self.size)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        return np.arange(first, first + len(pieces))


class Codec:
    """Encoder and decoder for one file of ranks; made once in each worker."""

    def __init__(self, rank_path: str, pattern: str):
        if pattern != pretoken.PATTERN:
            raise ValueError(f"the array scan splits by {pretoken.PATTERN!r} alone, not by {pattern!r}")
        self.ranks = read_ranks(rank_path)
        self.kinds = pretoken.Classifier(asks_tiktoken(pattern))
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = Strings(tokens)
        self.decimal = Strings([b"%d " % i for i in range(size)])
        self.cache = Ids(self.ranks)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        raw, bounds, per_text = pretoken.split(texts, self.kinds)
        slot = self.cache.slots(raw, bounds)
        size = self.cache.size[slot]
        ids = self.cache.ids[ragged(self.cache.start[slot], size)]
        return ids, np.diff(np.append(0, np.cumsum(size))[np.append(0, np.cumsum(per_text))])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of the ids, byte offset of each token with the end last)."""
        return self.bytes.joined(ids)


class Strings:
    """Byte strings in one buffer, so that joining many of them is a gather."""

    def __init__(self, strings: list[bytes]):
        self.width = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the strings one after another, offset of each with the end last)."""
        width = self.width[which]
        return self.blob[ragged(self.start[which], width)].tobytes(), np.append(0, np.cumsum(width))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... (size[i] of them) for each i, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_path: str, pattern: str) -> Codec:
    if (rank_path, pattern) not in _CODECS:
        _CODECS[rank_path, pattern] = Codec(rank_path, pattern)
    return _CODECS[rank_path, pattern]


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), offsets (byte offset of each token in the text, then its end)."""

    def make(texts: list[str]) -> dict[str, list]:
        c = codec(rank_path, pattern)
        ids, counts = c.encode(texts)
        cuts = np.append(0, np.cumsum(counts)).tolist()
        width = c.bytes.width[ids]
        return {"ids": [ids[a:b] for a, b in itertools.pairwise(cuts)], "offsets": [np.append(0, np.cumsum(width[a:b])) for a, b in itertools.pairwise(cuts)]}

    return over_texts(df, id_col, text_col, "ids array<int>, offsets array<bigint>", make)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text that the ids of each row stand for (null ids: empty text)."""
    import pyarrow as pa

    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        c = codec(rank_path, pattern)
        for batch in batches:
            texts = [c.decode(np.asarray(x, np.int64))[0].decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to, in one pass."""

    def make(texts: list[str]) -> dict[str, list]:
        c = codec(rank_path, pattern)
        ids, counts = c.encode(texts)
        cuts = np.append(0, np.cumsum(counts))
        decimal, at = c.decimal.joined(ids)
        data, offsets = c.decode(ids)
        listed, view = memoryview(decimal), memoryview(data)
        return {
            "n_tokens": counts,
            "ids_sha256": [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in itertools.pairwise(at[cuts].tolist())],  # without the last space
            "decoded_sha256": [hashlib.sha256(view[a:b]).hexdigest() for a, b in itertools.pairwise(offsets[cuts].tolist())],
        }

    return over_texts(df, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
