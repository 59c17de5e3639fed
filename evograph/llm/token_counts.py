"""Token counts by a map-side two-tier lookup.

First tier: a compact hash table of the lengths (in tokens) of the corpus's frequent pre-tokens. Each
task sums up the words of all its texts in a Misra-Gries summary of fixed size; only those summaries
meet, and the pre-tokens of the heaviest words become the table, which is broadcast. Second tier: what the
table lacks is encoded by the tokenizer itself and remembered in a cache per worker. Pre-tokens are
never shuffled; the summaries have SUMMARY entries a task at most, the table TABLE entries in all.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole;
equal rows give equal results, a row each; an empty table gives an empty result; only id and text are
read, so other columns don't matter. The special strings of the tokenizer count as one token each,
as its library does it by default. A tokenizer with a normalizer, a prefix space or added tokens that strip
their surroundings is an error.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evograph.llm import pretoken
from evograph.llm.common import chunks, over_texts

#: Entries of a task's summary of frequent pre-tokens, and of the table made of all summaries.
SUMMARY, TABLE = 2048, 16_384
#: Distinct pre-tokens that a worker remembers besides the table.
CACHE_ENTRIES = 300_000
#: Longest pre-token, in bytes, that the summary may hold: bounds the table's size in bytes.
LONGEST = 48


class Encoder:
    """The tokenizer of a .json file with its pre-tokeniser in array form; made once in each worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = self.tokenizer.pre_tokenizer
        said = json.loads(self.tokenizer.to_str())
        how = said["pre_tokenizer"] or {}
        if (how.get("type"), how.get("add_prefix_space"), how.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"not a byte-level pre-tokenizer without a prefix space: {path}")
        if said["normalizer"] is not None:
            raise ValueError(f"a normalizer would change the texts before they are counted: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError(f"an added token that takes more or less than its own string: {path}")
        self.kinds = pretoken.Classifier(lambda a, c: len(pre.pre_tokenize_str(a + c)) == 1)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(texts cut at special strings, segments of each text, special strings of each text)."""
        if self.special is None or not any(map(self.special.search, texts)):
            return texts, np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
        cut = [self.special.split(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        return list(itertools.chain.from_iterable(cut)), sizes, sizes - 1

    def lengths(self, pieces: list[bytes]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)))


_ENCODERS: dict[str, Encoder] = {}
_CACHES: dict[str, pretoken.Memo] = {}


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def lengths(table: dict[bytes, int], enc: Encoder, limit: int = CACHE_ENTRIES) -> pretoken.Memo:
    """Token lengths of pre-tokens: the broadcast table first, then what this worker has encoded."""

    def make(pieces: list[bytes], anew: bool) -> np.ndarray:
        return np.array([table[p] for p in pieces] if anew and table else enc.lengths(pieces))

    return pretoken.Memo(limit + len(table), make, list(table))


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text") -> dict[bytes, int]:
    """The table: token lengths of the pre-tokens in the most frequent words of all texts, from a summary per task."""
    src = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in chunks(batches):
            for text in part.column(0).to_pylist():
                held.update(text.encode("utf-8").split())
            if len(held) > 32 * SUMMARY:  # Misra-Gries: take the largest count left out from all
                least = sorted(held.values(), reverse=True)[8 * SUMMARY]
                held = Counter({w: n - least for w, n in held.items() if n > least})
        top = [(w, n) for w, n in held.most_common(SUMMARY) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    words = src.mapInArrow(summarise, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE // 2)
    enc = encoder(path)
    texts = [x for r in words.collect() for x in (" " + bytes(r.word).decode("utf-8"), bytes(r.word).decode("utf-8"))]
    raw, bounds, _ = pretoken.split(texts, enc.kinds)
    pieces = list(dict.fromkeys(raw[a:b] for a, b in itertools.pairwise(bounds.tolist())))[:TABLE]
    return dict(zip(pieces, enc.lengths(pieces), strict=True))


def count_tokens(df: DataFrame, path: str, over: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > over) for each row of df."""
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text_col))

    def make(texts: list[str]) -> dict[str, np.ndarray]:
        enc = encoder(path)
        if (known := _CACHES.get(path)) is None:
            known = _CACHES[path] = lengths(table.value, enc)
        segments, parts, special = enc.segments(texts)
        raw, bounds, per_segment = pretoken.split(segments, enc.kinds)
        sums = np.append(0, np.cumsum(known(raw, bounds)))
        ends = np.append(0, np.cumsum(per_segment))[np.append(0, np.cumsum(parts))]
        n = np.diff(sums[ends]) + special
        return {"n_bytes": np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > over}

    return over_texts(df, id_col, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)
