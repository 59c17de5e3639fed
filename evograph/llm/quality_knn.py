"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes and the levels of a few shares of it. TF-IDF
weights and a truncated singular value decomposition, fitted on a bounded sample of labelled rows, turn
them into short vectors. The sample's vectors and labels are broadcast; every document is multiplied with
all of them, block by block, and its score is the mean label of its nearest neighbours by cosine,
weighted by similarity. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has the vector of its constant term, and so a score; texts of any
length are scored whole; voters as similar as the last of the nearest (to five digits) vote as well; equal rows give equal results, a row each; without labelled rows every score is
0.5; a null id counts as held out; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evograph.llm.common import bounded_ids, chunks, keep_rows, over_texts, text_each

#: Labelled rows that the space and the voters are taken from, at most; dimensions; voters of a score.
MAX_FIT_ROWS, DIMENSIONS, NEIGHBOURS = 4000, 48, 15
#: Documents multiplied with the voters at a time.
BLOCK = 256


def _classes() -> bytes:
    """Character classes of bytes: each small letter, capitals, digits, white space, single marks, other; non-ASCII by lead."""
    own = {c: i for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz")}
    marks = {c: 30 + i for i, c in enumerate(b".,!?|#*$%&<>")}
    out = []
    for c in range(256):
        if c in own:
            out.append(own[c])
        elif c in marks:
            out.append(marks[c])
        elif 65 <= c <= 90:
            out.append(26)
        elif 48 <= c <= 57:
            out.append(27)
        elif c == 10:
            out.append(29)
        elif c in b" \t\r\x0b\x0c":
            out.append(28)
        elif c < 0x80:
            out.append(42)
        else:
            out.append(43 if c < 0xC0 else 44 if c < 0xE0 else 45)
    return bytes(out)


_CLASS = _classes()
N_CLASSES = 46
N_PAIRS = N_CLASSES * N_CLASSES
#: Upper bounds of the levels of a text's shares (the last level has none): each level is a term of its own.
LEVELS = {
    "equal neighbours of words": (0.02, 0.08, 0.2, 0.5),
    "different words": (0.1, 0.25, 0.45, 0.7),
    "repeated lines": (0.05, 0.2, 0.5, 0.8),
    "marks": (0.002, 0.01, 0.04, 0.12),
    "bars": (0.002, 0.01, 0.04, 0.12),
    "capitals": (0.01, 0.04, 0.15, 0.5),
    "digits": (0.01, 0.04, 0.15, 0.5),
}
N_LEVELS = len(LEVELS) * 5
#: The pairs, the levels, and a constant.
N_TERMS = N_PAIRS + N_LEVELS + 1
_MARKS = [bytes([c]) for c in b"#*$%&<>!"]


def terms(text: str) -> np.ndarray:
    """The term counts of one text."""
    raw = text.encode("utf-8")
    code = np.frombuffer(raw.translate(_CLASS), np.uint8).astype(np.int32)
    out = np.zeros(N_TERMS, np.float32)
    out[-1] = 1
    if len(code) > 1:
        out[:N_PAIRS] = np.bincount(code[:-1] * N_CLASSES + code[1:], minlength=N_PAIRS)
    words = raw.split()
    if words:
        single = np.bincount(code, minlength=N_CLASSES)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n, size = len(words), len(code)
        shares = (
            sum(map(bytes.__eq__, words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines),
            sum(map(raw.count, _MARKS)) / size, raw.count(b"|") / size, single[26] / size, single[27] / size,
        )
        for i, (share, bounds) in enumerate(zip(shares, LEVELS.values(), strict=True)):
            out[N_PAIRS + 5 * i + bisect.bisect(bounds, share)] = 1
    return out


@dataclass
class Space:
    """Term weights, the projection, and the voters: unit vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.basis)

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Similarity-weighted mean labels of the nearest voters, from exact cosine products."""
        if not len(self.voters):
            return np.full(len(counts), 0.5)
        similar = np.round(self.vectors(counts) @ self.voters.T, 5)
        k = min(neighbours, len(self.voters))
        near = similar >= np.partition(similar, -k, axis=1)[:, -k, None]
        weight = np.where(near, np.maximum(similar, 1e-6), 0).astype(np.float64) ** 4
        return np.round(np.clip(weight @ self.labels / weight.sum(1), 0, 1), 6)  # equal texts get equal scores, whatever block they are in


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights; pairs and levels are brought to one length each, so that neither drowns the other."""
    x = np.log1p(counts) * idf
    return np.hstack([_unit(x[:, :N_PAIRS]), _unit(x[:, N_PAIRS:])])


def build(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    """The latent space of a sample: idf, then the leading right singular vectors of its weighted terms."""
    n = len(counts)
    if not n:
        return Space(np.zeros(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _weighted(counts, idf)
    rng = np.random.default_rng(7)
    q = rng.standard_normal((N_TERMS, min(dimensions + 16, n))).astype(np.float32)
    for _ in range(6):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :dimensions].astype(np.float32)
    return Space(idf, basis, _unit(x @ basis), labels.astype(np.float64))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is the row in the fold that is never learned from? By the CRC-32 of the id as text; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Space:
    """The space of a table's labels, from at most max_rows labelled rows that aren't held out, chosen by a hash of the id."""
    usable = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = bounded_ids(usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label")), "_id", max_rows)
    src = text_each(df, known, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sparse = [terms(t) for t in part.column(2).to_pylist()]
            at = [np.flatnonzero(x) for x in sparse]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.string()), part.column(1).cast(pa.int32()), pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())), pa.array([x[a] for x, a in zip(sparse, at, strict=True)], pa.list_(pa.float32()))],
                names=["doc_id", "label", "at", "n"],
            )

    # Sorted by id and terms, so that the sample's order doesn't hang on that of the tasks; columns, not a Python object a number.
    rows = src.mapInArrow(counted, "doc_id string, label int, at array<short>, n array<float>").orderBy("doc_id", "at", "n").limit(max_rows).toArrow().combine_chunks()
    counts = np.zeros((rows.num_rows, N_TERMS), np.float32)
    if rows.num_rows:
        at, n = rows["at"].combine_chunks(), rows["n"].combine_chunks()
        owner = np.repeat(np.arange(rows.num_rows), np.diff(at.offsets.to_numpy()))
        counts[owner, at.flatten().to_numpy()] = n.flatten().to_numpy()
    return build(counts, rows["label"].to_numpy().astype(float))


def score(df: DataFrame, space: Space, threshold: float = 0.3, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0) for each row of df."""
    sent = df.sparkSession.sparkContext.broadcast(space)

    def make(texts: list[str]) -> dict[str, np.ndarray]:
        s = _blocks(sent.value, texts, neighbours)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return over_texts(df, id_col, text_col, "score double, predicted int", make).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _blocks(space: Space, texts: list[str], neighbours: int) -> np.ndarray:
    parts = [space.scores(np.array([terms(t) for t in texts[i : i + BLOCK]]), neighbours) for i in range(0, len(texts), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(df: DataFrame, space: Space, threshold: float = 0.3, neighbours: int = NEIGHBOURS, text_col: str = "text") -> DataFrame:
    """The rows of df with a score of at least the threshold, with all their columns and without a shuffle.

    Null, empty and very long texts are scored as by score(); equal rows stay or go together, each a row; an
    empty table gives an empty result; only the text is read, so other columns' names don't matter.
    """
    sent = df.sparkSession.sparkContext.broadcast(space)
    return keep_rows(df, text_col, lambda texts: _blocks(sent.value, texts, neighbours) >= threshold)
