"""Toxicity by a classifier chain.

Categories are predicted one after another; each model is a logistic regression over the words of a text
and their beginnings, and over the probabilities of all earlier categories. In training, those come from out-of-fold
predictions, so later models see earlier ones as wrong as they will be. The last link is the label itself.

A category's training label is a column of the labels table, where such columns are named. The table at hand
says no more than toxic or not; there the categories are groups of toxic rows that are found in the sample:
the rows' words that go with the label are clustered (spherical k-means from far-apart rows), and each group
is a category. No word is given by hand.

Models are fitted on a bounded sample of labelled rows; word counts for them are made by Spark, and only
max_features words and the rows' positions among them reach the driver. Every document is then scored on its
whole text.

Defined cases: a null or empty text has the scores of a text without words; texts of any length are
scored whole; equal rows give equal results, a row each; without labels of both kinds every score is next
to 1 if all labels are positive, else next to 0; an empty table gives an empty result; only id and text are
read, so other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evograph.llm.common import bounded_ids, chunks, cut, keep_rows, over_texts, text_each

#: Labelled rows to fit on, at most; words that the models see, at most; folds of the out-of-fold predictions.
MAX_FIT_ROWS, FEATURES, FOLDS = 6000, 192, 5
#: Least documents of the sample that a word must be in; groups of toxic rows where no category columns are named.
MIN_DOCUMENTS, GROUPS = 5, 3
LAST = "toxic"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = range(4, 9)


def words(text: str) -> set[bytes]:
    """The different words of a text: runs of letters, A-Z lower-cased."""
    return set(text.encode("utf-8").translate(_LETTERS).split())


def features(found: set[bytes]) -> set[bytes]:
    """Words, and the beginnings of longer ones, marked by a hyphen."""
    return found.union(*({w[:n] + b"-" for w in found if len(w) > n} for n in BEGINNINGS))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 25) -> np.ndarray:
    """Weights (the bias last) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """Words by position, categories in order, each one's weights (words, earlier categories, bias), and from where on a text is toxic."""

    words: dict[bytes, int]
    categories: list[str]
    weights: list[np.ndarray]
    threshold: float = 0.5
    _by_length: dict[int, dict[bytes, int]] | None = None

    def present(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        for i, t in enumerate(texts):
            found = words(t)
            x[i, [self.words[w] for w in found & self.words.keys()]] = 1
            for n, begin in self.beginnings().items():
                x[i, [begin[w] for w in begin.keys() & {w[:n] for w in found if len(w) > n}]] = 1
        return x

    def beginnings(self) -> dict[int, dict[bytes, int]]:
        """The features that are beginnings, by length."""
        if self._by_length is None:
            self._by_length = {n: {w[:-1]: i for w, i in self.words.items() if w.endswith(b"-") and len(w) == n + 1} for n in BEGINNINGS}
            self._by_length = {n: x for n, x in self._by_length.items() if x}
        return self._by_length

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        for w in self.weights:
            x = np.hstack([x, probability(x, w)[:, None]])
        return x[:, len(self.words) :]


def grouped(x: np.ndarray, groups: int) -> np.ndarray:
    """A group's number for each row of x (presence of words), by spherical k-means; the same for the same rows. Groups are numbered by size."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [unit[int(x.sum(1).argmax())]]
    while len(centres) < groups:  # the row that is farthest from all centres so far
        centres.append(unit[int((unit @ np.array(centres).T).max(1).argmin())])
    of = np.zeros(len(x), int)
    for _ in range(20):
        of = (unit @ np.array(centres).T).argmax(1)
        means = [unit[of == g].mean(0) if (of == g).any() else centres[g] for g in range(groups)]
        centres = [m / max(np.linalg.norm(m), 1e-12) for m in means]
    rank = np.empty(groups, int)
    rank[np.argsort(-np.bincount(of, minlength=groups), kind="stable")] = np.arange(groups)
    return rank[of]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, vocabulary: dict[bytes, int], categories: list[str]) -> Chain:
    """x: presence of words; y: a column of labels for each category; fold: a number for each row."""
    weights, seen = [], x
    for k in range(len(categories)):
        weights.append(logistic(seen, y[:, k]))
        held = np.empty(len(x))
        for f in np.unique(fold):
            out = fold == f
            rest = ~out if (~out).any() else out
            held[out] = probability(seen[out], logistic(seen[rest], y[rest, k]))
        seen = np.hstack([seen, held[:, None]])
    return Chain(vocabulary, categories, weights, best_threshold(seen[:, -1], y[:, -1] > 0))


def best_threshold(p: np.ndarray, label: np.ndarray) -> float:
    """Where out-of-fold predictions part the labels best (by F1), in the middle of the gap there."""
    order = np.argsort(-p, kind="stable")
    hits, ranked = np.cumsum(label[order]), p[order]
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + label.sum())
    f1[np.append(ranked[1:] == ranked[:-1], False)] = 0
    k = int(f1.argmax())
    return float(np.clip((ranked[k] + (ranked[k + 1] if k + 1 < len(p) else 0)) / 2, 0.1, 0.9))


def fit(
    df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, ...] = (),
    max_rows: int = MAX_FIT_ROWS, max_features: int = FEATURES, min_documents: int = MIN_DOCUMENTS, groups: int = GROUPS,
) -> Chain:
    """The chain of a table's labels, from at most max_rows labelled documents chosen by a hash of the id.

    category_cols: columns of labels (0, 1; null is 0) in the order of the chain; none: `groups` groups are found.
    Words must be in min_documents documents of the sample; the max_features most associated with the label are used.
    """
    categories = [*(category_cols or (f"group{i + 1}" for i in range(groups))), LAST]
    flags = F.array(*(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in category_cols)) if category_cols else F.array().cast("array<int>")
    known = bounded_ids(labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"), flags.alias("_flags")), "_id", max_rows)
    src = text_each(df, known, id_col, text_col)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = [features(words(t)) for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), *part.columns[1:3], pa.array([sorted(w) for w in found], pa.list_(pa.binary()))], names=["doc_id", "label", "flags", "words"])

    # The sample has max_rows rows at most, so what follows doesn't grow with the corpus.
    sample = cut(src.mapInArrow(listed, "doc_id string, label int, flags array<int>, words array<binary>"))
    hits = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per_word = sample.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), hits(F.col("label") > 0).alias("p")).where(F.col("n") >= min_documents)
    total = sample.agg(F.count(F.lit(1)).alias("n"), hits(F.col("label") > 0).alias("p")).first()
    n, p = total.n or 0, total.p or 0
    if not 0 < p < n:
        return Chain({}, categories, [np.concatenate([np.zeros(k), [-30.0 if not p else 30.0]]) for k in range(len(categories))])
    # Association of word and label (chi squared), in the numbers of the fourfold table.
    a, b = F.col("p"), F.col("n") - F.col("p")
    c, d = F.lit(p) - a, F.lit(n - p) - b
    odds = (a * d - b * c).cast("double")
    score = F.coalesce(n * odds * odds / F.nullif((a + b) * (c + d) * F.lit(float(p)) * F.lit(float(n - p)), F.lit(0.0)), F.lit(0.0))  # a word that all have says nothing
    best = per_word.select("word", score.alias("s"), (odds > 0).alias("up")).orderBy(F.desc("s"), "word").limit(max_features).collect()
    chosen = [bytes(r.word) for r in best]
    vocabulary = {w: i for i, w in enumerate(chosen)}

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[vocabulary[w] for w in ws if w in vocabulary] for ws in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "label", "flags", "at"])

    rows = sorted(sample.mapInArrow(positions, "doc_id string, label int, flags array<int>, at array<int>").collect())
    x = np.zeros((len(rows), len(chosen)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    label = np.array([r.label > 0 for r in rows], float)
    if category_cols:
        parts = [np.array([r.flags[k] for r in rows], float) for k in range(len(category_cols))]
    else:
        of = np.full(len(rows), -1)
        of[label > 0] = grouped(x[label > 0][:, [r.up for r in best]], groups)
        parts = [(of == g).astype(float) for g in range(groups)]
    y = np.column_stack([*parts, label])
    fold = np.array([zlib.crc32(r.doc_id.encode()) % FOLDS for r in rows])
    return fit_chain(x, y, fold, vocabulary, categories)


def score(df: DataFrame, chain: Chain, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and toxic (the last one's is at least the threshold, by default the chain's)."""
    threshold = chain.threshold if threshold is None else threshold
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def make(texts: list[str]) -> dict[str, np.ndarray]:
        c = sent.value
        p = c.predict(c.present(texts))
        return {f"p_{name}": p[:, k] for k, name in enumerate(c.categories)} | {"toxic": p[:, -1] >= threshold}

    return over_texts(df, id_col, text_col, ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean", make)


def keep_clean(df: DataFrame, chain: Chain, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of df that the chain doesn't call toxic, with all their columns and without a shuffle.

    Null, empty and very long texts are scored as by score(); equal rows stay or go together, each a row; an
    empty table gives an empty result; only the text is read, so other columns' names don't matter.
    """
    threshold = chain.threshold if threshold is None else threshold
    sent = df.sparkSession.sparkContext.broadcast(chain)
    return keep_rows(df, text_col, lambda texts: sent.value.predict(sent.value.present(texts))[:, -1] < threshold)
