"""Answer quality: per-pair metrics as columns, and their grouped statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evograph.functions.stem import stem
from evograph.functions.text import tokens
from evograph.functions.vector import matrix


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the two sets of tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(x) + F.size(y)))


def aggregate_metrics(rows: DataFrame, metrics: list[str], category: str = "category", leave_out: int = 5) -> DataFrame:
    """metric, category (null: overall, without one category), mean, std (sample, 0 for one value), median, min, max, count."""
    long = rows.unpivot([category], metrics, "metric", "value").where("value IS NOT NULL")
    both = long.select("metric", F.explode(F.array(F.col(category).cast("long"), F.when(F.col(category) != leave_out, F.lit(-1).cast("long")))).alias("g"), "value").where("g IS NOT NULL")
    out = both.groupBy("metric", "g").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.round(F.median("value"), 6).alias("median"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"),
    )
    return out.select("metric", F.when(F.col("g") >= 0, F.col("g")).alias("category"), "mean", "std", "median", "min", "max", "count")


def judge_runs(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation over runs of each run's mean score, by category. rows: run, category, score (null: skipped)."""
    per_run = rows.where("score IS NOT NULL").groupBy("run", "category").agg(F.avg("score").alias("m"))
    return per_run.groupBy("category").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("runs"))


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            up, row[j + 1], left = row[j + 1], (left + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
            left = up
    return row[-1]


#: The weights of orders 1 to 4 in BLEU-1 to 4, and what an order without a hit counts as.
BLEU_WEIGHTS = [(1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.33, 0.33, 0.33, 0), (0.25, 0.25, 0.25, 0.25)]
NO_HIT = 0.1
#: Fixed values of METEOR: the weight of precision against recall, and the penalty's exponent and factor.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


#: Words that are two tokens, by where they are cut.
JOINED = ["can|not", "gim|me", "gon|na", "got|ta", "lem|me", "wan|na"]
_TOKENS = re.compile(
    "|".join(
        [r"n't\b", r"'(?:s|re|ve|ll|d|m)\b"]  # ends of contractions
        + [rf"\b{a}(?={b}\b)" for a, b in (x.split("|") for x in JOINED)]
        + [r"\.{3}", "--", r"\d+(?:[.,:]\d+)+", r"\w+?(?=n't\b)", r"\w+(?:(?:[./]|-(?!-))\w+)*", r"[^\w\s]"]  # runs of marks, numbers, words, single marks
    )
)


def bleu_tokens(text: str) -> list[str]:
    """Lower-case words (with inner marks), numbers, ends of contractions, runs of dots and dashes, and single marks."""
    return _TOKENS.findall(text.lower())


def rouge_tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case; words of more than three letters as stems."""
    return [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", text.lower())]


def _bleu(a: list[str], b: list[str]) -> list[float]:
    shares = []
    for n in range(1, 5):
        x = _grams(a, n)
        hits, total = sum((x & _grams(b, n)).values()), max(1, sum(x.values()))
        shares.append((hits or NO_HIT) / total)
    if not a or not set(a) & set(b):
        return [0.0] * 4
    brevity = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))
    return [brevity * math.exp(sum(w * math.log(p) for w, p in zip(ws, shares, strict=True) if w)) for ws in BLEU_WEIGHTS]


def _f1(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if hits else 0.0


def meteor(prediction: str, reference: str) -> float:
    """METEOR over exact words, then stems (synonyms need a word net): each word meets the last free equal one, and runs of neighbours are chunks."""
    a, b = prediction.lower().split(), reference.lower().split()
    met: dict[int, int] = {}
    for form in (lambda w: w, stem):
        free = {}
        for j, w in enumerate(b):
            if j not in met.values():
                free.setdefault(form(w), []).append(j)
        for i in reversed(range(len(a))):
            if i not in met and free.get(form(a[i])):
                met[i] = free[form(a[i])].pop()
    if not met:
        return 0.0
    p, r = len(met) / len(a), len(met) / len(b)
    chunks = sum(met.get(i - 1) != j - 1 for i, j in met.items())
    return p * r / (ALPHA * p + (1 - ALPHA) * r) * (1 - GAMMA * (chunks / len(met)) ** BETA)


def text_scores(prediction: str, reference: str) -> dict[str, float]:
    """BLEU-1 to 4, the F1 of ROUGE-1, 2 and L, and METEOR; all 0 if a text is empty or null."""
    if not (prediction or "").strip() or not (reference or "").strip():
        return dict.fromkeys(NAMES, 0.0)
    out = dict(zip(NAMES, _bleu(bleu_tokens(prediction), bleu_tokens(reference)), strict=False))
    a, b = rouge_tokens(prediction), rouge_tokens(reference)
    for n in (1, 2):
        x, y = _grams(a, n), _grams(b, n)
        out[f"rouge{n}"] = _f1(sum((x & y).values()), sum(x.values()), sum(y.values()))
    out["rougeL"] = _f1(_lcs(a, b), len(a), len(b))
    out["meteor"] = meteor(prediction, reference)
    return out


def token_weights(texts: DataFrame, tokens: str) -> DataFrame:
    """token, idf: log((texts + 1) / (texts that have it + 1)), over a column of token arrays."""
    n = texts.count()
    has = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return has.select("token", F.log(F.lit(n + 1) / (F.col("df") + 1)).alias("idf"))


#: Tokens of a block of pairs, about; cosines that are held at a time.
TOKENS, HELD = 1 << 17, 1 << 22


def _aligned(u: np.ndarray, none: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Precision and recall of two texts (places of their tokens): the weighted means of each token's best cosine with the other side."""
    if not len(x) or not len(y):
        return 0.0, 0.0
    (x, n), (y, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    a, b = np.zeros(len(x)), np.zeros(len(y))
    known, other = np.flatnonzero(~none[x]), np.flatnonzero(~none[y])
    if len(known) and len(other):
        best = np.full(len(other), -np.inf)
        for i in range(0, len(known), step := max(1, HELD // len(other))):
            sims = u[x[known[i : i + step]]] @ u[y[other]].T
            a[known[i : i + step]] = sims.max(1)
            best = np.maximum(best, sims.max(0))
        b[other] = best
    share = lambda near, weight: float(near @ weight / weight.sum()) if weight.sum() else 0.0
    return share(a, n * w[x]), share(b, m * w[y])


def aligned_similarity(pairs: DataFrame, vectors: DataFrame, weights: DataFrame | None = None, key: tuple[str, ...] = ("pair",)) -> DataFrame:
    """key, precision, recall, f1: each token of a side is aligned with the most similar one of the other side, and cosines are averaged, by idf.

    pairs: key, prediction, reference (arrays of tokens); vectors: token, v, norm, of any encoder that gives tokens vectors; weights: token, idf
    (1 for all without them, 0 for a token that they lack). Tokens without a vector align with nothing and count as 0; so does an empty side.

    Pairs go into blocks of about TOKENS tokens; a block gets the vector of each of its tokens once, not one for each place, and a pair is a product of two matrices.
    """
    text = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    texts = pairs.select(*key, text("prediction"), text("reference"))
    total = texts.agg(F.sum(F.size("prediction") + F.size("reference"))).first()[0] or 0
    left = texts.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(-(-total // TOKENS) or 1)))
    words = left.select(F.col("_block").alias("_of"), F.explode(F.concat("prediction", "reference")).alias("token")).distinct()
    words = words.join(vectors.select("token", "v", "norm").hint("merge"), "token", "left")
    words = words.withColumn("w", F.lit(1.0)) if weights is None else words.join(weights.select("token", "idf").hint("merge"), "token", "left").withColumn("w", F.coalesce("idf", F.lit(0.0))).drop("idf")
    schema = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in key)

    def meet(texts: pa.Table, words: pa.Table) -> pa.Table:
        d = (pc.max(pc.list_value_length(words["v"])).as_py() if words.num_rows else None) or 1
        v, none = matrix(words["v"], d)
        u = v / np.where(none, 1.0, pc.fill_null(words["norm"], 1.0).to_numpy())[:, None]
        w, places = words["w"].to_numpy(), []
        for name in ("prediction", "reference"):
            lists = texts[name].combine_chunks()
            at = pc.index_in(lists.flatten(), words["token"]).to_numpy(zero_copy_only=False)
            places.append((at, np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]))
        (a, i), (b, j) = places
        out = [_aligned(u, none, w, a[i[n] : i[n + 1]], b[j[n] : j[n + 1]]) for n in range(texts.num_rows)]
        return pa.table({**{k: texts[k] for k in key}, "precision": pa.array([x for x, _ in out], pa.float64()), "recall": pa.array([x for _, x in out], pa.float64())})

    met = left.groupBy("_block").cogroup(words.groupBy("_of")).applyInArrow(meet, f"{schema}, precision double, recall double")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return met.select(*key, "precision", "recall", f1.alias("f1"))


NAMES = ["bleu1", "bleu2", "bleu3", "bleu4", "rouge1", "rouge2", "rougeL", "meteor"]


@F.pandas_udf(StructType([StructField(x, DoubleType()) for x in NAMES]))
def text_metrics(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_scores(p, r) for p, r in zip(prediction, reference, strict=True)], columns=NAMES, dtype=float)
