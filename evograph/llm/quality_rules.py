"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts are counted once per document. From a bounded sample of labelled rows, rules
are learned one after another: a conjunction of thresholds grows by information gain on two thirds of
the rows, is pruned on the other third, and is kept if it is precise there; what it covers is set aside
and the next rule is learned. The list becomes one ordered Spark conditional expression.

Defined cases: a null or empty text has zero counts (and fails the base rule); texts of any length are
counted whole; equal rows give equal results, a row each; with no usable labels the list is empty and
keeps all that passes the base rule; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evograph.llm.common import bounded_ids, over_texts, text_each

#: Labelled rows that the list is learned from, at most.
MAX_FIT_ROWS = 10_000
#: Rules of a list and conditions of a rule, at most; precision that a rule needs on the pruning rows.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION = 12, 3, 0.9

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_digits bigint, n_marks bigint, n_distinct bigint"


def counts(text: str) -> tuple[int, ...]:
    """The numbers of COUNTS for one text."""
    raw = text.encode("utf-8")
    words = raw.split()  # at ASCII white space, as bytes
    lines = Counter(line for line in text.split("\n") if line.strip(_SPACES))
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w, c in Counter(windows).items() if c > 1} if len(set(windows)) < len(windows) else ()
    repeated = covered = 0
    for i, w in enumerate(windows) if often else ():
        if w in often:
            repeated += i + 3 - max(i, covered)
            covered = i + 3
    upper = sum(map(raw.count, _UPPER))
    return (
        n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), repeated,
        sum(lines.values()), upper, sum(map(raw.count, _DIGITS)), raw.count(b"!") + raw.count(b"?"), len(set(words)),
    )


_UPPER = [bytes([c]) for c in range(65, 91)]
_DIGITS = [bytes([c]) for c in range(48, 58)]


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS for each row of df."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return over_texts(df, id_col, text_col, COUNTS, lambda texts: dict(zip(names, np.array([counts(t) for t in texts], np.int64).reshape(-1, len(names)).T, strict=True)))


#: What conditions may test, from the counts. The same expressions serve learning and deciding.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int) -> Rule:
    """Adds the condition of the greatest gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < most and (good := int((~bad[rows]).sum())):
        p = int(bad[rows].sum())
        if not p:
            break
        base, best = np.log2(p / (p + good)), (1e-9, None)
        for name in FEATURES:
            v = x[name][rows]
            order = np.argsort(v, kind="stable")
            value, hits = v[order], np.cumsum(bad[rows][order])
            ends = np.flatnonzero(np.append(value[1:] != value[:-1], True))[:-1]  # cuts between different values
            for at_least in (False, True):
                p1 = hits[-1] - hits[ends] if at_least else hits[ends]
                n1 = (len(v) - 1 - ends) if at_least else ends + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / n1) - base), 0)
                if len(gain) and gain.max() > best[0]:
                    k = ends[int(gain.argmax())]
                    best = (float(gain.max()), Condition(name, at_least, float((value[k] + value[k + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows[best[1].holds({n: x[n][rows] for n in FEATURES})]
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered rules that say what is bad. fold: 0 or 1 for rows to grow on, 2 for rows to prune on.

    max_rules, max_conditions: the list's and a rule's length at most; min_precision: what a rule needs on the pruning rows.
    """
    n, rules, left = len(bad), [], np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = np.flatnonzero(left & (fold < 2)), np.flatnonzero(left & (fold == 2))
        if not bad[grow].any() or not bad[prune].any():
            break
        rule = _grow(x, bad, grow, max_conditions)
        if not rule:
            break

        def worth(r: Rule, prune: np.ndarray = prune) -> tuple[float, int]:
            hit = _covered(r, x, n)[prune]
            p = int(bad[prune][hit].sum())
            return ((p - (hit.sum() - p)) / max(1, hit.sum()), -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        hit = _covered(rule, x, n) & left
        at = hit & (fold == 2)
        if not at.any() or bad[at].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> list[Rule]:
    """Learns from at most max_rows labelled documents (label 0: bad), chosen by a hash of the id."""
    known = bounded_ids(labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")), "_id", max_rows)
    rows = statistics(text_each(df, known, id_col, text_col).select("doc_id", "text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("_fold"), *(F.expr(e).alias(n) for n, e in FEATURES.items()))
    got = rows.toPandas()
    return learn({n: got[n].to_numpy(float) for n in FEATURES}, got["_label"].to_numpy() == 0, got["_fold"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression over COUNTS: false where the first rule that holds says bad, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for each row of df."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(df, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
