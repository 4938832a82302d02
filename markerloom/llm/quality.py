"""Quality rules learned from labelled documents (operator 9).

Statistics of a text are counts; rules are conjunctions of thresholds on their
ratios, found by sequential covering: a rule is grown condition by condition on
one part of the sample, pruned on the other, and what it covers is set aside.
The list becomes one ordered conditional expression of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import fresh_name

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Most labelled rows that rules are learned from.
SAMPLE_ROWS = 20_000
#: Most conditions of a rule, most rules, and thresholds tried for a ratio.
MOST_CONDITIONS, MOST_RULES, THRESHOLDS = 4, 12, 48
#: A rule must be right this often on the pruning part, and cover so many rejected rows there.
LEAST_PRECISION, LEAST_COVER = 0.9, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_digits", "n_distinct")
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
_DIGITS = dict.fromkeys(map(ord, "0123456789"))


def counts(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``COUNTS``. Words are runs without ASCII white space."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    distinct: dict[bytes, int] = {}
    numbers = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), dtype=np.int64, count=len(words))
    joined = b"".join(words)
    return (
        len(words),
        len(joined) - int(np.count_nonzero((np.frombuffer(joined, dtype=np.uint8) & 0xC0) == 0x80)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(numbers),
        len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines),
        sum(map(str.isupper, text)) if not text.islower() else 0,
        len(text) - len(text.translate(_DIGITS)),
        len(distinct),
    )


def _repeated(numbers: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    size = int(numbers.max()) + 1
    _, pair = np.unique(numbers[:-1] * size + numbers[1:], return_inverse=True)
    _, which, often = np.unique(pair[:n] * size + numbers[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(often[which] > 1)
    covered = np.zeros(len(numbers), dtype=bool)
    for step in range(WINDOW):
        covered[again + step] = True
    return int(covered.sum())


def count_column(text: Column) -> Column:
    """The statistics of a text column, as a struct."""

    @F.pandas_udf(COUNTS_SCHEMA)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def ratios(stats) -> dict:
    """Ratios that rules speak of; ``stats[c]`` may be a column or an array. No words or lines count as one."""
    at_least_one = (lambda x: F.greatest(x, F.lit(1))) if isinstance(stats["n_words"], Column) else (lambda x: np.maximum(x, 1))
    words, lines, chars = (at_least_one(stats[c]) for c in ("n_words", "n_lines", "word_chars"))
    return {
        "words": stats["n_words"] / 1,
        "mean_word": stats["word_chars"] / words,
        "symbols": stats["n_symbols"] / words,
        "same_lines": stats["n_dup_lines"] / lines,
        "repeated": stats["n_repeat_words"] / words,
        "ended_lines": stats["n_ended_lines"] / lines,
        "upper": stats["n_upper"] / chars,
        "digits": stats["n_digits"] / chars,
        "distinct": stats["n_distinct"] / words,
    }


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def holds(self, values: dict):
        return values[self.ratio] >= self.threshold if self.above else values[self.ratio] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions together reject a document."""

    conditions: tuple[Condition, ...]

    def holds(self, values: dict):
        out = self.conditions[0].holds(values)
        for c in self.conditions[1:]:
            out = out & c.holds(values)
        return out


def _candidates(values: dict[str, np.ndarray]) -> list[Condition]:
    out = []
    for name, column in values.items():
        for cut in np.unique(np.quantile(column, np.linspace(0, 1, THRESHOLDS), method="nearest")).tolist():
            out += [Condition(name, True, cut), Condition(name, False, cut)]
    return out


def _grown(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule | None:
    """Adds the condition with the largest information gain until only rejected rows are covered."""
    covered, conditions = np.ones(len(bad), dtype=bool), []
    while len(conditions) < MOST_CONDITIONS and (covered & ~bad).any():
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, gain = None, 1e-9
        for c in _candidates({k: v[covered] for k, v in values.items()}):
            own = covered & c.holds(values)
            q, m = int((own & bad).sum()), int((own & ~bad).sum())
            if q and (found := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                best, gain = c, found
        if best is None:
            break
        conditions.append(best)
        covered &= best.holds(values)
    return Rule(tuple(conditions)) if conditions else None


def _pruned(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is worth most on rows it was not grown on; its precision and cover there."""
    best, worth = (rule, 0.0, 0), -2.0
    for size in range(len(rule.conditions), 0, -1):
        shorter = Rule(rule.conditions[:size])
        own = shorter.holds(values)
        p, n = int((own & bad).sum()), int((own & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            best, worth = (shorter, p / (p + n), p), (p - n) / (p + n)
    return best


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """The decision list. ``part`` is 0 or 1 for rows to grow on, 2 for rows to prune on."""
    values, open_rows, rules = ratios(stats), np.ones(len(bad), dtype=bool), []
    while len(rules) < MOST_RULES:
        grow, prune = open_rows & (part < 2), open_rows & (part == 2)
        if not (grow & bad).any() or not (prune & bad).any():
            break
        rule = _grown({k: v[grow] for k, v in values.items()}, bad[grow])
        if rule is None:
            break
        rule, precision, cover = _pruned(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        if precision < LEAST_PRECISION or cover < LEAST_COVER:
            break
        rules.append(rule)
        open_rows &= ~rule.holds(values)
    return rules


def labelled(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """Statistics and ``quality`` of at most ``rows`` labelled documents, those with the least hash of their id.

    The bound holds for the labels that are sent to all tasks and for what
    reaches the driver. Labels without id or quality are left out.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", count_column(F.col("text")).alias("s"))
    flat = joined.select("doc_id", "quality", "s.*")
    return flat.orderBy(F.xxhash64("doc_id"), *flat.columns).limit(rows).toPandas()


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from labelled documents; none if there are no labels or no rejected ones."""
    sample = labelled(documents, labels, rows)
    if sample.empty:
        return []
    stats = {c: sample[c].to_numpy(dtype=np.int64) for c in COUNTS}
    part = np.arange(len(sample)) % 3
    return learn(stats, (sample["quality"] == 0).to_numpy(), part)


def base_failed(stats: Column) -> Column:
    few = stats["n_words"] < LEAST_WORDS
    return few | (100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"])


def verdict(rules: list[Rule], stats: Column) -> Column:
    """Ordered conditions: base rules, then the learned list; true keeps the document."""
    values, out = ratios(stats), F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.holds(values), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(documents: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, all counts, ``base_failed, kept`` of every row.

    Null and empty texts have no words and fail the base rules; null keys and
    repeated rows stay; texts of any length are read whole; no documents give no rows.
    """
    counted = documents.select(F.col(key).cast("long").alias("doc_id"), count_column(F.col(f"`{text}`")).alias("stats"))
    stats = F.col("stats")
    return counted.select("doc_id", "stats.*", base_failed(stats).alias("base_failed"), verdict(rules, stats).alias("kept"))


def keep_good(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``documents`` without rejected rows; all columns are kept."""
    stats = fresh_name(documents, "quality_counts")
    marked = documents.withColumn(stats, count_column(F.col(f"`{text}`")))
    return marked.filter(verdict(rules, F.col(stats))).drop(stats)
