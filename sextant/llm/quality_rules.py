"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Each rule is a conjunction of thresholds that rejects documents. A rule is grown on two thirds of
the labelled rows by information gain, pruned on the other third, kept if it is precise enough
there, and the rows that it covers are taken out before the next rule is grown. The list is emitted
as one ordered Spark conditional expression over statistic columns, so that applying it is a
projection and everyone can read it (``DecisionList.describe``).

Fitting uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of their id; statistics and
verdicts cover every row and the whole text. Both passes stream; nothing is shuffled.

Defined results: a null text counts as empty and fails the base rule. Repeated rows keep their
rows. A document without a label is judged like any other. Without both labels among the labelled
rows the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import quoted
from sextant.llm.textstats import FIELDS, with_stats
from sextant.operators.sampling import bounded_sample

FIT_ROWS = 20_000
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Thresholds tried for each statistic: quantiles of its values among the rows still uncovered.
THRESHOLDS = 64
LEAST_PRECISION = 0.9
LEAST_COVERED = 3
MOST_CONDITIONS = 4


def _ratio(over: str, under: str, times: float = 1.0) -> Column:
    return F.col(over) * F.lit(float(times)) / F.greatest(F.col(under), F.lit(1))


def ratios() -> dict[str, Column]:
    """Statistics that rules may test, from the columns of ``with_stats``."""
    return {
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "chars_per_word": _ratio("word_chars", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_word_share": _ratio("n_repeat_words", "n_words"),
        "distinct_word_share": _ratio("n_distinct_words", "n_words"),
        "top_word_share": _ratio("n_top_word", "n_words"),
        "upper_share": F.col("n_upper") * F.lit(1.0) / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digit_share": _ratio("n_digits", "n_bytes"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, values: Mapping[str, np.ndarray]) -> np.ndarray:
        return values[self.name] > self.threshold if self.above else values[self.name] <= self.threshold

    def column(self, columns: Mapping[str, Column]) -> Column:
        return columns[self.name] > F.lit(self.threshold) if self.above else columns[self.name] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Sequence[Condition], values: Mapping[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    held = rows.copy()
    for condition in rule:
        held &= condition.holds(values)
    return held


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, and what none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejects(self, columns: Mapping[str, Column]) -> Column:
        """One CASE expression: true where a rule rejects the row."""
        found = F.lit(False)
        chain = None
        for rule in self.rules:
            test = rule[0].column(columns)
            for condition in rule[1:]:
                test = test & condition.column(columns)
            chain = F.when(test, F.lit(True)) if chain is None else chain.when(test, F.lit(True))
        return found if chain is None else chain.otherwise(found)

    def describe(self) -> list[str]:
        return [f"reject if {' and '.join(map(str, rule))}" for rule in self.rules]


def _centred(condition: Condition, own: np.ndarray) -> Condition:
    """The same split of these values, its threshold in the middle of the gap that it lies in."""
    under, over = own[own <= condition.threshold], own[own > condition.threshold]
    return Condition(condition.name, condition.above, float((under.max() + over.min()) / 2)) if len(under) and len(over) else condition


def _grow(values: Mapping[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: list[Condition] = []
    covered = rows
    while len(rule) < MOST_CONDITIONS and (covered & ~bad).any():
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        if p0 == 0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for name, column in values.items():
            own = column[covered]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
            lowest = np.unique(own)
            if len(lowest) <= THRESHOLDS:
                cuts = (lowest[:-1] + lowest[1:]) / 2
            # The edge of the bad rows is where a short list cuts best: between its extremes and the nearest good value.
            extremes = column[covered & bad]
            good = np.sort(column[covered & ~bad])
            for edge, side in ((extremes.min(), "left"), (extremes.max(), "right")):
                i = np.searchsorted(good, edge, side)
                near = good[i - 1] if side == "left" and i else good[i] if side == "right" and i < len(good) else None
                if near is not None:
                    cuts = np.append(cuts, (edge + near) / 2)
            if not len(cuts):
                continue
            is_bad = bad[covered]
            order = np.argsort(own, kind="stable")
            ranks = np.searchsorted(own[order], cuts, "right")
            bad_to = np.concatenate([[0], np.cumsum(is_bad[order])])[ranks]
            for above in (True, False):
                p = (p0 - bad_to if above else bad_to).astype(float)
                t = (len(own) - ranks if above else ranks).astype(float)
                gain = np.where(p >= LEAST_COVERED, p * (np.log2(np.maximum(p, 1) / np.maximum(t, 1)) - before), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-12:
                    best = gain[i], Condition(name, above, float(cuts[i]))
        if best[1] is None:
            break
        chosen = _centred(best[1], values[best[1].name][covered])
        rule.append(chosen)
        covered = covered & chosen.holds(values)
    return tuple(rule)


def _worth(rule: Rule, values: Mapping[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> float:
    held = _covers(rule, values, rows)
    p, n = int((held & bad).sum()), int((held & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(values: Mapping[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Sequential covering of the bad rows. Every third row only serves pruning and acceptance."""
    bad = np.asarray(bad, dtype=bool)
    found = DecisionList()
    if not bad.any() or bad.all():
        return found
    pruning = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    while (left & bad & ~pruning).sum() >= LEAST_COVERED:
        rule = _grow(values, bad, left & ~pruning)
        if not rule:
            break
        best = max((rule[:n] for n in range(len(rule), 0, -1)), key=lambda r: _worth(r, values, bad, left & pruning))
        grown, pruned = _covers(best, values, left & ~pruning), _covers(best, values, left & pruning)
        held = grown | pruned
        precision = (held & bad).sum() / max(1, held.sum())
        if (grown & bad).sum() < LEAST_COVERED or precision < LEAST_PRECISION or (pruned.any() and (pruned & bad).sum() < LEAST_PRECISION * pruned.sum()):
            break
        found.rules.append(best)
        left &= ~held
    return found


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learns the list from documents with ``labels.quality`` 0 or 1; base failures take no part."""
    clean = labels.select(F.col("doc_id").alias(id_col), "quality").dropna().filter(F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(clean, F.col(id_col), fit_rows)
    labelled = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    columns = ratios()
    stats = with_stats(labelled).filter(~base_failed()).select(id_col, "quality", *[c.alias(n) for n, c in columns.items()])
    # Order by a hash of the id, so that the pruning third is spread over sources and ages.
    got = stats.withColumn("order_", F.xxhash64(id_col)).drop(id_col).toPandas().sort_values(["order_", *columns], kind="stable")
    return learn({n: got[n].to_numpy(dtype=float) for n in columns}, got["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (without its text) with statistics, base_failed and kept; columns of these names, in any case, give way."""
    own = {*FIELDS, "base_failed", "kept"}
    stats = with_stats(docs.select(*[quoted(c) for c in docs.columns if c.lower() not in own]), text_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.rejects(ratios()))


def passed(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that the base rule and the list keep."""
    names = docs.columns
    plain = docs.select(*[F.col(quoted(n)).alias(f"k{i}") for i, n in enumerate(names)])
    judged = judge(plain.withColumn("text", F.col(f"k{names.index(text_col)}")), rules)
    return judged.filter("kept").select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)])
