"""Quality rules as learned decision lists, in Spark expressions alone.

Every whole text gets a row of statistics from built-in functions.  Labelled rows teach an
ordered list of rules by sequential covering: a rule grows as a conjunction of thresholds by
information gain on one part of the rows still uncovered, is pruned on the other part, and
stays if it is precise there; the rows that it covers leave.  The list is emitted as a Spark
conditional expression over the statistics.  The two base rules stand before it.

The rules are learned on the driver from a sample of at most ``TRAIN_ROWS`` labelled rows;
statistics and verdicts are for all rows and run no Python on executors.

Defined results: null text has no words and fails the base rules, as does an empty one; with no
labels or one class the list is empty; ties between thresholds go to the first statistic and the
lowest value; repeated rows are judged each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.llm._shared import by_position

TRAIN_ROWS = 20_000
#: Conditions of a rule, rules of a list, thresholds tried for a statistic, and the precision and
#: covered rows that a rule needs on the part that it is pruned on.
MOST_CONDITIONS = 4
MOST_RULES = 16
CUTS = 64
PRECISION = 0.98
COVERS = 5

#: Fixed values of the contract.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the base statistics, and those that only the learned rules use.

    Each step is a projection of its own, as its arrays are referred to more than once.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        *keep, text.alias("text"), F.array_remove(F.split(text, _BLANKS), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines")
    )
    at = lambda i: F.get("words", i)
    grams = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    words = cut.select(
        *keep, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"), grams.alias("grams"),
    )
    rest = [c for c in words.columns if c != "grams"]
    # windows found twice stand side by side when sorted; few texts have any, and only these are sorted
    pairs = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    paired = words.select(*rest, pairs.alias("pairs"))
    twice = F.filter(
        "pairs", lambda p, j: F.when(j > 0, F.get("pairs", j - 1)["g"] == p["g"]).otherwise(False) | F.coalesce(F.get("pairs", j + 1)["g"] == p["g"], F.lit(False))
    )
    starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n")))
    return paired.select(*rest, covered["n"].cast("long").alias("n_repeat_words"))


def shares() -> dict[str, Column]:
    """What the learned rules compare: counts by the words or lines that they are of."""
    by = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": by("word_chars", "n_words"), "symbols": by("n_symbols", "n_words"), "dup_lines": by("n_dup_lines", "n_lines"),
        "repeats": by("n_repeat_words", "n_words"), "upper": by("n_upper", "word_chars"), "bangs": by("n_bangs", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    share: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.share] >= self.cut if self.above else x[:, self.share] < self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grown(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition with the most information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        xi, bi = x[inside], bad[inside]
        p0 = np.log2(max(bi.sum(), 1e-9) / len(bi))
        best, best_gain = None, 1e-9
        for s in range(x.shape[1]):
            values = np.unique(xi[:, s])
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > CUTS:
                middles = np.unique(np.concatenate([np.quantile(xi[:, s], np.linspace(0, 1, CUTS)), np.quantile(xi[bi, s], np.linspace(0, 1, CUTS // 2)), np.quantile(xi[~bi, s], np.linspace(0, 1, CUTS // 2))]))
            order = np.argsort(xi[:, s], kind="stable")
            sorted_x, cum = xi[order, s], np.concatenate([[0], np.cumsum(bi[order])])
            below = np.searchsorted(sorted_x, middles, side="left")
            for above in (True, False):
                n = len(sorted_x) - below if above else below
                p = cum[-1] - cum[below] if above else cum[below]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((p > 0) & (n < len(sorted_x)), p * (np.log2(p / n) - p0), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best_gain:
                    best, best_gain = Condition(s, above, float(middles[i])), gain[i]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """Of the rule's beginnings, the one of best value on other rows, with its precision and covered bad rows."""
    best: tuple[float, Rule, float, int] | None = None
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], x)
        n, p = int(inside.sum()), int(bad[inside].sum())
        precision = p / n if n else 0.0
        value = (2 * p - n) / n if n else -1.0
        if best is None or value > best[0] + 1e-12:
            best = (value, rule[:k], precision, p)
    return best[1], best[2], best[3]


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """The ordered list for rows ``x`` with ``bad`` marks."""
    rules: list[Rule] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    while len(rules) < MOST_RULES and bad[part].any():
        grown = _grown(x[part], bad[part])
        if not grown:
            break
        rule, precision, found = _pruned(grown, x[~part], bad[~part])
        if precision < PRECISION or found < COVERS:
            break
        rules.append(rule)
        left = ~covers(rule, x)
        x, bad, part = x[left], bad[left], part[left]
    return rules


def verdict(rules: list[Rule], by: dict[str, Column]) -> Column:
    """True where no rule holds: the list as one conditional expression."""
    columns, out = list(by.values()), None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & ((columns[c.share] >= c.cut) if c.above else (columns[c.share] < c.cut))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents, those with the smallest hashes of their ids."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    few = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id"), "doc_id", "quality")
    got = stats.select("doc_id", "quality", *[v.alias(k) for k, v in shares().items()]).toPandas().sort_values("doc_id", kind="stable")
    return learn(got[list(shares())].to_numpy(float), got["quality"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """``keep`` columns, the base statistics, base_failed and kept."""
    stats = statistics(docs, *keep)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return stats.select(*keep, *BASE, failed.alias("base_failed"), (~failed & verdict(rules, shares())).alias("kept"))


def apply(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed and kept of every document, by rules learned from the labelled ones."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(docs, learned(spark, docs, labels), "doc_id")


def filtered(spark: SparkSession, docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that stay, with their columns.

    The row number keeps the optimizer from moving the filter below the projections, where it
    would compute the arrays anew for each use.
    """

    def work(named: DataFrame) -> DataFrame:
        whole = named.select(F.struct(*named.columns).alias("_row"), F.col("text"))
        return judged(whole, rules, "_row").withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0").select("_row.*")

    return by_position(docs, ("text",), work)
