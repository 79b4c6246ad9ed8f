"""Why a board's candidate was chosen: gates, a soft regime, scorecards, alternatives, rails and where a book's weights stand.

A board is the rows that share ``by`` (a date, or a policy and a date), one row for each candidate, with the columns ``NUMBERS``
and ``FLAGS``, ``candidate``, ``strategy`` and ``action``.  Any number of boards is one plan: numbers of a board are aggregates,
places in it windows over ``by``, and a board has as many rows as there are strategies.

Missing numbers count as 0, a missing ``eligible`` as false.  A missing gate isn't known: it makes no node, flag or reason.  A board
without rows gives none.  Rows that tie go by ``candidate``.  Other columns of a board are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("alpha", "net_alpha", "cost", "turn_penalty", "risk_penalty", "utility", "turnover", "overlap", "vol", "dd")
FLAGS = ("eligible", "required", "cadence_due", "hold_lock", "kill")
HOLD = "hold_current"

# Of the soft regime each state's base, and its terms (weight, measure, scale); what stale inputs add; the least share.
STATES = {
    "risk_on": (0.50, (("utility", 0.20, 8.0), ("alpha", 0.15, 10.0)), -0.15),
    "risk_off": (0.25, (("risk_penalty", 0.20, 10.0), ("dd", 0.20, 0.10)), 0.0),
    "chop": (0.20, (("turnover", 0.20, 0.25), ("utility", -0.10, 8.0)), 0.0),
    "ops_stress": (0.15, (("vol", 0.20, 0.20),), 0.25),
}
LEAST_SHARE = 0.01
# Each gate, the value that passes, and what its failure is called as a reason and as a flag.
GATES = (
    ("required", True, "rebalance not required"), ("cadence_due", True, "cadence not due"),
    ("hold_lock", False, "hold lock"), ("kill", False, "kill switch"),
)
CALLS = ("GREENLIGHT", "REVIEW", "HOLD CURRENT", "HOLD BASELINE", "BLOCK")


@dataclass(frozen=True)
class Limits:
    """Fixed values of the scorecard: edges for a go and a review, and from where turnover, drawdown, volatility and overlap are flagged."""

    go: float = 2.0
    review: float = 0.0
    turnover: float = 0.35
    drawdown: float = 0.15
    vol: float = 0.35
    overlap: float = 0.25


def _n(name: str) -> Column:
    """A number of a board, 0 where it is missing; sums that differ in their last bits compare alike."""
    return F.round(F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(0.0)), 9)


def _able() -> Column:
    return F.coalesce(F.col("eligible"), F.lit(False))


def _failed(gate: str, good: bool) -> Column:
    return F.col(gate) != F.lit(good)


def _out(x: Column, places: int) -> Column:
    return F.round(x, places) + F.lit(0.0)


def regimes(board: DataFrame, by: list[str], stale: str | None = None) -> DataFrame:
    """One row a board: the share of each state, the likeliest (the first of ``STATES`` in a tie), and what drove it.

    Means are over the eligible candidates, over all where none is; ``stale`` names a column that tells that inputs were stale.
    """
    measures = sorted({m for _, terms, _ in STATES.values() for m, _, _ in terms})
    mean = lambda m: F.coalesce(F.avg(F.when(_able(), _n(m))), F.avg(_n(m)))
    old = F.max(F.coalesce(F.col(stale), F.lit(False))) if stale else F.lit(False)
    got = board.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(_able(), 1)).alias("able"), old.alias("stale"), *[mean(m).alias(f"mean_{m}") for m in measures])
    for state, (base, terms, more) in STATES.items():
        raw = sum((F.lit(w) * F.tanh(F.col(f"mean_{m}") / F.lit(scale)) for m, w, scale in terms), F.lit(base)) + F.when(F.col("stale"), F.lit(more)).otherwise(F.lit(0.0))
        got = got.withColumn(f"raw_{state}", F.greatest(F.lit(LEAST_SHARE), raw))
    total = sum((F.col(f"raw_{s}") for s in STATES), F.lit(0.0))
    got = got.select(*by, "candidates", "able", "stale", *[_out(F.col(f"mean_{m}"), 4).alias(f"mean_{m}") for m in measures], *[_out(F.col(f"raw_{s}") / total, 4).alias(s) for s in STATES])
    top = F.greatest(*[F.col(s) for s in STATES])
    return got.withColumn("state", F.coalesce(*[F.when(F.col(s) == top, s) for s in STATES]))


def nodes(board: DataFrame, by: list[str], most_turnover: float = 0.35) -> DataFrame:
    """One row for each candidate and gate that is known: PASS, WARN or BLOCK, with the value where there is one."""
    none = F.lit(None).cast("double")
    node = lambda name, state, value: F.struct(F.lit(name).alias("node"), state.alias("state"), value.alias("value"))
    every = F.array(
        node("eligible", F.when(_able(), "PASS").otherwise("BLOCK"), none),
        *[node(g, F.when(_failed(g, good), "BLOCK").when(F.col(g).isNotNull(), "PASS"), none) for g, good, _ in GATES],
        node("turnover", F.when(_n("turnover") <= most_turnover, "PASS").otherwise("BLOCK"), _out(_n("turnover"), 5)),
        node("utility", F.when(_n("utility") >= 0, "PASS").otherwise("WARN"), _out(_n("utility"), 3)),
    )
    return board.select(*by, "candidate", F.explode(every).alias("x")).where("x.state IS NOT NULL").select(*by, "candidate", "x.*")


def scorecard(board: DataFrame, by: list[str], limits: Limits = Limits()) -> DataFrame:
    """One row for each candidate: edge over holding, flags, risk points, conviction, the call, its place, and whether it is the play to look at.

    Without a row that holds, the edge is over 0.  The play is the first to be greenlit or reviewed, else the first at all.
    """
    action = F.lower(F.coalesce("action", F.lit("")))
    flags = F.array_compact(F.array(
        F.when(_failed("kill", False), "kill switch"), F.when(_n("turnover") > limits.turnover, "high turnover"), F.when(F.abs(_n("dd")) > limits.drawdown, "drawdown risk"),
        F.when(_n("vol") > limits.vol, "high vol"), F.when((F.round("overlap", 9) < limits.overlap) & action.isin("switch", "rebalance"), "low overlap"),
        F.when(_failed("hold_lock", False), "hold lock"), F.when(_failed("cadence_due", True), "cadence not due"), F.when(_failed("required", True) & ~action.isin("hold", ""), "rebalance not required"),
    ))
    own = Window.partitionBy(*by)
    hold = F.coalesce(F.max(F.when(F.col("candidate") == HOLD, _n("utility"))).over(own), F.lit(0.0))
    got = board.select(*by, "candidate", "strategy", _able().alias("eligible"), *[_n(c).alias(c) for c in ("utility", "net_alpha", "cost", "turnover", "vol", "dd")], F.coalesce("kill", F.lit(False)).alias("kill"), flags.alias("f"), F.round(_n("utility") - hold, 9).alias("edge"))
    points = F.round(100 * (0.35 * F.greatest(F.lit(0.0), "turnover") + 0.25 * F.abs("dd") + 0.20 * F.greatest(F.lit(0.0), "vol") + 0.20 * F.greatest(F.lit(0.0), "cost") / 100) + 4 * F.size("f"), 2)
    call = (
        F.when(F.col("candidate") == HOLD, "HOLD BASELINE").when(~F.col("eligible") | F.col("kill"), "BLOCK")
        .when((F.col("edge") >= limits.go) & (F.size("f") == 0), "GREENLIGHT").when(F.col("edge") >= limits.review, "REVIEW").otherwise("HOLD CURRENT")
    )
    got = got.withColumn("points", points).withColumn("call", call).withColumn("conviction", F.round(F.col("edge") - 0.05 * F.col("points"), 6))
    rank = F.array_position(F.array(*map(F.lit, CALLS)), F.col("call"))
    place = F.row_number().over(own.orderBy(rank, F.desc("conviction"), F.desc("utility"), "candidate"))
    return got.withColumn("place", place).select(
        *by, "place", "candidate", "strategy", "call", "eligible", *[_out(F.col(c), 3).alias(c) for c in ("edge", "utility", "net_alpha", "cost")],
        (F.col("points") + F.lit(0.0)).alias("risk_points"), _out(F.col("conviction"), 3).alias("conviction"),
        F.when(F.size("f") > 0, F.array_join("f", ", ")).otherwise("clear").alias("flags"), (F.col("place") == 1).alias("best"),
    )


def _reasons(most_turnover: float) -> list[Column]:
    return [*[F.when(_failed(g, good), said) for g, good, said in GATES], F.when(_n("turnover") > most_turnover, "turnover over the limit")]


def rails(board: DataFrame, by: list[str], most_turnover: float = 0.35) -> DataFrame:
    """One row for each candidate: whether a decision may name it, and why not (empty where it may)."""
    known = F.array_compact(F.array(*_reasons(most_turnover)))
    said = F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("not eligible under the policy")
    return board.select(*by, "candidate", _able().alias("allowed"), F.when(_able(), "").otherwise(said).alias("reasons"))


def readiness(board: DataFrame, by: list[str], stale: str | None = None) -> DataFrame:
    """One row a board: PASS where a decision can be made on it, else BLOCK, and what is in the way."""
    old = F.max(F.coalesce(F.col(stale), F.lit(False))) if stale else F.lit(False)
    got = board.groupBy(*by).agg(F.count(F.when(_able(), 1)).alias("allowed"), old.alias("stale"))
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("allowed") == 0, "no candidate is allowed"), F.when(F.col("stale"), "inputs are stale"))), ", ")
    return got.select(*by, "allowed", issues.alias("issues"), F.when(issues == "", "PASS").otherwise("BLOCK").alias("status"))


def explained(board: DataFrame, by: list[str], planned: str | None = None, most: int = 8, most_turnover: float = 0.35) -> DataFrame:
    """The board's focus less each of the ``most`` best others (by utility), with what speaks against those.

    The focus is the candidate of the true row of ``planned``, else the best eligible one that rebalances, else the one that holds, else the first.
    """
    chosen = F.coalesce(F.col(planned), F.lit(False)) if planned else F.lit(False)
    first = F.when(chosen, 0).when(_able() & (F.col("action") == "rebalance"), 1).when(F.col("candidate") == HOLD, 2).otherwise(3)
    own = Window.partitionBy(*by)
    less = ("utility", "alpha", "net_alpha", "cost", "turn_penalty", "risk_penalty", "turnover", "overlap")
    got = board.select(*by, "candidate", "action", _able().alias("eligible"), first.alias("first"), F.array_compact(F.array(F.when(~_able(), "not eligible"), *_reasons(most_turnover))).alias("against"), *[_n(c).alias(c) for c in less])
    # among those that may be focused for the same reason the best leads; where nothing else decides, the first by name
    got = got.withColumn("lead", F.row_number().over(own.orderBy("first", F.when(F.col("first") < 3, -F.col("utility")), "candidate")))
    of = F.max(F.when(F.col("lead") == 1, F.struct("candidate", *less))).over(own)
    got = got.withColumn("focus", of).where("lead > 1").withColumn("place", F.row_number().over(own.orderBy(F.desc("utility"), "candidate"))).where(F.col("place") <= most)
    return got.select(
        *by, F.col("focus.candidate").alias("focus"), "place", "candidate", "action", "eligible", F.when(F.size("against") > 0, F.array_join("against", ", ")).otherwise("eligible alternative").alias("against"),
        *[_out(F.col(f"focus.{c}") - F.col(c), 5).alias(f"d_{c}") for c in less],
    )


def provenance(books: DataFrame, by: list[str], top: int = 20) -> DataFrame:
    """One row a book (``by``, ``asset``, ``weight``): gross, net, positions, effective number, and its ``top`` weights as text.

    Only the top ones are gathered, so that a book of any number of assets is an aggregate.  Missing weights are left out.
    """
    w = F.col("weight")
    own = Window.partitionBy(*by).orderBy(F.desc("size"), "asset")
    ranked = books.where(w.isNotNull() & ~F.isnan("weight")).select(*by, "asset", "weight", F.round(F.abs(w), 9).alias("size")).withColumn("k", F.row_number().over(own))
    said = F.concat(F.col("asset").cast("string"), F.lit("="), F.format_string("%.6f", w))
    got = ranked.groupBy(*by).agg(
        F.sum("size").alias("gross"), F.sum("weight").alias("net"), F.count(F.when(F.col("size") > 1e-9, 1)).alias("positions"), F.sum(w * w).alias("squares"),
        F.collect_list(F.when((F.col("k") <= top) & (F.col("size") > 1e-9), F.struct("k", said.alias("said")))).alias("first"),
    )
    told = F.array_join(F.transform(F.array_sort("first"), lambda x: x["said"]), ", ")
    return got.select(*by, _out(F.col("gross"), 5).alias("gross"), _out(F.col("net"), 5).alias("net"), "positions", _out(F.when(F.col("positions") > 0, 1 / F.col("squares")).otherwise(0.0), 2).alias("effective_n"), told.alias("top_weights"))


def frontier(board: DataFrame, by: list[str], expected: list[str]) -> DataFrame:
    """One row a board: how many of the strategies that a policy names are on it, and which are missing."""
    there = F.collect_set("strategy")
    got = board.where(F.coalesce("candidate", F.lit("")) != HOLD).groupBy(*by).agg(F.count(F.lit(1)).alias("on_board"), F.array_sort(F.array_except(F.array(*map(F.lit, sorted(expected))), there)).alias("gone"))
    return got.select(*by, "on_board", F.lit(len(set(expected))).alias("expected"), F.array_join("gone", ", ").alias("missing"), (F.size("gone") == 0).alias("complete"))
