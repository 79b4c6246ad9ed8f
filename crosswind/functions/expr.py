"""Staged expressions over a dense (date, asset) panel.

An expression is a small tree; windows over windows can't be nested in SQL, so every window and
every argument that is used more than once becomes a column of a stage.  Stages of any number of
expressions are shared: windows over one asset in one stage are one sort and one operator, and
only the cross-sections shuffle by date.  ``staged`` writes the stages as common table
expressions that Spark plans as a whole; another dialect serves as an independent oracle.

Missing is NULL.  Rolling windows are counts of rows with a least number of values; clips and
extremes of a NULL are NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

E = 1e-12


@dataclass(frozen=True)
class X:
    kind: str
    args: tuple = ()
    extra: tuple = ()

    def _bin(self, op, other, swap=False):
        a, b = self, lift(other)
        return X("op", (b, a) if swap else (a, b), (op,))

    def __add__(self, o):
        return self._bin("+", o)

    def __radd__(self, o):
        return self._bin("+", o, True)

    def __sub__(self, o):
        return self._bin("-", o)

    def __rsub__(self, o):
        return self._bin("-", o, True)

    def __mul__(self, o):
        return self._bin("*", o)

    def __rmul__(self, o):
        return self._bin("*", o, True)

    def __truediv__(self, o):
        return self._bin("/", o)

    def __rtruediv__(self, o):
        return self._bin("/", o, True)

    def __neg__(self):
        return X("op", (lift(0.0), self), ("-",))

    def __gt__(self, o):
        return self._bin(">", o)

    def __lt__(self, o):
        return self._bin("<", o)

    def __ge__(self, o):
        return self._bin(">=", o)


def lift(v) -> X:
    return v if isinstance(v, X) else X("lit", (), (float(v),))


def col(name: str) -> X:
    return X("col", (), (name,))


def held(x: X) -> X:
    """A column of its own stage, unless it is one."""
    return x if x.kind in ("col", "lit", "held", "roll", "roll2", "lag", "xs", "rank", "total", "ema") else X("held", (x,))


def fn(name: str, *args) -> X:
    return X("fn", tuple(lift(a) for a in args), (name,))


def if_(cond: X, a, b=None) -> X:
    return X("if", (cond, lift(a)) + (() if b is None else (lift(b),)))


def b01(cond: X) -> X:
    """1 where the condition holds, else 0; a missing comparison is not a hit."""
    return if_(cond, 1.0, 0.0)


def clip(x: X, lo: float, hi: float) -> X:
    return X("clip", (held(x),), (lo, hi))


def pos(x: X) -> X:
    return X("clip", (held(x),), (0.0, None))


def neg_part(x: X) -> X:
    """least(x, 0)."""
    return X("clip", (held(x),), (None, 0.0))


def absolute(x) -> X:
    return fn("abs", x)


def sign(x) -> X:
    return fn("sign", x)


def sqrt(x) -> X:
    return fn("sqrt", x)


def ln(x) -> X:
    return fn("ln", x)


def coalesce(x, v) -> X:
    return fn("coalesce", x, v)


def greatest(*args) -> X:
    return X("greatest", tuple(held(a) for a in args))


def lag(x: X, k: int = 1) -> X:
    return X("lag", (held(x),), (k,))


def lead(x: X, k: int = 1) -> X:
    return X("lag", (held(x),), (-k,))


def roll(agg: str, x: X, w: int, mp: int, q: float | None = None) -> X:
    return X("roll", (held(x),), (agg, w, mp, q))


def roll2(agg: str, x: X, y: X, w: int, mp: int) -> X:
    """corr or cov of rows where both are there."""
    return X("roll2", (held(x), held(y)), (agg, w, mp))


def total(agg: str, x: X, mp: int = 1) -> X:
    """Aggregate of all rows of the asset up to this one."""
    return X("total", (held(x),), (agg, mp))


def xs(agg: str, x: X) -> X:
    """Aggregate of a date's cross-section."""
    return X("xs", (held(x),), (agg,))


def xrank(x: X) -> X:
    """Rank within the date over the number of values, ties averaged."""
    return X("rank", (held(x),))


STAGED = ("held", "roll", "roll2", "lag", "xs", "rank", "total", "ema", "row", "within", "before")
#: An exponential mean's weights are kept relative to a block's first row, down to the exponential of this; one gap shrinks old weight to no less than the other.
DEEPEST, GAP = -300.0, -69.0


class Writer:
    def __init__(self, dialect: str):
        self.spark = dialect == "spark"
        self.names: dict[X, str] = {}
        self.levels: dict[X, int] = {}

    def level(self, x: X) -> int:
        if x not in self.levels:
            below = max((self.level(a) for a in x.args), default=0)
            self.levels[x] = below + 1 if x.kind in STAGED else below
        return self.levels[x]

    def gather(self, x: X, into: dict[X, None]) -> None:
        if x in into:
            return
        for a in x.args:
            self.gather(a, into)
        if x.kind in STAGED:
            into[x] = None

    def text(self, x: X) -> str:
        return self.names[x] if x in self.names else self.body(x)

    def body(self, x: X) -> str:  # noqa: C901
        a = [self.text(v) for v in x.args]
        k = x.kind
        if k == "col":
            return x.extra[0]
        if k == "lit":
            return f"CAST({x.extra[0]!r} AS DOUBLE)"
        if k == "held":
            return a[0]
        if k == "rounded":
            return f"(round({a[0]}, {x.extra[0]}) + CAST(0 AS DOUBLE))"
        if k == "op":
            return f"({a[0]} {x.extra[0]} {a[1]})"
        if k == "fn":
            name = x.extra[0]
            if name == "power":
                return f"power({a[0]}, {a[1]})"
            return f"{name}({', '.join(a)})"
        if k == "if":
            return f"CASE WHEN {a[0]} THEN {a[1]}" + (f" ELSE {a[2]}" if len(a) > 2 else "") + " END"
        if k == "clip":
            lo, hi = x.extra
            inner = a[0]
            if hi is not None:
                inner = f"least(CAST({hi!r} AS DOUBLE), {inner})"
            if lo is not None:
                inner = f"greatest(CAST({lo!r} AS DOUBLE), {inner})"
            return f"CASE WHEN {a[0]} IS NOT NULL THEN {inner} END"
        if k == "greatest":
            return f"CASE WHEN {' AND '.join(v + ' IS NOT NULL' for v in a)} THEN greatest({', '.join(a)}) END"
        if k == "lag":
            n = x.extra[0]
            return f"{'lag' if n > 0 else 'lead'}({a[0]}, {abs(n)}) OVER (PARTITION BY asset ORDER BY date)"
        if k == "total":
            agg, mp = x.extra
            over = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            return f"CASE WHEN count({a[0]}) {over} >= {mp} THEN {agg}({a[0]}) {over} END"
        if k == "roll":
            agg, w, mp, q = x.extra
            over = f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            return f"CASE WHEN count({a[0]}) {over} >= {max(mp, 2) if agg in ('stddev_samp', 'var_samp') else mp} THEN {self.agg(agg, a[0], over, q)} END"
        if k == "roll2":
            agg, w, mp = x.extra
            over = f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            return f"CASE WHEN count({a[0]} + {a[1]}) {over} >= {max(mp, 2)} THEN {agg}({a[0]}, {a[1]}) {over} END"
        if k == "row":
            return "row_number() OVER (PARTITION BY asset ORDER BY date)"
        if k == "within":
            return f"sum({a[0]}) OVER (PARTITION BY asset, {a[1]} ORDER BY date)"
        if k == "before":
            return f"(max(named_struct('d', date, 'v', {a[0]})) OVER (PARTITION BY asset ORDER BY {a[1]} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)).v"
        if k == "isnull":
            return f"({a[0]} IS NULL)"
        if k == "ema":
            return self.ema(a[0], *x.extra)
        if k == "xs":
            return self.agg(x.extra[0], a[0], "OVER (PARTITION BY date)", 0.5)
        if k == "rank":
            v = a[0]
            return (
                f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY date, {v}) - 1) / CAST(2 AS DOUBLE))"
                f" / count({v}) OVER (PARTITION BY date) END"
            )
        raise ValueError(k)

    def ema(self, v: str, span: int, mp: int) -> str:
        """The recurrence itself, over all rows so far: y = x at first, then the mean of y and x by weights old and alpha; old shrinks by 1 - alpha a row and is 1 again after a value.

        Lists of all rows suit an oracle on small tables; Spark's text has ``scan`` in place of it.
        """
        alpha, keep = 2.0 / (span + 1), 1 - 2.0 / (span + 1)
        over = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        old = f"(p.w * CAST({keep!r} AS DOUBLE))"
        mean = f"CASE WHEN p.a IS NULL THEN s.a WHEN s.a IS NULL THEN p.a ELSE ({old} * p.a + CAST({alpha!r} AS DOUBLE) * s.a) / ({old} + CAST({alpha!r} AS DOUBLE)) END"
        weight = f"CASE WHEN p.a IS NULL OR s.a IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE {old} END"
        start = "struct_pack(a := CAST(NULL AS DOUBLE), w := CAST(1 AS DOUBLE))"
        value = f"struct_extract(list_reduce(list_prepend({start}, list(struct_pack(a := {v}, w := CAST(1 AS DOUBLE))) {over}), lambda p, s: struct_pack(a := {mean}, w := {weight})), 'a')"
        return f"CASE WHEN count({v}) {over} >= {mp} THEN {value} END"

    def agg(self, agg: str, v: str, over: str, q: float | None) -> str:
        if agg == "quantile":
            return f"percentile({v}, {q}) {over}" if self.spark else f"quantile_cont({v}, {q}) {over}"
        if agg == "skew":  # bias-corrected
            if not self.spark:
                return f"skewness({v}) {over}"
            n = f"CAST(count({v}) {over} AS DOUBLE)"
            return f"skewness({v}) {over} * sqrt({n} * ({n} - 1)) / ({n} - 2)"
        if agg == "kurt":
            if not self.spark:
                return f"kurtosis({v}) {over}"
            n = f"CAST(count({v}) {over} AS DOUBLE)"
            return f"({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({v}) {over} + 6)"
        return f"{agg}({v}) {over}"


def scan(x: X, span: int, mp: int) -> X:
    """The exponential mean of ``X("ema")`` as running sums, without a list.

    A row maps the mean before it to kept * mean + (1 - kept) * value, where kept falls with the rows since the last value; a
    missing value keeps all.  Composed from an asset's first row on, the logarithms of kept add up, so that the mean is a running
    sum of values over their weight times the weight now.  Sums begin anew in each block of ``DEEPEST``, to stay in range; of what lies
    before a block only the block before it bears weight.
    """
    alpha, shrink = 2.0 / (span + 1), math.log1p(-2.0 / (span + 1))
    known, row = X("op", (x, x), ("=",)), X("row")
    gap = held(row - lag(total("max", if_(known, row)))) * shrink
    kept = held(if_(known, coalesce(fn("greatest", gap - ln(fn("exp", gap) + alpha), GAP), 0.0), 0.0))
    log = total("sum", kept, 0)
    block = held(fn("floor", log / DEEPEST))
    first = X("op", (total("count", x, 0), lift(1.0)), ("=",))
    term = if_(known, x * if_(first, 1.0, lift(1.0) - fn("exp", kept)) * fn("exp", block * DEEPEST - log), 0.0)
    own = held(X("within", (held(term), block)) * fn("exp", log - block * DEEPEST))
    older = X("before", (own, block)) * fn("exp", log - X("before", (log, block)))
    return if_(total("count", x, 0) >= float(mp), own + coalesce(older, 0.0))


def scanned(x: X, seen: dict[X, X]) -> X:
    """The tree with every exponential mean as a scan."""
    if x not in seen:
        args = tuple(scanned(a, seen) for a in x.args)
        seen[x] = scan(args[0], *x.extra) if x.kind == "ema" else x if args == x.args else X(x.kind, args, x.extra)
    return seen[x]


def staged(outputs: dict[str, X], source: str, dialect: str, keys: str = "date, asset", given: tuple[tuple[str, str], ...] = ()) -> str:
    """SQL for the outputs over relation ``source``; ``given`` are further CTEs before it."""
    w = Writer(dialect)
    if w.spark:
        seen: dict[X, X] = {}
        outputs = {name: scanned(x, seen) for name, x in outputs.items()}
    nodes: dict[X, None] = {}
    for x in outputs.values():
        w.gather(x, nodes)
    by: dict[int, list[X]] = {}
    for n in nodes:
        by.setdefault(w.level(n), []).append(n)
    ctes, at, i = [f"{n} AS ({q})" for n, q in given], source, 0
    for level in sorted(by):
        parts = []
        for n in by[level]:
            parts.append((n, f"{w.body(n)} AS t{i}", f"t{i}"))
            i += 1
        ctes.append(f"s{level} AS (SELECT *, {', '.join(p[1] for p in parts)} FROM {at})")
        for n, _, name in parts:
            w.names[n] = name
        at = f"s{level}"
    body = f"SELECT {keys}, {', '.join(f'{w.text(x)} AS {name}' for name, x in outputs.items())} FROM {at}"
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def rounded(x: X, places: int = 6) -> X:
    """Rounded, and never the negative zero."""
    return X("rounded", (x,), (places,))
