"""Market holidays as one SQL expression over any range of years, and trading-day counts."""

from __future__ import annotations

EASTER = """
 e1 AS (SELECT *, y % 19 AS a, CAST(floor(y / 100.0) AS INT) AS b, y % 100 AS c FROM days),
 e2 AS (SELECT *, (19 * a + b - CAST(floor(b / 4.0) AS INT) - CAST(floor((b - CAST(floor((b + 8) / 25.0) AS INT) + 1) / 3.0) AS INT) + 15) % 30 AS h FROM e1),
 e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * CAST(floor(c / 4.0) AS INT) - h - c % 4) % 7 AS l FROM e2),
 e4 AS (SELECT *, h + l - 7 * CAST(floor((a + 11 * h + 22 * l) / 451.0) AS INT) + 114 AS n FROM e3)"""


def calendar_ctes(d, start: str, end: str) -> str:
    """CTE text ending in ``cal`` (d, w, trading): every day of the range, w from 0 for Monday.

    Fixed holidays move to the nearest weekday within their year; Good Friday is two days before
    Easter by the Gregorian rule; the June holiday is from 2022 on.
    """
    fixed = lambda mo, da, since=0: f"(y >= {since} AND ((mo = {mo} AND da = {da} AND w < 5) OR (mo = {mo} AND da = {da - 1} AND w = 4) OR (mo = {mo} AND da = {da + 1} AND w = 0)))"
    return f"""days AS (SELECT d, {d.weekday('d')} AS w, month(d) AS mo, day(d) AS da, year(d) AS y FROM {d.series(start, end)} z),{EASTER},
 cal AS (SELECT d, w, CASE WHEN w > 4 THEN 0
 WHEN (mo = 1 AND ((da = 1) OR (da = 2 AND w = 0))) OR {fixed(7, 4)} OR {fixed(12, 25)} OR {fixed(6, 19, 2022)}
 OR (mo = 1 AND w = 0 AND da BETWEEN 15 AND 21) OR (mo = 2 AND w = 0 AND da BETWEEN 15 AND 21) OR (mo = 5 AND w = 0 AND da >= 25)
 OR (mo = 9 AND w = 0 AND da <= 7) OR (mo = 11 AND w = 3 AND da BETWEEN 22 AND 28)
 OR (w = 4 AND {d.days('make_date(y, CAST(floor(n / 31.0) AS INT), n % 31 + 1)', 'd')} = 2) THEN 0 ELSE 1 END AS trading FROM e4)"""


def trading_days(spark, start: str, end: str):
    """(d, w, trading) as a DataFrame."""
    from crosswind.plans.panel_queries import Dialect

    return spark.sql(f"WITH {calendar_ctes(Dialect('spark'), start, end)} SELECT d, w, trading FROM cal")
