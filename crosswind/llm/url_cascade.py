"""URL filters: path rules on hosts and their subdomains, then a Bloom filter cascade.

The cascade holds a list of blocked sites exactly over a known universe of keys: level 1 is a
Bloom filter of the listed keys, level 2 of the universe's other keys that pass level 1, level 3
of the listed keys that pass level 2, and so on until a level lets nothing wrong through.  A key
is listed if the first level that it fails is an even one.  The universe is every host suffix
of the whole table, so membership is exact on the table without a join.  The levels are
literals in one Spark expression.  Their size follows the list, a parameter or a table of keys.
Level 1 has the more bits a key the larger the universe is, so that about half as many keys as are
listed pass it wrongly, at any number of hosts; its bits grow with the fourth root of that number.
When a level has few keys left it names them, which ends the cascade.  A list whose level 1 would
take over ``MOST_BITS`` is no literal: then the distinct hosts' suffixes are joined with it, with equal results.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed; of rules of equal length the last by name wins; repeated urls and listed keys count once, null keys
not at all; urls of any length are read whole; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The listed sites: a host is listed with all its subdomains.
SITES = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bits for each key and hashes of a level; with so few keys left a level is the list of them.
BITS_PER_KEY = 12
HASHES = 4
FEW = 16
#: Bits that a level may have as literals, 32 KB: some 20,000 keys.  Beyond that a list is joined with the distinct hosts.
MOST_BITS = 1 << 18


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + F.lit(4))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, lowered).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + F.lit(4))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> Column:
    """The host itself and every parent domain; none for the empty host."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter as words of bits, or the few keys themselves."""

    bits: int = 0
    words: tuple[int, ...] = ()
    keys: tuple[str, ...] = ()


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Bit places by hashes of their own, so that no two keys share all places by few collisions; each level has its own seeds."""
    return [F.pmod(F.xxhash64(F.lit(HASHES * level + i), key), F.lit(bits)) for i in range(HASHES)]


def _passes(key: Column, level: int, made: Level) -> Column:
    if made.keys:
        return key.isin(list(made.keys))
    words = F.array(*[F.lit(w) for w in made.words])
    ok = F.lit(True)
    for place in _places(key, level, made.bits):
        word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
        ok = ok & (F.call_function("getbit", word, (place % 64).cast("int")) == 1)
    return ok


def _bits_per_key(listed: int, others: int) -> float:
    """Bits with which about half as many of the other keys as are listed pass, ``BITS_PER_KEY`` at least."""
    part = min(0.5, listed / (2 * max(1, others)))
    return max(BITS_PER_KEY, -HASHES / math.log1p(-(part ** (1 / HASHES))))


def _level(keys: DataFrame, level: int, n: int, each: float = BITS_PER_KEY) -> Level:
    """A Bloom filter of the keys: set bits gathered by word; as many rows as the filter has words."""
    bits = max(64, math.ceil(n * each / 64) * 64)
    at = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at")).distinct()
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
    words = {r["word"]: r["bits"] for r in rows}
    return Level(bits, tuple(words.get(i, 0) for i in range(bits // 64)))


def build(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> list[Level] | None:
    """The levels for the keys of ``listed`` over ``universe`` (both: column ``key``, repeats allowed); None if they are too large.

    Each level reads the universe again rather than keeping it; levels shrink by the filters'
    error rate, so a handful suffice.
    """
    mine = listed.where(F.col("key").isNotNull()).distinct()
    n = mine.count()
    if not n:
        return []
    others = universe.where(F.col("key").isNotNull()).distinct().join(mine, "key", "left_anti")
    each = _bits_per_key(n, others.agg(F.approx_count_distinct("key")).first()[0])
    if n * each > most_bits:
        return None
    levels: list[Level] = []
    while n:
        side = mine if len(levels) % 2 == 0 else others
        for j, made in enumerate(levels):  # only what has come through all levels so far
            side = side.where(_passes(F.col("key"), j, made))
        if levels:
            n, each = side.count(), BITS_PER_KEY
        if n > most_bits / BITS_PER_KEY:  # more keys than expected come through
            return None
        if n > FEW:
            levels.append(_level(side, len(levels), n, each))
        elif n:
            return [*levels, Level(keys=tuple(sorted(r["key"] for r in side.collect())))]
    return levels


def contains(key: Column, levels: list[Level]) -> Column:
    """True for listed keys: the level that first fails a key decides; passing all, the last does."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~_passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, sites=SITES, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.  ``sites``: listed keys, or a table with the column ``key``."""
    url = F.col("url")
    at = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    listed = sites if isinstance(sites, DataFrame) else spark.createDataFrame([(k,) for k in sites], "key string")
    hosts = at.select("host").distinct()
    levels = build(hosts.select(F.explode(suffixes(F.col("host"))).alias("key")), listed, most_bits)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if levels is None:  # a list too large for literals: hosts, each once, are joined with it
        keys = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = keys.join(listed, "key", "left_semi").select("host", F.lit(True).alias("listed")).distinct()
        at, blocked = at.join(bad, "host", "left"), F.coalesce(F.col("listed"), F.lit(False))
    else:
        blocked = F.exists(suffixes(F.col("host")), lambda k: contains(k, levels))
    return at.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def judge_sql(rules=RULES, sites=SITES) -> str:
    """DuckDB SQL for ``judge`` with plain lists."""
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    listed = " OR ".join(f"host = '{s}' OR host LIKE '%.{s}'" for s in sites)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM h"""
