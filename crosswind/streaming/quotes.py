"""Streams of quotes and candles: parsing, latest state, daily candles and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(frames: DataFrame, fields: dict[str, list[str]], column: str = "frame") -> DataFrame:
    """Events (type, values map) from compact frames ``[type, [v1, ..., vN, ...]]``: values come in chunks of a type's fields."""
    parts = F.from_json(column, "array<string>")
    kind, values = F.element_at(parts, 1), F.from_json(F.element_at(parts, 2), "array<string>")
    out = None
    for name, own in fields.items():
        k = len(own)
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size("values") / k).cast("int") - 1), lambda i: F.map_from_arrays(F.array(*[F.lit(f) for f in own]), F.slice("values", i * k + 1, k)))
        out = F.when((F.col("type") == name) & (F.size("values") >= k), chunks) if out is None else out.when((F.col("type") == name) & (F.size("values") >= k), chunks)
    return frames.select(kind.alias("type"), values.alias("values")).select("type", F.explode(out).alias("event"))


def mark(bid: F.Column, ask: F.Column, last: F.Column) -> F.Column:
    """The mid where both sides are positive, else the last price."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(F.when(last > 0, last))


def latest(quotes: DataFrame) -> DataFrame:
    """Newest bid, ask and last by symbol and their mark; for update mode."""
    newest = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask", "last"), "ts").alias("q"), F.max("ts").alias("ts"))
    return newest.select("symbol", "ts", "q.bid", "q.ask", "q.last", mark(F.col("q.bid"), F.col("q.ask"), F.col("q.last")).alias("mark"))


def candles(trades: DataFrame, late: str = "1 day", width: str = "1 day", order: str = "ts") -> DataFrame:
    """Open, high, low, close and volume by symbol and window; rows later than the watermark are dropped.

    ``order``: the column that says which trades are first and last, where times can be equal.
    """
    t = trades.withWatermark("ts", late)
    return t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("size").alias("v")
    ).select("symbol", F.col("w.start").alias("start"), "o", "h", "l", "c", "v")


def once(fills: DataFrame, late: str = "1 day") -> DataFrame:
    """Each transaction once within the watermark."""
    return fills.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transaction_id"])


def finished(notes: DataFrame, wanted: list[str], terminal=("Filled", "Cancelled", "Rejected", "Expired")) -> DataFrame:
    """The last status of each wanted order, and if it is final."""
    own = notes.where(F.col("order_id").isin(wanted)).groupBy("order_id").agg(F.max_by("status", "ts").alias("status"))
    return own.select("order_id", "status", F.col("status").isin(list(terminal)).alias("done"))


def notification(raw: DataFrame, column: str = "message") -> DataFrame:
    """Account messages as (kind, type, data, timestamp): records without a type and data are control records."""
    m = F.from_json(column, "type string, data string, timestamp long, action string, status string")
    plain = m["type"].isNotNull() & m["data"].isNotNull()
    kind = F.when(plain, "event").otherwise("control")
    return raw.select(kind.alias("kind"), F.when(plain, m["type"]).otherwise(m["action"]).alias("type"), F.when(plain, m["data"]).otherwise(F.col(column)).alias("data"), F.timestamp_millis(m["timestamp"]).alias("timestamp"))


def position_pnl(marks: DataFrame, positions: DataFrame) -> DataFrame:
    """Value, unrealised gain and change on the day of each position (symbol, qty, cost, prev_close) at marks (symbol, mark); stream or table."""
    return marks.join(F.broadcast(positions), "symbol").select(
        "symbol", (F.col("qty") * F.col("mark")).alias("value"), (F.col("qty") * (F.col("mark") - F.col("cost"))).alias("unrealised"),
        F.when(F.col("prev_close") > 0, F.col("mark") / F.col("prev_close") - 1).alias("day_change"),
    )


#: Statuses after which an order does not change.
TERMINAL = ("Filled", "Cancelled", "Rejected", "Expired", "Removed", "Partially Removed")


def watched(notes: DataFrame, timeout: str = "5 minutes") -> DataFrame:
    """(order_id, status, outcome) once for each order of notes (order_id, status, ts): done at a terminal status, timeout if none comes in time.

    State is one row an order; it leaves with the outcome, so it doesn't grow with finished orders.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"order_id": [key[0]], "status": [last], "outcome": ["timeout"]})
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        final = rows[rows["status"].isin(TERMINAL)]
        if len(final):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"order_id": [key[0]], "status": [final["status"].iloc[0]], "outcome": ["done"]})
        else:
            state.update((rows["status"].iloc[-1],))
            state.setTimeoutDuration(wait)

    return notes.select("order_id", "status", "ts").groupBy("order_id").applyInPandasWithState(step, f"order_id {dict(notes.dtypes)['order_id']}, status string, outcome string", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout)
