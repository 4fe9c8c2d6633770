"""Alert rules as windowed aggregations with watermarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestat.session import ship_by_value

ship_by_value(__name__)

# Fixed values of the rules.
ERROR_RATE_LIMIT = 0.01
LATENCY_LIMIT_ONE, LATENCY_LIMIT_BATCH = 1.0, 30.0
LATENESS = "10 minutes"


def timed(events: DataFrame, ts: str, lateness: str = LATENESS) -> DataFrame:
    """Events with a real timestamp and, on a stream, a watermark that bounds the state."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, lateness) if events.isStreaming else stamped


def _bounds(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(
        F.col("window.start").alias("debut"), F.col("window.end").alias("fin"), *columns
    )


def error_rate_window(
    events: DataFrame,
    ts: str,
    error: Column,
    limit: float = ERROR_RATE_LIMIT,
    width: str = "10 minutes",
    slide: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(debut, fin[, by], n, n_erreurs, taux, alerte) per window."""
    marked = timed(events.withColumn("_e", error), ts)
    counts = marked.groupBy(F.window(ts, width, slide or width), *by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_e").alias("n_erreurs")
    )
    rate = F.col("n_erreurs") / F.col("n")
    return _bounds(counts, *by, "n", "n_erreurs", rate.alias("taux"), (rate > limit).alias("alerte"))


def latency_quantile_window(
    events: DataFrame,
    ts: str,
    value: str,
    route: str,
    quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    limit: float = LATENCY_LIMIT_BATCH,
    width: str = "15 minutes",
    slide: str = "5 minutes",
    accuracy: int = 10_000,
) -> DataFrame:
    """(debut, fin, route, n, p50, p95, p99, alerte) per sliding window and route."""
    sketched = timed(events, ts).groupBy(F.window(ts, width, slide), route).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(value, list(quantiles), accuracy).alias("_q"),
    )
    named = [F.col("_q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)]
    worst = F.col("_q")[list(quantiles).index(0.95)]
    return _bounds(sketched, route, "n", *named, (worst > limit).alias("alerte"))


def refusal_increase_window(refused: DataFrame, ts: str, width: str = "24 hours") -> DataFrame:
    """(debut, fin, colonne, n): refusals per offending field and window; any is an alert."""
    fields = timed(refused, ts).select(ts, F.explode("erreurs.champ").alias("colonne"))
    return _bounds(
        fields.groupBy(F.window(ts, width), "colonne").agg(F.count(F.lit(1)).alias("n")),
        "colonne",
        "n",
    )


def traffic_by_status(
    events: DataFrame, ts: str, route: str, status: str, minutes: int = 5
) -> DataFrame:
    """(debut, fin, route, status, n, par_seconde) per tumbling window."""
    counts = timed(events, ts).groupBy(F.window(ts, f"{minutes} minutes"), route, status).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _bounds(counts, route, status, "n", (F.col("n") / (60 * minutes)).alias("par_seconde"))


def sustained_alert(windows: DataFrame, hold: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, debut, fin, n_fenetres): runs of adjoining alert windows at least ``hold`` long.

    A window without traffic breaks a run. Works on finished windows, a few per hour and key.
    """
    alerts = windows.where("alerte")
    if not by:
        alerts, by = alerts.withColumn("_serie", F.lit(0)), ["_serie"]
    order = Window.partitionBy(*by).orderBy("debut")
    breaks = F.coalesce(F.col("debut") > F.lag("fin").over(order), F.lit(True)).cast("int")
    runs = alerts.withColumn("_b", breaks).withColumn("_run", F.sum("_b").over(order))
    return (
        runs.groupBy(*by, "_run")
        .agg(F.min("debut").alias("debut"), F.max("fin").alias("fin"), F.count(F.lit(1)).alias("n_fenetres"))
        .where(F.col("fin") >= F.col("debut") + F.expr(f"INTERVAL {hold}"))
        .drop("_run", "_serie")
    )


def sustained_alert_stream(windows: DataFrame, key: str, hold_seconds: int) -> DataFrame:
    """(key, debut, fin): emitted once per run, when a stream of finished windows holds long enough.

    The state of a key is the run under way: its start, its end, whether it was reported.
    """

    def follow(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        start, end, told = state.get if state.exists else (None, None, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("debut").itertuples():
            opened, closed = row.debut.timestamp(), row.fin.timestamp()
            if not row.alerte:
                start, end, told = None, None, False
                continue
            if start is None or opened > end:
                start, told = opened, False
            end = closed
            if not told and end - start >= hold_seconds:
                told = True
                out.append((group[0], pd.Timestamp(start, unit="s"), pd.Timestamp(end, unit="s")))
        state.update((start if start is not None else -1.0, end if end is not None else -1.0, told))
        if start is None:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "debut", "fin"])

    kind = dict(windows.dtypes)[key]
    return windows.groupBy(key).applyInPandasWithState(
        follow,
        f"{key} {kind}, debut timestamp, fin timestamp",
        "debut double, fin double, dit boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )
