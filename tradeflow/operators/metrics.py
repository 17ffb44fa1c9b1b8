"""Histograms, sums and maxima that come out of a pass over the data itself, without another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of the buckets by metric. Fixed values.
BOUNDS = {
    "size_usd": (10, 50, 100, 500, 1_000, 3_000, 10_000, 30_000, 100_000, 300_000, 1_000_000, 10_000_000),
    "odds": (1, 1.5, 2, 3, 5, 10, 25, 50, 100, 1_000),
    "market_p95_ratio": (0.5, 1, 2, 3, 5, 10, 30, 100, 300, 1_000),
    "trader_p95_ratio": (0.5, 1, 1.5, 2, 3, 5, 10, 30, 100),
    "profit_if_win_usd": (1_000, 5_000, 15_000, 50_000, 100_000, 250_000, 1_000_000, 10_000_000),
}


def expressions(metrics: dict[str, Column], bounds: dict[str, tuple] = BOUNDS) -> list[Column]:
    """For each metric: values at most each bound, all values, their sum and maximum. Nulls are no values."""
    out = []
    for name, value in metrics.items():
        v = value.cast("double")
        out += [F.count_if(v <= b).alias(f"{name}|{i}") for i, b in enumerate(bounds[name])]
        out += [F.count(v).alias(f"{name}|n"), F.sum(v).alias(f"{name}|sum"), F.max(v).alias(f"{name}|max")]
    return out


def observed(d: DataFrame, metrics: dict[str, Column], bounds: dict[str, tuple] = BOUNDS, name: str = "histograms") -> tuple[DataFrame, Observation]:
    """d, and what its next action sees of the metrics: `rows` of the observation's `get`. The counts ride on that action."""
    seen = Observation(name)
    return d.observe(seen, *expressions(metrics, bounds)), seen


def streamed(d: DataFrame, metrics: dict[str, Column], bounds: dict[str, tuple] = BOUNDS, name: str = "histograms") -> DataFrame:
    """A stream whose progress reports carry the metrics of each micro-batch under `name`; `total` adds them up."""
    return d.observe(name, *expressions(metrics, bounds))


def total(progress: list, name: str = "histograms") -> dict:
    """The metrics of all micro-batches of a query's progress reports."""
    out: dict = {}
    for p in progress:
        seen = p.observedMetrics.get(name)
        for k, v in (seen.asDict() if seen is not None else {}).items():
            if v is not None:
                out[k] = v if k not in out else max(out[k], v) if k.endswith("|max") else out[k] + v
    return out


def rows(spark: SparkSession, values: dict, bounds: dict[str, tuple] = BOUNDS) -> DataFrame:
    """metric, le (null: no bound), n, and on the last row of a metric its sum and maximum."""
    out = []
    for name, own in bounds.items():
        if f"{name}|n" in values:
            out += [(name, float(b), int(values[f"{name}|{i}"]), None, None) for i, b in enumerate(own)]
            out.append((name, None, int(values[f"{name}|n"]), *[None if (x := values.get(f"{name}|{k}")) is None else float(x) for k in ("sum", "max")]))
    return spark.createDataFrame(out, "metric string, le double, n long, total double, largest double")
