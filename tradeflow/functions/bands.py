"""Bands, life-cycle and severity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-open bands, lower bound inclusive.
ODDS = [(2, "<2x"), (3, "2-3x"), (5, "3-5x"), (10, "5-10x"), (25, "10-25x"), (100, "25-100x"), (None, "100x+")]
NOTIONAL = [(1_000, "<1k"), (5_000, "1-5k"), (10_000, "5-10k"), (25_000, "10-25k"), (100_000, "25-100k"), (500_000, "100-500k"), (None, "500k+")]
RETURN_PCT = [(0, "<0%"), (10, "0-10%"), (25, "10-25%"), (50, "25-50%"), (100, "50-100%"), (500, "100-500%"), (None, "500%+")]
OWNERSHIP_PCT = [(1, "<1%"), (5, "1-5%"), (10, "5-10%"), (25, "10-25%"), (50, "25-50%"), (None, "50%+")]
VOLATILITY = [(0.01, "very_low"), (0.03, "low"), (0.06, "moderate"), (0.12, "elevated"), (None, "high")]
CALIBRATION = [(0.10, "0-10"), (0.20, "10-20"), (0.30, "20-30"), (0.40, "30-40"), (0.50, "40-50"), (0.70, "50-70"), (None, "70+")]
LIFECYCLE = [(75, "0-75%"), (80, "75-80%"), (85, "80-85%"), (90, "85-90%"), (95, "90-95%")]
SEVERITY_RANK = {"info": 1, "warning": 2, "critical": 3, "hard": 4}
SEVERITY_WEIGHT = {"info": 1.0, "warning": 3.0, "critical": 10.0, "hard": 25.0}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(x, edges, empty_below_zero: bool = True) -> Column:
    x = _col(x)
    out = F.when(x <= 0, "") if empty_below_zero else F.when(F.lit(False), "")
    for top, name in edges:
        out = out.when(x < top, name) if top is not None else out.otherwise(name)
    return out


def odds_band(x) -> Column:
    return band(x, ODDS)


def notional_band(x) -> Column:
    return band(x, NOTIONAL)


def return_band(pct) -> Column:
    return band(pct, RETURN_PCT, empty_below_zero=False)


def return_band_of_price(price) -> Column:
    p = _col(price)
    return F.when((p <= 0) | (p >= 1), "").otherwise(return_band(F.try_divide(100 * (1 - p), p)))


def ownership_band(pct) -> Column:
    return band(pct, OWNERSHIP_PCT)


def volatility_band(sd) -> Column:
    return band(sd, VOLATILITY)


def calibration_band(p) -> Column:
    return band(p, CALIBRATION, empty_below_zero=False)


def lifecycle_band(pct) -> Column:
    x = _col(pct)
    out = F.when(F.lit(False), "")
    for top, name in LIFECYCLE:
        out = out.when(x < top, name)
    return out.when(x <= 100, "95-100%").otherwise("unknown")


def lifecycle_pct(at, start, end, clamp: bool = True) -> Column:
    """Elapsed share of the life in percent; null when a bound is missing or the span is not positive."""
    secs = lambda c: F.unix_micros(_col(c).cast("timestamp")) / F.lit(1_000_000)
    span = secs(end) - secs(start)
    pct = F.when(span > 0, 100 * (secs(at) - secs(start)) / span)
    return F.when(pct.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), pct))) if clamp else pct


def severity_rank(s) -> Column:
    out = F.when(F.lit(False), 0)
    for name, r in SEVERITY_RANK.items():
        out = out.when(_col(s) == name, r)
    return out.otherwise(0)


def severity_weight(s) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, w in SEVERITY_WEIGHT.items():
        out = out.when(_col(s) == name, w)
    return out.otherwise(0.0)


def control_key(*parts) -> Column:
    """Parts joined by |, with _ for empty ones."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(_col(p).cast("string"), F.lit("")), F.lit("_")) for p in parts])
