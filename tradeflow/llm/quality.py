"""Quality rules with robust multivariate outliers (operator 9), in DataFrame functions only.

Base rules work on counts of the whole text. The method then estimates, per language and
source, a minimum-covariance-determinant location and scatter of transformed statistics and
rejects texts whose Mahalanobis distance from it is large. Fewer symbols, repeated lines or repeated words
than the group has are no fault: those statistics are taken from the location upwards, before the distance.

At scale: text is read once and becomes one narrow row per document. Each concentration step
is one map-side-combined aggregation over those narrow rows (a histogram of distances per
group whose bins carry sums, so the kept half's moments are running sums over bins); no group is
ever gathered in one task. The group estimates are one row per (lang, source) and are joined
normally, so Spark broadcasts them only while they are small.

Null and empty texts have no words: base_failed is true. Null languages and sources form groups
of their own. Groups with fewer than `min_rows` usable rows use the estimate of all rows. Very long texts are
counted whole. Repeated rows and rows without an id are judged like others, and columns other than id, text and
`by` are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import cut

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

STATS = ["x_len", "x_sym", "x_line", "x_rep"]
#: Least standard deviation of each transformed statistic: a constant statistic must not turn
#: the smallest difference into a rejection. Larger deviations of the kept rows stay as they are; the
#: factors from kept rows to all rows come after it.
LEAST = {"x_len": 0.01, "x_sym": 0.06, "x_line": 0.08, "x_rep": 0.08}
#: Added to the deviations, in squares, so that the factorisation is defined.
FLOOR = dict.fromkeys(STATS, 1e-6)
#: Statistics whose both sides are bad, words can be too long and too short; of the others what lies below the
#: location counts as the location.
BOTH_SIDES = {"x_len"}


def _windows(words: Column, n: Column) -> Column:
    five = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(5)])
    return F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: five(i))).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """Words covered by 5-word windows at the sorted positions `starts`."""
    gaps = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-5).cast("long").alias("last")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(5).cast("long"), p.cast("long") - a["last"])).alias("sum"), p.cast("long").alias("last")),
    )
    return gaps["sum"]


def _sorted_pairs(h: Column) -> Column:
    """(hash, position) of all windows, sorted: windows that occur twice or more are neighbours."""
    return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t)
    d = d.withColumn("_words", F.filter(F.split("_t", SPACE + "+"), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_h", _windows(F.col("_words"), F.size("_words")))
    d = d.withColumn("_dup", F.size(F.array_distinct("_h")) < F.size("_h"))
    # Only texts with a repeated window pay for sorting.
    d = d.withColumn("_pairs", F.when(F.col("_dup"), _sorted_pairs(F.col("_h"))))
    d = d.withColumn(
        "_starts",
        F.when(
            F.col("_dup"),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.col("_pairs"),
                        lambda p, k: (p["h"] == F.get(F.col("_pairs"), k + 1)["h"]) | ((k > 0) & (p["h"] == F.get(F.col("_pairs"), k - 1)["h"])),
                    ),
                    lambda p: p["i"],
                )
            ),
        ),
    )
    d = d.withColumn("n_repeat_words", F.when(F.col("_dup"), _covered(F.col("_starts"))).otherwise(F.lit(0)).cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines)
    return d.select(
        *[c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "n_words",
        F.length(F.regexp_replace("_t", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(F.split("_t", "\n")).cast("long").alias("_n_lines"),
    )


def transformed(d: DataFrame) -> DataFrame:
    """Variance-stabilised statistics: log mean word length, and arcsine roots of shares."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)))))
    n, c = F.col("n_words"), F.col("word_chars")
    return d.select(
        "*",
        F.log(F.greatest(F.lit(0.1), F.coalesce(F.try_divide(c.cast("double"), n.cast("double")), F.lit(0.1)))).alias("x_len"),
        share(F.col("n_symbols"), c).alias("x_sym"),
        share(F.col("n_dup_lines"), F.col("_n_lines")).alias("x_line"),
        share(F.col("n_repeat_words"), n).alias("x_rep"),
    )


# ---------------------------------------------------------------- MCD

SALTS = 32


def consistency(h_share: float, p: int = len(STATS)) -> float:
    """Factor by which the scatter of the nearest h_share of normal rows falls short of that of all: h over the
    chi-squared distribution with p + 2 degrees at the h quantile with p (closed form for even p)."""

    def chi2(q: float, degrees: int) -> float:
        return 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        q = (low + high) / 2
        low, high = (q, high) if chi2(q, p) < h_share else (low, q)
    return h_share / chi2(low, p + 2)


def small_sample(n: Column, h_share: float, p: int = len(STATS)) -> Column:
    """Factor by which the scatter of small groups falls short besides (Pison, Van Aelst and Willems 2002, p > 2)."""

    def share(coefficients: list[tuple]) -> Column:
        (y1, x1), (y2, x2) = [(math.log(-a / p**b), -math.log(q * p * p)) for a, b, q in coefficients]
        slope = (y1 - y2) / (x1 - x2)
        return 1 - math.exp(y1 - slope * x1) / F.pow(n.cast("double"), F.lit(slope))

    half = share([(-1.42764571687802, 1.26263336932151, 2), (-1.06141115981725, 1.28907991440387, 3)])
    most = share([(-0.455179464070565, 1.11192541278794, 2), (-0.294241208320834, 1.09649329149811, 3)])
    f = half + (most - half) * ((h_share - 0.5) / 0.375) if h_share <= 0.875 else most + (1 - most) * ((h_share - 0.875) / 0.125)
    return 1 / F.greatest(f, F.lit(0.25))


PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
SUMS = ["m_n", *[f"s_{i}" for i in range(len(STATS))], *[f"q_{i}_{j}" for i, j in PAIRS]]


def _sums() -> list[Column]:
    """Count, sums and sums of products of STATS: what estimates are made of, and what adds up over parts of a group."""
    sums = ["count(*) AS m_n", *[f"sum({x}) AS s_{i}" for i, x in enumerate(STATS)]]
    return [F.expr(e) for e in [*sums, *[f"sum({STATS[i]} * {STATS[j]}) AS q_{i}_{j}" for i, j in PAIRS]]]


def _estimated(m: DataFrame, keys: list[str], h_share: float = 1.0) -> DataFrame:
    """Location mu_i, lower Cholesky factor l_i_j of the scatter and its log_det, from rows of _sums().
    Each expression may name those before it."""
    scale = small_sample(F.col("m_n") / h_share, h_share) * consistency(h_share) if h_share < 1 else F.lit(1.0)
    parts = [f"s_{i} / m_n AS mu_{i}" for i in range(len(STATS))]
    for i, j in PAIRS:
        c = f"q_{i}_{j} / m_n - mu_{i} * mu_{j}"
        if i == j:
            c = f"greatest({c}, {LEAST[STATS[i]] ** 2!r}D) * _scale + {FLOOR[STATS[i]] ** 2!r}D"
        else:
            c = f"({c}) * _scale"
        c = " - ".join([c, *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
        parts.append(f"sqrt(greatest({c}, 1e-12D)) AS l_{i}_{j}" if i == j else f"({c}) / l_{j}_{j} AS l_{i}_{j}")
    det = " + ".join(f"ln(l_{i}_{i})" for i in range(len(STATS)))
    return m.withColumn("_scale", scale).selectExpr(*keys, "m_n", *parts, f"2 * ({det}) AS log_det")


def _distance(both_sides: bool = True) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[str] = []
    for i, x in enumerate(STATS):
        r = f"({x} - mu_{i})" if both_sides or x in BOTH_SIDES else f"greatest({x} - mu_{i}, 0D)"
        z.append("((" + " - ".join([r, *[f"l_{i}_{k} * {z[k]}" for k in range(i)]]) + f") / l_{i}_{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in z))


def _key(d: DataFrame, cols: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols])


def mcd(d: DataFrame, h_share: float = 0.75, steps: int = 12, grid: int = 64) -> DataFrame:
    """One robust estimate per (grp, start): concentration steps from two starts, of which the
    caller keeps the one with the smaller determinant.

    d has grp and STATS. Each step keeps the h_share of a group's rows that are nearest under
    the current estimate. The cut is found in a histogram of log distances with `grid` bins per
    unit, so it holds at least that share; it is exact to a bin and the same on every run. Steps end when no
    determinant falls any more, at the latest after `steps`.
    """
    # Start 1 is all rows, start 2 the rows inside the group's middle range of every statistic.
    mid = cut(d.groupBy("grp").agg(*[F.percentile_approx(x, F.array(F.lit(0.1), F.lit(0.9)), 1000).alias(f"r_{x}") for x in STATS]))
    e = _near(d, mid)
    inside = F.lit(True)
    for x in STATS:
        inside = inside & F.col(x).between(F.col(f"r_{x}")[0], F.col(f"r_{x}")[1])
    starts = F.when(inside, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    est = cut(_estimated(e.select("grp", *STATS, F.explode(starts).alias("start")).groupBy("grp", "start").agg(*_sums()), ["grp", "start"]))
    for step in range(steps):
        new = cut(_concentrate(d, est, h_share, grid))
        if step:  # the first estimates are of other shares of the rows
            fell = new.join(est.select("grp", "start", F.col("log_det").alias("_old")), ["grp", "start"]).agg(F.max(F.col("_old") - F.col("log_det"))).first()[0]
            if fell is None or fell < 1e-3:
                return new
        est = new
    return est


def _near(d: DataFrame, est: DataFrame) -> DataFrame:
    """d with its group's rows of est. The key is salted: where est is too large to broadcast, a
    group that holds most rows is dealt over SALTS tasks, and sums after it combine map-side."""
    salted = est.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.join(salted, ["grp", "_salt"])


def _concentrate(d: DataFrame, est: DataFrame, h_share: float, grid: int) -> DataFrame:
    """The next estimates. Each bin of the histogram carries its rows' sums, so the running sums up to the
    cut are those of the kept rows: one pass over d a step."""
    bins = F.floor(F.log2(_distance() + 1e-9) * grid).cast("int")
    per = _near(d, est).groupBy("grp", "start", bins.alias("_bin")).agg(*_sums())
    up_to = "(PARTITION BY grp, start ORDER BY _bin ROWS UNBOUNDED PRECEDING)"
    run = per.selectExpr("grp", "start", "_bin", "sum(m_n) OVER (PARTITION BY grp, start) AS _total", *[f"sum({c}) OVER {up_to} AS {c}" for c in SUMS])
    kept = run.where(f"m_n >= ceil(_total * {h_share!r}D)").groupBy("grp", "start").agg(F.expr(f"min_by(struct({', '.join(SUMS)}), _bin) AS _kept"))
    kept = kept.select("grp", "start", "_kept.*")
    return _estimated(kept, ["grp", "start"], h_share)


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source"),
           cutoff: float = 23.5, min_rows: int = 30, h_share: float = 0.75, steps: int = 12) -> DataFrame:
    """One row per document: id, counts, base_failed, distance, outlier, kept.

    cutoff is a squared distance: 23.5 is the 0.9999 quantile of chi-squared with 4 degrees.
    """
    spark_cols = [id_col, *[c for c in by if c in docs.columns]]
    counted = text_counts(docs.select(*spark_cols, text), text).drop(text)
    by_here = [c for c in by if c in docs.columns]
    d = transformed(counted)
    d = d.withColumn("grp", _key(d, by_here) if by_here else F.lit("all"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    d = cut(d.drop(*by_here, "_n_lines"))
    usable = d.where(~F.col("base_failed")).select("grp", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("_salt"), *STATS)
    both = usable.unionByName(usable.withColumn("grp", F.lit("all groups")))
    est = mcd(both, h_share, steps)
    pick = Window.partitionBy("grp").orderBy("log_det", "start")
    est = est.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") == 1).drop("_r", "start", "log_det")
    est = cut(est)
    own = est.where((F.col("grp") != "all groups") & (F.col("m_n") >= min_rows * h_share))
    pooled = est.where(F.col("grp") == "all groups").drop("grp")
    pooled = pooled.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"p_{c}") for c in pooled.columns])
    j = d.join(own, "grp", "left").withColumn("_one", F.lit(1)).join(F.broadcast(pooled), "_one", "left")  # pooled is one row
    cols = [c for c in own.columns if c.startswith(("mu_", "l_"))]
    j = j.select(*d.columns, *[F.coalesce(F.col(c), F.col(f"p_{c}")).alias(c) for c in cols])
    j = j.withColumn("distance", F.coalesce(_distance(both_sides=False), F.lit(0.0)))
    j = j.withColumn("outlier", F.col("distance") > cutoff)
    return j.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance",
    )
