"""URL filter with gradient-boosted trees on lexical features (operator 4), in DataFrame functions only.

Rules decide first: a rule (host, path) fits its host and all subdomains where the path starts
with the rule's, and the longest fitting rule wins. For the rest a gradient-boosted tree model
judges lexical features: lengths, depth, digit ratio, entropy, parameter counts and suffix
statistics. It is trained on labelled URLs, a bounded sample of them; rules give no labels. Where a crawl has no
labels of its own, `page_labels` derives weak ones from the pages: mostly markup is bad.

At scale: one narrow scan of the url column and no shuffle but for the sample (a top-k by hash,
`sample` rows, whose pages alone are read) and a suffix table of at most `suffixes` rows. Scoring is row by row.

Null urls and urls without `://` have an empty host and path, fit no rule and are scored like others, as are very
long ones. Without labelled rows of both classes every url without a rule is allowed. Repeated rows and
rows without an id are judged like others; columns that are not asked for are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, cut

#: Fixed by the result contract: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

FEATURES = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_params", "f_query_len", "f_entropy", "f_fragment", "f_secure", "f_suffix"]


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(u, pattern, 1)), "path": F.regexp_extract(u, pattern, 2)})


def ruled(d: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest fitting rule (ties: the smaller string)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return d.withColumns({"rule": rule, "rule_verdict": verdict})


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(d: DataFrame, url: str = "url") -> DataFrame:
    """Lexical features of the whole url; all of them are defined for any string."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    d = d.withColumn("_chars", chars)
    n = F.greatest(F.size("_chars"), F.lit(1)).cast("double")

    def part(c):
        p = (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double") / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    entropy = F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda a, c: a + part(c))
    return d.withColumns({
        "f_len": F.length(u).cast("double"), "f_host_len": F.length("host").cast("double"), "f_path_len": F.length("path").cast("double"),
        "f_depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_digits": ratio(digits(u), F.length(u)), "f_host_digits": ratio(digits(F.col("host")), F.length("host")),
        "f_hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
        "f_params": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "f_query_len": F.length(query).cast("double"), "f_entropy": entropy,
        "f_fragment": u.contains("#").cast("double"), "f_secure": u.startswith("https://").cast("double"),
        "_suffix": _suffix(F.col("host")),
    }).drop("_chars")


def page_labels(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: float = 0.66, sample: int = 20_000) -> DataFrame:
    """url, label of the `sample` pages of the smallest url hashes: 1 where less than `least` of the page is text."""
    ids = pages.where(F.col(url).isNotNull()).select(id_col, F.xxhash64(url).alias("_h")).orderBy("_h", id_col).limit(sample).select(id_col).distinct()
    read = pages.select(id_col, url, html).join(F.broadcast(ids), id_col)  # at most `sample` ids
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?s)<[^>]*>", "")
    return read.where(F.length(html) > 0).select(F.col(url).alias("url"), (F.length(text) / F.length(html) < least).cast("double").alias("label"))


def judged(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None,
           sample: int = 20_000, suffixes: int = 10_000, rounds: int = 20, depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and the model's probability of block.

    labelled (url, label 0/1) holds the training urls. At most `sample` of them, those of the smallest url
    hashes, are used; a url with several labels has the largest of them. A suffix's share of blocked urls leaves the row
    itself out in training."""
    d = ruled(parts(pages.select(id_col, url), url), rules)
    if labelled is None:
        verdict = F.coalesce("rule_verdict", F.lit("allow"))
        return d.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.lit(0.0).alias("p_block"))
    known = parts(labelled.select(F.col("url").alias(url), F.col("label").cast("double").alias("label")), url)
    others = [c for c in known.columns if c not in (url, "label")]
    taken = known.groupBy(url).agg(F.max("label").alias("label"), *[F.first(c).alias(c) for c in others])  # the others follow from the url
    taken = taken.orderBy(F.xxhash64(url), url).limit(sample)
    train = cut(lexical(taken, url).drop("host", "path"))
    mean = train.agg(F.avg("label")).first()[0]
    if mean is None or mean in (0.0, 1.0):
        out = d.withColumn("p_block", F.lit(0.0))
    else:
        # Smoothed share of blocked urls of a suffix; the most frequent suffixes of the sample only.
        stats = train.groupBy("_suffix").agg(F.count("*").alias("_n"), F.sum("label").alias("_s"))
        stats = cut(stats.orderBy(F.desc("_n"), "_suffix").limit(suffixes))

        def with_suffix(x: DataFrame, own: Column) -> DataFrame:
            """own: the label of a row that is among the suffix's, null where it is not."""
            others, of_them = F.col("_s") - F.coalesce(own, F.lit(0.0)), F.col("_n") - own.isNotNull().cast("int")
            share = F.coalesce((others + 10 * mean) / (of_them + 10), F.lit(float(mean)))
            return x.join(F.broadcast(stats), "_suffix", "left").withColumn("f_suffix", share).drop("_s", "_n")

        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        fitted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False)
        model = fitted.fit(assembler.transform(with_suffix(train, F.col("label"))).select("features", "label"))
        scored = model.transform(assembler.transform(with_suffix(lexical(d, url), F.lit(None).cast("double"))))
        from pyspark.ml.functions import vector_to_array

        out = scored.withColumn("p_block", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "p_block")
