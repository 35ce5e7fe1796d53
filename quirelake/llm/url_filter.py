"""Allow or block decisions for URLs: rules first, else gradient-boosted trees on lexical features.

DataFrame functions and Spark ML only; the trees are trained on the URLs that
the rules label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FEATURES = ("length", "host_length", "host_labels", "depth", "digit_ratio", "hyphens", "entropy", "params", "has_fragment", "secure", "suffix_rate", "label_rate", "section_rate")


#: Folds of the statistics that the trees are trained with.
FOLDS = 5


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host``, ``path`` and the query string of ``url_col``."""
    rest = F.regexp_extract(url_col, r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.instr(F.col(url_col), "://") > 0, rest).otherwise(F.lit(""))
    return pages.withColumn("_rest", rest).select(
        "*",
        ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1).alias("_query"),
    )


def longest_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits ``host`` and ``path`` as a struct, or null."""
    fits = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        is_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        here = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits = F.when(is_host & F.startswith(F.col("path"), F.lit("/" + path)), here).otherwise(fits)
    return fits


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """Adds lexical columns of the URL; none of them names a rule."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    chars = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    labels = F.split("host", r"\.")
    return df.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(labels).cast("double").alias("host_labels"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        F.size(F.filter(F.split("_query", "&"), lambda p: p != "")).cast("double").alias("params"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(url, F.lit("https")).cast("double").alias("secure"),
        F.element_at(labels, -1).alias("_suffix"),
        F.element_at(labels, 1).alias("_label"),
        F.coalesce(F.get(F.filter(F.split("path", "/"), lambda p: p != ""), F.lit(0)), F.lit("")).alias("_section"),
    )


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    max_train_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    threshold: float = 0.5,
) -> DataFrame:
    """Judge every URL. Returns ``id, url, host, path, rule, verdict, block_score``.

    The longest rule that fits decides; where none fits, the trees do. They
    learn from the distinct URLs that rules label, at most ``max_train_rows``
    of them (the smallest by hash: the fit is bounded, the scoring covers every
    row). Statistics of suffix, first host label and first path part are rates
    of blocked URLs over all labelled rows, smoothed by the overall rate; for a
    URL that trains the trees, over the rows of the other folds (``FOLDS`` by
    hash of the URL), so that no tree sees a URL's own label in its features.

    Edge cases: a null URL, or one without ``://``, has an empty host and path,
    fits no rule and is judged by the trees; with labels of one kind only that
    kind is the verdict of the rest, without labels it is ``allow``; repeated
    rows are judged alike; an empty table gives an empty table; columns not
    named are ignored.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    parts = with_parts(base, "_url").withColumn("_rule", longest_rule(rules))
    rows = lexical(parts, "_url")
    labelled = rows.filter(F.col("_rule").isNotNull()).withColumn("_y", (F.col("_rule.verdict") == "block").cast("double"))
    by_name = [("_suffix", "suffix_rate"), ("_label", "label_rate"), ("_section", "section_rate")]
    # one pass for the labels' totals and the three statistics by fold
    labelled = labelled.withColumn("_fold", F.pmod(F.xxhash64("_url", F.lit("fold")), F.lit(FOLDS)))
    by_fold = cut(
        labelled.select("_y", "_fold", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k, _ in by_name])).alias("_s"))
        .groupBy("_s.kind", "_s.value", "_fold")
        .agg(F.sum("_y").alias("_blocked"), F.count(F.lit(1)).alias("_n"))
    )
    stats = cut(by_fold.groupBy("kind", "value").agg(F.sum("_blocked").alias("_blocked"), F.sum("_n").alias("_n")))
    others = stats.withColumnsRenamed({"_blocked": "_b", "_n": "_m"}).join(by_fold, ["kind", "value"]).select("kind", "value", "_fold", (F.col("_b") - F.col("_blocked")).alias("_blocked"), (F.col("_m") - F.col("_n")).alias("_n"))
    total = stats.filter(F.col("kind") == "_suffix").agg(F.coalesce(F.sum("_blocked"), F.lit(0.0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    prior = total[0] / total[1] if total[1] else 0.0
    if 0 < total[0] < total[1]:

        def rated(df: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
            for kind, name in by_name:
                one = counts.filter(F.col("kind") == kind).select(F.col("value").alias(kind), *keys, ((F.col("_blocked") + 20 * prior) / (F.col("_n") + 20)).alias(name))
                df = df.join(one, [kind, *keys], "left").withColumn(name, F.coalesce(name, F.lit(prior)))
            return df

        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
        sample = labelled.dropDuplicates(["_url"]).orderBy(F.xxhash64("_url"), "_url").limit(max_train_rows)
        model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=7, predictionCol="_p").fit(
            cut(assemble.transform(rated(sample, others, "_fold")).select("_x", "_y").coalesce(8))
        )
        open_rows = rows.filter(F.col("_rule").isNull())
        scored = model.transform(assemble.transform(rated(open_rows, stats))).withColumn("_score", vector_to_array("probability")[1])
    else:
        scored = rows.filter(F.col("_rule").isNull()).withColumn("_score", F.lit(float(prior)))
    keep = ["_id", "_url", "host", "path", "_rule"]
    ruled = parts.filter(F.col("_rule").isNotNull()).select(*keep, (F.col("_rule.verdict") == "block").cast("double").alias("_score"))
    return ruled.unionByName(scored.select(*keep, "_score")).select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("block_score"),
    )
