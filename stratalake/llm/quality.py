"""Quality rules with adaptive thresholds: per language and source, from mergeable quantile sketches. Built-in functions only.

Each text gets counts (words, symbols, repeated lines and 3-word windows) and from them four integer features. A
*sketch* of a feature is a histogram of logarithmic buckets (32 to a doubling, so quantiles are right to 1/32):
sketches merge by adding counts, so they are made with map-side sums, and those of small groups fall back on the sum
over their language, or over all. The thresholds are fences beside the quartiles: ``q75 + 3 (q75 - q25) + guard``,
and below for word length. A fence adapts to what is usual in a language and source and, unlike a fixed quantile,
rejects no set share of a clean group.

Defined cases: a null text has no words, hence fails the base rule; null languages and sources form groups of their
own; repeated rows are judged each; columns beyond doc_id, text, lang and source are kept where the caller wants rows
(:func:`keep_good`) and not read elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BASE_MIN_WORDS, BASE_MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Feature -> (numerator, scale, denominator, guard added to the fence, fence below too).
FEATURES = {
    "word_length": ("word_chars", 100, "n_words", 100, True),
    "symbols": ("n_symbols", 1000, "n_words", 50, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 150, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 150, False),
}
MIN_GROUP, REACH = 200, 3


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    The intermediate arrays are columns of their own: a lambda that reads an array twice must find it computed.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = df.columns
    df = df.withColumns({"_w": F.filter(F.split(t, "[ \\t-\\r]+"), lambda x: x != ""), "_l": F.filter(F.split(t, "\\n"), lambda x: x.rlike("[^ \\t-\\r]")), "_t": t})
    hashes = F.when(F.size("_w") >= 3, F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))))
    df = df.withColumn("_h", hashes)
    ordered = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    df = df.withColumn("_s", ordered)
    twice = F.transform("_s", lambda x, i: F.when((x["h"] == F.get("_s", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("_s", F.greatest(i - 1, F.lit(0)))["h"])), x["p"]))
    df = df.withColumn("_p", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_MAX_REPEAT)


def feature(name: str) -> Column:
    over, scale, under, _, _ = FEATURES[name]
    return F.floor(F.try_divide(F.col(over) * scale, F.col(under))).cast("long")


def bucket(v: Column) -> Column:
    """The sketch's bucket: the value itself below 64, from there 32 buckets to each doubling."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise((shift - 1) * 32 + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long") + 32).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor((b - 32) / 32)
    return F.when(b < 64, b).otherwise((b - shift * 32 + 1) * F.pow(F.lit(2.0), shift) - 1).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) over the rows that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(feature(k)).alias("bucket")) for k in FEATURES]))
    rows = counted.where(~base_failed()).select("lang", "source", pairs.alias("x")).select("lang", "source", "x.feature", "x.bucket")
    return rows.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <feature>_low, <feature>_high) for each group, merged upward where it has below min_group rows."""
    cells = sketch.select("lang", "source", "feature", "bucket", "n")
    merged = {
        "group": cells,
        "lang": cells.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n")),
        "all": cells.groupBy("feature", "bucket").agg(F.sum("n").alias("n")),
    }
    keys = {"group": ["lang", "source"], "lang": ["lang"], "all": []}
    out = cells.select("lang", "source").distinct()
    for level, hist in merged.items():
        by = Window.partitionBy(*keys[level], "feature")
        ranked = hist.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bucket"))})
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, bucket_top(F.col("bucket"))))  # noqa: E731, B023
        quart = ranked.groupBy(*keys[level], "feature").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
        wide = quart.groupBy(*keys[level]).agg(
            F.max("total").alias(f"total_{level}"),
            *[F.max(F.when(F.col("feature") == k, F.col(q))).alias(f"{k}_{q}_{level}") for k in FEATURES for q in ("q1", "q3")],
        )
        wide = wide.withColumnsRenamed({k: f"_{k}" for k in keys[level]})
        out = out.join(wide, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[level]], F.lit(True)), "left").drop(*[f"_{k}" for k in keys[level]])
    pick = lambda name: F.when(F.col("total_group") >= min_group, F.col(f"{name}_group")).when(F.col("total_lang") >= min_group, F.col(f"{name}_lang")).otherwise(F.col(f"{name}_all"))
    made = []
    for k, (_, _, _, guard, below) in FEATURES.items():
        q1, q3 = pick(f"{k}_q1"), pick(f"{k}_q3")
        made.append((q3 + REACH * (q3 - q1) + guard).alias(f"{k}_high"))
        made.append((q1 - REACH * (q3 - q1) - guard if below else F.lit(None)).cast("long").alias(f"{k}_low"))
    return out.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *made)


def verdict() -> Column:
    """Whether a row joined with its thresholds is kept."""
    good = ~base_failed()
    for k, (*_, below) in FEATURES.items():
        good = good & (feature(k) <= F.col(f"{k}_high"))
        if below:
            good = good & (feature(k) >= F.col(f"{k}_low"))
    return F.coalesce(good, F.lit(False))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed and kept. limits has a row a group and is a written table: Spark knows its size, and
    splits the partitions of a large group where it is too large to broadcast."""
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": verdict()}).select(*counted.columns, "base_failed", "kept")


def quality_rules(docs: DataFrame, scratch: Scratch, min_group: int = MIN_GROUP) -> DataFrame:
    """The counts and verdict of each (doc_id, text, lang, source) row. A language and source with fewer than min_group
    rows that pass the base rule take the thresholds of the language, one with fewer those of all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counted = scratch.table(with_counts(rows).drop("text"), "counts")
    return judge(counted, scratch.table(thresholds(sketches(counted), min_group), "thresholds"))


def fenced(counted: DataFrame) -> DataFrame:
    """counted with a column that no condition passes: below it the optimizer would put the counts' whole expressions in
    place of their names, and each would be made as often as a condition names it."""
    return counted.withColumn("_fence", F.spark_partition_id()).where("_fence >= 0")


def keep_good(docs: DataFrame, scratch: Scratch, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs that pass, with all their columns as they were.

    The documents are read twice, for the sketches and for the verdicts: only the thresholds are written.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").alias("_text"))
    counted = fenced(with_counts(rows, "_text").drop("_text"))
    limits = scratch.table(thresholds(sketches(counted), min_group), "thresholds")
    return judge(counted, limits).where("kept").select("row.*")
