"""Statistics from mergeable sketches: one for each block of a dataset, kept beside its data.

A block's sketches hold counts, extremes and moments, which are exact, a HyperLogLog
sketch for distinct values, a KLL sketch for quantiles of numbers, and the frequent
values of categories. Each is of bounded size whatever the rows. Blocks made later
add theirs and all are merged, so statistics of a dataset that is resumed or extended
never read old blocks again.

Bounds: distinct values lie within 5 % of the truth (three deviations of 2^12
registers), a quantile's rank within 2 % of the one asked for. Categories of at most
``TRACKED`` values have exact counts; with more, a count may be too high by a share
of about 3.5 / ``TRACKED`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.profile import canonical, percent, simple_type

REGISTERS = 12  # as a power of two
QUANTILES = 400
TRACKED = 4096  # frequent values; the sketch holds three quarters of as many exactly


def numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def sketched(df: DataFrame, block: str, categorical: list[str] = ()) -> DataFrame:
    """(block, column_name, ...): a row of sketches for each column of each block. ``df`` is read once."""
    names = [c for c in df.columns if c != block]
    sums: list[Column] = [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, name in enumerate(names):
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        text = canonical(c, t).cast("string")
        sums += [F.count(c).alias(f"held{i}"), F.hll_sketch_agg(text, F.lit(REGISTERS)).alias(f"distinct{i}")]
        fields = [F.lit(name).alias("column_name"), F.lit(simple_type(t)).alias("simple_dtype"), F.col("n"), F.col(f"held{i}").alias("held"), F.col(f"distinct{i}").alias("distinct")]
        x = c.cast("double")
        if numeric(t):
            sums += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"), F.kll_sketch_agg_double(x, F.lit(QUANTILES)).alias(f"quantiles{i}")]
        for k in ("min", "max", "mean", "var"):
            fields.append((F.col(f"{k}{i}") if numeric(t) else F.lit(None).cast("double")).alias(k))
        fields.append((F.col(f"quantiles{i}") if numeric(t) else F.lit(None).cast("binary")).alias("quantiles"))
        frequent = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
        if name in categorical:
            sums.append(F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias(f"frequent{i}"))
            fields.append(F.when(F.col(f"held{i}") > 0, F.col(f"frequent{i}")).cast(frequent).alias("frequent"))
        else:
            fields.append(F.lit(None).cast(frequent).alias("frequent"))
        rows.append(F.struct(*fields))
    return df.groupBy(block).agg(*sums).select(block, F.inline(F.array(*rows)))


def merged(sketches: DataFrame, most: int = 20) -> DataFrame:
    """One row a column of all blocks' sketches: counts and percentages, distinct values, extremes, mean, deviation, median and the
    ``most`` frequent values of categories."""
    moments = F.collect_list(F.when(F.col("mean").isNotNull(), F.struct(F.col("held").cast("double").alias("n"), "mean", "var"))).alias("moments")  # one a block, and blocks are bounded
    sums = sketches.groupBy("column_name").agg(
        F.first("simple_dtype").alias("simple_dtype"),
        F.sum("n").alias("num_records"),
        F.sum(F.col("n") - F.col("held")).alias("num_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("num_unique"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double(F.col("quantiles")).alias("quantiles"),
        F.sum(F.when(F.col("mean").isNotNull(), F.col("held"))).alias("numbers"),
        moments,
    )
    total = lambda f: F.aggregate("moments", F.lit(0.0), lambda s, m: s + f(m))
    sums = sums.withColumn("mean", F.try_divide(total(lambda m: m["n"] * m["mean"]), F.col("numbers")))
    spread = F.aggregate("moments", F.lit(0.0), lambda s, m: s + m["n"] * (m["var"] + (m["mean"] - F.col("mean")) * (m["mean"] - F.col("mean"))))
    sums = sums.withColumn("stddev", F.sqrt(F.try_divide(spread, F.nullif(F.col("numbers") - 1, F.lit(0)))))
    sums = sums.withColumn("median", F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))))
    listed = F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)), F.lit(most))
    top = sketches.where("frequent is not null").groupBy("column_name").agg(listed.alias("x"))
    # Ties in order of the values.
    ordered = F.array_sort("x", lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0))
    top = top.select("column_name", F.transform(ordered, lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("frequent"))
    shares = {"percent_null": percent(F.col("num_null"), F.col("num_records")), "percent_unique": percent(F.col("num_unique"), F.col("num_records"))}
    return sums.withColumns(shares).join(top, "column_name", "left").select("column_name", "simple_dtype", "num_records", "num_null", "num_unique", "percent_null", "percent_unique", "min", "max", "mean", "stddev", "median", "frequent")

