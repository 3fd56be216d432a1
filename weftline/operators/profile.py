"""Statistics of a finished dataset: one aggregation for all columns, and one grouped pass for histograms.

Exact statistics keep every distinct value (``general``) and every number (the median) of a column in the aggregation,
and rank all values of a column in one task. For large datasets take ``exact=False``: distinct values and medians are
estimated in bounded memory (HyperLogLog, and percentiles to one part in 10,000), and histograms keep the ``most``
frequent values, which the tasks choose from counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.draws import rank_key, uniform

EPSILON = 1e-8
CATEGORICAL = ("category", "subcategory")
NUMERICAL = ("uniform", "gaussian", "bernoulli", "bernoulli_mixture", "binomial", "poisson", "scipy")


def canonical(c: Column, t: T.DataType) -> Column:
    """A value to count distinct by: containers as text, with the elements of lists sorted."""
    if isinstance(t, T.ArrayType):
        inner = F.transform(c, lambda x: x.cast("string")) if isinstance(t.elementType, T.AtomicType) else F.transform(c, lambda x: F.to_json(F.struct(x)))
        return F.to_json(F.sort_array(inner))
    if isinstance(t, (T.StructType, T.MapType)):
        return F.to_json(c)
    return c


def percent(n: Column, of: Column) -> Column:
    return F.round(100 * n / (of + F.lit(EPSILON)), 2)


def simple_type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"list[{simple_type(t.elementType)}]"
    if isinstance(t, (T.StructType, T.MapType)):
        return "dict"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return {T.TimestampType: "timestamp", T.DateType: "date"}.get(type(t), "string")


def general(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row a column: num_records, num_null, num_unique and their percentages, in one aggregation."""
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    sums = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        sums += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}"), distinct(canonical(F.col(f"`{c}`"), df.schema[c].dataType)).alias(f"unique{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(simple_type(df.schema[c].dataType)).alias("simple_dtype"), F.col("n").alias("num_records"), F.col(f"null{i}").alias("num_null"), F.col(f"unique{i}").alias("num_unique")) for i, c in enumerate(columns)))
    out = df.agg(*sums).select(F.inline(rows))
    return out.withColumns({"percent_null": percent(F.col("num_null"), F.col("num_records")), "percent_unique": percent(F.col("num_unique"), F.col("num_records"))})


def numerical(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """min, max, mean, sample deviation and median of each column, nulls left out, in one aggregation."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_samp, "median": F.median if exact else lambda c: F.percentile_approx(c, 0.5, 10000)}
    sums = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in stats.items()]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{k}{i}").alias(k) for k in stats)) for i, c in enumerate(columns)))
    return df.agg(*sums).select(F.inline(rows))


def categorical(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """column_name, value, n, rank of every value, or of the ``most`` frequent ones, most frequent first (ties by value); all
    columns in one grouped pass. The filter on the rank lets each task keep its own ``most`` before values meet."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def distribution_kind(sampler_type: str | None) -> str:
    return "categorical" if sampler_type in CATEGORICAL else "numerical" if sampler_type in NUMERICAL else "other"


def input_tokens(df: DataFrame, tokens: Column, seed: int = 42, most: int = 1000, key: str = "_row_id") -> DataFrame:
    """mean, median and population deviation over at most ``most`` rows, chosen by a hash of their id."""
    some = df.select(tokens.alias("t"), rank_key(seed, "tokens", F.col(key)).alias("k")).orderBy("k").limit(most)
    return some.agg(F.avg("t").alias("mean"), F.median("t").alias("median"), F.stddev_pop("t").alias("stddev"))


def output_tokens(df: DataFrame, tokens: Column) -> DataFrame:
    return df.agg(F.avg(tokens).alias("mean"), F.median(tokens).alias("median"), F.stddev_samp(tokens).alias("stddev"))


def valid_counts(df: DataFrame, column: str) -> DataFrame:
    """How many rows a validation column passes, and their share."""
    out = df.agg(F.count(F.lit(1)).alias("num_records"), F.count_if(F.coalesce(F.col(column)["is_valid"].cast("boolean"), F.lit(False))).alias("num_valid"))
    return out.withColumn("percent_valid", percent(F.col("num_valid"), F.col("num_records")))


def judge_scores(df: DataFrame, column: str, names: list[str], key: str | None = None) -> DataFrame:
    """name, score, reasoning in long form: one row for each score of each row, with the row's ``key`` as ``row`` where one is named."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(column)[n]["score"].cast("string").alias("score"), F.col(column)[n]["reasoning"].alias("reasoning")) for n in names))
    return df.select(*([F.col(key).alias("row")] if key else []), F.explode(each).alias("x")).select(*(["row"] if key else []), "x.*")


def judge_distribution(scores: DataFrame) -> DataFrame:
    """name, score, n, and is_numerical: whether all of the name's scores are whole numbers."""
    whole = F.every(F.col("score").try_cast("double") == F.rint(F.col("score").try_cast("double")))
    kinds = scores.where("score is not null").groupBy("name").agg(F.coalesce(whole, F.lit(False)).alias("is_numerical"))
    counts = scores.where("score is not null").groupBy("name", "score").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(kinds), "name")


def stratified(scores: DataFrame, n: int, seed: int = 0, key: str = "row", category: str = "score") -> DataFrame:
    """At most ``n`` rows that show the categories: all rows if they are few enough; one of each of the most frequent if
    there are ``n`` categories or more; else a sample weighted by the categories' frequency."""
    counts = scores.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    categories, total = (r := counts.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("t")).first())["k"], r["t"] or 0
    if total <= n:
        return scores
    u = uniform(seed, "stratified", F.col(key))
    if categories >= n:
        top = counts.orderBy(F.col("_n").desc(), category).limit(n)
        return scores.join(F.broadcast(top), category).withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(u, key))).where("_r = 1").drop("_r", "_n")
    weighted = scores.join(F.broadcast(counts), category).withColumn("_w", -F.log(u) / F.col("_n"))
    return weighted.orderBy("_w", key).limit(n).drop("_w", "_n")


def percent_complete(made: int, target: int) -> float:
    return round(100 * made / (target + EPSILON), 2)


def judge_summaries(scores: DataFrame, client: Callable, most: int = 20, seed: int = 0, key: str = "row") -> dict[str, str]:
    """A model's summary of each judge score: of at most ``most`` rows that show its scores, chosen by ``stratified``.

    ``scores`` is in the form of ``judge_scores`` with a row id; no more than the chosen rows come to the driver.
    """
    out = {}
    for (name,) in sorted(scores.select("name").distinct().collect()):
        some = stratified(scores.where(F.col("name") == name), most, seed, key).select("score", "reasoning").orderBy(key).collect()
        told = "\n".join(f"{r['score']}: {r['reasoning']}" for r in some)
        out[name] = client("text", [{"role": "user", "content": f"Sum up what these scores of {name} have in common.\n{told}"}], {})["content"]
    return out


def profile(df: DataFrame, sampler_types: dict[str, str], exact: bool = True, most: int = 1000) -> dict[str, DataFrame]:
    """The statistics of a dataset: general, and by kind of sampler numerical or categorical."""
    kinds = {c: distribution_kind(t) for c, t in sampler_types.items() if c in df.columns}
    out = {"general": general(df, exact=exact)}
    histogram = lambda df, names: categorical(df, names, None if exact else most)
    for kind, f in (("numerical", lambda df, names: numerical(df, names, exact)), ("categorical", histogram)):
        if names := [c for c, k in kinds.items() if k == kind]:
            out[kind] = f(df, names)
    return out
