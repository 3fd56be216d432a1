"""Expression columns, casts, dropped rows, skipped cells, and processors over whole datasets."""

from __future__ import annotations

import fnmatch
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.template import Compiler, json_escaped

DROP = "_drop_reason"


def cast_text(c: Column, dtype: str) -> Column:
    """Text to int (through a float, truncated), float, bool (a number that isn't 0, else ``true`` in any case) or str; null where it fails."""
    number = F.trim(c).try_cast("double")
    if dtype == "int":
        return F.when(~F.isnan(number), number.try_cast("long"))
    if dtype == "float":
        return number
    if dtype == "bool":
        return F.coalesce(number.try_cast("long") != 0, F.lower(F.trim(c)) == "true")
    if dtype == "str":
        return c
    raise ValueError(f"no dtype is named {dtype!r}")


def expression(df: DataFrame, name: str, template: str, dtype: str = "str", seed: int = 0, row: Column | None = None) -> DataFrame:
    """Adds the rendered column and marks in ``_drop_reason`` the rows where rendering failed, gave no text, or can't be cast."""
    shown = Compiler(df.schema, seed, row).render(template)
    out = df.withColumn("_text", shown)
    text = F.col("_text")
    value = cast_text(text, dtype)
    reason = F.when(text.isNull(), "render").when(F.trim(text) == "", "empty").when(value.isNull(), "cast")
    held = F.col(DROP) if DROP in df.columns else F.lit(None).cast("string")
    return out.withColumns({name: value, DROP: F.coalesce(held, F.when(reason.isNotNull(), F.concat_ws(":", F.lit(name), reason)))}).drop("_text")


def drop_marked(df: DataFrame) -> DataFrame:
    return df.where(F.col(DROP).isNull()).drop(DROP) if DROP in df.columns else df


def drop_counts(df: DataFrame) -> DataFrame:
    """How many rows each reason dropped, for the run's metadata."""
    return df.where(F.col(DROP).isNotNull()).groupBy(F.col(DROP).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def skip_flag(df: DataFrame, when: str | None, upstream: list[str], propagate: bool = True) -> Column:
    """Whether a cell is skipped: one it requires was skipped, or its condition holds or can't be told."""
    out = F.lit(False)
    for name in upstream if propagate else []:
        if (flag := f"_skip_{name}") in df.columns:
            out = out | F.col(flag)
    if when is not None:
        out = out | F.coalesce(Compiler(df.schema).condition(when), F.lit(True))
    return out


def schema_transform(df: DataFrame, shape: dict[str, Any]) -> DataFrame:
    """A second dataset from a dictionary of templates: nested dictionaries are structs, lists arrays, texts rendered."""
    compiler = Compiler(df.schema)

    def made(x: Any) -> Column:
        if isinstance(x, dict):
            return F.struct(*(made(v).alias(k) for k, v in x.items()))
        if isinstance(x, list):
            return F.array(*map(made, x))
        return compiler.render(x) if isinstance(x, str) else F.lit(x)

    return df.select(*(made(v).alias(k) for k, v in shape.items()))


def as_json_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each value as it stands within JSON text, quotes and backslashes escaped."""
    return df.withColumns({c: json_escaped(F.col(c).cast("string")) for c in columns})


def matching_columns(df: DataFrame, patterns: list[str]) -> list[str]:
    return [c for c in df.columns if any(fnmatch.fnmatchcase(c, p) for p in patterns)]


def drop_columns(df: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rest, the dropped columns (aligned by row id where there is one), and the patterns that matched nothing."""
    names = matching_columns(df, patterns)
    missing = [p for p in patterns if not fnmatch.filter(df.columns, p)]
    keys = [c for c in df.columns if c == "_row_id" and c not in names]
    return df.drop(*names), df.select(*keys, *names), missing
