"""From a config to one DataFrame plan.

Columns are sorted by what they need and grouped into levels; each level is one
projection, which Catalyst collapses with its neighbours, so a run of samplers
and expressions is a single stage of generated code over a range of row ids.
Rows that fail are marked in the plan and filtered once at the end. A column that
Python makes is one pass over all rows: rows that are skipped or dropped already
go through it beside the others, and its function never sees them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from threading import Thread
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.template import Compiler
from weftline.operators.expressions import DROP, cast_text, skip_flag
from weftline.operators.generate import CallRules, generate_model_column, stand_in
from weftline.operators.gate import Address, FailureWindow, Limit, server
from weftline.operators.people import derived, person, projected, sample_people
from weftline.operators.samplers import Draw, redrawn
from weftline.operators.validate import RemoteRules, validate_code, validate_local, validate_remote
from weftline.plans.config import ColumnConfig, Config, ConfigError
from weftline.sources.media import MediaStore
from weftline.sources.seeds import INDEX, UNIT, HydratedSource, attach, indexed, selected

ROW = "_row_id"
GROUP = "_row_group"


def levels(columns: list[ColumnConfig], given: list[str], constraints: list | None = None) -> list[list[ColumnConfig]]:
    """Columns in levels by their needs; names that nobody makes must be given. A cycle is an error."""
    maker = {x: c.name for c in columns for x in c.side_effects}
    maker |= {c.name: c.name for c in columns}  # a real column wins over a side effect
    needs: dict[str, set[str]] = {}
    for c in columns:
        wanted = [*c.required(), *c.gate(), *(str(k.rhs) for k in constraints or [] if k.target == c.name and k.scalar is None)]
        if unknown := [x for x in wanted if x not in maker and x not in given]:
            raise ConfigError(f"column {c.name!r} needs {unknown[0]!r}, which nothing makes")
        needs[c.name] = {maker[x] for x in wanted if x in maker} - {c.name}
    done: set[str] = set()
    out: list[list[ColumnConfig]] = []
    left = list(columns)
    while left:
        ready = [c for c in left if needs[c.name] <= done]
        if not ready:
            raise ConfigError(f"these columns need each other: {', '.join(sorted(c.name for c in left))}")
        out.append(ready)
        done |= {c.name for c in ready}
        left = [c for c in left if c.name not in done]
    return out


@dataclass
class Resources:
    """What a run may call: model clients by alias, local functions by column name, tools by name, a post for remote validation;
    people by locale, as DataFrames or as the folder that holds ``<locale>.parquet``; makers of column kinds of the caller's own."""

    models: dict[str, Callable] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    tools: dict[str, Callable] = field(default_factory=dict)
    post: Callable | None = None
    people: dict[str, DataFrame] | str | None = None

    def people_of(self, spark: SparkSession, locale: str) -> DataFrame | None:
        if isinstance(self.people, str):
            return spark.read.parquet(f"{self.people.rstrip('/')}/{locale}.parquet")
        return (self.people or {}).get(locale)


#: Makers of column kinds that plugins add: ``maker(df, column, resources, off) -> DataFrame`` with the column added.
COLUMN_KINDS: dict[str, Callable] = {}


def register_column_kind(kind: str, maker: Callable) -> None:
    if kind in COLUMN_KINDS:
        raise ConfigError(f"there is a column kind {kind!r} already")
    COLUMN_KINDS[kind] = maker


class Planner:
    def __init__(self, spark: SparkSession, config: Config, resources: Resources | None = None, buffer_size: int = 1000, rules: CallRules | None = None, remote: RemoteRules | None = None, total: int | None = None) -> None:
        """``total`` is how many rows the whole dataset has, where a plan makes a part of them."""
        self.spark, self.config, self.resources, self.buffer_size = spark, config, resources or Resources(), buffer_size
        self.rules, self.remote, self.total = rules or CallRules(), remote or RemoteRules(), total
        self.media: MediaStore | None = None  # where images go; null: they stay base64 in their cells
        self.gates: dict[str, Address] = {}  # of each model, shared by its columns and all their tasks

    def rows(self, count: int, start: int = 0, groups: list[int] | None = None, width: int = 1) -> DataFrame:
        """Row ids from ``start`` to ``count``, or those of the row groups given, or of blocks of ``width`` row groups each. The list
        stands in the plan, so it is to be bounded (see ``Engine``)."""
        self.total = self.total or count
        if groups is None:
            ids = self.spark.range(start, count).withColumnRenamed("id", ROW)
        else:
            size = self.buffer_size * width
            each = F.array(*map(F.lit, groups)) if groups else F.array(F.lit(0))
            ids = self.spark.range(len(groups) * size)
            ids = ids.select((F.get(each, F.floor(F.col("id") / size).cast("int")).cast("long") * size + F.col("id") % size).alias(ROW)).where(F.col(ROW) < count)
        return ids.withColumn(GROUP, F.floor(F.col(ROW) / self.buffer_size).cast("long"))

    def marked(self, rows: DataFrame, before: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """All columns over the rows, with the reason of dropped rows in ``_drop_reason``. ``before`` acts on what comes first, the
        row ids and seed columns."""
        df = before(self.seeded(rows)).withColumn(DROP, F.lit(None).cast("string"))
        # Samplers that need nothing but samplers and seeds come first. Conditions and constraints among them see what was drawn;
        # all other columns see it converted and rounded.
        by_name = {c.name: c for c in self.config.columns}
        steps, late = levels(self.config.columns, df.columns, self.config.constraints), set()
        for level in steps:
            late |= {c.name for c in level if c.kind != "sampler" or any(x in late or x not in by_name and x not in df.columns for x in self.needs(c))}
        for early in (True, False):
            for level in steps:
                some = [c for c in level if (c.name not in late) == early]
                for c in [c for c in some if self.managed(c)]:
                    df = self.people(df, c)
                if samplers := [c for c in some if c.kind == "sampler" and not self.managed(c)]:
                    df = self.sample(df, samplers)
                    if not early:
                        df = self.finish_samplers(df, samplers)
                if plain := [c for c in some if c.kind == "expression"]:
                    df = self.express(df, plain)
                for c in some:
                    if c.kind not in ("sampler", "expression", "seed"):
                        df = self.generate(df, c)
            if early:
                df = self.finish_samplers(df, [c for c in self.config.columns if c.kind == "sampler" and c.name not in late])
        return df

    def needs(self, c: ColumnConfig) -> list[str]:
        return [*c.required(), *(str(k.rhs) for k in self.config.constraints if k.target == c.name and k.scalar is None)]

    def plan(self, count: int, start: int = 0, groups: list[int] | None = None) -> DataFrame:
        df = self.marked(self.rows(count, start, groups))
        keep = [c for c in df.columns if not c.startswith("_skip_") and c != DROP]
        return df.where(F.col(DROP).isNull()).select(keep)

    # -- steps

    def seeded(self, rows: DataFrame) -> DataFrame:
        s = self.config.seed_config
        if s is None:
            return rows
        if isinstance(s.source, HydratedSource):
            seeds, size = s.source.seeds(self.spark, s.selection, s.order_by)
            return attach(rows, seeds, size, s.strategy, self.config.seed, ROW, INDEX, unit=UNIT).drop(UNIT)
        source = s.source.read(self.spark) if hasattr(s.source, "read") else s.source
        seeds = indexed(source, s.order_by)
        seeds, size = selected(seeds, s.selection, source.count(), INDEX)
        return attach(rows, seeds, size, s.strategy, self.config.seed, ROW, INDEX)

    def draw(self, name: str, attempt: int = 0) -> Draw:
        return Draw(self.config.seed, name, F.col(ROW), attempt)

    def managed(self, c: ColumnConfig) -> bool:
        """Whether a person column is drawn from a managed dataset; ``person_from_faker`` never is."""
        return c.sampler_type == "person" and self.resources.people is not None

    def people(self, df: DataFrame, c: ColumnConfig) -> DataFrame:
        locale = c.params.get("locale", "en_US")
        held = self.resources.people_of(self.spark, locale)
        if held is None:
            raise ConfigError(f"column {c.name!r} needs people of {locale!r}, and there are none")
        fields = projected(held, bool(c.params.get("with_synthetic_personas")), locale)
        key = "uuid" if "uuid" in fields.columns else "_person"
        if key == "_person":  # a name for each person that doesn't depend on how they lie
            fields = fields.withColumn(key, F.md5(F.to_json(F.struct(*fields.columns))))
        made = sample_people(fields, df, c.params, self.config.seed, c.name, key, ROW, self.total)
        return made.withColumn(c.name, derived(F.col(c.name), made.schema[c.name].dataType.fieldNames(), self.draw(c.name))) if locale == "en_US" else made

    def sample(self, df: DataFrame, columns: list[ColumnConfig]) -> DataFrame:
        compiler, made, failed = Compiler(df.schema, self.config.seed, F.col(ROW)), {}, []
        for c in columns:
            if c.sampler_type in ("person", "person_from_faker"):
                made[c.name] = person(c.params, self.draw(c.name))
                continue
            spec, own = c.sampler(), [k for k in self.config.constraints if k.target == c.name]
            made[c.name] = redrawn(spec, self.draw(c.name), own, compiler.condition)
            if own or c.sampler_type == "subcategory":
                failed.append(c.name)
        df = df.withColumns(made)
        for name in failed:
            what = F.concat(F.lit(f"no draw of {name} fits its constraints or parent, row "), F.col(ROW).cast("string"))
            df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(what).cast(df.schema[name].dataType)).otherwise(F.col(name)))
        return df

    def finish_samplers(self, df: DataFrame, columns: list[ColumnConfig]) -> DataFrame:
        """Conversion and rounding, which come after constraints; dates are text from here on."""
        done = {c.name: c.sampler().finished(F.col(c.name)) for c in columns if c.sampler_type not in ("person", "person_from_faker") and (c.convert_to or "decimal_places" in c.params or c.sampler_type in ("datetime", "timedelta"))}
        return df.withColumns(done) if done else df

    def express(self, df: DataFrame, columns: list[ColumnConfig]) -> DataFrame:
        compiler = Compiler(df.schema, self.config.seed, F.col(ROW))
        flags, texts = {}, {}
        for c in columns:
            if c.skip is not None or any(f"_skip_{x}" in df.columns for x in c.required()):
                flags[f"_skip_{c.name}"] = skip_flag(df, c.skip.when if c.skip else None, c.required(), c.propagate_skip)
            texts[f"_text_{c.name}"] = compiler.render(str(c.expr))
        df = df.withColumns(flags | texts)
        values, reason = {}, F.col(DROP)
        for c in columns:
            text = F.col(f"_text_{c.name}")
            value = cast_text(text, c.dtype)
            why = F.when(text.isNull(), f"{c.name}:render").when(F.trim(text) == "", f"{c.name}:empty").when(value.isNull(), f"{c.name}:cast")
            if f"_skip_{c.name}" in flags:
                instead = F.lit(c.skip.value if c.skip else None)
                value = F.when(F.col(f"_skip_{c.name}"), cast_text(instead.cast("string"), c.dtype)).otherwise(value)
                why = F.when(~F.col(f"_skip_{c.name}"), why)
            values[c.name], reason = value, F.coalesce(reason, why)
        # The condition never fails. Marked as not deterministic, it keeps the final filter from being pushed below the
        # projections, where every expression would be computed twice.
        reason = F.when(F.monotonically_increasing_id() >= 0, reason)
        return df.withColumns(values | {DROP: reason}).drop(*texts)

    def generate(self, df: DataFrame, c: ColumnConfig) -> DataFrame:
        """A column that Python makes, in one pass. Rows to be skipped, and rows dropped already, never reach its function."""
        off = F.col(DROP).isNotNull()
        if c.skip is not None or any(f"_skip_{x}" in df.columns for x in c.required()):
            flag = f"_skip_{c.name}"
            df = df.withColumn(flag, skip_flag(df, c.skip.when if c.skip else None, c.required(), c.propagate_skip))
            off = off | F.col(flag)
        return self.made(df.withColumn(OFF, off), c).drop(OFF)

    def made(self, df: DataFrame, c: ColumnConfig) -> DataFrame:
        r, instead = self.resources, c.skip.value if c.skip else None
        if c.kind in COLUMN_KINDS:
            return COLUMN_KINDS[c.kind](df, c, r, OFF)
        if c.kind == "validation":
            if (c.validator or "").startswith("code:"):
                return validate_code(df, c.name, c.target_columns, c.validator.removeprefix("code:"), OFF)
            if c.validator == "remote":
                return validate_remote(df, c.name, c.target_columns, c.params["url"], r.post, c.batch_size, self.remote, OFF)
            return validate_local(df, c.name, c.target_columns, r.functions[c.name], c.params.get("schema", "is_valid boolean"), OFF)
        if c.kind == "custom":
            return custom(df, c, r.functions[c.name], instead)
        parameters = next((m.parameters for m in self.config.models if m.alias == c.model_alias), {})
        c, rules, tools = self.with_tools(c)
        return generate_model_column(df, c, r.models[c.model_alias], self.config.seed, rules, parameters, tools, OFF, instead, self.gate(str(c.model_alias)), self.media)

    def with_tools(self, c: ColumnConfig) -> tuple[ColumnConfig, CallRules, dict[str, Callable]]:
        """A column that names a tool config as one that names its tools, with the config's rules."""
        alias = c.params.get("tool_alias")
        if alias is None:
            return c, self.rules, self.resources.tools
        told = tools_of(self.config, alias)
        names, limit = told.get("allow_tools"), told.get("timeout_sec")
        tools = {n: timed(f, limit) if limit else f for n, f in self.resources.tools.items() if names is None or n in names}
        if lacking := [n for n in names or [] if n not in tools]:
            raise ConfigError(f"column {c.name!r} needs the tool {lacking[0]!r}, which nobody brings")
        params = {k: v for k, v in c.params.items() if k != "tool_alias"} | {"tools": list(tools)}
        return replace(c, params=params), replace(self.rules, tool_budget=told.get("max_tool_call_turns", self.rules.tool_budget)), tools

    def gate(self, alias: str) -> Address:
        """The gate of a model's calls. It stays open as long as the plan may be run; ``close`` ends it."""
        if alias not in self.gates:
            rules = self.rules
            window = FailureWindow(rules.stop_rate, rules.stop_window) if rules.stop_early else None
            self.gates[alias] = server(self.spark).open(Limit(rules.most_calls), window)
        return self.gates[alias]

    def close(self) -> None:
        for address in self.gates.values():
            server(self.spark).close(address)
        self.gates = {}


def tools_of(config: Config, alias: str) -> dict[str, Any]:
    for t in config.tools:
        if t["tool_alias"] == alias:
            return t
    raise ConfigError(f"no tools have the alias {alias!r}")


def timed(tool: Callable, seconds: float) -> Callable:
    """The tool, or that it took too long. Its thread isn't stopped, but nobody waits for it."""

    def run(**arguments: Any) -> Any:
        said: list = []

        def work() -> None:
            try:
                said.append((True, tool(**arguments)))
            except Exception as e:  # the caller raises it
                said.append((False, e))

        thread = Thread(target=work, daemon=True)
        thread.start()
        thread.join(seconds)
        if not said:
            return f"the tool took more than {seconds:g} seconds"
        good, value = said[0]
        if not good:
            raise value
        return value

    return run


#: The column that tells which rows a function is not to see.
OFF = "_off"


def custom(df: DataFrame, c: ColumnConfig, function: Callable, instead: Any = None) -> DataFrame:
    """A function of a row (``params["mode"] == "cell"``) or of a row group's frame. It makes the column and its side effects,
    may not remove columns or rows, and what it makes beyond that is left out. Rows that are off get ``instead``."""
    import pandas as pd

    types = {n: T._parse_datatype_string(t) if isinstance(t, str) else t for n, t in (c.params.get("types") or {}).items()}
    extra = [T.StructField(n, types.get(n, T.StringType())) for n in c.outputs()]
    schema = T.StructType([*df.schema.fields, *extra])

    def of_group(frame: pd.DataFrame) -> pd.DataFrame:
        off = frame[OFF].to_numpy(bool)
        seen = frame[~off]
        given = seen.drop(columns=[x for x in seen.columns if x in (OFF, DROP) or x.startswith("_skip_")])
        if not len(seen):
            got = pd.DataFrame({n: pd.Series(dtype=object) for n in c.outputs()}, index=seen.index)
        elif c.params.get("mode", "cell") == "cell":
            cells = [function(r) for r in given.to_dict("records")]
            got = pd.DataFrame([x if isinstance(x, dict) else {c.name: x} for x in cells], index=seen.index)
        else:
            got = function(given.copy())
            if len(got) != len(seen):
                raise ValueError(f"the function of {c.name!r} changed the number of rows")
            if missing := [n for n in given.columns if n not in got.columns]:
                raise ValueError(f"the function of {c.name!r} left out {', '.join(missing)}")
            got.index = seen.index
        if missing := [n for n in c.outputs() if n not in got.columns]:
            raise ValueError(f"the function of {c.name!r} left out {', '.join(missing)}")
        made = got[c.outputs()].astype(object).reindex(frame.index)
        made.loc[off, c.name] = pd.Series([stand_in(instead, extra[0].dataType)] * int(off.sum()), index=frame.index[off], dtype=object)
        made = made.where(made.notna(), None)
        return pd.concat([frame, made], axis=1)[[f.name for f in schema.fields]]

    if c.params.get("mode", "cell") == "cell":

        def run(frames: Iterator[Any]) -> Iterator[Any]:
            for frame in frames:
                yield of_group(frame)

        return df.mapInPandas(run, schema)
    return df.groupBy(GROUP).applyInPandas(of_group, schema)


__all__ = ["GROUP", "OFF", "ROW", "Column", "Planner", "Resources", "levels", "register_column_kind"]
