"""The declaration of a dataset: columns, seeds, constraints and processors, as plain data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from weftline.functions.template import TemplateError, references
from weftline.operators.samplers import SAMPLERS, Constraint, SamplerError, SamplerSpec, SEEDLESS_KINDS


class ConfigError(ValueError):
    pass


@dataclass
class Skip:
    when: str
    value: Any = None


@dataclass
class ColumnConfig:
    """One column. ``kind`` says which of the further fields count."""

    name: str
    kind: str  # sampler, expression, seed, validation, custom, llm-text, llm-code, llm-structured, llm-judge, embedding, image
    drop: bool = False
    skip: Skip | None = None
    propagate_skip: bool = True
    side_effects: list[str] = field(default_factory=list)
    # sampler
    sampler_type: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    conditional_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    convert_to: str | None = None
    # expression
    expr: str | None = None
    dtype: str = "str"
    # validation, custom, embedding
    target_columns: list[str] = field(default_factory=list)
    validator: str | None = None  # code:<language>, local, remote
    batch_size: int = 10
    # models
    prompt: str | None = None
    system_prompt: str | None = None
    model_alias: str | None = None
    code_lang: str | None = None
    output_format: dict[str, Any] | None = None
    scores: list[dict[str, Any]] = field(default_factory=list)

    def required(self) -> list[str]:
        """Columns that must be there before this one: what its templates name, its parents and its targets."""
        out: list[str] = []
        for t in (self.expr, self.prompt, self.system_prompt):
            if t is not None:
                out += references(t)
        out += self.target_columns
        if self.sampler_type == "subcategory":
            out.append(self.params["category"])
        if self.sampler_type == "timedelta":
            out.append(self.params["reference_column_name"])
        for condition in self.conditional_params:
            out += references("{{ " + condition + " }}" if "{{" not in condition else condition)
        return [x for x in dict.fromkeys(out) if x != self.name]

    def gate(self) -> list[str]:
        """Columns that the skip condition names; they come first, but skips don't pass through them."""
        if self.skip is None:
            return []
        return references(self.skip.when if "{{" in self.skip.when else "{{ " + self.skip.when + " }}")

    def outputs(self) -> list[str]:
        return [self.name, *self.side_effects]

    def sampler(self) -> SamplerSpec:
        return SamplerSpec(self.name, str(self.sampler_type), self.params, self.conditional_params, self.convert_to)


@dataclass
class ProcessorConfig:
    name: str
    kind: str  # drop_columns, schema_transform, or one that a plugin registered
    column_names: list[str] = field(default_factory=list)
    template: dict[str, Any] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class SeedConfig:
    source: Any
    strategy: str = "ordered"  # or shuffle
    selection: Any = None
    order_by: list[str] | None = None


@dataclass
class ModelConfig:
    alias: str
    model: str
    parameters: dict[str, Any] = field(default_factory=dict)


@dataclass
class Config:
    columns: list[ColumnConfig]
    constraints: list[Constraint] = field(default_factory=list)
    processors: list[ProcessorConfig] = field(default_factory=list)
    models: list[ModelConfig] = field(default_factory=list)
    tools: list[dict[str, Any]] = field(default_factory=list)
    profilers: list[str | dict[str, Any]] = field(default_factory=list)  # names, or names with parameters
    seed_config: SeedConfig | None = None
    seed: int = 0

    def fingerprint(self) -> str:
        """SHA-256 of what the data depend on. The order of columns counts; that of models doesn't."""
        told = plain(self)
        told.pop("profilers", None)
        told["models"] = sorted(told["models"], key=lambda m: m["alias"])
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(plain(self), indent=1, default=str)


def plain(x: Any) -> Any:
    if is_dataclass(x) and not isinstance(x, type):
        return {k: plain(v) for k, v in ((f.name, getattr(x, f.name)) for f in fields(x))}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x if isinstance(x, (str, int, float, bool, type(None))) else type(x).__name__


def known_only(cls: type, data: dict[str, Any]) -> dict[str, Any]:
    if extra := set(data) - {f.name for f in fields(cls)}:
        raise ConfigError(f"{cls.__name__} has no field {', '.join(sorted(extra))}")
    return data


def config_of(data: dict[str, Any] | str | Path) -> Config:
    """A config from a dictionary, JSON text, or a file of JSON (or of YAML, where its library is installed); unknown fields are
    refused. Seed sources are given apart."""
    if isinstance(data, Path) or isinstance(data, str) and not data.lstrip().startswith("{"):
        path = Path(data)
        data = path.read_text()
        if path.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError:
                raise ConfigError("YAML files need the yaml library") from None
            data = yaml.safe_load(data)
    if isinstance(data, str):
        data = json.loads(data)
    data = dict(known_only(Config, data))
    columns = []
    for c in data.pop("columns", []):
        c = dict(known_only(ColumnConfig, c))
        c["skip"] = Skip(**known_only(Skip, c["skip"])) if c.get("skip") else None
        columns.append(ColumnConfig(**c))
    seed_config = data.pop("seed_config", None)
    return Config(
        columns,
        [Constraint(**known_only(Constraint, c)) for c in data.pop("constraints", [])],
        [ProcessorConfig(**known_only(ProcessorConfig, p)) for p in data.pop("processors", [])],
        [ModelConfig(**known_only(ModelConfig, m)) for m in data.pop("models", [])],
        seed_config=SeedConfig(**known_only(SeedConfig, seed_config)) if seed_config else None,
        **data,
    )


class Builder:
    """Collects a config step by step."""

    def __init__(self, seed: int = 0) -> None:
        self.config = Config([], seed=seed)

    def add_column(self, column: ColumnConfig | None = None, **kwargs: Any) -> Builder:
        column = column or ColumnConfig(**kwargs)
        if any(column.name in c.outputs() for c in self.config.columns):
            raise ConfigError(f"there is a column {column.name!r} already")
        self.config.columns.append(column)
        return self

    def delete_column(self, name: str) -> Builder:
        self.config.columns = [c for c in self.config.columns if c.name != name]
        return self

    def get_column(self, name: str) -> ColumnConfig:
        return next(c for c in self.config.columns if c.name == name)

    def get_columns_of_kind(self, kind: str) -> list[ColumnConfig]:
        return [c for c in self.config.columns if c.kind == kind]

    def add_constraint(self, target: str, operator: str, rhs: float | str) -> Builder:
        self.config.constraints.append(Constraint(target, operator, rhs))
        return self

    def get_constraints(self, target: str) -> list[Constraint]:
        return [c for c in self.config.constraints if c.target == target]

    def delete_constraints(self, target: str) -> Builder:
        self.config.constraints = [c for c in self.config.constraints if c.target != target]
        return self

    def add_processor(self, processor: ProcessorConfig) -> Builder:
        """A processor of the same name is replaced; columns that a drop processor names are marked, and unmarked when it goes."""
        for old in [p for p in self.config.processors if p.name == processor.name]:
            self._mark(old, False)
            self.config.processors.remove(old)
        self.config.processors.append(processor)
        self._mark(processor, True)
        return self

    def _mark(self, processor: ProcessorConfig, drop: bool) -> None:
        for c in self.config.columns if processor.kind == "drop_columns" else []:
            if c.name in processor.column_names:
                c.drop = drop

    def add_model(self, alias: str, model: str, **parameters: Any) -> Builder:
        self.config.models.append(ModelConfig(alias, model, parameters))
        return self

    def delete_model(self, alias: str) -> Builder:
        self.config.models = [m for m in self.config.models if m.alias != alias]
        return self

    def add_tool(self, tool_alias: str, allow_tools: list[str] | None = None, max_tool_call_turns: int = 5, timeout_sec: float | None = None, **more: Any) -> Builder:
        """What columns that name the alias (``params["tool_alias"]``) may ask for: tools by name (all where null), for how many turns,
        and how long one may take. An alias that is there is replaced."""
        if max_tool_call_turns < 1 or timeout_sec is not None and timeout_sec <= 0:
            raise ConfigError("a tool config needs one turn at least, and a time above 0")
        self.config.tools = [t for t in self.config.tools if t["tool_alias"] != tool_alias]
        self.config.tools.append({"tool_alias": tool_alias, "allow_tools": allow_tools, "max_tool_call_turns": max_tool_call_turns, "timeout_sec": timeout_sec} | more)
        return self

    def add_profiler(self, name: str, **params: Any) -> Builder:
        """A profiler of ``Engine.analyze``, with its parameters."""
        self.config.profilers.append({"name": name, **params} if params else name)
        return self

    def with_seed(self, source: Any, strategy: str = "ordered", selection: Any = None, order_by: list[str] | None = None) -> Builder:
        self.config.seed_config = SeedConfig(source, strategy, selection, order_by)
        return self

    def allowed_references(self) -> list[str]:
        return [x for c in self.config.columns for x in c.outputs()]

    def build(self) -> Config:
        return self.config

    @classmethod
    def from_config(cls, data: dict[str, Any] | str | Path | Config) -> Builder:
        out = cls()
        out.config = data if isinstance(data, Config) else config_of(data)
        return out

    def write_config(self, path: str | Path) -> None:
        Path(path).write_text(self.config.to_json())


@dataclass(frozen=True)
class Finding:
    level: str  # ERROR or WARNING
    kind: str
    column: str | None
    message: str


def lint(config: Config, seed_columns: list[str] | None = None) -> list[Finding]:
    """What is wrong or odd with a config, told before anything runs."""
    out: list[Finding] = []
    columns, seeds = {c.name: c for c in config.columns}, list(seed_columns or [])
    known = {x for c in config.columns for x in c.outputs()} | set(seeds)
    add = lambda level, kind, column, message: out.append(Finding(level, kind, column, message))
    if config.columns and all(c.drop for c in config.columns) and not seeds:
        add("ERROR", "all_columns_dropped", None, "every column is dropped")
    for name in set(seeds) & set(columns):
        add("ERROR", "invalid_column", name, "a seed column has the name of a declared column")
    for c in config.columns:
        try:
            needs, gate = c.required(), c.gate()
        except (TemplateError, KeyError) as e:
            add("ERROR", "invalid_reference", c.name, str(e))
            continue
        for x in needs:
            if x not in known:
                add("ERROR", "expression_reference_missing" if c.kind == "expression" else "invalid_reference", c.name, f"no column is named {x!r}")
        for x in gate:
            if x not in known:
                add("ERROR", "skip_reference_missing", c.name, f"the skip condition names {x!r}, which is no column")
        if c.skip is not None and c.kind in ("sampler", "seed"):
            add("ERROR", "skip_on_sampler_seed", c.name, "samplers and seed columns can't be skipped")
        if c.skip is not None and c.name in gate:
            add("ERROR", "invalid_reference", c.name, "a skip condition can't name its own column")
        if c.kind == "sampler":
            if c.sampler_type not in SAMPLERS and c.sampler_type not in SEEDLESS_KINDS:
                add("ERROR", "invalid_column", c.name, f"no sampler is named {c.sampler_type!r}")
            elif c.sampler_type == "subcategory":
                check_subcategory(c, columns, add)
        if c.kind.startswith("llm") or c.kind in ("image", "embedding"):
            if c.model_alias not in {m.alias for m in config.models}:
                add("ERROR", "invalid_model_config", c.name, f"no model has the alias {c.model_alias!r}")
            if (alias := c.params.get("tool_alias")) is not None and alias not in {t["tool_alias"] for t in config.tools}:
                add("ERROR", "invalid_tool_config", c.name, f"no tools have the alias {alias!r}")
            if c.prompt is not None and not needs:
                add("WARNING", "prompt_without_references", c.name, "the prompt names no column, so all rows are alike")
            if c.prompt is not None and "{{" not in c.prompt and "{" in c.prompt:
                add("WARNING", "f_string_syntax", c.name, "single braces aren't a reference")
        if c.kind == "validation" and (c.validator or "").startswith("code:"):
            for x in c.target_columns:
                if x not in columns:
                    add("ERROR", "code_column_missing", c.name, f"no column is named {x!r}")
                elif columns[x].kind not in ("llm-code", "expression"):
                    add("WARNING", "code_column_not_code", c.name, f"{x!r} isn't a code column")
                elif columns[x].code_lang and columns[x].code_lang != c.validator.removeprefix("code:"):
                    add("ERROR", "code_lang_mismatch", c.name, f"{x!r} is written in {columns[x].code_lang}")
        if c.kind == "validation" and c.validator == "local":
            add("WARNING", "local_only_column", c.name, "a local function can't be written to a config file")
    for k in config.constraints:
        target = columns.get(k.target)
        if target is None or target.kind != "sampler":
            add("ERROR", "invalid_reference", k.target, "a constraint's target must be a sampler column")
        if k.scalar is None and columns.get(str(k.rhs), ColumnConfig("", "")).kind != "sampler":
            add("ERROR", "invalid_reference", k.target, f"the constraint's right side {k.rhs!r} is no number and no sampler column")
    return out


def check_subcategory(c: ColumnConfig, columns: dict[str, ColumnConfig], add: Any) -> None:
    parent = columns.get(c.params.get("category"))
    if parent is None or parent.sampler_type != "category":
        add("ERROR", "invalid_column", c.name, "the parent must be a category column")
        return
    values = list(parent.params.get("values", []))
    for p in parent.conditional_params.values():
        values += p.get("values", [])
    if set(map(str, values)) != set(map(str, c.params.get("values", {}))):
        add("ERROR", "invalid_column", c.name, "there must be subcategories for each of the parent's values")


__all__ = ["Builder", "ColumnConfig", "Config", "ConfigError", "Constraint", "Finding", "ModelConfig", "ProcessorConfig", "SamplerError", "SeedConfig", "Skip", "asdict", "config_of", "lint"]
