"""Command line: check, preview and make a dataset from a JSON config.

    python -m weftline validate config.json [--seed-path data.parquet]
    python -m weftline preview config.json [--rows 10] [--seed-path ...]
    python -m weftline create config.json --rows 1000000 --out hdfs:///data/out [--resume if_possible] [--seed-path ...]
    python -m weftline list

``--resources module:name`` names what a run may call: a ``Resources``, or a function that makes one of the session. The
module is looked for in the working folder too, and may register readers, column kinds, processors and profilers.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from weftline.operators.samplers import SAMPLERS
from weftline.plans.config import Builder, ConfigError, lint
from weftline.plans.engine import PROCESSORS, PROFILERS, Engine, RunConfig, RunError
from weftline.plans.planner import COLUMN_KINDS, Resources
from weftline.sources.seeds import READERS, LocalFileSource


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline", description="Declarative tabular datasets on Spark.")
    steps = out.add_subparsers(dest="step", required=True)
    for name in ("validate", "preview", "create"):
        p = steps.add_parser(name)
        p.add_argument("config")
        p.add_argument("--seed-path", help="a file, or a pattern of files, whose rows are the seeds")
        p.add_argument("--resources", help="module:name of the models, functions and tools")
        if name != "validate":
            p.add_argument("--rows", type=int, default=10)
        if name == "create":
            p.add_argument("--out", required=True)
            p.add_argument("--resume", choices=("never", "always", "if_possible"), default="never")
            p.add_argument("--check", action="store_true", help="ask models, and look for tools, before the run")
    steps.add_parser("list")
    return out


def resources_of(spark: SparkSession, named: str | None) -> Resources | None:
    if not named:
        return None
    module, _, name = named.partition(":")
    if os.getcwd() not in sys.path:
        sys.path.insert(0, os.getcwd())
    try:
        held = getattr(importlib.import_module(module), name or "resources")
    except (ModuleNotFoundError, AttributeError) as e:
        raise ConfigError(f"{named!r} can't be found: {e}") from None
    return held if isinstance(held, Resources) else held(spark)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.step == "list":
        for title, names in (("samplers", SAMPLERS), ("readers", READERS), ("column kinds", COLUMN_KINDS), ("processors", ["drop_columns", "schema_transform", *PROCESSORS]), ("profilers", PROFILERS)):
            print(f"{title}: {', '.join(sorted(names))}")
        return 0
    builder = Builder.from_config(open(a.config, encoding="utf-8").read())
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.seed_path:
        builder.with_seed(LocalFileSource(a.seed_path))
    try:
        resources = resources_of(spark, a.resources)
        if a.step == "validate":
            source = builder.build().seed_config
            found = lint(builder.build(), source.source.read(spark).columns if source else None)
            for f in found:
                print(f"{f.level} {f.kind} {f.column or ''}: {f.message}")
            return int(any(f.level == "ERROR" for f in found))
        engine = Engine(spark, resources, RunConfig(resume=getattr(a, "resume", "never"), check_models=getattr(a, "check", False)))
        if a.step == "preview":
            engine.preview(builder, a.rows).show(a.rows, truncate=False)
        else:
            print(f"{engine.create(builder, a.rows, a.out).count_records()} rows in {a.out}")
    except (ConfigError, RunError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
