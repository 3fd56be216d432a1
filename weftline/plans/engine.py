"""Runs: create, preview, resume, profile, export, and workflows of several stages.

A dataset is written as Parquet by blocks of row groups, of which there are at most
``MOST_BLOCKS``. Draws depend on row ids alone, so a run that stopped is resumed by
making the blocks that are missing, and a dataset is extended by further ids;
either gives what one run would have given.

The plan is run once: where there is more than one thing to write (dropped columns,
processors' datasets, images' manifest), or processors act on what was made, the made rows are written
to a staging folder first and all else is read from there, so what models answered
is the same everywhere and each call is made once. Why rows were dropped is counted
on the way.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators.expressions import DROP, drop_columns, schema_transform
from weftline.operators.generate import CallRules, health_check
from weftline.operators.profile import distribution_kind, general, judge_distribution, judge_scores, judge_summaries, percent_complete, profile
from weftline.operators.sketches import merged, sketched
from weftline.operators.validate import RemoteRules
from weftline.plans.config import Builder, Config, ConfigError, lint
from weftline.plans.planner import GROUP, ROW, Planner, Resources
from weftline.sources.media import IMAGE_MANIFEST, IMAGES, MediaStore, manifest, swept
from weftline.sources.shared import written

DATA, DROPPED, SIDE, SKETCHES, META, STAGING = "parquet-files", "dropped-columns", "processors-files", "column-sketches", "metadata.json", "_staging"
MOST_BLOCKS = 4096  # folders of a dataset


@dataclass
class RunConfig:
    buffer_size: int = 1000
    resume: str = "never"  # never, always, if_possible
    preserve_dropped: bool = True
    least_rows: float = 0.0  # share of the rows asked for that must be made
    calls: CallRules = field(default_factory=CallRules)
    remote: RemoteRules = field(default_factory=RemoteRules)
    check_models: bool = False  # whether models are asked once before a run
    #: Whether the metadata hold the columns' statistics: "exact" (or true) by a pass over all data, in memory that grows with the
    #: distinct values, or "sketches", in bounded memory from sketches that are kept with each block and merged.
    statistics: bool | str = False


class RunError(RuntimeError):
    pass


class Processor:
    """What a plugin does to a run; each method may return another DataFrame. ``before`` and ``after_batch`` see the rows with their
    row id and group and may not change how many there are; ``after_generation`` sees the finished dataset and may. The last two see
    rows that are written already, so they may read them as often as they like.

    ``before`` acts on the row ids and seed columns, ``after_batch`` on the rows that were made."""

    def __init__(self, name: str, **params: Any) -> None:
        self.name, self.params = name, params

    def before(self, df: DataFrame) -> DataFrame:
        return df

    def after_batch(self, df: DataFrame) -> DataFrame:
        return df

    def after_generation(self, df: DataFrame) -> DataFrame:
        return df

    def acts(self, method: str) -> bool:
        return getattr(type(self), method) is not getattr(Processor, method)


PROCESSORS: dict[str, type[Processor]] = {}


def register_processor(kind: str, processor: type[Processor]) -> None:
    if kind in PROCESSORS or kind in ("schema_transform", "drop_columns"):
        raise ConfigError(f"there is a processor kind {kind!r} already")
    PROCESSORS[kind] = processor


#: What profilers tell of a finished dataset: ``profiler(results, resources, **params)`` gives DataFrames by name.
PROFILERS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def register_profiler(name: str, profiler: Callable[..., dict[str, DataFrame]]) -> None:
    if name in PROFILERS:
        raise ConfigError(f"there is a profiler {name!r} already")
    PROFILERS[name] = profiler


def profile_judges(results: Results, resources: Resources, model_alias: str | None = None, summary_score_sample_size: int | None = 20) -> dict[str, DataFrame]:
    """Of each judge column: how its scores are distributed, and a model's summary of each score, where one is named."""
    data, out = results.spark.read.option("mergeSchema", "true").parquet(f"{results.path}/{DATA}"), {}
    for c in results.config.columns:
        if c.kind == "llm-judge" and c.name in data.columns:
            names = [s["name"] for s in c.scores]
            out[f"judge_scores:{c.name}"] = judge_distribution(judge_scores(data, c.name, names))
            if model_alias is not None and summary_score_sample_size:
                each = [judge_scores(data, c.name, [n], ROW) for n in names]
                told = [x for s in each for x in judge_summaries(s, resources.models[model_alias], summary_score_sample_size).items()]
                out[f"judge_summaries:{c.name}"] = results.spark.createDataFrame(told, "name string, summary string")
    return out


register_profiler("judge_scores", profile_judges)


class Folder:
    """Small files of a dataset, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.jpath = jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.jpath(f"{self.path}/{name}"))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.jpath(f"{self.path}/{name}"))] if self.exists(name) else []

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.jpath(f"{self.path}/{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.jpath(f"{self.path}/{name}"), False)
        self.fs.rename(self.jpath(f"{self.path}/{name}.tmp"), self.jpath(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        return "".join(r["value"] + "\n" for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def joined(self, name: str, head: str, parts: list[str]) -> None:
        """A file of ``head`` and the parts' bytes on end, under its name once it is whole. Bytes pass in small pieces."""
        out = self.fs.create(self.jpath(f"{self.path}/{name}.tmp"), True)
        out.write(bytearray(head.encode()))
        for part in parts:
            held = self.fs.open(self.jpath(f"{self.path}/{part}"))
            self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
            held.close()
        out.close()
        self.fs.delete(self.jpath(f"{self.path}/{name}"), False)
        self.fs.rename(self.jpath(f"{self.path}/{name}.tmp"), self.jpath(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.jpath(f"{self.path}/{name}"), True)


@dataclass
class Results:
    """A finished dataset."""

    spark: SparkSession
    path: str
    config: Config
    metadata: dict[str, Any]

    def load_dataset(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{DATA}").drop(GROUP, ROW)

    def load_dropped(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{DROPPED}").drop(GROUP)

    def load_processor_dataset(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{SIDE}/{name}").drop(GROUP)

    def load_analysis(self, exact: bool = True) -> dict[str, DataFrame]:
        """Statistics; ``exact=False`` estimates what takes unbounded memory, for large datasets."""
        return profile(self.load_dataset(), {c.name: c.sampler_type for c in self.config.columns if c.sampler_type}, exact)

    def count_records(self) -> int:
        return self.load_dataset().count()

    def percent_complete(self) -> float:
        return percent_complete(self.count_records(), self.metadata["target"])

    def load_images(self) -> DataFrame:
        """The image columns' files: path (as cells hold it), length, content."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.path}/{IMAGES}")
        return files.select(F.regexp_extract("path", f"({IMAGES}/[^/]+/[^/]+/[^/]+)$", 1).alias("path"), "length", "content")

    def export(self, path: str) -> None:
        """One file of the kind that the name's end says. Text is written in parts by all tasks, whose bytes are then joined in order,
        with one header; of Parquet, whose files can't be joined so, one task writes all."""
        ext = path.rsplit(".", 1)[-1]
        folder, name = path.rsplit("/", 1)
        data, temp, at, head = self.load_dataset(), f"{path}.parts", Folder(self.spark, folder), ""
        if ext in ("json", "jsonl"):
            data.write.mode("overwrite").json(temp)
        elif ext == "csv":
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in data.dtypes]
            data.select(flat).write.mode("overwrite").csv(temp, header=False)
            head = ",".join('"' + c.replace('"', '\\"') + '"' if any(x in c for x in ',"\n\\') else c for c in data.columns) + "\n"
        elif ext == "parquet":
            data.coalesce(1).write.mode("overwrite").parquet(temp)
        else:
            raise RunError(f"files of kind {ext!r} aren't written")
        parts = sorted(n for n in at.names(f"{name}.parts") if n.startswith("part-"))
        if ext == "parquet":
            at.delete(name)
            at.fs.rename(at.jpath(f"{temp}/{parts[0]}"), at.jpath(path))
        else:
            at.joined(name, head, [f"{name}.parts/{p}" for p in parts])
        at.delete(f"{name}.parts")

    def to_config_builder(self, columns: list[str] | None = None) -> Builder:
        data = self.load_dataset()
        return Builder(self.config.seed).with_seed(data.select(columns) if columns else data)

    def push_to_hub(self, upload: Callable[[str, str], None]) -> None:
        """Hands the dataset's folder and a card to an uploader, which the caller brings."""
        upload(self.path, f"# Dataset\n\n{self.metadata['target']} rows asked for, {self.count_records()} made.\n")


class Engine:
    def __init__(self, spark: SparkSession, resources: Resources | None = None, run_config: RunConfig | None = None) -> None:
        self.spark, self.resources, self.run_config = spark, resources or Resources(), run_config or RunConfig()

    def set_run_config(self, run_config: RunConfig) -> None:
        self.run_config = run_config

    def validate(self, builder: Builder | Config) -> Config:
        config = builder.build() if isinstance(builder, Builder) else builder
        seeds = None
        if config.seed_config is not None:
            source = config.seed_config.source
            seeds = (source.read(self.spark) if hasattr(source, "read") else source).columns
        if wrong := [f for f in lint(config, seeds) if f.level == "ERROR"]:
            raise ConfigError("; ".join(f"{f.column or 'config'}: {f.message}" for f in wrong))
        return config

    def check_models(self) -> dict[str, str | None]:
        """The fault of each model that can't be reached."""
        return health_check(self.resources.models)

    def check_tools(self, config: Config) -> dict[str, str | None]:
        """The fault of each tool config whose tools aren't there."""
        out: dict[str, str | None] = {}
        for t in config.tools:
            lacking = [n for n in t.get("allow_tools") or [] if n not in self.resources.tools]
            out[t["tool_alias"]] = f"nobody brings {', '.join(lacking)}" if lacking else None if self.resources.tools else "there are no tools"
        return out

    def analyze(self, results: Results, exact: bool = True) -> dict[str, DataFrame]:
        """The statistics of a dataset and what the config's profilers tell of it."""
        out = results.load_analysis(exact)
        for p in results.config.profilers:
            params = dict(p) if isinstance(p, dict) else {"name": p}
            name = params.pop("name")
            if name not in PROFILERS:
                raise ConfigError(f"no profiler is named {name!r}")
            out |= PROFILERS[name](results, self.resources, **params)
        return out

    def planner(self, config: Config, total: int | None = None) -> Planner:
        rc = self.run_config
        return Planner(self.spark, config, self.resources, rc.buffer_size, rc.calls, rc.remote, total)

    def preview(self, builder: Builder | Config, count: int = 10) -> DataFrame:
        """The plan over the first rows. Nothing is written, but for rows that processors see, in the shared folder."""
        config = self.validate(builder)
        df = self.made(self.rows(config, self.planner(config), count))
        if any(p.acts("after_batch") or p.acts("after_generation") for p in self.processors(config)):
            df = self.batched(config, written(df, "preview"), lambda x: written(x, "preview"))
        return self.main(config, self.whole(config, df)).drop(ROW, GROUP)

    # -- steps

    @staticmethod
    def processors(config: Config) -> list[Processor]:
        """The plugins' processors; other kinds than those and the two built in are refused."""
        out = []
        for p in config.processors:
            if p.kind in PROCESSORS:
                out.append(PROCESSORS[p.kind](p.name, **p.params))
            elif p.kind not in ("schema_transform", "drop_columns"):
                raise ConfigError(f"no processor is of kind {p.kind!r}")
        return out

    def rows(self, config: Config, planner: Planner, count: int, blocks: list[int] | None = None, width: int = 1) -> DataFrame:
        """All columns with the reasons of dropped rows."""

        def before(df: DataFrame) -> DataFrame:
            for p in self.processors(config):
                df = p.before(df) if p.acts("before") else df
            return df

        return planner.marked(planner.rows(count, groups=blocks, width=width), before)

    @staticmethod
    def made(marked: DataFrame) -> DataFrame:
        """The rows that stay."""
        return marked.where(F.col(DROP).isNull()).select([c for c in marked.columns if not c.startswith("_skip_") and c != DROP])

    def batched(self, config: Config, rows: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """After the processors that act on batches. ``rows`` are written already; what comes of them is written once, and how many
        rows each processor left is told on the way."""
        df, acting, seen = rows, [p for p in self.processors(config) if p.acts("after_batch")], []
        for p in acting:
            df = p.after_batch(df)
            if not {ROW, GROUP} <= set(df.columns):
                raise ConfigError(f"the processor {p.name!r} must leave {ROW} and {GROUP}")
            seen.append(Observation())
            df = df.observe(seen[-1], F.count(F.lit(1)).alias("rows"))
        if not acting:
            return rows
        out, n = write(df), rows.count()  # from Parquet's footers
        for p, told in zip(acting, seen, strict=True):
            if told.get["rows"] != n:
                raise RunError(f"the processor {p.name!r} changed the number of rows")
        return out

    def whole(self, config: Config, df: DataFrame) -> DataFrame:
        """After the processors that act on the finished dataset; where these make rows anew, they are numbered anew too."""
        for p in self.processors(config):
            if p.acts("after_generation"):
                df = p.after_generation(df.drop(ROW, GROUP))
                df = df.select("*", F.monotonically_increasing_id().alias(ROW)).withColumn(GROUP, F.floor(F.col(ROW) / self.run_config.buffer_size).cast("long"))
        return df

    def dropped(self, config: Config, df: DataFrame) -> list[str]:
        marked = [c.name for c in config.columns if c.drop]
        for p in config.processors:
            if p.kind == "drop_columns":
                marked += [c for c in df.columns if c in drop_columns(df, p.column_names)[1].columns and c not in (ROW, GROUP)]
        return list(dict.fromkeys(marked))

    def main(self, config: Config, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped(config, df))

    def finish(self, config: Config, df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        """The main dataset, and the side ones of processors and dropped columns; side ones see all columns."""
        side = {f"{SIDE}/{p.name}": transformed(df, p.template) for p in config.processors if p.kind == "schema_transform"}
        if (marked := self.dropped(config, df)) and self.run_config.preserve_dropped:
            side[DROPPED] = df.select(ROW, GROUP, *marked)
        return self.main(config, df), side

    def create(self, builder: Builder | Config, count: int, path: str) -> Results:
        config, folder, rc = self.validate(builder), Folder(self.spark, path), self.run_config
        if rc.check_models and (faults := {k: v for k, v in self.check_models().items() if v}):
            raise RunError(f"models can't be reached: {faults}")
        if rc.check_models and (faults := {k: v for k, v in self.check_tools(config).items() if v}):
            raise RunError(f"tools aren't there: {faults}")
        acts = any(p.acts("after_generation") for p in self.processors(config))
        groups = -(-count // rc.buffer_size)
        meta: dict[str, Any] = {"target": count, "buffer_size": rc.buffer_size, "fingerprint": config.fingerprint(), "preserve_dropped": rc.preserve_dropped, "groups_of_block": -(-groups // MOST_BLOCKS) or 1, "empty": [], "incomplete": [], "dropped": {}}
        todo, fresh = None, True
        if folder.exists(META) and rc.resume != "never":
            old = json.loads(folder.read(META))
            if all(old[k] == meta[k] for k in ("buffer_size", "fingerprint", "preserve_dropped")) and old["target"] <= count and (not acts or old.get("complete") and old["target"] == count):
                meta |= {k: old.get(k, []) for k in ("groups_of_block", "empty", "incomplete", "dropped")}
                meta["dropped"] = {r: n for r, n in meta["dropped"].items() if not r.endswith(":stopped")}  # those rows are made anew
                todo, fresh = ([] if acts else self.missing(folder, groups, old, meta["groups_of_block"])), False
            elif rc.resume == "always":
                raise RunError("the dataset there was made by another config, or was processed as a whole, and can't be resumed")
        if fresh:
            for name in (DATA, DROPPED, SIDE, SKETCHES, IMAGES, IMAGE_MANIFEST, META, STAGING, f"{STAGING}-batch"):
                folder.delete(name)
        folder.write(META, json.dumps(meta | {"complete": False}))
        wide, pictures = meta["groups_of_block"], [c.name for c in config.columns if c.kind == "image"]
        if todo is None or todo:
            planner = self.planner(config, count)
            planner.media = MediaStore(path.rstrip("/")) if pictures else None
            marked = self.rows(config, planner, count, todo, wide)
            reasons, seen = [f"{c.name}:{why}" for c in config.columns for why in ("render", "empty", "cast", "model", "stopped")], Observation()
            marked = marked.observe(seen, *(F.count_if(F.coalesce(F.col(DROP) == r, F.lit(False))).alias(r) for r in reasons), F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.when(F.endswith(DROP, F.lit(":stopped")), F.floor(F.col(GROUP) / wide))).alias("stopped"))
            df = self.made(marked)
            if acts or pictures or self.processors(config) or len(self.finish(config, df)[1]):
                df = self.staged(df, f"{path.rstrip('/')}/{STAGING}")
                named = manifest(df, pictures, GROUP) if pictures else None
                df = self.batched(config, df, lambda x: self.staged(x, f"{path.rstrip('/')}/{STAGING}-batch"))
                df = self.whole(config, df)
                df = written(df, "processed") if acts else df
            main, side = self.finish(config, df)
            if pictures:
                side[IMAGE_MANIFEST] = named
            for name, out in [*side.items(), (DATA, main)]:  # the main data come last: a block there means that all of it is there
                self.write(out, f"{path.rstrip('/')}/{name}", wide)
            folder.delete(STAGING)
            folder.delete(f"{STAGING}-batch")
            planner.close()
            meta["incomplete"] = bits_of(seen.get["stopped"])
            meta["dropped"] = {r: n for r in reasons if (n := meta["dropped"].get(r, 0) + (seen.get[r] or 0))}
        if pictures and folder.names(IMAGE_MANIFEST):
            # Any run may have left files behind, so the sweep takes place even where no block was missing.
            meta["images"] = swept(self.spark, path.rstrip("/"), pictures, self.spark.read.parquet(f"{path.rstrip('/')}/{IMAGE_MANIFEST}"))
            if meta["images"]["missing"]:
                raise RunError(f"{meta['images']['missing']} images aren't there any more")
        if not acts:
            done = self.blocks(folder, wide)
            meta["empty"] = [b for b in range(-(-groups // wide)) if b not in done and b not in meta["incomplete"]]
        out = Results(self.spark, path.rstrip("/"), config, meta)
        meta |= {"actual": out.count_records() if self.blocks(folder, wide) else 0, "stopped_early": any(r.endswith(":stopped") for r in meta["dropped"])}
        if rc.statistics and meta["actual"]:
            told = self.sketches(config, folder, wide, todo) if rc.statistics == "sketches" else general(out.load_dataset())
            meta |= {"column_statistics": [r.asDict(recursive=True) for r in told.collect()], "estimated": rc.statistics == "sketches"}
        folder.write(META, json.dumps(meta | {"complete": True, "groups": groups}, default=str))
        if count and meta["actual"] < max(1, rc.least_rows * count):
            raise RunError("too few rows were made")
        return out

    def staged(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, path: str, groups_of_block: int) -> None:
        """A folder for each block, named by its first row group."""
        out = df.withColumn(GROUP, F.floor(F.col(GROUP) / groups_of_block).cast("long") * groups_of_block)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GROUP).parquet(path)

    def sketches(self, config: Config, folder: Folder, groups_of_block: int, made: list[int] | None) -> DataFrame:
        """Statistics from all blocks' sketches. Those of blocks just ``made`` (all where null), or that have none yet, are worked
        out; other blocks' data aren't read."""
        path = f"{folder.path}/{SKETCHES}"
        have = {int(n.split("=")[1]) // groups_of_block for n in folder.names(SKETCHES) if n.startswith(f"{GROUP}=")}
        blocks = self.blocks(folder, groups_of_block)
        todo = blocks if made is None else blocks & (set(made) | (blocks - have))
        if todo:
            data = self.spark.read.option("mergeSchema", "true").parquet(f"{folder.path}/{DATA}").drop(ROW)
            data = data.where(F.col(GROUP).isin([b * groups_of_block for b in todo])) if todo != blocks else data
            categories = [c.name for c in config.columns if distribution_kind(c.sampler_type) == "categorical"]
            sketched(data, GROUP, categories).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GROUP).parquet(path)
        return merged(self.spark.read.parquet(path))

    def blocks(self, folder: Folder, groups_of_block: int) -> set[int]:
        return {int(n.split("=")[1]) // groups_of_block for n in folder.names(DATA) if n.startswith(f"{GROUP}=")}

    def missing(self, folder: Folder, groups: int, old: dict[str, Any], groups_of_block: int) -> list[int]:
        """Blocks that aren't there and weren't found empty, those in which a run stopped calling models, and the last one of a
        shorter run if it wasn't full."""
        done = (self.blocks(folder, groups_of_block) | set(old["empty"])) - set(old.get("incomplete", []))
        if old["target"] % (width := self.run_config.buffer_size * groups_of_block):
            if -(-old["target"] // width) * groups_of_block < groups or old["target"] < groups * self.run_config.buffer_size:
                done.discard(old["target"] // width)
        return [b for b in range(-(-groups // groups_of_block)) if b not in done]


def bits_of(held: bytes | None) -> list[int]:
    """Places of the bits that are set."""
    return [8 * i + k for i, byte in enumerate(held or b"") for k in range(8) if byte >> k & 1]


def transformed(df: DataFrame, template: dict[str, Any]) -> DataFrame:
    """The dataset of a schema transform, with the row groups."""
    made = schema_transform(df.withColumnRenamed(GROUP, "grp__"), template | {"grp__": "{{ grp__ }}"})
    return made.withColumn(GROUP, F.col("grp__").cast("long")).drop("grp__")


@dataclass
class Stage:
    name: str
    builder: Builder
    count: int | None = None
    output: str | None = None  # a processor whose dataset goes on, else the main one
    on_success: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Workflow:
    """Stages on end: each is seeded by what the one before wrote. Stages whose chained fingerprint is unchanged aren't run again."""

    engine: Engine
    path: str
    stages: list[Stage] = field(default_factory=list)
    results: dict[str, Results] = field(default_factory=dict)

    def add_stage(self, name: str, builder: Builder, **kwargs: Any) -> Workflow:
        if any(s.name == name for s in self.stages):
            raise ConfigError(f"there is a stage {name!r} already")
        self.stages.append(Stage(name, builder, **kwargs))
        return self

    def run(self, counts: dict[str, int] | None = None, targets: list[str] | None = None, rerun_from: str | None = None) -> dict[str, Results]:
        import hashlib

        chain, previous, again = "", None, False
        last = max((i for i, s in enumerate(self.stages) if not targets or s.name in targets), default=-1)
        for i, stage in enumerate(self.stages[: last + 1]):
            again = again or stage.name == rerun_from
            builder = Builder.from_config(stage.builder.build())
            if previous is not None:
                if previous.isEmpty():
                    break  # nothing to go on with
                builder.with_seed(previous)
            count = (counts or {}).get(stage.name) or stage.count or (previous.count() if previous is not None else 0)
            path = f"{self.path.rstrip('/')}/{i:02d}-{stage.name}"
            chain = hashlib.sha256(f"{chain}|{builder.build().fingerprint()}|{count}".encode()).hexdigest()
            folder = Folder(self.engine.spark, path)
            if not again and folder.exists("stage.json") and json.loads(folder.read("stage.json")).get("chain") == chain:
                got = Results(self.engine.spark, path, builder.build(), json.loads(folder.read(META)))
            else:
                again = True
                folder.delete("stage.json")
                got = self.engine.create(builder, count, path)
                folder.write("stage.json", json.dumps({"chain": chain}))
            self.results[stage.name] = got
            previous = got.load_processor_dataset(stage.output) if stage.output else got.load_dataset()
            if stage.on_success is not None:
                previous = stage.on_success(previous)
        return self.results
