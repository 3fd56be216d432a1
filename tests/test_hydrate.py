"""Seeds that a function makes from the rows of a manifest."""

import pytest
from pyspark.sql import functions as F

from weftline.plans.config import Builder
from weftline.plans.engine import Engine
from weftline.plans.planner import Planner
from weftline.sources.seeds import DirectorySource, HydratedSource, IndexRange, PartitionBlock


def parts():
    return lambda row: [{"n": row["n"], "k": k, "words": ["w"] * k} for k in range(row["n"] % 3 + 1)]


SCHEMA = "n long, k long, words array<string>"


def manifest(spark, n=10):
    return spark.range(n).withColumnRenamed("id", "n").withColumn("path", F.lit("p"))


def planned(spark, source, count, **how):
    b = Builder(5).with_seed(source, order_by=["n"], **how).add_column(name="v", kind="expression", expr="{{ n }}-{{ k }}")
    return [r.v for r in Planner(spark, b.build()).plan(count).orderBy("_row_id").collect()]


def test_selection_is_of_the_manifest(spark):
    source = HydratedSource(manifest(spark), parts(), SCHEMA)
    assert planned(spark, source, 8, selection=IndexRange(4, 6)) == ["4-0", "4-1", "5-0", "5-1", "5-2", "6-0", "4-0", "4-1"]
    assert planned(spark, source, 4, selection=PartitionBlock(2, 3)) == ["6-0", "7-0", "7-1", "8-0"]


def test_a_shuffle_keeps_a_manifest_rows_parts_together(spark):
    source = HydratedSource(manifest(spark), parts(), SCHEMA)
    total = sum(n % 3 + 1 for n in range(10))
    got = planned(spark, source, 2 * total, strategy="shuffle")
    orders = []
    for half in (got[:total], got[total:]):
        seen = []
        for v in half:
            n, k = map(int, v.split("-"))
            assert (k == 0 and n not in seen) or (n == seen[-1] and k == last + 1)
            seen, last = seen + [n] * (k == 0), k
        assert sorted(seen) == list(range(10))
        orders.append(seen)
    assert orders[0] != orders[1] and orders[0] != sorted(orders[0])


def test_without_a_schema_rows_are_the_manifest_s(spark):
    source = HydratedSource(manifest(spark), lambda r: r | {"path": f"{r['path']}{r['n']}"})
    assert source.read(spark).columns == ["n", "path"]
    b = Builder(1).with_seed(source, order_by=["n"]).add_column(name="v", kind="expression", expr="{{ path }}")
    assert sorted(r.v for r in Planner(spark, b.build()).plan(3).collect()) == ["p0", "p1", "p2"]


def test_files_are_read_for_the_chosen_alone(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.txt").write_text("\n".join(f"line {i}.{k}" for k in range(i + 1)))
    log = tmp_path / "log"
    log.mkdir()

    def lines(row):
        (log / row["file_name"]).write_text("")
        with open(row["source_path"].removeprefix("file:")) as f:
            return [{"file": row["file_name"], "line": x.rstrip("\n")} for x in f]

    source = HydratedSource(DirectorySource(str(tmp_path), "*.txt"), lines, "file string, line string")
    b = Builder(1).with_seed(source, selection=IndexRange(2, 3), order_by=["relative_path"]).add_column(name="v", kind="expression", expr="{{ file }} {{ line }}")
    made = Engine(spark).create(b, 7, f"{tmp_path}/set").load_dataset()
    assert sorted(r.v for r in made.collect()) == [f"f{i}.txt line {i}.{k}" for i in (2, 3) for k in range(i + 1)]
    assert sorted(p.name for p in log.iterdir()) == ["f2.txt", "f3.txt"]


def test_rows_of_other_columns_are_refused(spark):
    source = HydratedSource(manifest(spark, 2), lambda r: [{"n": 1}], SCHEMA)
    with pytest.raises(Exception, match="hydrated rows must have"):
        planned(spark, source, 1)
    with pytest.raises(Exception, match="no rows"):
        planned(spark, HydratedSource(manifest(spark, 2), lambda r: [], SCHEMA), 1)
