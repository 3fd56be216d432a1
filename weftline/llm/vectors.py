"""Near-duplicate vectors by tiles in the order of their principal components.

Vectors of one label and one width are compared by cosine. A rotation to the
principal axes of all vectors puts most of their length into the leading
coordinates. Equal vectors are one node. Nodes are put in order of their leading
coordinates (interleaved by bits), dealt out by range and cut into tiles of at
most ``TILE``, each a file in the shared folder. Two tiles are compared only if
the boxes of their leading coordinates, and the largest suffix norms, allow a
cosine of the threshold. Within a pair of tiles products are accumulated over the
leading dimensions first; what the rest can add is at most the product of the two
suffix norms, so pairs are dropped at each cut as soon as they cannot reach the
threshold. Where few are left they go on as a list, else as a block.

Rotated products differ from the plain cosine by rounding, so bounds have a margin
of 1e-9, and pairs within it of the threshold are decided by the plain cosine of
the vectors as given, in double precision.

No pair is written. A tile's own links are worked out where the tile is written,
by union-find, so each node carries a local root. A pair of tiles gives, by node,
how many vectors it met and, of the links between local roots, a spanning forest.
A group of thousands of copies in one tile is one local root, and equal vectors
are counted by how many there are.

Equal vectors are found by SHA-256 of label, width and bytes. A hot label is
spread over ranges and tiles; pairs of tiles are dealt out by both.

Defined results: rows whose vector is null, empty, zero, or holds null or
non-finite components, or whose label is null, link with nothing, and neither do
vectors of different widths. Rows of a null id are kept with a null component,
link with nothing and stay (``kept`` is true). Repeated rows are vectors of their
own, linked with each other. Empty tables give no rows. Only id, vector and label
are read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import TempFile, opened
from .parity import components
from .shared import at_exit, flat, materialize, partitions, release, shared_dir, store
from .unionfind import unite

TILE = 2048  # nodes of a tile, and bits 0 to 10 of a node's number
TILE_VALUES = 1 << 22  # a tile of wide vectors has fewer nodes
ROWS = 512  # of a tile that are held against another tile at once
LEADING = 6  # coordinates that order and bound tiles, six bits each
CUTS = (8, 16, 32, 64, 128, 256, 512, 1024)
FEW = 1 / 16  # of a block's pairs, below which they go on as a list
MARGIN = 1e-9
ROTATED = 2048  # wider vectors keep their own axes
WIDTHS = 16  # so many widths get axes of their own
NONE = np.zeros(0, np.int64)
SALT = 64  # tiles of a label that are held against all others of it in one task


class Rows(NamedTuple):
    """A batch's vectors: values on end, each row's width, and whether it can be compared."""

    values: np.ndarray
    ends: np.ndarray
    width: np.ndarray
    good: np.ndarray


def rows_of(column: pa.Array, kind: str) -> Rows:
    column = flat(column)
    width = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = np.asarray(pc.fill_null(flat(column.flatten()), float("nan"))).astype(kind, copy=False)
    ends = np.concatenate([[0], np.cumsum(width)])
    fine, full = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (np.isfinite(values), values != 0))
    return Rows(values, ends, width, (width > 0) & (np.diff(fine) == width) & (np.diff(full) > 0))


def units(block: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    wide = block.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def axes(df: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The principal axes of all comparable vectors of each width, by falling variance, as columns.

    Tasks add up products; their sums are added by row of the matrix, so none is larger than a matrix. The driver
    takes one matrix for each of the ``WIDTHS`` least widths, up to ``ROTATED``.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = rows_of(batch.column("vector"), kind)
            for w in np.unique(rows.width[rows.good]).tolist():
                if w <= ROTATED:
                    at = np.flatnonzero(rows.good & (rows.width == w))
                    unit = units(rows.values[(rows.ends[at][:, None] + np.arange(w))])
                    sums[w] = sums.get(w, 0) + unit.T @ unit
        for w, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w)), pa.array(np.arange(w)), pa.array([r.tobytes() for r in s], pa.binary())], ["width", "i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for w, i, row in zip(*(batch.column(c).to_pylist() for c in ("width", "i", "row")), strict=True):
                sums[w, i] = sums.get((w, i), 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["width", "i", "row"])

    form = "width long, i long, row binary"
    parts = df.mapInArrow(products, form).repartition(partitions(df.sparkSession), "width", "i").mapInArrow(added, form)
    parts = materialize(parts, "products")
    out = {}
    # Any axes give the same result, so widths beyond these may keep their own.
    for r in parts.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").limit(WIDTHS).collect():
        held = parts.where(F.col("width") == r["width"]).orderBy("i").collect()
        matrix = np.stack([np.frombuffer(h["row"]) for h in held])
        out[r["width"]] = np.ascontiguousarray(np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1])
    release(parts)
    return out


def interleaved(leading: np.ndarray) -> np.ndarray:
    """A number whose bits come in turn from the leading coordinates (six bits of each)."""
    steps = np.clip(np.floor((leading + 1) * 32), 0, 63).astype(np.int64)
    out = np.zeros(len(leading), np.int64)
    for bit in range(5, -1, -1):
        for c in range(leading.shape[1]):
            out = out << 1 | (steps[:, c] >> bit & 1)
    return out


class Tile:
    """Nodes of a tile: vectors as given, rotated units, suffix norms at the cuts, counts of copies and local roots."""

    def __init__(self, data: bytes, rotation: np.ndarray | None) -> None:
        held = np.load(io.BytesIO(data))
        self.given, self.copies, self.roots, self.first = held["given"], held["copies"], held["roots"], int(held["first"])
        self.unit = units(self.given)
        if rotation is not None:
            self.unit = self.unit @ rotation
        width = self.unit.shape[1]
        self.cuts = [c for c in CUTS if c < width] + [width]
        rest = np.cumsum(self.unit[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.suffix = {c: np.sqrt(rest[:, c]) if c < width else np.zeros(len(self.unit)) for c in [*self.cuts, min(LEADING, width)]}

    def box(self) -> tuple[list[float], list[float], float]:
        m = min(LEADING, self.unit.shape[1])
        return self.unit[:, :m].min(axis=0).tolist(), self.unit[:, :m].max(axis=0).tolist(), float(self.suffix[m].max(initial=0))


def links(a: Tile, b: Tile, at: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a`` within ``at``, row of ``b``) whose cosine is the threshold or more; of a tile with itself those with row < other."""
    x, least = a.unit[at], threshold - MARGIN
    product, i, j, before = np.zeros((len(x), len(b.unit))), None, None, 0
    own = a is b
    for cut in a.cuts:
        if i is None:
            product += x[:, before:cut] @ b.unit[:, before:cut].T
            good = product + np.outer(a.suffix[cut][at], b.suffix[cut]) >= least
            if own:
                good &= np.arange(at.start, at.start + len(x))[:, None] < np.arange(len(b.unit))
            n = int(np.count_nonzero(good))
            if not n:
                break
            if n <= FEW * good.size or cut == a.cuts[-1]:
                i, j = np.nonzero(good)
                product = product[i, j]
        else:
            product = product + np.einsum("ij,ij->i", x[i, before:cut], b.unit[j, before:cut])
            keep = product + a.suffix[cut][at][i] * b.suffix[cut][j] >= least
            i, j, product = i[keep], j[keep], product[keep]
            if not len(i):
                break
        before = cut
    if i is None or not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = i + at.start
    close = np.flatnonzero(np.abs(product - threshold) <= MARGIN)
    if len(close):
        u, v = a.given[i[close]].astype(np.float64), b.given[j[close]].astype(np.float64)
        plain = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        keep = product >= threshold
        keep[close] = plain >= threshold
        i, j = i[keep], j[keep]
    return i, j


def compare(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors that each node of ``a`` and of ``b`` met in the other tile, and the flat forest over nodes of ``a`` and then of ``b``.
    Of a tile with itself both are counted in the first."""
    n, m, own = len(a.unit), len(b.unit), a is b
    met_a, met_b, parent = np.zeros(n, np.int64), np.zeros(m, np.int64), np.arange(n + (0 if own else m))
    for at in range(0, n, ROWS):
        i, j = links(a, b, slice(at, min(at + ROWS, n)), threshold)
        if len(i):
            met_a += np.bincount(i, b.copies[j], n).astype(np.int64)
            met_b += np.bincount(j, a.copies[i], m).astype(np.int64)
            unite(parent, a.roots[i], b.roots[j] + (0 if own else n))
    return (met_a + met_b, met_b[:0], parent) if own else (met_a, met_b, parent)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of ``df``: its key, n_links, component_id and kept."""
    spark = df.sparkSession
    kind = "<f4" if isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    rotation = spark.sparkContext.broadcast(axes(rows.where("key is not null and label is not null").select("vector"), kind))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, labels, keys = rows_of(batch.column("vector"), kind), batch.column("label").to_pylist(), batch.column("key")
            good = (held.good & np.asarray(keys.is_valid()) & np.asarray(batch.column("label").is_valid())).tolist()
            ends = (held.ends * held.values.itemsize).tolist()
            data = held.values.tobytes()
            given = [data[ends[k] : ends[k + 1]] if g else None for k, g in enumerate(good)]
            names = [hashlib.sha256(b"%d %s" % (len(k := x.encode()), k) + g).digest() if g else None for x, g in zip(labels, given, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.binary()), batch.column("label"), pa.array(given, pa.binary())], ["key", "name", "label", "given"])

    told = rows.mapInArrow(named, "key long, name binary, label string, given binary")
    nodes = told.where("name is not null").groupBy("name").agg(F.first("label").alias("label"), F.first("given").alias("given"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("low"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = rotation.value
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column("given"))).astype(np.int64)
            z = np.zeros(batch.num_rows, np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                unit = units(np.frombuffer(b"".join(batch.column("given").take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1))
                m, turn = min(LEADING, unit.shape[1]), turned.get(unit.shape[1])
                z[at] = interleaved(unit[:, :m] if turn is None else unit @ turn[:, :m])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(z)], [*batch.schema.names, "size", "z"])

    order = ["label", "size", "z", "name"]
    dealt = nodes.mapInArrow(placed, "name binary, label string, given binary, copies long, low long, size long, z long").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    folder = shared_dir(spark, "tiles")
    at_exit(spark, folder)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the tiles of a partition; gives each node with its tile, and what it met in it."""
        part, made, held, at = TaskContext.get().partitionId(), 0, [], None

        def tile() -> pa.RecordBatch:
            first = (part << 22 | made) * TILE
            given = np.frombuffer(b"".join(r["given"] for r in held), kind).reshape(len(held), -1)
            content = {"given": given, "copies": np.array([r["copies"] for r in held]), "first": np.int64(first)}

            def packed(roots: np.ndarray) -> bytes:
                out = io.BytesIO()
                np.savez(out, roots=roots, **content)
                return out.getvalue()

            tile = Tile(packed(np.arange(len(held))), rotation.value.get(given.shape[1]))
            met, _, roots = compare(tile, tile, threshold)
            out = TempFile(folder, f"{part}-{made}.npz")
            out.write(packed(roots))
            out.commit()
            low, high, rest = tile.box()
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(first + np.arange(n)),
                    pa.array([r["name"] for r in held], pa.binary()),
                    *(pa.array([r[c] for r in held], pa.int64()) for c in ("copies", "low")),
                    pa.array(met),
                    pa.array(first + roots),
                    *(pa.array([x] + [None] * (n - 1), t) for x, t in ((f"{part}-{made}.npz", pa.string()), (at[0], pa.string()), (at[1], pa.int64()), (low, pa.list_(pa.float64())), (high, pa.list_(pa.float64())), (rest, pa.float64()))),
                ],
                ["node", "name", "copies", "low", "met", "root", "file", "label", "size", "lows", "highs", "rest"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                where = (r["label"], r["size"])
                if held and (where != at or len(held) >= max(1, min(TILE, TILE_VALUES // (at[1] // np.dtype(kind).itemsize)))):
                    yield tile()
                    held, made = [], made + 1
                at = where
                held.append(r)
        if held:
            yield tile()

    form = "node long, name binary, copies long, low long, met long, root long, file string, label string, size long, lows array<double>, highs array<double>, rest double"
    nodes = materialize(dealt.mapInArrow(tiled, form), "nodes")
    more = materialize(compared(nodes, folder, rotation, threshold), "met")

    edges = nodes.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    roots = components(edges) if not edges.isEmpty() else spark.createDataFrame([], "node long, root long")
    met = more.where("met > 0").groupBy("node").agg(F.sum("met").alias("more"))
    known = nodes.select("node", "name", "copies", "low", "met").join(met, "node", "left").join(roots, "node", "left").where("copies > 1 or met > 0 or more > 0")
    known = materialize(known.select("name", F.coalesce("root", "node").alias("root"), "low", (F.col("copies") - 1 + F.col("met") + F.coalesce("more", F.lit(0))).alias("n_links")), "known")
    release(nodes, more)
    fs, path = store(spark, folder)
    fs.delete(path, True)
    found = known.join(known.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("name", "n_links", "component_id")
    out = told.select("key", "name").join(found, "name", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def compared(nodes: DataFrame, folder: str, rotation, threshold: float) -> DataFrame:  # noqa: ANN001
    """(node, met, other): vectors that nodes met in other tiles, and links that join local roots of two tiles."""
    spark = nodes.sparkSession
    tiles = nodes.where("file is not null").select("node", "file", "label", "size", "lows", "highs", "rest")
    sizes = tiles.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    tiles = tiles.join(sizes, ["label", "size"])
    left = tiles.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    right = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left, right = (t.select("label", "size", "salt", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "file", "lows", "highs", "rest"))) for t, side in ((left, "a"), (right, "b")))
    reach = F.expr(
        "aggregate(zip_with(zip_with(a_lows, a_highs, (l, h) -> struct(l, h)), zip_with(b_lows, b_highs, (l, h) -> struct(l, h)),"
        " (x, y) -> greatest(x.l * y.l, x.l * y.h, x.h * y.l, x.h * y.h)), 0D, (s, x) -> s + x) + a_rest * b_rest"
    )
    pairs = left.join(right, ["label", "size", "salt"]).where((F.col("a_node") < F.col("b_node")) & (reach >= threshold - MARGIN)).select("a_file", "b_file")
    # As many tasks as pairs, within bounds: a row is a name, but stands for millions of products.
    tasks = 4 * partitions(spark)
    pairs = pairs.repartition(tasks, "a_file", F.pmod(F.xxhash64("b_file"), F.lit(8))).sortWithinPartitions("a_file", "b_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        name, tile, met = None, None, None

        def read(file: str) -> Tile:
            with fs.open_input_stream(f"{path}/{file}", compression=None) as f:
                data = f.read()
            width = np.load(io.BytesIO(data))["given"].shape[1]
            return Tile(data, rotation.value.get(width))

        def given(tile: Tile, met: np.ndarray, a: np.ndarray = NONE, b: np.ndarray = NONE) -> pa.RecordBatch:
            some = np.flatnonzero(met)
            other = pa.array(np.concatenate([np.zeros(len(some), np.int64), b]), mask=np.arange(len(some) + len(a)) < len(some))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([tile.first + some, a])), pa.array(np.concatenate([met[some], np.zeros(len(a), np.int64)])), other], ["node", "met", "other"])

        for batch in batches:
            for a, b in zip(batch.column("a_file").to_pylist(), batch.column("b_file").to_pylist(), strict=True):
                if a != name:
                    if tile is not None:
                        yield given(tile, met)
                    name, tile = a, read(a)
                    met = np.zeros(len(tile.unit), np.int64)
                beside = read(b)
                met_a, met_b, parent = compare(tile, beside, threshold)
                met += met_a
                number = np.concatenate([tile.first + np.arange(len(tile.unit)), beside.first + np.arange(len(beside.unit))])
                joined = np.flatnonzero(parent != np.arange(len(parent)))
                yield given(beside, met_b, number[joined], number[parent[joined]])
        if tile is not None:
            yield given(tile, met)

    return pairs.mapInArrow(run, "node long, met long, other long")
