"""Images of a dataset as files beside it.

A file is named by the SHA-256 of what it holds, so equal images are one file, and
a task that is run again writes the same file or another one, never half of one:
files are written under names of their own and renamed when whole. What an attempt
left behind (images of a lost task, for which the model gave others the second
time, and of rows that were dropped later) is found at commit, as no row of the
manifest names it, and deleted. All of that is done by tasks: each lists a few of
the folders that the names' first digits make.

A task that is still writing when its run is over (a lost executor that lives on)
can leave a file that the next run's sweep takes. Texts that are no base64 or hold
no PNG, JPEG, GIF or WebP are ``MediaError``. Paths are relative to the dataset.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES, IMAGE_MANIFEST = "images", "images-manifest"
DIGITS = 3  # of a name, that make its folder
#: How files of each format begin: fixed values.
STARTS = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"))


class MediaError(ValueError):
    pass


def image_of(text: str) -> tuple[bytes, str]:
    """The image that base64 text, or a data URI, holds, and its format."""
    try:
        held = base64.b64decode("".join((text.partition(",")[2] if text.startswith("data:") else text).split()), validate=True)
    except (AttributeError, ValueError, binascii.Error):
        raise MediaError("the image isn't base64") from None
    for start, name in STARTS:
        if held.startswith(start):
            return held, name
    if held[:4] == b"RIFF" and held[8:12] == b"WEBP":
        return held, "webp"
    raise MediaError("the image is of no known format")


@functools.cache
def opened(root: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(root)
    return fs, at.rstrip("/")


def folder_of(column: str) -> str:
    """A column's folder; its name can't leave the dataset."""
    return f"{IMAGES}/{quote(column, safe='').replace('.', '%2E')}"


@dataclass(frozen=True)
class MediaStore:
    root: str  # the dataset's folder

    def save(self, text: str, column: str) -> str:
        """Writes the image, unless it is there, and gives its path."""
        (held, kind), (fs, at) = image_of(text), opened(self.root)
        digest = hashlib.sha256(held).hexdigest()
        folder = f"{folder_of(column)}/{digest[:DIGITS]}"
        path = f"{folder}/{digest}.{kind}"
        there = fs.get_file_info(f"{at}/{path}")
        if there.type == pafs.FileType.File and there.size == len(held):
            return path
        fs.create_dir(f"{at}/{folder}", recursive=True)
        temp = f"{at}/{folder}/.{digest}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as out:
            out.write(held)
        try:
            fs.move(temp, f"{at}/{path}")
        except OSError:  # where names can't be taken over: another task's file holds the same
            if fs.get_file_info(f"{at}/{path}").size != len(held):
                raise
        return path

    def load(self, path: str) -> tuple[str, str]:
        """An image as base64, and its format."""
        if not re.fullmatch(rf"{IMAGES}/[^/]+/[0-9a-f]{{{DIGITS}}}/[0-9a-f]{{64}}\.\w+", path):
            raise MediaError(f"{path!r} isn't an image of the dataset")
        fs, at = opened(self.root)
        try:
            with fs.open_input_stream(f"{at}/{path}") as f:
                return base64.b64encode(f.read()).decode(), path.rsplit(".", 1)[1]
        except FileNotFoundError:
            raise MediaError(f"there is no image {path!r}") from None


def manifest(df: DataFrame, columns: list[str], block: str) -> DataFrame:
    """Which images the rows of each block name: block, column, path, rows."""

    def told(column: str) -> Column:
        named = F.transform(F.col(column), lambda p: F.struct(F.lit(column).alias("column"), p.alias("path")))
        return F.coalesce(named, F.array().cast("array<struct<column:string,path:string>>"))

    each = df.select(block, F.explode(F.concat(*map(told, columns))).alias("x"))
    own = F.startswith(F.col("x.path"), F.lit(f"{IMAGES}/"))  # what skipped cells hold instead is no path
    return each.where(own).groupBy(block, F.col("x.column").alias("column"), F.col("x.path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def swept(spark: SparkSession, root: str, columns: list[str], named: DataFrame) -> dict[str, int]:
    """Deletes the images that ``named`` doesn't name. Tells how many files stay, their bytes, how many were deleted, and how many
    that are named aren't there."""
    kind = "path string, bytes long, named int"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                got = fs.get_file_info(pafs.FileSelector(f"{at}/{folder}", allow_not_found=True))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{f.base_name}" for f in got], pa.string()), pa.array([f.size for f in got], pa.int64()), pa.array([0] * len(got), pa.int32())], ["path", "bytes", "named"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(root)
        for batch in batches:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("named").to_pylist(), strict=True):
                if not name and fs.get_file_info(f"{at}/{path}").type == pafs.FileType.File:
                    fs.delete_file(f"{at}/{path}")
            yield batch

    every = spark.range(len(columns) << 4 * DIGITS)
    column = F.element_at(F.array(*(F.lit(folder_of(c)) for c in columns)), (F.shiftright("id", 4 * DIGITS) + 1).cast("int"))
    folders = every.select(F.concat(column, F.lit("/"), F.lower(F.lpad(F.hex(F.col("id") % (1 << 4 * DIGITS)), DIGITS, "0"))).alias("folder"))
    files = folders.mapInArrow(listed, kind).unionByName(named.select("path", F.lit(None).cast("long").alias("bytes"), F.lit(1).alias("named")))
    one = files.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("named").alias("named")).mapInArrow(kept, kind)
    there, name = F.col("bytes").isNotNull(), F.col("named") == 1
    told = one.agg(F.count_if(there & name).alias("files"), F.coalesce(F.sum(F.when(name, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(~name).alias("swept"), F.count_if(~there).alias("missing"))
    return told.first().asDict()
