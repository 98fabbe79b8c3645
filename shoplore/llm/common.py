"""What the operators on texts share: words, folds, column names that do not clash, map-only passes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import shoplore
from shoplore.functions.columns import fresh  # noqa: F401
from shoplore.operators.bitmaps import bitmap_of, split_by  # noqa: F401
from shoplore.session import shared_path
from shoplore.sources.files import create_table_as


@cache
def _package() -> tempfile.TemporaryDirectory:
    """A zip of this package, for as long as the driver lives."""
    folder = tempfile.TemporaryDirectory(prefix="shoplore-code-", ignore_cleanup_errors=True)
    root = Path(shoplore.__file__).resolve().parent
    with zipfile.ZipFile(f"{folder.name}/shoplore.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"shoplore/{path.relative_to(root)}")
    return folder


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Have tasks find this package even where it is not installed; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        context.addPyFile(f"{_package().name}/shoplore.zip")
        _SENT.add(context.applicationId)


def in_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` whose tasks have this package."""
    send_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8. ``bytes.split`` cuts at exactly those six
    characters, while ``str.split`` would cut at every Unicode space."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % folds


def per_text(df: DataFrame, key: str, text: str, fields: Sequence[T.StructField],
             make: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """``key`` and new columns worked out from ``text``, without a shuffle.

    ``make`` runs once per task and returns a function from the texts of a batch to one Arrow
    compatible list or array per field. Only the key, the text and the results pass through Python.
    """
    import pyarrow as pa

    kind = df.schema[key].dataType
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, kind), *fields])
    types = [_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator) -> Iterator:
        work = make()
        for batch in batches:
            for part in pieces(batch):
                found = work(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *[pa.array(x, t) for x, t in zip(found, types)]], names)

    return in_arrow(narrow, run, schema)


def pieces(batch, rows: int = 256, most_bytes: int = 4 << 20) -> Iterator:
    """An Arrow batch in slices of at most ``rows`` rows and about ``most_bytes`` of ``text``, one row at
    least, so that long texts do not pile up."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
        to = max(at + 1, min(at + rows, fits))
        yield batch.slice(at, to - at)
        at = to


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


class Scratch:
    """Tables of one job in the shared checkpoint folder, which go when the job has its result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        return create_table_as(df, self.paths[-1])

    def hand_over(self, df: DataFrame, name: str) -> DataFrame:
        """Keep a table that the result still reads; it is not removed."""
        return create_table_as(df, shared_path(self.spark, name))

    def clear(self) -> None:
        while self.paths:
            removed(self.spark, self.paths.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared checkpoint folder and read it back."""
    return create_table_as(df, shared_path(df.sparkSession, name))


def _arrow_type(kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
