"""What several operators share: table access, word classes, row-wise Arrow stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from drivetrove.session import materialize  # noqa: F401  (re-exported for the operators)

#: Words are runs of anything but these; as bytes they are what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast; a missing one is NULL. Extra columns can't clash with later names."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def held_out(doc_id: str, folds: int) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder; a NULL id counts as the text ``''``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column; NULL is the empty text."""
    return [x or "" for x in column.to_pylist()]


def map_texts(df: DataFrame, column: str, make: Callable[[list[str]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Adds the columns of ``schema`` that ``make`` derives from the texts of a batch; rows stay where they are."""
    full = T.StructType([*df.schema.fields, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
        for batch in batches:
            for part in small_batches(batch, column):
                made = make(texts(part.column(column)))
                new = [pa.array(made[k], kinds[k]) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *kinds])

    return df.mapInArrow(run, full)


def change_rows(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Filters or rewrites whole rows batch by batch; every column keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (change(part) for part in small_batches(batch, "text"))

    return df.mapInArrow(run, df.schema)


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that a worker's memory stays bounded."""
    if batch.num_rows == 0:
        yield batch
        return
    step = max(1, int(batch.num_rows * limit / max(1, batch.column(column).nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
