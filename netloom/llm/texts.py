"""Shared helpers: texts as bytes, per-row Arrow functions, result columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def as_bytes(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.binary()).to_pylist()


def slices(array: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """A batch in small parts, so that only a part of its texts is held as Python objects."""
    for at in range(0, max(len(array), 1), rows):
        yield array.slice(at, rows)


def runs_of_bytes(array: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about ``size`` bytes of text; a longer text stands alone or ends a run."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1).tolist()] if len(sizes) else []
    return zip(starts, np.diff([*starts, len(sizes)]).tolist())


def give_back() -> None:
    """Returns free memory of a Python worker, which lives on after its task, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_function(fn: Callable[[list[bytes | None]], pa.Array], schema: str):
    """Arrow UDF over one text column; ``fn`` gets the texts of a batch as bytes."""

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield fn(as_bytes(batch))
        give_back()

    return run


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those of ``names`` (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in taken]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """Adds the fields of a struct column; input columns of these names give way."""
    kept = others(df, *fields)
    name = free_name(df, "result_of_row")
    return df.select(*kept, result.alias(name)).select(*kept, *[F.col(name)[f].alias(f) for f in fields])


def records(names: list[str], types: list[pa.DataType], columns) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=names)


def frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def streamed(batches: Iterator[pa.RecordBatch], key: int, open_group, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Feeds sorted rows to one open group at a time; the ``key`` leading columns name the group.

    A group's ``feed`` may give out a row at any time, its ``row`` gives the last
    one, or none; so no group is held as a whole.
    """
    group, done = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group is None or group.key != row[:key]:
                if group is not None:
                    done.append(group.row())
                group = open_group(row[:key])
            done.append(group.feed(*row[key:]))
            if len(done) >= 4096:
                yield frame([r for r in done if r is not None], schema)
                done = []
    if group is not None:
        done.append(group.row())
    yield frame([r for r in done if r is not None], schema)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def conversations(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")
