"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, pruned to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def doc_crc(name: str = "doc_id") -> Column:
    """crc32 of the decimal text of an id (null: null)."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def unit_hash(*columns: Column) -> Column:
    """A double in (0, 1) that depends on the columns only."""
    return ((F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + F.lit(0.5))
            * F.lit(2.0 ** -53))


def release() -> None:
    """Hand memory that a finished task has freed back to the system.  Workers live on and serve later
    stages, and what they keep for themselves adds to what the executor needs then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run: Callable[[Iterator], Iterator], *caches) -> Callable[[Iterator], Iterator]:
    """``run`` as a function of batches that clears ``caches`` and releases memory when its task ends."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            release()

    return tidy


PART_ROWS = 256


def by_parts(function: Callable[..., pa.Array], kind: str, *columns: Column,
             after: Callable[[], None] | None = None) -> Column:
    """``function`` over one or more columns, PART_ROWS rows at a time, as an Arrow
    UDF of the iterator kind: Python objects exist for one part only, however many
    rows Spark sends at once.  ``after`` is called when a task ends."""

    def end() -> None:
        if after is not None:
            after()
        release()

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for whole in batches:
                for at in range(0, max(1, len(whole)), PART_ROWS):
                    yield function(whole.slice(at, PART_ROWS))
                del whole  # before the next is read
        finally:
            end()

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        try:
            for whole in batches:
                for at in range(0, max(1, len(whole[0])), PART_ROWS):
                    yield function(*(c.slice(at, PART_ROWS) for c in whole))
                del whole
        finally:
            end()

    run, given = (one, pa.Array) if len(columns) == 1 else (several, tuple[pa.Array, ...])
    run.__annotations__ = {"batches": Iterator[given], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(*columns)


def each(column: pa.Array) -> Iterator:
    """The values of an Arrow column as Python objects, one at a time."""
    for value in column:
        yield value.as_py()


def slices(batch: pa.RecordBatch, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows, so that Python objects exist for one
    part only."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def running_sums(values: str, block: int = 256) -> Column:
    """Inclusive running sums of an array<bigint> column, as an array.

    Spark has no prefix-sum function, and growing one array by ``aggregate``
    copies it once per element.  Sums are therefore built in blocks whose
    offsets are added afterwards, so a row with k values copies about
    k * block elements instead of k * k / 2."""
    fold = ("aggregate({xs}, named_struct('t', 0L, 's', cast(array() as array<bigint>)), "
            "(a, x) -> named_struct('t', a.t + {v}, 's', concat(a.s, array(a.t + {v}))))")
    blocks = (f"transform(filter(sequence(0, greatest(size({values}) - 1, 0) div {block}), "
              f"b -> size({values}) > 0), "
              f"b -> {fold.format(xs=f'slice({values}, b * {block} + 1, {block})', v='x')})")
    # inner(bs): offset of each block = running sum of the block totals before it
    return F.expr(
        f"flatten(aggregate({blocks}, "
        "named_struct('o', 0L, 'r', cast(array() as array<array<bigint>>)), "
        "(acc, blk) -> named_struct('o', acc.o + blk.t, "
        "'r', concat(acc.r, array(transform(blk.s, y -> y + acc.o))))).r)")
