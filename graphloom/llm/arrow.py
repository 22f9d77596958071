"""Row-wise text work over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Bytes that a function gets at once; larger batches are halved, down to single rows, so memory doesn't grow with the texts.
PIECE_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most PIECE_BYTES or of one row."""
    waiting = [batch]
    while waiting:
        b = waiting.pop()
        if b.num_rows > 1 and b.nbytes > PIECE_BYTES:
            half = b.num_rows // 2
            waiting += [b.slice(half), b.slice(0, half)]
        elif b.num_rows:
            yield b


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a function over batches; ``make`` builds it once per task, so that models load on the executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in it:
            yield from map(f, pieces(batch))

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bounded_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by the hash of their id alone, so the same rows come out of every run.

    The number of rows comes from the files' footers; the choice is a filter, without sorting or shuffling.
    """
    every = max(1, -(-df.count() // bound))
    return df if every == 1 else df.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)
