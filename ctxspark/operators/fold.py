"""Order-dependent folds over groups of any size: rows are sorted within partitions and streamed past a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, keys: list[str], order: list, needs: list[str], start: Callable[[], dict], step: Callable[[dict, dict], object], out: str, kind: T.DataType) -> DataFrame:
    """df with column `out`: what step(state, row) returns as the rows of a key pass in order; row holds `needs` alone.

    A group is never collected, so its size is bounded by time alone. Rows whose key is null are one group; the other
    columns stay Arrow arrays, so their types and nulls are untouched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: dict = {}
        for batch in batches:
            got = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *needs)]
            for values in zip(*columns, strict=True):
                now = tuple("NaN" if v != v else v for v in values[: len(keys)])
                if now != key:
                    key, state = now, start()
                got.append(step(state, dict(zip(needs, values[len(keys) :], strict=True))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=[*batch.schema.names, out])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(df.columns).mapInArrow(run, schema)


def greedy_fit(budget: int) -> tuple[Callable[[], dict], Callable[[dict, dict], bool]]:
    """Skip-and-continue packing: an item that doesn't fit overflows, smaller ones behind it may still enter. No tokens
    (null) are none."""

    def step(state: dict, row: dict) -> bool:
        tokens = row["tokens"] or 0
        fits = state["used"] + tokens <= budget
        if fits:
            state["used"] += tokens
        return fits

    return lambda: {"used": 0}, step
