"""Functions over the rows of one key, called for many keys of a partition without a data frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Names = Sequence[str]


def dealt(df: DataFrame, keys: Names, each: int | None = None) -> DataFrame:
    """df by its keys, in as many partitions as the session has for shuffles, or three for each core: small rows that take long in Python are not put together in few tasks.

    each: in so many more that about so many rows go to one, whatever the table's size, so that a task's memory doesn't grow with it.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(parts, -(-df.count() // each)) if each else parts, *keys)


def key_groups(batches: Iterator[pa.RecordBatch], keys: Names) -> Iterator[pa.Table]:
    """The rows of each key, which stand together, as one table each; null keys are keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        new = np.zeros(held.num_rows, bool)
        for c in keys:
            column = held.column(c).combine_chunks()
            differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))), False)
            nulls = pc.not_equal(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, max(len(column) - 1, 0))))
            new[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
        at = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(at, at[1:]):
            yield held.slice(a, b - a)
        held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed in its parts, as in the schema of a result."""
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, _nullable(kind.item_type))
    return pa.struct([(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def table_groups(df: DataFrame, keys: Names, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over the rows of each key as a table, dealt(); columns that it hands on stay as they are, without a Python value for each."""

    def task(part: pa.Table) -> pa.Table:
        made = run(part)
        return made.cast(pa.schema([(f.name, _nullable(f.type)) for f in made.schema]))

    return dealt(df, keys).groupBy(*keys).applyInArrow(task, schema)


def mapped_groups(df: DataFrame, keys: Names, run: Callable[[pa.Table], dict[str, pa.Array]], made: str, order: Names = ()) -> DataFrame:
    """keys and the columns `made` that run gives for the rows of each key, sorted by `order`."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys), made])
    names = [x.split()[0] for x in made.split(", ")]
    first = {f.name: i for i, f in enumerate(df.schema)}
    keys = sorted(keys, key=first.__getitem__)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in key_groups(batches, keys):
            found = run(group)
            size = len(found[names[0]])
            own = [pa.repeat(group.column(k)[0], size) for k in keys]
            held.append(pa.RecordBatch.from_arrays([*own, *(found[c] for c in names)], [*keys, *names]))
            n += size
            if n >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
