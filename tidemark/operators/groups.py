"""Groups of several inputs by key: all inputs go through one exchange, tagged, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tagged(inputs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, _input (the place of an input in their order), and each input's other columns as <input>_<column>, null in other inputs' rows. Keys have one type in all of them."""
    made = [f"{name}_{c}" for name, df in inputs.items() for c in df.columns if c not in keys]
    if len(set(made)) < len(made):
        raise ValueError("names of inputs and columns run together")
    parts = [df.select(*keys, F.lit(i).alias("_input"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys]) for i, (name, df) in enumerate(inputs.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def aligned(inputs: dict[str, DataFrame], keys: list[str], aggregates: dict[str, Callable[[Callable[[str], Column]], list[Column]]]) -> DataFrame:
    """A row for each key of any input: keys, n_<input> (its rows, 0 for none), and each input's aggregates, a function of its columns by name; other inputs' rows are nulls to them. One grouped aggregation, partial before the exchange, so a key is one row a task however often it comes; null keys are one key."""
    both = _tagged(inputs, keys)
    n = [F.count(F.when(F.col("_input") == i, 1)).alias(f"n_{name}") for i, name in enumerate(inputs)]
    of = [a for name, make in aggregates.items() for a in make(lambda c, name=name: F.col(f"`{name}_{c}`"))]
    return both.groupBy(*keys).agg(*n, *of)


#: (key, its inputs' rows in their order) -> rows. Rows of an input come as (its name, record batches), batch by batch.
Consumer = Callable[[tuple, Iterator[tuple[str, pa.RecordBatch]]], Iterator[pa.RecordBatch]]


def merged(inputs: dict[str, DataFrame], keys: list[str], order: dict[str, list[str]], consume: Consumer, schema: str) -> DataFrame:
    """What `consume` makes of each key, in the order of keys within a task: it gets the key and one stream over all inputs' rows, input after input, each in its own order. A key's rows are never held together: sorting spills, and batches pass through. What a consumer leaves of its stream is passed over. A key is one task's work, as a consumer sees its rows in order; `aligned` is for what can be summed up."""
    names = list(inputs)
    both = _tagged(inputs, keys)
    held = {name: [c for c in df.columns if c not in keys] for name, df in inputs.items()}
    by = [F.col(f"`{name}_{c}`") for name in names for c in order.get(name, [])]
    rows = both.repartition(*keys).sortWithinPartitions(*keys, "_input", *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple, str, pa.RecordBatch]]:
            for batch in batches:
                marks = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "_input")), strict=True))
                lo = 0
                for hi in range(1, len(marks) + 1):
                    if hi == len(marks) or marks[hi] != marks[lo]:
                        name, some = names[marks[lo][-1]], batch.slice(lo, hi - lo)
                        yield marks[lo][:-1], name, pa.RecordBatch.from_arrays([some.column(f"{name}_{c}") for c in held[name]], names=held[name])
                        lo = hi

        stream = pieces()
        head = next(stream, None)
        while head is not None:
            key = head[0]

            def own(key=key) -> Iterator[tuple[str, pa.RecordBatch]]:
                nonlocal head
                while head is not None and head[0] == key:
                    yield head[1:]
                    head = next(stream, None)

            rest = own()
            yield from consume(key, rest)
            for _ in rest:
                pass

    return rows.mapInArrow(run, schema)
