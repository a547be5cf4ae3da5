"""Ordered folds as a streamed pass: rows sorted within partitions go through a small Python generator, one key after another.

For steps that depend on the previous result and have no closed form. Only what a generator keeps is in memory, never a key's rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
BATCH = 8192


def scanned(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """The tuples that step yields for each key's rows, which it gets one by one in order, as named tuples. schema names the keys first
    and then the fields that step yields; types are long, double, string and boolean. Nulls come as None."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    arrow = pa.schema([(name, TYPES[kind]) for name, kind in fields])
    names = [*keys, *[c for c in df.columns if c not in keys]]
    row = namedtuple("row", names)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*r) for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        out = ((*group[:n], *found) for group, found in results(rows))
        while part := list(islice(out, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    def results(rows: Iterator) -> Iterator[tuple]:
        for key, group in groupby(rows, itemgetter(slice(0, n))):
            for found in step(group):
                yield key, found

    return df.select(*names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
