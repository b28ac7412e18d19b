"""Ordered folds over keyed groups, streamed through sorted partitions.

Some steps depend on the order in which lines were taken. Their groups are cut as small as the rules allow
(see each use), dealt by key and sorted by Spark; a task then streams its rows and holds one group at a time, or,
where a rule only looks back a bounded way (``keep_rows``), no group at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Columns = dict[str, list]
#: Rows that a fold gathers before it passes them on.
ROWS = 5000


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """``key, lo, hi`` for each stretch of equal keys."""
    lo = 0
    for key, stretch in groupby(zip(*(batch.column(k).to_pylist() for k in keys))):
        hi = lo + sum(1 for _ in stretch)
        yield key, lo, hi
        lo = hi


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as the session shuffles with. The number is stated, since the work on these
    rows costs far more than their bytes tell, and partitions merged by size would leave it to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_groups(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return dealt(df, *keys).sortWithinPartitions(*keys, *order)


def fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[Columns], Columns], schema: str, gathered: bool = False) -> DataFrame:
    """Rows of ``step`` for each group of ``keys``: it gets the group's columns in ``order`` and returns those of
    ``schema``; rows lead with the keys. Null keys are a group; no rows give no rows. With ``gathered`` a group's rows are in one
    task already, as ``islands`` of some of the keys leaves them, and are only sorted there."""
    types = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(schema).fields)
    target = to_arrow_schema(types)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Columns = {name: [] for name in target.names}
        group: Columns = {}
        last: tuple | None = None

        def close() -> None:
            made = step(group)
            size = len(next(iter(made.values())))
            for name, value in zip(keys, last):
                out[name] += [value] * size
            for name in target.names[len(keys) :]:
                out[name] += made[name]

        for batch in batches:
            columns = batch.to_pydict()
            for key, lo, hi in runs(batch, keys):
                if last is not None and key != last:
                    close()
                    group = {}
                    if len(out[keys[0]]) >= ROWS:
                        yield pa.RecordBatch.from_pydict(out, target)
                        out = {name: [] for name in target.names}
                for name, values in columns.items():
                    group.setdefault(name, []).extend(values[lo:hi])
                last = key
        if last is not None:
            close()
            yield pa.RecordBatch.from_pydict(out, target)

    ready = df.sortWithinPartitions(*keys, *order) if gathered else sorted_groups(df, keys, order)
    return ready.mapInArrow(rows, types)


def keep_rows(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], begin: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows that a test keeps. ``begin`` gives a fresh test for each group of ``keys``; it is asked for one row
    after another, in ``order``, with the values of ``columns``. Only its own state is held."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, test = None, begin()
        for batch in batches:
            mask: list[bool] = []
            values = [batch.column(c).to_pylist() for c in columns]
            for key, lo, hi in runs(batch, keys):
                if key != last:
                    last, test = key, begin()
                mask += map(test, *(v[lo:hi] for v in values))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return sorted_groups(df, keys, order).mapInArrow(rows, df.schema)


def scan_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], begin: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """A row of ``keys``, ``order`` and ``schema`` for each row. ``begin`` gives a fresh step for each group of ``keys``; it gets one
    row after another, in ``order``, as the values of ``columns``, and returns those of ``schema``. Only its own state is held."""
    types = T.StructType([df.schema[k] for k in keys + order] + T._parse_datatype_string(schema).fields)
    target = to_arrow_schema(types)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, begin()
        for batch in batches:
            made = []
            values = [batch.column(c) for c in columns]
            for key, lo, hi in runs(batch, keys):
                if key != last:
                    last, step = key, begin()
                made += [step(*(v[i].as_py() for v in values)) for i in range(lo, hi)]
            found = [pa.array(column, kind) for column, kind in zip(zip(*made), target.types[len(keys + order) :])]
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys + order), *found], schema=target)

    return sorted_groups(df.select(*dict.fromkeys(keys + order + columns)), keys, list(order)).mapInArrow(rows, types)


def islands(df: DataFrame, keys: list[str], at: str, gap: float, order: list[str | Column], inclusive: bool) -> DataFrame:
    """Numbers stretches of ``at`` in ``island``: a new one begins where the step from the row before is over
    ``gap`` (or equals it, unless ``inclusive``)."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    step = F.col(at) - F.lag(at).over(w)
    begins = (step > gap) if inclusive else (step >= gap)
    flagged = df.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    return flagged.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
