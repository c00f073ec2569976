"""Folds over an order that is one sequence, some rows at a time."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType, _parse_datatype_string

from keystrata.plans.shared import shared_folder

#: Rows that one step sorts and folds, about.
STEP_ROWS = 1_000_000


def fold_in_order(rows: DataFrame, group: str, order: list[str], start: Callable, schema: str, step_rows: int = STEP_ROWS) -> DataFrame:
    """What the folds of ``rows`` give, one for each group and in the order of some columns.

    ``start()`` makes a group's state, and ``state.take(batch)`` goes on with rows of that group and
    returns a batch of ``schema``. Up to ``step_rows`` rows are one step. More are cut into ranges of the
    order, each of which is a step that sorts its own rows only and takes over the states, pickled, that
    the step before has left; so no task has more than a range and its states in memory.
    """
    spark = rows.sparkSession
    own: StructType = _parse_datatype_string(schema)
    kept = StructType(own.fields).add("_state", BinaryType()).add("_group", rows.schema[group].dataType)
    n = rows.count()
    if n <= step_rows:
        return _step(rows, None, group, order, start, kept).where("_state IS NULL").select(*own.fieldNames())
    path = shared_folder(spark)
    ranges = rows.repartitionByRange(-(-n // step_rows), *order, group).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(f"{path}/ranges")
    ranges = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType())])).parquet(f"{path}/ranges")
    sizes = sorted(tuple(r) for r in ranges.groupBy("_part").count().collect())
    done, first, held = [], sizes[0][0], 0
    for i, (part, size) in enumerate(sizes):
        held += size
        # small ranges go together
        if i + 1 < len(sizes) and held + sizes[i + 1][1] <= step_rows:
            continue
        states = spark.read.schema(kept).parquet(done[-1]).where("_state IS NOT NULL") if done else None
        some = ranges.where(F.col("_part").between(first, part)).drop("_part")
        done.append(f"{path}/step-{len(done)}")
        _step(some, states, group, order, start, kept).write.parquet(done[-1])
        first, held = part + 1, 0
    return spark.read.schema(kept).parquet(*done).where("_state IS NULL").select(*own.fieldNames())


def _step(rows: DataFrame, states: DataFrame | None, group: str, order: list[str], start: Callable, kept: StructType) -> DataFrame:
    """What one step gives, and a row for each group's state behind it."""
    out = pa.schema([pa.field(f.name, t) for f, t in zip(kept.fields, _arrow_types(kept), strict=True)])
    both = rows.withColumn("_state", F.lit(None).cast("binary"))
    if states is not None:
        both = both.unionByName(states.select(F.col("_group").alias(group), "_state"), allowMissingColumns=True)
    # a group's state is before its rows
    both = both.repartition(group).sortWithinPartitions(group, F.col("_state").isNull(), *order)

    def kept_state(name, state) -> pa.RecordBatch:
        values = {"_state": pickle.dumps(state, pickle.HIGHEST_PROTOCOL), "_group": name}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            ids = batch[group].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if state is None or name != batch[group][a].as_py():
                    if state is not None:
                        yield kept_state(name, state)
                    name, state = batch[group][a].as_py(), start()
                if batch["_state"][a].is_valid:
                    state, a = pickle.loads(batch["_state"][a].as_py()), a + 1
                if a < b:
                    given = state.take(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([*given.columns, pa.nulls(b - a, out.field("_state").type), pa.nulls(b - a, out.field("_group").type)], schema=out)
        if state is not None:
            yield kept_state(name, state)

    return both.mapInArrow(run, kept)


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
