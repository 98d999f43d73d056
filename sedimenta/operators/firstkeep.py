"""First occurrence per key over hot keys: a map-side collapse of sorted runs.

Every input partition is sorted by key and order value (no shuffle) and walked once; of equal
keys only the first survives the run, the others are marked at once. A key with a third of all
rows therefore leaves each partition as one row, whatever follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def collapse_sorted_runs(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Adds boolean ``flag``: True where an equal ``key`` (binary or string, nulls equal each other) with
    a smaller or equal (``order``) value precedes in the same partition. Rows and columns are
    kept; an empty table stays empty."""
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType(), False)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            same = np.zeros(batch.num_rows, dtype=bool)
            if batch.num_rows > 1:
                head, tail = keys.slice(0, batch.num_rows - 1), keys.slice(1)
                equal = pc.fill_null(pc.equal(head, tail), False)
                both = pc.and_(pc.is_null(head), pc.is_null(tail))
                same[1:] = pc.or_(equal, both).to_numpy(zero_copy_only=False)
            same[0] = last is not None and last[0] == keys[0].as_py()
            last = (keys[-1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same)], names=[*batch.schema.names, flag])

    return df.sortWithinPartitions(key, order).mapInArrow(walk, schema)
