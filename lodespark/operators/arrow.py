"""Arrow functions over tables with columns of any name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def map_in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """DataFrame.mapInArrow, which by itself takes a dot in a name for a path. ``run`` sees the names as they are, and gives columns in the schema's order."""
    if not any(set(".`") & set(name) for name in (*rows.columns, *schema.names)):
        return rows.mapInArrow(run, schema)
    names = rows.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, [f"c{i}" for i in range(len(out.columns))])

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return rows.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, plain).toDF(*schema.names)
