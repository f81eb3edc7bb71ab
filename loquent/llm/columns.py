"""A column made from the text of each row, next to all columns that are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from loquent.llm import textbuf as tb


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores after it as long as `docs` has a column of that name (case does not count)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_column(docs: DataFrame, name: str, kind: DataType, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """`docs` with the column `name`, in batches of bounded size and without a shuffle. A column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            made = make(part.column(part.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, StructType([*kept, StructField(name, kind)]))
