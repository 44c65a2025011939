"""What the Arrow operators share: texts of a batch in slices of bounded size, and appended columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batch with their texts as UTF-8; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    start, size, texts = 0, 0, []
    for i, x in enumerate(column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())):
        x = x.as_py() or b""
        if texts and size + len(x) > most:
            yield batch.slice(start, i - start), texts
            start, size, texts = i, 0, []
        texts.append(x)
        size += len(x)
    if texts:
        yield batch.slice(start), texts


def append(df: DataFrame, fields: list[StructField], values: Callable[[list[bytes]], list], text: str = "text") -> DataFrame:
    """df with one more column for each of fields, made by values(texts) as one Arrow array each."""
    schema = StructType([*df.schema.fields, *fields])
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *values(texts)], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)
