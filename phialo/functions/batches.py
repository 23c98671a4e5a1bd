"""Parts of Arrow batches that hold a bounded number of bytes of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A part ends before it passes this many bytes; one larger document is a part of its own.
PART_BYTES = 4_000_000


def parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes of ``column`` (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_documents(df: DataFrame, column: str, added: T.StructType, make: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``df`` without ``column``, with what a function of each document gives.

    ``make()`` gives the function once in each task; a null document counts as empty.  Columns
    of ``df`` with the name of an added one give way.  Rows come and go in parts bounded by
    the documents' bytes, and a part is done before the next one is taken apart.
    """
    kept = [f for f in df.schema.fields if f.name != column and f.name not in added.names]
    schema = T.StructType(kept + added.fields)
    arrow = to_arrow_schema(schema)
    source = df.select(*[df[f.name] for f in kept], df[column].alias("__document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch, "__document"):
                rows = [work(x.as_py() or "") for x in part.column("__document")]
                made = [pa.array([r[i] for r in rows], type=arrow.field(f.name).type) for i, f in enumerate(added.fields)]
                same = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, *made], schema=arrow)

    return source.mapInArrow(run, schema)
