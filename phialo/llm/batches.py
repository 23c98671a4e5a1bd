"""Whole texts of Arrow batches, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A slice ends before it passes this many bytes of text; one longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def trim(store: dict, most: int) -> None:
    """Halve a store of results that outgrew its bound; what came first is met most often."""
    if len(store) > most:
        for key in list(islice(store, most // 2, None)):
            del store[key]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about SLICE_BYTES of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(
    docs: DataFrame, text: str, added: T.StructType, make: Callable[[], Callable[[list[str]], dict]], drop_text: bool = True
) -> DataFrame:
    """``docs`` with columns that a function of whole texts gives.

    ``make()`` is called once in each task and returns the function from a list of texts
    (null: empty) to the lists of added columns.  Columns of ``docs`` with the name of an
    added one give way; every other column is kept.
    """
    kept = [f for f in docs.schema.fields if f.name not in added.names and not (drop_text and f.name == text)]
    schema = T.StructType(kept + added.fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]
    # the text travels under a name of its own, so that an added column may take its name
    source = docs.select(*[docs[n] for n in names], docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [x or "" for x in part.column(len(names)).to_pylist()]
                new = work(texts)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                for f in added.fields:
                    made, kind = new[f.name], arrow.field(f.name).type
                    columns.append(made.cast(kind) if isinstance(made, pa.Array) else pa.array(made, type=kind))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)
