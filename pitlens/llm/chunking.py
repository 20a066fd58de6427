"""Texts cut into chunks that tasks share out, so one long text is no one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
BATCH_BYTES = "8m"


def bound_batches(df: DataFrame) -> DataFrame:
    """Has Spark pass texts to Python in batches of bytes, not rows, so that neither side holds much at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def unused(columns: list[str], name: str) -> str:
    """`name`, or it with underscores before it, such that no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def short_texts(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, text of the documents that are one chunk, null text as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= size)


def long_chunks(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = 0) -> DataFrame:
    """row, doc_id, part, parts, start, text: chunks of `size` code points, each with `overlap` more
    of what follows, of the documents longer than one. `row` tells rows apart whatever their
    doc_id. Chunks are dealt out evenly."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    long = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(F.length("text") > size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k) for k in range(3))):
                text = text.as_py()
                parts = -(-len(text) // size)
                for part in range(parts):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], batch.schema.field(1).type),
                        pa.array([part], pa.int32()), pa.array([parts], pa.int32()), pa.array([part * size], pa.int64()),
                        pa.array([text[part * size:(part + 1) * size + overlap]], pa.string())],
                        ["row", "doc_id", "part", "parts", "start", "text"])

    chunks = long.mapInArrow(cut, f"row long, doc_id {kind}, part int, parts int, start long, text string")
    return chunks.repartition("row", "part")
