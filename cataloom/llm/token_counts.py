"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces
from .common import by_bytes, small_batches, texts_of

#: Bytes of text in one batch of rows.
BATCH_BYTES = 4 << 20


def token_counts(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts the tokens of every whole text.

    Rows: one for each row of docs, repeated rows included, with key, n_bytes (UTF-8), n_tokens and over_limit
    (n_tokens > max_tokens). A null or empty text has 0 bytes and 0 tokens; a null key stays null; other columns of docs are
    dropped, so their names can't clash. An empty table gives an empty table. Texts are never cut: those beyond 1 MB are split
    at white space if the tokenizer drops it, so that no token can stand across, and are encoded whole otherwise.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.pieces(tokenizer_path)
        for part in by_bytes(batches, "t", BATCH_BYTES):
            texts = texts_of(part.column("t"))
            n = table.lengths(texts)
            yield pa.record_batch([part.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > max_tokens)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
