"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols (UTF-8 bytes) minus the merges that encoding makes; no identifiers are produced. There
is no shuffle: each task cuts its own texts and keeps a bounded memo of units it has counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import bpe

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
_COUNTERS: dict[str, bpe.Units] = {}


def counter(path: str) -> bpe.Units:
    """This worker's counter for a vocabulary; workers are used again, and so is its memo."""
    if path not in _COUNTERS:
        ranks, specials = bpe.load(path)
        symbols = bpe.byte_symbols()
        _COUNTERS[path] = bpe.Units(lambda pretokens: [len(p.encode()) - bpe.heap_merges(p, ranks, symbols) for p in pretokens], sum, specials)
    return _COUNTERS[path]


def count_text(text: str, path: str) -> int:
    """Tokens of one text; a special string inside it is one token, as the library has it by default."""
    own = counter(path)
    return sum(1 if part is None else sum(own.values(part)) for part in own.parts(text))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        counts = pa.array([count_text(t, path) for t in texts], pa.int64())
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, counts], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for each row of ``docs``.

    ``vocabulary`` names a byte-level BPE file in the ``tokenizers`` format, or gives its path on every executor. A null text
    counts as empty (0 bytes, 0 tokens, false); a null id stays null; repeated rows are counted each; an empty table gives no
    rows; other columns, whatever their names, aren't read.
    """
    path = bpe.vocabulary_path(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.select(id_col).dtypes[0][1]
    out = rows.mapInArrow(partial(_count, path=path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
