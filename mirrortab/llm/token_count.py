"""Token counts of whole texts, without keeping the tokens.

A map over Arrow batches: each is cut into slices of about equal bytes, the texts of a slice into pieces at safe
boundaries (:mod:`mirrortab.llm.pieces`), and only the number of tokens per piece is kept. Rows are never shuffled.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import SLICE_BYTES, balanced
from mirrortab.llm.pieces import loaded
from mirrortab.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024

_models: dict[str, object] = {}


def _model_counts(path: str, texts: list[str]) -> list[int]:
    if path not in _models:
        import sentencepiece
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(ids) for ids in _models[path].encode(texts, num_threads=1)]


def counts_of(path: str, texts: list[str]) -> np.ndarray:
    """Tokens per text by the library for the file."""
    if path.endswith(".model"):
        return np.array(_model_counts(path, texts), np.int64)
    values, pieces = loaded(path, "count", len).values(texts)
    ends = np.cumsum(pieces)
    sums = np.concatenate([[0], np.cumsum(np.array(values, np.int64))])
    return sums[ends] - sums[ends - pieces]


def token_counts(df: DataFrame, text: str, path: str, output: str = "n_tokens", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` without ``text`` and with the long column ``output``.

    Every row is counted by itself: repeated rows get equal counts, a null or empty text has 0 tokens, an empty
    table stays empty. Other columns pass through unread; a column that is called ``output`` is replaced. No begin,
    end or other special token is added; their strings inside a text count as the library's default has it.
    """
    kept = [c for c in df.columns if c not in (text, output)]
    fields = [df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)] or [F.lit(0).alias("c0")]
    body = df.select(F.struct(*fields).alias("kept"), df[f"`{text}`"].alias("text"))

    def count(batches):
        for batch in batches:
            for part in balanced(batch, "text", slice_bytes):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(counts_of(path, texts), pa.int64())], names=["kept", "n"])

    out = body.mapInArrow(count, f"kept {body.schema['kept'].dataType.simpleString()}, n bigint")
    return out.select(*[F.col("kept").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("n").alias(output))


@query("op1_token_count")
def op1_token_count(spark, folder):
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return token_counts(docs, "text", public_tokenizers.path(VOCABULARY)).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
