"""Token counts of a byte-level BPE.

Texts are split at safe boundaries, the distinct segments go to the library in batches balanced by bytes,
and only their lengths come back: no ids or offsets leave the Arrow function. See chunk_table for the rule
that makes a boundary safe and for what bounds the memory.

Defined results: a null text counts as empty (no token); a null doc_id is passed through; repeated rows are
each counted; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quadlens.llm import chunk_table


@lru_cache(maxsize=2)
def _lengths(path: str) -> chunk_table.BytePieces:
    return chunk_table.BytePieces(path, counts=True)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""
    def run(batches):
        for b in batches:
            text = b.column("text").fill_null("")
            counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(edge) for edge, _ in _lengths(path).results(text))])
            columns = [b.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
