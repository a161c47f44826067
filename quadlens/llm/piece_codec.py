"""SentencePiece encoding and decoding through a distinct-chunk table (see chunk_table).

Defined results: a null text counts as empty and gives the end id alone; a null doc_id is passed through;
repeated rows are each encoded; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from quadlens.llm import chunk_table


@lru_cache(maxsize=2)
def _pieces(path: str) -> chunk_table.MarkedPieces:
    chunk_table.check_markers(path)
    return chunk_table.MarkedPieces(path)


def encode_texts(texts: list[str], path: str):
    """Ids of each text, the end id last, and the same ids as one string."""
    end = chunk_table.piece_model(path).eos_id()
    for found in _pieces(path).results(texts):
        ids = list(chain.from_iterable(x[0] for x in found))
        ids.append(end)
        yield ids, " ".join([*(x[1] for x in found), str(end)])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of each row of docs."""
    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([ids for ids, _ in encode_texts(texts, path)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of doc_id, ids."""
    def run(batches):
        model = chunk_table.piece_model(path)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded by the library, without keeping the ids."""
    def run(batches):
        model, sha = chunk_table.piece_model(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            texts, rows = [x or "" for x in b.column("text").to_pylist()], []
            for ids, as_text in encode_texts(texts, path):
                rows.append((len(ids), sha(as_text), sha(model.decode(ids))))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
