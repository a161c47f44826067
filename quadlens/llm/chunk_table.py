"""Distinct-chunk tables: segment each distinct chunk of text once, join results back by position.

A table belongs to a Python worker and lives as long as it. It maps a chunk to what the tokenizer library
makes of it; texts become lists of chunks, and their results are the chunks' results side by side. Both
rules below cut only where the library never joins what stands left and right of the cut:

* sentencepiece (identity normalizer, prefix marker, no piece with a marker after another character):
  before every run of markers;
* byte-level BPE with the usual word pattern: before a space with a non-space on both sides, or, if no
  space of the text is followed by white space or its end, before every space.

Memory is bounded: texts are taken in groups of GROUP_BYTES, and a table past `limit` chunks starts anew
from those of the group at hand.
A table shared by all executors would need every occurrence of every chunk to be shuffled (several times
the size of the text), which is why it is per worker.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 4 << 20
BATCH_BYTES = 64 << 10
LIMIT = 600_000
PLAIN = "\u0250"  # first character of no plain chunk
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
MARKED = re.compile(r" ( *[^ ]*)")


class ChunkTable:
    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = LIMIT):
        self.encode_many, self.limit, self.known = encode_many, limit, {}

    def look_up(self, lists: Iterable[list[str]]) -> dict:
        """The table, with every chunk of the lists in it."""
        distinct = set(chain.from_iterable(lists))
        missing = [x for x in distinct if x not in self.known]
        if len(self.known) + len(missing) > self.limit:
            self.known = {x: self.known[x] for x in distinct if x in self.known}
        self.known.update(zip(missing, self.encode_many(missing)))
        return self.known


def by_bytes(items: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """items in batches of about `most` bytes of UTF-8 each."""
    batch, size = [], 0
    for x in items:
        batch.append(x)
        size += 16 + (len(x) if x.isascii() else len(x.encode()))
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def grouped(sizes, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups of about `most` bytes."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


# Byte-level BPE (tokenizers)


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def rank_bpe(path: str):
    """The same vocabulary as ranks, for tiktoken."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _opens(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    vocabulary = byte_bpe(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for x, i in vocabulary.items() if x[0] == "Ġ"]] = True
    return out


class BytePieces:
    """Token counts of texts, or their ids, as the tokenizers library gives them.

    ranks: the same vocabulary as a rank file. New chunks of plain Latin text without special strings then go
    through tiktoken, which gives the same ids several times faster; all others go through tokenizers.

    Chunks that begin with their only space are encoded many to a call, joined: tokens that begin with a
    space then mark where each chunk's ids start.
    """

    def __init__(self, path: str, counts: bool, ranks: str | None = None):
        tokenizer, opens = byte_bpe(path), _opens(path)
        fast = rank_bpe(ranks) if ranks else None

        def encode(chunks: list[str], head: str = "") -> list:
            found = (e for batch in by_bytes(chunks) for e in tokenizer.encode_batch_fast([head + x for x in batch], add_special_tokens=False))
            return [len(e) if counts else np.array(e.ids, "<u4").tobytes() for e in found]

        def encode_spaced(chunks: list[str]) -> list:
            if not fast:
                return joined(chunks, lambda x: tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids)
            plain = [max(x) < PLAIN and "<|" not in x for x in chunks]
            quick = iter(joined([x for x, p in zip(chunks, plain) if p], fast.encode_ordinary))
            rest = iter(joined([x for x, p in zip(chunks, plain) if not p], lambda x: tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids))
            return [next(quick if p else rest) for p in plain]

        def joined(chunks: list[str], ids_of) -> list:
            out = []
            for batch in by_bytes(chunks):
                ids = np.array(ids_of(" " + " ".join(batch)), "<u4")
                at = np.append(np.flatnonzero(opens[ids]), len(ids))
                if len(at) != len(batch) + 1:
                    out += encode(batch, " ")
                elif counts:
                    out += np.diff(at).tolist()
                else:
                    raw, at = ids.tobytes(), (4 * at).tolist()
                    out += [raw[i:j] for i, j in zip(at, at[1:])]
            return out

        self.counts, self.spaced, self.whole = counts, ChunkTable(encode_spaced), ChunkTable(encode)

    def results(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each group of texts: where each text's tokens begin and end, and all ids (none when counting)."""
        texts = texts.fill_null("")
        for a, b in grouped(pc.binary_length(texts).to_numpy()):
            yield self._group(texts[a:b])

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # a chunk that is empty or opens with white space makes its text odd, unless it is the text's first
        odd_chunk = np.array([not x or x[0].isspace() for x in chunks])
        odd = odd_chunk[at]
        odd[first] = False
        odd = np.logical_or.reduceat(odd, first)
        known = self.spaced.look_up([[x for x, o in zip(chunks, odd_chunk) if not o]])
        empty = 0 if self.counts else b""
        of_chunk = [empty if o else known[x] for x, o in zip(chunks, odd_chunk)]
        cuts = [SAFE_CUT.split(texts[i].as_py()) if o else [chunks[at[first[i]]]] for i, o in enumerate(odd.tolist())]
        known = self.whole.look_up(cuts)
        of_text = [[known[x] for x in c] for c in cuts]
        # what the rules below place at a text's first chunk: that chunk alone, or all of an odd text
        of_text = [sum(x) for x in of_text] if self.counts else [b"".join(x) for x in of_text]
        n_chunk = np.array(of_chunk if self.counts else [len(x) // 4 for x in of_chunk], np.int64)
        n_text = np.array(of_text if self.counts else [len(x) // 4 for x in of_text], np.int64)
        size = n_chunk[at]
        size[np.repeat(odd, np.diff(np.append(first, len(at))))] = 0
        size[first] = n_text
        edge = np.concatenate([[0], np.cumsum(np.add.reduceat(size, first))])
        if self.counts:
            return edge, np.zeros(0, np.uint32)
        pool = np.frombuffer(b"".join([*of_chunk, *of_text]), "<u4")
        begin = np.concatenate([[0], np.cumsum(np.concatenate([n_chunk, n_text]))])
        place = begin[at]
        place[first] = begin[len(chunks) : -1]
        shift = place - np.concatenate([[0], np.cumsum(size)[:-1]])
        return edge, pool[np.repeat(shift, size) + np.arange(edge[-1])]


# Sentencepiece


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_markers(path: str) -> None:
    """Raises if some piece of the model crosses a white-space marker, for then no cut is safe."""
    model = piece_model(path)
    for i in range(model.get_piece_size()):
        if re.search("[^▁]▁", model.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a white-space marker")


class MarkedPieces:
    """(ids, ids as text) of the chunks of each text."""

    def __init__(self, path: str):
        model = piece_model(path)
        marker = model.piece_to_id("▁")

        def encode(chunks: list[str]) -> list:
            found = model.encode(chunks, num_threads=1) if chunks else []
            found = [x if c else [marker] for x, c in zip(found, chunks)]
            return [(x, " ".join(map(str, x))) for x in found]

        self.table = ChunkTable(encode)

    def results(self, texts: list[str]) -> Iterator[list]:
        for a, b in grouped([len(t) for t in texts]):
            lists = []
            for t in texts[a:b]:
                t = t.replace("▁", " ")
                x = t.split(" ") if t else []
                lists.append(MARKED.findall(" " + t) if "" in x else x)
            known = self.table.look_up(lists)
            for x in lists:
                yield list(map(known.__getitem__, x))
