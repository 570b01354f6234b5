"""Packing documents into token windows: bounded-space online best fit.

Each partition reads its documents once. A document's tokens are cut into full windows, which are complete
at once, and one rest. A fixed number of windows stays open; a rest goes into the open window that it fills
best, and if it fits none, the fullest is emitted and a new one opened. What is still open at the end of a
partition keeps its token ids; these leftovers of all partitions are then dealt to tasks of bounded size and
joined end to end, cut freely at the window size, so that each such task leaves at most one window short.

The ids come from the byte-level BPE of `vocabulary`. The pieces are written to the shared folder before the
merge, so a lost executor never makes two halves of the job disagree.

Edge cases: a null or empty text is the end token alone. Repeated rows, and rows of one doc_id or none, are separate documents
(their pieces carry the same doc_id). A very long text gives full windows as it is read, and only its rest waits. Of open windows
with equal room the one opened first is filled. Extra columns are ignored. The string of an added token (`added`) has that token's id, wherever it stands; without
`added` it is ordinary text. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut

WINDOW = 1024
OPEN = 64
END = 0
#: Tokens of leftovers that one merging task takes.
MERGE_TOKENS = 4_000_000
#: Sequences of the merging step are numbered from here, above all others.
MERGED = 1 << 62

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_TYPES = [pa.int64()] * len(_NAMES)


def added_tokens(tokenizer: str) -> dict[str, int]:
    """String and id of the added tokens in a tokenizer's JSON file."""
    with open(tokenizer, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} does not match its string alone")
    return {t["content"]: t["id"] for t in tokens}


def encoder(vocabulary: str, pattern: str, added: dict[str, int] | None = None):
    """text -> token ids, from a file of ranks (`base64 rank` lines) and the pattern that splits words.

    The strings of `added` cut a text, the longest where several begin; what lies between is encoded for itself.
    """
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ordinary = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return ordinary
    places = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            return ordinary(text)
        ids: list[int] = []
        for i, part in enumerate(places.split(text)):
            ids += [added[part]] if i % 2 else ordinary(part)
        return ids

    return encode


def _crc(ids: array) -> int:
    return zlib.crc32(ids.tobytes())


class OpenWindows:
    """The open windows of one partition, kept in order of their free space."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.free: list[tuple[int, int]] = []  # (free tokens, sequence)
        self.held: dict[int, list[tuple]] = {}

    def take(self, n: int) -> int:
        """A new sequence number for a window that is full at once."""
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, n: int) -> list[tuple]:
        """Places a piece of n tokens; returns the pieces of windows that this emits."""
        done: list[tuple] = []
        at = bisect_left(self.free, (n, -1))
        if at == len(self.free):
            if len(self.free) == self.most:
                done += self.held.pop(self.free.pop(0)[1])
            room, number = self.size, self.take(n)
            self.held[number] = []
        else:
            room, number = self.free.pop(at)
        self.held[number].append((*piece, number, self.size - room))
        if room == n:
            done += self.held.pop(number)
        else:
            insort(self.free, (room - n, number))
        return done


def _packer(vocabulary: str, pattern: str, size: int, most: int, added: dict[str, int] | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern, added)
        windows = OpenWindows(size, most, TaskContext.get().partitionId() << 32)
        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, ids = doc_id.as_py(), array("I", encode(text.as_py() or ""))
                ids.append(END)
                full = len(ids) - len(ids) % size
                for at in range(0, full, size):
                    done.append((doc_id, at, size, _crc(ids[at : at + size]), len(ids), windows.take(size), 0))
                if full < len(ids):
                    rest = ids[full:]
                    placed = windows.place((doc_id, full, rest, len(ids)), len(rest))
                    done += [(d, s, len(r), _crc(r), n, q, o) for d, s, r, n, q, o in placed]
            if done:
                yield _batch([*map(list, zip(*done, strict=True)), [None] * len(done)])
        held = [p for pieces in windows.held.values() for p in pieces]
        if held:
            yield _batch([*map(list, zip(*[(d, s, len(r), _crc(r), n, q, o, r.tobytes()) for d, s, r, n, q, o in held], strict=True))])

    return pack


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*_TYPES, pa.binary()], strict=True)], names=[*_NAMES, "ids"])


def _merger(size: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, offset = MERGED | TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            done: list[tuple] = []
            for doc_id, start, total, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = array("I", data)
                at = 0
                while at < len(ids):
                    part = ids[at : at + size - offset]
                    done.append((doc_id, start + at, len(part), _crc(part), total, number, offset))
                    at, offset = at + len(part), offset + len(part)
                    if offset == size:
                        number, offset = number + 1, 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*done, strict=True)), _TYPES, strict=True)], names=_NAMES)

    return merge


def pack(docs: DataFrame, vocabulary: str, pattern: str, size: int = WINDOW, most_open: int = OPEN, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens: see PIECE. `start` counts the document's ids before the piece."""
    placed = cut(docs.select("doc_id", "text").mapInArrow(_packer(vocabulary, pattern, size, most_open, added), f"{PIECE}, ids binary"))
    open_pieces = placed.where("ids IS NOT NULL")
    tokens = open_pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(tokens / MERGE_TOKENS))
    dealt = open_pieces.select("doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset").repartition(tasks, "sequence_id")
    dealt = dealt.sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "doc_tokens", "ids")
    return placed.where("ids IS NULL").drop("ids").unionByName(dealt.mapInArrow(_merger(size), PIECE))
