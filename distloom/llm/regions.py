"""Content-defined regions: the part of repeat search that all documents go through.

A window is a run of fixed length, of words or of bytes. Its anchor is the gram with the smallest hash among
those inside it, the leftmost if several. Equal windows have equal anchors at equal places, so windows need
comparing only under a common anchor. The windows of one anchor place are consecutive; together they make a
region. Regions, about one for every `width` / 2 units, stand for all windows of a text: an anchor seen once
in the corpus has nothing repeated in its region, and regions of equal content repeat as a whole. Only distinct
regions that share an anchor but differ are left for suffix trees or suffix arrays.

Anchors and the codes of words that they stand on may collide: that costs a comparison. A region's content is told by a
128-bit digest of its bytes. Texts are cut in segments, so that what is held besides a text itself does not follow its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut, sieve

_PLACE = np.uint64((1 << 24) - 1)
#: Units of a segment: of a long text, or of several short ones that are cut together.
SEGMENT = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class Powers:
    """Powers of the factor and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                steps = np.full((2, size), [[_FACTOR], [_INVERSE]], dtype=np.uint64)
                steps[:, 0] = 1
                self.up, self.down = np.multiply.accumulate(steps, axis=1)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` codes (64-bit numbers that stand for words or bytes)."""
    up, down = _POWERS.upto(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    n = len(codes) - gram + 1
    return mixed((sums[gram:] - sums[:-gram]) * down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def cut_regions(codes: np.ndarray, piece: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For codes of pieces of text laid end to end: anchor hash, first and last window of each region, none across pieces."""
    grams = gram_hashes(codes, gram)
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(packed, window - gram + 1) & _PLACE).astype(np.int64)
    whole = piece[: len(place)] == piece[window - 1 :]
    new = np.flatnonzero((place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | (piece[1 : len(place)] != piece[: len(place) - 1])) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(place)]]) - 1
    first, last = first[whole[first]], last[whole[first]]
    return grams[place[first]], first, last


@dataclass
class Block:
    """Regions of one or more texts: which text, anchor, 128-bit digest as two numbers, first and last window in that text."""

    text: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray
    first: np.ndarray
    last: np.ndarray
    units: Callable[[int], bytes]  # the content of region i: bytes, or words joined by one space

    def keys(self) -> list[bytes]:
        raw = self.digest.tobytes()
        return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    found = b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2)


_NONE = np.zeros((0, 2), dtype=np.uint64)


class Cutter:
    """Cuts texts into regions. Subclasses lay pieces of texts end to end and give them codes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def pieces(self, text: str) -> Iterator[tuple[int, object]]:
        """(first unit, units) of the segments of a text; neighbours share window - 1 units."""
        raise NotImplementedError

    def block(self, pieces: list[tuple[int, int, object]], digests: bool) -> Block | None:
        raise NotImplementedError

    def blocks(self, texts: Iterable[str | None], digests: bool = True) -> Iterator[Block]:
        held: list[tuple[int, int, object]] = []
        size = 0
        for i, text in enumerate(texts):
            for base, units in self.pieces(text or ""):
                if len(units) < self.window:
                    continue
                held.append((i, base, units))
                size += len(units)
                if size >= SEGMENT:
                    yield self.block(held, digests)
                    held, size = [], 0
        if held:
            yield self.block(held, digests)

    def _made(self, pieces: list, codes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray, digests: bool) -> Block:
        """Regions of pieces whose units are data[starts:ends]."""
        lengths = np.array([len(p[2]) for p in pieces])
        place = np.cumsum(lengths) - lengths
        piece = np.repeat(np.arange(len(pieces)), lengths)
        anchor, first, last = cut_regions(codes, piece, self.window, self.gram)
        of = piece[first]
        low, high = starts[first], ends[last + self.window - 1]
        digest = _digests(data, low, high) if digests else _NONE
        text, base = np.array([p[0] for p in pieces])[of], np.array([p[1] for p in pieces])[of] - place[of]
        return Block(text, anchor.view(np.int64), digest, first + base, last + base, lambda i: data[low[i] : high[i]])


_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


class ByteCutter(Cutter):
    def pieces(self, text: str) -> Iterator[tuple[int, bytes]]:
        data = text.encode("utf-8", "surrogatepass")
        for base in range(0, max(1, len(data) - self.window + 1), SEGMENT):
            yield base, data[base : base + SEGMENT + self.window - 1]

    def block(self, pieces: list, digests: bool) -> Block:
        data = b"".join([p[2] for p in pieces])
        places = np.arange(len(data) + 1)
        return self._made(pieces, _BYTES[np.frombuffer(data, dtype=np.uint8)], data, places[:-1], places[1:], digests)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_in_segments(text: str, overlap: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of segments of a text, each beginning with the last `overlap` words of the one before."""
    data = text.encode("utf-8", "surrogatepass")
    at, base, carried = 0, 0, []
    while True:
        edge = _SPACE.search(data, at + 8 * SEGMENT)
        end = edge.start() if edge else len(data)
        words = carried + data[at:end].split()
        yield base, words
        if end == len(data):
            return
        carried = words[-overlap:] if overlap else []
        base += len(words) - len(carried)
        at = end


class WordCutter(Cutter):
    def pieces(self, text: str) -> Iterator[tuple[int, list[bytes]]]:
        return words_in_segments(text, self.window - 1)

    def block(self, pieces: list, digests: bool) -> Block:
        data = b" ".join([b" ".join(p[2]) for p in pieces])  # one space between words: content is a slice of it
        raw = np.frombuffer(data, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        up, down = _POWERS.upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * up[:-1], out=sums[1:])
        codes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        return self._made(pieces, codes, data, starts, ends, digests)


def binary_array(digest: np.ndarray) -> pa.Array:
    """A column of 16-byte values from rows of two numbers."""
    data = np.ascontiguousarray(digest).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(digest), [None, pa.py_buffer(np.arange(len(digest) + 1, dtype=np.int32) * 16), pa.py_buffer(data)])


def anchor_counts(docs: DataFrame, cutter: Callable[[], Cutter], within: bool) -> DataFrame:
    """(anchor, n) for docs (key, text), counted by block: how often an anchor stands there, or, unless `within`, in how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter()
        for batch in batches:
            for block in own.blocks((t.as_py() for t in batch.column(1)), digests=False):
                anchor = block.anchor
                if not within:
                    order = np.lexsort((anchor, block.text))
                    a, t = anchor[order], block.text[order]
                    anchor = a[np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])[: len(a)]]
                anchor, n = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return docs.select("key", "text").mapInArrow(run, "anchor long, n long")


def region_rows(docs: DataFrame, cutter: Callable[[], Cutter]) -> DataFrame:
    """(key, anchor, region, n) for docs (key, text): how often each region stands in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for block in own.blocks(t.as_py() for t in batch.column(1)):
                if not len(block.text):
                    continue
                order = np.lexsort((block.digest[:, 1], block.digest[:, 0], block.text))
                d, t = block.digest[order], block.text[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1) | (t[1:] != t[:-1])]))
                n = np.diff(np.append(new, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[t[new]]), pa.array(block.anchor[order[new]]), binary_array(d[new]), pa.array(n)], names=["key", "anchor", "region", "n"])

    return docs.select("key", "text").mapInArrow(run, "key long, anchor long, region binary, n long")


def shared_rows(docs: DataFrame, cutter: Callable[[], Cutter], within: bool) -> DataFrame:
    """The rows of region_rows whose anchor stands twice or more in the corpus (in two texts, unless `within`), written out."""
    again = anchor_counts(docs, cutter, within).groupBy("anchor").agg(F.sum("n").alias("seen")).where("seen > 1").select("anchor")
    again = cut(again)  # a plain table: both sides of the join can then be split where an anchor is hot
    return cut(region_rows(docs, cutter).join(again, "anchor", "left_semi"))


def region_texts(docs: DataFrame, wanted: DataFrame, cutter: Callable[[], Cutter]) -> DataFrame:
    """(region, units) for wanted (key, region): the content of each wanted region, words joined by one space."""
    lists = wanted.groupBy("key").agg(F.collect_list("region").alias("regions"))  # no more than the regions of a text
    maybe, _ = sieve(docs, wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter()
        for batch in batches:
            wants, names, contents = [set(w) for w in batch.column(1).to_pylist()], [], []
            for block in own.blocks(t.as_py() for t in batch.column(0)):
                for i, (text, name) in enumerate(zip(block.text.tolist(), block.keys(), strict=True)):
                    if name in wants[text]:
                        wants[text].discard(name)
                        names.append(name)
                        contents.append(block.units(i))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary())], names=["region", "units"])

    found = maybe.join(lists, "key").select("text", "regions").mapInArrow(run, "region binary, units binary")
    return found.dropDuplicates(["region"])


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (key, ...) with `marks`: the array of (region, spans) that marks (key, region, spans) has for the document.

    Documents without marks stay where they are.
    """
    marks = cut(marks)
    lists = marks.groupBy("key").agg(F.collect_list(F.struct("region", "spans")).alias("marks"))  # no more than the regions of a text
    maybe, others = sieve(docs, marks, "key")
    none = F.lit(None).cast("array<struct<region:binary,spans:array<int>>>")
    return maybe.join(lists, "key", "left").unionByName(others.withColumn("marks", none))


def covered(cutter: Cutter, texts: list[str | None], marks: list[list[dict] | None], sizes: list[int]) -> dict[int, np.ndarray]:
    """For each text with marks: which of its `size` units they cover. Spans are pairs of first unit, from the region's start, and length; null means the whole region."""
    marked = [i for i, m in enumerate(marks) if m]
    gone = {i: np.zeros(sizes[i], dtype=bool) for i in marked}
    by = {i: {m["region"]: m["spans"] for m in marks[i]} for i in marked}
    for block in cutter.blocks(texts[i] for i in marked):
        for at, name, first, last in zip(block.text.tolist(), block.keys(), block.first.tolist(), block.last.tolist(), strict=True):
            own = by[marked[at]]
            if name not in own:
                continue
            spans, there = own[name], gone[marked[at]]
            if spans is None:
                there[first : last + cutter.window] = True
            else:
                for start, n in zip(spans[::2], spans[1::2], strict=True):
                    there[first + start : first + start + n] = True
    return gone


def groups(batches: Iterator[pa.RecordBatch], least: int, key: int = 0, size: str = "units") -> Iterator[pa.Table]:
    """Joins batches that are sorted by column `key` into tables of whole groups with at least `least` bytes of `size`."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        bytes_held += batch.column(batch.schema.get_field_index(size)).nbytes
        if bytes_held < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        if len(other):
            yield table.slice(0, other[-1] + 1)
            held = table.slice(other[-1] + 1).to_batches()
            bytes_held = sum(b.column(b.schema.get_field_index(size)).nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)
