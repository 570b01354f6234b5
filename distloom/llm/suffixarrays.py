"""Suffix-array dedup, over UTF-8 bytes.

A byte is removed if a string of WINDOW bytes that covers it also starts anywhere else, in the same document or
another. Content-defined regions (see regions) settle windows of regions that stand twice as they are; what is
left are regions that differ but share an anchor. These are dealt by anchor into shards of bounded size. A
shard's suffix array comes from prefix doubling that refines only groups still unsorted (Larsson and Sadakane),
its common prefixes from Kasai's recurrence, run over blocks of the text side by side. An anchor with more
regions than fit a shard is split over several; their windows that stand once in their shard are then merged
across shards in order of their hashes, where binary search counts each one's occurrences.

A region is told by 128 bits of its content, and so are windows that meet across shards.

Edge cases: a null or empty text has no bytes. Repeated rows, and rows of one doc_id or none, are documents of their own: copies of
each other, both lose every window. A text shorter than WINDOW keeps all. Very long texts are cut in segments. Extra columns are ignored. An empty table works.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut
from distloom.llm.regions import ByteCutter, covered, groups, region_texts, shared_rows, with_marks

WINDOW = 200
GRAM = 32
#: Regions of one anchor in a shard, and bytes of regions in a task's step.
SHARD = 2_000
_CHUNK = 600_000
_BLOCK = 64


def eights(data: np.ndarray, pad: int) -> np.ndarray:
    """At every byte, the eight bytes that start there as a number, first byte lowest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(pad + 16, dtype=np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + pad + 8, 8), (1, 1)).copy().view("<u8").ravel()


def suffix_array(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Positions of the n suffixes in order of at least their first `depth` bytes (ties beyond that stay in any order)."""
    first = words[:n].byteswap()  # first byte highest: order of numbers is order of strings
    order = np.argsort(first, kind="stable")
    key = first[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, dtype=np.int64)  # one more: the empty suffix, below all
    rank[order] = start + 1
    h = 8
    while h < depth:
        open_places = np.flatnonzero(~(new & np.append(new[1:], True)))  # in groups of two or more
        if not len(open_places):
            break
        members = order[open_places]
        key = rank[members] * (n + 1) + rank[np.minimum(members + h, n)]
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[open_places] = members
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_places] = differs
        rank[members] = np.maximum.accumulate(np.where(differs, open_places, 0)) + 1
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place in the order, the common prefix with the suffix before it, up to cap.

    Kasai: the suffix one byte on shares at least one byte less. The text is taken in blocks that advance side
    by side; only the first suffix of a block starts from nothing.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, dtype=np.int64)
    blocks = np.arange(0, n, _BLOCK)
    have = np.zeros(len(blocks), dtype=np.int64)
    for step in range(_BLOCK):
        here = blocks + step
        lanes = np.flatnonzero(here < n)
        here, there = here[lanes], before[here[lanes]]
        h = np.where(there < 0, 0, np.maximum(have[lanes] - 1, 0))
        going = np.flatnonzero(there >= 0)
        while len(going):
            apart = words[here[going] + h[going]] ^ words[there[going] + h[going]]
            equal = np.bitwise_count((apart & -apart) - np.uint64(1)).astype(np.int64) >> 3  # low equal bytes; 8 if all
            h[going] = np.minimum(h[going] + equal, cap)
            going = going[(equal == 8) & (h[going] < cap)]
        found[here] = h
        have[lanes] = np.where(h < cap, h, 0)  # beyond the sorted depth the order does not carry over to the next suffix
    return found[order]


_SCHEMA = "region binary, spans array<int>, hash binary, at int, again boolean"


def _taken(names: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    return pa.concat_arrays(names.take(pa.array(at)).chunks or [pa.array([], pa.binary())])


def _shards(window: int):
    """For regions sorted by shard: rows (region, spans) of repeated windows, and for split anchors a row (hash, ...) for each window class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _CHUNK):
            times, parts = (table.column(c).to_numpy() for c in ("n", "parts"))
            region, texts = table.column("region"), table.column("units").to_pylist()
            joined = b"".join(texts)
            words = eights(np.frombuffer(joined, dtype=np.uint8), window)
            order = suffix_array(words, len(joined), window)
            run_of = np.cumsum(common_prefixes(words, order, window) < window)
            lengths = np.array([len(t) for t in texts])
            owner_of = np.repeat(np.arange(len(texts)), lengths)
            offset_of = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            valid = offset_of[order] <= lengths[owner_of[order]] - window
            order, run_of = order[valid], run_of[valid]
            owner, offset = owner_of[order], offset_of[order]
            total = np.bincount(run_of, weights=np.minimum(times[owner], 2))
            twice = total[run_of] >= 2
            hit = np.flatnonzero(twice & (times[owner] == 1))
            hit = hit[np.lexsort((offset[hit], owner[hit]))]
            o, w = owner[hit], offset[hit]
            new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1)])[: len(hit)])
            last = np.append(new[1:], len(hit))[: len(new)] - 1
            spans = np.stack([w[new], w[last] - w[new] + window], axis=1).astype(np.int32)  # neighbouring windows as one
            k = len(new)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * 2), pa.array(spans.ravel()))
            yield pa.RecordBatch.from_arrays([_taken(region, o[new]), lists, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_())], names=_NAMES)
            ones = np.flatnonzero((parts[owner] > 1) & np.concatenate([[True], run_of[1:] != run_of[:-1]])[: len(run_of)])
            if len(ones):
                view, k = memoryview(joined), len(ones)
                hashes = pa.array([xxhash.xxh3_128_digest(view[s : s + window]) for s in order[ones].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([_taken(region, owner[ones]), pa.nulls(k, pa.list_(pa.int32())), hashes, pa.array(offset[ones], pa.int32()), pa.array(twice[ones])], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _merge(window: int):
    """Window classes of several shards, sorted by hash: (region, spans) of those that stand once in their shard and again elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1, size="hash"):
            hashes = np.array(table.column("hash").to_pylist())
            at, again = (table.column(c).to_numpy() for c in ("at", "again"))
            count = np.searchsorted(hashes, hashes, "right") - np.searchsorted(hashes, hashes, "left")
            hit = np.flatnonzero((count > 1) & ~again.astype(bool))
            spans = np.stack([at[hit], np.full(len(hit), window)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * 2), pa.array(spans.ravel()))
            yield pa.RecordBatch.from_arrays([_taken(table.column("region"), hit), lists], names=["region", "spans"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(key, region, spans) for docs (key, text): what of each region stands twice or more in the corpus; null means all of it."""
    cutter = lambda: ByteCutter(window, gram)
    rows = shared_rows(docs, cutter, within=True)
    distinct = cut(rows.groupBy("anchor", "region").agg(F.sum("n").alias("n"), F.min("key").alias("rep")))
    mixed = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1"))
    parts = F.ceil(F.col("m") / F.lit(float(shard))).cast("int")
    several = cut(distinct.join(mixed, "anchor").select("anchor", "region", "n", "rep", parts.alias("parts")))
    texts = region_texts(docs, several.select(F.col("rep").alias("key"), "region"), cutter)
    dealt = several.join(texts, "region").withColumn("part", F.pmod(F.xxhash64("region"), "parts"))
    shards = F.xxhash64("anchor", "part").alias("shard")
    dealt = dealt.select(shards, "region", "n", "parts", "units").repartition("shard").sortWithinPartitions("shard")
    found = cut(dealt.mapInArrow(_shards(window), _SCHEMA))
    classes = found.where("hash IS NOT NULL").select("hash", "region", "at", "again").repartition("hash").sortWithinPartitions("hash")
    merged = classes.mapInArrow(_merge(window), _SPANS)
    spans = found.where("hash IS NULL").select("region", "spans").unionByName(merged)
    spans = spans.groupBy("region").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # no more than a region has bytes
    decided = cut(distinct.join(spans, "region", "left").where("n > 1 OR spans IS NOT NULL").select("region", F.when(F.col("n") == 1, F.col("spans")).alias("spans")))
    return rows.select("key", "region").join(decided, "region")


_SPANS = "region binary, spans array<int>"


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and, if `texts`, kept: the remaining bytes."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    marks = repeated_spans(keyed.select("key", "text"), window, gram, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = ByteCutter(window, gram)
        for batch in batches:
            rows, texts_here = [], [t.as_py() or "" for t in batch.column(1)]
            contents = [t.encode("utf-8", "surrogatepass") for t in texts_here]
            gone = covered(cutter, texts_here, batch.column(2).to_pylist(), list(map(len, contents)))
            for i, kept in enumerate(contents):
                size, spans = len(kept), 0
                if i in gone:
                    out = gone[i]
                    kept = np.frombuffer(kept, dtype=np.uint8)[~out].tobytes()
                    spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
                rows.append((size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            made = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(made[: 5 + texts], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])

    joined = with_marks(keyed, marks).select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
