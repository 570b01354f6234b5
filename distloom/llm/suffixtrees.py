"""Substring dedup by prefix-partitioned suffix trees, over words.

A window is a run of WINDOW words. A word is removed if a window that covers it also starts in a document with
a smaller doc_id. Content-defined regions (see regions) leave few suffixes to look at: those of regions that
differ but share an anchor. A region of one content alone is a tree of a single path: all of it stands first in
the least of its documents.

The suffixes of the others, each with its words up to the end of its region, are split into memory-sized
groups by prefixes of PREFIXES words: the next longer one where more than GROUP suffixes share the shorter. In
each group the suffixes are sorted, and the common prefixes of neighbours give the internal nodes of the group's subtree.
Nodes at least WINDOW words deep are repeats that no further word extends alike; each carries the smallest
doc_id below it. A suffix loses as many words as its deepest node with a smaller doc_id than its own has. Where even the longest
prefix, a whole window, has too many suffixes, they are one deep node: its smallest doc_id is found by aggregation.

Words are compared as they stand, those of more than LONG_WORD bytes by a 128-bit digest; hashes of prefixes only deal suffixes out.

Edge cases: a null or empty text has no words and removes none. A null doc_id counts as larger than any other.
Rows that repeat a doc_id remove nothing from each other. Of equal windows in one document none is earlier. Very long texts are cut in
segments. Extra columns are ignored. An empty table works.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut
from distloom.llm.regions import WordCutter, covered, groups, region_texts, shared_rows, with_marks, words_in_segments

WINDOW = 13
GRAM = 4
#: Words of prefixes; the last is the window.
PREFIXES = (4, 8, WINDOW)
GROUP = 20_000
_CHUNK = 1_000_000
_LAST = (1 << 63) - 1

_FOUND = "region binary, spans array<int>"


def internal_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth and parent of the internal nodes at least `least` deep, and the node right above each suffix (-1: none).

    common[i] is the common prefix, in words, of suffix i and the one before it in sorted order.
    """
    depth: list[int] = []
    parent: list[int] = []
    above: list[int] = []
    path: list[int] = []  # nodes that are still open, from the root
    values = [*common.tolist(), 0]
    for i in range(len(values) - 1):
        before, after = values[i], values[i + 1]
        while path and depth[path[-1]] > before:
            node = path.pop()
            if before >= least and (not path or depth[path[-1]] < before):
                path.append(len(depth))
                depth.append(before)
                parent.append(-1)
            parent[node] = path[-1] if path else -1
        if after >= least and (not path or depth[path[-1]] < after):
            path.append(len(depth))
            depth.append(after)
            parent.append(-1)
        above.append(path[-1] if path else -1)
    for upper, lower in zip(path, path[1:], strict=False):
        parent[lower] = upper
    return np.array(depth, dtype=np.int64), np.array(parent, dtype=np.int64), np.array(above, dtype=np.int64)


#: Between words stands 1, and nothing smaller but the end of a string; 0 and 1 within words become bytes that UTF-8 has not.
_ORDERED = bytes.maketrans(b"\x00\x01\x20", b"\xf8\xf9\x01")


def repeated_depths(suffixes: list[bytes], first: np.ndarray, least: int) -> np.ndarray:
    """For suffixes (words joined by one space): words of the longest prefix, of at least `least`, that also starts in a document smaller than `first`.

    Sorted as strings, with separators below all else, suffixes of a common prefix of words are neighbours.
    """
    texts = np.array([s.translate(_ORDERED) for s in suffixes])
    order = np.argsort(texts, kind="stable")
    width = texts.dtype.itemsize
    ranked = np.zeros((len(texts), width + 1), dtype=np.uint8)  # the last column: every string ends
    ranked[:, :width] = texts[order].view(np.uint8).reshape(len(texts), width)
    ends = np.cumsum(ranked == 1, axis=1, dtype=np.int16)
    differs = ranked[1:] != ranked[:-1]
    apart = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    rows = np.arange(len(apart))
    whole = (ranked[1:][rows, apart] <= 1) & (ranked[:-1][rows, apart] <= 1)  # the word before ends in both
    words = np.where(apart > 0, ends[:-1][rows, np.maximum(apart - 1, 0)], 0) + whole
    words[apart == width] = ends[:-1][apart == width, width] + 1  # equal strings
    common = np.concatenate([[0], np.where(words >= least, words, 0)])
    inner = np.flatnonzero((common > 0) | np.append(common[1:] > 0, False))  # below some node
    out = np.zeros(len(texts), dtype=np.int64)
    depth, parent, above = internal_nodes(common[inner], least)
    if not len(depth):
        return out
    own = first[order[inner]]
    smallest = np.full(len(depth), _LAST)
    np.minimum.at(smallest, above, own)
    for d in sorted(set(depth.tolist()), reverse=True):  # children before their parents
        level = np.flatnonzero((depth == d) & (parent >= 0))
        np.minimum.at(smallest, parent[level], smallest[level])
    node = above.copy()
    while len(up := np.flatnonzero((node >= 0) & (smallest[node] >= own))):
        node[up] = parent[node[up]]
    out[order[inner]] = np.where(node >= 0, depth[node], 0)
    return out


def _subtrees(least: int):
    """(prefix, region, d0, at, units) sorted by prefix to (region, spans): the span of a suffix that an earlier document repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _CHUNK):
            depths = repeated_depths(table.column("units").to_pylist(), table.column("d0").to_numpy(), least)
            hit = np.flatnonzero(depths)
            spans = np.stack([table.column("at").to_numpy()[hit], depths[hit]], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * 2), pa.array(spans.ravel()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(table.column("region").take(pa.array(hit)).chunks or [pa.array([], pa.binary())]), lists], names=["region", "spans"])

    return run


#: Longer words stand in suffixes by their 128-bit digest, so that a suffix has a bounded length.
LONG_WORD = 64


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\xfa" + xxhash.xxh3_128_hexdigest(word).encode()


def _prefixes(window: int, lengths: tuple[int, ...]):
    """For every suffix of (region, d0, units): hashes of its prefixes, counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            found = []
            for units in batch.column(0).to_pylist():
                words = list(map(_short, units.split(b" ")))
                found += [digest(b" ".join(words[i : i + k])) for i in range(len(words) - window + 1) for k in lengths]
            table = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, len(lengths))
            order = np.lexsort(table.T)
            table = table[order]
            new = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])[: len(table)])
            n = np.diff(np.append(new, len(table)))
            yield pa.RecordBatch.from_arrays([*(pa.array(table[new, k]) for k in range(len(lengths))), pa.array(n)], names=[*(f"p{k}" for k in lengths), "n"])

    return run


def _suffixes(window: int, lengths: tuple[int, ...]):
    """For every suffix of (region, d0, units): its prefixes, the digest of its window, and its own words."""
    names = [*(f"p{k}" for k in lengths), "whole", "region", "d0", "at", "units"]
    types = [*[pa.int64()] * len(lengths), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            prefixes, rest = [], []
            for region, first, units in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = units.split(b" ")
                if len(units) > LONG_WORD:
                    words = [_short(w) for w in words] if max(map(len, words)) > LONG_WORD else words
                for i in range(len(words) - window + 1):
                    prefixes += [digest(b" ".join(words[i : i + k])) for k in lengths]
                    rest.append((whole(b" ".join(words[i : i + window])), region, first, i, b" ".join(words[i:])))
            hashes = np.array(prefixes, dtype=np.uint64).view(np.int64).reshape(-1, len(lengths))
            columns = [*(hashes[:, k] for k in range(len(lengths))), *(zip(*rest, strict=True) if rest else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return run, ", ".join(f"{n} {kinds[t]}" for n, t in zip(names, types, strict=True))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP) -> DataFrame:
    """(key, region, spans) for docs (key, text): what of each region also starts in a document with a smaller key; null means all of it."""
    cutter = lambda: WordCutter(window, gram)
    rows = shared_rows(docs, cutter, within=False)
    distinct = cut(rows.groupBy("anchor", "region").agg(F.min("key").alias("d0"), F.max("key").alias("d1")))
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("d0").alias("least"), F.max("d0").alias("most"))
    mixed = cut(mixed.where("m > 1 AND most > least").select("anchor"))
    several = cut(distinct.join(mixed, "anchor", "left_semi").select("region", "d0"))
    texts = region_texts(docs, several.select(F.col("d0").alias("key"), "region"), cutter)
    several = cut(several.join(texts, "region").select("region", "d0", "units"))

    short, longer = prefixes[0], prefixes[1]
    crowded = several.select("units").mapInArrow(_prefixes(window, (short,)), f"p{short} long, n long").groupBy(f"p{short}").agg(F.sum("n").alias("n"))
    crowded = cut(crowded.where(F.col("n") > group).select(f"p{short}"))
    made, schema = _suffixes(window, (short, longer))
    suffixes = several.mapInArrow(made, schema)
    if crowded.limit(1).count():
        both = several.select("units").mapInArrow(_prefixes(window, (short, longer)), f"p{short} long, p{longer} long, n long")
        still = both.join(crowded, f"p{short}", "left_semi").groupBy(f"p{longer}").agg(F.sum("n").alias("n"))
        still = cut(still.where(F.col("n") > group).select(f"p{longer}"))
        flagged = suffixes.join(crowded.withColumn("crowded", F.lit(True)), f"p{short}", "left").join(still.withColumn("still", F.lit(True)), f"p{longer}", "left")
        prefix = F.when(F.col("crowded"), F.col(f"p{longer}")).otherwise(F.col(f"p{short}"))
        dealt = flagged.where("crowded IS NULL OR still IS NULL").select(prefix.alias("prefix"), "region", "d0", "at", "units")
        nodes = suffixes.select(f"p{short}", f"p{longer}", "whole", "region", "d0", "at")
        nodes = cut(nodes.join(crowded, f"p{short}", "left_semi").join(still, f"p{longer}", "left_semi").select("whole", "region", "d0", "at"))
        least = cut(nodes.groupBy("whole").agg(F.min("d0").alias("least")))
        late = nodes.join(least, "whole").where("least < d0").select("region", F.array("at", F.lit(window)).alias("spans"))
    else:  # no prefix to lengthen
        dealt, late = suffixes.select(F.col(f"p{short}").alias("prefix"), "region", "d0", "at", "units"), None
    found = dealt.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(window), _FOUND)
    found = found if late is None else found.unionByName(late)
    spans = found.groupBy("region").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a region has few suffixes

    decided = cut(distinct.join(spans, "region", "left").where("d1 > d0 OR spans IS NOT NULL").select("region", "d0", "spans"))
    marks = rows.select("key", "region").join(decided, "region")
    return marks.where("key > d0 OR spans IS NOT NULL").select("key", "region", F.when(F.col("key") == F.col("d0"), F.col("spans")).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and, if `texts`, kept: the remaining words joined by one space."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("key"), "text")
    marks = repeated_spans(keyed.select("key", "text"), window, gram, prefixes, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter(window, gram)
        for batch in batches:
            counts, removed, hashes, kept_texts = [], [], [], []
            texts_here = [t.as_py() or "" for t in batch.column(1)]
            for text in texts_here:
                counts.append(sum(len(words) for _, words in words_in_segments(text)))
            gone = covered(cutter, texts_here, batch.column(2).to_pylist(), counts)
            for i, text in enumerate(texts_here):
                digest, parts, out = hashlib.sha256(), [], gone.get(i)
                for base, words in words_in_segments(text):
                    if out is not None:
                        words = list(compress(words, (~out[base : base + len(words)]).tolist()))
                    if words:
                        part = b" ".join(words) if not parts else b" " + b" ".join(words)
                        digest.update(part)
                        parts.append(part if texts else b"")
                removed.append(0 if out is None else int(np.count_nonzero(out)))
                hashes.append(digest.hexdigest())
                kept_texts.append(b"".join(parts))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())]
            if texts:
                columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    joined = with_marks(keyed, marks).select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
