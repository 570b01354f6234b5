"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight positional bytes.
Lists of single bytes would hold a 256th of all fingerprints each, so postings are dealt by four bytes first: the
fourteen sets of four positions whose XOR is zero. Any three positions lie together outside one of these sets,
hence two fingerprints that differ in at most three bytes meet in a list. Within a list an inverted index of
the four other positions tallies the bytes that a fingerprint shares with each member; members with the guaranteed
five of eight stay and are verified by their differing bits. A search from member to member emits one edge for
each fingerprint it reaches, never all pairs, and goes on only among those not yet reached. Exact copies collapse to one
fingerprint before anything else.

`keep_one` is the filter of near copies. It links texts whose sets of shingles have a Jaccard coefficient of the
given similarity or more: the index proposes the closest pairs, near_copies adds those whose fingerprints lie farther apart, and
whole sets verify both.

Edge cases: a text without words, null or empty, has fingerprint 0 and is linked like any other. Repeated
rows are copies of each other. A null doc_id is never the smallest of a group. Very long texts are hashed in pieces. Ties
cannot matter: groups are connected parts. Extra columns are ignored. An empty table works.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut, cut_observed, discard, stay, text_key

SEED = 42
SHINGLE = 3
BITS = 3
#: Positional bytes that fingerprints within BITS bits share at least.
SHARED = 8 - BITS
_CHUNK = 1 << 16

#: The sets of four byte positions by which postings are dealt.
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
MASKS = [sum(0xFF << (8 * p) for p in q) for q in QUADS]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, repeats included; of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.array([digest(s, SEED) for s in runs], dtype=np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes as an unsigned number: bits set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = words_of(text)
    return print_of(shingle_hashes(words, size)) if words else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class ByteIndex:
    """The members of one list, posted under each byte of the positions that they do not share already."""

    def __init__(self, members: np.ndarray, quad: tuple[int, ...]):
        self.members, self.open = members, [p for p in range(8) if p not in quad]
        self.postings = []
        for p in self.open:
            byte = (members >> np.uint64(8 * p)).astype(np.uint8)
            order = np.argsort(byte, kind="stable")
            self.postings.append((order, np.searchsorted(byte[order], np.arange(257))))

    def near(self, print_: np.uint64) -> np.ndarray:
        """Members within BITS bits: tallied over the postings of its bytes, then verified."""
        hits = [order[at[b] : at[b + 1]] for (order, at), b in zip(self.postings, (int(print_) >> 8 * p & 0xFF for p in self.open), strict=True)]
        tally = np.bincount(np.concatenate(hits), minlength=len(self.members)) + 4
        enough = np.flatnonzero(tally >= SHARED)
        return enough[np.bitwise_count(self.members[enough] ^ print_) <= BITS]


def list_edges(members: np.ndarray, quad: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For one posting list (distinct members): edges from the root of each connected part to its other members."""
    roots, others = [], []
    alive, index, place = np.ones(len(members), dtype=bool), ByteIndex(members, quad), np.arange(len(members))
    for at in range(len(members)):
        if not alive[at]:
            continue
        alive[at], queue = False, [at]
        while queue and (left := np.count_nonzero(alive)):
            if 2 * left < len(place):  # post again only what is not reached yet
                place = np.flatnonzero(alive)
                index = ByteIndex(members[place], quad)
            found = place[index.near(members[queue.pop()])]
            found = found[alive[found]]
            if len(found):
                alive[found] = False
                queue.extend(found.tolist())
                roots.append(np.full(len(found), members[at]))
                others.append(members[found])
    return roots, others


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads postings (which, bytes, fp) sorted by list; keeps the list that a batch may have cut for the next one."""
    kept: list[list[np.ndarray]] = []

    def closed(which: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
        roots, others = [], []
        for g in np.flatnonzero(ends - starts > 1):
            a, b = list_edges(np.unique(fp[starts[g] : ends[g]].view(np.uint64)), QUADS[which[starts[g]]])
            roots += a
            others += b
        if roots:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (others, roots)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        which, key, fp = (c.to_numpy() for c in batch.columns)
        cutoff = np.flatnonzero((which != which[-1]) | (key != key[-1]))
        cutoff = cutoff[-1] + 1 if len(cutoff) else 0
        same = kept and kept[0][0][0] == which[0] and kept[0][1][0] == key[0]
        if kept and (cutoff or not same):
            whole = [np.concatenate([*(k[i] for k in kept), c[:cutoff]]) for i, c in enumerate((which, key, fp))]
            kept = []
            yield from closed(*whole)
        elif cutoff:
            yield from closed(which[:cutoff], key[:cutoff], fp[:cutoff])
        kept.append([which[cutoff:], key[cutoff:], fp[cutoff:]])
    if kept:
        yield from closed(*(np.concatenate([k[i] for k in kept]) for i in range(3)))


def near_edges(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (column fp) within BITS bits: as many as are reached, not all pairs."""
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    posting = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    lists = distinct.select("fp", posting.alias("p")).select("p.which", "p.key", "fp")
    lists = lists.repartition("which", "key").sortWithinPartitions("which", "key")
    return lists.mapInArrow(_edges, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that it reaches.

    Large-star and small-star rounds, each written to the shared folder; only two numbers of a round reach the driver.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        table, seen = cut_observed(e, n=F.count(F.lit(1)), digest=F.expr("bit_xor(xxhash64(u, v))"))
        return table, (seen["n"], seen["digest"])

    now, before = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        then = now
        now, after = written(stars(then))
        discard(then)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id that links of up to BITS bits reach."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = components(near_edges(distinct))
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = cut(rooted.join(least, "root").select("fp", "component_id"))  # written, so that both sides of the join are plain and hot prints can be split
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def proposed(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of ids whose fingerprints are equal or linked by the index, for sets (id, fp): a tree over each group."""
    least = cut(sets.groupBy("fp").agg(F.min("id").alias("least")))
    equal = sets.select("id", "fp").join(least, "fp").where("id != least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    edges = near_edges(least.select("fp"))
    of = lambda name: least.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_id"))
    return equal.unionByName(edges.join(of("u"), "u").join(of("v"), "v").select(F.col("v_id").alias("u"), F.col("u_id").alias("v")))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that are the least of their group of near copies, by doc_id and text. Rows that repeat both stay once."""
    from distloom.llm import near_copies

    sets = near_copies.shingle_sets(docs, shingle, similarity)
    linked = near_copies.grouped(docs, sets, proposed(sets), shingle, similarity)
    roots = sets.select("id", F.col("key").alias("text_key")).join(linked, "id", "left").select("text_key", F.coalesce("root", "id").alias("root"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"))
    return stay(docs, cut(rows.join(roots, "text_key")))
