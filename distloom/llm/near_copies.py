"""Links between texts whose sets of word shingles have a Jaccard coefficient of at least `similarity`. All of them.

At 0.8 two SimHashes differ in about ten of 64 bits, beyond any index of equal bytes. Prefix filtering reaches
these pairs: shingle hashes are put in one order for all texts; a set of n posts its n - ceil(similarity * n) + 1 first ones,
and two sets that reach the similarity share a posting. Any order gives all pairs; here shingles that are
frequent in a sample of the texts come last, so that few lists are long. Candidates fit in length, share a posting early
enough for the similarity, differ in no more parity bits than it allows, share enough of their prefixes, and are verified by their whole sets: first each member of a list against the list's smallest, together
with the pairs that the SimHash index proposes; what these link is one group. Then members of different groups that share a
list and fit in length are compared, so that many copies of one text do not meet each other in all pairs.

Texts move only where a pair asks for them: a sieve of bounded size holds back the others. A text that many pairs
ask for is dealt over several tasks.

Edge cases: letter case (A-Z) and ASCII space do not count. A text of fewer words than a shingle has its whole word
sequence as one shingle; texts without words, null or empty, are copies of each other. Equal texts are one
from the start, told by 128 bits. Extra columns are ignored. An empty table works.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distloom.llm.common import cut, discard, sieve, text_key
from distloom.llm.simhash import components, print_of, shingle_hashes, words_of

#: One text in SAMPLE is counted for the order; shingles of at least FREQUENT of them, MOST_FREQUENT at most, come last.
SAMPLE = 16
FREQUENT = 4
MOST_FREQUENT = 200_000
#: Members of a group that one task compares with the group's centre.
FAN = 512
#: Longs of a set's parity bits, and of their folded form that postings carry.
PARITY = 16
FOLDED = 4


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), size).view(np.int64))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls to each of 64 * PARITY bits, as longs.

    Two sets differ in at least as many elements as their parities differ in bits.
    """
    odd = np.bincount(hashes & (64 * PARITY - 1), minlength=64 * PARITY).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


_BITS = [f"b{i}" for i in range(PARITY)]


def _folded(name: str) -> list[Column]:
    """Parities of FOLDED longs: bits that fall together are parities of both."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"b{i}") for i in range(k, PARITY, FOLDED)]).alias(f"{name}{k}") for k in range(FOLDED)]


def frequent_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold; at most MOST_FREQUENT reach the driver."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["s"])

    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(made, "s long")
    counted = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return np.array(sorted(r.s for r in counted.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect()), dtype=np.int64)


def shingle_sets(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, key, fp, n, prefix, b0, ...) of every distinct text: its number, 128-bit key, SimHash, size of its set, the set's prefix and parity. Written out."""
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    repeated = texts.groupBy("key").count().where("count > 1").select("key")
    maybe, once = sieve(texts, repeated, "key")
    distinct = maybe.dropDuplicates(["key"]).unionByName(once)
    frequent = frequent_shingles(texts, size)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, found, bits = [], [], [], [np.zeros((0, PARITY), dtype=np.int64)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                every = shingle_hashes(words, size)
                prints.append(print_of(every) if words else 0)
                hashes = np.unique(every.view(np.int64))
                sizes.append(len(hashes))
                bits.append(parity(hashes)[None])
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
                    hashes = np.concatenate([hashes[~late], hashes[late]])
                found.append(hashes[: prefix_length(sizes[-1], similarity)])
            columns = [batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(found)]
            columns += [pa.array(c) for c in np.ascontiguousarray(np.concatenate(bits).T)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "n", "prefix", *_BITS])

    made_sets = distinct.mapInArrow(made, "key binary, fp long, n int, prefix array<long>, " + ", ".join(f"{b} long" for b in _BITS))
    return cut(made_sets.select(F.monotonically_increasing_id().alias("id"), "*"))  # numbers hold from here on: they are written


def _needed(similarity: float) -> Column:
    """Elements that sets of nu and nv share at least if they reach the similarity."""
    return F.ceil((F.col("nu") + F.col("nv")) * F.lit(similarity / (1 + similarity)) - 1e-9)


def _alike(similarity: float, longs: int) -> Column:
    """Whether parities (b0, ... of u; c0, ... of v) allow the similarity."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(longs)])
    return apart <= F.col("nu") + F.col("nv") - 2 * _needed(similarity)


def _enough(similarity: float) -> Column:
    """Whether prefixes pu and pv share enough: what two sets share besides lies behind the prefix that ends first."""
    rest = F.greatest(F.col("nu") - F.size("pu"), F.col("nv") - F.size("pv"))
    return F.size(F.array_intersect("pu", "pv")) + rest >= _needed(similarity)


def _early(similarity: float) -> Column:
    """Whether a posting at places pu and pv, if it is the first that two sets share, leaves enough of both, and their sizes fit."""
    rest = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv"))
    return (F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(similarity) - 1e-9) & (rest >= _needed(similarity))


def _compared(size: int, similarity: float):
    """For (u, v, text) sorted by group, the centre u (v null) before the members: the pairs that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.int64)
        for batch in batches:
            us, vs = [], []
            for u, v, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = shingles(text, size)
                if v is None:
                    centre, own = u, found
                    continue
                assert u == centre
                both = len(np.intersect1d(own, found, assume_unique=True))
                if both >= (len(own) + len(found) - both) * similarity - 1e-9:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the similarity, written out."""
    of_u = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), *_BITS)
    of_v = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), *[F.col(b).alias(f"c{i}") for i, b in enumerate(_BITS)])
    pairs = cut(pairs.distinct().join(of_u, "u").join(of_v, "v").where(_alike(similarity, PARITY)).select("u", "v"))
    asked, _ = sieve(sets.select("id", "n", "prefix"), pairs.select(F.explode(F.array("u", "v")).alias("id")), "id")
    of_u = asked.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("prefix").alias("pu"))
    of_v = asked.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("prefix").alias("pv"))
    pairs = cut(pairs.join(of_u, "u").join(of_v, "v").where(_enough(similarity)).select("u", "v"))
    parts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
    centres = parts.select(F.col("u").alias("id"), "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"))
    members = pairs.join(parts, "u").select(F.col("v").alias("id"), "u", F.pmod(F.hash("v"), "parts").alias("part"), "v")
    roles = cut(centres.unionByName(members).join(sets.select("id", "key"), "id").select("key", "u", "part", "v"))
    texts, _ = sieve(docs.select(text_key(F.col("text")).alias("key"), "text"), roles, "key")
    rows = roles.join(texts.dropDuplicates(["key"]), "key").select("u", "v", "text", "part").repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    found = cut(rows.select("u", "v", "text").mapInArrow(_compared(size, similarity), "u long, v long"))
    discard(roles)
    discard(pairs)
    return found


def _contested(left: DataFrame) -> DataFrame:
    """The postings (s, known, length, ...) whose list holds a member of another group of nearly its own length; only these can make a pair."""
    whole = Window.partitionBy("s")
    near = whole.orderBy("length").rangeBetween(-1, 1)
    several = lambda over: F.min("known").over(over) != F.max("known").over(over)
    return left.withColumn("several", several(whole)).where("several").withColumn("several", several(near)).where("several").drop("several")


def grouped(docs: DataFrame, sets: DataFrame, proposed: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, root) of the sets that are linked to others: links of the similarity or more connect a group, whose least id is its root."""
    posted = sets.select("id", "n", F.posexplode("prefix").alias("p", "s"))
    whole = Window.partitionBy("s")
    lists = posted.select("*", F.count(F.lit(1)).over(whole).alias("members"), F.min(F.struct("id", "n", "p")).over(whole).alias("first"))
    lists = cut(lists.where("members > 1").select("s", "id", "n", "p", "first"))
    star = lists.where(F.col("first.id") != F.col("id"))
    star = star.select(F.col("first.id").alias("u"), F.col("first.n").alias("nu"), F.col("first.p").alias("pu"), F.col("id").alias("v"), F.col("n").alias("nv"), F.col("p").alias("pv"))
    star = star.where(_early(similarity)).select("u", "v").unionByName(proposed)
    first = components(verified(star, sets, docs, size, similarity))
    known = first.select(F.col("node").alias("id"), F.col("root").alias("known"))
    left = lists.select("s", "id", "n", "p").join(known, "id", "left").withColumn("known", F.coalesce("known", "id"))
    length = F.floor(F.log("n") / F.lit(-math.log(similarity)) + 1e-9).cast("int")
    left = _contested(left.withColumn("length", length)).select("s", "id", "n", "p", "known", "length")
    left = cut(left.join(sets.select("id", *_folded("b")), "id"))
    discard(lists)
    a = left.select("s", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("known").alias("ku"), *[f"b{i}" for i in range(FOLDED)], F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("length"))
    b = left.select("s", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("p").alias("pv"), F.col("known").alias("kv"), *[F.col(f"b{i}").alias(f"c{i}") for i in range(FOLDED)], "length")
    shorter = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    pairs = a.join(b.hint("merge"), ["s", "length"]).where(shorter & (F.col("ku") != F.col("kv")) & _early(similarity) & _alike(similarity, FOLDED)).select("u", "v")
    more = verified(pairs, sets, docs, size, similarity)
    discard(left)
    # Groups that `more` joins: components of the few groups it names.
    root = lambda name: known.select(F.col("id").alias(name), F.col("known").alias(f"root_{name}"))
    named = more.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    joined = components(named).select(F.col("node").alias("known"), F.col("root").alias("last"))
    alone = joined.select(F.col("known").alias("id"), F.col("last").alias("root")).join(known.select("id"), "id", "left_anti")
    return known.join(joined, "known", "left").select("id", F.coalesce("last", "known").alias("root")).unionByName(alone)
