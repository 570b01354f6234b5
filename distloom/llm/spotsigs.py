"""Document fingerprints by spot signatures. DataFrame functions only.

Spots are places of common words. Which words these are is decided language by language, so that a small language has
spots as well: of each, the COMMON words that stand in most of its documents, counted over all of them; the lists together
serve every text, so equal texts have equal fingerprints whatever their language is said to be. A
spot that a content word follows gives one signature: the common word and the chain of the next CHAIN content
words, common words between them skipped, hashed to a long. A document's fingerprint is the set of its
signatures; likeness is the Jaccard coefficient of two sets. `similar_pairs` finds all pairs above a
threshold: sets that are equal form one class; classes are partitioned by set length so that a set meets only
sets whose length allows the threshold, are looked up through their rarest signatures, and are verified.

Edge cases: a text without spots (empty, null, or of common words alone) has one signature, the hash of its
whole word sequence, so that only equal sequences are alike. Ties of doc_id are ordered by text; null doc_ids
come last, all in one range. A table of one document has itself as its next. A null language is a language of its own; a table without
column `lang` has one. Very long texts take time in proportion to their length. Extra columns are ignored. An empty table works.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distloom.llm.common import ascii_lower, cut, words_between

#: Common words of a language, and languages that have a list: those of most documents.
COMMON = 60
LANGUAGES = 64
CHAIN = 2
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Characters of text in a range of doc_ids, and ranges at most.
RANGE = 4_000_000
MOST_RANGES = 50_000


def words(text: Column) -> Column:
    return words_between(ascii_lower(text), SEPARATORS)


def common_words(docs: DataFrame, n: int = COMMON) -> list[str]:
    """For each language the n words that stand in most of its documents (ties: by word), together; at most n * LANGUAGES."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    texts = docs.select(lang.alias("lang"), "text")
    often = Window.orderBy(F.desc("n"), F.col("lang").asc_nulls_last())
    chosen = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(often)).where(F.col("place") <= LANGUAGES)
    langs = [r["lang"] for r in chosen.collect()]
    known = F.col("lang").isin([x for x in langs if x is not None]) | (F.col("lang").isNull() if None in langs else F.lit(False))
    seen = texts.where(known).select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    counted = seen.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # limited before the shuffle, map by map
    return sorted({r["word"] for r in counted.withColumn("place", place).where(F.col("place") <= n).select("word").collect()})


def with_signatures(df: DataFrame, text: str, name: str, common: list[str], chain: int = CHAIN) -> DataFrame:
    """Adds the sorted array of distinct signatures of column `text`.

    Each step is a column that later ones read more than once, so that it is computed once a row.
    """
    w, spot, content, start = (f"__{name}_{x}" for x in ("words", "spot", "content", "start"))
    upto = lambda n: F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(spot, F.transform(w, lambda x: x.isin(common)))
    df = df.withColumn(content, F.filter(upto(F.size(spot) - 1), lambda i: ~F.get(F.col(spot), i)))
    follows = lambda k: (F.get(F.col(content), k) > 0) & F.coalesce(F.get(F.col(spot), F.get(F.col(content), k) - 1), F.lit(False))
    df = df.withColumn(start, F.filter(upto(F.size(content) - chain), follows))
    word = lambda i: F.get(F.col(w), i)
    made = F.transform(start, lambda k: F.xxhash64(word(F.get(F.col(content), k) - 1), *[word(F.get(F.col(content), k + j)) for j in range(chain)]))
    whole = F.array(F.xxhash64(F.array_join(w, " "), F.lit("whole")))
    df = df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size(start) > 0, made).otherwise(whole))))
    return df.drop(w, spot, content, start)


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def digest(signatures: str) -> Column:
    """A printable fingerprint: the SHA-256 of the set."""
    return F.sha2(F.array_join(F.col(signatures).cast("array<string>"), ","), 256)


def range_bounds(docs: DataFrame, size: int = RANGE) -> tuple[list[int], int | None]:
    """doc_ids that split the table into ranges of about `size` characters, and the smallest doc_id; at most MOST_RANGES."""
    row = docs.agg(F.sum(F.length("text")).alias("all"), F.min("doc_id").alias("least")).first()
    ranges = max(2, min(MOST_RANGES, math.ceil((row["all"] or 0) / size)))
    shares = [i / ranges for i in range(1, ranges)]
    # Ends of ranges are ids that stand in the table, by rank of rows.
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges)).alias("b")).first()["b"]
    return sorted(set(bounds or []) - {row["least"]}), row["least"]


def _range(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are not above doc_id: first among every so many-th bound, then in the stretch that this names."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    long_array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    coarse = below(long_array(bounds[step - 1 :: step])) * step
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(coarse + below(F.slice(long_array(bounds), coarse + 1, F.lit(step))))


def with_next(docs: DataFrame, carried: list[str], size: int = RANGE) -> DataFrame:
    """(doc_id, *carried, next_*) for docs (doc_id, text, ...): carried columns of the next document by doc_id, after the last those of the first.

    Rows move once, to the task of their range of doc_ids. The first document of each range also goes, as a ghost, to the
    end of the range before, and the first of all to the last range, so ranges need nothing of each other.
    """
    bounds, least = range_bounds(docs, size)
    docs = docs.select("doc_id", *carried).withColumn("range", _range(F.col("doc_id"), bounds))
    place = lambda number, ghost: F.struct(number.cast("int").alias("range"), F.lit(ghost).alias("ghost"))
    first = F.lit(False)
    if bounds:
        first = F.coalesce(F.get(F.array(*map(F.lit, bounds)).cast("array<bigint>"), F.col("range") - 1) == F.col("doc_id"), F.lit(False))
    opens = F.lit(True) if least is None else F.coalesce(F.col("doc_id") == least, F.lit(False))
    places = F.array_compact(F.array(place(F.col("range"), 0), F.when(first, place(F.col("range") - 1, 1)), F.when(opens, place(F.lit(len(bounds)), 2))))
    dealt = docs.select("doc_id", *carried, F.explode(places).alias("place")).select("doc_id", *carried, "place.*")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range"))
    order = Window.partitionBy("range").orderBy((F.col("ghost") == 2), F.col("doc_id").asc_nulls_last(), F.col("ghost"), F.col("text"))
    following = dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("ghost = 0")
    return following.select("doc_id", *carried, *[F.col(f"next.{c}").alias(f"next_{c}") for c in carried])


def likeness(docs: DataFrame, common: list[str] | None = None, size: int = RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited and to the next text."""
    common = common_words(docs) if common is None else common
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signatures(texts, "text", "own", common), ["text", "own"], size)  # signatures move with their text
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "changed", common)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest("own").alias("fingerprint"),
        digest("changed").alias("edited_fingerprint"),
        jaccard("own", "changed").alias("near_edited"),
        jaccard("own", "next_own").alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
    )


def classes(docs: DataFrame, common: list[str] | None = None) -> DataFrame:
    """(doc_id, class_id, signatures): documents of equal sets share the smallest doc_id as class_id."""
    common = common_words(docs) if common is None else common
    signed = cut(with_signatures(docs.select("doc_id", "text"), "text", "signatures", common).withColumn("print", digest("signatures")).select("doc_id", "signatures", "print"))
    least = signed.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    return signed.join(least, "print").select("doc_id", "class_id", "signatures")


def similar_pairs(classed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard) for all pairs of classes at or above the threshold.

    A set of n signatures goes to the partition of its length, in steps of 1/threshold, so that partners lie in
    its own or the next one. Its n - ceil(threshold * n) + 1 rarest signatures are its postings there; two sets
    that meet the threshold share one of them.
    """
    reps = cut(classed.where(F.col("doc_id") == F.col("class_id")).dropDuplicates(["class_id"]).select("class_id", "signatures"))
    flat = reps.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    rarity = flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = flat.join(rarity, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    # Signatures of a single class come first in the order, and can be in no intersection: they use up the prefix.
    spare = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - F.size("o"))
    prefix = ordered.where(spare > 0).select("class_id", "n", F.explode(F.slice("o", F.lit(1), spare.cast("int"))).alias("p"))
    length = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    posted = prefix.select("class_id", "n", F.col("p.s").alias("s"), length.alias("length"))
    a = posted.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("length"))
    b = posted.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", "length")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["s", "length"]).where(shorter & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    sets = reps.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa"))
    other = reps.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb"))
    return pairs.join(sets, "a").join(other, "b").select("a", "b", jaccard("sa", "sb").alias("jaccard")).where(F.col("jaccard") >= threshold)
