"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and MOST that give every source its target words, those are taken that stay
closest to one copy of each document in relative entropy, sum(r ln r - r + 1). They are exponential in a document's
tokens: rate = min(MOST, exp(tilt * size)), with one tilt a source, the multiplier of its token constraint: where a
source is to shrink its long documents give way first, where it is to grow they are repeated first. The bound is
part of the problem, so its multipliers are in the dual: a document at the bound no longer adds to the curvature. The
tilts minimise the convex dual; Newton steps for all sources at once, kept within a bracket, take gradient and Hessian
from one aggregation a step over distinct (source, size) pairs, counted beforehand so that a hot source combines
before the shuffle.

Rates become copies: the whole part, and one more for a random set of documents by sequential Poisson sampling: documents are
ordered by u / fraction, u a hash of the row, and taken until the source's words are reached. The order is cut into cells; only
the cell in which the target falls is ordered row by row, so no task sorts a whole source. One more document, of the size nearest
to the words still missing, then closes the gap.

Edge cases: a null or empty text has size 0, is under no constraint, and stays once. A null source is a source of its own,
last. A row is told by doc_id and text; rows that repeat both are decided alike, and none of them closes a gap. Documents of equal
size in one source have equal rates; chance by hash decides between them. A source all of whose documents are at
the bound, since its target is MOST times its size, takes MOST copies of each. All sizes 0: targets are 0. Long texts are
only counted. Extra columns are ignored by `plan` and kept by `mix`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distloom.llm.common import cut, cut_observed, discard

WEIGHTS = (5, 2, 1)
MOST = 3.0
CELLS = 1024
#: Newton steps at most, the gap at which they end, and the longest step in units of tilt * mean size.
STEPS = 80
TOLERANCE = 1e-9
LEAP = 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): shares of all words by weight, none above `most` times its source.

    Sharing the excess again until none is above it gives target = min(most * size, level * weight), with one
    level for all; ordered by size / weight, it is the largest level at which a source stays below its cap.
    One row a source, so these are small tables.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("all_size") - F.col("capped")) / F.col("open_weight")
    below = level * F.col("weight") <= F.lit(most) * F.col("source_size")
    levelled = filled.withColumn("level", F.max(F.when(below, level)).over(every))
    return levelled.select("source", "source_size", "weight", F.least(F.lit(most) * F.col("source_size"), F.col("level") * F.col("weight")).cast("double").alias("target"))


def _same_source(a: DataFrame, b: DataFrame, kind: str = "inner") -> DataFrame:
    b = b.withColumnRenamed("source", "source_b")
    return a.join(b, a.source.eqNullSafe(b.source_b), kind).drop("source_b")


def balance(sizes: DataFrame, aims: DataFrame, most: float = MOST) -> DataFrame:
    """(source, tilt) that solve the dual for documents (source, size) and targets (source, target)."""
    counted = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted.select("source", "size", (F.col("size") * F.col("n")).cast("double").alias("words"), "n"))
    means = counted.groupBy("source").agg((F.sum("words") / F.sum("n")).alias("mean"), F.sum("words").alias("all"))
    bounded = F.col("target") >= F.col("all") * F.lit(most * (1 - 1e-12))  # every document at the bound: no finite tilt
    unknown = F.lit(None).cast("double")
    start = _same_source(aims.where("target > 0").select("source", "target"), means)
    state = cut(start.select("source", "target", "mean", F.when(bounded, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("x"), unknown.alias("low"), unknown.alias("high"), F.when(bounded, 0.0).otherwise(1.0).alias("gap")))
    for _ in range(STEPS):
        # x is the tilt in units of the mean size. Gradient: words taken less the target; Hessian: over documents below the bound.
        open_rows = _same_source(counted.select("source", "size", "words"), state.where(F.col("gap") > TOLERANCE).select("source", "mean", "x"))
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.col("x") * z)
        sums = open_rows.groupBy("source").agg(
            F.sum(F.col("words") * F.least(F.lit(most), rate)).alias("taken"), F.sum(F.when(rate < F.lit(most), F.col("words") * z * rate)).alias("curve")
        )
        met = _same_source(state, sums, "left")
        gradient = F.col("taken") - F.col("target")
        low, high = F.when(gradient < 0, F.col("x")).otherwise(F.col("low")), F.when(gradient > 0, F.col("x")).otherwise(F.col("high"))
        met = met.withColumns({"low": low, "high": high, "gap": F.when(F.col("taken").isNull(), F.col("gap")).otherwise(F.abs(gradient) / F.col("target"))})
        leap = F.greatest(F.lit(LEAP), F.abs("x"))
        step = F.coalesce(F.col("x") - (F.col("taken") - F.col("target")) / F.col("curve"), F.col("x") - F.signum(F.col("taken") - F.col("target")) * leap)
        step = F.greatest(F.col("x") - leap, F.least(F.col("x") + leap, step))
        inside = (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        x = F.when(F.col("taken").isNull() | (F.col("gap") <= TOLERANCE), F.col("x")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        then = state
        state, seen = cut_observed(met.select("source", "target", "mean", x.alias("x"), "low", "high", "gap"), gap=F.max("gap"))
        discard(then)
        if (seen["gap"] or 0.0) <= TOLERANCE:
            break
    discard(counted)
    # Sums of doubles depend on their order in the last digits; rounded, reruns decide alike.
    return cut(state.select("source", (F.round("x", 9) / F.col("mean")).alias("tilt")))


def rates(sizes: DataFrame, solved: DataFrame, most: float = MOST) -> DataFrame:
    """Adds rate, its whole part and its fraction, and the place of the row (doc_id, tag, source, size) in its source's random order."""
    joined = _same_source(sizes, solved, "left")
    rate = F.when(F.col("size") > 0, F.least(F.lit(most), F.exp(F.coalesce("tilt", F.lit(0.0)) * F.col("size")))).otherwise(F.lit(1.0))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    rated = joined.withColumn("rate", near).withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    u = (F.pmod(F.xxhash64("tag", F.lit("mix")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    return rated.withColumn("xi", F.when(F.col("part") > 0, u / F.col("part"))).drop("tilt")


def copies(rated: DataFrame, aims: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row a source: `edge`, up to which place in the order documents get a further copy, and `closing`, the tag of one more."""
    cell = F.floor(F.col("xi") / (F.lit(1.0) + F.col("xi")) * F.lit(cells)).cast("long")
    due = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("given"))
    due = cut(_same_source(aims, due).select("source", (F.col("target") - F.col("given")).alias("due")))
    open_rows = rated.where("part > 0 AND size > 0").select("tag", "source", "size", "xi", cell.alias("cell"))
    filled = open_rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = _same_source(filled.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))), due)
    crossing = cut(filled.where("before <= due AND before + words > due").select("source", "cell", "before", "due"))
    inside = crossing.withColumnsRenamed({"source": "source_b", "cell": "cell_b"})
    inside = open_rows.join(inside, open_rows.source.eqNullSafe(inside.source_b) & (open_rows.cell == inside.cell_b)).drop("source_b", "cell_b")
    order = Window.partitionBy("source", "cell").orderBy("xi").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("reached", F.col("before") + F.sum("size").over(order))
    within = inside.groupBy("source").agg(F.max(F.when(F.col("reached") <= F.col("due"), F.col("xi"))).alias("edge_in"), F.max(F.when(F.col("reached") <= F.col("due"), F.col("reached"))).alias("reached"))
    edges = _same_source(due, _same_source(crossing.drop("due"), within, "left"), "left")
    # No crossing cell: all of a source's fractions are due, or none.
    start = F.col("cell") / F.lit(float(cells))
    edge = F.when(F.col("cell").isNull(), F.when(F.col("due") > 0, F.lit(float("inf"))).otherwise(F.lit(-1.0))).otherwise(F.coalesce("edge_in", F.least(start / (1 - start), F.lit(1e300)) * (1 - 1e-12)))
    missing = F.when(F.col("cell").isNull(), 0.0).otherwise(F.col("due") - F.coalesce("reached", "before"))
    edges = cut(edges.select("source", edge.alias("edge"), missing.alias("missing")))
    spare = _same_source(open_rows, edges).where("xi > edge AND abs(size - missing) < missing")
    spare = spare.groupBy("source", "tag", "size", "xi", "missing").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    closing = spare.groupBy("source").agg(F.min_by("tag", F.struct(F.abs(F.col("size") - F.col("missing")), F.col("xi"), F.col("tag"))).alias("closing"))
    return cut(_same_source(edges.select("source", "edge"), closing, "left"))


def _copies() -> Column:
    """Copies of a rated row that has met its source's decisions."""
    taken = (F.col("xi") <= F.col("edge")) | F.coalesce(F.col("tag") == F.col("closing"), F.lit(False))
    return F.col("whole") + F.when((F.col("part") > 0) & taken, 1).otherwise(0)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tag"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every document."""
    sizes = cut(_sizes(docs))
    aims = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    rated = cut(rates(sizes, balance(sizes, aims, most), most))
    decided = _same_source(_same_source(rated, copies(rated, aims)), aims)
    return decided.select("doc_id", "source", "size", "source_size", "target", "rate", _copies().alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts meet only the small tables of sources."""
    sizes = cut(_sizes(docs))
    aims = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    solved = balance(sizes, aims, most)
    decisions = copies(cut(rates(sizes, solved, most)), aims)
    rows = docs.select(F.struct(*map(F.col, docs.columns)).alias("row"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tag"))
    decided = _same_source(rates(rows, solved, most), decisions, "left").withColumn("copies", _copies())
    return decided.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
