"""The index job: lines of many dists and products to entries with payload offsets, warnings and errors.

Existence of a subproduct is membership of the dist's listing, with letter case; host paths are never probed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from distloom.functions import columns as C
from distloom.plans.stored import stored

HEADER = 13  # bytes before the first record of an image
KEY = ["dist", "product", "line_no"]
#: Lines of one stretch of an image that one task sums up.
STRETCH = 1 << 16
#: Columns from which offsets, paths, warnings and errors come.
_NEEDED = ["ftype", "fname", "subproduct", "payload_size", "status", "no_image"]


@dataclass(frozen=True)
class Index:
    entries: DataFrame
    warnings: DataFrame
    errors: DataFrame


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row a non-blank line: its fields, and `status`: null if accepted, else the warning.

    Which token names an image is asked once for all lines of a dist whose tokens may name the same images: an equi-join of
    these few rows with the dist's files. The answers are written, so that the engine knows their size and broadcasts
    them where they are small. `no_image` tells lines whose subproduct no file of the dist is.
    """
    rows = lines.where(~C.is_blank(F.col("line"))).select(*KEY, C.tokens(F.col("line")).alias("t"))
    rows = rows.withColumn("tail", F.when(F.size("t") >= 7, F.slice("t", 7, 1 << 30)).otherwise(F.array().cast(C.NO_STRINGS)))
    rows = rows.withColumn("names", F.transform("tail", C.subproduct))
    asked = ["dist", "names"]
    named = rows.select(*asked).distinct().select(*asked, F.posexplode_outer("names").alias("at", "rel_path")).where("rel_path IS NOT NULL")
    known = named.join(files.select("dist", "rel_path").distinct(), ["dist", "rel_path"], "left_semi").groupBy(*asked).agg((F.min("at") + 1).alias("known"))
    rows = rows.join(stored(known), asked, "left")
    shaped = F.array_position(F.transform("tail", C.looks_like_subgroup), F.lit(True)).cast("int")
    rows = rows.withColumn("at", F.coalesce("known", shaped))
    rows = rows.withColumn("subgroup", F.when(F.col("at") > 0, F.try_element_at("tail", F.col("at"))))
    rows = rows.withColumn("subproduct", C.subproduct(F.col("subgroup")))
    warning = lambda *text: F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(" ignored: "), *text)
    status = (
        F.when(F.size("t") < 7, warning(F.lit("not enough fields")))
        .when(F.col("subgroup").isNull(), warning(F.lit("cannot locate subgroup token")))
        .when(F.col("subproduct").isNull(), warning(F.lit("bad subgroup '"), F.col("subgroup"), F.lit("'")))
    )
    field = lambda i: F.try_element_at("t", F.lit(i))
    return rows.select(
        *KEY,
        F.left(field(1), F.lit(1)).alias("ftype"),
        C.octal(field(2)).alias("mode"),
        field(3).alias("user"),
        field(4).alias("group"),
        field(5).alias("fname"),
        field(6).alias("source_path"),
        "subgroup",
        "subproduct",
        F.array_join(F.filter("tail", lambda t, i: i != F.col("at") - 1), " ").alias("attrs_raw"),
        status.alias("status"),
        (F.col("subproduct").isNotNull() & F.col("known").isNull()).alias("no_image"),
    )


def with_attributes(rows: DataFrame) -> DataFrame:
    """Adds mach, symval, size, cmpsize and payload_size."""
    rows = rows.withColumn("items", C.attributes(F.col("attrs_raw")))
    keys = ("mach", "symval", "size", "cmpsize")
    held = F.lower("attrs_raw")
    rows = rows.withColumns({f"item_{key}": F.when(held.contains(f"{key}("), C.attribute_item(F.col("items"), key)) for key in keys})  # a step of its own: each is found once
    value = lambda key: C.item_value(F.col(f"item_{key}"), key)
    rows = rows.withColumns({
        "mach": F.coalesce(C.trimmed(value("mach")), F.lit("")),
        "symval": F.coalesce(value("symval"), F.lit("")),
        "size": F.coalesce(C.whole_number(value("size")), F.lit(0)),
        "cmpsize": F.coalesce(C.whole_number(value("cmpsize")), F.lit(0)),
    })
    payload = F.when(F.col("ftype") == "f", F.when(F.col("cmpsize") > 0, F.col("cmpsize")).otherwise(F.col("size"))).otherwise(0)
    return rows.withColumn("payload_size", payload.cast("long")).drop("items", *[f"item_{key}" for key in keys])


def with_offsets(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds offset: HEADER plus payload, name and two bytes of all earlier files of the same image; -1 for other types.

    An image's lines are summed in stretches of line numbers, so that no image is one task: sums of the
    stretches before a line's own, which are few rows, plus the running sum within it.
    """
    image = ["dist", "product", "subproduct"]
    is_file = F.col("ftype") == "f"
    rows = rows.withColumn("__step", F.when(is_file, F.col("payload_size") + F.length("fname") + 2).otherwise(0))
    rows = rows.withColumn("__part", F.floor(F.col("line_no") / stretch))
    before = lambda *key: Window.partitionBy(*image, *key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*image, "__part").agg(F.sum("__step").alias("__sum"))
    parts = parts.select(*image, "__part", F.coalesce(F.sum("__sum").over(before("__part")), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__step").over(before("__part", "line_no")), F.lit(0))
    summed = rows.withColumn("__within", within).join(parts, [*image, "__part"])
    offset = F.when(is_file, F.lit(HEADER) + F.col("__base") + F.col("__within")).otherwise(-1)
    return summed.withColumn("offset", offset.cast("long")).drop("__step", "__part", "__within", "__base")


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds full_path, parent_path, base_name and base_name_lower."""
    rows = rows.withColumn("full_path", C.normalized_path(F.col("fname")))
    rows = rows.withColumns({"parent_path": C.parent_path(F.col("full_path")), "base_name": C.base_name(F.col("full_path"))})
    return rows.withColumn("base_name_lower", F.lower("base_name"))


def _errors(parsed: DataFrame, lines: DataFrame, requested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each product's first accepted line whose image is missing, and the errors: these, and requested products without lines."""
    fatal = parsed.where("status IS NULL AND no_image").groupBy("dist", "product").agg(F.min(F.struct("line_no", "subproduct")).alias("x"))
    fatal = fatal.select("dist", "product", "x.*")
    message = F.concat(F.lit("Missing subproduct file '"), F.col("subproduct"), F.lit("' referenced by "), F.col("product"), F.lit(".idb:"), F.col("line_no").cast("string"))
    errors = fatal.select(*KEY, message.alias("message"))
    if requested is not None:
        unread = requested.join(lines.select("dist", "product").distinct(), ["dist", "product"], "left_anti")
        errors = errors.unionByName(unread.select("dist", "product", F.lit(0).cast("int").alias("line_no"), F.concat(F.lit("Cannot open idb: "), F.col("uri")).alias("message")))
    return fatal, errors


def index_errors(lines: DataFrame, files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The errors of build_index alone; attributes, which they do not need, are not read from the lines."""
    return _errors(stored(parse_lines(lines, files).select(*KEY, "subproduct", "status", "no_image")), lines, requested)[1]


def build_index(lines: DataFrame, files: DataFrame, requested: DataFrame | None = None, wanted: list[str] | None = None) -> Index:
    """Entries, warnings and errors of all products. Lines are parsed once, and the result is written out.

    wanted: columns of entries, if not all; attributes that neither these nor the offsets need are then not read from the lines.

    A product's first accepted line whose image is missing is an error, and the product then has neither
    entries nor warnings. A requested (dist, product, uri) without lines is an error too.
    """
    parsed = with_attributes(parse_lines(lines, files))
    if wanted is not None:
        parsed = parsed.select(*[c for c in parsed.columns if c in {*KEY, *_NEEDED, *wanted}])
    parsed = stored(parsed)
    fatal, errors = _errors(parsed, lines, requested)
    whole = parsed.join(fatal.select("dist", "product"), ["dist", "product"], "left_anti")
    accepted = whole.where("status IS NULL").drop("status", "no_image")
    entries = with_paths(with_offsets(accepted))
    entries = entries.select(*(wanted or [*[c for c in entries.columns if c != "offset"], "offset"]))
    warnings = whole.where("status IS NOT NULL").select(*KEY, F.col("status").alias("message"))
    return Index(entries, warnings, errors)


def scan_summary(products: DataFrame, index: Index) -> DataFrame:
    """Per product: entries loaded, warnings, and the error if there is one."""
    key = ["dist", "product"]
    counted = index.entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n_entries"))
    warned = index.warnings.groupBy(*key).agg(F.count(F.lit(1)).alias("n_warnings"))
    out = products.select(*key).join(counted, key, "left").join(warned, key, "left").join(index.errors.select(*key, F.col("message").alias("error")), key, "left")
    return out.select(*key, F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), "error")
