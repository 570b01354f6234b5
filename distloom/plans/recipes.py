"""Index lines, dist listings and images that Spark derives from the tables of a data directory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from distloom.plans.stored import buckets

#: Columns of an index over `part`; the text of this query also runs in other engines.
PART = """
SELECT dist, product, image, subsystem, ftype, mode, size, cmpsize, odd, p_partkey,
       CASE WHEN p_partkey % 61 = 7 THEN '/' ELSE concat(lead, 'usr/', subsystem, '/', replace(p_name, ' ', '/'), '.', cast(p_partkey AS string)) END AS fname,
       CASE WHEN ftype = 'l' THEN CASE WHEN p_partkey % 20 = 1 THEN '../../standard' ELSE '../x' END ELSE '' END AS symval,
       row_number() OVER (PARTITION BY dist, product ORDER BY p_partkey) AS line_no
FROM (SELECT p_partkey, p_name,
             concat('d', cast(p_partkey % 4 AS string)) AS dist, lower(replace(p_brand, '#', '')) AS product,
             CASE p_size % 3 WHEN 0 THEN 'sw' WHEN 1 THEN 'man' ELSE 'data' END AS image,
             lower(replace(p_type, ' ', '/')) AS subsystem,
             CASE p_partkey % 10 WHEN 0 THEN 'd' WHEN 1 THEN 'l' WHEN 2 THEN 'x' ELSE 'f' END AS ftype,
             CASE p_partkey % 3 WHEN 0 THEN '0755' WHEN 1 THEN '0644' ELSE '79' END AS mode,
             CASE WHEN p_partkey % 7 = 0 THEN '/' ELSE '' END AS lead,
             cast(CASE WHEN p_partkey % 71 = 9 THEN -7 ELSE p_size * 100 + p_partkey % 100 END AS bigint) AS size,
             cast(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 71 = 9 THEN 0 ELSE p_size * 40 END AS bigint) AS cmpsize,
             CASE WHEN p_partkey % 50 = 3 THEN 'short' WHEN p_partkey % 53 = 4 THEN 'unlocated' WHEN p_partkey % 59 = 5 THEN 'bad' WHEN p_partkey % 47 = 6 THEN 'blank' ELSE '' END AS odd
      FROM part)
"""


def part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(PART)


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines in the order and with the oddities that indexes have: attributes around the subgroup, any case; lines that are blank, short, without subgroup or with a bad one."""
    rows = part_columns(spark, sf_dir)
    subgroup = F.concat_ws(".", "product", "image", F.replace("subsystem", F.lit("/"), F.lit("_")))
    fields = [F.col("ftype"), F.col("mode"), F.lit("root"), F.lit("sys"), F.col("fname")]
    tail = [
        F.concat(F.lit("src/"), "fname"), F.lit("mach(CPUBOARD=IP"), F.lit(") nostrip"), subgroup, F.concat(F.lit("SIZE("), "size", F.lit(")")),
        F.when(F.col("cmpsize") > 0, F.concat(F.lit("cmpsize("), "cmpsize", F.lit(")"))), F.when(F.col("ftype") == "l", F.concat(F.lit("symval("), "symval", F.lit(")"))),
    ]
    odd = F.col("odd")
    subgroup_or = F.when(odd == "unlocated", F.lit("config(a.b.c)")).when(odd == "bad", F.lit(".....")).otherwise(subgroup)
    tail[3] = subgroup_or
    line = F.when(odd == "blank", F.lit(" \t\xa0")).when(odd == "short", F.concat_ws(" ", *fields)).otherwise(F.concat_ws(" ", *fields, *tail))
    return rows.select("dist", "product", "line_no", line.alias("line"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dist listing of part_lines. Dist d3 has no `data` image of products that end in 5."""
    rows = part_columns(spark, sf_dir)
    images = rows.select("dist", F.concat_ws(".", "product", "image").alias("rel_path"), (F.col("dist").eqNullSafe("d3") & F.col("product").endswith("5") & (F.col("image") == "data")).alias("gone"))
    return images.where("NOT gone").select("dist", "rel_path").unionByName(rows.select("dist", F.concat("product", F.lit(".idb")).alias("rel_path"))).distinct()


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large index: one line a lineitem. Order numbers keep lines of one product apart by a key of all columns."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    rows = spark.sql(LINEITEM)
    line = F.concat_ws(" ", F.lit("f 0644 root sys"), "fname", F.concat(F.lit("src/"), "fname"), F.concat_ws(".", "product", "image", F.lit("base")), F.concat(F.lit("size("), "size", F.lit(")")), F.when(F.col("cmpsize") > 0, F.concat(F.lit("cmpsize("), "cmpsize", F.lit(")"))))
    return rows.select("dist", "product", "line_no", line.alias("line"))


def lineitem_files(spark: SparkSession) -> DataFrame:
    """The images of lineitem_lines."""
    return spark.sql(LINEITEM).select("dist", F.concat_ws(".", "product", "image").alias("rel_path")).distinct()


#: Columns of an index over `lineitem`; the text of this query also runs in other engines.
LINEITEM = """
SELECT concat('d', cast(l_orderkey % 8 AS string)) AS dist, concat('p', cast(l_suppkey % 20 AS string)) AS product,
       lower(concat(l_returnflag, l_linestatus)) AS image,
       concat('o', cast(l_orderkey % 97 AS string), '/', cast(l_orderkey AS string), '/', cast(l_linenumber AS string), '.', cast(l_partkey AS string)) AS fname,
       cast(floor(l_extendedprice) AS bigint) AS size,
       cast(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE floor(l_quantity) * 10 END AS bigint) AS cmpsize,
       row_number() OVER (PARTITION BY l_orderkey % 8, l_suppkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
FROM lineitem
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of `pages`: the URL without scheme, query and fragment; every fifth takes a step back."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(path, F.lit("/../up"), F.col("page_id").cast("string"))).otherwise(path)
    return spark.table("pages").select("page_id", path.alias("path"))


#: Literal codes of a `.Z` stream before its table is cleared: with the clear code 31 groups of eight, all nine bits wide.
LITERALS = 247
_PLACES = np.arange(8, dtype="<u2")


def _packed(data: bytes) -> bytes:
    """A .Z stream of literal codes: maximum width 12, block mode, the table cleared before codes widen."""
    codes = np.frombuffer(data, dtype=np.uint8).astype("<u2")
    blocks = -(-len(codes) // LITERALS)
    rows = np.zeros((blocks, LITERALS + 1), dtype="<u2")
    rows[:, LITERALS] = 256
    rows[:, :LITERALS].flat[: len(codes)] = codes
    n = len(codes) + max(0, blocks - 1)
    groups = rows.reshape(-1, 8)  # eight codes of nine bits are nine bytes: code k ends byte k + 1 and begins in byte k
    out = np.zeros((len(groups), 9), dtype=np.uint8)
    out[:, :8] = groups << _PLACES
    out[:, 1:] |= (groups >> (8 - _PLACES)).astype(np.uint8)
    return b"\x1f\x9d\x8c" + out.tobytes()[: (9 * n + 7) // 8]


@F.pandas_udf(BinaryType())
def packed(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else _packed(bytes(d)))


#: Documents of one image.
IMAGE_DOCS = 64
#: What names an image; records and images are dealt by it.
IMAGE = ["dist", "rel_path"]

#: What is the matter with a document's record, by its id; the text of these expressions also runs in other engines.
RAW = "id % 3 = 0"  # stored as it is
BROKEN = "id % 3 <> 0 AND id % 13 = 5"  # a stream that no reader takes
MISSING = "id % 29 = 7"  # in the index, not in the image
JUNK = "id % 17 = 0"  # five bytes before it
FORM = "CASE WHEN id % 5 = 1 THEN './' WHEN id % 5 = 2 THEN '/' ELSE '' END"  # before the name in the image
TWIN = "id % 19 = 3"  # has the output path of the document before
CUT = "part % 3 = 0"  # images that end a byte early
UNDERSCORE, UPPER = "part % 5 = 1", "part % 7 = 2"  # names of products, suffixes of their indexes

#: The other lines of a product: number, fields, attributes; %s stands for its image.
PLAIN = [
    (1, "d 0755 root sys docs docs", ""), (99, "f 0600 root sys docs/plain src/plain", "size(0)"), (100, "l 0777 root sys docs/link src/link", "symval(plain)"),
    (101, "f 0644 root sys docs src/docs", "size(0)"), (102, "d 0755 root sys docs/plain/sub src/sub", ""), (103, "l 0777 root sys docs/plain/ln src/ln", "symval(x)"),
    (104, "f 0644 root sys docs/plain/y src/y", "size(0)"), (105, "d 0755 root sys docs/plain src/d", ""), (107, "f 0644 root sys docs/bad src/bad", "size(-5)"), (108, "c 0600 root sys docs/tty src/tty", ""),
]


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document: image, line, name, size, payload, the bytes of its record, and what is the matter with it.

    An image holds IMAGE_DOCS neighbouring doc_ids, so that images stay small; documents without doc_id share one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    docs = docs.withColumn("part", F.floor(F.col("id") / IMAGE_DOCS))
    product = F.concat(F.when(F.expr(UNDERSCORE), "_p").otherwise("p"), F.col("part").cast("string"))
    docs = docs.withColumns({"dist": F.concat(F.lit("b"), F.pmod("part", F.lit(8)).cast("string")), "product": product, "rel_path": F.concat(product, F.lit(".sw"))})
    payload = F.when(F.expr(RAW), F.col("raw")).when(F.expr(BROKEN), F.lit(b"\x1f\x9d\x88")).otherwise(packed(F.when(F.expr(f"NOT ({RAW}) AND NOT ({BROKEN})"), F.col("raw"))))
    docs = docs.withColumns({"payload": payload, "size": F.octet_length("raw"), "md5": F.md5("raw")}).drop("raw").repartition(buckets(spark), *IMAGE)
    place = Window.partitionBy(*IMAGE, "part").orderBy("id", "md5")
    docs = docs.withColumn("line_no", F.row_number().over(place) + 1)
    fname = F.concat(F.lit("docs/"), F.when(F.expr(TWIN), F.concat(F.lit("./"), (F.col("id") - 1).cast("string"))).otherwise(F.col("id").cast("string")), F.lit(".txt"))
    docs = docs.withColumn("fname", fname)
    name = F.encode(F.concat(F.expr(FORM), F.col("fname")), "ISO-8859-1")
    record = F.concat(F.when(F.expr(JUNK), F.lit(b"junk!")).otherwise(F.lit(b"")), F.unhex(F.lpad(F.hex(F.length(name)), 4, "0")), name, "payload")
    return docs.select(
        "dist", "product", "rel_path", "part", "doc_id", "id", "line_no", "fname", "size", F.when(F.expr(RAW), 0).otherwise(F.length("payload")).alias("packed"),
        F.when(F.expr(MISSING), F.lit(b"")).otherwise(record).alias("record"),
    )


def document_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image: dist, product, rel_path, content (13 header bytes and the records in line order; some images lack their last byte), and the index lines of its records."""
    records = document_records(spark, sf_dir)
    line = F.concat(F.lit("f 0644 root sys "), "fname", F.lit(" src/"), "fname", F.lit(" "), "product", F.lit(".sw.base size("), "size", F.lit(") cmpsize("), "packed", F.lit(")"))
    body = F.expr("listagg(record) WITHIN GROUP (ORDER BY line_no)")
    rows = records.select("dist", "product", "rel_path", "part", "line_no", "record", line.alias("line"))
    made = rows.groupBy("dist", "product", "rel_path", "part").agg(F.concat(F.lit(b"im001V405P00\n"), body).alias("body"), F.collect_list(F.struct("line_no", "line")).alias("lines"))
    content = F.when(F.expr(CUT), F.substring("body", F.lit(1), F.length("body") - 1)).otherwise(F.col("body"))
    return made.select("dist", "product", "rel_path", content.alias("content"), "lines")


def document_images(made: DataFrame) -> DataFrame:
    """(dist, rel_path, uri, content) of document_archive."""
    return made.select("dist", "rel_path", F.lit("").alias("uri"), "content")


def document_lines(made: DataFrame) -> DataFrame:
    """Index lines of the records, and the PLAIN ones of each product."""
    own = made.select("dist", "product", F.explode("lines").alias("x")).select("dist", "product", "x.line_no", "x.line")
    more = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(fields).alias("fields"), F.lit(rest).alias("rest")) for n, fields, rest in PLAIN])).alias("x")
    plain = made.select("dist", "product", more)
    return own.unionByName(plain.select("dist", "product", F.col("x.n").alias("line_no"), F.concat(F.col("x.fields"), F.lit(" "), "product", F.lit(".sw.base "), F.col("x.rest")).alias("line")))


def document_files(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(path, content) of dist directories: indexes, blank lines where a number has none, and images. A hidden index lies beside them.

    Every second product's lines end in CRLF, and the last line of every fourth in nothing.
    """
    part = F.regexp_extract("product", "-?[0-9]+$", 0).cast("long").alias("part")
    whole = lines.groupBy("dist", "product").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("by"), F.max("line_no").alias("last"))  # up to 108 lines
    end = F.when(F.expr("part % 2 = 0"), F.lit("\r\n")).otherwise(F.lit("\n"))
    rows = whole.select("dist", "product", part, F.transform(F.sequence(F.lit(1), F.col("last")), lambda n: F.coalesce(F.try_element_at("by", n), F.lit(" \t"))).alias("rows"))
    text = F.when(F.expr("part % 2 = 0"), F.array_join("rows", "\r\n")).otherwise(F.array_join("rows", "\n"))
    text = F.concat(text, F.when(F.expr("part % 4 = 3"), F.lit("")).otherwise(end))
    name = F.concat("dist", F.lit("/"), "product", F.when(F.expr(UPPER), F.lit(".IDB")).otherwise(F.lit(".idb")))
    indexes = rows.select(name.alias("path"), F.encode(text, "ISO-8859-1").alias("content"))
    others = images.select(F.concat("dist", F.lit("/"), "rel_path").alias("path"), "content")
    hidden = rows.select("dist").distinct().select(F.concat("dist", F.lit("/.hidden.idb")).alias("path"), F.lit(b"f 0644").alias("content"))
    return indexes.unionByName(others).unionByName(hidden)
