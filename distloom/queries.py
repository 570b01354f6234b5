"""Registered queries of the library's own operators, and the SQL that computes the same rows from the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distloom import archives
from distloom.functions import columns as C
from distloom.operators import catalog, unpack
from distloom.plans import recipes
from distloom.plans.index import Index, build_index, scan_summary
from distloom.plans.stored import stored

MASK = "*.sw.*"
QUERY = "AR"


def part_index(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(recipes.part_lines(spark, sf_dir), recipes.part_files(spark, sf_dir))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted line with its attributes, offset and paths."""
    return part_index(spark, sf_dir).entries.drop("base_name_lower")


def index_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).warnings


def index_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).errors


def scan_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = recipes.part_files(spark, sf_dir).where("rel_path LIKE '%.idb'")
    products = files.select("dist", F.regexp_extract("rel_path", r"^(.*)\.idb$", 1).alias("product"))
    return scan_summary(products, part_index(spark, sf_dir))


def large_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(recipes.lineitem_lines(spark, sf_dir))
    return build_index(lines, stored(recipes.lineitem_files(spark)), wanted=["dist", "product", "line_no", "subproduct", "payload_size", "offset"]).entries


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X5 over page paths."""
    rows = recipes.page_paths(spark, sf_dir).withColumn("full_path", C.normalized_path(F.col("path")))
    up = C.parent_path(F.col("full_path"))
    return rows.select(
        "page_id", "full_path", C.safe_out_path(F.col("path")).alias("out_path"), up.alias("parent_path"), C.base_name(F.col("full_path")).alias("base_name"),
        F.array_join(C.ancestors(F.col("full_path")), "|").alias("ancestors"), C.link_path(up, F.lit("../x/./y")).alias("link"),
    )


def masked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries of a subgroup mask whose name holds a text."""
    rows = catalog.masked(part_index(spark, sf_dir).entries, MASK)
    return rows.where(catalog.name_matches(F.col("base_name"), QUERY)).select("dist", "product", "line_no", "subgroup", "base_name")


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.known_dirs(part_index(spark, sf_dir).entries)


_LISTED = ["dist", "product", "dir", "seq", "kind", "display_name", "size", "packed", "type", "subgroup", "offset", "rel_path", "navigate_path", "line_no"]


def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every directory."""
    return catalog.listing(stored(part_index(spark, sf_dir).entries)).select(*_LISTED)


def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing under a mask and a name filter."""
    return catalog.listing(stored(part_index(spark, sf_dir).entries), MASK, QUERY).select(*_LISTED)


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listing_counts(catalog.listing(stored(part_index(spark, sf_dir).entries)))


def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered_counts(part_index(spark, sf_dir).entries, MASK)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every seventh line and every directory named after `small` select."""
    entries = stored(part_index(spark, sf_dir).entries)
    own = entries.where("line_no % 7 = 0").select("dist", "product", F.lit("entry").alias("kind"), F.col("full_path").alias("path"), "line_no")
    folders = catalog.known_dirs(entries).where(F.col("path").endswith("small"))
    rows = folders.select("dist", "product", F.lit("directory").alias("kind"), "path", F.lit(None).cast("int").alias("line_no"))
    return catalog.select_rows(entries, own.unionByName(rows)).select("dist", "product", "line_no")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree usr/standard of every product, under a mask."""
    entries = stored(part_index(spark, sf_dir).entries)
    folders = entries.select("dist", "product", F.lit("usr/standard").alias("path")).distinct()
    return catalog.select_trees(entries, folders, MASK).select("dist", "product", "line_no")


def path_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 over pages: positions are page_ids; a path that comes again keeps its first position."""
    rows = recipes.page_paths(spark, sf_dir).select(F.col("page_id").alias("position"), C.parent_path(C.normalized_path(F.col("path"))).alias("rel_path"))
    return catalog.path_export(rows)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of every product by a filter alone."""
    return catalog.select_tree(part_index(spark, sf_dir).entries, "usr/standard", MASK).select("dist", "product", "line_no")


def root_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the root tree takes entries whose path is empty, which no listing shows."""
    entries = stored(part_index(spark, sf_dir).entries)
    roots = entries.select("dist", "product", F.lit("").alias("path")).distinct()
    return catalog.select_trees(entries, roots, MASK).select("dist", "product", "line_no", "full_path")


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five errors of each product of the part index, none of whose images is there."""
    asked = stored(unpack.requests(part_index(spark, sf_dir).entries))
    none = spark.createDataFrame([], "dist string, rel_path string, uri string")
    return unpack.first_errors(unpack.outcomes(asked, unpack.unpack(asked, none)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        index_entries, index_warnings, index_errors, scan_products, large_index, paths, masked_entries, directories, list_all, list_filtered, list_counts, mask_counts,
        selection, trees, tree, root_trees, path_export, missing_images, *archives.QUERIES,
    )
    return {q.__name__: q for q in own}


_PART = f"""
p AS ({recipes.PART}),
q AS (SELECT *, concat(product, '.', image) AS subproduct, concat(product, '.', image, '.', replace(subsystem, '/', '_')) AS subgroup,
             CASE WHEN ftype <> 'f' THEN 0 WHEN cmpsize > 0 THEN cmpsize ELSE size END AS payload_size,
             ltrim(fname, '/') AS full_path,
             dist = 'd3' AND ends_with(product, '5') AND image = 'data' AS gone FROM p),
bad AS (SELECT dist, product, min(line_no) AS bad_line FROM q WHERE odd = '' AND gone GROUP BY ALL),
ok AS (SELECT q.* FROM q ANTI JOIN bad USING (dist, product)),
e AS (SELECT *, regexp_replace(full_path, '/[^/]*$', '') AS parent_path, regexp_extract(full_path, '[^/]*$') AS base_name,
             CASE WHEN ftype <> 'f' THEN -1 ELSE 13 + coalesce(sum(CASE WHEN ftype = 'f' THEN payload_size + length(fname) + 2 ELSE 0 END)
               OVER (PARTITION BY dist, product, image ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS "offset"
      FROM ok WHERE odd = '')"""

_PAGES = """
u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages),
v AS (SELECT page_id, list_filter(string_split(p, '/'), lambda t: t <> '') AS parts, p FROM u),
n AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN list_append(parts[:-2], concat('up', page_id)) ELSE parts END AS a,
             CASE WHEN page_id % 5 = 0 THEN list_append(parts, concat('up', page_id)) ELSE parts END AS o FROM v)"""


def _listing(mask: str, matches: str) -> str:
    """The listing in SQL: entries m under the mask; `matches` tests a name x."""
    hit = matches.format
    return f"""WITH {_PART},
m AS (SELECT * FROM e WHERE {mask} AND full_path <> ''),
anc AS (SELECT DISTINCT dist, product, array_to_string(string_split(full_path, '/')[:k], '/') AS path, {hit(x="base_name")} AS hit
        FROM m, range(1, 40) r(k) WHERE k < len(string_split(full_path, '/'))),
known AS (SELECT DISTINCT dist, product, path FROM (SELECT dist, product, path FROM anc UNION ALL SELECT dist, product, full_path FROM m WHERE ftype = 'd')),
above AS (SELECT DISTINCT dist, product, path FROM anc WHERE hit),
up AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS up, regexp_extract(path, '[^/]*$') AS name FROM known),
lk AS (SELECT *, CASE WHEN ftype <> 'l' THEN full_path WHEN symval = '../x' THEN concat(array_to_string(string_split(parent_path, '/')[:-2], '/'), '/x')
              ELSE concat(array_to_string(string_split(parent_path, '/')[:-3], '/'), '/standard') END AS to_path FROM m WHERE ftype <> 'd' AND {hit(x="base_name")}),
lf AS (SELECT lk.*, ltrim(to_path, '/') AS navigate_path, ftype = 'l' AND known.path IS NOT NULL AS linked
       FROM lk LEFT JOIN known ON known.dist = lk.dist AND known.product = lk.product AND known.path = ltrim(lk.to_path, '/')),
rws AS (
  SELECT dist, product, path AS dir, 0 AS rank, 'parent' AS kind, '' AS name, '..' AS display_name, NULL::BIGINT AS size, NULL::BIGINT AS packed, 'UP' AS type, NULL AS subgroup, NULL::BIGINT AS "offset", up AS rel_path, NULL AS navigate_path, NULL::BIGINT AS line_no FROM up
  UNION ALL SELECT up.dist, up.product, up, 1, 'directory', name, name, NULL, NULL, 'DIR', NULL, NULL, up.path, up.path, NULL FROM up LEFT JOIN above USING (dist, product, path) WHERE {hit(x="name")} OR above.path IS NOT NULL
  UNION ALL SELECT dist, product, parent_path, 2, CASE WHEN linked THEN 'dirlink' ELSE 'entry' END, base_name, CASE WHEN ftype = 'l' THEN concat(base_name, ' -> ', symval) ELSE base_name END,
    CASE WHEN NOT linked THEN size END, CASE WHEN NOT linked THEN cmpsize END, CASE WHEN linked THEN 'LNKD' WHEN ftype = 'l' THEN 'LNK' ELSE ftype END, CASE WHEN NOT linked THEN subgroup END, CASE WHEN NOT linked THEN "offset" END, full_path, navigate_path, line_no FROM lf)
SELECT dist, product, dir, row_number() OVER (PARTITION BY dist, product, dir ORDER BY rank, CASE WHEN rank = 1 THEN name END, lower(name), name, line_no)::INT AS seq, kind, display_name, size, packed, type, subgroup, "offset", rel_path, navigate_path, line_no::INT AS line_no FROM rws"""


_MASKED = "contains(subgroup, '.sw.')"

_ORACLE = {
    "index_entries": f"""WITH {_PART}
SELECT dist, product, line_no::INT AS line_no, ftype, CASE mode WHEN '0755' THEN 493 WHEN '0644' THEN 420 ELSE 0 END::INT AS mode, 'root' AS "user", 'sys' AS "group", fname, concat('src/', fname) AS source_path,
       subgroup, subproduct, concat('mach(CPUBOARD=IP ) nostrip SIZE(', size, ')', CASE WHEN cmpsize > 0 THEN concat(' cmpsize(', cmpsize, ')') ELSE '' END, CASE WHEN ftype = 'l' THEN concat(' symval(', symval, ')') ELSE '' END) AS attrs_raw,
       'CPUBOARD=IP' AS mach, symval, size, cmpsize, payload_size, "offset", full_path, parent_path, base_name FROM e""",
    "index_warnings": f"""WITH {_PART} SELECT dist, product, line_no::INT AS line_no, concat('Line ', line_no, ' ignored: ', CASE odd WHEN 'short' THEN 'not enough fields' WHEN 'unlocated' THEN 'cannot locate subgroup token' ELSE concat('bad subgroup ', chr(39), '.....', chr(39)) END) AS message FROM ok WHERE odd IN ('short', 'unlocated', 'bad')""",
    "index_errors": f"""WITH {_PART} SELECT dist, product, bad_line::INT AS line_no, concat('Missing subproduct file ''', product, '.data'' referenced by ', product, '.idb:', bad_line) AS message FROM bad""",
    "scan_products": f"""WITH {_PART}, pr AS (SELECT DISTINCT dist, product FROM q)
SELECT pr.dist, pr.product, (SELECT count(*) FROM e WHERE e.dist = pr.dist AND e.product = pr.product) AS n_entries, (SELECT count(*) FROM ok WHERE odd IN ('short', 'unlocated', 'bad') AND ok.dist = pr.dist AND ok.product = pr.product) AS n_warnings,
       (SELECT concat('Missing subproduct file ''', product, '.data'' referenced by ', product, '.idb:', bad_line) FROM bad WHERE bad.dist = pr.dist AND bad.product = pr.product) AS error FROM pr""",
    "large_index": f"""WITH l AS ({recipes.LINEITEM}), s AS (SELECT *, CASE WHEN cmpsize > 0 THEN cmpsize ELSE size END AS payload_size FROM l)
SELECT dist, product, line_no::INT AS line_no, concat(product, '.', image) AS subproduct, payload_size, (13 + coalesce(sum(payload_size + length(fname) + 2) OVER (PARTITION BY dist, product, image ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM s""",
    "paths": f"""WITH {_PAGES}
SELECT page_id, array_to_string(a, '/') AS full_path, array_to_string(o, '/') AS out_path, array_to_string(a[:-2], '/') AS parent_path, a[-1] AS base_name,
       array_to_string(list_transform(range(1, len(a)), lambda k: array_to_string(a[:k], '/')), '|') AS ancestors, array_to_string(list_concat(a[:-3], ['x', 'y']), '/') AS link FROM n""",
    "masked_entries": f"""WITH {_PART} SELECT dist, product, line_no::INT AS line_no, subgroup, base_name FROM e WHERE {_MASKED} AND contains(lower(base_name), '{QUERY.lower()}')""",
    "directories": f"""WITH {_PART} SELECT DISTINCT dist, product, path FROM (
SELECT dist, product, array_to_string(string_split(full_path, '/')[:k], '/') AS path FROM e, range(1, 40) r(k) WHERE k < len(string_split(full_path, '/'))
UNION ALL SELECT dist, product, full_path FROM e WHERE ftype = 'd' AND full_path <> '')""",
    "list_all": _listing("true", "true"),
    "list_filtered": _listing(_MASKED, "contains(lower({x}), '" + QUERY.lower() + "')"),
    "list_counts": f"""SELECT dist, product, dir, count(*) AS n_rows FROM ({_listing("true", "true")}) GROUP BY ALL""",
    "mask_counts": f"""WITH {_PART} SELECT dist, product, count(*) AS n_entries FROM e WHERE {_MASKED} GROUP BY ALL""",
    "selection": f"""WITH {_PART} SELECT DISTINCT dist, product, line_no::INT AS line_no FROM e
WHERE line_no % 7 = 0 OR regexp_matches(full_path, 'small/') OR (ftype = 'd' AND ends_with(full_path, 'small'))""",
    "trees": f"""WITH {_PART} SELECT dist, product, line_no::INT AS line_no FROM e WHERE {_MASKED} AND (full_path = 'usr/standard' OR starts_with(full_path, 'usr/standard/'))""",
    "path_export": f"""WITH {_PAGES} SELECT min(page_id) AS position, concat('/', array_to_string(a[:-2], '/')) AS path FROM n WHERE len(a) > 1 GROUP BY 2""",
    "tree": f"""WITH {_PART} SELECT dist, product, line_no::INT AS line_no FROM e WHERE {_MASKED} AND (full_path = 'usr/standard' OR starts_with(full_path, 'usr/standard/'))""",
    "root_trees": f"""WITH {_PART} SELECT dist, product, line_no::INT AS line_no, full_path FROM e WHERE {_MASKED}""",
    "missing_images": f"""WITH {_PART}, r AS (SELECT *, row_number() OVER (PARTITION BY dist, product ORDER BY line_no)::INT AS rank FROM e WHERE ftype = 'f' AND payload_size <> 0)
SELECT dist, product, rank, concat(fname, ': Cannot open subproduct file: ', dist, '/', subproduct) AS message FROM r WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return _ORACLE | archives.ORACLE
