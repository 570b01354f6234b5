"""Catalog jobs over entries of all products: masks, listings of every directory, links, selections, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distloom.functions import columns as C

PRODUCT = ["dist", "product"]
KEY = [*PRODUCT, "line_no"]


def masked(entries: DataFrame, mask: str = "*") -> DataFrame:
    """Entries whose subgroup fits the mask; a mask that is no pattern filters nothing."""
    pattern = C.wildcard(mask)
    return entries.where(F.col("subgroup").rlike(pattern)) if pattern else entries


def name_matches(name: Column, query: str) -> Column:
    query = query.strip()
    return F.lower(name).contains(F.lower(F.lit(query))) if query else F.lit(True)


def _with_ancestors(rows: DataFrame) -> DataFrame:
    """Distinct (dist, product, path) of all ancestors; parents are made distinct first, being far fewer than rows."""
    parents = rows.where("parent_path != ''").select(*PRODUCT, "parent_path").distinct()
    every = F.concat(C.ancestors(F.col("parent_path")), F.array("parent_path"))
    return parents.select(*PRODUCT, F.explode(every).alias("path")).distinct()


def known_dirs(entries: DataFrame) -> DataFrame:
    """(dist, product, path) of every directory that entries name or imply."""
    own = entries.where("ftype = 'd' AND full_path != ''").select(*PRODUCT, F.col("full_path").alias("path"))
    return _with_ancestors(entries).unionByName(own).distinct()


def dirs_of_matches(entries: DataFrame, query: str) -> DataFrame:
    """(dist, product, path) of the directories above entries whose name matches."""
    return _with_ancestors(entries.where(name_matches(F.col("base_name"), query)))


def resolve_links(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """Adds navigate_path and is_dir_link to entries that are not directories."""
    resolved = F.when(F.col("ftype") == "l", C.link_path(F.col("parent_path"), F.col("symval"))).otherwise("")
    rows = entries.where("ftype != 'd'").withColumn("__to", resolved)
    links = rows.where("__to != ''").join(dirs.select(*PRODUCT, F.col("path").alias("__to"), F.lit(True).alias("__known")), [*PRODUCT, "__to"], "left")
    others = rows.where("__to = ''").withColumn("__known", F.lit(None).cast("boolean"))
    rows = links.unionByName(others).withColumn("is_dir_link", F.coalesce("__known", F.lit(False)))
    return rows.withColumn("navigate_path", F.when(F.col("__to") != "", F.col("__to")).otherwise(F.col("full_path"))).drop("__to", "__known")


def listing(entries: DataFrame, mask: str = "*", query: str = "") -> DataFrame:
    """The rows of every directory of every product: parent, directories by name, then files and links by name in any case.

    Ties of the last order fall by name and line. `seq` numbers the rows of a directory from 1.
    """
    shown = masked(entries, mask).where("full_path != ''")
    dirs = known_dirs(shown)
    children = dirs.select(*PRODUCT, C.parent_path(F.col("path")).alias("dir"), C.base_name(F.col("path")).alias("name"), F.col("path").alias("rel_path"))
    files = resolve_links(shown, dirs)
    if query.strip():
        above = dirs_of_matches(shown, query).withColumnRenamed("path", "rel_path").withColumn("__above", F.lit(True))
        children = children.join(above, [*PRODUCT, "rel_path"], "left").where(name_matches(F.col("name"), query) | F.col("__above")).drop("__above")
        files = files.where(name_matches(F.col("base_name"), query))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    blank = {"subgroup": text, "mach": text, "size": number, "packed": number, "offset": number, "link_target": text, "line_no": F.lit(None).cast("int")}
    parents = dirs.select(*PRODUCT, F.col("path").alias("dir"), F.lit("parent").alias("kind"), F.lit("").alias("name"), C.parent_path(F.col("path")).alias("rel_path"), text.alias("ftype"), text.alias("navigate_path"), *[c.alias(n) for n, c in blank.items()])
    folders = children.select(*PRODUCT, "dir", F.lit("directory").alias("kind"), "name", "rel_path", F.lit("d").alias("ftype"), F.col("rel_path").alias("navigate_path"), *[c.alias(n) for n, c in blank.items()])
    kind = F.when(F.col("is_dir_link"), "dirlink").otherwise("entry")
    entry_only = lambda c: F.when(~F.col("is_dir_link"), F.col(c))
    leaves = files.select(
        *PRODUCT, F.col("parent_path").alias("dir"), kind.alias("kind"), F.col("base_name").alias("name"), F.col("full_path").alias("rel_path"), "ftype", "navigate_path",
        entry_only("subgroup").alias("subgroup"), entry_only("mach").alias("mach"), entry_only("size").alias("size"), entry_only("cmpsize").alias("packed"),
        entry_only("offset").alias("offset"), F.col("symval").alias("link_target"), "line_no",
    )
    rows = parents.unionByName(folders).unionByName(leaves)
    rank = F.when(F.col("kind") == "parent", 0).when(F.col("kind") == "directory", 1).otherwise(2)
    order = [rank, F.when(rank == 1, F.col("name")), F.lower("name"), "name", "line_no"]
    label = F.when(F.col("kind") == "parent", "UP").when(F.col("kind") == "directory", "DIR").when(F.col("kind") == "dirlink", "LNKD").when(F.col("ftype") == "l", "LNK").otherwise(F.col("ftype"))
    display = F.when(F.col("kind") == "parent", "..").when(F.col("ftype") == "l", F.concat("name", F.lit(" -> "), "link_target")).otherwise(F.col("name"))
    numbered = rows.withColumn("seq", F.row_number().over(Window.partitionBy(*PRODUCT, "dir").orderBy(*order)))
    return numbered.select(*PRODUCT, "dir", "seq", "kind", "name", display.alias("display_name"), "size", "packed", label.alias("type"), "subgroup", "mach", "offset", "rel_path", "navigate_path", "link_target", "line_no")


def _under(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Keys of entries at or under one of folders (dist, product, path): an equi-join on their own path and its ancestors."""
    places = F.explode(F.concat(C.ancestors(F.col("full_path")), F.array("full_path")))
    return entries.where("full_path != ''").select(*KEY, places.alias("path")).join(folders.select(*PRODUCT, "path").distinct(), [*PRODUCT, "path"], "left_semi").select(*KEY)


def _by_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.dropDuplicates(KEY), KEY, "left_semi")


def select_rows(entries: DataFrame, selection: DataFrame, mask: str = "*") -> DataFrame:
    """Entries that selected listing rows (dist, product, kind, path, line_no) stand for, each once.

    A directory stands for all masked entries at or under it, a file or a link (even to a directory) for itself.
    """
    shown = masked(entries, mask)
    own = selection.where("kind IN ('entry', 'dirlink')").select(*KEY)
    return _by_keys(shown, _under(shown, selection.where("kind = 'directory'")).unionByName(own))


def select_trees(entries: DataFrame, folders: DataFrame, mask: str = "*") -> DataFrame:
    """All masked entries at or under the given folders (dist, product, path), each once; the root takes even entries without a path."""
    shown = masked(entries, mask)
    roots = folders.where("path = ''").select(*PRODUCT).distinct()
    return _by_keys(shown, _under(shown, folders).unionByName(shown.join(roots, PRODUCT, "left_semi").select(*KEY)))


def select_tree(entries: DataFrame, folder: str, mask: str = "*") -> DataFrame:
    """All masked entries at or under one folder of every product: a filter, no join."""
    return masked(entries, mask).where(C.is_under_or_equal(F.col("full_path"), F.lit(folder)))


def filtered_counts(entries: DataFrame, mask: str = "*") -> DataFrame:
    return masked(entries, mask).groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("n_entries"))


def listing_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy(*PRODUCT, "dir").agg(F.count(F.lit(1)).alias("n_rows"))


def path_export(rows: DataFrame) -> DataFrame:
    """(position, path): '/' and rel_path of chosen rows (position, rel_path), empty ones dropped, each path at its first position."""
    paths = rows.where("rel_path != ''").select("position", F.concat(F.lit("/"), "rel_path").alias("path"))
    return paths.groupBy("path").agg(F.min("position").alias("position")).select("position", "path")


def write_paths(exported: DataFrame, path: str) -> None:
    """Writes exported paths as text, in order over the part files."""
    exported.orderBy("position").select("path").write.text(path)
