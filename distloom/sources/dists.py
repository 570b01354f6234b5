"""Reading dist directories: index files, their lines, and what else lies beside them.

The driver finds the directories, through Hadoop's file system; tasks list them and read index files through Arrow's,
which, unlike Spark's readers, show files whose names begin with `_` or `.`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from distloom.functions.images import find_store, open_image
from distloom.plans.stored import BATCH

_INDEX = r"(?i)/([^/]+)\.idb$"


def _place(path: Column) -> list[Column]:
    return [F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("dist"), F.regexp_extract(path, _INDEX, 1).alias("product")]


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(uri, length) of the files directly in directories. As Hadoop does, a local store's checksum files are passed over."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.uri:
            store, path = find_store(uri)
            found = [f for f in store.get_file_info(fs.FileSelector(path)) if f.type != fs.FileType.Directory]
            if isinstance(store, fs.LocalFileSystem):
                found = [f for f in found if not (f.base_name.startswith(".") and f.base_name.endswith(".crc"))]
            yield pd.DataFrame({"uri": [f"{uri}/{f.base_name}" for f in found], "length": [f.size for f in found]}).astype({"uri": object, "length": "int64"})


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(uri, length) of the files directly in the given directories, or of the given files (globs allowed): metadata only. Each directory is listed by a task."""
    hadoop, folders, files = spark._jvm.org.apache.hadoop.fs, [], []
    for path in [paths] if isinstance(paths, str) else paths:
        place = hadoop.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for top in store.globStatus(place) or []:
            uri = top.getPath().toString()
            if top.isDirectory():
                folders.append((uri,))
            else:
                files.append((uri, top.getLen()))
    schema = "uri string, length long"
    inside = spark.createDataFrame(folders, "uri string").repartition(max(1, len(folders))).mapInPandas(_inside, schema)
    return inside.unionByName(spark.createDataFrame(files, schema)) if files else inside


def dist_files(spark: SparkSession, dists: str | list[str]) -> DataFrame:
    """(dist, rel_path, uri, length) of the files directly in dist directories, without reading them."""
    name = F.regexp_extract("uri", r"[^/]+$", 0)
    return _listed(spark, dists).select(_place(F.col("uri"))[0], name.alias("rel_path"), "uri", "length")


def discover_products(spark: SparkSession, dists: str | list[str]) -> DataFrame:
    """(dist, product, place, uri) of the index files directly in the given dist directories (globs allowed); place orders a dist's by name.

    The suffix counts in any letter case, the file is read by its real name, and hidden files, `.` before their name, are passed over.
    """
    found = _listed(spark, dists).select(*_place(F.col("uri")), "uri").where("product != '' AND NOT startswith(product, '.')")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("dist").orderBy("product", "uri"))).select("dist", "product", "place", "uri")


def index_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dist, product, line_no, line) of index files, given as dist directories or as paths of index files.

    Bytes are Latin-1; a line ends at LF or CRLF; numbers start at 1; what follows the last line end is a line
    only if it is not empty.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uris, contents, size = [], [], 0
            for uri in batch.uri:
                with open_image(uri) as file:
                    contents.append(file.read())
                uris.append(uri)
                size += len(contents[-1])
                if size >= BATCH:
                    yield pd.DataFrame({"path": uris, "content": contents})
                    uris, contents, size = [], [], 0
            yield pd.DataFrame({"path": uris, "content": contents})

    uris = discover_products(spark, paths).select("uri")
    found = uris.repartition(spark.sparkContext.defaultParallelism, "uri").mapInPandas(read, "path string, content binary")
    texts = found.select(*_place(F.col("path")), F.decode("content", "ISO-8859-1").alias("text"))
    lines = texts.select("dist", "product", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("at", "line"))
    return lines.select("dist", "product", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))
