"""The unpack job: selected entries to content, modes, links and outcomes.

Images are files that are read by range, or small ones whose bytes lie in the image table. Bytes of the second kind
cross to Python once, beside all requests for the image: records are found and payloads decoded in the same pass. For files
all headers are first tested at their own offsets, spread freely; only from the first miss of an image on are its requests followed in order,
since drift carries over. Payloads are then read and decoded in one pass, neighbours together, so content is born in
the last step and never shuffled. The content sink settles first, without contents, what it is to hold, and then reads
these payloads again by their places.

A `.Z` copy is written under its own name only where asked for, and never takes the place of an entry of that
name. A failed decode leaves none unless `keep_z` is set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distloom.functions import columns as C
from distloom.functions.images import Window as Around
from distloom.functions.images import follow, form_at, open_image, read_range
from distloom.functions.lzw import content_of
from distloom.plans.stored import BATCH, stored, writing

PRODUCT = ["dist", "product"]
KEY = [*PRODUCT, "line_no"]


@dataclass(frozen=True)
class Options:
    no_decompress: bool = False
    keep_z: bool = False
    continue_on_error: bool = True
    resync_back: int = 1 << 20
    resync_forward: int = 16 << 20
    resync_chunk: int = 1 << 20
    link_fallback: bool = False
    #: Payloads are read and decoded as ever, but of them only the errors are returned.
    no_content: bool = False


def requests(selected: DataFrame) -> DataFrame:
    """Selected entries with position, 1..n in line order of their product, and out_path.

    Positions come from counts of stretches of lines and the rank within one, so no product is one task.
    """
    rows = selected.withColumn("__part", F.floor(F.col("line_no") / (1 << 16)))
    parts = rows.groupBy(*PRODUCT, "__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*PRODUCT).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*PRODUCT, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy(*PRODUCT, "__part").orderBy("line_no"))
    rows = rows.withColumn("__rank", rank).join(parts, [*PRODUCT, "__part"])
    return rows.withColumn("position", (F.col("__base") + F.col("__rank")).cast("int")).withColumn("out_path", C.safe_out_path(F.col("fname"))).drop("__part", "__rank", "__base")


def _needs_image(rows: DataFrame) -> DataFrame:
    return rows.where("ftype = 'f' AND payload_size != 0")


IMAGE = ["dist", "subproduct"]
RESOLVED = "dist string, product string, line_no int, subproduct string, want_offset long, name_variant string, delta long, error string"
_RESOLVED = [c.split()[0] for c in RESOLVED.split(", ")]
#: Bytes of an image file that one task reads payloads from.
SPAN = 64 << 20


def _places(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images (dist, subproduct, uri) that are files, and images (dist, subproduct, content) whose bytes are in the table."""
    named = images.withColumnRenamed("rel_path", "subproduct")
    if "content" not in images.columns:
        return named.select(*IMAGE, "uri"), named.select(*IMAGE, F.lit(None).cast("binary").alias("content")).limit(0)
    return named.where("content IS NULL").select(*IMAGE, "uri"), named.where("content IS NOT NULL").select(*IMAGE, "content")


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[kind]) for c, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])


def _followed(image, rows: list, options: Options) -> Iterator[tuple]:
    """Each request of one image, with place, form, drift and error: rows are in order of product and position, each product from no drift."""
    around = Around(options.resync_back, options.resync_forward, options.resync_chunk)
    for _, own in groupby(rows, key=lambda r: r.product):
        own = list(own)
        for r, (place, form, drift) in zip(own, follow(image, [(r.fname, int(r.offset)) for r in own], around), strict=True):
            yield r, place, form and form.decode("latin-1"), drift, None if form is not None else f"Out of sync at {r.offset} (delta={drift})"


def _resolved(image, rows: list, options: Options) -> Iterator[tuple]:
    """The rows RESOLVED of one image."""
    for r, place, form, drift, error in _followed(image, rows, options):
        yield r.dist, r.product, r.line_no, r.subproduct, place, form, drift, error


def _beside(rows: DataFrame, contents: DataFrame, made: Callable, schema: str) -> DataFrame:
    """made(image, requests) for all requests of each image whose bytes are in the table: one row an image holds both."""
    order = ["product", "position"]
    asked = rows.groupBy(*IMAGE).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in {*IMAGE, *order}]))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for dist, subproduct, asked, content in zip(*(batch.column(c) for c in (*IMAGE, "asked", "content")), strict=True):
                place = {"dist": dist.as_py(), "subproduct": subproduct.as_py()}
                for row in made(open_image(None, content.as_py()), [SimpleNamespace(**place, **r) for r in asked.as_py()]):
                    out.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size >= BATCH:
                        yield _batch(out, schema)
                        out, size = [], 0
            yield _batch(out, schema)

    return contents.join(asked, IMAGE).select(*IMAGE, "asked", "content").mapInArrow(run, schema)


def _at_offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds `form`: the form of the name whose record begins at the offset itself, or null. Rows come image by image."""
    uri, image = None, None
    for batch in batches:
        forms = []
        for r in batch.itertuples():
            if r.uri != uri:
                if image is not None:
                    image.close()
                uri, image = r.uri, open_image(r.uri)
            form = form_at(image, r.fname, r.offset)
            forms.append(form and form.decode("latin-1"))
        yield batch.assign(form=forms)
    if image is not None:
        image.close()


def _by_place(rows: DataFrame, at: str) -> DataFrame:
    """Requests dealt by image and stretch of it, in order of place."""
    return rows.withColumn("__span", F.floor(F.col(at) / SPAN)).repartition(*IMAGE, "__span").sortWithinPartitions(*IMAGE, at).drop("__span")


def _valid(asked: DataFrame) -> DataFrame:
    """Requests that may have a record."""
    return _needs_image(asked).where("payload_size >= 0 AND offset >= 0")


def _refused(asked: DataFrame, images: DataFrame) -> DataFrame:
    """The rows RESOLVED of requests without an image, and of those that cannot have a record."""
    rows, known = _needs_image(asked), images.select("dist", F.col("rel_path").alias("subproduct")).distinct()
    failed = lambda df, error: df.select(*KEY, "subproduct", F.lit(None).cast("long").alias("want_offset"), F.lit(None).cast("string").alias("name_variant"), F.lit(None).cast("long").alias("delta"), error.alias("error"))
    absent = failed(rows.join(known, IMAGE, "left_anti"), F.concat(F.lit("Cannot open subproduct file: "), "dist", F.lit("/"), "subproduct"))
    return absent.unionByName(failed(rows.where("NOT (payload_size >= 0 AND offset >= 0)").join(known, IMAGE, "left_semi"), F.lit("Invalid payload metadata")))


def _in_files(asked: DataFrame, files: DataFrame, options: Options) -> DataFrame:
    """The rows RESOLVED of requests for images that are files."""
    tested = _by_place(_valid(asked).select(*KEY, "subproduct", "fname", "offset", "position").join(files, IMAGE), "offset").select(*KEY, "subproduct", "fname", "offset", "position", "uri")
    schema = "dist string, product string, line_no int, subproduct string, fname string, offset long, position int, uri string, form string"
    tested = stored(tested.mapInPandas(_at_offsets, schema))
    stream = [*PRODUCT, "subproduct"]
    missed = tested.where("form IS NULL").groupBy(*stream).agg(F.min("position").alias("from"))
    tested = tested.join(missed, stream, "left")
    straight = tested.where("from IS NULL OR position < from").select(*KEY, "subproduct", F.col("offset").alias("want_offset"), F.col("form").alias("name_variant"), F.lit(0).cast("long").alias("delta"), F.lit(None).cast("string").alias("error"))

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        with open_image(rows.uri.iloc[0]) as image:
            found = pd.DataFrame(_resolved(image, list(rows.sort_values("position").itertuples()), options), columns=_RESOLVED)
        return found.astype({"want_offset": "Int64", "delta": "Int64"})

    return straight.unionByName(tested.where("position >= from").drop("form", "from").groupBy(*stream).applyInPandas(ordered, RESOLVED))


def resolve_offsets(asked: DataFrame, images: DataFrame, options: Options = Options()) -> DataFrame:
    """Where the record of each requested file with a payload lies: see RESOLVED.

    images: dist, rel_path, uri, and optionally content. delta is the drift that holds after the record.
    """
    files, contents = _places(images)
    rows = _valid(asked).select(*KEY, "subproduct", "fname", "offset", "position")
    inside = _beside(rows, contents, lambda image, own: _resolved(image, own, options), RESOLVED)
    return _refused(asked, images).unionByName(inside).unionByName(_in_files(asked, files, options))


UNPACKED = "dist string, product string, line_no int, position int, out_path string, action string, perms int, content binary, z_content binary, error string"
#: place: where the payload begins, if all of it is there.
PLACED = f"{UNPACKED}, place long"


def _payload(image, r, record: int, form: str, options: Options) -> tuple:
    """content, z_content, error and place of the payload whose record begins at a place."""
    place = int(record) + 2 + len(form)
    payload = read_range(image, place, place + int(r.payload_size))
    if len(payload) < r.payload_size:
        return None, None, f"Short read for {r.fname}", None
    content, failed = (None, False) if options.no_decompress else content_of(payload)
    error = f"LZW decompress failed: {r.fname}" if failed else None
    if options.no_content:
        return None, None, error, place
    return content, payload if options.no_decompress or options.keep_z else None, error, place


def _row(r, found: tuple, options: Options) -> tuple:
    return r.dist, r.product, r.line_no, r.position, r.out_path, "packed" if options.no_decompress else "file", r.perms, *found


def _found(image, rows: list, options: Options) -> Iterator[tuple]:
    """The rows PLACED of one image whose records are yet to be found."""
    for r, record, form, _, error in _followed(image, rows, options):
        yield _row(r, (None, None, error, None) if error else _payload(image, r, record, form, options), options)


def _by_range(rows: DataFrame, files: DataFrame, at: str, made: Callable, schema: str) -> DataFrame:
    """made(image, request) for all requests whose image is a file: read by range, neighbours together."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=columns)
        return found.astype({"place": "Int64"}) if "place" in columns else found

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, image = None, None
        for batch in batches:
            out, size = [], 0
            for r in batch.itertuples():
                if r.uri != uri:
                    if image is not None:
                        image.close()
                    uri, image = r.uri, open_image(r.uri)
                out.append(made(image, r))
                size += sum(len(x) for x in out[-1] if isinstance(x, bytes))
                if size >= BATCH:
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)
        if image is not None:
            image.close()

    return _by_place(rows.join(files, IMAGE), at).mapInPandas(read, schema)


def unpack(asked: DataFrame, images: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each request (see UNPACKED): directories, links, empty files, and files read and decoded."""
    return _placed(asked, images, options).drop("place")


def _placed(asked: DataFrame, images: DataFrame, options: Options) -> DataFrame:
    """The rows of unpack, and where their payloads lie (see PLACED)."""
    text, binary, place = F.lit(None).cast("string"), F.lit(None).cast("binary"), F.lit(None).cast("long").alias("place")
    perms = C.permissions(F.col("mode"))
    simple = asked.where("ftype IN ('d', 'l') OR ftype = 'f' AND payload_size = 0")
    is_link = F.col("ftype") == "l"
    link = F.encode("symval", "UTF-8")
    action = F.when(F.col("ftype") == "d", "mkdir").when(is_link, "link_text" if options.link_fallback else "symlink").otherwise("file")
    content = F.when(is_link, link).when(F.col("ftype") == "f", F.lit(b""))
    path = F.when(is_link & F.lit(options.link_fallback), F.concat("out_path", F.lit(".link.txt"))).otherwise(F.col("out_path"))
    mode = F.when(is_link, F.when(F.lit(options.link_fallback), F.lit(0o644))).otherwise(perms)
    made = simple.select(*KEY, "position", path.alias("out_path"), action.alias("action"), mode.alias("perms"), content.alias("content"), binary.alias("z_content"), text.alias("error"), place)
    files, contents = _places(images)
    located = stored(_refused(asked, images).unionByName(_in_files(asked, files, options)).drop("delta"))
    wanted = _needs_image(asked).select(*KEY, "position", "out_path", "fname", "payload_size", perms.alias("perms"))
    rows = wanted.join(located, KEY)
    failed = rows.where("error IS NOT NULL").select(*KEY, "position", "out_path", F.lit("packed" if options.no_decompress else "file").alias("action"), "perms", binary.alias("content"), binary.alias("z_content"), "error", place)
    rows = rows.where("error IS NULL").drop("error")

    from_files = _by_range(rows, files, "want_offset", lambda image, r: _row(r, _payload(image, r, r.want_offset, r.name_variant, options), options), PLACED)
    own = _valid(asked).select(*KEY, "subproduct", "position", "out_path", "fname", "offset", "payload_size", perms.alias("perms"))
    inside = _beside(own, contents, lambda image, rows: _found(image, rows, options), PLACED)
    return made.unionByName(failed).unionByName(from_files).unionByName(inside)


def with_clashes(unpacked: DataFrame) -> DataFrame:
    """Adds path-clash errors: of two requests of which one needs a directory where the other needs a file, the later fails."""
    rows = unpacked.withColumn("parent", C.parent_path(F.col("out_path")))
    folders = rows.where("error IS NULL").select(*PRODUCT, "position", F.explode(F.concat(C.ancestors(F.col("out_path")), F.when(F.col("action") == "mkdir", F.array("out_path")).otherwise(F.array().cast(C.NO_STRINGS)))).alias("path"))
    folders = folders.groupBy(*PRODUCT, "path").agg(F.min("position").alias("dir_from"))
    files = rows.where("error IS NULL AND action != 'mkdir'").groupBy(*PRODUCT, F.col("out_path").alias("path")).agg(F.min("position").alias("file_from"))
    above = rows.select(*KEY, "position", F.explode(C.ancestors(F.col("out_path"))).alias("path")).join(files, [*PRODUCT, "path"]).where("file_from < position").select(*KEY, F.lit(True).alias("under_file")).distinct()
    rows = rows.join(folders.withColumnRenamed("path", "out_path"), [*PRODUCT, "out_path"], "left").join(files.withColumnRenamed("path", "out_path"), [*PRODUCT, "out_path"], "left").join(above, KEY, "left")
    link = F.col("action").isin("symlink", "link_text")
    clash = (
        F.when(F.col("under_file") & (F.col("action") == "mkdir"), F.concat(F.lit("Cannot create directory "), "out_path"))
        .when(F.col("under_file") & link, F.concat(F.lit("Cannot create parent for symlink "), "out_path"))
        .when(F.col("under_file"), F.concat(F.lit("Cannot create parent directory for "), "out_path"))
        .when((F.col("action") == "mkdir") & (F.col("file_from") < F.col("position")), F.concat(F.lit("Cannot create directory "), "out_path"))
        .when(~link & (F.col("action") != "mkdir") & (F.col("dir_from") < F.col("position")), F.concat(F.lit("Output path is a directory: "), "out_path"))
    )
    return rows.withColumn("error", F.coalesce("error", clash)).drop("parent", "dir_from", "file_from", "under_file")


def final_files(unpacked: DataFrame) -> DataFrame:
    """What remains on disk: of successful writes to one path the last."""
    last = unpacked.where("error IS NULL").groupBy(*PRODUCT, "out_path").agg(F.max("position").alias("position"))
    return unpacked.where("error IS NULL").join(last, [*PRODUCT, "out_path", "position"], "left_semi")


def outcomes(asked: DataFrame, unpacked: DataFrame, options: Options = Options()) -> DataFrame:
    """Key, position, fname, status (extracted, skipped, error, not_attempted) and error of every request."""
    done = unpacked.select(*KEY, "error")
    rows = asked.select(*KEY, "position", "fname", "ftype").join(done, KEY, "left")
    status = F.when(~F.col("ftype").isin("f", "d", "l"), "skipped").when(F.col("error").isNotNull(), "error").otherwise("extracted")
    rows = rows.select(*KEY, "position", "fname", status.alias("status"), "error")
    if options.continue_on_error:
        return rows
    first = rows.where("status = 'error'").groupBy(*PRODUCT).agg(F.min("position").alias("stop"))
    rows = rows.join(first, PRODUCT, "left")
    after = F.coalesce(F.col("position") > F.col("stop"), F.lit(False))
    return rows.select(*KEY, "position", "fname", F.when(after, "not_attempted").otherwise(F.col("status")).alias("status"), F.when(~after, F.col("error")).alias("error"))


def summary(results: DataFrame) -> DataFrame:
    """Counters of each run (product): total counts all requests, even those not attempted."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return results.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("total"), count("extracted"), count("skipped"), count("error").alias("errors"))


def first_errors(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n error messages of each run, as `name: error`."""
    failed = results.where("status = 'error'").select(*PRODUCT, "position", F.concat("fname", F.lit(": "), "error").alias("message"))
    order = F.row_number().over(Window.partitionBy(*PRODUCT).orderBy("position"))
    return failed.withColumn("rank", order).where(F.col("rank") <= n).select(*PRODUCT, "rank", "message")


def _to_write(done: DataFrame, has_copy: Column) -> tuple[DataFrame, DataFrame]:
    """What the content sink holds: the final files, and the packed copies that are rows of their own: of each path the last, if no entry has its name."""
    taken = done.where("error IS NULL").select(*PRODUCT, F.col("out_path")).distinct()
    last = F.row_number().over(Window.partitionBy(*PRODUCT, "out_path").orderBy(F.desc("position")))
    packed = done.where(has_copy).withColumn("__last", last).where(F.col("__last") == 1).drop("__last")
    packed = packed.withColumns({"out_path": F.concat("out_path", F.lit(".Z")), "action": F.lit("packed"), "perms": F.lit(None).cast("int")})
    return final_files(done).where("action != 'packed'"), packed.join(taken, [*PRODUCT, "out_path"], "left_anti")


WRITTEN = "dist string, product string, out_path string, action string, perms int, content binary"
_WRITTEN = [c.split()[0] for c in WRITTEN.split(", ")]


def _write(rows: DataFrame, path: str) -> None:
    with writing(rows.sparkSession):
        rows.select(*_WRITTEN).write.partitionBy("dist").parquet(path)


def write_unpacked(unpacked: DataFrame, path: str) -> None:
    """The content sink: Parquet with out_path, perms, content, link targets, and `.Z` copies as rows of their own."""
    files, packed = _to_write(unpacked, F.col("z_content").isNotNull())
    _write(files.select(*_WRITTEN).unionByName(packed.withColumn("content", F.col("z_content")).select(*_WRITTEN)), path)


def _written(image, r) -> tuple:
    """The row WRITTEN of a payload that is known to be there."""
    payload = read_range(image, int(r.place), int(r.place + r.payload_size))
    return r.dist, r.product, r.out_path, r.action, r.perms, payload if r.action == "packed" else content_of(payload)[0]


def unpack_to(asked: DataFrame, images: DataFrame, path: str, options: Options = Options()) -> None:
    """The content sink of all requests, clashes included, without storing or shuffling contents.

    Errors, clashes and final files are found first, by decoding without keeping; what is to be written is then read and decoded again.
    """
    done = stored(with_clashes(stored(_placed(asked, images, replace(options, no_content=True)).drop("z_content"))))
    kept = F.col("place").isNotNull() & F.lit(options.keep_z or options.no_decompress)
    files, packed = _to_write(done, kept)
    rows = files.unionByName(packed).join(asked.select(*KEY, "subproduct", "payload_size"), KEY)
    rows = stored(rows.select(*IMAGE, "product", "position", "out_path", "action", "perms", "content", "place", "payload_size"))
    plain, rows = rows.where("place IS NULL"), rows.where("place IS NOT NULL").drop("content")
    in_files, in_table = _places(images)
    inside = _beside(rows, in_table, lambda image, own: (_written(image, r) for r in own), WRITTEN)
    _write(plain.select(*_WRITTEN).unionByName(inside).unionByName(_by_range(rows, in_files, "place", _written, WRITTEN)), path)


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path, content) under a folder of any store that Arrow's filesystems reach; path and length of each, once written.

    A task that runs again writes the same bytes to the same place.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        for batch in batches:
            sizes = []
            for r in batch.itertuples():
                place = f"{root}/{r.path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(r.content)
                sizes.append(len(r.content))
            yield pd.DataFrame({"path": batch.path, "length": sizes})

    return files.select("path", "content").mapInPandas(write, "path string, length long")
