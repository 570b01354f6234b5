import random
import subprocess

import pytest
from pyspark.sql.functions import lit

from distloom.functions.images import Window, follow, headers, open_image
from distloom.functions.lzw import DecodeError, content_of, decode
from distloom.operators import unpack
from distloom.plans.index import build_index
from tests.compressor import compress
from tests.test_index import files, lines


@pytest.mark.parametrize(("stream", "content"), [("1F9D90610202", b"aaa"), ("1F9D90", b""), ("1F9D9061", b""), ("414243", b"ABC")])
def test_golden_streams(stream, content):
    assert content_of(bytes.fromhex(stream)) == (content, False)


@pytest.mark.parametrize("stream", ["1F9D906104FE", "1F9D", "1F9D88", "1F9D91"])
def test_bad_streams(stream):
    assert content_of(bytes.fromhex(stream)) == (None, True)
    with pytest.raises(DecodeError):
        decode(bytes.fromhex(stream))


def slow_decode(stream):
    """A bit-by-bit reader, for comparison."""
    limit, block = stream[2] & 31, bool(stream[2] & 128)
    table, width, top = {i: bytes([i]) for i in range(256)}, 9, 511
    free, last, out, at = 257 if block else 256, None, b"", 3
    group, bit = b"", 0
    clear = False
    while True:
        if clear or free > top or bit + width > len(group) * 8:
            if free > top:
                width += 1
                top = 1 << limit if width == limit else (1 << width) - 1
            if clear:
                width, top, clear = 9, 511, False
            group, bit = stream[at : at + width], 0
            at += len(group)
            if len(group) * 8 < width:
                return out
        code = int.from_bytes(group, "little") >> bit & ((1 << width) - 1)
        bit += width
        if block and code == 256:
            clear, free, last = True, 257, None
            table = {i: bytes([i]) for i in range(256)}
            continue
        if last is None:
            if code > 255:
                raise DecodeError
            word = table[code]
        elif code in table and (code < 256 or code < free):
            word = table[code]
        elif code == free:
            word = last + last[:1]
        else:
            raise DecodeError
        out += word
        if last is not None and free < 1 << limit:
            table[free] = last + word[:1]
            free += 1
        last = word


def test_decode_against_slow_reader_and_gzip():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 300, 4000, 70000):
        for alphabet in (2, 30, 256):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            stream = compress(data)
            assert decode(stream) == data
            assert subprocess.run(["gzip", "-dc"], input=stream, capture_output=True).stdout == data
    for flags in (0x89, 0x8C, 0x90, 0x0A, 0x09):
        for _ in range(300):
            stream = bytes([0x1F, 0x9D, flags]) + bytes(rng.choice((rng.randrange(256), 0, 1)) for _ in range(rng.randrange(60)))
            try:
                expected = slow_decode(stream)
            except DecodeError:
                expected = None
            assert content_of(stream) == (expected, expected is None)


def record(name, payload):
    raw = name.encode("latin-1")
    return len(raw).to_bytes(2, "big") + raw + payload


def image(*parts):
    return b"im001V405P00\n" + b"".join(parts)


A, B, F = ("usr/bin/a", b"x" * 40), ("usr/bin/b", b"1234567"), ("usr/bin/f", b"abc")


def locate(content, wanted, chunk=1 << 20, back=1 << 20, forward=16 << 20):
    """((place, form) or None of each record, the drift at the end)."""
    found = list(follow(open_image(None, content), wanted, Window(back, forward, chunk)))
    return [None if place is None else (place, form) for place, form, _ in found], found[-1][2]


def test_resync():
    want = [("usr/bin/a", 13), ("usr/bin/b", 64), ("usr/bin/f", 82)]
    exact = image(record(*A), record(*B), record(*F))
    assert [x[0] for x in locate(exact, want)[0]] == [13, 64, 82]
    junk = image(record(*A), b"junk!", record(*B), record(*F))
    found, delta = locate(junk, want)
    assert ([x[0] for x in found], delta) == ([13, 69, 87], 5)
    assert locate(junk, want[2:])[0][0][0] == 87
    dotted = image(record(*A), record("./usr/bin/b", B[1]), record(*F))
    assert locate(dotted, want[:2])[0][1] == (64, b"./usr/bin/b")
    assert locate(image(record(*A), record(*F)), want)[0][1] is None
    twice = image(b"j", record(*B), record(*B))
    assert locate(twice, [("usr/bin/b", 40)])[0][0][0] == 14
    across = image(b"." * 4080, record(*B))
    assert locate(across, [("usr/bin/b", 13)], chunk=10)[0][0][0] == 13 + 4080
    assert list(headers("a").items()) == [(b"a", b"\0\1a"), (b"./a", b"\0\3./a"), (b"/a", b"\0\2/a")]
    # Drift without a hit around: the plain offset counts, and drift is zero again.
    back = image(b"junk!", record(*A), record(*B), b"." * 9000, record(*F))
    wanted = [("usr/bin/a", 13), ("usr/bin/b", 64), ("usr/bin/f", len(back) - len(record(*F)))]
    assert locate(back, wanted, back=0, forward=100)[1] == 0


def plain_scan(data, name, want, back, forward, chunk):
    """The search chunk by chunk, form by form, place by place."""
    known = list(headers(name).items())
    overlap = max(len(h) for _, h in known)
    start, end = max(0, want - back), min(len(data), want + forward)
    at = start
    while at < end:
        for form, head in known:
            for p in range(at, min(at + chunk, end) - len(head) + 1):
                if data[p : p + len(head)] == head:
                    return p, form
        at += chunk - overlap
    return None


def test_search_agrees_with_the_plain_one():
    rng = random.Random(3)
    for _ in range(60):
        parts = [rng.choice([record("n", b"xy"), record("./n", b""), record("/n", b"z"), b"." * rng.randrange(3000), b"n", b"\0\1"]) for _ in range(rng.randrange(1, 12))]
        data = b"".join(parts)
        want, back, forward = rng.randrange(len(data) + 50), rng.choice([0, 100, 9000]), rng.choice([0, 50, 20000])
        assert Window(back, forward, 1).find(open_image(None, data), "n", want) == plain_scan(data, "n", want, back, forward, 4096)


TEXT = [
    "d 0755 root sys usr usr toy.sw.base",
    "f 0755 root sys usr/bin/a src/a toy.sw.base size(40)",
    "f 0644 root sys usr/bin/b src/b toy.sw.base size(7)",
    "l 0777 root sys usr/sbin src/sbin toy.sw.base symval(bin)",
    "f 0644 root sys usr/bin/f src/f toy.sw.base size(9) cmpsize(6)",
    "f 0600 root sys usr/empty src/e toy.sw.base",
    "c 0600 root sys dev/x src/x toy.sw.base",
    "f 0644 root sys usr/bin/b src/b toy.sw.base size(3)",
    "f 0644 root sys gone src/g toy.sw.base size(3)",
    "f 0644 root sys usr/empty/y src/y toy.sw.base",
    "f 0644 root sys usr src/u toy.sw.base",
]


@pytest.fixture(scope="module")
def asked(spark):
    return unpack.requests(build_index(lines(spark, TEXT), files(spark)).entries).cache()


def images(spark, content):
    return spark.createDataFrame([("t", "toy.sw", "", bytearray(content))], "dist string, rel_path string, uri string, content binary")


Z = bytes.fromhex("1F9D90610202")
CONTENT = image(record(*A), record(*B), record("usr/bin/f", Z), record("usr/empty", b""), record("usr/bin/b", b"new"))


def test_unpack(spark, asked):
    out = unpack.with_clashes(unpack.unpack(asked, images(spark, CONTENT)))
    got = {r.line_no: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert (got[1].action, got[1].perms, got[4].action, bytes(got[4].content)) == ("mkdir", 0o755, "symlink", b"bin")
    assert [bytes(got[n].content) for n in (2, 3, 5, 6, 8)] == [b"x" * 40, b"1234567", b"aaa", b"", b"new"]
    assert got[9].error.startswith("Out of sync at ")
    assert got[10].error == "Cannot create parent directory for usr/empty/y"
    assert got[11].error == "Output path is a directory: usr"
    kept = {(r.out_path, bytes(r.content)) for r in unpack.final_files(out).where("out_path = 'usr/bin/b'").collect()}
    assert kept == {("usr/bin/b", b"new")}
    results = unpack.outcomes(asked, out)
    assert [tuple(r)[2:] for r in unpack.summary(results).collect()] == [(11, 7, 1, 3)]
    assert [r.message for r in unpack.first_errors(results, 2).orderBy("rank").collect()][1] == "usr/empty/y: Cannot create parent directory for usr/empty/y"
    stopped = unpack.outcomes(asked, out, unpack.Options(continue_on_error=False))
    assert [tuple(r)[2:] for r in unpack.summary(stopped).collect()] == [(11, 7, 1, 1)]


def test_packed_and_kept(spark, asked, tmp_path):
    f = asked.where("line_no = 5")
    packed = unpack.unpack(f, images(spark, CONTENT), unpack.Options(no_decompress=True)).first()
    assert (packed.action, bytes(packed.z_content), packed.content) == ("packed", Z, None)
    both = unpack.unpack(f, images(spark, CONTENT), unpack.Options(keep_z=True))
    unpack.write_unpacked(both, str(tmp_path / "u"))
    assert {(r.out_path, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {("usr/bin/f", b"aaa"), ("usr/bin/f.Z", Z)}
    text = unpack.unpack(asked.where("line_no = 4"), images(spark, CONTENT), unpack.Options(link_fallback=True)).first()
    assert (text.out_path, text.action, text.perms, bytes(text.content)) == ("usr/sbin.link.txt", "link_text", 0o644, b"bin")


def test_short_and_broken_payloads(spark, asked, tmp_path):
    path = tmp_path / "toy.sw"
    path.write_bytes(CONTENT[:-1])
    place = spark.createDataFrame([("t", "toy.sw", f"file://{path}")], "dist string, rel_path string, uri string")
    files = [(f"x/{n}", content) for n, content in (("a", b"1"), ("_b", b""), (".c", b"333"))]
    made = unpack.export_files(spark.createDataFrame(files, "path string, content binary"), f"file://{tmp_path}/out")
    assert {tuple(r) for r in made.collect()} == {("x/a", 1), ("x/_b", 0), ("x/.c", 3)} and (tmp_path / "out/x/.c").read_bytes() == b"333"
    assert unpack.unpack(asked.where("line_no = 8"), place).first().error == "Short read for usr/bin/b"
    broken = image(record(*A), record(*B), record("usr/bin/f", bytes.fromhex("1F9D906104FE")))
    assert unpack.unpack(asked.where("line_no = 5"), images(spark, broken)).first().error == "LZW decompress failed: usr/bin/f"
    (tmp_path / "whole.sw").write_bytes(image(b"junk!", CONTENT[13:]))
    drifted = place.withColumn("uri", lit(f"file://{tmp_path}/whole.sw"))
    got = {r.line_no: (r.want_offset, r.delta, r.error) for r in unpack.resolve_offsets(asked, drifted).collect()}
    inside = {r.line_no: (r.want_offset, r.delta, r.error) for r in unpack.resolve_offsets(asked, images(spark, image(b"junk!", CONTENT[13:]))).collect()}
    assert got == inside and got[2] == (18, 5, None)
    none = spark.createDataFrame([], "dist string, rel_path string, uri string")
    assert unpack.unpack(asked.where("line_no = 2"), none).first().error == "Cannot open subproduct file: t/toy.sw"
