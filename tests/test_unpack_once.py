import random

from distloom.functions import lzw
from distloom.operators import unpack
from distloom.plans.recipes import _packed
from tests.test_unpack import CONTENT, asked, image, images, record, slow_decode  # noqa: F401


def test_blocks_of_bytes_are_read_at_once(monkeypatch):
    data, calls, plain = random.Random(2).randbytes(200_000), [], lzw._codes
    monkeypatch.setattr(lzw, "_codes", lambda *given: calls.append(1) or plain(*given))
    assert lzw.decode(_packed(data)) == data
    assert len(calls) < 40


def test_block_with_entries_between_blocks_of_bytes():
    """Only a block that ends with a group is skipped over; one with an entry, or cleared within a group, is not."""
    literal = [*b"abcdefg", 256]
    for block in ([97, 257, 258, 98, 99, 100, 101, 256], [97, 98, 256, 7, 7, 7, 7, 7], [256, 0, 0, 0, 0, 0, 0, 0]):
        stream = b"".join(sum(c << 9 * k for k, c in enumerate(group)).to_bytes(9, "little") for group in (literal, literal, block, literal))
        stream = b"\x1f\x9d\x8c" + stream
        assert lzw.decode(stream) == slow_decode(stream)


def test_errors_without_contents(spark, asked):  # noqa: F811
    """Payloads are decoded and what fails is told, and no content is returned for them."""
    broken = image(record("usr/bin/a", b"x" * 40), record("usr/bin/f", bytes.fromhex("1F9D906104FE")), record("usr/bin/b", b"12"))
    for content in (CONTENT, CONTENT[:-1], broken):
        whole = unpack.unpack(asked, images(spark, content))
        bare = unpack.unpack(asked, images(spark, content), unpack.Options(no_content=True))
        columns = ["line_no", "position", "out_path", "action", "perms", "error"]
        assert sorted(whole.select(*columns).collect(), key=str) == sorted(bare.select(*columns).collect(), key=str)
        assert not bare.where("line_no IN (2, 3, 5, 8) AND content IS NOT NULL").count()
