"""Decoding `.Z` payloads (Unix compress)."""

from __future__ import annotations

from functools import cache

import numpy as np

MAGIC = b"\x1f\x9d"
_CLEAR = 256
#: Codes that are read at once at most.
MOST = 1 << 16


class DecodeError(ValueError):
    """The stream is no valid .Z stream."""


@cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of MOST codes of `width` bits: the byte where each begins, and its bit there."""
    bit = np.arange(MOST, dtype=np.int64) * width
    return bit >> 3, (bit & 7).astype(np.uint32)


def _codes(data: np.ndarray, width: int, most: int) -> np.ndarray:
    """Up to `most` codes of `width` bits, lowest bits first; a code cut short by the end is not there."""
    n = min(most, len(data) * 8 // width)
    at, shift = (x[:n] for x in _places(width))
    padded = np.zeros((n * width + 7) // 8 + 3, dtype=np.uint32)
    padded[:-3] = data[: len(padded) - 3]
    return (padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16)[at] >> shift & ((1 << width) - 1)


def _literals(codes: np.ndarray) -> int:
    """How many codes stand before the first that is no byte."""
    other = codes > 255
    first = int(other.argmax())
    return first if other[first] else len(codes)


def _short_blocks(codes: np.ndarray, most: int) -> tuple[bytes, int]:
    """What blocks of single bytes hold, each ended by the clear code after at most `most` codes in all and at the end of a group, and their number of codes."""
    ends = np.flatnonzero(codes >= _CLEAR)
    other = (codes[ends] != _CLEAR) | (ends % 8 != 7) | (np.diff(ends, prepend=-1) > most)
    whole = ends[: int(other.argmax()) if other.any() else len(ends)]
    used = int(whole[-1]) + 1 if len(whole) else 0
    return codes[:used][codes[:used] < _CLEAR].astype(np.uint8).tobytes(), used


def decode(stream: bytes) -> bytes:
    """The content of a .Z stream. A stream that ends early ends the content quietly; a bad code is an error.

    A table entry is the previous string and the byte after it, which lie side by side in what is already
    written, so an entry is a place and a length there.
    """
    if len(stream) < 3 or stream[:2] != MAGIC:
        raise DecodeError("not a .Z stream")
    limit, block = stream[2] & 0x1F, bool(stream[2] & 0x80)
    if not 9 <= limit <= 16:
        raise DecodeError("unsupported maximum width")
    data, position = np.frombuffer(stream, dtype=np.uint8)[3:], 0
    first = _CLEAR + 1 if block else _CLEAR
    width, top, free = 9, 511, first
    start, length = [0] * (1 << limit), [0] * (1 << limit)
    out = bytearray()
    last, size = -1, 0  # where the previous string starts and how long it is; -1: none yet
    while position < len(data):
        room = top - free + 1 + (last < 0)  # codes until the width grows; the first code after a clear adds no entry
        if max(top, free) >= 1 << limit:
            room = MOST  # the width stays: any number of whole groups
        codes = _codes(data[position:], width, room)
        if not len(codes):
            break
        cleared = False
        used = len(codes)
        literals = _literals(codes)
        ended = block and literals < used and codes[literals] == _CLEAR
        if ended and last < 0:  # no entry of such a block is looked up: many at once
            text, whole = _short_blocks(_codes(data[position:], width, MOST), room)
            if whole:
                out += text
                position += whole // 8 * width
                continue
        if last < 0 and literals:  # the first code after a clear adds no entry
            out.append(int(codes[0]))
            last, size, done = len(out) - 1, 1, 1
        else:
            done = 0
        if literals > done:  # bytes up to the first other code at once: each adds the string before it and itself
            here, added = len(out), min(literals - done, (1 << limit) - free)
            if ended:
                added = 0  # no one looks them up
            out += codes[done:literals].astype(np.uint8).tobytes()
            if added > 0:
                start[free : free + added] = [last, *range(here, here + added - 1)]
                length[free : free + added] = [size + 1] + [2] * (added - 1)
                free += added
            last, size, done = len(out) - 1, 1, literals
        for i, code in enumerate(codes[done:].tolist(), done):
            if block and code == _CLEAR:
                cleared, used = True, i + 1
                break
            here = len(out)
            if last < 0:
                if code > 255:
                    raise DecodeError("corrupt start")
                out.append(code)
                last, size = here, 1
                continue
            if code < 256:
                out.append(code)
                n = 1
            elif code < free:
                n = length[code]
                out += out[start[code] : start[code] + n]
            elif code == free:
                n = size + 1
                out += out[last : last + size]
                out.append(out[last])
            else:
                raise DecodeError("code beyond the table")
            if free < 1 << limit:
                start[free], length[free] = last, size + 1
                free += 1
            last, size = here, n
        position += -(-used // 8) * width
        if cleared:
            width, top, free, last = 9, 511, first, -1
        elif free > top:
            width += 1
            top = 1 << limit if width == limit else (1 << width) - 1
        elif used < room:
            break
    return bytes(out)


def content_of(payload: bytes) -> tuple[bytes | None, bool]:
    """(content, failed): a payload with the magic is decoded, any other is its own content."""
    if payload[:2] != MAGIC:
        return payload, False
    try:
        return decode(payload), False
    except DecodeError:
        return None, True
