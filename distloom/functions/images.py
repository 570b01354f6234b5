"""Reading subproduct images by range: record headers, re-synchronisation, payloads."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

#: The smallest chunk of a re-synchronisation window.
LEAST_CHUNK = 4096


def find_store(uri: str) -> tuple:
    """The Arrow filesystem of a uri, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", uri))


def open_image(uri: str | None, content: bytes | None = None) -> BinaryIO:
    """A seekable file: the given content, or the file at uri in any store that Arrow's filesystems reach."""
    if content is not None:
        return io.BytesIO(content)
    store, path = find_store(uri)
    return store.open_input_file(path)


def read_range(image: BinaryIO, first: int, end: int) -> bytes:
    """Bytes first to end, as far as the image has them."""
    if first < 0 or end <= first:
        return b""
    image.seek(first)
    return image.read(end - first)


def headers(name: str) -> dict[bytes, bytes]:
    """The forms in which a record may hold a name, in order of preference, and the header bytes of each."""
    raw = name.encode("latin-1", "replace")
    return {form: (len(form) % 65536).to_bytes(2, "big") + form for form in (raw, b"./" + raw, b"/" + raw)}


def form_at(image: BinaryIO, name: str, place: int) -> bytes | None:
    """The form of the name whose record begins at a place, if one does."""
    known = headers(name)
    there = read_range(image, place, place + max(map(len, known.values())))
    return next((form for form, head in known.items() if there.startswith(head)), None)


@dataclass(frozen=True)
class Window:
    """What is searched around an expected place: bytes before and after it, in chunks that overlap by a header."""

    back: int
    forward: int
    chunk: int

    def find(self, image: BinaryIO, name: str, want: int) -> tuple[int, bytes] | None:
        """Place and form of a record of that name: from the first chunk that holds one, there by form, then by place."""
        known = headers(name)
        first, data = max(0, want - self.back), b""
        if want + self.forward > first:
            data = read_range(image, first, want + self.forward)
        chunk = max(LEAST_CHUNK, self.chunk)
        stride = chunk - max(map(len, known.values()))

        def rank(at: int, order: int, size: int) -> tuple[int, int, int]:
            """The number of the first chunk that reaches to the end of a header, then form and place."""
            return max(0, -((chunk - at - size) // stride)), order, at

        hits = {rank(at, order, len(head)): form for order, (form, head) in enumerate(known.items()) for at in occurrences(data, head)}
        if not hits:
            return None
        best = min(hits)
        return first + best[2], hits[best]


def occurrences(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


def follow(image: BinaryIO, wanted: Iterable[tuple[str, int]], window: Window) -> Iterator[tuple[int | None, bytes | None, int]]:
    """For records (name, offset) in order: place and form (None where there is none), and the drift that now holds.

    Drift is how far the last record that was found lies from its offset. A record is expected there, else searched around
    there, else, without drift, where its offset says.
    """
    drift = 0
    for name, offset in wanted:
        place = offset + drift
        form = form_at(image, name, place)
        if form is None:
            place, form = window.find(image, name, place) or (offset, form_at(image, name, offset) if drift else None)
        if form is not None:
            drift = place - offset
        yield (place, form, drift) if form is not None else (None, None, drift)
