"""A compressor of .Z streams, for tests alone."""


def compress(data: bytes) -> bytes:
    """A .Z stream of data: maximum width 12, block mode, no clear codes."""
    table = {bytes([i]): i for i in range(256)}
    codes, free, word = [], 257, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        if free < 4096:
            table[longer] = free
            free += 1
        word = data[i : i + 1]
    if word:
        codes.append(table[word])
    out, free, top, width, group = bytearray(b"\x1f\x9d\x8c"), 257, 511, 9, []

    def flush(whole: bool) -> None:
        if group:
            number = sum(c << (width * i) for i, c in enumerate(group))
            out.extend(number.to_bytes(width if whole else -(-width * len(group) // 8), "little"))
            group.clear()

    for i, code in enumerate(codes):
        if free > top and width < 12:  # the reader widens here, and drops the rest of its group
            flush(True)
            width += 1
            top = 4096 if width == 12 else (1 << width) - 1
        group.append(code)
        if len(group) == 8:
            flush(True)
        free += i > 0 and free < 4096
    flush(False)
    return bytes(out)
