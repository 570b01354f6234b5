"""Column functions of index lines and paths. All are built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trims a line, and the patterns of index tokens.
BLANK = r"\s\x85\xA0"
SUBGROUP = r"^[A-Za-z0-9_+.-]+\.[A-Za-z0-9_+.-]+\.[A-Za-z0-9_+.-]+(?:\.[A-Za-z0-9_+.-]+)*$"
#: One attribute: a key, and its value up to the first ')' that no ':' stands before, or to the end.
ATTRIBUTE = r"[^\s\x85\xA0(]+(?:\((?:[^):]|:\)?+)*+(?:\)|\z))?"

NO_STRINGS = "array<string>"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{BLANK}]")


def tokens(line: Column) -> Column:
    """Runs of anything but ASCII white space."""
    odd = (line == "") | line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in "\t\n\x0b\x0c\r":
        odd |= line.contains(space)
    return F.when(odd, F.filter(F.split(line, r"\s+"), lambda t: t != "")).when(line.isNotNull(), F.split(line, " "))


def octal(c: Column) -> Column:
    """Base-8 int; what is no such number, or does not fit 32 bits, is 0."""
    plain = (F.length(c) <= 10) & (c != "") & (F.translate(c, "01234567", "") == "")  # most are; no pattern is matched then
    digits = F.regexp_replace(c, "^[+-]?0*", "")
    value = F.conv(F.when(digits == "", "0").otherwise(digits), 8, 10).cast("long")
    signed = F.when(c.startswith("-"), -value).otherwise(value)
    fits = c.rlike("^[+-]?[0-7]+$") & (F.length(digits) <= 11)
    number = F.when(fits, signed)
    other = F.coalesce(F.when(number.between(-(1 << 31), (1 << 31) - 1), number), F.lit(0))
    return F.when(plain, F.conv(c, 8, 10).cast("long")).otherwise(other).cast("int")


def whole_number(c: Column) -> Column:
    """Base-10 long; anything else is 0."""
    t = trimmed(c)
    plain = (F.length(c) <= 18) & (c != "") & (F.translate(c, "0123456789", "") == "")
    return F.when(plain, c.try_cast("bigint")).otherwise(F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), F.lit(0).cast("long")))


def subproduct(subgroup: Column) -> Column:
    """The first two non-empty dotted parts joined again; null if there are fewer."""
    parts = F.filter(F.split(subgroup, "[.]"), lambda t: t != "")
    whole = ~subgroup.startswith(".") & ~subgroup.endswith(".") & ~subgroup.contains("..")  # no part is empty
    other = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "."))
    return F.when(subgroup.contains("."), F.when(whole, F.substring_index(subgroup, ".", 2)).otherwise(other))


def looks_like_subgroup(token: Column) -> Column:
    return token.rlike(SUBGROUP)  # the class holds none of ( ) / =


def attributes(text: Column) -> Column:
    """The attributes of a line as they stand, in order."""
    return F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(0))


def attribute(items: Column, key: str) -> Column:
    """The value of the last attribute of that key (any case) that has one; null if none has."""
    return item_value(attribute_item(items, key), key)


def attribute_item(items: Column, key: str) -> Column:
    """The last attribute of that key (any case) that has a value, as it stands."""
    own = F.filter(items, lambda i: F.lower(F.left(i, F.lit(len(key) + 1))) == f"{key}(")
    return F.try_element_at(own, F.lit(-1))


def item_value(item: Column, key: str) -> Column:
    """The value of an attribute of that key."""
    body = F.substring(item, len(key) + 2, 1 << 30)
    closed = item.endswith(")") & ~item.endswith(":)")
    return F.when(closed, F.left(body, F.length(body) - 1)).otherwise(trimmed(body))


def normalized_path(path: Column) -> Column:
    """Slashes only, no empty or '.' parts, '..' takes the part before it away."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda t: (t != "") & (t != "."))
    step = lambda done, t: F.when(t != "..", F.concat(done, F.array(t))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
    return F.array_join(F.when(F.exists(parts, lambda t: t == ".."), F.aggregate(parts, F.array().cast(NO_STRINGS), step)).otherwise(parts), "/")


def safe_out_path(path: Column) -> Column:
    """For output: empty, '.' and '..' parts are left out; backslashes stay."""
    return F.array_join(F.filter(F.split(path, "/"), lambda t: ~t.isin("", ".", "..")), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.left(path, F.length(path) - F.length(base_name(path)) - 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """All proper ancestors that are not empty, outermost first."""
    parts = F.split(path, "/")
    places = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(places, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast(NO_STRINGS))


def is_under(path: Column, folder: Column) -> Column:
    return (folder == "") | path.startswith(F.concat(folder, F.lit("/")))


def is_under_or_equal(path: Column, folder: Column) -> Column:
    return F.when(folder == "", path != "").otherwise((path == folder) | is_under(path, folder))


def link_path(parent: Column, target: Column) -> Column:
    """Where a link points, as a normalized path; an empty target points nowhere."""
    slashed = F.replace(target, F.lit("\\"), F.lit("/"))
    return F.when(slashed == "", "").when(slashed.startswith("/"), normalized_path(slashed)).otherwise(normalized_path(F.concat(parent, F.lit("/"), slashed)))


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o777))


def wildcard(mask: str) -> str | None:
    """A shell mask as a whole-string regular expression; None where the mask is none and so filters nothing.

    '*' and '?' stay within a path part; [..] and [!..] are classes.
    """
    mask = mask.strip() or "*"
    out, i = "", 0
    while i < len(mask):
        c = mask[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            start = i + 1
            start += mask[start : start + 1] == "!"
            end = mask.find("]", start + 1)
            if end < 0 or "/" in mask[start:end]:
                return None
            negated = "^" if start > i + 1 else ""
            inside = "".join("\\" + x if x in "\\[&^]" else x for x in mask[start:end])
            out, i = out + f"[{negated}{inside}]", end
        else:
            out += c if c.isalnum() or c in "_/" else f"\\{c}"
        i += 1
    return rf"\A(?:{out})\z"
