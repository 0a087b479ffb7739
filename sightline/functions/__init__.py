r"""Scalar derivations as Column builders; all stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Read depths in rising order, by code.
DEPTHS = ("unseen", "name", "overview", "signature", "full", "stale")
UNSEEN, NAME_ONLY, OVERVIEW, SIGNATURE, FULL_BODY, STALE = range(6)

_WHITE = r"\p{IsWhite_Space}"
_WORD = r"[\p{IsAlphabetic}\p{N}_]"


def normalize_source(text: Column) -> Column:
    """Outer white space off, each inner run of white space made one space."""
    return F.trim(F.regexp_replace(text, _WHITE + "+", " "))


def content_hash(text: Column) -> Column:
    """Hash by which two sources that differ in white space alone are equal."""
    return F.sha2(normalize_source(text), 256)


def estimate_tokens(text: Column) -> Column:
    """A quarter token per word character, rounded up word by word, and one per other visible character.

    Greedy runs of at most four word characters are just so many per word, so one pass counts both.
    """
    return F.regexp_count(text, F.lit(rf"{_WORD}{{1,4}}|[^\p{{IsAlphabetic}}\p{{N}}_\p{{IsWhite_Space}}]")).cast("long")


def strip_keywords(path: Column) -> Column:
    """Each ``/`` segment without the lower-case words that lead it (``pub fn name`` -> ``name``)."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "^([a-z]+ )+", "")), "/")


def short_path(path: Column) -> Column:
    """The last two components, trailing slashes ignored."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -2)


def under_root(path: Column, root: Column) -> Column:
    """A path below ``root`` made relative to it (the root itself: empty); any other path unchanged."""
    return F.when(path == root, F.lit("")).when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def remap(path: Column, old_root: Column, new_root: Column) -> Column:
    """A path of a worktree moved to the main root, component-wise."""
    moved = F.concat(new_root, F.substring(path, F.length(old_root) + 1, F.length(path)))
    return F.when((path == old_root) | F.startswith(path, F.concat(old_root, F.lit("/"))), moved).otherwise(path)


def truncate_command(text: Column, limit: int = 200) -> Column:
    """Long commands end in an ellipsis after the characters that start within ``limit`` bytes."""
    ascii_cut = F.concat(F.left(text, F.lit(limit)), F.lit("…"))
    n = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")), lambda a, i: F.when(a["b"] < limit, F.struct((a["b"] + F.octet_length(F.substring(text, i, F.lit(1)))).alias("b"), i.alias("k"))).otherwise(a))["k"]
    cut = F.when(F.octet_length(text) == F.length(text), ascii_cut).otherwise(F.concat(F.left(text, n), F.lit("…")))
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double, 0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole == 0, 1).otherwise(whole) * F.lit(100.0))


def depth_label(depth: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DEPTHS)), depth + 1)


def path_parts(path: Column) -> Column:
    """Components, by which paths are ordered (``a/b`` before ``a-b``)."""
    return F.split(path, "/")


def literal_filter(path: Column, prefix: str) -> Column:
    """Component-wise prefix test, on names alone: empty components and dots count on neither side; an empty prefix holds for all."""
    want = [x for x in prefix.split("/") if x]
    if not want:
        return F.lit(True)
    own = F.filter(path_parts(path), lambda x: ~x.isin("", ".", ".."))
    return F.slice(own, 1, len(want)) == F.array(*map(F.lit, want))


def regex_filter(path: Column, pattern: str) -> Column:
    """Unanchored regular expression on the ``/``-separated path; look-around and back references are refused."""
    import re

    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern}")
    re.compile(pattern)
    return F.rlike(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(pattern))


def compact_number(n: Column) -> Column:
    """1234 -> 1.2k, 1234567 -> 1.2M; the binary quotient is rounded, and only a true half to the even digit."""

    def tenth(x: Column) -> Column:
        # 2^-52 is the least step of a double from 1 on, so the fraction is a whole number of them.
        bits = ((x - F.floor(x)) * F.lit(float(1 << 52))).cast("long") * 10
        digit, rest = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1))
        up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
        tenths = F.floor(x).cast("long") * 10 + digit + up.cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.when(n >= 1_000_000, F.concat(tenth(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(tenth(n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


def percent_band(pct: Column) -> Column:
    """The band that a percentage is shown in, by its whole part."""
    whole = F.floor(pct)
    return F.when(whole <= 20, "0-20").when(whole <= 50, "21-50").when(whole <= 80, "51-80").otherwise("81-100")


def decision(pct: Column, proceed: float = 80, adequate: float = 50) -> Column:
    """What a file's full percentage allows: to go on, to change it in places, or to read it first; nothing read allows nothing."""
    return F.when(pct == 0, "unread").when(pct >= proceed, "proceed").when(pct >= adequate, "adequate").otherwise("read")


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """A double with 0 or 1 digits after the point; its exact binary value is rounded, a true half to the even digit.

    The fraction is cut into 104 bits, which hold every double from 2^-52 on whole.
    """
    a, unit = F.abs(x), F.lit(float(1 << 52))
    whole = F.floor(a)
    high = F.floor((a - whole) * unit)
    low = F.floor(((a - whole) * unit - high) * unit)
    one = F.lit(str(1 << 104)).cast("decimal(38,0)")
    bits = high.cast("decimal(17,0)") * F.lit(str(1 << 52)).cast("decimal(17,0)") + low.cast("decimal(17,0)")
    scaled = bits.cast("decimal(34,0)") * F.lit(10**digits).cast("decimal(2,0)")
    digit = F.floor((scaled - scaled % one) / one).cast("long") if digits else F.lit(0).cast("long")
    rest = (scaled % one).cast("decimal(38,0)")
    half = F.lit(str(1 << 103)).cast("decimal(38,0)")
    odd = (digit if digits else whole) % 2 == 1
    total = whole.cast("long") * 10**digits + digit + ((rest > half) | ((rest == half) & odd)).cast("long")
    text = total.cast("string") if not digits else F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))
    minus = F.when(x < 0, F.lit("-")).otherwise(F.lit("+" if signed else ""))
    return F.concat(minus, text)


def token_delta(before: Column, after: Column) -> Column:
    """By how many percent the second count differs from the first; 0 if that is none."""
    return F.when(before > 0, F.lit(100.0) * (after - before) / F.when(before > 0, before)).otherwise(F.lit(0.0))


def seconds(milliseconds: Column) -> Column:
    return milliseconds / F.lit(1000.0)


def total_lines(text: Column) -> Column:
    """Lines of a text; a line feed at the end begins no further line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + ((F.length(text) > 0) & ~F.endswith(text, F.lit("\n"))).cast("int")


def short_id(name: Column, length: int = 12) -> Column:
    return F.left(name, F.lit(length))


def name_path(parent: Column, name: Column) -> Column:
    """Names from the root down, by slashes."""
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def symbol_id(path: Column, names: Column) -> Column:
    return F.concat(path, F.lit("::"), names)


def first_bytes(text: Column, limit: int) -> Column:
    """The characters that end within ``limit`` bytes."""
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")), lambda a, i: F.struct(
        (a["b"] + F.octet_length(F.substring(text, i, F.lit(1)))).alias("b"), F.when((a["b"] + F.octet_length(F.substring(text, i, F.lit(1))) <= limit) & (i <= F.length(text)), i).otherwise(a["k"]).alias("k")))["k"]
    return F.when(F.octet_length(text) == F.length(text), F.left(text, F.lit(limit))).otherwise(F.left(text, ends))


def wrapped(text: Column, width: int, least: int = 20) -> Column:
    """The words of a text in lines of at most ``width`` bytes (a longer word has a line of its own); one empty line without words."""
    room = max(width, least)
    words = F.filter(F.split(text, _WHITE + "+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        full = (F.octet_length(acc["line"]) + 1 + F.octet_length(word)) > room
        lines = F.when((acc["line"] != "") & full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"])
        line = F.when((acc["line"] == "") | full, word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        return F.struct(lines.alias("lines"), line.alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))


def file_status(total: Column, seen: Column, full: Column) -> Column:
    """Rank by which files are listed: 0 partially, 1 all seen, 2 fully read, 3 not covered."""
    return F.when((total == 0) | (seen == 0), 3).when(full == total, 2).when(seen == total, 1).otherwise(0)
