"""Small languages of arguments and names: locators, ranges, patterns, project keys."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders whose projects may be forgotten once they vanish.
TEMPORARY = ("/tmp/", "/private/tmp/", "/var/folders/", "/private/var/folders/")
#: Signs that make a search text look like a pattern, and those that end a run of plain text beside them.
_PATTERN_SIGNS, _BREAKS = r"()[]|+*?^$" + "\\", ".{}"


def locator(arg: Column) -> Column:
    """struct<file,name> of "file.ext:Name", cut at the last colon; file is null for a plain name."""
    file, name = F.regexp_extract(arg, r"(?s)^(.*):[^:]*$", 1), F.regexp_extract(arg, r"([^:]*)$", 1)
    is_one = arg.contains(":") & file.contains(".") & (name != "") & ~name.contains("/")
    return F.struct(F.when(is_one, file).alias("file"), F.when(is_one, name).otherwise(arg).alias("name"))


def split_locator(arg: str) -> tuple[str | None, str]:
    """The same for one argument."""
    m = re.fullmatch(r"(?s)(?P<file>.*\..*):(?P<name>[^:/]+)", arg)
    return (m["file"], m["name"]) if m else (None, arg)


def parse_range(text: str) -> tuple[int, int]:
    """Lines of "S-E", counted from 1."""
    m = re.fullmatch(r"\s*\+?([0-9]+)\s*-\s*\+?([0-9]+)\s*", text)
    if not m or not 1 <= int(m[1]) <= int(m[2]):
        raise ValueError("a range is S-E with 1 <= S <= E, like 42-48")
    return int(m[1]), int(m[2])


def literal_of(pattern: str) -> str | None:
    """The longest plain part of what looks like a pattern, the last of equals; None for plain text."""
    if not any(c in _PATTERN_SIGNS for c in pattern):
        return None
    runs = re.split("[" + re.escape(_PATTERN_SIGNS + _BREAKS) + "]", pattern)
    return max(reversed(runs), key=lambda r: len(r.encode()))


def like_escape(text: Column) -> Column:
    """text for LIKE, its own wildcards taken literally."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def project_hash(root: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hexadecimal digits.

    The 64-bit product is kept in two halves of 32 bits, so no multiplication overflows: the prime is 2^40 + 435.
    """
    digits = F.hex(F.encode(root, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    each = F.when(F.length(digits) > 0, F.transform(at, lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    half = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        product = low * 435
        return F.struct((h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    return F.aggregate(each, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))


def is_ephemeral(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Below a folder for temporary files; ``more`` names this machine's own."""
    roots = [*TEMPORARY, *(m.rstrip("/") + "/" for m in more)]
    hit = F.lit(False)
    for r in roots:
        hit = hit | path.startswith(r)
    return hit


def is_home_or_root(path: str, home: str | None = None) -> bool:
    """A home folder or the root of a file system, which are no projects."""
    here = os.path.realpath(path)
    return here == os.path.dirname(here) or here == os.path.realpath(home or os.path.expanduser("~"))
