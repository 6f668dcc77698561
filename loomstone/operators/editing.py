"""Edits as plans: spliced texts and renames are columns; only the final write touches files, on the driver."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, word_pattern


def _joined(parts: Column, text: Column) -> Column:
    """Lines with the text's own line ends and final line end."""
    body = F.array_join(parts, "\n")
    final = (text == "") | text.endswith("\n")
    plain = F.when(final & (body != ""), F.concat(body, F.lit("\n"))).otherwise(body)
    return F.when(text.contains("\r\n"), F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)


def _code(new: Column) -> Column:
    return F.regexp_replace(F.replace(new, F.lit("\r\n"), F.lit("\n")), "\n+$", "")


def splice_lines(text: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with lines start to end replaced."""
    old = F.when(text == "", F.array().cast("array<string>")).otherwise(lines(text))
    head = F.slice(old, F.lit(1), F.greatest(start - 1, F.lit(0)))
    tail = F.slice(old, F.greatest(end, F.lit(0)) + 1, F.greatest(F.size(old) - end, F.lit(0)))
    return _joined(F.concat(head, F.array(_code(new)), tail), text)


def splice_insert(text: Column, at: Column, new: Column) -> Column:
    """The text with new lines after line ``at``."""
    old = F.when(text == "", F.array().cast("array<string>")).otherwise(lines(text))
    at = F.least(at, F.size(old))
    return _joined(F.concat(F.slice(old, F.lit(1), at), F.array(_code(new)), F.slice(old, at + 1, F.size(old) - at)), text)


def rename_plan(files: DataFrame, old: str, new: str, symbols: DataFrame | None = None) -> DataFrame:
    """(path, hits, new_text) of files that use ``old`` as an identifier; matches never overlap, so one pass replaces all.

    With ``symbols``, a new name that something already has is refused, as both would be one afterwards."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", new):
        raise ValueError(f"{new!r} is no identifier")
    if symbols is not None and (taken := collisions(symbols, new).collect()):  # a few rows for a message
        raise ValueError(f"{new!r} is already defined: " + ", ".join(f"{r.path}:{r.start_line}" for r in taken))
    pattern = word_pattern(old)
    hit = files.where(F.col("text").contains(old) & F.col("text").rlike(pattern))
    return hit.select("path", F.regexp_count("text", F.lit(pattern)).cast("long").alias("hits"), F.regexp_replace("text", pattern, new).alias("new_text"))


def collisions(symbols: DataFrame, new: str, limit: int = 5) -> DataFrame:
    """Definitions that already have the new name."""
    return symbols.where(F.col("name") == new).orderBy("path", "start_line").limit(limit)


def inside(root: str, path: str) -> str:
    """The absolute path of a file of the project; raises if it leads out of it."""
    if not path or os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"{path!r} isn't inside of the project")
    full = os.path.realpath(os.path.join(root, path))
    if not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{path!r} leads out of the project")
    return full


def write_all(root: str, plan: DataFrame, check=lambda path, text: None, most: int = 10_000) -> int:
    """Write new_text of every path of a plan, all or nothing: ``check`` may raise before anything is written.

    Plans hold the files of one edit; more than ``most`` are refused.
    """
    rows = plan.select("path", "new_text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files")
    targets = [(inside(root, r.path), r.new_text) for r in rows]
    for full, text in targets:
        check(full, text)
    done: list[tuple[str, bytes]] = []
    try:
        for full, text in targets:
            with open(full, "rb") as f:
                before = f.read()
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(full))
            with os.fdopen(handle, "wb") as f:
                f.write(text.encode())
            os.chmod(temporary, os.stat(full).st_mode)
            os.replace(temporary, full)
            done.append((full, before))
    except OSError:
        for full, before in reversed(done):
            with open(full, "wb") as f:
                f.write(before)
        raise
    return len(targets)
