"""Names, lines, identifiers, costs and humanised values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z folded, everything else kept: LIKE and fuzzy search fold ASCII alone."""
    return F.translate(c, UPPER, LOWER)


def est_tokens(n_bytes: Column) -> Column:
    """Tokens that so many UTF-8 bytes cost: a quarter, rounded up."""
    return F.floor((n_bytes + 3) / 4).cast("long")


def name_tail(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def scope_parent(name: Column) -> Column:
    """What precedes the last dot; null without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(?s)(.*)\.[^.]*$", 1))


def dir_of(path: Column) -> Column:
    """What precedes the last slash; empty without one."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize_path(path: Column) -> Column:
    """Lexical: empty and "." parts go, ".." takes the part before it, never above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def lines(text: Column) -> Column:
    """Lines without their ends: a final line feed adds no empty line, a carriage return before one goes."""
    cut = F.split(text, "\n")
    whole = F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    ended = F.size(cut) - 1
    return F.transform(whole, lambda s, i: F.when(i < ended, F.regexp_replace(s, "\r$", "")).otherwise(s))


def identifiers(line: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of two or more that don't start with a digit."""
    return F.filter(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+"), 0), lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_]+$"))


def long_identifiers(line: Column, least: int) -> Column:
    """``identifiers`` of so many characters or more, by one search without a test of each: what is short is passed over, not made."""
    return F.regexp_extract_all(line, F.lit(f"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{{{max(least, 2) - 1},}}+"), 0)


def is_valid_ident(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def word_pattern(name: str) -> str:
    """Java pattern of the name between characters that can't belong to an identifier."""
    return rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"


def first_line_signature(text: Column) -> Column:
    """First line, trimmed, without an opening brace at its end, cut at 120 characters."""
    first = F.trim(F.regexp_replace(F.trim(F.substring_index(text, "\n", 1)), r"\{$", ""))
    return F.when(F.char_length(first) > 120, F.concat(F.substring(first, 1, 120), F.lit("…"))).otherwise(first)


def ago(seconds: Column) -> Column:
    """Age in words."""
    d = F.greatest(seconds, F.lit(0)).cast("long")
    unit = lambda by, name: F.concat(F.floor(d / by).cast("string"), F.lit(f"{name} ago"))
    return F.when(d < 5, F.lit("just now")).when(d < 60, unit(1, "s")).when(d < 3600, unit(60, "m")).when(d < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def human_bytes(n: Column) -> Column:
    """Size in B, KB, MB or GB; one decimal from KB on, halves to even."""
    size = lambda by, name: F.format_string(f"%.1f {name}", F.bround(n / F.lit(float(by)), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, size(1024, "KB")).when(n < 1024**3, size(1024**2, "MB")).otherwise(size(1024**3, "GB"))


def grouped(n: Column) -> Column:
    """Whole number with commas between thousands."""
    return F.format_number(n, 0)


def short_count(n: Column) -> Column:
    """Whole number in thousands (k) or millions (M) with one decimal, halves to even; smaller ones as they are."""
    size = lambda by, name: F.format_string(f"%.1f{name}", F.bround(n / F.lit(float(by)), 1))
    return F.when(F.abs(n) >= 1_000_000, size(1_000_000, "M")).when(F.abs(n) >= 1_000, size(1_000, "k")).otherwise(n.cast("string"))


def left_cut(text: Column, most: int) -> Column:
    """A cell of so many characters: short texts with blanks behind, of longer ones the end after an ellipsis."""
    if most <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.char_length(text) <= most, F.rpad(text, most, " ")).otherwise(F.concat(F.lit("…"), F.substring(text, F.char_length(text) - most + 2, F.lit(most - 1))))


def param_count(signature: Column) -> Column:
    """Parameters in the first parenthesised group; null without one, 0 if it is blank.

    Quoted parts go; what follows the first parenthesis loses its innermost groups (a placeholder stays where they
    hold anything) until none is left, so its first closing bracket ends the group and its commas part the
    parameters. An ">" that closes nothing, as of an arrow, is text.
    """
    after = F.substring(signature, F.instr(signature, "(") + 1, F.length(signature))
    tail = F.regexp_replace(after, r"""(?s)\"(?:\\.|[^\"\\])*+(?:\"|\\?$)|'(?:\\.|[^'\\])*+(?:'|\\?$)""", "")
    rounds = F.sequence(F.lit(0), F.length(tail) - F.length(F.regexp_replace(tail, r"[(\[{<]", "")))

    def without_innermost(text: Column) -> Column:
        blank = F.regexp_replace(text, r"[(\[{<][ \t]*[)\]}>]", "")
        return F.regexp_replace(blank, r"[(\[{<][^()\[\]{}<>]*[^()\[\]{}<> \t][^()\[\]{}<>]*[)\]}>]", "x")

    flat = F.aggregate(rounds, tail, lambda text, _: without_innermost(text))
    group = F.regexp_extract(flat, r"^[^)\]}]*", 0)
    commas = F.regexp_count(F.regexp_extract(group, r"^[^(\[{<]*", 0), F.lit(","))
    seen = group.rlike(r"[^(\[{< \t,]") | F.regexp_extract(group, r"[(\[{<].*", 0).contains(",")
    return F.when(F.instr(signature, "(") > 0, F.when(seen, commas + 1).otherwise(F.lit(0)).cast("int"))


def first_param_is_receiver(signature: Column) -> Column:
    """The first parameter is self or this, which a call doesn't write."""
    first = F.trim(F.regexp_extract(signature, r"\(([^,)]*)", 1))
    first = F.trim(F.regexp_replace(F.regexp_replace(first, "^&+", ""), r"^(mut )+", ""))
    return first.rlike("^(self|this)($|[: ])")
