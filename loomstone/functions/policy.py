"""Decisions about tool calls as expressions: allow, redirect, nudge, advise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default thresholds.
READ_MAX, ADVISE_MIN, READ_STREAK, NUDGE_EVERY, PARTIAL_STREAK = 300, 120, 4, 10, 3
MAINTENANCE = ("index", "edit", "rename", "note")


def decide_read(partial: Column, is_code: Column, indexed: Column, in_repo: Column, lines: Column, callable_: Column, reread: Column, most: int = READ_MAX, advise: int = ADVISE_MIN) -> Column:
    """Whole reads of long indexed code are redirected, of middling or repeated ones advised on."""
    worth = indexed & callable_ & F.lit(advise > 0) & (reread | (lines >= advise))
    return (
        F.when(partial | ~is_code, "allow")
        .when(lines <= most, F.when(worth, "advise").otherwise("allow"))
        .when(indexed, "redirect")
        .when(in_repo, "nudge")
        .otherwise("allow")
    )


def decide_grep(surgical: Column, single_file: Column, identifier: Column, indexed: Column, in_repo: Column, soft: Column) -> Column:
    """Broad searches for an identifier are redirected, restrained ones advised on."""
    return (
        F.when(surgical | ~identifier, "allow")
        .when(indexed, F.when(soft | single_file, "advise").otherwise("redirect"))
        .when(in_repo & ~single_file, "nudge")
        .otherwise("allow")
    )


def fires(count: Column, every: int) -> Column:
    """On every so manieth count; never if that is 0."""
    return (count > 0) & (count % every == 0) if every > 0 else F.lit(False)


def is_maintenance(cmd: Column) -> Column:
    return cmd.isin(*MAINTENANCE) | cmd.startswith("hook:")


def session_key(env: Column, payload: Column, ts: Column) -> Column:
    """Session named by the environment, else by the payload, else by the day."""
    named = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(named(env), named(payload), F.concat(F.lit("day-"), F.floor(ts / 86400).cast("string")))
