"""Reply-ordered conversations by linking quotations to the messages that they quote.

A message's lines have a quote level, the number of ">" before them. Lines of one level that follow each
other, cut at empty lines, make a passage; it is normalised (markers removed, lower case, white space
joined) and hashed. Own passages (level 0) keep the message's text; lines that only introduce a quotation
("... wrote:") are dropped with it. A passage is also hashed in pieces, its lines and its sentences, cut at "[...]",
so that trimmed or rewrapped quotations and paragraphs quoted as one are found. Each piece of a quoted passage of
level 1 and more stands for the latest earlier message of its conversation that holds it as its own; a passage
links to the message that most of its words stand for, the latest of equals. A message replies to the latest
message that its outermost quotations (level 1) link to, else to the latest that any of them does; without a link
it starts a thread of its own.

Threads are ordered by their first turns, messages of a thread below what they reply to, replies to one message
by turn. ``place`` numbers a conversation's messages in that order. It comes from an Euler tour of the replies,
ranked by pointer doubling: O(log n) equi-joins of rows of fixed size, however deep a thread is.

Nothing is compared in pairs. What is looked up along a conversation (the latest earlier holder, the next reply to a
message, the messages before a thread) is looked up within blocks of ``BLOCK`` turns and then among the blocks,
so a conversation, a message or a passage of very many rows isn't one task's work.

Null texts count as empty. Rows with equal (conv_id, turn) are both kept and have the same place. Rows with a null
conv_id or turn link with nothing and have no place.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import map_slices

PREFIX = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
SHORTEST, BLOCK = 3, 1024
CUT = re.compile(r"\[ ?(?:\.{3}|…) ?\]|…")
SENTENCE = re.compile(r"(?<=[.!?;:])\s")
INTRO = re.compile(r"^.*\b(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$", re.I)


def passages(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """Own text without quotations, and all passages as (level, lines)."""
    found: list[tuple[int, list[str]]] = []
    own: list[str] = []
    lines = text.split("\n")
    quoted_next = [False] * (len(lines) + 1)
    for k in range(len(lines) - 1, -1, -1):
        quoted_next[k] = bool(PREFIX.match(lines[k])) or (not lines[k].strip() and quoted_next[k + 1])
    fresh = True
    for k, line in enumerate(lines):
        m = PREFIX.match(line)
        level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not m and INTRO.match(line) and quoted_next[k + 1]:
            fresh = True
            continue
        if not m:
            own.append(line)
        if not body.strip():
            fresh = True
        elif fresh or found[-1][0] != level:
            found.append((level, [body]))
            fresh = False
        else:
            found[-1][1].append(body)
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return kept if any(level for level, _ in found) else text, found


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def pieces(lines: list[str]) -> dict[int, int]:
    """Hash and words of a passage as a whole, and of its lines and sentences of ``SHORTEST`` words or more."""
    whole = normal(" ".join(lines))
    parts = {normal(x) for line in lines for x in CUT.split(line)} | {x.strip() for y in CUT.split(whole) for x in SENTENCE.split(y)}
    out = {digest(x): n for x in parts if (n := len(x.split())) >= SHORTEST}
    # The mark keeps it apart from pieces: a whole paragraph is held by more than its line is.
    return out | {digest("\0" + whole): len(whole.split())}


def _parse(batches):
    for batch in batches:
        rows = []
        for text in batch["text"]:
            own, found = passages(text if isinstance(text, str) else "")
            rows.append((own, [{"level": level, "hash": hashlib.md5(normal(" ".join(b)).encode("utf-8", "surrogatepass")).hexdigest(), "pieces": [{"piece": p, "words": n} for p, n in pieces(b).items()]} for level, b in found]))
        yield batch.drop(columns="text").assign(text=[r[0] for r in rows], passages=[r[1] for r in rows])


SHAPE = "conv_id long, turn long, role string, text string, passages array<struct<level:int,hash:string,pieces:array<struct<piece:long,words:int>>>>"


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("turn") / BLOCK))


def latest_before(asked: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """asked (key, turn, ...) with ``of``: the greatest turn of held (key, turn) below its own; rows without one go."""
    rows = _in_blocks(asked.select(*key, "turn", F.lit(True).alias("asks")).distinct().unionByName(held.select(*key, "turn", F.lit(False).alias("asks")).distinct()))
    own = F.when(~F.col("asks"), F.col("turn"))
    w = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(own).over(w)).where("asks")
    blocks = rows.groupBy(*key, "block").agg(F.max(own).alias("top"))
    far = blocks.withColumn("far", F.max("top").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    found = near.join(far, [*key, "block"]).withColumn("of", F.coalesce("near", "far")).where("of is not null").select(*key, "turn", "of")
    return asked.join(found, [*key, "turn"])


def next_turn(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, turn) with ``next``: the next greater turn of the same key, or null."""
    rows = _in_blocks(rows)
    near = rows.withColumn("near", F.lead("turn").over(Window.partitionBy(*key, "block").orderBy("turn")))
    firsts = rows.groupBy(*key, "block").agg(F.min("turn").alias("first"))
    firsts = firsts.withColumn("far", F.lead("first").over(Window.partitionBy(*key).orderBy("block"))).drop("first")
    return near.join(firsts, [*key, "block"]).select(*key, "turn", F.coalesce("near", "far").alias("next"))


def threads(links: DataFrame, step: Steps) -> DataFrame:
    """(conv_id, turn, root, rank, size) of the messages that links (conv_id, turn, reply_to) connect.

    The tour enters (down) and leaves (up) every message; its arcs point at the arc after them. Doubling adds up the
    arcs of entering from each arc to the end of its thread's tour.
    """
    kids = step(next_turn(links.select("conv_id", F.col("reply_to").alias("parent"), "turn"), ["conv_id", "parent"]), "replies")
    nodes = kids.select("conv_id", "turn").unionByName(kids.select("conv_id", F.col("parent").alias("turn"))).distinct()
    first = kids.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("first"))
    tree = nodes.join(first, ["conv_id", "turn"], "left").join(kids, ["conv_id", "turn"], "left")
    arc = lambda turn, up, to, to_up: F.struct(F.col("turn").alias("turn"), F.lit(up).alias("up"), to.alias("to"), to_up.alias("to_up"), F.lit(0 if up else 1).alias("n"), F.col("turn").alias("end"))
    down = arc("turn", False, F.coalesce("first", "turn"), F.col("first").isNull())
    # After the last reply the tour goes back up to what it replied to; after a root it ends.
    up = arc("turn", True, F.coalesce("next", "parent"), F.col("next").isNull())
    arcs = step(tree.select("conv_id", F.explode(F.array(down, up)).alias("a")).select("conv_id", "a.*"), "arcs")
    while not arcs.where("to is not null").isEmpty():
        ahead = arcs.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("u"), F.col("to").alias("to2"), F.col("to_up").alias("to_up2"), F.col("n").alias("n2"), F.col("end").alias("end2"))
        joined = arcs.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("t")) & (F.col("to_up") == F.col("u")), "left")
        moved = F.col("t").isNotNull()
        pick = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old)
        old, arcs = arcs, step(joined.select("conv_id", "turn", "up", pick("to2", "to"), pick("to_up2", "to_up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), pick("end2", "end")), "arcs")
        step.drop(old)
    entered = arcs.where("not up").select("conv_id", "turn", F.col("end").alias("root"), F.col("n"))
    sizes = entered.where("turn = root").select("conv_id", "root", F.col("n").alias("size"))
    return entered.join(sizes, ["conv_id", "root"]).select("conv_id", "turn", "root", (F.col("size") - F.col("n")).cast("long").alias("rank"), F.col("size").cast("long").alias("size"))


def places(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv_id, turn, place) of the different messages (conv_id, turn); linked as from ``threads``."""
    rows = messages.join(linked, ["conv_id", "turn"], "left")
    rows = rows.select("conv_id", "turn", F.coalesce("root", "turn").alias("root"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("size", F.lit(1)).alias("size"))
    roots = rows.where("turn = root").select("conv_id", "turn", "size", F.floor(F.col("turn") / BLOCK).alias("block"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = roots.groupBy("conv_id", "block").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = roots.withColumn("near", within).join(blocks.withColumn("far", before).drop("n"), ["conv_id", "block"])
    return rows.join(starts.select("conv_id", F.col("turn").alias("root"), (F.col("near") + F.col("far")).alias("start")), ["conv_id", "root"]).select("conv_id", "turn", (F.col("start") + F.col("rank")).cast("long").alias("place"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, quote_levels, n_quotes, n_linked, place) for each row of messages."""
    step = Steps(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = step(map_slices(rows, _parse, SHAPE), "messages")
    each = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", F.col("p.level").alias("level"), F.col("p.hash").alias("hash"), F.explode("p.pieces").alias("x"))
    each = each.where("conv_id is not null and turn is not null").select("conv_id", "turn", "level", "hash", F.col("x.piece").alias("piece"), F.col("x.words").alias("words"))
    quotes = step(each.where("level > 0").groupBy("conv_id", "turn", "level", "hash", "piece").agg(F.max("words").alias("words")), "quotes")
    # Own passages matter only where a quotation has the piece.
    own = each.where("level = 0").select("conv_id", "piece", "turn").join(quotes.select("conv_id", "piece").distinct(), ["conv_id", "piece"], "left_semi")
    hits = latest_before(quotes, own, ["conv_id", "piece"])
    held = hits.groupBy("conv_id", "turn", "level", "hash", "of").agg(F.sum("words").alias("words"))
    hits = held.groupBy("conv_id", "turn", "level", "hash").agg(F.max(F.struct("words", "of"))["of"].alias("of"))
    links = hits.groupBy("conv_id", "turn").agg(F.coalesce(F.max(F.when(F.col("level") == 1, F.col("of"))), F.max("of")).alias("reply_to"), F.count("*").alias("n_linked"))
    links = step(links, "links")
    tree = step(threads(links, step), "threads")
    known = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    place = step(places(known, tree).join(links, ["conv_id", "turn"], "left"), "places")
    step.drop_all_but(parsed, place)
    out = parsed.join(place, ["conv_id", "turn"], "left")
    levels = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    quoted = F.size(F.array_distinct(F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"], p["hash"]))))
    return out.select("conv_id", "turn", "role", "text", "reply_to", levels.cast("int").alias("quote_levels"), quoted.cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "place")


def chat_lines(linked: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """linked with a column ``chat``: the message in chat format. Written sorted by (conv_id, place) these make the conversations."""
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{text}")
    return linked.withColumn("chat", F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(after)))


def conversations(linked: DataFrame, at_once: int = 1024) -> DataFrame:
    """(conv_id, part, n_messages, chat): each conversation in reply order, in parts of ``at_once`` places.

    Parts bound what one task gathers; sorted by (conv_id, part) and joined they are the whole conversation. Rows with a
    null conv_id or turn have no place in one; each makes a row of its own, with a null part.
    """
    every = chat_lines(linked)
    rows, loose = every.where("place is not null"), every.where("place is null")
    grouped = rows.groupBy("conv_id", F.floor(F.col("place") / at_once).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "chat"))).alias("m"))
    built = grouped.select("conv_id", "part", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["chat"]), "").alias("chat"))
    return built.unionByName(loose.select("conv_id", F.lit(None).cast("long").alias("part"), F.lit(1).cast("long").alias("n_messages"), "chat"))
