"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base kinds, leftmost and non-overlapping for each kind: e-mail, ip, card, phone, as in ``base_spans``. The
scans are linear: e-mail looks at "@" signs and the runs before them, the others start at run starts,
where the patterns can't match later if they fail.

The field (Sarawagi and Cohen, 2004) reads regions: stretches around "@", spelled-out "at" signs, dotted quads
(blanks or brackets about their dots) and runs with seven digits or more; they reach to the start of an address's
name and to the end of its dot-joined host. Only where all of these lie inside base spans is it not run. A region is cut into tokens (letters, digits, blanks, single signs); a segment of
up to ``LONGEST`` tokens, or to the end of a longer host, gets a kind, by features of the whole span: its shape, digit count, number of
parts, Luhn and octet tests, "@" and dots and their spelled-out forms, ends and neighbours. A dynamic
programme over segment ends and the kind of the span before, with bounded segment length, chooses boundaries and kinds jointly. Weights
maximise the conditional likelihood of segmentations of up to ``regions`` regions of the corpus, chosen by a
hash of the text, whose base spans are gold; each also occurs rewritten as people disguise such data
(spelled-out signs, other separators, no plus sign). A decoded span is added if it beats the
same text outside of any span by ``margin`` and overlaps no base span. Base spans always stay.

Null and empty texts have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, release, slices

# Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = r"@|[(\[{<][ \t]?(?i:at)[ \t]?[)\]}>]|\b(?i:at)\b(?= \S+ (?i:dot) )"
#: A dot between octets, and what people write for it.
_DOT = r"(?:[ \t]{0,2}[(\[{<][ \t]?(?:(?i:dot)|\.)[ \t]?[)\]}>][ \t]{0,2}|[ \t]{0,2}\.[ \t]{0,2}|[ \t]{1,2}(?i:dot)[ \t]{1,2})"
_QUAD = rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}"
REGION = re.compile(_AT + rf"|(?<![0-9]){_QUAD}|[0-9+(](?:[ ().+/-]{{0,3}}[0-9]){{6,}}")
#: What a span of each kind must look like as a whole; the name of the group that matches is a feature.
MAIL = re.compile(r"(?P<name>[A-Za-z0-9._%+-]+)(?:(?P<sign>@)|(?P<blanks>[ \t]+@[ \t]+)|(?P<bracket>[ \t]*[(\[{<][ \t]?(?i:at)[ \t]?[)\]}>][ \t]*)|(?P<word>[ \t]+(?i:at)[ \t]+))"
                  r"(?P<host>[A-Za-z0-9-]+(?:(?:\.|[ \t]*[(\[{<][ \t]?(?:(?i:dot)|\.)[ \t]?[)\]}>][ \t]*|[ \t]+(?i:dot)[ \t]+)[A-Za-z0-9-]+)*(?:(?P<plain>\.)|(?P<boxed>[ \t]*[(\[{<][ \t]?(?:(?i:dot)|\.)[ \t]?[)\]}>][ \t]*)|(?P<spelled>[ \t]+(?i:dot)[ \t]+))[A-Za-z]{2,})")
ADDRESS = re.compile(_QUAD)
GROUPS = re.compile(r"[0-9]{4}(?:(?P<gap>[ ./-]{1,3})[0-9]{4}(?:(?P=gap)[0-9]{4}){2}(?:(?P=gap)[0-9]{1,3})?)|(?P<run>[0-9]+)")
CALL = re.compile(
    r"(?P<abroad>(?:\(\+[0-9]{1,3}\)|\+[0-9]{1,3})(?:[ ./()-]{1,3}[0-9]{1,9}){1,6})|(?P<zeros>00[1-9][0-9]{0,2}(?:[ ./()-]{1,3}[0-9]{2,9}){1,6})"
    r"|(?P<area>\([0-9]{2,5}\)[ ./-]{0,2}[0-9]{3,4}[ ./-]?[0-9]{3,5})|(?P<triple>(?:1(?P<sep>[-. ]))?[2-9][0-9]{2}(?P<mid>[-. ])[0-9]{3}(?P=mid)[0-9]{4})"
)
#: The host after a sign, its dots as they are, in brackets or spelled out.
HOST = re.compile(r"[ \t]*[A-Za-z0-9-]++(?:(?:\.|[ \t]*[(\[{<][ \t]?(?:(?i:dot)|\.)[ \t]?[)\]}>][ \t]*|[ \t]+(?i:dot)[ \t]+)[A-Za-z0-9-]++)+")
SIGN = re.compile(_AT)
TOKEN = re.compile(r"[A-Za-z_%]+|[0-9]+|\s+|.", re.S)
#: Characters around what begins a region; tokens of a segment; characters of a region that may train the field.
AROUND, LONGEST, LONGEST_SAMPLE = 40, 24, 400


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
            free = end.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Base spans of each kind."""
    if not text:
        return [[], [], [], []]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    ips = [m.span() for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


def hosts(text: str) -> list[tuple[int, int]]:
    """Signs and where the hosts after them end; each run is read once."""
    out, reach = [], 0
    for m in SIGN.finditer(text):
        if m.end() >= reach and (host := HOST.match(text, m.end())):
            reach = host.end()
            out.append((m.start(), reach))
    return out


def _regions(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Regions and the matches that they are made of."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    ends = dict(hosts(text))
    for m in REGION.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), max(m.end(), ends.get(m.start(), 0)) + AROUND)
        free = out[-1][1] if out else 0
        # A name that reaches further back.
        while a > free and text[a] in LOCAL_CHARS and text[a - 1] in LOCAL_CHARS:
            a -= 1
        if out and a <= free:
            out[-1][2].append(m.span())
            out[-1] = (out[-1][0], max(b, free), out[-1][2])
        else:
            out.append((a, b, [m.span()]))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around what may belong to a span, merged where they overlap."""
    return [(a, b) for a, b, _ in _regions(text)]


def _shape(tokens: list[str]) -> str:
    kind = lambda t: f"d{min(len(t), 6)}" if t.isdigit() else "_" if t.isspace() else t.lower() if t.lower() in ("at", "dot") else "a" if t[0].isalpha() else t
    return "".join(map(kind, tokens))


# Top domains that end a spelled-out address; those that are also common words ("it", "in", "at") don't.
TOPS = frozenset("com org net edu gov mil int info biz name io ai app dev cloud online shop site xyz eu uk us ca au nz de fr es pt nl ch se dk fi pl cz sk hu ro bg gr ie ru ua tr il ae sa za ng ke br mx ar cl co pe jp kr cn tw hk sg th vn ph id pk bd".split())
#: The beginning of a bank account, of which the text may be the rest.
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[0-9]{4})*[ ]?$")


def _name(found: re.Match) -> str:
    return "".join(sorted(k for k, v in found.groupdict().items() if v is not None))


def forms(text: str, before: str, after: str) -> list[str | None]:
    """How a text between two others looks as a span of each kind; None where it can't be one.

    Octets are joined by dots or what stands for them; digits of a card are one run or groups of four with one
    separator; a phone number has a prefix, an area in brackets or the form 3-3-4. Numbers that go on
    beyond the text, as those of dates, times, versions, identifiers and bank accounts do, are none of these."""
    out: list[str | None] = [None] * len(KINDS)
    # A letter, digit or sign that belongs to the number on either side, or another number just before or after it.
    cut = re.search(r"[A-Za-z0-9_@:#=/]$|[0-9][.,-]$", before) or re.match(r"[A-Za-z0-9_@]|[.,:/-][0-9]", after) or ACCOUNT.search(before)
    digits = re.sub(r"[^0-9]", "", text)
    if (m := MAIL.fullmatch(text)) and not re.search(r"[A-Za-z0-9_.%+-]$", before) and not re.match(r"[A-Za-z0-9_-]|[ \t]+(?i:dot)[ \t]+[A-Za-z]|[ \t]?[(\[{<][ \t]?(?i:dot)", after):
        out[0] = _name(m) if not (m["word"] and m["spelled"]) or re.split(r"[^A-Za-z]", text)[-1].lower() in TOPS else None
    if cut:
        return out
    if ADDRESS.fullmatch(text) and all(map(octet, re.findall("[0-9]+", text))) and not re.search(rf"[0-9]{_DOT}$", before) and not re.match(rf"{_DOT}[0-9]", after):
        out[1] = "bracket" if re.search(r"[\])}>]", text) else "word" if re.search("[a-zA-Z]", text) else "dot"
    if 16 <= len(digits) <= 19 and luhn(digits) and (m := GROUPS.fullmatch(text)):
        out[2] = _name(m)
    if 8 <= len(digits) <= 15 and (m := CALL.fullmatch(text)):
        beside = re.search(r"[0-9][ \t]{1,2}$", before) or re.match(r"[ \t]{1,2}[0-9]", after)
        if (not beside or m["area"] or m["abroad"]) and (not m["zeros"] or len(digits) >= 10):
            out[3] = _name(m)
    return out


def span_features(tokens: list[str], i: int, j: int) -> tuple[list[str], tuple[bool, ...]] | None:
    """Features of the whole segment tokens[i:j] and which kinds it may be; None if it can't be a span."""
    part = tokens[i:j]
    if part[0].isspace() or part[-1].isspace() or not (part[-1][-1].isalnum()) or not (part[0][0].isalnum() or part[0][0] in "+(_%.-"):
        return None
    text = "".join(part)
    digits = sum(len(t) for t in part if t.isdigit())
    low = [t.lower() for t in part]
    at, dot = ("@" in low) + 2 * ("at" in low), ("." in low) + 2 * ("dot" in low)
    if digits < 7 and not at and not (digits >= 4 and (text.count(".") == 3 or low.count("dot") == 3)):
        return None
    if at and not dot:
        return None
    found = forms(text, "".join(tokens[max(0, i - 8) : i]), "".join(tokens[j : j + 8]))
    may = tuple(f is not None for f in found)
    if not any(may):
        return None
    gaps = sum(t.isspace() for t in part)
    edge = lambda t: "" if t is None else "d" if t.isdigit() else "a" if t[0].isalnum() else "_" if t.isspace() else t
    before, after = tokens[i - 1] if i else None, tokens[j] if j < len(tokens) else None
    numbers = sum(t.isdigit() for t in part)
    out = [f"digits{min(digits, 20)}", f"numbers{min(numbers, 8)}", f"at{at}", f"dot{dot}", f"gaps{min(gaps, 6)}", f"before{edge(before)}", f"after{edge(after)}", f"first{edge(part[0])}", f"last{edge(part[-1])}", f"ends{edge(before) in 'da'}{edge(after) in 'da'}"]
    out += [f"form{k}{f}" for k, f in enumerate(found) if f is not None]
    if at:
        out += ["named" if re.match(r"[A-Za-z]+[0-9._%+-]", text) else "word"]
    if len(part) <= 12:
        out.append("shape" + _shape(part))
    return out, may


class Field:
    """Weights by (kind, feature), hashed into a fixed table, and by (kind of the span before in the region, kind).

    A span's score is the sum of its features' weights and of the weight of its following the span before it; the last
    row of ``after`` is for a region's first span. So a region's spans are chosen together.
    """

    SLOTS = 1 << 14

    def __init__(self, weights: np.ndarray | None = None, after: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), self.SLOTS)) if weights is None else weights
        self.after = np.zeros((len(KINDS) + 1, len(KINDS))) if after is None else after

    @staticmethod
    def slots(features: list[str]) -> np.ndarray:
        return np.array([zlib.crc32(f.encode()) % Field.SLOTS for f in features] + [0], np.int64)

    @staticmethod
    def candidates(tokens: list[str]) -> list[tuple[int, int, np.ndarray, tuple[bool, ...]]]:
        ends = [0]
        for t in tokens:
            ends.append(ends[-1] + len(t))
        # Hosts that segments of bounded length may not reach: (token of the sign, token after the host).
        long = [(bisect_right(ends, a) - 1, bisect_left(ends, b)) for a, b in hosts("".join(tokens))]
        out, first = [], 0
        for i in range(len(tokens)):
            last = min(len(tokens), i + LONGEST)
            while first < len(long) and long[first][0] <= i:
                first += 1
            sign, end = long[first] if first < len(long) else (len(tokens), 0)
            far = [end] if sign < last < end else []
            for j in [*range(i + 1, last + 1), *far]:
                if f := span_features(tokens, i, j):
                    out.append((i, j, Field.slots(f[0] + ([f"host{(j > end) - (j < end)}"] if sign < j else [])), f[1]))
        return out

    def scores(self, found) -> np.ndarray:
        """Scores of the candidates by kind; -30 for kinds that a candidate can't be."""
        sums = np.array([self.w[:, s].sum(axis=1) for _, _, s, _ in found]).reshape(-1, len(KINDS))
        return np.where(np.array([may for *_, may in found]).reshape(-1, len(KINDS)), sums, -30.0)

    def decode(self, tokens: list[str], margin: float) -> list[tuple[int, int, int]]:
        """Best segmentation: (start, end, kind) of its spans, each of which costs the margin."""
        found = self.candidates(tokens)
        if not found:
            return []
        scores, after = (self.scores(found) - margin).tolist(), self.after.tolist()
        into: dict[int, list[int]] = {}
        for k, (_, j, *_) in enumerate(found):
            into.setdefault(j, []).append(k)
        none, low = len(KINDS), float("-inf")
        # By end and kind of the last span: the best score, and the candidate and the kind before it that give it.
        best = [[low] * none + [0.0]]
        back: list[list[tuple[int, int] | None]] = [[None] * (none + 1)]
        for j in range(1, len(tokens) + 1):
            row, ways = best[-1][:], [None] * (none + 1)
            for k in into.get(j, ()):
                before = best[found[k][0]]
                for kind, s in enumerate(scores[k]):
                    if found[k][3][kind]:
                        v, p = max((before[p] + after[p][kind], p) for p in range(none + 1))
                        if v + s > row[kind]:
                            row[kind], ways[kind] = v + s, (k, p)
            best.append(row)
            back.append(ways)
        out, j = [], len(tokens)
        state = max(range(none + 1), key=lambda q: (best[j][q], q))
        while j > 0:
            if (way := back[j][state]) is None:
                j -= 1
            else:
                out.append((found[way[0]][0], j, state))
                j, state = found[way[0]][0], way[1]
        return out[::-1]

    def sums(self, n: int, found, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the sums over all segmentations ahead of and behind each place, by the kind of the last span."""
        none = len(KINDS)
        ahead, behind = np.full((n + 1, none + 1), -np.inf), np.zeros((n + 1, none + 1))
        ahead[0, none] = 0.0
        into: dict[int, list[int]] = {}
        out: dict[int, list[int]] = {}
        for k, (i, j, *_) in enumerate(found):
            into.setdefault(j, []).append(k)
            out.setdefault(i, []).append(k)
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            for k in into.get(j, ()):
                ahead[j, :none] = np.logaddexp(ahead[j, :none], np.logaddexp.reduce(ahead[found[k][0]][:, None] + self.after, axis=0) + s[k])
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1]
            for k in out.get(i, ()):
                behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(self.after + (s[k] + behind[found[k][1], :none])[None], axis=1))
        return ahead, behind

    def fit(self, examples: list[tuple[list[str], set[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.5, shrink: float = 1e-3) -> "Field":
        """AdaGrad on the conditional log-likelihood. Gold spans that aren't candidates (those that begin or end with a sign other
        than "+" and brackets) have no part in it: their tokens count as outside."""
        prepared = [(len(t), c, [[(i, j, k) in gold for k in range(len(KINDS))] for i, j, *_ in c]) for t, gold in examples if (c := self.candidates(t))]
        seen, seen_after, none = np.full_like(self.w, 1e-2), np.full_like(self.after, 1e-2), len(KINDS)
        for _ in range(rounds):
            for n, found, gold in prepared:
                s = np.clip(self.scores(found), -30, 30)
                ahead, behind = self.sums(n, found, s)
                z = np.logaddexp.reduce(ahead[n])
                g_after, last = np.zeros_like(self.after), none
                for (i, *_), hit in sorted(zip(found, gold), key=lambda x: x[0][0]):
                    if any(hit):
                        kind = hit.index(True)
                        g_after[last, kind] += 1
                        last = kind
                for k, (i, j, slots, _) in enumerate(found):
                    chance = np.exp(ahead[i][:, None] + self.after + (s[k] + behind[j, :none])[None] - z)
                    g_after -= chance
                    g = np.array(gold[k], float) - chance.sum(axis=0)
                    if abs(g).max() < 1e-4:
                        continue
                    g = g[:, None] - shrink * self.w[:, slots]
                    seen[:, slots] += g * g
                    self.w[:, slots] += rate * g / np.sqrt(seen[:, slots])
                # Few numbers that all regions share: held closer to zero, so that a span's own features lead.
                g_after -= 0.2 * self.after
                seen_after += g_after * g_after
                self.after += 0.1 * rate * g_after / np.sqrt(seen_after)
        return self


def _disguises(kind: int, span: str) -> list[str]:
    """A span as people rewrite it."""
    if kind == 0:
        name, _, host = span.partition("@")
        short, last = re.split(r"[0-9._%+-]", name)[0] or "office", host.split(".", host.count(".") - 1)[-1]
        return [out for n, h in ((name, host), (short, last), (short + "27", host)) for out in (f"{n} [at] {h.replace('.', ' [dot] ')}", f"{n} (at) {h.replace('.', ' (dot) ')}", f"{n} at {h.replace('.', ' dot ')}", f"{n} @ {h}", f"{n}(at){h}", f"{n}[at]{h.replace('.', '[dot]')}")]
    if kind == 1:
        return [span.replace(".", d) for d in (" . ", "[.]", "(dot)", " dot ")]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        groups = re.findall(r".{1,4}", digits)
        return [d.join(groups) for d in (".", "  ", "/", " - ")]
    tail = digits[-10:]
    if len(tail) < 10:
        return []
    head, one, two, last = digits[:-10].lstrip("0")[:3] or "1", f"{2 + int(tail[0]) % 8}{tail[1:3]}", tail[3:6], tail[6:]
    return [f"({one}) {two}-{last}", f"({one}) {two} {last}", f"00{head} {one} {two} {last}", f"00{head}-{one}-{two}{last}", f"(+{head}) {one} {two}{last}", f"+{head}/{one}/{two}{last}", *(d.join((one, two, last)) for d in "-. ")]


def _lookalikes(kind: int, span: str) -> list[str]:
    """Texts made of a span's characters that are no personal data, though they have its digits or signs."""
    digits = (re.sub(r"[^0-9]", "", span) + "20150317093045127")[:17]
    if kind == 0:
        name, _, host = span.partition("@")
        return [f"@{name} {host}", f"{name} at the {host.replace('.', ' ')}"]
    date = f"20{digits[:2]}-0{1 + int(digits[2]) % 9}-1{digits[3]}"
    return [f"{date} 1{digits[4]}:2{digits[5]}:3{digits[6]}", f"DE{digits[:2]} {digits[2:6]} {digits[6:10]} {digits[10:14]} {digits[14:16]}", f"978-{digits[0]}-{digits[1:5]}-{digits[5:9]}-{digits[9]}", f"{digits[:3]} {digits[3:6]} {digits[6:10]} {digits[10:13]}"]


def _version(region: str, spans: list[tuple[int, int, int]], changed: dict[int, str], lost: int) -> tuple[list[str], set[tuple[int, int, int]]]:
    """Tokens and gold spans of a region in which some spans are rewritten, one of them to what is no span."""
    tokens: list[str] = []
    gold, at = set(), 0
    for n, (a, b, k) in enumerate(spans):
        tokens += TOKEN.findall(region[at:a])
        part = TOKEN.findall(changed.get(n, region[a:b]))
        if n != lost:
            gold.add((len(tokens), len(tokens) + len(part), k))
        tokens += part
        at = b
    return tokens + TOKEN.findall(region[at:]), gold


def examples(region: str) -> list[tuple[tuple[int, int], tuple[list[str], set[tuple[int, int, int]]]]]:
    """Versions of a region, each with a key that says what was done: as it is with its base spans as gold, and around each span with
    the span rewritten, or replaced by what only looks like one."""
    spans = sorted((a, b, k) for k, found in enumerate(base_spans(region)) for a, b in found)
    apart, free = [], 0
    for a, b, k in spans:
        if a >= free:
            apart.append((a, b, k))
            free = b
    out = [((-1, 0), _version(region, apart, {}, -1))]
    for n, (a, b, k) in enumerate(apart):
        lo = max([0, a - AROUND, *(y for _, y, _ in apart[:n] if y > a - AROUND)])
        hi = min([len(region), b + AROUND, *(x for x, _, _ in apart[n + 1 :] if x < b + AROUND)])
        text, span = region[lo:hi], (a - lo, b - lo, k)
        out += [((k, v), _version(text, [span], {0: d}, -1)) for v, d in enumerate(_disguises(k, region[a:b]))]
        out += [((k, -1 - v), _version(text, [span], {0: d}, 0)) for v, d in enumerate(_lookalikes(k, region[a:b]))]
    return out


def _region_batches(batches):
    for batch in batches:
        # A region as long as that of a list of thousands of numbers would train the field on one document's style.
        found = {text[a:b] for text in batch["text"] if isinstance(text, str) for a, b in regions(text) if b - a <= LONGEST_SAMPLE}
        rows = [(r, hashlib.md5(r.encode("utf-8", "surrogatepass")).hexdigest(), next((k for k, x in enumerate(base_spans(r)) if x), -1)) for r in found]
        # Rows as tuples: an empty frame made of empty lists would have columns of floats.
        yield pd.DataFrame(rows, columns=["region", "order", "kind"])


def train(docs: DataFrame, sample: int = 80, versions: int = 2500) -> Field:
    """A field fitted to at most ``sample`` regions of the corpus, of up to ``LONGEST_SAMPLE`` characters, for each kind that they hold first (or
    none), the first by a hash of their texts, and to at most so many of their versions, taken in turn from each way of rewriting."""
    rows = map_slices(docs.select(F.col("text").cast("string").alias("text")), _region_batches, "region string, order string, kind int")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("order", "region"))
    chosen = [r[0] for r in rows.withColumn("rank", rank).where(F.col("rank") <= sample).orderBy("order", "region").collect()]
    ways: dict[tuple[int, int], list] = {}
    for region in dict.fromkeys(chosen):
        for way, version in examples(region):
            ways.setdefault(way, []).append(version)
    made = [ways[w] for w in sorted(ways)]
    in_turn = [e[k] for k in range(max(map(len, made), default=0)) for e in made if k < len(e)]
    return Field().fit(in_turn[:versions])


def all_spans(text: str, field: Field, margin: float) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and base spans with those that the field adds, by kind."""
    base = base_spans(text)
    every = [list(x) for x in base]
    flat = sorted(x for found in base for x in found)
    starts, reach = [x for x, _ in flat], [0, *accumulate((y for _, y in flat), max)]
    for a, b, matches in _regions(text) if text else ():
        taken = [(x, y) for found in base for x, y in found if x < b and y > a]
        if any(reach[bisect_right(starts, p)] < q for p, q in matches):  # not all inside base spans
            tokens = TOKEN.findall(text[a:b])
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]) + a
            for i, j, kind in field.decode(tokens, margin):
                x, y = int(ends[i]), int(ends[j])
                if all(y <= p or q <= x for p, q in taken):
                    every[kind].append((x, y))
    return base, [sorted(x) for x in every]


#: A value that is assigned to a name of a credential. Not a kind of personal data, so it is counted and masked apart.
SECRET = re.compile(r"\b(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?P<value>[A-Za-z0-9+/_=-]{16,})")


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span("value") for m in SECRET.finditer(text)]


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans) for a, b in found)


def _find(field: Field, margin: float):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = all_spans(text if isinstance(text, str) else "", field, margin)
                hidden = len(secrets(text)) if isinstance(text, str) else 0
                rows.append((*map(len, base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, every)) + hidden, hidden))
            columns = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_private", "n_secret"]
            found = pd.DataFrame(rows, columns=columns)
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    return run


def find(docs: DataFrame, field: Field | None = None, margin: float = 2.0) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_private, n_secret): counts and digest of base spans,
    all spans, and how many of these and of secrets there are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_private long, n_secret long"
    return map_slices(rows, _find(field or train(docs), margin), shape)


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with every span, and every secret, replaced by its kind in brackets; overlapping ones become one."""
    out, at = [], 0
    names = [*KINDS, "secret"]
    for a, b, k in sorted((a, b, k) for k, found in enumerate([*spans, secrets(text)]) for a, b in found):
        if a >= at:
            out += [text[at:a], f"[{names[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _mask(field: Field, margin: float, text_at: int, chars_at: int):
    def run(batches):
        try:
            for batch in batches:
                for part in slices(batch):
                    old = part.column(text_at)
                    texts = [masked(t, all_spans(t, field, margin)[1]) if t is not None else None for t in old.to_pylist()]
                    part = part.set_column(text_at, part.schema.field(text_at), pa.array(texts, old.type))
                    if chars_at >= 0:
                        counts = part.column(chars_at)
                        new = [len(t) if t is not None else n for t, n in zip(texts, counts.to_pylist())]
                        part = part.set_column(chars_at, part.schema.field(chars_at), pa.array(new, counts.type))
                    yield part
        finally:
            release()

    return run


def mask(docs: DataFrame, field: Field | None = None, margin: float = 2.0) -> DataFrame:
    """docs with personal data masked in text, n_chars counted anew; other columns as they are."""
    names = docs.columns
    return docs.mapInArrow(_mask(field or train(docs), margin, names.index("text"), names.index("n_chars") if "n_chars" in names else -1), docs.schema)
