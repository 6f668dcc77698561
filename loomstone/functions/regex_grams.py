"""What trigrams a line must hold to match a regular expression: an and/or tree over trigrams (after Cox, 2012).

The standard library reads the pattern; for each part four things are known: ``exact``, all texts that it can match (None if they are too
many), the texts that every match starts and ends with one of, and what every match needs. Joining two parts joins their ends, where new trigrams
appear. What the library can't read, and everything that may stand for other letters, needs nothing, so the answer never leaves a match out.
"""

from __future__ import annotations

import re
import warnings
from itertools import product

from .text import LOWER, UPPER

#: True (needs nothing), False (matches nothing), a trigram, or ("and" | "or", frozenset of such).
Need = bool | str | tuple
#: Texts of a set, and characters of one of them, beyond which it isn't followed.
MOST, LONGEST, CLASS = 24, 12, 12
_FOLD = str.maketrans(UPPER, LOWER)


def _and(*parts: Need) -> Need:
    flat: set = set()
    for p in parts:
        if p is False:
            return False
        flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else set() if p is True else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _or(*parts: Need) -> Need:
    flat: set = set()
    for p in parts:
        if p is True:
            return True
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else set() if p is False else {p}
    return False if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _grams(text: str) -> Need:
    return _and(*[text[k : k + 3] for k in range(len(text) - 2)])


def _any_of(texts) -> Need:
    """One of the texts is held; short ones ask for nothing."""
    return _or(*[_grams(t) for t in texts])


class _Part:
    """exact, starts, ends (sets of texts; starts and ends hold "" where nothing is known) and need."""

    def __init__(self, exact=None, starts=frozenset([""]), ends=frozenset([""]), need: Need = True):
        self.exact = exact
        self.starts, self.ends = (exact, exact) if exact is not None else (starts, ends)
        self.need = need
        if exact is not None and (len(exact) > MOST or any(len(t) > LONGEST for t in exact)):
            self.need, self.exact = _and(need, _any_of(exact)), None
        if self.exact is None:
            self.starts, self.ends = self._cut(self.starts, lambda t: t[:3]), self._cut(self.ends, lambda t: t[-3:])

    @staticmethod
    def _cut(texts, short) -> frozenset:
        cut = frozenset(map(short, texts))
        while len(cut) > MOST:
            n = max(map(len, cut)) - 1
            cut = frozenset(t[:n] if short("abcd") == "abc" else t[len(t) - n :] if len(t) > n else t for t in cut) if n > 0 else frozenset([""])
        return cut

    def whole(self) -> Need:
        return _and(self.need, _any_of(self.exact)) if self.exact is not None else self.need


_ANY = _Part()
_EMPTY = _Part(frozenset([""]))


def _join(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Part(frozenset(x + y for x in a.exact for y in b.exact), need=_and(a.need, b.need))
    need = _and(a.whole(), b.whole())
    # Trigrams across the border, where both sides are known.
    if len(a.ends) * len(b.starts) <= 4 * MOST:
        need = _and(need, _any_of({x[-2:] + y[:2] for x, y in product(a.ends, b.starts)}))
    starts = frozenset(x + y for x in a.exact for y in b.starts) if a.exact is not None and len(a.exact) * len(b.starts) <= MOST else a.starts
    ends = frozenset(x + y for x in a.ends for y in b.exact) if b.exact is not None and len(a.ends) * len(b.exact) <= MOST else b.ends
    return _Part(None, starts, ends, need)


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None and p.need is True for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return _Part(frozenset().union(*[p.exact for p in parts]))
    return _Part(None, frozenset().union(*[p.starts for p in parts]), frozenset().union(*[p.ends for p in parts]), _or(*[p.whole() for p in parts]))


def _chars(codes, ignore_case: bool) -> _Part:
    """One of some characters; folded. Those with other letters than A-Z as cases, if case is ignored, are unknown."""
    texts = set()
    for c in map(chr, codes):
        if c == "\n" or ignore_case and (ord(c) > 127 or c in "kKsSiI"):
            return _ANY
        texts.add(c.translate(_FOLD))
    return _Part(frozenset(texts))


def _of(tree, ignore_case: bool) -> _Part:
    out = _EMPTY
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            part = _chars([arg], ignore_case)
        elif op == "IN":
            codes: list[int] | None = []
            for kind, x in arg:
                kind = str(kind)
                if kind == "LITERAL":
                    codes.append(x)
                elif kind == "RANGE" and x[1] - x[0] < CLASS:
                    codes += range(x[0], x[1] + 1)
                else:
                    codes = None
                    break
            part = _chars(codes, ignore_case) if codes and len(codes) <= CLASS else _ANY
        elif op == "BRANCH":
            part = _either([_of(t, ignore_case) for t in arg[1]])
        elif op == "SUBPATTERN":
            part = _of(arg[3], ignore_case) if not arg[1] and not arg[2] else _ANY
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            one = _of(inner, ignore_case)
            if least == 0:
                part = _either([_EMPTY, one]) if most == 1 else _ANY
            else:
                part = _EMPTY
                for _ in range(min(least, 4)):
                    part = _join(part, one)
                # More copies may follow: its ends are known, but not the whole.
                if most != least or least > 4:
                    part = _Part(None, part.starts, part.ends, part.whole())
        elif op == "ATOMIC_GROUP":
            part = _of(arg, ignore_case)
        elif op == "AT":
            part = _EMPTY
        else:  # any character, all but one, and what isn't supported
            part = _ANY
        out = _join(out, part)
    return out


def required(pattern: str, regex: bool = True, ignore_case: bool = False) -> Need:
    """The trigrams, A-Z folded, that a line which matches must hold."""
    if not regex:
        if ignore_case and not pattern.isascii():
            return True
        folded = pattern.translate(_FOLD)
        return _and(*[folded[k : k + 3] for k in range(len(folded) - 2) if "\n" not in folded[k : k + 3] and not (ignore_case and set(folded[k : k + 3]) & set("ksi"))])
    # Java's own signs, of which the library knows none or others: quoting, classes in classes, properties, other escapes, flags.
    if re.search(r"\\[QEGhHRvVXZzpPNxucek0-9]|\[[^\]]*(?:\[|&&)|\(\?[a-zA-Z-]+[:)]|\{,", pattern):
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return True
    return _of(tree, ignore_case).whole()


def grams_of(need: Need) -> set[str]:
    if isinstance(need, str):
        return {need}
    return set().union(*[grams_of(p) for p in need[1]]) if isinstance(need, tuple) else set()


def holds(need: Need, text: str) -> bool:
    """Whether a text has what is needed."""
    if isinstance(need, bool):
        return need
    if isinstance(need, str):
        return need in text.translate(_FOLD)
    return (all if need[0] == "and" else any)(holds(p, text) for p in need[1])
