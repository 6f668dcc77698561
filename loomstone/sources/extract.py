"""Symbols and identifiers of source files, in one Arrow pass over each file.

Python is parsed by the standard library (exact). Other languages are read by a masked scan: comments and
strings are blanked with their lengths kept, declarations are found by patterns of the language, and their
extent by matching braces, ``end`` words, indentation or the next heading. Files of other languages
have identifiers but no symbols. Each file's rows say in ``exact`` which of the two it was.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[A-Za-z0-9_]+")
KEYWORDS = frozenset("if for while switch catch return new else do try with function and or not in is as await yield throw typeof sizeof match loop elif except assert del lambda print".split())

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_HASH = r"#[^\n]*"
MASKS = {
    "slash": re.compile(rf"(?s:{_C_LIKE})|{_STRINGS}|`(?:\\.|[^`\\])*`", re.S),
    # An apostrophe before a lifetime opens no string.
    "rust": re.compile(rf"(?s:{_C_LIKE})|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
    "hash": re.compile(rf"{_HASH}|{_STRINGS}"),
    "dash": re.compile(rf"--[^\n]*|(?s:/\*.*?(?:\*/|\Z))|{_STRINGS}"),
    "lua": re.compile(rf"--\[\[(?s:.*?)(?:\]\]|\Z)|--[^\n]*|{_STRINGS}"),
    "none": None,
}
_MOD = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|unsafe|const|export|default|virtual|override|sealed|partial|inline|extern|open|data|suspend|native|synchronized|readonly|declare|mutating|fileprivate|class|case|implicit|lazy)\s+)*"
_BODY = r"[^;{}]*\{"
# Patterns of declarations: kind, pattern with the group "n" for the name, whether a nested symbol takes it as parent.
RULES = {
    "rust": ("rust", "brace", [("fn", rf"^[ \t]*{_MOD}(?:extern\s+)?fn\s+(?P<n>\w+)", True), ("struct", rf"^[ \t]*{_MOD}struct\s+(?P<n>\w+)", False), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<n>\w+)", False), ("trait", rf"^[ \t]*{_MOD}trait\s+(?P<n>\w+)", True), ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, &']+\s+for\s+)?(?P<n>\w+)", True), ("mod", rf"^[ \t]*{_MOD}mod\s+(?P<n>\w+)", True), ("static", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<n>\w+)", False), ("const", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<n>[A-Z_]\w*)\s*:", False), ("type", rf"^[ \t]*{_MOD}type\s+(?P<n>\w+)", False), ("macro", r"^[ \t]*macro_rules!\s*(?P<n>\w+)", False)]),
    "javascript": ("slash", "brace", [("fn*", rf"^[ \t]*{_MOD}function\s*\*\s*(?P<n>[\w$]+)", True), ("fn", rf"^[ \t]*{_MOD}function\s+(?P<n>[\w$]+)", True), ("class", rf"^[ \t]*{_MOD}class\s+(?P<n>[\w$]+)", True), ("interface", rf"^[ \t]*{_MOD}interface\s+(?P<n>[\w$]+)", True), ("type", rf"^[ \t]*{_MOD}type\s+(?P<n>[\w$]+)\s*(?:<[^=]*>)?\s*=", False), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<n>[\w$]+)", False), ("fn", rf"^[ \t]*{_MOD}(?:const|let|var)\s+(?P<n>[\w$]+)[^=\n;]*=\s*(?:async\s*)?(?:function\b|\([^()]*\)[^=\n]*=>|[\w$]+\s*=>)", True), ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract)\s+)*\*?(?P<n>[#\w$]+)\s*(?:<[^>(]*>)?\([^;{}]*\)[^;{}=]*\{", True), ("method", r"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*(?P<n>[#\w$]+)(?:\s*:[^=\n]*)?\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)[^=\n]*=>|[\w$]+\s*=>)", True)]),
    "go": ("slash", "brace", [("method", r"^func\s+\([^)]*\)\s*(?P<n>\w+)", False), ("fn", r"^func\s+(?P<n>\w+)", False), ("type", r"^type\s+(?P<n>\w+)", False), ("const", r"^const\s+(?P<n>\w+)", False)]),
    "java": ("slash", "brace", [("class", rf"^[ \t]*{_MOD}class\s+(?P<n>\w+)", True), ("interface", rf"^[ \t]*{_MOD}interface\s+(?P<n>\w+)", True), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<n>\w+)", True), ("record", rf"^[ \t]*{_MOD}record\s+(?P<n>\w+)", True), ("method", rf"^[ \t]*{_MOD}(?:<[^>]*>\s*)?[\w.<>\[\],?]+\s+(?P<n>\w+)\s*\([^;{{}}]*\)[^;{{}}=]*[{{;]", False), ("ctor", rf"^[ \t]+{_MOD}(?P<n>[A-Z]\w*)\s*\([^;{{}}]*\)[^;{{}}]*\{{", False)]),
    "c": ("slash", "brace", [("struct", rf"^[ \t]*(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{{", True), ("enum", rf"^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<n>\w+)[^;{{(]*\{{", False), ("union", r"^[ \t]*union\s+(?P<n>\w+)\s*\{", False), ("class", r"^[ \t]*class\s+(?P<n>\w+)[^;{(]*\{", True), ("namespace", r"^[ \t]*namespace\s+(?P<n>\w+)\s*\{", True), ("macro", r"^[ \t]*#\s*define\s+(?P<n>\w+)", False), ("type", r"^[ \t]*typedef\s+[^;{}]*?(?P<n>\w+)\s*;", False), ("fn", r"^[ \t]*(?!else|return|if|for|while|switch)[\w:<>,*&~ \t]+?[\s*&](?P<n>~?\w+)\s*\([^;{}]*\)[^;{}=]*\{", False)]),
    "csharp": ("slash", "brace", [("namespace", r"^[ \t]*namespace\s+(?P<n>[\w.]+)", True), *[(k, rf"^[ \t]*{_MOD}{k}\s+(?P<n>\w+)", True) for k in ("class", "interface", "struct", "enum", "record")], ("method", rf"^[ \t]+{_MOD}[\w.<>\[\],?]+\s+(?P<n>\w+)\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:\{{|=>|;)", False), ("ctor", rf"^[ \t]+{_MOD}(?P<n>[A-Z]\w*)\s*\([^;{{}}]*\)[^;{{}}]*\{{", False)]),
    "php": ("slash", "brace", [*[(k, rf"^[ \t]*{_MOD}{k}\s+(?P<n>\w+)", True) for k in ("class", "interface", "trait", "enum")], ("fn", rf"^{_MOD}function\s+&?(?P<n>\w+)", False), ("method", rf"^[ \t]+{_MOD}function\s+&?(?P<n>\w+)", False)]),
    "kotlin": ("slash", "brace", [("class", rf"^[ \t]*{_MOD}(?:class|interface|enum\s+class)\s+(?P<n>\w+)", True), ("object", rf"^[ \t]*{_MOD}object\s+(?P<n>\w+)", True), ("fn", rf"^[ \t]*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<n>\w+)", False)]),
    "swift": ("slash", "brace", [*[(k, rf"^[ \t]*(?:(?:public|private|final|open|internal|indirect)\s+)*{k}\s+(?P<n>\w+)", True) for k in ("class", "struct", "enum", "extension", "actor", "protocol")], ("func", rf"^[ \t]*{_MOD}func\s+(?P<n>\w+)", False), ("init", rf"^[ \t]*{_MOD}(?P<n>init)\b", False), ("deinit", r"^[ \t]*(?P<n>deinit)\b", False), ("subscript", rf"^[ \t]*{_MOD}(?P<n>subscript)\b", False), ("type", r"^[ \t]*(?:public\s+)?(?:typealias|associatedtype)\s+(?P<n>\w+)", False)]),
    "scala": ("slash", "brace", [("class", rf"^[ \t]*{_MOD}class\s+(?P<n>\w+)", True), ("object", rf"^[ \t]*{_MOD}object\s+(?P<n>\w+)", True), ("trait", rf"^[ \t]*{_MOD}trait\s+(?P<n>\w+)", True), ("def", rf"^[ \t]*{_MOD}def\s+(?P<n>\w+)", False)]),
    "dart": ("slash", "brace", [("class", rf"^[ \t]*{_MOD}class\s+(?P<n>\w+)", True), ("enum", r"^[ \t]*enum\s+(?P<n>\w+)", False), ("fn", r"^[ \t]*(?:static\s+)?[\w<>?]+\s+(?P<n>\w+)\s*\([^;{}]*\)[^;{}]*(?:\{|=>)", False)]),
    "zig": ("slash", "brace", [("fn", r"^[ \t]*(?:pub\s+|export\s+|inline\s+)*fn\s+(?P<n>\w+)", False)]),
    "proto": ("slash", "brace", [("message", r"^[ \t]*message\s+(?P<n>\w+)", True), ("service", r"^[ \t]*service\s+(?P<n>\w+)", True), ("enum", r"^[ \t]*enum\s+(?P<n>\w+)", False), ("rpc", r"^[ \t]*rpc\s+(?P<n>\w+)", False)]),
    "css": ("slash", "brace", [("media", r"^[ \t]*@media\s*(?P<n>[^{]+?)\s*\{", True), ("keyframes", r"^[ \t]*@keyframes\s+(?P<n>[\w-]+)", True), ("supports", r"^[ \t]*@supports\s*(?P<n>[^{]+?)\s*\{", True), ("rule", r"^[ \t]*(?P<n>[^@{};\s/][^{};]*?)\s*\{", True)]),
    "hcl": ("hash", "brace", [("block", r"^(?P<n>\w+(?:\s+[\w-]+)*)\s*\{", False)]),
    "powershell": ("hash", "brace", [("fn", r"(?i)^[ \t]*function\s+(?P<n>[\w-]+)", False), ("class", r"(?i)^[ \t]*class\s+(?P<n>\w+)", True)]),
    "bash": ("hash", "brace", [("fn", r"^[ \t]*(?:function\s+(?P<n>[\w-]+)|(?P<m>[\w-]+)\s*\(\s*\))", False)]),
    "perl": ("hash", "brace", [("sub", r"^[ \t]*sub\s+(?P<n>\w+)", False), ("package", r"^[ \t]*package\s+(?P<n>[\w:]+)", False)]),
    "ruby": ("hash", "end", [("class", r"^[ \t]*class\s+(?P<n>[\w:]+)", True), ("module", r"^[ \t]*module\s+(?P<n>[\w:]+)", True), ("def", r"^[ \t]*def\s+(?:self\.)?(?P<n>[\w?!=]+)", False)]),
    "elixir": ("hash", "end", [("def", r"^[ \t]*(?:defmodule|defprotocol|defimpl|defp?|defmacrop?)\s+(?P<n>[\w.?!]+)", True)]),
    "julia": ("hash", "end", [("module", r"^[ \t]*module\s+(?P<n>\w+)", True), ("struct", r"^[ \t]*(?:mutable\s+)?struct\s+(?P<n>\w+)", False), ("abstract", r"^[ \t]*abstract\s+type\s+(?P<n>\w+)", False), ("fn", r"^[ \t]*function\s+(?P<n>[\w!.]+)", False)]),
    "lua": ("lua", "end", [("fn", r"^[ \t]*(?:local\s+)?function\s+(?P<n>[\w.:]+)", False)]),
    "sql": ("dash", "statement", [(k, rf"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:temporary\s+|unique\s+)*{w}\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.]+)", False) for k, w in (("table", "table"), ("view", "view"), ("fn", "function"), ("index", "index"))]),
    "haskell": ("dash", "line", [("data", r"^data\s+(?P<n>\w+)", False), ("newtype", r"^newtype\s+(?P<n>\w+)", False), ("type", r"^type\s+(?P<n>\w+)", False), ("class", r"^class\s+(?:.*=>\s*)?(?P<n>\w+)", True), ("fn", r"^(?P<n>[a-z_][\w']*)\s+(?!::)[^=\n]*=", False)]),
    "ocaml": ("none", "line", [("type", r"^[ \t]*type\s+(?:'\w+\s+)?(?P<n>\w+)", False), ("module", r"^[ \t]*module\s+(?P<n>\w+)", True), ("class", r"^[ \t]*class\s+(?P<n>\w+)", True), ("let", r"^let\s+(?:rec\s+)?(?P<n>\w+)", False)]),
    "make": ("hash", "indent", [("rule", r"^(?P<n>[\w./%-]+)\s*:(?!=)", False), ("var", r"^(?P<n>\w+)\s*[:?+]?=", False)]),
    "dockerfile": ("hash", "line", [("stage", r"(?i)^FROM\s+(?:\S+\s+AS\s+(?P<n>\S+)|(?P<m>\S+))", True)]),
    "toml": ("hash", "table", [("table[]", r"^\[\[\s*(?P<n>[^\]]+?)\s*\]\]", True), ("table", r"^\[\s*(?P<n>[^\[\]]+?)\s*\]", True)]),
    "yaml": ("hash", "indent", [("key", r"^[ \t]*(?:-\s+)?(?P<n>[\w.-]+)\s*:(?:\s|$)", True)]),
}
RULES |= {"typescript": RULES["javascript"], "tsx": RULES["javascript"], "cpp": RULES["c"]}
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<!--.*?-->", re.S)
# HTML elements that are symbols by themselves, and elements without an end.
STRUCTURAL = frozenset("main nav header footer section article aside form table h1 h2 h3 h4 h5 h6 script style template dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def mask(text: str, pattern) -> str:
    """The text with comments and strings blanked, line ends kept."""
    return text if pattern is None else pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def signature(line: str) -> str:
    s = line.strip().rstrip("{").strip()
    return s[:120] + "…" if len(s) > 120 else s


def _rows(found: list[tuple[str, str, int, int, bool]], lines: list[str]) -> list[tuple]:
    """(name, qualified, kind, parent, start, end, signature, ord) with parents by containment, outer first."""
    out, stack = [], []
    for name, kind, start, end, holds in sorted(found, key=lambda x: (x[2], -x[3])):
        while stack and stack[-1][1] < start:
            stack.pop()
        parent = stack[-1][0] if stack else None
        qualified = f"{parent}.{name}" if parent else name
        out.append((name, qualified, kind, parent, start, end, signature(lines[start - 1]) if start <= len(lines) else "", len(out)))
        if holds:
            stack.append((qualified, end))
    return out


def _python(text: str) -> tuple[list[tuple], list[int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return _scan("python", text), [getattr(e, "lineno", None) or 1]
    found, todo = [], [tree]
    while todo:
        node = todo.pop()
        for child in ast.iter_child_nodes(node):
            todo.append(child)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                found.append((child.name, "class" if isinstance(child, ast.ClassDef) else "def", child.lineno, child.end_lineno, True))
    return _rows(found, text.splitlines()), []


def _extent(style: str, masked: list[str], offsets: list[int], text: str, start: int, at: int) -> int:
    """Last line of a declaration that starts on line index ``start``; ``at`` is the end of its pattern's match."""
    if style == "brace":
        depth, opened = 0, False
        begin = offsets[start] + len(masked[start]) - len(masked[start].lstrip())
        for m in re.finditer(r"[{};]", text[begin:]):
            c = m[0]
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if depth <= 0:
                    return text.count("\n", 0, begin + m.start()) if opened else start
            elif not opened:
                return text.count("\n", 0, begin + m.start())
        return start
    indent = len(masked[start]) - len(masked[start].lstrip())
    if style in ("end", "indent"):
        for k in range(start + 1, len(masked)):
            line = masked[k]
            here = len(line) - len(line.lstrip())
            if line.strip() and here <= indent:
                if style == "end":
                    return k if re.match(r"\s*end\b", line) else start if k == start + 1 else k - 1
                last = k - 1
                while last > start and not masked[last].strip():
                    last -= 1
                return last
        return len(masked) - 1
    if style == "statement":
        stop = text.find(";", at)
        return text.count("\n", 0, stop) if stop >= 0 else len(masked) - 1
    if style == "table":
        for k in range(start + 1, len(masked)):
            if masked[k].startswith("["):
                return k - 1
        return len(masked) - 1
    return start


def _scan(lang: str, text: str) -> list[tuple]:
    if lang == "python":  # unparsable: indentation tells
        rules = ("hash", "indent", [("class", r"^[ \t]*class\s+(?P<n>\w+)", True), ("def", r"^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)", True)])
    else:
        rules = RULES[lang]
    masking, style, patterns = rules
    masked = mask(text, MASKS[masking])
    lines = masked.split("\n")
    offsets, at = [], 0
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    found, taken = [], set()
    for kind, pattern, holds in patterns:
        for m in re.finditer(pattern, masked, re.M):
            group = "n" if m["n"] is not None else "m"
            name = m[group]
            start = masked.count("\n", 0, m.start(group))
            first = masked.count("\n", 0, m.start()) if kind not in ("fn", "method", "ctor", "macro") else start
            if name in KEYWORDS or (start, name) in taken:
                continue
            taken.add((start, name))
            if lang == "hcl":
                name = ".".join(text[m.start(group) : m.end(group)].replace('"', "").split())
            end = _extent(style, lines, offsets, masked, min(first, start), m.end())
            found.append((name.strip(), kind, min(first, start) + 1, max(start, end) + 1, holds))
    members = {"javascript", "typescript", "tsx"}
    rows = _rows(found, text.split("\n"))
    if lang in members:  # methods only where a class holds them
        kinds = {q: k for _, q, k, *_ in rows}
        rows = [r for r in rows if r[2] != "method" or kinds.get(r[3]) == "class"]
    return rows


def _markdown(text: str) -> list[tuple]:
    lines, found, fence = text.split("\n"), [], False
    heads = []
    for k, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (m := HEADING.match(line)):
            heads.append((len(m[1]), m[2], k))
        elif not fence and k and re.fullmatch(r"(=+|-+)\s*", line) and lines[k - 1].strip():
            heads.append((1 if line[0] == "=" else 2, lines[k - 1].strip(), k - 1))
    for i, (level, name, k) in enumerate(heads):
        end = next((q for depth, _, q in heads[i + 1 :] if depth <= level), len(lines))
        found.append((name, "heading", k + 1, max(k + 1, end), False))
    return _rows(found, lines)


def _markup(lang: str, text: str) -> list[tuple]:
    """Elements: in XML all, named by an id attribute or child; in HTML structural ones and those with an id."""
    nodes: list[list] = []  # tag, name, parent node, start line, end line, text position
    open_: list[int] = []
    for m in _TAG.finditer(text):
        if not m[2]:
            continue
        tag, line = m[2], text.count("\n", 0, m.start()) + 1
        if m[1]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if nodes[open_[k]][0] == tag), None)
            if at is not None:
                nodes[open_[at]][4] = line
                del open_[at:]
            continue
        ident = re.search(r"\bid\s*=\s*[\"']([^\"']{1,80})[\"']", m[3] or "") or (lang == "xml" and re.match(r"\s*<id>\s*([^<]{1,80}?)\s*</id>", text[m.end() : m.end() + 200]))
        name = f"{tag}#{ident[1]}" if ident else tag if lang == "xml" or tag.lower() in STRUCTURAL else None
        nodes.append([tag, name, open_[-1] if open_ else None, line, line, m.end()])
        if not m[4] and not (lang == "html" and tag.lower() in VOID):
            open_.append(len(nodes) - 1)
    out, qualified, lines = [], {}, text.split("\n")
    for k, (_, name, up, start, end, _) in enumerate(nodes):
        parent = qualified.get(up)
        qualified[k] = parent if name is None else f"{parent}.{name}" if parent else name
        if name is not None:
            out.append((name, qualified[k], "element", parent, start, end, signature(lines[start - 1]), len(out)))
    return out


def symbols_of(lang: str, text: str) -> tuple[list[tuple], list[int], bool]:
    """Symbols, lines with syntax errors, and whether both are exact."""
    if lang == "python":
        rows, errors = _python(text)
        return rows, errors, not errors
    if lang == "markdown":
        return _markdown(text), [], False
    if lang in ("xml", "html"):
        return _markup(lang, text), [], False
    return (_scan(lang, text) if lang in RULES else []), [], False


def identifiers_of(lang: str, text: str) -> list[tuple[str, int, int, bool, int | None]]:
    """(name, line, column in bytes, is_call, argc): identifiers outside of strings and comments.

    argc counts the arguments of a call on one line, null where that can't be told.
    """
    masked = mask(text, MASKS["hash" if lang in ("python", "yaml", "toml", "make") else RULES[lang][0] if lang in RULES else "none"])
    out = []
    for k, line in enumerate(masked.split("\n"), 1):
        for m in WORD.finditer(line):
            if len(m[0]) < 2 or m[0][0].isdigit():
                continue
            rest = line[m.end() :]
            call = re.match(r"\s*!?\(", rest)
            out.append((m[0], k, len(line[: m.start()].encode()), bool(call) and m[0] not in KEYWORDS, _arguments(rest[call.end() - 1 :]) if call else None))
    return out


def _arguments(rest: str) -> int | None:
    depth = commas = 0
    seen = False
    for c in rest:
        if c in "([{":
            depth += 1
            seen |= depth > 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return commas + 1 if seen else 0
        elif c == "," and depth == 1:
            commas += 1
        elif not c.isspace():
            seen = True
    return None


def _symbol_batches(batches):
    for batch in batches:
        rows = [(p, lang, *s, exact) for p, lang, t in zip(batch["path"], batch["lang"], batch["text"]) for found, _, exact in [symbols_of(lang, t)] for s in found]
        yield pd.DataFrame(rows, columns=["path", "lang", "name", "qualified", "kind", "parent", "start_line", "end_line", "signature", "ord", "exact"])


def _ident_batches(batches):
    for batch in batches:
        rows = [(p, *i) for p, lang, t in zip(batch["path"], batch["lang"], batch["text"]) for i in identifiers_of(lang, t)]
        yield pd.DataFrame(rows, columns=["path", "name", "ln", "col", "is_call", "argc"]).astype({"argc": "Int32"})


def _error_batches(batches):
    for batch in batches:
        rows = [(p, e) for p, lang, t in zip(batch["path"], batch["lang"], batch["text"]) for e in symbols_of(lang, t)[1]]
        yield pd.DataFrame(rows, columns=["path", "ln"])


def symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of files (path, lang, text)."""
    return files.select("path", "lang", "text").mapInPandas(_symbol_batches, "path string, lang string, name string, qualified string, kind string, parent string, start_line int, end_line int, signature string, ord int, exact boolean")


def idents(files: DataFrame) -> DataFrame:
    return files.select("path", "lang", "text").mapInPandas(_ident_batches, "path string, name string, ln int, col int, is_call boolean, argc int")


def syntax_errors(files: DataFrame) -> DataFrame:
    """(path, lines) of files that don't parse; only for languages with an exact parser."""
    rows = files.where("lang = 'python'").select("path", "lang", "text").mapInPandas(_error_batches, "path string, ln int")
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("ln")).alias("lines"))
