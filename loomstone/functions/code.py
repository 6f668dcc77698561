"""What paths and symbols are: language, exclusions, tests, entry points."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, basename

# Extension -> language.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "css": "css", "rb": "ruby", "php": "php", "cs": "csharp",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sh": "bash", "bash": "bash", "lua": "lua", "scala": "scala", "sc": "scala",
    "ex": "elixir", "exs": "elixir", "dart": "dart", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html",
    "md": "markdown", "markdown": "markdown", "zig": "zig", "nix": "nix", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "svelte": "svelte",
    "vue": "vue", "pl": "perl", "pm": "perl", "r": "r", "R": "r", "jl": "julia", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
    "m": "objc", "mm": "objc", "xml": "xml", "xsd": "xml", "xsl": "xml", "xslt": "xml", "svg": "xml", "graphql": "graphql", "gql": "graphql",
    "proto": "proto", "sql": "sql", "tf": "hcl", "tfvars": "hcl", "hcl": "hcl",
}
# Directories and lock files that are never indexed.
EXCLUDED_DIRS = "node_modules target dist build out vendor venv .venv __pycache__ .git .svn .hg .tox .mypy_cache .pytest_cache .next .nuxt .svelte-kit .gradle .idea .cache bower_components Pods DerivedData".split()
EXCLUDED_FILES = "pnpm-lock.yaml package-lock.json yarn.lock npm-shrinkwrap.json bun.lock bun.lockb Cargo.lock composer.lock Gemfile.lock poetry.lock Pipfile.lock uv.lock pdm.lock go.sum flake.lock pubspec.lock Podfile.lock packages.lock.json mix.lock deno.lock".split()
# Languages without callable symbols, kinds of types and of callables.
NOT_CALLABLE = "markdown json yaml toml css graphql nix svelte vue r".split()
TYPE_KINDS = "struct enum trait type class interface record actor extension".split()
CALLABLE_KINDS = "fn fn* def method".split()
TEST_DIRS = "tests test __tests__ spec specs".split()


def detect_lang(path: Column) -> Column:
    """Language label of a path; null if it isn't indexed. The extension follows the last dot of the whole path."""
    base = F.regexp_extract(path, r"[^/\\]*$", 0)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    return (
        F.when(base.isin("Makefile", "makefile", "GNUmakefile") | base.endswith(".mk"), "make")
        .when(base.isin("Dockerfile", "dockerfile", "Containerfile") | base.startswith("Dockerfile.") | base.endswith(".dockerfile"), "dockerfile")
        .otherwise(F.try_element_at(known, F.substring_index(path, ".", -1)))
    )


def is_indexed_path(path: Column) -> Column:
    """Neither below an excluded directory nor a lock file, and of a known language."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: d.isin(EXCLUDED_DIRS)) & ~basename(path).isin(EXCLUDED_FILES) & detect_lang(path).isNotNull()


def is_type_kind(kind: Column) -> Column:
    return kind.isin(TYPE_KINDS)


def is_callable_kind(kind: Column) -> Column:
    return kind.isin(CALLABLE_KINDS)


def has_callable_symbols(lang: Column) -> Column:
    return ~lang.isin(NOT_CALLABLE)


def entries_prefix(path: Column, prefix: str) -> Column:
    """Paths that begin with the prefix, ASCII case ignored; % and _ in it are wildcards, nothing escapes them."""
    return F.like(ascii_lower(path), ascii_lower(F.lit(prefix + "%")), F.lit("\u0001"))


def deps_prefix(path: Column, prefix: str) -> Column:
    """Paths that begin with the very prefix."""
    return path.startswith(prefix)


def is_test_path(path: Column) -> Column:
    low = ascii_lower(path)
    name = basename(low)
    stem = F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))
    return F.exists(F.split(low, "/"), lambda s: s.isin(TEST_DIRS)) | name.startswith("test_") | name.contains(".test.") | name.contains(".spec.") | stem.endswith("_test") | stem.endswith("_spec")


def is_test_symbol(qualified: Column) -> Column:
    return F.exists(F.split(qualified, r"\."), lambda s: s.isin("tests", "test") | s.startswith("test_") | s.endswith("_test"))


def entry_class(lang: Column, name: Column, kind: Column, parent: Column, signature: Column, path: Column) -> Column:
    """test, main, api or null. Test code counts only where it can be called."""
    call, top = is_callable_kind(kind), parent.isNull()
    test = is_test_path(path) | F.coalesce(is_test_symbol(parent), F.lit(False)) | is_test_symbol(name)
    sig = F.ltrim(signature)
    api = ((lang == "rust") & top & sig.startswith("pub ")) | (lang.isin("javascript", "typescript", "tsx") & sig.startswith("export ")) | ((lang == "python") & top & kind.isin("def", "class") & ~name.startswith("_"))
    return (
        F.when(test, F.when(call, F.lit("test")))
        .when(call & (name == "main") & top, F.lit("main"))
        .when((lang == "python") & top & call & (basename(path) == "__main__.py"), F.lit("main"))
        .when(api, F.lit("api"))
    )


def external_name(lang: Column, spec: Column, own: list[str] = ()) -> Column:
    """Package that an import brings in from outside; null for relative, built-in and own ones."""
    first = F.trim(F.split(spec, "::")[0])
    rust = F.when(spec.startswith("mod:") | first.isin("crate", "self", "super", "std", "core", "alloc", "", *own), F.lit(None)).otherwise(first)
    top = F.trim(F.substring_index(spec, ".", 1))
    python = F.when(~spec.startswith(".") & (top != ""), top)
    scoped = F.nullif(F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1), F.lit(""))
    bare = F.nullif(F.trim(F.substring_index(spec, "/", 1)), F.lit(""))
    js = F.when(spec.startswith(".") | spec.startswith("/"), F.lit(None)).when(spec.startswith("@"), scoped).otherwise(bare)
    return F.when(lang == "rust", rust).when(lang == "python", python).otherwise(js)


def path_filter(path: Column, wanted: str, is_dir: bool = False) -> Column:
    """The path itself, what lies below it, and, unless it names a directory, every path that starts with it."""
    clean = wanted.rstrip("/")
    if not clean:
        return F.lit(True)
    below = (path == clean) | path.startswith(clean + "/")
    return below if is_dir or wanted.endswith("/") else below | path.startswith(clean)


def file_match(path: Column, wanted: str) -> Column:
    """The path itself, or a suffix of it from a slash on; ASCII case is ignored in the suffix."""
    return (path == wanted) | ascii_lower(path).endswith("/" + wanted.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
