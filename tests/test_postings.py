"""Fuzzy lookup and regular expressions through postings, against the scans that they spare."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.column import Column

from loomstone.functions.regex_grams import grams_of, holds, required
from loomstone.operators import postings, search


def symbols(spark, seed, n=400):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        name = "".join(r.choice(["get", "Set", "x", "_", "é", "Item", "s", "b", "2", "Size"]) for _ in range(r.randint(1, 9)))
        rows.append((f"p{r.randint(0, 9)}", name, f"{r.choice(['Box', 'sb', 'T' * r.randint(1, 30)])}.{name}" if r.random() < 0.6 else name, k))
    return spark.createDataFrame(rows, "path string, name string, qualified string, ord int")


def test_fuzzy_equals_the_scan(spark, tmp_path):
    s = symbols(spark, 4)
    postings.write_name_index(s, str(tmp_path / "index"))
    for query in ("sb2", "GetItem", "x", "é", "getsize", "sz2", "ti", "zzz", "boxget", "", "itemitemitem", "SET_"):
        for limit in (1, 10):
            want = [(r.path, r.qualified, r.ord, r.score) for r in search.fuzzy(s, query, limit).collect()]
            assert [tuple(r) for r in postings.fuzzy(spark, str(tmp_path / "index"), query, limit).collect()] == want, query


def test_lookup_reads_lengths_upwards(spark, tmp_path, monkeypatch):
    rows = [("p", "ab" + "c" * k, "ab" + "c" * k, k) for k in range(200)]
    postings.write_name_index(spark.createDataFrame(rows, "path string, name string, qualified string, ord int"), str(tmp_path / "index"))
    read, between = [], Column.between
    monkeypatch.setattr(Column, "between", lambda self, a, b: read.append((a, b)) or between(self, a, b))
    got = postings.fuzzy(spark, str(tmp_path / "index"), "ab", 5).collect()
    assert [r.ord for r in got] == [0, 1, 2, 3, 4] and read == [(2, 9)]  # the longer names aren't read
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = spark.read.parquet(str(tmp_path / "index")).where("gram = 'ab' and size between 2 and 9")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(gram,ab)" in plan and "GreaterThanOrEqual(size,2)" in plan and "LessThanOrEqual(size,9)" in plan


TREES = [
    ("abc", "abc"),
    ("abcd", ("and", frozenset(["abc", "bcd"]))),
    ("ABC", "abc"),
    ("a.c", True),
    ("abc|xyz", ("or", frozenset(["abc", "xyz"]))),
    ("(abc|xyz)?", True),
    ("foo(bar|baz)", ("or", frozenset([("and", frozenset(["foo", "oob", "oba", "bar"])), ("and", frozenset(["foo", "oob", "oba", "baz"]))]))),
    ("[ab]cd", ("or", frozenset(["acd", "bcd"]))),
    ("a+bcd", ("and", frozenset(["abc", "bcd"]))),
    (r"\d+-abc", ("and", frozenset(["-ab", "abc"]))),
    ("(?i)abc", True),
    (r"\Qabc\E", True),
    ("(ab){2}", ("and", frozenset(["aba", "bab"]))),
    ("", True),
    ("(", True),
]


@pytest.mark.parametrize(("pattern", "need"), TREES)
def test_trees(pattern, need):
    assert required(pattern) == need


atoms = st.sampled_from(["a", "b", "C", "ab", "abc", "d", ".", "[ab]", "[^a]", "[a-c]", r"\d", r"\w", "x", "k", "^", "$", r"\b", "é", " "])
patterns = st.recursive(atoms, lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda x: f"({x[0]}|{x[1]})"), st.tuples(st.sampled_from(["a", "abc", "[ab]", "(ab)", "(abc|d)"]), st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "{0,2}", "+?"])).map("".join)), max_leaves=8)


@settings(max_examples=1500, deadline=None)
@given(patterns, st.text(alphabet="abcdABCDxkKé1 ", max_size=20), st.booleans())
def test_no_match_is_left_out(pattern, text, ignore_case):
    if re.search(pattern, text, re.I if ignore_case else 0):
        assert holds(required(pattern, True, ignore_case), text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcKk\u212a\u017fé", max_size=6), st.text(alphabet="abcKks\u212a\u017fé", max_size=14), st.booleans())
def test_no_plain_match_is_left_out(wanted, text, ignore_case):
    if wanted.lower() in text.lower() if ignore_case else wanted in text:
        assert holds(required(wanted, False, ignore_case), text)


def test_grep_through_postings(spark):
    r = random.Random(8)
    words = ["license", "Licence", "under", "by", "the", "a-b", "x=1", "fooba", "foobar", "foobaz", "é", "km", "\u212am"]
    rows = [(f"f{k}", "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 5))), k) for k in range(80)] + [("none", None, 0), ("empty", "", 0)]
    files = spark.createDataFrame(rows, "path string, text string, size int")
    index = postings.trigram_index(files).cache()
    for pattern, regex, ignore in (("licen[cs]e (under|by)", True, True), ("foo(bar|baz)$", True, False), ("^by", True, False), ("fooba[^rz]", True, False), (".", True, False), ("a-b", False, False), ("KM", False, True), ("nothing here", False, False), ("(ab|cd|ef|gh|ij)(kl|mn|op|qr|st)(uv|wx|yz)|license", True, False)):
        want = sorted(map(tuple, search.grep(files, pattern, regex, ignore).collect()))
        assert sorted(map(tuple, postings.grep(files, index, pattern, regex, ignore).collect())) == want, pattern
        found = postings.candidates(index, pattern, regex, ignore)
        share = postings.scan_share(files, index, pattern, regex, ignore).first()
        assert share.files == (files.count() if found is None else found.count()) and share.all_files == 82 and share.bytes <= share.all_bytes
    assert postings.scan_share(files, index, "foobaz$").first().files < 60
    many = "|".join(f"w{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno")
    assert len(grams_of(required(many))) > 62 and postings.grep(files, index, many + "|foobar").count() == search.grep(files, many + "|foobar", True).count() > 0
