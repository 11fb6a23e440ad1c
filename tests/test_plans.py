"""Query strings, globs, the regex dialect and its prefilter."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeseam.plans import querylang as ql
from codeseam.plans import regexlang as rl


def test_parse():
    p = ql.parse('repo:a repo:b.* branch:dev lang:Py file:lib.rs file:*.rs case:yes select=symbol re:1 "two words" x:y tail')
    assert (p.repos, p.repo_regexes, p.branches, p.langs) == (("a",), ("b.*",), ("dev",), ("py",))
    assert p.file_globs == ("lib.rs", "*.rs") and not p.file_regexes
    assert p.case_sensitive and p.regex and p.select == "symbol" and p.pattern == "two words x:y tail"
    assert ql.parse("select:nonsense").select == "file" and ql.parse("path:only q").path_only


@pytest.mark.parametrize("line", [r"\bword\b", 'fi"le:bla"', "(abc def)", "(abc", "--", '"abc', "abc.*def", r"abc\.\*def", "lang:c++", ""])
def test_any_line_parses(line):
    ql.parse(line)


def test_globs():
    for glob, yes, no in [("*.rs", "a/b.rs", "b.rsx"), ("a?c", "abc", "ac"), ("[ab]x", "bx", "cx"), ("lib.rs", "lib.rs", "src/lib.rs"), ("[!a]b", "cb", "ab")]:
        assert re.match(ql.glob_to_regex(glob), yes) and not re.match(ql.glob_to_regex(glob), no)


@pytest.mark.parametrize(
    "pattern,some",
    [("abc", True), ("a.b", False), ("abc|def", True), ("abc|d", False), ("(abc)?", False), ("(abc)+", True), ("x*abcd", True), ("[abc]{3}", False), ("abc-def", True), ("Kelvin", True), ("kkk", False), ("a(?=b)", False), ("^abc$", True)],
)
def test_prefilter_kinds(pattern, some):
    assert bool(rl.prefilter(pattern)) == some


def has(text, needs):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    runs = re.findall("[a-z0-9_]{3,}", low)
    tri = {r[i : i + 3] for r in runs for i in range(len(r) - 2)}
    return any(n <= tri for n in needs)


ATOM = st.sampled_from(["abc", "de", "x", ".", "[ab]", "_1", "K", "s", " ", "-", r"\d", r"\b", "^", "foo"])
PATTERN = st.recursive(ATOM, lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda t: f"(?:{t[0]}|{t[1]})"), st.tuples(p, st.sampled_from(["?", "*", "+", "{2}"])).map(lambda t: f"(?:{t[0]}){t[1]}")), max_leaves=6)


@given(PATTERN, st.text("abcdexfo_1kKs -ſK", max_size=14))
@settings(max_examples=800, deadline=None)
def test_prefilter_loses_no_match(pattern, text):
    needs = rl.prefilter(pattern)
    if needs and re.search(pattern, text, re.I):
        assert has(text, needs)


def test_dialect():
    assert rl.to_java("a(?=b)") is None and rl.to_java(r"(a)\1") is None and rl.to_java("a(") is None
    assert rl.to_java("ab$") == r"(?Udi)ab\z" and rl.to_java("[$]", False) == r"(?Ud)[\$]"


NO_PATTERNS = ["a{,3}", "a(", "a)", "[a", "[z-a]", r"[a-\d]", r"\p{nope}", "a{2,1}", "{", "*a", "(?i", "(?<=a)b", "(?>a)", r"\1", r"\Qa\E", "(?P<a>x)(?P<a>y)", r"\x{110000}", "(?R)a", "[[:nope:]]", r"\q"]
SAME_AS_PYTHON = ["abc", "a|b", "(?:ab)+c?", "[a-c]x", "[^a-c]x", r"\d+", r"\bfoo\b", "(?i)ABC", "a.c", "(?s)a.c", "(?m)^b$", "^ab", "b$", "a{2}b{1,}", "a+?b", r"\x61", r"\u00e9", "(?P<n>a)b", "[]a]x", r"[\]\-]", "x*", "(a|)b", r"\."]
TEXTS = ["", "abc", "ab", "b", "a\nb\n", "a\nc", "foo", "xfoo", "aab", "dx", "ax", "]x", "-", "12", "ABC", "éa", "a.c", "abcab", "b\n"]


def test_patterns_run_as_they_should(spark):
    from pyspark.sql import functions as F

    assert [p for p in NO_PATTERNS if rl.to_java(p) is not None] == []
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", *[F.col("t").rlike(rl.to_java(p, False)).alias(str(i)) for i, p in enumerate(SAME_AS_PYTHON)]).collect()
    for r in rows:
        for i, p in enumerate(SAME_AS_PYTHON):
            want = re.search(p.replace("b$", r"b\Z") if p == "b$" else p, r.t) is not None
            assert r[str(i)] == want, (p, r.t)
    own = {r"\p{Lu}": "É", r"\p{Greek}+": "λ", r"\pL": "ß", r"\PL": "1", "(?<n>a)": "a", "[[:alpha:]]": "q", "[[:^alpha:]]": "é", "[a-z&&[^aeiou]]": "b", r"[\w--a]": "b", "[a-c~~b-d]": "d", "a**": "", "(?x) a b # c": "ab", "(?U)a+": "a", r"\<foo\>": "a foo", r"\b{start}f": "f", r"\x{1F600}": "😀", "[^]]": "a", "(?-i:a)": "a", "\\p{sc=Han}": "漢", r"\p{Lowercase_Letter}": "a"}
    none = {r"\p{Lu}": "é", "[[:alpha:]]": "é", "[a-z&&[^aeiou]]": "e", r"[\w--a]": "a", "[a-c~~b-d]": "b"}
    got = spark.range(1).select(*[F.lit(t).rlike(rl.to_java(p, False)).alias(f"y{i}") for i, (p, t) in enumerate(own.items())], *[F.lit(t).rlike(rl.to_java(p, False)).alias(f"n{i}") for i, (p, t) in enumerate(none.items())]).first().asDict()
    assert [k for k, v in got.items() if v != k.startswith("y")] == []


def test_anchors_and_substrings():
    assert rl.required_substrings("foo(bar|xbarx)+baz?") == ["foo", "ba"]
    assert rl.required_substrings("(?i)foo") == [] and rl.required_substrings("a|b") == [] and rl.required_substrings("(") == []
    assert rl.byte_anchors(r"foo\(a|b\(foo") == "(fo" and rl.byte_anchors("a?") == "" and rl.byte_anchors("(") == ""
