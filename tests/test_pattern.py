"""The pattern layer: Spark's results for translated patterns against Arrow's RE2."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from dredge.operators.lines import Matcher
from dredge.plans import pattern as P
from dredge.plans.search import search

SUBJECTS = ["", "a", "ab", "abab", "AB", "é", "éab", "aé", "a\r", "\r", "x\x0by", "a b", "foo.bar", "ÄPFEL äpfel", "K k K", "ſs", "line\nnext", "end\n", "[:alpha:]", "&&", "a-b]c", "123", "_x9", "tab\there", "日本語", "a b", "aaa bbb", "foo(bar|baz)", "\\d", "{2}", "a{2}", "ß SS"]
PATTERNS = [
    "a", "ab", "a|b", "^a", "b$", "^$", "a.b", ".", r"\bab", r"ab\b", r"\Bb", r"\s", r"\S+", r"\w+", r"\W", r"\d+", r"\D", "[[:alpha:]]+", "[[:^alpha:]]", "[^a]", "[a-c]+", "(?i)ab",
    "(?i)äpfel", "(?i)k", "(?i)s", "(?i)[k]", "(?s)a.b", "(?s).$", "(?m)^n", "(?m)e$", "(?m)$", "a*?b", "(a|ab)(b|)", "(?P<x>a)b", "(?:ab)+", "a{2}", "a{2,}", "a{0,1}b", "x{", r"\{2\}",
    "[&&]", "[a&&b]", "[[]", "[]]", r"[\]a]", "[-a]", r"[\d-]", r"\pL", r"\p{Lu}", r"\p{Greek}", r"\PL", r"[\pL\d]+", r"\x41", r"\x{e9}", r"\Qfoo.bar\E", r"\Q[", r"\A\w", r"\w\z", "(?U)a+", "(?i:A)b", "(?i-s:a.)", r"\.", "()", "(|a)*", r"\101", "é", "[é]b?", "[^é]", r"a\r", r"\v", "日|é", "(?-i)a",
]
BAD = ["(", ")", "[", "a**", "a{1001}", r"\1", "(?=a)", "(?!a)", "(?<=a)b", "a++", r"\h", r"\R", r"\G", "(?>a)", "[b-a]", "*a", "\\", "(?P<n>a)(?P<n>b)", r"\k", "[[:nope:]]", "(?z)a", r"\x{110000}", "(a{500}){3}"]


def agree(spark, patterns):
    df = spark.createDataFrame([(s,) for s in SUBJECTS], "s string")
    javas = [P.to_java(p) for p in patterns]
    got = df.select("s", *[F.col("s").rlike(j).alias(f"c{i}") for i, j in enumerate(javas)]).collect()
    subjects = pa.array([r["s"] for r in got])
    for i, p in enumerate(patterns):
        want = pc.match_substring_regex(subjects, pattern=p).to_pylist()
        assert [r[f"c{i}"] for r in got] == want, (p, javas[i], [s for s, g, w in zip(SUBJECTS, [r[f"c{i}"] for r in got], want) if g != w])


def test_table(spark):
    agree(spark, PATTERNS)


def random_pattern(rng, depth=0):
    atoms = ["a", "b", ".", r"\w", r"\d", r"\s", "[ab]", "[^a]", "é", r"\b", "(?i:Ä)", "[[:upper:]]", r"\.", "^", "$", r"\pL"]
    out = ""
    for _ in range(rng.randint(1, 3)):
        atom = f"({random_pattern(rng, depth + 1)})" if depth < 2 and rng.random() < 0.3 else rng.choice(atoms)
        out += atom + (rng.choice(["", "", "*", "+", "?", "{1,2}", "*?"]) if atom not in ("^", "$", r"\b") else "")
    return out + (f"|{random_pattern(rng, depth + 1)}" if depth < 2 and rng.random() < 0.3 else "")


def test_random(spark):
    rng = random.Random(5)
    agree(spark, [random_pattern(rng) for _ in range(120)])


@pytest.mark.parametrize("pattern", BAD)
def test_rejected(pattern):
    with pytest.raises(P.BadPattern):
        P.parse(pattern)


@pytest.mark.parametrize(
    "pattern, fixed, literal",
    [("lamp oil", False, "lamp oil"), (r"wick\.[a-z]+ burns", False, " burns"), ("oil|wax", False, ""), ("w?", False, ""), ("(glow)+er", False, "glow"), ("wx", False, ""), ("lamp(post|light)", False, "lamp"), ("w.x*y", True, "w.x*y"), ("(wax){2}", False, "wax"), ("(?i)WAX.oil", False, "wax"), ("[w]ick", False, "wick")],
)
def test_required_literal(pattern, fixed, literal):
    assert P.required_literal(pattern, fixed) == literal


@pytest.mark.parametrize(
    "pattern, fixed, nocase, line, at",
    [("wick", False, False, "the wick burns", 4), ("wick", False, False, "no lamp", None), ("wIcK", False, True, "éé wick", 5), ("o+il", False, False, "lamp oooil", 5), ("o+il", True, False, "pattern: o+il", 9), ("ÄÖ", False, False, "日本ÄÖ語", 6), ("(o+)+il", False, False, "é ooil", 3), ("öl", False, True, "LAMPENÖL", 6)],
)
def test_offsets(spark, pattern, fixed, nocase, line, at):
    m = Matcher(pattern, fixed, nocase)
    row = spark.createDataFrame([(line,)], "s string").select(m.hits(F.col("s")).alias("hit"), m.first(F.col("s")).alias("at")).first()
    assert row["hit"] == (at is not None) and (at is None or row["at"] == at)


def files(spark, *rows):
    return spark.createDataFrame([(p, len(t.encode()), t) for p, t in rows], "path string, size long, text string")


def test_line_model(spark):
    f = files(spark, ("crlf", "a\r\nb\r\n"), ("empty", ""), ("nl", "\n"), ("last", "x\nend"), ("vt", "p\x0bq"))
    rows = lambda p, **k: [(r["path"], r["line"]) for r in search(f, p, **k).collect()]
    assert rows(r"a.$") == [("crlf", 1)] and rows("^$") == [("nl", 1)] and rows("end$") == [("last", 2)]
    assert rows(r"p\sq") == [] and rows("(e+)+nd") == [("last", 2)]


def test_modes_agree(spark):
    f = files(spark, ("a", "hit hit\nno\nhit\n"), ("b", "none\n"))
    assert search(f, "hit", mode="count").collect() == [("a", 2)]
    assert search(f, "hit", mode="occurrences").collect() == [("a", 3)]
    assert search(f, "h[i]t", mode="files").collect() == [("a",)] == search(f, "(h+)+it", mode="files").collect()
    assert [r["line"] for r in search(f, "hit", limit=1).collect()] == [1]
    spans = search(f, r"hit\nno", scope="file").collect()
    assert [(r["line"], r["text"], r["col"]) for r in spans] == [(1, "hit hit\nno", 4)]
