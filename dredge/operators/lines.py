"""Lines of files, and matching them."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredge.functions.text import ascii_lower, occurrences
from dredge.plans import pattern as P


def split_lines(text: Column) -> Column:
    """Lines without their newlines; a last newline ends its line and begins none, and no text has no line."""
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def lines(files: DataFrame, *carry: str) -> DataFrame:
    """(path, line from 1, text) of every line, with the carried columns of the file."""
    return files.select("path", *carry, F.posexplode(split_lines(F.col("text"))).alias("_at", "text")).select(
        "path", *carry, (F.col("_at") + 1).alias("line"), "text"
    )


def linear(function, kind: str, pattern: str):
    """An Arrow UDF around one of Arrow's RE2 kernels, which take linear time for any pattern."""

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        return function(text, pattern=pattern)

    return run


@dataclass
class Matcher:
    """How a pattern is tested: as a literal (``contains``) where it is one, else as a Java pattern.

    A pattern with an unbounded repetition inside another could make Java backtrack without end; it is
    run by RE2 itself in Arrow batches (``linear``).
    """

    pattern: str
    fixed: bool = False
    nocase: bool = False

    def __post_init__(self):
        self.literal = P.plain_literal(self.pattern, self.fixed)
        if self.literal is not None and (self.literal == "" or (self.nocase and not self.literal.isascii())):
            self.literal = None
        self.linear = False
        if self.literal is None:
            source = P.Node("cat", kids=[P.Node("lit", c, self.nocase) for c in self.pattern]) if self.fixed else P.parse(f"(?i){self.pattern}" if self.nocase else self.pattern)
            self.java = P.java(source)
            self.empty = P.can_be_empty(source)
            self.linear = P.nested_repeat(source)
        elif self.nocase:
            self.java = "(?i)" + "".join(P.java_char(ord(c)) for c in self.literal)
            self.empty = False
        else:
            self.java = "".join(P.java_char(ord(c)) for c in self.literal)
            self.empty = False
        self.required = P.required_literal(self.pattern, self.fixed)

    @property
    def folds_ascii(self) -> bool:
        """A literal that ignores the case of A to Z."""
        return self.literal is not None and self.nocase

    def hits(self, text: Column) -> Column:
        if self.literal is not None and not self.nocase:
            return text.contains(self.literal)
        if self.linear:
            return linear(pc.match_substring_regex, "boolean", self.re2)(text)
        found = text.rlike(self.java)
        need = self.required if not self.nocase and P.flags_free(self.pattern, self.fixed) else ""
        return text.contains(need) & found if need else found

    @property
    def re2(self) -> str:
        return f"(?i){self.pattern}" if self.nocase else self.pattern

    def first(self, text: Column) -> Column:
        """Byte offset of the first match in a text that has one."""
        if self.linear:
            return linear(pc.find_substring_regex, "int", self.re2)(text)
        if self.literal is not None:
            subject, needle = (ascii_lower(text), self.literal.lower()) if self.nocase else (text, self.literal)
            place = F.locate(needle, subject)
        else:
            place = F.regexp_instr(text, F.lit(f"({self.java})"))
        return F.octet_length(F.substring(text, F.lit(1), place - 1)).cast("int")

    def count(self, text: Column) -> Column:
        """Matches in a text that do not overlap."""
        if self.literal is not None:
            return occurrences(ascii_lower(text), self.literal.lower()) if self.nocase else occurrences(text, self.literal)
        if self.linear:
            return linear(pc.count_substring_regex, "int", self.re2)(text).cast("long")
        return F.regexp_count(text, F.lit(self.java)).cast("long")

    def prefilter(self, text: Column) -> Column | None:
        """What the whole text must contain for any line to match, if that is known and cheap."""
        need = self.literal if self.literal is not None else self.required
        if not need or "\n" in need:
            return None
        if self.nocase:
            return text.rlike(self.java) if self.literal is not None else None
        return text.contains(need) if P.flags_free(self.pattern, self.fixed) else None


def matching_lines(files: DataFrame, m: Matcher, *carry: str) -> DataFrame:
    """(path, line, text, col, line_len) of every line that matches; offsets in bytes."""
    need = m.prefilter(F.col("text"))
    subject = files if need is None else files.where(need)
    found = lines(subject, *carry).where(m.hits(F.col("text")))
    return found.select("path", *carry, "line", "text", m.first(F.col("text")).alias("col"), F.octet_length("text").alias("line_len"))


def matching_spans(files: DataFrame, m: Matcher, *carry: str) -> DataFrame:
    """As ``matching_lines`` with the pattern run over whole texts: matches may span lines.

    One row per line that a match begins on; its text reaches from that line's start to the end of the
    line where the match ends. Patterns that match the empty text are rejected.
    """
    if m.empty:
        raise P.BadPattern("a pattern for whole files must not match the empty text")
    if m.linear:
        raise P.BadPattern("rows of whole-file matches need a pattern without nested unbounded repetitions; count or list files instead")
    text = F.col("text")
    found = files.where(m.hits(text)).select("path", *carry, "text", F.regexp_extract_all(text, F.lit(f"({m.java})"), F.lit(0)).alias("hit"), F.split(text, m.java, -1).alias("gap"))
    # a split that begins with a match has an empty first part, so gaps and hits alternate
    spans = F.aggregate(
        F.zip_with(F.slice("gap", F.lit(1), F.size("hit")), "hit", lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))),
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<a:int,b:int>>)").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["h"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("a"), (acc["at"] + x["g"] + x["h"]).alias("b")))).alias("out")),
        lambda acc: acc["out"],
    )
    rows = found.select("path", *carry, "text", F.explode(spans).alias("s"))
    before = F.substring(F.col("text"), F.lit(1), F.col("s.a"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    start = F.col("s.a") - F.length(F.substring_index(before, "\n", -1))
    tail = F.substring_index(F.substring(F.col("text"), F.col("s.b") + 1, F.length("text")), "\n", 1)
    whole = F.substring(F.col("text"), start + 1, F.col("s.b") - start + F.length(tail))
    col = F.octet_length(F.substring(F.col("text"), start + 1, F.col("s.a") - start))
    rows = rows.select("path", *carry, F.col("s.a").alias("at"), line.cast("int").alias("line"), whole.alias("text"), col.cast("int").alias("col"))
    first = rows.groupBy("path", *carry, "line").agg(F.min_by(F.struct("text", "col"), "at").alias("f"))
    return first.select("path", *carry, "line", F.col("f.text").alias("text"), F.col("f.col").alias("col"), F.octet_length("f.text").alias("line_len"))
