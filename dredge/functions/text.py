"""Scalar functions over texts, lines and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Languages by extension. Fixed values.
LANGUAGES = {"go": "go", "java": "java", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript"}
PROBE_BYTES = 8192


def ascii_lower(text: Column) -> Column:
    """Only A to Z lowered."""
    return F.translate(text, UPPER, LOWER)


def has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.regexp_extract(F.lower(basename(path)), r"\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language of a path, or the empty string."""
    ext = extension(path)
    out = F.lit("")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def root_hash(root: Column, follow: Column) -> Column:
    """Sixteen hex digits that name a root's index."""
    return F.substring(F.sha2(F.when(follow, F.concat(root, F.lit("\0follow"))).otherwise(root).cast("binary"), 256), 1, 16)


def decode_utf16(content: str) -> Column:
    """Text of a binary column: UTF-16 if it has its byte order mark, UTF-8 otherwise (bad bytes replaced)."""
    even = f"substring({content}, 1, octet_length({content}) - octet_length({content}) % 2)"
    bom = f"substring({content}, 1, 2)"
    return F.expr(
        f"CASE WHEN {bom} = X'FFFE' THEN decode(substring({even}, 3), 'UTF-16LE') "
        f"WHEN {bom} = X'FEFF' THEN decode(substring({even}, 3), 'UTF-16BE') "
        f"ELSE make_valid_utf8(CAST({content} AS STRING)) END"
    )


def line_of(text: Column, number: Column) -> Column:
    """The n-th line of a text, empty beyond its end."""
    return F.coalesce(F.try_element_at(F.split(text, "\n", -1), number), F.lit(""))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs without overlap."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal.encode())).cast("long")


def window(text: Column, at: Column, width: int) -> Column:
    """About ``width`` characters of a line around the byte offset ``at``, with an ellipsis at each cut side.

    The cut is made in characters, so it never splits one.
    """
    n = F.length(text)
    place = F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at), "UTF-8"))
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), (place - F.lit(width // 2))), n - width))
    body = F.substring(text, start + 1, F.lit(width))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < n, "…").otherwise(""))
    return F.when(n <= width, text).otherwise(cut)
