"""Path predicates: globs, hidden files, ignore rules. All are regular expressions made at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dredge.functions.text import basename


class BadGlob(ValueError):
    """The glob is not valid."""


def quoted(text: str) -> str:
    """A literal that Java, RE2 and Python read alike."""
    return "".join(c if c.isalnum() or c in "_/ " or not c.isascii() else f"\\{c}" for c in text)


def glob_regex(glob: str) -> str:
    r"""Anchored pattern of a glob: ``*``, ``?`` and ``[...]`` stay within a segment, ``\`` escapes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == len(glob):
                raise BadGlob(glob)
            out += quoted(glob[i])
            i += 1
        elif c == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            items, first = "", True
            while first or glob[i : i + 1] != "]":
                first = False
                ends = []
                for part in (0, 1):
                    if part and glob[i : i + 1] != "-":
                        break
                    i += part
                    if i < len(glob) and glob[i] == "\\":
                        i += 1
                    elif glob[i : i + 1] in ("-", "]"):
                        raise BadGlob(glob)
                    if i >= len(glob):
                        raise BadGlob(glob)
                    ends.append(glob[i])
                    i += 1
                if len(ends) == 2 and ends[1] < ends[0]:
                    raise BadGlob(glob)
                items += "-".join(e if e.isalnum() else f"\\{e}" for e in ends)
            i += 1
            out += f"[^/{items}]" if negated else f"[{items}]"
        else:
            out += quoted(c)
    return f"^(?:{out})$"


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def glob_match(path: Column, globs: Sequence[str]) -> Column:
    """Any glob fits the whole path or its last segment."""
    pattern = any_of(map(glob_regex, globs))
    return path.rlike(pattern) | basename(path).rlike(pattern)


def include_regex(glob: str) -> str:
    """As ``glob_regex``; ``dir/*`` also fits everything below ``dir``."""
    whole = glob_regex(glob)
    return any_of([whole, f"^{quoted(glob[:-2])}/"]) if glob.endswith("/*") else whole


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    pattern = any_of(map(include_regex, globs))
    return path.rlike(pattern) | basename(path).rlike(pattern)


def exclude_include(path: Column, exclude: Sequence[str], include: Sequence[str]) -> Column | None:
    """Kept unless excluded; what is included is kept in any case."""
    if not exclude:
        return None
    out = ~any_glob(path, exclude)
    return out | any_glob(path, include) if include else out


HIDDEN = r"(?:^|/)\."
GIT = r"(?:^|/)\.git(?:/|$)"


def hidden(path: Column) -> Column:
    return path.rlike(HIDDEN)


def under(path: Column, folder: str) -> Column:
    """The path is the folder or lies below it."""
    return (path == folder) | path.startswith(f"{folder}/") if folder else F.lit(True)


def ignore_rule(rule: str, folder: str = "") -> tuple[str | None, str] | None:
    """(pattern of the exact path or None for folders only, pattern of what lies below); None for no rule.

    Matching is relative to ``folder``, where the rule was found.
    """
    rule = rule.strip()
    if not rule or rule[0] in "#!":
        return None
    only_dirs = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    if not rule:
        return None
    body, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            body, i = body + ".*", i + 2
        else:
            body += {"*": "[^/]*", "?": "[^/]"}.get(rule[i]) or quoted(rule[i])
            i += 1
    start = f"^{quoted(folder)}/" if folder else "^"
    start += "" if anchored else "(?:.*/)?"
    return None if only_dirs else f"{start}{body}$", f"{start}{body}/"


def ignore_regex(rules: Iterable[str | tuple[str, str]]) -> str:
    """One pattern for files that are ignored; rules are lines, or (folder, line) of nested ignore files."""
    parts = [GIT]
    for r in rules:
        made = ignore_rule(*((r, "") if isinstance(r, str) else (r[1], r[0])))
        if made:
            parts += [p for p in made if p]
    return any_of(parts)


def ignored(path: Column, rules: Iterable[str | tuple[str, str]]) -> Column:
    return path.rlike(ignore_regex(rules))


def rule_pattern(rule: str) -> str | None:
    """What a rule matches of a path relative to its ignore file's folder; None for no rule."""
    made = ignore_rule(rule)
    return any_of(p for p in made if p) if made else None


def is_ignored(path: str, is_dir: bool, rules: Iterable[str]) -> bool:
    """The same test for one path, which may be a folder (folders match folder-only rules)."""
    if re.search(GIT, path):
        return True
    for r in rules:
        made = ignore_rule(r)
        if made and ((made[0] and re.search(made[0], path)) or re.search(made[1], path + "/" if is_dir else path)):
            return True
    return False
