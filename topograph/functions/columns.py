"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks entry points and tests.
ENTRY_POINT = r"(?i)(?:index|main|app|server|cli)\.[a-z]+$|vite\.config|webpack\.config"
TEST_PARTS = (".spec.", ".test.", "__tests__")
TEST_ENDS = ("_test.go", "Test.java", "Tests.java")
# Tags that are no components.
NATIVE_TAGS = tuple(
    "html head body title meta link style script noscript div span p a b i u s strong em small mark h1 h2 h3 h4 h5 h6 header footer nav main section article aside "
    "ul ol li dl dt dd table thead tbody tfoot tr th td caption form input textarea button select optgroup option label fieldset legend "
    "img audio video canvas svg path g circle rect line polyline polygon iframe embed object param picture source track "
    "slot template component transition transition-group keep-alive teleport suspense".split()
)
#: A dotted name before a bracket; the lookbehind is the ASCII word border.
CALL = r"(?<![A-Za-z0-9_])([a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*)\s*\("


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def api_path(path: Column) -> Column:
    """A route with each {x} or :x as *, single slashes and none at the end."""
    out = F.regexp_replace(F.regexp_replace(trimmed(path), r"\{[^}]+\}", "*"), r":[a-zA-Z0-9_]+", "*")
    return F.regexp_replace(F.regexp_replace(out, "/+", "/"), "/$", "")


def is_entry_point(path: Column) -> Column:
    return path.rlike(ENTRY_POINT)


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | path.contains(part)
    for end in TEST_ENDS:
        out = out | path.endswith(end)
    return out


def clean_query(query: str) -> str:
    """A lookup query: trimmed, without leading dots and slashes, with forward slashes, in lower case."""
    return re.sub(r"^[./\\]+", "", query.strip()).replace("\\", "/").lower()


def kebab_to_pascal(c: Column) -> Column:
    parts = F.filter(F.split(c, "-"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def component_tags(markup: Column) -> Column:
    """Tags of components: in PascalCase as they are, in kebab-case as they are and in PascalCase; each once."""
    tags = F.array_distinct(F.regexp_extract_all(markup, F.lit(r"<([a-zA-Z0-9_-]+)(?![A-Za-z0-9_])"), F.lit(1)))
    own = F.filter(tags, lambda t: ~F.lower(t).isin(*NATIVE_TAGS) & (t.rlike("^[A-Z]") | t.contains("-")))
    return F.array_distinct(F.flatten(F.transform(own, lambda t: F.when(t.rlike("^[A-Z]"), F.array(t)).otherwise(F.array(t, kebab_to_pascal(t))))))


def instability_milli(ca: Column, ce: Column) -> Column:
    """Thousandths of ce / (ca + ce), half up; 0 for an isolated module. An integer, so that engines agree."""
    n = ca + ce
    return F.when(n == 0, F.lit(0)).otherwise(F.floor((2000 * ce + n) / (2 * n))).cast("long")


def stability(milli: Column) -> Column:
    return F.when(milli == 0, "very stable").when(milli >= 800, "fragile").otherwise("balanced")


def glob_regex(pattern: str, mode: str = "legacy") -> str:
    """The regular expression of a boundary rule's glob.

    legacy keeps the established reading: * is a run of characters other than slashes, also within **, which so spans a character and such a
    run, and a pattern may match anywhere in a path. strict anchors both ends and lets ** span slashes.
    """
    quoted = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], pattern)
    if mode == "strict":
        return "^" + re.sub(r"\*\*|\*|\?", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]], quoted) + "$"
    return re.sub(r"\*\*|\*", lambda m: ".[^/]*" if m[0] == "**" else "[^/]*", quoted)


def canonical_cycle(cycle: Column) -> Column:
    """An open cycle rotated so that its smallest id is first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def mermaid_label(text: str) -> str:
    return re.sub(r"[<>]", "", text.replace('"', "'"))
