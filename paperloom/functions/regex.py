"""Regex helpers: one dialect for every pattern in ``rules``.

Spark runs ``java.util.regex``. ``(?d)`` makes only ``\\n`` a line end, ``(?u)`` folds case beyond ASCII,
and word boundaries are written as look-arounds over an explicit letter/digit class so that Hebrew and
accented letters count as word characters on every Java version.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = r"[\s\p{Z}]"
# every character that counts as white space when a text is trimmed
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_NAMED_GROUP = re.compile(r"\(\?P<(\w+)>")
_ANY_GROUP = re.compile(r"\((?!\?)|\(\?P<(\w+)>")


def _one_number(pattern: str) -> bool:
    r"""Whether a pattern is one group between ``\b`` that starts and ends with a digit, whatever it matches."""
    if not re.fullmatch(r"\\b\(\\d(?:\{[1-9].*)?\\d\{[1-9]\d*,?\d*\}\)\\b|\\b\(\\d\{[1-9]\d*,?\d*\}\)\\b", pattern):
        return False
    plain = re.sub(r"\[[^\]]*\]", "", re.sub(r"\\.", "", pattern))[1:-1]
    while "(" in plain:  # alternatives inside of inner groups do not matter
        inner = re.sub(r"\((?:\?:)?[^()]*\)", "", plain)
        if inner == plain:
            return False
        plain = inner
    return "|" not in plain and ")" not in plain


def _has_case(pattern: str) -> bool:
    """Whether the pattern spells a character that letter case could matter for; Hebrew has none."""
    plain = re.sub(r"\\[pP]\{\w+\}|\(\?P<\w+>|\\[bdnsw]", "", pattern)
    return "\\" in re.sub(r"\\[^a-zA-Z0-9]", "", plain) or any(c.isalpha() and not "\u05d0" <= c <= "\u05ea" or "\u0300" <= c <= "\u036f" for c in plain)


def dialect(pattern: str, ignore_case: bool = True) -> str:
    """Rule text -> Java pattern with the flags above.

    Case is folded only where a pattern has letters with case: folding keeps Java from its quick search for a fixed text. A
    number between word edges is looked for by its first digit; its edges need one look each.
    """
    ignore_case = ignore_case and _has_case(pattern)
    if _one_number(pattern):
        return ("(?iud)" if ignore_case else "(?d)") + rf"(?=\d)(?<!{WORD})" + pattern[2:-2].replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", WORD) + f"(?!{WORD})"
    body = _NAMED_GROUP.sub("(", pattern).replace(r"\b", WORD_EDGE).replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", WORD)
    return ("(?iud)" if ignore_case else "(?d)") + body


def group_numbers(pattern: str) -> dict[str, int]:
    """Named groups of a rule pattern -> their position."""
    found: dict[str, int] = {}
    plain = re.sub(r"\\.", "..", pattern)
    plain = re.sub(r"\[[^\]]*\]", lambda m: "." * len(m.group()), plain)
    for position, match in enumerate(_ANY_GROUP.finditer(plain), start=1):
        if match.group(1):
            found[match.group(1)] = position
    return found


def group_count(pattern: str) -> int:
    return re.compile(re.sub(r"\\p\{\w\}", "a", pattern)).groups


def required_literal(pattern: str) -> str:
    """The longest text that every match of a regex must contain, as far as that is plain from the outside; else empty.

    Only what stands outside of groups, classes and alternatives counts, and no character that may be left out.
    """
    if re.search(r"\(\?[a-zA-Z]*[ix]", pattern):  # other letter case or free spacing: nothing is literal
        return ""
    runs, run, at, depth, n = [], "", 0, 0, len(pattern)
    while at < n:
        one, atom = pattern[at], None
        if one == "\\":
            escaped = pattern[at + 1 : at + 2]
            if escaped and not escaped.isalnum():
                atom = escaped
            elif escaped in ("x", "u", "U", "N", "0") or escaped.isdigit():
                return ""  # spelled characters and references: left to the full check
            at += 2
        elif one == "[":
            at += 1
            if pattern[at : at + 1] == "^":
                at += 1
            if pattern[at : at + 1] == "]":
                at += 1
            while at < n and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            at += 1
        else:
            if one == "(":
                depth += 1
            elif one == ")":
                depth -= 1
            elif one == "|" and depth == 0:
                return ""
            elif one not in "|.^$*+?{}":
                atom = one
            elif one == "{" and not re.match(r"\{\d*,?\d*\}", pattern[at:]) or one == "}":
                return ""  # a plain brace: left to the full check
            at += 1
        counted = re.match(r"(\*|\+|\?|\{\d*,?\d*\})[?+]?", pattern[at:])
        if depth or one == ")" or atom is None:
            runs.append(run)
            run = ""
        elif counted is None:
            run += atom
        else:
            runs.append(run + atom if counted[1] == "+" else run)
            run = ""
        if counted is not None and one not in "(|":
            at += counted.end()
    return max([*runs, run], key=len)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once.

    A lambda variable keeps an intermediate value from being copied into every place that reads it when
    the optimizer merges projections or pushes a filter through them.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def non_blank(value: Column) -> Column:
    """NULL for ''. The value is evaluated once: inside of a lambda ``nullif`` computes it twice, and nested ones four times."""
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


def capture(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The group's text, NULL where the pattern or the group did not match.

    A text that lacks the literal which every match must contain is not scanned by the pattern: looking for a fixed text
    costs a small part of a scan. Only literals without letter case serve, since patterns fold it.
    """
    found = non_blank(F.regexp_extract(text, dialect(pattern, ignore_case), group))
    needed = required_literal(pattern)
    plain = len(needed) > 2 and needed.lower() == needed.upper() and (ord(max(needed)) < 0x600 or not ignore_case)
    return F.when(text.contains(needed), found) if plain else found


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def first_group(text: Column, patterns: list[str]) -> Column:
    """S-05: first non-blank capture over ordered patterns, case-insensitive."""
    found = []
    for pattern in patterns:
        groups = [capture(text, pattern, g) for g in range(1, group_count(pattern) + 1)]
        value = groups[0] if len(groups) == 1 else F.coalesce(*groups)
        found.append(non_blank(strip(value)))
    return F.coalesce(*found)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_match(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """An ordered CASE: the first true condition decides."""
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
