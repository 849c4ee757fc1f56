"""Boolean trigram queries of regular expressions.

A query is a list of alternatives, each a set of trigrams that must all occur in the lower-cased text of
any match; an empty set means that nothing is mandatory, so the rule has to scan fully.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

Query = frozenset  # of frozensets of trigrams
ANYTHING: Query = frozenset({frozenset()})
#: Strings that are followed exactly before their trigrams are taken, and alternatives of a query.
MAX_STRINGS, MAX_ALTERNATIVES = 64, 64


def tidy(query: Query) -> Query:
    """Without alternatives that another, weaker one covers."""
    if len(query) > MAX_ALTERNATIVES:
        return ANYTHING
    return frozenset(q for q in query if not any(other < q for other in query))


def both(a: Query, b: Query) -> Query:
    return tidy(frozenset(x | y for x in a for y in b))


def of_strings(strings: set[str]) -> Query:
    return tidy(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def class_members(items) -> set[str] | None:
    """Lower-cased members of a character class, or None if there are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings the sequence can match, if few; query of the sequence)."""
    strings: set[str] | None = {""}
    whole, query = True, ANYTHING
    for kind, value in nodes:
        part, needs = one(kind, value)
        if part is not None and strings is not None and len(strings) * len(part) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in part}
            continue
        query = both(both(query, of_strings(strings or {""})), ANYTHING if part is not None else needs)
        whole, strings = False, part if part is not None else {""}
    if whole:
        return strings, of_strings(strings)
    return None, both(query, of_strings(strings))


def one(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if kind is op.IN:
        return class_members(value), ANYTHING
    if kind is op.SUBPATTERN:
        return walk(value[-1])
    if kind is op.BRANCH:
        parts = [walk(branch) for branch in value[1]]
        if all(p[0] is not None for p in parts):
            union = set().union(*(p[0] for p in parts))
            return (union if len(union) <= MAX_STRINGS else None), of_strings(union)
        return None, tidy(frozenset().union(*(p[1] for p in parts)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if low == high == 1:
            return strings, query
        if strings is not None and low and len(strings) == 1 and low <= 16:
            repeated = {s * low for s in strings}
            return (repeated if low == high else None), of_strings(repeated)
        return None, query if low else ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Query:
    """Query of a pattern written for both Python and Java."""
    return walk(_parser.parse(pattern))[1]
