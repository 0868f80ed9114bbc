"""Boolean trigram queries from regular expressions.

A query is a conjunction of clauses, a clause a list of alternatives, an alternative a
set of trigrams of the lower-cased text that must all occur.  A regular expression
without a mandatory trigram has no clauses.  The standard library's pattern parser
reads the expression; only literals, small classes, optional parts and alternatives
become strings, everything else separates them.
"""

from __future__ import annotations

from itertools import product

try:  # the parser's name since Python 3.11
    from re import _constants as c
    from re import _parser as parser
except ImportError:
    import sre_constants as c
    import sre_parse as parser

MOST = 32
Clause = list[frozenset]


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses of ``pattern``, without duplicates."""
    clauses, run = _sequence(parser.parse(pattern))
    return _unique([*clauses, *_clause(run)])


def _unique(clauses: list[Clause]) -> list[Clause]:
    out: list[Clause] = []
    for clause in clauses:
        if clause not in out:
            out.append(clause)
    return out


def _clause(strings: set[str]) -> list[Clause]:
    """The clause "one of these strings occurs"; none if one of them is too short to say anything."""
    if not strings or any(len(s) < 3 for s in strings):
        return []
    return [sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)]


def _sequence(items) -> tuple[list[Clause], set[str]]:
    """Clauses of the closed runs of a concatenation, and the strings of the run that is still open."""
    clauses: list[Clause] = []
    run = {""}
    for op, value in items:
        strings = _exact(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        inner, opened = _inexact(op, value)
        if op is c.SUBPATTERN or (op is c.MAX_REPEAT and value[0] > 0):
            # the strings before and in it are not joined: what each says alone still holds
            inner = [*inner, *_clause(opened)]
        clauses += [*_clause(run), *inner]
        run = {""}
    return clauses, run


def _exact(op, value) -> set[str] | None:
    """All strings an element stands for, lower-cased, if they are few."""
    if op is c.LITERAL:
        return {chr(value).lower()}
    if op is c.AT:
        return {""}
    if op is c.IN:
        found: set[str] = set()
        for kind, v in value:
            if kind is c.LITERAL:
                found.add(chr(v).lower())
            elif kind is c.RANGE and v[1] - v[0] < MOST:
                found |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is c.SUBPATTERN:
        return _all(value[3])
    if op is c.BRANCH:
        parts = [_all(b) for b in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, body = value
        inner = _all(body)
        if inner is None or high is c.MAXREPEAT or high > 8:
            return None
        found = set()
        for n in range(low, high + 1):
            found |= {"".join(p) for p in product(inner, repeat=n)} if len(inner) ** n <= MOST else {None}
        return None if None in found or len(found) > MOST else found
    return None


def _all(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        strings = _exact(op, value)
        if strings is None or len(out) * len(strings) > MOST:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def _inexact(op, value) -> tuple[list[Clause], set[str]]:
    if op is c.SUBPATTERN:
        clauses, run = _sequence(value[3])
        return clauses, run
    if op is c.BRANCH:
        alternatives: Clause = []
        for body in value[1]:
            clauses, run = _sequence(body)
            clauses = [*clauses, *_clause(run)]
            if not clauses:
                return [], set()
            # one alternative may have several ways: each way of its first clause, with single ways of the others
            single = frozenset().union(*(x[0] for x in clauses[1:] if len(x) == 1))
            alternatives += [a | single for a in clauses[0]]
        return [sorted(set(alternatives), key=sorted)], set()
    if op is c.MAX_REPEAT and value[0] > 0:
        return _sequence(value[2])
    return [], set()
