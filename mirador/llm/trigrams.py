"""Boolean trigram queries of regular expressions (after Cox, "Regular Expression Matching with a Trigram Index", 2012).

A query is True (any text may match), or a frozenset of alternatives, each a frozenset of trigrams that must all occur.
Only what every match must contain is asked for, so a text that fails the query holds no match. Letters are folded to lower
case (A-Z only), for texts are indexed that way.
"""

from __future__ import annotations

from re import _constants as c
from re import _parser as parser

#: Sets of strings larger than these are cut to their trigrams and started anew.
MOST_EXACT, MOST_ALTERNATIVES, MOST_CLASS = 16, 64, 8


def trigram_query(pattern: str) -> bool | frozenset[frozenset[str]]:
    exact, need = _of(parser.parse(pattern))
    return _and(need, _any(exact)) if exact is not None else need


def _fold(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(strings: set[str]) -> bool | frozenset:
    """Some of the strings occurs."""
    found = frozenset(_grams(s) for s in strings)
    return True if not strings or frozenset() in found else _least(found)


def _least(alternatives: frozenset) -> frozenset:
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _and(x: bool | frozenset, y: bool | frozenset) -> bool | frozenset:
    if x is True or y is True:
        return y if x is True else x
    both = _least(frozenset(a | b for a in x for b in y))
    return both if len(both) <= MOST_ALTERNATIVES else x  # either side alone is still necessary


def _or(x: bool | frozenset, y: bool | frozenset) -> bool | frozenset:
    if x is True or y is True:
        return True
    both = _least(x | y)
    return both if len(both) <= MOST_ALTERNATIVES else True


def _of(items) -> tuple[set[str] | None, bool | frozenset]:
    """(all strings that the expression can be, if they are few, else None; the query of what else it must contain)."""
    run: set[str] = {""}  # what the last items spelled out can be
    need: bool | frozenset = True
    whole = True
    for op, arg in items:
        exact, own = _item(op, arg)
        need = _and(need, own)
        if exact is None or len(run) * len(exact) > MOST_EXACT:
            need = _and(need, _any(run))
            run, whole = exact if exact is not None else {""}, False
        else:
            run = {a + b for a in run for b in exact}
    return (run, need) if whole else (None, _and(need, _any(run)))


def _item(op, arg) -> tuple[set[str] | None, bool | frozenset]:
    if op is c.LITERAL:
        return {_fold(arg)}, True
    if op is c.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is c.LITERAL:
                chars.add(_fold(x))
            elif kind is c.RANGE and x[1] - x[0] < MOST_CLASS:
                chars |= {_fold(k) for k in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= MOST_CLASS else (None, True)
    if op is c.SUBPATTERN:
        return _of(arg[-1])
    if op is c.BRANCH:
        parts = [_of(b) for b in arg[1]]
        if all(e is not None and n is True for e, n in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*(e for e, _ in parts)), True
        need: bool | frozenset = frozenset()
        for e, n in parts:
            need = _or(need, _and(n, _any(e)) if e is not None else n)
        return None, need
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, body = arg
        exact, need = _of(body)
        if low == 0 and high == 1 and exact is not None and need is True:
            return exact | {""}, True
        if low == 0:
            return None, True
        if low == high and exact is not None and need is True and len(exact) ** low <= MOST_EXACT:
            strings = {""}
            for _ in range(low):
                strings = {a + b for a in strings for b in exact}
            return strings, True
        return None, _and(need, _any(exact)) if exact is not None else need
    if op is c.AT:
        return {""}, True
    return None, True
