"""Boolean trigram queries of regular expressions.

`query` reads a pattern's syntax tree and returns what any match must contain, as a
disjunction of conjunctions: a list of sets of lower-case trigrams, one of which is
in every matching text as a whole. None means that no trigram is mandatory.
"""

from __future__ import annotations

import re._parser as syntax

MOST_STRINGS, MOST_SETS = 48, 64

Sets = frozenset  # of frozensets of trigrams: any of them, wholly
ANYTHING: frozenset = frozenset([frozenset()])


def _grams(text: str) -> frozenset:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(sets) -> frozenset:
    """Without sets that hold another one: that one says as much."""
    own = sorted(set(sets), key=len)
    return frozenset(s for i, s in enumerate(own) if not any(t < s for t in own[:i]))


def _both(a: frozenset, b: frozenset) -> frozenset:
    out = _least(x | y for x in a for y in b)
    return out if len(out) <= MOST_SETS else a


def _of_strings(strings: frozenset) -> frozenset:
    return _least(map(_grams, strings))


def _class(items) -> frozenset | None:
    chars = set()
    for op, value in items:
        if op is syntax.LITERAL:
            chars.add(chr(value))
        elif op is syntax.RANGE and value[1] - value[0] < 6:
            chars.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return frozenset(c.lower() for c in chars) if len(chars) <= 6 else None


def _exact(items) -> frozenset | None:
    """All strings that a sequence matches, lower case, or None if they are too many."""
    out = frozenset([""])
    for op, value in items:
        if op is syntax.LITERAL:
            own = frozenset([chr(value).lower()])
        elif op is syntax.IN:
            own = _class(value)
        elif op is syntax.SUBPATTERN:
            own = _exact(value[3])
        elif op is syntax.BRANCH:
            each = [_exact(b) for b in value[1]]
            own = None if None in each else frozenset().union(*each)
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[1] <= 3:
            one, own = _exact(value[2]), frozenset()
            if one is None or len(one) ** value[1] > MOST_STRINGS:
                return None
            for k in range(value[0], value[1] + 1):
                times = frozenset([""])
                for _ in range(k):
                    times = frozenset(a + b for a in times for b in one)
                own |= times
        elif op is syntax.AT:
            own = frozenset([""])
        else:
            own = None
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _sequence(items) -> frozenset:
    found, run = ANYTHING, frozenset([""])
    for item in items:
        own = _exact([item])
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in own)
            continue
        found = _both(found, _of_strings(run))
        run = frozenset([""]) if own is None else own
        if own is None:
            op, value = item
            if op is syntax.SUBPATTERN:
                found = _both(found, _sequence(value[3]))
            elif op is syntax.BRANCH:
                found = _both(found, _least(s for b in value[1] for s in _sequence(b)))
            elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] > 0:
                found = _both(found, _sequence(value[2]))
    return _both(found, _of_strings(run))


def query(pattern: str) -> list[frozenset] | None:
    found = _sequence(syntax.parse(pattern))
    return None if frozenset() in found else sorted(found, key=sorted)
