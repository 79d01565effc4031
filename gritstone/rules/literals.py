"""Literals that a pattern cannot match without: a text that has none of them is not searched."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Shorter literals stand in most texts, but for signs alone; more alternatives cost more than they save.
SHORTEST, MOST = 3, 16

Literal = tuple[str, bool]  # the text, and whether case does not matter


def needed(pattern: str) -> frozenset[Literal] | None:
    """Literals of which every match of an RE2 pattern holds at least one, or None where none are known. Those whose case
    does not matter are in lower case."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError):
        return None  # RE2 syntax that has no equal here
    found = _of(tree, bool(tree.state.flags & re.IGNORECASE))
    return found and frozenset(found)


def _of(tree, folded: bool) -> set[Literal] | None:
    found: list[set[Literal]] = []
    run: list[str] = []

    def close() -> None:
        signs = all(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in run)
        if len(run) >= (1 if signs else SHORTEST):
            found.append({("".join(run), folded and not signs)})
        run.clear()

    for op, value in tree:
        if op is K.LITERAL and (not folded or value < 128):
            run.append(chr(value).lower() if folded else chr(value))
            continue
        if op is K.AT:
            continue  # an edge has no width
        close()
        if op is K.SUBPATTERN:
            _, on, off, inner = value
            got = _of(inner, (folded or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
        elif op is K.BRANCH:
            each = [_of(x, folded) for x in value[1]]
            got = set().union(*each) if all(each) else None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
            got = _of(value[2], folded)
        else:
            got = None
        if got and len(got) <= MOST:
            found.append(got)
    close()
    return max(found, key=lambda s: (min(len(x) for x, _ in s), -len(s)), default=None)
