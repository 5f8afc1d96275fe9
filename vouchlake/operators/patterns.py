"""Many patterns at once: which few rules are worth running on a text.

Of most patterns it is known, from the pattern alone, that each match holds one of a few
literal strings. One automaton over all rules' literals reads a text once and names the
rules that can match there; only these are run, as Java expressions. A match stands
between separators, so that a literal at its start or end takes its separator with it.
Rules without such literals, or in a syntax that is not understood here, are run on every
text. Letter case is passed over when looking for literals, so that no match is lost.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand around a match.
SEPARATOR = "[ ,;\\[\\]”\"')(.]"
#: A separator, or an end of the text, as the automaton reads it.
EDGE = "\0"
_EDGES = str.maketrans(dict.fromkeys(" ,;[]”\"')(.\r\n\x85\u2028\u2029\0", EDGE))


def edged(text: str) -> str:
    return text.lower().translate(_EDGES)


def _better(one: frozenset[str] | None, other: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest literal is longer; of such the smaller one."""
    if not one or not other:
        return one or other
    rank = lambda s: (-min(map(len, s)), len(s), sorted(s))
    return min(one, other, key=rank)


def _required(parsed: list) -> frozenset[str] | None:
    """Strings one of which is in every match of a parsed sequence; None if unknown."""
    best, run = None, ""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        best, run = _better(best, frozenset([edged(run)]) if run else None), ""
        inner = None
        if name == "SUBPATTERN":
            inner = _required(value[-1])
        elif name == "ATOMIC_GROUP":
            inner = _required(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            inner = _required(value[2])
        elif name == "BRANCH":
            ways = [_required(branch) for branch in value[1]]
            inner = frozenset().union(*ways) if all(ways) else None
        best = _better(best, inner)
    return _better(best, frozenset([edged(run)]) if run else None)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Strings one of which is in every match between its separators, as `edged` writes them; None if unknown."""
    parser = re._parser  # the only reader of expressions at hand
    try:
        edge = [(parser.LITERAL, 0)]
        found = _required(edge + list(parser.parse(pattern)) + edge)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if EDGE in found else found


def promising(patterns: list[str]) -> Callable[[Column], Column]:
    """A column function: the numbers of the patterns that can match a text, ascending."""
    by_literal, always = defaultdict(list), []
    for i, p in enumerate(patterns):
        literals = required_literals(p)
        for s in literals or ():
            by_literal[s].append(i)
        if not literals:
            always.append(i)

    @F.pandas_udf("array<int>")
    def pick(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s, rules in by_literal.items():
            automaton.add_word(s, s)
        automaton.make_automaton()
        for texts in parts:
            out = []
            for t in texts:
                found = {s for _, s in automaton.iter(f"{EDGE}{edged(t)}{EDGE}")} if t and by_literal else ()
                out.append(sorted({*always, *(i for s in found for i in by_literal[s])}))
            yield pd.Series(out, dtype=object)

    return pick


def matches(body: Column, pattern: Column) -> Column:
    """The pattern's matches between separators; a separator belongs to one match only."""
    return F.regexp_extract_all(body, F.concat(F.lit(f"(?:^|{SEPARATOR})("), pattern, F.lit(f")(?:$|{SEPARATOR})")), F.lit(1))
