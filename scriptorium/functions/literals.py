"""Which of many patterns a text may match, by one pass of an automaton over literals that each pattern needs."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

#: Alternatives that a class or a group of branches may stand for in a mined literal.
WIDEST = 64
#: Letters that Python's matching without case takes for others, beyond upper and lower case.
_ALIKE = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})
_MINABLE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 _-.,;:/'\"") | frozenset(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())


def folded(text: str) -> str:
    """Lower case, so that a literal of a pattern stands in it wherever the pattern matches without case."""
    return text.translate(_ALIKE).lower()


def _joined(heads: set[str], tails: set[str]) -> set[str] | None:
    return {h + t for h in heads for t in tails} if len(heads) * len(tails) <= WIDEST else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer; of equal ones the smaller."""
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if rank(a) >= rank(b) else b


def _letters(items: list) -> set[str] | None:
    """What a character class may match, if it is a few minable letters."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(folded(chr(value)))
        elif op is sre.RANGE and value[1] - value[0] < WIDEST:
            out |= {folded(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if out and all(c in _MINABLE for c in out) else None


def _mined(parsed) -> set[str] | None:
    """Literals of which one stands in every match, or None. Runs of letters are kept together; what isn't plain ends a run."""
    best, run = None, {""}

    def close() -> None:
        nonlocal best, run
        best, run = _better(best, run if all(run) else None), {""}

    for op, value in parsed:
        own = None
        if op is sre.LITERAL and folded(chr(value)) in _MINABLE:
            own = {folded(chr(value))}
        elif op is sre.IN:
            own = _letters(value)
        if own is not None:
            longer = _joined(run, own)
            if longer is None:
                close()
                longer = own
            run = longer
            continue
        if op is sre.AT:
            continue
        close()
        if op is sre.SUBPATTERN:
            best = _better(best, _mined(value[3]))
        elif op is sre.BRANCH:
            each = [_mined(b) for b in value[1]]
            if all(each) and sum(map(len, each)) <= WIDEST:
                best = _better(best, set().union(*each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            best = _better(best, _mined(value[2]))
        elif op is sre.ATOMIC_GROUP:
            best = _better(best, _mined(value))
    close()
    return best


def needed(pattern: str) -> set[str] | None:
    """Folded literals of which one stands in the folded text of every match of a pattern without case; None if there is no such set."""
    return _mined(_parser.parse(pattern, re.IGNORECASE))


class Candidates:
    """Numbers of the patterns that may match a text: those one of whose literals stands in it, and those without literals. Patterns have to compile."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.always, owners = [], {}
        for i, p in enumerate(patterns):
            literals = needed(p)
            if literals is None:
                self.always.append(i)
            for literal in literals or ():
                owners.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton() if owners else None
        for literal, own in owners.items():
            self.automaton.add_word(literal, own)
        if self.automaton is not None:
            self.automaton.make_automaton()

    def of(self, text: str) -> list[int]:
        found = set(self.always)
        if self.automaton is not None:
            for _, own in self.automaton.iter(folded(text)):
                found.update(own)
        return sorted(found)
