"""Many words at once: an automaton over characters finds all of them in one pass of a text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick

#: From so many words on the automaton is built; below, one search for each is faster. The results are the same.
FEW = 8


class Machine:
    """Where any of some words occur."""

    def __init__(self, words: Iterable[str]):
        self._automaton = ahocorasick.Automaton()
        for w in words:
            if w:
                self._automaton.add_word(w, w)
        if len(self._automaton):
            self._automaton.make_automaton()

    def starts(self, text: str) -> dict[str, list[int]]:
        """For each word that occurs its places in order, overlapping ones included."""
        out: dict[str, list[int]] = {}
        if len(self._automaton):
            for end, w in self._automaton.iter(text):
                out.setdefault(w, []).append(end - len(w) + 1)
        return out

    def any(self, text: str) -> bool:
        return bool(len(self._automaton)) and next(self._automaton.iter(text), None) is not None


@lru_cache(8)
def machine(words: tuple[str, ...]) -> Machine:
    """The worker's automaton for a list that many rows share."""
    return Machine(words)
