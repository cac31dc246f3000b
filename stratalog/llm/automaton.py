"""Suffix automata over words, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """The suffix automaton of some word sequences (no match crosses from one to another).

    Words are any hashable values. ``low`` of a state is the least owner of the sequences that
    hold the state's substrings.
    """

    def __init__(self, sequences: Iterable[tuple[int, Sequence]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [1 << 63]
        for owner, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w, owner)
        # A substring lies in all the sequences that its longer ones lie in.
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.low[up] = min(self.low[up], self.low[s])

    def _state(self, length: int, link: int, follow: dict, low: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.low.append(low)
        return len(self.link) - 1

    def _split(self, p: int, w, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 1 << 63)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w, owner: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            # The sequence so far is already a substring: generalised automata add no state here.
            s = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
            self.low[s] = min(self.low[s], owner)
            return s
        s = self._state(self.length[last] + 1, 0, {}, owner)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = s
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return s

    def statistics(self, words: Sequence) -> list[tuple[int, int]]:
        """For each place, (state, length) of the longest match that ends there."""
        out, state, length, follow = [], 0, 0, self.next
        for w in words:
            to = follow[state].get(w)
            while to is None and state:
                state = self.link[state]
                length = self.length[state]
                to = follow[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append((state, length))
        return out

    def windows_before(self, words: Sequence, size: int, owner: int) -> list[int]:
        """Starts of the windows of ``size`` words that are also in a sequence of a lesser owner."""
        return [i for a, b in self.runs_before(words, size, owner) for i in range(a, b + 1)]

    def runs_before(self, words: Sequence, size: int, owner: int) -> list[tuple[int, int]]:
        """Maximal runs of such starts, as the first and the last one."""
        found: list[list[int]] = []
        length_of, link, low = self.length, self.link, self.low
        for end, (state, length) in enumerate(self.statistics(words), 1):
            if length < size:
                continue
            while length_of[link[state]] >= size:
                state = link[state]
            if low[state] < owner:
                start = end - size
                if found and found[-1][1] == start - 1:
                    found[-1][1] = start
                else:
                    found.append([start, start])
        return [(a, b) for a, b in found]
