"""Levenshtein automaton of a whole lexicon: its trie and the edit automaton, run as one.

A state is a set of (trie node, edits so far).  States and their transitions are
made when first met and kept, so matching a word is a walk over ready
transitions, and most words leave the automaton after a few letters.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Look-alike characters that count as the letter that they stand for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """``words`` match whole words, ``stems`` match word beginnings; both with a few edits by length."""

    MAX_STATES = 50_000

    def __init__(self, words: Iterable[str], stems: Iterable[str] = (), exact: frozenset[str] = frozenset()):
        """``exact``: terms that match without edits only."""
        self.exact = exact
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]  # (term, is a stem)
        self.room = [0]  # most edits that a term below the node allows
        for terms, stem in ((words, False), (stems, True)):
            for term in terms:
                node, k = 0, self.allowed(term)
                self.room[0] = max(self.room[0], k)
                for c in term:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.ends.append(None)
                        self.room.append(0)
                    node = self.child[node][c]
                    self.room[node] = max(self.room[node], k)
                if self.ends[node] is None or stem:
                    self.ends[node] = (term, stem)
        self._clear()

    def allowed(self, term: str) -> int:
        return 0 if term in self.exact else edits_allowed(term)

    def _clear(self) -> None:
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.known: dict[tuple[tuple[int, int], ...], int] = {}
        self.step: list[dict[str, int]] = []
        self.whole: list[tuple[int, str] | None] = []
        self.begun: list[tuple[int, str] | None] = []
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of nodes (node: least edits), closed under leaving out letters of a term; -1 for none."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if e > nodes[node]:
                continue
            for kid in self.child[node].values():
                if e < self.room[kid] and e + 1 < nodes.get(kid, 99):
                    nodes[kid] = e + 1
                    todo.append((kid, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            best: list[tuple[int, str] | None] = [None, None]
            for node, e in key:
                end = self.ends[node]
                if end and e <= self.allowed(end[0]):
                    for i in (0, 1) if end[1] else (0,):
                        best[i] = min(best[i] or (99, ""), (e, end[0]))
            self.whole.append(best[0])
            self.begun.append(best[1])
        return self.known[key]

    def _next(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.room[node]:
                nodes[node] = min(nodes.get(node, 99), e + 1)  # a letter too many
            for letter, kid in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.room[kid]:
                    nodes[kid] = min(nodes.get(kid, 99), cost)
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that the word is, or begins with; None if none is near enough."""
        if len(self.sets) > self.MAX_STATES:
            self._clear()
        state, best = 0, None
        for c in word:
            ready = self.step[state]
            to = ready.get(c)
            if to is None:
                to = ready[c] = self._next(state, c)
            if to < 0:
                return best
            state = to
            if self.begun[state] and (best is None or self.begun[state] < best):
                best = self.begun[state]
        if self.whole[state] and (best is None or self.whole[state] < best):
            best = self.whole[state]
        return best
