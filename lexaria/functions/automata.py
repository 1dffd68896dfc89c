"""Automata on sequences: longest common runs by a suffix automaton, many terms at once by Aho and Corasick's.

Both work on lists of hashable symbols (tokens or numbers) and take time linear in
them, but for the levels of the alignment (see ``matching_runs``).
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """The automaton of all runs of one sequence."""

    def __init__(self, sequence: Sequence[Hashable]):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        last = 0
        for symbol in sequence:
            new = self._state({}, self.size[last] + 1)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            self.link[new] = 0 if at < 0 else self._split(at, symbol)
            last = new

    def _state(self, edges: dict, size: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, symbol: Hashable) -> int:
        """The state of the run that ends at with the symbol, on its own if longer runs share its state."""
        to = self.next[at][symbol]
        if self.size[to] == self.size[at] + 1:
            return to
        copy = self._state(dict(self.next[to]), self.size[at] + 1)
        self.link[copy], self.link[to] = self.link[to], copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def walk(self, sequence: Iterable[Hashable], most: int | None = None) -> Iterator[tuple[int, int]]:
        """After each symbol: the state of the longest run (of at most so many symbols) that ends there, and its length."""
        state = length = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            if most is not None and length > most:
                length = most
            while state and self.size[self.link[state]] >= length:
                state = self.link[state]
            yield state, length


def _longest_chain(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """The longest common runs of a and b, each after the one before on both sides: the first in a, and of its places in b the first, then on."""
    automaton = SuffixAutomaton(b)
    states = list(automaton.walk(a))
    size = max((n for _, n in states), default=0)
    if not size:
        return []
    ends = [(i, s) for i, (s, n) in enumerate(states) if n == size]
    wanted = {s for _, s in ends}
    places: dict[int, list[int]] = defaultdict(list)
    for j, (s, n) in enumerate(automaton.walk(b, size)):
        if n == size and s in wanted:
            places[s].append(j - size + 1)
    out, i_free, j_free = [], 0, 0
    for end, s in ends:
        i = end - size + 1
        if i >= i_free:
            at = bisect_left(places[s], j_free)
            if at < len(places[s]):
                out.append((i, places[s][at], size))
                i_free, j_free = i + size, places[s][at] + size
    return out


def matching_runs(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """Runs (i, j, n) that both have, by longest match first (ties: first in a, then in b), and what lies on either side likewise; an empty run ends the list.

    All runs of the greatest length that follow one another are taken at once, so each level of
    the search has shorter runs than the one above and looks at each symbol once.
    """
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        if i == i_end or j == j_end:
            continue
        x, y = a[i:i_end], b[j:j_end]
        if set(x).isdisjoint(y):
            continue
        for p, q, n in [*_longest_chain(x, y), (i_end, j_end, 0)]:
            if n:
                p, q = p + i_end - len(x), q + j_end - len(y)
                found.append((p, q, n))
            open_.append((i, p, j, q))
            i, j = p + n, q + n
    out: list[tuple[int, int, int]] = []
    for p, q, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == p and out[-1][1] + out[-1][2] == q:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((p, q, n))
    return [*out, (len(a), len(b), 0)]


#: Symbols of a text: a run of white space and hyphens, a word, or a mark.
FLEXIBLE = re.compile(r"([\s-]+)|\w+|[^\w\s-]")
#: The same, with every character that is no part of a word by itself.
EXACT = re.compile(r"(?!)()|\w+|\W", re.DOTALL)


class TermIndex:
    """Whole terms in a text, all in one pass; case doesn't count.

    A term has no word character on either side.  Where ``flexible``, white space and
    hyphens stand for one another, in runs of any length; terms lose such at
    their ends.  The automaton lies in arrays, so that it is small to send.
    """

    def __init__(self, terms: Sequence[str], flexible: bool = True):
        self.pattern = FLEXIBLE if flexible else EXACT
        self.number: dict[str, int] = {" ": 0} if flexible else {}
        edges: list[dict[int, int]] = [{}]
        self.term, self.size = array("q", [-1]), array("q", [0])
        self.of: list[int] = []
        known: dict[int, int] = {}
        for t in terms:
            state = 0
            for symbol, _, _ in self._symbols(t.strip(" \t\n\r\f\v-") if flexible else t, grow=True):
                state = self._child(edges, state, symbol)
            self.of.append(known.setdefault(state, len(known)) if state else -1)
            if state:
                self.term[state] = known[state]
        self._link(edges)

    def _symbols(self, text: str, grow: bool = False) -> Iterator[tuple[int, int, int]]:
        for m in self.pattern.finditer(text):
            key = " " if m[1] else m[0].lower()
            if grow:
                self.number.setdefault(key, len(self.number))
            yield self.number.get(key, -1), m.start(), m.end()

    def _child(self, edges: list[dict[int, int]], state: int, symbol: int) -> int:
        if symbol not in edges[state]:
            edges[state][symbol] = len(edges)
            edges.append({})
            self.term.append(-1)
            self.size.append(self.size[state] + 1)
        return edges[state][symbol]

    def _link(self, edges: list[dict[int, int]]) -> None:
        """Where to go on when a symbol doesn't fit, and the next shorter term that ends at a state too."""
        self.fail, self.shorter = array("q", [0]) * len(edges), array("q", [0]) * len(edges)
        queue = list(edges[0].values())
        for state in queue:
            for symbol, child in edges[state].items():
                at = self.fail[state]
                while at and symbol not in edges[at]:
                    at = self.fail[at]
                self.fail[child] = edges[at].get(symbol, 0)
                queue.append(child)
            back = self.fail[state]
            self.shorter[state] = back if self.term[back] >= 0 else self.shorter[back]
        width = len(self.number)
        flat = sorted((state * width + symbol, child) for state, out in enumerate(edges) for symbol, child in out.items())
        self.keys, self.values = array("q", (k for k, _ in flat)), array("q", (v for _, v in flat))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "goto"}

    def bytes(self) -> int:
        """What the arrays and the symbols take, about."""
        return 8 * (len(self.keys) + len(self.values) + 4 * len(self.fail)) + sum(60 + 4 * len(k) for k in self.number)

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term among the distinct ones), by end, of all places, those that overlap too."""
        if "goto" not in self.__dict__:
            self.goto = dict(zip(self.keys, self.values, strict=True))
        goto, fail, term, shorter, size, width = self.goto, self.fail, self.term, self.shorter, self.size, len(self.number)
        state, starts = 0, []
        for symbol, start, end in self._symbols(text):
            starts.append(start)
            if symbol < 0:
                state = 0
                continue
            while state and state * width + symbol not in goto:
                state = fail[state]
            state = goto.get(state * width + symbol, 0)
            at = state if term[state] >= 0 else shorter[state]
            while at:
                first = starts[len(starts) - size[at]]
                if not _word(text, first - 1) and not _word(text, end):
                    yield first, end, term[at]
                at = shorter[at]

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """The same without those that overlap an earlier place of the same term, as a search for each term would find them."""
        free: dict[int, int] = {}
        out = []
        for start, end, term in self.occurrences(text):
            if start >= free.get(term, 0):
                free[term] = end
                out.append((start, end, term))
        return out

    def found(self, text: str) -> set[int]:
        return {t for _, _, t in self.occurrences(text)}


def _word(text: str, at: int) -> bool:
    """Whether there is a word character at a place."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
