"""Minimal acyclic acceptors of word lists, composed with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Acceptor:
    """Minimal deterministic acceptor of a sorted list of distinct strings.

    States are numbers; equal right languages share one. A string's state is fixed as
    soon as a later string leaves it, so building needs the strings in code-point order.
    """

    def __init__(self, strings: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def close(arcs: dict[str, int], final: bool) -> int:
            mark = (final, *arcs.items())
            state = known.get(mark)
            if state is None:
                state = known[mark] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return state

        open_arcs: list[dict[str, int]] = [{}]
        open_final = [False]
        last = ""

        def shorten(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                state = close(open_arcs.pop(), open_final.pop())
                open_arcs[-1][last[len(open_arcs) - 1]] = state

        for text in strings:
            same = 0
            while same < len(last) and same < len(text) and last[same] == text[same]:
                same += 1
            shorten(same)
            for _ in range(len(text) - same):
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = text
        shorten(0)
        self.start = close(open_arcs.pop(), open_final.pop())


class OneEdit:
    """The composition acceptor, exactly one edit, acceptor.

    Its states are pairs of acceptor states, with or without the edit behind them. Before
    the edit both are the same state, since both strings are so far the same; after it the
    pair accepts what both accept. Pairs that accept nothing are left out. Nothing here
    recurses, so strings may have any length.
    """

    def __init__(self, acceptor: Acceptor):
        self.arcs, self.final, self.start = acceptor.arcs, acceptor.final, acceptor.start
        self._pairs: dict[tuple[int, int], list[tuple[str, tuple[int, int]]] | None] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}

    def _onward(self, pair: tuple[int, int]) -> list[tuple[str, tuple[int, int]]]:
        """Letters that both states read, and the pairs that they lead to."""
        left, right = self.arcs[pair[0]], self.arcs[pair[1]]
        if len(right) < len(left):
            left, right = right, left
        return [(a, tuple(sorted((p, right[a])))) for a, p in left.items() if a in right]

    def _solve(self, pair: tuple[int, int]) -> bool:
        """Whether both states accept some string; keeps the arcs to such pairs."""
        solved = self._pairs
        stack = [pair]
        while stack:
            top = stack[-1]
            if top in solved:
                stack.pop()
                continue
            arcs = self._onward(top)
            if top[0] != top[1]:
                open_pairs = [to for _, to in arcs if to not in solved]
                if open_pairs:
                    stack.extend(open_pairs)
                    continue
                arcs = [(a, to) for a, to in arcs if solved[to] is not None]
            both = self.final[top[0]] and self.final[top[1]]
            solved[top] = arcs if arcs or both else None
            stack.pop()
        return solved[pair] is not None

    def common(self, p: int, q: int) -> Iterator[str]:
        """Strings that lead from both states to acceptance."""
        pair = (p, q) if p < q else (q, p)
        if not self._solve(pair):
            return
        path: list[str] = []
        stack = [(pair, 0, "")]
        while stack:
            pair, depth, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            path.append(letter)
            if self.final[pair[0]] and self.final[pair[1]]:
                yield "".join(path)
            if pair not in self._pairs:
                self._solve(pair)
            stack.extend((to, depth + 1, a) for a, to in self._pairs[pair])

    def edits(self, p: int) -> list[tuple[str, str]]:
        """String pairs from ``p`` whose first letters differ and that are one edit apart.

        A replaced letter gives a pair once; a deleted one stands in the first string.
        """
        found = self._edits.get(p)
        if found is None:
            found = []
            arcs = list(self.arcs[p].items())
            for i, (a, state) in enumerate(arcs):
                for b, other in arcs[i + 1 :]:
                    found.extend((a + end, b + end) for end in self.common(state, other))
                # a string without its first letter, if that does not begin with the same one
                found.extend((a + end, end) for end in self.common(state, p) if end[:1] != a)
            self._edits[p] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every unordered pair of accepted strings one edit apart, once."""
        path: list[str] = []
        stack = [(self.start, 0, "")]
        while stack:
            state, depth, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            path.append(letter)
            edits = self.edits(state)
            if edits:
                before = "".join(path)
                for x, y in edits:
                    yield before + x, before + y
            stack.extend((to, depth + 1, a) for a, to in self.arcs[state].items())
