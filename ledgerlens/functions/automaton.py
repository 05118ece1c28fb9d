"""Many substrings at once: a multi-pattern automaton as flat arrays, run over a batch of texts in step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Automaton:
    """A complete transition table over the letters of the patterns (all others are one letter), and the patterns that end in each state."""

    def __init__(self, patterns: Sequence[str]):
        letters = sorted({c for p in patterns for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for i, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                code = int(self.letter[ord(c)])
                if code not in children[state]:
                    children[state][code] = len(children)
                    children.append({})
                    ends.append(set())
                state = children[state][code]
            ends[state].add(i)
        self.step = np.zeros((len(children), len(letters) + 1), np.int32)
        fallback, order = [0] * len(children), [0]
        for state in order:                        # breadth first: what a state falls back to is complete before it
            if state:
                self.step[state] = self.step[fallback[state]]
            for code, child in children[state].items():
                fallback[child] = int(self.step[state, code])
                ends[child] |= ends[fallback[child]]
                self.step[state, code] = child
                order.append(child)
        self.first = np.cumsum([0, *map(len, ends)])
        self.pattern = np.array([i for e in ends for i in sorted(e)], np.int32)
        self.speaks = np.diff(self.first) > 0

    def matches(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) of every pattern that occurs in a text, once each, in order."""
        codes = self.letter[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.array([len(t) for t in texts], np.int64)
        start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")   # longest first: the running ones are in front
        start, size = start[order], size[order]
        state, met = np.zeros(len(texts), np.int32), []
        if self.speaks[0]:
            met.append(np.arange(len(texts)) * len(self.step))
        for at in range(int(size.max(initial=0))):
            running = int(np.searchsorted(-size, -at, "left"))
            state[:running] = self.step[state[:running], codes[start[:running] + at]]
            said = np.flatnonzero(self.speaks[state[:running]])
            if len(said):
                met.append(order[said] * len(self.step) + state[said])
        seen = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
        text, state = np.divmod(seen, len(self.step))
        many = self.first[state + 1] - self.first[state]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([np.repeat(text, many), self.pattern[np.repeat(self.first[state], many) + inside]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]
