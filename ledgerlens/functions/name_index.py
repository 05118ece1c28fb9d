"""Names of several words found in sentences: flat arrays over the words of the names, run over a batch of sentences at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.functions.automaton import Automaton

#: Cells (sentence, name) or (sentence, word) that are looked at in one step.
CELLS = 4_000_000


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``of``, index) of every entry of the lists ``of``; list i is first[i]..first[i + 1]."""
    many = first[of + 1] - first[of]
    at = np.repeat(np.arange(len(of)), many)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many - first[of], many)


def _lists(owner: np.ndarray, value: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each owner, one list after the other, and where they begin."""
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]).astype(np.int64), value[order]


class NameIndex:
    """``names``: (name, its words by spaces).  A word is in a sentence iff it is in one of its tokens; an automaton of
    all words reads the different tokens of a batch.  A match holds at least m of a name's k words, so one of any
    k - m + 1: the rarest of the batch make candidates."""

    def __init__(self, names: Sequence[tuple[str, str]], ratio: float):
        self.names, self.clean = pa.array([n for n, _ in names], pa.string()), [c for _, c in names]
        split = [c.split(" ") for c in self.clean]
        words = sorted({w for ws in split for w in ws})
        known = {w: i for i, w in enumerate(words)}
        self.words, self.automaton = len(words), Automaton(words)
        self.size = np.array([len(ws) for ws in split], np.int64)
        self.of_name = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.name_word = np.array([known[w] for ws in split for w in ws], np.int64)
        self.least = np.where(self.size > 1, self.size * ratio, self.size)      # words that a match holds
        self.probes = self.size + 1 - np.ceil(self.least - 1e-9).astype(np.int64)

    def matches(self, sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, name, direct) of every match: the whole name is in the sentence (direct), or enough of its words."""
        step = max(1, CELLS // max(len(self.clean), self.words, 1))
        parts = [self._matches(sentences.slice(a, step), a) for a in range(0, len(sentences), step)]
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(p) for p in zip((none, none, none.astype(bool)), *parts))

    def _matches(self, sentences: pa.Array, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = pc.split_pattern(sentences, " ")
        tokens = pc.list_flatten(split).dictionary_encode()
        token, word = self.automaton.matches(tokens.dictionary.to_pylist())
        in_token = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens.dictionary)))]).astype(np.int64)
        at, i = _spread(in_token, tokens.indices.to_numpy().astype(np.int64))
        met = np.zeros((len(sentences), self.words), bool)
        met[pc.list_parent_indices(split).to_numpy()[at], word[i]] = True
        row, word = np.nonzero(met)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((self.name_word, np.bincount(word, minlength=self.words)[self.name_word], owner))
        rare = np.arange(len(owner)) - self.of_name[owner] < self.probes[owner]      # of each name's words, rarest first
        by_word, probe = _lists(self.name_word[order][rare], owner[rare], self.words)
        at, i = _spread(by_word, word)
        candidate = np.zeros((len(sentences), len(self.clean)), bool)
        candidate[row[at], probe[i]] = True
        row, name = np.nonzero(candidate)
        at, i = _spread(self.of_name, name)
        hits = np.bincount(at[met[row[at], self.name_word[i]]], minlength=len(row))
        size, few = self.size[name], (self.size[name] > 1) & (hits >= self.least[name])
        direct, texts = np.zeros(len(row), bool), sentences.to_pylist()
        whole = np.flatnonzero(hits == size)
        direct[whole] = [self.clean[n] in texts[r] for r, n in zip(row[whole].tolist(), name[whole].tolist())]
        keep = direct | few
        return row[keep] + base, name[keep], direct[keep]
