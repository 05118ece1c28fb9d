"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both sides and labels every
position; its state starts anew at each word, so equal words are run once.  A
document's probabilities are the mean over all its positions, of which those with
a byte that training never saw speak for no language.  It is trained in
numpy by backpropagation through time on the words of a bounded sample of
documents; a position's target is how often each language has its word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import crc_mod, slices, stored, texts

#: Bounds of the training sample, dealt evenly to the languages: documents, and words with their counts.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 4096, 40_000
WIDTH, EMBEDDING, EPOCHS, BATCH, RATE = 16, 12, 4, 128, 0.01
#: Bytes of a word that run together; longer words run in stretches.
STRETCH = 48
CACHE_PIECES = 200_000
UNKNOWN = "und"
_EDGE = 0x20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGRU:
    """Gates update, reset, new; one set of weights for each direction; a softmax over both states at each position."""

    def __init__(self, languages: list[str], seed: int = 5):
        self.languages, rng = list(languages), np.random.default_rng(seed)
        n, h = len(self.languages), WIDTH
        self.seen = np.ones(256, bool)  # bytes that speak for a language
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"E": small(256, EMBEDDING) * 4, "V": small(2 * h, n), "c": np.zeros(n, np.float32)}
        for d in "fb":
            self.w |= {f"W{d}": small(EMBEDDING, 3 * h), f"U{d}": small(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over bytes x (T, B); positions outside the mask keep the state."""
        h, w = WIDTH, self.w
        table = w["E"] @ w[f"W{d}"] + w[f"b{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, u = table[x[t]], state @ w[f"U{d}"]
            zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
            if keep is not None:
                keep.append((t, state, z, r, new, u[:, 2 * h:]))
            state = np.where(mask[t][:, None], new + z * (state - new), state)
            out[t] = state
        return out

    def _softmax(self, both: np.ndarray) -> np.ndarray:
        logits = both @ self.w["V"] + self.w["c"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions (target by word, B x L; weight by word), and its gradients."""
        h, kept = WIDTH, {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], axis=2)
        p = self._softmax(both)
        share = (mask * weight).astype(np.float32)
        share /= share.sum()
        loss = float(-(share[..., None] * target * np.log(p + 1e-9)).sum())
        dlogits = (p - target) * share[..., None]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["V"] = np.einsum("tbh,tbl->hl", both, dlogits)
        grads["c"] = dlogits.sum((0, 1))
        dboth = dlogits @ self.w["V"].T
        for d, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dtable = np.zeros((256, 3 * h), np.float32)
            U, carried = self.w[f"U{d}"], np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, new, un in reversed(kept[d]):
                carried = carried + dboth[t][:, cut]
                live = np.where(mask[t][:, None], carried, 0)
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (state - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.concatenate([dz, dr, dnew * r], axis=1)
                dg = np.concatenate([dz, dr, dnew], axis=1)
                grads[f"U{d}"] += state.T @ du
                np.add.at(dtable, x[t], dg)
                carried = np.where(mask[t][:, None], live * z + du @ U.T, carried)
            grads[f"b{d}"] = dtable.sum(0)
            grads[f"W{d}"] = self.w["E"].T @ dtable
            grads["E"] += dtable @ self.w[f"W{d}"].T
        return loss, grads

    def fit(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over batches of words of like length; the rate falls to a tenth."""
        rng, losses = np.random.default_rng(seed), []
        order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])), dtype=np.int64)
        batches = [order[i: i + BATCH] for i in range(0, len(order), BATCH)]
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        step, steps = 0, max(1, epochs * len(batches))
        for _ in range(epochs):
            total = 0.0
            for b in rng.permutation(len(batches)):
                rows = batches[b]
                x, mask = padded([words[i] for i in rows])
                loss, grads = self.gradients(x, mask, target[rows], weight[rows])
                total += loss
                step += 1
                rate = RATE * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(batches)))
        return losses

    def positions(self, words: list[bytes]) -> np.ndarray:
        """For each word, the sums over its positions with seen bytes of the languages' probabilities."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 1024):
            rows = order[a: a + 1024]
            x, mask = padded([words[i] for i in rows])
            p = self._softmax(np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2))
            out[rows] = (p * (mask & self.seen[x])[..., None]).sum(0)
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B) with an edge on both sides, and which positions count."""
    lengths = np.array([len(w) + 2 for w in words])
    x = np.full((int(lengths.max()), len(words)), _EDGE, np.int64)
    for i, w in enumerate(words):
        x[1: len(w) + 1, i] = np.frombuffer(w, np.uint8)
    return x, np.arange(len(x))[:, None] < lengths


def stretches(piece: str) -> list[bytes]:
    """The letters of a piece, lower-cased, in stretches of bytes; none without letters."""
    if not piece.isalpha():
        piece = "".join(c for c in piece if c.isalpha() or c in "'-").strip("'-")
    word = piece.lower().encode()
    return [word[i: i + STRETCH] for i in range(0, len(word), STRETCH)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts.update((lang, w) for p, n in Counter(text.split()).items() for w in stretches(p) for _ in range(n))
    yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": pa.array(counts.values(), pa.int64())},
                                     schema=pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]))


def train(docs: DataFrame, held: int = 0, of: int = 5, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> ByteGRU:
    """Fit the network on documents with a language whose crc32(id) mod ``of`` is not ``held``.

    Every language of such documents is known; each gives an equal share, one at least, of ``documents``
    documents and ``words`` words.  Without any, the network knows no language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter("doc_id is not null and lang is not null and text is not null").filter(crc_mod("doc_id", of) != held)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    each = lambda bound: max(1, bound // max(1, len(languages)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each(documents)).drop("r")
    counted = known.join(F.broadcast(stored(picked, "languages")), ["doc_id", "lang"]).select("text", "lang").mapInArrow(_words, "lang string, word binary, n long")
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    total = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = total.withColumn("r", F.row_number().over(often)).filter(F.col("r") <= each(words)).drop("r").orderBy(F.desc("n"), "lang", "word").collect()
    model = ByteGRU(languages)
    if rows:
        model.seen = np.zeros(256, bool)
        model.seen[list({_EDGE}.union(*(r["word"] for r in rows)))] = True
    if len(languages) > 1 and rows:
        number: dict[bytes, int] = {}
        for r in rows:
            number.setdefault(bytes(r["word"]), len(number))
        n = np.zeros((len(number), len(languages)))
        for r in rows:
            n[number[bytes(r["word"])], languages.index(r["lang"])] = r["n"]
        target = n / np.maximum(n.sum(0), 1)  # a language may have no word
        target /= target.sum(1, keepdims=True)
        model.fit(list(number), target.astype(np.float32), np.sqrt(n.sum(1)).astype(np.float32))
    return model


class _Pools:
    """Position sums of pieces by row; a cache that starts anew when it is full."""

    def __init__(self, model: ByteGRU):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.model.languages) + 1), np.float32)

    def learn(self, pieces: set[str]) -> None:
        if len(self.row) > CACHE_PIECES:
            self.clear()
        new = [p for p in pieces if p not in self.row]
        cut = [stretches(p) for p in new]
        words = list({w for c in cut for w in c})
        sums, at = self.model.positions(words), {w: i for i, w in enumerate(words)}
        more = np.zeros((len(new), self.sums.shape[1]), np.float32)
        for i, c in enumerate(cut):
            for w in c:
                more[i, :-1] += sums[at[w]]
                more[i, -1] += len(w) + 2
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.sums = np.concatenate([self.sums, more])


def _labels(texts_: list[str | None], pools: _Pools, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text has a language, its number, and the mean probability."""
    cut = [(t or "").split() for t in texts_]
    if not len(languages):
        return np.zeros(len(cut), bool), np.zeros(len(cut), int), np.zeros(len(cut))
    pools.learn(set().union(*cut))
    rows = np.fromiter((pools.row[p] for c in cut for p in c), np.int64)
    total = np.zeros((len(cut), pools.sums.shape[1]))
    full = np.flatnonzero([len(c) for c in cut])
    if len(full):
        counts = np.array([len(cut[i]) for i in full])
        total[full] = np.add.reduceat(pools.sums[rows].astype(np.float64), np.cumsum(counts) - counts)
    p = total[:, :-1] / np.maximum(total[:, -1:], 1e-9)
    known, best = total[:, -1] > 0, p.argmax(1)
    return known, best, np.where(known, p[np.arange(len(cut)), best], 0.0).clip(0, 1)


def _predict(batches: Iterator[pa.RecordBatch], model: ByteGRU) -> Iterator[pa.RecordBatch]:
    pools, languages = _Pools(model), np.array(model.languages, object)
    for batch in slices(batches):
        known, best, score = _labels(batch.column("text").to_pylist(), pools, languages)
        names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": score})


def predict(docs: DataFrame, model: ByteGRU) -> DataFrame:
    """doc_id, lang_pred and score (mean probability over positions), a row for each row.

    ``und`` with score 0 for a null text or one without a letter, or if the network knows no language;
    of equal languages the first by name.  Extra columns are ignored."""
    return texts(docs).mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double")


def _passing(batches: Iterator[pa.RecordBatch], model: ByteGRU, least: float) -> Iterator[pa.RecordBatch]:
    pools, languages = _Pools(model), np.array(model.languages, object)
    for batch in slices(batches):
        known, _, score = _labels(batch.column("text").to_pylist(), pools, languages)
        yield batch.filter(pa.array(known & (score >= least)))


def with_language(docs: DataFrame, model: ByteGRU, least: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose text is in a language that the network knows with a score of
    at least ``least``.  A network that knows no language rejects nothing but texts without a letter."""
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(partial(_passing, model=model, least=least), docs.schema)


def held_out(id_col: str | Column = "doc_id", held: int = 0, of: int = 5) -> Column:
    return F.coalesce(crc_mod(id_col, of) == held, F.lit(False))
