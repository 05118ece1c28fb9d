"""Byte-level BPE by a minimal acyclic transducer of frequent words, exact merges for the rest.

1. Words (what the vocabulary's pattern cuts a text into) are counted over all
   documents; the most frequent ``lexicon_words`` form the lexicon, whose size
   is the bound of what the driver compiles.
2. The lexicon becomes a minimal acyclic automaton over bytes (equal suffixes
   are shared).  The outputs on a path's arcs add up to the word's number,
   which points to its token ids.  The arrays go to one flat file in the
   shared folder that every task memory-maps.
3. Words the automaton rejects are merged by the vocabulary's ranks.

The lexicon decides speed only; ids are those of the tokenizers library,
special-token strings included.  Null texts are empty, each row stands alone,
and an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import open_folder, slices, texts
from ledgerlens.llm.pieces import byte_letters
from ledgerlens.llm.token_files import _mapped
from ledgerlens.session import scratch_path

#: Words compiled into the automaton.
LEXICON_WORDS = 1 << 18
#: Distinct pieces that a counting task holds before it hands its counts on.
COUNTED_PIECES = 250_000
#: Pieces that a worker's cache of ids holds in each of two generations.
CACHE_PIECES = 250_000
#: Ids that one step of decoding spells out.
DECODED_IDS = 1 << 17
#: A merge is one integer: its rank above ID_BITS bits of the new id; NO_MERGE is above all of them.
ID_BITS = 24
NEW_ID, NO_MERGE = (1 << ID_BITS) - 1, 1 << 60
#: White space of the pattern, as the Unicode property has it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: A space that meets other white space.
MET = re.compile(r" \s|\s ")


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        byte = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: By pair of ids: rank of the merge, then the new id in the low bits.
        self.merges = {(ids[a], ids[b]): rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [ids[c] for c in letters]
        order = sorted(self.merges)
        self.pairs = np.array([a << 32 | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.merges[p] for p in order], np.int64)
        self.letter_ids = np.array(self.first, np.int64)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.letter_ranks = self._ranks(self.letter_ids[a], self.letter_ids[b]).reshape(256, 256)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.marks = [t[:2] for t in self.special]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = [self.first[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        rank = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while rank and (best := min(rank)) < NO_MERGE:
            i = rank.index(best)
            ids[i] = new = best & NEW_ID
            del ids[i + 1], rank[i]
            if i:
                rank[i - 1] = get((ids[i - 1], new), NO_MERGE)
            if i < len(rank):
                rank[i] = get((new, ids[i + 1]), NO_MERGE)
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of many words: those of one length are a matrix, and
        every step merges in each row its lowest-ranked pair, the leftmost of equals."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            if length < 2 or length > 64 or len(which) < 16:
                for i in which.tolist():
                    out[i] = np.array(self.merge(words[i]), "<i4").tobytes()
                continue
            letters = np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8).reshape(-1, length)
            ids, rank = self.letter_ids[letters], self.letter_ranks[letters[:, :-1], letters[:, 1:]]
            while len(ids):
                width, row = ids.shape[1], np.arange(len(ids))
                at = rank.argmin(1) if width > 1 else None
                best = rank[row, at] if width > 1 else np.full(len(ids), NO_MERGE)
                done = best == NO_MERGE
                if done.any():
                    flat = ids[done].astype("<i4").tobytes()
                    for k, i in enumerate(which[done].tolist()):
                        out[i] = flat[k * width * 4: (k + 1) * width * 4]
                    if done.all():
                        break
                    which, ids, rank, at, best = which[~done], ids[~done], rank[~done], at[~done], best[~done]
                    row = np.arange(len(ids))
                ids[row, at] = best & NEW_ID
                kept = np.ones(ids.shape, bool)
                kept[row, at + 1] = False
                ids = ids[kept].reshape(len(row), width - 1)
                kept = np.ones(rank.shape, bool)
                kept[row, at] = False
                rank = rank[kept].reshape(len(row), width - 2)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                rank[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
                rank[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(a), NO_MERGE)
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[i] == key, self.pair_ranks[i], NO_MERGE)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked positions, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = best & NEW_ID, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x, kept in zip(ids, alive) if kept]


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of distinct ``words`` as flat arrays.

    Sorted words are added one by one; the states of the last word that the
    next one leaves are settled: a state equal to a settled one is replaced by it.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    settled: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by settled state: (final, ((byte, state), ...))
    size: list[int] = []  # words from there

    def settle(final: bool, out: list) -> int:
        key = (final, tuple(out))
        if (state := settled.get(key)) is None:
            state = settled[key] = len(arcs)
            arcs.append(key)
            size.append(final + sum(size[s] for _, s in out))
        return state

    path: list[list] = [[False, []]]  # open states of the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, out)))

    for i in order:
        word, same = words[i], 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    root = settle(*path[0])
    key, to, skip = [], [], []
    for state, (final, out) in enumerate(arcs):
        before = int(final)
        for byte, target in out:
            key.append(state << 8 | byte)
            to.append(target)
            skip.append(before)
            before += size[target]
    lengths = [len(ids[i]) for i in order]
    return {"root": np.array([root], "<i8"), "arc": np.array(key, "<i8"), "to": np.array(to, "<i4"), "skip": np.array(skip, "<i4"), "final": np.array([f for f, _ in arcs], "u1"),
            "out": np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8"), "ids": np.array([x for i in order for x in ids[i]], "<i4")}


def save(arrays: dict[str, np.ndarray], uri: str) -> None:
    fs, path = open_folder(uri)
    at, index = 0, {}
    for name, a in arrays.items():
        index[name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class Transducer:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, uri: str):
        buffer = _mapped(*open_folder(uri))
        n = int.from_bytes(buffer[:8], "little")
        for name, (at, length, dtype) in json.loads(buffer[8: 8 + n].to_pybytes()).items():
            setattr(self, name, np.frombuffer(buffer, dtype, length, 8 + n + at))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for a word that the automaton rejects; all words step together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not len(self.arc) or not len(words):
            return found
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(lengths) - lengths
        live, state, number = np.arange(len(words)), np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64)
        for step in range(int(lengths.max()) + 1):
            ends = lengths[live] == step
            done = live[ends]
            found[done] = np.where(self.final[state[ends]] > 0, number[ends], -1)
            live, state, number = live[~ends], state[~ends], number[~ends]
            if not len(live):
                break
            key = state << 8 | text[at[live] + step]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[arc] == key
            live, arc, number = live[hit], arc[hit], number[hit]
            state, number = self.to[arc].astype(np.int64), number + self.skip[arc]
        return found


_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


class Encoder:
    """Whole texts to ids.  A piece between spaces is looked up once; the automaton takes all new words of a slice together."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.vocabulary, self.lexicon = vocabulary(tokenizer), Transducer(lexicon)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}  # words that the automaton rejects

    def words(self, words: list[str]) -> dict[str, bytes]:
        if len(self.merged) > CACHE_PIECES // 2:
            self.merged.clear()
        got, new = {}, []
        for w in words:
            if (ids := self.merged.get(w)) is None:
                new.append(w)
            else:
                got[w] = ids
        encoded = [w.encode() for w in new]
        numbers = self.lexicon.numbers(encoded)
        at, end = self.lexicon.out[numbers] * 4, self.lexicon.out[numbers + 1] * 4
        flat = memoryview(self.lexicon.ids).cast("B")
        rejected = []
        for w, b, n, x, y in zip(new, encoded, numbers.tolist(), at.tolist(), end.tolist()):
            if n >= 0:
                got[w] = bytes(flat[x:y])
            else:
                rejected.append((w, b))
        merged = dict(zip([w for w, _ in rejected], self.vocabulary.merge_all([b for _, b in rejected])))
        self.merged.update(merged)
        return got | merged

    def segments(self, texts_: list[str]) -> list[bytes]:
        """Ids of stretches without special tokens or meeting white space, cut at spaces into pieces."""
        cut = [t.split(" ") for t in texts_]
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for p in set().union(*(c[1:] for c in cut)):
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        heads = [c[0] for c in cut]
        cuts = [self.vocabulary.words(" " + p) for p in new] + [self.vocabulary.words(h) for h in heads]
        ids = self.words(list(set().union(*cuts)) if cuts else [])
        joined = [b"".join(map(ids.__getitem__, c)) for c in cuts]
        known.update(zip(new, joined))
        return [head + b"".join(map(known.__getitem__, c[1:])) for head, c in zip(joined[len(new):], cut)]

    def whole(self, text: str) -> bytes:
        """Ids of one text by the pattern over the whole of it, special tokens apart."""
        parts = self.vocabulary.around(text)
        cuts = [self.vocabulary.words(p) if p not in self.vocabulary.special else [] for p in parts]
        ids = self.words(list(set().union(*cuts)))
        return b"".join(np.array([self.vocabulary.special[p]], "<i4").tobytes() if p in self.vocabulary.special else b"".join(map(ids.__getitem__, c)) for p, c in zip(parts, cuts))

    def encode(self, texts_: list[str | None]) -> list[bytes]:
        plain = [bool(t) and is_plain(t, self.vocabulary.marks) for t in texts_]
        quick = iter(self.segments([t for t, p in zip(texts_, plain) if p]))
        return [next(quick) if p else self.whole(t) if t else b"" for t, p in zip(texts_, plain)]


def is_plain(text: str, marks: list[str]) -> bool:
    """Spaces in the text are places that no word crosses: none meets other white space; no special token begins."""
    if "  " in text or any(m in text for m in marks):
        return False
    if text.isascii():
        return not any(x in text for x in ("\n ", " \n", "\t ", " \t", "\r ", " \r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f"))
    return MET.search(text) is None


_ENCODERS: dict[tuple, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, lexicon: str) -> Iterator[pa.RecordBatch]:
    if (tokenizer, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, lexicon] = Encoder(tokenizer, lexicon)
    enc = _ENCODERS[tokenizer, lexicon]
    for batch in slices(batches, limit=1 << 21):
        rows = enc.encode(batch.column("text").to_pylist())
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])


class Spelling:
    """The bytes of all tokens in one array: ids become bytes by gathering, many at a time."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        parts = []
        for a in range(0, len(ids), DECODED_IDS):
            some = ids[a: a + DECODED_IDS]
            length = self.length[some]
            end = np.cumsum(length)
            parts.append(self.letters[np.repeat(self.start[some] - end + length, length) + np.arange(end[-1])].tobytes())
        return b"".join(parts)


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    spelling = Spelling(vocabulary(tokenizer).bytes)
    for batch in batches:
        column = batch.column("ids")
        ends = np.asarray(column.offsets)
        flat = np.asarray(column.values)
        a = 0
        while a < len(batch):  # few texts at a time, as bytes of tokens outgrow ids
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + DECODED_IDS, "right")) - 1)
            text = spelling.spell(flat[ends[a]: ends[b]])
            at = np.concatenate([[0], np.cumsum(spelling.length[flat[ends[a]: ends[b]]])])[ends[a: b + 1] - ends[a]]
            out = [text[x:y].decode("utf-8", "replace") for x, y in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), column.slice(a, b - a), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])
            a = b


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Counts of words by task, handed on whenever many pieces are held.  Pieces seen once among
    that many are not proposed for the lexicon: they would save nothing, and ids don't depend on it."""
    words = vocabulary(tokenizer).words

    def handed(counts: Counter) -> pa.RecordBatch:
        total: Counter = Counter()
        for piece, n in counts.items():
            if n > 1:
                for w in words(" " + piece):
                    total[w] += n
        return pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counts.update((text or "").split(" "))
        if len(counts) > COUNTED_PIECES:
            yield handed(counts)
            counts.clear()
    yield handed(counts)


def build_lexicon(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Count words over all documents, compile the most frequent, and return the file's place."""
    counted = texts(docs).select("text").mapInArrow(partial(_count, tokenizer=tokenizer), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(lexicon_words).select("word")
    words = [w.encode() for w in top.toArrow().column("word").to_pylist()]
    merge = vocabulary(tokenizer).merge
    uri = scratch_path(docs.sparkSession, f"lexicon-{uuid.uuid4().hex}.bin")
    save(compile_words(words, [merge(w) for w in words]), uri)
    return uri


def encode(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    return texts(docs).mapInArrow(partial(_encode, tokenizer=tokenizer, lexicon=lexicon), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that they stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, tokenizer=tokenizer), "doc_id long, ids array<int>, decoded string")


def _round_trip(batches: Iterator[pa.RecordBatch], tokenizer: str, lexicon: str) -> Iterator[pa.RecordBatch]:
    yield from _decode(_encode(batches, tokenizer, lexicon), tokenizer)


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """``decode(encode(docs))`` in one step: ids reach the text that they stand for inside the task."""
    return texts(docs).mapInArrow(partial(_round_trip, tokenizer=tokenizer, lexicon=lexicon), "doc_id long, ids array<int>, decoded string")
