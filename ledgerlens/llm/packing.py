"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The attention cost of a piece of n tokens is estimated as
``linear * n + quadratic * n * n``.  Whole sequences are cut from the front of
a document; what is left goes, longest first, to the sequence of lowest cost
that has room for it.  Where none has, the sequence with most room takes the
front part and the rest goes on.  The rows of one group (bounded by its number
of documents and whole sequences, not by keys) make just as many sequences as
their tokens fill; the last tokens of a group fill sequences of power-of-two
length, so nothing is padded.
Null texts are empty; each row stands alone, so repeated ids are packed
twice; null ids stay null; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices, texts
from ledgerlens.llm.pieces import encoder

#: Rows that a group has on average: documents' ends and whole sequences.
GROUP_ROWS = 4096
#: Cost of a token beside its square: attention passes the linear layers at about this length.
LINEAR, QUADRATIC = 1024.0, 1.0
TOKENS = "doc_id long, start long, doc_tokens long, ids binary, packing_group long"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Each text's ids, cut into whole sequences and an end of fewer tokens, each with its group."""
    enc = encoder(path)
    item, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
    for batch in slices(batches):
        out: dict[str, list] = {"doc_id": [], "start": [], "doc_tokens": [], "ids": [], "packing_group": []}
        for doc_id, text, salt in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "salt"))):
            ids = enc.encode(text) + end
            for at in range(0, len(ids), size * item):
                out["doc_id"].append(doc_id)
                out["start"].append(at // item)
                out["doc_tokens"].append(len(ids) // item)
                out["ids"].append(ids[at: at + size * item])
                out["packing_group"].append((salt + at // item // size * 7919) % groups)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("packing_group", pa.int64())]))


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def assign(lengths: np.ndarray, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Pieces (row, start within the row, length, sequence) of rows given longest first, and the sequences' costs."""
    total = int(lengths.sum())
    room = np.array([size] * (total // size) + powers(total % size), dtype=np.int64)
    cost, out = np.zeros(len(room)), []
    whole = int((lengths == size).sum())  # these come first and fill a sequence each
    out, room[:whole], cost[:whole] = [(i, 0, size, i) for i in range(whole)], 0, linear * size + quadratic * size * size
    for row, n in enumerate(lengths[whole:].tolist(), whole):
        at = 0
        while n:
            best = int(np.where(room >= n, cost, np.inf).argmin())
            part = n
            if room[best] < n:
                best = int(room.argmax())
                part = int(room[best])
            out.append((row, at, part, best))
            room[best] -= part
            cost[best] += linear * part + quadratic * part * part
            at, n = at + part, n - part
    return out, cost


def _pack(key: tuple, rows: pa.Table, size: int, item: int) -> pa.Table:
    ids = rows.column("ids").to_pylist()
    doc, start, whole = (rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
    order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc[i] is None, doc[i], start[i], ids[i]))
    pieces, _ = assign(np.array([len(ids[i]) // item for i in order], dtype=np.int64), size)
    used: dict[int, int] = {}
    out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
    dtype = f"<u{item}"
    for row, at, n, sequence in pieces:
        i = order[row]
        offset = used.get(sequence, 0)
        used[sequence] = offset + n
        piece = np.frombuffer(ids[i], dtype)[at: at + n].astype("<u4").tobytes()
        for c, v in zip(out, (doc[i], start[i] + at, n, piece, whole[i], (key[0].as_py() << 32) + sequence, offset)):
            out[c].append(v)
    return pa.table(out, schema=pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in out]))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of the sequences that ``docs`` (doc_id, text) fill: doc_id, start (the document's ids
    before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    rows = texts(docs)
    many, bytes_ = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-(many + bytes_ // (4 * size)) // group_rows))
    item = encoder(tokenizer).dtype.itemsize
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 40)))  # equal rows part, too
    tokens = salted.mapInArrow(partial(_tokens, path=tokenizer, end_id=end_id, size=size, groups=groups), TOKENS)
    return tokens.groupBy("packing_group").applyInArrow(lambda key, rows: _pack(key, rows, size, item), PIECES)

