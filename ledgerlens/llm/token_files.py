"""Token-id files: flat unsigned integers, 64-bit document offsets, prefix-sum bases.

A folder holds, for each range of documents, three flat little-endian files:
``.ids`` (unsigned 16-bit token ids, 32-bit for larger vocabularies), ``.off``
(int64, one more than documents: where each starts, within this file) and
``.doc`` (int64 ids of the documents, with NO_ID for null).  Ranges follow
each other in ascending document id; equal ids, by the hash of their texts.
The manifest (a Spark table) names the files that count, each with the number
of documents and tokens before it: prefix sums over one row for each file.
A task writes files under a name of its attempt, so a lost executor's files
never count.  Null texts are empty; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import open_folder, shuffle_partitions, slices, texts
from ledgerlens.llm.pieces import encoder
from ledgerlens.session import scratch_path

NO_ID = -(1 << 63)
MANIFEST = "part long, file string, itemsize int, n_docs long, n_tokens long, docs_before long, tokens_before long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    enc, (fs, root), task = encoder(path), open_folder(folder), TaskContext.get()
    end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
    name = f"range-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    n_docs = n_tokens = 0
    with fs.open_output_stream(f"{root}/{name}.ids") as ids, fs.open_output_stream(f"{root}/{name}.off") as off, fs.open_output_stream(f"{root}/{name}.doc") as doc:
        off.write(np.zeros(1, "<i8").tobytes())
        for batch in slices(batches):
            rows = [enc.encode(text) + end for text in batch.column("text").to_pylist()]
            ids.write(b"".join(rows))
            ends = n_tokens + np.cumsum([len(r) // enc.dtype.itemsize for r in rows], dtype="<i8")
            off.write(ends.tobytes())
            doc.write(np.array([NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], "<i8").tobytes())
            n_docs, n_tokens = n_docs + len(rows), int(ends[-1])
    yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "itemsize": pa.array([enc.dtype.itemsize], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None) -> tuple[str, list[dict]]:
    """Write ``docs`` (doc_id, text) to ``folder``; return it with the manifest's rows, one for each file."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    tie = F.xxhash64("text")
    ranges = texts(docs).repartitionByRange(shuffle_partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows = ranges.mapInArrow(partial(_write, folder=folder, path=tokenizer, end_id=end_id), MANIFEST.partition(", docs_before")[0]).collect()
    kept = sorted((r.asDict() for r in rows if r.n_docs), key=lambda r: r["part"])
    for key, n in (("docs_before", "n_docs"), ("tokens_before", "n_tokens")):
        for r, before in zip(kept, accumulate((r[n] for r in kept), initial=0)):
            r[key] = before
    spark.createDataFrame(kept, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder, kept


def _mapped(fs, path: str):
    """A file's bytes: memory-mapped on a mounted folder, read where the store has no mapping."""
    from pyarrow import fs as pafs
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def _read(batches: Iterator[pa.RecordBatch], folder: str, at_once: int) -> Iterator[pa.RecordBatch]:
    fs, root = open_folder(folder)
    for r in (r for b in batches for r in b.to_pylist()):
        base = f"{root}/{r['file']}"
        ids = np.frombuffer(_mapped(fs, f"{base}.ids"), f"<u{r['itemsize']}")
        off = np.frombuffer(_mapped(fs, f"{base}.off"), "<i8")
        doc = np.frombuffer(_mapped(fs, f"{base}.doc"), "<i8")
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(off, off[a] + at_once, "right")) - 1)
            b = min(b, len(doc))
            wide = ids[off[a]: off[b]].astype("<u4").tobytes()
            cut = (off[a: b + 1] - off[a]) * 4
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc[a:b], pa.int64(), mask=doc[a:b] == NO_ID), "start": r["tokens_before"] + off[a:b],
                "n_tokens": np.diff(off[a: b + 1]), "ids": pa.array([wide[x:y] for x, y in zip(cut[:-1], cut[1:])], pa.binary())})
            a = b


def read_token_files(spark: SparkSession, folder: str, at_once: int = 1 << 20) -> DataFrame:
    """Documents of a token folder: doc_id, start (ids of all documents before it), n_tokens and
    ids (little-endian unsigned 32-bit).  One task reads a file or more, ``at_once`` ids at a time."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    spread = manifest.repartition(shuffle_partitions(spark), "part")
    return spread.mapInArrow(partial(_read, folder=folder, at_once=at_once), DOCUMENTS)
