"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature holds the low 16 bits of ``SYMBOLS`` minima.  Two sets of Jaccard
similarity s differ in about (1 - s) of the symbols; ``reach`` is the distance
that a pair at the threshold exceeds with a probability under ``MISS``.  The
symbols are split so that each part may hold one error: by pigeonhole, a pair
within ``reach`` agrees in some part but for one symbol.  Each part is keyed
once for each symbol left out, so every pair within reach shares a key.

Equal sets are one class.  A key's leader is its member that meets most others
over all keys, as the least changed of a group of copies does.  Each class is
first compared with the leader that it shares most keys with; the links found
make components.  Wherever members of a key still lie in different components,
their pairs within reach are compared too, each in the first key it shares, in
blocks of bounded size, but for pairs that cannot link: bitmaps of both sets
bound from below how many shingles each lacks of the other.  So no link is
lost, and a large group of copies never makes all its pairs.  Links are confirmed on whole
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, slices, stored, texts
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import mixed, shared_counts, shingle_sets

SYMBOLS = 64
MISS = 1e-5
#: Most rows of a key that are compared in one block.
BLOCK = 1024
#: Bits of a set's bitmap.
BITS = 2048
_RANDOM = np.random.default_rng(7919)
_FLIP = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_TURN = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MARK = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
SIGNED = "doc_id long, mark long, n_shingles long, set_a long, set_b long, signature binary"


def reach(percent: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """Smallest distance that pairs at the threshold exceed with a probability of at most ``miss``."""
    p, left = 1 - percent / 100, 1.0
    for d in range(symbols + 1):
        left -= comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if left <= miss:
            return d
    return symbols


def parts(distance: int, symbols: int = SYMBOLS) -> list[np.ndarray]:
    """Symbols of each part: so many parts that one error a part adds up to more than ``distance``."""
    return np.array_split(np.arange(symbols), distance // 2 + 1)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of 16-bit symbols of non-empty sets."""
    out, begin = np.empty((len(sizes), SYMBOLS), "<u2"), np.cumsum(sizes) - sizes
    for k in range(SYMBOLS if len(sizes) else 0):
        out[:, k] = mixed(np.minimum.reduceat((sets ^ _FLIP[k]) * _TURN[k], begin)) & np.uint64(0xFFFF)
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, sizes = shingle_sets(batch.column("text"), width)
        full = sizes > 0
        begin = (np.cumsum(sizes) - sizes)[full]
        sums = np.zeros((2, len(sizes)), np.uint64)
        if full.any():
            for k, salt in enumerate((0x51, 0xA7C3)):
                sums[k, full] = np.add.reduceat(mixed(h, salt), begin)
        rows = iter(signatures(h, sizes[full]))
        signature = pa.array([next(rows).tobytes() if f else None for f in full], pa.binary())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n_shingles": sizes.astype(np.int64), "set_a": sums[0].view(np.int64), "set_b": sums[1].view(np.int64), "signature": signature})


def keys_of(sig: np.ndarray, distance: int) -> np.ndarray:
    """64-bit keys of signatures, one for each symbol left out of its part."""
    own = mixed(sig.astype(np.uint64) + np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(1 << 16)) * _MARK
    return np.concatenate([mixed((own[:, p].sum(1)[:, None] - own[:, p]) ^ _MARK[p]) for p in parts(distance)], axis=1).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            rows = batch.slice(at, 4096)
            keys = keys_of(_matrix(rows.column("signature")), distance)
            yield pa.RecordBatch.from_pydict({"node": np.repeat(rows.column("node").to_numpy(), SYMBOLS), "key": keys.ravel()})


def _bitmaps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each text, a bitmap of the values of its hashed shingles modulo BITS."""
    for batch in slices(batches):
        h, sizes = shingle_sets(batch.column("text"), width)
        owner, at = np.repeat(np.arange(len(sizes)), sizes), (h % np.uint64(BITS)).astype(np.int64)
        bits = np.zeros((len(sizes), BITS), bool)
        bits[owner, at] = True
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "bits": pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())})


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "text_a"), "text_b"):
        left, right = shingle_sets(batch.column("text_a"), width), shingle_sets(batch.column("text_b"), width)
        both = shared_counts(left, right)
        kept = pa.array((both > 0) & (100 * both >= percent * (left[1] + right[1] - both)))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])


def confirmed(pairs: DataFrame, whole: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole texts, from ``whole`` (node, text), are similar enough."""
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(whole.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_confirm, width=width, percent=percent), "a long, b long")


def _apart(batches: Iterator[pa.RecordBatch], distance: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block (rows come sorted by block) in different components, within reach, that may link."""
    names = ("key", "i", "j", "side", "node", "comp", "n")
    begin = np.array([p[0] for p in parts(distance)])

    def pairs(rows: dict[str, np.ndarray], sig: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cross = rows["i"][0] != rows["j"][0]
        left = np.flatnonzero(rows["side"] == rows["i"]) if cross else np.arange(len(sig))
        right = np.flatnonzero(rows["side"] == rows["j"]) if cross else left
        out = int((keys_of(sig[:1], distance)[0] == rows["key"][0]).argmax())  # the symbol that this key leaves out
        n, found = rows["n"], []
        for x in range(0, len(left), 256):
            some = left[x: x + 256]
            ok = rows["comp"][some][:, None] != rows["comp"][right]
            if not cross:
                ok &= rows["node"][some][:, None] < rows["node"][right]
            ok &= 100 * np.minimum(n[some][:, None], n[right]) >= percent * np.maximum(n[some][:, None], n[right])
            p, q = np.nonzero(ok)
            p, q = some[p], right[q]
            for y in range(0, len(p), 1 << 15):
                r, s = p[y: y + (1 << 15)], q[y: y + (1 << 15)]
                differs = sig[r] != sig[s]
                by_part = np.add.reduceat(differs, begin, axis=1, dtype=np.int64)
                first = (by_part <= 1).argmax(1)
                at = np.arange(len(r))
                start, stop = begin[first], np.append(begin[1:], SYMBOLS)[first]
                inside = differs & (np.arange(SYMBOLS) >= start[:, None]) & (np.arange(SYMBOLS) < stop[:, None])
                shared = np.where(by_part[at, first] == 0, start, inside.argmax(1))  # the first key that both have
                near = (by_part.sum(1) <= distance) & (shared == out)
                r, s = r[near], s[near]
                lacks_r, lacks_s = (np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((bits[s], bits[r]), (bits[r], bits[s])))
                most = np.minimum(n[r] - lacks_s, n[s] - lacks_r)
                near = 100 * most >= percent * (n[r] + n[s] - most)
                found.append((r[near], s[near]))
        p, q = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return rows["node"][p], rows["node"][q]

    held: tuple | None = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def done(rows: dict[str, np.ndarray], sig: np.ndarray, bits: np.ndarray, last: bool):
        nonlocal held
        new = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
        cuts = [0, *new.tolist(), len(sig)]
        upto = len(cuts) - 1 if last else len(cuts) - 2
        a, b = [], []
        for x, y in zip(cuts[:upto], cuts[1: upto + 1]):
            if y - x > 1 and (rows["comp"][x:y] != rows["comp"][x]).any():
                p, q = pairs({c: v[x:y] for c, v in rows.items()}, sig[x:y], bits[x:y])
                a.append(np.maximum(p, q))
                b.append(np.minimum(p, q))
        held = None if last else ({c: v[cuts[upto]:] for c, v in rows.items()}, sig[cuts[upto]:], bits[cuts[upto]:])
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)}, schema=schema)

    for batch in batches:
        rows, sig = {c: batch.column(c).to_numpy() for c in names}, _matrix(batch.column("signature"))
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<u8").reshape(-1, BITS // 64)
        if held is not None:
            rows, sig, bits = {c: np.concatenate([held[0][c], v]) for c, v in rows.items()}, np.concatenate([held[1], sig]), np.concatenate([held[2], bits])
        if len(sig):
            yield from done(rows, sig, bits, False)
    if held is not None and len(held[1]):
        yield from done(*held, True)


def _remaining(shared: DataFrame, comps: DataFrame, signed: DataFrame, whole: DataFrame, distance: int, width: int, percent: int) -> DataFrame:
    """Pairs within reach that share a key, lie in different components and may link; large keys in blocks."""
    rows = shared.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("key", "node", "comp")
    open_ = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).filter("lo <> hi").select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    left = stored(rows.join(open_, "key"), "open")
    nodes = left.select("node").distinct()
    maps = whole.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(partial(_bitmaps, width=width), "node long, bits binary")
    signs = nodes.join(signed.select("node", F.col("n_shingles").alias("n"), "signature"), "node").join(maps, "node")
    dealt = left.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "comp")
    blocks = dealt.join(signs, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = blocks.select("key", "i", "j", "side", "node", "comp", "n", "signature", "bits").mapInArrow(partial(_apart, distance=distance, percent=percent), "a long, b long")
    return found.distinct()


def _placed(docs: DataFrame, width: int, percent: int, by_id: bool) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, group and component_id, a row for each row.

    A class has a key of its own, whatever ids its rows have: of one id, rows of different texts are in
    different classes.  ``group`` is what links make of classes, null without shingles or id; with
    ``by_id``, classes that share an id are linked as well.
    """
    distance = reach(percent)
    whole = texts(docs).withColumn("mark", F.xxhash64("text"))
    key = F.xxhash64("n_shingles", "set_a", "set_b").alias("node")
    signed = stored(whole.mapInArrow(partial(_sign, width=width), SIGNED), "signed")
    classed = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = classed.groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("signature").alias("signature"))
    classes = stored(classes.select(key, "n_shingles", "one.*", "signature"), "classes")
    keys = classes.select("node", "signature").mapInArrow(partial(_keys, distance=distance), "node long, key long")
    several = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("members")).filter("least < most").select("key", "members")
    shared = stored(keys.join(several, "key"), "shared")
    met = shared.groupBy("node").agg(F.sum("members").alias("met"))
    leaders = shared.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("leader"))
    signs = classes.select("node", "n_shingles", "signature")
    named = classes.select("node", "doc_id", "mark").join(shared.select("node").distinct(), "node", "left_semi")
    members = stored(whole.join(named, ["doc_id", "mark"]).select("node", "text"), "members")
    votes = shared.join(leaders, "key").filter("node <> leader").groupBy("node", "leader").count()
    best = votes.groupBy(F.col("node").alias("a")).agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("b"))
    links = stored(confirmed(best, members, width, percent), "links")
    comps = stored(components(links), "comps")
    more = stored(confirmed(_remaining(shared, comps, signs, members, distance, width, percent), members, width, percent), "more")
    dropped(shared, members)
    edges = links.unionByName(more)
    mixed_ids = classed.groupBy("doc_id").agg(F.min(key).alias("b"), F.max(key).alias("most")).filter("b < most").select("doc_id", "b")
    if by_id and (mixed_ids := stored(mixed_ids, "ids")).limit(1).count():
        same = classed.join(mixed_ids, "doc_id").select(key.alias("a"), "b").filter("a <> b").distinct()
        comps = stored(components(edges.unionByName(same)), "comps")
    elif more.limit(1).count():
        comps = stored(components(edges), "comps")
    dropped(links, more)
    at = classes.select("node", "doc_id").join(comps, "node", "left").withColumn("group", F.coalesce("component", "node"))
    linked = comps.join(classes.select("node", "doc_id"), "node").groupBy(F.col("component").alias("group")).agg(F.min("doc_id").alias("least"))
    at = at.join(linked, "group", "left").select("node", "group", F.coalesce("least", "doc_id").alias("component_id"))
    has = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), key)
    rows = signed.select("doc_id", "mark", "n_shingles", has.alias("node")).join(at, "node", "left")
    return rows.select("doc_id", "mark", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, a row for each row.

    Texts null or without words have no shingles and no links.  Rows of one id are linked, whatever their
    texts: they share their component, and all of them are kept or none; only those without words stand
    alone.  Rows without id have no component and are kept.  An empty table gives no row.
    """
    rows = _placed(docs, width, percent, True)
    return rows.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, without near-duplicates: of each component of texts the smallest id
    stays, and of several rows of that id and component the one with the smallest text.  Ids link nothing
    here: a text without a copy stays, whatever rows its id has besides.  Rows without id stay."""
    taken, p = {c.lower() for c in docs.columns}, "_"
    while {f"{p}id", f"{p}mark", f"{p}group"} & taken:
        p += "_"
    id_, mark, group = f"{p}id", f"{p}mark", f"{p}group"
    placed = stored(_placed(docs, width, percent, False), "components").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("group").alias(group), "component_id").filter(F.col(id_).isNotNull())
    here = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(mark))
    out = docs.join(placed.filter(F.col(id_) != F.col("component_id")).select(id_, mark).distinct(), here, "left_anti")
    again = placed.filter(F.col(id_) == F.col("component_id")).groupBy(id_, group).agg(F.count("*").alias("rows"), F.collect_set(mark).alias("marks")).filter("rows > 1").select(id_, group, F.explode("marks").alias(mark))
    if again.limit(1).count():
        again = stored(again, "again")
        several = docs.join(again, here).select(id_, group, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        first = several.groupBy(id_, group).agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
        out = out.join(again.select(id_, mark).distinct(), here, "left_anti").select(*docs.columns).unionByName(first)
    return out.select(*docs.columns)
