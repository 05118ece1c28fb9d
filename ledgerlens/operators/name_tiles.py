"""Comparison of normal forms tile by tile (JON-7, JON-8, JON-9, CLN-3), for names that are too alike for an index.

Forms are dealt to tiles of a few thousand by a hash; each pair of tiles is a
row that one task compares.  A tile is kept as bit-parallel LCS states (Hyyro),
one machine word for 64 characters, all forms side by side; the other tile's
forms are read backwards in sorted order, so that what they share with the
form before them is not read again.  Only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of a tile, links handed on at once, and most tasks that compare tiles.
TILE, LINKS, TASKS = 4096, 200_000, 10_000


def scores(lcs: np.ndarray, lensum: np.ndarray) -> np.ndarray:
    """``fuzzy.ratio_score`` of whole arrays (rint rounds halves to even, as Python does)."""
    return np.rint(100 * (2 * lcs.astype(np.int64) / lensum)).astype(np.int32)


@lru_cache(16)
def _needed(threshold: int, longest: int) -> np.ndarray:
    """Least LCS that reaches the threshold, by the sum of the lengths up to ``longest``."""
    out = np.zeros(longest + 1, np.int64)
    for lensum in range(1, longest + 1):
        lcs = np.arange(lensum + 1)
        out[lensum] = np.argmax(scores(lcs, lensum) >= threshold)
    return out


def common(a: Sequence[str], b: Sequence[str], threshold: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(j, part, lcs, needed) for each form j of ``b`` that some form of ``a``, sorted by length, is long enough for:
    the LCS with the forms ``a[part]``, and what each of them needs to reach the threshold."""
    if not a or not b:
        return
    la = np.array([len(x) for x in a], np.int64)
    needed = _needed(threshold, 2 * max(int(la[-1]), max(map(len, b))))
    letters = np.frombuffer("".join(x[::-1] for x in a).encode("ascii"), np.uint8)
    owner = np.repeat(np.arange(len(a)), la)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(la) - la, la)
    words = int(la[-1] + 63) // 64
    masks = np.zeros((128, words, len(a)), np.uint64)
    np.bitwise_or.at(masks, (letters, at >> 6, owner), np.uint64(1) << (at & 63).astype(np.uint64))
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for j, x in enumerate(b):
        by_length.setdefault(len(x), []).append((x[::-1].encode("ascii"), j))
    for lb, group in by_length.items():
        fit = np.flatnonzero(needed[la + lb] <= np.minimum(la, lb))
        if not len(fit):
            continue
        part = slice(int(fit[0]), int(fit[-1]) + 1)             # lengths in reach of lb: without a gap
        need, size = needed[la[part] + lb], part.stop - part.start
        mask = np.ascontiguousarray(masks[:, :, part])
        state = np.empty((lb + 1, words, size), np.uint64)
        state[0] = ~np.uint64(0)
        u, low, carry = np.empty(size, np.uint64), np.empty(size, np.uint64), np.zeros(size, np.uint64)
        before = b""
        for x, j in sorted(group):
            same = 0
            while same < len(before) and before[same] == x[same]:
                same += 1
            for q in range(same, lb):
                for w in range(words):
                    v, new = state[q, w], state[q + 1, w]
                    np.bitwise_and(v, mask[x[q], w], out=u)
                    np.subtract(v, u, out=low)
                    np.add(v, u, out=new)
                    if words > 1:
                        over = new < v
                        if w:
                            new += carry
                            over |= new < carry
                        carry = over.astype(np.uint64)
                    np.bitwise_or(new, low, out=new)
            before = x
            yield j, part, 64 * words - np.bitwise_count(state[lb]).sum(axis=0, dtype=np.int64), need


def _entries(column, row: int) -> tuple[list[str], pa.Array, np.ndarray]:
    """Forms of a tile, sorted by length, their names one after the other, and how many names each has."""
    form, names = column.slice(row, 1).flatten().flatten()
    order = pa.array(np.argsort(pc.utf8_length(form).to_numpy(zero_copy_only=False), kind="stable"))
    form, names = form.take(order), names.take(order)
    return form.to_pylist(), names.flatten().cast(pa.string()), pc.list_value_length(names).to_numpy(zero_copy_only=False).astype(np.int64)


def _spelled(ia, ib, score, a, b, threshold_rows=LINKS) -> Iterator[list[pa.Array]]:
    """name_a < name_b, score: the names of linked forms, at most ``threshold_rows`` rows at a time."""
    (names_a, count_a, rank_a), (names_b, count_b, rank_b) = a, b
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    many = count_a[ia] * count_b[ib]
    end, both = np.cumsum(many), pa.concat_arrays([names_a, names_b])
    rank = np.concatenate([rank_a, rank_b])
    for start in range(0, int(end[-1]) if len(end) else 0, threshold_rows):
        row = np.arange(start, min(start + threshold_rows, int(end[-1])))
        link = np.searchsorted(end, row, "right")
        inner = row - (end[link] - many[link])
        x, y = np.divmod(inner, count_b[ib[link]])
        x, y = first_a[ia[link]] + x, len(names_a) + first_b[ib[link]] + y
        swap = rank[x] > rank[y]
        yield [both.take(pa.array(np.where(swap, y, x))), both.take(pa.array(np.where(swap, x, y))), pa.array(score[link], pa.int32())]


def _ranks(names_a: pa.Array, names_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = pa.concat_arrays([names_a, names_b])
    rank = pc.rank(both.cast(pa.binary()), tiebreaker="dense").to_numpy(zero_copy_only=False)
    return rank[:len(names_a)], rank[len(names_a):]


def _links(batches: Iterator[pa.RecordBatch], threshold: int, block: list[str]) -> Iterator[pa.RecordBatch]:
    """Names linked across the two tiles of each row; inside a tile each pair once."""
    for batch in batches:
        for row in range(len(batch)):
            (a, names_a, count_a), (b, names_b, count_b) = (_entries(batch.column(c), row) for c in ("a", "b"))
            own = batch.column("lo")[row].as_py() == batch.column("hi")[row].as_py()
            rank_a, rank_b = _ranks(names_a, names_b)
            sides = (names_a, count_a, rank_a), (names_b, count_b, rank_b)
            la, lb = (np.array([len(x) for x in forms], np.int64) for forms in (a, b))

            def handed(found):
                ia, ib, lcs = (np.concatenate(x) for x in zip(*found))
                for out in _spelled(ia, ib, scores(lcs, la[ia] + lb[ib]), *sides):
                    at = pa.array(np.zeros(len(out[0]), np.int64))
                    out += [batch.column(c).slice(row, 1).take(at) for c in block]
                    yield pa.RecordBatch.from_arrays(out, ["name_a", "name_b", "score", *block])
            found, size = [], 0
            for j, part, lcs, need in common(a, b, threshold):
                hit = np.flatnonzero(lcs >= need)
                if own:
                    hit = hit[hit + part.start < j]
                if len(hit):
                    found.append((hit + part.start, np.full(len(hit), j), lcs[hit]))
                    size += len(hit)
                if size >= LINKS:
                    yield from handed(found)
                    found, size = [], 0
            if found:
                yield from handed(found)


def _dealt(forms: DataFrame, block: Sequence[str], side: str) -> DataFrame:
    """(block, tile, tiles, entries): the forms (norm, names) in tiles."""
    if block:
        sizes = forms.groupBy(*block).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        forms = forms.join(sizes, list(block))
    else:
        forms = forms.withColumn("tiles", F.lit(max(1, -(-forms.count() // TILE))))
    tile = F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int")
    return forms.groupBy(*block, tile.alias("tile")).agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("norm", "names")).alias(side))


def _met(a: DataFrame, b: DataFrame, block: Sequence[str], pairs: int) -> DataFrame:
    """A row for each pair (lo, hi) of tiles, spread over tasks by the pair."""
    spark, on = a.sparkSession, [*block, "lo", "hi"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, -(-pairs // 8)))
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on)


def linked_names(forms: DataFrame, threshold: int, block: Sequence[str] = ()) -> DataFrame:
    """(name_a < name_b, score, block): names of different forms (norm, names, block) whose ratio is ``threshold`` or more."""
    from ledgerlens.session import materialize
    tiles = materialize(_dealt(forms, block, "a"), "name-tiles")
    pairs = tiles.agg(F.sum("tiles")).first()[0] or 0            # every tile meets at most ``tiles`` others
    a = tiles.select(*block, F.col("tile").alias("lo"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("hi"), "a")
    b = tiles.select(*block, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("lo"), F.col("tile").alias("hi"), F.col("a").alias("b"))
    schema = T.StructType([T.StructField("name_a", T.StringType()), T.StructField("name_b", T.StringType()), T.StructField("score", T.IntegerType()),
                           *[forms.schema[c] for c in block]])
    return _met(a, b, block, pairs).mapInArrow(partial(_links, threshold=threshold, block=list(block)), schema)


def _bests(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """For each form of the left tile its best name in the right tile, the first by name of those with one score."""
    for batch in batches:
        for row in range(len(batch)):
            (a, _, _), (b, names, _) = (_entries(batch.column(c), row) for c in ("a", "b"))
            la, place = np.array([len(x) for x in a], np.int64), _ranks(names, names)[0].astype(np.int64)
            best = np.zeros(len(a), np.int64)                    # score, then the place counted from the end
            for j, part, lcs, need in common(a, b, threshold):
                key = np.where(lcs >= need, scores(lcs, la[part] + len(b[j])).astype(np.int64) << 32 | (0xffffffff - place[j]), 0)
                np.maximum(best[part], key, out=best[part])
            hit = np.flatnonzero(best)
            by_place = np.argsort(place, kind="stable")
            name = by_place[np.searchsorted(place[by_place], 0xffffffff - (best[hit] & 0xffffffff))]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.string()), names.take(pa.array(name, pa.int64())), pa.array(best[hit] >> 32, pa.int32())],
                                             ["norm_a", "right_name", "score"])


def best_names(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(norm_a, right_name, score): for each left form its best right name, the first by name of those with one score;
    forms (norm, names) of the right side have one name each."""
    from ledgerlens.session import materialize
    a, b = (materialize(_dealt(t, (), s), "name-tiles") for t, s in ((left, "a"), (right, "b")))
    na, nb = (t.agg(F.max("tiles")).first()[0] or 1 for t in (a, b))
    lo, hi = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (na, nb))
    met = _met(a.select(F.col("tile").alias("lo"), hi.alias("hi"), "a"), b.select(lo.alias("lo"), F.col("tile").alias("hi"), "b"), (), na * nb)
    found = met.mapInArrow(partial(_bests, threshold=threshold), "norm_a string, right_name string, score int")
    return found.groupBy("norm_a").agg(F.min_by("right_name", F.struct(-F.col("score"), F.col("right_name"))).alias("right_name"), F.max("score").alias("score"))


def _leaders(forms: list[str], threshold: int) -> list[int]:
    """Leaders of the sequential loop over ``forms`` in their order: no earlier leader is linked with them."""
    order = sorted(range(len(forms)), key=lambda i: len(forms[i]))
    place = np.array(order)
    linked: list = [None] * len(forms)
    for j, part, lcs, need in common([forms[i] for i in order], forms, threshold):
        linked[j] = place[part][lcs >= need].astype(np.int32)
    absorbed, out = np.zeros(len(forms), bool), []
    for j in range(len(forms)):
        if not absorbed[j]:
            out.append(j)
            if linked[j] is not None:
                absorbed[linked[j]] = True
    return out


def _led(batches: Iterator[pa.RecordBatch], leaders: list[tuple[str, str]], threshold: int) -> Iterator[pa.RecordBatch]:
    """Each form with the first leader that it is linked with (a leader with itself), or null."""
    forms = [x for x, _ in leaders]
    names = pa.array([n for _, n in leaders], pa.string())
    for batch in batches:
        for start in range(0, len(batch), TILE):
            piece = batch.slice(start, TILE)
            piece = piece.take(pa.array(np.argsort(pc.utf8_length(piece.column("norm")).to_numpy(zero_copy_only=False), kind="stable")))
            first = np.full(len(piece), len(leaders))
            for j, part, lcs, need in common(piece.column("norm").to_pylist(), forms, threshold):
                np.minimum(first[part], np.where(lcs >= need, j, len(leaders)), out=first[part])
            led = pa.array(first, pa.int64(), mask=first == len(leaders))
            yield pa.RecordBatch.from_arrays([*piece.columns, names.take(led)], [*piece.schema.names, "leader"])


def stars(first: DataFrame, threshold: int) -> DataFrame:
    """Greedy stars in name order without a list of links: (norm, first, leader) for forms (norm, first).

    The lowest ``TILE`` open names decide among themselves which of them lead;
    every open form is compared with these leaders only, where it lies, and
    joins the first that it is linked with.  Leaders come in name order, so
    that is its first leader of all.  A round settles at least its names."""
    from functools import reduce

    from ledgerlens.session import materialize
    schema = T.StructType([first.schema["norm"], first.schema["first"], T.StructField("leader", T.StringType())])
    tasks, done = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    rest = materialize(first.select("norm", "first").repartition(tasks, "norm"), "open-forms")
    while lowest := rest.orderBy("first").limit(TILE).collect():  # a bounded number of names
        lead = [lowest[j] for j in _leaders([r["norm"] for r in lowest], threshold)]
        led = materialize(rest.mapInArrow(partial(_led, leaders=[(r["norm"], r["first"]) for r in lead], threshold=threshold), schema), "led-forms")
        done.append(led.filter("leader IS NOT NULL"))
        rest = led.filter("leader IS NULL").drop("leader")
    return reduce(DataFrame.unionByName, done) if done else first.select("norm", "first", F.col("first").alias("leader"))
