"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 3, 1, 2 and so on; together they
get ``share`` of all words, none more than ``most`` times its own, and what
that cuts off goes to the others by weight until none is above.  Every document
of a source is expected ``target / size of the source`` times.  Documents of a
source stand in the order of their sizes (equal sizes by a hash of the id); a
document is taken once for each integer that lies between the expected copies
before it plus the source's random offset, and the same with its own copies.
The copies before a document are its place in the source (an exact prefix sum
over ranges) times the copies of one, so no rounding adds up and reruns agree.
In size order neighbours weigh alike, so the words taken are off the target by
about one longest document at most.

Null texts have no words and null ids count as one id; repeated rows are
documents of their own; extra columns are ignored by ``mix`` and kept by
``mixture``; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, stored
from ledgerlens.operators.ordered import prefix_sums

#: Runs of anything but the ASCII space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Sources up to which their plan is handed to all tasks.
FEW_SOURCES = 100_000


def hashed(text: Column, digits: int) -> Column:
    """The first hex ``digits`` of a text's md5, as a number."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, digits), 16, 10).cast("long")


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size in words, and the columns that order documents and sources."""
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    return docs.select(
        *more, doc_id.alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source.isNull().cast("int").alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key"),
        hashed(F.concat(F.lit("doc:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 15).alias("tie"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id_key"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"))


def _level(sources: DataFrame, share: float, most: float) -> float:
    """Words for each unit of weight: the least level at which sources cut off at ``most`` times their size use all words of the mix.
    Two sums a round reach the driver; each round cuts off more sources, or is the last."""
    budget = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, cut = 0.0, -1
    while True:
        above = most * F.col("source_size") < F.lit(level) * F.col("weight")
        n, used, weight = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n <= cut or not weight:
            return level
        level, cut = (budget - most * float(used or 0)) / float(weight), n


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """A row for each source: its size, its target in words, the copies of each document and its offset."""
    sums = stored(sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "sources")
    place = prefix_sums(sums, ["no_source", "source_key"], ["one"]).withColumn("at", F.col("one_below").cast("long") % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") + 1).cast("int"))
    weighed = stored(place.select("no_source", "source_key", "source_size", weight.alias("weight")), "source-weights")
    dropped(sums)
    target = F.least(F.lit(_level(weighed, share, most)) * F.col("weight"), F.lit(most) * F.col("source_size"))
    offset = hashed(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("source_key")), 4) / F.lit(65536.0)
    copies = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return stored(weighed.select("no_source", "source_key", "source_size", target.alias("target"), copies.alias("copies"), offset.alias("offset")), "targets")


def _taken(sized: DataFrame, **how) -> DataFrame:
    """``sized`` with its source's size and target, and how often the mix takes each document."""
    plan = targets(sized, **how)
    few = F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan
    placed = prefix_sums(sized.withColumn("one", F.lit(1)), ["size", "tie", "id_key", "text_key", "row"], ["one"], partition=["no_source", "source_key"])
    before, most = F.col("one_below") * F.col("copies") + F.col("offset"), F.ceil("copies")
    after = (F.col("one_below") + 1) * F.col("copies") + F.col("offset")
    return placed.join(few, ["no_source", "source_key"]).withColumn("times", F.least(F.floor(after) - F.floor(before), most))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's words in the mix) and taken (its words there, repeats counted), a row for each document."""
    sized = stored(sizes(docs, F.monotonically_increasing_id().alias("row")), "sizes")
    return _taken(sized, **how).select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as it is taken."""
    name = next(c for c in (f"_row{i}" for i in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns})
    numbered = stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    sized = stored(sizes(numbered, F.col(name).alias("row")), "sizes")
    times = _taken(sized, **how).filter("times > 0").select(F.col("row").alias(name), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy")).select(name)
    return numbered.join(times, name).select(*[numbered[c] for c in docs.columns])
