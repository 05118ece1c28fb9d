"""Fuzzy name matching (JON-7, JON-8, JON-9, CLN-3).

Score = token-sort ratio: both names are normalised (non-ASCII dropped,
non-word characters -> space, lower-case, tokens sorted and re-joined), then
round(100 * 2 * LCS / (len1 + len2)), the indel-normalised similarity.

Names of one normal form are one class, and classes are compared.  A score of
T or more needs an indel distance of at most d = floor((1 - r)(L1 + L2)) with
r = (T - 0.5) / 100.  Cut the longer form into d + 1 segments: d edits leave
some segment i whole, with exactly i - 1 edits before it, so it stands in the
shorter form at a shift of at most i - 1 seen from the left, and of d + 1 - i
seen from the right.  So forms meet only through an equality join on (length,
d, i, segment), and no pair that can reach the threshold is lost.  What meets
must also share enough characters (histograms, JVM-side) before the LCS is
computed (pandas UDF).  Forms are told apart by their text.  Where nearly all
forms share their segments the index leaves hardly a pair out; a sample of
the forms tells, and they are compared tile by tile (``name_tiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import name_tiles as NT


def normalize_for_ratio(c) -> F.Column:
    """Token-sort normalisation, JVM-side."""
    x = F.regexp_replace(F.lower(c), r"[^\x00-\x7F]", "")
    x = F.regexp_replace(x, r"[^a-zA-Z0-9_]", " ")
    x = F.trim(F.lower(x))
    toks = F.filter(F.split(x, " +"), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def _lcs(a: str, b: str) -> int:
    """Bit-parallel LCS length (Hyyro), O(len(b)) big-int operations."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio_score(a: str, b: str) -> int:
    """round(100 * (lensum - indel) / lensum), Python rounding; 0 if empty."""
    if not a or not b:
        return 0
    lensum = len(a) + len(b)
    dist = lensum - 2 * _lcs(a, b)
    return int(round(100 * ((lensum - dist) / lensum)))


@F.pandas_udf(T.IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Verifier for candidate pairs (Arrow batches of pairs)."""
    return pd.Series([ratio_score(x, y) for x, y in zip(a, b)], dtype="int32")


#: Characters of a normal form, counted side by side.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_ "


#: Place and size of segment i of a form of ``len`` characters cut into d + 1; the last ones are longer by one.
_SEGMENT = ("(i - 1) * (len div (d + 1)) + greatest(0, i - 2 - d + len % (d + 1)) + 1 AS at",
            "CAST(len div (d + 1) + IF(i > d + 1 - len % (d + 1), 1, 0) AS INT) AS size")


def _edits(threshold: int, length: str) -> str:
    """Largest indel distance of two forms of ``length`` characters together, as SQL."""
    return f"CAST(floor(({length}) * {1005 - 10 * threshold} / 1000) AS INT)"


def _segment_index(forms: DataFrame, threshold: int) -> DataFrame:
    """Segments (len, d, i, piece) of every form, for each number of edits that a partner no longer than it may be away."""
    r = (threshold - 0.5) / 100.0
    least = f"greatest(1, CAST(ceil(len * double('{r / (2 - r)!r}') - 1e-9D) AS INT))"
    e = forms.selectExpr("*", f"explode(sequence({_edits(threshold, f'len + {least}')}, {_edits(threshold, 'len + len')})) AS d")
    e = e.selectExpr("*", "explode(sequence(1, d + 1)) AS i").selectExpr("*", *_SEGMENT)
    return e.selectExpr("* EXCEPT (at, size)", "substring(norm, at, size) AS piece")


def _segment_probes(forms: DataFrame, threshold: int) -> DataFrame:
    """Pieces of every form where a segment of a form as long or longer could stand."""
    r = (threshold - 0.5) / 100.0
    most = f"greatest(own, CAST(floor(own * double('{(2 - r) / r!r}') + 1e-9D) AS INT))"
    e = forms.withColumnRenamed("len", "own").selectExpr("*", f"explode(sequence(own, {most})) AS len")
    e = e.selectExpr("*", f"{_edits(threshold, 'own + len')} AS d").selectExpr("*", "explode(sequence(1, d + 1)) AS i").selectExpr("*", *_SEGMENT)
    e = e.selectExpr("*", "greatest(1, at - (i - 1), at + own - len - (d + 1 - i)) AS low",
                     "least(own - size + 1, at + (i - 1), at + own - len + (d + 1 - i)) AS high").filter("low <= high")
    e = e.selectExpr("* EXCEPT (at, low, high, own)", "explode(sequence(CAST(low AS INT), CAST(high AS INT))) AS s")
    return e.selectExpr("* EXCEPT (s, size)", "substring(norm, s, size) AS piece").distinct()


def _candidates(forms: DataFrame, threshold: int, block: Sequence[str] = ()) -> DataFrame:
    """Pairs (norm_a < norm_b, block) of different forms, one ``left`` and one ``right``, that share a segment."""
    if threshold <= 50:
        raise ValueError("a threshold of 51 or more leaves no segment empty")
    index = _segment_index(forms, threshold).withColumnsRenamed({"norm": "long", "left": "long_left", "right": "long_right"})
    met = index.join(_segment_probes(forms, threshold), ["len", "d", "i", "piece", *block]).filter(
        (F.col("long") != F.col("norm")) & ((F.col("long_left") & F.col("right")) | (F.col("long_right") & F.col("left"))))
    pairs = met.select(F.least("long", "norm").alias("norm_a"), F.greatest("long", "norm").alias("norm_b"), *block)
    return pairs.distinct()          # pairs that share several segments; map-side combined before its shuffle


def name_classes(names: DataFrame, col: str = "name", block: Sequence[str] = ()) -> DataFrame:
    """Distinct names (name, norm and the ``block`` columns), with their normal forms; null names are left out."""
    n = names.select(F.col(col).alias("name"), *block).filter(F.col("name").isNotNull()).distinct()
    return n.withColumn("norm", normalize_for_ratio(F.col("name")))


def _forms(classes: DataFrame, block: Sequence[str] = ()) -> DataFrame:
    """The distinct forms, each on both sides of the comparison."""
    forms = classes.filter(F.length("norm") > 0).select("norm", *block).distinct()
    return forms.select("*", F.length("norm").alias("len"), F.lit(True).alias("left"), F.lit(True).alias("right"))


def _verified(pairs: DataFrame, threshold: int) -> DataFrame:
    """``pairs`` (norm_a, norm_b) with their score, where it reaches the threshold."""
    counts = lambda c: F.array(*[F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in _LETTERS])
    forms = pairs.select(F.explode(F.array("norm_a", "norm_b")).alias("norm")).distinct().withColumn("counts", counts("norm"))
    a, b = (forms.select(F.col("norm").alias(f"norm_{x}"), F.col("counts").alias(f"counts_{x}")) for x in "ab")
    shared = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    enough = pairs.join(a, "norm_a").join(b, "norm_b").filter(200 * shared >= F.lit(threshold - 0.5) * (F.length("norm_a") + F.length("norm_b")) - F.lit(1e-6))
    return enough.drop("counts_a", "counts_b").withColumn("score", ratio_udf("norm_a", "norm_b")).filter(F.col("score") >= threshold)


#: Forms that are compared tile by tile whatever they share, forms of the sample that probes the index for more of
#: them, and pairs of forms that a task compares in the time that one candidate of the index takes.
FEW, PROBES, PER_CANDIDATE = 20_000, 256, 200


def _much_alike(forms: DataFrame, threshold: int, block: Sequence[str] = ()) -> bool:
    """Whether comparing tiles is less work than the candidates of the index (both find the same pairs)."""
    if threshold <= 50:
        raise ValueError("a threshold of 51 or more leaves no segment empty")
    sizes = forms.groupBy(*block).agg(F.count("*").cast("double").alias("n"))
    n, pairs = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    if not n or n <= FEW:
        return True
    on = ["len", "d", "i", "piece", *block]
    some = forms.filter(F.pmod(F.xxhash64("norm", F.lit(3)), F.lit(max(1, int(n) // PROBES))) == 0)
    index = _segment_index(forms, threshold).groupBy(*on).agg(F.count("*").alias("met"))
    met, asked = index.join(_segment_probes(some, threshold), on).agg(F.sum("met")).first()[0] or 0, max(1, some.count())
    return met / asked * PER_CANDIDATE >= pairs / n


def similar_classes(classes: DataFrame, threshold: int = 85, block: Sequence[str] = ()) -> DataFrame:
    """JON-7 between classes: (norm_a < norm_b, score) of different normal forms with a ratio of ``threshold`` or
    more, among those that agree in the ``block`` columns.  With ``name_classes`` as membership this is the whole
    join: names of one form score 100, other names as their forms do."""
    return _verified(_candidates(_forms(classes, block), threshold, block), threshold).select("norm_a", "norm_b", *block, "score")


def similar_pairs(names: DataFrame, threshold: int = 85, col: str = "name", block: Sequence[str] = ()) -> DataFrame:
    """JON-7: all pairs of distinct names (a < b by name) with token-sort
    ratio >= threshold, within the ``block`` columns where given.  Returns
    (name_a, name_b, block, score): the class pairs spelled out by name."""
    from ledgerlens.session import materialize
    block = list(block)
    classes = materialize(name_classes(names, col, block), "name-classes")
    within = _within(classes, block)
    if _much_alike(_forms(classes, block), threshold, block):
        spelled = classes.filter(F.length("norm") > 0).groupBy("norm", *block).agg(F.collect_list("name").alias("names"))
        return NT.linked_names(spelled, threshold, block).select("name_a", "name_b", *block, "score").unionByName(within)
    a, b = (classes.select(F.col("name").alias(f"name_{x}"), F.col("norm").alias(f"norm_{x}"), *block) for x in "ab")
    between = similar_classes(classes, threshold, block).join(a, ["norm_a", *block]).join(b, ["norm_b", *block])
    pairs = between.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), *block, "score")
    return pairs.unionByName(within)


def _within(classes: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of names of one form, which score 100."""
    a, b = (classes.select(F.col("name").alias(f"name_{x}"), "norm", *block) for x in "ab")
    same = a.join(b, ["norm", *block]).filter((F.col("name_a") < F.col("name_b")) & (F.length("norm") > 0))
    return same.select("name_a", "name_b", *block, F.lit(100).alias("score"))


def cluster_names(names: DataFrame, pairs: DataFrame, col: str = "name") -> DataFrame:
    """JON-8: greedy star clustering in name order, as rounds.

    A name becomes a leader when every lower-ordered neighbour is absorbed;
    a name with a lower-ordered leader neighbour is absorbed.  Once no name
    is open, each absorbed name joins its smallest adjacent leader (assigning
    during the rounds would differ from the sequential loop).  The canonical
    name of a cluster is its longest member (leader first on ties, then name
    order).  Each round truncates lineage with ``checkpoint()`` into the
    shared checkpoint folder; every round settles the
    lowest open name, so the loop ends when none is open.
    Returns (name, leader, canonical).
    """
    from ledgerlens.session import checkpoint_dir
    spark = names.sparkSession
    checkpoint_dir(spark)
    nodes = names.select(F.col(col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    e = pairs.select(F.col("name_a").alias("u"), F.col("name_b").alias("v"))
    edges = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    lower = edges.filter(F.col("v") < F.col("u")).checkpoint()   # u's lower-ordered neighbours v
    state = nodes.withColumn("st", F.lit("open")).checkpoint()
    while True:
        nb = lower.join(state.select(F.col("name").alias("v"), F.col("st").alias("vst")), "v")
        agg = nb.groupBy("u").agg(F.max((F.col("vst") == "leader").cast("int")).alias("has_leader"),
                                  F.min((F.col("vst") == "absorbed").cast("int")).alias("all_absorbed"))
        s = state.join(agg, state.name == agg.u, "left")
        new_st = (F.when(F.col("st") != "open", F.col("st"))
                  .when(F.col("has_leader") == 1, F.lit("absorbed"))
                  .when(F.col("u").isNull() | (F.col("all_absorbed") == 1), F.lit("leader"))
                  .otherwise(F.lit("open")))
        state = s.select("name", new_st.alias("st")).checkpoint()
        if state.filter(F.col("st") == "open").isEmpty():
            break
    leaders = state.filter(F.col("st") == "leader").select(F.col("name").alias("v"))
    absorbed = state.filter(F.col("st") == "absorbed").select(F.col("name").alias("u"))
    assign = (absorbed.join(lower, "u").join(leaders, "v").groupBy("u").agg(F.min("v").alias("leader"))
              .select(F.col("u").alias("name"), "leader"))
    members = leaders.select(F.col("v").alias("name"), F.col("v").alias("leader")).unionByName(assign)
    canon = members.groupBy("leader").agg(F.min_by("name", F.struct(
        -F.length("name"), (F.col("name") != F.col("leader")).cast("int"), F.col("name"))).alias("canonical"))
    return members.join(canon.select("leader", "canonical"), "leader").select("name", "leader", "canonical")


def cluster_similar_names(names: DataFrame, threshold: int = 85, col: str = "name") -> DataFrame:
    """JON-8 over JON-7 without spelling out pairs of names: (name, leader, canonical).

    Names of one form are all linked and have the same neighbours, so the
    first of them stands for the class in ``cluster_names``; its leader leads
    all of them, and the longest of all members is canonical."""
    from ledgerlens.session import materialize
    members = materialize(name_classes(names, col).withColumn("form", F.when(F.length("norm") > 0, F.col("norm"))), "name-classes")
    first = members.filter("form IS NOT NULL").groupBy("form").agg(F.min("name").alias("first"))
    if _much_alike(_forms(members), threshold):
        stars = NT.stars(first.withColumnRenamed("form", "norm"), threshold).select("first", "leader")
    else:
        a, b = (first.select(F.col("form").alias(f"norm_{x}"), F.col("first").alias(f"name_{x}")) for x in "ab")
        pairs = similar_classes(members.select("name", "norm"), threshold).join(a, "norm_a").join(b, "norm_b").select("name_a", "name_b", "score")
        stars = cluster_names(first.select(F.col("first").alias("name")), materialize(pairs, "class-pairs")).select(F.col("name").alias("first"), "leader")
    led = members.join(first, "form", "left").join(stars, "first", "left").select("name", F.coalesce("leader", "name").alias("leader"))
    canon = led.groupBy("leader").agg(F.min_by("name", F.struct(
        -F.length("name"), (F.col("name") != F.col("leader")).cast("int"), F.col("name"))).alias("canonical"))
    return led.join(canon, "leader").select("name", "leader", "canonical")


def standardize_names(df: DataFrame, col: str = "entity_name", threshold: int = 85) -> DataFrame:
    """CLN-3: replace each name by its cluster's canonical name (join on the
    name; names outside any pair keep their value)."""
    cl = cluster_similar_names(df, threshold, col).select(F.col("name").alias("_n"), F.col("canonical").alias("_c"))
    j = df.join(cl, df[col] == cl["_n"], "left")
    return j.withColumn(col, F.coalesce("_c", F.col(col))).drop("_n", "_c")


def best_match(left: DataFrame, right: DataFrame, threshold: int = 80, left_col: str = "name",
               right_col: str = "name") -> DataFrame:
    """JON-9: for each left name the best right name by token-sort ratio of
    the FN-4-cleaned names (>= threshold); ties go to the first right name in
    name order.  Forms of the two tables meet as in JON-7, but only across the
    tables; of the right names of one form the first counts."""
    from ledgerlens.operators.text import clean_legal_name
    from ledgerlens.session import materialize
    lc, rc = (materialize(name_classes(t.select(F.col(c).alias("full"), clean_legal_name(F.col(c)).alias("name")), "name", ["full"]), "name-classes")
              for t, c in ((left, left_col), (right, right_col)))
    sides = lc.select("norm", F.lit(True).alias("left")).unionByName(rc.select("norm", F.lit(False).alias("left"))).filter(F.length("norm") > 0)
    forms = sides.groupBy("norm").agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right")).withColumn("len", F.length("norm"))
    firsts = rc.filter(F.length("norm") > 0).groupBy("norm").agg(F.min("full").alias("right_name"))
    if _much_alike(forms, threshold):
        best = NT.best_names(forms.filter("left").select("norm", F.array().cast("array<string>").alias("names")), firsts.select("norm", F.array("right_name").alias("names")), threshold)
    else:
        scored = _verified(_candidates(forms, threshold), threshold)
        turned = scored.select(F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b"), "score")
        equal = forms.filter("left AND right").select(F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"), F.lit(100).alias("score"))
        scored = scored.select("norm_a", "norm_b", "score").unionByName(turned).unionByName(equal)  # left forms first, whichever is smaller
        best = scored.join(firsts.withColumnRenamed("norm", "norm_b"), "norm_b").groupBy("norm_a").agg(
            F.min_by("right_name", F.struct(-F.col("score"), F.col("right_name"))).alias("right_name"), F.max("score").alias("score"))
    return lc.join(best, lc["norm"] == best["norm_a"]).select(F.col("full").alias("left_name"), "right_name", "score")
