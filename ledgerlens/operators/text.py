"""Report text: assembly, normalisation, sentences, entity mentions,
keyword labels, domain features and TF-IDF (SRC-5, FN-2..5, FN-7,
JON-6, TXT-1..8, AGG-28).

Text stays in Spark columns end to end: regexes run JVM-side, words and
n-grams are exploded rows, and the only driver-bound values are the fitted
vocabulary (<= ``max_features`` terms).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import rules
from ledgerlens.functions.automaton import Automaton
from ledgerlens.functions.exprs import classify_by_keywords, contains_any, count_present
from ledgerlens.functions.name_index import NameIndex

WS = r"(?U)\s+"


# ---------------------------------------------------------------------------
# Assembly and normalisation
# ---------------------------------------------------------------------------

def assemble_documents(parts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text",
                       out: str = "text") -> DataFrame:
    """SRC-5: non-empty parts of each document joined with newlines in order.

    One document is one output row, so its parts are gathered in one group
    by necessity; the group is bounded by that document's own size."""
    p = parts.filter(F.col(text).isNotNull() & (F.length(text) > 0))
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
                           .alias("_p"))
    return g.select(key, F.array_join(F.transform("_p", lambda x: x["t"]), "\n").alias(out))


def normalize_report_text(c, boilerplate: Sequence[str] = rules.REPORT_BOILERPLATE) -> F.Column:
    """FN-2: lower, collapse whitespace, drop page numbers and boilerplate, trim."""
    x = F.regexp_replace(F.lower(c), WS, " ")
    for pat in boilerplate:
        x = F.regexp_replace(x, pat, "")
    return F.trim(x)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = 10,
              normalized: bool = False) -> DataFrame:
    """FN-3: split on ``[.!?]+``, keep the original index, trim, drop short."""
    t = F.col(text) if normalized else normalize_report_text(F.col(text))
    s = docs.select(key, F.posexplode(F.split(t, "[.!?]+", -1)).alias("sentence_index", "sentence"))
    s = s.withColumn("sentence", F.trim("sentence")).withColumn("sentence_index", F.col("sentence_index").cast("long"))
    return s.filter(F.length("sentence") >= min_len)


def clean_legal_name(c) -> F.Column:
    """FN-4: drop company suffixes and the/of/and/&, collapse spaces, trim."""
    suf = "|".join(rules.LEGAL_SUFFIXES)
    fill = "|".join(re.escape(w) for w in rules.LEGAL_FILLERS)
    x = F.regexp_replace(F.trim(c), rf"(?iU)\b({suf})\b", "")
    x = F.regexp_replace(x, rf"(?iU)\b({fill})\b", " ")
    return F.trim(F.regexp_replace(x, WS, " "))


def normalize_feature_text(c) -> F.Column:
    """FN-5: lower; keep word chars, whitespace and ``- . , % $``; then the
    currency, dollar, percent, decimal and ISO-date rules, in this order."""
    x = F.lower(c)
    x = F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s\-.,%$]", " ")
    x = F.regexp_replace(x, r"(?U)gh[sc]?\s*\d+[\d,.\s]*", "currency_amount")
    x = F.regexp_replace(x, r"(?U)\$\s*\d+[\d,.\s]*", "dollar_amount")
    x = F.regexp_replace(x, r"(?U)\d+\.\d{2}%", "percentage_value")
    x = F.regexp_replace(x, r"(?U)\d+[,\d]*\.\d+", "numeric_value")
    x = F.regexp_replace(x, r"(?U)\d{4}[-/]\d{2}[-/]\d{2}", "date_value")
    x = F.regexp_replace(x, WS, " ")
    return F.trim(x)


def irregularity_categories(df: DataFrame, issues_col: str = "detected_issues", out: str = "irregularity_categories",
                            name_col: str = "entity_name") -> DataFrame:
    """FN-7: multi-label categories from the issue text; when none match,
    fall back by entity-name keywords."""
    hits = F.filter(F.array(*[F.when(contains_any(issues_col, ws), F.lit(lab)) for lab, ws in rules.ISSUE_TYPE_RULES]),
                    lambda x: x.isNotNull())
    fb = None
    for cats, ws in rules.ISSUE_FALLBACK_RULES:
        arr = F.array(*[F.lit(c) for c in cats])
        fb = F.when(contains_any(name_col, ws), arr) if fb is None else fb.when(contains_any(name_col, ws), arr)
    fb = fb.otherwise(F.array(*[F.lit(c) for c in rules.ISSUE_FALLBACK_DEFAULT]))
    return df.withColumn(out, F.when(F.size(hits) == 0, fb).otherwise(hits))


# ---------------------------------------------------------------------------
# Entity mentions (JON-6): token-vocabulary index instead of entity x sentence
# ---------------------------------------------------------------------------

def _grams(c, q: int) -> F.Column:
    n = F.length(c)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))),
                                      lambda i: F.substring(c, i, q))).otherwise(F.array().cast("array<string>"))


#: Words of names up to which every task holds them all.
NAME_WORDS = 20_000


def _names_in(batches: Iterator[pa.RecordBatch], index: NameIndex) -> Iterator[pa.RecordBatch]:
    """The names of each sentence, a row for each."""
    for batch in batches:
        at, name, direct = index.matches(batch.column("sentence"))
        out = batch.take(pa.array(at))
        kind = pa.array(["fuzzy", "direct"]).take(pa.array(direct.astype("int32")))
        yield pa.RecordBatch.from_arrays([index.names.take(pa.array(name)), *out.columns, kind], ["entity", *batch.schema.names, "match_type"])


def entity_mentions(sents: DataFrame, entities: DataFrame, name_col: str = "entity_name", ratio: float = 0.6,
                    key: str = "doc_id", q: int = 3, name_words: int = NAME_WORDS) -> DataFrame:
    """JON-6: (entity, sentence) pairs where the cleaned lower-case name is a
    substring of the sentence ('direct'), else, for names of >= 2 words, at
    least ``ratio`` of the words are substrings ('fuzzy').

    No entity x sentence product is formed.  A word (no spaces) is inside a
    sentence iff it is inside one of the sentence's space-separated tokens.
    If the names have few words (counted), each sentence is read once where it
    lies (``NameIndex``).  Else names too few of whose words are in any token
    are left out first, which is decided on the *vocabularies*: distinct tokens
    are indexed by their 1..q-grams, each entity word probes with its rarest
    gram, and candidate (word, token) pairs are verified with ``contains``;
    if many names are left, sentences meet their words by joins.
    All ways are exact: every true pair passes through the index.
    """
    from ledgerlens.operators.joins import broadcast_or_merge
    from ledgerlens.session import materialize
    ents = (entities.select(F.col(name_col).alias("entity")).filter(F.col("entity").isNotNull()).distinct()
            .withColumn("clean", F.lower(clean_legal_name(F.col("entity"))))
            .filter(F.length("clean") > 0))                                   # Q8: '' would match everything
    k = F.size(F.split("clean", " "))
    m = F.when(k > 1, F.ceil(k * F.lit(ratio) - F.lit(1e-9))).otherwise(k)      # words that a match holds
    names = materialize(ents.select("entity", "clean", k.alias("k"), m.alias("m")), "names")
    sents = sents.filter(F.col(key).isNotNull())

    def many() -> bool:
        return (names.agg(F.sum("k")).first()[0] or 0) > name_words

    if many():
        tok_word = _token_words(sents, names, q)
        words = names.select("*", F.explode(F.split("clean", " ")).alias("word"))
        met = materialize(tok_word.select("word").distinct(), "found-words")
        found = words.join(broadcast_or_merge(met), "word", "left_semi")
        names = materialize(found.groupBy(*names.columns).agg(F.count(F.lit(1)).alias("found"))
                            .filter(F.col("found") >= F.col("m")).drop("found"), "found-names")
        if many():
            return _mentions_by_joins(sents, names, tok_word, ratio, key)
    index = NameIndex([tuple(r) for r in names.select("entity", "clean").collect()], ratio)      # name_words words at most
    read = sents.select(key, "sentence_index", "sentence").filter(F.col("sentence").isNotNull())
    schema = T.StructType([T.StructField("entity", T.StringType()), *read.schema.fields, T.StructField("match_type", T.StringType())])
    return read.mapInArrow(partial(_names_in, index=index), schema)


def _token_words(sents: DataFrame, names: DataFrame, q: int) -> DataFrame:
    """(token, word): the words of names that are inside a token of the sentences.

    The grams of all tokens are many times the size of the tokens' file, by
    which Spark would choose them for a broadcast: they stay where they are.
    A word with a gram that no token has is in none and goes no further; the
    others come to the grams if a count shows few, else by a merge join."""
    from ledgerlens.operators.joins import broadcast_or_merge
    from ledgerlens.session import materialize
    vocab = materialize(sents.select(F.explode(F.array_distinct(F.split("sentence", " "))).alias("token")).distinct(), "tokens")
    vgrams = (vocab.select("token", F.explode(F.array_distinct(F.flatten(F.array(
        *[_grams(F.col("token"), n) for n in range(1, q + 1)])))).alias("gram")))
    gfreq = materialize(vgrams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")), "gram-counts")
    dwords = names.select(F.explode(F.split("clean", " ")).alias("word")).distinct()
    wg = dwords.select("word", F.explode(F.array_distinct(_grams(F.col("word"), F.least(F.length("word"), F.lit(q)))))
                       .alias("gram"))
    rarest = F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))
    key_gram = materialize(wg.join(broadcast_or_merge(gfreq), "gram", "left").groupBy("word").agg(rarest.alias("rarest"))
                           .filter(F.col("rarest.freq") > 0).select("word", "rarest.gram"), "key-grams")
    # A token has a gram once and a word one key gram, so no pair comes twice.
    return materialize(vgrams.join(broadcast_or_merge(key_gram), "gram").filter(F.col("token").contains(F.col("word")))
                       .select("token", "word"), "token-words")


def _mentions_by_joins(sents: DataFrame, names: DataFrame, tok_word: DataFrame, ratio: float, key: str) -> DataFrame:
    """The mentions of names and words too many for one task.  Sides are
    broadcast by their count only, as in ``_token_words``."""
    from ledgerlens.operators.joins import broadcast_or_merge
    from ledgerlens.session import materialize
    words = names.select("entity", "clean", "k", "m", F.posexplode(F.split("clean", " ")).alias("wpos", "word"))
    toks = sents.select(key, "sentence_index", F.explode(F.array_distinct(F.split("sentence", " "))).alias("token"))
    # Written once: word frequencies, candidates and their counts read it.
    sent_word = materialize(toks.join(broadcast_or_merge(tok_word), "token").select(key, "sentence_index", "word").distinct(), "sentence-words")
    # Probe with each entity's rarest words only: a direct match needs all k
    # words, a fuzzy match at least m = ceil(ratio * k), so every match
    # contains one of the entity's (k - m + 1) rarest words (prefix
    # filtering).  Common words never fan out to all their sentences x all
    # entities sharing them; candidates are then counted over all words.
    wfreq = sent_word.groupBy("word").agg(F.count(F.lit(1)).alias("wf"))
    wk = words.join(wfreq.hint("merge"), "word", "left").withColumn("wf", F.coalesce("wf", F.lit(0)))
    wrank = Window.partitionBy("entity").orderBy("wf", "word", "wpos")
    probe = materialize(wk.withColumn("_r", F.row_number().over(wrank)).filter(F.col("_r") <= F.col("k") - F.col("m") + 1)
                        .select("entity", "word"), "probes")
    cand_pairs = sent_word.join(broadcast_or_merge(probe), "word").select(key, "sentence_index", "entity").distinct()
    allw = cand_pairs.join(broadcast_or_merge(words.select("entity", "word", "wpos")), "entity")
    hits = (allw.join(sent_word.withColumn("_hit", F.lit(1)).hint("merge"), [key, "sentence_index", "word"], "left")
            .groupBy(key, "sentence_index", "entity").agg(F.count("_hit").alias("hits")))
    # Counts decide first; only sentences that hold enough words meet their text.
    fuzzy = (F.col("k") > 1) & (F.col("hits") >= F.col("k") * F.lit(ratio))
    cand = materialize(hits.join(broadcast_or_merge(names), "entity").filter((F.col("hits") == F.col("k")) | fuzzy), "mention-candidates")
    cand = broadcast_or_merge(cand).join(sents.select(key, "sentence_index", "sentence"), [key, "sentence_index"])
    direct = (F.col("hits") == F.col("k")) & F.col("sentence").contains(F.col("clean"))
    out = cand.withColumn("match_type", F.when(direct, "direct").when(fuzzy, "fuzzy")).filter(F.col("match_type").isNotNull())
    return out.select("entity", key, "sentence_index", "sentence", "match_type")


# ---------------------------------------------------------------------------
# Keyword labels (TXT-1..3) and label application (JON-5)
# ---------------------------------------------------------------------------

def _keywords_in(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    """The keywords of each mention, a row for each; a sentence is read once in a batch."""
    for batch in batches:
        texts = batch.column("lowered").dictionary_encode()
        text, found = automaton.matches(texts.dictionary.to_pylist())
        many = np.bincount(text, minlength=len(texts.dictionary))
        of, first = texts.indices.to_numpy(), np.cumsum(many) - many
        at = np.repeat(np.arange(len(of)), many[of])
        inside = np.arange(len(at)) - np.repeat(np.cumsum(many[of]) - many[of], many[of])
        out = batch.take(pa.array(at)).drop_columns(["lowered"])
        yield out.append_column("kw_order", pa.array(found[first[of[at]] + inside], pa.int32()))


def keyword_hits(mentions: DataFrame, keywords: Sequence[str] = rules.IRREGULARITY_KEYWORDS,
                 severity: dict = rules.SEVERITY_KEYWORDS, key: str = "doc_id") -> DataFrame:
    """TXT-1: one row per (mention, keyword) substring hit.

    Mentions stay where they are: an automaton of all keywords (flat arrays,
    as large as the list) runs over the different sentences of a batch, however
    many entities they mention and however many keywords there are."""
    words = list(keywords)
    automaton = Automaton(words)
    texts = mentions.filter(F.col(key).isNotNull() & F.col("sentence_index").isNotNull()).withColumn("lowered", F.lower("sentence"))
    schema = T.StructType([*mentions.schema.fields, T.StructField("kw_order", T.IntegerType())])
    found = texts.filter(F.col("lowered").isNotNull()).mapInArrow(partial(_keywords_in, automaton=automaton), schema)
    rank = {k: 3 if k in severity.get("high", []) else 2 if k in severity.get("medium", []) else 1 for k in words}
    at = F.col("kw_order") + 1
    return found.select(
        *mentions.columns, "kw_order", F.element_at(F.array(*[F.lit(k) for k in words]), at).alias("keyword"),
        F.element_at(F.array(*[F.lit(rank[k]) for k in words]), at).alias("sev_rank"))


def entity_labels(mentions: DataFrame, hits: DataFrame, key: str = "doc_id", evidence: int = 3) -> DataFrame:
    """TXT-2/3: one row per mentioned entity: flag, score (hit count),
    sorted distinct issues, severity (max hit severity, floor low), evidence
    count and the first ``evidence`` evidence sentences in (doc, sentence,
    keyword) order.  The evidence top-k is a ``row_number <= k`` filter, which
    Spark runs as a group limit before the shuffle."""
    g = hits.groupBy("entity").agg(F.count(F.lit(1)).alias("irregularity_score"),
                                   F.array_sort(F.collect_set("keyword")).alias("issues"),
                                   F.max("sev_rank").alias("_sev"))
    w = Window.partitionBy("entity").orderBy(key, "sentence_index", "kw_order")
    ev = (hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= evidence)
          .groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_rn", "sentence"))).alias("_ev")))
    ents = mentions.select("entity").distinct()
    # All three lie by entity; packed files of hits say little of their sentences, so none is broadcast.
    j = ents.join(g.hint("merge"), "entity", "left").join(ev.hint("merge"), "entity", "left")
    score = F.coalesce("irregularity_score", F.lit(0)).cast("int")
    sev = F.when(F.col("_sev") == 3, "high").when(F.col("_sev") == 2, "medium").otherwise("low")
    return j.select(F.col("entity").alias("entity_name"), (score > 0).cast("int").alias("audit_flag"),
                    score.alias("irregularity_score"),
                    F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
                    sev.alias("severity"), score.alias("evidence_count"),
                    F.coalesce(F.transform("_ev", lambda x: x["sentence"]), F.array().cast("array<string>"))
                    .alias("evidence_sentences"))


def apply_labels(df: DataFrame, labels: DataFrame, entity: str = "entity_name") -> DataFrame:
    """JON-5: defaults (0, 0, '', 'none', 0), overridden by the entity's
    label on every one of its rows (left join on the entity key)."""
    lab = labels.select(F.col("entity_name").alias("_e"), F.col("audit_flag").alias("_f"),
                        F.col("irregularity_score").alias("_s"),
                        F.array_join("issues", ", ").alias("_i"), F.col("severity").alias("_v"),
                        F.col("evidence_count").alias("_n"))
    base = df.drop(*[c for c in ("audit_flag", "irregularity_score", "detected_issues", "severity", "evidence_count")
                     if c in df.columns])
    j = base.join(lab.hint("merge"), base[entity] == lab["_e"], "left")
    return j.select(*base.columns,
                    F.coalesce("_f", F.lit(0)).alias("audit_flag"), F.coalesce("_s", F.lit(0)).alias("irregularity_score"),
                    F.coalesce("_i", F.lit("")).alias("detected_issues"), F.coalesce("_v", F.lit("none")).alias("severity"),
                    F.coalesce("_n", F.lit(0)).alias("evidence_count"))


def review_table(labels: DataFrame) -> DataFrame:
    """TXT-4 review rows: issues joined ', ', evidence joined ' | '."""
    return labels.select("entity_name", "audit_flag", "irregularity_score",
                         F.array_join("issues", ", ").alias("detected_issues"), "severity",
                         F.array_join("evidence_sentences", " | ").alias("evidence_sentences"))


def label_documents(df: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text",
                    keywords: Sequence[str] = rules.IRREGULARITY_KEYWORDS,
                    severity: dict = rules.SEVERITY_KEYWORDS) -> tuple[DataFrame, DataFrame]:
    """TXT-4: documents -> sentences -> mentions -> keyword hits -> labels,
    applied to the entity-year table.  Errors propagate (the reference
    silently returned all-zero labels)."""
    from ledgerlens.session import materialize
    s = materialize(sentences(docs, key, text), "sentences")      # read as tokens and as texts
    # mentions are read twice (entity set, keyword hits): written once, small next to the corpus
    m = materialize(entity_mentions(s, df.select("entity_name"), key=key), "mentions")
    h = materialize(keyword_hits(m, keywords, severity, key), "keyword-hits")     # read for scores and evidence
    lab = entity_labels(m, h, key)
    return apply_labels(df, lab), review_table(lab)


# ---------------------------------------------------------------------------
# Domain features and statistics (TXT-5..7)
# ---------------------------------------------------------------------------

def domain_features(df: DataFrame, text: str = "text", normalized: bool = False,
                    groups: dict = rules.DOMAIN_KEYWORDS) -> DataFrame:
    """TXT-5/6/7 on FN-5-normalised text: keyword scores, length, words,
    sentences, mean word length, token mention counts and derived scores."""
    t = F.col(text) if normalized else normalize_feature_text(F.col(text))
    d = df.withColumn("_t", t)
    words = F.filter(F.split("_t", " "), lambda w: w != "")
    sents = F.filter(F.split("_t", r"\."), lambda s: F.trim(s) != "")
    nw = F.size(words)
    cnt = lambda tok: F.coalesce(F.regexp_count(F.col("_t"), F.lit(re.escape(tok))), F.lit(0))
    d = d.withColumns({
        "domain_financial_score": count_present("_t", groups["financial"]),
        "domain_procedural_score": count_present("_t", groups["procedural"]),
        "domain_recovery_score": count_present("_t", groups["recovery"]),
        "domain_asset_score": count_present("_t", groups["asset"]),
        "domain_text_length": F.length("_t"),
        "domain_word_count": nw,
        "domain_sentence_count": F.size(sents),
        "domain_avg_word_length": F.when(nw > 0, F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / nw)
                                    .otherwise(F.lit(0.0)),
        "domain_currency_mentions": cnt("currency_amount") + cnt("dollar_amount"),
        "domain_numeric_mentions": cnt("numeric_value"),
        "domain_percentage_mentions": cnt("percentage_value"),
        "domain_date_mentions": cnt("date_value"),
        "domain_high_severity_score": count_present("_t", groups["high_severity"]),
        "domain_medium_severity_score": count_present("_t", groups["medium_severity"]),
    })
    d = d.withColumns({
        "domain_evidence_strength": F.col("domain_financial_score") * 3 + F.col("domain_procedural_score") * 2
        + F.col("domain_recovery_score"),
        "domain_compliance_risk": F.col("domain_high_severity_score") * 3 + F.col("domain_medium_severity_score") * 2,
        "domain_complexity_score": F.col("domain_word_count") / 100.0 + F.col("domain_sentence_count") / 20.0
        + F.col("domain_avg_word_length") / 10.0,
    })
    return d.drop("_t")


DOMAIN_COLUMNS = ["domain_financial_score", "domain_procedural_score", "domain_recovery_score", "domain_asset_score",
                  "domain_text_length", "domain_word_count", "domain_sentence_count", "domain_avg_word_length",
                  "domain_currency_mentions", "domain_numeric_mentions", "domain_percentage_mentions",
                  "domain_date_mentions", "domain_high_severity_score", "domain_medium_severity_score",
                  "domain_evidence_strength", "domain_compliance_risk", "domain_complexity_score"]


# ---------------------------------------------------------------------------
# TF-IDF (TXT-8)
# ---------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Unicode accent strip (NFKD, drop combining marks): a small per-value
    helper, Arrow-batched; Spark has no built-in for it."""
    def one(x):
        if x is None:
            return None
        if x.isascii():
            return x
        return "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))
    return s.map(one)


def english_stop_words() -> list[str]:
    """Spark ML's default English stop words (``StopWordsRemover``)."""
    from ledgerlens.functions.stopwords import ENGLISH_STOP_WORDS
    return list(ENGLISH_STOP_WORDS)


#: Words and terms up to which a list of them is written into the plan.
LISTED = 10_000


def doc_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: Sequence[str] | None = None,
               accents: bool = True) -> DataFrame:
    """(doc, tokens): ``\\w\\w+`` tokens in order, lower-cased, accents stripped, stop words removed."""
    sw = english_stop_words() if stop_words is None else list(stop_words)
    t = F.lower(F.col(text))
    if accents:
        t = strip_accents(t)
    d = docs.select(key, F.regexp_extract_all(t, F.lit(r"(?U)[\p{L}\p{N}_]{2,}"), 0).alias("tokens"))
    return d.select(key, F.filter("tokens", lambda x: ~x.isin(sw)).alias("tokens")) if sw else d


def _gram(n: int):
    """The n tokens from one on, joined by spaces; null if one of them is."""
    return lambda i: F.concat(*[c for j in range(n) for c in (F.lit(" "), F.get("tokens", i + j))][1:])


def doc_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: tuple[int, int] = (1, 3),
              stop_words: Sequence[str] | None = None, accents: bool = True, partition: bool = True,
              tokens: bool = False, words: Sequence[str] | None = None, terms: Sequence[str] | None = None) -> DataFrame:
    """(doc, term, count): 1..3-grams of the tokens (``tokens``: docs are rows of ``doc_tokens``).

    Documents are hash-partitioned by their key *before* tokenising: one
    shuffle of the raw text, after which the (doc, term) count is satisfied
    by that partitioning (no second exchange of the 3x larger n-gram rows).
    With ``partition=False`` texts stay where they are and the counts, combined
    before their exchange, move instead: for a caller that keeps few of them,
    such as the terms of given ``words`` alone, or given ``terms`` alone."""
    if partition:
        docs = docs.repartition(F.col(key))
    d = docs.select(key, "tokens") if tokens else doc_tokens(docs, key, text, stop_words, accents)
    if terms is not None and words is None:
        words = sorted({w for t in terms for w in t.split(" ")})
    if words is not None and len(words) <= LISTED:           # a gap for the others: no term runs across it
        d = d.select(key, F.transform("tokens", lambda x: F.when(x.isin(list(words)), x)).alias("tokens"))
    size, grams = F.size("tokens"), []
    for n in range(ngram[0], ngram[1] + 1):
        grams.append(F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), _gram(n)))
                     .otherwise(F.array().cast("array<string>")))
    found = F.filter(F.flatten(F.array(*grams)), lambda g: g.isNotNull())
    if terms is not None and len(terms) <= LISTED:
        found = F.filter(found, lambda g: g.isin(list(terms)))
    return d.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequent_terms(tokens: DataFrame, n_docs: int, key: str = "doc_id", ngram: tuple[int, int] = (1, 3), max_features: int = 100,
                   max_df: float = 0.8, min_df: int = 1) -> DataFrame:
    """``doc_terms`` of ``doc_tokens`` rows without terms that can't be among the ``max_features`` most frequent: a
    term is no more frequent than any of its words, so if that many words reach a frequency, terms with a rarer word
    are out.  The counts of all other terms are whole."""
    every = doc_terms(tokens, key, ngram=ngram, partition=False, tokens=True)
    if ngram[0] > 1:
        return every
    single = doc_terms(tokens, key, ngram=(1, 1), partition=False, tokens=True)
    freq = single.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    from ledgerlens.session import materialize
    freq = materialize(freq, "words")
    top = freq.filter((F.col("df") <= F.floor(F.lit(n_docs) * F.lit(max_df))) & (F.col("df") >= min_df)) \
        .orderBy(F.desc("freq")).select("freq").limit(max_features).collect() if max_features <= LISTED else []
    if not top or len(top) < max_features:
        return every
    words = [r["term"] for r in freq.filter(F.col("freq") >= top[-1]["freq"]).select("term").limit(LISTED + 1).collect()]
    return every if len(words) > LISTED else doc_terms(tokens, key, ngram=ngram, partition=False, tokens=True, words=words)


def fit_tfidf(terms: DataFrame, n_docs, max_features: int = 100, max_df: float = 0.8,
              min_df: int = 1) -> DataFrame:
    """Vocabulary (<= max_features terms by corpus frequency, ties by term)
    with smooth idf = ln((1+n)/(1+df)) + 1 and a 0-based column index.
    ``n_docs`` counts every document, including ones without terms."""
    n = n_docs if isinstance(n_docs, F.Column) else F.lit(n_docs)
    st = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    st = st.filter((F.col("df") <= F.floor(n * F.lit(max_df))) & (F.col("df") >= min_df))
    top = st.orderBy(F.desc("freq"), F.asc("term")).limit(max_features)
    vocab = top.select("term", "df", "freq", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    return vocab.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


def transform_tfidf(terms: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long L2-normalised weights (doc, term, idx, weight).  The vocabulary is
    at most ``max_features`` rows -- a bounded broadcast."""
    j = terms.join(F.broadcast(vocab.select("term", "idx", "idf")), "term")
    j = j.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return j.select(key, "term", "idx", (F.col("w") / norm).alias("weight"))


def corpus_summary(docs: DataFrame, mentions: DataFrame, labels: DataFrame, key: str = "doc_id",
                   text: str = "text", sample_chars: int = 500) -> DataFrame:
    """AGG-28: per document length, entities mentioned, entities with
    irregularities, total score, and the first 500 characters."""
    m = mentions.select(key, F.col("entity").alias("entity_name")).distinct()
    ml = m.join(labels.select("entity_name", "irregularity_score"), "entity_name", "left")
    per = ml.groupBy(key).agg(F.count(F.lit(1)).alias("entities_mentioned"),
                              F.count(F.when(F.col("irregularity_score") > 0, 1)).alias("entities_with_irregularities"),
                              F.coalesce(F.sum("irregularity_score"), F.lit(0)).alias("total_irregularity_score"))
    d = docs.select(key, F.length(text).cast("long").alias("text_length"),
                    F.substring(text, 1, sample_chars).alias("sample_text"))
    j = d.join(per, key, "left")
    return j.select(key, "text_length", F.coalesce("entities_mentioned", F.lit(0)).alias("entities_mentioned"),
                    F.coalesce("entities_with_irregularities", F.lit(0)).alias("entities_with_irregularities"),
                    F.coalesce("total_irregularity_score", F.lit(0)).alias("total_irregularity_score"), "sample_text")
