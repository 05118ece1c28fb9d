"""Registered text queries: assembly, normalisation, sentences, entity
mentions, keyword labels, domain features, TF-IDF and corpus summary."""

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import rules as RL
from ledgerlens.functions.stopwords import ENGLISH_STOP_WORDS
from ledgerlens.operators import text as TX
from ledgerlens.operators.text_extractor import TextFeatures
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.oracle_fixtures import EY, with_
from ledgerlens.plans.registry import register
from ledgerlens.session import materialize, scratch_path
from ledgerlens.sources import fixtures as fx, io as IO
from ledgerlens.sources.tables import table

r = S.r

# Entity names beside those of the benchmark table (one word, filler
# words, a legal suffix), and words of the driver's invented prose beside the
# whole keyword list (FIXTURES.md part B).
ENT_NAMES = ["License", "That With", "The From And This", "Free Ltd"]
KW_PROSE = {"high": ["worthless", "idiot"], "medium": ["license"], "low": ["free"]}
KW_KEYWORDS = RL.IRREGULARITY_KEYWORDS + [k for words in KW_PROSE.values() for k in words]
KW_SEVERITY = {level: RL.SEVERITY_KEYWORDS[level] + words for level, words in KW_PROSE.items()}

_SUF = "|".join(RL.LEGAL_SUFFIXES)
_FILL = "the|of|and|&"

DOCS = "docs AS (SELECT doc_id, text FROM documents)"
NORM = """norm AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '\\s+', ' ', 'g'), 'page \\d+', '', 'g'), 'ghana audit service', '', 'g'), 'auditor[- ]general', '', 'g')) AS t FROM docs)"""
SENTS = """sp AS (SELECT doc_id, regexp_split_to_array(t, '[.!?]+') AS arr FROM norm),
sx AS (SELECT doc_id, unnest(arr) AS s, generate_subscripts(arr, 1) - 1 AS sentence_index FROM sp),
sents AS (SELECT doc_id, sentence_index, trim(s) AS sentence FROM sx WHERE length(trim(s)) >= 10)"""


def _clean_sql(col):
    return (f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({col}), '(?i)\\b({_SUF})\\b', '', 'g'), "
            f"'(?i)\\b({_FILL})\\b', ' ', 'g'), '\\s+', ' ', 'g')))")


ENTS = ("ents AS (SELECT DISTINCT entity FROM (SELECT array_to_string(list_slice(string_split(trim(regexp_replace(text, "
        "'[^\\pL\\pN]+', ' ', 'g')), ' '), 1, 4), ' ') AS entity FROM benchmark UNION ALL SELECT * FROM (VALUES "
        + ", ".join(f"({S.q(n)})" for n in ENT_NAMES) + ") v(entity)) z WHERE length(entity) > 0), "
        f"ec AS (SELECT entity, {_clean_sql('entity')} AS clean FROM ents), "
        "ec2 AS (SELECT *, string_split(clean, ' ') AS w FROM ec WHERE length(clean) > 0)")
MEN = """men0 AS (SELECT e.entity, s.doc_id, s.sentence_index, s.sentence,
  CASE WHEN contains(s.sentence, e.clean) THEN 'direct'
       WHEN len(e.w) > 1 AND list_sum(list_transform(e.w, lambda x: CAST(contains(s.sentence, x) AS INT))) >= len(e.w) * 0.6
       THEN 'fuzzy' END AS match_type FROM sents s, ec2 e),
men AS (SELECT * FROM men0 WHERE match_type IS NOT NULL)"""
_KWV = ", ".join(f"({i}, {S.q(k)})" for i, k in enumerate(KW_KEYWORDS))
HITS = f"""kw(kw_order, keyword) AS (VALUES {_KWV}),
hits AS (SELECT m.*, kw.kw_order, kw.keyword,
  CASE WHEN kw.keyword IN ({', '.join(S.q(k) for k in KW_SEVERITY['high'])}) THEN 3
       WHEN kw.keyword IN ({', '.join(S.q(k) for k in KW_SEVERITY['medium'])}) THEN 2 ELSE 1 END AS sev_rank
  FROM men m JOIN kw ON contains(lower(m.sentence), kw.keyword))"""
LABELS = """hg AS (SELECT entity, count(*) AS sc, list_sort(list_distinct(list(keyword))) AS issues, max(sev_rank) AS sv
  FROM hits GROUP BY entity),
hr AS (SELECT entity, sentence, row_number() OVER (PARTITION BY entity ORDER BY doc_id, sentence_index, kw_order) AS rn FROM hits),
he AS (SELECT entity, string_agg(sentence, ' | ' ORDER BY rn) AS evidence FROM hr WHERE rn <= 3 GROUP BY entity),
lab AS (SELECT m.entity AS entity_name, CAST(coalesce(hg.sc, 0) > 0 AS INT) AS audit_flag,
  CAST(coalesce(hg.sc, 0) AS INT) AS irregularity_score, coalesce(array_to_string(hg.issues, ', '), '') AS issues,
  CASE WHEN hg.sv = 3 THEN 'high' WHEN hg.sv = 2 THEN 'medium' ELSE 'low' END AS severity,
  CAST(coalesce(hg.sc, 0) AS INT) AS evidence_count, coalesce(he.evidence, '') AS evidence
  FROM (SELECT DISTINCT entity FROM men) m LEFT JOIN hg ON m.entity = hg.entity LEFT JOIN he ON m.entity = he.entity)"""


def _sents(spark, sf):
    return TX.sentences(fx.report_documents(spark, sf))


def _ents(spark, sf):
    return fx.report_entities(spark, sf, ENT_NAMES)


def _mentions(spark, sf):
    from ledgerlens.session import materialize
    # sentences are read as tokens and as texts: cleaned and split once
    return TX.entity_mentions(materialize(_sents(spark, sf), "sentences"), _ents(spark, sf))


def _labels(spark, sf):
    from ledgerlens.session import materialize
    m = materialize(_mentions(spark, sf), "mentions")
    h = materialize(TX.keyword_hits(m, KW_KEYWORDS, KW_SEVERITY), "keyword-hits")      # read for scores and evidence
    return m, h, TX.entity_labels(m, h)


@register("src_assemble_conversations", """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations WHERE text IS NOT NULL AND length(text) > 0 GROUP BY conv_id""")
def q_assemble(spark, sf):
    """SRC-5: multi-part document assembly (conversation turns in order)."""
    return TX.assemble_documents(table(spark, sf, "conversations"))


@register("fn_report_text", with_(DOCS, NORM) + "SELECT doc_id, t AS text FROM norm")
def q_report_text(spark, sf):
    """FN-2: report text normalisation of every document."""
    d = fx.report_documents(spark, sf)
    return d.select("doc_id", TX.normalize_report_text(F.col("text")).alias("text"))


@register("fn_sentences", with_(DOCS, NORM, SENTS) + "SELECT doc_id, sentence_index, sentence FROM sents")
def q_sentences(spark, sf):
    """FN-3: sentence split with original indexes."""
    return _sents(spark, sf)


@register("fn_clean_legal_names", with_(EY) + f""", n AS (SELECT DISTINCT entity_name AS name FROM ey
  UNION ALL SELECT * FROM (VALUES {', '.join(f'({S.q(x)})' for x in ENT_NAMES + ['A & B Corp', 'Ministry of Finance and Trade', 'Inc.'])}) v(name))
SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '(?i)\\b({_SUF})\\b', '', 'g'),
  '(?i)\\b({_FILL})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM n""")
def q_clean_legal_names(spark, sf):
    """FN-4: legal-name cleaning over all entity names plus edge cases."""
    names = fx.entity_year(spark, sf).select(F.col("entity_name").alias("name")).distinct()
    extra = spark.createDataFrame([(x,) for x in ENT_NAMES + ["A & B Corp", "Ministry of Finance and Trade", "Inc."]],
                                  "name string")
    n = names.unionByName(extra)
    return n.select("name", TX.clean_legal_name(F.col("name")).alias("clean"))


FE_SQL = """fe AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(text), '[^\\pL\\pN_\\s\\-.,%$]', ' ', 'g'),
  'gh[sc]?\\s*\\d+[\\d,.\\s]*', 'currency_amount', 'g'), '\\$\\s*\\d+[\\d,.\\s]*', 'dollar_amount', 'g'),
  '\\d+\\.\\d{2}%', 'percentage_value', 'g'), '\\d+[,\\d]*\\.\\d+', 'numeric_value', 'g'),
  '\\d{4}[-/]\\d{2}[-/]\\d{2}', 'date_value', 'g'), '\\s+', ' ', 'g')) AS t FROM docs)"""


@register("fn_feature_text", with_(DOCS, FE_SQL) + "SELECT doc_id, t AS text FROM fe")
def q_feature_text(spark, sf):
    """FN-5: feature-text normalisation (currency / dollar / percent / number / date tokens)."""
    d = fx.report_documents(spark, sf)
    return d.select("doc_id", TX.normalize_feature_text(F.col("text")).alias("text"))


@register("jon_entity_mentions", with_(DOCS, NORM, SENTS, ENTS, MEN) + """SELECT entity, doc_id, sentence_index,
  sentence, match_type FROM men""")
def q_entity_mentions(spark, sf):
    """JON-6: entity x sentence containment join through the token index."""
    return _mentions(spark, sf)


@register("txt_keyword_hits", with_(DOCS, NORM, SENTS, ENTS, MEN, HITS) + """SELECT entity, doc_id, sentence_index,
  keyword, sev_rank FROM hits""")
def q_keyword_hits(spark, sf):
    """TXT-1: (mention, keyword) hits."""
    _, h, _ = _labels(spark, sf)
    return h.select("entity", "doc_id", "sentence_index", "keyword", "sev_rank")


@register("txt_entity_labels", with_(DOCS, NORM, SENTS, ENTS, MEN, HITS, LABELS) + "SELECT * FROM lab")
def q_entity_labels(spark, sf):
    """TXT-2/3: per-entity label rows with severity and evidence."""
    _, _, lab = _labels(spark, sf)
    return lab.select("entity_name", "audit_flag", "irregularity_score", F.array_join("issues", ", ").alias("issues"),
                      "severity", "evidence_count", F.array_join("evidence_sentences", " | ").alias("evidence"))


@register("jon_apply_labels", with_(DOCS, NORM, SENTS, ENTS, MEN, HITS, LABELS) + f""", {EY[:-1]}),
base AS (SELECT entity_name, year FROM ey UNION ALL SELECT entity, 2001 FROM ents)
SELECT b.entity_name, b.year, coalesce(l.audit_flag, 0) AS audit_flag, coalesce(l.irregularity_score, 0) AS irregularity_score,
  coalesce(l.issues, '') AS detected_issues, coalesce(l.severity, 'none') AS severity,
  coalesce(l.evidence_count, 0) AS evidence_count FROM base b LEFT JOIN lab l ON b.entity_name = l.entity_name""".replace(
    "ey AS (", "ey AS (", 1))
def q_apply_labels(spark, sf):
    """JON-5: labels applied to every row of an entity (defaults elsewhere)."""
    _, _, lab = _labels(spark, sf)
    base = fx.entity_year(spark, sf).select("entity_name", "year").unionByName(
        _ents(spark, sf).withColumn("year", F.lit(2001)))
    return TX.apply_labels(base, lab).select("entity_name", "year", "audit_flag", "irregularity_score",
                                             "detected_issues", "severity", "evidence_count")


_WORDS = "list_filter(string_split(t, ' '), lambda w: w <> '')"
_DOM = {k: RL.DOMAIN_KEYWORDS[k] for k in RL.DOMAIN_KEYWORDS}


def _cnt(tok):
    return f"len(regexp_extract_all(t, '{tok}'))"


DOMAIN_SQL = f"""dm AS (SELECT doc_id, CAST({S.count_present('t', _DOM['financial'])} AS BIGINT) AS domain_financial_score,
  CAST({S.count_present('t', _DOM['procedural'])} AS BIGINT) AS domain_procedural_score,
  CAST({S.count_present('t', _DOM['recovery'])} AS BIGINT) AS domain_recovery_score,
  CAST({S.count_present('t', _DOM['asset'])} AS BIGINT) AS domain_asset_score,
  length(t) AS domain_text_length, len({_WORDS}) AS domain_word_count,
  len(list_filter(string_split(t, '.'), lambda s: trim(s) <> '')) AS domain_sentence_count,
  CASE WHEN len({_WORDS}) > 0 THEN list_avg(list_transform({_WORDS}, lambda w: length(w))) ELSE 0.0 END AS domain_avg_word_length,
  {_cnt('currency_amount')} + {_cnt('dollar_amount')} AS domain_currency_mentions, {_cnt('numeric_value')} AS domain_numeric_mentions,
  {_cnt('percentage_value')} AS domain_percentage_mentions, {_cnt('date_value')} AS domain_date_mentions,
  CAST({S.count_present('t', _DOM['high_severity'])} AS BIGINT) AS domain_high_severity_score,
  CAST({S.count_present('t', _DOM['medium_severity'])} AS BIGINT) AS domain_medium_severity_score FROM fe)"""


@register("txt_domain_features", with_(DOCS, FE_SQL, DOMAIN_SQL) + f"""SELECT doc_id, domain_financial_score,
  domain_procedural_score, domain_recovery_score, domain_asset_score, domain_text_length, domain_word_count,
  domain_sentence_count, {r('domain_avg_word_length')} AS domain_avg_word_length, domain_currency_mentions,
  domain_numeric_mentions, domain_percentage_mentions, domain_date_mentions, domain_high_severity_score,
  domain_medium_severity_score,
  CAST(domain_financial_score * 3 + domain_procedural_score * 2 + domain_recovery_score AS BIGINT) AS domain_evidence_strength,
  CAST(domain_high_severity_score * 3 + domain_medium_severity_score * 2 AS BIGINT) AS domain_compliance_risk,
  {r('domain_word_count / 100.0 + domain_sentence_count / 20.0 + domain_avg_word_length / 10.0')} AS domain_complexity_score
FROM dm""")
def q_domain_features(spark, sf):
    """TXT-5/6/7: domain keyword scores, text statistics and derived scores."""
    d = TX.domain_features(fx.report_documents(spark, sf))
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) if c not in (
        "domain_avg_word_length", "domain_complexity_score") else F.col(c) for c in TX.DOMAIN_COLUMNS])


_SW = "[" + ", ".join(S.q(w) for w in ENGLISH_STOP_WORDS) + "]"
TFIDF_SQL = f"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(t)), '[\\pL\\pN_]{{2,}}'),
  lambda x: NOT list_contains({_SW}, x)) AS toks FROM fe),
gr AS (SELECT doc_id, unnest(list_concat(toks,
  CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END,
  CASE WHEN len(toks) >= 3 THEN list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]) ELSE [] END)) AS term FROM tk),
tf AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM docs),
st AS (SELECT term, count(*) AS df, sum(tf) AS freq FROM tf GROUP BY term),
voc AS (SELECT term, df, freq, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, nd WHERE df <= floor(n * 0.8) AND df >= 1
  ORDER BY freq DESC, term LIMIT 100),
tw AS (SELECT tf.doc_id, tf.term, tf.tf * voc.idf AS w FROM tf JOIN voc ON tf.term = voc.term)"""


def _tfidf(spark, sf):
    docs = fx.report_documents(spark, sf)
    fe = docs.select("doc_id", TX.normalize_feature_text(F.col("text")).alias("text"))
    tokens = materialize(TX.doc_tokens(fe), "tokens")      # read by the fit and by the weights
    n_docs = docs.count()
    vocab = materialize(TX.fit_tfidf(TX.frequent_terms(tokens, n_docs), n_docs), "vocabulary")
    terms = TX.doc_terms(tokens, tokens=True, partition=False, terms=[r["term"] for r in vocab.select("term").collect()])   # max_features rows
    return vocab, TX.transform_tfidf(terms, vocab)


@register("txt_tfidf_vocabulary", with_(DOCS, FE_SQL, TFIDF_SQL) + f"SELECT term, df, CAST(freq AS BIGINT) AS freq, {r('idf')} AS idf FROM voc")
def q_tfidf_vocab(spark, sf):
    """TXT-8: fitted vocabulary (top 100 1-3-grams) with smooth idf."""
    vocab, _ = _tfidf(spark, sf)
    return vocab.select("term", "df", "freq", "idf")


@register("txt_tfidf_weights", with_(DOCS, FE_SQL, TFIDF_SQL) + f"""SELECT doc_id, term,
  {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM tw""")
def q_tfidf_weights(spark, sf):
    """TXT-8: L2-normalised TF-IDF weights, long form."""
    _, w = _tfidf(spark, sf)
    return w.select("doc_id", "term", "weight")


def _extractor(spark, sf):
    """The text extractor fitted on documents of even id, saved and loaded (SRC-6); all documents."""
    docs = fx.report_documents(spark, sf)
    fitted = TextFeatures().fit(docs.filter(F.col("doc_id") % 2 == 0))
    path = scratch_path(spark, f"extractor-{uuid.uuid4().hex}")
    return IO.load_model(IO.save_model(fitted, path), type(fitted)), docs


_EVEN_FIT = TFIDF_SQL.replace("nd AS (SELECT count(*) AS n FROM docs)", "nd AS (SELECT count(*) AS n FROM docs WHERE doc_id % 2 = 0)").replace(
    "FROM tf GROUP BY term)", "FROM tf WHERE doc_id % 2 = 0 GROUP BY term)")


@register("txt_extractor_weights", with_(DOCS, FE_SQL, _EVEN_FIT) + f"""SELECT doc_id, term,
  {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM tw WHERE doc_id % 2 = 1""")
def q_extractor_weights(spark, sf):
    """TXT-10 / SRC-6: extractor fitted on even documents, saved, loaded; TF-IDF weights of the odd ones."""
    model, docs = _extractor(spark, sf)
    return model.tfidf(docs.filter(F.col("doc_id") % 2 == 1)).select("doc_id", "term", "weight")


@register("txt_extractor_features", with_(DOCS, FE_SQL, DOMAIN_SQL, _EVEN_FIT) + f"""SELECT doc_id, (SELECT greatest(least(50, count(*) - 1, (SELECT n - 1 FROM nd)), 1) FROM voc) AS components,
  domain_financial_score, domain_text_length, domain_word_count, domain_sentence_count, {r('domain_avg_word_length')} AS domain_avg_word_length,
  CAST(domain_financial_score * 3 + domain_procedural_score * 2 + domain_recovery_score AS BIGINT) AS domain_evidence_strength FROM dm WHERE doc_id % 2 = 1""")
def q_extractor_features(spark, sf):
    """TXT-10: the fitted extractor's features of odd documents: number of components and the domain features."""
    model, docs = _extractor(spark, sf)
    out = model.transform(docs.filter(F.col("doc_id") % 2 == 1))
    components = sum(F.col(c).isNotNull().cast("int") for c in out.columns if c.startswith("tfidf_svd_"))
    return out.select("doc_id", components.cast("long").alias("components"), *[F.col(c).cast("long").alias(c) for c in (
        "domain_financial_score", "domain_text_length", "domain_word_count", "domain_sentence_count")],
        "domain_avg_word_length", F.col("domain_evidence_strength").cast("long").alias("domain_evidence_strength"))


@register("txt_svd_invariants", with_(DOCS, FE_SQL, _EVEN_FIT) + """SELECT CAST(i AS INT) AS component, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS overlap, 0.0::DOUBLE AS residual,
  0.0::DOUBLE AS lowest, 1.0::DOUBLE AS highest, 1 AS in_order FROM range((SELECT greatest(least(50, count(*) - 1, (SELECT n - 1 FROM nd)), 1) FROM voc)) t(i)""")
def q_svd_invariants(spark, sf):
    """TXT-9: what makes the fitted basis the SVD of the even documents: unit, orthogonal vectors that solve the
    eigenvalue equation of the Gram matrix, in falling order, with components scaled to 0..1 on the fitted rows."""
    import numpy as np
    model, docs = _extractor(spark, sf)
    even = docs.filter(F.col("doc_id") % 2 == 0)
    plain = materialize(model.components_of(even, scaled=False), "components")
    names = [c for c in plain.columns if c.startswith("tfidf_svd_")]
    k, terms = len(names), model.tables["vocabulary"].count()
    basis = np.zeros((terms, k))
    for b in model.tables["basis"].collect():                       # maxFeatures x k numbers
        basis[b["idx"], b["comp"]] = b["loading"]
    image = np.zeros((terms, k))                                    # X^T X V, by Spark
    for g in model.tfidf(even).join(plain, "doc_id").groupBy("idx").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in names]).collect():
        image[g["idx"]] = [g[c] for c in names]
    energy = np.array(plain.agg(*[F.sum(F.col(c) * F.col(c)) for c in names]).first(), float)
    ends = model.components_of(even).agg(*[F.struct(F.min(c), F.max(c)) for c in names]).first()
    dots = basis.T @ basis
    rows = [(i, float(dots[i, i]), float(np.abs(np.delete(dots[i], i)).max(initial=0)), float(np.abs(image[:, i] - energy[i] * basis[:, i]).max() / max(energy[0], 1e-9)),
             float(ends[i][0]), float(ends[i][1]), int(i == 0 or energy[i] <= energy[i - 1] + 1e-9)) for i in range(k)]
    return spark.createDataFrame(rows, "component int, norm double, overlap double, residual double, lowest double, highest double, in_order int")


@register("agg_corpus_summary", with_(DOCS, NORM, SENTS, ENTS, MEN, HITS, LABELS) + """, md AS (SELECT DISTINCT doc_id, entity FROM men),
per AS (SELECT md.doc_id, count(*) AS em, count(CASE WHEN lab.irregularity_score > 0 THEN 1 END) AS ei,
  coalesce(sum(lab.irregularity_score), 0) AS ts FROM md LEFT JOIN lab ON md.entity = lab.entity_name GROUP BY md.doc_id)
SELECT d.doc_id, length(d.text) AS text_length, coalesce(per.em, 0) AS entities_mentioned,
  coalesce(per.ei, 0) AS entities_with_irregularities, CAST(coalesce(per.ts, 0) AS BIGINT) AS total_irregularity_score,
  substr(d.text, 1, 500) AS sample_text FROM docs d LEFT JOIN per ON d.doc_id = per.doc_id""")
def q_corpus_summary(spark, sf):
    """AGG-28: per-document corpus analysis summary."""
    m, _, lab = _labels(spark, sf)
    return TX.corpus_summary(fx.report_documents(spark, sf), m, lab)
