"""Queries on text, similarity, scoring, alignment, review and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.functions import text as T
from valograph.operators import alignment as A
from valograph.operators import relational as R
from valograph.operators import sampling as P
from valograph.operators.filematch import fuzzy_file_matches
from valograph.operators.reliability import filled
from valograph.operators.scoring import rule_scores, score_incrementally, with_quality
from valograph.operators.similarity import character_similarity, word_similarity
from valograph.session import materialise
from valograph.sources.readers import bind_files, read_table
from valograph.workload import model as M
from valograph.workload.articles import article_edges, article_sql, articles
from valograph.workload.model import sql
from valograph.workload.rankings import char_terms_sql, similarity_ctes, word_terms_sql
from valograph.workload.registry import query
from valograph.workload.scalars import STRATUM_SQL, r6

NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


@query("txt_normalize", f"SELECT doc_id, md5({NORM.format(c='text')}) AS digest FROM documents")
def txt_normalize(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.normalise("text")).alias("digest"))


_FOLD = "array_to_string(list_transform(string_split(lower(text), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')"


@query("txt_normalize_loose", f"SELECT doc_id, md5({NORM.format(c=_FOLD)}) AS digest, md5(replace({NORM.format(c=_FOLD)}, ' ', '')) AS solid FROM documents")
def txt_normalize_loose(spark, d):
    t = _documents(spark, d).withColumn("t", T.normalise_loose("text"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.md5(T.compact("t")).alias("solid"))


@query("txt_core_title", r"SELECT doc_id, md5(regexp_split_to_array(text, '[:\-–—]')[1]) AS head FROM documents")
def txt_core_title(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(T.core_title("text")).alias("head"))


_TOKENS = f"list_distinct(list_filter(string_split({NORM.format(c='text')}, ' '), lambda w: length(w) > 2 AND NOT list_contains({C.TITLE_STOP_WORDS}, w)))"


@query("txt_token_set", f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS tokens, md5(array_to_string(list_sort({_TOKENS}), ' ')) AS digest FROM documents")
def txt_token_set(spark, d):
    t = _documents(spark, d).withColumn("s", T.token_set(T.normalise("text")))
    return t.select("doc_id", F.size("s").alias("tokens"), F.md5(F.array_join(F.array_sort("s"), " ")).alias("digest"))


@query("txt_jaccard", f"""WITH c AS (SELECT conv_id, turn, {_TOKENS} AS s FROM conversations)
  SELECT a.conv_id, a.turn, round(len(list_intersect(a.s, b.s)) / greatest(1, len(list_distinct(list_concat(a.s, b.s)))), 6) AS jaccard,
    round(len(list_intersect(a.s, b.s)) / greatest(1, len(a.s)), 6) AS recall FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def txt_jaccard(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", T.token_set(T.normalise("text")).alias("s"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"))
    j = c.join(after, ["conv_id", "turn"])
    return j.select("conv_id", "turn", r6(T.jaccard(F.col("s"), F.col("t"))).alias("jaccard"), r6(T.recall(F.col("s"), F.col("t"))).alias("recall"))


# The sequence ratio sums the longest common block of two strings and, in turn, those left and right of it.
RATIO_CTES = {
    "equal_at": """SELECT title, name, i, j, len(list_filter(range(1, (least(length(title) - i, length(name) - j) + 2)::INT), lambda k: substr(title, i::INT, k::INT) = substr(name, j::INT, k::INT))) AS k
      FROM (SELECT title, name, i, unnest(range(1, length(name) + 1)) AS j FROM (SELECT title, name, unnest(range(1, length(title) + 1)) AS i FROM compared))
      WHERE substr(title, i::INT, 1) = substr(name, j::INT, 1)""",
    "pieces_of": """SELECT title, name, 1::BIGINT AS a, length(title) + 1 AS z, 1::BIGINT AS b, length(name) + 1 AS y, 0::BIGINT AS k FROM compared
      UNION ALL SELECT title, name, if(side = 0, a, m.i + m.k), if(side = 0, m.i, z), if(side = 0, b, m.j + m.k), if(side = 0, m.j, y), if(side = 0, m.k, 0) FROM (
        SELECT p.title, p.name, p.a, p.z, p.b, p.y, max({'k': least(e.k, p.z - e.i, p.y - e.j), 'ni': -e.i, 'nj': -e.j, 'i': e.i, 'j': e.j}) AS m
        FROM pieces_of p JOIN equal_at e ON e.title = p.title AND e.name = p.name AND e.i >= p.a AND e.i < p.z AND e.j >= p.b AND e.j < p.y GROUP BY ALL) CROSS JOIN (VALUES (0), (1)) s(side)""",
    "ratios": "SELECT title, name, 2.0::DOUBLE * sum(k)::DOUBLE / (length(title) + length(name)) AS ratio FROM pieces_of GROUP BY title, name",
}


def ratio_sql(compared: str, **before: str) -> str:
    """Common table expressions ending in ``ratios(title, name, ratio)`` for the distinct pairs of ``compared``."""
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in {**before, "compared": compared, **RATIO_CTES}.items())


_SPACED = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_TITLES = {
    "paired": "SELECT p_partkey, p_name AS title, concat_ws(' ', p_brand, reverse(p_name), p_type) AS entry FROM part",
    "folded": rf"""SELECT DISTINCT title, entry, {_SPACED.format(c='title')} AS a, {_SPACED.format(c='entry')} AS b, replace({_SPACED.format(c='title')}, ' ', '') AS sa, replace({_SPACED.format(c='entry')}, ' ', '') AS sb,
        replace({_SPACED.format(c="regexp_split_to_array(title, '[:–—-]')[1]")}, ' ', '') AS ca, replace({_SPACED.format(c="regexp_split_to_array(entry, '[:–—-]')[1]")}, ' ', '') AS cb FROM paired""",
}
_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 2 AND NOT list_contains(" + str(list(C.TITLE_STOP_WORDS)) + ", w)))"


def _part_titles(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", F.reverse("p_name"), "p_type").alias("entry"))


@query("txt_seq_ratio", ratio_sql("SELECT DISTINCT title, entry AS name FROM paired", **_TITLES) + " SELECT p_partkey, round(ratio, 6) AS ratio FROM paired JOIN ratios r ON r.title = paired.title AND r.name = entry")
def txt_seq_ratio(spark, d):
    return _part_titles(spark, d).select("p_partkey", r6(T.sequence_ratio("p_name", "entry")).alias("ratio"))


@query("txt_title_similarity", ratio_sql("SELECT DISTINCT a AS title, b AS name FROM folded", **_TITLES) + """
  SELECT p_partkey, round(CASE WHEN contains(b, a) OR contains(a, b) THEN greatest(ratio, 0.95)
    ELSE 0.65::DOUBLE * ratio + 0.35::DOUBLE * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / greatest(1, len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))) END, 6) AS similarity
  FROM paired JOIN folded USING (title, entry) JOIN ratios r ON r.title = a AND r.name = b""")
def txt_title_similarity(spark, d):
    t = _part_titles(spark, d)
    return t.select("p_partkey", r6(T.title_similarity(T.normalise("p_name"), T.normalise("entry"))).alias("similarity"))


@query("txt_title_score", ratio_sql("SELECT a AS title, b AS name FROM folded UNION SELECT sa, sb FROM folded UNION SELECT ca, cb FROM folded WHERE ca <> '' AND cb <> ''", **_TITLES) + f"""
  , steps AS (SELECT folded.title, entry, sa, sb, ca, rl.ratio AS loose, rs.ratio AS solid, coalesce(rc.ratio, 0.0) AS core,
      len(list_intersect({_WORDS.format(c='a')}, {_WORDS.format(c='b')})) / greatest(1, len({_WORDS.format(c='a')})) AS recall
    FROM folded JOIN ratios rl ON rl.title = a AND rl.name = b JOIN ratios rs ON rs.title = sa AND rs.name = sb LEFT JOIN ratios rc ON rc.title = ca AND rc.name = cb),
  judged AS (SELECT title, entry, CASE WHEN contains(sb, sa) THEN 1 WHEN ca <> '' AND contains(sb, ca) THEN 2 WHEN solid >= 0.92 AND recall >= 0.6 THEN 3 WHEN core >= 0.9 AND recall >= 0.55 THEN 4 ELSE 5 END AS step,
    greatest(0.55::DOUBLE * loose + 0.25::DOUBLE * solid + 0.2::DOUBLE * recall, 0.95::DOUBLE * core) AS blend, solid, core FROM steps)
  SELECT p_partkey, round([0.99, 0.96, solid, core, blend][step], 6) AS score,
    ['title_compact_exact', 'core_title_exact', 'title_compact_fuzzy_high', 'core_title_fuzzy_high', 'title_fuzzy_candidate'][step] AS method FROM paired JOIN judged USING (title, entry)""")
def txt_title_score(spark, d):
    t = _part_titles(spark, d).withColumn("t", A.title_scores("p_name", "entry"))
    return t.select("p_partkey", r6("t.score").alias("score"), F.col("t.method").alias("method"))


@query("txt_doi", r"""SELECT page_id, regexp_extract(lower(x), '(10\.\d{4,9}/[-._;()/:a-z0-9]+)', 1) AS doi FROM (
  SELECT page_id, 'see DOI:10.' || (page_id % 20000) || '/' || upper(list_extract(string_split(url, '/'), 3)) || ' , ok' AS x FROM pages)""")
def txt_doi(spark, d):
    host = F.upper(F.element_at(F.split("url", "/"), 3))
    x = F.concat(F.lit("see DOI:10."), (F.col("page_id") % 20000).cast("string"), F.lit("/"), host, F.lit(" , ok"))
    return read_table(spark, d, "pages").select("page_id", T.doi(x).alias("doi"))


@query("txt_keyword_fallback", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM part")
def txt_keyword_fallback(spark, d):
    return read_table(spark, d, "part").select("p_partkey", T.keyword_fallback("p_name", ["red", "widget"]).alias("score"))


_CUES = ["the", "and", "that", "les", "der", "was"]


@query("txt_cues", rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b({'|'.join(_CUES)})\b'))), ', ') AS matched_cue_words,
  CAST(len(list_distinct(regexp_extract_all(lower(text), '\b({'|'.join(_CUES)})\b'))) AS INT) AS cue_count FROM documents WHERE regexp_matches(lower(text), '\b({'|'.join(_CUES)})\b')""")
def txt_cues(spark, d):
    return P.hard_cases(_documents(spark, d), "text", _CUES).select("doc_id", "matched_cue_words", "cue_count")


@query("txt_quality_meta", "SELECT doc_id, length(text) < 2000 OR (length(text) - length(replace(text, chr(65533), ''))) / greatest(1, length(text)) > 0.01 AS poor FROM documents")
def txt_quality_meta(spark, d):
    return _documents(spark, d).select("doc_id", T.poor_quality("text").alias("poor"))


@query("txt_expand_ranges", """SELECT l_orderkey, l_partkey, CAST(CASE WHEN l_quantity <= 20 THEN l_quantity + 1 ELSE 0 END AS BIGINT) AS numbers,
  CAST(CASE WHEN l_quantity <= 20 THEN (l_quantity + 1) * (l_linenumber + l_linenumber + l_quantity) / 2 ELSE 0 END AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY ALL""")
def txt_expand_ranges(spark, d):
    token = F.concat(F.col("l_linenumber").cast("string"), F.lit("–"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").cast("string"))
    l = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", T.expand_range(token).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return l.groupBy("l_orderkey", "l_partkey", F.size("x").cast("bigint").alias("numbers"), total.alias("total")).agg(F.count(F.lit(1)).alias("n"))


# --- articles -----------------------------------------------------------------------------


@query("txt_split_refs", article_sql("SELECT doc_id, CAST(length(body) AS INT) AS body_length, CAST(length(refs) AS INT) AS refs_length, md5(body) AS body_digest FROM arts"))
def txt_split_refs(spark, d):
    a = articles(spark, d).select("doc_id", T.body_text("full_text").alias("b"), T.reference_text("full_text").alias("r"))
    return a.select("doc_id", F.length("b").alias("body_length"), F.length("r").alias("refs_length"), F.md5("b").alias("body_digest"))


@query("txt_ref_entries", article_sql("""SELECT doc_id, CAST(CASE WHEN lang IN ('de', 'es') OR n < 3 THEN 0 ELSE n END AS INT) AS entries,
    CASE WHEN lang IN ('de', 'es') OR n < 3 THEN md5('') ELSE md5(es) END AS digest FROM arts JOIN (
      SELECT doc_id, string_agg(trim(entry_text), '|' ORDER BY i) AS es FROM marked GROUP BY doc_id) USING (doc_id)"""))
def txt_ref_entries(spark, d):
    a = articles(spark, d).select("doc_id", T.reference_text("full_text").alias("refs"))
    a = T.with_reference_entries(a, "refs", "e")
    return a.select("doc_id", F.size("e").alias("entries"), F.md5(F.array_join(F.transform("e", lambda x: x["entry"]), "|")).alias("digest"))


@query("txt_author_year_entries", article_sql("""SELECT doc_id, count(*) FILTER (WHERE lang = 'es' AND length(trim(entry)) >= 40) AS entries FROM marked GROUP BY doc_id"""))
def txt_author_year_entries(spark, d):
    a = articles(spark, d).select("doc_id", T.author_year_entries(T.reference_text("full_text")).alias("e"))
    return a.select("doc_id", F.size("e").cast("bigint").alias("entries"))


_SENT = {
    "cut": r"SELECT doc_id, string_split(regexp_replace(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)) AS raw FROM {t}",
    "sents": r"""SELECT doc_id, list_filter(list_transform(raw, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM cut""",
}


def _sent(column: str, table: str) -> dict[str, str]:
    return {"cut": _SENT["cut"].format(c=column, t=table), "sents": _SENT["sents"]}


@query("txt_sentences", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _sent("text", "documents").items()) + " SELECT doc_id, CAST(len(ss) AS INT) AS sentences, md5(array_to_string(ss, '|')) AS digest FROM sents")
def txt_sentences(spark, d):
    s = _documents(spark, d).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_MENTION_CTES = {
    **_sent("body", "arts"),
    "spots": "SELECT doc_id, ss, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS k FROM sents",
    "br": r"""SELECT doc_id, k, trim(regexp_replace(array_to_string(ss[greatest(1, k - 1):k + 1], ' '), '\s+', ' ', 'g')) AS win, unnest(regexp_extract_all(s, '\[([^\]]+)\]', 1)) AS inside FROM spots""",
    "tok": r"SELECT doc_id, k, win, CASE WHEN contains(inside, ',') THEN 'grouped' WHEN contains(inside, '-') THEN 'range' ELSE 'exact' END AS kind, unnest(regexp_split_to_array(inside, '[,\s;]+')) AS t FROM br",
    "nums": r"""SELECT doc_id, k, win, kind, unnest(CASE WHEN regexp_full_match(t, '\d+') THEN [t::INT]
        WHEN regexp_full_match(t, '\d+-\d+') AND split_part(t, '-', 1)::INT <= split_part(t, '-', 2)::INT AND split_part(t, '-', 2)::INT - split_part(t, '-', 1)::INT <= 20
        THEN range(split_part(t, '-', 1)::INT, split_part(t, '-', 2)::INT + 1)::INT[] ELSE []::INT[] END) AS number FROM tok""",
    "uniq": "SELECT doc_id, number, win, arg_min(kind, k) AS kind, min(k) AS k FROM nums GROUP BY ALL",
}


@query("txt_mentions", article_sql("""SELECT doc_id, number, count(*) AS mentions, count(*) FILTER (WHERE kind = 'grouped') AS grouped, count(*) FILTER (WHERE kind = 'range') AS ranges,
    md5(string_agg(win, '|' ORDER BY k)) AS digest FROM uniq GROUP BY doc_id, number""", **_MENTION_CTES))
def txt_mentions(spark, d):
    a = articles(spark, d).select("doc_id", T.body_text("full_text").alias("body")).withColumn("s", T.sentences("body"))
    a = a.select("doc_id", T.mention_index("s").alias("index"))
    found = T.mentions_by_number(materialise(a), "doc_id", "index").withColumnRenamed("mentions", "m")
    kinds = lambda k: F.size(F.filter("m", lambda m: m["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", "number", F.size("m").cast("bigint").alias("mentions"), kinds("grouped").alias("grouped"), kinds("range").alias("ranges"),
        F.md5(F.array_join(F.transform("m", lambda m: m["window"]), "|")).alias("digest"),
    )


@query("interval_match", article_sql("SELECT doc_id, k AS sentence, count(*) AS brackets FROM br GROUP BY doc_id, k", **{k: _MENTION_CTES[k] for k in ("cut", "sents", "spots", "br")}))
def interval_match(spark, d):
    a = articles(spark, d).select("doc_id", T.body_text("full_text").alias("body")).select("doc_id", T.sentences("body").alias("s"))
    # The outer form drops no rows itself, so Spark adds no filter that would build the article again to ask for its sentences.
    each = a.select("doc_id", F.posexplode_outer("s").alias("i", "text")).withColumn("brackets", F.regexp_count("text", F.lit(r"\[[^\]]+\]")).cast("bigint"))
    return each.where("brackets > 0").select("doc_id", (F.col("i") + 1).cast("bigint").alias("sentence"), "brackets")


def _parsed(spark, d):
    return A.parse_articles(articles(spark, d), "doc_id", "full_text")


_ALIGNED = ["edge_id", "target_reference_marker", "reference_match_method", "num_mentions", "context_type", "alignment_status"]


def _aligned(spark, d):
    parsed = materialise(_parsed(spark, d))
    return parsed, materialise(A.align_edges(article_edges(spark, d), parsed))


@query("best_entry_match")
def best_entry_match(spark, d):
    return A.align_edges(article_edges(spark, d), _parsed(spark, d)).select(*_ALIGNED, r6("reference_match_score").alias("score"))


@query("align_audit")
def align_audit(spark, d):
    parsed, aligned = _aligned(spark, d)
    facts = A.audit_failures(aligned, parsed).groupBy("failure_reason").agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("source_id").alias("source_count"))
    return R.complete_dimension(spark, C.FAILURE_REASONS, facts, "failure_reason", {"edge_count": 0, "source_count": 0})


@query("align_failures_by_source")
def align_failures_by_source(spark, d):
    parsed, aligned = _aligned(spark, d)
    return A.failures_by_source(aligned, A.audit_failures(aligned, parsed))


@query("align_rescue_round")
def align_rescue_round(spark, d):
    parsed, aligned = _aligned(spark, d)
    return A.rescue_candidates(aligned, parsed).select(*_ALIGNED, "upgrade_reason")


@query("coverage_compare")
def coverage_compare(spark, d):
    parsed, aligned = _aligned(spark, d)
    return A.coverage(aligned, "first").unionByName(A.coverage(A.rescue_candidates(aligned, parsed), "rescued"))


@query("extra_rescue_pool")
def extra_rescue_pool(spark, d):
    parsed, aligned = _aligned(spark, d)
    audited = A.audit_failures(aligned, parsed).withColumn("contexts", A.contexts_text("mentions"))
    return A.extra_rescue_pool(audited, "contexts").select("edge_id", r6("title_score").alias("title_score"), "title_score_method", "candidate_alignment_status")


# --- alignment rules on whole rows ------------------------------------------------------------

_METHODS = ["doi_exact", "title_exact", "title_fuzzy_high", "author_year_title_fuzzy", "author_title_fuzzy", "failed", "no_reference_entries"]
_FEATURES = f"""SELECT l_orderkey, l_partkey, l_suppkey, list_extract({_METHODS}, l_linenumber) AS method, round(l_discount * 10.0, 6) AS score, l_returnflag AS flag, l_linestatus AS status_flag,
  CAST(l_quantity AS INT) % 3 AS mentions, CASE l_returnflag WHEN 'A' THEN ['range', 'exact'] WHEN 'R' THEN ['grouped'] ELSE ['exact'] END AS kinds, round(l_tax * 25.0, 6) AS extra, CAST(l_quantity AS INT) AS qty FROM lineitem"""


def _features(spark, d):
    l = read_table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    kinds = F.when(flag == "A", F.array(F.lit("range"), F.lit("exact"))).when(flag == "R", F.array(F.lit("grouped"))).otherwise(F.array(F.lit("exact")))
    return l.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.element_at(F.lit(_METHODS), F.col("l_linenumber")).alias("method"), r6(F.col("l_discount") * 10.0).alias("score"),
        flag.alias("flag"), F.col("l_linestatus").alias("status_flag"), (F.col("l_quantity").cast("int") % 3).alias("mentions"), kinds.alias("kinds"),
        r6(F.col("l_tax") * 25.0).alias("extra"), F.col("l_quantity").cast("int").alias("qty"),
    )


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
_STATUS_SQL = """CASE WHEN method = 'doi_exact' AND mentions > 0 THEN CASE flag WHEN 'A' THEN 'range' WHEN 'R' THEN 'grouped' ELSE 'exact' END
  WHEN method IN ('title_exact', 'title_fuzzy_high') AND score >= 0.85 AND mentions > 0 THEN CASE flag WHEN 'A' THEN 'range' WHEN 'R' THEN 'grouped' ELSE 'high_confidence' END
  WHEN method IN ('author_year_title_fuzzy', 'author_title_fuzzy') AND mentions > 0 THEN 'ambiguous' WHEN method = 'failed' OR score = 0 THEN 'failed' ELSE 'ambiguous' END"""


@query("align_status", f"SELECT l_orderkey, l_partkey, l_suppkey, {_STATUS_SQL} AS status, CASE flag WHEN 'A' THEN 'mixed' WHEN 'R' THEN 'grouped' ELSE 'exact' END AS kind, count(*) AS n FROM ({_FEATURES}) GROUP BY ALL")
def align_status(spark, d):
    f = _features(spark, d)
    status = A.alignment_status(F.col("method"), F.col("score"), F.col("kinds"), F.col("mentions"))
    return f.groupBy(*_KEYS, status.alias("status"), A.context_type(F.col("kinds")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_REASON = """CASE WHEN NOT has_article THEN 'missing_pdf_or_text' WHEN poor AND (len < 2000 OR NOT has_refs) THEN 'poor_pdf_text_extraction' WHEN NOT has_refs THEN 'reference_section_not_found'
  WHEN method = 'no_reference_entries' AND ay > 0 THEN 'author_year_format_not_supported' WHEN method = 'no_reference_entries' AND num = 0 THEN 'reference_section_not_found'
  WHEN status = 'ambiguous' AND entry <> '' AND mentions = 0 THEN 'citation_marker_not_found' WHEN status = 'ambiguous' AND kind IN ('grouped', 'range', 'mixed') THEN 'grouped_or_range_uncertain'
  WHEN method = 'failed' AND entry <> '' AND marker <> '' AND mentions > 0 THEN 'title_fuzzy_match_failed' WHEN method = 'failed' AND entry <> '' THEN CASE WHEN score >= 0.75 THEN 'citation_marker_not_found' ELSE 'title_fuzzy_match_failed' END
  WHEN method = 'failed' THEN 'target_reference_entry_not_matched' WHEN method = 'pdf_missing' THEN 'missing_pdf_or_text' ELSE 'unknown' END"""


@query("align_failure_reason", f"""SELECT l_orderkey, l_partkey, l_suppkey, {_REASON} AS reason, count(*) AS n FROM (SELECT *, {_STATUS_SQL} AS status,
    CASE flag WHEN 'A' THEN 'mixed' WHEN 'R' THEN 'grouped' ELSE 'exact' END AS kind, qty > 3 AS has_article, extra > 1.8 AS poor, qty * 500 AS len, qty % 11 <> 0 AS has_refs, qty % 2 AS num, qty % 4 AS ay,
    CASE WHEN qty % 5 = 0 THEN '' ELSE 'e' END AS entry, CASE WHEN qty % 7 = 0 THEN '' ELSE '[1]' END AS marker FROM ({_FEATURES})) WHERE status IN ('ambiguous', 'failed') GROUP BY ALL""")
def align_failure_reason(spark, d):
    f = _features(spark, d).withColumn("status", A.alignment_status(F.col("method"), F.col("score"), F.col("kinds"), F.col("mentions")))
    q = F.col("qty")
    reason = A.failure_reason(
        F.col("status"), F.col("method"), F.col("score"), F.col("mentions"), F.when(q % 5 == 0, "").otherwise("e"), F.when(q % 7 == 0, "").otherwise("[1]"),
        A.context_type(F.col("kinds")), q > 3, F.col("extra") > 1.8, q * 500, q % 11 != 0, q % 2, q % 4,
    )
    return f.where(F.col("status").isin(C.UNRESOLVED_STATUSES)).groupBy(*_KEYS, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("align_rescue", f"""SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN mentions > 0 AND (s >= 0.90 OR (s >= 0.84 AND extra >= 0.5)) THEN CASE flag WHEN 'A' THEN 'range' WHEN 'R' THEN 'grouped' ELSE 'high_confidence' END END AS rescued,
    count(*) AS n FROM (SELECT *, round(0.8 + score / 5.0, 6) AS s FROM ({_FEATURES})) GROUP BY ALL""")
def align_rescue(spark, d):
    f = _features(spark, d).withColumn("s", r6(0.8 + F.col("score") / 5.0))
    return f.groupBy(*_KEYS, A.rescue_status(F.col("s"), F.col("kinds"), F.col("mentions"), F.col("extra")).alias("rescued")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_candidate", f"""SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM ({_FEATURES}) WHERE method = 'failed' AND mentions >= 1 AND score >= 0.7
    AND regexp_matches('[' || qty || ']', '\\d') AND length(repeat('x', qty)) >= 40 GROUP BY ALL""")
def flt_candidate(spark, d):
    f = _features(spark, d)
    marker = F.concat(F.lit("["), F.col("qty").cast("string"), F.lit("]"))
    keep = (F.col("method") == "failed") & (F.col("mentions") >= 1) & (F.col("score") >= 0.7) & marker.rlike(r"\d") & (F.length(F.repeat(F.lit("x"), F.col("qty"))) >= 40)
    return f.where(keep).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))


# --- review, scoring, similarity ---------------------------------------------------------------

_REVIEW = {
    "cur": "SELECT edge_id, CASE WHEN has_score AND q_ij > 0.3 THEN 'high_confidence' ELSE 'failed' END AS alignment_status FROM (SELECT *, source_id || '->' || target_id AS edge_id FROM sem)",
    "cand": """SELECT edge_id, alignment_status, CASE WHEN confidence > 0.66 THEN 'correct' WHEN confidence > 0.33 THEN 'ambiguous' ELSE 'wrong' END AS review, section FROM (
      SELECT *, source_id || '->' || target_id AS edge_id, CASE WHEN relevance > 0.5 THEN 'grouped' ELSE 'high_confidence' END AS alignment_status FROM sem) WHERE has_score AND q_ij <= 0.3""",
}


def _review(spark, d):
    e = M.semantic_edges(spark, d).withColumn("edge_id", S.edge_key("source_id", "target_id"))
    status = F.when(F.col("has_score") & (F.col("q_ij") > 0.3), "high_confidence").otherwise("failed")
    base = e.select("edge_id", "has_score", "q_ij", "relevance", "confidence", "section", status.alias("alignment_status"))
    current = base.select("edge_id", "alignment_status", F.lit("").alias("target_reference_marker"), F.lit("old").alias("alignment_note"))
    picked = base.where("has_score and q_ij <= 0.3")
    candidate = picked.select(
        "edge_id", F.when(F.col("relevance") > 0.5, "grouped").otherwise("high_confidence").alias("alignment_status"),
        F.lit("[1]").alias("target_reference_marker"), F.lit("rescued").alias("alignment_note"),
    )
    verdict = F.when(F.col("confidence") > 0.66, "Correct ").when(F.col("confidence") > 0.33, "ambiguous").otherwise("wrong")
    review = picked.select(
        "edge_id", verdict.alias("human_alignment_status"), F.when(F.col("section") == "", "[9]").otherwise("").alias("human_reference_marker_confirmed"),
        F.lit(None).cast("string").alias("human_note"),
    )
    return current, candidate, review


@query("review_promotion", sql("""SELECT cur.edge_id, CASE WHEN review = 'correct' THEN cand.alignment_status ELSE cur.alignment_status END AS alignment_status,
    CASE WHEN review = 'correct' THEN CASE WHEN section = '' THEN '[9]' ELSE '[1]' END ELSE '' END AS target_reference_marker,
    CASE WHEN review = 'correct' THEN CASE WHEN section = '' THEN 'rescued | human_reference_marker_confirmed=[9]' ELSE 'rescued' END ELSE 'old' END AS alignment_note
  FROM cur LEFT JOIN cand USING (edge_id)""", **_REVIEW))
def review_promotion(spark, d):
    return A.promote_reviewed(*_review(spark, d))[0]


@query("review_summary", sql("""SELECT (SELECT count(*) FROM cand) AS candidate_rescued_edges, (SELECT count(*) FROM cand WHERE review = 'correct') AS manually_accepted_edges,
    (SELECT count(*) FROM cand WHERE review = 'ambiguous') AS rejected_ambiguous_edges, (SELECT count(*) FROM cand WHERE review = 'wrong') AS rejected_wrong_edges,
    (SELECT count(*) FROM cur WHERE alignment_status <> 'failed') + (SELECT count(*) FROM cand WHERE review = 'correct') AS final_target_aligned_edges,
    round(((SELECT count(*) FROM cur WHERE alignment_status <> 'failed') + (SELECT count(*) FROM cand WHERE review = 'correct')) / (SELECT count(*) FROM cur), 6) AS final_coverage_ratio""", **_REVIEW))
def review_summary(spark, d):
    summary = A.promote_reviewed(*_review(spark, d))[1]
    return summary.withColumn("final_coverage_ratio", r6("final_coverage_ratio"))


_SECTION_CUES = [("Conclusion", ["zustand", "anation"]), ("Discussion", ["oueur"]), ("Result", ["thorat", "reand"]), ("Methodology", ["ation"]), ("Introduction", ["the"])]
_POS, _NEG, _REL = ["the", "and", "of"], ["thand", "onesen", "ertion"], ["ing", "ent"]


def _has(cues) -> str:
    return "(" + " OR ".join(f"contains(t, '{c}')" for c in cues) + ")"


def _sum(cues) -> str:
    return "(" + " + ".join(f"contains(t, '{c}')::INT" for c in cues) + ")"


_RULE_SQL = f"""SELECT doc_id, section, sentiment, round(greatest(0.1, least(0.95, rel)), 6) AS relevance, round(greatest(0.0, least(0.95, conf)), 6) AS confidence,
    round((CASE section WHEN 'Introduction' THEN 0.4 WHEN 'Methodology' THEN 1.0 WHEN 'Result' THEN 1.0 WHEN 'Discussion' THEN 0.7 WHEN 'Conclusion' THEN 0.5 ELSE 0.2 END)::DOUBLE
      * (CASE WHEN sentiment >= 0 THEN (sentiment + 1.0) / 2.0 ELSE 0.01 END) * power(greatest(0.1, least(0.95, rel)), 2), 6) AS q_ij FROM (
  SELECT *, (CASE section WHEN 'Methodology' THEN 0.82 WHEN 'Result' THEN 0.76 WHEN 'Discussion' THEN 0.62 WHEN 'Introduction' THEN 0.38 WHEN 'Conclusion' THEN 0.48 ELSE 0.45 END)::DOUBLE
      + CASE WHEN {_has(_REL)} THEN 0.08 ELSE 0.0 END + CASE WHEN mentions >= 2 THEN 0.05 ELSE 0.0 END - CASE WHEN status IN ('grouped', 'range') THEN 0.08 ELSE 0.0 END AS rel,
    (CASE status WHEN 'high_confidence' THEN 0.82 WHEN 'grouped' THEN 0.68 WHEN 'range' THEN 0.63 ELSE 0.55 END)::DOUBLE + CASE WHEN mentions >= 2 THEN 0.04 ELSE 0.0 END AS conf,
    (CASE WHEN {_sum(_NEG)} > {_sum(_POS)} THEN -0.45 WHEN {_sum(_POS)} > 0 THEN CASE WHEN status = 'high_confidence' THEN 0.35 ELSE 0.2 END ELSE 0.0 END)::DOUBLE AS sentiment FROM (
  SELECT *, CASE {' '.join(f"WHEN {_has(c)} THEN '{label}'" for label, c in _SECTION_CUES)} ELSE 'Other' END AS section FROM (
  SELECT doc_id, lower(text) AS t, CASE n_chars % 4 WHEN 0 THEN 'high_confidence' WHEN 1 THEN 'grouped' WHEN 2 THEN 'range' ELSE 'exact' END AS status, n_chars % 5 AS mentions FROM documents)))"""


@query("rule_scorer", _RULE_SQL)
def rule_scorer(spark, d):
    n = F.col("n_chars") % 4
    status = F.when(n == 0, "high_confidence").when(n == 1, "grouped").when(n == 2, "range").otherwise("exact")
    doc = read_table(spark, d, "documents").select("doc_id", "text", status.alias("status"), (F.col("n_chars") % 5).alias("mentions"))
    out = rule_scores(doc, "text", "status", "mentions", _SECTION_CUES, _POS, _NEG, _REL)
    return out.select("doc_id", "section", "sentiment", r6("relevance").alias("relevance"), r6("confidence").alias("confidence"), r6("q_ij").alias("q_ij"))


@query("incremental_scoring", sql("""SELECT source_id || '->' || target_id AS edge_id, CASE WHEN has_score THEN 'reused_existing' ELSE 'newly_scored' END AS score_source,
    round(CASE WHEN has_score THEN q_ij ELSE CASE WHEN cnt > 1 THEN 1.0 * 0.6 * 0.25 ELSE 0.2 * 0.5 * 0.16 END END, 6) AS q_ij FROM sem"""))
def incremental_scoring(spark, d):
    contexts = M.edges(spark, d).select(S.edge_key("source_id", "target_id").alias("edge_id"), "cnt")
    existing = M.best_scores(spark, d).select(S.edge_key("source_id", "target_id").alias("edge_id"), "q_ij")

    def score(todo):
        often = F.col("cnt") > 1
        raw = todo.withColumns(
            {
                "section": F.when(often, "methods").otherwise("-"), "sentiment": F.when(often, 0.2).otherwise(0.0),
                "relevance": F.when(often, 0.5).otherwise(0.4), "confidence": F.lit(1.0),
            }
        )
        return with_quality(raw).select("edge_id", "q_ij")

    return score_incrementally(contexts, existing, score).withColumn("q_ij", r6("q_ij"))


_QUERY, _STOP = "and the thand anation", ["of", "to", "in", "is"]


@query("tfidf_word_cosine", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in similarity_ctes(
  "SELECT doc_id AS id, text FROM documents", "text", word_terms_sql("tf_rows", _STOP), "['and','the','thand','anation','and the','the thand','thand anation']").items())
  + " SELECT id AS doc_id, round(similarity, 6) AS similarity FROM sim")
def tfidf_word_cosine(spark, d):
    return word_similarity(_documents(spark, d), "doc_id", "text", _QUERY, _STOP).select("doc_id", r6("similarity").alias("similarity"))


@query("tfidf_char_cosine", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in similarity_ctes(
  "SELECT conv_id * 1000 + turn AS id, text FROM conversations", "text", char_terms_sql("tf_rows"), "['th','he','e ',' a','an','nd','the','he ','e a',' an','and']").items())
  + " SELECT id, round(similarity, 6) AS similarity FROM sim")
def tfidf_char_cosine(spark, d):
    c = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return character_similarity(c, "id", "text", "the and").select("id", r6("similarity").alias("similarity"))


@query("file_binding", """WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS pk FROM part), f AS (
    SELECT 'F_W' || lpad(s_suppkey::VARCHAR, 6, '0') || '.pdf' AS fn FROM supplier UNION ALL SELECT DISTINCT replace(p_name, ' ', '_') || CASE WHEN length(p_name) % 2 = 0 THEN '' ELSE '_full' END || '.pdf' FROM part),
    fk AS (SELECT min(fn) AS fn, regexp_replace(lower(regexp_replace(fn, '\\.[^.]*$', '')), '[^a-z0-9]+', '', 'g') AS fkey FROM f GROUP BY 2)
  SELECT 'W' || lpad(k.p_partkey::VARCHAR, 6, '0') AS paper_id, coalesce(i.fn, e.fn, c.fn) AS file_name, CAST(CASE WHEN i.fn IS NOT NULL THEN 1 WHEN e.fn IS NOT NULL THEN 2 WHEN c.fn IS NOT NULL THEN 3 END AS INT) AS step
  FROM k LEFT JOIN f i ON i.fn = 'F_W' || lpad(k.p_partkey::VARCHAR, 6, '0') || '.pdf' LEFT JOIN fk e ON e.fkey = k.pk
  LEFT JOIN (SELECT pk, min(fn) AS fn FROM (SELECT DISTINCT pk FROM k) JOIN fk ON contains(fkey, pk) OR contains(pk, fkey) GROUP BY pk) c ON c.pk = k.pk""")
def file_binding(spark, d):
    code = lambda c: F.concat(F.lit("W"), F.lpad(F.col(c).cast("string"), 6, "0"))
    parts = read_table(spark, d, "part").select(code("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    by_id = read_table(spark, d, "supplier").select(F.concat(F.lit("F_"), code("s_suppkey"), F.lit(".pdf")).alias("file_name"))
    tail = F.when(F.length("title") % 2 == 0, ".pdf").otherwise("_full.pdf")
    by_title = parts.select(F.concat(F.replace(F.col("title"), F.lit(" "), F.lit("_")), tail).alias("file_name")).distinct()
    return bind_files(by_id.unionByName(by_title), parts, r"(W\d{6,})").select("paper_id", "file_name", "step")


@query("file_fuzzy_match", """WITH RECURSIVE parts AS (SELECT p_partkey AS paper_id, p_name AS title FROM part),
  stems AS (SELECT DISTINCT p_brand || '-' || replace(CASE WHEN p_size > 25 THEN replace(p_name, 'i', 'y') ELSE p_name END, ' ', '_') AS stem FROM part),
  files AS (SELECT stem || '.pdf' AS file_name FROM stems UNION SELECT 'Source_' || s_suppkey || '.pdf' FROM supplier),
  names AS (SELECT min(file_name) AS file_name, name FROM (SELECT file_name, trim(regexp_replace(lower(regexp_replace(file_name, '\\.[^.]*$', '')), '[^a-z0-9]+', ' ', 'g')) AS name FROM files) WHERE name <> '' GROUP BY name),
  opened AS (SELECT paper_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title FROM parts WHERE 'Source_' || paper_id || '.pdf' NOT IN (SELECT file_name FROM files)),
  titles AS (SELECT DISTINCT title FROM opened WHERE title <> ''), compared AS (SELECT title, name FROM titles CROSS JOIN names), """ + ", ".join(f"{k} AS ({v})" for k, v in RATIO_CTES.items()) + """,
  matched AS (SELECT title, name, ratio + if(contains(name, title), 0.25, 0.0)::DOUBLE AS score FROM ratios),
  bound AS (SELECT title, file_name, score FROM matched JOIN names USING (name) WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, file_name) = 1)
  SELECT paper_id, coalesce(f.file_name, b.file_name) AS file_name, round(b.score, 6) AS score FROM parts p LEFT JOIN files f ON f.file_name = 'Source_' || p.paper_id || '.pdf'
  LEFT JOIN opened USING (paper_id) LEFT JOIN bound b ON b.title = opened.title""")
def file_fuzzy_match(spark, d):
    parts = read_table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), "p_brand", "p_size")
    written = F.when(F.col("p_size") > 25, F.replace(F.col("title"), F.lit("i"), F.lit("y"))).otherwise(F.col("title"))
    stems = parts.select(F.concat("p_brand", F.lit("-"), F.replace(written, F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("file_name"))
    by_id = read_table(spark, d, "supplier").select(F.concat(F.lit("Source_"), "s_suppkey", F.lit(".pdf")).alias("file_name"))
    out = fuzzy_file_matches(stems.unionByName(by_id).distinct(), parts.select("paper_id", "title"))
    return out.withColumn("score", r6("score"))


# --- samples ----------------------------------------------------------------------------------


def _sample_rows(spark, d):
    b = M.best_scores(spark, d).withColumn("edge_id", S.edge_key("source_id", "target_id"))
    key = S.stratum_key(S.section_label("section"), S.bucketize("relevance", C.RELEVANCE_EDGES), S.bucketize("q_ij", C.QUALITY_EDGES))
    return b.withColumn("stratum", key)


@query("sample_stratified", sql(f"""SELECT edge_id, stratum, 'S' || CASE WHEN pos < 10 THEN '00' WHEN pos < 100 THEN '0' ELSE '' END || pos AS sample_id FROM (
    SELECT *, row_number() OVER (ORDER BY CASE WHEN forced THEN 0 WHEN rn = 1 THEN 1 ELSE 2 END, h) AS pos FROM (
      SELECT *, confidence > 0.99 AND relevance > 0.99 AND sentiment > 0.9 AS forced, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn FROM (
        SELECT *, md5('42|' || edge_id) AS h FROM (SELECT *, source_id || '->' || target_id AS edge_id, {STRATUM_SQL} AS stratum FROM best)))) WHERE pos <= 120"""))
def sample_stratified(spark, d):
    forced = (F.col("confidence") > 0.99) & (F.col("relevance") > 0.99) & (F.col("sentiment") > 0.9)
    return P.stratified_sample(_sample_rows(spark, d), "edge_id", "stratum", forced, 120).select("edge_id", "stratum", "sample_id")


def _diverse_sql(rows: str, key: str, source: str, stratum_order: str, fill_order: str, n: int, columns: str) -> str:
    """SQL of the diverse sample over ``rows`` (a table with ``stratum``): the greedy choice as a recursion over strata."""
    return f"""first_rows AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {stratum_order}) AS place FROM {rows}),
      strata AS (SELECT stratum, row_number() OVER (ORDER BY {stratum_order}) AS turn FROM first_rows WHERE place = 1),
      choices AS (SELECT turn, {source} AS src, min({key}) AS id FROM {rows} JOIN strata USING (stratum) GROUP BY ALL),
      greedy AS (SELECT 0::BIGINT AS turn, [] ::{{t}}[] AS used, NULL::{{t}} AS src, NULL::{{i}} AS id
        UNION ALL SELECT turn, list_append(used, m.src), m.src, m.id FROM (
          SELECT g.turn + 1 AS turn, g.used, min({{{{'taken': list_contains(g.used, c.src), 'src': c.src, 'id': c.id}}}}) AS m
          FROM greedy g JOIN choices c ON c.turn = g.turn + 1 GROUP BY ALL)),
      both_tiers AS (SELECT r.*, 0 AS tier, g.turn FROM {rows} r JOIN greedy g ON g.id = r.{key}
        UNION ALL SELECT *, 1, row_number() OVER (ORDER BY {fill_order}, {key}) FROM {rows} WHERE {key} NOT IN (SELECT id FROM greedy WHERE id IS NOT NULL))
    SELECT {columns} FROM both_tiers QUALIFY row_number() OVER (ORDER BY tier, turn) <= {n}"""


_DIVERSE = _diverse_sql("pool", "edge_id", "source_id", "edge_id", "source_id, relevance DESC, q_ij DESC", 50, "edge_id, source_id, stratum").format(t="BIGINT", i="VARCHAR")


@query("sample_diverse", sql("", pool=f"SELECT *, source_id || '->' || target_id AS edge_id, {STRATUM_SQL} AS stratum FROM best").rstrip() + ", " + _DIVERSE)
def sample_diverse(spark, d):
    fill = [F.asc("source_id"), F.desc("relevance"), F.desc("q_ij")]
    return P.diverse_sample(_sample_rows(spark, d), "edge_id", "source_id", "stratum", [F.asc("edge_id")], fill, 50).select("edge_id", "source_id", "stratum")


_HARD = rf"""WITH RECURSIVE cued AS (SELECT doc_id, lang, source, n_chars, list_sort(list_distinct(regexp_extract_all(lower(text), '\b({'|'.join(_CUES)})\b'))) AS cues FROM documents),
  pool AS (SELECT doc_id, lang, source, n_chars, array_to_string(cues, ', ') AS matched_cue_words, len(cues) AS cue_count, concat_ws('|', coalesce(lang, 'nan'), len(cues)) AS stratum FROM cued WHERE len(cues) > 0), """


@query("sample_hardcase", _HARD + _diverse_sql("pool", "doc_id", "source", "cue_count DESC, lang, n_chars DESC, doc_id", "source, n_chars DESC", 30, "doc_id, source, stratum, matched_cue_words").format(t="VARCHAR", i="BIGINT"))
def sample_hardcase(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    hard = P.hard_cases(doc, "text", _CUES).withColumn("stratum", S.stratum_key("lang", "cue_count")).drop("text")
    order = [F.desc("cue_count"), F.asc("lang"), F.desc("n_chars"), F.asc("doc_id")]
    return P.diverse_sample(hard, "doc_id", "source", "stratum", order, [F.asc("source"), F.desc("n_chars")], 30).select("doc_id", "source", "stratum", "matched_cue_words")
