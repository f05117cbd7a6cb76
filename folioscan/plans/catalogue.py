"""Queries of the engine and the SQL they equal; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fold import fold_text
from ..functions.porter import family
from ..functions.text import CJK, literal, plain_marks
from ..operators import changes, expand, filters, occurrences, quality, rank, snippets, vectors
from ..operators.chunks import chunked
from . import samples
from .index import TextIndex, index_of
from .search import Options, Searcher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# What the queries ask for.
ROOTS = ["/srv/share/dept_00", "/srv/share/inbox"]
EXCLUDED = ["drafts", "*.csv", "/srv/share/archive"]
CASE_WORD, WORD, SHORT, MARKS = "Budget", "budget", "ud", "No. "
STEM_WORD, PHRASE = "reviewed", ("weekly", "register")
NOW = 1700000000.0
PATTERN = r"20(1[89]|2[0-6])-0[1-6]-[0-9]{2}"
GRAM = "會議"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def segs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_segments")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the segments; the first query that needs it builds it."""
    return index_of(spark, f"{d}/doc_segments.parquet")


def searcher(spark: SparkSession, d: str) -> Searcher:
    return Searcher(docs(spark, d), segs(spark, d), index=index(spark, d))


META = "doc_id, path, filename, file_type, file_size, mtime, parse_status"
META_COLUMNS = META.split(", ")
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW_PATH = LOW.format("path")


@query("doc_scan_projection", f"SELECT {META} FROM documents")
def _(s, d):
    return docs(s, d).select(*META_COLUMNS)


@query("segment_scan", "SELECT doc_id, segment_row_id, segment_type, CAST(length(content) AS BIGINT) AS n FROM doc_segments")
def _(s, d):
    return segs(s, d).select("doc_id", "segment_row_id", "segment_type", F.length("content").cast("long").alias("n"))


@query("flt_type_group", "SELECT doc_id, file_type FROM documents WHERE file_type IN ('docx', 'doc')")
def _(s, d):
    return docs(s, d).where(filters.type_group("word")).select("doc_id", "file_type")


@query("flt_type_list", "SELECT doc_id, file_type FROM documents WHERE file_type IN ('pdf', 'txt', 'md', 'csv')")
def _(s, d):
    return docs(s, d).where(filters.type_group(["pdf", "text"])).select("doc_id", "file_type")


@query("flt_time_range", "SELECT doc_id, mtime FROM documents WHERE mtime >= 1600000000 AND mtime < 1700000000")
def _(s, d):
    return docs(s, d).where(filters.time_range(1.6e9, 1.7e9)).select("doc_id", "mtime")


@query("flt_size_range", "SELECT doc_id, file_size FROM documents WHERE file_size >= 1000 AND file_size <= 20000")
def _(s, d):
    return docs(s, d).where(filters.size_range(1000, 20000)).select("doc_id", "file_size")


@query("flt_presets", f"SELECT doc_id, mtime, file_size FROM documents WHERE mtime >= {NOW - 365 * 86400} AND file_size <= 1048575")
def _(s, d):
    after, _ = filters.preset_time("year", NOW)
    return docs(s, d).where(filters.time_range(after) & filters.size_range(*filters.PRESET_SIZES["small"])).select("doc_id", "mtime", "file_size")


UNDER = " OR ".join(f"{LOW_PATH} = '{r}' OR starts_with({LOW_PATH}, '{r}/')" for r in ROOTS)


@query("flt_include_paths", f"SELECT doc_id, path FROM documents WHERE {UNDER}")
def _(s, d):
    return docs(s, d).where(filters.include_paths(ROOTS)).select("doc_id", "path")


@query("flt_exclude_patterns", f"SELECT doc_id, path FROM documents WHERE NOT contains({LOW_PATH}, '/drafts/') AND NOT contains({LOW_PATH}, '.csv') AND NOT starts_with({LOW_PATH}, '/srv/share/archive')")
def _(s, d):
    return docs(s, d).where(filters.exclude(EXCLUDED)).select("doc_id", "path")


BELOW = "CASE " + " ".join(f"WHEN {LOW_PATH} = '{r}' OR starts_with({LOW_PATH}, '{r}/') THEN substring(path, {len(r) + 1})" for r in sorted(ROOTS, key=len, reverse=True)) + " ELSE path END"


@query("flt_search_roots", f"SELECT doc_id, {BELOW} AS below FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", filters.relative("path", ROOTS).alias("below"))


@query("lit_substring", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE contains(lower(content), '{SHORT}')")
def _(s, d):
    return segs(s, d).where(F.col("content").rlike(literal(SHORT))).select("doc_id", "segment_row_id")


@query("lit_match_case", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE contains(content, '{CASE_WORD}')")
def _(s, d):
    return segs(s, d).where(F.col("content").rlike(literal(CASE_WORD, match_case=True))).select("doc_id", "segment_row_id")


EDGE = r"[^\pL\pN\pM\p{Pc}]"


@query("lit_whole_word", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE regexp_matches(content, '(?i)(^|{EDGE}){WORD}({EDGE}|$)')")
def _(s, d):
    return segs(s, d).where(F.col("content").rlike(literal(WORD, whole_word=True))).select("doc_id", "segment_row_id")


@query("lit_short_term", f"SELECT DISTINCT doc_id FROM doc_segments WHERE contains(lower(content), '{SHORT}')")
def _(s, d):
    return searcher(s, d).hits(SHORT).select("doc_id").distinct()


@query("lit_punctuation", "SELECT doc_id, segment_row_id FROM doc_segments WHERE contains(content, '±')")
def _(s, d):
    return searcher(s, d).hits("±").select("doc_id", "segment_row_id")


# what may stand beside a token: no letter or digit, or an ideograph
OUTSIDE = "[^\\pL\\pN]|[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}]"


def alternation(word: str) -> str:
    """The words of a stem, written out: SQL has no stemmer. The queries take them from the index; a test holds the two against each other."""
    return "|".join(family(word))


def token_sql(word: str) -> str:
    """Whole index tokens with the stem of word."""
    return f"regexp_matches(content, '(?i)(^|{OUTSIDE})({alternation(word)})({OUTSIDE}|$)')"


@query("stem_single", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE {token_sql(STEM_WORD)}")
def _(s, d):
    return searcher(s, d).hits(STEM_WORD).select("doc_id", "segment_row_id")


@query("stem_phrase", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE regexp_matches(content, '(?i)(^|{OUTSIDE})({alternation(PHRASE[0])})[^\\pL\\pN]+({alternation(PHRASE[1])})({OUTSIDE}|$)')")
def _(s, d):
    return searcher(s, d).hits(f'"{" ".join(PHRASE)}"').select("doc_id", "segment_row_id")


for _name, _text, _sql in (
    ("bool_and", "budget AND weekly", f"{token_sql('budget')} AND {token_sql('weekly')}"),
    ("bool_or", "thermostat OR telescope", f"({token_sql('thermostat')} OR {token_sql('telescope')})"),
    ("bool_not", "budget NOT weekly", f"{token_sql('budget')} AND NOT {token_sql('weekly')}"),
    ("bool_precedence", "boiler OR budget AND weekly NOT register", f"({token_sql('boiler')} OR ({token_sql('budget')} AND ({token_sql('weekly')} AND NOT {token_sql('register')})))"),
    ("bool_implicit", "budget weekly OR telescope", f"(({token_sql('budget')} AND {token_sql('weekly')}) OR {token_sql('telescope')})"),
    ("cjk_fold", "計畫 AND 会议", "regexp_matches(content, '[計计][畫画]') AND regexp_matches(content, '[會会][議议]')"),
):
    query(_name, f"SELECT doc_id, segment_row_id FROM doc_segments WHERE {_sql}")(lambda s, d, t=_text: searcher(s, d).hits(t).select("doc_id", "segment_row_id"))


@query("negative_only", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_segments WHERE {token_sql('budget')} AND doc_id IS NOT NULL)")
def _(s, d):
    return searcher(s, d).without("budget").select("doc_id")


@query("multi_segment_scope", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM doc_segments WHERE {token_sql('budget')} AND {token_sql('weekly')} GROUP BY doc_id")
def _(s, d):
    return rank.documents_ranked(searcher(s, d).hits("budget AND weekly")).select("doc_id", F.col("segment_count").alias("n"))


@query("filename_search", "SELECT doc_id, filename FROM documents WHERE contains(lower(filename), 'budget')")
def _(s, d):
    return searcher(s, d).filenames("budget").select("doc_id", "filename")


@query("filename_fold", "SELECT doc_id, filename FROM documents WHERE regexp_matches(filename, '[會会][議议][紀纪]')")
def _(s, d):
    return searcher(s, d).filenames("會議紀").select("doc_id", "filename")


@query("regex_search", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE regexp_matches(content, '{PATTERN}')")
def _(s, d):
    return searcher(s, d).hits(PATTERN, Options(regex=True)).select("doc_id", "segment_row_id")


@query("regex_whole_word", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE regexp_matches(content, '(?i)(^|{EDGE})boil[a-z]+s?({EDGE}|$)')")
def _(s, d):
    return searcher(s, d).hits("boil[a-z]+s?", Options(regex=True, whole_word=True)).select("doc_id", "segment_row_id")


@query("filtered_search", f"SELECT s.doc_id, s.segment_row_id FROM doc_segments s JOIN documents d USING (doc_id) WHERE {token_sql('budget')} AND d.file_type IN ('xlsx', 'xls') AND d.file_size >= 500")
def _(s, d):
    return searcher(s, d).hits("budget", Options(type_filter="excel", min_size=500)).select("doc_id", "segment_row_id")


# ranking

TOKENS_SQL = "regexp_extract_all(regexp_replace(lower(content), '([\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}])', ' \\1 ', 'g'), '[\\pL\\pN]+')"


RUNS_SQL = "len(regexp_extract_all(content, '[\\pL\\pN]+'))"


def bm25_sql(*terms: str) -> str:
    """Common tables ending in ranked(doc_id, segment_row_id, rank, tf_0, ...)."""
    tf = ", ".join(f"list_sum(list_transform(toks, lambda x: CASE WHEN x IN ({', '.join(repr(w) for w in family(t))}) THEN 1 ELSE 0 END)) AS tf_{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS n_{i}" for i in range(len(terms)))
    scores = ", ".join(f"CASE WHEN tf_{i} > 0 THEN -greatest(ln((n_all - n_{i} + 0.5) / (n_{i} + 0.5)), 1e-6) * tf_{i} * 2.2e0 / (tf_{i} + 1.2e0 * (0.25e0 + 0.75e0 * length / mean)) ELSE 0e0 END" for i in range(len(terms)))
    return f"""WITH t AS (SELECT doc_id, segment_row_id, {TOKENS_SQL} AS toks, {RUNS_SQL} AS runs FROM doc_segments),
c AS (SELECT doc_id, segment_row_id, CAST(len(toks) + runs AS DOUBLE) AS length, {tf} FROM t),
s AS (SELECT count(*) AS n_all, avg(length) AS mean, {stats} FROM c),
ranked AS (SELECT doc_id, segment_row_id, least(0e0, {scores}) AS rank, {', '.join(f'tf_{i}' for i in range(len(terms)))} FROM c, s)
"""


def scores(s, d, text: str) -> DataFrame:
    return searcher(s, d).hits(text).select("doc_id", "segment_row_id", F.round("rank", 6).alias("rank"))


@query("bm25_single", bm25_sql("budget") + "SELECT doc_id, segment_row_id, round(rank, 6) AS rank FROM ranked WHERE tf_0 > 0")
def _(s, d):
    return scores(s, d, "budget")


@query("bm25_min_over_terms", bm25_sql("budget", "weekly") + "SELECT doc_id, segment_row_id, round(rank, 6) AS rank FROM ranked WHERE tf_0 > 0 OR tf_1 > 0")
def _(s, d):
    return scores(s, d, "budget OR weekly")


@query("bm25_by_scan", bm25_sql("budget") + "SELECT doc_id, segment_row_id, round(rank, 6) AS rank FROM ranked WHERE tf_0 > 0")
def _(s, d):
    """The same without an index: the stem's words are read from the texts, which are scanned."""
    return Searcher(docs(s, d), segs(s, d)).hits("budget").select("doc_id", "segment_row_id", F.round("rank", 6).alias("rank"))


RANKED_DOCS = bm25_sql("budget", "weekly") + ", g AS (SELECT doc_id, min(rank) AS rank_score, count(*) AS segment_count FROM ranked WHERE tf_0 > 0 AND tf_1 > 0 GROUP BY doc_id)\n"


def _ranked(s, d):
    return searcher(s, d).ranked("budget AND weekly")


@query("rank_documents", RANKED_DOCS + "SELECT doc_id, round(rank_score, 6) AS rank_score, CAST(segment_count AS BIGINT) AS segment_count FROM g")
def _(s, d):
    return _ranked(s, d).select("doc_id", F.round("rank_score", 6).alias("rank_score"), "segment_count")


@query("page_limit", RANKED_DOCS + "SELECT doc_id, round(rank_score, 6) AS rank_score FROM g ORDER BY g.rank_score, doc_id LIMIT 20")
def _(s, d):
    return rank.page(_ranked(s, d), 20).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


@query("page_keyset_second", RANKED_DOCS + "SELECT doc_id, round(rank_score, 6) AS rank_score FROM g WHERE g.rank_score > -4 OR (g.rank_score = -4 AND doc_id > 100) ORDER BY g.rank_score, doc_id LIMIT 20")
def _(s, d):
    return rank.page(_ranked(s, d), 20, (-4.0, 100)).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


@query("sort_filenames", "SELECT doc_id, filename FROM documents ORDER BY lower(filename), doc_id LIMIT 100")
def _(s, d):
    return docs(s, d).orderBy(F.lower("filename"), "doc_id").limit(100).select("doc_id", "filename")


for _by, _sql in (("type", "lower(file_type)"), ("size", "file_size"), ("mtime", "mtime"), ("path", "lower(path)")):
    query(f"sort_by_{_by}", f"SELECT doc_id, CAST(n AS INT) AS n FROM (SELECT doc_id, row_number() OVER (ORDER BY {_sql} DESC, doc_id) AS n FROM documents) WHERE n <= 200")(
        lambda s, d, by=_by: rank.sorted_results(docs(s, d), by, descending=True).limit(200).select("doc_id", (F.monotonically_increasing_id() + 1).cast("int").alias("n"))
    )


# occurrences


@query("occ_counts_single", "SELECT doc_id, segment_row_id, CAST(len(string_split(lower(content), 'budget')) - 1 AS BIGINT) AS n FROM doc_segments WHERE contains(lower(content), 'budget')")
def _(s, d):
    n = F.regexp_count("content", F.lit(literal("budget"))).cast("long")
    return segs(s, d).select("doc_id", "segment_row_id", n.alias("n")).where("n > 0")


def starts_sql(term: str) -> str:
    """(doc_id, segment_row_id, start, end) of a literal that cannot overlap itself."""
    return f"""SELECT doc_id, segment_row_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(term)} AS INT) AS "start", CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + i * {len(term)} AS INT) AS "end"
FROM (SELECT doc_id, segment_row_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, segment_row_id, string_split(lower(content), '{term}') AS p FROM doc_segments WHERE contains(lower(content), '{term}')))"""


def positions(s, d, term: str) -> DataFrame:
    rows = segs(s, d).where(F.lower("content").contains(term)).select("doc_id", "segment_row_id", F.explode(occurrences.literal_positions("content", term)).alias("start"))
    return rows.withColumn("end", F.col("start") + len(term))


@query("occ_locations", starts_sql("budget"))
def _(s, d):
    return positions(s, d, "budget")


@query("occ_counts_merged", f"""WITH h AS ({starts_sql('budget')} UNION ALL {starts_sql('get the')}),
m AS (SELECT *, CASE WHEN "start" >= max("end") OVER (PARTITION BY segment_row_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY segment_row_id ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS f FROM h)
SELECT doc_id, segment_row_id, CAST(sum(f) AS BIGINT) AS n FROM m GROUP BY doc_id, segment_row_id""")
def _(s, d):
    both = positions(s, d, "budget").union(positions(s, d, "get the"))
    return occurrences.merge_islands(both, ["doc_id", "segment_row_id"]).groupBy("doc_id", "segment_row_id").agg(F.count("*").alias("n"))


@query("location_page", f"""SELECT doc_id, segment_row_id, "start", CAST(n AS INT) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment_row_id, "start") AS n FROM ({starts_sql('budget')})) WHERE n BETWEEN 3 AND 5""")
def _(s, d):
    by = W.partitionBy("doc_id").orderBy("segment_row_id", "start")
    return positions(s, d, "budget").withColumn("ordinal", F.row_number().over(by)).where("ordinal BETWEEN 3 AND 5").select("doc_id", "segment_row_id", "start", "ordinal")


def runs_sql(word: str) -> str:
    """Occurrences of a stem in a segment that holds it as a token: runs of ASCII letters."""
    return f"CASE WHEN {token_sql(word)} THEN len(list_filter(regexp_extract_all(content, '[A-Za-z]+'), lambda x: lower(x) IN ({', '.join(repr(w) for w in family(word))}))) ELSE 0 END"


@query("occ_merged_udf", f"SELECT doc_id, segment_row_id, CAST({runs_sql('budget')} + {runs_sql('reviewed')} AS BIGINT) AS n FROM doc_segments WHERE {token_sql('budget')} OR {token_sql('reviewed')}")
def _(s, d):
    return searcher(s, d).located("budget OR reviewed").select("doc_id", "segment_row_id", F.size("spans").cast("long").alias("n"))


SPANS = r"(SELECT doc_id, segment_row_id, content, list_transform(list_filter(range(1, len(p)), lambda i: true), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 6) AS hits FROM (SELECT *, string_split(lower(content), 'budget') AS p FROM doc_segments WHERE contains(lower(content), 'budget')))"
ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
# the first context; hits are marked in the pieces between them, and cut at its ends
FIRST = f"""(SELECT doc_id, segment_row_id, CASE WHEN l > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(1, len(e)), lambda i: {ESCAPED.format('substring(content, CAST(e[i] AS BIGINT) + 1, CAST(e[i + 1] - e[i] AS BIGINT))')} || CASE WHEN i % 2 = 0 OR i = len(e) - 1 THEN '' ELSE '<mark>' END || CASE WHEN i % 2 = 0 THEN '</mark>' ELSE '' END), '') || CASE WHEN r < length(content) THEN '...' ELSE '' END AS html
FROM (SELECT *, list_concat(list_concat([l], flatten(list_transform(list_filter(hits, lambda a: a + 6 >= l AND a <= r), lambda a: [greatest(a, l), least(a + 6, r)]))), [r]) AS e FROM (SELECT *, greatest(hits[1] - 60, 0) AS l, least(length(content), hits[1] + 66) AS r FROM {SPANS})))"""


def contexts(s, d) -> DataFrame:
    rows = segs(s, d).where(F.lower("content").contains("budget"))
    spans = F.transform(occurrences.literal_positions("content", "budget"), lambda a: F.struct(a.alias("start"), (a + 6).alias("end")))
    return rows.select("doc_id", "segment_row_id", snippets.snippets("content", spans)[0].alias("html"))


@query("snippet_html", f"SELECT * FROM {FIRST}")
def _(s, d):
    return contexts(s, d)


@query("snippet_plain", f"SELECT doc_id, segment_row_id, {'replace(replace(replace(replace(replace('}regexp_replace(regexp_replace(html, '(?s)<mark[^>]*>(.*?)</mark>', '**\\1**', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&') AS text FROM {FIRST}")
def _(s, d):
    return contexts(s, d).select("doc_id", "segment_row_id", plain_marks(F.col("html")).alias("text"))


@query("located_sources")
def _(s, d):
    return occurrences.with_sources(searcher(s, d).located("budget")).select("doc_id", "segment_row_id", "start", "end", "ordinal", "source_kind", "location")


@query("context_window", f"""SELECT h.doc_id, h.segment_row_id, h."start", substring(content, greatest(h."start" - 40, 0) + 1, h."end" + 40 - greatest(h."start" - 40, 0)) AS context FROM ({starts_sql('budget')}) h JOIN doc_segments s USING (segment_row_id)""")
def _(s, d):
    left = F.greatest(F.col("start") - 40, F.lit(0))
    rows = segs(s, d).where(F.lower("content").contains("budget")).select("doc_id", "segment_row_id", "content", F.explode(occurrences.literal_positions("content", "budget")).alias("start"))
    return rows.select("doc_id", "segment_row_id", "start", F.substring("content", left + 1, F.col("start") + 46 - left).alias("context"))


# expansion


def known_words(s, d) -> DataFrame:
    return index(s, d).words().where(F.length("word") >= 4).select("word", "n")


@query("vocabulary_top", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[\\pL\\pN]+')) AS word FROM doc_segments) WHERE regexp_full_match(word, '[a-z]{4,}') GROUP BY word ORDER BY n DESC, word LIMIT 100")
def _(s, d):
    return known_words(s, d).orderBy(F.desc("n"), "word").limit(100)


VOCABULARY_SQL = "(SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(content), '[\\pL\\pN]+')) AS word FROM doc_segments) WHERE regexp_full_match(word, '[a-z]{4,}'))"


@query("fuzzy_terms", f"SELECT word FROM {VOCABULARY_SQL} WHERE levenshtein(word, 'bugdet') = 1 OR levenshtein(word, 'regster') = 1")
def _(s, d):
    vocabulary = known_words(s, d)
    return expand.near_words(vocabulary, "bugdet").union(expand.near_words(vocabulary, "regster"))


@query("fuzzy_documents", f"SELECT DISTINCT doc_id FROM doc_segments WHERE regexp_matches(content, '(?i)register')")
def _(s, d):
    near = expand.near_words(known_words(s, d), "regster")
    terms = [r[0] for r in near.collect()]  # at most expand.MOST
    return expand.expansion_hits(segs(s, d), terms).select("doc_id").distinct()


@query("synonym_documents", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, segment_row_id FROM doc_segments WHERE contains(lower(content), 'estimate') UNION ALL SELECT doc_id, segment_row_id FROM doc_segments WHERE contains(content, '預算')) GROUP BY doc_id")
def _(s, d):
    terms = expand.synonyms("budget", {"budget": ["estimate", "預算"]})
    return expand.expansion_hits(segs(s, d), terms).groupBy("doc_id").agg(F.count("*").alias("n"))


QUERY_VECTOR = "(SELECT vector FROM semantic_chunks WHERE chunk_id = (SELECT min(chunk_id) FROM semantic_chunks WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: x * x)) > 0 AND NOT isnan(list_sum(vector))) LIMIT 1)"
SCORED = f"""(SELECT DISTINCT chunk_id, segment_row_id, list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) / (sqrt(list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])))) AS score FROM semantic_chunks c, {QUERY_VECTOR} q WHERE len(c.vector) = 64 AND NOT isnan(list_sum(c.vector)) AND list_sum(list_transform(c.vector, lambda x: x * x)) > 0)"""


def usable(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.size("vector") == 64) & ~F.exists("vector", F.isnan) & F.exists("vector", lambda x: x != 0))


def query_vector(s, d) -> list[float]:
    return usable(table(s, d, "semantic_chunks")).orderBy("chunk_id").select("vector").first()[0]


@query("cosine_topk", f"SELECT chunk_id, round(score, 6) AS score FROM {SCORED} ORDER BY {'score'} DESC, chunk_id LIMIT 50")
def _(s, d):
    chunks = usable(table(s, d, "semantic_chunks")).dropDuplicates(["chunk_id"])
    return vectors.nearest(chunks, "chunk_id", "vector", query_vector(s, d), 50).select("chunk_id", F.round("score", 6).alias("score"))


@query("cosine_threshold", f"SELECT chunk_id, round(score, 6) AS score FROM {SCORED} WHERE score >= {expand.SEMANTIC_LEAST}")
def _(s, d):
    chunks = usable(table(s, d, "semantic_chunks")).dropDuplicates(["chunk_id"])
    return chunks.select("chunk_id", vectors.cosine("vector", query_vector(s, d)).alias("score")).where(F.col("score") >= expand.SEMANTIC_LEAST).select("chunk_id", F.round("score", 6).alias("score"))


@query("vector_reuse_delta", "SELECT DISTINCT s.segment_row_id, c.segment_row_id IS NOT NULL AS reused FROM doc_segments s LEFT JOIN (SELECT DISTINCT segment_row_id FROM semantic_chunks) c USING (segment_row_id)")
def _(s, d):
    return vectors.reuse(segs(s, d), table(s, d, "semantic_chunks"))


RRF_SQL = bm25_sql("budget") + f""", e AS (SELECT doc_id, min(rank) AS r FROM ranked WHERE tf_0 > 0 GROUP BY doc_id),
a AS (SELECT doc_id, 1e0 / (60 + row_number() OVER (ORDER BY r, doc_id)) AS s, true AS exact FROM e),
v AS (SELECT doc_id, 1e0 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS s, false AS exact FROM (SELECT chunk_id, score, doc_id FROM {SCORED} x JOIN doc_segments USING (segment_row_id) ORDER BY score DESC, chunk_id LIMIT 1000)),
x AS (SELECT doc_id, count(*) * 0.001e0 AS s, false AS exact FROM doc_segments WHERE contains(lower(content), 'estimate') GROUP BY doc_id)
SELECT doc_id, round(sum(s), 6) AS score, round((CASE WHEN bool_or(exact) THEN -2e0 ELSE 0e0 END) - least(1e0, sum(s)), 6) AS rank_score FROM (SELECT * FROM a UNION ALL SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY doc_id"""


@query("rrf_hybrid_rank", RRF_SQL)
def _(s, d):
    exact = searcher(s, d).ranked("budget").select("doc_id", "rank_score")
    chunks = usable(table(s, d, "semantic_chunks")).dropDuplicates(["chunk_id"])
    scored = chunks.select("chunk_id", "segment_row_id", vectors.cosine("vector", query_vector(s, d)).alias("score")).join(segs(s, d).select("segment_row_id", "doc_id"), "segment_row_id")
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(expand.SEMANTIC_MOST).select("doc_id", F.col("chunk_id").alias("passage"), "score")
    out = expand.fused(exact, expand.expansion_hits(segs(s, d), ["estimate"]), best)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("rank_score", 6).alias("rank_score"))


CHUNKS_SQL = r"""WITH RECURSIVE long AS (SELECT row_number() OVER () AS n, segment_row_id, content FROM doc_segments WHERE length(trim(content)) > 0),
c AS (
  SELECT n, segment_row_id, content, 0 AS s, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b FROM long
  UNION ALL
  SELECT n, segment_row_id, content, CASE WHEN e IS NULL THEN NULL ELSE e - greatest(1, CAST(round_even(0.15e0 * (e - s), 0) AS INT)) END, s, coalesce(e, CAST(length(content) AS INT)) FROM (
    SELECT *, CASE WHEN length(content) - s <= 1000 THEN NULL WHEN hard >= 2 THEN s + 398 + hard ELSE s + 800 END AS e FROM (
      SELECT *, CAST(greatest(length(regexp_extract(w, '(?s)^(.*\n)[^\n]', 1)), length(regexp_extract(v, '(?s)^(.*[。！？])', 1)), length(regexp_extract(w, '(?s)^(.*[.!?])\s', 1))) AS INT) AS hard FROM (
        SELECT *, substring(content, s + 399, 403) AS w, substring(content, s + 399, 402) AS v FROM c WHERE s IS NOT NULL))))
SELECT segment_row_id, a AS "start", b AS "end" FROM c WHERE a IS NOT NULL"""


@query("chunk_passages", CHUNKS_SQL)
def _(s, d):
    return chunked(segs(s, d)).select("segment_row_id", "start", "end")


@query("gram_candidates", f"SELECT doc_id, segment_row_id FROM doc_segments WHERE regexp_matches(content, '[會会][議议]') AND regexp_matches(content, '[議议][記记]')")
def _(s, d):
    pairs = [fold_text(p, s) for p in (GRAM, "議記")]
    held = index(s, d).postings(pairs).groupBy("segment_row_id", "doc_id").agg(F.count("*").alias("n"))
    return held.where(F.col("n") == len(pairs)).select("doc_id", "segment_row_id")


# stems and folded signs apart, which SQL does not know
OTHER = "NOT regexp_full_match(term, '[a-z]+') AND NOT regexp_matches(term, '[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}]')"


@query("posting_counts", f"SELECT term, CAST(count(*) AS BIGINT) AS segments, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT segment_row_id, term, count(*) AS tf FROM (SELECT segment_row_id, unnest({TOKENS_SQL}) AS term FROM doc_segments) GROUP BY ALL) WHERE {OTHER} GROUP BY term")
def _(s, d):
    rows = index(s, d).postings().where("tf is not null").groupBy("term").agg(F.count("*").alias("segments"), F.sum("tf").alias("occurrences"))
    return rows.where(~F.col("term").rlike("^[a-z]+$") & ~F.col("term").rlike(f"[{CJK}]"))


@query("posting_places", f"SELECT segment_row_id, CAST(i - 1 AS INT) AS position FROM (SELECT segment_row_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT segment_row_id, {TOKENS_SQL} AS toks FROM doc_segments)) WHERE toks[i] IN ('2019', '2020')")
def _(s, d):
    return index(s, d).postings(["2019", "2020"]).select("segment_row_id", F.explode("positions").alias("position"))


@query("stem_counts", f"SELECT 'budget' AS term, CAST(count(*) AS BIGINT) AS segments FROM doc_segments WHERE {token_sql('budget')} UNION ALL SELECT 'review', CAST(count(*) AS BIGINT) FROM doc_segments WHERE {token_sql('reviewed')}")
def _(s, d):
    return index(s, d).terms().where(F.col("term").isin("budget", "review")).select("term", "segments")


@query("segment_lengths", f"SELECT segment_row_id, CAST(len({TOKENS_SQL}) + {RUNS_SQL} AS BIGINT) AS n FROM doc_segments WHERE len({TOKENS_SQL}) > 0")
def _(s, d):
    return index(s, d).postings().groupBy("segment_row_id").agg(F.max("length").cast("long").alias("n"))


# statistics and quality


@query("index_stats", "SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS documents_ok, CAST(sum(file_size) FILTER (WHERE error IS NULL) AS BIGINT) AS bytes_ok, max(indexed_at) AS last_indexed, (SELECT CAST(count(*) AS BIGINT) FROM doc_segments) AS segments, (SELECT CAST(count(*) AS BIGINT) FROM documents d WHERE EXISTS (SELECT 1 FROM doc_segments s WHERE s.doc_id = d.doc_id AND length(trim(content)) > 0)) AS searchable FROM documents")
def _(s, d):
    return quality.index_stats(docs(s, d), segs(s, d))


@query("quality_counts", "SELECT coalesce(parse_status, 'unknown') AS parse_status, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def _(s, d):
    return quality.quality_counts(docs(s, d))


@query("problem_documents", "SELECT doc_id, parse_status FROM documents WHERE coalesce(parse_status, 'unknown') <> 'success' OR coalesce(len(warnings), 0) > 0")
def _(s, d):
    return quality.problem_documents(docs(s, d)).select("doc_id", "parse_status")


@query("warning_filter", "SELECT doc_id FROM documents WHERE len(list_filter(warnings, lambda w: w.code = 'ocr_disabled')) > 0")
def _(s, d):
    return docs(s, d).where(filters.has_warning("ocr_disabled")).select("doc_id")


@query("warning_counts", "SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(warnings).code AS code FROM documents) GROUP BY code")
def _(s, d):
    return docs(s, d).select(F.explode("warnings").alias("w")).groupBy(F.col("w.code").alias("code")).agg(F.count("*").alias("n"))


@query("searchable_documents", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM doc_segments s WHERE s.doc_id = d.doc_id AND length(trim(content)) > 0)")
def _(s, d):
    return quality.searchable(docs(s, d), segs(s, d)).select("doc_id")


@query("reprocess_eligible", "SELECT doc_id FROM documents WHERE coalesce(parse_status, 'unknown') = 'unknown' OR parser_version IS DISTINCT FROM (CASE WHEN file_type IN ('xlsx', 'pdf', 'pptx') THEN '3' WHEN file_type = 'docx' THEN '2' ELSE '1' END)")
def _(s, d):
    return docs(s, d).where(filters.reprocess_eligible()).select("doc_id")


@query("document_markdown", "SELECT d.doc_id, '# ' || filename || chr(10) || chr(10) || '- Path: ' || path || chr(10) || '- Type: ' || file_type || chr(10) || '- Size: ' || CAST(file_size AS VARCHAR) || ' bytes' || coalesce(b.body, '') AS markdown FROM documents d LEFT JOIN (SELECT doc_id, string_agg(chr(10) || chr(10) || '## ' || segment_type || ' ' || segment_id || chr(10) || chr(10) || content, '' ORDER BY segment_row_id) AS body FROM doc_segments GROUP BY doc_id) b USING (doc_id)")
def _(s, d):
    return quality.markdown(docs(s, d), segs(s, d))


@query("root_sizes", "SELECT d.root_id, r.root_path, CAST(count(*) AS BIGINT) AS documents, CAST(sum(file_size) AS BIGINT) AS bytes FROM documents d LEFT JOIN watch_roots r USING (root_id) GROUP BY 1, 2")
def _(s, d):
    return changes.rooted(docs(s, d), table(s, d, "watch_roots")).groupBy("root_id", "root_path").agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes"))


# changes; the state of the log stands for a scan

LAST_SQL = "(SELECT doc_id, last.path AS path, last.change_kind AS change_kind, last.file_size AS file_size, last.event_at AS event_at FROM (SELECT doc_id, arg_max({'path': path, 'change_kind': change_kind, 'file_size': file_size, 'event_at': event_at}, {'a': event_at, 'b': seen_at, 'c': change_id}) AS last FROM file_changes WHERE doc_id IS NOT NULL GROUP BY doc_id))"


@query("log_state", f"SELECT doc_id, path, change_kind, coalesce(file_size, -1) AS file_size, epoch_us(event_at) AS event_us FROM {LAST_SQL}")
def _(s, d):
    return changes.log_state(table(s, d, "file_changes")).select("doc_id", "path", "change_kind", F.coalesce("file_size", F.lit(-1)).alias("file_size"), F.unix_micros("event_at").alias("event_us"))


SCAN_SQL = f"(SELECT path, min(epoch(event_at)) AS mtime, min(file_size) AS file_size FROM {LAST_SQL} WHERE change_kind <> 'deleted' AND path IS NOT NULL GROUP BY path)"
DIFF_SQL = f"(SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN abs(a.mtime - b.mtime) > 0.001 OR coalesce(a.file_size, -1) <> coalesce(b.file_size, -1) THEN 'changed' ELSE 'same' END AS change FROM {SCAN_SQL} a FULL JOIN (SELECT path, mtime, file_size FROM documents) b ON a.path = b.path)"


def _diff(s, d):
    state = changes.log_state(table(s, d, "file_changes")).where("change_kind <> 'deleted' AND path IS NOT NULL")
    scanned = state.groupBy("path").agg(F.min(F.unix_micros("event_at") / 1e6).alias("mtime"), F.min("file_size").alias("file_size"))
    fill = lambda x: x.withColumn("file_size", F.coalesce("file_size", F.lit(-1)))
    return changes.diff(fill(scanned), fill(docs(s, d)))


@query("diff_new_changed_deleted", f"SELECT path, change FROM {DIFF_SQL}")
def _(s, d):
    return _diff(s, d)


@query("diff_preserved_dirs", f"SELECT path FROM {DIFF_SQL} WHERE change = 'deleted' AND NOT ({UNDER})")
def _(s, d):
    return changes.deletions(_diff(s, d), ROOTS)


@query("stream_debounce_batch", """WITH g AS (SELECT path, event_at, CASE WHEN epoch_us(event_at) - epoch_us(lag(event_at) OVER w) > 3600000000 OR lag(event_at) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM file_changes WHERE path IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY event_at)),
b AS (SELECT path, event_at, sum(f) OVER (PARTITION BY path ORDER BY event_at ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT path, epoch_us(min(event_at)) AS first_us, epoch_us(max(event_at)) AS last_us, CAST(count(*) AS BIGINT) AS events FROM b GROUP BY path, n""")
def _(s, d):
    bursts = changes.debounced(table(s, d, "file_changes"), seconds=3600)
    return bursts.select("path", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "events")


@query("change_lateness", "SELECT change_kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE seen_at < event_at) AS BIGINT) AS early, CAST(max(epoch_us(seen_at) - epoch_us(event_at)) AS BIGINT) AS most_us FROM (SELECT DISTINCT * FROM file_changes) GROUP BY change_kind")
def _(s, d):
    log = table(s, d, "file_changes").distinct()
    late = F.unix_micros("seen_at") - F.unix_micros("event_at")
    return log.groupBy("change_kind").agg(F.count("*").alias("n"), F.count_if(late < 0).alias("early"), F.max(late).alias("most_us"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | samples.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | samples.SQL
