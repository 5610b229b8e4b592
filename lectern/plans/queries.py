"""Queries of the retrieval engine over the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT, shared_folder
from ..functions import language as L
from ..functions import phrases as P
from ..functions import quality as Q
from ..functions import references as R
from ..functions import text as T
from ..functions import unicode as U
from ..operators import catalog, chunking, conversations, evaluation, report, retrieval, vector_index
from ..operators.nearest import Way, nearest, within
from ..sources import html as pages_html
from ..sources import pages as page_files
from . import frames as fr

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


PAGES = """pages_t AS (SELECT doc_id, source || '_' || lang || '.pdf' AS source, lang || '/' || source || '_' || lang || '.pdf' AS relative_path,
  lang AS folder, CAST(doc_id + 1 AS INTEGER) AS page, text FROM documents)"""
CHUNKS = rf"""{PAGES}, cut AS (SELECT p.*, i, regexp_replace(substring(text, i + 1, 800), '^\s+|\s+$', '', 'g') AS document
  FROM (SELECT *, unnest(range(0, length(text), 650)) AS i FROM pages_t) p),
chunks_t AS (SELECT doc_id, source, relative_path, folder, page, document, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk
  FROM cut WHERE document <> '')"""
VECTORS = """vec AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, d.source || '_' || d.lang || '.pdf' AS source,
  CAST((d.doc_id + 1) % 7 AS INTEGER) AS page, 0 AS chunk, CASE WHEN d.doc_id % 11 <> 5 THEN d.lang END AS language, l.quality = 1 AS readable, d.text AS content
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
qs AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS q, CASE WHEN (vec_id // 50) % 2 = 0 THEN 'fr' ELSE 'en' END AS question_language,
  CASE WHEN (vec_id // 50) % 3 = 0 THEN 'SRC' || ((vec_id // 50) % 20) || '_' END AS prefix, (vec_id // 50) % 4 = 0 AS expand FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT qs.* EXCLUDE (q), vec.* EXCLUDE (v),
  round(1 - list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS distance FROM vec, qs)"""
AR, LA = "[^\\x{0600}-\\x{06FF}]", "[^A-Za-zÀ-ÿ]"


def duck_ar(c: str) -> str:
    return f"length(regexp_replace({c}, '{AR}', '', 'g'))"


def duck_la(c: str) -> str:
    return f"length(regexp_replace({c}, '{LA}', '', 'g'))"


def duck_kinds(c: str) -> str:
    return f"len(list_distinct(regexp_extract_all(lower({c}), '[a-zÀ-ÿ]')))"


def duck_script(c: str) -> str:
    a, b = duck_ar(c), duck_la(c)
    return (
        f"CASE WHEN {a} + {b} < 10 THEN NULL WHEN {a} / ({a} + {b}) >= 0.3 THEN 'ar' "
        f"WHEN {b} / ({a} + {b}) >= 0.7 AND {duck_kinds(c)} >= 4 THEN 'fr' END"
    )


def duck_readable(c: str, lang: str) -> str:
    a, b = duck_ar(c), duck_la(c)
    return (
        f"CASE WHEN {lang} = 'ar' THEN {a} >= 5 AND {a} / greatest({a} + {b}, 1) >= 0.15 "
        f"WHEN {lang} = 'fr' THEN {b} >= 10 AND {duck_kinds(c)} >= 4 ELSE false END"
    )


def docs(spark, d):
    return fr.table(spark, d, "documents")


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).lower() if isinstance(x, bool) else str(x)


def cases(name: str, columns: str, rows: list[tuple], expected: list, driver: str | None = None):
    """Registers a query over hand-made rows, whose results are stated, and over the driver's rows where `driver` says,
    in SQL for (case, value), what they give. The function gets the hand-made rows; their first column is `case`."""

    def keep(fn):
        told = ", ".join(f"({sql_value(r[0])}, {sql_value(e)})" for r, e in zip(rows, expected, strict=True))
        sql = f'SELECT * FROM (VALUES {told}) t("case", value)'
        QUERIES[name] = lambda spark, d: fn(spark, d, spark.createDataFrame(rows, columns))
        ORACLES[name] = f"{driver} UNION ALL {sql}" if driver else sql
        return fn

    return keep


TERMS = "list_distinct(list_filter(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[0-9]+|[a-zÀ-ÿ]{{2,}}'), lambda t: NOT list_contains(['avec','dans','des','est','les','pour','que','quel','quelle','sont','une','the','what','which'], t)))"


def folded(c: str) -> str:
    """Case and marks of Latin letters, which DuckDB can state; Arabic ones are hand-made rows."""
    return f"strip_accents(replace(lower({c}), 'ß', 'ss'))"


def header_form(c: str) -> str:
    return rf"trim(regexp_replace({folded(c)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def normal_form(c: str) -> str:
    bare = rf"regexp_replace({folded(c)}, '\(\s*[0-9]+([.,][0-9]+)?\s*\)', ' ', 'g')"
    plain = rf"""regexp_replace({bare}, '[-.,;:!?…"’‘“”''()\[\]{{}}<>«»/\\|_]+', ' ', 'g')"""
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"


# Sources and counts ------------------------------------------------------------------------------


@query("src10_collection_count", "SELECT count(*) AS chunks FROM embeddings")
def _(spark, d):
    return fr.table(spark, d, "embeddings").agg(F.count("*").alias("chunks"))


@query("src12_metadata_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars")


# Filters and projections ---------------------------------------------------------------------------


@query("fil1_language_filter", f"WITH {VECTORS} SELECT id, source FROM vec WHERE language = 'fr' AND readable")
def _(spark, d):
    return fr.vectors(spark, d).where("language = 'fr' and readable").select("id", "source")


@query("fil2_source_filter", f"WITH {VECTORS} SELECT id, page FROM vec WHERE source = 'src0_en.pdf' AND readable")
def _(spark, d):
    return fr.vectors(spark, d).where("source = 'src0_en.pdf' and readable").select("id", "page")


@query("fil3_readable_unless_false", f"WITH {VECTORS} SELECT id, readable FROM vec WHERE coalesce(readable, true)")
def _(spark, d):
    return fr.vectors(spark, d).where("coalesce(readable, true)").select("id", "readable")


@query("fil4_prefix_filter", f"WITH {PAGES} SELECT DISTINCT source FROM pages_t WHERE starts_with(lower(source), lower('SRC1'))")
def _(spark, d):
    return fr.pages(spark, d).where(F.lower("source").startswith("src1")).select("source").distinct()


@query("fil6_question_selection", "SELECT item_id, text FROM benchmark WHERE item_id = 7 UNION ALL (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10)")
def _(spark, d):
    items = fr.table(spark, d, "benchmark").select("item_id", "text")
    return evaluation.selected(items, "item_id", wanted=7, limit=5).unionByName(evaluation.selected(items, "item_id", limit=10))


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


OFFICIAL = ("blog.tionsh.example.net", "www.example.org")


def moved(spark, d):
    """Page URLs, every third on an official host and every third without a host that counts."""
    p = fr.table(spark, d, "pages").select("page_id", "url")
    other = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "HTTP://WWW.Example.org")
    return p.withColumn("url", F.when(F.col("page_id") % 3 == 0, other).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("ftp:"), "url")))


@query("fil7_official_host", f"SELECT page_id, page_id % 3 = 0 OR (page_id % 3 = 1 AND {HOST} = 'blog.tionsh.example.net') AS official FROM pages")
def _(spark, d):
    return moved(spark, d).select("page_id", catalog.is_official(F.col("url"), OFFICIAL).alias("official"))


PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("fil8_path_suffix", f"SELECT page_id, page_id % 4 < 2 OR contains(lower({PATH}), '.pdf') AS document FROM pages")
def _(spark, d):
    n = F.col("page_id") % 4
    tail = F.when(n == 0, "/a.PDF").when(n == 1, "/a.pdf.html").when(n == 2, "?f=a.pdf").otherwise("#a.pdf")
    p = fr.table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail).alias("url"))
    return p.select("page_id", catalog.is_document_url(F.col("url")).alias("document"))


SESSIONS = """s AS (SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN conv_id % 5 END AS user_id, arg_min(text, turn) AS first, count(*) AS messages
  FROM conversations GROUP BY conv_id)"""


@query("fil9_owner_predicate", f"WITH {SESSIONS} SELECT conv_id, 'anonymous' AS asked FROM s WHERE user_id IS NULL UNION ALL SELECT conv_id, 'one' FROM s WHERE user_id = 1")
def _(spark, d):
    s = fr.sessions(spark, d)
    ask = lambda who, user: s.where(conversations.owned_by(F.col("user_id"), user)).select("conv_id", F.lit(who).alias("asked"))
    return ask("anonymous", F.lit(None).cast("long")).unionByName(ask("one", F.lit(1)))


@query("prj1_chain_sources", f"WITH {VECTORS} SELECT id, source, page, chunk, language, readable, left(content, 100) AS preview FROM vec")
def _(spark, d):
    return fr.vectors(spark, d).select("id", "source", "page", "chunk", "language", "readable", F.substring("content", 1, 100).alias("preview"))


@query("prj2_api_sources", f"WITH {PAGES} SELECT doc_id, string_split(relative_path, '/')[-1] AS source, page FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", T.base_name(F.col("relative_path")).alias("source"), "page")


@query("prj3_evaluation_sources", f"WITH {VECTORS} SELECT id, source, page, chunk, language, readable FROM vec")
def _(spark, d):
    return fr.vectors(spark, d).select("id", "source", "page", "chunk", "language", "readable")


@query("prj6_message_view", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    return fr.messages(spark, d).select("conv_id", "turn", "role", "text")


@query("prj7_session_title", f"WITH {SESSIONS} SELECT conv_id, left(trim(regexp_replace(first, '\\s+', ' ', 'g')), 80) AS title FROM s")
def _(spark, d):
    return fr.sessions(spark, d).select("conv_id", T.session_title(F.col("first")).alias("title"))


@query("prj8_source_accessor", f"WITH {PAGES} SELECT doc_id, source FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", "source")


# Text ------------------------------------------------------------------------------------------------

CLEAN = r"""regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: NOT (length(regexp_replace(x, '\s+', '', 'g')) >= 8
  AND len(list_distinct(string_split(lower(regexp_replace(x, '\s+', '', 'g')), ''))) <= 2 AND NOT regexp_matches(x, '[0-9]'))), chr(10)),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query("str1_clean_text", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def _(spark, d):
    # Decomposition only matters beyond Latin-1, so only such texts go through Python.
    plain = docs(spark, d).select("doc_id", "text", F.col("text").rlike(r"[^\u0000-ÿ]").alias("wide"))
    done = plain.where("not coalesce(wide, false)").select("doc_id", "text").unionByName(plain.where("wide").select("doc_id", U.nfkc_udf("text").alias("text")))
    return done.select("doc_id", Q.clean_lines(F.col("text")).alias("cleaned"))


@query("str2_collapse", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS compact FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.collapse(F.col("text")).alias("compact"))


@query("str3_bounded_compact", r"SELECT doc_id, rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300)) AS compact FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.compact(F.col("text"), 300).alias("compact"))


@query(
    "str4_truncate_text",
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    g AS (SELECT *, left(t, 401) AS s FROM f),
    h AS (SELECT *, CASE WHEN contains(s, '. ') OR contains(s, '! ') OR contains(s, '? ') THEN 401 - least(
      CASE WHEN contains(s, '. ') THEN strpos(reverse(s), ' .') ELSE 9999 END, CASE WHEN contains(s, '! ') THEN strpos(reverse(s), ' !') ELSE 9999 END,
      CASE WHEN contains(s, '? ') THEN strpos(reverse(s), ' ?') ELSE 9999 END) - 1 ELSE -1 END AS e FROM g)
    SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN e >= 200 THEN left(s, e + 1)
      WHEN contains(s, ' ') THEN left(s, 401 - strpos(reverse(s), ' ')) || '…' ELSE left(t, 400) || '…' END AS short FROM h""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_text(F.col("text"), 400).alias("short"))


@cases(
    "str5_header_form",
    "case string, text string",
    [("h1", "  N° du TEXTE : Éléments_clés "), ("h2", "رَقْمُ النَّصّ:"), ("h3", "--"), ("h4", "ﬁche №2"), ("h5", None)],
    ["n du texte elements_cles", "رقم النص", "", "fiche No2", None],
    f"""SELECT 'd' || item_id AS "case", {header_form('text')} AS value FROM benchmark""",
)
def _(spark, d, rows):
    texts = fr.table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("case"), "text").unionByName(rows)
    return texts.select("case", U.header_udf("text").alias("value"))


def message_texts(spark, d, rows):
    return fr.messages(spark, d).select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), "text").unionByName(rows)


@cases(
    "str6_follow_up_form",
    "case string, text string",
    [("h1", "Qu’est-ce que cela signifie ?"), ("h2", "اشرحْ ذلكـ، رجاءً"), ("h3", "على"), ("h4", "ÇA  VA?!")],
    ["qu'est ce que cela signifie", "اشرح ذلك رجاء", "علي", "ca va"],
    rf"""SELECT 'd' || conv_id || '/' || turn AS "case", trim(regexp_replace(replace({folded('text')}, '’', ''''), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g')) AS value FROM conversations""",
)
def _(spark, d, rows):
    return message_texts(spark, d, rows).select("case", U.follow_up_udf("text").alias("value"))


@cases(
    "str7_comparison_form",
    "case string, text string",
    [("h1", "L’Élève (12,5) a_reçu : 3/4 !"), ("h2", "والوثيقة للمؤسسة"), ("h3", "إلى الآنَ"), ("h4", "واحد واثنان"), ("h5", "( 7 ) [x]")],
    ["l eleve a recu 3 4", "وثيقة موسسة", "ي ان", "و احد و اثنان", "x"],
    f"""SELECT 'd' || item_id AS "case", {normal_form('text')} AS value FROM benchmark""",
)
def _(spark, d, rows):
    texts = fr.table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("case"), "text").unionByName(rows)
    return texts.select("case", U.normalized_whole_udf("text").alias("value"))


@query(
    "str8_safe_filename",
    r"""WITH a AS (SELECT page_id, left(regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*]', ' ', 'g')), '\s+', '_', 'g'), 90) AS n FROM pages)
    SELECT page_id, CASE WHEN trim(n, ' ._') = '' THEN 'untitled' ELSE trim(n, ' ._') END AS name FROM a""",
)
def _(spark, d):
    return fr.table(spark, d, "pages").select("page_id", T.safe_component(F.col("url"), 90, "untitled").alias("name"))


@query("str9_source_name", f"WITH {PAGES} SELECT doc_id, string_split(replace(relative_path, '/', chr(92)), chr(92))[-1] AS name FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", T.base_name(F.translate("relative_path", "/", "\\"), "Unknown source").alias("name"))


@query("str10_ascii_digits", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS digits FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.ascii_digits(F.translate(F.col("doc_id").cast("string"), T.ASCII_DIGITS, T.ARABIC_INDIC_DIGITS)).alias("digits"))


@query("str11_reference_label", "SELECT doc_id, CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 3 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 3, '0') END || '/2026' AS label FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.concat(T.zfill(F.col("doc_id").cast("string")), F.lit("/2026")).alias("label"))


@query("str12_email", "SELECT c_custkey, lower(c_name) || '@example.org' AS email FROM customer")
def _(spark, d):
    return fr.table(spark, d, "customer").select("c_custkey", T.email(F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))).alias("email"))


# Language and quality ----------------------------------------------------------------------------------


@query("lng1_script_counts", f"SELECT doc_id, CAST({duck_ar('text')} AS INTEGER) AS arabic, CAST({duck_la('text')} AS INTEGER) AS latin FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", L.arabic_count(F.col("text")).alias("arabic"), L.latin_count(F.col("text")).alias("latin"))


@query("lng2_script_language", f"SELECT doc_id, {duck_script('text')} AS language FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", L.script_language(F.col("text")).alias("language"))


NAMED = "CASE WHEN folder IN ('ar', 'fr') THEN folder END"


@query("lng3_filename_language", f"WITH {PAGES} SELECT doc_id, {NAMED} AS language FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", L.filename_language(F.col("source")).alias("language"))


@query(
    "lng4_detect_language",
    f"""WITH {PAGES} SELECT doc_id, coalesce({NAMED}, {duck_script('text')}, 'unknown') AS language,
    CASE WHEN folder = 'fr' THEN 'filename' WHEN {duck_script('text')} IS NOT NULL THEN 'text' ELSE 'unknown' END AS language_source FROM pages_t""",
)
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", L.detect_language(L.scripts(F.col("text")), F.col("source"), F.lit("en")).alias("l")).select("doc_id", "l.*")


@query("lng5_question_language", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'fr' END AS language FROM conversations WHERE role = 'user'")
def _(spark, d):
    return fr.messages(spark, d).where("role = 'user'").select("conv_id", "turn", L.question_language(F.col("text")).alias("language"))


@query(
    "lng6_readability",
    f"SELECT doc_id, {duck_readable('text', 'lang')} AS readable, round({duck_ar('text')} / greatest({duck_ar('text')} + {duck_la('text')}, 1), 3) AS arabic_ratio FROM documents",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", L.is_readable(F.col("text"), F.col("lang")).alias("readable"), L.arabic_ratio(L.scripts(F.col("text"))).alias("arabic_ratio"))


@query(
    "lng7_document_language",
    f"""WITH {PAGES}, t AS (SELECT relative_path, any_value(folder) AS folder, string_agg(text, chr(10) ORDER BY page) AS text FROM pages_t GROUP BY relative_path)
    SELECT relative_path, coalesce({NAMED}, {duck_script('text')}, 'unknown') AS document_language,
    CASE WHEN folder = 'fr' THEN 'filename' WHEN {duck_script('text')} IS NOT NULL THEN 'text' ELSE 'unknown' END AS document_language_source FROM t""",
)
def _(spark, d):
    return chunking.document_language(fr.pages(spark, d))


@query("lng8_expected_page_language", f"WITH {PAGES} SELECT doc_id, coalesce({NAMED}, 'unknown') AS language FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", L.expected_page_language(F.col("source"), F.col("folder")).alias("language"))


@query(
    "lng9_record_language",
    rf"""WITH p AS (SELECT page_id, url, {PATH} AS path, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
    SELECT page_id, CASE WHEN list_contains(regexp_split_to_array(lower(path), '[/_.\-]+'), 'ar') THEN 'ar'
      WHEN list_contains(regexp_split_to_array(lower(path), '[/_.\-]+'), 'fr') THEN 'fr'
      WHEN {duck_ar('title')} / greatest({duck_ar('title')} + {duck_la('title')}, 1) >= 0.3 THEN 'ar' ELSE 'fr' END AS language FROM p""",
)
def _(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return fr.table(spark, d, "pages").select("page_id", L.record_language(title, F.col("url"), F.col("url")).alias("language"))


ARABIC_TEXT = "هذه إجابة عن السؤال المطروح في الوثيقة"
BOTH = f"(SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ما هو الأجل؟' ELSE 'Quel délai ?' END AS question, CASE turn % 3 WHEN 0 THEN '{ARABIC_TEXT}' WHEN 1 THEN text ELSE left(text, 3) || ' {ARABIC_TEXT}' END AS text FROM conversations)"


def both_languages(spark, d):
    """Messages with a question in one of two languages, a third of them in Arabic and a third mixed."""
    question = F.when(F.col("turn") % 2 == 0, "ما هو الأجل؟").otherwise("Quel délai ?")
    text = F.when(F.col("turn") % 3 == 0, ARABIC_TEXT).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.left("text", F.lit(3)), F.lit(" " + ARABIC_TEXT)))
    return fr.messages(spark, d).select("conv_id", "turn", question.alias("question"), text.alias("text"))


@query(
    "lng10_chain_answer_language",
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {duck_readable('text', chr(39) + 'ar' + chr(39))} ELSE {duck_la('text')} >= 5 AND {duck_la('text')} > {duck_ar('text')} END AS matches FROM {BOTH}",
)
def _(spark, d):
    return both_languages(spark, d).select("conv_id", "turn", L.chain_answer_language_matches(F.col("question"), F.col("text")).alias("matches"))


@query(
    "lng11_eval_answer_language",
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {duck_ar('text')} > 0 AND {duck_ar('text')} >= {duck_la('text')} WHEN 1 THEN {duck_la('text')} > 0 AND {duck_la('text')} > {duck_ar('text')}
    ELSE true END AS correct FROM {BOTH}""",
)
def _(spark, d):
    expected = F.when(F.col("turn") % 4 == 0, "ar").when(F.col("turn") % 4 == 1, "fr").otherwise("en")
    answer = F.concat("text", F.lit("\nSource: a long name in Latin letters that the answer's body does not have.pdf, page 1"))
    return both_languages(spark, d).select("conv_id", "turn", L.eval_answer_language(expected, R.answer_body(answer)).alias("correct"))


LETTERS = "lower(regexp_replace(text, '[^A-Za-zÀ-ÿ\\x{0600}-\\x{06FF}]', '', 'g'))"
DOMINANCE = f"coalesce(list_max(list_transform(list_filter(list_distinct(string_split({LETTERS}, '')), lambda c: c <> ''), lambda c: length({LETTERS}) - length(replace({LETTERS}, c, '')))) / greatest(length({LETTERS}), 1), 0)"
WORDS = "regexp_extract_all(text, '[A-Za-zÀ-ÿ\\x{0600}-\\x{06FF}0-9]+')"
SCORE = f"""CASE WHEN length({LETTERS}) + length(regexp_replace(text, '[^0-9]', '', 'g')) < 10 THEN 0.0 ELSE round(greatest(0.0, least(1.0,
  0.30 * least((length({LETTERS}) + length(regexp_replace(text, '[^0-9]', '', 'g'))) / 120, 1)
  + 0.25 * least((length({LETTERS}) + length(regexp_replace(text, '[^0-9]', '', 'g'))) / length(regexp_replace(text, '\\s', '', 'g')) / 0.70, 1)
  + 0.20 * least(len(list_distinct(list_transform({WORDS}, lambda w: lower(w)))) / 20, 1)
  + 0.25 * CASE WHEN folder = 'fr' THEN least({duck_la('text')} / 30, 1) ELSE least(length({LETTERS}) / 30, 1) END
  - greatest({DOMINANCE} - 0.35, 0))), 3) END"""


@query("agg1_letter_dominance", f"SELECT doc_id, round({DOMINANCE}, 6) AS dominance FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.round(Q.dominance(F.col("text")), 6).alias("dominance"))


@query("qlt1_quality_score", f"WITH {PAGES} SELECT doc_id, CAST({SCORE} AS DOUBLE) AS score FROM pages_t")
def _(spark, d):
    return fr.pages(spark, d).select("doc_id", Q.quality_score(F.col("text"), F.col("folder")).alias("score"))


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def short_lines(spark, d):
    """documents; every third with a line for each word."""
    return docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.translate("text", " ", "\n")).otherwise(F.col("text")).alias("text"))


@query(
    "qlt2_looks_like_table",
    f"""WITH short AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(10)) ELSE text END AS text FROM documents),
    l AS (SELECT doc_id, {LINES} AS ls FROM short) SELECT doc_id, len(ls) >= 6
    AND len(list_filter(ls, lambda x: length(x) <= 80)) / len(ls) >= 0.85 AND (len(list_filter(ls, lambda x: regexp_matches(x, '[0-9%]'))) / len(ls) >= 0.6
      OR doc_id % 2 = 1 AND len(list_filter(ls, lambda x: length(regexp_replace(x, '[^A-Za-z\\x{{C0}}-\\x{{FF}}]', '', 'g')) >= 3)) / len(ls) >= 0.6) AS is_table FROM l""",
)
def _(spark, d):
    """Every second document counts as Arabic, where lines of Latin letters make a table too; short lines are made of its words."""
    language = F.when(F.col("doc_id") % 2 == 1, "ar").otherwise("fr")
    return short_lines(spark, d).select("doc_id", Q.looks_like_table(F.col("text"), language).alias("is_table"))


@query(
    "qlt3_corrupted_arabic",
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN text ELSE repeat('كتاب ', CAST(8 + doc_id % 20 AS INTEGER)) || repeat(chr(1614), CAST(doc_id % 3 AS INTEGER)) END AS t, CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE 'ar' END AS lang FROM documents),
    n AS (SELECT *, length(regexp_replace(t, '[^\x{0600}-\x{06FF}]', '', 'g')) AS n,
      length(regexp_replace(t, '[^\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}\x{063B}-\x{063F}]', '', 'g')) AS odd FROM t)
    SELECT doc_id, lang = 'ar' AND n >= 50 AND odd / n >= 0.015 AS corrupted FROM n""",
)
def _(spark, d):
    n = F.col("doc_id")
    marked = F.concat(F.repeat(F.lit("كتاب "), (8 + n % 20).cast("int")), F.repeat(F.lit("َ"), (n % 3).cast("int")))
    rows = docs(spark, d).select("doc_id", F.when(n % 4 == 3, F.col("text")).otherwise(marked).alias("t"), F.when(n % 5 == 0, "fr").otherwise("ar").alias("lang"))
    return rows.select("doc_id", Q.corrupted_arabic(F.col("t"), F.col("lang")).alias("corrupted"))


@query("qlt4_low_quality", f"WITH {PAGES} SELECT doc_id FROM pages_t WHERE {SCORE} < 0.35")
def _(spark, d):
    rows = fr.pages(spark, d)
    return rows.where(Q.quality_score(F.col("text"), F.col("folder")) < DEFAULT.usable_quality).select("doc_id")


@query("fil10_poor_text", f"WITH {PAGES} SELECT doc_id, {SCORE} < 0.65 AS poor FROM pages_t")
def _(spark, d):
    score = Q.quality_score(F.col("text"), F.col("folder"))
    return fr.pages(spark, d).select("doc_id", ((score < DEFAULT.good_quality) | Q.corrupted_arabic(F.col("text"), F.col("folder"))).alias("poor"))


# Chunks -----------------------------------------------------------------------------------------------


@query("ing1_split_text", f"WITH {CHUNKS} SELECT doc_id, chunk, document FROM chunks_t")
def _(spark, d):
    return fr.chunks(spark, d).select("doc_id", "chunk", "document")


@query("ing2_chunk_id", f"WITH {CHUNKS} SELECT relative_path || '_page_' || page || '_chunk_' || chunk AS id FROM chunks_t")
def _(spark, d):
    return fr.chunks(spark, d).select("id")


@query("win1_chunk_ordinal", f"WITH {CHUNKS} SELECT doc_id, max(chunk) AS last_chunk, count(*) AS chunks FROM chunks_t GROUP BY doc_id")
def _(spark, d):
    return fr.chunks(spark, d).groupBy("doc_id").agg(F.max("chunk").alias("last_chunk"), F.count("*").alias("chunks"))


@query("ing4_text_candidate", f"WITH {PAGES}, c AS (SELECT doc_id, folder, {CLEAN} AS text FROM pages_t) SELECT doc_id, text, CAST({SCORE} AS DOUBLE) AS score FROM c")
def _(spark, d):
    rows = fr.pages(spark, d).select("doc_id", "text", F.col("folder").alias("language"))
    return chunking.candidate_scores(rows).select("doc_id", "text", "score")


def duck_clean(c: str) -> str:
    return CLEAN.replace("string_split(text, chr(10))", f"string_split({c}, chr(10))")


@query(
    "ing7_extractor_cascade",
    f"""WITH {PAGES}, c AS (SELECT doc_id, folder, m, {duck_clean("CASE m WHEN 0 THEN left(text, length(text) // 2) ELSE text END")} AS text FROM pages_t, (VALUES (0), (1)) v(m)),
    s AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score FROM c), p AS (SELECT *, max(CASE WHEN m = 0 AND score < 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS poor FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text <> '' DESC, score DESC, length(text) DESC, m) AS n FROM p WHERE m <= poor)
    SELECT doc_id, text, CASE m WHEN 0 THEN 'pymupdf' ELSE 'pdfplumber' END AS method, score, false AS corrupted FROM r WHERE n = 1 AND text <> ''""",
)
def _(spark, d):
    """Two texts of each page: its first half as the native extractor's, the text itself as the second one's."""
    p = fr.pages(spark, d).select("doc_id", "text", F.col("folder").alias("language"))
    half = p.withColumn("text", F.left("text", F.floor(F.length("text") / 2)))
    rows = half.withColumn("method", F.lit("pymupdf")).unionByName(p.withColumn("method", F.lit("pdfplumber")))
    return chunking.cascade(chunking.candidate_scores(rows), ["doc_id"])


@query(
    "ing10_readable_flag",
    f"WITH {PAGES} SELECT doc_id, {duck_readable('text', 'folder')} AND {SCORE} >= 0.35 AS readable FROM pages_t",
)
def _(spark, d):
    sound = Q.quality_score(F.col("text"), F.col("folder")) >= DEFAULT.usable_quality
    return fr.pages(spark, d).select("doc_id", (L.is_readable(F.col("text"), F.col("folder")) & sound).alias("readable"))


@query(
    "prj4_chunk_metadata",
    f"""WITH {CHUNKS} SELECT doc_id, chunk, source, relative_path, page, page % 5 = 0 AS ocr_used, round({duck_ar('document')} / greatest({duck_ar('document')} + {duck_la('document')}, 1), 3) AS arabic_ratio FROM chunks_t""",
)
def _(spark, d):
    return fr.chunk_table(spark, d).select("doc_id", "chunk", "source", "relative_path", "page", "ocr_used", "arabic_ratio")


@query(
    "top4_best_candidate",
    """WITH c AS (SELECT doc_id, m, text[1:(CASE m WHEN 0 THEN length(text) // 2 ELSE length(text) END)] AS t FROM documents, (VALUES (0), (1)) v(m)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 0 DESC, length(t) DESC, m) AS n FROM c)
    SELECT doc_id, 'm' || m AS method, length(t) AS chars FROM r WHERE n = 1 AND length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 0""",
)
def _(spark, d):
    p = docs(spark, d).select("doc_id", "text", F.lit(0.5).alias("score"), F.lit(False).alias("corrupted"))
    half = p.withColumn("text", F.left("text", F.floor(F.length("text") / 2)))
    rows = half.withColumns({"method": F.lit("m0"), "ordinal": F.lit(0)}).unionByName(p.withColumns({"method": F.lit("m1"), "ordinal": F.lit(1)}))
    best = chunking.best_candidate(rows, ["doc_id"])
    return best.select("doc_id", "method", F.length("text").cast("long").alias("chars"))


@query(
    "top5_longest_title",
    r"""WITH v AS (SELECT doc_id, [lang, source, regexp_extract(text, '^\S+'), '', CAST(doc_id AS VARCHAR), regexp_extract(text, '\S+\s*$')] AS vs, CAST(doc_id AS VARCHAR) AS number, source AS date FROM documents),
    e AS (SELECT doc_id, number, date, unnest(vs) AS x, unnest(range(0, 6)) AS i FROM v)
    SELECT doc_id, coalesce(arg_max(x, length(x) * 100 - i) FILTER (WHERE x <> '' AND x <> number AND x <> date), any_value(number)) AS title FROM e GROUP BY doc_id""",
)
def _(spark, d):
    """Of a row's cells the longest that is neither number nor date, the first of equally long ones."""
    cells = F.array("lang", "source", F.regexp_extract("text", r"^\S+", 0), F.lit(""), F.col("doc_id").cast("string"), F.regexp_extract("text", r"\S+\s*$", 0))
    return docs(spark, d).select("doc_id", R.record_title(cells, F.col("doc_id").cast("string"), F.col("source")).alias("title"))


# Joins ------------------------------------------------------------------------------------------------


@query(
    "joi1_chunk_metadata",
    f"""WITH {CHUNKS}, m AS (SELECT DISTINCT relative_path, upper(source) AS title FROM pages_t WHERE folder = 'fr')
    SELECT c.doc_id, c.chunk, coalesce(m.title, '') AS document_title FROM chunks_t c LEFT JOIN m USING (relative_path)""",
)
def _(spark, d):
    rows = fr.chunks(spark, d).join(fr.metadata(spark, d), "relative_path", "left")
    return rows.select("doc_id", "chunk", F.coalesce("document_title", F.lit("")).alias("document_title"))


@query("joi2_known_records", "SELECT p.page_id, k.page_id IS NOT NULL AS known FROM pages p LEFT JOIN (SELECT page_id, url FROM pages WHERE page_id % 2 = 0) k ON p.url = k.url AND p.page_id = k.page_id")
def _(spark, d):
    p = fr.table(spark, d, "pages").select("page_id", "url")
    known = p.where("page_id % 2 = 0").withColumn("_k", F.lit(True))
    return p.join(known, ["page_id", "url"], "left").select("page_id", F.col("_k").isNotNull().alias("known"))


@query(
    "joi3_hash_duplicates",
    """WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents), f AS (SELECT digest, min(doc_id) AS first FROM h GROUP BY digest)
    SELECT doc_id, first FROM h JOIN f USING (digest) WHERE doc_id <> first""",
)
def _(spark, d):
    h = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    first = h.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return h.join(first, "digest").where("doc_id <> first").select("doc_id", "first")


@query("joi4_first_url", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def _(spark, d):
    p = fr.table(spark, d, "pages").select(F.col("url").alias("pdf_url"), F.col("page_id").alias("ordinal"))
    return catalog.first_by_url(p).select(F.col("pdf_url").alias("url"), F.col("ordinal").alias("page_id"))


@query("joi5_similarity_pairs", f"WITH {VECTORS} SELECT question_id, id, distance FROM pairs WHERE distance <= 0.5")
def _(spark, d):
    near = within(fr.searched(spark, d), fr.questions(spark, d), 0.5)
    return near.select("question_id", "id", "distance")


FACTS = f"f AS (SELECT item_id, {normal_form('text')} AS fact FROM benchmark), dt AS (SELECT doc_id, {normal_form('text')} AS t FROM documents)"


@query("joi9_fact_containment", f"WITH {FACTS} SELECT item_id, doc_id FROM f JOIN dt ON contains(t, fact) WHERE fact <> ''")
def _(spark, d):
    facts = fr.table(spark, d, "benchmark").select("item_id", F.upper("text").alias("fact"))
    return evaluation.fact_texts(facts, docs(spark, d), "item_id", "fact", "doc_id", "text")


@query("joi10_message_owner", f"WITH {SESSIONS} SELECT c.conv_id, c.turn, s.user_id FROM conversations c JOIN s USING (conv_id)")
def _(spark, d):
    return fr.messages(spark, d).join(fr.sessions(spark, d), "conv_id").select("conv_id", "turn", "user_id")


RANKED = f"{VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM pairs)"


@query(
    "joi6_expected_documents",
    f"WITH {RANKED}, e(doc) AS (VALUES ('src0_en.pdf'), ('src1_fr.pdf')) SELECT question_id, rank, doc FROM r JOIN e ON contains(source, doc) WHERE rank <= 10",
)
def _(spark, d):
    top = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 10)
    expected = spark.createDataFrame([("src0_en.pdf",), ("src1_fr.pdf",)], "doc string")
    return top.join(F.broadcast(expected), F.col("source").contains(F.col("doc"))).select("question_id", "rank", "doc")


@query(
    "joi7_citation_matches",
    f"""WITH {RANKED}, c AS (SELECT question_id, CASE WHEN question_id % 100 = 0 THEN 'src' ELSE 'src1_en.pdf page' END AS cited, CASE WHEN question_id % 150 = 0 THEN 3 END AS cited_page FROM qs)
    SELECT question_id, rank FROM c JOIN r USING (question_id) WHERE rank <= 5 AND (contains(source, cited) OR contains(cited, source)) AND (cited_page IS NULL OR cited_page = page)""",
)
def _(spark, d):
    q = fr.questions(spark, d)
    cited = F.when(F.col("question_id") % 100 == 0, "src").otherwise("src1_en.pdf page")
    c = q.select("question_id", cited.alias("cited"), F.when(F.col("question_id") % 150 == 0, 3).alias("cited_page"))
    return evaluation.citation_matches(c, retrieval.knn(fr.searched(spark, d), q, 5)).select("question_id", "rank")


@query(
    "joi8_cited_chunk",
    f"""WITH {RANKED}, c AS (SELECT question_id, source, page FROM r WHERE rank = 2)
    SELECT c.question_id, min(r.rank) AS rank FROM c JOIN r ON r.question_id = c.question_id AND r.source = c.source AND r.page = c.page AND r.rank <= 10 GROUP BY c.question_id""",
)
def _(spark, d):
    top = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 10).select("question_id", T.base_name(F.col("source")).alias("source"), "page", "rank")
    cited = top.where("rank = 2").select("question_id", "source", "page")
    return cited.join(top, ["question_id", "source", "page"]).groupBy("question_id").agg(F.min("rank").alias("rank"))


@query(
    "joi11_same_source_neighbours",
    f"""WITH {RANKED} SELECT DISTINCT a.question_id, a.id FROM r a JOIN r b ON a.question_id = b.question_id AND a.source = b.source AND abs(a.page - b.page) <= 1
    WHERE a.rank <= 50 AND b.rank <= 2""",
)
def _(spark, d):
    top = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 50)
    best = top.where("rank <= 2").select("question_id", "source", F.col("page").alias("p2"))
    near = (top["question_id"] == best["question_id"]) & (top["source"] == best["source"]) & (F.abs(top["page"] - best["p2"]) <= 1)
    return top.join(best, near, "left_semi").select("question_id", "id")


# Aggregates ---------------------------------------------------------------------------------------------

TABLE = f"""{CHUNKS}, q AS (SELECT doc_id, CAST({SCORE} AS DOUBLE) AS quality, {duck_script('text')} AS page_script FROM pages_t),
wd AS (SELECT relative_path AS path, string_agg(text, chr(10) ORDER BY page) AS text FROM pages_t GROUP BY relative_path), dl AS (SELECT path, {duck_script('text')} AS doc_script FROM wd),
ct AS (SELECT c.*, q.quality, c.page % 5 = 0 AS ocr_used, coalesce({NAMED}, {duck_script('document')}, page_script, doc_script, 'unknown') AS language,
  CASE WHEN {NAMED} IS NOT NULL THEN 'filename' WHEN {duck_script('document')} IS NOT NULL THEN 'text' WHEN coalesce(page_script, doc_script) IS NOT NULL THEN 'inherited' ELSE 'unknown' END AS language_source,
  round({duck_ar('document')} / greatest({duck_ar('document')} + {duck_la('document')}, 1), 3) AS arabic_ratio
  FROM chunks_t c JOIN q USING (doc_id) JOIN dl ON dl.path = c.relative_path),
cr AS (SELECT *, coalesce({duck_readable('document', 'language')}, false) AND quality >= 0.35 AS readable FROM ct)"""
CATALOGUE = r"""m AS (SELECT DISTINCT relative_path, 'https://example.org/' || source AS source_url, 'https://example.org/fr' AS source_page_url,
  regexp_extract(source, '(\d+)', 1) AS document_number, upper(source) AS document_title FROM pages_t WHERE folder = 'fr')"""


@query(
    "ing3_chunk_table",
    f"""WITH {TABLE}, {CATALOGUE} SELECT doc_id, source, relative_path, folder, page, quality AS extraction_quality, CASE WHEN ocr_used THEN 'ocr_psm_3' ELSE 'pymupdf' END AS extraction_method,
    chunk, document, relative_path || '_page_' || page || '_chunk_' || chunk AS id, language, language_source, readable, arabic_ratio, ocr_used,
    coalesce(m.source_url, '') AS source_url, coalesce(m.source_page_url, '') AS source_page_url, coalesce(m.document_number, '') AS document_number, coalesce(m.document_title, '') AS document_title
    FROM cr LEFT JOIN m USING (relative_path)""",
)
def _(spark, d):
    return fr.chunk_table(spark, d)


@query(
    "agg5_document_stats",
    f"""WITH {TABLE} SELECT source, count(*) AS chunks, count(DISTINCT page) AS pages, count_if(ocr_used) AS ocr_chunks, count_if(quality < 0.5) AS low_quality_chunks
    FROM ct GROUP BY source""",
)
def _(spark, d):
    return report.document_stats(fr.chunk_table(spark, d)).select("source", "chunks", "pages", "ocr_chunks", "low_quality_chunks")


@query("agg6_pages_per_document", f"WITH {PAGES} SELECT source, count(DISTINCT page) AS pages FROM pages_t WHERE regexp_matches(text, '\\S') GROUP BY source")
def _(spark, d):
    return report.document_stats(fr.chunk_table(spark, d)).select("source", "pages")


@query(
    "agg7_risk_documents",
    f"""WITH {TABLE}, s AS (SELECT source, count(*) AS chunks, count_if(ocr_used) AS ocr_chunks, count_if(quality < 0.5) AS low_quality_chunks, count_if(NOT readable) AS unreadable_chunks FROM cr GROUP BY source)
    SELECT source, round(ocr_chunks / chunks, 3) AS ocr_ratio, low_quality_chunks, unreadable_chunks FROM s WHERE ocr_chunks / chunks >= 0.5 OR low_quality_chunks > 0 OR unreadable_chunks > 0""",
)
def _(spark, d):
    return report.risk_documents(fr.chunk_table(spark, d)).select("source", "ocr_ratio", "low_quality_chunks", "unreadable_chunks")


@query("agg2_by_source", f"WITH {CHUNKS} SELECT source, count(*) AS chunks, arg_min(left(document, 100), page * 100000 + chunk) AS preview FROM chunks_t GROUP BY source")
def _(spark, d):
    return report.ingestion_by_source(fr.chunk_table(spark, d)).select("source", "chunks", "preview")


@query(
    "agg3_ingestion_summary",
    f"""WITH {CHUNKS}, n AS (SELECT relative_path, count(*) AS n FROM pages_t GROUP BY 1), bad AS (SELECT relative_path, n % 8 = 0 AS broken FROM n WHERE n % 4 = 0),
    ok AS (SELECT * FROM chunks_t WHERE relative_path NOT IN (SELECT relative_path FROM bad))
    SELECT NULL AS failed_file, (SELECT count(*) FROM n) AS found, (SELECT count(DISTINCT relative_path) FROM ok) AS ingested, (SELECT count(*) FROM ok) AS chunks, (SELECT count(*) FROM bad) AS failed
    UNION ALL SELECT relative_path || CASE WHEN broken THEN ': broken' ELSE ': no usable text' END, NULL, NULL, NULL, NULL FROM bad""",
)
def _(spark, d):
    """Files whose number of pages is a multiple of eight count as broken, of four as empty; a row for each of them."""
    p = fr.pages(spark, d)
    counts = p.groupBy("relative_path").count()
    bad = counts.where("count % 8 = 0").select("relative_path", F.lit("broken").alias("error"))
    good = p.join(counts.where("count % 4 > 0"), "relative_path", "left_semi")
    outcomes = page_files.file_outcomes(p, good, bad, chunking.split_pages(good), "relative_path")
    total = page_files.ingestion_summary(outcomes).select(F.lit(None).cast("string").alias("failed_file"), "found", "ingested", "chunks", "failed")
    none = [F.lit(None).cast("long")] * 4
    return total.union(outcomes.where("error is not null").select(F.concat("relative_path", F.lit(": "), "error"), *none))


@query(
    "agg4_corpus_counters",
    f"""WITH {TABLE}, m AS (SELECT language, CASE WHEN ocr_used THEN 'ocr_psm_3' ELSE 'pymupdf' END AS method, language_source FROM ct)
    SELECT 'language' AS field, language AS value, count(*) AS chunks FROM m GROUP BY 2 UNION ALL SELECT 'extraction_method', method, count(*) FROM m GROUP BY 2
    UNION ALL SELECT 'language_source', language_source, count(*) FROM m GROUP BY 2""",
)
def _(spark, d):
    return report.all_counters(fr.chunk_table(spark, d), ["language", "extraction_method", "language_source"])


@query(
    "agg8_corpus_totals",
    f"""WITH {TABLE} SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_documents, count_if(ocr_used) AS ocr_based_chunks, count(*) - count_if(ocr_used) AS native_extraction_chunks,
    count_if(quality < 0.5) AS low_quality_chunks, count_if(NOT readable) AS unreadable_chunks, count_if(page % 9 = 2) AS corrupted_chunks FROM cr""",
)
def _(spark, d):
    """Every ninth page counts as corrupted."""
    return report.totals(fr.chunk_table(spark, d).withColumn("corrupted", F.col("page") % 9 == 2))


@query(
    "agg9_scrape_counters",
    """WITH f AS (SELECT url, min(page_id) AS o, arg_min(html, page_id) AS html FROM pages GROUP BY url), k AS (SELECT url FROM pages WHERE page_id % 4 = 0),
    a AS (SELECT o, url IN (SELECT url FROM k) AS known, sha256(html) AS h FROM f), b AS (SELECT *, min(CASE WHEN NOT known THEN o END) OVER (PARTITION BY h) AS e FROM a),
    c AS (SELECT *, CASE WHEN known THEN 'skip_url' WHEN o > e THEN 'duplicate_hash' ELSE 'download' END AS action, o % 7 = 3 AS broken, row_number() OVER (PARTITION BY o % 10 ORDER BY o) > 1 AS taken FROM b)
    SELECT count(*) AS discovered, count_if(action = 'download' AND NOT broken) AS download, count_if(action = 'download' AND broken) AS failed, count_if(action <> 'download') AS skipped,
    count_if(action = 'skip_url') AS skip_url, count_if(action = 'duplicate_hash') AS duplicate_hash, count_if(action = 'download' AND NOT broken AND taken) AS collisions,
    count_if(o % 2 = 0) AS language_ar, count_if(o % 2 = 1) AS language_fr FROM c""",
)
def _(spark, d):
    """Every seventh download fails; ten names are shared by all."""
    p = fr.table(spark, d, "pages")
    language = F.when(F.col("page_id") % 2 == 0, "ar").otherwise("fr")
    rows = p.select(F.col("url").alias("pdf_url"), F.sha2("html", 256).alias("content_sha256"), F.col("page_id").alias("ordinal"), language.alias("language"))
    known = rows.where("ordinal % 4 = 0").select("pdf_url")
    done = catalog.actions(rows, known, spark.createDataFrame([], "content_sha256 string"))
    done = done.withColumn("error", F.when(F.col("ordinal") % 7 == 3, "timeout")).withColumn("name", F.concat(F.lit("n"), (F.col("ordinal") % 10).cast("string"), F.lit(".pdf")))
    return catalog.counters(catalog.unique_names(done, "name", "content_sha256", "ordinal"))


@query("agg10_average", "SELECT round(avg(quality), 3) AS mean_quality FROM labels")
def _(spark, d):
    return fr.table(spark, d, "labels").agg(evaluation.average(F.col("quality")).alias("mean_quality"))


@query("agg11_count_metric", "SELECT count_if(quality = 1) AS count, count(quality) AS out_of FROM labels")
def _(spark, d):
    return fr.table(spark, d, "labels").agg(evaluation.count_metric(F.col("quality") == 1).alias("m")).select("m.*")


# Answers to questions without one, composed so that each way to judge them comes up.
ABSENT_ANSWERS = (
    "L'information n'est pas disponible dans les documents.",
    "Oui, le délai est de dix jours.",
    "Le délai est de dix jours.",
    "L'information n'est pas disponible.\nSource: a.pdf, page 2",
    "Oui, mais l'information n'est pas disponible.",
    "المعلومة غير متوفرة في الوثائق.",
)
ABSENT = "(SELECT doc_id, doc_id % 6 AS k, quality FROM labels)"
ABSENT_RISK = "CASE k WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'high' ELSE 'low' END"


def absent_answers(spark, d):
    answer = F.get(F.array(*map(F.lit, ABSENT_ANSWERS)), (F.col("doc_id") % 6).cast("int"))
    rows = fr.table(spark, d, "labels").select("doc_id", "quality", answer.alias("answer"))
    rows = evaluation.decided(rows)
    missing = evaluation.unavailable_signal(F.col("answer"))
    ok, risk = evaluation.absent_answer(missing, F.col("decision"), F.col("contradiction"), R.cited_source(F.col("answer")))
    return rows.select("doc_id", "quality", ok.alias("correct"), risk.alias("risk"))


@query("agg13_risk_histogram", f"SELECT {ABSENT_RISK} AS hallucination_risk, count(*) AS questions FROM {ABSENT} WHERE quality = 0 GROUP BY 1")
def _(spark, d):
    return evaluation.risk_histogram(absent_answers(spark, d).select((F.col("quality") == 1).alias("answer_available"), F.col("risk").alias("hallucination_risk")))


@query("agg14_metadata_available", f"WITH {VECTORS} SELECT bool_or(readable IS NOT NULL) AS readable, bool_or(id % 90 = 7) AS corrupted, bool_or(id < 0) AS blank, bool_or(id < 0) AS other FROM vec")
def _(spark, d):
    v = fr.vectors(spark, d).withColumns({"corrupted": F.when(F.col("id") % 90 == 7, F.lit(False)), "blank": F.lit(None).cast("string")})
    return v.agg(*[report.available(v, c).alias(c) for c in ("readable", "corrupted", "blank", "other")])


# Order --------------------------------------------------------------------------------------------------


@query("top1_vector_knn", f"WITH {RANKED} SELECT question_id, id, rank, distance FROM r WHERE rank <= 10")
def _(spark, d):
    return retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 10).select("question_id", "id", F.col("rank").cast("long").alias("rank"), "distance")


@query("snk1_indexed_search", f"WITH {RANKED} SELECT question_id, id, rank, distance FROM r WHERE rank <= 10")
def _(spark, d):
    """The collection written in cells around centres, and searched without the cells that are too far away."""
    vectors = fr.vectors(spark, d).select("id", "embedding", "source", "page")
    index = vector_index.build(vectors, shared_folder(spark, "cells"), 32)
    found, _ = vector_index.search(spark, index, vectors.schema, fr.questions(spark, d), 10)
    return found.select("question_id", "id", F.col("rank").cast("long").alias("rank"), "distance")


BONUS = """lr AS (SELECT *, round(distance - CASE WHEN language = question_language THEN 0.005 ELSE 0 END, 6) AS score FROM pairs),
lk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, distance, id) AS rank FROM lr)"""


@query("top2_language_ranking", f"WITH {VECTORS}, {BONUS} SELECT question_id, id, rank, score FROM lk WHERE rank <= 20")
def _(spark, d):
    ranked = retrieval.language_knn(fr.searched(spark, d), fr.questions(spark, d), 20)
    return ranked.select("question_id", "id", F.col("rank").cast("long").alias("rank"), "score")


@query(
    "top3_document_knn",
    f"""WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM pairs WHERE starts_with(lower(source), lower(prefix)) AND readable)
    SELECT question_id, id, rank FROM r WHERE rank <= 8""",
)
def _(spark, d):
    return retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 8, "named").select("question_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "top6_session_order",
    """WITH s AS (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id), l AS (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 3 > 0 GROUP BY user_id)
    SELECT user_id, greatest(created_at, coalesce(last, created_at)) AS updated_at, row_number() OVER (ORDER BY greatest(created_at, coalesce(last, created_at)) DESC, user_id) AS place FROM s LEFT JOIN l USING (user_id) QUALIFY place <= 50""",
)
def _(spark, d):
    """Users' first events as sessions, two thirds of their events as messages."""
    e = fr.table(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("updated_at"))
    m = e.where("event_id % 3 > 0").select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    top = conversations.recency(s, m).limit(50)
    place = F.row_number().over(Window.orderBy(F.col("updated_at").desc(), "id")).cast("long")
    return top.select(F.col("id").alias("user_id"), "updated_at", place.alias("place"))


@query(
    "top7_evidence_chunk",
    f"""WITH {RANKED}, a AS (SELECT item_id * 50 AS question_id, text AS question, CASE item_id % 3 WHEN 0 THEN 'Voir le document n° 2.' WHEN 1 THEN text ELSE left(text, 40) END AS answer, item_id % 3 AS k FROM benchmark),
    t AS (SELECT r.*, a.question, a.answer, a.k, {TERMS.format("question || ' ' || answer")} AS terms, {TERMS.format('question')} AS entities, {TERMS.format('content')} AS words FROM r JOIN a USING (question_id) WHERE rank <= 4),
    s AS (SELECT *, count(DISTINCT coalesce(language, '?')) OVER (PARTITION BY question_id) AS languages FROM t),
    e AS (SELECT *, CASE WHEN k = 0 AND rank = 2 THEN 1e9 WHEN languages > 1 THEN -distance ELSE round(len(list_intersect(entities, words)) * 0.12 + len(list_intersect(terms, words)) * 0.01 - distance, 9) END AS score FROM s)
    SELECT question_id, id, rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS n FROM e) WHERE n = 1""",
)
def _(spark, d):
    rows = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 4).withColumnRenamed("rank", "place")
    n, text = F.col("item_id"), F.col("text")
    answer = F.when(n % 3 == 0, "Voir le document n° 2.").when(n % 3 == 1, text).otherwise(F.left(text, F.lit(40)))
    asked = fr.table(spark, d, "benchmark").select((n * 50).alias("question_id"), text.alias("question"), answer.alias("answer"))
    return retrieval.evidence(fr.with_content(rows.join(asked, "question_id"), spark, d)).select("question_id", "id", F.col("place").cast("long").alias("place"))


@query(
    "win2_first_of_key",
    f"""WITH {VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY question_id, source, page, chunk ORDER BY distance, id) AS n FROM pairs),
    l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS m FROM k WHERE n = 1) SELECT question_id, id FROM l WHERE m <= 15""",
)
def _(spark, d):
    return retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 15, each=("source", "page", "chunk")).select("question_id", "id")


LAST = "last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("win3_last_by_role", f"SELECT conv_id, turn, {LAST} AS last_assistant FROM conversations")
def _(spark, d):
    return conversations.with_history(fr.messages(spark, d), "conv_id", "turn").select("conv_id", "turn", "last_assistant")


ASKED = "(SELECT conv_id, turn, role, CASE WHEN role = 'user' AND (conv_id + turn) % 3 = 0 THEN 'Pourquoi ?' WHEN role = 'user' AND (conv_id + turn) % 3 = 1 THEN 'اشرح ذلك من فضلك' ELSE text END AS text, role = 'user' AND (conv_id + turn) % 3 < 2 AS again FROM conversations)"


def asked_again(spark, d):
    """Messages in which two thirds of what users say is a follow-up."""
    n = (F.col("conv_id") + F.col("turn")) % 3
    text = F.when((F.col("role") == "user") & (n == 0), "Pourquoi ?").when((F.col("role") == "user") & (n == 1), "اشرح ذلك من فضلك").otherwise(F.col("text"))
    return fr.messages(spark, d).withColumn("text", text)


@query("win4_last_standalone", f"SELECT conv_id, turn, {LAST.replace('assistant', 'user').replace(' THEN', ' AND NOT again THEN')} AS last_user FROM {ASKED}")
def _(spark, d):
    return conversations.with_history(asked_again(spark, d), "conv_id", "turn").select("conv_id", "turn", "last_user")


FOREIGN = """fo AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY distance, id) AS n FROM pairs WHERE language IS DISTINCT FROM question_language),
fb AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS m FROM fo WHERE n = 1)"""


@query("win5_foreign_best", f"WITH {VECTORS}, {FOREIGN} SELECT question_id, id FROM fb WHERE m <= 2")
def _(spark, d):
    return retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 2, "foreign", each=("source",)).select("question_id", "id")


@query("win6_first_rank", f"WITH {RANKED} SELECT question_id, min(CASE WHEN contains(source, 'src1') THEN rank END) AS document_rank FROM r WHERE rank <= 20 GROUP BY question_id")
def _(spark, d):
    top = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 20)
    return top.groupBy("question_id").agg(F.min(F.when(F.col("source").contains("src1"), F.col("rank"))).cast("long").alias("document_rank"))


@query("win7_consecutive_duplicates", "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role")
def _(spark, d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = fr.messages(spark, d).withColumn("before", before)
    return rows.where(~F.col("before").eqNullSafe(F.col("role"))).select("conv_id", "turn", "role")


def truncated(text: str, limit: str) -> str:
    """Text cut to `limit` as truncate_text does."""
    t = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    s = f"left({t}, {limit} + 1)"
    place = lambda m: f"CASE WHEN contains({s}, '{m}') THEN length({s}) - strpos(reverse({s}), '{m[::-1]}') - 1 ELSE -1 END"
    end = f"greatest({place('. ')}, {place('! ')}, {place('? ')}, {place('؟ ')})"
    space = f"CASE WHEN contains({s}, ' ') THEN left({s}, length({s}) - strpos(reverse({s}), ' ')) ELSE left({t}, {limit}) END || '…'"
    return f"CASE WHEN length({t}) <= {limit} THEN {t} WHEN {end} >= {limit} // 2 THEN left({s}, {end} + 1) ELSE {space} END"


def context_sql(rows: int) -> str:
    """Contexts of the first `rows` (2 or 3) chunks; up to the third, one is only cut by its own limit or the rest of the budget."""
    head = """'[Document ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Page: ' || page || chr(10) || 'Language: ' || coalesce(language, 'unknown') || chr(10)
      || 'Readable: ' || CASE WHEN readable IS NULL THEN 'Unknown' WHEN readable THEN 'True' ELSE 'False' END || chr(10) || 'Excerpt: '"""
    return f"""WITH {RANKED}, h AS (SELECT question_id, rank, content, {head} AS head FROM r WHERE rank <= {rows}),
    s AS (SELECT *, head || {truncated('content', '1800')} AS section FROM h),
    two AS (SELECT question_id, max(CASE WHEN rank = 1 THEN section END) || chr(10) || chr(10) || max(CASE WHEN rank = 2 THEN section END) AS context FROM s GROUP BY question_id),
    three AS (SELECT two.question_id, context, head, content, least(1800, 5000 - length(context) - 2 - length(head)) AS room FROM two JOIN h ON h.question_id = two.question_id AND rank = {rows}),
    all_ AS (SELECT question_id, CASE WHEN {rows} = 2 THEN context ELSE context || chr(10) || chr(10) || head || {truncated('content', 'room')} END AS context FROM three)
    SELECT question_id, context, length(context) AS chars, {rows} AS chunks FROM all_"""


@query("win8_format_context", context_sql(3))
def _(spark, d):
    found = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 3).withColumnRenamed("rank", "place")
    return retrieval.format_context(fr.with_content(found, spark, d))


@query("win9_distance_gap", f"WITH {RANKED} SELECT question_id, round(max(CASE WHEN rank = 2 THEN distance END) - max(CASE WHEN rank = 1 THEN distance END), 6) >= 0.02 AS wide FROM r GROUP BY question_id")
def _(spark, d):
    w = Window.partitionBy("question_id").orderBy("rank")
    rows = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 2).withColumn("next", F.lead("distance").over(w))
    return rows.where("rank = 1").select("question_id", (F.round(F.col("next") - F.col("distance"), 6) >= DEFAULT.distance_gap).alias("wide"))


# Sets ---------------------------------------------------------------------------------------------------


@query(
    "set1_preferred_and_readable",
    f"""WITH {VECTORS}, own AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS k FROM pairs WHERE language = question_language AND readable),
    wide AS (SELECT question_id, id, readable, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS k FROM pairs)
    SELECT question_id, id FROM own WHERE k <= 2 UNION SELECT question_id, id FROM wide WHERE k <= 20 AND coalesce(readable, true)""",
)
def _(spark, d):
    found = nearest(fr.searched(spark, d), fr.questions(spark, d), [Way(0, "own", 2), Way(1, "all", 20)])
    return found.where("_way = 0 or coalesce(readable, true)").select("question_id", "id").distinct()


@query("set2_with_fallback", f"WITH {RANKED}, {FOREIGN} SELECT question_id, id FROM r WHERE rank <= 2 UNION SELECT question_id, id FROM fb WHERE m <= 2")
def _(spark, d):
    ways = [Way(0, "all", 2), Way(1, "foreign", 2, ("source",))]
    return nearest(fr.searched(spark, d), fr.questions(spark, d), ways).select("question_id", "id").distinct()




@query("set3_term_overlap", f"SELECT a.doc_id, len(list_intersect({TERMS.format('a.text')}, {TERMS.format('b.text')})) AS overlap FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def _(spark, d):
    """Each text with the next one."""
    terms = docs(spark, d).select("doc_id", R.evidence_terms(F.col("text")).alias("terms"))
    both = terms.join(terms.select((F.col("doc_id") - 1).alias("doc_id"), F.col("terms").alias("others")), "doc_id")
    return both.select("doc_id", F.size(F.array_intersect("terms", "others")).cast("long").alias("overlap"))


@query("ref6_evidence_terms", f"SELECT doc_id, array_to_string(list_sort({TERMS.format('text')}), ' ') AS terms FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.sort_array(R.evidence_terms(F.col("text"))), " ").alias("terms"))


@query("set4_without_stop_words", f"SELECT doc_id, len({TERMS.format('text')}) AS terms FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(R.evidence_terms(F.col("text"))).cast("long").alias("terms"))


@query(
    "set6_token_coverage",
    f"""WITH f AS (SELECT item_id, string_split({normal_form('text')}, ' ') AS p FROM benchmark), t AS (SELECT doc_id, string_split({normal_form('text')}, ' ') AS w FROM documents)
    SELECT doc_id, round(len(list_filter(p, lambda x: list_contains(w, x))) / len(p), 6) AS coverage FROM t JOIN f ON item_id = doc_id""",
)
def _(spark, d):
    """Each fact of the benchmark against the text of the same number, both normalised."""
    facts = fr.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("fact"))
    rows = docs(spark, d).select("doc_id", "text").join(facts, "doc_id")  # first, as texts without a fact need no form
    rows = rows.select("doc_id", U.normalized_udf("text").alias("t"), U.normalized_udf("fact").alias("phrase"))
    return rows.select("doc_id", F.round(evaluation.token_coverage(F.col("t"), F.col("phrase")), 6).alias("coverage"))


NAMED_REFS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '12/2020' WHEN 2 THEN '12/2020,' || (doc_id % 300 + 1) || '/2021' ELSE (doc_id % 300 + 1) || '/2021,12/2020' END"


def references_of(spark, d):
    """Documents that name none, one or two references, written in ways that differ."""
    n = F.col("doc_id") % 4
    other = F.concat(F.lit("décret n° "), F.lpad((F.col("doc_id") % 300 + 1).cast("string"), 3, "0"), F.lit(" de 2021"))
    tail = F.when(n == 0, " rien").when(n == 1, " texte 12/2020 et 12_2020").when(n == 2, F.concat(F.lit(" الوثيقة عدد 12 لسنة 2020; "), other)).otherwise(F.concat(F.lit(" "), other, F.lit(" puis 12-2020")))
    return docs(spark, d).select("doc_id", F.concat(F.regexp_replace("text", "[0-9]", ""), tail).alias("text"))


@query("set5_foreign_references", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS foreign_refs FROM documents")
def _(spark, d):
    target = F.array(F.struct(F.lit("12").alias("number"), F.lit("2020").alias("year")))
    rows = references_of(spark, d).select("doc_id", U.references_udf(F.col("text")).alias("refs"))
    return rows.select("doc_id", F.size(F.array_except("refs", target)).alias("foreign_refs"))


# References, answers, URLs ---------------------------------------------------------------------------------


@cases(
    "ref1_number_prefix",
    "case string, text string",
    [("h1", "026_2021"), ("h2", "الوثيقة عدد ٢٦ لسنة ٢٠٢١"), ("h3", "Texte n° 7"), ("h4", "document numéro 12 de 2019"), ("h5", "للنص رقم 5"), ("h6", "12345-2021"), ("h7", "القرار 1234 سنة 1999"), ("h8", "rien"), ("h9", "7 - 2020 et texte 8")],
    ["026_2021", "026_2021", "007_", "012_2019", "005_", None, "1234_1999", None, "007_2020"],
    """SELECT 'd' || conv_id || '/' || turn AS "case", CASE turn % 3 WHEN 0 THEN lpad(CAST(turn % 90 + 1 AS VARCHAR), 3, '0') || '_2024' WHEN 1 THEN lpad(CAST(turn % 90 + 1 AS VARCHAR), 3, '0') || '_' END AS value FROM conversations""",
)
def _(spark, d, rows):
    m, n = fr.messages(spark, d), (F.col("turn") % 90 + 1).cast("string")
    tail = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" document n° "), n, F.lit(" de 2024"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" الوثيقة رقم "), n)).otherwise(F.lit(""))
    text = F.concat(F.regexp_replace("text", "[0-9]", ""), tail)
    texts = m.select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), text.alias("text")).unionByName(rows)
    return texts.select("case", R.document_number_prefix(F.col("text")).alias("value"))


@query("ref2_references_in_order", f"SELECT doc_id, {NAMED_REFS} AS refs FROM documents WHERE doc_id % 4 > 0")
def _(spark, d):
    rows = references_of(spark, d).select("doc_id", U.references_udf(F.col("text")).alias("refs")).where(F.size("refs") > 0)
    return rows.select("doc_id", F.array_join(F.transform("refs", lambda x: F.concat(x["number"], F.lit("/"), x["year"])), ",").alias("refs"))


@query(
    "ref3_reference_conflict",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 4 OR doc_id % 7 = 6 THEN false WHEN doc_id % 4 < 2 THEN false WHEN doc_id % 4 = 2 THEN doc_id % 5 = 0 ELSE true END AS conflict FROM documents",
)
def _(spark, d):
    """Questions on 12/2020 (each fifth on two documents), answers that name it first, later or alone, contexts that
    know the other reference or (each fifth) do not, and (each seventh) answers that nothing is available."""
    n = F.col("doc_id")
    answer = F.when(n % 7 == 6, F.concat("text", F.lit(" aucune information"))).otherwise(F.col("text"))
    question = F.when(n % 5 == 4, "texte 12/2020 ou 13/2020 ?").otherwise("Que dit le texte 12/2020 ?")
    context = F.when(n % 5 == 0, "texte 12/2020").otherwise(F.concat(F.lit("texte 12/2020, "), "text"))
    rows = references_of(spark, d).withColumns({"q": U.references_udf(question), "a": U.references_udf(answer), "c": U.references_udf(context), "none": R.is_unavailable(answer)})
    return rows.select("doc_id", R.reference_conflict(F.col("q"), F.col("a"), F.col("c"), F.col("none")).alias("conflict"))


@query(
    "ref4_record_number",
    rf"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '0' || (page_id % 90 + 10) || '_2020' WHEN 1 THEN '015_2021' WHEN 2 THEN '014_2024' WHEN 3 THEN '007_2019'
      ELSE CASE WHEN {PATH} = '/' THEN 'document' ELSE coalesce(nullif(regexp_replace(string_split({PATH}, '/')[-1], '\.[^.]*$', ''), ''), 'document') END END AS document_number FROM pages""",
)
def _(spark, d):
    n = F.col("page_id")
    cell = F.when(n % 5 == 0, F.concat(F.lit("منشور عدد "), (n % 90 + 10).cast("string"), F.lit(" لسنة 2020"))).when(n % 5 == 1, "N° 2021/15").when(n % 5 == 2, "12_2023 et 14-2024").otherwise("")
    url = F.when(n % 5 == 3, "https://a.org/docs/2020-01-02_2019-7_avis.pdf").otherwise(F.col("url"))
    return fr.table(spark, d, "pages").select("page_id", R.record_number(F.array(F.lit(""), cell), url).alias("document_number"))


@query("ref5_record_date", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\b'), ''), nullif(regexp_extract(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'), ''), '') AS date FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", R.record_date(F.array("text"), F.lit("")).alias("date"))


CITED = "text || chr(10) || 'Source: src' || turn || '.pdf, page ' || turn"


@query("ref8_parse_citation", "SELECT conv_id, turn, 'src' || turn || '.pdf' AS cited_source, CAST(turn AS INTEGER) AS cited_page FROM conversations")
def _(spark, d):
    text = F.concat("text", F.lit("\nSource: src"), "turn", F.lit(".pdf, page "), "turn")
    return fr.messages(spark, d).select("conv_id", "turn", R.cited_source(text).alias("cited_source"), R.cited_page(text).alias("cited_page"))


@query(
    "ref7_strip_source",
    r"""WITH a AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN chr(10) || '(Source : a.txt, page 3)' WHEN 1 THEN chr(10) || 'Voir le fichier avis-12.pdf, page 4.' WHEN 2 THEN chr(10) || 'المصدر: a، الصفحة 5' ELSE '  ' END AS text FROM conversations)
    SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\s*[^.!؟\n]*[\w.-]+\.pdf[^.!؟\n]*(?:[.!؟]\s*)$', ''), '\s+$', ''), '(?i)\s*\(?\s*(?:Source\s*:|المصدر\s*:).*?(?:page|الصفحة)\s*\d+\s*\)?[.۔]?\s*$', '') AS answer FROM a""",
)
def _(spark, d):
    tails = ("\n(Source : a.txt, page 3)", "\nVoir le fichier avis-12.pdf, page 4.", "\nالمصدر: a، الصفحة 5", "  ")
    tail = F.get(F.array(*map(F.lit, tails)), (F.col("turn") % 4).cast("int"))
    return fr.messages(spark, d).select("conv_id", "turn", R.strip_trailing_source(F.concat("text", tail)).alias("answer"))


@query("ref9_cited_sources", "SELECT conv_id, turn, 'src' || turn || '.pdf' AS source FROM conversations")
def _(spark, d):
    text = F.concat("text", F.lit("\nSource: /a/src"), "turn", F.lit(".pdf, page "), "turn", F.lit("."))
    return fr.messages(spark, d).select("conv_id", "turn", T.base_name(R.cited_source(text)).alias("source"))


@query("ref10_answer_body", r"SELECT conv_id, turn, regexp_split_to_array(text || CASE turn % 3 WHEN 0 THEN chr(10) || ' source : x' WHEN 1 THEN chr(10) || 'المصدر: x' ELSE ' the source: x' END, '(?im)^\s*(?:source|المصدر)\s*:')[1] AS body FROM conversations")
def _(spark, d):
    tail = F.when(F.col("turn") % 3 == 0, "\n source : x").when(F.col("turn") % 3 == 1, "\nالمصدر: x").otherwise(" the source: x")
    return fr.messages(spark, d).select("conv_id", "turn", R.answer_body(F.concat("text", tail)).alias("body"))


@query(
    "ref11_add_source",
    rf"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN CASE WHEN turn % 2 = 0 THEN 'المعلومة غير متوفرة في الوثائق المقدمة.' ELSE 'L''information n''est pas disponible dans les documents fournis.' END
      ELSE regexp_replace(text, '\s+$', '') || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'المصدر: a.pdf، الصفحة ' || turn ELSE chr(10) || chr(10) || 'Source : a.pdf, page ' || turn END END AS answer
    FROM conversations WHERE role = 'assistant'""",
)
def _(spark, d):
    n = F.col("turn")
    text = F.when(n % 3 == 2, F.concat("text", F.lit(" Aucune information."))).when(n % 3 == 1, F.concat("text", F.lit("\n(Source: b, page 9)"))).otherwise(F.col("text"))
    rows = fr.messages(spark, d).where("role = 'assistant'")
    return rows.select("conv_id", "turn", R.with_source(text, F.when(n % 2 == 0, "ما؟").otherwise("quoi ?"), F.lit("a.pdf"), n).alias("answer"))


@query("ref12_chat_reference", "SELECT conv_id, turn, regexp_matches(text, '(?i)\\b[0-9]{1,4}[_/-][0-9]{4}\\b|(texte|document|note|circulaire)\\s*(n[°o]?|num[eé]ro)?\\s*[0-9]{1,4}') AS has_reference FROM conversations")
def _(spark, d):
    return fr.messages(spark, d).select("conv_id", "turn", R.has_chat_reference(F.col("text")).alias("has_reference"))


@cases(
    "jsn1_answer_text",
    "case string, text string",
    [("h1", 'Voici : {"answer": "dix jours"} fin'), ("h2", '{"answer": "coupé au mil'), ("h3", 'pas de JSON'), ("h4", '{"answer": "{\\"answer\\": \\"deux fois\\"}"}'), ("h5", '```json\n{"answer": ""}\n```'), ("h6", '{"other": 1}')],
    ["dix jours", "coupé au mil", "pas de JSON", "deux fois", '{"answer": ""}', '{"other": 1}'],
    r"""SELECT 'd' || conv_id || '/' || turn AS "case", regexp_replace(text, '^\s+|\s+$', '', 'g') AS value FROM conversations WHERE regexp_matches(text, '\S')""",
)
def _(spark, d, rows):
    m = fr.messages(spark, d).where(F.col("text").rlike(r"\S"))
    wrapped = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("answer"))), F.lit("\n```"))
    texts = m.select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), wrapped.alias("text")).unionByName(rows)
    return texts.select("case", R.answer_text(F.col("text")).alias("value"))


@query(
    "ans1_clean_answer",
    r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || '  Fin ' END, '\r\n|[\n\r\x0B\x0C]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS answer
    FROM conversations""",
)
def _(spark, d):
    odd = F.concat(F.lit("brouillon\nRéponse finale : "), "text", F.lit("\nJe dois vérifier.\nHmm, attends\n```\n  Fin "))
    even = F.concat(F.lit("<think>x\ny</think>"), "text", F.lit("<think>sans fin"))
    return fr.messages(spark, d).select("conv_id", "turn", R.clean_answer(F.when(F.col("turn") % 2 == 0, even).otherwise(odd)).alias("answer"))


UNAVAILABLE = " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in P.UNAVAILABLE_ANSWER)


@query("ans2_is_unavailable", f"SELECT doc_id, {UNAVAILABLE} AS unavailable FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", R.is_unavailable(F.col("text")).alias("unavailable"))


@query(
    "ans3_long_copy",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a FROM documents),
    c AS (SELECT doc_id, a, trim(CASE doc_id % 4 WHEN 0 THEN a WHEN 1 THEN substring(a, 31, 500) WHEN 2 THEN 'x ' || substring(a, 1, 230) ELSE reverse(a) END) AS c FROM t)
    SELECT doc_id, length(a) >= 240 AND length(c) > 0 AND len(list_filter(list_append(range(0, greatest(length(c) - 240, 0) + 1, 120), greatest(length(c) - 240, 0)), lambda s: contains(a, substring(c, CAST(s + 1 AS BIGINT), 240)))) > 0 AS copied FROM c""",
)
def _(spark, d):
    """Each text against itself, a stretch of it, a stretch that is too short, and its letters backwards."""
    n, a = F.col("doc_id") % 4, T.collapse(F.col("text"))
    chunk = F.when(n == 0, a).when(n == 1, F.substring(a, 31, 500)).when(n == 2, F.concat(F.lit("x "), F.substring(a, 1, 230))).otherwise(F.reverse(a))
    return docs(spark, d).select("doc_id", R.long_copy(F.col("text"), chunk).alias("copied"))


@query(
    "ans4_needs_repair",
    f"""WITH a AS (SELECT conv_id, turn, turn % 6 AS k, CASE turn % 6 WHEN 0 THEN left(text, 100) WHEN 1 THEN text WHEN 2 THEN 'Excerpt: ' || left(text, 60) WHEN 3 THEN left(text, 60) || chr(10) || 'Okay, next' WHEN 4 THEN '' ELSE 'نعم' END AS t FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, k IN (2, 3, 4, 5) OR NOT ({duck_la('t')} >= 5 AND {duck_la('t')} > {duck_ar('t')}) OR len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) > 120 OR conv_id % 9 = 0 AS repair FROM a""",
)
def _(spark, d):
    n, text = F.col("turn") % 6, F.col("text")
    answer = (
        F.when(n == 0, F.left(text, F.lit(100))).when(n == 1, text).when(n == 2, F.concat(F.lit("Excerpt: "), F.left(text, F.lit(60))))
        .when(n == 3, F.concat(F.left(text, F.lit(60)), F.lit("\nOkay, next"))).when(n == 4, "").otherwise("نعم")
    )
    rows = fr.messages(spark, d).where("role = 'assistant'").select("conv_id", "turn", answer.alias("t"))
    matches = L.chain_answer_language_matches(F.lit("question"), F.col("t"))
    return rows.select("conv_id", "turn", R.needs_repair(F.col("t"), matches, F.col("conv_id") % 9 == 0).alias("repair"))


@query("ans5_format_context", context_sql(2))
def _(spark, d):
    found = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 2).withColumnRenamed("rank", "place")
    return retrieval.format_context(fr.with_content(found, spark, d))


@query(
    "ans6_unavailable_answer",
    f"SELECT conv_id, turn, CASE WHEN regexp_matches(question, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'المعلومة غير متوفرة في الوثائق المقدمة.' ELSE 'L''information n''est pas disponible dans les documents fournis.' END AS answer FROM {BOTH}",
)
def _(spark, d):
    return both_languages(spark, d).select("conv_id", "turn", R.unavailable_answer(F.col("question")).alias("answer"))


@cases(
    "cnv1_follow_ups",
    "case string, text string",
    [("h1", "Pourquoi ?"), ("h2", "Et pourquoi le délai de dépôt est-il si court ?"), ("h3", "Peux-tu donner plus de détails ?"), ("h4", "لماذا؟"), ("h5", "اِشرح أكثر"), ("h6", "Quel est le délai ?"), ("h7", "Comment ça marche au juste, dis-moi tout cela ?")],
    [True, False, True, True, True, False, False],
    f"""SELECT 'd' || conv_id || '/' || turn AS "case", again AS value FROM {ASKED} WHERE role = 'user'""",
)
def _(spark, d, rows):
    m = asked_again(spark, d).where("role = 'user'").select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), "text")
    return m.unionByName(rows).select("case", R.is_follow_up(U.follow_up_udf(F.col("text"))).alias("value"))


@query(
    "cnv2_rewritten_questions",
    rf"""WITH h AS (SELECT *, {LAST.replace('assistant', 'user').replace(' THEN', ' AND NOT again THEN')} AS u, {LAST} AS a FROM {ASKED}),
    c AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q, rtrim(left(trim(regexp_replace(u, '\s+', ' ', 'g')), 300)) AS asked, rtrim(left(trim(regexp_replace(a, '\s+', ' ', 'g')), 500)) AS said, (conv_id + turn) % 3 = 1 AS ar FROM h WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN again AND u IS NOT NULL THEN q || chr(10) || CASE WHEN ar THEN 'المقصود بالسؤال السابق: ' ELSE 'Question précédente concernée : ' END || asked
      || CASE WHEN coalesce(said, '') <> '' THEN chr(10) || CASE WHEN ar THEN 'السياق السابق: ' ELSE 'Contexte précédent : ' END || said ELSE '' END ELSE q END AS rewritten FROM c""",
)
def _(spark, d):
    return conversations.rewritten_questions(asked_again(spark, d), "conv_id", "turn").select("conv_id", "turn", "rewritten")


@query(
    "url1_canonical",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 OR (page_id % 3 = 1 AND {HOST} = 'blog.tionsh.example.net') THEN 'https://www.example.org' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '')
      WHEN page_id % 3 = 1 THEN regexp_replace(url, '#.*$', '') ELSE regexp_replace('ftp:' || url, '#.*$', '') END AS canonical FROM pages""",
)
def _(spark, d):
    return moved(spark, d).select("page_id", U.canonical_url_column(F.concat("url", F.lit("#part")), F.lit(""), OFFICIAL).alias("canonical"))


@query("url2_topic_slug", rf"SELECT page_id, coalesce(regexp_replace(list_filter(string_split(lower({PATH}), '/'), lambda x: x NOT IN ('', 'ar', 'fr'))[-1], '-[0-9]+$', ''), '') AS slug FROM pages")
def _(spark, d):
    parts = F.filter(F.split(F.lower(L.url_path(F.col("url"))), "/"), lambda x: ~x.isin("", "ar", "fr"))
    return fr.table(spark, d, "pages").select("page_id", F.coalesce(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"-\d+$", ""), F.lit("")).alias("slug"))


OFFICIAL_PAGES = """op AS (SELECT page_id, 'https://www.example.org/fr/topic-' || (page_id % 3) || '/p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html' AS url, count(*) OVER () AS n FROM pages)"""


def official_pages(spark, d):
    """The driver's pages on an official host, each with two links to pages of its topic, one to another, a table with a
    document, and links to documents with and without a label."""
    p = fr.table(spark, d, "pages").select("page_id", "html")
    num = lambda c: F.lpad(c.cast("string"), 9, "0")
    n = F.col("page_id")
    page = lambda c: F.concat(F.lit("/fr/topic-0/p"), num(c), F.lit(".html"))
    links = F.concat(F.lit("<p><a href='"), page(2 * n + 1), F.lit("#x'>a</a> <a href='http://example.org"), page(2 * n + 2), F.lit("'>b</a> <a href='/fr/other.html'>c</a></p>"))
    table = F.concat(
        F.lit("<table><tr><th>Numéro du texte</th><th>Date</th><th>Objet</th><th></th></tr><tr><td>"), (n % 900 + 1).cast("string"), F.lit("_2024</td><td>01/02/2024</td><td>"),
        F.when(n % 2 == 0, "تنقيح القانون عدد 5").otherwise("Avis au public"), F.lit("</td><td><a href='/docs/"), n.cast("string"), F.lit("-ar.pdf'>pdf</a></td></tr></table>"),
    )
    loose = F.concat(F.lit("<ul><li>Note du 2023-05-06 <a href='/docs/n"), n.cast("string"), F.lit(".pdf?v=1'>Télécharger</a></li></ul><a href='/docs/"), n.cast("string"), F.lit("-ar.pdf'>again</a></div></span>"))
    return p.select("page_id", F.concat(F.lit("https://www.example.org"), page(n)).alias("url"), F.concat("html", links, table, loose).alias("html"))


SITE = ("example.org", "www.example.org")


@query(
    "url3_page_links",
    """SELECT 'https://www.example.org/fr/topic-0/p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html' AS page_url, 'https://www.example.org/fr/topic-0/p' || lpad(CAST(2 * page_id + k AS VARCHAR), 9, '0') || '.html' AS link
    FROM pages, (VALUES (1), (2)) v(k)""",
)
def _(spark, d):
    return pages_html.relevant_links(official_pages(spark, d), "topic-0", SITE)


@query("top8_crawl_frontier", "SELECT 'https://www.example.org/fr/topic-0/p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html' AS url, page_id AS place FROM pages ORDER BY page_id LIMIT 20")
def _(spark, d):
    """Page n links to 2n + 1 and 2n + 2, so a crawl that serves first what came first visits the pages in order."""
    p = official_pages(spark, d)
    return catalog.crawl(p, pages_html.relevant_links(p, "topic-0", SITE), "https://www.example.org/fr/topic-0/p000000000.html")


@query(
    "htm3_page_records",
    """WITH p AS (SELECT page_id AS n, 'https://www.example.org/fr/topic-0/p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html' AS source_page FROM pages)
    SELECT CAST(n % 900 + 1 AS VARCHAR) || '_2024' AS document_number, '01/02/2024' AS date, CASE WHEN n % 2 = 0 THEN 'تنقيح القانون عدد 5' ELSE 'Avis au public' END AS title, 'ar' AS language, 'https://www.example.org/docs/' || n || '-ar.pdf' AS pdf_url, source_page FROM p
    UNION ALL SELECT 'n' || n, '2023-05-06', 'Note du 2023-05-06 Télécharger', 'fr', 'https://www.example.org/docs/n' || n || '.pdf?v=1', source_page FROM p""",
)
def _(spark, d):
    return pages_html.records(official_pages(spark, d), SITE)


@query(
    "prj5_metadata_rows",
    """SELECT 'n' || page_id AS document_number, '' AS date, '' AS title, 'fr' AS language, url AS pdf_url, '' AS source_page, CASE WHEN page_id % 2 = 0 THEN 'raw/fr/' || page_id || '.pdf' ELSE '/other/' || page_id || '.pdf' END AS local_path,
    sha256(html) AS content_sha256, '2024-01-01T00:00:00+00:00' AS scraped_at FROM pages""",
)
def _(spark, d):
    n = F.col("page_id").cast("string")
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/data/raw/fr/").otherwise("/other/"), n, F.lit(".pdf"))
    rows = fr.table(spark, d, "pages").select(
        F.concat(F.lit("n"), n).alias("document_number"), F.lit(None).alias("date"), F.lit(None).alias("title"), F.lit("fr").alias("language"), F.col("url").alias("pdf_url"), F.lit(None).alias("source_page"),
        path.alias("local_path"), F.sha2("html", 256).alias("content_sha256"), F.lit("2024-01-01T00:00:00+00:00").alias("scraped_at"),
    )
    return catalog.metadata_rows(rows, "/data")


@query("hsh1_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def _(spark, d):
    return fr.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query(
    "hsh2_unique_names",
    """WITH r AS (SELECT doc_id, source || '.pdf' AS name, left(sha256(text), 8) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    s AS (SELECT *, row_number() OVER (PARTITION BY name, h ORDER BY doc_id) AS m, min(n) OVER (PARTITION BY name, h) AS f FROM r)
    SELECT doc_id, CASE WHEN n = 1 THEN name WHEN m - CAST(f = 1 AS INT) <= 1 THEN replace(name, '.pdf', '_' || h || '.pdf') ELSE replace(name, '.pdf', '_' || h || '_' || (m - CAST(f = 1 AS INT)) || '.pdf') END AS destination FROM s""",
)
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"), F.sha2("text", 256).alias("digest"))
    return catalog.unique_names(rows, "name", "digest", "doc_id").select("doc_id", "destination")


# Search and evaluation --------------------------------------------------------------------------------------


@query(
    "ret1_search",
    f"""WITH {VECTORS}, rt AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM pairs WHERE prefix IS NOT NULL AND starts_with(lower(source), lower(prefix)) AND readable QUALIFY rank <= 8),
    op AS (SELECT * FROM pairs WHERE question_id NOT IN (SELECT question_id FROM rt)),
    own AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank, 1 AS way FROM op WHERE language = question_language AND readable QUALIFY rank <= 2),
    wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank, 2 AS way FROM op QUALIFY rank <= 20) WHERE coalesce(readable, true)),
    once AS (SELECT *, row_number() OVER (PARTITION BY question_id, source, page, chunk ORDER BY way, rank) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM wide)),
    cand AS (SELECT question_id, id, source, page, chunk, language, distance, expand, false AS routed,
        row_number() OVER (PARTITION BY question_id ORDER BY round(distance - CASE WHEN language = question_language THEN 0.005 ELSE 0 END, 6), distance, id) AS rank FROM once WHERE n = 1
      UNION ALL SELECT question_id, id, source, page, chunk, language, distance, false, true, rank FROM rt),
    f AS (SELECT question_id, max(CASE WHEN rank = 1 THEN source END) AS s1, max(CASE WHEN rank = 2 THEN source END) AS s2, max(CASE WHEN rank = 1 THEN page END) AS p1, max(CASE WHEN rank = 2 THEN page END) AS p2,
      max(CASE WHEN rank = 1 THEN distance END) AS d1, max(CASE WHEN rank = 2 THEN distance END) AS d2, bool_or(expand) AS any_expand FROM cand WHERE rank <= 2 GROUP BY question_id),
    c AS (SELECT cand.*, s1, p1, p2, CASE WHEN s2 IS NULL THEN 'plain' WHEN s1 = s2 THEN CASE WHEN abs(p1 - p2) <= 1 OR any_expand THEN 'expand' ELSE 'plain' END WHEN round(d2 - d1, 6) >= 0.02 THEN 'first' ELSE 'plain' END AS mode FROM cand JOIN f USING (question_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM c WHERE CASE mode WHEN 'expand' THEN source = s1 AND (abs(page - p1) <= 1 OR abs(page - p2) <= 1) WHEN 'first' THEN rank = 1 ELSE rank <= 2 END),
    chosen AS (SELECT * FROM k WHERE mode <> 'expand' OR place <= 4),
    weak AS (SELECT qs.question_id FROM qs LEFT JOIN own USING (question_id) WHERE qs.question_id NOT IN (SELECT question_id FROM rt) GROUP BY 1 HAVING coalesce(min(distance), 1.0) > 0.18),
    fo AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY distance, id) AS n FROM wide WHERE language IS DISTINCT FROM question_language),
    ex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS m FROM fo WHERE n = 1),
    both_ AS (SELECT question_id, id, source, page, chunk, language, distance, 0 AS part, place AS pos FROM chosen WHERE NOT routed AND (question_id NOT IN (SELECT question_id FROM weak) OR place <= 2)
      UNION ALL SELECT question_id, id, source, page, chunk, language, distance, 1, m FROM ex WHERE m <= 2 AND question_id IN (SELECT question_id FROM weak)),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source, page, chunk ORDER BY part, pos) AS n FROM both_) WHERE n = 1),
    last AS (SELECT question_id, id, source, page, chunk, language, distance, row_number() OVER (PARTITION BY question_id ORDER BY part, pos) AS place FROM merged QUALIFY place <= 4)
    SELECT * FROM last UNION ALL SELECT question_id, id, source, page, chunk, language, distance, place FROM chosen WHERE routed""",
)
def _(spark, d):
    found = retrieval.search(fr.searched(spark, d), fr.questions(spark, d))
    return found.withColumn("place", F.col("place").cast("long"))


@query(
    "ret2_select_context",
    f"""WITH {VECTORS}, {BONUS}, f AS (SELECT question_id, max(CASE WHEN rank = 1 THEN source END) AS s1, max(CASE WHEN rank = 2 THEN source END) AS s2, max(CASE WHEN rank = 1 THEN page END) AS p1,
      max(CASE WHEN rank = 2 THEN page END) AS p2, max(CASE WHEN rank = 1 THEN distance END) AS d1, max(CASE WHEN rank = 2 THEN distance END) AS d2 FROM lk GROUP BY question_id),
    c AS (SELECT lk.*, CASE WHEN s1 = s2 THEN CASE WHEN abs(p1 - p2) <= 1 OR expand THEN 'expand' ELSE 'plain' END WHEN round(d2 - d1, 6) >= 0.02 THEN 'first' ELSE 'plain' END AS mode, s1, p1, p2 FROM lk JOIN f USING (question_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM c WHERE CASE mode WHEN 'expand' THEN source = s1 AND (abs(page - p1) <= 1 OR abs(page - p2) <= 1) WHEN 'first' THEN rank = 1 ELSE rank <= 2 END)
    SELECT question_id, id, mode, place FROM k WHERE mode <> 'expand' OR place <= 4""",
)
def _(spark, d):
    return retrieval.nearest_context(fr.searched(spark, d), fr.questions(spark, d)).select("question_id", "id", "mode", F.col("place").cast("long").alias("place"))


@query("ret3_mixed_language", "SELECT conv_id, turn, regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AND regexp_matches(text, '[A-Za-z]{2,}') AS mixed FROM conversations WHERE role = 'user'")
def _(spark, d):
    mixed = (L.question_language(F.col("text")) == "ar") & F.col("text").rlike("[A-Za-z]{2,}")
    return fr.messages(spark, d).where("role = 'user'").select("conv_id", "turn", mixed.alias("mixed"))


@query(
    "ret4_weak_match",
    f"WITH {VECTORS} SELECT qs.question_id, coalesce(min(CASE WHEN language = p.question_language AND readable THEN distance END), 1.0) > 0.18 AS weak FROM qs LEFT JOIN pairs p USING (question_id) GROUP BY 1",
)
def _(spark, d):
    q = fr.questions(spark, d)
    best = retrieval.knn(fr.searched(spark, d), q, 1, "own").select("question_id", "distance")
    return q.select("question_id").join(best, "question_id", "left").select("question_id", (F.coalesce("distance", F.lit(1.0)) > DEFAULT.weak_match).alias("weak"))


def _expected(spark, d):
    known = F.when(F.col("question_id") % 150 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("src1"), F.lit("src2")))
    return fr.questions(spark, d).select("question_id", known.alias("documents"), F.array(F.lit(1), F.lit(3)).alias("pages"))


METRICS = f"""{RANKED}, h AS (SELECT question_id, rank, page, question_id % 150 <> 0 AS known, contains(source, 'src1') AS a, contains(source, 'src2') AS b FROM r WHERE rank <= 10),
m AS (SELECT question_id, any_value(known) AS known, min(CASE WHEN a OR b THEN rank END) AS dr, min(CASE WHEN (a OR b) AND page IN (1, 3) THEN rank END) AS pr,
  max(CASE WHEN a AND rank <= 3 THEN 1 ELSE 0 END) + max(CASE WHEN b AND rank <= 3 THEN 1 ELSE 0 END) AS nd, count(DISTINCT CASE WHEN (a OR b) AND page IN (1, 3) AND rank <= 3 THEN page END) AS np FROM h GROUP BY question_id),
em AS (SELECT question_id, known, CASE WHEN known THEN dr END AS document_rank, CASE WHEN known THEN pr END AS page_rank, CASE WHEN known THEN coalesce(dr = 1, false) END AS document_hit_at_1, CASE WHEN known THEN coalesce(dr <= 3, false) END AS document_hit_at_3,
  CASE WHEN known THEN coalesce(round(1.0 / dr, 3), 0) END AS document_mrr, CASE WHEN known THEN coalesce(round(1.0 / pr, 3), 0) END AS page_mrr,
  CASE WHEN known THEN round(nd / 2, 3) END AS document_recall_at_k, CASE WHEN known THEN round(np / 2, 3) END AS page_recall_at_k, CASE WHEN known THEN dr IS NOT NULL END AS retrieval_document_correct, CASE WHEN known THEN pr IS NOT NULL END AS retrieval_page_correct FROM m)"""


def _metrics(spark, d):
    ranked = retrieval.knn(fr.searched(spark, d), fr.questions(spark, d), 10).select("question_id", "rank", "source", "page")
    return evaluation.retrieval_metrics(_expected(spark, d), ranked)


@query(
    "evl4_retrieval_metrics",
    f"WITH {METRICS} SELECT question_id, document_rank, page_rank, document_hit_at_1, document_hit_at_3, CAST(document_mrr AS DOUBLE) AS document_mrr, CAST(page_mrr AS DOUBLE) AS page_mrr, document_recall_at_k, page_recall_at_k FROM em",
)
def _(spark, d):
    m = _metrics(spark, d)
    ranks = [F.col(c).cast("long").alias(c) for c in ("document_rank", "page_rank")]
    return m.select("question_id", *ranks, "document_hit_at_1", "document_hit_at_3", "document_mrr", "page_mrr", "document_recall_at_k", "page_recall_at_k")


@query(
    "agg12_summary",
    f"""WITH {METRICS}, a AS (SELECT *, question_id // 50 % 6 AS k FROM em) SELECT count(*) AS total_questions, count_if(known) AS answerable_questions, count_if(NOT known) AS absent_questions, round(avg(document_mrr), 3) AS mean_document_mrr,
    round(avg(document_recall_at_k), 3) AS mean_document_recall_at_3, 
    count_if(retrieval_document_correct) + count_if(retrieval_page_correct) + count_if(known AND k IN (1, 2)) + count_if(NOT known AND k IN (0, 5)) + count_if(known AND k = 3) + count_if(k < 5) AS passed_checks,
    count(retrieval_document_correct) + count(retrieval_page_correct) + 2 * count_if(known) + count_if(NOT known) + count(*) AS applicable_checks FROM a""",
)
def _(spark, d):
    """Answers of six kinds by the question's number, judged as those to any question: facts, citation, language, absence."""
    known = F.col("document_hit_at_1").isNotNull()
    answer = F.get(F.array(*map(F.lit, ABSENT_ANSWERS)), F.floor(F.col("question_id") / 50 % 6).cast("int"))
    rows = evaluation.decided(_metrics(spark, d).withColumn("answer_available", known).withColumn("answer", answer))
    told = evaluation.fact_matches(rows.select("question_id", "answer", F.array(F.lit("dix jours")).alias("facts")), "answer", "facts", ["question_id"])
    rows = rows.join(told.select("question_id", "matched"), "question_id")
    absent, _ = evaluation.absent_answer(evaluation.unavailable_signal(F.col("answer")), F.col("decision"), F.col("contradiction"), R.cited_source(F.col("answer")))
    cited, french = R.cited_source(F.col("answer")).isNotNull(), L.question_language(F.col("answer")) == "fr"
    rows = rows.withColumns({"answer_facts_correct": F.col("matched") > 0, "absent_answer_correct": absent, "citation_honest": cited, "answer_language_correct": french})
    names = ["total_questions", "answerable_questions", "absent_questions", "mean_document_mrr", "mean_document_recall_at_3", "passed_checks", "applicable_checks"]
    return evaluation.summary(rows).select(*names)


@cases(
    "evl1_phrase_present",
    "case string, text string, phrase string",
    [("h1", "Le délai est de dix jours.", "délai"), ("h2", "Les délais courent.", "délai"), ("h3", "Le DELAI de dépôt (10) court", "délai de dépôt court"), ("h4", "يجب إيداع الملف خلال عشرة أيام", "إيداع الملفات خلال عشرة أيام"), ("h5", "إيداع الملف غدا", "إيداع الطلب خلال عشرة"), ("h6", "x", "")],
    [True, False, True, True, False, False],
    f"""SELECT 'd' || item_id AS "case", contains({normal_form('text')}, {normal_form('left(text, 30)')}) AS value FROM benchmark""",
)
def _(spark, d, rows):
    b = fr.table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("case"), "text", F.upper(F.left("text", F.lit(30))).alias("phrase"))
    both = b.unionByName(rows).select("case", U.normalized_udf("text").alias("t"), U.normalized_udf("phrase").alias("p"))
    return both.select("case", evaluation.present(F.col("t"), F.col("p")).alias("value"))


@query(
    "evl2_fact_matches",
    f"""WITH n AS (SELECT count(*) AS n FROM benchmark), f AS (SELECT a.item_id, {normal_form('a.text')} AS t, [{normal_form('left(a.text, 40)')}, {normal_form('left(b.text, 40)')}, 'quebec zulu'][1:CAST(a.item_id % 4 AS INTEGER)] AS fs
      FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT n FROM n)),
    c AS (SELECT item_id, len(fs) AS facts, len(list_filter(fs, lambda x: x <> '' AND contains(t, x))) AS matched FROM f)
    SELECT item_id, facts, matched, CASE WHEN facts = 0 THEN 0 ELSE round(matched / facts, 3) END AS ratio FROM c""",
)
def _(spark, d):
    """Up to three facts for each text: its own beginning in capitals, the next text's, and one that none has."""
    b = fr.table(spark, d, "benchmark").select("item_id", "text")
    n = b.count()
    other = b.select(((F.col("item_id") + n - 1) % n).alias("item_id"), F.left("text", F.lit(40)).alias("other"))
    facts = F.slice(F.array(F.upper(F.left("text", F.lit(40))), F.col("other"), F.lit("Québec, (1) ZULU")), F.lit(1), (F.col("item_id") % 4).cast("int"))
    return evaluation.fact_matches(b.join(other, "item_id").withColumn("facts", facts), "text", "facts", ["item_id"])


@query("evl3_facts_needed", "SELECT doc_id, greatest(1, (n_chars * 7 + 9) // 10) AS needed FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", evaluation.facts_needed(F.col("n_chars"), F.lit(None).cast("long")).alias("needed"))


@cases(
    "evl5_decision",
    "case string, text string",
    [("h1", "Oui, le dépôt est possible."), ("h2", "Non, ce n'est pas exigé."), ("h3", "Le texte existe."), ("h4", "Le texte n'existe pas."), ("h5", "Oui, mais l'information n'est pas disponible."), ("h6", "Le délai court."), ("h7", "نعم، يوجد أجل"), ("h8", "لا يوجد أجل"), ("h9", "غير متوفرة"), ("h10", "Le texte existe mais n'est pas exigée"), ("h11", "Rien.\nSource: oui.pdf")],
    ["yes/false", "no/false", "yes/false", "no/false", "unknown/true", "unknown/false", "yes/false", "no/false", "no/false", "unknown/true", "unknown/false"],
    """SELECT 'd' || conv_id || '/' || turn AS "case", CASE turn % 3 WHEN 0 THEN 'yes/false' WHEN 1 THEN 'no/false' ELSE 'unknown/true' END AS value FROM conversations""",
)
def _(spark, d, rows):
    """Driver messages after a leading yes, a leading no, and a yes that is taken back; their own words say neither."""
    lead = F.get(F.array(F.lit("Oui. "), F.lit("Non: "), F.lit("Oui, pas disponible. ")), (F.col("turn") % 3).cast("int"))
    m = fr.messages(spark, d).select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), F.concat(lead, F.length("text").cast("string")).alias("text"))
    told = evaluation.decided(m.unionByName(rows), "text")
    return told.select("case", F.concat("decision", F.lit("/"), F.col("contradiction").cast("string")).alias("value"))


CITING = """CASE WHEN question_id % 250 = 0 THEN 'Rien' ELSE 'x' || chr(10) || 'Source: ' || CASE WHEN question_id % 100 = 0 THEN 'SRC1' ELSE 'src' || (question_id // 50 % 3) || '_en.pdf' END || CASE WHEN question_id % 150 = 0 THEN '' ELSE ', page ' || (question_id // 50 % 7) END END"""


@query(
    "evl6_citation_metrics",
    f"""WITH {RANKED}, q AS (SELECT question_id, question_id % 250 <> 0 AS has, CASE WHEN question_id % 100 = 0 THEN 'SRC1' ELSE 'src' || (question_id // 50 % 3) || '_en.pdf' END AS c, CASE WHEN question_id % 150 <> 0 THEN question_id // 50 % 7 END AS p FROM qs),
    e AS (SELECT question_id, CASE WHEN has THEN CASE WHEN p IS NULL THEN c ELSE c END END AS cited, CASE WHEN has THEN p END AS cited_page FROM q),
    n AS (SELECT e.*, {normal_form('cited')} AS nc FROM e),
    h AS (SELECT n.question_id, count(r.id) AS hits, coalesce(bool_or(regexp_matches({normal_form('r.content')}, '(^|[^a-z0-9_])the([^a-z0-9_]|$)')), false) AS fact
      FROM n LEFT JOIN r ON r.question_id = n.question_id AND r.rank <= 5 AND (contains({normal_form('r.source')}, nc) OR contains(nc, {normal_form('r.source')})) AND (cited_page IS NULL OR cited_page = r.page) GROUP BY n.question_id),
    m AS (SELECT n.*, hits > 0 AS matched, fact, CASE WHEN n.question_id % 200 <> 0 THEN coalesce(cited_page IN (1, 3), false) END AS page_ok,
      CASE WHEN cited IS NULL THEN false WHEN n.question_id % 350 = 0 THEN true ELSE contains(nc, 'src1') OR contains(nc, 'src2 en pdf') END AS source_ok FROM n JOIN h USING (question_id))
    SELECT question_id, cited AS cited_source, cited_page, matched AS citation_matches_retrieved_source, page_ok AS citation_matches_expected_page, CASE WHEN question_id % 450 <> 0 THEN fact END AS citation_supports_expected_facts, matched AND source_ok AND coalesce(page_ok, true) AS citation_honest FROM m""",
)
def _(spark, d):
    q, n = fr.questions(spark, d), F.col("question_id")
    name = F.when(n % 100 == 0, "SRC1").otherwise(F.concat(F.lit("src"), F.floor(n / 50 % 3).cast("string"), F.lit("_en.pdf")))
    page = F.when(n % 150 == 0, "").otherwise(F.concat(F.lit(", page "), F.floor(n / 50 % 7).cast("string")))
    answer = F.when(n % 250 == 0, "Rien").otherwise(F.concat(F.lit("x\nSource: "), name, page))
    none = F.array().cast("array<string>")
    asked = q.select(
        "question_id", answer.alias("answer"), F.when(n % 350 == 0, none).otherwise(F.array(F.lit("SRC1"), F.lit("src2_en.pdf"))).alias("documents"),
        F.when(n % 200 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(3))).alias("pages"), F.when(n % 450 == 0, none).otherwise(F.array(F.lit("the"), F.lit("quebec zulu"))).alias("facts"),
    )
    return evaluation.citation_metrics(asked, fr.with_content(retrieval.knn(fr.searched(spark, d), q, 5), spark, d))


@query("evl7_absent_answers", f"SELECT doc_id, k IN (0, 5) AS correct, {ABSENT_RISK} AS risk FROM {ABSENT}")
def _(spark, d):
    return absent_answers(spark, d).select("doc_id", "correct", "risk")


@query(
    "evl8_phrase_constraints",
    f"""WITH x AS (SELECT doc_id, {normal_form('text')} AS t, {normal_form('left(text, 20)')} AS own FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN contains(t, own) WHEN 2 THEN NOT contains(t, 'quebec zulu') ELSE contains(t, own) AND contains(t, 'quebec zulu') END AS passed FROM x WHERE contains(own, ' ')""",
)
def _(spark, d):
    n = F.col("doc_id") % 4
    rows = docs(spark, d).select("doc_id", F.when(n > 0, F.col("text")).alias("t"), F.left("text", F.lit(20)).alias("own"))  # those of 0 have no phrases
    rows = evaluation.normalized_columns(rows, "t", "own").where(F.col("own").contains(" "))
    has, other = evaluation.present(F.col("t"), F.col("own")), evaluation.present(F.col("t"), F.lit("quebec zulu"))
    required = F.when(n == 1, F.array(has)).when(n == 3, F.array(has, other))
    return rows.select("doc_id", evaluation.phrase_constraints(required, F.when(n == 2, F.array(other))).alias("passed"))


@query("evl9_faithfulness", f"WITH {FACTS} SELECT item_id, count(doc_id) > 0 AS supported FROM f LEFT JOIN dt ON fact <> '' AND contains(t, fact) GROUP BY item_id")
def _(spark, d):
    facts = fr.table(spark, d, "benchmark").select("item_id", "text")
    hit = evaluation.fact_texts(facts, docs(spark, d), "item_id", "text", "doc_id", "text").select("item_id").distinct().withColumn("_h", F.lit(True))
    return facts.join(hit, "item_id", "left").select("item_id", F.col("_h").isNotNull().alias("supported"))


@query("evl12_expected_documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS documents FROM documents")
def _(spark, d):
    names = F.filter(F.array(F.when(F.col("doc_id") % 3 != 0, F.col("source"))), lambda x: x.isNotNull() & (x != ""))
    return docs(spark, d).select("doc_id", F.size(names).alias("documents"))


@query(
    "evl11_error_defaults",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(quality = 1 AND doc_id % 2 = 0, false) WHEN doc_id % 2 = 0 THEN quality = 1 END AS citation_honest,
    CASE WHEN doc_id % 3 = 0 THEN 'low' WHEN doc_id % 5 = 0 THEN 'high' END AS hallucination_risk FROM labels""",
)
def _(spark, d):
    """Each fifth question failed; half of the rest, and of those, were judged before."""
    n = F.col("doc_id")
    rows = fr.table(spark, d, "labels").select(
        "doc_id", F.when(n % 5 == 0, "timeout").alias("error"), F.when(n % 2 == 0, F.col("quality") == 1).alias("citation_honest"), F.when(n % 3 == 0, "low").alias("hallucination_risk")
    )
    return evaluation.with_error_defaults(rows).select("doc_id", "citation_honest", "hallucination_risk")


# Sessions --------------------------------------------------------------------------------------------------


USERS = "u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(trim(c_name)) || '@example.org' AS email, c_acctbal AS balance FROM customer)"


@query(
    "lkp1_session_lookup",
    f"""WITH {SESSIONS}, {USERS} SELECT 'session' AS lookup, CAST(conv_id AS VARCHAR) AS id FROM s WHERE conv_id = 3 UNION ALL SELECT 'own', CAST(conv_id AS VARCHAR) FROM s WHERE conv_id = 4 AND user_id = 4
    UNION ALL SELECT 'not own', CAST(conv_id AS VARCHAR) FROM s WHERE conv_id = 4 AND user_id = 2 UNION ALL SELECT 'anonymous', CAST(conv_id AS VARCHAR) FROM s WHERE conv_id = 6 AND user_id IS NULL
    UNION ALL SELECT 'email', id FROM u WHERE email = 'customer#000000007@example.org' UNION ALL SELECT 'id', id FROM u WHERE id = '9' UNION ALL SELECT 'oldest', id FROM (SELECT * FROM u ORDER BY balance, id LIMIT 5)""",
)
def _(spark, d):
    """Sessions by id, for their owner, for another user and for nobody; users by address, by id and by age."""
    s = fr.sessions(spark, d).select(F.col("conv_id").alias("id"), "user_id")
    u = fr.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), T.email(F.concat("c_name", F.lit("@example.org"))).alias("email"), F.col("c_acctbal").alias("created_at"))
    found = {
        "session": conversations.session_by_id(s, 3), "own": conversations.session_for_user(s, 4, 4), "not own": conversations.session_for_user(s, 4, 2), "anonymous": conversations.session_for_user(s, 6, None),
        "email": conversations.user_by_email(u, " Customer#000000007@EXAMPLE.org"), "id": conversations.user_by_id(u, "9"), "oldest": conversations.users_by_age(u).limit(5),
    }
    return fr.union_all([rows.select(F.lit(name).alias("lookup"), F.col("id").cast("string").alias("id")) for name, rows in found.items()])


@query("lkp2_session_messages", f"WITH {SESSIONS} SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN s USING (conv_id) WHERE s.user_id = 2 ORDER BY c.conv_id, c.turn")
def _(spark, d):
    own = fr.sessions(spark, d).where(conversations.owned_by(F.col("user_id"), F.lit(2))).select("conv_id")
    return fr.messages(spark, d).join(own, "conv_id").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("mut2_claim_session", f"WITH {SESSIONS} SELECT conv_id AS id, CASE WHEN conv_id = 3 AND user_id IS NULL THEN 9 ELSE user_id END AS user_id FROM s")
def _(spark, d):
    return conversations.claim(fr.sessions(spark, d).select(F.col("conv_id").alias("id"), "user_id"), 3, F.lit(9).cast("long"))


@query("mut1_create_session", "SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN conv_id END AS user_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 80) AS title FROM conversations WHERE turn = 0")
def _(spark, d):
    """The first message of each conversation opens a session."""
    have = spark.createDataFrame([], "id long, user_id long, title string, created_at timestamp, updated_at timestamp")
    new = fr.messages(spark, d).where("turn = 0").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).alias("user_id"), F.col("text").alias("first"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return conversations.create_sessions(have, new).select("id", "user_id", "title")


@query("mut3_save_message", f"WITH {SESSIONS} SELECT conv_id AS session_id, turn FROM conversations UNION ALL SELECT conv_id, 1000 FROM s WHERE conv_id % 2 = 0")
def _(spark, d):
    """One more message for each even number; those without a session are not saved."""
    s = fr.sessions(spark, d).select(F.col("conv_id").alias("id"))
    m = fr.messages(spark, d).select(F.col("conv_id").alias("session_id"), "turn")
    top = s.agg(F.max("id")).first()[0]
    new = spark.range(0, 2 * top + 10, 2).select(F.col("id").alias("session_id"), F.lit(1000).cast("long").alias("turn"))
    return conversations.append_message(m, s, new)


@query(
    "mut4_create_user",
    """WITH h AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) || '@example.org' AS email FROM customer WHERE c_custkey % 2 = 0),
    w AS (SELECT 'n' || s_suppkey AS id, 'supplier' || (s_suppkey % 5) || '@example.org' AS email, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY 'n' || s_suppkey) AS n FROM supplier)
    SELECT id, email FROM h UNION ALL SELECT id, email FROM w WHERE n = 1 UNION ALL SELECT 'c' || c_custkey, lower(c_name) || '@example.org' FROM customer WHERE c_custkey % 2 = 1""",
)
def _(spark, d):
    """Half of the customers are users; all ask to be, and five addresses are asked for by many suppliers."""
    c, s = fr.table(spark, d, "customer"), fr.table(spark, d, "supplier")
    names = "id string, email string, full_name string, hashed_password string, is_active boolean, is_admin boolean"
    plain = {"full_name": F.lit(" x "), "hashed_password": F.lit("h"), "is_admin": F.lit(False)}
    address = F.concat("c_name", F.lit("@example.org"))
    have = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lower(address).alias("email")).withColumns({**plain, "is_active": F.lit(True)}).select(*[x.split()[0] for x in names.split(", ")])
    new = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit(" "), F.upper(address)).alias("email"))
    new = new.unionByName(s.select(F.concat(F.lit("n"), "s_suppkey").alias("id"), F.concat(F.lit("Supplier"), (F.col("s_suppkey") % 5).cast("string"), F.lit("@example.org ")).alias("email")))
    return conversations.create_users(have, new.withColumns(plain)).select("id", "email")


@query("mut5_cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 2 <> 0")
def _(spark, d):
    s = fr.sessions(spark, d).select(F.col("conv_id").alias("id"))
    m = fr.messages(spark, d).select(F.col("conv_id").alias("session_id"), "conv_id", "turn")
    return conversations.delete_sessions(s, m, s.where("id % 2 = 0"))[1].select("conv_id", "turn")


@query("acl1_session_access", f"WITH {SESSIONS} SELECT conv_id, CASE WHEN user_id IS NULL THEN 'claimed' WHEN user_id = 1 THEN 'granted' ELSE 'forbidden' END AS access FROM s")
def _(spark, d):
    return fr.sessions(spark, d).select("conv_id", conversations.access(F.col("conv_id"), F.col("user_id"), F.lit(1)).alias("access"))


@query("ui2_source_ellipsis", "SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE rtrim(left(url, 29)) || '…' END AS shown FROM pages")
def _(spark, d):
    return fr.table(spark, d, "pages").select("page_id", T.ellipsis(F.col("url"), 30).alias("shown"))


@cases(
    "ui1_shown_answer",
    "case string, text string",
    [("h1", "Dix jours.\r\n\r\nSource : a.pdf, page 3"), ("h2", "Source : a.pdf, page 3"), ("h3", "Documents: rien d'autre"), ("h4", "Un\nSources:\n- 12/2020\nDeux"), ("h5", "Un\nالمصدر: x، الصفحة 3"), ("h6", "Source: page 1\n" + "ligne\n" * 9 + "fin"), ("h7", "Un\nSource: page 1\nDeux\nSource: b.pdf")],
    ["Dix jours.", "", "Documents: rien d'autre", "Un", "Un", "Source: page 1\n" + "ligne\n" * 9 + "fin", "Un\nSource: page 1\nDeux"],
    """SELECT 'd' || conv_id || '/' || turn AS "case", regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS value FROM conversations""",
)
def _(spark, d, rows):
    m = fr.messages(spark, d).select(F.concat(F.lit("d"), "conv_id", F.lit("/"), "turn").alias("case"), F.concat("text", F.lit("\n\nRéférences : texte 12_2020")).alias("text"))
    return m.unionByName(rows).select("case", T.shown_answer(F.col("text")).alias("value"))


@query("ui3_answer_direction", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'rtl' ELSE 'ltr' END AS direction FROM {BOTH}")
def _(spark, d):
    return both_languages(spark, d).select("conv_id", "turn", F.when(L.question_language(F.col("text")) == "ar", "rtl").otherwise("ltr").alias("direction"))
