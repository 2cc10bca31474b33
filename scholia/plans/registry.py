"""The registered queries on the driver's tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import citations as C
from scholia.functions import names as N
from scholia.functions import text as X
from scholia.operators import catalog as cat
from scholia.operators import chunking, graph, references, resolve, style, vectors
from scholia.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- normalisation and identifiers (N1, N2, N6-N8, N10, N20, N21, C28, C29, P4, P6, P16) ---------------------------



@query(
    r"""SELECT id, n AS normalized, replace(n, ' ', '') AS glued FROM (
    SELECT id, coalesce(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(title, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '') AS n FROM papers)"""
)
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", X.normalize_text("title").alias("normalized"))
    return rows.withColumn("glued", X.glue("normalized"))


@query(
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[\[\]().,;:"<>]', ' ', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))) AS norm,
    sha256(text) AS checksum FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7F]*')"""
)
def reference_norm_checksum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("text").rlike(r"^[\x00-\x7F]*\z"))
    return rows.select("doc_id", X.normalize_reference("text").alias("norm"), X.checksum("text").alias("checksum"))


@query()
def reference_norm_checksum_all(spark: SparkSession, d: str) -> DataFrame:
    """N6/N7 over every document, whatever its letters; SQL engines differ in lower case beyond ASCII."""
    return table(spark, d, "documents").select("doc_id", X.normalize_reference("text").alias("norm"), X.checksum("text").alias("checksum"))


@query(
    r"""SELECT id, nullif(regexp_extract(arxiv_id, '([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)', 1), '') AS clean,
    regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arXiv:\s*', ''), 'v[0-9]+$', '') AS base,
    nullif(regexp_extract(replace(arxiv_id, 'preprints.example', 'arxiv.org'), 'arxiv\.org/(?:pdf|abs)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[A-Za-z\-]+/[0-9]{7}(?:v[0-9]+)?)', 1), '') AS in_url
    FROM papers"""
)
def clean_ids(spark: SparkSession, d: str) -> DataFrame:
    url = F.replace("arxiv_id", F.lit("preprints.example"), F.lit("arxiv.org"))
    return table(spark, d, "papers").select("id", X.clean_id("arxiv_id").alias("clean"), X.base_id("arxiv_id").alias("base"), X.id_in_url(url).alias("in_url"))


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' arXiv: ' || arxiv_id || ' and https://arxiv.org/abs/' || arxiv_id || ' arXiv:' || arxiv_id || 'v2' AS t FROM documents WHERE arxiv_id IS NOT NULL),
    r AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(t, '(?i)(arXiv:\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)', 1), regexp_extract_all(t, 'https?://arxiv\.org/abs/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)', 1))) AS r FROM t)
    SELECT doc_id, unnest(r) AS ref FROM r"""
)
def ids_in_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("arxiv_id")
    own = F.concat(F.lit(" arXiv: "), c, F.lit(" and https://arxiv.org/abs/"), c, F.lit(" arXiv:"), c, F.lit("v2"))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce(own, F.lit("")))  # a document without an id has its text searched too
    return table(spark, d, "documents").select("doc_id", F.explode(X.references_in_text(text)).alias("ref"))


@query(
    r"""SELECT id, CASE WHEN arxiv_id IS NOT NULL AND arxiv_id <> '' THEN substring(regexp_replace(arxiv_id, '[<>:"/\\|?*]', '', 'g'), 1, 150) || '.pdf'
    ELSE substring(regexp_replace(coalesce(nullif(title, ''), 'Untitled'), '[<>:"/\\|?*]', '', 'g'), 1, 100) || '.pdf' END AS file, coalesce(nullif(title, ''), 'Untitled') AS shown FROM works"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    shown = X.title_or_default("title", F.lit(None).cast("string"))
    return table(spark, d, "works").select("id", X.file_name("arxiv_id", shown).alias("file"), shown.alias("shown"))


@query(
    """WITH h AS (SELECT chunk_seq, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)
    SELECT chunk_seq, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE WHEN substring(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substring(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substring(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid FROM h"""
)
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_seq", X.uuid5("chunk_id").alias("uuid"))


@query(
    r"""SELECT id, CASE WHEN regexp_matches(m, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(m AS DATE) WHEN regexp_matches(split_part(m, 'T', 1), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(split_part(m, 'T', 1) AS DATE) END AS day
    FROM (SELECT id, metadata->>'$.created' AS m FROM papers)"""
)
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", X.parse_date(F.get_json_object("metadata", "$.created"), F.lit(None).cast("date")).alias("day"))


# --- catalog (P1, K5-K7, W1, A1-A6, T1-T3, J5) ---------------------------------------------------------------------


@query(
    """SELECT id, title_and_authors, created_date FROM (SELECT *, row_number() OVER (PARTITION BY title_and_authors ORDER BY created_date DESC, id DESC) AS rn FROM papers) WHERE rn = 1"""
)
def dedup_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "title_and_authors", "created_date")
    return cat.keep_latest(rows, "title_and_authors", [F.desc("created_date"), F.desc("id")])


@query(
    """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY title_and_authors ORDER BY created_date DESC, id DESC) AS rn FROM papers) WHERE rn > 1"""
)
def dedup_deleted_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "title_and_authors", "created_date")
    return cat.deleted_ids(rows, "title_and_authors", "id", [F.desc("created_date"), F.desc("id")])


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM papers GROUP BY title_and_authors)")
def dedup_dry_run_count(spark: SparkSession, d: str) -> DataFrame:
    return cat.count_duplicates(table(spark, d, "papers"), "title_and_authors")


@query(
    """WITH old AS (SELECT * FROM papers WHERE batch_no = 0), new AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY id) AS rn FROM papers WHERE batch_no > 0 AND arxiv_id IS NOT NULL AND trim(arxiv_id) <> '')
    SELECT id, arxiv_id FROM new WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.arxiv_id = new.arxiv_id)"""
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "arxiv_id", "batch_no")
    return cat.insert_if_absent(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"), "arxiv_id", [F.asc("id")]).select("id", "arxiv_id")


@query(
    """WITH old AS (SELECT DISTINCT arxiv_id FROM papers WHERE batch_no = 0), new AS (SELECT arxiv_id, arxiv_id IN (SELECT arxiv_id FROM old WHERE arxiv_id IS NOT NULL) AS known, arxiv_id IS NULL OR trim(arxiv_id) = '' AS blank FROM papers WHERE batch_no > 0)
    SELECT i AS inserted, b AS skipped_blank, n - i - b AS already_there FROM (SELECT count(DISTINCT CASE WHEN NOT blank AND NOT known THEN arxiv_id END) AS i, count(*) FILTER (blank) AS b, count(*) AS n FROM new)"""
)
def insert_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "arxiv_id", "batch_no")
    return cat.insert_summary(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"), "arxiv_id")


_UPDATES = """u AS (SELECT arxiv_id, arg_max(citation_count, citation_id) AS new FROM citations WHERE arxiv_id IS NOT NULL AND citation_count IS NOT NULL AND citation_count <> 0 GROUP BY arxiv_id)"""


@query(f"WITH {_UPDATES} SELECT p.id, coalesce(u.new, p.citation_count) AS citation_count FROM papers p LEFT JOIN u USING (arxiv_id)")
def update_citation_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "arxiv_id", "citation_count")
    new = table(spark, d, "citations").select("arxiv_id", F.col("citation_count").alias("value"), "citation_id")
    return cat.update_by_key(rows, "arxiv_id", "citation_count", new, "value", "citation_id").select("id", "citation_count")


@query(
    """WITH u AS (SELECT DISTINCT arxiv_id FROM citations WHERE arxiv_id IS NOT NULL AND citation_count <> 0), m AS (SELECT count(*) AS n FROM u WHERE arxiv_id IN (SELECT arxiv_id FROM papers WHERE arxiv_id IS NOT NULL))
    SELECT m.n AS matched, (SELECT count(*) FROM u) AS total, (SELECT count(*) FROM u) - m.n AS unmatched FROM m"""
)
def update_summary(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "citations").select("arxiv_id", F.col("citation_count").alias("value"))
    return cat.update_summary(table(spark, d, "papers"), "arxiv_id", new, "value")


@query("SELECT DISTINCT arxiv_id FROM papers WHERE arxiv_id IS NOT NULL")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("arxiv_id").filter("arxiv_id IS NOT NULL").distinct()


@query("SELECT id, citations FROM works ORDER BY citations DESC, id LIMIT 100")
def top_n_cited(spark: SparkSession, d: str) -> DataFrame:
    from scholia.sources.works_api import top_cited

    return top_cited(table(spark, d, "works").select("id", "citations"), 100)


@query(
    """SELECT c_custkey, o_orderkey, rank::INT AS rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"""
)
def top_k_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    rank = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.asc("o_orderkey")))
    return rows.withColumn("rank", rank).filter("rank <= 3").drop("o_orderdate")


@query("SELECT p.id, p.arxiv_id FROM papers p WHERE p.arxiv_id IN (SELECT arxiv_id FROM citations WHERE arxiv_id IS NOT NULL)")
def lookup_cited(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "citations").select("arxiv_id").filter("arxiv_id IS NOT NULL")
    return resolve.lookup(ids, table(spark, d, "papers").select("id", "arxiv_id"))


# --- citation resolution (J1-J6, A4, N11-N13) ----------------------------------------------------------------------


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("id", "title", F.col("normalized_authors").alias("authors"), "created_date")
    return rows.select("id", "authors", "created_date", X.glue(X.normalize_text("title")).alias("glued"))


def _work_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works").select(F.col("id").alias("query_id"), X.glue(X.normalize_text("title")).alias("glued"), X.normalize_list("authors").alias("authors"))


_GLUE = r"replace(coalesce(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), ''), ' ', '')"


@query(
    f"""WITH q AS (SELECT id AS query_id, {_GLUE} AS g FROM works), p AS (SELECT id, created_date, {_GLUE} AS g FROM papers)
    SELECT query_id, id, cand_rank::INT AS cand_rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_date DESC, id) AS cand_rank FROM q JOIN p USING (g) WHERE g <> '') WHERE cand_rank <= 50"""
)
def title_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.exact_candidates(_work_queries(spark, d), _catalog(spark, d)).select("query_id", "id", "cand_rank")


@query(
    f"""WITH q AS (SELECT id AS query_id, {_GLUE} AS g FROM works), p AS (SELECT id, {_GLUE} AS g FROM papers),
    qg AS (SELECT g, list_distinct(list_transform(range(1, length(g) + 2), lambda i: substring('  ' || g || ' ', i::INT, 3))) AS t FROM (SELECT DISTINCT g FROM q WHERE g <> '')),
    pg AS (SELECT g, list_distinct(list_transform(range(1, length(g) + 2), lambda i: substring('  ' || g || ' ', i::INT, 3))) AS t FROM (SELECT DISTINCT g FROM p WHERE g <> '')),
    a AS (SELECT g, len(t) AS n, unnest(t) AS k FROM qg), b AS (SELECT g, len(t) AS n, unnest(t) AS k FROM pg),
    s AS (SELECT a.g AS qg, b.g AS pg, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM a JOIN b USING (k) GROUP BY 1, 2),
    h AS (SELECT qg, pg, c / (na + nb - c) AS sim FROM s WHERE c / (na + nb - c) >= 0.3)
    SELECT query_id, id, round(sim, 6) AS similarity, r::INT AS cand_rank FROM (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM h JOIN q ON q.g = h.qg JOIN p ON p.g = h.pg) WHERE r <= 50"""
)
def title_trigram_match(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.trigram_candidates(_work_queries(spark, d), _catalog(spark, d))
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "cand_rank")


@query()
def title_cascade(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_work_queries(spark, d), _catalog(spark, d))


@query(
    r"""WITH p AS (SELECT id, normalized_authors[1] AS a FROM papers WHERE len(normalized_authors) > 0),
    t AS (SELECT id, list_sort(list_distinct(string_split_regex(lower(trim(a)), '\s+'))) AS w FROM p)
    SELECT id, array_to_string(w, ' ') AS words FROM t"""
)
def name_token_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").filter(F.size("normalized_authors") > 0)
    return rows.select("id", F.array_join(N.token_set(F.element_at("normalized_authors", 1)), " ").alias("words"))


@query(
    r"""WITH p AS (SELECT id, generate_subscripts(normalized_authors, 1) - 1 AS pos, unnest(normalized_authors) AS a FROM papers)
    SELECT id, pos::BIGINT AS pos, array_to_string(list_sort(list_distinct(string_split_regex(lower(trim(a)), '\s+'))), ' ') AS words FROM p"""
)
def name_token_sets_all(spark: SparkSession, d: str) -> DataFrame:
    """N11 over every author of a paper; `name_token_sets` takes the first."""
    rows = table(spark, d, "papers").select("id", F.posexplode("normalized_authors").alias("pos", "name"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.array_join(N.token_set("name"), " ").alias("words"))


@query(
    r"""WITH a AS (SELECT DISTINCT unnest(authors) AS a FROM works), p AS (SELECT a, list_filter(string_split_regex(a, '[^0-9A-Za-z''\-]+'), lambda t: t <> '') AS p FROM a WHERE a IS NOT NULL),
    w AS (SELECT a, p, list_filter(p, lambda t: NOT regexp_matches(replace(t, '.', ''), '^[A-Za-z](-[A-Za-z])*$')) AS w FROM p),
    c AS (SELECT a, list_filter([w[-1], w[1], p[-1], CASE WHEN len(p) > 1 THEN array_to_string(p[-2:], ' ') END], lambda x: x IS NOT NULL) AS c FROM w)
    SELECT DISTINCT a AS author, lower(unnest(c)) AS candidate FROM c"""
)
def surname_candidates(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "works").select(F.explode("authors").alias("author")).filter("author IS NOT NULL").distinct()
    return names.select("author", F.explode(N.surname_candidates("author")).alias("candidate"))


# --- citation style, markers, reference lists (C1-C17, A7, A8, O6, J9, J10, C26) -----------------------------------


@query(
    r"""SELECT chunk_seq, len(regexp_extract_all(chunk_text, '\[\s*\d+(?:\s*(?:,|;|:|\-|–|—)\s*\d+)*(?:\s*(?:\-|–|—)\s*\d+)?\s*\]')) AS bracket,
    len(regexp_extract_all(chunk_text, '\(\s*\d+(?:\s*(?:,|;|:|\-|–|—)\s*\d+)*(?:\s*(?:\-|–|—)\s*\d+)?\s*\)')) AS paren,
    len(regexp_extract_all(chunk_text, '[¹²³⁰-⁹]')) AS superscript FROM chunks"""
)
def citation_style_counts(spark: SparkSession, d: str) -> DataFrame:
    n = C.style_counts("chunk_text")
    return table(spark, d, "chunks").select("chunk_seq", *(n[k].cast("long").alias(k) for k in ("bracket", "paren", "superscript")))


@query(
    rf"""SELECT chunk_seq, len(regexp_extract_all(t, '{C.BRACKETED}')) AS bracket, len(regexp_extract_all(t, '{C.PARENTHESISED}')) AS paren, len(regexp_extract_all(t, '{C.AUTHOR_YEAR}')) AS author_year,
    len(regexp_extract_all(t, '{C.SUPERSCRIPT}')) AS superscript, len(regexp_extract_all(t, '{C.SMALL_NUMBER}')) AS raw_numeric FROM (SELECT chunk_seq, coalesce(chunk_text, '') AS t FROM chunks)"""
)
def citation_style_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """All five counts; `citation_style_counts` gives three of them."""
    n = C.style_counts("chunk_text")
    return table(spark, d, "chunks").select("chunk_seq", *(n[k].cast("long").alias(k) for k in style.KINDS))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(t, '\([A-Z][A-Za-z\-\s\.]+(?:et al\.|and [A-Z][A-Za-z\-]+)?,?\s*(?:19|20)\d{2}\)|\b[A-Z][A-Za-z\-\.\s]+et al\.\s*\(\s*(?:19|20)\d{2}\s*\)|\b[A-Z][A-Za-z\-\.\s]+\,\s*(?:19|20)\d{2}\b')) AS author_year
    FROM (SELECT doc_id, 'We follow (Smith et al., ' || (1990 + doc_id % 30) || ') and Jones et al. (' || (1980 + doc_id % 20) || ') in ' || doc_id || ' cases, Brown, 2001.' AS t FROM documents)"""
)
def author_year_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat(F.lit("We follow (Smith et al., "), (1990 + i % 30).cast("string"), F.lit(") and Jones et al. ("), (1980 + i % 20).cast("string"), F.lit(") in "), i.cast("string"), F.lit(" cases, Brown, 2001."))
    return table(spark, d, "documents").select("doc_id", C.occurrences(text, C.AUTHOR_YEAR).cast("long").alias("author_year"))


@query(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{C.AUTHOR_YEAR}')) AS author_year FROM documents")
def author_year_counts_in_text(spark: SparkSession, d: str) -> DataFrame:
    """C2 over every document's whole text as it stands; `author_year_counts` takes a composed line instead."""
    return table(spark, d, "documents").select("doc_id", C.occurrences("text", C.AUTHOR_YEAR).cast("long").alias("author_year"))


_KIND_SQL = rf"""CASE WHEN regexp_matches(e, '{C.LABEL}') OR regexp_matches(e, '{C.LEADING_NUMBER}') THEN 'numeric' WHEN regexp_matches(e, '{C.YEAR}') AND (regexp_matches(e, '{C.NAMES}') OR contains(e, 'et al.')) THEN 'author_year' ELSE 'ambiguous' END"""
_COUNTS_SQL = ", ".join(rf"len(regexp_extract_all(t, '{p}')) AS {k}" for k, p in zip(style.KINDS, (C.BRACKETED, C.PARENTHESISED, C.AUTHOR_YEAR, C.SUPERSCRIPT, C.SMALL_NUMBER), strict=True))
_WORDS_SQL = " OR ".join(f"contains(h, '{w}')" for w in C.SECTION_WORDS)


@query(
    rf"""WITH s AS (SELECT chunk_paper_id AS p, chunk_seq, lower(coalesce(section_title, '')) AS h, coalesce(chunk_text, '') AS t FROM chunks),
    n AS (SELECT p, chunk_seq, h, h <> '' AND ({_WORDS_SQL}) AS known, {_COUNTS_SQL} FROM s),
    m AS (SELECT *, max(known::INT) OVER (PARTITION BY p) AS any_known, sum((h <> '')::INT) OVER (PARTITION BY p ORDER BY chunk_seq ROWS UNBOUNDED PRECEDING) AS place FROM n),
    z AS (SELECT *, CASE WHEN any_known = 1 THEN known ELSE h <> '' AND place <= 3 END AS sel FROM m),
    t AS (SELECT p, {", ".join(f"coalesce(sum(CASE WHEN sel THEN {k} END), 0)::INT AS {k}, sum({k})::INT AS body_{k}" for k in style.KINDS)} FROM z GROUP BY p),
    e AS (SELECT DISTINCT k.chunk_paper_id AS p, trim(regexp_replace(concat_ws('. ', array_to_string(c.authors_str, ' and '), '20' || lpad((c.citation_id % 25)::VARCHAR, 2, '0'), c.title), '\s+', ' ', 'g')) AS e FROM citations c JOIN chunks k USING (chunk_seq)),
    b AS (SELECT p, count(*)::INT AS bib_count, count(*) FILTER (k = 'numeric')::INT AS bib_numeric, count(*) FILTER (k = 'author_year')::INT AS bib_author_year FROM (SELECT p, {_KIND_SQL} AS k FROM e) GROUP BY p),
    j AS (SELECT t.*, coalesce(bib_count, 0) AS bib_count, coalesce(bib_numeric, 0) AS bib_numeric, coalesce(bib_author_year, 0) AS bib_author_year, greatest(2, floor(coalesce(bib_count, 0) * 0.6)) AS most FROM t LEFT JOIN b ON b.p = t.p),
    d AS (SELECT *, CASE WHEN bib_count >= 5 AND bib_numeric >= most THEN 'bibliography_majority_numeric' WHEN bib_count >= 5 AND bib_author_year >= most THEN 'bibliography_majority_author_year'
      WHEN author_year >= 3 AND bracket + superscript <= 1 THEN 'sections_author_year_strong' WHEN bracket >= 4 OR (bracket >= 2 AND superscript >= 2) THEN 'sections_bracket_strong' WHEN superscript >= 4 THEN 'sections_superscript_strong'
      WHEN author_year >= 4 AND author_year > bracket + superscript THEN 'sections_author_year_dominate' WHEN body_bracket >= 8 OR (body_bracket >= 5 AND body_superscript >= 3) THEN 'body_bracket_fallback'
      WHEN body_author_year >= 8 AND body_author_year > body_bracket + body_superscript THEN 'body_author_year_fallback' ELSE 'conservative_default_no_clear_numeric_evidence' END AS reason FROM j)
    SELECT p AS chunk_paper_id, {", ".join(f"{k}, body_{k}" for k in style.KINDS)}, bib_count, bib_numeric, bib_author_year, reason IN ('bibliography_majority_numeric', 'sections_bracket_strong', 'sections_superscript_strong', 'body_bracket_fallback') AS numbered, reason FROM d"""
)
def citation_style_decision(spark: SparkSession, d: str) -> DataFrame:
    """C7 with each paper's bibliography: its citations as entries, authors before the title."""
    rows = table(spark, d, "chunks").select("chunk_paper_id", "chunk_seq", "section_title", "chunk_text")
    counts = style.section_counts(rows, "chunk_paper_id", "chunk_seq", "section_title", "chunk_text")
    entry = F.concat_ws(". ", F.array_join("authors_str", " and "), F.concat(F.lit("20"), F.lpad((F.col("citation_id") % 25).cast("string"), 2, "0")), "title")
    entries = table(spark, d, "citations").join(rows.select("chunk_seq", "chunk_paper_id"), "chunk_seq").select("chunk_paper_id", entry.alias("entry"))
    return style.decide_style(counts, "chunk_paper_id", style.bibliography_counts(entries, "chunk_paper_id", "entry"))


@query(
    r"""WITH m AS (SELECT chunk_seq, unnest(regexp_extract_all(chunk_text, '\[([^\]]+)\]', 1)) AS m, generate_subscripts(regexp_extract_all(chunk_text, '\[([^\]]+)\]', 1), 1) - 1 AS pos FROM chunks),
    t AS (SELECT chunk_seq, pos, unnest(regexp_extract_all(m, '([0-9]+(?:-[0-9]+)?)', 1)) AS t FROM m),
    r AS (SELECT chunk_seq, pos, try_cast(split_part(t, '-', 1) AS BIGINT) AS lo, CASE WHEN split_part(t, '-', 2) = '' THEN try_cast(split_part(t, '-', 1) AS BIGINT) ELSE try_cast(split_part(t, '-', 2) AS BIGINT) END AS hi FROM t)
    SELECT chunk_seq, pos::BIGINT AS marker_pos, unnest(range(lo, hi + 1))::BIGINT AS number FROM r WHERE hi >= lo"""
)
def marker_expand(spark: SparkSession, d: str) -> DataFrame:
    found = references.expand_markers(table(spark, d, "chunks"), "chunk_seq", "chunk_text")
    return found.select("chunk_seq", F.col("marker_pos").cast("long"), F.col("number").cast("long"))


@query(
    r"""WITH refs AS (SELECT c.chunk_seq, row_number() OVER (PARTITION BY c.chunk_seq ORDER BY c.citation_id) AS number, c.title FROM citations c),
    m AS (SELECT chunk_seq, unnest(regexp_extract_all(chunk_text, '\[([^\]]+)\]', 1)) AS m, generate_subscripts(regexp_extract_all(chunk_text, '\[([^\]]+)\]', 1), 1) - 1 AS pos FROM chunks),
    f AS (SELECT chunk_seq, m, min(pos) AS pos FROM m GROUP BY 1, 2),
    t AS (SELECT chunk_seq, m, pos, unnest(regexp_extract_all(m, '([0-9]+(?:-[0-9]+)?)', 1)) AS t FROM f),
    r AS (SELECT chunk_seq, m, try_cast(split_part(t, '-', 1) AS BIGINT) AS lo, CASE WHEN split_part(t, '-', 2) = '' THEN try_cast(split_part(t, '-', 1) AS BIGINT) ELSE try_cast(split_part(t, '-', 2) AS BIGINT) END AS hi FROM t),
    n AS (SELECT chunk_seq, m, unnest(range(lo, hi + 1)) AS number FROM r WHERE hi >= lo)
    SELECT n.chunk_seq, '[' || m || ']' AS marker, n.number::BIGINT AS number, '[' || n.number || '] ' || coalesce(refs.title, 'Reference not found') AS reference FROM n LEFT JOIN refs ON refs.chunk_seq = n.chunk_seq AND refs.number = n.number"""
)
def marker_resolve(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("chunk_seq").orderBy("citation_id"))
    refs = table(spark, d, "citations").select("chunk_seq", number.alias("number"), F.col("title").alias("reference"))
    found = references.match_markers(table(spark, d, "chunks").select("chunk_seq", "chunk_text"), "chunk_seq", "chunk_text", refs)
    return found.select("chunk_seq", "marker", F.col("number").cast("long").alias("number"), "reference")


_ENTRY = """CASE id % 4 WHEN 0 THEN normalized_authors[1] || ' et al. ' || (2000 + id % 20) WHEN 1 THEN array_to_string(normalized_authors, ', ') || '. ' || (2000 + id % 20) || '. ' || title || '. In Proceedings'
    WHEN 2 THEN '[' || id || '] ' || title ELSE 'Smith and ' || normalized_authors[1] || ', ' || (2000 + id % 20) END"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    i, year = F.col("id"), (2000 + F.col("id") % 20).cast("string")
    first, title = F.try_element_at("normalized_authors", F.lit(1)), F.col("title")
    entry = (
        F.when(i % 4 == 0, F.concat(first, F.lit(" et al. "), year))
        .when(i % 4 == 1, F.concat(F.array_join("normalized_authors", ", "), F.lit(". "), year, F.lit(". "), title, F.lit(". In Proceedings")))
        .when(i % 4 == 2, F.concat(F.lit("["), i.cast("string"), F.lit("] "), title))
        .otherwise(F.concat(F.lit("Smith and "), first, F.lit(", "), year))
    )
    return table(spark, d, "papers").select("id", (i % 50).alias("paper"), entry.alias("entry")).filter("entry IS NOT NULL")


@query(
    rf"""SELECT id, CASE WHEN regexp_matches(e, '^\s*\[\s*\d+\s*\]') OR regexp_matches(e, '^\s*(?:\d{{1,4}}\s*[\.\)]\s+|\d{{1,4}}\s+-\s+)') THEN 'numeric'
    WHEN regexp_matches(e, '\b(?:19|20)\d{{2}}\b') AND (regexp_matches(e, '[A-Z][a-z]{{2,}}\s+(and|&|,|\.)') OR contains(e, 'et al.')) THEN 'author_year' ELSE 'ambiguous' END AS kind,
    nullif(regexp_extract(e, '((?:19|20)[0-9]{{2}})', 1), '') AS year,
    regexp_matches(e, '\b(19|20)\d{{2}}\.\s+[A-Za-z]') OR contains(lower(e), ' in ') OR contains(lower(e), 'iclr') OR contains(lower(e), 'acl') OR contains(lower(e), 'nips') OR contains(lower(e), 'emnlp') OR contains(lower(e), 'in proceedings') OR contains(lower(e), 'computational') OR length(e) > 60 AS is_full
    FROM (SELECT id, {_ENTRY} AS e FROM papers) WHERE e IS NOT NULL"""
)
def entry_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("id", C.entry_kind("entry").alias("kind"), C.find_year("entry").alias("year"), C.is_full_entry("entry").alias("is_full"))


@query(
    rf"""WITH e AS (SELECT id, id % 50 AS paper, {_ENTRY} AS entry FROM papers),
    m AS (SELECT *, lower(entry) AS low, nullif(regexp_extract(entry, '((?:19|20)[0-9]{{2}})', 1), '') AS y, lower(trim(regexp_replace(regexp_replace(entry, '[\[\]().,;:"<>]', ' ', 'g'), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B\x1C-\x1F]+', ' ', 'g'))) AS norm,
      regexp_matches(entry, '{C.FULL_ENTRY}') OR {" OR ".join(f"contains(lower(entry), '{w}')" for w in C.FULL_WORDS)} OR length(entry) > 60 AS is_full FROM e WHERE entry IS NOT NULL),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper, norm ORDER BY id) AS rn FROM m WHERE is_full) WHERE rn = 1),
    h AS (SELECT paper, id, y, CASE WHEN regexp_extract(entry, '{C.NAME_BLOCK}', 1) <> '' THEN regexp_extract(entry, '{C.NAME_BLOCK}', 1) WHEN regexp_extract(entry, '^(.*?)[0-9]{{4}}', 1) <> '' THEN regexp_extract(entry, '^(.*?)[0-9]{{4}}', 1) ELSE entry END AS head
      FROM m WHERE NOT is_full AND y IS NOT NULL AND (contains(low, 'et al') OR (contains(low, ' and ') AND length(entry) < 80))),
    n AS (SELECT paper, id, y, lower(regexp_replace(string_split_regex(trim(x), '\s+')[-1], '[^A-Za-z\-]', '', 'g')) AS name FROM (SELECT *, unnest(string_split_regex(head, '[,;]| and | & ')) AS x FROM h)),
    g AS (SELECT DISTINCT n.paper, n.id FROM n JOIN f ON f.paper = n.paper AND f.y = n.y AND contains(f.low, n.name) WHERE n.name <> '')
    SELECT id, paper, entry FROM f UNION ALL SELECT id, paper, entry FROM m WHERE NOT is_full AND NOT EXISTS (SELECT 1 FROM g WHERE g.paper = m.paper AND g.id = m.id)"""
)
def refs_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return references.without_repeats(_entries(spark, d), "paper", "entry", "id")


@query()
def authors_in_text(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "citations").select("chunk_seq", F.explode("authors_str").alias("author")).filter("author IS NOT NULL")
    return references.authors_in_text(table(spark, d, "chunks").select("chunk_seq", "chunk_text"), "chunk_seq", "chunk_text", cited, "author")


@query()
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("citation_id", F.concat_ws(". ", F.array_join("authors_str", ", "), "title").alias("t"))
    lists = table(spark, d, "citations").groupBy("chunk_seq").agg(F.array_sort(F.collect_list(item)).alias("r"))
    lines = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n")
    return references.references_of(lists.select("chunk_seq", F.concat(F.lit("Text before.\nReferences\n"), lines).alias("text")), "chunk_seq", "text")


# --- sections and chunks (C24, C25, W2, W3, A11, P15) --------------------------------------------------------------


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, w, greatest(ceil(len(w) / greatest(ceil(len(w) / 64), 1)), 1)::INT AS size FROM t),
    p AS (SELECT doc_id, w, size, unnest(range(0, greatest(len(w) - 1, 0) + 1, size)) AS o FROM s)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS chunk_num, len(list_slice(w, o + 1, o + size))::BIGINT AS token_len, sha256(array_to_string(list_slice(w, o + 1, o + size), ' ')) AS checksum FROM p"""
)
def chunk_balanced_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text").withColumn("pos", F.lit(0))
    made = chunking.split_chunks(rows, "doc_id", "pos", "text", 64)
    return made.select("doc_id", F.col("chunk_num").cast("long").alias("chunk_num"), F.col("token_len").cast("long").alias("token_len"), "checksum")


@query()
def section_merge_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_paper_id", "chunk_num", "section_title", "chunk_text")
    return chunking.merge_sections(rows, "chunk_paper_id", "chunk_num", "section_title", "chunk_text")


@query(
    """WITH f AS (SELECT chunk_seq, arxiv_id, title, min(citation_id) AS o FROM citations GROUP BY 1, 2, 3)
    SELECT k.chunk_seq, coalesce(g.n, 0)::BIGINT AS n_citations, g.first_title, coalesce(g.n, 0) > 0 AS is_context FROM chunks k LEFT JOIN (SELECT chunk_seq, count(*) AS n, first(title ORDER BY o) AS first_title FROM f GROUP BY 1) g USING (chunk_seq)"""
)
def nested_regroup(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_seq")
    made = chunking.regroup_citations(chunks, table(spark, d, "citations"), "chunk_seq", "citation_id", F.struct("arxiv_id", "title"))
    first = F.try_element_at("citations", F.lit(1))
    return made.select("chunk_seq", F.coalesce(F.size("citations"), F.lit(0)).cast("long").alias("n_citations"), first["title"].alias("first_title"), F.col("is_citation_context").alias("is_context"))


@query(
    """SELECT chunk_seq, checksum FROM (SELECT chunk_seq, sha256(chunk_text) AS checksum, row_number() OVER (PARTITION BY sha256(chunk_text) ORDER BY chunk_seq) AS rn FROM chunks) WHERE rn = 1"""
)
def checksum_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_seq", X.checksum("chunk_text").alias("checksum"))
    return cat.first_per_key(rows, "checksum", [F.asc("chunk_seq")])


# --- vectors (J13, J14, V5-V7, A9, G6) -----------------------------------------------------------------------------


@query(
    """WITH old AS (SELECT DISTINCT checksum FROM chunks WHERE batch_no = 0 AND checksum IS NOT NULL) SELECT DISTINCT checksum FROM chunks WHERE batch_no > 0 AND checksum IS NOT NULL AND checksum NOT IN (SELECT checksum FROM old)"""
)
def vector_exists_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("checksum", "batch_no")
    return vectors.not_stored(rows.filter("batch_no > 0"), rows.filter("batch_no = 0"), "checksum").select("checksum")


@query(
    """WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0)
    SELECT query_id, vec_id, round(s, 6) AS similarity, r::BIGINT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS r FROM q CROSS JOIN e) WHERE r <= 5"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, searched in all rows."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.cosine_topk(asked, rows)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("SELECT label, d AS dim, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS d FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    made = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return made.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(
    """WITH f AS (SELECT DISTINCT arxiv_id FROM papers WHERE batch_no > 0 AND arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM papers WHERE batch_no = 0 AND arxiv_id IS NOT NULL)),
    c AS (SELECT sha256(chunk_text) AS s, min(chunk_seq) AS chunk_seq FROM chunks WHERE batch_no > 0 AND chunk_text IS NOT NULL AND chunk_paper_id IN (SELECT arxiv_id FROM f) AND sha256(chunk_text) NOT IN (SELECT sha256(chunk_text) FROM chunks WHERE batch_no = 0 AND chunk_text IS NOT NULL) GROUP BY 1),
    h AS (SELECT chunk_seq, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(s)) AS h FROM c)
    SELECT chunk_seq, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE WHEN substring(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substring(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substring(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid, 64 AS dim FROM h"""
)
def embed_new_chunks(spark: SparkSession, d: str) -> DataFrame:
    from scholia.plans.pipelines import load_vectors

    papers = table(spark, d, "papers").select("arxiv_id", "title", F.get_json_object("metadata", "$.abstract").alias("abstract"), "batch_no")
    chunks = table(spark, d, "chunks").select("chunk_paper_id", "chunk_seq", "chunk_text", X.checksum("chunk_text").alias("checksum"), "batch_no")
    _, new = load_vectors(papers.filter("batch_no > 0"), chunks.filter("batch_no > 0"), papers.filter("batch_no = 0"), chunks.filter("batch_no = 0"), order="chunk_seq")
    return new.select("chunk_seq", "uuid", F.size("vector").alias("dim"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("chunk_seq").alias("id"), "chunk_text").filter("chunk_text IS NOT NULL")


@query(
    r"""WITH w AS (SELECT '(?:[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B])' AS r),
    t AS (SELECT chunk_seq AS id, regexp_extract_all(lower(chunk_text), (SELECT r FROM w)) AS l FROM chunks WHERE chunk_text IS NOT NULL),
    q AS (SELECT id AS query_id, unnest(list_distinct(regexp_extract_all(lower(title), (SELECT r FROM w)))) AS term FROM works WHERE title IS NOT NULL AND substring(id, 2)::BIGINT % 100 = 0),
    p AS (SELECT id, len(l) AS n, unnest(l) AS term FROM t), f AS (SELECT id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len(l)) AS avg_len FROM t),
    x AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score FROM f JOIN d USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY 1, 2)
    SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the works whose number is divisible by 100, searched in the text of all chunks."""
    asked = table(spark, d, "works").filter(F.col("title").isNotNull() & (F.substring("id", 2, 20).cast("long") % 100 == 0)).select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    return vectors.bm25(_texts(spark, d), "id", "chunk_text", asked)


# --- graph (G1-G6, J15, O1-O4, P12) --------------------------------------------------------------------------------


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers").select(
        F.col("arxiv_id").alias("id"), "title", F.get_json_object("metadata", "$.doi").alias("doi"), F.col("created_date").alias("published"), X.parse_date(F.get_json_object("metadata", "$.updated"), F.lit(None).cast("date")).alias("updated"),
        F.get_json_object("metadata", "$.abstract").alias("summary"), F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id").alias("url"),
        F.col("normalized_authors").alias("authors"), F.split(F.get_json_object("metadata", "$.categories"), " ").alias("categories"), F.struct("created_date", F.col("id").alias("n")).alias("order"),
    )
    chunks, cites = table(spark, d, "chunks").select("chunk_seq", "chunk_paper_id"), table(spark, d, "citations").select("chunk_seq", "arxiv_id")
    pairs = chunks.join(cites, "chunk_seq").select(F.col("chunk_paper_id").alias("src"), F.col("arxiv_id").alias("dst"))
    return graph.scholarly_graph(papers, pairs)


_SQL_PAPERS = """p AS (SELECT arxiv_id AS id, id AS n, title, normalized_authors AS a, created_date, string_split(metadata->>'$.categories', ' ') AS c FROM papers WHERE arxiv_id IS NOT NULL)"""


@query(
    r"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY created_date DESC NULLS LAST, id DESC) AS rn, metadata->>'$.updated' AS u FROM papers WHERE arxiv_id IS NOT NULL)
    SELECT arxiv_id AS id, 'Paper' AS label, title, metadata->>'$.doi' AS doi, created_date AS published, CASE WHEN regexp_matches(u, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(u AS DATE) WHEN regexp_matches(split_part(u, 'T', 1), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(split_part(u, 'T', 1) AS DATE) END AS updated,
    metadata->>'$.abstract' AS summary, 'https://arxiv.org/pdf/' || arxiv_id AS url FROM p WHERE rn = 1
    UNION ALL SELECT DISTINCT x, 'Author', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(normalized_authors) AS x FROM papers) WHERE x IS NOT NULL AND x <> ''
    UNION ALL SELECT DISTINCT x, 'Category', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(string_split(metadata->>'$.categories', ' ')) AS x FROM papers) WHERE x IS NOT NULL AND x <> ''"""
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


@query(
    f"""WITH {_SQL_PAPERS}, e AS (SELECT DISTINCT k.chunk_paper_id AS src, c.arxiv_id AS dst FROM chunks k JOIN citations c USING (chunk_seq) WHERE c.arxiv_id IS NOT NULL AND k.chunk_paper_id IS NOT NULL AND k.chunk_paper_id <> c.arxiv_id)
    SELECT DISTINCT x AS src, id AS dst, 'WROTE' AS type FROM (SELECT id, unnest(a) AS x FROM p) WHERE x IS NOT NULL AND x <> id
    UNION ALL SELECT DISTINCT id, x, 'IN_CATEGORY' FROM (SELECT id, unnest(c) AS x FROM p) WHERE x IS NOT NULL AND x <> id
    UNION ALL SELECT src, dst, 'CITES' FROM e WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)"""
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query(
    """SELECT src, dst, type FROM (SELECT DISTINCT chunk_paper_id AS src, chunk_id AS dst, 'HAS_CHUNK' AS type FROM chunks WHERE chunk_paper_id IS NOT NULL)
    UNION ALL SELECT DISTINCT k.chunk_id, c.arxiv_id, 'CITES' FROM chunks k JOIN citations c USING (chunk_seq) WHERE c.arxiv_id IS NOT NULL"""
)
def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_seq", "chunk_paper_id", "chunk_id")
    has = graph.edges(chunks, F.col("chunk_paper_id"), F.col("chunk_id"), "HAS_CHUNK")
    cites = graph.edges(chunks.join(table(spark, d, "citations").select("chunk_seq", "arxiv_id"), "chunk_seq"), F.col("chunk_id"), F.col("arxiv_id"), "CITES")
    return has.unionByName(cites)


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
    SELECT src, dst, 'SIMILAR_TO' AS type, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM p) WHERE r <= 5 AND s >= 0"""
)
def similar_to_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.similar_edges(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query()
def concept_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.concept_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


# --- sources and streams (S7, A5, R1, R2) --------------------------------------------------------------------------


@query("SELECT event_id, event_id % 7 <> 0 AS good FROM events WHERE props IS NOT NULL")
def ndjson_permissive(spark: SparkSession, d: str) -> DataFrame:
    """Good and malformed lines of events.props; every seventh line is broken on purpose."""
    from scholia.sources.files import parse_lines

    line = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    good, bad = parse_lines(table(spark, d, "events").select("event_id", line.alias("line")), "line", "a string")
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@query("SELECT DISTINCT user_id, 1::BIGINT AS n FROM events WHERE user_id IS NOT NULL")
def stream_dedup_append(spark: SparkSession, d: str) -> DataFrame:
    """One event of every user, by a stream over the whole table that stops when it's read; n counts what was kept."""
    from scholia.session import scratch_path
    from scholia.streaming.ingest import append_unseen, run_available

    source = table(spark, d, "events").select("event_id", "user_id")
    folder = scratch_path(spark, "events")
    source.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    target = scratch_path(spark, "stream")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run_available(stream, append_unseen(target, "user_id", F.col("event_id")), scratch_path(spark, "offsets"))
    made = spark.read.option("basePath", target).parquet(target)
    return made.groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    r"""SELECT id, coalesce(nullif(title, ''), 'Untitled') AS title, citations, substring(regexp_replace(coalesce(nullif(title, ''), 'Untitled'), '[<>:"/\\|?*]', '', 'g'), 1, 100) || '.pdf' AS filename, arxiv_id FROM works WHERE pdf_url <> ''"""
)
def works_payload(spark: SparkSession, d: str) -> DataFrame:
    """Works from payloads of the paged source's shape, with a second location that doesn't count."""
    from scholia.sources.works_api import SOURCE_ID, works

    place = lambda source, url: F.struct(F.struct(F.lit(source).alias("id")).alias("source"), url.alias("pdf_url"))
    places = F.array(place("https://x.example/S1", F.lit("other")), place(f"https://x.example/{SOURCE_ID}", F.col("pdf_url")))
    raw = F.struct("id", "title", F.lit("").alias("display_name"), F.col("citations").alias("cited_by_count"), F.struct(F.col("arxiv_id").alias("arxiv")).alias("ids"), places.alias("locations"))
    return works(table(spark, d, "works").select(F.to_json(raw).alias("payload"))).select("id", "title", "citations", "filename", "arxiv_id")


def _xml(text):
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(
    r"""WITH c AS (SELECT chunk_paper_id, chunk_seq, trim(regexp_replace(coalesce(section_title, ''), '\s+', ' ', 'g')) AS t, trim(regexp_replace(chunk_text, '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS x FROM chunks)
    SELECT chunk_paper_id, row_number() OVER (PARTITION BY chunk_paper_id ORDER BY chunk_seq) - 1 AS pos, t AS section_title, sha256(x) AS checksum FROM c"""
)
def tei_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a paper's TEI, which is made of its chunks."""
    from scholia.sources.tei import section_table

    c = F.col
    div = F.concat(F.lit("<div><head>"), _xml(c("section_title")), F.lit("</head><p>"), _xml(c("chunk_text")), F.lit("</p></div>"))
    papers = table(spark, d, "chunks").groupBy("chunk_paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", div.alias("x")))).alias("l"))
    tei = papers.select("chunk_paper_id", F.concat(F.lit("<TEI><text><body>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</body></text></TEI>")).alias("tei"))
    return section_table(tei, "chunk_paper_id").select("chunk_paper_id", c("pos").cast("long").alias("pos"), "section_title", X.checksum("section_text").alias("checksum"))


@query(
    r"""SELECT chunk_seq, row_number() OVER (PARTITION BY chunk_seq ORDER BY citation_id)::INT AS id, trim(regexp_replace(coalesce(title, ''), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS title, NULL::VARCHAR AS error FROM citations WHERE chunk_seq IS NOT NULL"""
)
def tei_references(spark: SparkSession, d: str) -> DataFrame:
    """C20: references of a chunk's TEI, which is made of its citations."""
    from scholia.sources.tei import reference_table

    people = F.array_join(F.transform(F.coalesce("authors_str", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><persName><surname>"), _xml(a), F.lit("</surname></persName></author>"))), "")
    item = F.concat(F.lit("<biblStruct><analytic><title>"), _xml(F.col("title")), F.lit("</title>"), people, F.lit("</analytic></biblStruct>"))
    lists = table(spark, d, "citations").groupBy("chunk_seq").agg(F.array_sort(F.collect_list(F.struct("citation_id", item.alias("x")))).alias("l"))
    tei = lists.select("chunk_seq", F.concat(F.lit("<TEI><listBibl>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</listBibl></TEI>")).alias("tei"))
    return reference_table(tei, "chunk_seq").select("chunk_seq", "id", "title", "error")


@query()
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """V7: ranks by words and by vectors of the text of chunks, fused; queries are the works whose number is divisible by 100."""
    asked = table(spark, d, "works").filter(F.col("title").isNotNull() & (F.substring("id", 2, 20).cast("long") % 100 == 0)).select(F.substring("id", 2, 20).cast("long").alias("query_id"), F.col("title").alias("text"))
    texts = _texts(spark, d)
    words = vectors.bm25(texts, "id", "chunk_text", asked)
    stored = vectors.embed(texts.withColumnRenamed("id", "vec_id"), F.col("chunk_text")).select("vec_id", "vector")
    near = vectors.cosine_topk(vectors.embed(asked, F.col("text")).select("query_id", "vector"), stored, 10)
    return vectors.fuse_ranks(words, near.select("query_id", F.col("vec_id").alias("id"), "rank"), "id")


@query(
    """WITH l AS (SELECT arxiv_id AS paper_id, coalesce(metadata->>'$.updated', '') AS updated, row_number() OVER (PARTITION BY arxiv_id ORDER BY id DESC) AS rn FROM papers WHERE arxiv_id IS NOT NULL),
    c AS (SELECT chunk_paper_id AS paper_id, count(*) AS n FROM chunks GROUP BY 1), r AS (SELECT k.chunk_paper_id AS paper_id, count(DISTINCT (c.arxiv_id, c.title)) AS n FROM citations c JOIN chunks k USING (chunk_seq) GROUP BY 1)
    SELECT l.paper_id, l.updated, coalesce(c.n, 0)::INT AS n_chunks, coalesce(r.n, 0)::INT AS n_references FROM l LEFT JOIN c USING (paper_id) LEFT JOIN r USING (paper_id) WHERE rn = 1"""
)
def paper_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents of papers with their chunks and references; flattened to counts."""
    from scholia.plans import pipelines

    latest = cat.first_per_key(table(spark, d, "papers").select(F.col("arxiv_id").alias("paper_id"), "title", "id", F.get_json_object("metadata", "$.updated").alias("updated")).filter("paper_id IS NOT NULL"), "paper_id", [F.desc("id")])
    chunks = table(spark, d, "chunks").select(F.col("chunk_paper_id").alias("paper_id"), "chunk_seq", "chunk_num", "chunk_text", "checksum")
    refs = table(spark, d, "citations").join(chunks.select("chunk_seq", "paper_id"), "chunk_seq").select("paper_id", "arxiv_id", "title")
    made = pipelines.paper_documents(latest.drop("id"), chunks.drop("chunk_seq"), refs)
    return made.select("paper_id", "updated", F.coalesce(F.size("chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.size("references"), F.lit(0)).alias("n_references"))


@query()
def enrich_papers(spark: SparkSession, d: str) -> DataFrame:
    """TEI -> sections, references and bibliography -> style -> markers or authors -> chunks with citations.

    A paper's TEI is made of its chunks and of their citations, numbered in order.
    """
    from scholia.plans import pipelines
    from scholia.session import materialize
    from scholia.sources.tei import bibliography_table, reference_table, section_table

    c = F.col
    div = F.concat(F.lit("<div><head>"), _xml(c("section_title")), F.lit("</head><p>"), _xml(c("chunk_text")), F.lit("</p></div>"))
    person = lambda a: F.concat(F.lit("<author><persName><surname>"), _xml(a), F.lit("</surname></persName></author>"))
    people = F.array_join(F.transform(F.coalesce("authors_str", F.array().cast("array<string>")), person), "")
    entry = F.concat(F.lit("<biblStruct><analytic><title>"), _xml(c("title")), F.lit("</title>"), people, F.lit("</analytic></biblStruct>"))
    chunks, cites = table(spark, d, "chunks").filter("chunk_paper_id IS NOT NULL"), table(spark, d, "citations")
    one = lambda rows, order, x: rows.groupBy("chunk_paper_id").agg(F.array_sort(F.collect_list(F.struct(order, x.alias("x")))).alias("l"))
    joined = lambda rows, name: rows.select("chunk_paper_id", F.array_join(F.transform("l", lambda i: i["x"]), "").alias(name))
    bodies = joined(one(chunks, "chunk_seq", div), "body")
    lists = joined(one(cites.join(chunks.select("chunk_seq", "chunk_paper_id"), "chunk_seq"), "citation_id", entry), "list")
    text = F.concat(F.lit("<TEI><text><body>"), c("body"), F.lit("</body><back><listBibl>"), F.coalesce("list", F.lit("")), F.lit("</listBibl></back></text></TEI>"))
    tei = materialize(bodies.join(lists, "chunk_paper_id", "left").select(c("chunk_paper_id").alias("paper_id"), text.alias("tei")), "tei")
    sections = materialize(section_table(tei, "paper_id"), "sections")
    found = reference_table(tei, "paper_id").filter("error IS NULL")
    refs = found.select("paper_id", F.concat_ws("#", "paper_id", F.lpad(c("id").cast("string"), 6, "0")).alias("query_id"), "title", c("authors_teiled").alias("authors"), c("id").alias("number"), "raw")
    catalog = table(spark, d, "papers").select("id", "arxiv_id", "title", X.glue(X.normalize_text("title")).alias("glued"), c("normalized_authors").alias("authors"), "created_date", "citation_count")
    made = pipelines.enrich_papers(sections, materialize(refs, "refs"), materialize(catalog, "catalog"), bibliography_table(tei, "paper_id"))
    cited = F.transform(F.coalesce("citations", F.array().cast("array<struct<arxiv_id:string,title:string,citation_count:int>>")), lambda x: x["arxiv_id"])
    return made.select("paper_id", "chunk_num", "section_title", "token_len", "checksum", "uses_markers", "is_citation_context", cited.alias("cited"))
