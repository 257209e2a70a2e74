"""Queries of codes, registries, dates, versions, names, filters and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import codes, keywords
from quarry.operators import filters, index, tables

from .registry import CODES, SPLICED, digits, query, rows, table

FAMILY = f"CASE WHEN regexp_matches(code, '{codes.CDM}') THEN 'CDM' WHEN regexp_matches(code, '{codes.VCS}') THEN 'VCS' WHEN regexp_matches(code, '{codes.GS}') THEN 'GS' ELSE 'OTHER' END"


@query("F01_code_family", f"SELECT p_partkey, {FAMILY} AS family FROM ({CODES})")
def code_family(spark, sf_dir):
    return rows(spark, sf_dir, CODES).select("p_partkey", codes.family(F.col("code")).alias("family"))


INFER = "CASE WHEN code LIKE 'AM%' OR code LIKE 'ACM%' OR code LIKE 'AR%' THEN 'CDM' WHEN code LIKE 'VM%' THEN 'VCS' WHEN code LIKE 'TPDDTEC%' OR code LIKE 'GS%' OR regexp_matches(code, '^[0-9]+$') OR contains(code, '-') THEN 'GS' ELSE '' END"
GIVEN = "CASE WHEN p_size % 4 = 0 THEN 'VCS' WHEN p_size % 4 = 1 THEN '' ELSE NULL END"


@query("Q02_registry_inference", f"SELECT p_partkey, coalesce(nullif({GIVEN}, ''), {INFER}) AS registry FROM ({CODES})")
def registry_inference(spark, sf_dir):
    return rows(spark, sf_dir, CODES).select("p_partkey", codes.registry(F.col("code"), F.expr(GIVEN)).alias("registry"))


# A project of each market segment; codes listed with the standards of a third of them.
PROJECTS = "SELECT DISTINCT o_orderpriority AS project, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'GS' WHEN '2' THEN 'VCS' WHEN '3' THEN '' ELSE 'GS' END AS registry, CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN 'large' ELSE 'small' END AS scale FROM orders"
LISTED = f"SELECT code, CASE WHEN min(p_size) % 3 = 0 THEN 'GS' WHEN min(p_size) % 3 = 1 THEN 'VCS' ELSE 'CDM' END AS standard FROM ({CODES}) GROUP BY code"
KEEP = f"(registry = '' OR (registry = 'GS' AND ({FAMILY} IN ('GS', 'CDM') OR standard = 'GS')) OR (registry = 'VCS' AND ({FAMILY} IN ('VCS', 'CDM') OR standard = 'VCS')))"


@query("F02_registry_keep", f"SELECT project, CAST(count(*) AS BIGINT) AS n, min(code) AS first, max(code) AS last FROM ({PROJECTS}), ({LISTED}) WHERE {KEEP} GROUP BY project")
def registry_keep(spark, sf_dir):
    kept = filters.registry_keep(rows(spark, sf_dir, PROJECTS), rows(spark, sf_dir, LISTED))
    return kept.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("first"), F.max("code").alias("last"))


@query("F03_scale_exclusion", f"SELECT project, CAST(count(*) AS BIGINT) AS n FROM ({PROJECTS}), ({LISTED}) WHERE NOT (scale = 'large' AND code LIKE 'AMS-%') GROUP BY project")
def scale_exclusion(spark, sf_dir):
    pairs = filters.pairs(rows(spark, sf_dir, PROJECTS), rows(spark, sf_dir, LISTED))
    return pairs.where(filters.scale_fits(F.col("scale"), F.col("code"))).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


# Versions of a part: one a year in which it was shipped, the last of even parts open.
VERSIONS = """SELECT l_partkey AS code, CAST(min(l_shipdate) AS DATE) AS ef,
  CASE WHEN l_partkey % 2 = 0 AND year(l_shipdate) >= 1997 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) END AS et,
  CASE WHEN l_partkey % 11 = 0 THEN 'Withdrawn' ELSE 'Active' END AS status
FROM lineitem GROUP BY l_partkey, year(l_shipdate)"""
DATED = "SELECT o_orderkey AS gid, CAST(o_orderdate AS DATE) AS d, o_orderkey % 500 + 1 AS code FROM orders"


@query("F04_conservative_validity", f"SELECT gid, coalesce(status = 'Withdrawn', FALSE) OR coalesce(ended, FALSE) AS invalid FROM ({DATED}) q LEFT JOIN (SELECT code c, max(status) status, max(coalesce(et, DATE '9999-12-31')) last FROM ({VERSIONS}) GROUP BY 1) v ON v.c = q.code CROSS JOIN LATERAL (SELECT last < d AS ended)")
def conservative(spark, sf_dir):
    return filters.invalid_at(rows(spark, sf_dir, DATED), rows(spark, sf_dir, VERSIONS)).select("gid", "invalid")


@query("F05_strict_validity", f"SELECT gid, (NOT EXISTS (SELECT 1 FROM v WHERE v.code = q.code)) OR EXISTS (SELECT 1 FROM v WHERE v.code = q.code AND d BETWEEN coalesce(ef, DATE '1900-01-01') AND coalesce(et, DATE '2099-12-31')) AS valid FROM ({DATED}) q".replace("SELECT gid", f"WITH v AS ({VERSIONS}) SELECT gid", 1))
def strict(spark, sf_dir):
    return filters.valid_at(rows(spark, sf_dir, DATED), rows(spark, sf_dir, VERSIONS)).select("gid", "valid")


# A project of each customer; codes with standards, a status, the latest end of their versions and scopes.
STARTED = """SELECT c_custkey AS project, CASE c_custkey % 4 WHEN 0 THEN 'GS' WHEN 1 THEN 'VCS' WHEN 2 THEN '' ELSE NULL END AS registry,
  CASE WHEN c_custkey % 9 > 0 THEN make_date(CAST(1992 + c_custkey % 9 AS INT), 6, 1) END AS start, CASE c_custkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'Large' ELSE NULL END AS scale,
  CASE WHEN c_custkey % 16 = 0 THEN '' ELSE concat(lpad(CAST(c_custkey % 16 AS STRING), 2, '0'), '-scope') END AS scope FROM customer"""
SPACE = f"""SELECT code, split(CASE min(p_size) % 3 WHEN 0 THEN 'GS' WHEN 1 THEN 'CDM,VCS' ELSE 'CDM' END, ',') AS standards, CASE WHEN min(p_partkey) % 11 = 0 THEN 'Withdrawn' ELSE 'Active' END AS status,
  CASE WHEN min(p_partkey) % 5 = 0 THEN NULL WHEN min(p_partkey) % 5 = 1 THEN DATE '9999-12-31' ELSE make_date(CAST(1992 + min(p_partkey) % 8 AS INT), 3, 1) END AS last,
  split(concat(CAST(min(p_size) % 15 + 1 AS STRING), ',', CAST(max(p_size) % 15 + 1 AS STRING)), ',') AS scopes FROM ({CODES}) GROUP BY code"""


@query(
    "F06_allow_list",
    f"""WITH p AS ({STARTED}), s AS ({SPACE}), f AS (SELECT project, coalesce(registry, '') NOT IN ('GS', 'VCS') OR {FAMILY} IN (registry, 'CDM') OR list_contains(standards, registry) AS a,
      start IS NULL OR NOT (status = 'Withdrawn' OR coalesce(last < start, FALSE)) AS b, NOT (lower(coalesce(scale, '')) = 'large' AND code LIKE 'AMS-%') AS c,
      scope <> '' AND list_contains(scopes, CAST(TRY_CAST(substr(scope, 1, 2) AS INT) AS STRING)) AS d FROM p, s)
    SELECT project, CAST(count(*) AS BIGINT) AS n_all, CAST(count_if(a) AS BIGINT) AS n_registry, CAST(count_if(a AND b) AS BIGINT) AS n_date, CAST(count_if(a AND b AND c) AS BIGINT) AS n_scale, CAST(count_if(a AND b AND c AND d) AS BIGINT) AS n_boosted FROM f GROUP BY project""",
)
def allow_list(spark, sf_dir):
    return filters.staged(rows(spark, sf_dir, STARTED), rows(spark, sf_dir, SPACE), dated=True).select("project", "n_all", "n_registry", "n_date", "n_scale", "n_boosted")


def words_of(values: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', '{w}')" for k, v in values.items() for w in v)


def pick(values: list[str], n: str) -> str:
    return "CASE CAST(" + n + f" % {len(values)} AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


# A candidate of each document: its text with a code and three keywords in it, beside a project's features.
SAID_WORDS = [w for v in (keywords.SCOPES | keywords.TECHNOLOGIES | keywords.GASES).values() for w in v]
CANDIDATES = f"""SELECT doc_id, code, concat(text, ' ', {pick([*SAID_WORDS, 'small-scale', 'tidal'], 'doc_id')}, ' ', {pick(SAID_WORDS, '(doc_id * 7)')}, '. ', upper({pick([*SAID_WORDS, 'NF3'], '(doc_id * 11)')})) AS text,
  CASE doc_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'large' ELSE NULL END AS scale, {pick([*keywords.SCOPES, '06-construction', ''], '(doc_id * 5)')} AS scope,
  {pick([*keywords.TECHNOLOGIES, 'Tidal', ''], '(doc_id * 3)')} AS technology, split(concat({pick([*keywords.GASES, 'NF3'], 'doc_id')}, ',', {pick(list(keywords.GASES), '(doc_id * 5)')}), ',') AS gases FROM ({SPLICED})"""
HAS = "EXISTS (SELECT 1 FROM (VALUES {0}) k(key, word) WHERE key = {1} AND contains(low, lower(word)))"
MATCHES = f"""SELECT *, coalesce(CASE scale WHEN 'small' THEN code LIKE 'AMS-%' OR contains(low, 'small-scale') WHEN 'large' THEN code NOT LIKE 'AMS-%' END, FALSE) AS fits_scale, {HAS.format(words_of(keywords.SCOPES), 'scope')} AS fits_scope,
  {HAS.format(words_of(keywords.TECHNOLOGIES), 'technology')} OR (technology = 'Tidal' AND contains(low, 'tidal')) AS fits_technology,
  {HAS.format(words_of(keywords.GASES), 'gases[1]')} OR {HAS.format(words_of(keywords.GASES), 'gases[2]')} OR (gases[1] = 'NF3' AND contains(low, 'nf3')) AS fits_ghg FROM (SELECT *, lower(text) AS low FROM ({CANDIDATES}))"""
COUNTED = f"SELECT *, CAST(fits_scale AS INT) + CAST(fits_scope AS INT) + CAST(fits_technology AS INT) + CAST(fits_ghg AS INT) AS n FROM ({MATCHES})"


@query("F08_keyword_flags", f"SELECT doc_id, fits_scale AS scale, fits_scope AS scope, fits_technology AS technology, fits_ghg AS ghg FROM ({MATCHES})")
def keyword_flags(spark, sf_dir):
    c = rows(spark, sf_dir, CANDIDATES)
    flags = keywords.matches(c.text, c.code, scale=c.scale, scope=c.scope, technology=c.technology, gases=c.gases)
    return c.select("doc_id", *[f.alias(k) for k, f in flags.items()])


@query("F09_match_count", f"SELECT doc_id, CAST(n AS BIGINT) AS match_count, coalesce(scale = 'large' AND code LIKE 'AMS-%', FALSE) AS excluded, CASE WHEN scale = 'large' AND code LIKE 'AMS-%' THEN 'scale=large but code is AMS-* (small-only)' ELSE '' END AS reasons FROM ({COUNTED})")
def match_count(spark, sf_dir):
    return filters.matched(rows(spark, sf_dir, CANDIDATES)).select("doc_id", "match_count", "excluded", F.array_join("reasons", "; ").alias("reasons"))


@query("A11_match_histogram", f"SELECT CAST(n AS BIGINT) AS match_count, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS share FROM ({COUNTED}) c GROUP BY c.n")
def histogram(spark, sf_dir):
    """Candidates and their share of all for each match count."""
    counts = filters.matched(rows(spark, sf_dir, CANDIDATES)).groupBy("match_count").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("match_count", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))  # one row


SAID = "SELECT l_orderkey AS gid, l_linenumber AS pos, l_suppkey % 40 AS code FROM lineitem"


@query("F11_label_validity", f"WITH s AS ({SAID}), f AS (SELECT gid, code, min(pos) pos FROM s WHERE code < 30 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY pos, code) rank FROM f) SELECT gid, code, CAST(rank AS INT) AS rank, round(1.0 / pos, 6) AS score FROM r WHERE rank <= 5")
def label_validity(spark, sf_dir):
    space = rows(spark, sf_dir, "SELECT DISTINCT s_suppkey % 40 AS code FROM supplier").where("code < 30")
    return filters.valid_labels(rows(spark, sf_dir, SAID), space, 5).select("gid", "code", "rank", F.round("score", 6).alias("score"))


@query("F12_nonempty", "SELECT CAST(count(*) AS BIGINT) AS n FROM conversations WHERE length(trim(text)) > 0")
def nonempty(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0).agg(F.count(F.lit(1)).alias("n"))


@query("F13_approved_gate", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> ''")
def approved(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority <> ''").select("o_orderkey")


FILES = """SELECT p_partkey, concat(CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'Project_Design_Document_' WHEN 1 THEN '123 PDD ' WHEN 2 THEN 'VCS_PD_' WHEN 3 THEN 'Monitoring Report ' WHEN 4 THEN 'VPA-DD ' WHEN 5 THEN 'Project Description ' ELSE 'Map ' END,
  CASE p_partkey % 5 WHEN 0 THEN 'Annual Report' ELSE p_name END, '_v', CAST(p_size AS STRING), '.pdf') AS name, p_size AS version, CAST(p_retailprice AS BIGINT) AS size, p_brand AS project FROM part"""


@query("F14_document_names")
def document_names(spark, sf_dir):
    return rows(spark, sf_dir, FILES).select("p_partkey", codes.name_rank(F.col("name")).alias("pattern"))


@query("T34_primary_document")
def primary_document(spark, sf_dir):
    """Best document of each brand: pattern, newest version, largest, first."""
    return tables.primary_document(rows(spark, sf_dir, FILES), "project", "p_partkey").select("project", "name", "pattern")


STAMPS = "SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) WHEN 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:00:00Z') WHEN 2 THEN CAST(year(o_orderdate) AS STRING) WHEN 3 THEN '' WHEN 4 THEN '2020-13-01' ELSE concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING)) END AS s FROM orders"


@query("D01_parse_date", f"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(s, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})($|[T ])', 1), '') AS DATE) AS d FROM ({STAMPS})")
def parse_date(spark, sf_dir):
    return rows(spark, sf_dir, STAMPS).select("o_orderkey", codes.parse_date(F.col("s")).alias("d"))


ROW_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no date' ELSE concat('Adopted ', CAST(day(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING), '.', CAST(year(o_orderdate) AS STRING), ' in force') END AS s FROM orders"
DMY = "\\b(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})\\b"


@query("D02_row_date", f"SELECT o_orderkey, CASE WHEN regexp_matches(s, '{DMY}') THEN concat(regexp_extract(s, '{DMY}', 3), '-', lpad(regexp_extract(s, '{DMY}', 2), 2, '0'), '-', lpad(regexp_extract(s, '{DMY}', 1), 2, '0')) ELSE '' END AS iso FROM ({ROW_DATES})")
def row_date(spark, sf_dir):
    return rows(spark, sf_dir, ROW_DATES).select("o_orderkey", codes.row_date(F.col("s")).alias("iso"))


VERS = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'draft' ELSE concat(CAST(p_size % 4 AS STRING), '.', CAST(p_size AS STRING)) END AS v FROM part"


@query("D03_version_key", f"SELECT p_partkey, array_to_string(CASE WHEN len(list_filter(split(v, '.'), lambda x: TRY_CAST(x AS INT) IS NULL)) = 0 THEN list_transform(split(v, '.'), lambda x: CAST(x AS INT)) ELSE [0] END, ',') AS k FROM ({VERS})")
def version_key(spark, sf_dir):
    return rows(spark, sf_dir, VERS).select("p_partkey", F.array_join(codes.version_key(F.col("v")).cast("array<string>"), ",").alias("k"))


SCOPES = "SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN CAST(p_size % 20 AS STRING) WHEN 1 THEN concat('0', CAST(p_size % 10 AS STRING), ' - x') WHEN 2 THEN 'Scope Transport' WHEN 3 THEN 'waste-handling and disposal' ELSE 'none' END AS raw FROM part"
SCOPE_MAP = "MAP {" + ", ".join(f"'{n}': '{n}-{s}'" for n, s in codes.SCOPES.items()) + "}"
SCOPE_NAMES = " ".join(f"WHEN contains(s, '{name}') THEN '{n}-{name}'" for n, name in codes.SCOPES.items())


@query("D05_sectoral_scope", f"SELECT p_partkey, coalesce(({SCOPE_MAP})[lpad(regexp_extract(s, '^0?(\\d{{1,2}})[-_\\s]*(.*)$', 1), 2, '0')], CASE {SCOPE_NAMES} ELSE '' END) AS scope FROM (SELECT p_partkey, lower(trim(raw)) s FROM ({SCOPES}))")
def sectoral_scope(spark, sf_dir):
    return rows(spark, sf_dir, SCOPES).select("p_partkey", codes.scope(F.col("raw")).alias("scope"))


RAW = "SELECT c_custkey, concat(' ', c_mktsegment, '  plant ') AS tech, substr(c_name, 1, CAST(c_custkey % 5 AS INT)) AS iso, CASE WHEN c_custkey % 3 = 0 THEN 'Small ' WHEN c_custkey % 3 = 1 THEN 'LARGE' ELSE 'medium' END AS scale FROM customer"


@query("D06_feature_validation", f"SELECT c_custkey, left(regexp_replace(lower(trim(tech)), '\\s+', '-', 'g'), 80) AS technology, CASE WHEN regexp_matches(upper(trim(iso)), '^[A-Z]{{2,3}}$') THEN upper(trim(iso)) ELSE '' END AS country, CASE WHEN lower(trim(scale)) IN ('small', 'large') THEN lower(trim(scale)) ELSE 'unknown' END AS scale FROM ({RAW})")
def feature_validation(spark, sf_dir):
    c = F.col
    return rows(spark, sf_dir, RAW).select("c_custkey", codes.technology(c("tech")).alias("technology"), codes.country(c("iso")).alias("country"), codes.scale(c("scale")).alias("scale"))


LABELS = f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat('| ', p_name, ' | version 2.1') WHEN p_partkey % 7 = 1 THEN '' ELSE concat(p_name, ' ', code, ' rest') END AS label FROM ({CODES})"
NORMAL = "regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({0}, '\\s+', '', 'g')), '^AMS([IVX]+)', 'AMS-\\1'), '^ARAMS([IVX]+)', 'AR-AMS-\\1'), '^ARAM(\\d)', 'AR-AM\\1')"
LABEL_CASE = " ".join(f"WHEN regexp_matches(label, '{p}') THEN " + NORMAL.format(f"regexp_extract(label, '{p}')") for p, _ in codes.LABEL_CODES)
OWNER_CASE = " ".join(f"WHEN regexp_matches(label, '{p}') THEN '{r}'" for p, r in codes.LABEL_CODES)


@query("D07_canonical_code", f"SELECT p_partkey, CASE WHEN label = '' THEN 'Unknown' {OWNER_CASE} ELSE 'GS-native' END AS registry, CASE WHEN label = '' THEN '' {LABEL_CASE} ELSE lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(label, '^\\s*[|\\-\\s]+', ''), '\\s*\\|\\s*', ' ', 'g')), '(?i)\\s+(?:version|v\\.?\\s*)\\s*\\d+(?:\\.\\d+)?\\s*$', ''))) END AS code FROM ({LABELS})")
def canonical(spark, sf_dir):
    return rows(spark, sf_dir, LABELS).select("p_partkey", codes.canonical(F.col("label")).alias("x")).select("p_partkey", "x.registry", "x.code")


HREFS = f"SELECT p_partkey, concat('https://h.example/docs/', CASE WHEN p_partkey % 4 = 0 THEN concat('plain-file_', CAST(p_size AS STRING)) ELSE concat({digits('p_partkey % 900', 3)}, '_V', CAST(p_size % 9 AS STRING), '.', CAST(p_size % 3 AS STRING), '_PAR_some-title_', CAST(p_size AS STRING)) END, '.pdf?x=1') AS href FROM part"
SF = "(?i)^([A-Za-z0-9.\\-]+?)_V([\\d.]+)_(.+?)\\.pdf$"


@query("D08_standards_file", f"SELECT p_partkey, regexp_extract(name, '{SF}', 1) AS code, regexp_extract(name, '{SF}', 2) AS version, CASE WHEN contains(regexp_extract(name, '{SF}', 3), '_') THEN split_part(regexp_extract(name, '{SF}', 3), '_', 1) ELSE '' END AS tag FROM (SELECT p_partkey, split_part(split_part(href, '/', -1), '?', 1) name FROM ({HREFS}))")
def standards_file(spark, sf_dir):
    return rows(spark, sf_dir, HREFS).select("p_partkey", codes.standards_file(F.col("href")).alias("x")).select("p_partkey", "x.code", "x.version", "x.tag")


CAT = "SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' Ver 02.0 Note: old' WHEN p_partkey % 3 = 1 THEN concat(' CDM-EB', CAST(p_size AS STRING), '-A07-TOOL Ver3.1') ELSE '' END) AS row_text FROM part"


@query("D09_catalog_row", f"SELECT p_partkey, regexp_extract(row_text, '\\b(CDM-EB\\d+-A\\d+-[A-Z]+)\\b', 1) AS code, regexp_extract(row_text, '(?i)\\bVer\\s*([\\d.]+)', 1) AS version, CASE WHEN p_partkey % 3 = 2 THEN row_text ELSE p_name END AS title FROM (SELECT r.*, p_name FROM ({CAT}) r JOIN part USING (p_partkey))")
def catalog_row(spark, sf_dir):
    return rows(spark, sf_dir, CAT).select("p_partkey", codes.catalog_row(F.col("row_text")).alias("x")).select("p_partkey", "x.code", "x.version", "x.title")


TYPES = "SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Standards' WHEN 1 THEN 'Procedures list' WHEN 2 THEN 'Clarifications' WHEN 3 THEN 'Core Document - Guideline' ELSE 'Optional form' END AS s FROM part"


@query("D10_document_type", f"SELECT p_partkey, CASE WHEN contains(lower(s), 'standard') THEN 'standard' WHEN contains(lower(s), 'procedure') THEN 'procedure' WHEN contains(lower(s), 'guideline') OR contains(lower(s), 'clarif') THEN 'guideline' ELSE '' END AS by_section, CASE WHEN contains(lower(s), 'optional') THEN 'optional' WHEN contains(lower(s), 'core document') THEN 'core' WHEN contains(lower(s), 'guideline') THEN 'guideline' WHEN contains(lower(s), 'procedure') THEN 'procedure' ELSE '' END AS by_row FROM ({TYPES})")
def document_type(spark, sf_dir):
    return rows(spark, sf_dir, TYPES).select("p_partkey", codes.section_type(F.col("s")).alias("by_section"), codes.row_type(F.col("s")).alias("by_row"))


LINK = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_name, ', v', CAST(p_size % 5 AS STRING), '.0') END AS label FROM part"


@query("D11_link_label", f"SELECT p_partkey, base AS title, regexp_extract(label, '(?i)^(.*?)[,\\s]+v\\.?\\s*([\\d.]+)\\s*$', 2) AS version, regexp_replace(regexp_replace(base, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN label ELSE regexp_extract(label, '^(.*), v[0-9.]+$', 1) END AS base FROM ({LINK}))")
def link_label(spark, sf_dir):
    return rows(spark, sf_dir, LINK).select("p_partkey", codes.link_label(F.col("label")).alias("x")).select("p_partkey", "x.title", "x.version", "x.slug")


@query("D12_url_prefix", "SELECT page_id, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS prefix, regexp_extract(url, '/([0-9]+)', 1) AS slug FROM pages")
def url_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1).alias("prefix"), F.regexp_extract("url", "/([0-9]+)", 1).alias("slug"))


ISO = "[" + ", ".join(f"'{c}'" for v in codes.REGIONS.values() for c in v.split()) + ", 'XXX']"
PEOPLE = "SELECT c_custkey, {0}[CAST(c_custkey % 95 AS INT) + {1}] AS iso FROM customer"
REGION_CASE = " ".join(f"WHEN iso IN ({', '.join(repr(c) for c in v.split())}) THEN '{k}'" for k, v in codes.REGIONS.items())


@query("D13_region", f"SELECT c_custkey, CASE {REGION_CASE} ELSE 'other' END AS region FROM ({PEOPLE.format(ISO, 1)})")
def region(spark, sf_dir):
    return rows(spark, sf_dir, PEOPLE.format("array(" + ISO[1:-1] + ")", 0)).select("c_custkey", codes.region(F.col("iso")).alias("region"))


@query("D14_least_developed", f"SELECT c_custkey, coalesce(iso IN ({', '.join(repr(c) for c in codes.LDC)}), FALSE) AS ldc FROM ({PEOPLE.format(ISO, 1)})")
def least_developed(spark, sf_dir):
    return rows(spark, sf_dir, PEOPLE.format("array(" + ISO[1:-1] + ")", 0)).select("c_custkey", codes.least_developed(F.col("iso")).alias("ldc"))


TITLES = f"SELECT p_partkey, code, concat(p_name, CASE CAST(p_size % 10 AS INT) WHEN 0 THEN ' Landfill gas' WHEN 1 THEN ' grid-connected wind' WHEN 2 THEN ' rice fields' WHEN 3 THEN ' manure' WHEN 4 THEN ' LED lamps' WHEN 5 THEN ' cookstoves' WHEN 6 THEN ' displacement' WHEN 7 THEN ' cement kiln' ELSE '' END) AS title FROM ({CODES})"
GROUPS = " ".join(f"WHEN regexp_matches({'code' if k == 'code' else 'lower(title)'}, '(?i){p}') THEN '{g}/{r}'" for r, g, k, p in codes.GROUP_RULES)


@query("D15_group_rules", f"SELECT p_partkey, CASE {GROUPS} END AS found FROM ({TITLES})")
def group_rules(spark, sf_dir):
    return rows(spark, sf_dir, TITLES).select("p_partkey", codes.group(F.col("code"), F.col("title")).alias("x")).select("p_partkey", F.concat("x.group_id", F.lit("/"), "x.rule_id").alias("found"))


HEADERS = "SELECT p_partkey, concat(p_name, CASE CAST(p_size % 4 AS INT) WHEN 0 THEN ' Small-scale Sectoral scope(s): 07' WHEN 1 THEN ' large scale' WHEN 2 THEN ' large-scale small scale sectoral scope(s): 13' ELSE '' END) AS header FROM part"


@query("D16_header_anchors", f"SELECT p_partkey, CASE WHEN regexp_matches(header, '(?i)small[- ]scale') THEN 'small' WHEN regexp_matches(header, '(?i)large[- ]scale') THEN 'large' END AS scale, nullif(regexp_extract(header, '[Ss]ectoral scope\\(s\\):\\s*0?(\\d{{1,2}})', 1), '') AS scope FROM ({HEADERS})")
def header_anchors(spark, sf_dir):
    return rows(spark, sf_dir, HEADERS).select("p_partkey", codes.header_scale(F.col("header")).alias("scale"), F.nullif(F.regexp_extract("header", r"[Ss]ectoral scope\(s\):\s*0?(\d{1,2})", 1), F.lit("")).alias("scope"))


@query("D17_registry_from_head", "SELECT doc_id, CASE WHEN contains(substr(text, 1, 4000), ' the ') THEN 'GS' WHEN contains(substr(text, 1, 4000), ' der ') THEN 'VCS' ELSE '' END AS registry FROM documents")
def registry_from_head(spark, sf_dir):
    head = F.substring("text", 1, 4000)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(head.contains(" the "), "GS").when(head.contains(" der "), "VCS").otherwise("").alias("registry"))


METHODS = f"SELECT code, min(p_name) AS title, max(p_type) AS typical, min(p_brand) AS b1, CASE WHEN min(p_size) % 2 = 0 THEN ' ' ELSE max(p_brand) END AS b2, max(p_name) AS b3, CASE WHEN min(p_size) % 3 = 0 THEN '' ELSE min(p_type) END AS baseline, CASE WHEN min(p_size) % 4 = 0 THEN 'VCS' ELSE NULL END AS registry FROM ({CODES}) GROUP BY code"


@query(
    "Q01_clause_explode",
    f"WITH m AS (SELECT *, coalesce(nullif(registry, ''), {INFER}) AS reg FROM ({METHODS})), c AS (SELECT concat(code, '-app-', CAST(i AS STRING)) clause_id, code, reg registry, 'applicability' clause_type, [b1, b2, b3][i] clause_text FROM m, range(1, 4) t(i) UNION ALL SELECT concat(code, '-title'), code, reg, 'title', title FROM m UNION ALL SELECT concat(code, '-typical'), code, reg, 'typical_projects', typical FROM m UNION ALL SELECT concat(code, '-parameters'), code, reg, 'parameters', concat(b1, ' | ', b3) FROM m UNION ALL SELECT concat(code, '-baseline'), code, reg, 'baseline_scenario', baseline FROM m) SELECT * FROM c WHERE trim(clause_text) <> ''",
)
def clause_explode(spark, sf_dir):
    m = rows(spark, sf_dir, METHODS).withColumns({"bullets": F.array("b1", "b2", "b3"), "parameters": F.array("b1", "b3")})
    return index.clauses(m)


@query("Q04_label_space", f"SELECT DISTINCT code FROM ({CODES})")
def label_space(spark, sf_dir):
    return rows(spark, sf_dir, CODES).select("code").distinct()


@query("Q05_first_registry", f"SELECT code, arg_min(p_brand, p_partkey) AS registry FROM ({CODES}) GROUP BY code")
def first_registry(spark, sf_dir):
    return rows(spark, sf_dir, CODES).groupBy("code").agg(F.min_by("p_brand", "p_partkey").alias("registry"))


@query("Q07_url_parts", "SELECT page_id, CASE WHEN contains(url, '?') THEN '' ELSE split_part(regexp_replace(split_part(url, '#', 1), '/+$', ''), '/', -1) END AS last FROM pages")
def url_parts(spark, sf_dir):
    last = F.element_at(F.split(F.regexp_replace(F.element_at(F.split("url", "#"), 1), "/+$", ""), "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").contains("?"), "").otherwise(last).alias("last"))


@query("Q08_version_lookup", f"SELECT o_orderkey, v.ef FROM orders o LEFT JOIN (SELECT code, min(ef) ef FROM ({VERSIONS}) GROUP BY code) v ON v.code = o.o_orderkey")
def version_lookup(spark, sf_dir):
    v = rows(spark, sf_dir, VERSIONS).groupBy("code").agg(F.min("ef").alias("ef"))
    return table(spark, sf_dir, "orders").join(v, F.col("code") == F.col("o_orderkey"), "left").select("o_orderkey", "ef")


MANY = "SELECT l_orderkey AS gid, l_linenumber AS pos, l_partkey AS code FROM lineitem"


@query("Q10_primary_label", f"SELECT gid, list(code ORDER BY pos, code)[1] AS first, CAST(count(*) - 1 AS BIGINT) AS others FROM ({MANY}) GROUP BY gid")
def primary_label(spark, sf_dir):
    got = rows(spark, sf_dir, MANY).groupBy("gid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("all"))
    return got.select("gid", F.try_element_at("all", F.lit(1)).alias("first"), F.size(F.slice("all", F.lit(2), F.size("all"))).cast("long").alias("others"))


@query("Q11_first_seen", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) n FROM lineitem) WHERE n = 1")
def first_seen(spark, sf_dir):
    return tables.first_seen(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey")


@query("Q12_last_wins_lookup", "SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def last_wins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("l_suppkey"))


@query("Q13_catalog_fan_out", f"SELECT code, coalesce(max(CASE WHEN status = 'Withdrawn' THEN NULL ELSE status END), 'Unknown') AS status, CAST(count(*) AS BIGINT) AS n_versions, CAST(count(et) AS BIGINT) AS n_ended FROM ({VERSIONS}) GROUP BY code")
def catalog_fan_out(spark, sf_dir):
    v = rows(spark, sf_dir, VERSIONS).withColumn("status", F.nullif("status", F.lit("Withdrawn")))
    return v.groupBy("code").agg(F.coalesce(F.max("status"), F.lit("Unknown")).alias("status"), F.count(F.lit(1)).alias("n_versions"), F.count("et").alias("n_ended"))


@query("Q14_result_subset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def result_subset(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")
