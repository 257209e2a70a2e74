"""Queries of text clean-up, redaction, sections, document types and landed HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalogue, sections, tables

from .registry import ORACLES, SPLICED, query, rows, table

TOC = "SELECT doc_id, concat('Contents ........... 3', chr(10), 'Chapter one .......... 12', chr(10), text) AS text FROM documents"
#: The pattern for an engine whose \\s also takes line ends; the lines here have none between dots and number.
TOC_SQL = "(?m)^[^\\n]*?\\.{8,} *\\d+ *$\\n?"


@query("T03_strip_toc", f"SELECT doc_id, md5(regexp_replace(text, '{TOC_SQL}', '', 'g')) AS digest FROM ({TOC})")
def strip_toc(spark, sf_dir):
    return rows(spark, sf_dir, TOC).select("doc_id", F.md5(T.strip_toc(F.col("text"))).alias("digest"))


PAGED = "SELECT doc_id, concat('Project Description: VCS Version 3.1 ', substr(text, 1, 300), ' <!-- page break --> ', substr(text, 301)) AS text FROM documents"


@query("T04_strip_headers", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{T.PAGE_HEADERS[0]}', '', 'g'), '{T.PAGE_HEADERS[1]}', '', 'g')) AS digest FROM ({PAGED})")
def strip_headers(spark, sf_dir):
    return rows(spark, sf_dir, PAGED).select("doc_id", F.md5(T.strip_headers(F.col("text"))).alias("digest"))


@query("T05_paragraphs", f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 30) p FROM ({SPLICED}))")
def paragraphs(spark, sf_dir):
    p = T.paragraphs(F.col("text"))
    return rows(spark, sf_dir, SPLICED).select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


@query("T06_paragraph_offsets")
def paragraph_offsets(spark, sf_dir):
    """Paragraphs with their places; short ones stay if they hold the mask."""
    p = F.split("text", r"\n\s*\n", -1)
    gaps = F.regexp_extract_all("text", F.lit(r"\n\s*\n"), F.lit(0))
    placed = F.aggregate(
        F.zip_with(p, F.concat(gaps, F.array(F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x["a"]) + F.length(x["b"])).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), x["a"].alias("value")))).alias("out")),
        lambda s: s["out"],
    )
    own = rows(spark, sf_dir, SPLICED).withColumn("text", T.mask_words(F.col("text")))
    return own.select("doc_id", F.explode(placed).alias("x")).select("doc_id", "x.start", "x.value").where((F.length(F.trim("value")) >= 30) | F.contains("value", F.lit(T.MASK))).select("doc_id", "start", F.md5("value").alias("digest"))


MASKED = "text"
for _, _p in T.REDACTION:
    MASKED = f"regexp_replace({MASKED}, '{_p}', '{T.MASK}', 'g')"


@query("T08_mask_words", f"SELECT doc_id, md5({MASKED}) AS digest FROM ({SPLICED})")
def mask_words(spark, sf_dir):
    return rows(spark, sf_dir, SPLICED).select("doc_id", F.md5(T.mask_words(F.col("text"))).alias("digest"))


COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS pattern, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n, CAST(count_if(regexp_matches(text, '{p}')) AS BIGINT) AS n_docs FROM s" for n, p in T.REDACTION)


@query("T07_redaction_patterns", f"WITH s AS ({SPLICED}) {COUNTS}")
def redaction_patterns(spark, sf_dir):
    """Occurrences and documents of each pattern."""
    m = rows(spark, sf_dir, SPLICED).select(F.explode(T.marks(F.col("text"))).alias("m"))
    return m.groupBy("m.pattern").agg(F.sum("m.n").alias("n"), F.count_if(F.col("m.n") > 0).alias("n_docs"))


def masked(spark, sf_dir):
    return rows(spark, sf_dir, SPLICED).withColumn("m", sections.mask_sentences("text"))


@query("T10_mask_sentences")
def mask_sentences(spark, sf_dir):
    """Sentence-level masking."""
    return masked(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.length("m.text").alias("n_masked"), F.size("m.spans").alias("n_spans"), F.size("m.marks").alias("n_marks"), F.md5("m.text").alias("digest"))


@query("T11_mask_paragraphs")
def mask_paragraphs(spark, sf_dir):
    """Each paragraph masked by itself, joined by blank lines."""
    p = rows(spark, sf_dir, SPLICED).select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p")).withColumn("m", sections.mask_sentences("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("m.text").alias("t")))), lambda x: x["t"]), "\n\n")
    return p.groupBy("doc_id").agg(F.md5(joined).alias("digest"), F.sum(F.size("m.marks")).alias("n_marks"))


SPANS = "SELECT l_partkey AS id, CAST(l_linenumber * 10 + l_quantity % 7 AS INT) AS s, CAST(l_linenumber * 10 + l_quantity AS INT) AS e FROM lineitem"


@query("T10_merge_spans", f"WITH x AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END n FROM ({SPANS})), y AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM x) SELECT id, min(s) AS start, max(e) AS \"end\" FROM y GROUP BY id, i")
def merge_spans(spark, sf_dir):
    return sections.merged_spans(rows(spark, sf_dir, SPANS).selectExpr("id", "s AS start", "e AS end"), "id")


ANY = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for _, p in T.REDACTION)


@query("T15_leakage_gate", f"SELECT doc_id, CAST((length(text) - length(replace(lower(text), lower(code), ''))) / length(code) AS BIGINT) AS code_leaks, CAST({ANY} AS BIGINT) AS any_codes FROM ({SPLICED})")
def leakage_gate(spark, sf_dir):
    return rows(spark, sf_dir, SPLICED).select("doc_id", sections.gate(F.col("text"), F.col("code")).alias("g")).select("doc_id", "g.code_leaks", "g.any_codes")


@query("T16_clean_evaluation")
def clean_evaluation(spark, sf_dir):
    """Section A or the first 16,000 signs, masked by sentence, gated, the literal code forced out."""
    own = sections.extract_section_a(rows(spark, sf_dir, COVERED)).withColumn("text", F.coalesce("section_text", F.substring("text", 1, 16000)))
    m = own.withColumn("m", sections.mask_sentences("text")).withColumn("clean", F.replace("m.text", F.col("code"), F.lit(T.MASK)))
    g = m.withColumn("g", sections.gate(F.col("clean"), F.col("code")))
    return g.select("doc_id", "status", F.length("clean").alias("n_chars"), F.col("clean").rlike(T.CAPACITY).alias("capacity"), "g.passes")


#: Documents under covers of every template, with sections A and B by line.
COVERED = """SELECT doc_id, concat('AM', lpad(CAST(doc_id % 100 AS STRING), 4, '0')) AS code, concat(CASE CAST(doc_id % 8 AS INT)
  WHEN 0 THEN concat('VPA Design Document', chr(10), 'SECTION A. Description', chr(10), substr(text, 1, 200), chr(10), 'SECTION B. Application', chr(10))
  WHEN 1 THEN concat('CDM-CPA-DD', chr(10), 'SECTION A.', chr(10), substr(text, 1, 150), chr(10), 'SECTION B.', chr(10))
  WHEN 2 THEN concat('CDM-SSC-PDD', chr(10), 'SECTION A. General description', chr(10), substr(text, 1, 100), chr(10), 'A.4. Technical', chr(10))
  WHEN 3 THEN concat('Project Description: VCS Version 3', chr(10), '1.1 Summary description of it', chr(10), substr(text, 1, 120), chr(10), '2.1 Application of methods here', chr(10))
  WHEN 4 THEN concat('SECTION A. One', chr(10), substr(text, 1, 80), chr(10), 'SECTION B. Two', chr(10))
  WHEN 5 THEN concat('1.2 Something', chr(10))
  WHEN 6 THEN concat('Gold Standard for the Global Goals', chr(10), 'SECTION A. Only', chr(10), substr(text, 1, 90), chr(10), 'Application of Methodology', chr(10))
  ELSE '' END, text) AS text FROM documents"""
TEMPLATE_CASE = " ".join(f"WHEN regexp_matches(left(text, 20000), '{p}') THEN '{n}'" for n, p in sections.TEMPLATES)


@query("T18_template", f"SELECT doc_id, CASE {TEMPLATE_CASE} WHEN regexp_matches(text, '{sections.SECTION_A}') AND regexp_matches(text, '{sections.SECTION_B}') THEN 'GS' WHEN regexp_matches(text, '{sections.NUMBERED}') THEN 'VCS-ProjectDesc' ELSE 'unknown' END AS template FROM ({COVERED})")
def template(spark, sf_dir):
    return rows(spark, sf_dir, COVERED).select("doc_id", sections.template(F.col("text")).alias("template"))


GAPPED = "SELECT doc_id, concat('SECTION A. one', chr(10), substr(text, 1, 60), chr(10), 'SECTION B. two', chr(10), 'SECTION A. three', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('SECTION B. four', chr(10)) END, 'end') AS text FROM documents"


@query(
    "J08_max_gap",
    f"SELECT doc_id, CAST(instr(text, 'SECTION A.') - 1 AS INT) AS start, CAST(length(text) - instr(reverse(text), '.B NOITCES') - 9 AS INT) AS \"end\" FROM ({GAPPED})",
)
def max_gap(spark, sf_dir):
    return rows(spark, sf_dir, GAPPED).select("doc_id", sections.max_gap(F.col("text"), sections.SECTION_A, sections.SECTION_B).alias("x")).select("doc_id", "x.start", "x.end")


@query("T22_section_a")
def section_a(spark, sf_dir):
    """Spans, methods and statuses of section A."""
    return sections.extract_section_a(rows(spark, sf_dir, COVERED)).select("doc_id", "template", "start", "end", "method", "status")


RICH = COVERED.replace("ELSE '' END, text) AS text", "ELSE '' END, text, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat(chr(10), 'B.3 Project Boundary', chr(10), 'inside 12 MWe', chr(10), 'Monitoring Plan', chr(10), 'daily', chr(10), 'B.4 Baseline', chr(10), 'Parameters Monitored', chr(10), 'last') WHEN 1 THEN concat(chr(10), 'See monitoring here <table><tr>1</tr></table> of 5 kW now') ELSE '' END) AS text")


@query("T23_rich_text")
def rich_text(spark, sf_dir):
    """Section A with facts of section B, or tables, or the surroundings of a capacity, else the head."""
    return sections.rich_text(rows(spark, sf_dir, RICH)).select("doc_id", "template", "tier", "n_facts", "n_tables", F.length("rich_text").alias("n_chars"), F.md5("rich_text").alias("digest"))


NAMED = "SELECT doc_id, CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN 'x_VPA-DD_v2.pdf' WHEN 1 THEN 'cpa-12.pdf' WHEN 2 THEN 'Joint Project.pdf' WHEN 3 THEN 'VPA-DD of PoA-DD.pdf' WHEN 4 THEN 'SD VISTA PoA-DD.pdf' WHEN 5 THEN 'x CCB-PDD.pdf' WHEN 6 THEN '1234-VCS-Project.pdf' ELSE 'plain.pdf' END AS name, CASE WHEN doc_id % 17 = 16 THEN concat(chr(9), chr(10), ' ') ELSE concat(CASE CAST(doc_id % 11 AS INT) WHEN 3 THEN 'Grouped project ' WHEN 4 THEN 'CDM-PDD-Form ' WHEN 5 THEN 'Programme of Activities ' WHEN 6 THEN 'Document prepared by X ' WHEN 7 THEN 'Project Description: VCS Version ' WHEN 8 THEN 'Gold Standard for the Global Goals ' WHEN 9 THEN 'CPA-W-015 Document Prepared by Y ' ELSE '' END, text) END AS text FROM documents"
BODY_CASE = " ".join(f"WHEN regexp_matches(upper(left(text, 5000)), '{p}') THEN '{k}'" for p, k in sections.BODY_TYPES)
# the names are of the input above, so the file's tier is written out for each
TYPE_SQL = f"""CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' WHEN name IN ('SD VISTA PoA-DD.pdf', 'x CCB-PDD.pdf') THEN 'SD-VISta' WHEN name = 'Joint Project.pdf' THEN 'VCS-Joint' WHEN name = 'VPA-DD of PoA-DD.pdf' THEN 'GS-PoA-DD'
  WHEN name = 'cpa-12.pdf' THEN CASE WHEN (CASE {BODY_CASE} ELSE '' END) = 'VCS-PD' THEN 'VCS-CPA-component' ELSE 'CDM-CPA-DD' END WHEN name = 'x_VPA-DD_v2.pdf' THEN 'GS-VPA-DD' {BODY_CASE}
  WHEN name = '1234-VCS-Project.pdf' OR regexp_matches(left(text, 1000), '(?i)document\\s+prepared\\s+by') THEN CASE WHEN regexp_matches(left(text, 300), '(?i)cpa[-\\s]?[a-z]?[-\\s]?[0-9]{{1,4}}\\b') THEN 'VCS-CPA-component' ELSE 'VCS-PD' END ELSE 'unknown' END"""
CLASS_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sections.CLASSES.items()) + " END"


@query("T24_document_type", f"SELECT doc_id, kind, {CLASS_CASE} AS class FROM (SELECT doc_id, {TYPE_SQL} AS kind FROM ({NAMED}))")
def document_type(spark, sf_dir):
    kind = sections.doc_type(F.col("name"), F.col("text"))
    return rows(spark, sf_dir, NAMED).select("doc_id", kind.alias("kind")).withColumn("class", sections.semantic_class(F.col("kind")))


@query("F10_semantic_inclusion", f"SELECT doc_id FROM (SELECT doc_id, {TYPE_SQL} AS kind FROM ({NAMED})) WHERE {CLASS_CASE} IN ('single', 'component') AND kind <> 'SD-VISta'")
def inclusion(spark, sf_dir):
    """Documents of single projects and components, but for SD-VISta."""
    return rows(spark, sf_dir, NAMED).where(sections.included(sections.doc_type(F.col("name"), F.col("text")))).select("doc_id")


@query("A06_type_tallies", f"SELECT coalesce(lang, 'all') AS lang, coalesce(kind, 'all') AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT d.lang, {TYPE_SQL} AS kind FROM ({NAMED}) JOIN documents d USING (doc_id)) GROUP BY GROUPING SETS ((lang, kind), (kind), ())".replace("left(text", "left(n.text").replace("matches(text", "matches(n.text").replace(f"({NAMED}) JOIN", f"({NAMED}) n JOIN"))
def type_tallies(spark, sf_dir):
    typed = rows(spark, sf_dir, NAMED).select("doc_id", sections.doc_type(F.col("name"), F.col("text")).alias("kind")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    sets = typed.groupingSets([["lang", "kind"], ["kind"], []], "lang", "kind").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("kind", F.lit("all")).alias("kind"), "n")


PROGRAM = """SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'GS-VPA-DD' WHEN 1 THEN 'CDM-CPA-DD' WHEN 2 THEN 'VCS-CPA-component' ELSE 'VCS-PD' END AS kind, concat('GS', CAST(1000 + doc_id AS STRING)) AS gid,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('GS', CAST(1000 + doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN ' VPA-3.pdf' ELSE ' GS 7001 VPA-3.pdf' END) WHEN 1 THEN 'x PoA 88.pdf' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'plain.pdf' ELSE 'CPA-W-015.pdf' END ELSE 'CPA-1 GS7777.pdf' END AS name,
  concat(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'of PoA-9.2 ' WHEN doc_id % 4 = 2 THEN 'this CPA 15 is ' ELSE 'under GS_8002 here ' END, text) AS text FROM documents"""
# what the rule makes of these names and heads; digits of the texts themselves stand in no such reference
PROGRAM_SQL = """CASE kind WHEN 'GS-VPA-DD' THEN CASE WHEN doc_id % 3 <> 0 THEN 'GS7001' WHEN doc_id % 5 <> 0 THEN 'GS8002' END WHEN 'CDM-CPA-DD' THEN CASE WHEN doc_id % 5 <> 0 THEN 'PoA-9.2' ELSE 'PoA88' END
  WHEN 'VCS-CPA-component' THEN CASE WHEN doc_id % 3 <> 0 THEN 'CPA-W' WHEN doc_id % 5 <> 0 THEN 'CPA' END END"""


@query("T25_program_id", f"SELECT doc_id, {PROGRAM_SQL} AS program FROM ({PROGRAM})")
def program_id(spark, sf_dir):
    return rows(spark, sf_dir, PROGRAM).select("doc_id", sections.program_id(F.col("kind"), F.col("name"), F.col("text"), F.col("gid")).alias("program"))


SECTIONED = "SELECT doc_id, concat('1. Scope of it', chr(10), text, chr(10), '2.1 | Baseline monitoring', chr(10), '- first item', chr(10), 'goes on', chr(10), '(b) second', chr(10), 'III. Eligibility criteria', chr(10), 'x', chr(10), 'Sources of it ............ 12', chr(10), '3. Sources and sinks', chr(10), 'they are these', chr(10), 'Project boundary', chr(10), 'The fence.', chr(10), '4.', chr(10), 'Definition of terms', chr(10), 'a is b', chr(10), 'Monitoring plan ends') AS text FROM documents"
HEAD_RE = sections.NUMBERED_HEADING
HEAD_AT = {n: f"nullif(instr(lower(title), lower(regexp_extract(title, '{p}'))) * CAST(regexp_matches(title, '{p}') AS INT), 0)" for n, p in sections.HEADINGS}


CONTENTS = r"(?m)^[^\n]*?\.{8,}\s*\d+\s*$\n?"
MARKED = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{CONTENTS}', '', 'g'), '{HEAD_RE.replace('^', '(?m)^(', 1).replace('([^', ')([^')}', chr(1) || '\\2' || chr(2) || '\\1\\2', 'g'), "
    f"'(?im)^({sections.BARE_HEADING})', chr(1) || '\\2' || chr(2) || '\\1', 'g')"
)


@query("T26_headings", f"SELECT doc_id, CAST(i - 1 AS INT) AS n, trim(split_part(l[i], chr(2), 1)) AS title FROM (SELECT doc_id, split({MARKED}, chr(1)) l FROM ({SECTIONED})), LATERAL (SELECT unnest(range(2, len(l) + 1)) i)")
def headings(spark, sf_dir):
    return sections.headings(rows(spark, sf_dir, SECTIONED), "doc_id", "text").select("doc_id", "n", "title")


# The rule in words of its own: eligibility first, else the word that stands first; a definition of monitoring is none.
FIRST_WORD = "list_sort(list_filter([{'at': CASE WHEN contains(lower(title), 'monitor') THEN 0 ELSE instr(lower(title), 'definition') END, 'name': 'definitions'}, {'at': instr(lower(title), 'baseline'), 'name': 'baseline_scenario'}, {'at': instr(lower(title), 'project boundary'), 'name': 'project_scenario'}, {'at': instr(lower(title), 'monitoring'), 'name': 'parameters_monitored'}, {'at': instr(lower(title), 'scope'), 'name': 'typical_projects'}], lambda x: x.at > 0))[1].name"


@query("T27_heading_categories", f"SELECT DISTINCT title, CASE WHEN contains(lower(title), 'eligibility') THEN 'applicability' ELSE {FIRST_WORD} END AS category FROM ({ORACLES['T26_headings']})")
def heading_categories(spark, sf_dir):
    """Categories of all headings of the texts."""
    return sections.headings(rows(spark, sf_dir, SECTIONED), "doc_id", "text").select("title", "category").distinct()


@query("T28_split_by_headings")
def split_by_headings(spark, sf_dir):
    return sections.by_heading(rows(spark, sf_dir, SECTIONED), "doc_id", "text").select("doc_id", "category", F.md5("body").alias("digest"))


@query("T29_bullets")
def bullets(spark, sf_dir):
    return sections.bullets(rows(spark, sf_dir, SECTIONED), "doc_id", "text")


@query("T30_methodology_assembly")
def assembly(spark, sf_dir):
    """Categories of each document as columns."""
    parts = sections.by_heading(rows(spark, sf_dir, SECTIONED), "doc_id", "text")
    wide = parts.groupBy("doc_id").pivot("category", ["applicability", "baseline_scenario", "definitions", "typical_projects"]).agg(F.first("body"))
    return wide.select("doc_id", *[F.length(c).alias(c) for c in wide.columns[1:]])


@query("T32_clean_markup", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<!--\\s*page\\s+break\\s*-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest FROM pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_markup(F.col("html"))).alias("digest"))


CONDITIONS = "SELECT l_partkey, CONCAT('item <b>', CAST(l_orderkey AS STRING), '</b>  ', l_returnflag) AS item, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem"


@query(
    "T33_eligibility_excerpt",
    f"""WITH c AS ({CONDITIONS}), t AS (SELECT p_partkey, concat('Typical ', p_name) AS typical, concat('none of ', p_type) AS base, (SELECT string_agg(replace(replace(replace(item, '<b>', ' '), '</b>', ' '), '  ', ' '), ' ' ORDER BY n) FROM c WHERE l_partkey = p_partkey AND n <= 12) AS twelve,
      (SELECT string_agg(replace(replace(replace(item, '<b>', ' '), '</b>', ' '), '  ', ' '), ' ' ORDER BY n) FROM c WHERE l_partkey = p_partkey AND n <= 6) AS six FROM part)
    SELECT p_partkey, left(regexp_replace(concat_ws(' ', typical, twelve, base), ' +', ' ', 'g'), 7000) AS long, left(regexp_replace(concat_ws(' ', typical, six), ' +', ' ', 'g'), 60) AS short FROM t""",
)
def excerpt(spark, sf_dir):
    """What is typical, the first twelve conditions and the baseline; and a short form of six, cut at sixty signs."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.concat(F.lit("item <b>"), F.col("l_orderkey").cast("string"), F.lit("</b>  "), "l_returnflag").alias("item"))
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "item"))  # lines of one number by their text
    first = lines.withColumn("n", n).where("n <= 12").groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("c"))
    p = table(spark, sf_dir, "part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("items", F.transform("c", lambda x: x["item"]))
    typical, base = F.concat(F.lit("Typical "), "p_name"), F.concat(F.lit("none of "), "p_type")
    return p.select("p_partkey", sections.eligibility(typical, F.col("items"), base).alias("long"), sections.eligibility(typical, F.col("items"), None, 6, 60).alias("short"))


@query("T35_needle_contexts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '.{0,20}license.{0,20}')) AS BIGINT) AS n FROM documents WHERE contains(text, 'license')")
def needle_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("license")))
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(".{0,20}license.{0,20}"), F.lit(0))).cast("long").alias("n"))


NOISY = "SELECT event_id, concat('Sure: ', props, ' done', CASE WHEN event_id % 3 = 0 THEN ' {\"z\": {\"a\": 1}}' ELSE '' END) AS t FROM events"


@query("D20_greedy_json", f"SELECT event_id, nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS obj FROM ({NOISY})")
def greedy_json(spark, sf_dir):
    return rows(spark, sf_dir, NOISY).select("event_id", T.json_object(F.col("t")).alias("obj"))


@query("D18_balanced_json", "SELECT event_id, props AS obj, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN concat('[', props, ']') END AS list FROM events")
def balanced_json(spark, sf_dir):
    """The first object of an answer, and the fenced array of another; an array that does not parse is none."""
    fenced = F.concat(F.lit("Here [1, x\n```json\n["), "props", F.when(F.col("event_id") % 2 == 0, "]\n``` end").otherwise("\n``` end"))
    own = rows(spark, sf_dir, NOISY.replace("SELECT event_id,", "SELECT event_id, props,", 1)).select("event_id", sections.json_part("t").alias("obj"), sections.json_list(fenced).alias("list"))
    return own.withColumn("k", F.get_json_object("obj", "$.k").cast("long"))


SAID = """SELECT conv_id, turn, 'AMS-I.D.' AS a, 'VM0001' AS b, concat(text, chr(10), CASE CAST(turn % 6 AS INT) WHEN 0 THEN 'CHOICE: VM0001; because it fits' WHEN 1 THEN 'choice :AMS-I.D.'
  WHEN 2 THEN 'I prefer VM0001' WHEN 3 THEN 'CHOICE: neither, AMS-I.D. and VM0001 fail' WHEN 4 THEN 'CHOICE: VM9' ELSE concat('Choice:', chr(10), 'VM0001.') END, chr(10), 'x') AS t FROM conversations"""
ALONE = "contains(t, {0}) AND NOT contains(t, {1})"


@query("D19_choice", f"SELECT conv_id, turn, CASE WHEN w IN (a, b) THEN w WHEN {ALONE.format('a', 'b')} THEN a WHEN {ALONE.format('b', 'a')} THEN b END AS choice FROM (SELECT *, trim(regexp_extract(t, '(?i)CHOICE\\s*:\\s*(\\S+)', 1), '.,;:') AS w FROM ({SAID}))")
def choice(spark, sf_dir):
    return rows(spark, sf_dir, SAID).select("conv_id", "turn", T.choice(F.col("t"), F.col("a"), F.col("b")).alias("choice"))


CAP = "SELECT o_orderkey, concat('plant of ', CAST(o_orderkey % 30 AS STRING), CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN ' MW' WHEN 1 THEN ' people' WHEN 2 THEN '.5kWp' WHEN 3 THEN ' MWh' WHEN 4 THEN ' MWe.' WHEN 5 THEN ',5 gwth' WHEN 6 THEN ' kWh, 3 MW' ELSE ' MWs' END) AS t FROM orders"


@query("D21_capacity", "SELECT o_orderkey, o_orderkey % 8 IN (0, 2, 4, 5, 6) AS stated, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat(CAST(o_orderkey % 30 AS STRING), ' MW') WHEN 2 THEN concat(CAST(o_orderkey % 30 AS STRING), '.5kWp') WHEN 4 THEN concat(CAST(o_orderkey % 30 AS STRING), ' MWe') WHEN 5 THEN '5 gwth' WHEN 6 THEN '3 MW' ELSE '' END AS value FROM orders")
def capacity(spark, sf_dir):
    return rows(spark, sf_dir, CAP).select("o_orderkey", F.col("t").rlike(T.CAPACITY).alias("stated"), F.regexp_extract("t", T.CAPACITY, 0).alias("value"))


INDEX = """SELECT page_id, concat(html, chr(10), '<tr><th nowrap="nowrap">ACM', lpad(CAST(page_id % 10000 AS STRING), 4, '0'), '</th><td>x</td>', chr(10), '<a href="https://cdm.unfccc.int/methodologies/DB/A', CAST(page_id AS STRING), '">Title', chr(10), ' of ', CAST(page_id AS STRING), ' --- Version 3.0 </a></tr>',
  '<tr><th>AMS-I.D</th><a href="https://cdm.unfccc.int/methodologies/DB/B2">Other</a></tr><tr><th>ACM', lpad(CAST(page_id % 10000 AS STRING), 4, '0'), '</th><a href="https://cdm.unfccc.int/methodologies/DB/C3">Again</a></tr>',
  CASE WHEN page_id % 3 = 0 THEN '<tr><th>AM0001</th><a href="https://cdm.unfccc.int/methodologies/DB/D4">Last</a></tr>' ELSE '' END) AS html FROM pages"""


@query(
    "S23_html_index",
    """SELECT page_id, concat('ACM', lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0')) AS code, concat('https://cdm.unfccc.int/methodologies/DB/A', page_id) AS url, concat('Title of ', page_id) AS title FROM pages
    UNION ALL SELECT page_id, 'AM0001', 'https://cdm.unfccc.int/methodologies/DB/D4', 'Last' FROM pages WHERE page_id % 3 = 0""",
)
def html_index(spark, sf_dir):
    """Rows of a category's index behind whole pages: other codes and repeated ones go."""
    return catalogue.index_rows(rows(spark, sf_dir, INDEX), "html", catalogue.INDEX_ROWS["CDM"], catalogue.INDEX_CODES["PA"]).select("page_id", "code", "url", "title")


ANCHORS = """SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'Standards' ELSE 'Procedures' END AS section,
  concat('https://', CASE WHEN p_partkey % 5 = 0 THEN 'other.example' ELSE 'h.example' END, '/docs/', CASE WHEN p_partkey % 3 = 0 THEN concat('plain', CAST(p_partkey % 40 AS STRING)) ELSE concat(CAST(400 + p_partkey % 30 AS STRING), '_V1.', CAST(p_size AS STRING), '_PAR_a-title') END, '.pdf') AS href,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN p_name ELSE concat(p_name, ', v', CAST(p_size % 12 AS STRING), '.', CAST(p_partkey % 3 AS STRING)) END AS text,
  concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' CDM-EB', CAST(p_size AS STRING), '-A07-TOOL Ver3.1 05.0', CAST(1 + p_size % 9 AS STRING), '.2020 Core document') ELSE ' Note: 1 optional' END) AS row FROM part"""
HERE = "strpos(href, '//h.example') > 0"
NAME = "regexp_extract(href, '([^/]*)[.]pdf$', 1)"
EXPECTED = ["GS-400", "GS-plain1", "GS-none"]


@query(
    "S26_catalog_discovery",
    f"""WITH a AS (SELECT *, {NAME} AS stem FROM ({ANCHORS}) WHERE {HERE}),
    l AS (SELECT *, concat(CASE WHEN starts_with(text, 'r') THEN '' ELSE 'R-' END, replace(split_part(text, ',', 1), ' ', '-')) AS doc_id, regexp_extract(text, ', v(.*)$', 1) AS version FROM a WHERE text <> ''),
    r AS (SELECT *, CASE WHEN pos % 3 = 0 THEN regexp_extract(row, 'CDM-EB[0-9]+-A07-TOOL') ELSE concat('R-', stem) END AS doc_id FROM a),
    f AS (SELECT *, concat('GS-', CASE WHEN pos % 3 = 0 THEN stem ELSE split_part(stem, '_V', 1) END) AS doc_id FROM a)
    SELECT 'doclink' AS mode, doc_id, version, CASE section WHEN 'Standards' THEN 'standard' ELSE 'procedure' END AS type, '' AS effective, href AS url FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN version = '' THEN [0] ELSE [CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)] END DESC, pos) n FROM l) WHERE n = 1
    UNION ALL SELECT 'row', doc_id, CASE WHEN pos % 3 = 0 THEN '3.1' ELSE '' END, CASE section WHEN 'Standards' THEN 'standard' ELSE 'procedure' END, CASE WHEN pos % 3 = 0 THEN regexp_replace(regexp_extract(row, '05[.]0[0-9][.]2020'), '05[.](0[0-9])[.]2020', '2020-\\1-05') ELSE '' END, href FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) n FROM r) WHERE n = 1
    UNION ALL SELECT 'filename', doc_id, CASE WHEN pos % 3 = 0 THEN '' ELSE regexp_extract(stem, '_V([0-9.]+)_', 1) END, CASE WHEN pos % 3 = 0 THEN 'core' ELSE 'optional' END, CASE WHEN pos % 3 = 0 THEN regexp_replace(regexp_extract(row, '05[.]0[0-9][.]2020'), '05[.](0[0-9])[.]2020', '2020-\\1-05') ELSE '' END, href FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) n FROM f) WHERE n = 1
    UNION ALL SELECT 'missing', x, NULL, NULL, NULL, NULL FROM (SELECT unnest({EXPECTED}) x) WHERE x NOT IN (SELECT doc_id FROM f)""",
)
def discovery(spark, sf_dir):
    """Documents that a catalogue's links name, by each way of reading them, and the expected ones that are missing."""
    a = rows(spark, sf_dir, ANCHORS)
    columns = ["doc_id", "version", "type", "effective", "url"]
    found = {m: catalogue.discovered(a, m, o, "//h.example").select(F.lit(m).alias("mode"), *columns) for m, o in (("doclink", "R"), ("row", "R"), ("filename", "GS"))}
    expected = spark.createDataFrame([(x,) for x in EXPECTED], "doc_id string")
    none = [F.lit(None).cast("string").alias(c) for c in columns[1:]]
    missing = tables.missing(expected, found["filename"], "doc_id").select(F.lit("missing").alias("mode"), "doc_id", *none)
    return found["doclink"].union(found["row"]).union(found["filename"]).union(missing)


ENTRIES = """SELECT CAST(p_partkey AS STRING) AS code, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS registry, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN array(named_struct('version', '1', 'url', ''), named_struct('version', '2', 'url', concat('https://h.example/a%20b+', p_size, '.pdf')), named_struct('version', '3', 'url', 'https://h.example/c.pdf')) ELSE array(named_struct('version', '1', 'url', '')) END AS documents,
  CASE WHEN p_size % 2 = 0 THEN concat('https://made.example/', p_partkey, '.pdf') END AS made_url, '9' AS made_version FROM part"""
OWNER = "coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_type END, '_UNKNOWN')"


@query(
    "S21_download_plan",
    f"""SELECT every, CAST(p_partkey AS VARCHAR) AS code, {OWNER} AS registry, v AS version, concat({OWNER}, '/', p_partkey, '/', CASE v WHEN '2' THEN concat('a b+', p_size, '.pdf') WHEN '3' THEN 'c.pdf' ELSE concat(p_partkey, '.pdf') END) AS target
    FROM part, (VALUES (TRUE, '2'), (TRUE, '3'), (FALSE, '2'), (TRUE, '9'), (FALSE, '9')) k(every, v) WHERE CASE WHEN v = '9' THEN p_partkey % 3 <> 1 AND p_size % 2 = 0 ELSE p_partkey % 3 = 1 END""",
)
def download_plan(spark, sf_dir):
    """Listed files, all or the first with an address, else made-up addresses."""
    e = rows(spark, sf_dir, ENTRIES)
    return reduce(DataFrame.union, [catalogue.download_plan(e, k).select(F.lit(k).alias("every"), "code", "registry", "version", "target") for k in (True, False)])


@query("S31_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return tables.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("S14_issued_only", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def issued_only(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(r, "o_orderkey", "left_semi").select("o_orderkey")


@query("S04_parquet_scan", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")
