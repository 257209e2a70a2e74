"""Normalising catalogue and project records with nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import codes

# Rows of methodology indexes (code, address, title) and the codes of each category.
INDEX_ROWS = {
    "CDM": r'(?s)<th[^>]*>([A-Z][A-Z0-9\-\.]+)</th>.*?<a\s+href="(https?://cdm\.unfccc\.int/methodologies/DB/[A-Z0-9]+)">([^<]+?)</a>',
    "Verra": r'(?s)(V(?:M|MD|T)\d{4}).{1,500}?<a[^>]+href="(https?://[^"]+)"[^>]*>([^<]+)</a>',
}
INDEX_CODES = {"PA": r"^(ACM|AM)\d{4}$", "SSC": r"^AMS-[IVX]+\.[A-Z]{1,2}$", "AR": r"^AR-AM\d{4}$", "SSCAR": r"^AR-AMS-[IVX]+\.[A-Z]{1,2}$"}


def catalog(entries: DataFrame) -> DataFrame:
    """code, primary_standard, all_standards, latest_version, latest_url, n_tools of nested entries (Q06).

    entries: code, standards array<struct<name,primary>>, versions array<struct<version,ef,url>>, tools array<struct<code,version>>.
    The primary standard is the flagged one, else the first; the latest version is the newest that has a URL.
    """
    flagged = F.filter("standards", lambda s: s["primary"])
    newest = F.reverse(F.array_sort(F.transform(F.filter("versions", lambda v: F.coalesce(v["url"], F.lit("")) != ""), lambda v: F.struct(v["ef"].alias("ef"), v["version"].alias("version"), v["url"].alias("url")))))
    return entries.select(
        "code", F.coalesce(F.get(flagged, F.lit(0))["name"], F.get("standards", F.lit(0))["name"]).alias("primary_standard"),
        F.array_sort(F.array_distinct(F.transform("standards", lambda s: s["name"]))).alias("all_standards"),
        F.get(newest, F.lit(0))["version"].alias("latest_version"), F.get(newest, F.lit(0))["url"].alias("latest_url"), F.size(F.array_distinct("tools")).alias("n_tools"),
    )


def reconcile(manifest: DataFrame, harvested: DataFrame) -> DataFrame:
    """State of each entry still to verify (M24) and the cap that it was held against.

    The first harvested threshold of the entry's kind whose dimension holds the
    entry's, or is held by it, confirms an equal cap and conflicts with another; an
    entry without one is unconfirmed.  manifest: code, kind, dimension, cap, verify;
    harvested: pos, kind, dimension, cap (null: 0).  Distinct dimensions are matched once.
    """
    plain = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    open_ = manifest.where("verify").select("code", "cap", F.coalesce("kind", F.lit("")).alias("kind"), plain("dimension").alias("dim"))
    other = harvested.select("pos", F.coalesce("kind", F.lit("")).alias("kind"), plain("dimension").alias("other"), F.coalesce("cap", F.lit(0)).alias("harvested_cap"))
    met = open_.select("kind", "dim").distinct().join(other, "kind").where(F.contains("dim", "other") | F.contains("other", "dim"))
    first = met.groupBy("kind", "dim").agg(F.min_by("harvested_cap", "pos").alias("harvested_cap"))
    state = F.when(F.col("harvested_cap").isNull(), "unconfirmed").when(F.abs(F.col("harvested_cap") - F.col("cap")) < 1e-6, "confirmed").otherwise("conflict")
    return open_.join(first, ["kind", "dim"], "left").select("code", state.alias("state"), "harvested_cap")


def projects(raw: DataFrame, most_urls: int = 30) -> DataFrame:
    """Project rows with a primary document, dates cut to days and at most ``most_urls`` other documents (Q09)."""
    other = F.transform(F.slice("documents", 2, most_urls), lambda d: d["url"])
    return raw.where(F.size("documents") > 0).select(
        "gid", F.get("documents", F.lit(0))["url"].alias("primary_url"), F.substring("started", 1, 10).alias("started"), F.substring("ended", 1, 10).alias("ended"), other.alias("other_urls")
    )


def index_rows(pages: DataFrame, html: str, row: str, code: str = "") -> DataFrame:
    """(columns of pages, pos, code, url, title): rows of an HTML index whose code fits, each code once a page.

    Pages are searched once; white space in titles is folded and a version at their end dropped.  A null page has no row.
    """
    found = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(0)), lambda m: F.struct(*(F.regexp_extract(m, row, k).alias(c) for k, c in ((1, "code"), (2, "url"), (3, "raw")))))
    kept = pages.withColumn("_rows", F.filter(found, lambda x: x["code"].rlike(code)))
    each = kept.select(*(F.col(f"`{c}`") for c in pages.columns), F.transform("_rows", lambda x: x["code"]).alias("_codes"), F.posexplode("_rows").alias("pos", "_row"))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_replace("_row.raw", r"\s+", " ")), r"(?i)\s*---\s*Version\s*[\d\.]+\s*$", ""))
    first = each.where(F.array_position("_codes", F.col("_row.code")) == F.col("pos") + 1)
    return first.select(*(F.col(f"`{c}`") for c in pages.columns), "pos", "_row.code", "_row.url", title.alias("title"))


def discovered(anchors: DataFrame, mode: str, registry: str, host: str = "") -> DataFrame:
    """(doc_id, title, url, type, version, effective): documents of a registry's catalogue pages.

    anchors: pos, section, href, text, row.  ``doclink`` reads the link's label and
    keeps the newest version of a document (ties: the first), ``row`` the table row and
    ``filename`` the file's name; these keep the first.  Links to other hosts are left out.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.element_at(F.split("href", "/"), -1), r"\?"), 1), r"(?i)\.pdf$", "")
    named = lambda c: F.when(c == "", stem).otherwise(c)
    owned = lambda c: F.concat(F.lit(f"{registry}-"), c)
    order: list[Column] = [F.col("pos")]
    if mode == "doclink":
        x, kind, effective = codes.link_label(F.col("text")), codes.section_type(F.col("section")), F.lit("")
        doc_id = F.when(F.upper(x["slug"]).startswith(registry.upper()), x["slug"]).otherwise(owned(x["slug"]))
        doc_id, order = F.when(x["slug"] != "", doc_id), [F.desc("_key"), *order]
    elif mode == "row":
        x, kind, effective = codes.catalog_row(F.col("row")), codes.section_type(F.col("section")), codes.row_date(F.col("row"))
        doc_id = F.when(x["code"] == "", owned(stem)).otherwise(x["code"])
    else:
        x, kind, effective = codes.standards_file(F.col("href")), codes.row_type(F.col("row")), codes.row_date(F.col("row"))
        doc_id = owned(named(x["code"]))
    own = anchors.where(F.contains("href", F.lit(host))).select(
        "pos", doc_id.alias("doc_id"), x["title"].alias("title"), F.col("href").alias("url"), kind.alias("type"), x["version"].alias("version"), effective.alias("effective")
    )
    ranked = own.where("doc_id IS NOT NULL").withColumn("_key", codes.version_key(F.col("version")))
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("_n = 1").drop("_n", "_key", "pos")


def download_plan(entries: DataFrame, every: bool = False) -> DataFrame:
    """(code, registry, version, url, target) of files to fetch (S21): an entry's listed documents with an address, all or the first, else the made-up address.

    entries: code, registry, documents array<struct<version,url>>, made_url, made_version.  An entry without any address has no row.
    """
    listed = F.filter(F.coalesce("documents", F.array()), lambda d: F.coalesce(d["url"], F.lit("")) != "")
    made = F.array(F.struct(F.col("made_version").alias("version"), F.col("made_url").alias("url")))
    chosen = F.when(F.size(listed) > 0, listed if every else F.slice(listed, 1, 1)).when(F.coalesce("made_url", F.lit("")) != "", made)
    each = entries.select("code", F.coalesce("registry", F.lit("_UNKNOWN")).alias("registry"), F.explode(chosen).alias("d"))
    file = F.element_at(F.split("d.url", "/"), -1)
    plain = F.coalesce(F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), file)
    return each.select("code", "registry", "d.version", "d.url", F.concat_ws("/", "registry", "code", plain).alias("target"))
