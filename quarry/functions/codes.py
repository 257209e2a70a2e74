"""Column functions on methodology codes, registries, dates, versions, file names and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of codes by prefix.
CDM, VCS, GS = r"^(ACM|AM\d|AMS-|AR-|ARNM)", r"^(VM\d|VMR|VMD|GCCM)", r"^(GS-|\d)"

# Patterns that find a code in a label, with its registry, in order.
LABEL_CODES = (
    (r"\bACM\d{4}\b", "CDM"),
    (r"\bAM\d{4}\b", "CDM"),
    (r"\bAMS[-\s]*[IVX]{1,4}(?:\.[A-Z]{1,2})?\b", "CDM"),
    (r"\bAR-?AM\d{4}\b", "CDM"),
    (r"\bAR-?AMS[-\s]*[IVX]+\b", "CDM"),
    (r"\bVM\d{4}\b", "Verra"),
    (r"\bVMD\d{4}\b", "Verra"),
    (r"\bTPDDTEC\b", "GS"),
    (r"\bGS[-\s]*VER\d+\b", "GS"),
)

# The fifteen sectoral scopes.
SCOPES = {
    "01": "energy-industries",
    "02": "energy-distribution",
    "03": "energy-demand",
    "04": "manufacturing-industries",
    "05": "chemical-industries",
    "06": "construction",
    "07": "transport",
    "08": "mining-mineral",
    "09": "metal-production",
    "10": "fugitive-fuel",
    "11": "fugitive-halocarbon",
    "12": "solvent-use",
    "13": "waste-handling",
    "14": "afforestation-reforestation",
    "15": "agriculture",
}
GHG = ("CO2", "CH4", "N2O", "HFC", "PFC", "SF6")

# Regions of countries (ISO 3166 alpha-3) and the least developed countries.
REGIONS = {
    "south-asia": "IND PAK BGD NPL LKA AFG BTN",
    "east-asia": "CHN MNG KOR JPN",
    "se-asia": "VNM KHM LAO MMR IDN PHL THA MYS TLS",
    "mena": "TUR EGY MAR JOR SAU ARE QAT IRQ IRN TUN DZA LBN OMN YEM KWT BHR",
    "east-africa": "UGA KEN ETH TZA RWA MWI MOZ MDG ZMB ZWE BDI SOM SSD ERI",
    "west-africa": "NGA GHA SEN CIV MLI BFA BEN TGO NER GIN SLE LBR GMB",
    "southern-africa": "ZAF BWA NAM LSO SWZ",
    "central-africa": "COD CMR CAF COG GAB TCD AGO",
    "lac": "BRA MEX COL PER CHL ARG ECU BOL GTM HND NIC CRI PAN PRY URY DOM HTI",
    "north-america": "USA CAN",
}
LDC = "AFG AGO BGD BEN BFA BDI KHM CAF TCD COM COD DJI ERI ETH GMB GIN GNB HTI KIR LAO LSO LBR MDG MWI MLI MRT MOZ MMR NPL NER RWA STP SEN SLE SLB SOM SSD SDN TLS TGO TUV UGA TZA YEM ZMB".split()

# Rules that give a methodology its group; the first that fits counts.
GROUP_RULES = (
    ("R01", "G02", "title", r"landfill"),
    ("R02", "G11", "title", r"coal\s*(mine|bed)|coal mines|leak detection|fugitive (methane|emission)"),
    ("R03", "G07", "title", r"waste\s*water"),
    ("R04", "G06", "title", r"manure|livestock"),
    ("R05", "G08", "title", r"waste treatment|composting|solid waste|waste gas|recycling of materials|recovery and recycling"),
    ("R06", "G04", "title", r"afforest|reforest"),
    ("R07", "G05", "title", r"deforestation|\bredd|forest management|avoided ecosystem|conversion from logged"),
    ("R08", "G12", "title", r"agricultural land|\brice\b|grassland|grazing"),
    ("R09", "G15", "title", r"drinking water|water supply|safe water|water purification"),
    ("R10", "G10", "title", r"vehicle|transport|modal shift|\bcharging|shore-side|off-shore electricity supply"),
    ("R11", "G16", "title", r"ozone-depleting|hydrofluorocarbon|\bsf6\b|cover gas|\bods\b"),
    ("R12", "G13", "title", r"\b(cement|clinker|concrete|asphalt|pavement|quicklime)\b"),
    ("R12L", "G09", "title", r"\blighting\b|\bled\b|\bcfl\b"),
    (
        "R13",
        "G01",
        "title",
        r"(grid[\- ]?connected|electrification|electricity generation|electricity and heat|power[\- ]only|renewable electricity)"
        r".*(renewable|wind|solar|hydro|geothermal|tidal|wave|biomass)"
        r"|(renewable|wind|solar|hydro|geothermal|tidal|wave|biomass).*(electric|grid|power generation|power[\- ]only)",
    ),
    ("R14", "G01", "code", r"^AMS-I\.[ABFL]\.?$"),
    ("R15", "G03", "title", r"cooking|heating|thermal|cookstove|stove|space heating|district cooling"),
    ("R16", "G03", "code", r"^AMS-I\.[CE]\.?$"),
    ("R17", "G14", "title", r"fuel switch|fossil fuel|natural gas|grid connected electricity"),
    ("R18", "G09", "title", r"energy efficiency|lighting|\bled\b|\bcfl\b|demand-side|campus clean energy"),
)

# Signs in a file's name that it is a project document, in order, and that it is not.
DOCUMENT_NAMES = (
    r"(?i)(?<![A-Za-z])PDD(?![A-Za-z])",
    r"(?i)Project[\s_\-]*Activity[\s_\-]*Design[\s_\-]*Document",
    r"(?i)Project[\s_\-]*Design[\s_\-]*Document",
    r"(?i)Project[\s_\-]*Description",
    r"(?i)VCS[\s_\-]+PD(?![A-Za-z])",
    r"(?i)(?<![A-Za-z])VPA[\s_\-]*DD(?![A-Za-z])",
    r"(?i)(?<![A-Za-z])CPA[\s_\-]*DD(?![A-Za-z])",
    r"(?i)(?<![A-Za-z])PoA[\s_\-]*DD(?![A-Za-z])",
    r"(?i)GS[\s_\-]+Passport",
    r"(?i)CDM[\s_]+PDD",
)
OTHER_NAMES = (
    r"(?i)\b(?:Final[\s_]+)?Val(?:idation)?[\s_]+(?:Report|Statement|Opinion|Representation)",
    r"(?i)\b(?:Final[\s_]+)?Ver(?:ification)?[\s_]+(?:Report|Statement|Opinion|Representation)",
    r"(?i)\bFVR[\s_\-]",
    r"(?i)\bFVerRep",
    r"(?i)\bVerification[\s_]+Statement",
    r"(?i)\bMonitoring[\s_]+Report",
    r"(?i)\bMR[\s_\-]\d",
    r"(?i)\bMP\d+[\s_]+MR",
    r"(?i)^MR[\s_\-]",
    r"(?i)^VR[\s_\-]",
    r"(?i)MONIT_?REP",
    r"(?i)\bIssuance[\s_]+(?:Deed|Representation|Notice|of)",
    r"(?i)\bRegistration[\s_]+(?:Deed|Representation|Certificate|Notice)",
    r"(?i)\bAudit[\s_]+Report",
    r"(?i)\bDeviation[\s_]+Request",
    r"(?i)\bWBT\b",
    r"(?i)\bKPT\b",
    r"(?i)\bBBT\b",
    r"(?i)Water[\s_]+Boiling[\s_]+Test",
    r"(?i)Kitchen[\s_]+Performance[\s_]+Test",
    r"(?i)Stakeholder[\s_]+Consultation",
    r"(?i)\bLSC\b",
    r"(?i)\bSCR\b",
    r"(?i)Comm[\w]*[\s_]+Agreement",
    r"(?i)Annual[\s_]+Report",
    r"(?i)\bPerfCert",
    r"(?i)Performance[\s_]+Certificate",
    r"(?i)\bAlteracao",
    r"(?i)\bContrato\b",
    r"(?i)Comfort[\s_]+Letter",
    r"(?i)Management[\s_]+(?:Letter|Comment)",
)


def family(code: Column) -> Column:
    """CDM, VCS, GS or OTHER."""
    return F.when(code.rlike(CDM), "CDM").when(code.rlike(VCS), "VCS").when(code.rlike(GS), "GS").otherwise("OTHER")


def registry(code: Column, given: Column) -> Column:
    """The registry given, else by prefix, else empty (Q02)."""
    by_code = (
        F.when(code.startswith("AM") | code.startswith("ACM") | code.startswith("AR"), "CDM")
        .when(code.startswith("VM"), "VCS")
        .when(code.startswith("TPDDTEC") | code.startswith("GS") | code.rlike("^[0-9]+$") | code.contains("-"), "GS")
        .otherwise("")
    )
    return F.coalesce(F.nullif(given, F.lit("")), by_code)


def parse_date(s: Column) -> Column:
    """The date of an ISO date or time; null for anything else, such as a year alone."""
    return F.try_to_date(F.nullif(F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})($|[T ])", 1), F.lit("")), "yyyy-M-d")


def row_date(s: Column) -> Column:
    """DD.MM.YYYY in a row as ISO; empty where there is none."""
    part = lambda k: F.regexp_extract(s, r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", k)
    return F.when(part(3) == "", "").otherwise(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def version_key(v: Column) -> Column:
    """array<int> that sorts as versions do; [0] where a part is not a number."""
    parts = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts).otherwise(F.array(F.lit(0)))


def scope(raw: Column) -> Column:
    """``NN-name`` of a sectoral scope given by number or name; empty where unknown."""
    s = F.lower(F.trim(raw))
    number = F.lpad(F.regexp_extract(s, r"^0?(\d{1,2})[-_\s]*(.*)$", 1), 2, "0")
    names = F.create_map(*[F.lit(x) for n, name in SCOPES.items() for x in (n, f"{n}-{name}")])
    by_name = F.coalesce(*[F.when(s.contains(name), f"{n}-{name}") for n, name in SCOPES.items()], F.lit(""))
    return F.when((number != "00") & F.map_contains_key(names, number), F.element_at(names, number)).otherwise(by_name)


def gases(raw: Column) -> Column:
    """Allowed gases of a list, upper-cased."""
    return F.filter(F.transform(raw, lambda g: F.upper(F.trim(g))), lambda g: g.isin(*GHG))


def technology(raw: Column) -> Column:
    """Slug of at most 80 signs."""
    return F.substring(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "-"), 1, 80)


def country(raw: Column) -> Column:
    """Two or three capitals, else empty."""
    iso = F.upper(F.trim(raw))
    return F.when(iso.rlike("^[A-Z]{2,3}$"), iso).otherwise("")


def scale(raw: Column) -> Column:
    """small, large or unknown."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin("small", "large"), s).otherwise("unknown")


def normal_code(raw: Column) -> Column:
    """A code without white space, in capitals, with its hyphens."""
    s = F.upper(F.regexp_replace(raw, r"\s+", ""))
    s = F.regexp_replace(s, r"^AMS([IVX]+)", "AMS-$1")
    s = F.regexp_replace(s, r"^ARAMS([IVX]+)", "AR-AMS-$1")
    return F.regexp_replace(s, r"^ARAM(\d)", "AR-AM$1")


def canonical(label: Column) -> Column:
    """struct<registry, code, kind> of a label: its first code, else its title cleaned."""
    made = lambda r, c, k: F.struct(r.alias("registry"), c.alias("code"), k.alias("kind"))
    out = F.when(F.coalesce(label, F.lit("")) == "", made(F.lit("Unknown"), F.lit(""), F.lit("empty")))
    for pattern, owner in LABEL_CODES:
        out = out.when(label.rlike(pattern), made(F.lit(owner), normal_code(F.regexp_extract(label, pattern, 0)), F.lit("coded")))
    clean = F.regexp_replace(label, r"^\s*[|\-\s]+", "")
    clean = F.trim(F.regexp_replace(clean, r"\s*\|\s*", " "))
    clean = F.trim(F.regexp_replace(clean, r"(?i)\s+(?:version|v\.?\s*)\s*\d+(?:\.\d+)?\s*$", ""))
    return out.otherwise(made(F.lit("GS-native"), F.lower(clean), F.lit("verbose-title")))


def standards_file(href: Column) -> Column:
    """struct<filename, code, version, tag, title> of ``{code}_V{version}_{TAG}_{slug}.pdf``."""
    name = F.element_at(F.split(F.element_at(F.split(href, "/"), -1), r"\?"), 1)
    p = r"(?i)^([A-Za-z0-9.\-]+?)_V([\d.]+)_(.+?)\.pdf$"
    rest = F.regexp_extract(name, p, 3)
    spaced = lambda x: F.trim(F.translate(x, "-_", "  "))
    slug = F.when(rest.contains("_"), F.regexp_extract(rest, "^[^_]*_(.*)$", 1)).otherwise(rest)
    fits = name.rlike(p)
    return F.struct(
        name.alias("filename"), F.regexp_extract(name, p, 1).alias("code"), F.regexp_extract(name, p, 2).alias("version"),
        F.when(fits & rest.contains("_"), F.substring_index(rest, "_", 1)).otherwise("").alias("tag"),
        F.when(fits, spaced(slug)).otherwise(spaced(F.regexp_replace(name, r"(?i)\.pdf$", ""))).alias("title"),
    )


def catalog_row(row: Column) -> Column:
    """struct<code, version, title> of a catalogue row; the title ends at the earliest marker."""
    r = F.trim(F.coalesce(row, F.lit("")))
    cut = lambda m: F.nullif(F.greatest(F.locate(m, r) - 1, F.lit(0)), F.lit(0))
    first = F.least(cut(" Ver"), cut(" Note:"), cut(" CDM-EB"))
    return F.struct(
        F.regexp_extract(r, r"\b(CDM-EB\d+-A\d+-[A-Z]+)\b", 1).alias("code"), F.regexp_extract(r, r"(?i)\bVer\s*([\d.]+)", 1).alias("version"),
        F.substring(F.when(first.isNotNull(), F.trim(F.substring(r, F.lit(1), first))).otherwise(r), 1, 140).alias("title"),
    )


def section_type(section: Column) -> Column:
    """Document type by its catalogue section."""
    s = F.lower(F.coalesce(section, F.lit("")))
    return F.when(s.contains("standard"), "standard").when(s.contains("procedure"), "procedure").when(s.contains("guideline") | s.contains("clarif"), "guideline").otherwise("")


def row_type(row: Column) -> Column:
    """Document type by its catalogue row."""
    s = F.lower(F.coalesce(row, F.lit("")))
    return F.when(s.contains("optional"), "optional").when(s.contains("core document"), "core").when(s.contains("guideline"), "guideline").when(s.contains("procedure"), "procedure").otherwise("")


def link_label(label: Column) -> Column:
    """struct<title, version, slug> of a link such as ``Standard, v5.0``."""
    t, p = F.trim(F.coalesce(label, F.lit(""))), r"(?i)^(.*?)[,\s]+v\.?\s*([\d.]+)\s*$"
    base = F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1))).otherwise(t)
    return F.struct(
        F.substring(base, 1, 140).alias("title"), F.regexp_extract(t, p, 2).alias("version"), F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "").alias("slug")
    )


def region(iso: Column) -> Column:
    """Region of a country, ``other`` where unknown."""
    c = F.upper(F.coalesce(iso, F.lit("")))
    out = F.lit("other")
    for name, members in REGIONS.items():
        out = F.when(c.isin(*members.split()), name).otherwise(out)
    return out


def least_developed(iso: Column) -> Column:
    return F.upper(F.coalesce(iso, F.lit(""))).isin(*LDC)


def group(code: Column, title: Column) -> Column:
    """struct<group_id, rule_id> by the first rule that fits; null where none does."""
    t = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for rule, group_id, kind, pattern in GROUP_RULES:
        fits = (code if kind == "code" else t).rlike("(?i)" + pattern)
        made = F.struct(F.lit(group_id).alias("group_id"), F.lit(rule).alias("rule_id"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def header_scale(header: Column) -> Column:
    """small before large, by the header's words."""
    return F.when(header.rlike("(?i)small[- ]scale"), "small").when(header.rlike("(?i)large[- ]scale"), "large")


def name_rank(name: Column) -> Column:
    """1-based place of the first sign of a project document in a file's name; null if none or if a contrary sign is there."""
    bad = F.lit(False)
    for p in OTHER_NAMES:
        bad = bad | name.rlike(p)
    first = F.coalesce(*[F.when(name.rlike(p), F.lit(k + 1)) for k, p in enumerate(DOCUMENT_NAMES)])
    return F.when(~bad, first)
