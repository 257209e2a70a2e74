"""SQL of the operators that SQL can express."""

from __future__ import annotations

import string

SPACED = "[^\\x20\\x09-\\x0D]+"
ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
FOLDED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM k JOIN (SELECT h, count(*) AS times FROM k GROUP BY h) USING (h) WHERE times > 1),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
m AS (SELECT p.doc_id, count(*) AS n, count(c.at) AS gone, string_agg(x, ' ' ORDER BY p.p) FILTER (WHERE c.at IS NULL) AS t FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.at = p.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN m USING (doc_id)
"""

DECONTAMINATE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '{ALNUM}') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM k),
d AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, z WHERE len(w) >= n)),
f AS (SELECT doc_id, item_id, i, d.n FROM d JOIN k ON k.g = d.g AND k.n = d.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text: half a byte at a time, the table by its rule."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    entries = ", ".join(f"{k}::UBIGINT" for k in table)
    step = lambda c: f"xor({c} >> 4, list_extract([{entries}], CAST({c} & 15 AS INTEGER) + 1))"
    start = "list_value(4294967295::UBIGINT)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_concat({start}, {codes}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295::UBIGINT)"


def _past(column: str) -> str:
    """n and s of the line's column before its moment, without its fold."""
    over = lambda *by: f"(PARTITION BY {', '.join(by)} ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        f"coalesce({f} OVER {over(column)}, 0) - coalesce({f} OVER {over(column, 'fold')}, 0) AS {column}_{c}"
        for c, f in (("n", "sum(1)"), ("s", "sum(CASE WHEN flag = 'returned' THEN 1 ELSE 0 END)"))
    )


def _rate(column: str, prior: str) -> str:
    return f"CASE WHEN {column}_n < 1 THEN {prior} ELSE CAST((1000000 * {column}_s + 50 * {prior}) // ({column}_n + 50) AS BIGINT) END"


TARGET_ENCODING = f"""
WITH j AS (SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, l.flag, coalesce(s.client_id, -1) AS client_id, epoch_us(s.sold_at) AS moment,
  CAST({_crc32('CAST(l.sale_id AS VARCHAR)')} % 5 AS INTEGER) AS fold FROM sale_lines l JOIN sales s ON s.sale_id = l.sale_id WHERE s.sold_at IS NOT NULL),
k AS (SELECT j.*, i.kind, v.nation_id, c.segment, 0 AS a FROM j LEFT JOIN items i ON i.item_id = j.item_id LEFT JOIN vendors v ON v.vendor_id = j.vendor_id LEFT JOIN clients c ON c.client_id = j.client_id),
h AS (SELECT *, {', '.join(_past(x) for x in ('a', 'kind', 'item_id', 'nation_id', 'vendor_id', 'segment', 'client_id'))} FROM k),
p AS (SELECT *, {_rate('a', '500000')} AS r FROM h),
g AS (SELECT *, {_rate('kind', 'r')} AS rk, {_rate('nation_id', 'r')} AS rn, {_rate('segment', 'r')} AS rs FROM p)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, count(*) FILTER (WHERE flag = 'returned') AS n_returned,
  CAST(max(item_id_n) AS BIGINT) AS item_n, max({_rate('item_id', 'rk')}) AS item_rate, CAST(max(vendor_id_n) AS BIGINT) AS vendor_n,
  max({_rate('vendor_id', 'rn')}) AS vendor_rate, CAST(max(client_id_n) AS BIGINT) AS client_n, max({_rate('client_id', 'rs')}) AS client_rate
FROM g GROUP BY sale_id, item_id, vendor_id
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
