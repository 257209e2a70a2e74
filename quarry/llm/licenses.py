"""Licence scans: patience alignment of texts with licence templates."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import ALNUM_FOLDED, Words, chunks, trimmed

# Well-known licence notices, and one-line forms of them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: Share of a template's words that an alignment must cover.
COVERAGE = 0.8


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect.bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text, template) places, in order: common ends first, then anchors, then the gaps between them."""
    matched: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict = {}
        for k in range(a, b):
            once[text[k]] = -1 if text[k] in once else k
        there: dict = {}
        for k in range(c, d):
            there[template[k]] = -1 if template[k] in there else k
        anchors = [(once[w], k) for w, k in there.items() if k >= 0 and once.get(w, -1) >= 0]
        if not anchors:
            continue
        anchors.sort()
        chain = [anchors[k] for k in increasing([y for _, y in anchors])]
        matched += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


def _scan(text: list, template: list, need: float) -> list[list[tuple[int, int]]]:
    """Alignments of successive copies: windows of about the template's length from each word that a copy may begin with."""
    size = len(template)
    span, bag, head = size + size // 2 + 1, Counter(template), set(template[: size - int(np.ceil(need)) + 1])
    starts = [k for k, w in enumerate(text) if w in head]
    out: list[list[tuple[int, int]]] = []
    best: list[tuple[int, int]] = []
    after = limit = 0
    for s in starts:
        if best and s > limit:
            out.append(best)
            after, best = best[-1][0] + 1, []
        if s < after or sum((Counter(text[s : s + span]) & bag).values()) < need:
            continue
        for end in (size, span):
            pairs = [(s + x, y) for x, y in align(text[s : s + end], template)]
            if len(pairs) >= need and (not best or pairs[0][0] <= limit) and (len(pairs), pairs[0][0] - pairs[-1][0]) > (len(best), best[0][0] - best[-1][0] if best else 0):
                limit = limit if best else pairs[-1][0] - size // 2
                best = pairs
    return [*out, best] if best else out


def copies(text: list, template: list, need: float) -> list[list[tuple[int, int]]]:
    """Alignments, in order, of the copies of a template in a stretch of text; each matches ``need`` words at least.

    Words of copies that stand close together occur more than once and give no anchors,
    so where the stretch as a whole is not one copy it is aligned window by window.
    """
    whole = align(text, template)
    if len(whole) < need or not whole or whole[-1][0] - whole[0][0] > len(template) + len(template) // 2:
        return _scan(text, template, need)
    a, b = whole[0][0], whole[-1][0] + 1
    return [*_scan(text[:a], template, need), whole, *([(b + x, y) for x, y in m] for m in _scan(text[b:], template, need))]


def _apart(found: list[dict]) -> list[dict]:
    """Of findings that overlap the one of most coverage, in order."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["coverage"], x["end"] - x["start"], x["start"])):
        at = bisect.bisect_left(out, x["start"], key=lambda y: y["start"])
        if (at == 0 or out[at - 1]["end"] <= x["start"]) and (at == len(out) or x["end"] <= out[at]["start"]):
            out.insert(at, x)
    return out


class _Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = [k for k, v in templates.items()]
        w = Words(*_buffer([templates[k] for k in self.names]), ALNUM_FOLDED)
        self.words = [w.hashes[w.bounds[k] : w.bounds[k + 1]] for k in range(len(self.names))]
        self.vocabulary = np.unique(w.hashes)
        self.member = np.array([np.isin(self.vocabulary, x) for x in self.words]) if len(self.vocabulary) else np.zeros((0, 0), bool)


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _regions(hits: np.ndarray, size: int, share: float) -> list[tuple[int, int]]:
    """Runs of words where windows of ``size`` words and a half hold enough words of the template, with margins."""
    span = size + size // 2 + 1
    sums = np.concatenate([[0], np.cumsum(hits)])
    start = np.arange(len(hits))
    dense = np.flatnonzero((sums[np.minimum(start + span, len(hits))] - sums[start] >= share * size) & hits)
    out: list[tuple[int, int]] = []
    for s in dense.tolist():
        a, b = max(0, s - span), min(len(hits), s + span)
        if out and s - out[-1][2] <= 1 + size // 4:
            out[-1] = (out[-1][0], b, s)
        else:
            out.append((a, b, s))
    return [(a, b) for a, b, _ in out]


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """Adds ``licences``: array of (name, coverage, start, end) of the templates found in a text; bytes of its UTF-8, end exclusive.

    Words are lower-cased runs of letters and digits.  Stretches of a text with enough
    words of a template are aligned with it by patience: words that occur once in both
    are anchors, the longest increasing run of them stands, and gaps are aligned
    again.  A copy is found if matches inside one and a half template lengths (and a
    word) cover at least ``coverage`` of the template; stretches that hold too few of its words
    for that are not aligned.

    Templates are code-sized (a parameter); texts are read whole, row by row, no
    shuffle.  Edge cases: null and empty texts, and templates without words, find
    nothing; a template that is repeated in a text is found each time, also where its
    copies touch; repeated rows get their findings each; a column ``licences`` is replaced.
    """
    known = _Templates(TEMPLATES if templates is None else templates)
    names = [c for c in docs.columns if c != "licences"]
    where = names.index(text)

    def find(w: Words, k: int, at: np.ndarray, known_word: np.ndarray) -> list[dict]:
        lo, hi = w.bounds[k], w.bounds[k + 1]
        out = []
        own, is_known = at[lo:hi], known_word[lo:hi]
        for t, name in enumerate(known.names):
            size = len(known.words[t])
            if not size:
                continue
            hits = is_known & known.member[t][own]
            if hits.sum() < coverage * len(np.unique(known.words[t])):
                continue
            own_found: list[dict] = []
            for a, b in _regions(hits, size, coverage * 0.9):
                for pairs in copies(w.hashes[lo + a : lo + b].tolist(), known.words[t].tolist(), coverage * size):
                    start, end = int(w.starts[lo + a + pairs[0][0]]), int(w.ends[lo + a + pairs[-1][0]])
                    own_found.append({"name": name, "coverage": round(len(pairs) / size, 6), "start": start, "end": end})
            out += _apart(own_found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = []
            for i, j, data, offsets in chunks(batch.column(where)):
                w = Words(data, offsets, ALNUM_FOLDED)
                if not len(known.vocabulary):
                    found += [[]] * (j - i)
                    continue
                at = np.minimum(np.searchsorted(known.vocabulary, w.hashes), len(known.vocabulary) - 1)
                is_known = known.vocabulary[at] == w.hashes
                for k in range(j - i):
                    base = int(offsets[k])
                    found.append([x | {"start": x["start"] - base, "end": x["end"] - base} for x in find(w, k, at, is_known)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "licences"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*names).mapInArrow(trimmed(run), schema + ", licences array<struct<name:string,coverage:double,start:long,end:long>>")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).selectExpr(
        "doc_id", "cast(size(licences) as long) AS n_licences", "coalesce(array_max(transform(licences, x -> x.coverage)), 0D) AS coverage",
        "array_join(transform(licences, x -> concat_ws(':', x.name, x.start, x.end)), ',') AS licences",
    )
