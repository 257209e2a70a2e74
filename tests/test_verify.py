"""The second pass of redaction against plain Python."""

import random
import re

from quarry.functions import text as T
from quarry.operators import verify


def made():
    def verifier(paragraphs):
        if any("FAIL" in p for p in paragraphs):
            raise OSError("down")
        return [(True, "version", p.replace("version", "[V]" * (len(p) % 5))) if "version" in p else (True, "", "no evidence") if "odd" in p else None for p in paragraphs]

    return verifier  # a function of a function travels to workers whole


def plain(text, only_marked):
    """(new text, spans) by walking the text's stretches with their offsets."""
    text = text or ""
    marks = [m.start() for _, p in T.REDACTION for m in re.finditer(p, text)]
    out, spans, at = "", [], 0
    for piece in re.split(r"(\n\s*\n)", text):
        value = piece.strip()
        start = at + piece.find(value)
        asked = len(value) >= 30 and (not only_marked or any(start <= a <= start + len(value) for a in marks))
        if asked and "version" in value:
            new = made()([value])[0][2]
            head = piece[: piece.find(value)]
            spans.append((len(out + head), len(out + head + new), new[:200]))
            out += head + new + piece[piece.find(value) + len(value) :]
        else:
            out += piece
        at += len(piece)
    return out, spans


def test_spliced_texts_equal_the_plain_version(spark):
    r = random.Random(2)
    bits = ["The project applies ACM0002 version 3 in full here. ", "Nothing but words, version one, in this paragraph.", "short", "AMS-I.D. odd one out, with no evidence in it", "   \tVM0007 version 1 and version 2, indented here \t", ""]
    texts = ["".join(r.choice(bits) + r.choice(["\n\n", "\n \n\n", "\n", "\n\n\t\n"]) for _ in range(r.randint(0, 12))) + "é end" for _ in range(120)]
    texts += [None, "", "\n\n", (bits[0] + "\n\n") * 300, bits[0] + "\n\n" + bits[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for only in (True, False):
        new, marks = verify.verified(df, "i", "text", made(), only)
        got = {x.i: x.text for x in new.collect()}
        spans = {}
        for x in sorted(marks.collect(), key=lambda x: (x.i, x.pos)):
            spans.setdefault(x.i, []).append((x.start, x.end, x.after))
        for i, t in enumerate(texts):
            want, places = plain(t, only)
            assert got[i] == want, (i, t)
            assert spans.get(i, []) == places, i
            assert all(got[i][a:b][:200] == s for a, b, s in places)


def test_what_the_verifier_fails_on_stays(spark):
    df = spark.createDataFrame([(1, "The project applies ACM0002 version 3, FAIL it does.\n\nend")], "i long, text string")
    new, marks = verify.verified(df, "i", "text", made())
    row = new.first()
    assert (row.text, row.n_asked, row.n_replaced, marks.count()) == (df.first().text, 1, 0, 0)
