"""Extraction under a schema: what fits, what is asked again, what is given up."""

from quarry.operators import extract


def model(log):
    def transport(prompts):
        out = []
        with open(log, "a") as f:
            f.writelines("x\n" for _ in prompts)
        for p in prompts:
            body = p.split("\n\n", 1)[1]
            again = "It does not fit" in p
            if body.startswith("crash") and not again:
                raise OSError("down")
            good = '{"capacity_mw": 12.5, "stated": true, "quote": "12.5 MW", "unit_raw": "MW"}'
            answers = {
                "good": good, "prose": good if again else "I think 12 MW.", "typed": good if "not of the schema" in p else good.replace("12.5,", '"many",'),
                "missing": good if "the field quote is missing" in p else '{"capacity_mw": 1, "stated": true, "unit_raw": ""}', "never": "no", "invented": good, "crash": good, "nulls": '{"capacity_mw": null, "stated": null, "quote": null, "unit_raw": null}',
            }
            out.append(answers.get((body.split() or [""])[0]))
        return out

    return transport


def test_every_input_has_a_row(spark, tmp_path):
    texts = ["good 12.5 MW", "prose 12.5 MW", "typed 12.5 MW", "missing 12.5 MW", "never", "invented", "nulls", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(9, "i")
    log = str(tmp_path / "log")
    rows, bad = extract.capacities(df, "i", "text", model(log))
    got = {r.i: (r.attempts, r.ok, r.capacity_mw, r.stated) for r in rows.collect()}
    assert got[0] == (1, True, 12.5, True) and got[1] == got[2] == got[3] == (2, True, 12.5, True)
    assert got[4] == got[7] == (3, False, None, False)
    assert got[5] == (1, True, 12.5, False)  # the quote is not in the text
    assert got[6] == (1, True, None, False) and len(got) == 8
    crashed, _ = extract.capacities(spark.createDataFrame([(1, "crash 12.5 MW")], "i long, text string"), "i", "text", model(str(tmp_path / "other")))
    assert tuple(crashed.first())[1:5] == (2, True, 12.5, True)
    assert extract.capacities(df.limit(0), "i", "text", model(log))[0].count() == 0
    errors = {(r.i, r.attempt): r.error for r in bad.collect()}
    assert errors[1, 1] == "no JSON object" and errors[3, 1] == "the field quote is missing" and errors[2, 1].startswith("not of the schema") and errors[7, 3] == "no answer"
    assert {k for k in errors if k[0] == 4} == {(4, 1), (4, 2), (4, 3)}
    asked = open(log).read().count("x")
    rows.collect(), bad.count()
    assert open(log).read().count("x") == asked  # nothing is asked twice


def test_features_by_their_rules(spark):
    def transport(prompts):
        return ['Sure: {"ghg": ["co2 ", "CH4", "CO2", "steam"], "technology": " Wind  Power ", "country_iso": "in", "scale": "LARGE"}'] * len(prompts)

    rows, bad = extract.features(spark.createDataFrame([(1, "x")], "i long, text string"), "i", "text", transport)
    r = rows.first()
    assert (sorted(r.ghg), r.technology, r.country, r.scale, r.ok) == (["CH4", "CO2"], "wind-power", "IN", "large", True) and bad.count() == 0
