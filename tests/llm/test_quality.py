import re

from pyspark.sql import functions as F

from pandwerk.llm import quality

GAP = "[\x20\x09-\x0d]+"


def counts(text):
    text = text or ""
    w = [x for x in re.split(GAP, text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    places = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places))


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c a b c\n\na b c\nx", "é\xa0ü \x0b b\x1cc ## <|>", "\n".join(["x y z", "x y z", " ", " "]),
         "w " * 4000, " ".join(f"w{i % 700}" for i in range(3000))]


def test_counts_match_a_plain_reading(documents):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "a a a a", None, None)])
    got = quality.judged(docs.withColumn("n_lines", F.lit(5)).withColumn("kept", F.lit(True)))
    assert got.columns.count("kept") == 1
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "a a a a" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert tuple(r[c] for c in quality.COUNTS) == counts(text)
        n, repeated = counts(text)[0], counts(text)[4]
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_thresholds_follow_language_and_source(documents):
    import random

    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    prose = lambda n: " ".join(word(draw.randint(3, 7)) for _ in range(n))
    code = lambda n: " ".join(word(4) + ("$" if draw.random() < 0.6 else "") for _ in range(n))
    rows = [(i, prose(120), "en", "news") for i in range(600)] + [(1000 + i, code(120), "xx", "code") for i in range(900)]
    rows += [(5000, code(120), "en", "news"), (5001, prose(120), None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(rows)).collect()}
    assert all(kept[i] for i in range(600)) and all(kept[1000 + i] for i in range(900))
    assert not kept[5000] and kept[5001]


def test_the_quantiles_of_a_group_decide(documents):
    """The same texts are usual in a group that holds many like them and outliers in a group that does not."""
    import random

    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    line = lambda: " ".join(word(draw.randint(3, 7)) for _ in range(4))
    def text(signs=0, lines=0, repeats=0):
        made = [line() for _ in range(30)]
        twice = line()
        made += [made[0]] * lines + ["$ " * signs] * (signs > 0) + [f"{twice} {word(3 + i % 5)}" for i in range(repeats)]
        return "\n".join(made)
    odd = {"symbols_per_word": dict(signs=40), "dup_line_share": dict(lines=12), "repeat_share": dict(repeats=14)}
    rows, at = [], {}
    for name, how in odd.items():
        rows += [(len(rows) + i, text(**how), "xx", name) for i in range(600)]  # a group in which this is usual
    rows += [(len(rows) + i, text(), "en", "plain") for i in range(3000)]
    for name, how in odd.items():
        at[name] = len(rows)
        rows.append((len(rows), text(**how), "en", "plain"))
    got = {r["doc_id"]: (r["kept"], r["reasons"]) for r in quality.judged(documents(rows)).collect()}
    for name, i in at.items():
        assert not got[i][0] and name in got[i][1], (name, got[i])
    usual = [i for i, r in enumerate(rows) if i not in at.values()]
    assert sum(got[i][0] for i in usual) >= 0.99 * len(usual)


def test_sketches_add_up_and_bound_the_error(spark):
    values = spark.range(20_000).selectExpr("pmod(id, 2) k", "pow(id / 1000.0, 2) value")
    whole = quality.quantiles(quality.sketch(values, []), [], (0.25, 0.9)).first()
    parts = quality.sketch(values, ["k"]).groupBy("bucket").agg(F.sum("n").alias("n"))
    assert tuple(quality.quantiles(parts, [], (0.25, 0.9)).first()) == tuple(whole)
    assert abs(whole["q0"] / 25.0 - 1) < 0.011 and abs(whole["q1"] / 324.0 - 1) < 0.011


def test_empty_table(documents):
    assert quality.judged(documents([])).count() == 0
