from collections import Counter

from pyspark.sql import functions as F

from pandwerk.llm import licenses


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.translate({c: c + 32 for c in range(65, 91)})).split()


def dice(a, b):
    a, b = (Counter(zip(x, x[1:])) for x in (a, b))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a and b else 0.0


def expected(text):
    lines = (text or "").split("\n")
    out = []
    for no, unit in ([(0, text)] if len(lines) > 1 else []) + list(enumerate(lines, 1)):
        scores = [dice(words(unit), words(t)) for _, t in licenses.TEMPLATES]
        best = max(scores)
        if best * 100 >= licenses.PERCENT:
            out.append((no, licenses.TEMPLATES[scores.index(best)][0], scores.index(best), round(best, 9)))
    return out


TEXTS = [None, "", "Prose.\nLicensed under the Apache License, Version 2.0.\nmore", "licensed under THE apache license version 2.0!",
         "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0", "All rights\nreserved", "all rights reserved all rights reserved",
         "This work is licensed under the GNU General Public License, version 3.", "Released under a MIT License", "rights reserved",
         "all all all rights rights reserved", "é " * 3000, "\n".join(["All rights reserved."] * 3), "Licensed under the Apache License"]


def test_matches_brute_force(documents):
    docs = documents([(i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], None, None)] * 2)
    got = licenses.license_matches(docs.withColumn("matches", F.lit(1)).withColumn("_lines", F.lit(2)),
                                   carry=("doc_id", "text", "_lines")).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert [(m["line"], m["license"], m["template"], round(m["dice"], 9)) for m in r["matches"]] == expected(r["text"])


def test_size_bounds_are_necessary_and_tight():
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n)
        for m in range(1, 200):
            assert (lo <= m <= hi) == (200 * min(n, m) >= licenses.PERCENT * (n + m))


def test_without_rows_or_templates(documents):
    assert licenses.license_matches(documents([])).count() == 0
    assert licenses.license_matches(documents([(1, "All rights reserved", None, None)]), templates=()).first()["matches"] == []
