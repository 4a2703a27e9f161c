"""Licence scan: lines and whole texts against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import let, lower_ascii

#: (licence, template); several templates may name one licence.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Least Dice coefficient, in percent.
PERCENT = 80
#: ASCII characters that separate words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def profiles(templates=TEMPLATES) -> list[tuple[int, str, int, dict[str, int]]]:
    """(number, licence, bigrams, count of each bigram) of every template with a bigram."""
    out = []
    for i, (name, text) in enumerate(templates):
        w = _template_words(text)
        counts: dict[str, int] = {}
        for pair in zip(w, w[1:]):
            counts[" ".join(pair)] = counts.get(" ".join(pair), 0) + 1
        if counts:
            out.append((i, name, len(w) - 1, counts))
    return out


def size_bounds(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Least and most bigrams of a text whose coefficient with n bigrams can reach the threshold: the shared bigrams
    are at most the smaller of the two sizes."""
    return -(-percent * n // (200 - percent)), (200 - percent) * n // percent


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), BETWEEN), lambda w: w != "")


def license_matches(docs: DataFrame, text: str = "text", *, templates=TEMPLATES, percent: int = PERCENT,
                    carry: tuple[str, ...] | None = None) -> DataFrame:
    """The `carry` columns (default: all but the text) and `matches`: array<struct<line, license, template, dice>>.

    Compared are every line and, as line 0, the whole text if it has more lines than one; each gives its best
    template (ties: the earlier one) if the coefficient reaches the threshold. Bigrams count as often as they
    occur. Only templates within the size bounds are compared, so long prose is dropped by its length alone. Null
    and empty texts have no match; texts of any length are scanned whole; repeated rows stay; without templates
    nothing matches. Row-local: no shuffle.
    """
    carry = [c for c in docs.columns if c not in (text, "matches")] if carry is None else list(carry)
    known = profiles(templates)
    none = F.expr("cast(array() as array<struct<line:int,license:string,template:int,dice:double>>)")
    if not known:
        return docs.select(*[F.col(f"`{c}`") for c in carry], none.alias("matches"))
    table = F.array(*[F.struct(
        F.lit(i).alias("no"), F.lit(name).alias("license"), F.lit(n).alias("n"), F.lit(size_bounds(n, percent)[0]).alias("lo"),
        F.lit(size_bounds(n, percent)[1]).alias("hi"),
        F.array(*[F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")) for g, c in counts.items()]).alias("grams"))
        for i, name, n, counts in known])
    least, most = min(size_bounds(k[2], percent)[0] for k in known), max(size_bounds(k[2], percent)[1] for k in known)

    def compare(unit, number):
        def with_grams(grams):
            size = F.size(grams)
            fit = F.filter(table, lambda t: (t["lo"] <= size) & (size <= t["hi"]))
            shared = lambda t: F.aggregate(t["grams"], F.lit(0), lambda s, g: s + F.least(
                g["c"], F.size(F.filter(grams, lambda x: x == g["g"]))))
            scored = F.transform(fit, lambda t: F.struct(
                (2.0 * shared(t) / (size + t["n"])).alias("dice"), (-t["no"]).alias("rank"), t["license"].alias("license")))
            return let(F.array_max(scored), lambda best: F.when(best["dice"] * 100 >= percent, F.struct(
                number.alias("line"), best["license"].alias("license"), (-best["rank"]).alias("template"),
                best["dice"].alias("dice"))))

        grams = F.zip_with(F.slice(unit, 1, F.size(unit) - 1), F.slice(unit, 2, F.size(unit) - 1),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return let(grams, with_grams)

    possible = lambda u: (F.size(u["w"]) - 1).between(least, most)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), _words(x).alias("w")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], lines.alias("_lines"))
    total = F.aggregate("_lines", F.lit(0), lambda s, u: s + F.size(u["w"]))
    whole = F.when((F.size("_lines") > 1) & (total - 1).between(least, most), F.array(F.struct(
        F.lit(0).alias("line"), F.flatten(F.transform("_lines", lambda u: u["w"])).alias("w")))).otherwise(
        F.expr("cast(array() as array<struct<line:int,w:array<string>>>)"))
    units = F.concat(whole, F.filter("_lines", possible))
    matches = F.filter(F.transform(units, lambda u: compare(u["w"], u["line"])), lambda m: m.isNotNull())
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], matches.alias("matches"))
