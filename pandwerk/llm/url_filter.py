"""URL filter: host/path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary of this filter: one strict term rejects; soft terms reject when SEVERAL distinct ones are found, or one
#: whose weight alone reaches SOFT_LIMIT.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "viagra", "cialis", "phishing", "malware",
          "keygen", "warez")
SOFT = {"adult": 1.0, "bet": 0.5, "betting": 1.0, "bonus": 0.5, "casino": 1.0, "cheap": 0.5, "crack": 1.0,
        "dating": 0.5, "free": 0.5, "gambling": 1.0, "jackpot": 1.0, "loan": 0.5, "lottery": 1.0, "nude": 1.5,
        "pharmacy": 1.0, "pills": 1.0, "poker": 1.0, "sex": 1.5, "slots": 1.0, "torrent": 1.0, "win": 0.5}
SOFT_LIMIT, SEVERAL = 2.0, 2

#: (verdict, host, path start)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

COUNTS = "strict_hits long, soft_hits long, soft_weight double"


def url_host(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host, all its subdomains and
    every path that starts with its own. Of two rules of equal length, the one with the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def term_counter(strict, soft: dict):
    """A pandas UDF from URLs to (strict_hits, soft_hits, soft_weight); hits are distinct terms.

    A term counts where both neighbours are the text's ends or not ASCII letters or digits. Memory is the
    automaton of the vocabulary, whatever the number of URLs.
    """
    strict, soft = tuple(strict), dict(soft)

    @F.pandas_udf(COUNTS)
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in (*strict, *soft):
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        lower = {c: c + 32 for c in range(65, 91)}
        sharp = frozenset(strict)

        def judge(url):
            url = "" if url is None else url.translate(lower)
            found = set()
            for end, term in automaton.iter(url) if len(automaton) else ():
                start = end - len(term) + 1
                if (start == 0 or url[start - 1] not in inside) and (end + 1 == len(url) or url[end + 1] not in inside):
                    found.add(term)
            mild = found - sharp
            return len(found & sharp), len(mild), float(sum(soft[t] for t in mild))

        for batch in urls:
            yield pd.DataFrame([judge(u) for u in batch], columns=["strict_hits", "soft_hits", "soft_weight"])

    return count


def judge_urls(pages: DataFrame, url: str = "url", *, rules=RULES, strict=STRICT, soft=None,
               soft_limit: float = SOFT_LIMIT, several: int = SEVERAL) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits, soft_weight and verdict (allow or block) to every row.

    The longest fitting rule decides; without one, the vocabulary does: one strict term blocks, as do `several` distinct
    soft terms, and any that weigh `soft_limit` or more together. A null or empty URL has empty host and path, no
    rule and no term: allow. Terms are sought in the whole URL, whatever its length. Row-local: no shuffle,
    no state; repeated rows stay. Columns of the same names in the input are replaced.
    """
    soft = SOFT if soft is None else soft
    rest = [c for c in pages.columns if c.lower() not in
            {"host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"}]
    source = F.col(f"`{url}`")
    found = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)], url_host(source).alias("host"),
                         url_path(source).alias("path"), term_counter(strict, soft)(source).alias("_terms"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = ((F.col("_terms.strict_hits") > 0) | (F.col("_terms.soft_hits") >= several)
               | (F.col("_terms.soft_weight") >= soft_limit))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], "host", "path", rule.alias("rule"),
                        "_terms.strict_hits", "_terms.soft_hits", "_terms.soft_weight",
                        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
