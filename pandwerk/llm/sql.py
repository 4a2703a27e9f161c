"""DuckDB statements the registered queries are compared with, written from the contracts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _op1() -> str:
    assign = ("(" + "|".join(either(w) for w in ("password", "passwd", "secret", "token"))
              + "|" + either("api") + "_?" + either("key") + r")[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
    kinds = (("assign", 1, assign, f"length(regexp_extract(m, '{assign}', 2)) >= 8", f"regexp_extract(m, '{assign}', 2)"),
             ("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 16", "m"), ("hex", 3, "[0-9a-f]{32,}", "length(m) >= 32", "m"),
             ("bare", 4, "[A-Za-z0-9+/_-]{20,}={0,2}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')", "m"))
    scans = " UNION ALL ".join(f"""
      SELECT doc_id, source, lang, '{k}' AS kind, {n} AS place, s, s + length(m) AS e, {value} AS v FROM (
        SELECT doc_id, source, lang, hit.m AS m, hit.s AS s FROM (
          SELECT doc_id, source, lang, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
            'm': hits[i], 's': list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                 + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)}})) AS hit
          FROM (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '{p}') AS hits,
                       string_split(regexp_replace(coalesce(text, ''), '{p}', chr(1), 'g'), chr(1)) AS gaps
                FROM documents)))
      WHERE {keep}""" for k, n, p, keep, value in kinds)
    return f"""
    WITH spans AS MATERIALIZED ({scans}),
    free AS MATERIALIZED (SELECT * FROM spans b WHERE kind <> 'bare' OR NOT EXISTS (
        SELECT 1 FROM spans o WHERE o.doc_id = b.doc_id AND o.kind <> 'bare' AND o.s < b.e AND b.s < o.e)),
    counted AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM free GROUP BY v),
    kept AS (SELECT f.*, owners, kind || ':' || s::INT || ':' || e::INT AS t FROM free f JOIN counted USING (v)
             WHERE kind <> 'bare' OR (owners < 3
                AND 4 * len(regexp_extract_all(regexp_replace(v, '[^A-Za-z0-9]', '', 'g'), '[0-9]+|[A-Z]?[a-z]+|[A-Z]+')) >= length(v)
                AND 8 * list_sum(list_transform(list_distinct(string_split(v, '')),
                    lambda c: pow(length(v) - length(replace(v, c, '')), 2)))::BIGINT <= length(v) * length(v))),
    rows AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, string_agg(t, ',' ORDER BY s, place) FILTER (kind <> 'bare') AS base,
        string_agg(t, ',' ORDER BY s, place) AS spans, count(*) FILTER (kind = 'bare') AS n_bare,
        count(*) FILTER (owners < 3) AS n_live, count(*) FILTER (owners >= 3) AS n_example FROM kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_bare, 0) AS n_bare,
        coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM documents d LEFT JOIN rows USING (doc_id)"""


def _op3() -> str:
    from pandwerk.llm import quality as q

    signals = {"mean_word_length": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
               "dup_line_share": "n_dup_lines / n_lines", "repeat_share": "n_repeat_words / n_words"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS signal, {v}::DOUBLE AS x FROM counts WHERE NOT base_failed"
                              for k, v in signals.items())
    chance = {"mean_word_length": f"{q.WORD_SPREAD}::DOUBLE * (word_chars / n_words) / sqrt(n_words)",
              "symbols_per_word": f"{q.CHANCE_SYMBOLS}::DOUBLE / n_words", "dup_line_share": f"{q.CHANCE_LINES}::DOUBLE / n_lines",
              "repeat_share": f"{q.CHANCE_WORDS}::DOUBLE / n_words"}
    value = lambda b: f"CASE WHEN {b} = {q.ZERO_BUCKET} THEN 0.0::DOUBLE ELSE pow({q.GAMMA}::DOUBLE, {b}) * {2 / (1 + q.GAMMA)!r}::DOUBLE END"

    def level(name, keys):
        cols = "".join(k + ", " for k in keys)
        over = f"PARTITION BY {cols}signal"
        end = lambda which: "CASE signal " + " ".join(f"WHEN '{k}' THEN " + value(
            f"min(b) FILTER (upto >= total * {v[which]})") for k, v in q.SIGNALS.items()) + " END"
        return f"""{name} AS (SELECT *, high - low AS spread FROM (
              SELECT {cols}signal, max(total) AS n, {end(0)} AS low, {end(1)} AS high
              FROM (SELECT *, sum(n) OVER ({over} ORDER BY b) AS upto, sum(n) OVER ({over}) AS total
                    FROM (SELECT {cols}signal, b, count(*) AS n FROM buckets GROUP BY ALL)) GROUP BY {cols}signal))"""

    def lean(side):
        wide = f"((l.n * l.{side} + {q.PRIOR}::DOUBLE * c.{side}) / (l.n + {q.PRIOR}::DOUBLE))"
        return f"(g.n * g.{side} + {q.PRIOR}::DOUBLE * {wide}) / (g.n + {q.PRIOR}::DOUBLE)"

    reach = lambda k: f"{q.FENCE}::DOUBLE * greatest(t.spread, {chance[k]})"
    outside = " OR ".join(f"(t.signal = '{k}' AND (" + " OR ".join(
        f"{signals[k]}::DOUBLE " + (f"< t.low - {reach(k)}" if side == "low" else f"> t.high + {reach(k)}")
        for side in q.SIGNALS[k][2]) + "))" for k in signals)
    return f"""
    WITH w AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
    wins AS MATERIALIZED (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (
        PARTITION BY doc_id, win) > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    counts AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
        SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
        coalesce(wc, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeated r USING (doc_id))),
    buckets AS (SELECT lang, source, signal, CASE WHEN x <= 0 THEN {q.ZERO_BUCKET} ELSE
        ceil(ln(x) / {q.math.log(q.GAMMA)!r}::DOUBLE)::INT END AS b FROM ({long})),
    {level("g", ["lang", "source"])}, {level("l", ["lang"])}, {level("c", [])},
    t AS (SELECT g.lang, g.source, g.signal, {lean("low")} AS low, {lean("high")} AS high, {lean("spread")} AS spread FROM g
          JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.signal = l.signal JOIN c ON g.signal = c.signal)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (
        SELECT 1 FROM t WHERE t.lang IS NOT DISTINCT FROM d.lang AND t.source IS NOT DISTINCT FROM d.source
        AND ({outside})) AS kept FROM counts d"""


def _op5() -> str:
    from pandwerk.llm.url_filter import SEVERAL, SOFT, SOFT_LIMIT, STRICT

    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    strict = " + ".join(hit(t) for t in STRICT)
    soft = " + ".join(hit(t) for t in SOFT)
    weight = " + ".join(f"{hit(t)} * {w}::DOUBLE" for t, w in SOFT.items())
    at = lambda h: f"(host = '{h}' OR host LIKE '%.{h}')"
    return f"""
    WITH parts AS (SELECT page_id, {lower} AS u,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (SELECT *, CASE WHEN {at('example.org')} AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN {at('example.org')} AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN {at('com')} AND path LIKE '/fr/%' THEN 'com/fr/' WHEN {at('com')} AND path LIKE '/de/%' THEN 'com/de/'
        WHEN {at('org')} AND path LIKE '/%' THEN 'org/' END AS rule,
        ({strict})::BIGINT AS strict_hits, ({soft})::BIGINT AS soft_hits, ({weight})::DOUBLE AS soft_weight FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN strict_hits > 0 OR soft_hits >= {SEVERAL} OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
        strict_hits, soft_hits, soft_weight FROM ruled"""


_OP8 = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id)
            + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
              UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""


#: For pages of one <article> with headings, paragraphs, bold and line breaks, as in the supplied tables.
_OP9 = r"""
    WITH article AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages),
    blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(a, '<br>', ' ', 'g'),
            '</?b>', '', 'g'), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x,
            '&amp([^;]|$)', '&\1', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM article)
    SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text,
        length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM blocks"""

def _op4() -> str:
    from pandwerk.llm.licenses import PERCENT, profiles

    grams = ", ".join(f"({i}, '{name}', {n}, '{g}', {c})" for i, name, n, counts in profiles() for g, c in counts.items())
    return f"""
    WITH templates(no, license, n, g, c) AS (VALUES {grams}),
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    units AS (SELECT doc_id, i AS line, lines[i] AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)
              UNION ALL SELECT doc_id, 0, array_to_string(lines, chr(10)) FROM split WHERE len(lines) > 1),
    cut AS (SELECT doc_id, line, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM units),
    short AS MATERIALIZED (SELECT * FROM cut WHERE len(w) BETWEEN 2 AND 60),
    pairs AS (SELECT doc_id, line, size, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (
        SELECT doc_id, line, len(w) - 1 AS size, w, unnest(range(1, len(w))) AS i FROM short) GROUP BY ALL),
    dice AS (SELECT doc_id, line, no, license, 2.0::DOUBLE * sum(least(p.c, t.c)) / (p.size + t.n) AS dice
        FROM pairs p JOIN templates t USING (g) GROUP BY doc_id, line, no, license, p.size, t.n),
    found AS (SELECT * FROM dice WHERE dice * 100 >= {PERCENT}
        QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, no) = 1),
    rows AS (SELECT doc_id, count(*) AS n_matches, string_agg(line::VARCHAR || ':' || license, ',' ORDER BY line) AS matches,
        arg_max(license, {{'d': dice, 'l': -line, 'n': license}}) AS license, max(dice) AS dice FROM found GROUP BY 1)
    SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches, license, dice
    FROM documents d LEFT JOIN rows USING (doc_id)"""


_OP2 = """
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM least"""

ORACLES = {"op2_vector_near_dedup": _OP2, "op4_license_scan": _op4(), "op9_main_text": _OP9, "op8_ngram_jaccard": _OP8, "op1_secret_scan": _op1(), "op3_quality_rules": _op3(), "op5_url_filter": _op5()}
