"""The operators' queries as DuckDB SQL over the driver's tables, said from their definitions rather than from their method."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKENS = r"[^\x20\x09-\x0D]+"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substring(h, 2 * k + 1, 100) AS s FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS t(k)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT DISTINCT w.doc_id, k FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
i AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50, true) AS fresh FROM g),
r AS (SELECT doc_id, k, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM i),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM spans),
cut AS (SELECT gaps.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
               string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept
        FROM gaps JOIN d USING (doc_id) GROUP BY gaps.doc_id)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{_LETTERS}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_low('text')}, '{_LETTERS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s
        FROM bw, unnest(range(1, greatest(len(w) - 8, 2))) AS t(k) WHERE len(w) > 0),
dx AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
       FROM dw, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(k)),
hit AS (SELECT dx.doc_id, dx.k, dx.n, win.item_id FROM dx JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{_TOKENS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM dw, unnest(range(1, greatest(len(w) - 3, 2))) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, e.b FROM reach AS r JOIN edge AS e ON r.b = e.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_ LEFT JOIN n USING (doc_id)
"""

# ---- fixed values: rules (host, path, verdict) ----
_RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


def _parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    return f"{host} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


URL_FILTERS = f"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
p AS (SELECT page_id, url, {_parts("coalesce(url, '')")} FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE html IS NOT NULL),
named AS (SELECT url AS source, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM tags
          WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
          UNION ALL SELECT url, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags
          WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
split AS (SELECT source, target, regexp_extract(target, '^[^?#]*') AS own, regexp_extract(source, '^(.*?:)//', 1) AS scheme, regexp_extract(source, '^(.*?://[^/?#]*)', 1) AS root,
                 regexp_extract(regexp_extract(source, '://[^/?#]*([^?#]*)', 1), '^(.*)/[^/]*$', 1) AS folder FROM named WHERE source IS NOT NULL AND target <> ''),
links AS (SELECT source, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN scheme || target ELSE root ||
                 list_reduce(string_split(CASE WHEN starts_with(own, '/') THEN own ELSE folder || '/' || own END, '/'),
                             lambda so_far, part: CASE part WHEN '..' THEN regexp_replace(so_far, '/[^/]*$', '') WHEN '.' THEN so_far ELSE so_far || '/' || part END) END AS target
          FROM split WHERE contains(target, '://') OR (contains(source, '://') AND own <> '' AND NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
ends AS (SELECT source AS url FROM links UNION SELECT target FROM links UNION SELECT url FROM pages),
nodes AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') END AS node
          FROM (SELECT url, {_parts("coalesce(url, '')")} FROM ends)),
edge AS (SELECT x.node AS a, y.node AS b FROM links JOIN nodes AS x ON x.url = source JOIN nodes AS y ON y.url = target
         WHERE contains(target, '://') AND x.node IS NOT NULL AND y.node IS NOT NULL),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT node AS a, node AS b FROM nodes WHERE node IS NOT NULL UNION SELECT r.a, e.b FROM reach AS r JOIN sym AS e ON r.b = e.a),
ruled AS (SELECT node, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
          FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
          GROUP BY node, host, path),
alias AS (SELECT a AS node, min(verdict) AS verdict FROM reach JOIN ruled ON ruled.node = reach.b GROUP BY a)
SELECT page_id, p.host, p.path, ruled.rule, coalesce(ruled.verdict, alias.verdict, 'allow') AS verdict
FROM p LEFT JOIN ruled ON ruled.host = p.host AND ruled.path = p.path
LEFT JOIN alias ON alias.node = p.host || regexp_replace(p.path, '/$', '')
"""

CHAT_FORMATTING = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t),
e AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
             length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n_text, length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) AS n_role FROM c)
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + CASE WHEN opens THEN length('<|role|><|text|><|end|>') + n_role ELSE length('<|next|>') END)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""


# DuckDB's integer division cuts towards zero, which is rounding down for what is never negative
LEXICAL_SEARCH = f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_low('text')}, '{_LETTERS}') AS w FROM documents),
bt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_low('text')}, '{_LETTERS}')) AS term FROM benchmark)),
s AS (SELECT count(*) FILTER (len(w) > 0)::bigint AS n_docs, coalesce(sum(len(w)), 0)::bigint AS n_terms FROM dw),
tf AS (SELECT r, term, count(*)::bigint AS tf FROM (SELECT r, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM bt) GROUP BY r, term),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS weight FROM tf, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::bigint * n_docs) // greatest(n_terms, 1) AS m FROM dw, s),
sc AS (SELECT bt.item_id, m.r, m.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m.m)))::bigint AS score
       FROM bt JOIN tf USING (term) JOIN wt USING (term) JOIN m ON m.r = tf.r GROUP BY bt.item_id, m.r, m.doc_id),
rk AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM rk WHERE rank <= 50
"""


def centroids(width: int = 64, clusters: int = 40, rounds: int = 5, seed: str = "2:") -> str:
    """Every round as two steps of its own: the nearest centroids, and the centroids after them."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT v.r, v.vec_id, v.x, (min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': c.c}})) AS best
        FROM v, c{k} AS c GROUP BY v.r, v.vec_id, v.x)""")
        if k < rounds:
            steps.append(f"""u{k} AS (SELECT best.c AS c, k, sum(x[k])::hugeint AS s, count(*)::hugeint AS n FROM a{k}, unnest(range(1, {width + 1})) AS t(k) GROUP BY best.c, k),
n{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY k) AS x FROM u{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{k} AS c LEFT JOIN n{k} AS n ON n.c = c.c)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) AS x FROM embeddings
       WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT x, sha256('{seed}' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT {clusters})),
{", ".join(steps)},
e AS (SELECT best.c AS c, sum(best.d)::bigint AS total FROM a{rounds} GROUP BY best.c)
SELECT a.vec_id, a.best.c::int AS cluster, a.best.d AS distance, e.total AS cluster_inertia, (SELECT sum(total)::bigint FROM e) AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN e ON e.c = a.best.c JOIN c{rounds} AS f ON f.c = a.best.c
"""


# ---- fixed values: phrases and notices (words, label, whether a base phrase), and the words that name a label's license ----
_TEMPLATES = (
    ("mit license", "mit", True), ("apache license", "apache", True), ("general public license", "gpl", True),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", False),
    ("released under the mit license", "mit", False),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0", False),
    ("licensed under the apache license version 2 0", "apache-2.0", False),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", False),
    ("licensed under the gnu general public license version 3", "gpl-3.0", False),
    ("licensed under the gnu general public license version 2", "gpl-2.0", False),
    ("licensed under the gnu lesser general public license", "lgpl", False),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", False),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", False), ("licensed under cc by sa 4 0", "cc-by-sa-4.0", False), ("licensed under cc by 4 0", "cc-by-4.0", False),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", False),
    ("all rights reserved no part of this publication may be reproduced", "proprietary", False), ("all rights reserved", "proprietary", False),
)
_NAMING = (
    ("mit", "mit license"), ("mit", "hereby granted"), ("apache-2.0", "apache license"), ("apache-2.0", "2 0"), ("gpl", "gnu general public license"),
    ("gpl-3.0", "gnu general public license"), ("gpl-3.0", "version 3"), ("gpl-2.0", "gnu general public license"), ("gpl-2.0", "version 2"),
    ("lgpl", "gnu lesser general public license"), ("bsd", "are permitted"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-4.0", "cc by 4 0"), ("mpl", "mozilla public license"), ("proprietary", "all rights reserved"),
)
_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', {base}, '{text}')" for k, (text, label, base) in enumerate(_TEMPLATES))
_NAMING_ROWS = ", ".join(f"('{label}', '{text}')" for label, text in _NAMING)
_DENY = "lambda x: x IN ('not', 'never', 'cannot', 'no')"

# words 2 apart at most belong to one passage; nine tenths of the pairs, or one edit, and nothing that names the license missing or denied
LICENSE_SCANS = f"""
WITH t(template, label, base, w) AS (SELECT a, b, c, string_split(d, ' ') FROM (VALUES {_TEMPLATE_ROWS}) AS v(a, b, c, d)),
naming(label, n) AS (SELECT a, string_split(b, ' ') FROM (VALUES {_NAMING_ROWS}) AS v(a, b)),
needed AS (SELECT template, list_distinct(flatten(list(range(k - 1, k + len(n) - 2)))) AS needed FROM t JOIN naming USING (label), unnest(range(1, len(w) - len(n) + 2)) AS u(k)
           WHERE w[k:k + len(n) - 1] = n GROUP BY template),
tg AS (SELECT template, label, base, len(w) - 1 AS grams, k - 1 AS spot, w[k] || ' ' || w[k + 1] AS g FROM t, unnest(range(1, len(w))) AS u(k)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low('text')}, '{_LETTERS}') AS w FROM documents),
dg AS (SELECT r, k - 1 AS place, w[k] || ' ' || w[k + 1] AS g FROM d, unnest(range(1, greatest(len(w), 1))) AS u(k)),
hit AS (SELECT r, template, label, base, grams, place - spot AS diagonal, list(DISTINCT spot) AS ats, min(place) AS low, max(place) AS high
        FROM dg JOIN tg USING (g) GROUP BY r, template, label, base, grams, place - spot),
near AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > 2 OR low - lag(high) OVER o > grams + 2, true) AS far
         FROM hit WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(far::int) OVER (PARTITION BY r, template ORDER BY diagonal) AS passage FROM near),
passages AS (SELECT r, template, label, base, grams, passage, list_distinct(flatten(list(ats))) AS found, min(low) AS low, max(high) AS high,
                    count(*) FILTER (len(ats) = grams) AS places, min(diagonal) FILTER (len(ats) = grams) AS first_place,
                    max(diagonal) FILTER (len(ats) = grams) AS last_place FROM numbered GROUP BY r, template, label, base, grams, passage),
missing AS (SELECT p.*, len(found) / grams AS share, list_filter(range(0, grams), lambda x: NOT list_contains(found, x)) AS missed, coalesce(needed, []) AS needed,
                   len(list_filter(d.w[greatest(low - 1, 1):high + 2 + (NOT list_contains(found, grams - 1))::int], {_DENY})) AS denied,
                   len(list_filter(t.w[list_min(found) + 1:list_max(found) + 2 + (NOT list_contains(found, grams - 1))::int], {_DENY})) AS own
            FROM passages AS p JOIN d USING (r) JOIN t USING (template) LEFT JOIN needed USING (template)),
meant AS (SELECT *, (share >= 0.9 OR len(missed) = 1 OR (len(missed) = 2 AND missed[2] - missed[1] = 1)) AND NOT list_has_any(missed, needed) AND denied <= own AS counts FROM missing),
judged AS (SELECT r, sum(places) FILTER (base) AS n_base, min(first_place) FILTER (base) AS first_word, max(last_place) FILTER (base) AS last_word,
                  array_to_string(list_sort(list(DISTINCT label) FILTER (base AND places > 0)), ',') AS base_labels,
                  array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN places > 0 ELSE counts END)), ',') AS labels,
                  max(share) AS score FROM meant GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::double AS score
FROM d LEFT JOIN judged USING (r)
"""
