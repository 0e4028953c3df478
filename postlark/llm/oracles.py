"""SQL of the registered queries for a second engine, where SQL can express them."""

from __future__ import annotations

from postlark.llm.decontamination import LITERALS, RUN, SHARE, UNITS, WINDOW
from postlark.llm.quality import ALPHA, BANDS, DELTA, GRID, MIN_WORDS, RATIOS, STEPS, enough

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
win AS (
    SELECT r, doc_id, i, list_slice(words, i, i + 12) AS k
    FROM (SELECT r, doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)
),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
    SELECT DISTINCT r, i + d AS p
    FROM win JOIN least USING (k), (SELECT unnest(generate_series(0, 12)) AS d)
    WHERE doc_id > m
),
pos AS (SELECT r, doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
marked AS (SELECT pos.r, pos.doc_id, pos.p, pos.word, gone.p IS NOT NULL AS g FROM pos LEFT JOIN gone ON pos.r = gone.r AND pos.p = gone.p),
done AS (
    SELECT r, count(*) AS n_words, count(*) FILTER (g) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT g), '') AS kept
    FROM marked GROUP BY r
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done USING (r)
"""


OP4 = """
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
p AS (
    SELECT row_number() OVER () AS r, page_id, h AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path
    FROM (SELECT *, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h
          FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM parts))
),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
    SELECT r, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v
    FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""

OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
win AS (SELECT r, doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM (SELECT *, unnest(generate_series(1, n - 49)) AS i FROM n WHERE n >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
marks AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -99) AS gap FROM win JOIN least USING (k) WHERE doc_id > m),
runs AS (SELECT r, min(i) AS a, max(i) + 49 AS b FROM (SELECT r, i, sum((gap > 50)::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM marks) GROUP BY r, g),
gaps AS (
    SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM runs
    UNION ALL SELECT r, max(b) + 1, 1000000000 FROM runs GROUP BY r
),
kept AS (SELECT r, string_agg(substr(h, 2 * f - 1, 2 * (least(t, n) - f + 1)), '' ORDER BY f) AS k FROM gaps JOIN n USING (r) WHERE f <= least(t, n) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a + 1) AS n_removed FROM runs GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM n LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


_ENDS = "('.', '!', '?', ':', ';', chr(10))"
_DIGIT = "substr({0}, 1, 1) BETWEEN '0' AND '9'"


def _template_windows(table: str, key: str, out: str) -> str:
    """Template words of a table's texts with their windows of eight."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
{out}_t AS (
    SELECT r, {key}, p, t, lag(t) OVER (PARTITION BY r ORDER BY p) AS b
    FROM (SELECT r, {key}, unnest(tokens) AS t, unnest(generate_series(1, len(tokens))) AS p
          FROM (SELECT row_number() OVER () AS r, {key}, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*|[.!?:;\\n]') AS tokens
                FROM {table}))
),
{out}_k AS (
    SELECT r, {key}, lower(t) AS v, row_number() OVER (PARTITION BY r ORDER BY p) AS q,
        CASE WHEN {_DIGIT.format('t')} THEN '1' WHEN t IN ({units}) AND coalesce({_DIGIT.format('b')}, FALSE) THEN '2'
             WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND b IS NOT NULL AND b NOT IN {_ENDS} AND right(b, 1) = lower(right(b, 1)) THEN '3'
             ELSE 'w:' || lower(t) END AS k
    FROM {out}_t WHERE t NOT IN {_ENDS}
),
{out} AS (
    SELECT * FROM (SELECT r, {key}, q, string_agg(k, ' ') OVER f AS w, count(*) OVER f AS n, sum((length(k) > 1)::INT) OVER f AS plain
                   FROM {out}_k WINDOW f AS (PARTITION BY r ORDER BY q ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))
    WHERE n = {WINDOW}
)"""


OP5 = f"""
WITH {_template_windows("documents", "doc_id", "d")},
{_template_windows("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id", "e")},
b AS (SELECT * FROM e WHERE plain >= {LITERALS}),
m AS (SELECT d.r AS dr, d.doc_id, d.q AS dq, b.r AS br, b.item_id, b.q AS bq, d.q - b.q AS shift FROM d JOIN b USING (w)),
slots AS (
    SELECT DISTINCT m.dr, m.item_id, m.shift, bq + o AS at, x.k, x.v, y.v AS b
    FROM m, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS o), d_k x, e_k y
    WHERE x.r = m.dr AND x.q = m.dq + o AND y.r = m.br AND y.q = m.bq + o AND x.k IN ('1', '2', '3')
),
judged AS (
    SELECT dr, item_id, shift, sum(n) AS n_slots, sum(CASE WHEN b <> least THEN n ELSE 0 END) AS n_changed, max((least <> most)::INT) AS broken
    FROM (SELECT dr, item_id, shift, k, b, min(v) AS least, max(v) AS most, count(*) AS n FROM slots GROUP BY ALL) GROUP BY ALL
),
counted AS (SELECT dr, doc_id, item_id, shift, count(DISTINCT bq) AS n_windows FROM m GROUP BY ALL),
whole AS (SELECT item_id, count(DISTINCT q) AS item_windows FROM b GROUP BY 1)
SELECT doc_id, item_id, n_windows, item_windows, coalesce(n_slots, 0)::BIGINT AS n_slots, coalesce(n_changed, 0)::BIGINT AS n_changed
FROM counted LEFT JOIN judged USING (dr, item_id, shift) JOIN whole USING (item_id)
WHERE coalesce(broken, 0) = 0 AND (n_windows >= {SHARE} * item_windows OR n_windows >= {RUN})
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_slots DESC, n_changed DESC) = 1
"""

_RATIO = {name: ratio.replace(" / ", "::DOUBLE / ") for name, ratio in RATIOS.items()}
_STEPS = ", ".join(f"unnest([{', '.join(f'{c}::DOUBLE' for c in GRID[name])}]) AS cut_{name}" for name in RATIOS)
_ANY_OVER = " OR ".join(f"{ratio} > cut_{name}" for name, ratio in _RATIO.items())
_REJECTED = " ".join(f"WHEN {ratio} > cut_{name} THEN '{name}'" for name, ratio in _RATIO.items())


def _strata() -> str:
    """The stratum t of each band s: shorter bands take longer ones in until they have enough good documents."""
    last, least = len(BANDS), enough(ALPHA, DELTA / (len(BANDS) + 1))
    counts = ", ".join(f"count(*) FILTER (s = {b}) AS n{b}" for b in range(last + 1))
    parts = [f"j0 AS (SELECT *, 0 AS g0, n0 AS a0 FROM (SELECT {counts} FROM h))"]
    for b in range(1, last + 1):
        grown = f"g{b - 1} + (a{b - 1} >= {least})::INT AS g{b}, CASE WHEN a{b - 1} >= {least} THEN n{b} ELSE a{b - 1} + n{b} END AS a{b}"
        parts.append(f"j{b} AS (SELECT *, {grown} FROM j{b - 1})")
    top = f"CASE WHEN a{last} >= {least} THEN g{last} ELSE greatest(g{last} - 1, 0) END"
    of = ", ".join(f"least(g{b}, {top})" for b in range(last + 1))
    parts.append(f"bands AS (SELECT unnest(range({last + 1})) AS s, unnest([{of}]) AS t FROM j{last})")
    return ", ".join(parts)


OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
pos AS (SELECT r, unnest(words) AS w, unnest(generate_series(1, len(words))) AS p FROM t),
win AS (SELECT r, p, w, count(*) OVER f AS n, string_agg(w, ' ') OVER f AS k FROM pos
        WINDOW f AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
hit AS (SELECT r, p FROM win WHERE n = 8 QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT p + d) AS n FROM hit, (SELECT unnest(generate_series(0, 7)) AS d) GROUP BY 1),
lin AS (SELECT r, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t)
        WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
c AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        coalesce(lin.n, 0)::BIGINT AS n_lines, coalesce(lin.n - lin.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        {" + ".join(f"(len(words) >= {b})::INT" for b in BANDS)} AS s
    FROM t LEFT JOIN lin USING (r) LEFT JOIN rep USING (r)
),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
h AS (SELECT c.* FROM c JOIN good USING (doc_id) WHERE n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 30 * n_words),
{_strata()},
steps AS (SELECT unnest(range({STEPS})) AS k, {_STEPS}),
tested AS (SELECT t, k, count(*) AS n, count(*) FILTER ({_ANY_OVER}) AS away FROM h JOIN bands USING (s), steps GROUP BY ALL),
terms AS (SELECT *, unnest(generate_series(0, away)) AS i FROM tested WHERE away <= n * {ALPHA}),
tails AS (
    SELECT t, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) AS tail
    FROM terms GROUP BY ALL
),
stops AS (
    SELECT t, min(k) FILTER (coalesce(tail, 1) > {DELTA} / (SELECT max(t) + 1 FROM bands)) AS stop
    FROM tested LEFT JOIN tails USING (t, k) GROUP BY ALL
),
cuts AS (SELECT s, steps.* FROM bands JOIN stops USING (t) JOIN steps ON k = coalesce(stop, {STEPS}) - 1),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE {_REJECTED} END AS rejected_by FROM c LEFT JOIN cuts USING (s))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, n_lines, n_upper, rejected_by
FROM v
"""


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _merkle(lower: int = 6, upper: int = 3) -> str:
    """The tree by languages, as many levels as the tables need; a node that is alone in its group goes up unchanged."""
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "steps(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL"
        " SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8)",
        "tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)",
        f"leaves AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('text')} AS leaf, {_leaf(fold)} AS folded, xor(list_reduce(list_prepend(4294967295::BIGINT,"
        " list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc"
        " FROM documents, tab)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,"
        " row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS s FROM leaves)",
        "way0 AS (SELECT r, doc_id, g, s, leaf, CASE WHEN crc % 3 = 0 THEN folded ELSE leaf END AS f, '' AS p FROM placed)",
        "level0 AS (SELECT g, s, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM placed)",
    ]
    for k in range(lower + upper):
        if k == lower:  # the languages' own nodes become the leaves of one more tree
            parts.append(f"subroots AS (SELECT g, d AS subroot FROM level{k})")
            parts.append(f"top{k} AS (SELECT 0 AS g, g - 1 AS s, d, count(*) OVER () AS n FROM level{k})")
            parts.append(f"on{k} AS (SELECT r, doc_id, g AS lang_g, 0 AS g, g - 1 AS s, leaf, f, p FROM way{k})")
        level, way = (f"top{k}", f"on{k}") if k == lower else (f"level{k}", f"way{k}")
        own = "lang_g, " if k >= lower else ""
        parts.append(
            f"near{k} AS (SELECT a.g, a.s, a.n, coalesce(string_agg(b.d, '' ORDER BY b.s) FILTER (b.s < a.s), '') AS l,"
            f" coalesce(string_agg(b.d, '' ORDER BY b.s) FILTER (b.s > a.s), '') AS h"
            f" FROM {level} a JOIN {level} b ON a.g = b.g AND a.s // 8 = b.s // 8 GROUP BY ALL)"
        )
        parts.append(
            f"way{k + 1} AS (SELECT r, doc_id, {own}g, s // 8 AS s, leaf, CASE WHEN n > 1 THEN sha256(l || f || h) ELSE f END AS f,"
            f" CASE WHEN n > 1 THEN p || l || h ELSE p END AS p FROM {way} JOIN near{k} USING (g, s))"
        )
        parts.append(
            f"level{k + 1} AS (SELECT g, s // 8 AS s, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY s)) ELSE max(d) END AS d,"
            f" (max(n) + 7) // 8 AS n FROM {level} GROUP BY g, s // 8)"
        )
    last = lower + upper
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified"
        f" FROM way{last} JOIN level{last} USING (g, s) JOIN subroots ON subroots.g = lang_g"
    )


OP11 = _merkle()

OP12 = """
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) <= 5),
n AS (
    SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id NULLS LAST, s.br)::INTEGER AS rank
    FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP13 = """
WITH RECURSIVE e AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
           label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS there
    FROM embeddings
),
g AS (SELECT r, vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM e WHERE there),
links AS (
    SELECT a.r AS u, b.r AS v, b.vec_id AS id FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
),
reach(u, v) AS (SELECT r, r FROM e UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT u, min(vec_id) AS component_id FROM reach JOIN e ON e.r = reach.v GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN least ON e.r = least.u LEFT JOIN n ON n.u = e.r
"""


def queries() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op4_url_filters": OP4,
        "op5_decontamination": OP5,
        "op8_run_length_index": OP8,
        "op9_quality_rules": OP9,
        "op11_merkle_manifest": OP11,
        "op12_hard_negatives": OP12,
        "op13_near_embeddings": OP13,
    }
