"""DuckDB SQL for the queries of this subpackage that SQL can express.

Operators 1, 3, 5, 8 and 10 (suffix arrays, MinHash over lines, validated spans, learned models) are tested against plain
versions on small tables instead.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = "coalesce(text, '')"
_FOLDED = f"translate({_TEXT}, '{_UPPER}', '{_LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_NAMES = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all({_TEXT}, {_WORDS})) AS BIGINT) AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * weight) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT size, CAST(r * source_size + cum AS DOUBLE) / target AS finish FROM q, range(3) AS x(r) WHERE size > 0),
e AS (SELECT min(finish) AS cut FROM (SELECT finish, sum(n) OVER (ORDER BY finish) AS run FROM (SELECT finish, sum(size) AS n FROM f GROUP BY finish)) WHERE run > (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * len(list_filter([0, 1, 2], lambda r: CAST(r * source_size + cum AS DOUBLE) / target < coalesce(cut, 'infinity'::DOUBLE))) END AS BIGINT) AS taken FROM q, e
"""

PHRASES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_TEXT}, {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_NAMES}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_NAMES}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, 2 + len(w) - least(13, len(w)))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SAFE = "replace(coalesce({x}, ''), '<|', '< |')"
_RENDER = "coalesce(array_to_string(list_transform({l}, lambda t: '<|' || " + _SAFE.format(x="t.role") + " || '|>' || chr(10) || " + _SAFE.format(x="t.text") + " || '<|end|>' || chr(10)), ''), '')"
_HEAD = "(5 + length(" + _SAFE.format(x="t.role") + "))"
_SIZE = "(" + _HEAD + " + length(" + _SAFE.format(x="t.text") + ") + 8)"
_MASK = "coalesce(array_to_string(list_filter(list_transform({l}, lambda t, i: CASE WHEN t.role = 'assistant' THEN CAST(coalesce(list_sum(sizes_{s}[1:i-1]), 0) + " + _HEAD + " AS BIGINT) || ':' || CAST(list_sum(sizes_{s}[1:i]) AS BIGINT) END), lambda x: x IS NOT NULL), ','), '')"

PREFERENCES = f"""
WITH c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT a.conv_id, CAST(floor(a.conv_id / 2.0) AS BIGINT) AS pair_id, a.t AS chosen, CASE WHEN b.t IS NULL THEN a.t[1:len(a.t)//2] ELSE list_concat(a.t[1:len(a.t)//2], b.t[len(a.t)//2+1:]) END AS rejected FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id + CASE WHEN a.conv_id % 2 = 0 THEN 1 ELSE -1 END),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, 1 + least(len(chosen), len(rejected))), lambda i: chosen[i].role IS NOT DISTINCT FROM rejected[i].role AND chosen[i].text IS NOT DISTINCT FROM rejected[i].text), FALSE) - 1, least(len(chosen), len(rejected))) AS n_common FROM p),
m AS (SELECT conv_id, pair_id, CASE WHEN n_common < 0 THEN least(len(chosen), len(rejected)) ELSE n_common END AS n_common, chosen, rejected FROM n),
k AS (SELECT conv_id, pair_id, n_common, chosen[1:n_common] AS prompt, chosen[n_common+1:] AS c, rejected[n_common+1:] AS r FROM m),
z AS (SELECT *, list_transform(c, lambda t: {_SIZE}) AS sizes_c, list_transform(r, lambda t: {_SIZE}) AS sizes_r FROM k)
SELECT conv_id, pair_id, CAST(n_common AS BIGINT) AS n_common, sha256({_RENDER.format(l="prompt")}) AS prompt_sha256, sha256({_RENDER.format(l="c")}) AS chosen_sha256, sha256({_RENDER.format(l="r")}) AS rejected_sha256,
{_MASK.format(l="c", s="c")} AS chosen_mask, {_MASK.format(l="r", s="r")} AS rejected_mask FROM z
"""

ORACLE_SQL: dict[str, str] = {
    "op2_weighted_fair_mix": MIX,
    "op4_repeated_phrases": PHRASES,
    "op6_near_duplicates": NEAR,
    "op7_preference_format": PREFERENCES,
    "op9_decontaminate": DECONTAMINATE,
}
