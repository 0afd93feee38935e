"""DuckDB SQL for the queries that SQL can express, each in the plainest form that gives the same rows."""

from __future__ import annotations

from .mixing import MOST_COPIES
from .url_filter import DAMPING, ROUNDS

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""

_JUMP = "CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT)"


def _jump(name: str, shards: int) -> str:
    """A recursive step for each jump; k is the generator's state as an unsigned 64-bit number."""
    step = "(k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT"
    return f"""{name}(doc_id, b, j, k) AS (
  SELECT doc_id, -1::BIGINT, 0::BIGINT, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT FROM documents
  UNION ALL SELECT doc_id, j, {_JUMP}, k FROM (SELECT doc_id, j, {step} AS k FROM {name} WHERE j < {shards}))"""


OP5 = f"""
WITH RECURSIVE {_jump("j16", 16)}, {_jump("j17", 17)},
t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, t),
f AS (SELECT c.*, a.shard, g.grown_shard FROM c
      JOIN (SELECT doc_id, max(b) AS shard FROM j16 WHERE j >= 16 GROUP BY doc_id) a ON a.doc_id = c.doc_id
      JOIN (SELECT doc_id, max(b) AS grown_shard FROM j17 WHERE j >= 17 GROUP BY doc_id) g ON g.doc_id = c.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM f
"""

OP7 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i AS a, substr(h, 2 * i + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM h WHERE len(h) >= 400)),
m AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
p AS (SELECT doc_id, a FROM w WHERE s IN (SELECT s FROM m)),
b AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 200 THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT doc_id, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM b),
r AS (SELECT doc_id, run, min(a) AS a, max(a) + 200 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT r.doc_id, run, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY run), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY run), 0))) AS part, z, z - a AS n FROM r JOIN h ON h.doc_id = r.doc_id),
o AS (SELECT doc_id, string_agg(part, '' ORDER BY run) AS parts, max(z) AS z, sum(n) AS n, count(*) AS runs FROM k GROUP BY doc_id)
SELECT h.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(o.n, 0) AS BIGINT) AS n_removed, coalesce(o.runs, 0) AS n_spans,
       sha256(unhex(coalesce(o.parts, '') || substr(h, 2 * coalesce(o.z, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN o ON o.doc_id = h.doc_id
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op9(rules: tuple[str, ...], threshold: float = 0.001) -> str:
    """The rules as rows; a common table expression for each round of propagation."""
    rows = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, _, r in (x.partition(" ") for x in rules))
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"r{k + 1} AS (SELECT kind, host, sum(s) AS s FROM (SELECT f.kind, f.dst AS host, r.s * f.part * {DAMPING} AS s FROM r{k} r JOIN f ON f.kind = r.kind AND f.src = r.host UNION ALL SELECT kind, host, s * {1 - DAMPING} FROM r0) GROUP BY 1, 2)")
    return rf"""
WITH rules(v, rh, rp, rule) AS (VALUES {rows}),
p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT p.*, (SELECT arg_max(struct_pack(rule := rule, v := v), len(rule)) FROM rules WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS best FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (best.v = 'block') AS nb, count(*) FILTER (best.v = 'allow') AS na FROM j WHERE host <> '' GROUP BY host),
x AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)) AS t FROM p),
e AS (SELECT src, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(*) AS weight FROM x GROUP BY 1, 2 HAVING src <> dst AND src <> ''),
b AS (SELECT 'trust' AS kind, src, dst, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
f AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS part FROM b),
m AS (SELECT 'distrust' AS kind, host FROM h WHERE nb * 2 > n UNION ALL SELECT 'trust', host FROM h WHERE na > 0 AND nb * 2 <= n),
r0 AS (SELECT kind, host, 1.0::DOUBLE AS s FROM m),
{", ".join(rounds)},
z AS (SELECT host, round(coalesce(sum(s) FILTER (kind = 'trust'), 0), 9) AS trust, round(coalesce(sum(s) FILTER (kind = 'distrust'), 0), 9) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, best.rule AS rule, coalesce(best.v, CASE WHEN coalesce(distrust, 0) >= {threshold} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN z ON z.host = j.host
"""


OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS draw FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS digits FROM d),
s AS (SELECT source, coalesce('=' || source, '') AS skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {MOST_COPIES} AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
v AS (SELECT level AS share FROM l WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, skey LIMIT 1),
t AS (SELECT skey, source_size, least(cap::DOUBLE, coalesce((SELECT share FROM v), 'infinity'::DOUBLE) * weight) AS target FROM w),
k AS (SELECT coalesce('=' || source, '') AS skey, digits, sum(size) AS words FROM e GROUP BY ALL),
p AS (SELECT k.*, target, (target - {MOST_COPIES} * coalesce(sum(words) OVER (PARTITION BY skey ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
   / nullif(sum(words * digits) OVER (PARTITION BY skey) - coalesce(sum(words * digits) OVER (PARTITION BY skey ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::DOUBLE AS level FROM k JOIN t USING (skey)),
x AS (SELECT skey, arg_max(level, digits) AS share FROM p WHERE level * digits <= {MOST_COPIES} GROUP BY skey),
y AS (SELECT p.skey, digits, words, greatest(least({MOST_COPIES}.0::DOUBLE, coalesce(share, 'infinity'::DOUBLE) * digits), 0) AS expected FROM p LEFT JOIN x USING (skey)),
g AS (SELECT skey, digits, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS chance, CAST(sum(words * floor(expected)) OVER (PARTITION BY skey) AS DOUBLE) AS sure FROM y),
q AS (SELECT e.*, t.source_size, t.target, certain, chance, t.target - sure AS rest FROM e JOIN t ON t.skey = coalesce('=' || e.source, '') JOIN g ON g.skey = t.skey AND g.digits = e.digits),
o AS (SELECT *, CASE WHEN chance > 0 THEN ((draw + 0.5::DOUBLE) / (281474976710656.0::DOUBLE - (draw + 0.5::DOUBLE))) / (chance / (1.0::DOUBLE - chance)) ELSE 'infinity'::DOUBLE END AS pareto FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto, doc_id, size, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS upto FROM o)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (certain + CASE WHEN chance > 0 AND upto < rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken FROM c
"""
