"""DuckDB SQL for the queries of ``registry`` that SQL can express."""

from __future__ import annotations

#: Constants of the 64-bit XXH hash (fixed values).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORDS = r"[^\x20\x09-\x0D]+"
TWO64 = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: int) -> str:
    return f"(({a}) * {b}::UHUGEINT) % {TWO64}"


def _add(*terms: str) -> str:
    return f"({' + '.join(f'({t})' for t in terms)}) % {TWO64}"


def _turned(x: str, bits: int) -> str:
    """x rotated to the left; x is computed once."""
    return f"list_transform([{x}], lambda v: (v * {1 << bits}::UHUGEINT) % {TWO64} + v // {1 << (64 - bits)}::UHUGEINT)[1]"


def _shifted(x: str, bits: int) -> str:
    return f"list_transform([{x}], lambda v: xor(v, v // {1 << bits}::UHUGEINT))[1]"


def _round(state: str, lane: str) -> str:
    return _mul(_turned(_add(state, _mul(lane, P2)), 31), P1)


def _lane_list(source: str, first: str, count: str, size: int, step: int = 1) -> str:
    """Little-endian numbers of ``size`` bytes from an array of bytes (1-based), count of them, each step lanes apart."""
    value = " + ".join(f"{source}[{first} + i * {size * step} + {j + 1}]::UHUGEINT * {1 << (8 * j)}::UHUGEINT" for j in range(size))
    return f"list_transform(range({count}), lambda i: {value})"


def _xxh64() -> str:
    """The hash of an array of bytes b of n entries, seed 42, as a select list over (key, b, n)."""
    seed = 42
    starts = [(seed + P1 + P2) % 2**64, (seed + P2) % 2**64, seed, (seed - P1) % 2**64]
    walk = lambda init, lanes: f"list_reduce({lanes}, lambda h, x: {_round('h', 'x')}, {init}::UHUGEINT)"
    v = [walk(init, _lane_list("b", str(8 * j), "n // 32", 8, 4)) for j, init in enumerate(starts)]
    lane = _add(_mul(_turned(f"xor(h, {_round('0::UHUGEINT', 'x')})", 27), P1), f"{P4}::UHUGEINT")
    merge = lambda h, x: _add(_mul(f"xor({h}, {_round('0::UHUGEINT', x)})", P1), f"{P4}::UHUGEINT")
    last = f"list_reduce(t8, lambda h, x: {lane}, h0)"
    four = f"list_reduce(t4, lambda h, x: {_add(_mul(_turned(f'xor(h, {_mul('x', P1)})', 23), P2), f'{P3}::UHUGEINT')}, h8)"
    one = f"list_reduce(t1, lambda h, x: {_mul(_turned(f'xor(h, {_mul('x', P5)})', 11), P1)}, h4)"
    mixed = _shifted(_mul(_shifted(_mul(_shifted("h1", 33), P2), 29), P3), 32)
    return f"""
v AS (SELECT g, b, n, {', '.join(f'{x} AS v{i}' for i, x in enumerate(v))} FROM bytes),
joined AS (SELECT *, {_add(*[_turned(f'v{i}', r) for i, r in enumerate((1, 7, 12, 18))])} AS s FROM v),
m0 AS (SELECT *, {merge('s', 'v0')} AS s0 FROM joined), m1 AS (SELECT *, {merge('s0', 'v1')} AS s1 FROM m0), m2 AS (SELECT *, {merge('s1', 'v2')} AS s2 FROM m1), m3 AS (SELECT *, {merge('s2', 'v3')} AS s3 FROM m2),
begun AS (SELECT g, b, n, {_add(f'CASE WHEN n >= 32 THEN s3 ELSE {(seed + P5) % 2**64}::UHUGEINT END', 'n::UHUGEINT')} AS h0, n // 32 * 32 AS d, n % 32 // 8 AS n8, n % 8 // 4 AS n4, n % 4 AS n1 FROM m3),
tails AS (SELECT g, h0, {_lane_list('b', 'd', 'n8', 8)} AS t8, {_lane_list('b', 'd + n8 * 8', 'n4', 4)} AS t4, {_lane_list('b', 'd + n8 * 8 + n4 * 4', 'n1', 1)} AS t1 FROM begun),
r8 AS (SELECT *, {last} AS h8 FROM tails), r4 AS (SELECT *, {four} AS h4 FROM r8), r1 AS (SELECT *, {one} AS h1 FROM r4),
hashes AS (SELECT g, ({mixed})::UBIGINT AS h FROM r1)"""


def _byte_list(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::INTEGER)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Fingerprints from the definition of the hash; components by closure over all pairs of fingerprints.
SIMHASH = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS g FROM d),
bytes AS (SELECT g, b, len(b) AS n FROM (SELECT g, {_byte_list('g')} AS b FROM (SELECT DISTINCT g FROM s))),
{_xxh64()},
votes AS (SELECT r, count(*) AS n, list_transform(range(64), lambda i: 0) AS none, {', '.join(f'sum((h >> {i}) & 1) AS b{i}' for i in range(64))} FROM s JOIN hashes USING (g) GROUP BY r),
f AS (SELECT d.doc_id, coalesce({' + '.join(f'CASE WHEN 2 * b{i} > n THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END' for i in range(64))}, 0)::UBIGINT AS fp FROM d LEFT JOIN votes USING (r)),
u AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
e AS (SELECT x.fp AS a, y.fp AS b FROM u x, u y WHERE x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)::UHUGEINT::HUGEINT) <= 4),
reach(a, b) AS (SELECT fp, fp FROM u UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN u ON u.fp = reach.b GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN c USING (fp)
"""

#: Targets by the closed form of repeated sharing, and the whole slot schedule.
MIXING = rf"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
wt AS (SELECT *, (place - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM own),
fill AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(most) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS gone FROM wt
  WINDOW w AS (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (total - used)::DOUBLE / (weights - gone)::DOUBLE AS own_level FROM fill),
lw AS (SELECT *, first_value(CASE WHEN own_level * weight <= most THEN own_level END IGNORE NULLS) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM lv),
t AS (SELECT source, source_size, place, coalesce(least(most::DOUBLE, level * weight), most::DOUBLE) AS target FROM lw),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.place, md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS h FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, row_number() OVER () AS r, (coalesce(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place_at FROM p),
c AS (SELECT r, place, place_at + k * source_size AS begin_at, least(place_at + k * source_size + size, round(target)::BIGINT) AS end_at FROM q, (VALUES (0), (1), (2)) x(k) WHERE size > 0 AND place_at + k * source_size < round(target)::BIGINT),
b AS (SELECT r, place, rank, least(end_at, (rank + 1) * 1024) - greatest(begin_at, rank * 1024) AS words FROM (SELECT *, unnest(range(begin_at // 1024, (end_at - 1) // 1024 + 1)) AS rank FROM c)),
n AS (SELECT ((SELECT sum(size) FROM s) + 1023) // 1024 AS n),
pts AS (SELECT slot, ((slot % 4294967296) * 1640531527 % 4294967296) / 4294967296.0::DOUBLE AS point FROM (SELECT unnest(range((SELECT n FROM n)::BIGINT)) AS slot)),
bd AS (SELECT place, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(target) OVER (), 0) AS low, sum(target) OVER (ORDER BY place) / nullif(sum(target) OVER (), 0) AS high, ceil(target / 1024)::BIGINT AS need FROM t),
dealt AS (SELECT * FROM (SELECT place, need, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM pts JOIN bd ON point >= low AND point < high) WHERE rank < need),
had AS (SELECT bd.place, need, count(slot) AS had FROM bd LEFT JOIN dealt USING (place, need) GROUP BY ALL),
closing AS (SELECT place, rank, (SELECT n FROM n) - 1 + row_number() OVER (ORDER BY rank - had, place) AS slot FROM (SELECT *, unnest(range(had, need)) AS rank FROM had)),
slots AS (SELECT place, rank, slot FROM dealt UNION ALL SELECT place, rank, slot FROM closing),
taken AS (SELECT r, sum(words) AS taken, count(*) AS slots, min(slot) AS first_slot FROM b JOIN slots USING (place, rank) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(slots, 0)::BIGINT AS slots, coalesce(first_slot, -1)::BIGINT AS first_slot FROM q LEFT JOIN taken USING (r)
"""

#: Every run of 50 words against the first document that holds it; unions of the runs that overlap or touch.
SUFFIXES = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORDS}') AS w FROM d),
g AS (SELECT doc_id, text, s, array_to_string(w[s + 1 : s + 50], ' ') AS run FROM (SELECT *, unnest(range(len(w) - 49)) AS s FROM w WHERE len(w) >= 50)),
f AS (SELECT run, min(doc_id) AS first FROM g GROUP BY run),
h AS (SELECT doc_id, text, s, CASE WHEN s <= lag(s) OVER o + 50 THEN 0 ELSE 1 END AS opens FROM g JOIN f USING (run) WHERE doc_id > first WINDOW o AS (PARTITION BY doc_id, text ORDER BY s)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, text ORDER BY s) AS island FROM h)
SELECT doc_id, min(s)::INTEGER AS start_word, (max(s) + 50)::INTEGER AS end_word FROM i GROUP BY doc_id, text, island
"""

_PLAIN = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

#: The similarity of every window that sets a shingle of an item on its place, by brute force.
DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m FROM (SELECT DISTINCT item_id, {_PLAIN} AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT i, k, m, o, array_to_string(w[o + 1 : o + k], ' ') AS g FROM (SELECT *, unnest(range(m)) AS o FROM i)),
dg AS (SELECT r, k, n, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT r, w, k, len(w) - k + 1 AS n, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
hit AS (SELECT r, i, k, n, m, p, o, g FROM dg JOIN ig USING (k, g)),
st AS (SELECT DISTINCT r, i, k, n, m, greatest(0, least(p - o, n - m)) AS start FROM hit),
pl AS (SELECT DISTINCT r, i, p, g FROM hit),
ic AS (SELECT i, g, count(*) AS c FROM ig GROUP BY ALL),
wc AS (SELECT st.r, st.i, st.k, st.n, st.m, st.start, pl.g, count(*) AS c FROM st JOIN pl ON pl.r = st.r AND pl.i = st.i AND pl.p >= st.start AND pl.p < st.start + st.m GROUP BY ALL),
co AS (SELECT r, wc.i, k, n, m, start, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic ON ic.i = wc.i AND ic.g = wc.g GROUP BY ALL),
sim AS (SELECT r, i, start, least(m, n - start) AS size, k, common::DOUBLE / (least(m, n - start) + m - common)::DOUBLE AS similarity FROM co),
best AS (SELECT d.doc_id, i.item_id, arg_max({{'start': start, 'size': size, 'k': sim.k, 's': similarity}}, (similarity, -start)) AS b FROM sim JOIN d USING (r) JOIN i USING (i) WHERE similarity >= 0.8 GROUP BY ALL)
SELECT doc_id, item_id, b.start::INTEGER AS start_word, (b.size + b.k - 1)::INTEGER AS n_words, b.s AS similarity FROM best
"""

_LITTLE = "printf('%02X%02X%02X%02X', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216 % 256)"
_HEADER = " || ".join([
    "'52494646'", _LITTLE.format("payload_bytes + 36"), "'57415645666D74201000000001000100'", _LITTLE.format("8000"), _LITTLE.format("8000"), "'0100080064617461'", _LITTLE.format("payload_bytes"),
])

#: The stored file from its header's fields; spectra by the definition of the Fourier transform.
MEDIA = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, doc_id, strlen(text) AS n_bytes, greatest((strlen(text) + 191) // 192, 1) * 192 AS payload_bytes, text || repeat(' ', greatest((strlen(text) + 191) // 192, 1) * 192 - strlen(text)) AS payload FROM t),
m AS (SELECT *, unhex({_HEADER}) || encode(payload) AS media, {_byte_list('payload')} AS b FROM p),
bits AS (SELECT r, list_reduce(b[-16:], lambda c, x: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(c, x::BIGINT)), 4294967295::BIGINT) AS c FROM m),
fr AS (SELECT r, i AS frame, list_transform(b[i * 256 + 1 : i * 256 + 256] || list_transform(range(greatest(0, (i + 1) * 256 - payload_bytes)), lambda z: 128), lambda x, j: (x - 128) * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / 255)))::DOUBLE[256] AS x
  FROM (SELECT r, b, payload_bytes, unnest(range((payload_bytes + 255) // 256)) AS i FROM m)),
wave AS (SELECT k, list_transform(range(256), lambda j: cos(2 * pi() * (j * k % 256) / 256))::DOUBLE[256] AS re, list_transform(range(256), lambda j: sin(2 * pi() * (j * k % 256) / 256))::DOUBLE[256] AS im FROM (SELECT unnest(range(1, 129)) AS k)),
pw AS (SELECT r, frame, k, round(log2(sqrt(power(array_inner_product(x, re), 2) + power(array_inner_product(x, im), 2)) + 1e-3) * 1048576) AS level FROM fr, wave),
pk AS (SELECT r, frame, arg_max(k, (level, -k)) AS peak FROM pw GROUP BY ALL),
pr AS (SELECT a.r, a.frame, a.peak * 65536 + z.peak * 16 + z.frame - a.frame AS code FROM pk a JOIN pk z ON z.r = a.r AND z.frame IN (a.frame + 1, a.frame + 2, a.frame + 3)
  UNION ALL SELECT r, 0, any_value(peak) * 65536 FROM pk GROUP BY r HAVING count(*) = 1),
ft AS (SELECT r, count(*) || ':' || sha256(string_agg(frame || ':' || code, ',' ORDER BY frame, code)) AS feature FROM pr GROUP BY r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, xor(c, 4294967295::BIGINT) AS tail_crc32, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256, feature
FROM m JOIN bits USING (r) JOIN ft USING (r)
"""
