"""DuckDB SQL for the training-data queries that SQL can express.

The others need a tokenizer's ids, XXH64 hashes, a trained network, a rolling
hash or an alignment; their tests compare them with brute force.
"""

from __future__ import annotations

from acyclica.llm.queries import N_SHARDS, URL_RULES
from acyclica.llm.quality import Limits
from acyclica.llm.timestamps import MONTHS

_SHARD = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, md5('42:' || CAST(doc_id AS VARCHAR)) AS m FROM documents),
b AS (SELECT d.*, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d),
c AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32, strlen(text) + 16 AS size FROM b, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source, no_source ORDER BY m, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source, no_source) AS n FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY (rank + CAST('0x' || substr(md5('42:' || CASE WHEN no_source THEN '' ELSE 's' || source END), 1, 8) AS BIGINT) / 4294967296::DOUBLE) / n, no_source DESC, source, rank) - 1 AS g, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(g * {N_SHARDS} // total AS INTEGER) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY g) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
_URLS = f"""
WITH rules(verdict, rule, host, path) AS (VALUES {_RULES}),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT p.*, (SELECT r.rule FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) ORDER BY length(r.rule) DESC LIMIT 1) AS rule FROM p)
SELECT m.page_id, m.host, m.path, m.rule, coalesce((SELECT r.verdict FROM rules r WHERE r.rule = m.rule), 'allow') AS verdict FROM m
"""

_L = Limits()
_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(CAST(source AS VARCHAR), '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, i, words[i : i + 4] AS key FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, key) AS n FROM win) WHERE n > 1),
hit AS (SELECT k, count(DISTINCT i + j) AS n FROM dup, range(5) AS t(j) GROUP BY k),
f AS (SELECT w.k, doc_id, host, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(hit.n, 0) AS n_repeat_words FROM w LEFT JOIN hit ON hit.k = w.k),
b AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_percent} * n_words AS base_failed FROM f),
x AS (SELECT *, base_failed OR 100 * n_symbols > {_L.max_symbol_percent} * word_chars OR 100 * n_dup_lines > {_L.max_dup_line_percent} * n_lines AS failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS bad FROM x GROUP BY host),
m AS (SELECT avg(bad / n) AS mean, coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM m),
v AS (SELECT h.host, (bad + weight * mean) / (n + weight) AS rate, mean FROM h, q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rate <= {_L.max_host_rate} AND rate <= {_L.max_host_ratio} * mean + 1e-9 AS kept FROM x JOIN v ON v.host = x.host
"""

_CLOCK = r"([T ]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP]M))?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
_MONTHS = ", ".join(f"'{m}'" for m in MONTHS)
_ZONES = "SELECT name FROM pg_timezone_names()"
#: Offsets at instants are unambiguous; those a day about a wall time tell which one holds, as no zone changes twice in two days.
_STAMPS = rf"""
WITH s AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
f AS (SELECT *, CASE
    WHEN regexp_full_match(t, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{_CLOCK}') THEN [t[1:4], t[6:7], t[9:10], '', t[11:]]
    WHEN regexp_full_match(t, '20[0-9]{{6}}{_CLOCK}') THEN [t[1:4], t[5:6], t[7:8], '', t[9:]]
    WHEN regexp_full_match(t, '[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}{_CLOCK}') THEN [t[7:10], t[4:5], t[1:2], '', t[11:]]
    WHEN regexp_full_match(t, '[0-9]{{2}} ({'|'.join(MONTHS)}) 20[0-9]{{2}}{_CLOCK}') THEN [t[8:11], lpad(CAST(list_position([{_MONTHS}], t[4:6]) AS VARCHAR), 2, '0'), t[1:2], '', t[12:]]
    WHEN regexp_full_match(t, '[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}{_CLOCK}') THEN [t[7:10], t[4:5], t[1:2], '/', t[11:]] END AS p,
  CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN CAST(t AS BIGINT) * 1000 END AS epoch FROM s),
g AS (SELECT *, TRY_CAST(p[1] || '-' || p[2] || '-' || p[3] AS DATE) AS dm0, CASE WHEN p[4] = '/' THEN TRY_CAST(p[1] || '-' || p[3] || '-' || p[2] AS DATE) ELSE TRY_CAST(p[1] || '-' || p[2] || '-' || p[3] AS DATE) END AS md0,
  coalesce(TRY_CAST(p[5][2:3] AS INT), 0) AS h, coalesce(TRY_CAST(p[5][5:6] AS INT), 0) AS mi, coalesce(TRY_CAST(nullif(regexp_extract(p[5], '^.[0-9]{{2}}:[0-9]{{2}}:([0-9]{{2}})', 1), '') AS INT), 0) AS sec,
  nullif(regexp_extract(p[5], '([AP]M)', 1), '') AS half, nullif(regexp_extract(p[5], '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1), '') AS o FROM f),
k AS (SELECT *, CASE WHEN half IS NULL THEN h ELSE h % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END END AS h24,
  CASE WHEN o = 'Z' THEN 0 ELSE (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(o[2:3] AS INT) * 60 + TRY_CAST(o[-2:] AS INT)) END AS own,
  (CASE WHEN half IS NULL THEN h <= 23 ELSE h BETWEEN 1 AND 12 END) AND mi <= 59 AND sec <= 59 AND (o IS NULL OR o = 'Z' OR (TRY_CAST(o[2:3] AS INT) <= 14 AND TRY_CAST(o[-2:] AS INT) <= 59))
    AND (o IS NOT NULL OR coalesce(zone IN ({_ZONES}), false)) AS ok FROM g),
d AS (SELECT *, CASE WHEN ok THEN dm0 END AS dm, CASE WHEN ok THEN md0 END AS md FROM k),
v AS (SELECT source, count(*) FILTER (md IS NULL) AS dms, count(*) FILTER (dm IS NULL) AS mds FROM d WHERE p[4] = '/' AND (dm IS NULL) <> (md IS NULL) GROUP BY source),
r AS (SELECT d.*, CASE WHEN dm <> md THEN (CASE WHEN coalesce(dms, 0) > 3 * coalesce(mds, 0) OR coalesce(mds, 0) > 3 * coalesce(dms, 0) THEN 'votes' ELSE 'default' END) WHEN epoch IS NOT NULL THEN 'epoch' WHEN coalesce(dm, md) IS NULL THEN 'bad' ELSE 'plain' END AS rule,
  CASE WHEN dm <> md THEN (CASE WHEN coalesce(dms, 0) > 3 * coalesce(mds, 0) THEN dm ELSE md END) ELSE coalesce(dm, md) END AS day FROM d LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source),
w AS (SELECT stamp_id, zone, rule, epoch, own, o, day + CAST(h24 * 3600 + mi * 60 + sec AS INT) * INTERVAL 1 SECOND AS wall FROM r),
x AS (SELECT *, epoch_us(wall) AS wall_us, CASE WHEN o IS NULL AND rule NOT IN ('bad', 'epoch') THEN zone END AS z FROM w),
b AS (SELECT *, epoch_us(timezone(z, make_timestamptz(wall_us - 86400000000))) - (wall_us - 86400000000) AS ob, epoch_us(timezone(z, make_timestamptz(wall_us + 86400000000))) - (wall_us + 86400000000) AS oa FROM x),
c AS (SELECT *, epoch_us(timezone(z, make_timestamptz(wall_us - ob))) - (wall_us - ob) = ob AS vb, epoch_us(timezone(z, make_timestamptz(wall_us - oa))) - (wall_us - oa) = oa AS va FROM b)
SELECT stamp_id, CAST(CASE WHEN rule = 'bad' THEN NULL WHEN rule = 'epoch' THEN epoch WHEN z IS NULL THEN wall_us - own * 60000000::BIGINT WHEN ob = oa OR vb OR NOT va THEN wall_us - ob ELSE wall_us - oa END AS BIGINT) AS utc_us,
  rule, rule IN ('votes', 'default') OR coalesce(ob <> oa AND va = vb, false) AS ambiguous FROM c
"""

_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS t(k) WHERE len(w) >= k),
c AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT * FROM c WHERE k > 1 AND f >= 100),
inner_parts AS (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[:-2], ' ')]) AS phrase FROM a WHERE k > 2),
most AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT a.* FROM a LEFT JOIN most USING (lang, phrase) WHERE most.f IS NULL OR 100 * most.f < 100 * a.f),
cuts AS (SELECT lang, k, phrase, f, unnest(range(1, k)) AS cut FROM kept),
parts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS y FROM cuts),
s AS (SELECT parts.*, cl.f AS l, cr.f AS r, n.n, 1000 * CAST(parts.f AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(cl.f AS HUGEINT) * CAST(cr.f AS HUGEINT)) AS score
  FROM parts JOIN c cl ON cl.lang = parts.lang AND cl.phrase = x JOIN c cr ON cr.lang = parts.lang AND cr.phrase = y JOIN n ON n.lang = parts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op2_sharding": _SHARD, "op3_url_filter": _URLS, "op8_quality_rules": _QUALITY, "op11_timestamps": _STAMPS, "op12_collocations": _PHRASES}
