"""DuckDB twins of the corpus queries that SQL can express.

Left out: op1 (fingerprints), op2 and op10 (fitted models), op9 (tokenizer) and the
pipeline; their tests compare with brute force, the published library or held-out rows.
"""

from __future__ import annotations

from churnlens.llm import chat_format, sharding, url_filter, warc

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE["op3_jaccard_join"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM pos),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM reach JOIN words ON words.doc_id = reach.x LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

ORACLE["op4_quality_rules"] = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range(3)) AS k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
         FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 5 * n_shouts > n_words THEN 8 ELSE 0 END
    + CASE WHEN n_dup_lines >= 2 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM b"""

_BASE32 = " || ".join(
    f"substr('{warc._BASE32}', (((('0x' || substr(h, {k}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)"
    for k in range(1, 41, 5) for s in (15, 10, 5, 0))

ORACLE["op5_warc"] = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri FROM o"""


def _sql_host(url: str) -> str:
    rest = f"CASE WHEN strpos(coalesce({url}, ''), '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return (f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
            f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)")


def _op6() -> str:
    host, path = _sql_host("url")
    link_host, _ = _sql_host("(CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END)")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules))
    link = url_filter.LINK.replace("'", "''")
    d = url_filter.DAMPING
    rounds = []
    for k in range(1, url_filter.ROUNDS + 1):
        rounds.append(f"""s{k} AS (SELECT host, kind, sum(score) AS score FROM (
  SELECT host, kind, (1 - {d}) * seed AS score FROM seeds UNION ALL
  SELECT w.dest, w.kind, {d} * w.share * s.score FROM ways w JOIN s{k - 1} s ON s.host = w.origin AND s.kind = w.kind) GROUP BY ALL)""")
    return f"""
WITH p AS (SELECT page_id, html, {host} AS host, {path} AS path FROM pages),
j AS (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict FROM p),
l AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM j),
hosts AS (SELECT DISTINCT host FROM j WHERE host <> ''),
up AS (SELECT host, unnest(list_transform(range(2, len(string_split(host, '.')) + 1),
         lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS dst FROM hosts),
edges AS (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT host AS src, {link_host} AS dst, 1 AS n FROM l UNION ALL
    SELECT host, dst, 1 FROM up WHERE dst IN (SELECT host FROM hosts))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT src AS origin, dst AS dest, 'trust' AS kind, n FROM edges UNION ALL SELECT dst, src, 'distrust', n FROM edges),
ways AS (SELECT origin, dest, kind, n / sum(n) OVER (PARTITION BY origin, kind) AS share FROM both_ways),
seeds AS (SELECT host, CASE rule_verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*)::DOUBLE AS seed
  FROM j WHERE rule IS NOT NULL GROUP BY ALL),
s0 AS (SELECT host, kind, seed AS score FROM seeds),
{', '.join(rounds)},
v AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
  FROM s{url_filter.ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN round(distrust - trust - {url_filter.MARGIN} * (distrust + trust), 6) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM j LEFT JOIN v USING (host)"""


ORACLE["op6_url_filter"] = _op6()

_O, _C = chat_format.OPEN, chat_format.CLOSE
ORACLE["op7_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, max(i) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
r AS (
  SELECT conv_id, i, role, text FROM t JOIN c USING (conv_id) WHERE i < coalesce(last, n) UNION ALL
  SELECT c.conv_id, coalesce(c.last, c.n), t.role, t.text FROM c JOIN c d ON d.conv_id = xor(c.conv_id, 1)
  JOIN t ON t.conv_id = d.conv_id AND t.i = d.last),
diff AS (
  SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, min(coalesce(t.i, r.i)) AS k FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.i = r.i
  WHERE t.i IS NULL OR r.i IS NULL OR t.role <> r.role OR t.text <> r.text GROUP BY ALL),
cut AS (SELECT conv_id, coalesce(k, n) AS k FROM c LEFT JOIN diff USING (conv_id)),
turns AS (SELECT conv_id, 'c' AS side, i, role, text FROM t UNION ALL SELECT conv_id, 'r', i, role, text FROM r),
shown AS (
  SELECT turns.*, i < k AS common, '{_O}' || role || chr(10) || text || '{_C}' || chr(10) AS shown FROM turns JOIN cut USING (conv_id)),
placed AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side, common ORDER BY i) - length(shown) AS since FROM shown),
parts AS (
  SELECT conv_id, side, common, string_agg(shown, '' ORDER BY i) AS body,
    string_agg((since + {len(_O) + 1} + length(role))::BIGINT || '-' || (since + length(shown) - 1)::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS loss
  FROM placed GROUP BY ALL)
SELECT cut.conv_id AS pair_id, cut.k::BIGINT AS n_prompt_turns, coalesce(p.body, '') AS prompt,
  coalesce(a.body, '') AS chosen, coalesce(b.body, '') AS rejected, coalesce(a.loss, '') AS chosen_loss,
  coalesce(b.loss, '') AS rejected_loss, a.body IS NULL AND b.body IS NULL AS identical
FROM cut LEFT JOIN parts p ON p.conv_id = cut.conv_id AND p.side = 'c' AND p.common
LEFT JOIN parts a ON a.conv_id = cut.conv_id AND a.side = 'c' AND NOT a.common
LEFT JOIN parts b ON b.conv_id = cut.conv_id AND b.side = 'r' AND NOT b.common"""

_M, _N = sharding.TABLE_SIZE, len(sharding.SHARDS)
ORACLE["op8_sharding"] = f"""
WITH RECURSIVE names AS (SELECT k, printf('shard-%03d', k) AS shard FROM range({_N}) r(k)),
prefs AS (
  SELECT list((('0x' || substr(md5('offset:' || shard), 1, 12))::BIGINT % {_M}) ORDER BY k) AS offs,
    list((('0x' || substr(md5('skip:' || shard), 1, 12))::BIGINT % {_M - 1} + 1) ORDER BY k) AS skips FROM names),
claims(turn, slot, free) AS (
  SELECT 0::BIGINT, (-1)::BIGINT, list_resize(CAST([] AS BOOLEAN[]), {_M}, true) UNION ALL
  SELECT turn + 1, slot, list_transform(free, lambda f, i: f AND i - 1 <> slot) FROM (
    SELECT turn, free, list_filter(list_transform(range({_M}), lambda j: (offs[turn % {_N} + 1] + j * skips[turn % {_N} + 1]) % {_M}),
      lambda s: free[s + 1])[1] AS slot FROM claims, prefs WHERE turn < {_M})),
owner AS (SELECT slot, shard FROM claims JOIN names ON k = (turn - 1) % {_N} WHERE turn > 0),
keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {_M} AS slot FROM documents)
SELECT doc_id, slot, shard FROM keyed JOIN owner USING (slot)"""


_FIM_H = "('0x' || substr(h, {0}, 8))::BIGINT"
_FIM_UNITS = "array_to_string(u[{0}:{1}], '')"

ORACLE["op11_fill_middle"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, {_FIM_H.format(1)} % (len(u) + 1) AS x, {_FIM_H.format(9)} % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_FIM_H.format(17)} % 100 >= 100
    THEN 'plain' WHEN {_FIM_H.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, {_FIM_UNITS.format(1, 'least(x, y)')} AS pre, {_FIM_UNITS.format('least(x, y) + 1', 'greatest(x, y)')} AS mid,
  {_FIM_UNITS.format('greatest(x, y) + 1', 'n')} AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
