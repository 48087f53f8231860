"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ratewise.llm import mixing, pii, url_reputation

OP1 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
slots AS (SELECT conv_id, turn, list({'r': role, 't': text} ORDER BY role NULLS FIRST, text NULLS FIRST) AS said FROM t GROUP BY ALL),
convs AS (SELECT conv_id, count(*) AS n, list({'k': turn, 's': said} ORDER BY turn) AS turns FROM slots GROUP BY conv_id),
same AS (SELECT min(conv_id) AS conv_id, n, turns, count(*) AS copies FROM convs GROUP BY n, turns),
kept AS (SELECT * FROM same a WHERE NOT EXISTS (
  SELECT 1 FROM same b WHERE b.n > a.n AND b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns)),
lines AS (SELECT DISTINCT conv_id, CAST(floor(turn / 256.0) AS BIGINT) AS part, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
clean AS (SELECT *, replace(replace(r, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS cr,
  replace(replace(x, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS cx FROM lines),
said AS (SELECT conv_id, part, string_agg('<|im_start|>' || cr || chr(10) || cx || '<|im_end|>' || chr(10), '' ORDER BY turn, r, x) AS text
  FROM clean GROUP BY conv_id, part)
SELECT s.conv_id, s.part, k.n AS n_turns, k.copies, s.text, CAST(length(s.text) AS BIGINT) AS n_chars
FROM said s JOIN kept k USING (conv_id)
"""


def _op2(rules=url_reputation.RULES, max_bad_rate: float = 0.5, z: float = 1.645) -> str:
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
            for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    case = lambda pick: "CASE " + " ".join(f"WHEN {c} THEN '{pick(r)}'" for c, r in fits) + " END"
    second = ", ".join(f"'{s}'" for s in url_reputation.SECOND_LEVEL)

    def level(name: str, source: str, keep: str) -> str:
        return f"""
{name}_k AS (SELECT coalesce(least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 10000.0 END, 1.0), 10000.0), 10000.0) AS k FROM (
  SELECT CASE WHEN sum(mu * (1 - mu) * (n - 1)) > 0
    THEN sum(n * pow(bad::DOUBLE / n - mu, 2) - mu * (1 - mu)) / sum(mu * (1 - mu) * (n - 1)) END AS rho FROM {source} WHERE n > 0)),
{name} AS (SELECT {keep}, n, bad, k, (k * mu + bad) / (k + n) AS rate FROM {source}, {name}_k)"""

    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
v AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
o AS (SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
  HAVING max(greatest(toxic, 1 - quality)) IS NOT NULL),
s0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM v LEFT JOIN o USING (page_id) GROUP BY host),
s1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM s0),
s2 AS (SELECT *, string_split(site, '.') AS p, len(string_split(site, '.')) AS m,
  regexp_matches(site, '^[0-9.]+$') OR contains(site, '[') AS num FROM s1),
s3 AS (SELECT *, m >= 3 AND length(p[m]) = 2 AND p[m - 1] IN ({second}) AS lng FROM s2),
sites AS (SELECT host, n, bad,
  CASE WHEN num THEN '' WHEN lng THEN array_to_string(p[m - 1:], '.') ELSE p[m] END AS suffix,
  CASE WHEN num THEN site WHEN lng THEN array_to_string(p[m - 2:], '.') ELSE array_to_string(p[greatest(m - 1, 1):], '.') END AS domain FROM s3),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM sites GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
a0 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM suffixes) AS mu FROM suffixes),
{level('a', 'a0', 'suffix')},
b0 AS (SELECT d.*, a.rate AS mu FROM domains d JOIN a USING (suffix)),
{level('b', 'b0', 'domain, suffix')},
c0 AS (SELECT s.*, b.rate AS mu FROM sites s JOIN b USING (domain, suffix)),
{level('c', 'c0', 'host')},
d AS (SELECT *, greatest(rate - {z} * sqrt(rate * (1 - rate) / (k + n + 1)), 0.0) AS low FROM c)
SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
  coalesce({case(lambda r: r.action)}, CASE WHEN low > {max_bad_rate} THEN 'block' ELSE 'allow' END) AS verdict,
  n AS host_labelled, rate AS bad_rate, low AS bad_lower
FROM v LEFT JOIN d USING (host)
"""


def _op5() -> str:
    plain = {  # without the possessive forms that only bound the time
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    plain |= {k.name: k.pattern.replace("}+", "}").replace(r"\x20", " ") for k in pii.KINDS if not k.base}
    luhn = "list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 1 THEN " \
        "CASE WHEN digits[length(digits) - i]::INT > 4 THEN 2 * digits[length(digits) - i]::INT - 9 ELSE 2 * digits[length(digits) - i]::INT END " \
        "ELSE digits[length(digits) - i]::INT END)) % 10 = 0"
    moved = "(replace(value, ' ', '')[5:] || replace(value, ' ', '')[1:4])"
    valid = {
        "email": "true", "ssn": "true", "tel": "true",
        "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) <= 255))",
        "card": f"CASE WHEN length(digits) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": "length(digits) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: ord(c))), "
                "lambda r, v: CASE WHEN v >= 65 THEN (r * 100 + v - 55) % 97 ELSE (r * 10 + v - 48) % 97 END) = 1",
    }
    parts = []
    for i, k in enumerate(pii.KINDS):
        p = plain[k.name]
        near = f"lower(t[start - least(start, {pii.BEFORE}) + 1:start] || ' ' || t[\"end\" + 1:\"end\" + {pii.AFTER}])"
        words = "(^|[^a-z])(" + "|".join(k.context) + ")([^a-z]|$)"
        score = f"{k.prior} + CASE WHEN regexp_matches({near}, '{words}') THEN {k.lift} ELSE 0 END"
        ok = valid[k.name]
        if k.clear:
            ok += f" AND NOT regexp_matches(CASE WHEN start > 0 THEN t[start:start] ELSE '' END, '[{k.clear}]')" \
                  f" AND NOT regexp_matches(t[\"end\" + 1:\"end\" + 1], '[{k.clear}]')"
        if not k.base:
            ok += f" AND {score} >= {pii.MIN_SCORE}"
        parts.append(f"""SELECT rid, {i} AS ord, '{k.name}' AS kind, {str(k.base).lower()} AS base, start, "end" FROM (
  SELECT *, start + length(value) AS "end", regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM (
  SELECT rid, t, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))))) WHERE {ok}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
kept AS (SELECT * FROM found f WHERE base OR NOT EXISTS (
  SELECT 1 FROM found b WHERE b.rid = f.rid AND b.base AND b.start < f."end" AND f.start < b."end")),
agg AS (SELECT rid, string_agg(CASE WHEN base THEN kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) END, ',' ORDER BY start, ord) AS b,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, ord) AS s,
  {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))} FROM kept GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""


def _op10(seed: int = 42, mean: float = mixing.MEAN, stride: int = mixing.STRIDE) -> str:
    key = "coalesce(CAST(doc_id AS VARCHAR), 'null|' || md5(coalesce(text, 'null')))"
    return f"""
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents WHERE source IS NOT NULL GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM sizes WHERE size > 0) * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate FROM sizes),
draws AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {mean}) AS BIGINT)) AS draws FROM rates WHERE rate > 0),
steps AS (SELECT source, rate / draws AS mean, 0 AS k, exp(-rate / draws) AS p, exp(-rate / draws) AS cdf FROM draws
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE k < mean OR cdf + p * mean / (k + 1) > cdf),
docs AS (SELECT row_number() OVER () AS r, doc_id, source, text, {key} AS key FROM documents),
drawn AS (SELECT docs.*, unnest(range(0, draws)) AS draw FROM docs JOIN draws USING (source)),
u AS (SELECT *, CAST('0x' || substr(md5('{seed}|' || key || CASE WHEN draw > 0 THEN '|' || draw ELSE '' END), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM drawn),
counted AS (SELECT r, doc_id, u.source, text, draw, (SELECT count(*) FROM steps s WHERE s.source = u.source AND s.cdf <= u.u) AS n FROM u
  UNION ALL SELECT r, doc_id, source, text, 0, 1 FROM docs WHERE source IS NULL)
SELECT doc_id, source, CAST(draw * {stride} + unnest(range(0, n)) AS BIGINT) AS mix_copy, text FROM counted
"""


OP7 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


# CRC-32 bit by bit for the 256 bytes, byte by byte for each distinct word.
OP11 = """
WITH crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
u AS (SELECT r, unnest(words) AS w FROM d),
o AS (SELECT unnest(regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM u UNION SELECT w FROM o)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) %% 10000 AS bucket FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS s FROM u JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM o JOIN buckets USING (w) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM u) + 10000.0::DOUBLE)
    / ((CAST(s AS DOUBLE) + 1) * ((SELECT count(*) FROM o) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM u JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (r)
""" % {"upper": url_reputation.UPPER, "lower": url_reputation.LOWER}


OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE own QUALIFY place <= 5),
n AS (SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY s.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


ORACLE: dict[str, str] = {
    "op12_hard_negatives": OP12,
    "op11_importance_resampling": OP11,
    "op7_bit_sliced_topk": OP7,
    "op1_chat_snapshot_collapse": OP1,
    "op2_url_reputation": _op2(),
    "op5_pii_spans": _op5(),
    "op10_poisson_mixing": _op10(),
}
