"""DuckDB SQL of the text operators whose results SQL can express."""

from launchlens.llm.secret_scan import BASE_RULES, RULES


def _clustering(rounds: int, k: int, width: int, scale: int, seed: int) -> str:
    """Assignment and exact means, one pair of table expressions per round."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS (SELECT r, unnest(v) AS x, unnest(range({width})) AS j FROM v)",
        f"""c0 AS (SELECT c, unnest(v) AS y, unnest(range({width})) AS j FROM (
  SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::varchar, '')), v) - 1 AS c FROM v QUALIFY c < {k}))""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, sum((x - y) * (x - y))::bigint AS d FROM x JOIN c{n} USING (j) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS (SELECT c, coalesce((s - ((s % k) + k) % k) // k, y)::bigint AS y, j FROM c{n} LEFT JOIN (
  SELECT c, j, sum(x) AS s, count(*) AS k FROM x JOIN a{n} USING (r) GROUP BY c, j) USING (c, j))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::integer AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(y::varchar, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


OP11_SQL = _clustering(3, 16, 64, 64, 1)

# the checksum of a word from the table of its 256 one-byte steps
OP12_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)), crc),
counted AS (SELECT b.bucket, count(*) FILTER (side = 'd')::double AS s, count(*) FILTER (side = 'b')::double AS t FROM words JOIN buckets b USING (w) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000))))::bigint AS gain FROM counted),
weights AS (SELECT r, count(*) AS n, sum(gain)::bigint AS g FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM texts LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint AS score FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank FROM (
  SELECT *, row_number() OVER able AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM ranked
  WINDOW able AS (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST))"""


def _secrets() -> str:
    def spans(n: int) -> str:
        rule = RULES[n]
        p = "'" + rule.pattern.replace("'", "''") + "'"
        end = f"list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda g: len(g)))::bigint + list_sum(list_transform(m{n}[1:i], lambda g: len(g)))::bigint"
        held = f"len(regexp_extract_all(t, {p}, {rule.group})[i]) >= {rule.least}"
        return f"""list_transform(list_filter(range(1, len(m{n}) + 1), lambda i: {held}), lambda i: {{'s': {end} - len(m{n}[i]), 'n': {n}, 'k': '{rule.kind}', 'e': {end}}})"""

    found = ", ".join("regexp_extract_all(t, '" + r.pattern.replace("'", "''") + f"', 0) AS m{n}" for n, r in enumerate(RULES))
    text = lambda x: f"list_aggregate(list_transform(list_sort({x}), lambda z: z.k || ':' || z.s || ':' || z.e), 'string_agg', ',')"
    base = f"list_filter(a, lambda z: z.n < {len(BASE_RULES)})"
    counts = ", ".join(f"len(list_filter(a, lambda z: z.n = {n}))::bigint AS n_{r.kind}" for n, r in enumerate(BASE_RULES))
    return f"""SELECT doc_id, {counts}, sha256(coalesce({text(base)}, '')) AS base_sha256, coalesce({text('a')}, '') AS spans FROM (
  SELECT doc_id, list_concat({', '.join(spans(n) for n in range(len(RULES)))}) AS a FROM (
    SELECT doc_id, t, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"""


OP13_SQL = _secrets()
