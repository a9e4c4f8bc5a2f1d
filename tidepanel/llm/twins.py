"""DuckDB SQL of operators 11 and 13, by plainer means than the operators' own."""

#: Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 3988292384

OP11 = (
    r"""
WITH RECURSIVE bit(b, k, v) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST({poly} AS BIGINT)) ELSE v >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, r, count(*) AS n, lower(hex(encode(doc_id || ':' || r))) AS x
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents)
        WHERE length(r) >= 7 GROUP BY doc_id, r),
sum AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST(CAST('0x' || substr(x, 2 * i + 1, 2) AS UTINYINT) AS BIGINT))),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM run, crc),
word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, n FROM sum)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, word[1 : i] AS a, word[i + 2 :] AS z FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
pair AS (
  SELECT p.word, q.word AS near, q.n AS near_n FROM cut p JOIN cut q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION SELECT p.word, q.word, q.n FROM cut p JOIN word q ON q.word = p.a || p.z
  UNION SELECT q.word, p.word, p.n FROM cut p JOIN word q ON q.word = p.a || p.z),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pair GROUP BY word),
pick AS (SELECT b.word, b.n_near, b.m, min(encode(near)) AS near FROM best b JOIN pair p ON p.word = b.word AND p.near_n = b.m GROUP BY ALL),
formed AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * w.n THEN decode(near) END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM word w LEFT JOIN pick p ON p.word = w.word),
walk(word, tip) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.tip AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.tip AND e.form IS NULL
"""
).replace("{poly}", str(_POLYNOMIAL))


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of assignment and mean, one after another, over components as rows."""
    steps = [
        f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
c AS MATERIALIZED (
  SELECT vec_id, label, i // (len(q) // {parts}) AS part, i % (len(q) // {parts}) AS d, q[i + 1] AS x FROM (SELECT *, unnest(range(len(q))) AS i FROM v)),
head AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT part, e, d, x FROM c JOIN head USING (vec_id))"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT part, vec_id, min(off) AS off, arg_min(e, off * {entries} + e) AS e
  FROM (SELECT c.part, vec_id, e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS off FROM c JOIN b{k} b ON b.part = c.part AND b.d = c.d GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT a.part, a.e, c.d, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM a{k} a JOIN c ON c.part = a.part AND c.vec_id = a.vec_id GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, b.d, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.e = b.e AND m.d = b.d)""")
    return (
        ",".join(steps)
        + f""",
code AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(off) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, d)) FROM b{rounds}) AS codebooks_sha256
FROM code JOIN v USING (vec_id)
"""
    )
