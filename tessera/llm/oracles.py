"""DuckDB SQL for the queries that SQL can express."""

OP6 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
plain AS (
  SELECT doc_id, pos, line, regexp_replace(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS t FROM lines),
counted AS (SELECT *, length(t) - length(replace(t, ' ', '')) + 1 AS n, string_split(t, ' ') AS w FROM plain),
leaves AS (
  SELECT doc_id, pos, n, 0 AS k, t FROM counted WHERE t NOT IN ('', '<*>', '<*> <*>')
  UNION ALL
  SELECT doc_id, pos, n, q + 1, array_to_string(list_concat(w[1:2 + (n - 2) * q // 4], ['<*>'], w[3 + (n - 2) * (q + 1) // 4:n]), ' ')
  FROM counted, (SELECT unnest([0, 1, 2, 3]) AS q) WHERE n >= 10),
recurring AS (SELECT n, k, t, min(doc_id) AS first FROM leaves GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM leaves JOIN recurring USING (n, k, t) WHERE doc_id <> first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS rest
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP8 = """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, (SELECT count(*) FROM documents) AS listed_rows, true AS compacted FROM documents
"""

OP5 = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
best AS (SELECT h, max(page_id) AS r FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN r <> page_id OR page_id IS NULL AND r IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r <> page_id OR page_id IS NULL THEN r END AS refers_to
FROM p LEFT JOIN best USING (h)
"""


def _op11() -> str:
    """Codes by rounds of assignment and means, all distances worked out."""
    assigned = """
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT vec_id, label, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN book{k} b USING (p, c) GROUP BY ALL) GROUP BY ALL),"""
    moved = """
book{n} AS MATERIALIZED (
  SELECT b.p, b.e, b.c, coalesce(m.v, b.v) AS v
  FROM book{k} b LEFT JOIN (SELECT n.p, n.e, x.c, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM near{k} n JOIN x USING (vec_id, p) GROUP BY ALL) m USING (p, e, c)),"""
    rounds = "".join(assigned.format(k=k) + moved.format(k=k, n=k + 1) for k in range(4)) + assigned.format(k=4)
    return f"""
WITH good AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS q, len(embedding) // 4 AS each, unnest(embedding) AS c FROM good),
x AS MATERIALIZED (SELECT vec_id, label, q // each AS p, q % each AS c, floor(1024 * c::DOUBLE)::BIGINT AS v FROM cells),
book0 AS MATERIALIZED (SELECT x.p, f.e, x.c, x.v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM good QUALIFY e < 256) f USING (vec_id)),{rounds}
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, c)) AS h FROM book4),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest
"""


ORACLES: dict[str, str] = {"op5_urls": OP5, "op6_line_templates": OP6, "op8_sharding": OP8, "op11_codes": _op11(), "op12_warc": OP12}
