"""DuckDB SQL for the queries of this package that SQL can express.

The toxicity model, the quality model (expectation-maximisation), the tokenizers and
packing have none: tests hold them against brute-force versions.
"""

from __future__ import annotations

from folio.llm import mixing, neardup, secrets

ORACLES: dict[str, str] = {}

#: Words of a text in the engine's own regular expressions.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: A-Z to a-z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mixing() -> str:
    """The sweeps are unrolled."""
    groups = range(mixing.TOPICS)
    counts = ", ".join(f"length(f) - length(translate(f, '{mixing.letters(k)}', '')) AS c{k}" for k in groups)
    sums = ", ".join(f"sum(c{k}) AS s{k}" for k in groups)
    whole = " + ".join(f"s{k}" for k in groups)
    shares = ", ".join(f"s{k} / ({whole}) AS m{k}" for k in groups)
    above = ", ".join(f"CASE WHEN c{k} > 0 THEN c{k} / m{k} ELSE 0.0::DOUBLE END" for k in groups)
    named = " ".join(f"WHEN CASE WHEN c{k} > 0 THEN c{k} / m{k} ELSE 0.0::DOUBLE END = top THEN 'group{k}'" for k in groups)
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    sql = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, chr(0) || 'null') AS source, coalesce(lang, chr(0) || 'null') AS lang,
  translate(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]*([^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D]*[\\x20\\x09-\\x0D]*', '\\1', 'g'), {spaces}, '') AS f FROM documents),
c AS MATERIALIZED (SELECT doc_id, source, lang, length(f) AS n, {counts} FROM d),
m AS MATERIALIZED (SELECT {shares} FROM (SELECT {sums} FROM c)),
t AS MATERIALIZED (SELECT *, greatest({above}) AS top FROM c, m),
g AS MATERIALIZED (SELECT doc_id, source, lang, n, CASE WHEN top = 0 THEN 'none' {named} END AS topic FROM t),
w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) AS DOUBLE) AS w FROM g GROUP BY source, lang, topic HAVING sum(n) > 0),
all_ AS MATERIALIZED (SELECT sum(n) AS n FROM w0)"""
    for name, power in mixing.POWERS.items():
        sql += f",\ngoal_{name} AS MATERIALIZED (SELECT {name}, p / sum(p) OVER () AS share FROM (SELECT {name}, pow(sum(n), {power}::DOUBLE) AS p FROM w0 GROUP BY {name}))"
    k = 0
    for _ in range(mixing.SWEEPS):
        for name in mixing.DIMENSIONS:
            sql += f",\nw{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.n, a.w * b.share * (SELECT n FROM all_) / sum(a.w) OVER (PARTITION BY a.{name}) AS w FROM w{k} a JOIN goal_{name} b ON a.{name} = b.{name})"
            k += 1
    # the scale, in rounds that take cells at probability 1 out
    sql += f",\ns0 AS MATERIALIZED (SELECT {mixing.BUDGET} * sum(n) / sum(w) AS s FROM w{k})"
    for j in range(8):
        full = f"w * (SELECT s FROM s{j}) >= n"
        sql += f",\ns{j + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN {full} THEN 0.0 ELSE w END) = 0 THEN (SELECT s FROM s{j}) ELSE ({mixing.BUDGET} * sum(n) - sum(CASE WHEN {full} THEN n ELSE 0.0 END)) / sum(CASE WHEN {full} THEN 0.0 ELSE w END) END AS s FROM w{k})"
    return sql + f""",
p AS (SELECT g.doc_id, g.n, g.topic, coalesce(c.w / c.n, 0.0) AS factor, least(1.0, coalesce((SELECT s FROM s8) * c.w / c.n, 0.0)) AS p, ('0x' || substring(md5('mix:' || g.doc_id), 1, 12))::BIGINT / pow(2.0::DOUBLE, 48) AS u FROM g LEFT JOIN w{k} c ON g.source = c.source AND g.lang = c.lang AND g.topic = c.topic)
SELECT doc_id, n AS n_tokens, topic, round(factor, 6) AS factor, round(p, 6) AS probability, u < p AS sampled FROM p"""


ORACLES["op1_source_mixing"] = _mixing()

ORACLES["op2_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {neardup.THRESHOLD}),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node AND r.root < l.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id"""


def _secrets() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS rule, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(m) + 1)) AS i, m, g, s FROM (
  SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d WHERE regexp_matches(t, '{pattern}'))""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, rule, kind, length(m[i]) AS size, CAST(list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(s[1:i], lambda x: length(x))) AS BIGINT) AS stop FROM m WHERE length(g[i]) >= least),
f AS (SELECT *, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM p),
a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rule, stop) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rule, stop) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""


ORACLES["op3_secret_scans"] = _secrets()

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM r"""

ORACLES["op8_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node AND r.root < l.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id"""

#: An n-gram is counted in the corpus and in each document; what others have is the difference.
ORACLES["op9_lm_scoring"] = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, i, w[i + 1] AS c, CASE WHEN i > 0 THEN w[i] END AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
n1 AS MATERIALIZED (SELECT c, sum(n) AS n FROM (SELECT c, count(*) AS n FROM t GROUP BY c) GROUP BY c),
n2 AS MATERIALIZED (SELECT b, c, count(*) AS n FROM t WHERE i > 0 GROUP BY b, c),
n3 AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM t WHERE i > 1 GROUP BY a, b, c),
o AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS o1, count(*) OVER (PARTITION BY doc_id, b, c) AS o2, count(*) OVER (PARTITION BY doc_id, a, b, c) AS o3 FROM t),
k AS MATERIALIZED (SELECT o.doc_id, o.i, n1.n - o1 AS c1, CASE WHEN o.i > 0 THEN n2.n - o2 END AS c2, CASE WHEN o.i > 1 THEN n3.n - o3 END AS c3
  FROM o JOIN n1 ON n1.c = o.c LEFT JOIN n2 ON n2.b = o.b AND n2.c = o.c LEFT JOIN n3 ON n3.a = o.a AND n3.b = o.b AND n3.c = o.c),
p AS (SELECT *, lag(c1) OVER d AS p1, lag(c2) OVER d AS p2, (SELECT count(*) FROM t) - count(*) OVER (PARTITION BY doc_id) AS others FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, sum(CASE WHEN c3 > 0 THEN ln(c3 / p2) WHEN c2 > 0 THEN ln(c2 / p1) + CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END ELSE ln(greatest(c1, 1) / greatest(others, 1)) + least(i, 2) * ln(0.4) END) AS score,
  count(*) FILTER (CASE WHEN i = 0 THEN false WHEN i = 1 THEN c2 = 0 ELSE c3 = 0 END) AS late FROM p GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_tokens, coalesce(late, 0) AS n_backoff, round(coalesce(score, 0.0), 4) AS log_score, CASE WHEN len(w.w) > 0 THEN round(score / len(w.w), 6) END AS mean_log_score FROM w LEFT JOIN s USING (doc_id)"""

#: Exact search. On the small tables the radius of every query covers all codes, so nothing may be missed there.
ORACLES["op11_nearest_neighbours"] = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda s, d: s + d)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10"""

#: Terms of a text: runs of ASCII letters and digits and of all wider characters.
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_lexical_search"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: CRC-32 bit by bit, over the digits of a whole number.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"""

ORACLES["op13_prefix_trie"] = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id")} % 9 AS head FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, turn FROM c JOIN t ON t.conv_id = c.base AND pos <= head UNION ALL SELECT c.conv_id, pos, turn FROM c JOIN t USING (conv_id) WHERE pos > head),
p AS MATERIALIZED (SELECT c.conv_id, coalesce(list(turn ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS MATERIALIZED (SELECT conv_id AS member, d AS depth, path[1 : d] AS path, len(path) = d AS ends FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM p)),
n AS MATERIALIZED (SELECT path, depth, min(member) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN depth > 0 THEN (count(*) - 1) * octet_length(encode(path[-1].text)) ELSE 0 END AS saved FROM m GROUP BY path, depth),
u AS (SELECT path[1 : depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
k AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (path, depth)),
s AS (SELECT a.path, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens FROM n a JOIN k b ON b.depth >= a.depth AND b.path[1 : a.depth] = a.path GROUP BY a.path, a.depth)
SELECT k.conv_id, k.depth, v.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path, depth) LEFT JOIN n v ON v.depth = k.depth - 1 AND v.path = k.path[1 : k.depth - 1]"""
