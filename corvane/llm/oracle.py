"""DuckDB SQL for the queries whose results SQL can express."""

SQL: dict[str, str] = {}

#: Full passes over a source's shuffled words, then what is over from its start.
SQL["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3.0, 1.0, 2.0][src % 3 + 1] AS DOUBLE) AS w, CAST(2.0 AS DOUBLE) * source_size AS cap,
    CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level <= cap / w THEN level END) OVER () * w), cap) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS need,
    sum(size) OVER (PARTITION BY t.source ORDER BY md5('mix:' || d.doc_id), d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE need // source_size * size + greatest(0, least(size, need % source_size - lo)) END AS BIGINT) AS taken
FROM p
"""


def _licenses() -> str:
    """Every unit of every text against every template, with nothing left out beforehand."""
    from corvane.llm.license_scan import BLANK, BREAK, DENSE, FILE_NAME, LAST, SENTENCE, TERM, THRESHOLD, template_weights

    idf, weights, needs, other = template_weights()
    idf_rows = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items())
    weight_rows = ", ".join(f"({i}, '{n}', '{t}', {w!r}::DOUBLE, {needed}, {barred}, {needs[i]})" for i, n, t, w, needed, barred in weights)
    words = ", ".join(f"'{t}'" for t in idf)
    return rf"""
WITH idf(term, idf) AS (VALUES {idf_rows}), weights(template, license, term, weight, needed, barred, needs) AS (VALUES {weight_rows}),
files AS (
  SELECT doc_id AS id, source AS repo, text,
    'part' || (doc_id // 1000) || '/set' || (doc_id // 20) || '/' || CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path
  FROM documents
), cut AS (
  SELECT id, text, md5(text) AS body, string_split(text, chr(10)) AS lines FROM (SELECT DISTINCT id, text FROM files WHERE text IS NOT NULL)
), marked AS (
  SELECT *, array_to_string(list_transform(lines, lambda x: CASE WHEN
      len(list_filter(regexp_extract_all(lower(x), '{TERM}'), lambda t: list_contains([{words}], t))) >= {DENSE} * len(regexp_extract_all(lower(x), '{TERM}'))
      THEN x ELSE chr({ord(BREAK)}) END), chr(10)) AS runs FROM cut
), units AS (
  SELECT id, body, p AS part, p = text AS whole
  FROM marked, LATERAL (SELECT unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '{BLANK}'), lines, string_split(regexp_replace(text, '{SENTENCE}', '\1' || chr({ord(BREAK)}), 'g'), chr({ord(BREAK)})), string_split(runs, chr({ord(BREAK)}))))) AS p)
), tf AS (
  SELECT id, body, part, whole, term, count(*) AS tf
  FROM (SELECT id, body, part, whole, unnest(regexp_extract_all(lower(part), '{TERM}')) AS term FROM units) GROUP BY ALL
), v AS (
  SELECT tf.*, tf.tf * coalesce(idf.idf, {other!r}::DOUBLE) AS v FROM tf LEFT JOIN idf USING (term)
), norms AS (
  SELECT id, body, part, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL
), dots AS (
  SELECT id, body, part, whole, template, license, sum(v * weight) AS dot FROM v JOIN weights USING (term) GROUP BY id, body, part, whole, template, license, needs
  HAVING sum(needed) = needs AND max(barred) = 0
), scored AS (
  SELECT id, whole, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (id, body, part) WHERE round(dot / norm, 6) >= {THRESHOLD}
), own AS (
  SELECT id, arg_min(license, (license = '{LAST}', -score, license)) AS own_license, arg_min(score, (license = '{LAST}', -score, license)) AS own_score, bool_or(whole) AS whole FROM scored GROUP BY id
), known AS (
  SELECT f.id, f.repo, f.path, own_license, own_score, coalesce(whole, false) AS whole, regexp_replace(f.path, '/[^/]*$', '') AS dir FROM files f LEFT JOIN own USING (id)
), given AS (
  SELECT repo, dir, arg_min(own_license, (own_license = '{LAST}', -own_score, path, own_license)) AS dir_license FROM known
  WHERE own_license IS NOT NULL AND (whole OR regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE_NAME}')) GROUP BY ALL
), reach AS (
  SELECT k.id, d.dir, d.dir_license, row_number() OVER (PARTITION BY k.id ORDER BY len(d.dir) DESC) AS r
  FROM known k JOIN given d ON k.repo = d.repo AND (k.dir = d.dir OR d.dir = '' OR starts_with(k.dir, d.dir || '/')) WHERE k.own_license IS NULL
)
SELECT k.id AS doc_id, k.path, k.own_license, k.own_score, coalesce(k.own_license, r.dir_license) AS license, r.dir AS inherited_from
FROM known k LEFT JOIN (SELECT * FROM reach WHERE r = 1) r ON k.id = r.id
"""


SQL["op2_license_scan"] = _licenses()

#: All pairs by brute force, then labels passed along links.
SQL["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.x LEFT JOIN n ON v.vec_id = n.x
"""

SQL["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS q FROM embeddings
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: Exact Jaccard of all pairs that share a shingle.
SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT w.doc_id, min(w.doc_id) OVER (PARTITION BY CASE WHEN len(w.w) = 0 THEN [CAST(w.doc_id AS VARCHAR)] ELSE w.w END) AS class_id,
  coalesce(k.n_links, 0) AS n_links, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON w.doc_id = c.x LEFT JOIN k ON w.doc_id = k.x
"""

#: Digests of the turns themselves; each assistant turn's example is all turns up to it, and a rest without one is an example too.
SQL["op6_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
    || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10)) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t
), p AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    step = "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}))"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(n_chars="n_chars + 1")} END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM rows_
), node(g, lvl, idx, n, digest) AS (
  SELECT g, CAST(0 AS BIGINT), idx, n, leaf FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY g, lvl, n, idx // 2
), top(lvl, idx, n, digest) AS (
  SELECT CAST(0 AS BIGINT), g, count(*) OVER (), digest FROM node WHERE n = 1
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, n, idx // 2
), steps AS (
  SELECT rid, o.lvl AS step, s.digest AS sibling, s.idx < o.idx AS before
  FROM leaves l JOIN node o ON o.g = l.g AND o.idx = l.idx >> o.lvl AND o.n > 1 LEFT JOIN node s ON s.g = o.g AND s.lvl = o.lvl AND s.idx = xor(o.idx, 1)
  UNION ALL
  SELECT rid, 1000 + o.lvl, s.digest, s.idx < o.idx
  FROM leaves l JOIN top o ON o.idx = l.g >> o.lvl AND o.n > 1 LEFT JOIN top s ON s.lvl = o.lvl AND s.idx = xor(o.idx, 1)
), path AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS pos FROM steps
), folded(rid, pos, digest) AS (
  SELECT rid, CAST(0 AS BIGINT), coalesce(other, leaf) FROM leaves
  UNION ALL
  SELECT f.rid, p.pos, sha256(CASE WHEN p.before THEN p.sibling || f.digest ELSE f.digest || coalesce(p.sibling, '') END)
  FROM folded f JOIN path p ON p.rid = f.rid AND p.pos = f.pos + 1
), proofs AS (
  SELECT rid, string_agg(sibling, '' ORDER BY pos) AS proof FROM path GROUP BY rid
), ends AS (
  SELECT rid, arg_max(digest, pos) AS folded_root FROM folded GROUP BY rid
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM leaves l JOIN node s ON s.g = l.g AND s.n = 1 CROSS JOIN (SELECT digest FROM top WHERE n = 1) r JOIN ends e ON e.rid = l.rid LEFT JOIN proofs p ON p.rid = l.rid
"""


def _repair() -> str:
    def plus(state: str, letter: str, cost: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || chr(10) || {line}}} END"

    def gone(state: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'D', 'r': {state}.r}} END"

    def inserted(source: str) -> str:
        u = f"least(u, {plus('e', 'I', '5', chr(39) + 'user:' + chr(39))}, {plus('s', 'I', '5', chr(39) + 'user:' + chr(39))}, {plus('a', 'I', '5', chr(39) + 'user:' + chr(39))})"
        return f"SELECT conv_id, idx, e, s, u, least(a, {plus('u', 'I', '5', chr(39) + 'assistant:' + chr(39))}) AS a FROM (SELECT conv_id, idx, e, s, {u} AS u, a FROM {source})"

    def kept(initial: str, before: str) -> str:
        return f"CASE WHEN stays AND initial = '{initial}' THEN {plus(before, 'K', 'more', 'line')} END"

    def reroled(role: str, before: str) -> str:
        return f"CASE WHEN stays THEN {plus(before, 'R', '1 + more', chr(39) + role + ':' + chr(39) + ' || text')} END"

    state = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations
), hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS idx FROM hit
), flags AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY idx) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed
), turns AS (
  SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, role || ':' || text AS line FROM flags
), fold(conv_id, idx, e, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 'r': ''}} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)), {state}, {state}, {state} FROM turns
  UNION ALL
  SELECT g.conv_id, t.idx, {gone("e")}, least({gone("s")}, {kept("s", "e")}), least({gone("u")}, {kept("u", "b")}, {reroled("user", "b")}), least({gone("a")}, {kept("a", "u")}, {reroled("assistant", "u")})
  FROM (SELECT *, least(e, s, a) AS b FROM ({inserted("fold")})) g JOIN turns t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.idx = g.idx + 1
), ends AS (
  SELECT conv_id, arg_max(least(e, a), idx) AS best FROM ({inserted("fold")}) GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM k.conv_id
"""


SQL["op12_conversation_repair"] = _repair()
