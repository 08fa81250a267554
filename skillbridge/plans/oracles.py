"""The registered queries in SQL, for DuckDB over the same tables.

Left out, with tests of their own instead: ``embed_hash`` and what builds on it
(``recommend_text``, ``stream_recommend_text``), ``knn_lsh`` and ``surrogate_ids``.
"""

from __future__ import annotations

from skillbridge.functions.text import PROMPT_TEMPLATE, STANDING_QUESTION
from skillbridge.operators.quality import SPECIAL_CHARACTER
from skillbridge.plans.inputs import LONGEST_TEXT, OPERATOR_ADDRESS, PAGE_ROWS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LISTING_A = """
SELECT CAST(p_partkey AS INT) AS id, p_name AS title,
       CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS headline,
       CAST(p_size AS DOUBLE) / 10 AS rating, p_size AS enrolled,
       'https://courses.example/' || p_partkey AS url, CAST(p_size AS VARCHAR) AS duration,
       p_brand AS section, p_type AS sub_category, CAST(p_size * 10 AS VARCHAR) AS price
FROM part"""

_LISTING_B = """
SELECT CAST(d.doc_id AS INT) AS id, CASE WHEN coalesce(toxic, 0) = 0 THEN text END AS title,
       source AS headline, CAST(n_chars AS DOUBLE) / 8 AS rating, CAST(quality AS INT) AS enrolled,
       'https://docs.example/' || d.doc_id AS url, CAST(n_chars AS VARCHAR) AS duration,
       lang AS section, source AS sub_category, CAST(n_chars * 10 AS VARCHAR) AS price
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

_VALID_B = f"""
SELECT * FROM ({_LISTING_B}) WHERE title IS NOT NULL AND length(title) <= 255 AND enrolled IS NOT NULL"""

_ACTIVE = "SELECT user_id FROM events"


def _ranked(pairs: str, metric: str = "l2sq", k: int = 3) -> str:
    """Hits ``(qid, vec_id, d, rk)`` of the pairs ``q, c`` given as a FROM/WHERE text."""
    square = """list_sum(list_transform(list_zip(q.embedding, c.embedding),
             lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"""
    cosine = "list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rk FROM (
    SELECT q.vec_id AS qid, c.vec_id AS vec_id, {square if metric == "l2sq" else cosine} AS d {pairs}))
WHERE rk <= {k}"""


_ALL_PAIRS = "FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"
_SCOPED_PAIRS = """FROM embeddings q JOIN embeddings c
     ON q.vec_id <> c.vec_id AND (c.label = 0 OR c.label = q.label)"""
# Row r of the index: vector and document numbered r modulo their counts.
_INDEX = """(
  SELECT r AS vec_id, e.embedding, e.label, t.text
  FROM unnest(generate_series(0, greatest((SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents)) - 1)) u(r)
  JOIN embeddings e ON e.vec_id = r % (SELECT count(*) FROM embeddings)
  JOIN documents t ON t.doc_id = r % (SELECT count(*) FROM documents))"""
_INDEX_PAIRS = f"""FROM embeddings q JOIN {_INDEX} c
     ON q.vec_id <> c.vec_id AND (c.label = 0 OR c.label = q.label)"""


def _hits(pairs: str, metric: str = "l2sq") -> str:
    return f"SELECT qid, CAST(rk AS INT) AS rk, vec_id, round(d, 6) AS d FROM ({_ranked(pairs, metric)})"


_ANSWERS = f"""
SELECT qid, string_agg(text, e'\\n\\n' ORDER BY rk) AS context,
       string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rk) AS sources
FROM ({_ranked(_INDEX_PAIRS)}) h JOIN (SELECT vec_id AS id, text FROM {_INDEX}) ON id = vec_id GROUP BY qid"""

_BEFORE, _AFTER = PROMPT_TEMPLATE.replace("{question}", STANDING_QUESTION).split("{context}")
_PROMPT = f"{_quote(_BEFORE)} || context || {_quote(_AFTER)}"

# the template with a question of its own
_PROMPT_OF = "{} || context || {} || question || {}".format(
    *map(_quote, PROMPT_TEMPLATE.replace("{question}", "{context}").split("{context}"))
)

_RECOMMEND = f"""
SELECT qid, 'user' || qid || '@example.com' AS address, 'Courses' AS subject, context, sources,
       {_PROMPT} AS prompt
FROM ({_ANSWERS})"""

_UPLOADS = """
SELECT o_orderkey AS id, 'user' || o_custkey || '@example.com' AS email, o_custkey FROM orders"""

_DOC_UNION = """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS owner, 'course' AS kind,
       p_name || p_type AS text, to_json({'headline': p_type, 'title': p_name})::VARCHAR AS meta FROM part
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'user' || doc_id || '@example.com', 'resume', text,
       to_json({'lang': lang, 'n_chars': n_chars::VARCHAR, 'source': source})::VARCHAR FROM documents
UNION ALL
SELECT conv_id || '-' || turn, 'user' || conv_id || '@example.com', 'job', text,
       to_json({'role': role, 'turn': turn::VARCHAR})::VARCHAR FROM conversations"""


def _chunks(docs: str, columns: str) -> str:
    return f"""
SELECT {columns}, CAST(i AS INT) AS chunk_idx, substring(text, i * 192 + 1, 256) AS chunk
FROM {docs}, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 64) / 192.0) AS BIGINT) - 1, 0))) u(i)"""


def _chunk_text(size: int = 256, overlap: int = 64) -> str:
    """The separator-aware chunks of ``documents``.

    Level by level, texts are cut before a separator; pieces that are too long are cut at
    the next one. Neighbouring pieces of a level form a run. For each piece of a run it is
    worked out where a chunk starting there ends and where the next one starts; the chunks
    are then found by following these links.
    """
    separators = ("\n\n", "\n", " ")
    steps = ["s0 AS (SELECT doc_id, 0::BIGINT AS lo, text AS t FROM documents)"]
    runs = []
    for i, separator in enumerate(separators):
        sep = "e'" + separator.replace("\n", "\\n") + "'"
        steps += [
            f"""cut{i} AS (
  SELECT doc_id, lo, piece, length(piece) AS n,
         lo + sum(length(piece)) OVER w - length(piece) AS a,
         sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER w AS long_before
  FROM (SELECT doc_id, lo, j, CASE WHEN j = 1 THEN part ELSE {sep} || part END AS piece
        FROM (SELECT doc_id, lo, unnest(string_split(t, {sep})) AS part,
                     generate_subscripts(string_split(t, {sep}), 1) AS j
              FROM s{i} WHERE contains(t, {sep})))
  WHERE piece <> '' WINDOW w AS (PARTITION BY doc_id, lo ORDER BY j))""",
            f"""s{i + 1} AS (
  SELECT * FROM s{i} WHERE NOT contains(t, {sep})
  UNION ALL SELECT doc_id, CAST(a AS BIGINT), piece FROM cut{i} WHERE n >= {size})""",
        ]
        runs.append(f"""
  SELECT doc_id, concat_ws('/', doc_id, {i}, lo, long_before) AS run,
         CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b
  FROM cut{i} WHERE n < {size}""")
    last = len(separators)
    runs.append(f"""
  SELECT doc_id, concat_ws('/', doc_id, {last}, lo), lo + i, lo + i + 1
  FROM s{last}, unnest(range(length(t))) u(i)""")
    steps += [
        f"pieces AS MATERIALIZED ({' UNION ALL '.join(runs)})",
        f"""ends AS MATERIALIZED (
  SELECT doc_id, run, a AS s, max(b) OVER (PARTITION BY run ORDER BY b
         RANGE BETWEEN CURRENT ROW AND {size} - (b - a) FOLLOWING) AS e FROM pieces)""",
        f"""links AS MATERIALIZED (
  SELECT x.doc_id, x.run, x.s, x.e, n.next FROM ends x LEFT JOIN (
    SELECT w.run, w.s, p.a AS next FROM (
      SELECT x.run, x.s, greatest(x.e - {overlap}, n.b - {size}) AS least
      FROM ends x JOIN pieces n ON n.run = x.run AND n.a = x.e) w
    ASOF JOIN pieces p ON w.run = p.run AND w.least <= p.a) n ON x.run = n.run AND x.s = n.s)""",
        """chain AS (
  SELECT l.* FROM links l JOIN (SELECT run, min(a) AS a FROM pieces GROUP BY run) f
    ON l.run = f.run AND l.s = f.a
  UNION ALL
  SELECT l.* FROM chain c JOIN links l ON l.run = c.run AND l.s = c.next)""",
    ]
    return f"""
WITH RECURSIVE {", ".join(steps)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_idx, chunk
FROM (SELECT doc_id, s, regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS chunk
      FROM chain JOIN documents USING (doc_id))
WHERE chunk <> ''"""


# Requests: (qid, request_id, address, resume, job_desc, question).
_RESUMES = """
SELECT CAST(doc_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS request_id,
       'user' || doc_id || '@example.com' AS address, text AS resume, lang || ' ' || source AS job_desc
FROM documents"""
_TURNS = """
SELECT conv_id || '-' || turn AS qid, CAST(conv_id AS VARCHAR) AS request_id,
       'user' || conv_id || '-' || turn || '@example.com' AS address, text AS resume, role AS job_desc
FROM conversations"""

_COURSE_DOCS = f"""
SELECT concat_ws('-', CAST(id AS VARCHAR), md5(title || headline)) AS doc_id, CAST(NULL AS VARCHAR) AS qid,
       title || headline AS text, title
FROM ({_LISTING_A} UNION ALL {_VALID_B}) WHERE headline IS NOT NULL"""


def _recommend_windows(requests: str, question: str, titles: bool = False) -> str:
    """Fixed windows and letter counts; ``question`` is an expression over the requests."""
    listed = """
  SELECT q, min(title) AS line, min(d) AS d, min(chunk_id) AS chunk_id
  FROM near JOIN courses ON doc_id = split_part(chunk_id, '#', 1) GROUP BY q, title"""
    lines = listed if titles else "SELECT q, chunk AS line, d, chunk_id FROM near"
    return f"""
WITH requests AS MATERIALIZED (SELECT *, {question} AS question FROM ({requests})),
asked AS (SELECT row_number() OVER (ORDER BY question) AS q, question FROM (SELECT DISTINCT question FROM requests)),
request_docs AS (
  SELECT 'resume-' || request_id AS doc_id, qid, resume AS text FROM requests WHERE resume IS NOT NULL
  UNION ALL SELECT 'job-' || request_id, qid, job_desc FROM requests WHERE job_desc IS NOT NULL),
courses AS MATERIALIZED (SELECT DISTINCT * FROM ({_COURSE_DOCS})),
docs AS (SELECT * FROM request_docs UNION ALL SELECT doc_id, qid, text FROM courses),
texts AS (
  SELECT qid, NULL::BIGINT AS q, doc_id || '#' || lpad(CAST(chunk_idx AS VARCHAR), 9, '0') AS chunk_id, chunk
  FROM ({_chunks("docs", "doc_id, qid")})
  UNION ALL SELECT NULL, q, NULL, question FROM asked),
counts AS (
  SELECT *, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
                           lambda c: length(chunk) - length(replace(chunk, c, ''))) AS n FROM texts),
vectors AS MATERIALIZED (
  SELECT qid, q, chunk_id, chunk, list_transform(n, lambda x: CAST(x / norm AS FLOAT)::DOUBLE) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(n, lambda x: x * x))::DOUBLE) AS norm FROM counts)
  WHERE norm > 0),
questions AS (SELECT q, question, v AS qv FROM vectors JOIN asked USING (q)),
near AS MATERIALIZED (
  SELECT s.q, c.chunk_id, c.chunk,
         list_sum(list_transform(list_zip(c.v, s.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM vectors c, questions s WHERE c.qid IS NULL AND c.q IS NULL
  QUALIFY row_number() OVER (PARTITION BY s.q ORDER BY d, c.chunk_id) <= 3),
own AS (
  SELECT c.qid, c.chunk_id, c.chunk,
         list_sum(list_transform(list_zip(c.v, s.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM vectors c JOIN requests r ON r.qid = c.qid JOIN questions s ON s.question = r.question),
hits AS (
  SELECT * FROM (
    SELECT qid, chunk_id, chunk, d FROM own UNION ALL
    SELECT r.qid, n.chunk_id, n.chunk, n.d
    FROM near n JOIN questions s USING (q) JOIN requests r ON r.question = s.question)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) <= 3),
answers AS (
  SELECT qid, string_agg(chunk, e'\n\n' ORDER BY d, chunk_id) AS context,
         string_agg(chunk_id, ',' ORDER BY d, chunk_id) AS sources FROM hits GROUP BY qid),
messages AS (SELECT q, string_agg(line, e'\n' ORDER BY d, chunk_id) AS message FROM ({lines}) GROUP BY q)
SELECT request_id, address, 'Courses' AS subject, message, context, sources,
       {_PROMPT_OF} AS prompt
FROM answers JOIN requests USING (qid) JOIN asked USING (question) JOIN messages USING (q)"""


def _embed_counts(dimension: int = 256) -> str:
    """Words of each text by the 32-bit MurmurHash 3 of their UTF-8 bytes, seed 42, modulo ``dimension``."""
    word = 1 << 32

    def times(x: str, factor: int) -> str:
        return f"(({x})::HUGEINT * {factor} % {word})"

    def turned(x: str, bits: int) -> str:
        # modulo one less than 2 ** 32, a product with a power of two is a rotation
        return f"(({x})::HUGEINT * {1 << bits} % {word - 1})"

    def scrambled(block: str) -> str:
        return times(turned(times(block, 0xCC9E2D51), 15), 0x1B873593)

    def little_endian(first: str, count: int) -> str:
        return " + ".join(f"b[{first} + {k}]::HUGEINT * {256 ** (k - 1)}" for k in range(1, count + 1))

    folded = f"(({turned('xor(h::BIGINT, k::BIGINT)', 13)} * 5 + {0xE6546B64}) % {word})"
    rest = " ".join(f"WHEN {n} THEN {scrambled(little_endian('4 * (n // 4)', n))}" for n in (1, 2, 3))
    return f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+')) AS w
  FROM documents
), bytes AS (
  SELECT w, strlen(w) AS n, list_transform(range(1, strlen(w) + 1),
    lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT w FROM words)
), body AS (
  SELECT w, n, b, list_reduce(list_prepend(42::HUGEINT, list_transform(range(0, n // 4),
    lambda i: {scrambled(little_endian('4 * i', 4))})), lambda h, k: {folded}) AS h FROM bytes
), tail AS (
  SELECT w, xor(xor(h::BIGINT, (CASE n % 4 {rest} ELSE 0 END)::BIGINT), n) AS h FROM body
), one AS (SELECT w, {times('xor(h, h >> 16)', 0x85EBCA6B)}::BIGINT AS h FROM tail),
two AS (SELECT w, {times('xor(h, h >> 13)', 0xC2B2AE35)}::BIGINT AS h FROM one)
SELECT doc_id, CAST(xor(h, h >> 16) % {dimension} AS INT) AS component, count(*) AS n_words, true AS as_embedded
FROM words JOIN two USING (w) GROUP BY ALL"""


ORACLES: dict[str, str] = {
    # listings
    "listing_a": _LISTING_A,
    "listing_b": _LISTING_B,
    "listing_bad_envelope": """
SELECT conv_id * 1000 + turn AS _page, text AS raw, 'bad_envelope' AS errors
FROM conversations WHERE role <> 'assistant'""",
    "courses_conform": _VALID_B,
    "courses_rejects": f"""
SELECT * FROM (
  SELECT 'b' AS _source, id // {PAGE_ROWS} AS _page, CAST(id AS VARCHAR) AS raw_id, title AS raw_title,
         concat_ws(',', CASE WHEN title IS NULL THEN 'title_null' END,
                   CASE WHEN length(title) > 255 THEN 'title_length' END,
                   CASE WHEN enrolled IS NULL THEN 'enrolled_cast' END) AS errors
  FROM (SELECT * REPLACE (CAST(id AS BIGINT) AS id) FROM ({_LISTING_B})))
WHERE errors <> ''""",
    "courses_union": f"{_LISTING_A} UNION ALL {_VALID_B}",
    "courses_append": f"{_LISTING_A} UNION ALL {_LISTING_A}",
    "page_gaps": "SELECT doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "page_gap_runs": """
SELECT page + 1 AS gap_first, next - 1 AS gap_last FROM (
  SELECT page, lead(page) OVER (ORDER BY page) AS next FROM (
    SELECT -1 AS page UNION ALL SELECT DISTINCT conv_id * 1000 + turn FROM conversations))
WHERE next > page + 1""",
    "course_text": "SELECT p_name || p_type AS text FROM part WHERE p_type <> 'ECONOMY'",
    # accounts
    "row_rules": f"""
SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(text, '@') THEN 'email_format' END,
       CASE WHEN NOT regexp_matches(text, '\\p{{Lu}}') THEN 'password_uppercase' END,
       CASE WHEN NOT regexp_matches(text, {_quote(SPECIAL_CHARACTER)}) THEN 'password_special' END) AS errors
FROM documents""",
    "upload_admit": """
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'""",
    "upload_rejects": """
SELECT id, errors FROM (
  SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderpriority = '5-LOW' THEN 'no_file' END,
         CASE WHEN o_orderstatus <> 'O' THEN 'not_pdf' END) AS errors FROM orders)
WHERE errors <> ''""",
    "user_lookup": f"""
SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, c_name AS password
FROM customer WHERE c_custkey IN ({_ACTIVE})""",
    "user_credential": f"SELECT c_name AS password FROM customer WHERE c_custkey IN ({_ACTIVE})",
    "user_uploads": f"""
SELECT o_orderkey AS id, to_base64(encode(o_orderpriority)) AS pdf_resume,
       o_orderstatus || ' ' || o_orderpriority AS job_description
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN ({_ACTIVE})""",
    "upload_page": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "upload_page_after": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "upload_listing": f"SELECT id, email FROM ({_UPLOADS}) ORDER BY id",
    "fk_ok": f"SELECT id FROM ({_UPLOADS}) WHERE o_custkey IN ({_ACTIVE})",
    "fk_orphan": f"SELECT id FROM ({_UPLOADS}) WHERE o_custkey NOT IN ({_ACTIVE})",
    "erase_users": f"""
SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email
FROM customer WHERE c_custkey NOT IN ({_ACTIVE})""",
    "erase_uploads": f"SELECT id, email FROM ({_UPLOADS}) WHERE o_custkey NOT IN ({_ACTIVE})",
    "erase_report": f"""
SELECT (SELECT count(*) FROM customer WHERE c_custkey IN ({_ACTIVE})) AS users_removed,
       (SELECT count(*) FROM orders WHERE o_custkey IN ({_ACTIVE})) AS uploads_removed""",
    "user_admit": f"""
SELECT min(id) AS id, email FROM ({_UPLOADS}) WHERE o_custkey NOT IN ({_ACTIVE}) GROUP BY email""",
    "user_admit_rejects": f"""
SELECT id, email, CASE WHEN n > 1 THEN 'key_repeated' ELSE 'key_taken' END AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY id) AS n FROM ({_UPLOADS}))
WHERE n > 1 OR o_custkey IN ({_ACTIVE})""",
    "upsert_latest": """
SELECT c_custkey AS key, coalesce(arg_max(o_totalprice, o_orderkey), any_value(c_acctbal)) AS v
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "update_latest": """
SELECT CAST(n_nationkey AS BIGINT) AS key, coalesce(arg_max(o_totalprice, o_orderkey), 0.0::DOUBLE) AS v
FROM nation LEFT JOIN orders ON n_nationkey = o_custkey GROUP BY n_nationkey""",
    "surrogate_summary": "SELECT count(*) AS n_rows, count(*) AS n_ids, true AS above_start FROM customer",
    "ids_two_loads": """
SELECT c_custkey AS key, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS id FROM customer
UNION ALL
SELECT s_suppkey, s_name, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey) FROM supplier""",
    # messages
    "upload_publish": f"""
SELECT CAST(id AS VARCHAR) AS message_id, email, o_orderpriority AS resume,
       o_orderstatus || ' ' || o_orderpriority AS job_desc, CAST(NULL AS VARCHAR) AS error
FROM ({_UPLOADS}) JOIN orders ON o_orderkey = id
WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND orders.o_custkey IN ({_ACTIVE})""",
    "upload_publish_rejects": f"""
SELECT id, errors FROM (
  SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderpriority = '5-LOW' THEN 'no_file' END,
         CASE WHEN o_orderstatus <> 'O' THEN 'not_pdf' END,
         CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'O' AND o_custkey NOT IN ({_ACTIVE})
              THEN 'unknown_user' END) AS errors FROM orders)
WHERE errors <> ''""",
    "request_roundtrip": """
SELECT CAST(doc_id AS VARCHAR) AS request_id, 'user' || doc_id || '@example.com' AS email,
       text AS resume, lang || ' ' || source AS job_desc FROM documents""",
    "answer_trim": """
SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM conversations""",
    "notify_rows": """
SELECT 'user' || conv_id || '@example.com' AS address, 'Courses' AS subject,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS message FROM conversations""",
    # corpus
    "atomic_meta": "SELECT vec_id, label FROM embeddings",
    "doc_union": _DOC_UNION,
    "chunk_fixed": _chunks("documents", "doc_id"),
    "chunk_text": _chunk_text(),
    "embed_counts": _embed_counts(),
    "embed_model": f"""
SELECT doc_id, chunk_idx, CAST(length(chunk) AS INT) AS n_chars,
       CAST(length(chunk) - length(replace(chunk, ' ', '')) AS INT) AS n_spaces
FROM ({_chunks("documents", "doc_id")})""",
    "index_roundtrip": f"""
SELECT *, doc_id || '#' || lpad(CAST(chunk_idx AS VARCHAR), 9, '0') AS chunk_id
FROM ({_chunks(f"({_DOC_UNION})", "doc_id, owner, kind, meta")})""",
    # retrieval
    "knn_top3": _hits(_ALL_PAIRS),
    "knn_cosine": _hits(_ALL_PAIRS, "cosine"),
    "knn_cells": _hits(_ALL_PAIRS),
    "knn_sent_corpus": _hits(_ALL_PAIRS),
    "knn_lsh_recall": """
SELECT count(*) AS n_queries, true AS distances_exact, true AS recall_reached FROM embeddings""",
    "knn_ivf_recall": """
SELECT count(*) AS n_queries, true AS distances_exact, true AS recall_reached FROM embeddings""",
    "knn_scoped": _hits(_SCOPED_PAIRS),
    "context": f"SELECT qid, context FROM ({_ANSWERS})",
    "source_docs": f"SELECT qid, sources FROM ({_ANSWERS})",
    "prompt": f"SELECT qid, {_PROMPT} AS prompt FROM ({_ANSWERS})",
    "recommend": _RECOMMEND,
    "recommend_windows": _recommend_windows(_RESUMES, _quote(STANDING_QUESTION)),
    "recommend_isolated": _recommend_windows(_TURNS, _quote(STANDING_QUESTION)),
    "recommend_per_request": _recommend_windows(_RESUMES, "job_desc"),
    "recommend_titles": _recommend_windows(_RESUMES, _quote(STANDING_QUESTION), True),
    "recommend_titles_each": _recommend_windows(_RESUMES, "job_desc", True),
    "outbound_batch": f"""
SELECT address, subject, message FROM ({_recommend_windows(_RESUMES, _quote(STANDING_QUESTION), True)})
UNION ALL
SELECT {_quote(OPERATOR_ADDRESS)}, 'Service Error', 'Error occurred: ' ||
       CASE WHEN value < 10 THEN 'email is missing' ELSE 'body is not JSON' END
FROM events WHERE event_type = 'purchase' AND value < 20""",
    # streams
    "stream_route": f"""
SELECT event_id, CASE WHEN value < 10 THEN props WHEN value < 20 THEN event_type ELSE body END AS body
FROM (
  SELECT *, to_json({{'email': 'user' || user_id || '@example.com',
                      'file_content': to_base64(encode(event_type)), 'job_desc': props}})::VARCHAR AS body
  FROM events) WHERE event_type = 'purchase'""",
    "stream_deadletter": f"""
SELECT event_id, {_quote(OPERATOR_ADDRESS)} AS address, 'Service Error' AS subject,
       'Error occurred: ' || CASE WHEN value < 10 THEN 'email is missing' ELSE 'body is not JSON' END AS message,
       CASE WHEN value < 10 THEN props ELSE event_type END AS body
FROM events WHERE event_type = 'purchase' AND value < 20""",
    "stream_admit": f"SELECT id FROM ({_UPLOADS}) WHERE o_custkey IN ({_ACTIVE})",
    "stream_poison": f"""
SELECT doc_id, CASE WHEN bad THEN {_quote(OPERATOR_ADDRESS)} ELSE 'user' || doc_id || '@example.com' END AS address,
       CASE WHEN bad THEN 'Service Error' ELSE 'Courses' END AS subject,
       CASE WHEN bad THEN 'Error occurred: ' || length(text) || ' characters are too many'
            ELSE length(text) || ' ' || (length(text) - length(replace(text, ' ', ''))) END AS message
FROM (SELECT *, length(text) > {LONGEST_TEXT} AS bad FROM documents)""",
    "stream_courses_table": _LISTING_A,
    "stream_ingest": _LISTING_A,
    "stream_recommend": _RECOMMEND,
}
