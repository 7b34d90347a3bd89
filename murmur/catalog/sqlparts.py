"""SQL fragments shared by the oracle statements."""

LOG = """
log AS (
  SELECT event_id AS row_id, ts,
    CASE WHEN event_type = 'signup' THEN 'vote' END AS event,
    CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('u', user_id, '-', CAST(ts AS DATE)) END AS session_id,
    CAST(hour(ts) * 60 + minute(ts) + 1 AS BIGINT) AS turn_index,
    CASE user_id % 4 WHEN 0 THEN 'openai/m1' WHEN 1 THEN 'openai/m2' WHEN 2 THEN 'anthropic/m3' ELSE 'gemini/m4' END AS model,
    CASE user_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' ELSE 'gemini' END AS provider,
    CASE user_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'personal' ELSE 'inner_circle' END AS audience_tier,
    CASE event_type WHEN 'click' THEN 'walkthrough' WHEN 'purchase' THEN 'diagram_only' ELSE 'standard' END AS workflow,
    (user_id % 25 = 0 AND event_id % 10 = 0) AS is_owner_traffic,
    event_type = 'error' AS had_error,
    event_id % 97 = 0 AS empty_response,
    CAST(floor(value * 100) AS BIGINT) AS latency_ms,
    CAST(floor(value * 10) AS BIGINT) AS response_chars,
    CASE WHEN event_id % 41 <> 0 THEN k / 100.0::DOUBLE END AS chunk_similarity_avg,
    CASE WHEN event_id % 41 <> 0 THEN (k + 7) / 107.0::DOUBLE END AS chunk_similarity_max,
    k / 1000.0::DOUBLE AS cost_usd,
    CAST(k % 11 AS BIGINT) AS n_chunks_retrieved,
    CAST(5 + 5 * (user_id % 3) AS BIGINT) AS n_chunks_config,
    (user_id % 11) / 10.0::DOUBLE AS temperature,
    event_id % 13 = 0 AS tool_called,
    CASE WHEN event_id % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'send_notification' ELSE 'roll_dice' END END AS tool_name,
    CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS liked,
    CAST(k * 9 AS BIGINT) AS prompt_tokens,
    CASE WHEN k % 7 <> 0 THEN CAST(k * 4 AS BIGINT) END AS completion_tokens
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
),
chats AS (SELECT * FROM log WHERE event IS NULL),
votes AS (SELECT * FROM log WHERE event = 'vote')
"""

MESSAGES = """
msgs AS (
  SELECT c.*, b.text AS message FROM log c
  LEFT JOIN benchmark b ON b.item_id = (c.row_id * 7) % (SELECT count(*) FROM benchmark)
),
chats_m AS (SELECT * FROM msgs WHERE event IS NULL)
"""

SESSION_KEY = ("CASE WHEN trim(session_id) = '' THEN concat('__missing_session__:', row_id) "
               "ELSE session_id END")

OWNER = """
touched AS (SELECT DISTINCT session_id FROM log WHERE is_owner_traffic AND trim(session_id) <> '')
"""


def mean(x: str) -> str:
    return (f"(CAST(sum(CAST({x} AS DECIMAL(20,6))) AS DOUBLE) / "
            f"CASE WHEN count({x}) > 0 THEN count({x}) END)")


def total(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(20,6))) AS DOUBLE), 0.0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def rate(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {n} / {d} END)"


def quantile(source: str, value: str, num: int, den: int, method: str = "linear",
             min_rows: int = 1) -> str:
    """Scalar subquery: exact quantile by position over the sorted values."""
    if method == "linear":
        low, share = f"(({num} * (n - 1)) // {den} + 1)", f"(({num} * (n - 1)) % {den})"
    elif method == "exclusive":
        low = f"least(greatest(({num} * (n + 1)) // {den}, 1), greatest(n - 1, 1))"
        share = f"({num} * (n + 1) - {low} * {den})"
    else:
        low, share = f"least((n * {num}) // {den} + 1, n)", "0"
    high = low if method == "upper" else f"least({low} + 1, n)"
    return f"""(SELECT CASE WHEN max(n) >= {min_rows} THEN
        CAST(max(CASE WHEN rn = {low} THEN v END) * (max({den} - {share}))
         + max(CASE WHEN rn = {high} THEN v END) * (max({share})) AS DOUBLE) / {den} END
      FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) AS rn, count(*) OVER () AS n
            FROM {source} WHERE {value} IS NOT NULL))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


DOCS = """
docs AS (SELECT doc_id, text, lang, source, n_chars,
  CASE source WHEN 'src18' THEN 'notes-personal' WHEN 'src19' THEN 'notes-inner' ELSE 'notes-public' END AS source_type
  FROM documents)
"""

USER_MESSAGES = """
um AS (SELECT concat(conv_id, '-', turn) AS message_id, text AS message FROM conversations WHERE role = 'user')
"""

CATALOGUE = """
cat0 AS (SELECT *, string_split(text, ' ') AS w FROM benchmark),
cat AS (SELECT concat('p', item_id) AS project_id, item_id AS "order",
  concat_ws(' ', coalesce(w[1], ''), coalesce(w[2], '')) AS title, text AS summary,
  CASE WHEN length(text) % 2 = 0 THEN concat_ws(' ', coalesce(w[8], ''), coalesce(w[9], '')) ELSE '' END AS design_insight,
  CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END AS walkthrough_context,
  [lower(coalesce(w[5], '')), lower(coalesce(w[7], ''))] AS tags,
  [concat_ws(' ', coalesce(w[3], ''), coalesce(w[4], '')), coalesce(w[6], '')] AS mention_keywords,
  concat('https://example.org/', coalesce(w[4], '')) AS demo,
  CASE WHEN length(text) % 3 = 0 THEN concat_ws(' ', coalesce(w[9], ''), coalesce(w[10], '')) END AS post_title,
  concat('https://example.org/b/', coalesce(w[9], '')) AS post_url
  FROM cat0)
"""

WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def words(x: str) -> str:
    return f"list_distinct({WORDS.format(x=x)})"


MD_DOCS = """
md AS (SELECT * REPLACE (array_to_string(list_transform(string_split(text, chr(10)), lambda s, i:
    CASE WHEN (i - 1) % 5 = 2 THEN concat('## L', i - 1, chr(10), s)
         WHEN (i - 1) % 5 = 4 THEN concat('### L', i - 1, chr(10), s) ELSE s END), chr(10)) AS text) FROM docs),
ml AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM md)
"""

STRIP_LINES = r"regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g')"

MD_SECTIONS = MD_DOCS.strip() + rf""",
ms0 AS (SELECT *, sum(CAST(regexp_matches(line, '^##\s+.') AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM ml),
ms1 AS (SELECT doc_id, g, coalesce(max(CASE WHEN regexp_matches(line, '^##\s+.') THEN trim(substr(line, 4)) END), 'Preamble') AS section_name,
  {STRIP_LINES} AS text, max(CASE WHEN regexp_matches(line, '^##\s+.') THEN 2 ELSE 0 END) AS header_level,
  min(n) AS start_line, max(n) AS end_line FROM ms0 GROUP BY doc_id, g),
msec AS (SELECT doc_id, section_name, text, CAST(header_level AS INT) AS header_level, CAST(start_line AS INT) AS start_line,
  CAST(end_line AS INT) AS end_line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS BIGINT) AS section_order
  FROM ms1 WHERE text <> '')
"""

LINE_CHUNKS = """
lc AS (SELECT concat(doc_id, '-', i - 1) AS id, doc_id, concat(source_type, ':', source) AS source, source_type,
  CASE WHEN lang <> 'en' THEN concat('part ', (i - 1) // 10) END AS section, CAST(i - 1 AS INT) AS chunk_index, text,
  length(text) AS char_count
  FROM (SELECT doc_id, lang, source, source_type, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs))
"""

SQUASH = r"trim(regexp_replace(p, '\s+', ' ', 'g'))"


def chunk_ctes(source: str, key: str, size: int, overlap: int, prefix: str = "") -> str:
    """Recursive CTEs cutting ``source(key, text)`` into ``{prefix}ch(key, k, s, e, text)``."""
    p = prefix
    return rf"""
{p}pp AS (SELECT {key} AS key, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {SQUASH}), lambda p: p <> '') AS ps FROM {source}),
{p}pf AS (SELECT key, ps, len(ps) AS n,
  list_transform(range(0, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x) + 1)), 0)) AS f,
  list_transform(range(0, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)) AS q FROM {p}pp WHERE len(ps) > 0),
{p}st AS (
  SELECT key, 0 AS k, 0 AS s, greatest(1, len(list_filter(f[2:], lambda x: x <= {size} + 1))) AS e FROM {p}pf
  UNION ALL
  SELECT key, k + 1, s2, greatest(s2 + 1, len(list_filter(f[2:], lambda x: x <= {size} + 1 + f[s2 + 1]))) FROM (
    SELECT st.key, st.k, pf.f, greatest(st.s + 1, len(list_filter(pf.q, lambda x: x < pf.q[st.e + 1] - {overlap}))) AS s2
    FROM {p}st AS st JOIN {p}pf AS pf ON pf.key = st.key WHERE st.e < pf.n)),
{p}ch AS (SELECT key, k, s, e - 1 AS e, array_to_string(ps[s + 1:e], chr(10) || chr(10)) AS text FROM {p}st JOIN {p}pf USING (key))"""


def merge_ctes(min_chars: int, prefix: str = "") -> str:
    """Recursive CTEs joining short chunks of ``{prefix}ch`` into ``{prefix}mg(key, k, text)``."""
    p = prefix
    return f"""
{p}cl AS (SELECT key, list(text ORDER BY k) AS c FROM {p}ch GROUP BY key),
{p}mr AS (
  SELECT key, 0 AS i, CAST(NULL AS VARCHAR) AS carry, CAST([] AS VARCHAR[]) AS done FROM {p}cl
  UNION ALL
  SELECT key, i + 1, CASE WHEN length(cand) < {min_chars} THEN cand END,
    CASE WHEN length(cand) < {min_chars} THEN done ELSE list_append(done, cand) END FROM (
    SELECT mr.key, mr.i, mr.done, CASE WHEN mr.carry IS NULL THEN cl.c[mr.i + 1] ELSE mr.carry || chr(10) || chr(10) || cl.c[mr.i + 1] END AS cand
    FROM {p}mr AS mr JOIN {p}cl AS cl ON cl.key = mr.key WHERE mr.i < len(cl.c))),
{p}ml AS (SELECT mr.key, CASE WHEN carry IS NULL THEN done WHEN len(done) = 0 THEN [carry]
    ELSE list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || chr(10) || carry) END AS texts
  FROM {p}mr AS mr JOIN {p}cl AS cl ON cl.key = mr.key WHERE mr.i = len(cl.c)),
{p}mg AS (SELECT key, CAST(generate_subscripts(texts, 1) - 1 AS INT) AS k, unnest(texts) AS text FROM {p}ml)"""


def with_recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


PROJECT_ENTITIES = """
pe AS (SELECT CAST(l_suppkey AS VARCHAR) AS project_id, ['skills', 'methods', 'technologies'][p_size % 3 + 1] AS kind,
  concat(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(upper(split_part(p_name, ' ', 1)[1]), split_part(p_name, ' ', 1)[2:], ' ',
    upper(split_part(p_name, ' ', 2)[1]), split_part(p_name, ' ', 2)[2:]) ELSE p_name END, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END) AS name,
  p_type AS category, p_brand AS detail, l_suppkey * 10000000 + l_partkey AS seq
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey)
"""

PROJECT_USES = """
uses AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS project, CASE WHEN p_size % 2 = 0 THEN 'methods' ELSE 'technologies' END AS kind,
  concat('part ', l_partkey) AS entity, CASE WHEN p_size % 2 = 0 THEN l_returnflag END AS detail FROM lineitem JOIN part ON p_partkey = l_partkey)
"""

SECTION_MENTIONS = r"""
sd AS (SELECT *, concat('kb_', source, ':', doc_id) AS section_id FROM docs),
sm AS (
  SELECT section_id, 'concepts' AS kind, unnest(ws) AS name, CAST(NULL AS VARCHAR) AS context,
    doc_id * 100000 + generate_subscripts(ws, 1) - 1 AS seq FROM (
    SELECT section_id, doc_id, list_transform(list_sort(list_transform(list_distinct(ws), lambda w: {'p': list_position(ws, w), 'w': w})), lambda x: x.w) AS ws
    FROM (SELECT section_id, doc_id, regexp_extract_all(text, '\p{L}{14,}') AS ws FROM sd))
  UNION ALL SELECT section_id, 'skills', p_name, NULL, doc_id * 100000 FROM sd JOIN part ON p_partkey = doc_id
  UNION ALL SELECT section_id, 'projects', CASE lang WHEN 'en' THEN concat(' ', lower(title)) WHEN 'fr' THEN mention_keywords[1] ELSE 'no such project' END,
    sd.text, doc_id * 100000 FROM sd JOIN cat ON cat."order" = doc_id)
"""


SECTIONS = """
sec AS (SELECT vec_id AS section_id, vec_id // 8 AS parent, vec_id % 8 AS ord, concat('part ', vec_id % 8) AS name,
  CASE WHEN vec_id % 10 <= 6 THEN 0 WHEN vec_id % 10 <= 8 THEN 1 ELSE 2 END AS tr, coalesce(d.text, '') AS full_text,
  length(coalesce(d.text, '')) AS char_count, concat_ws(':', d.source_type, d.source) AS source,
  CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings LEFT JOIN docs d ON d.doc_id = vec_id),
q AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, item_id % 3 AS qr, 5 AS k, label AS qlabel, text
  FROM benchmark JOIN embeddings ON vec_id = item_id),
pairs AS (SELECT query_id, qr, qlabel, section_id, tr, parent, name, char_count, source, label, full_text,
  list_distance(e, qe) AS distance, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS cosine
  FROM q CROSS JOIN sec)
"""


def topk_cte(name: str, order: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, section_id) AS INT) AS rank
  FROM pairs WHERE {where}) WHERE rank <= {k})"""


L2_ORDER = "round(distance, 9)"
COS_ORDER = "round(1.0::DOUBLE - cosine, 9)"
L2_SCORE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - distance * distance / 2.0::DOUBLE))"

SIGNALS = """
sig AS (SELECT section_id, CAST(section_id % 3 = 0 AS BIGINT) AS projects_described,
  CASE WHEN section_id % 8 = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, section_id % 8 + 1), lambda i: section_id * i % 50))) END AS entities_mentioned
  FROM sec)
"""


def rerank_cte(name: str, source: str, sem: float, proj: float, ent: float, length: float) -> str:
    return f"""{name}_s AS (SELECT c.* EXCLUDE (rank), projects_described, entities_mentioned, cosine * {sem}::DOUBLE AS semantic_part,
    CASE WHEN projects_described > 0 THEN {proj}::DOUBLE ELSE 0.0::DOUBLE END AS project_bonus,
    CAST(least(entities_mentioned, 5) AS DOUBLE) / 5 * {ent}::DOUBLE AS entity_bonus,
    CASE WHEN char_count > 2000 THEN {length}::DOUBLE ELSE 0.0::DOUBLE END AS length_bonus
  FROM {source} c JOIN sig USING (section_id) WHERE tr <= qr),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, section_id) AS INT) AS rank
  FROM (SELECT *, semantic_part + project_bonus + entity_bonus + length_bonus AS final_score FROM {name}_s) QUALIFY rank <= 5)"""


def eval_cte(run: str) -> str:
    b = run == "b"
    response = "CASE WHEN lang = 'es' THEN 'Sí. [x](http://e.org) happy to' ELSE text END" if b else "text"
    return f"""res_{run} AS (SELECT 'run-{run}' AS run_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('q', doc_id) END AS question_id, text AS question,
  source AS legacy_category, lang AS question_type, {response} AS response, CASE WHEN doc_id % {13 if b else 19} = 0 THEN 'timeout' END AS error,
  CASE doc_id % 7 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'prompt' END AS issue_source,
  list_transform(range(1, doc_id % 5 + 1), lambda j: {{'source': source, 'chunk_index': CAST((doc_id * j + j * {1 if b else 0}) % 17 AS INT), 'similarity': (doc_id * j) % 100 / 100.0::DOUBLE}}) AS chunks,
  doc_id % 1000 AS total_tokens, (doc_id % 50) / 1000.0::DOUBLE AS cost_usd, (doc_id + {7 if b else 0}) % 100 / 100.0::DOUBLE AS sim, doc_id AS pos,
  coalesce(nullif(CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('q', doc_id) END, ''), substr(text, 1, 80)) AS key
  FROM docs{" WHERE source <> 'src11'" if b else ""}),
k_{run} AS (SELECT * FROM res_{run} QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1)"""
