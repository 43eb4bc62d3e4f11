"""DuckDB SQL for the corpus queries that SQL can express."""

from . import chat, secrets

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept = page_id THEN NULL ELSE kept END AS refers_to
FROM d
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), tests AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda i: w[i : i + least(8, len(w)) - 1])) AS t
  FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM tests
), places AS (
  SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m
), hits AS (
  SELECT doc_id, i, p.m, item FROM places p JOIN tests t ON p.m = t.m AND p.w[i : i + p.m - 1] = t.t
), covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op3() -> str:
    """Windows by their greedy spans; lengths of escaped texts from the marks that escaping adds."""
    count = lambda col, c: f"((length({col}) - length(replace({col}, {_quoted(c)}, ''))) // {len(c)})"
    added = lambda col: " + ".join(count(col, c) for c in ("\\", *chat.CONTROLS))
    frame = len(chat.TURN) + 1 + len(chat.END) + 1
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, len(regexp_extract_all(text, {_quoted(chat.PIECES)})) + {chat.OVERHEAD} AS cost,
         {frame} + length(role) + {added('role')} + {len(chat.LINE) - 1} * {count('role', chr(10))} + length(text) + {added('text')} AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM t
), u AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM c
), s AS (
  SELECT conv_id, cost AS sys_cost, size AS sys_size FROM u WHERE i = 0 AND role = '{chat.SYSTEM}'
), r AS (
  SELECT u.conv_id, u.i, u.upto - u.cost AS before, coalesce(sys_cost, 0) AS sys_cost, coalesce(sys_size, 0) AS sys_size, (sys_cost IS NOT NULL)::INT AS n_system,
         CASE WHEN u.i = 0 THEN {chat.BUDGET} ELSE {chat.BUDGET - chat.HISTORY} - coalesce(sys_cost, 0) END AS room
  FROM u LEFT JOIN s ON u.conv_id IS NOT DISTINCT FROM s.conv_id
), spans AS (
  SELECT r.conv_id, r.i AS b, any_value(r.before) AS before, any_value(sys_cost) AS sys_cost, any_value(sys_size) AS sys_size, any_value(n_system) AS n_system,
         max(u.i) + 1 AS e, max(u.upto) - any_value(r.before) AS cost, sum(u.size) AS size
  FROM r JOIN u ON u.conv_id IS NOT DISTINCT FROM r.conv_id AND u.i >= r.i AND (u.i = r.i OR u.upto - r.before <= r.room) GROUP BY r.conv_id, r.i
), used AS (
  SELECT * FROM spans WHERE b = 0
  UNION ALL SELECT n.* FROM used JOIN spans n ON n.conv_id IS NOT DISTINCT FROM used.conv_id AND n.b = used.e
), history AS (
  SELECT used.conv_id, used.b, sum(u.size) AS size FROM used JOIN u ON u.conv_id IS NOT DISTINCT FROM used.conv_id AND used.b > 0 AND u.i < used.b AND u.i >= n_system
    AND used.before - (u.upto - u.cost) <= least({chat.HISTORY}, {chat.BUDGET} - used.sys_cost - used.cost) GROUP BY used.conv_id, used.b
), sizes AS (
  SELECT used.conv_id, sum(used.size + CASE WHEN used.b > 0 THEN sys_size ELSE 0 END + coalesce(history.size, 0))::BIGINT AS formatted_chars
  FROM used LEFT JOIN history ON history.conv_id IS NOT DISTINCT FROM used.conv_id AND history.b = used.b GROUP BY used.conv_id
), texts AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.ASSISTANT}'), '') AS loss FROM u GROUP BY conv_id
)
SELECT texts.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM texts JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM texts.conv_id
"""


def _op9() -> str:
    """Per rule the texts between matches and the matches, laid end to end."""
    columns, spans = [], []
    for k, rule in enumerate(secrets.RULES):
        p = _quoted(rule.pattern)
        columns += [f"regexp_extract_all(text, {p}, 0) AS m{k}", f"string_split_regex(text, {p}) AS b{k}", f"regexp_extract_all(text, {p}, {rule.group}) AS v{k}"]
        length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
        places = f"list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': ({length(f'b{k}[1:i]')} + {length(f'm{k}[1:i-1]')})::BIGINT, 'rank': {k}, 'size': length(m{k}[i]), 'part': length(v{k}[i]), 'kind': '{rule.kind}'}})"
        spans.append(f"list_filter({places}, lambda x: x.part >= {rule.least})")
    whole = spans[0]
    for s in spans[1:]:
        whole = f"list_concat({whole}, {s})"
    joined = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size)), ','), '')"
    base = [k for k, r in enumerate(secrets.RULES) if r.base]
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.rank = {k}))::BIGINT AS n_{secrets.RULES[k].kind}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS (SELECT doc_id, {", ".join(columns)} FROM d
), s AS (SELECT doc_id, list_sort({whole}) AS spans FROM f)
SELECT doc_id, {counts}, sha256({joined(f"list_filter(spans, lambda s: s.rank <= {max(base)})")}) AS base_sha256, {joined("spans")} AS spans FROM s
"""


ORACLE_SQL = {"op1_warc": OP1, "op3_chat": _op3(), "op8_decontamination": OP8, "op9_secrets": _op9()}
