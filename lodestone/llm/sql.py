"""DuckDB SQL with the results of those queries that SQL can express."""

from lodestone.llm import quality

DECONTAMINATION = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT r, i, windows.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), marked AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS least FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM marked
"""


def _text(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i : i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs)
), short AS (
  SELECT *, len(lw) BETWEEN 1 AND {quality.SHORT} AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '[.!?…:;"''»”)\]。！？]$') AND NOT regexp_matches(line, '^[ \t]*([-*+•–]|[0-9]+[.)])[ \t]') AS scrap FROM lines
), islands AS (
  SELECT *, k - row_number() OVER (PARTITION BY r, scrap ORDER BY k) AS island, 2 * count_if(scrap) OVER (PARTITION BY r) <= count_if(len(lw) > 0) OVER (PARTITION BY r) AS few FROM short
), runs AS (
  SELECT *, scrap AND few AND count(*) OVER (PARTITION BY r, scrap, island) >= {quality.RUN} AS stray FROM islands
), judged AS (
  SELECT *, len(lw) > 0 AND (
    len(list_filter([{_text(*quality.BOILERPLATE)}], lambda x: contains(lower(line), x) AND len(lw) <= {quality.FILL} * len(string_split(x, ' ')))) > 0
    OR len(lw) <= {2 * quality.SHORT} AND len(list_filter(lw, lambda x: trim(x, '|<>«»›‹·•-–—/\,.:') <> '' AND NOT list_contains([{_text(*quality.NAVIGATION)}], lower(trim(x, '|<>«»›‹·•-–—/\,.:'))))) = 0
    OR len(list_filter(lw, lambda x: trim(x, '|<>«»›‹·•') = '')) >= greatest({quality.BARS}, len(lw) / 4.0)
    OR 2 * len(list_filter(lw, lambda x: {" OR ".join(f"contains(x, '{x}')" for x in quality.LINK)})) > len(lw)
    OR stray
    OR {quality.SYMBOL_SHARE} * len(regexp_extract_all(line, '[#*$%&|<>]')) > list_sum(list_transform(lw, lambda x: length(x)))
  ) AS fails FROM runs
), by_line AS (
  SELECT r, count(*) AS n_lines, count_if(fails) AS n_lines_removed, count_if(len(lw) > 0) - count(DISTINCT line) FILTER (len(lw) > 0) AS n_dup_lines,
    coalesce(sum(length(line)) FILTER (NOT fails), 0) + greatest(count_if(NOT fails) - 1, 0) AS chars_left, coalesce(sum(len(lw)) FILTER (NOT fails), 0) AS words_left
  FROM judged GROUP BY r
), base AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_repeat_words, 0) AS rep, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed FROM docs LEFT JOIN repeats USING (r) JOIN by_line USING (r)
)
SELECT doc_id, n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT 2 * chars_left < length(t) AND NOT (n_lines_removed > 0 AND words_left < {quality.LEAST_WORDS}) AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines_removed AS BIGINT) AS n_lines_removed
FROM base
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _cheapest(*values: str) -> str:
    return f"list_sort(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, cost: str, audit: str, turn: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{audit}', 't': {state}.t || {turn}}} END"


def _keep(state: str, initial: str, role: str) -> str:
    """A row that stays with this initial, kept or reassigned."""
    kept = _edit(state, "extra", "K", "chr(10) || role || ':' || text")
    moved = _edit(state, "1 + extra", "R", f"'\n{role}:' || text") if role else "NULL"
    return f"CASE WHEN must THEN NULL WHEN initial = '{initial}' THEN {kept} ELSE {moved} END"


REPAIR = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations
), damaged AS (
  SELECT conv_id, turn, r0, t0, copy, CASE WHEN f = 4 THEN 'user' ELSE r0 END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text
  FROM (SELECT *, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE f <> 0)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS i, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged
), seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), turns AS (
  SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, blank OR again AS must FROM seen
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate, count_if(cut) AS truncated,
    count_if(i > 1 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
), way AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM figures
  UNION ALL
  SELECT conv_id, i, {_edit('s0', '2', 'D')}, {_cheapest(_edit('s1', '2', 'D'), _keep('s0', 's', ''))},
    {_cheapest(_edit('u', '2', 'D'), _keep('s0', 'u', 'user'), _keep('s1', 'u', 'user'), _keep('a', 'u', 'user'))}, {_cheapest(_edit('a', '2', 'D'), _keep('u', 'a', 'assistant'))}
  FROM (
    SELECT *, {_cheapest('s3', _edit('u', '5', 'I', "chr(10) || 'assistant:'"))} AS a
    FROM (SELECT w.conv_id, t.i, s0, s1, s3, {_cheapest('s2', *[_edit(s, '5', 'I', "chr(10) || 'user:'") for s in ('s0', 's1', 's3')])} AS u, role, text, initial, must, CASE WHEN cut THEN 5 ELSE 0 END AS extra
      FROM way w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1)
  )
), ended AS (
  SELECT conv_id, {_cheapest('s0', 's3', _edit('u', '5', 'I', "chr(10) || 'assistant:'"))} AS x
  FROM (SELECT *, {_cheapest('s2', *[_edit(s, '5', 'I', "chr(10) || 'user:'") for s in ('s0', 's1', 's3')])} AS u FROM way)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _leaf(text: str) -> str:
    columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in columns) + ")"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, leaf, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AND text IS NOT NULL THEN {_leaf(_LOW)} END AS changed FROM documents)
), nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 16, n
), sources AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, i, n, h FROM sources
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16, n
), siblings AS (
  SELECT r, 0 AS tree, x.level, coalesce(string_agg(h, '' ORDER BY x.i) FILTER (x.i < l.i >> 4 * x.level), '') AS b, coalesce(string_agg(h, '' ORDER BY x.i) FILTER (x.i > l.i >> 4 * x.level), '') AS a
  FROM leaves l JOIN nodes x ON l.source IS NOT DISTINCT FROM x.source AND x.n > 1 AND x.i >> 4 = l.i >> 4 * (x.level + 1) GROUP BY r, x.level
  UNION ALL
  SELECT r, 1, x.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < s.i >> 4 * x.level), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > s.i >> 4 * x.level), '')
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source JOIN top x ON x.n > 1 AND x.i >> 4 = s.i >> 4 * (x.level + 1) GROUP BY r, x.level
), paths AS (
  SELECT r, list({{'b': b, 'a': a}} ORDER BY tree, level) AS steps, string_agg(b || a, '' ORDER BY tree, level) AS proof FROM siblings GROUP BY r
)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend({{'b': coalesce(changed, leaf), 'a': ''}}, coalesce(steps, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root, folded_root = t.h AS verified
FROM leaves LEFT JOIN paths USING (r) JOIN sources s ON leaves.source IS NOT DISTINCT FROM s.source JOIN top t ON t.n = 1
"""
