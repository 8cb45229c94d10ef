"""DuckDB statements, written apart from the Spark code, for the queries that SQL can express.

Not stated: the mix (its permutations are drawn by hash), language identification and toxicity (learnt models), and
the pipeline (it ends in the mix).
"""

SQL: dict[str, str] = {}


def lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACE_WORD = r"'[^\x20\x09-\x0D]+'"

SQL["op1_benchmark_decontamination"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower('text')}, {ITEM_WORD}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM items, unnest(range(greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower('text')}, {ITEM_WORD}) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM docs, sizes, unnest(range(len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
met AS (SELECT r, i, n, item FROM runs JOIN win USING (win, n)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM met, unnest(range(n)) AS t(k) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""

HOST = lower(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

SQL["op2_warc_index_merge"] = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, {HOST} AS host, {PATH} AS path FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body),
k AS (SELECT *, regexp_replace(CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(path)
  || lower(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1)) ELSE lower(url) END, '[\x00-\x20]', '%20', 'g') AS url_key FROM p LEFT JOIN f USING (body))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture
FROM k"""

SQL["op4_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower('text')}, {SPACE_WORD}) AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM d, unnest(range(greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN least_id USING (doc_id) LEFT JOIN n USING (doc_id)"""

# Rate: part, whole, bucket width, smallest spread; all in thousandths.
RATES = {
    "symbols": ("n_symbols", "word_chars", 1, 20),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 170),
    "repeats": ("n_repeat_words", "n_words", 1, 150),
    "capitals": ("n_capitals", "word_chars", 1, 60),
    "word_length": ("word_chars", "n_words", 100, 1500),
}
_RATE = ", ".join(f"least(coalesce(1000 * {part} // nullif({whole}, 0), 0), 100000) AS {name}" for name, (part, whole, _, _) in RATES.items())
_PAIRS = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} // {b} AS bucket, {b} AS width, {slack} AS slack FROM good" for r, (_, _, b, slack) in RATES.items())


def _fence(level: str, keys: str) -> str:
    by = f"{keys}{', ' if keys else ''}rate"
    return f"""{level}_q AS (SELECT {by}, width, slack, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM pairs GROUP BY {by}, width, slack),
{level} AS (SELECT {keys + ',' if keys else ''} max(n) AS n, map(list(rate), list((q3 + 1) * width + 3 * greatest((q3 - q1) * width, slack))) AS f FROM {level}_q {'GROUP BY ' + keys if keys else ''})"""


SQL["op5_quality_rules"] = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {SPACE_WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {SPACE_WORD})) AS lines FROM t),
each AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
threes AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS three FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS times FROM threes WHERE three IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM grams, unnest(range(3)) AS u(k) WHERE times > 1 GROUP BY r),
base AS (SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN repeated USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_RATE} FROM base),
good AS (SELECT * FROM m WHERE NOT base_failed), pairs AS ({_PAIRS}),
{_fence('grp', 'lang, source')}, {_fence('lng', 'lang')}, {_fence('corpus', '')}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f"{r} > coalesce(grp.f['{r}'], lng.f['{r}'], corpus.f['{r}'])" for r in RATES)}) AS kept
FROM m LEFT JOIN grp ON grp.n >= 200 AND m.lang IS NOT DISTINCT FROM grp.lang AND m.source IS NOT DISTINCT FROM grp.source
LEFT JOIN lng ON lng.n >= 200 AND m.lang IS NOT DISTINCT FROM lng.lang LEFT JOIN corpus ON true"""


def _level(name: str, nodes: str, key: str, parent: str, above: str) -> str:
    """Beta posterior of every node of a level around its parent's mean."""
    return f"""{name}_s AS (SELECT sum(k) / sum(n) AS p, CAST(sum(n) AS DOUBLE) AS big, count(*) AS m, sum(CAST(n AS DOUBLE) * n) AS sq, sum(CAST(k AS DOUBLE) * k / n) AS kk FROM {nodes} WHERE n > 0),
{name}_b AS (SELECT m, p * (1 - p) AS inside, (kk - big * p * p - p * (1 - p) * (m - 1)) / nullif(big - sq / nullif(big, 0), 0) AS apart FROM {name}_s),
{name}_p AS (SELECT CASE WHEN m > 1 AND apart > 0 AND inside > 0 THEN least(greatest(inside / apart - 1, 1.0), 10000.0) ELSE 10000.0 END AS pull FROM {name}_b),
{name} AS (SELECT {key}, mean * pull + k AS a, (1 - mean) * pull + n - k AS b, (mean * pull + k) / (pull + n) AS mean
  FROM {nodes} JOIN (SELECT {above}.{parent}, {above}.mean FROM {above}) USING ({parent}), {name}_p)"""


SQL["op6_url_reputation"] = f"""
WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
  string_split(host, '.')[-1] AS suffix, 0 AS top FROM p LEFT JOIN o USING (page_id) GROUP BY host),
dn AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2), sn AS (SELECT suffix, 0 AS top, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
c AS (SELECT 0 AS top, (sum(k) + 1) / (sum(n) + 2) AS mean FROM h),
{_level('sp', 'sn', 'suffix', 'top', 'c')}, {_level('dp', 'dn', 'domain', 'suffix', 'sp')}, {_level('hp', 'h', 'host', 'domain', 'dp')},
low AS (SELECT host, a / (a + b) - 1.6448536269514722 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM hp),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN low USING (host)"""

# Kind: pattern, group of the value, least characters of it.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
    "prefixed": (r"\b(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    "opaque": ("[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
}


def _spans(order: int, name: str) -> str:
    pattern, group, least = KINDS[name]
    return f"""SELECT r, doc_id, source, {order} AS kind, '{name}' AS name, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) AS start,
  length(hits[i]) AS size, vals[i] AS value FROM (SELECT r, doc_id, source, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d),
  unnest(range(1, len(hits) + 1)) AS u(i) WHERE length(vals[i]) >= {least}"""


SQL["op9_secret_scan"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
every AS MATERIALIZED (SELECT r, doc_id, coalesce(source, chr(1)) AS source, kind, name, CAST(start AS BIGINT) AS s, CAST(start + size AS BIGINT) AS e, value FROM ({' UNION ALL '.join(_spans(i, k) for i, k in enumerate(KINDS))})
  WHERE name <> 'opaque' OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]'))),
held AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) <= 2 AS live FROM every GROUP BY value),
j AS MATERIALIZED (SELECT *, name || ':' || s || ':' || e AS said FROM every JOIN held USING (value)),
shown AS (SELECT * FROM j WHERE kind < 3 UNION ALL SELECT * FROM j WHERE kind >= 3 AND live AND NOT EXISTS (SELECT 1 FROM j b WHERE b.r = j.r AND b.kind < 3 AND b.s < j.e AND j.s < b.e)),
per AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(said, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
  string_agg(said, ',' ORDER BY s, kind, e) AS spans, count(*) FILTER (kind < 3 AND live) AS live, count(*) FILTER (kind < 3 AND NOT live) AS copied FROM shown GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied FROM d LEFT JOIN per USING (r)"""

SQL["op10_suffix_array_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower('text')}, {SPACE_WORD}) AS w FROM documents),
runs AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM d, unnest(range(len(w) - 49)) AS t(i) WHERE len(w) >= 50),
again AS (SELECT h FROM runs GROUP BY h HAVING count(DISTINCT r) > 1),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM runs JOIN again USING (h)),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
passages AS (SELECT r, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY r, k)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, CAST(sum(e - s) AS BIGINT) AS n_repeated, string_agg(s || ':' || e, ',' ORDER BY s) AS passages
FROM passages JOIN d USING (r) GROUP BY r, doc_id"""


def _edit(state: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'w': {state}.w || '{letter}', 't': {state}.t || {line}}} END"


def _least(*ways: str) -> str:
    """The cheapest way, of equal ones the ASCII-least edits; ways that do not exist are null."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT del AND k = '{initial}' THEN {_edit(state, 'tr', 'K', 'line')} END"


def _changed(state: str, role: str) -> str:
    body = "chr(10) || '" + role + ":' || text"
    return f"CASE WHEN NOT del THEN {_edit(state, '(3 + tr)', 'R', body)} END"


def _added(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"chr(10) || '{role}:'")


def _dropped(state: str) -> str:
    return _edit(state, "4", "D", "''")


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS t(i))),
known AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
faults AS (SELECT known.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fault FROM known, tab),
hurt AS (SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
marked AS (SELECT *, left(role, 1) AS k, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prior,
  CASE WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 3 END AS tr FROM placed),
r AS (SELECT *, blank OR again AS del, chr(10) || role || ':' || text AS line FROM marked),
stat AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (tr > 0 AND NOT del) AS truncated,
  count(*) FILTER (prior IS NOT NULL AND (prior || k) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
start AS (SELECT DISTINCT c FROM known),
walk AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'w': '', 't': ''}} AS q0, CAST(NULL AS STRUCT(c BIGINT, w VARCHAR, t VARCHAR)) AS q1,
    {{'c': CAST(3 AS BIGINT), 'w': 'I', 't': chr(10) || 'user:'}} AS q2,
    {{'c': CAST(6 AS BIGINT), 'w': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS q3 FROM start
  UNION ALL
  SELECT c, i, q0, q1, p2 AS q2, {_least('p3', _added('p2', 'assistant'))} AS q3 FROM (
    SELECT c, i, p0 AS q0, p1 AS q1, {_least('p2', _added('p0', 'user'), _added('p1', 'user'), _added('p3', 'user'))} AS p2, p3 FROM (
      SELECT c, r.i AS i, {_dropped('q0')} AS p0, {_least(_dropped('q1'), _kept('q0', 's'))} AS p1,
        {_least(_dropped('q2'), *[_kept(q, 'u') for q in ('q0', 'q1', 'q3')], *[_changed(q, 'user') for q in ('q0', 'q1', 'q3')])} AS p2,
        {_least(_dropped('q3'), _kept('q2', 'a'), _changed('q2', 'assistant'))} AS p3
      FROM walk JOIN r USING (c) WHERE r.i = walk.i + 1))),
last AS (SELECT c, {_least('q0', 'q3')} AS best, i FROM walk),
ids AS (SELECT DISTINCT c, conv_id FROM known)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.w AS audit,
  sha256(substr(best.t, 2)) AS repaired_sha256, CAST(coalesce(n, 0) AS BIGINT) AS n_rows
FROM ids JOIN last USING (c) LEFT JOIN stat USING (c) WHERE last.i = coalesce(n, 0)"""
