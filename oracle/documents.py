"""Statements for the document, transcript and intake-merge queries."""

from oracle import frag as f

V = f.with_views
SQL: dict[str, str] = {}

SQL["line_class"] = f"""{V('quote_lines')} SELECT doc_id, line_no, CASE line_no WHEN 90 THEN 'skip' WHEN 91 THEN 'charge' WHEN 92 THEN 'product' ELSE 'product' END AS kind, count(*) AS lines FROM quote_lines GROUP BY 1, 2, 3"""
Q = f"""{V('quote_lines')}, q AS (SELECT *, regexp_extract(text, '^\\d+\\. Wolf (.*) Model: ', 1) AS nm, regexp_extract(text, 'Model: (\\S+)', 1) AS md, regexp_extract(text, 'Qty (\\d+)', 1) AS qt,
 regexp_extract(text, '(\\$[\\d,]+(?:\\.\\d{{2}})?)', 1) AS pr FROM quote_lines WHERE line_no <> 90)"""
ROWS = """SELECT doc_id, line_no, CASE WHEN line_no < 90 THEN 'Wolf ' || nm WHEN line_no = 91 THEN 'Unresolved Charge - Row 7' ELSE 'Supplier: Example Dealer' END AS product_name,
 CASE WHEN line_no < 90 THEN 'Wolf' ELSE '' END AS brand, CASE WHEN line_no < 90 THEN md ELSE '' END AS model_sku, CAST(CASE WHEN line_no < 90 THEN CAST(qt AS INT) ELSE 1 END AS INT) AS quantity,
 CASE WHEN line_no = 92 THEN '' ELSE pr END AS price, CASE WHEN line_no < 90 THEN 'Kitchen' ELSE '' END AS room, CASE WHEN line_no < 90 THEN 'Appliances' ELSE '' END AS category,
 CASE WHEN line_no < 90 THEN '[Model: ' || md || ']' WHEN line_no = 91 THEN '[Unresolved charge: ' || text || ']' ELSE '' END AS notes, line_no <> 91 AS include,
 CASE WHEN line_no = 91 THEN 'unresolved_charge' ELSE '' END AS import_type FROM q"""
SQL["lines_to_rows"] = f"{Q} SELECT *, count(*) AS copies FROM ({ROWS}) t GROUP BY ALL"
SQL["doc_context"] = f"""{V('quote_lines')} SELECT doc_id, '' AS doc_project, CASE WHEN bool_or(line_no = 92) THEN 'Example Dealer' ELSE '' END AS doc_supplier, '' AS doc_category FROM quote_lines GROUP BY 1"""
SQL["room_annotation"] = f"""{V('quote_lines')} SELECT DISTINCT doc_id, line_no, text, CASE WHEN line_no < 90 THEN 'Kitchen' WHEN line_no = 3 THEN 'Powder Room' ELSE '' END AS room,
 CASE WHEN line_no < 90 THEN regexp_replace(text, ' Kitchen$', '') ELSE text END AS rest FROM quote_lines"""
SQL["parsed_documents"] = f"""{Q}, r AS ({ROWS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(product_name), lower(model_sku) ORDER BY line_no, price, quantity) AS rn FROM r)
 SELECT k.doc_id, line_no, product_name, model_sku, CASE WHEN o_orderkey IS NULL THEN '' ELSE 'Example Dealer' END AS supplier,
 CASE WHEN line_no = 91 THEN 'Manual Review' WHEN line_no < 90 THEN 'Needs Enrichment' ELSE 'Needs Review' END AS status, quantity, price FROM k LEFT JOIN orders ON o_orderkey = k.doc_id WHERE rn = 1"""
ROW_NO = "CAST(l_linenumber * 10000019 + (l_partkey * 10007 + l_suppkey * 101 + CAST(floor(l_quantity) AS BIGINT)) % 10000019 AS INT)"
LI = """li AS (SELECT l.*, p_name, p_type || p_partkey AS md, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem l JOIN part ON p_partkey = l_partkey), o AS (SELECT o_orderkey FROM orders)"""
CELLS = f"""WITH {LI}, c AS (SELECT l_orderkey AS doc_id, {ROW_NO} AS row_no, CASE WHEN l_orderkey % 3 < 2 AND o_orderkey IS NOT NULL THEN p_name WHEN l_orderkey % 3 = 2 THEN 'Wolf ' || p_name ELSE NULL END AS product_name,
 CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Miele' ELSE 'Wolf' END AS brand, md AS model_sku, CAST(q AS INT) AS quantity, CASE l_orderkey % 3 WHEN 0 THEN '$10.00' WHEN 1 THEN '$11.00' ELSE '' END AS price,
 CASE l_orderkey % 3 WHEN 0 THEN 'Brass' ELSE '' END AS finish_color FROM li LEFT JOIN o ON o_orderkey = l_orderkey)"""
SQL["cells_to_rows"] = f"""{CELLS} SELECT * FROM c UNION ALL SELECT o_orderkey, 0, 'ok | ok', '', '', 1, '', '' FROM orders WHERE o_orderkey % 3 = 2"""
SQL["header_forward_fill"] = f"""{V('quote_cells')} SELECT doc_id, row_no, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM (
 SELECT doc_id, row_no, CASE WHEN row_no = 0 OR row_no % 7 = 3 THEN concat('h', row_no) END AS own FROM quote_cells) t"""
SQL["first_seen_per_doc"] = f"""{Q}, {CELLS[5:]}, r AS ({ROWS}), t AS (SELECT doc_id, product_name, model_sku, row_no FROM c UNION ALL SELECT o_orderkey, 'ok | ok', '', 0 FROM orders WHERE o_orderkey % 3 = 2
 UNION ALL SELECT doc_id, product_name, model_sku, line_no FROM r WHERE doc_id % 3 < 2 AND doc_id NOT IN (SELECT doc_id FROM c))
 SELECT doc_id, arg_min(product_name, row_no) AS product_name, arg_min(model_sku, row_no) AS model_sku, CAST(min(row_no) AS INT) AS row_no FROM t GROUP BY doc_id, lower(product_name), lower(model_sku)"""
SIDES = f"""{V('intake_wide')}, p AS (SELECT row_id // 100000190 AS doc_id, row_id, {f.token('model_sku')} AS mk, product_name, quantity, notes FROM intake_wide WHERE model_sku <> ''),
 p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mk ORDER BY row_id) AS nth FROM p),
 m2 AS (SELECT doc_id, row_id, mk, CASE WHEN row_id % 2 = 0 THEN trim(product_name || ' deluxe') ELSE '' END AS product_name, quantity % 3 AS quantity, row_number() OVER (PARTITION BY doc_id, mk ORDER BY row_id) AS nth FROM p WHERE row_id % 3 > 0)"""
SQL["merge_parser_ai"] = f"""{SIDES} SELECT p2.doc_id, p2.mk AS model_key, CAST(p2.nth AS INT) AS nth, p2.row_id AS p_position, m2.row_id AS m_position, CASE WHEN coalesce(m2.product_name, '') <> '' THEN m2.product_name ELSE p2.product_name END AS product_name,
 CAST(CASE WHEN p2.quantity > 1 AND coalesce(m2.quantity, 0) <= 1 THEN p2.quantity WHEN coalesce(m2.quantity, 0) > 0 THEN m2.quantity WHEN p2.quantity > 0 THEN p2.quantity ELSE 1 END AS INT) AS quantity,
 CASE WHEN m2.doc_id IS NULL THEN p2.notes ELSE concat_ws(' ', nullif(p2.notes, ''), 'seen by model') END AS notes FROM p2 LEFT JOIN m2 ON p2.doc_id = m2.doc_id AND p2.mk = m2.mk AND p2.nth = m2.nth"""
# The pairing row by row: which model rows of the document are used, and the choice of every parser row.
PAIRS = f"""WITH RECURSIVE {V('intake_wide')[5:]}, pr AS (SELECT row_id // 100000190 AS doc_id, row_id, {f.token('model_sku')} AS m, {f.token('product_name')} AS n FROM intake_wide),
 p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_id) AS i FROM pr),
 md AS (SELECT doc_id, list({{'id': row_id, 'm': m, 'n': CASE WHEN row_id % 2 = 0 THEN n || 'deluxe' ELSE '' END}} ORDER BY row_id) AS ms FROM p WHERE row_id % 3 > 0 GROUP BY 1),
 st AS (SELECT DISTINCT p.doc_id, coalesce(ms, []) AS ms FROM p LEFT JOIN md USING (doc_id)),
 w AS (SELECT doc_id, ms, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS p_position FROM st UNION ALL
  SELECT doc_id, ms, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick, row_id FROM (
   SELECT w.doc_id, ms, p.i, used, row_id, coalesce(list_filter(range(1, len(ms) + 1), lambda k: NOT list_contains(used, k) AND p.m <> '' AND ms[k].m = p.m)[1],
     CASE WHEN p.i <= len(ms) AND NOT list_contains(used, p.i) THEN p.i END,
     list_filter(range(1, len(ms) + 1), lambda k: NOT list_contains(used, k) AND p.n <> '' AND ms[k].n <> '' AND (contains(ms[k].n, p.n) OR contains(p.n, ms[k].n)))[1]) AS pick
   FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1) t),
 pairs AS (SELECT doc_id, p_position, ms[pick].id AS m_position FROM w WHERE i > 0
  UNION ALL SELECT doc_id, NULL, x.id FROM (SELECT doc_id, unnest(list_filter(ms, lambda x, k: NOT list_contains(used, k))) AS x FROM (SELECT doc_id, arg_max(ms, i) AS ms, arg_max(used, i) AS used FROM w GROUP BY doc_id) t) u)"""
SQL["merge_parser_ai_pairs"] = f"{PAIRS} SELECT doc_id, p_position, m_position FROM pairs"
_BLANKS = {"product_name": ("Product Name", 20), "brand": ("Brand", 15), "model_sku": ("Model/SKU", 20), "dimensions": ("Dimensions", 10), "supplier": ("Supplier", 10),
           "category": ("Product Category", 10)}


def _gone(side: str) -> str:
    parts = [(f"{side}.{c} = ''", f"'{label}'") for c, (label, _) in _BLANKS.items()] + [(f"{side}.quantity < 1", "'Quantity'")]
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {test} THEN {label} END" for test, label in parts) + ")"


SQL["merge_parser_ai_rows"] = f"""{PAIRS}, m AS (SELECT * REPLACE (CASE WHEN row_id % 2 = 0 THEN trim(product_name || ' deluxe') ELSE '' END AS product_name, quantity % 3 AS quantity, 'seen by model' AS notes) FROM intake_wide),
 j AS (SELECT doc_id, p_position, m_position, a, b, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE {{{', '.join(f"'{c}': CASE WHEN b.{c} <> '' THEN b.{c} ELSE a.{c} END" for c in ('product_name', 'brand', 'model_sku', 'dimensions', 'supplier', 'category', 'room'))},
   'quantity': CASE WHEN a.quantity > 1 AND b.quantity <= 1 THEN a.quantity WHEN b.quantity > 0 THEN b.quantity WHEN a.quantity > 0 THEN a.quantity ELSE 1 END,
   'notes': CASE WHEN a.notes <> '' THEN a.notes || ' ' || b.notes ELSE b.notes END, 'source_type': 'PDF_AI', 'status': a.status, 'include': a.include}} END AS c
  FROM (SELECT doc_id, p_position, m_position, CASE WHEN p.row_id IS NOT NULL THEN {{COLS:p}} END AS a, CASE WHEN m.row_id IS NOT NULL THEN {{COLS:m}} END AS b
   FROM pairs LEFT JOIN intake_wide p ON p.row_id = p_position LEFT JOIN m ON m.row_id = m_position) t),
 k AS (SELECT *, 100 - {' - '.join(f"CASE WHEN c.{c} = '' THEN {w} ELSE 0 END" for c, (_, w) in _BLANKS.items())} - CASE WHEN c.quantity < 1 THEN 10 ELSE 0 END AS score FROM j)
 SELECT doc_id, p_position, m_position, c.product_name, c.brand, c.model_sku, c.dimensions, c.category, c.room, c.quantity, c.notes, c.source_type,
  CASE WHEN a IS NULL OR b IS NULL THEN c.status WHEN score >= 75 THEN 'Ready for Review' WHEN c.status = '' THEN 'Needs Review' ELSE c.status END AS status, c.include, CAST(score AS INT) AS parse_confidence,
  b IS NOT NULL AS ai_used, CASE WHEN b IS NULL THEN 'AI returned no matching row' ELSE '' END AS ai_skipped_reason,
  CASE WHEN a IS NOT NULL THEN {_gone('a')} ELSE {_gone('b')} END AS missing_critical_fields_before_ai, {_gone('c')} AS missing_critical_fields_after_ai,
  {', '.join(f"coalesce(trim(a.{c}), '') AS deterministic_{c}, coalesce(trim(b.{c}), '') AS ai_{c}, trim(c.{c}) AS final_{c}" for c in ('product_name', 'supplier', 'model_sku', 'dimensions'))} FROM k"""
for _s in "pm":
    _all = ("product_name", "brand", "model_sku", "dimensions", "supplier", "category", "room", "quantity", "notes", "source_type", "status", "include")
    SQL["merge_parser_ai_rows"] = SQL["merge_parser_ai_rows"].replace(f"{{COLS:{_s}}}", "{" + ", ".join(f"'{c}': {_s}.{c}" for c in _all) + "}")
SQL["choose_final_value"] = f"""{V('intake_wide')} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'Model text' ELSE product_name END AS product_name,
 CASE WHEN quantity > 1 AND row_id % 4 <= 1 THEN quantity WHEN row_id % 4 > 0 THEN row_id % 4 WHEN quantity > 0 THEN quantity ELSE 1 END AS quantity,
 CASE WHEN row_id % 2 = 1 THEN notes ELSE concat_ws(' ', nullif(notes, ''), 'Model text') END AS notes FROM intake_wide"""
SQL["result_answers"] = f"""{V('intake')}, a AS (SELECT row_id AS doc_id, row_id % 5 AS k, image_url AS im, CAST(quantity AS VARCHAR) AS w FROM intake)
 SELECT doc_id, CAST(p AS INT) AS position, CASE k WHEN 2 THEN 'json_repaired' WHEN 3 THEN 'partial_recovery' WHEN 4 THEN 'no_rows' ELSE 'strict_json' END AS parse_status,
 CASE WHEN k < 3 THEN CAST(doc_id AS VARCHAR) END AS result_row_id, CASE WHEN k < 2 THEN 'true' WHEN k = 3 THEN 'false' END AS result_safe_to_write, CASE WHEN k < 3 THEN im WHEN k = 3 THEN nullif(im, '') END AS result_image_url,
 CASE WHEN k < 4 THEN w END AS result_width_in, CASE WHEN k = 3 THEN 'OpenAI JSON response could not be parsed safely.' END AS result_reason FROM a, unnest(range(CASE WHEN k = 0 THEN 2 ELSE 1 END)) AS u(p)"""
ITEMS = f"""{V('intake')}, a AS (SELECT * FROM intake WHERE row_id % 4 <> 2)"""
SQL["json_array_from_text"] = f"""{ITEMS} SELECT row_id AS doc_id, CAST(0 AS INT) AS position, product_name, CAST(row_id % 4 AS VARCHAR) AS quantity, room FROM a UNION ALL SELECT row_id, 1, concat('second ', row_id), NULL, NULL FROM a"""
SQL["ai_item_to_row"] = f"""{ITEMS}, b AS (SELECT *, least(100, row_id % 130) AS sc FROM a),
 c AS (SELECT *, CASE room WHEN '' THEN '' WHEN 'kitchen' THEN 'Kitchen' WHEN 'bar' THEN 'Bar' WHEN 'pantry - TBD' THEN 'Pantry' ELSE 'Laundry Room Floor 2' END AS rm, room = '' OR contains(room, '-') AS unsure FROM b),
 d AS (SELECT *, CASE WHEN unsure THEN greatest(0, sc - 15) ELSE sc END AS fs FROM c)
 SELECT row_id AS doc_id, CAST(0 AS INT) AS position, product_name, 'Seating' AS category, CAST(greatest(1, row_id % 4) AS INT) AS quantity, rm AS room, CASE WHEN unsure AND room <> '' THEN '[Location note: ' || room || ']' ELSE '' END AS notes,
 CAST(fs AS INT) AS confidence_score, true AS review_required, CASE WHEN fs >= 75 THEN 'Ready for Review' ELSE 'Needs Review' END AS status FROM d
 UNION ALL SELECT row_id, 1, concat('second ', row_id), '', 1, '', '', 35, false, 'Needs Review' FROM a"""
SQL["transcript_assembly"] = f"""{V('transcripts')} SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, CAST(count(*) AS INT) AS turns FROM transcripts GROUP BY 1"""
_SIZES = """SELECT p_partkey AS conv_id, p_partkey % 3 = 1 AND p_size <> 99 AS clash, p_partkey % 6 <> 5 AS whole,
 CASE p_partkey % 6 WHEN 2 THEN '36' WHEN 5 THEN '42' ELSE CAST(p_size AS VARCHAR) END AS w FROM part"""
SQL["transcript_dimensions"] = f"""SELECT conv_id, CASE WHEN clash THEN 'conflict' WHEN whole THEN 'complete' ELSE 'partial' END AS dimension_status,
 CASE WHEN clash THEN '' ELSE w END AS width, CASE WHEN clash OR NOT whole THEN '' ELSE '24' END AS depth, CASE WHEN clash OR NOT whole THEN '' ELSE '84' END AS height,
 CASE WHEN clash OR NOT whole THEN '' ELSE concat(w, ' in W x 24 in D x 84 in H') END AS dimensions FROM ({_SIZES})"""
SQL["transcript_specs"] = f"""SELECT conv_id, 'Dimensions' AS field, CASE WHEN whole AND NOT clash THEN concat(w, ' in W x 24 in D x 84 in H') ELSE '' END AS value, CASE WHEN whole AND NOT clash THEN 'high' ELSE 'unresolved' END AS confidence FROM ({_SIZES})
 UNION ALL SELECT conv_id, 'Width', CASE WHEN clash THEN '' ELSE concat(w, ' in') END, CASE WHEN clash THEN 'unresolved' WHEN whole THEN 'high' ELSE 'medium' END FROM ({_SIZES})
 UNION ALL SELECT p_partkey, 'Finish / Color', CASE WHEN p_partkey % 3 <> 2 THEN 'brass' ELSE '' END, CASE WHEN p_partkey % 3 <> 2 THEN 'medium' ELSE 'unresolved' END FROM part
 UNION ALL SELECT p_partkey, 'Price', '', 'unresolved' FROM part"""
for _name, _always in (("apply_transcript", False), ("apply_transcript_overwrite", True)):
    SQL[_name] = f"""{f.X}, j AS (SELECT x.*, c.conv_id, c.clash, c.whole, c.w FROM x LEFT JOIN ({_SIZES}) c ON c.conv_id = TRY_CAST(regexp_extract(model_sku, '([0-9]+)$', 1) AS BIGINT)),
 k AS (SELECT *, coalesce(whole AND NOT clash, false) AND (NOT complete OR {_always}) AS a, coalesce(conv_id % 3 <> 2, false) AND (finish_color = '' OR {_always}) AS b FROM j)
 SELECT row_id, CASE WHEN a THEN concat(w, ' in W x 24 in D x 84 in H') ELSE dimensions END AS dimensions, CASE WHEN b THEN 'brass' ELSE finish_color END AS finish_color,
 {f.listing([('a', "'dimensions'"), ('b', "'finish_color'")])} AS applied, CASE WHEN a OR b THEN concat_ws(chr(10), nullif(notes, ''), 'Filled from call transcript',
  CASE WHEN b THEN 'Finish / Color evidence: Width ' || w || ', Height is 84, Depth 24.' END) ELSE notes END AS notes FROM k"""
ACTIVE = "include AND " + f"{f.token('brand')} <> '' AND {f.token('model_sku')} <> ''"
SQL["intake_dedupe_rooms"] = f"""{f.X} SELECT DISTINCT {f.token('brand')} || '_' || {f.token('model_sku')} AS product_key, {f.spaced('room')} AS room FROM x WHERE {ACTIVE} AND room <> ''"""
SQL["intake_dedupe_aside"] = f"""{f.X} SELECT row_id, {f.token('brand')} AS brand, quantity FROM x WHERE NOT ({ACTIVE})"""
# The intake merge row by row: a list of merged rows per key, which every row extends or changes.
_WEIGHTS = {"brand": 20, "model_sku": 20, "product_name": 18, "room": 14, "dimensions": 12, "supplier": 10, "image_url": 10, "product_url": 9,
            "finish_color": 6, "material": 6, "category": 6, "price": 3}
_KEPT = [*_WEIGHTS, "notes", "source_type", "project", "import_type", "color", "status", "dimension_source_url", "include", "quantity",
         "confidence_score", "review_required"]
_TYPES = {"include": "BOOLEAN", "quantity": "BIGINT", "confidence_score": "INT", "review_required": "BOOLEAN"}


def _points(v: str) -> str:
    filled = " + ".join(f"CASE WHEN {v}[{_KEPT.index(c) + 1}] <> '' THEN {w} ELSE 0 END" for c, w in _WEIGHTS.items())
    return f"({filled} - CASE WHEN {v}[{_KEPT.index('import_type') + 1}] = 'unresolved_charge' THEN 100 ELSE 0 END)"


def _side(part: str, lead: str, other: str) -> str:
    """A key of the merged row: the leader's if it has the column at all."""
    column = _KEPT.index({"rk": "room", "nk": "product_name"}[part]) + 1
    return f"CASE WHEN {lead}.v[{column}] = '' THEN {other}.{part} ELSE {lead}.{part} END"


def _led(lead: str, other: str) -> str:
    fill = f"list_transform(range(1, {len(_KEPT) + 1}), lambda k: CASE WHEN {lead}.v[k] = '' THEN {other}.v[k] ELSE {lead}.v[k] END)"
    return f"{{'id': g.id, 'rk': {_side('rk', lead, other)}, 'nk': {_side('nk', lead, other)}, 'v': {fill}}}"


_FITS = """NOT (g.rk <> '' AND n.rk <> '' AND g.rk <> n.rk) AND ((g.nk <> '' AND n.nk <> '' AND (contains(g.nk, n.nk) OR contains(n.nk, g.nk)))
  OR g.rk = '' OR n.rk = '' OR g.nk = '' OR n.nk = '')"""
SQL["intake_dedupe"] = f"""WITH RECURSIVE {f.X[5:]}, a AS (SELECT {f.token('brand')} || '_' || {f.token('model_sku')} AS key, import_type = 'unresolved_charge' AS fresh,
  {{'id': row_id, 'rk': {f.spaced('room')}, 'nk': array_to_string(string_split({f.spaced('product_name')}, ' ')[1:8], ' '),
   'v': [{', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _KEPT)}]}} AS n,
  row_number() OVER (PARTITION BY {f.token('brand')} || '_' || {f.token('model_sku')} ORDER BY row_id) AS i FROM x WHERE {ACTIVE}),
 w AS (SELECT key, i, [n] AS gs FROM a WHERE i = 1 UNION ALL
  SELECT key, i, CASE WHEN pos = 0 THEN list_append(gs, n) ELSE list_concat(gs[1 : pos - 1], [CASE WHEN {_points('n.v')} > {_points('g.v')} THEN {_led('n', 'g')} ELSE {_led('g', 'n')} END], gs[pos + 1 :]) END AS gs
  FROM (SELECT *, gs[pos] AS g FROM (SELECT a.key, a.i, gs, n, CASE WHEN fresh THEN 0 ELSE coalesce(list_position(list_transform(gs, lambda g: {_FITS}), true), 0) END AS pos
   FROM w JOIN a ON a.key = w.key AND a.i = w.i + 1) t) u),
 last AS (SELECT unnest(arg_max(gs, i)) AS g FROM w GROUP BY key)
 SELECT g.id AS row_id, {', '.join(f"CAST(g.v[{k + 1}] AS {_TYPES[c]}) AS {c}" if c in _TYPES else f"g.v[{k + 1}] AS {c}" for k, c in enumerate(_KEPT))}, true AS merged FROM last
 UNION ALL SELECT row_id, {', '.join(_KEPT)}, false FROM x WHERE NOT ({ACTIVE})"""
