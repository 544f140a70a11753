"""DuckDB SQL for the document queries, on the same tables."""

from __future__ import annotations

from paperloom.functions import rules as R
from paperloom.operators import chat
from paperloom.plans.rendered import DUCKDB

DOCS = f"docs AS ({DUCKDB})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {_quoted(w)})::INT" for w in words) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), '')"


_LAYOUT = f"""layout AS (
  SELECT doc_id, full_text, len(ls) AS total_lines, len(ne) AS non_empty_lines,
    coalesce(list_sum(list_transform(ne, lambda x: length(x))), 0) / greatest(len(ne), 1) AS avg_line_length,
    regexp_matches(full_text, '{R.CURRENCY}') AS has_currency,
    regexp_matches(full_text, '{R.DATE_ISO}') OR regexp_matches(full_text, '{R.DATE_DMY}') AS has_dates,
    regexp_matches(full_text, '{R.NUMBERED_LINE}') AS has_numbered_list, regexp_matches(full_text, '{R.BULLET_LINE}') AS has_bullet_list,
    regexp_matches(full_text, '{R.CAPITALS_LINE}') AS has_all_caps_headers,
    (length(full_text) - length(replace(full_text, ':', ''))) / greatest(len(ne), 1) AS colon_ratio
  FROM (SELECT *, list_filter(list_transform(ls, lambda x: {_strip('x')}), lambda x: x <> '') AS ne FROM (
    SELECT doc_id, full_text, CASE WHEN full_text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(full_text, '\\n$', ''), chr(10)) END AS ls FROM source))
)"""

_SCORES = "scores AS (\n" + "\n  UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{t}' AS document_type, CASE WHEN {_hits('lower(full_text)', must)} > 0 THEN (2 * {_hits('lower(full_text)', must)} + {_hits('lower(full_text)', may)}) / {2 * len(must) + len(may)}::DOUBLE ELSE 0 END AS score FROM docs"
    for i, (t, (must, may)) in enumerate(R.DOCUMENT_TYPES.items())
) + ")"

_TABLED = f"(t IN ({', '.join(map(_quoted, R.TRADE_TYPES))}))::INT * {R.TABLE_BOOST}"
_CLASSES = f"""source AS (SELECT doc_id, full_text FROM docs), {_LAYOUT}, {_SCORES}, best AS (
  SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_max(document_type, score - ord * 1e-9) ELSE 'UNKNOWN' END AS t, max(score) AS s FROM scores GROUP BY doc_id
), boosted AS (
  SELECT l.*, t, least(1.0, s + CASE WHEN t IN ('INVOICE', 'PURCHASE_ORDER', 'RECEIPT') AND has_currency THEN 0.15 ELSE 0 END
    + CASE WHEN t = 'CONTRACT' AND avg_line_length > 60 THEN 0.1 ELSE 0 END + CASE WHEN t = 'EMAIL' AND colon_ratio > 1.5 THEN 0.1 ELSE 0 END) AS s
  FROM layout l JOIN best USING (doc_id)
), by_layout AS (
  SELECT *, CASE WHEN s >= 0.4 THEN NULL WHEN colon_ratio > 1.5 AND has_dates THEN 'STRUCTURED_FORM' WHEN avg_line_length > 70 THEN 'NARRATIVE_DOCUMENT'
    WHEN has_numbered_list OR has_bullet_list THEN 'LIST_DOCUMENT' END AS h FROM boosted
), classes AS (
  SELECT doc_id, full_text, coalesce(h, CASE WHEN s < 0.4 THEN 'UNKNOWN' ELSE t END) AS document_type, CASE WHEN h IS NULL THEN s ELSE least(s, 0.39) END AS class_confidence FROM by_layout
)"""


def _pairs(shortest: int) -> str:
    key, value = _title(_strip("k")), _strip("v")
    return rf"""raw_pairs AS (
  SELECT doc_id, i, {key} AS key, {value} AS value FROM (
    SELECT doc_id, unnest(range(1, len(ks) + 1)) AS i, unnest(ks) AS k, unnest(vs) AS v FROM (
      SELECT doc_id, regexp_extract_all(full_text, '{R.KEY_VALUE}', 1) AS ks, regexp_extract_all(full_text, '{R.KEY_VALUE}', 2) AS vs FROM docs))
), pairs AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, key || CASE WHEN n > 1 THEN ' ' || n ELSE '' END AS key, value FROM (
    SELECT doc_id, i, key, value, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS n FROM raw_pairs WHERE length(key) >= {shortest} AND value <> '')
)"""


def _entity(kind: str, source: str) -> str:
    pattern, group, cap = R.ENTITIES[kind]
    return f"""(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS pos, value FROM (
  SELECT doc_id, value, min(i) AS first FROM (
    SELECT doc_id, {_strip('m')} AS value, i FROM (SELECT doc_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce({source.split()[1]}, ''), '{pattern}', {group}) AS ms FROM {source.split()[0]}))) WHERE value <> '' GROUP BY doc_id, value)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first) <= {cap})"""


def _field(labels, text="full_text") -> str:
    import re

    escaped = [re.sub(r"([^A-Za-z0-9 ])", r"\\\1", a) for a in labels]
    return "coalesce(" + ", ".join(f"nullif({_strip(f'''regexp_extract({text}, '(?i)(?:{a}){R.FIELD_VALUE}', 1)''')}, '')" for a in escaped) + ")"


_FIELDS = sorted({f for fields in R.TYPED_FIELDS.values() for f in fields} | set(R.ENRICHED_FIELDS))
_TYPED = "typed AS (\n" + "\n  UNION ALL ".join(f"SELECT doc_id, '{name}' AS field, {_field(fields[name])} AS value FROM classes WHERE document_type = '{t}'" for t, fields in R.TYPED_FIELDS.items() for name in fields) + ")"
_ENRICHED = """enriched AS (
  SELECT doc_id, field, coalesce(t.value, k.value) AS value FROM (SELECT doc_id, unnest([%s]) AS field FROM docs) f
  LEFT JOIN (SELECT * FROM typed WHERE value IS NOT NULL) t USING (doc_id, field)
  LEFT JOIN (SELECT p.doc_id, l.field, arg_min(nullif(p.value, ''), l.ord) AS value FROM pairs p JOIN (VALUES %s) l(field, label, ord) ON p.key = l.label WHERE p.value <> '' GROUP BY 1, 2) k USING (doc_id, field)
)""" % (", ".join(map(_quoted, _FIELDS)), ", ".join(f"({_quoted(f)}, {_quoted(a.title())}, {i})" for f, labels in R.ENRICHED_FIELDS.items() for i, a in enumerate(labels)))
_WITH_FIELDS = f"WITH {DOCS}, {_CLASSES}, {_pairs(3)}, {_TYPED}, {_ENRICHED}"

_NUMBER = "TRY_CAST(regexp_replace(%s, '[^0-9.]', '', 'g') AS DOUBLE)"
# A product label begins an item; what follows it up to the next label's line fills it.
_ITEMS = f"""text_lines AS (
  SELECT doc_id, i, {_strip('x')} AS x FROM (SELECT doc_id, unnest(string_split(full_text, chr(10))) AS x, unnest(range(1, len(string_split(full_text, chr(10))) + 1)) AS i FROM docs)
), labelled AS (
  SELECT doc_id, i, replace(replace(lower(regexp_extract(x, '(?i)(Product:|Quantity:|Unit\\s*Price:|Total:)', 1)), ' ', ''), ':', '') AS label, {_strip("regexp_extract(x, '(?i)(Product:|Quantity:|Unit\\s*Price:|Total:)(.*)$', 2)")} AS rest, x FROM text_lines WHERE x <> ''
), begun AS (
  SELECT *, sum((label = 'product')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM labelled
), numbered AS (
  SELECT *, max(CASE WHEN label = 'quantity' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item ORDER BY i) AS counted FROM begun WHERE item > 0
), line_items AS (
  SELECT doc_id, (item - 1)::INT AS pos, string_agg(CASE WHEN label = 'product' THEN rest WHEN label = '' AND counted = 0 THEN x END, ' ' ORDER BY i) AS product,
    arg_max({_NUMBER % 'rest'}, i) FILTER (WHERE label = 'quantity') AS quantity, arg_max({_NUMBER % 'rest'}, i) FILTER (WHERE label = 'unitprice') AS unit_price,
    arg_max({_NUMBER % 'rest'}, i) FILTER (WHERE label = 'total') AS line_total
  FROM numbered GROUP BY doc_id, item
)"""
_value = lambda f: f"max(value) FILTER (WHERE field = '{f}')"
_SCHEMA = f"""picked AS (
  SELECT doc_id, {_value('order_id')} AS order_id, {_value('customer_id')} AS customer_id, {_value('customer_name')} AS customer_name, {_value('date')} AS order_date, {_value('total_amount')} AS total FROM enriched GROUP BY doc_id
), sums AS (SELECT doc_id, sum(coalesce(line_total, 0)) AS calc, bool_and(line_total IS NOT NULL) AS every FROM line_items GROUP BY doc_id
), final AS (
  SELECT d.doc_id, order_id,
    coalesce(customer_id, nullif(regexp_extract(full_text, '(?i)Customer\\s+ID\\s*[:\\-]\\s*(\\S+)', 1), '')) AS customer_id,
    coalesce(customer_name, nullif({_strip("regexp_extract(full_text, '(?i)Customer\\s+Name\\s*[:\\-]\\s*([^\\n]+)', 1)")}, '')) AS customer_name,
    coalesce(order_date, nullif(regexp_extract(full_text, '(?i)Order\\s+Date\\s*[:\\-]\\s*(\\S+)', 1), '')) AS order_date,
    coalesce({_NUMBER % 'total'}, 0) AS ext_total, calc AS calc_total, every
  FROM docs d JOIN picked USING (doc_id) JOIN sums USING (doc_id)
)"""

_HIT = lambda text, words: _hits(f"lower({text})", words)
_TOTAL = f"first_total AS (SELECT doc_id, regexp_replace(value, '[^0-9.,]', '', 'g') AS amount FROM {_entity('totals', 'docs full_text')} WHERE pos = 0)"
_AMOUNT = "TRY_CAST(replace(amount, ',', '') AS DOUBLE)"
_RISK = f"""risks AS (
  SELECT doc_id, 'Risk:' || CASE WHEN {_HIT('full_text', R.HIGH_RISK)} >= 2 OR coalesce({_AMOUNT}, 0) >= 50000 THEN 'High' WHEN {_HIT('full_text', R.HIGH_RISK)} >= 1 OR {_HIT('full_text', R.MEDIUM_RISK)} >= 2 THEN 'Medium' ELSE 'Low' END AS risk
  FROM docs LEFT JOIN first_total USING (doc_id))"""
_BUCKET = f"buckets AS (SELECT doc_id, CASE WHEN {_AMOUNT} < 1000 THEN 'Amount:Under1K' WHEN {_AMOUNT} < 5000 THEN 'Amount:1K-5K' WHEN {_AMOUNT} < 50000 THEN 'Amount:5K-50K' WHEN {_AMOUNT} >= 50000 THEN 'Amount:Over50K' END AS bucket FROM docs LEFT JOIN first_total USING (doc_id))"
_DOMAINS = "domain_scores AS (\n" + "\n  UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{d}' AS tag, {_HIT('full_text', words)} AS score FROM docs" for i, (d, words) in enumerate(R.DOMAINS.items())) + f"""
), ranked_domains AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) - 1)::INT AS pos FROM domain_scores
), domains AS (SELECT doc_id, pos, tag FROM ranked_domains WHERE score >= {R.STRONG_DOMAIN} OR (pos = 0 AND score > 0))"""


def _vendor(pattern: str) -> str:
    name = f"regexp_replace({_title(f'''left({_strip(f'''regexp_extract(lower(full_text), '{pattern}', 1)''')}, 50)''')}, '[.,;:]+$', '')"
    return f"CASE WHEN length({name}) > 1 THEN {name} END"


_VENDOR = f"vendors AS (SELECT doc_id, coalesce({', '.join(map(_vendor, R.VENDOR_PATTERNS))}) AS vendor FROM docs)"
_TAGS = """all_tags AS (
  SELECT doc_id, pos AS o, tag FROM domains UNION ALL SELECT doc_id, 100, 'DocType:' || document_type FROM classes UNION ALL SELECT doc_id, 101, 'Vendor:' || vendor FROM vendors WHERE vendor IS NOT NULL
  UNION ALL SELECT doc_id, 102, risk FROM risks UNION ALL SELECT doc_id, 103, bucket FROM buckets WHERE bucket IS NOT NULL UNION ALL SELECT doc_id, 104, 'Status:Under Review' FROM docs)"""
_ALL_TAGS = f"WITH {DOCS}, {_CLASSES}, {_TOTAL}, {_RISK}, {_BUCKET}, {_DOMAINS}, {_VENDOR}, {_TAGS}"

_TABLES = f"""raw AS (
  SELECT l_orderkey, l_orderkey % 4 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cells) AS i, cells, price FROM (
    SELECT *, l_extendedprice::DECIMAL(12, 2) AS price, l_quantity::DECIMAL(12, 2)::VARCHAR AS quantity, CASE l_orderkey % 4 WHEN 0 THEN [' Part  ' || l_partkey, quantity, price::VARCHAR]
      WHEN 1 THEN ['Line ' || l_linenumber || ':', l_returnflag] WHEN 2 THEN [l_partkey::VARCHAR, l_suppkey::VARCHAR, quantity]
      ELSE CASE WHEN l_linenumber % 2 = 0 THEN [' Part  ' || l_partkey, quantity] ELSE [' Part  ' || l_partkey, quantity, NULL, 'note'] END END AS cells FROM lineitem)
), sums AS (SELECT l_orderkey, kind, max(i) AS n, sum(price)::DECIMAL(14, 2)::VARCHAR AS total FROM raw GROUP BY ALL
), given AS (
  SELECT l_orderkey, i, cells FROM raw UNION ALL SELECT l_orderkey, 0, ['Product:', 'Qty', 'Line Total'] FROM sums WHERE kind = 0 UNION ALL SELECT l_orderkey, n + 1, ['', 'Subtotal', total] FROM sums WHERE kind = 0
  UNION ALL SELECT l_orderkey, -1, ['1', '2'] FROM sums WHERE kind = 3 UNION ALL SELECT l_orderkey, 0, ['Item : ', 'Qty', 'Qty', ''] FROM sums WHERE kind = 3
  UNION ALL SELECT l_orderkey, n + 1, ['', ' '] FROM sums WHERE kind = 3 UNION ALL SELECT l_orderkey, n + 2, [' Grand   Total ', '', total] FROM sums WHERE kind = 3
), table_rows AS (
  SELECT 'DOC_' || l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS r, list_transform(cells, lambda c: {_strip("regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g')")}) AS cells FROM given
)"""
_BARE = lambda c: _strip(f"regexp_replace({c}, ':\\s*$', '')")
_UNIQUE = "list_transform(range(1, len(hs) + 1), lambda i: hs[i] || CASE WHEN len(list_filter(hs[1:i], lambda x: x = hs[i])) > 1 THEN '_' || len(list_filter(hs[1:i], lambda x: x = hs[i])) ELSE '' END)"
#: The rules over the rows: key/value tables by their left cells, the header among the first rows, unique names, and what is below.
_SHAPES = f"""{_TABLES}, lefts AS (
  SELECT doc_id, max(len(cells)) AS width, count(*) FILTER (cells[1] <> '') AS n, count(*) FILTER (cells[1] <> '' AND (suffix(cells[1], ':') OR regexp_matches(cells[1], '{R.KEY_CELL}'))) AS good FROM table_rows GROUP BY doc_id
), kinds AS (SELECT doc_id, width, width = 2 AND n > 0 AND good >= {R.KEY_TABLE_SHARE} * n AS is_key_table FROM lefts
), judged AS (
  SELECT doc_id, r, cells, len(f) > 0 AND (len(list_filter(f, lambda c: NOT suffix(c, ':'))) = 0 OR (len(names) > 0 AND len(list_filter(names, lambda c: NOT regexp_matches(c, '{R.NUMBER_CELL}') AND regexp_matches(c, '{R.HEADER_CELL}'))) >= {R.HEADER_SHARE} * len(names))) AS fits
  FROM (SELECT *, list_filter(cells, lambda c: c <> '') AS f, list_filter(list_transform(cells, lambda c: {_BARE('c')}), lambda c: c <> '') AS names FROM table_rows)
), found AS (SELECT doc_id, coalesce(min(r) FILTER (r < {R.HEADER_ROWS} AND fits) + 1, 0) AS head FROM judged GROUP BY doc_id
), named AS (
  SELECT doc_id, head, CASE WHEN head > 0 THEN list_transform(cells, lambda c: coalesce(nullif({_BARE('c')}, ''), 'Column')) ELSE list_transform(range(1, greatest(width, 1) + 1), lambda i: 'Column_' || i) END AS hs
  FROM kinds JOIN found USING (doc_id) LEFT JOIN table_rows t USING (doc_id) WHERE NOT is_key_table AND (head = 0 AND t.r = 0 OR t.r = head - 1)
), once AS (SELECT doc_id, head, {_UNIQUE} AS hs FROM named
), headed AS (SELECT doc_id, head, {_UNIQUE} AS hs FROM once
), body AS (
  SELECT doc_id, r, hs, c, len(list_filter(c, lambda x: lower(x) IN ({', '.join(map(_quoted, R.FOOTER_LABELS))}))) > 0 AS is_footer, list_filter(c, lambda x: x <> '') AS f
  FROM (SELECT doc_id, r, hs, list_transform(range(1, len(hs) + 1), lambda i: coalesce(cells[i], '')) AS c FROM headed JOIN table_rows USING (doc_id) WHERE r >= head) WHERE len(list_filter(c, lambda x: x <> '')) > 0
), footers AS (
  SELECT doc_id, r, f[p] AS label, coalesce(f[p + 1], f[2], '') AS value FROM (SELECT *, list_position(list_transform(f, lambda x: lower(x) IN ({', '.join(map(_quoted, R.FOOTER_LABELS))})), true) AS p FROM body WHERE is_footer)
), kv AS (
  SELECT doc_id, key, arg_max(value, r) AS value, min(r) AS r FROM (SELECT doc_id, r, {_BARE("coalesce(cells[1], '')")} AS key, coalesce(cells[2], '') AS value FROM table_rows JOIN kinds USING (doc_id) WHERE is_key_table) WHERE key <> '' GROUP BY doc_id, key
), lines AS (
  SELECT doc_id, r, {_strip("array_to_string(list_transform(range(1, len(hs) + 1), lambda i: hs[i] || ': ' || c[i]), ' | ')")} AS t FROM body WHERE NOT is_footer
)"""

_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_PAIRED = f"scored AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_DOT('q.embedding', 'v.embedding')} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"
_META = "meta AS (SELECT e.vec_id AS doc_id, 'type' || label AS document_type, 'Tag' || (vec_id %% 3) AS tag, trim(coalesce(text, ''), chr(10) || chr(9) || chr(13) || ' ') AS content FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)".replace("%%", "%")
_POOL = "pool AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20)"


def _mmr(source: str, k: int = 5) -> str:
    """k picks, one after the other: each the best of those left by relevance less likeness to those picked."""
    parts = [f"m1 AS (SELECT query_id, doc_id, 1 AS pick FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) = 1)"]
    for n in range(2, k + 1):
        parts.append(f"""m{n} AS (SELECT * FROM m{n - 1} UNION ALL SELECT query_id, doc_id, {n} FROM (
  SELECT c.query_id, c.doc_id, c.rank, round(0.5 * any_value(c.s) - 0.5 * max({_DOT('a.embedding', 'b.embedding')}), 12) AS value
  FROM {source} c JOIN m{n - 1} p ON p.query_id = c.query_id JOIN embeddings a ON a.vec_id = c.doc_id JOIN embeddings b ON b.vec_id = p.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM m{n - 1} o WHERE o.query_id = c.query_id AND o.doc_id = c.doc_id) GROUP BY c.query_id, c.doc_id, c.rank)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank) = 1)""")
    return ", ".join(parts)


_FILTERED = f"WITH {_PAIRED}, {_POOL}, {_META}, kept AS (SELECT pool.*, document_type, content FROM pool JOIN meta USING (doc_id) WHERE contains(lower(tag), 'tag1') OR contains(lower(document_type), 'tag1')), {_mmr('kept')}"

_CHUNK_RULE = """pages AS (SELECT doc_id, regexp_replace(coalesce(%(text)s, ''), '^\\s+|\\s+$', '', 'g') AS t FROM %(table)s
), steps AS (
  SELECT doc_id, t, 0 AS s, 1 AS step FROM pages WHERE length(t) > 800
  UNION ALL SELECT doc_id, t, s + greatest(cut - 80, 1), step + 1 FROM (SELECT *, %(cut)s AS cut FROM (SELECT *, substr(t, s + 1, 400) AS w FROM steps)) WHERE s + 400 < length(t)
), cuts AS (SELECT doc_id, step, regexp_replace(left(w, %(cut)s), '^\\s+|\\s+$', '', 'g') AS piece FROM (SELECT *, substr(t, s + 1, 400) AS w FROM steps)
), page_parts AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step))::INT AS pos, piece FROM cuts WHERE piece <> '' UNION ALL SELECT doc_id, 1, t FROM pages WHERE t <> '' AND length(t) <= 800)"""
_LAST = lambda p: f"(CASE WHEN instr(reverse(w), {p}) > 0 THEN length(w) - instr(reverse(w), {p}) - 1 ELSE -1 END)"
_BEST = f"greatest({_LAST(chr(39) + ' .' + chr(39))}, {_LAST('chr(10) || ' + chr(39) + '.' + chr(39))}, {_LAST('chr(10) || chr(10)')})"
_CUT = f"(CASE WHEN {_BEST} >= length(w) // 2 THEN least(length(w), {_BEST} + 2) ELSE length(w) END)"

_HEADER_FIELDS = ("order_id", "customer_name", "customer_id", "country", "city", "date", "total_amount")
_HEADER = f"""header_values AS (
  SELECT doc_id, field, arg_min(value, place) AS v FROM (
    SELECT doc_id, field, value, 0 AS place FROM enriched WHERE value IS NOT NULL
    UNION ALL SELECT doc_id, replace(lower(key), ' ', '_'), value, 1 FROM pairs WHERE {_strip('value')} <> '')
  GROUP BY doc_id, field
), header_fields AS (
  SELECT doc_id, {', '.join(f"max(v) FILTER (field = '{f}') AS {f}" for f in _HEADER_FIELDS)} FROM header_values GROUP BY doc_id
), header_items AS (
  SELECT doc_id, string_agg(product || CASE WHEN quantity <> 0 THEN ' x' || quantity::VARCHAR ELSE '' END, ', ' ORDER BY pos) AS products
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM line_items WHERE product <> '') WHERE r <= {R.HEADER_PRODUCTS} GROUP BY doc_id
)"""

#: The rest of the fields in the order in which types list them.
_FIELD_ORDER = list(dict.fromkeys([f for fields in R.TYPED_FIELDS.values() for f in fields] + list(R.ENRICHED_FIELDS)))
_FIELD_LINES = lambda indent: f"string_agg('{indent}' || field || ': ' || value, chr(10) ORDER BY list_position([{', '.join(map(_quoted, _FIELD_ORDER))}], field)) FILTER (value IS NOT NULL)"
#: What a document's summary and entities' text are made of.
_PARTS = f"""date_lists AS (SELECT doc_id, string_agg(value, ', ' ORDER BY pos) AS dates FROM {_entity('dates', 'docs full_text')} GROUP BY doc_id
), total_lists AS (SELECT doc_id, arg_min(value, pos) AS first_total, string_agg('Total Amount: ' || value, chr(10) ORDER BY pos) AS totals FROM {_entity('totals', 'docs full_text')} GROUP BY doc_id
), field_lists AS (SELECT doc_id, {_FIELD_LINES('')} AS fields, {_FIELD_LINES('  ')} AS indented FROM enriched GROUP BY doc_id
), pair_lists AS (SELECT doc_id, string_agg(key || ': ' || value, chr(10) ORDER BY pos) FILTER (pos < 8) AS some_pairs, string_agg('  ' || key || ': ' || value, chr(10) ORDER BY pos) AS all_pairs FROM pairs GROUP BY doc_id
), item_lists AS (
  SELECT doc_id, count(*) AS n, string_agg('  - ' || coalesce(nullif(product, ''), 'Item') || CASE WHEN coalesce(quantity, 0) <> 0 THEN ' x' || quantity::VARCHAR ELSE '' END || ' (Total: ' || coalesce(line_total::VARCHAR, 'N/A') || ')', chr(10) ORDER BY pos) FILTER (pos < 10) AS items FROM line_items GROUP BY doc_id
)"""
_JOINED_PARTS = "classes LEFT JOIN date_lists USING (doc_id) LEFT JOIN total_lists USING (doc_id) LEFT JOIN field_lists USING (doc_id) LEFT JOIN pair_lists USING (doc_id) LEFT JOIN item_lists USING (doc_id)"
_HEADER_TEXT = """concat_ws(chr(10), 'Document: ' || doc_id, 'Type: ' || document_type, 'Order ID: ' || order_id,
      coalesce('Customer: ' || customer_name || coalesce(' (' || customer_id || ')', ''), 'Customer: (' || customer_id || ')'),
      'Country: ' || country, 'City: ' || city, 'Date: ' || "date", 'Total: ' || total_amount, 'Products: ' || products)"""

#: Columns whose names are like a label: the longest common part of both, then the same on either side of it, gives the share of characters that match.
_LONGEST = "list_sort(list_transform(range(1, length(a) + 1), lambda i: {'n': len(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))), 'i': -i}), 'DESC')[1]"
_LABELS = sorted({x for labels in (*R.ENRICHED_FIELDS.values(), R.PRODUCT_LABELS, R.QUANTITY_LABELS) for x in labels})
_ALIKE = f"""{_SHAPES}, names AS (SELECT DISTINCT unnest(hs) AS name FROM headed
), parts AS (
  SELECT name, label, label AS a, lower(name) AS b FROM names, (SELECT unnest([{', '.join(map(_quoted, _LABELS))}]) AS label) WHERE name <> ''
  UNION ALL SELECT name, label, unnest([left(a, i - 1), substr(a, i + n)]), unnest([left(b, j - 1), substr(b, j + n)]) FROM (
    SELECT *, instr(b, substr(a, i, n)) AS j FROM (SELECT name, label, a, b, m.n AS n, -m.i AS i FROM (SELECT *, {_LONGEST} AS m FROM parts WHERE a <> '' AND b <> ''))) WHERE n > 0
), shares AS (
  SELECT name, label, 2 * sum(({_LONGEST}).n) / (length(label) + length(name)) AS share FROM parts WHERE a <> '' AND b <> '' GROUP BY name, label
), alike AS (
  SELECT name, label, CASE WHEN contains(lower(name), label) OR contains(label, lower(name)) THEN least(1.0, share + {R.FUZZY_BONUS}) ELSE share END AS score FROM shares
), label_columns AS (
  SELECT doc_id, label, arg_max(name, {{'s': score, 'p': -pos}}) AS name, max(score) AS score FROM (SELECT doc_id, unnest(hs) AS name, unnest(range(len(hs))) AS pos FROM headed) JOIN alike USING (name) WHERE score >= {R.FUZZY_THRESHOLD} GROUP BY doc_id, label
)"""


def _columns(fields) -> str:
    """The column of each field, by the first of its labels that has one."""
    places = ", ".join(f"({_quoted(f)}, {_quoted(x)}, {i})" for f, labels in fields.items() for i, x in enumerate(labels))
    return f"SELECT doc_id, field, arg_min(name, place) AS name FROM label_columns JOIN (VALUES {places}) p(field, label, place) USING (label) GROUP BY doc_id, field"


_OF_TABLES = f"""all_pairs AS (
  SELECT doc_id, key, value FROM pairs UNION ALL SELECT doc_id, {_title('key')} AS key, value FROM kv WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = kv.doc_id AND p.key = {_title('kv.key')})
), {_ENRICHED.replace('FROM pairs p', 'FROM all_pairs p')}, field_columns AS ({_columns(R.ENRICHED_FIELDS)}
), table_values AS (SELECT doc_id, field, arg_min(v, r) AS value FROM (SELECT doc_id, field, r, c[list_position(hs, name)] AS v FROM body JOIN field_columns USING (doc_id) WHERE NOT is_footer) WHERE v <> '' GROUP BY doc_id, field
), footer_values AS (SELECT doc_id, 'total_amount' AS field, arg_min(value, r) AS value FROM footers WHERE value <> '' GROUP BY doc_id)"""
_TABLED_CLASSES = _CLASSES.replace("least(1.0, s + CASE", f"least(1.0, s + {_TABLED} + CASE").replace("THEN NULL WHEN colon_ratio", "THEN NULL WHEN has_currency THEN 'FINANCIAL_DOCUMENT' WHEN colon_ratio")

#: Documents whose first line is a page of its own, and what their tables add to everything.
_RUN = f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_replace(full_text, chr(10), chr(10) || chr(10)) AS full_text FROM ({DUCKDB})), {_TABLED_CLASSES}, {_pairs(3)}, {_TYPED}, {_ALIKE}, {_OF_TABLES}
), final_fields AS (
  SELECT doc_id, field, coalesce(e.value, t.value, f.value) AS value FROM enriched e LEFT JOIN table_values t USING (doc_id, field) LEFT JOIN footer_values f USING (doc_id, field)
), of_text AS (SELECT doc_id, pos AS o, value FROM {_entity('totals', 'docs full_text')}
), every_total AS (
  SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS nth FROM (SELECT doc_id, value, min(o) AS o FROM (FROM of_text UNION ALL SELECT doc_id, 1000 + r, value FROM footers WHERE value <> '') GROUP BY doc_id, value)
), date_lists AS (SELECT doc_id, string_agg(value, ', ' ORDER BY pos) AS dates FROM {_entity('dates', 'docs full_text')} GROUP BY doc_id
), total_lists AS (SELECT doc_id, arg_min(value, nth) AS first_total, string_agg('Total Amount: ' || value, chr(10) ORDER BY nth) AS totals FROM every_total WHERE nth <= {R.ENTITIES['totals'][2]} GROUP BY doc_id
), field_lists AS (SELECT doc_id, {_FIELD_LINES('')} AS fields, {_FIELD_LINES('  ')} AS indented, max(value) FILTER (field = 'order_id') AS order_id, max(value) FILTER (field = 'customer_name') AS customer_name FROM final_fields GROUP BY doc_id
), known_pairs AS (
  SELECT doc_id, key, value, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS pos FROM (
    SELECT doc_id, key, value, pos AS o FROM pairs UNION ALL SELECT doc_id, {_title('key')}, value, 100000 + r FROM kv WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = kv.doc_id AND p.key = {_title('kv.key')}))
), pair_lists AS (SELECT doc_id, string_agg(key || ': ' || value, chr(10) ORDER BY pos) FILTER (pos < 8) AS some_pairs, string_agg('  ' || key || ': ' || value, chr(10) ORDER BY pos) AS shown_pairs FROM known_pairs GROUP BY doc_id
), table_rows_of AS (
  SELECT doc_id, t, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth FROM lines) WHERE nth <= {R.TABLE_ROWS} AND t <> '' GROUP BY doc_id, t
  UNION ALL SELECT doc_id, string_agg(key || ': ' || value, ' | ' ORDER BY r), 0 FROM kv GROUP BY doc_id
), row_lists AS (SELECT doc_id, string_agg('  ' || t, chr(10) ORDER BY r) AS table_data FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth FROM table_rows_of) WHERE nth <= 20 GROUP BY doc_id
), shapes AS (
  SELECT doc_id, 'Table (1 rows): ' || string_agg(key, ', ' ORDER BY r) AS shape, string_agg(rtrim(key || ': ' || value), chr(10) ORDER BY r) AS raw_text FROM kv GROUP BY doc_id
  UNION ALL SELECT doc_id, 'Table (' || count(t) || ' rows): ' || array_to_string(any_value(hs), ', '), string_agg(coalesce(t, rtrim(label || ': ' || value)), chr(10) ORDER BY label IS NOT NULL, r)
    FROM headed LEFT JOIN (SELECT doc_id, r, t, NULL AS label, NULL AS value FROM lines UNION ALL SELECT doc_id, r, NULL, label, value FROM footers) USING (doc_id) GROUP BY doc_id
), every_field AS (
  SELECT doc_id, field, arg_min(value, place) AS v FROM (SELECT doc_id, field, value, 0 AS place FROM final_fields WHERE value IS NOT NULL UNION ALL SELECT doc_id, replace(lower(key), ' ', '_'), value, 1 FROM known_pairs) GROUP BY doc_id, field
), header_fields AS (SELECT doc_id, {', '.join(f"max(v) FILTER (field = '{f}') AS {f}" for f in _HEADER_FIELDS)} FROM every_field GROUP BY doc_id
), product_columns AS ({_columns({'name': R.PRODUCT_LABELS, 'quantity': R.QUANTITY_LABELS})}
), table_products AS (
  SELECT doc_id, string_agg(p || CASE WHEN k <> '' THEN ' x' || k ELSE '' END, ', ' ORDER BY r) AS products FROM (
    SELECT doc_id, r, c[list_position(hs, n.name)] AS p, coalesce(c[list_position(hs, q.name)], '') AS k, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth
    FROM body JOIN (FROM product_columns WHERE field = 'name') n USING (doc_id) LEFT JOIN (FROM product_columns WHERE field = 'quantity') q USING (doc_id) WHERE NOT is_footer AND c[list_position(hs, n.name)] <> '') WHERE nth <= {R.HEADER_PRODUCTS} GROUP BY doc_id
), joined AS (
  SELECT * FROM classes LEFT JOIN date_lists USING (doc_id) LEFT JOIN total_lists USING (doc_id) LEFT JOIN (SELECT doc_id, fields, indented, order_id AS field_order_id, customer_name AS field_customer FROM field_lists) USING (doc_id) LEFT JOIN pair_lists USING (doc_id) LEFT JOIN row_lists USING (doc_id) LEFT JOIN shapes USING (doc_id) LEFT JOIN header_fields USING (doc_id) LEFT JOIN table_products USING (doc_id)
), run_pages AS (
  SELECT doc_id, 1 AS page, split_part(full_text, chr(10), 1) AS text FROM docs UNION ALL SELECT doc_id, 2, substr(full_text, instr(full_text, chr(10)) + 2) FROM docs
), {_CHUNK_RULE.replace('SELECT doc_id, ', 'SELECT doc_id, page, ').replace('PARTITION BY doc_id ', 'PARTITION BY doc_id, page ') % {'cut': _CUT, 'table': 'run_pages', 'text': 'text'}
}, run_chunks AS (
  SELECT doc_id, 0 AS o, 'document_header' AS chunk_type, NULL AS page_number, {_HEADER_TEXT} AS t FROM joined
  UNION ALL SELECT doc_id, (3 - page) * 10000 + pos, 'page_text', page, '[' || doc_id || ' / ' || document_type || ']' || chr(10) || piece FROM page_parts JOIN classes USING (doc_id)
  UNION ALL SELECT doc_id, 1000000, 'table', NULL, '[' || doc_id || ' / ' || document_type || ' / table]' || chr(10) || raw_text FROM joined WHERE raw_text <> ''
  UNION ALL SELECT doc_id, 2000000, 'entity_summary', NULL, '[' || doc_id || ' / ' || document_type || ']' || chr(10) || concat_ws(chr(10), '[ / ' || document_type || ']', 'Key Fields:' || chr(10) || indented, totals, 'Dates: ' || dates, 'Document Fields:' || chr(10) || shown_pairs, 'Table Data:' || chr(10) || table_data) FROM joined
), chunk_counts AS (SELECT doc_id, count(*)::INT AS n_chunks FROM run_chunks GROUP BY doc_id)"""
_RUN = _RUN.replace("GROUP BY doc_id)\n), final_fields", "GROUP BY doc_id\n), final_fields").replace("\n}, run_chunks", ", run_chunks")

ORACLES = {
    "rendered_docs": DUCKDB,
    "doc_layout_hints": f"WITH {DOCS}, source AS (SELECT doc_id, full_text FROM docs UNION ALL SELECT doc_id::VARCHAR, coalesce(text, '') FROM documents), {_LAYOUT} SELECT * EXCLUDE (full_text, avg_line_length, colon_ratio), round(avg_line_length, 6) AS avg_line_length, round(colon_ratio, 6) AS colon_ratio FROM layout",
    "doc_tier1_scores": f"WITH {DOCS}, {_SCORES} SELECT doc_id, document_type, round(score, 6) AS score FROM scores",
    "doc_classify": f"WITH {DOCS}, {_CLASSES} SELECT doc_id, document_type, round(class_confidence, 6) AS class_confidence FROM classes",
    "doc_classify_tables": f"WITH {DOCS}, {_TABLED_CLASSES} SELECT doc_id, true AS has_tables, document_type, round(class_confidence, 6) AS class_confidence FROM classes",
    "known_docs": f"WITH {DOCS}, {_CLASSES} SELECT doc_id, document_type FROM classes WHERE document_type <> 'UNKNOWN' AND class_confidence >= 0.4",
    "kv_pairs": f"WITH {DOCS}, {_pairs(3)} SELECT * FROM pairs",
    "profile_dates_amounts": f"""WITH {DOCS}, dates AS (SELECT doc_id, i, d FROM (SELECT doc_id, unnest(ds) AS d, unnest(range(1, len(ds) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(full_text, '{R.DATE_ISO}') || regexp_extract_all(full_text, '{R.DATE_DMY}') AS ds FROM docs))),
    money AS (SELECT doc_id, i, s || n AS d FROM (SELECT doc_id, unnest(ss) AS s, unnest(ns) AS n, unnest(range(1, len(ss) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(full_text, '{R.MONEY}', 1) AS ss, regexp_extract_all(full_text, '{R.MONEY}', 2) AS ns FROM docs)) WHERE i <= 10)
    SELECT DISTINCT doc_id, 'date' AS kind, d AS value FROM dates UNION ALL SELECT DISTINCT doc_id, 'amount', d FROM money""",
    **{name: f"WITH {DOCS} SELECT * FROM {_entity(kind, source)}" for name, kind, source in (
        ("entity_dates", "dates", "docs full_text"), ("entity_amounts", "amounts", "docs full_text"), ("entity_totals", "totals", "docs full_text"), ("entity_order_ids", "order_ids", "docs full_text"), ("entity_invoice_ids", "invoice_ids", "docs full_text"),
        ("entity_emails", "email_addresses", "documents text"), ("entity_phones", "phone_numbers", "documents text"), ("entity_postal", "postal_codes", "documents text"))},
    "typed_fields": f"WITH {DOCS}, {_CLASSES}, {_TYPED} SELECT * FROM typed WHERE value IS NOT NULL",
    "typed_fields_enriched": f"{_WITH_FIELDS} SELECT * FROM enriched WHERE value IS NOT NULL",
    "document_mode": f"WITH {DOCS} SELECT doc_id, CASE WHEN regexp_matches(full_text, '{R.PRODUCT_LABEL}') THEN 'FORM_MODE' ELSE 'UNKNOWN' END AS document_mode FROM docs",
    "line_items": f"WITH {DOCS}, {_ITEMS} SELECT * FROM line_items",
    "total_validation": f"{_WITH_FIELDS}, {_ITEMS}, {_SCHEMA} SELECT doc_id, round(ext_total, 2) AS ext_total, round(calc_total, 2) AS calc_total, round(CASE WHEN abs(calc_total - ext_total) > 0.01 THEN calc_total ELSE ext_total END, 2) AS total_amount FROM final",
    "completeness_score": f"{_WITH_FIELDS}, {_ITEMS}, {_SCHEMA} SELECT doc_id, order_id, customer_id, customer_name, order_date, round(0.4 + CASE WHEN every THEN 0.2 ELSE 0 END + CASE WHEN abs(calc_total - ext_total) <= 0.01 THEN 0.2 ELSE 0 END + CASE WHEN order_id IS NULL THEN 0 ELSE 0.1 END + CASE WHEN customer_name IS NULL THEN 0 ELSE 0.1 END, 4)::DOUBLE AS confidence FROM final",
    "header_chunk": f"{_WITH_FIELDS}, {_ITEMS}, {_HEADER} SELECT doc_id, {_HEADER_TEXT} AS text FROM classes LEFT JOIN header_fields USING (doc_id) LEFT JOIN header_items USING (doc_id)",
    "doc_summary": f"""{_WITH_FIELDS}, {_ITEMS}, {_PARTS}, texts AS (
      SELECT doc_id, concat_ws(chr(10), 'Document: ' || doc_id, 'Document Type: ' || document_type, fields, 'Dates: ' || dates, 'Total: ' || first_total, 'Line Items (' || n || '):' || chr(10) || items, some_pairs) AS t FROM {_JOINED_PARTS})
      SELECT doc_id, md5(t) AS summary_md5, length(t)::INT AS n_chars FROM texts""",
    "doc_chunks": f"""{_WITH_FIELDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_ITEMS}, {_HEADER}, {_PARTS}, {_CHUNK_RULE % {'cut': _CUT, 'table': 'docs', 'text': 'full_text'}}, texts AS (
      SELECT doc_id, 0 AS o, 'document_header' AS chunk_type, NULL AS page_number, {_HEADER_TEXT} AS t FROM classes LEFT JOIN header_fields USING (doc_id) LEFT JOIN header_items USING (doc_id)
      UNION ALL SELECT doc_id, pos, 'page_text', 1, '[' || doc_id || ' / ' || document_type || ']' || chr(10) || piece FROM page_parts JOIN classes USING (doc_id)
      UNION ALL SELECT doc_id, 1000000, 'entity_summary', NULL, '[' || doc_id || ' / ' || document_type || ']' || chr(10) || concat_ws(chr(10), '[ / ' || document_type || ']', 'Key Fields:' || chr(10) || indented, totals, 'Dates: ' || dates, 'Document Fields:' || chr(10) || all_pairs) FROM {_JOINED_PARTS}
    ) SELECT doc_id, doc_id || '_chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY o))::VARCHAR, 4, '0') AS chunk_id, chunk_type, page_number::INT AS page_number, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM texts""",
    "document_run": f"""{_RUN}
    SELECT doc_id, document_type, round(class_confidence, 6) AS class_confidence, 'TABLE_MODE' AS document_mode, 2 AS n_pages, 1 AS n_tables, 0 AS n_items, n_chunks, round(CASE WHEN coalesce(field_order_id, order_id) IS NULL THEN 0 ELSE 0.1 END + CASE WHEN coalesce(customer_name, nullif({_strip("regexp_extract(full_text, '(?i)Customer\\s+Name\\s*[:\\-]\\s*([^\\n]+)', 1)")}, '')) IS NULL THEN 0 ELSE 0.1 END, 4)::DOUBLE AS confidence,
      md5(concat_ws(chr(10), 'Document: ' || doc_id, 'Document Type: ' || document_type, fields, 'Dates: ' || dates, 'Total: ' || first_total, shape, some_pairs)) AS summary_md5, document_type AS profile_type, order_id, '' AS errors FROM joined JOIN chunk_counts USING (doc_id)""",
    "document_run_chunks": f"""{_RUN}
    SELECT doc_id, doc_id || '_chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY o))::VARCHAR, 4, '0') AS chunk_id, chunk_type, page_number::INT AS page_number, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM run_chunks""",
    "profile_pairs": f"WITH {DOCS}, {_pairs(1)} SELECT * FROM pairs WHERE pos < {R.PAIR_CAP}",
    "tables_by_page": f"WITH {_TABLES} SELECT doc_id, CASE WHEN count(*) < 5 THEN 1 ELSE 2 END::INT AS page_number, 1 AS n_tables, count(*)::INT AS n_rows FROM table_rows GROUP BY doc_id",
    "stored_texts": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "text_information": f"""WITH cleaned AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents), {', '.join(f"{n} AS (SELECT doc_id, string_agg(value, ',' ORDER BY pos) AS v FROM {_entity(kind, 'cleaned t')} GROUP BY doc_id)" for n, kind in (('e', 'email_addresses'), ('f', 'phone_numbers'), ('g', 'postal_codes')))}
    SELECT doc_id, CASE WHEN t = '' THEN 'empty' ELSE 'success' END AS extraction_status, length(t)::INT AS n_chars, coalesce(e.v, '') AS emails, coalesce(f.v, '') AS phones, coalesce(g.v, '') AS postal FROM cleaned LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "rag_prompt": f"""{_FILTERED}, contexts AS (
      SELECT query_id, string_agg('[' || doc_id || '] (' || document_type || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pick) AS context, bool_or(lower(document_type) IN ({', '.join(map(_quoted, R.RISK_TYPES))})) AS risky FROM m5 JOIN meta USING (doc_id) GROUP BY query_id
    ), said AS (
      SELECT conv_id AS query_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS memory FROM (
        SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id)
    SELECT query_id, md5({_quoted(chat.SYSTEM)} || CASE WHEN risky THEN chr(10) || chr(10) || {_quoted(chat.RISK)} ELSE '' END) AS system_md5,
      md5(concat_ws(chr(10) || chr(10), nullif(memory, ''), 'Documents:' || chr(10) || coalesce(context, {_quoted(chat.NOTHING)}), 'Question: What does ' || query_id || ' say?')) AS user_md5
    FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0) LEFT JOIN contexts USING (query_id) LEFT JOIN said USING (query_id)""",
    "index_rebuild_rows": f"SELECT vec_id, label, round({_DOT('embedding', 'embedding')}, 4) AS norm FROM embeddings WHERE embedding IS NOT NULL",
    "fuzzy_header_match": f"WITH RECURSIVE {_ALIKE} SELECT doc_id, 0 AS no, label, name AS column, round(score, 6)::DOUBLE AS score FROM label_columns",
    "header_products": f"""WITH RECURSIVE {_ALIKE}, found_columns AS ({_columns({'name': R.PRODUCT_LABELS, 'quantity': R.QUANTITY_LABELS})}
    ), shown AS (
      SELECT doc_id, r, c[list_position(hs, n.name)] AS p, coalesce(c[list_position(hs, q.name)], '') AS k FROM body JOIN (FROM found_columns WHERE field = 'name') n USING (doc_id) LEFT JOIN (FROM found_columns WHERE field = 'quantity') q USING (doc_id) WHERE NOT is_footer)
    SELECT doc_id, string_agg(p || CASE WHEN k <> '' THEN ' x' || k ELSE '' END, ', ' ORDER BY r) AS products FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth FROM shown WHERE p <> '') WHERE nth <= {R.HEADER_PRODUCTS} GROUP BY doc_id""",
    "typed_fields_tables": f"""WITH RECURSIVE {DOCS}, {_TABLED_CLASSES}, {_pairs(3)}, {_TYPED}, {_ALIKE}, {_OF_TABLES}
    SELECT doc_id, field, coalesce(e.value, t.value, f.value) AS value FROM enriched e LEFT JOIN table_values t USING (doc_id, field) LEFT JOIN footer_values f USING (doc_id, field) WHERE coalesce(e.value, t.value, f.value) IS NOT NULL""",
    "table_cells_clean": f"WITH {_TABLES} SELECT doc_id, r::INT AS row, unnest(range(0, len(cells)))::INT AS col, unnest(cells) AS cell FROM table_rows",
    "kv_table_detect": f"WITH {_SHAPES} SELECT doc_id, is_key_table FROM kinds",
    "table_header_infer": f"""WITH {_SHAPES} SELECT doc_id, head::INT AS "at", unnest(range(0, len(hs)))::INT AS pos, unnest(hs) AS header FROM headed""",
    "table_footer_totals": f"WITH {_SHAPES} SELECT doc_id, label, value FROM footers",
    "table_normalise": f"""WITH {_SHAPES}, texts AS (
      SELECT doc_id, 'key_value' AS table_type, count(*)::INT AS n_headers, 1 AS n_rows, string_agg(rtrim(key || ': ' || value), chr(10) ORDER BY r) AS t FROM kv GROUP BY doc_id
      UNION ALL SELECT doc_id, 'data', len(any_value(hs))::INT, count(t)::INT, string_agg(coalesce(t, rtrim(label || ': ' || value)), chr(10) ORDER BY label IS NOT NULL, r) FROM headed LEFT JOIN (SELECT doc_id, r, t, NULL AS label, NULL AS value FROM lines UNION ALL SELECT doc_id, r, NULL, label, value FROM footers) USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, table_type, n_headers, n_rows, md5(t) AS text_md5 FROM texts""",
    "table_entities": f"""WITH {_SHAPES}, texts AS (
      SELECT doc_id, t, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS nth FROM lines) WHERE nth <= {R.TABLE_ROWS} AND t <> '' GROUP BY doc_id, t
      UNION ALL SELECT doc_id, string_agg(key || ': ' || value, ' | ' ORDER BY r), 0 FROM kv GROUP BY doc_id
    ), joined AS (SELECT doc_id, count(*)::INT AS n_rows, md5(string_agg(t, chr(10) ORDER BY r)) AS rows_md5 FROM texts GROUP BY doc_id
    ), sums_of AS (SELECT doc_id, string_agg(value, ',' ORDER BY r) AS totals FROM footers GROUP BY doc_id
    ), pairs_of AS (SELECT doc_id, count(*)::INT AS n_pairs FROM kv WHERE value <> '' GROUP BY doc_id)
    SELECT doc_id, n_rows, rows_md5, coalesce(totals, '') AS totals, coalesce(n_pairs, 0) AS n_pairs FROM joined LEFT JOIN sums_of USING (doc_id) LEFT JOIN pairs_of USING (doc_id)""",
    "page_chunks_boundary": f"WITH RECURSIVE {_CHUNK_RULE % {'cut': _CUT, 'table': 'documents', 'text': 'text'}} SELECT doc_id, pos, md5(piece) AS text_md5 FROM page_parts",
    "char_chunks": "SELECT doc_id, (o // 450 + 1)::INT AS pos, md5(substr(text, o + 1, 500)) AS text_md5 FROM documents, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE length(text) END, 450)) AS t(o) WHERE text <> ''",
    "structured_sink": "SELECT doc_id, (o // 600 + 1)::INT AS pos, least(500, length(text) - o)::INT AS n_chars FROM documents, unnest(range(0, length(text), 600)) AS t(o) WHERE text <> ''",
    "domain_tags": f"WITH {DOCS}, {_DOMAINS} SELECT * FROM domains",
    "risk_level": f"WITH {DOCS}, {_TOTAL}, {_RISK} SELECT * FROM risks",
    "amount_bucket": f"WITH {DOCS}, {_TOTAL}, {_BUCKET} SELECT * FROM buckets",
    "vendor_tag": f"WITH {DOCS}, {_VENDOR} SELECT * FROM vendors WHERE vendor IS NOT NULL",
    "generate_tags": f"{_ALL_TAGS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS pos, tag FROM all_tags",
    "risk_addendum_flag": f"{_ALL_TAGS}, flags AS (SELECT doc_id, bool_or(tag LIKE 'Risk:High%' OR tag LIKE 'Risk:Medium%' OR tag = 'DocType:CONTRACT') AS risky FROM all_tags GROUP BY doc_id) SELECT variant, bool_or(risky) AS any_risk, sum(risky::INT)::BIGINT AS n_risky FROM docs JOIN flags USING (doc_id) GROUP BY variant",
    "mean_pool_vectors": """WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL)
    SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS value FROM m""",
    "vector_search_topk": f"WITH {_PAIRED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank, round(s, 4) AS score FROM scored QUALIFY rank <= 5",
    "vector_search_bounded": f"WITH {_PAIRED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank, round(s, 4) AS score FROM scored QUALIFY rank <= 5",
    "similar_documents": f"WITH {_PAIRED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank, round(s, 4) AS score FROM scored WHERE query_id <> doc_id QUALIFY rank <= 5",
    "filtered_retrieval": f"WITH {_PAIRED}, {_POOL}, {_META} SELECT query_id, doc_id, rank::INT AS rank, document_type FROM pool JOIN meta USING (doc_id) WHERE contains(lower(tag), 'tag1') OR contains(lower(document_type), 'tag1')",
    "mmr_retrieval": f"WITH {_PAIRED}, {_POOL}, {_mmr('pool')} SELECT query_id, pick::INT AS pick, doc_id FROM m5",
    "rag_context": f"{_FILTERED} SELECT query_id, md5(string_agg('[' || doc_id || '] (' || document_type || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pick)) AS context_md5 FROM m5 JOIN meta USING (doc_id) GROUP BY query_id",
    "rag_sources": f"{_FILTERED} SELECT query_id, pick::INT AS pick, doc_id::VARCHAR AS doc_name, 1 AS page, round(s, 4) AS similarity_score, document_type, left(content, 200) AS content_preview FROM m5 JOIN kept USING (query_id, doc_id)",
    "chat_window": """SELECT conv_id, count(*) AS n_messages, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS memory FROM (
      SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id""",
    "chat_memory_stream": """SELECT conv_id, count(*) AS n_messages, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS memory FROM (
      SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id""",
    "chat_history": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "chat_clear": "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id <> 7 GROUP BY conv_id",
    "metadata_upsert": "SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS status FROM documents",
    "metadata_upsert_bucketed": "SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS status FROM documents",
    "index_insert_bucketed": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label ELSE -1 END AS label FROM embeddings",
    "metadata_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "metadata_lookup": "SELECT doc_id, source, lang FROM documents WHERE doc_id = 11",
    "index_insert_absent": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label ELSE -1 END AS label FROM embeddings",
    "index_rebuild_count": "SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL",
    "upload_validation": r"""SELECT doc_id, extension, extension IN ('pdf', 'png', 'jpg', 'jpeg') AS ok FROM (
      SELECT doc_id, lower(regexp_extract(source || ['.PDF', '.tiff', '', '.scan.Jpeg', '.docx'][doc_id % 5 + 1], '\.([^./]*)$', 1)) AS extension FROM documents)""",
    "page_concat": r"""SELECT doc_id, length(t)::INT AS char_count, len(regexp_extract_all(t, '\S+'))::INT AS word_count, 2 AS page_count, CASE WHEN t = '' THEN 'empty' ELSE 'success' END AS ocr_status, md5(t) AS text_md5 FROM (
      SELECT doc_id, CASE WHEN a = '' OR b = '' THEN a || b ELSE a || chr(10) || chr(10) || b END AS t FROM (
        SELECT doc_id, regexp_replace(left(text, length(text) // 2), '^\s+|\s+$', '', 'g') AS a, regexp_replace(substr(text, length(text) // 2 + 1), '^\s+|\s+$', '', 'g') AS b FROM documents WHERE text IS NOT NULL))""",
}
