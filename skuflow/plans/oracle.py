"""SQL counterparts of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

import re

from skuflow.functions import fixed_values as fv
from skuflow.operators.resample import NORMAL_EDGE, NORMAL_MIDDLE, NORMAL_TAIL

SKU_IN_TEXT = r"\bSKU-\d+\b"


def r(expression: str, digits: int = 0) -> str:
    """Rounding half up, as the queries do it."""
    return f"(floor(({expression}) * 1e{digits} + 0.5) / 1e{digits})"


def whole(expression: str) -> str:
    return f"CAST(CAST(floor(({expression}) + 0.5) AS BIGINT) AS VARCHAR)"


def places(expression: str, digits: int) -> str:
    return f"CAST(CAST({r(expression, digits)} AS DECIMAL(30,{digits})) AS VARCHAR)"


def signed(expression: str) -> str:
    return f"(CASE WHEN floor(({expression}) + 0.5) >= 0 THEN '+' ELSE '' END || {whole(expression)})"


def month(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TRIMMED = quoted(fv.BLANKS)
NEWLINE = "chr(10)"

ABC = "CASE {key} % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '—' END"
Z = "abs({c} - s.{c}_m) / (s.{c}_s + 1e-8)"
ANOMALY = fv.ANOMALY_COLUMNS
LARGEST_Z = "greatest(" + ", ".join(Z.format(c=c) for c in ANOMALY) + ")"
STATS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ANOMALY)
SCORE_SEVERITY = "CASE WHEN {s} < -0.2 THEN 'high' WHEN {s} < -0.1 THEN 'medium' ELSE 'low' END"
GAP_SEVERITY = "CASE WHEN gap < -50 THEN 'high' WHEN gap < 0 THEN 'medium' ELSE 'low' END"
HIGH_SEASON = "({m} IN (10, 11, 12, 1))::INT"


def _scores() -> str:
    parts = []
    for intent, words in fv.INTENT_KEYWORDS.items():
        total = " + ".join(f"contains(lower(question), {quoted(word)})::INT" for word in words)
        parts.append(f"{total} AS {intent}_score")
    return ", ".join(parts)


def _chunk(source: str) -> str:
    return f"""
SELECT source || '_p' || page || '_c' || i AS chunk_id, source, page, CAST(i AS INT) AS chunk_index,
       CASE WHEN lower(source) LIKE 'po\\_%' ESCAPE '\\' OR contains(lower(source), 'purchase') THEN 'PO'
            WHEN contains(lower(source), 'catalog') OR contains(lower(source), 'supplier') THEN 'catalog'
            ELSE 'unknown' END AS doc_type,
       substring(text, 1 + 1400 * i, 1600) AS text
FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 1600 THEN 1
                             ELSE CAST(ceil((length(text) - 1600) / 1400.0) AS BIGINT) + 1 END)) AS i FROM {source})
"""


def _cleaned(source: str) -> str:
    return f"""
SELECT source, page, text FROM (
  SELECT source, page, trim(regexp_replace(regexp_replace(trim(text, {TRIMMED}), '\\n{{3,}}', chr(10) || chr(10), 'g'),
                            ' {{2,}}', ' ', 'g'), {TRIMMED}) AS text
  FROM {source}) WHERE length(text) > 0
"""


WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
SHINGLES = (
    "list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), "
    "lambda i: array_to_string(words[i:i + 3], ' ')))"
)

_PRIME = 2147483647
_HASHES = range(fv.MINHASH_PERMUTATIONS)

VIEWS = {
    "fx_demand": f"""
SELECT printf('SKU-%06d', p_partkey) AS sku_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
       min(p_name) AS product_name, min({ABC.format(key='p_partkey')}) AS abc_class, min(l_linestatus) AS channel,
       sum(l_quantity) AS units_sold,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS units_returned,
       greatest(sum(l_quantity) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0) AS net_units,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""",
    "fx_inventory": f"""
SELECT sku_id, item_name, item_type, abc_class, qty_on_hand, qty_wip, qty_in_transit, total_available, reorder_point,
       floor(total_available / daily_use * 10 + 0.5) / 10 AS days_of_stock,
       CASE WHEN total_available * 2 <= reorder_point THEN 'Critical'
            WHEN total_available <= reorder_point THEN 'Low' ELSE 'OK' END AS status,
       total_available - reorder_point AS gap
FROM (SELECT printf('SKU-%06d', p_partkey) AS sku_id, p_name AS item_name, p_type AS item_type,
             {ABC.format(key='p_partkey')} AS abc_class,
             p_size * 8 AS qty_on_hand, (p_partkey * 7) % 40 AS qty_wip, (p_partkey * 13) % 25 AS qty_in_transit,
             p_size * 8 + (p_partkey * 7) % 40 + (p_partkey * 13) % 25 AS total_available,
             60 + (p_partkey * 31) % 200 AS reorder_point, CAST(1 + p_size % 7 AS DOUBLE) AS daily_use
      FROM part)
""",
    "fx_directory": """
SELECT printf('SUP-%05d', s_suppkey + 2) AS supplier_id, s_name AS supplier_name, n_name AS city, r_name AS state,
       CAST(70 + (s_suppkey * 7) % 27 AS DOUBLE) AS on_time_rate_pct,
       CASE s_suppkey % 4 WHEN 0 THEN '15 days net' WHEN 1 THEN '30 days net' WHEN 2 THEN '45 days net'
            ELSE '60 days net' END AS payment_terms
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "fx_terms": """
SELECT printf('SUP-%05d', s_suppkey + 1) AS supplier_id, s_name AS supplier_name, 15 + s_suppkey % 53 AS lead_time_days,
       100 + (s_suppkey * 37) % 350 AS min_order_qty, CAST(70 + (s_suppkey * 7) % 27 AS DOUBLE) AS on_time_rate_pct,
       10 * (s_suppkey % 4) AS advance_pct
FROM supplier
""",
    "fx_bridge": """
SELECT DISTINCT printf('SUP-%05d', l_suppkey) AS supplier_id, printf('SKU-%06d', l_partkey + 50) AS sku_id
FROM lineitem
""",
    "fx_po": """
SELECT concat('PO-', o_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS po_number,
       CAST(o_orderdate AS DATE) AS po_date, printf('SUP-%05d', l_suppkey) AS supplier_id,
       printf('SKU-%06d', l_partkey) AS sku_id, l_quantity AS qty_ordered,
       floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS rate_per_unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "fx_pages": """
SELECT CASE doc_id % 4 WHEN 0 THEN printf('PO_%06d.pdf', doc_id) WHEN 1 THEN printf('catalog_%06d.pdf', doc_id)
                       WHEN 2 THEN printf('Purchase_note_%06d.pdf', doc_id) ELSE printf('misc_%06d.pdf', doc_id) END AS source,
       0 AS page, text, doc_id
FROM documents
""",
    "fx_binders": """
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page, text, bool_or(doc_id % 97 = 0) OVER (PARTITION BY source) AS spoiled
FROM (SELECT regexp_extract(source, '^([^0-9]+)', 1) || printf('%05d', CAST(floor(doc_id / 40) AS BIGINT)) || '.txt' AS source, doc_id, translate(text, chr(12), ' ') AS text FROM fx_pages)
""",
    "fx_whole_binders": "SELECT source, page, text FROM fx_binders WHERE NOT spoiled",
    "fx_questions": """
SELECT printf('Q%08d-%04d', conv_id, turn) AS query_id, text AS question FROM conversations WHERE role = 'user'
""",
    "fx_all_questions": """
SELECT query_id, question FROM fx_questions
UNION ALL
SELECT printf('S%08d', p_partkey), CASE p_partkey % 5
  WHEN 0 THEN printf('forecast demand for SKU-%06d next month', p_partkey)
  WHEN 1 THEN printf('Is stock of sku-%06d low, when to order?', p_partkey)
  WHEN 2 THEN printf('who is the best supplier for SKU-%06d?', p_partkey)
  WHEN 3 THEN printf('any unusual spike for SKU-%06d?', p_partkey)
  ELSE printf('hello, about SKU-%06d', p_partkey) END FROM part
UNION ALL
SELECT printf('N%08d', n_nationkey), CASE n_nationkey % 5
  WHEN 0 THEN 'which items need reordering in ' || n_name || '?'
  WHEN 1 THEN 'any unusual outlier in ' || n_name
  WHEN 2 THEN 'which vendor serves ' || n_name
  WHEN 3 THEN 'any unusual demand anomalies in ' || n_name || '?'
  ELSE 'hello ' || n_name END FROM nation
""",
    "lags": """
SELECT *, lag(net_units, 1) OVER w AS lag_1, lag(net_units, 3) OVER w AS lag_3, lag(net_units, 6) OVER w AS lag_6,
       lag(net_units, 12) OVER w AS lag_12,
       CASE WHEN count(net_units) OVER p3 = 3 THEN avg(net_units) OVER p3 END AS roll_mean_3,
       CASE WHEN count(net_units) OVER p3 = 3 THEN stddev_samp(net_units) OVER p3 ELSE 0 END AS roll_std_3,
       CASE WHEN count(net_units) OVER p6 = 6 THEN avg(net_units) OVER p6 END AS roll_mean_6
FROM fx_demand
WINDOW w AS (PARTITION BY sku_id ORDER BY period),
       p3 AS (PARTITION BY sku_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       p6 AS (PARTITION BY sku_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
""",
    "growth": f"""
SELECT *, CASE WHEN lag_12 IS NULL THEN 0.0 WHEN lag_12 = 0 AND net_units = 0 THEN 0.0
               WHEN lag_12 = 0 AND net_units > 0 THEN 'inf'::DOUBLE WHEN lag_12 = 0 THEN '-inf'::DOUBLE
               ELSE {r('(net_units - lag_12) / lag_12', 4)} END AS yoy_growth
FROM lags
""",
    "feats": f"""
SELECT *, CAST(month(period) AS INT) AS month, CAST(quarter(period) AS INT) AS quarter,
       {HIGH_SEASON.format(m='month(period)')} AS is_high_season,
       CASE abc_class WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS abc_enc
FROM growth WHERE lag_1 IS NOT NULL
""",
    "arows": "SELECT sku_id, period, product_name, units_sold, net_units, lag_1, roll_mean_3, roll_std_3, is_high_season "
             "FROM feats WHERE roll_mean_3 IS NOT NULL",
    "scored": f"""
SELECT a.*, -{LARGEST_Z} AS anomaly_score, {LARGEST_Z} > 2.5 AS is_anomaly
FROM (SELECT * FROM arows) a, (SELECT {STATS} FROM arows) s
""".replace("abs(", "abs(a."),
    "scored_sku": f"""
SELECT a.*, -{LARGEST_Z} AS anomaly_score, {LARGEST_Z} > 2.5 AS is_anomaly
FROM (SELECT * FROM arows) a JOIN (SELECT sku_id, {STATS} FROM arows GROUP BY sku_id) s USING (sku_id)
""".replace("abs(", "abs(a."),
    "flagged": "SELECT sku_id, product_name, period, net_units, roll_mean_3, anomaly_score FROM scored WHERE is_anomaly",
    "rounded_scores": f"SELECT * REPLACE ({r('anomaly_score', 6)} AS anomaly_score) FROM scored",
    "offers": "SELECT sku_id, supplier_id, supplier_name, lead_time_days, on_time_rate_pct FROM fx_bridge JOIN fx_terms USING (supplier_id)",
    "lead": "SELECT sku_id, arg_min(lead_time_days, supplier_id) AS lead_time_days FROM offers GROUP BY sku_id",
    "ranked": """
SELECT *, on_time_rank - lead_rank AS score FROM (
  SELECT *,
    rank() OVER (PARTITION BY sku_id ORDER BY lead_time_days)
      + (count(*) OVER (PARTITION BY sku_id, lead_time_days) - 1) / 2.0 AS lead_rank,
    rank() OVER (PARTITION BY sku_id ORDER BY on_time_rate_pct)
      + (count(*) OVER (PARTITION BY sku_id, on_time_rate_pct) - 1) / 2.0 AS on_time_rank
  FROM offers)
""",
    "best_supplier": f"""
SELECT sku_id, supplier_count, supplier_id, supplier_name, lead_time_days, on_time_rate_pct, score,
       '🏆 Recommended supplier for ' || sku_id || ': ' || supplier_name || ' (Lead time: ' || lead_time_days
       || ' days, On-time rate: ' || {whole('on_time_rate_pct')} || '%)' AS recommendation
FROM (SELECT *, count(*) OVER (PARTITION BY sku_id) AS supplier_count,
             row_number() OVER (PARTITION BY sku_id ORDER BY score DESC, supplier_id) AS place FROM ranked)
WHERE place = 1 AND supplier_count > 1
""",
    "stats": """
SELECT sku_id, avg(net_units) AS avg_monthly, avg(net_units) / 30.0 AS avg_daily, stddev_pop(net_units) AS std_monthly
FROM fx_demand GROUP BY sku_id
""",
    "newest": "SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY period DESC) AS place FROM fx_demand",
    "recent": """
SELECT sku_id, avg(net_units) FILTER (place <= 3) AS mean_3, stddev_pop(net_units) AS std_6
FROM newest WHERE place <= 6 GROUP BY sku_id
""",
    "points": f"""
SELECT sku_id, CAST(month_offset AS INT) AS month_offset, forecast,
       {r('greatest(0, forecast - 1.64::DOUBLE * std_6)', 1)} AS lower_ci,
       {r('forecast + 1.64::DOUBLE * std_6', 1)} AS upper_ci, 'Rolling Mean (fallback)' AS model
FROM (SELECT *, {r('mean_3', 1)} AS forecast, unnest(range(1, 7)) AS month_offset FROM recent)
""",
    "forecast_texts": f"""
SELECT sku_id, 'Demand forecast for ' || sku_id || ' (next 3 months):' || {NEWLINE} || string_agg(
    '  Month +' || month_offset || ': ' || {whole('forecast')} || ' units  (90% CI: ' || {whole('lower_ci')}
    || ' – ' || {whole('upper_ci')} || ')', {NEWLINE} ORDER BY month_offset) AS forecast_text
FROM points WHERE month_offset <= 3 GROUP BY sku_id
""",
    "top": "SELECT sku_id, avg(net_units) AS avg_units FROM fx_demand GROUP BY sku_id ORDER BY avg_units DESC, sku_id LIMIT 1",
    "split": """
SELECT *, CASE WHEN period <= (SELECT max(period) FROM feats) - INTERVAL 3 MONTH THEN 'train' ELSE 'test' END AS part FROM feats
""",
    "naive": """
SELECT *, roll_mean_3 AS prediction FROM lags
WHERE roll_mean_3 IS NOT NULL AND period > (SELECT max(period) FROM fx_demand) - INTERVAL 3 MONTH
""",
    "rops": """
SELECT sku_id, avg_daily, CAST(coalesce(lead_time_days, 30) AS DOUBLE) AS lead_time_days,
       1.64::DOUBLE * std_monthly AS safety_stock,
       avg_daily * CAST(coalesce(lead_time_days, 30) AS DOUBLE) + 1.64::DOUBLE * std_monthly AS rop,
       CAST(coalesce(total_available, 0) AS DOUBLE) AS current_available
FROM stats LEFT JOIN lead USING (sku_id) LEFT JOIN (SELECT sku_id, total_available FROM fx_inventory) USING (sku_id)
""",
    "rop_texts": f"""
SELECT sku_id, 'ROP Analysis — ' || sku_id || ':' || {NEWLINE} || '  Avg daily demand: ' || {places('avg_daily', 1)}
  || ' units' || {NEWLINE} || '  Lead time: ' || {whole('lead_time_days')} || ' days' || {NEWLINE}
  || '  Safety stock (95% SL): ' || {whole('safety_stock')} || ' units' || {NEWLINE} || '  Computed ROP: ' || {whole('rop')}
  || ' units' || {NEWLINE} || '  Current available: ' || {whole('current_available')} || ' units' || {NEWLINE} || '  '
  || CASE WHEN current_available < rop THEN '⚠️ REORDER NOW' ELSE '✓ Stock OK' END AS rop_text
FROM rops
""",
    "stock_texts": f"""
SELECT sku_id, 'Inventory — ' || sku_id || ' (' || item_name || '):' || {NEWLINE} || '  On-Hand: ' || qty_on_hand
  || '  |  WIP: ' || qty_wip || '  |  In-Transit: ' || qty_in_transit || {NEWLINE} || '  Total Available: ' || total_available
  || '  |  Reorder Point: ' || reorder_point || {NEWLINE} || '  Days of Stock: ' || {places('days_of_stock', 1)}
  || '  |  Status: ' || status || {NEWLINE} || '  Gap vs ROP: ' || {signed('gap')} || ' units  — '
  || CASE WHEN gap <= 0 THEN '⚠️ REORDER NEEDED' ELSE '✓ OK' END AS stock_text
FROM fx_inventory
""",
    "profiles": f"""
SELECT supplier_id, d.supplier_id IS NOT NULL AS in_directory, t.supplier_id IS NOT NULL AS in_terms,
       city, payment_terms, lead_time_days, min_order_qty,
       concat_ws({NEWLINE},
         CASE WHEN d.supplier_id IS NOT NULL THEN 'Supplier: ' || d.supplier_name || ' (' || d.supplier_id || ')' || {NEWLINE}
           || '  City: ' || city || ', ' || state || {NEWLINE} || '  On-time rate: ' || {whole('d.on_time_rate_pct')} || '%'
           || {NEWLINE} || '  Payment terms: ' || payment_terms END,
         CASE WHEN t.supplier_id IS NOT NULL THEN '  Lead time: ' || lead_time_days || ' days' || {NEWLINE} || '  MOQ: '
           || min_order_qty || ' units' || {NEWLINE} || '  Advance: ' || advance_pct || '%' END) AS profile_text
FROM fx_directory d FULL JOIN fx_terms t USING (supplier_id)
""",
    "reorders": f"""
SELECT sku_id, item_name, 'reorder' AS alert_type, {GAP_SEVERITY} AS severity,
       CAST(total_available AS DOUBLE) AS current_stock, CAST(reorder_point AS DOUBLE) AS reorder_point,
       {r('gap', 1)} AS gap,
       'Stock ' || total_available || ' ≤ ROP ' || reorder_point || '. Place order immediately (' || status || ').' AS message
FROM fx_inventory WHERE total_available <= reorder_point
""",
    "anomaly_board": f"""
SELECT sku_id, substring(product_name, 1, 30) AS item_name, 'anomaly' AS alert_type,
       {SCORE_SEVERITY.format(s='anomaly_score')} AS severity, {r('anomaly_score', 4)} AS anomaly_score,
       'Unusual demand in ' || {month('period')} || ': ' || {whole('net_units')} || ' units vs 3M avg '
       || {whole('roll_mean_3')} || '.' AS message, CAST(period AS VARCHAR) AS period
FROM (SELECT * FROM flagged ORDER BY sku_id, period LIMIT 10)
""",
    "board": """
SELECT sku_id, item_name, alert_type, severity, current_stock, reorder_point, gap, message,
       NULL::DOUBLE AS anomaly_score, NULL::VARCHAR AS period FROM reorders
UNION ALL
SELECT sku_id, item_name, alert_type, severity, NULL, NULL, NULL, message, anomaly_score, period FROM anomaly_board
""",
    "cleaned": _cleaned("fx_pages"),
    "cleaned_binders": _cleaned("fx_whole_binders"),
    "chunks": _chunk("cleaned"),
    "collected": """
SELECT *, CASE WHEN doc_type = 'PO' THEN 'purchase_orders' ELSE 'supplier_catalogs' END AS collection FROM chunks
""",
    "shingle_sets": f"""
SELECT chunk_id, source, page, chunk_index, {SHINGLES} AS shingles
FROM (SELECT *, regexp_split_to_array(trim(lower(text), {TRIMMED}), '[{fv.BLANKS}]+') AS words FROM chunks)
""",
    "minhash_values": f"""
SELECT chunk_id, k, min((x * a + b) % {_PRIME}) AS h
FROM (SELECT chunk_id, CAST('0x' || substr(md5(unnest(shingles)), 1, 8) AS BIGINT) % {_PRIME} AS x FROM shingle_sets),
     (SELECT unnest({[pow(48271, 2 * k + 1, _PRIME) for k in _HASHES]}::BIGINT[]) AS a,
             unnest({[pow(48271, 2 * k + 2, _PRIME) for k in _HASHES]}::BIGINT[]) AS b, unnest(range({len(_HASHES)})) AS k)
GROUP BY chunk_id, k
""",
    # Chunks with one shingle set are one content, named by its first chunk.
    "content_keys": """
SELECT chunk_id, row_number() OVER (ORDER BY source, page, chunk_index, chunk_id) AS ord,
       array_to_string(list_sort(shingles), '|') AS set_key, shingles FROM shingle_sets
""",
    "members": """
SELECT *, min(ord) OVER (PARTITION BY set_key) AS content_ord, len(shingles) AS size FROM content_keys
""",
    "content_shingles": "SELECT ord, size, unnest(shingles) AS shingle FROM members WHERE ord = content_ord",
    "content_pairs": """
SELECT a.ord AS later, b.ord AS earlier, count(*) AS shared, any_value(a.size) + any_value(b.size) - count(*) AS united
FROM content_shingles a JOIN content_shingles b ON a.shingle = b.shingle AND b.ord < a.ord
GROUP BY 1, 2 HAVING count(*) * 100 >= (any_value(a.size) + any_value(b.size) - count(*)) * 85
""",
    "first_pairs": "SELECT later, min(earlier) AS earlier, arg_min(shared, earlier) AS shared, arg_min(united, earlier) AS united "
                   "FROM content_pairs GROUP BY later",
    "token_rows": f"SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest({WORDS.format(t='text')}) AS token FROM chunks) GROUP BY 1, 2",
    "idf": """
SELECT token, ln((1.0::DOUBLE + (SELECT count(*) FROM chunks)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
FROM token_rows GROUP BY token
""",
    "index_rows": """
SELECT chunk_id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) AS weight,
       CAST(floor(raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS units
FROM (SELECT chunk_id, token, tf * idf AS raw FROM token_rows JOIN idf USING (token))
""",
}


def _search(queries: str, prefix: str) -> dict[str, str]:
    """Views that score (query_id, search_text) rows against all chunks."""
    return {
        f"{prefix}_tokens": f"""
SELECT query_id, token, CAST(floor(raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS units
FROM (SELECT query_id, token, count(*) * any_value(idf) AS raw
      FROM (SELECT query_id, unnest({WORDS.format(t='search_text')}) AS token FROM {queries}) JOIN idf USING (token)
      GROUP BY query_id, token)
""",
        f"{prefix}_scores": f"""
SELECT query_id, chunk_id, sum(q.units::HUGEINT * i.units) AS exact, {r('CAST(sum(q.units::HUGEINT * i.units) AS DOUBLE) / 1e18::DOUBLE', 6)} AS score
FROM {prefix}_tokens q JOIN index_rows i USING (token) GROUP BY query_id, chunk_id
""",
    }


def _retrieval(queries: str, prefix: str, order: str) -> dict[str, str]:
    """Views that merge purchase-order and catalog hits of (query_id, search_text, search_type, search_k) rows."""
    return {
        f"{prefix}_hits": f"""
SELECT * FROM (
  SELECT query_id, chunk_id, score, exact, search_k, CASE collection WHEN 'purchase_orders' THEN 0 ELSE 1 END AS source_rank,
         row_number() OVER (PARTITION BY query_id, collection ORDER BY exact DESC, chunk_id) AS rank
  FROM {prefix}_scores JOIN (SELECT chunk_id, collection FROM collected) USING (chunk_id) JOIN {queries} USING (query_id)
  WHERE search_type = 'all' OR (search_type = 'PO') = (collection = 'purchase_orders'))
WHERE rank <= search_k
""",
        f"{prefix}_merged": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS place FROM {prefix}_hits)
WHERE place <= search_k
""",
        f"{prefix}_contexts": f"""
SELECT query_id, coalesce(context, 'No relevant documents found.') AS context
FROM {queries} LEFT JOIN (
  SELECT query_id, string_agg('[Source ' || place || ': ' || source || ' — Page ' || page || ']' || {NEWLINE} || text,
                              {NEWLINE} || {NEWLINE} || '---' || {NEWLINE} || {NEWLINE} ORDER BY place) AS context
  FROM {prefix}_merged JOIN (SELECT chunk_id, source, page, text FROM chunks) USING (chunk_id) GROUP BY query_id) USING (query_id)
""",
    }


VIEWS["searches"] = "SELECT query_id, question AS search_text FROM fx_questions"
VIEWS["typed"] = """
SELECT *, CASE length(search_text) % 3 WHEN 0 THEN 'PO' WHEN 1 THEN 'catalog' ELSE 'all' END AS search_type,
       CASE length(search_text) % 3 WHEN 2 THEN 4 ELSE 3 END AS search_k FROM searches
"""
VIEWS.update(_search("searches", "plain"))
VIEWS.update(_search("typed", "typed"))
VIEWS.update(_retrieval("typed", "typed", "source_rank, rank"))
VIEWS["intent_scores"] = f"SELECT query_id, question, {_scores()} FROM fx_all_questions"
_BEST = "greatest(demand_score, reorder_score, supplier_score, anomaly_score)"
VIEWS["classified"] = f"""
SELECT query_id, question,
       CASE WHEN {_BEST} = 0 THEN 'general' WHEN demand_score = {_BEST} THEN 'demand'
            WHEN reorder_score = {_BEST} THEN 'reorder' WHEN supplier_score = {_BEST} THEN 'supplier'
            ELSE 'anomaly' END AS intent,
       upper(regexp_extract(question, '(?i){SKU_IN_TEXT}', 0)) AS sku_id
FROM intent_scores
"""
VIEWS["routed"] = """
SELECT *, CASE WHEN sku_id = '' AND handler = 'demand' THEN (SELECT sku_id FROM top) ELSE sku_id END AS target_sku
FROM (SELECT *, CASE intent WHEN 'general' THEN 'demand' ELSE intent END AS handler FROM classified)
"""
VIEWS["asked"] = """
SELECT *, CASE handler
    WHEN 'demand' THEN 'demand history seasonal sales ' || target_sku
    WHEN 'reorder' THEN CASE WHEN target_sku <> '' THEN 'purchase order ' || target_sku || ' reorder' ELSE 'low stock reorder' END
    WHEN 'supplier' THEN 'supplier catalog pricing terms ' || target_sku || ' ' || substring(question, 1, 60)
    ELSE 'unusual demand spike stockout ' || target_sku || ' ' || substring(question, 1, 40) END AS search_text,
  CASE handler WHEN 'anomaly' THEN 4 ELSE 3 END AS search_k,
  CASE handler WHEN 'supplier' THEN 'catalog' WHEN 'anomaly' THEN 'all' ELSE 'PO' END AS search_type
FROM routed
"""
VIEWS.update(_search("asked", "asked"))
VIEWS.update(_retrieval("asked", "asked", "source_rank, rank"))
VIEWS["scan_lines"] = f"""
SELECT sku_id, '  • ' || sku_id || ' (' || item_name || '): Available=' || total_available || '  ROP=' || reorder_point
  || '  Gap=' || {signed('gap')} AS line
FROM fx_inventory WHERE gap <= 0
"""
VIEWS["sku_anomaly_texts"] = f"""
SELECT sku_id, 'Anomalies detected for ' || sku_id || ':' || {NEWLINE} || string_agg(
    '  ' || {month('period')} || ': ' || {whole('net_units')} || ' units sold (3-month avg: ' || {whole('roll_mean_3')}
    || '), score: ' || {places('anomaly_score', 3)}, {NEWLINE} ORDER BY period) AS anomaly_text
FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY period) AS place FROM scored_sku WHERE is_anomaly)
WHERE place <= 5 GROUP BY sku_id
"""
VIEWS["anomaly_scan"] = f"""
SELECT CASE WHEN (SELECT count(*) FROM flagged) = 0 THEN '✓ No anomalies detected across all SKUs.' ELSE
  '🚨 ' || (SELECT count(*) FROM flagged) || ' anomalous data point(s) detected:' || {NEWLINE} || {NEWLINE} || string_agg(
    '  • ' || sku_id || ' (' || substring(product_name, 1, 20) || ') | Period: ' || {month('period')} || ' | Units: '
    || {whole('net_units')} || ' | 3M-Avg: ' || {whole('roll_mean_3')} || ' | Score: ' || {places('anomaly_score', 3)},
    {NEWLINE} ORDER BY sku_id, period) END AS scan_text
FROM (SELECT * FROM flagged ORDER BY sku_id, period LIMIT 8)
"""
VIEWS["supplier_texts"] = f"""
SELECT sku_id, concat_ws({NEWLINE} || {NEWLINE}, texts, recommendation) AS supplier_text
FROM (SELECT sku_id, string_agg(profile_text, {NEWLINE} || {NEWLINE} ORDER BY supplier_id) AS texts
      FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY supplier_id) AS place FROM offers)
      JOIN (SELECT supplier_id, profile_text FROM profiles) USING (supplier_id) WHERE place <= 3 GROUP BY sku_id)
LEFT JOIN (SELECT sku_id, recommendation FROM best_supplier) USING (sku_id)
"""
VIEWS["listed_offers"] = """
SELECT supplier_id, t.supplier_name, t.lead_time_days, t.on_time_rate_pct
FROM (SELECT supplier_id FROM fx_directory ORDER BY supplier_id LIMIT 5) LEFT JOIN fx_terms t USING (supplier_id)
"""
VIEWS["listed_best"] = f"""
SELECT '🏆 Recommended supplier for : ' || supplier_name || ' (Lead time: ' || lead_time_days || ' days, On-time rate: '
       || {whole('on_time_rate_pct')} || '%)' AS recommendation
FROM (SELECT *, rank() OVER (ORDER BY on_time_rate_pct) + (count(*) OVER (PARTITION BY on_time_rate_pct) - 1) / 2.0
      - rank() OVER (ORDER BY lead_time_days) - (count(*) OVER (PARTITION BY lead_time_days) - 1) / 2.0 AS score,
      count(*) OVER () AS suppliers
      FROM listed_offers WHERE lead_time_days IS NOT NULL)
WHERE suppliers > 1 ORDER BY score DESC, supplier_id LIMIT 1
"""
VIEWS["listed_text"] = f"""
SELECT concat_ws({NEWLINE} || {NEWLINE},
  (SELECT string_agg(profile_text, {NEWLINE} || {NEWLINE} ORDER BY supplier_id)
   FROM (SELECT supplier_id, profile_text FROM profiles JOIN listed_offers USING (supplier_id) ORDER BY supplier_id LIMIT 3)),
  (SELECT recommendation FROM listed_best)) AS listed_text
"""


def sql(body: str) -> str:
    """``body`` with the views it uses, directly or through others, as common table expressions."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    visit(body)
    if not wanted:
        return body
    parts = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in wanted)
    return f"WITH {parts} {body}"


_P = "CAST(period AS VARCHAR) AS period"

_BODIES = {
    "scan_demand": f"SELECT sku_id, {_P}, product_name, abc_class, channel, units_sold, units_returned, net_units, {r('revenue', 2)} AS revenue_inr FROM fx_demand",
    "scan_inventory": "SELECT * EXCLUDE (gap) FROM fx_inventory",
    "scan_supplier_terms": "SELECT supplier_id, lead_time_days, min_order_qty, sku_id FROM fx_terms LEFT JOIN fx_bridge USING (supplier_id)",
    "scan_supplier_directory": "SELECT * FROM fx_directory",
    "scan_purchase_orders": "SELECT po_number, CAST(po_date AS VARCHAR) AS po_date, supplier_id, sku_id, qty_ordered, rate_per_unit AS rate_per_unit_inr FROM fx_po",
    "scan_sales_invoices": "SELECT 'INV-' || o_orderkey AS invoice_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS invoice_date, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status, o_totalprice AS total_inr FROM orders",
    "scan_documents": """
SELECT source, page, length(text) AS n_chars, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS reason FROM cleaned_binders
UNION ALL SELECT DISTINCT source, NULL, NULL, NULL, 'not UTF-8 text' FROM fx_binders WHERE spoiled""",
    "explode_catalog": """
SELECT DISTINCT printf('SUP-%05d', l_suppkey) AS supplier_id, CAST(floor(l_partkey / 50) AS BIGINT) AS catalog_no,
       printf('SKU-%06d', l_partkey) AS sku, p_name AS name, p_size * 10 AS moq, p_retailprice AS price, 'Pcs' AS unit
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sink_features": f"SELECT sku_id, {_P}, CAST(year(period) AS INT) AS year, net_units, lag_1, {r('roll_mean_3', 4)} AS roll_mean_3, abc_enc FROM feats",
    "sink_metrics": f"SELECT 'naive' AS run, '3' AS months, {r('sqrt(avg((net_units - prediction) * (net_units - prediction)))', 4)} AS rmse FROM naive",
    "chunk_upsert": """
SELECT chunk_id, CASE WHEN labelled THEN 2 ELSE 1 END AS version,
       md5(CASE WHEN labelled THEN lower(text) ELSE text END) AS text_md5
FROM (SELECT *, regexp_extract(source, '_(\\d+)\\.pdf$', 1)::BIGINT IN (SELECT doc_id FROM labels) AS labelled FROM chunks)""",
    "collection_count": "SELECT collection, count(*) AS chunk_count FROM collected GROUP BY collection",
    "filter_sku": f"SELECT sku_id, {_P}, net_units FROM fx_demand WHERE sku_id = 'SKU-000042'",
    "reorder_scan": "SELECT sku_id, item_name, total_available, reorder_point, status, CAST(gap AS DOUBLE) AS gap FROM fx_inventory WHERE gap <= 0",
    "stock_check": "SELECT sku_id, item_name, total_available, reorder_point, CAST(gap AS DOUBLE) AS gap, gap <= 0 AS needs_reorder, stock_text FROM fx_inventory JOIN stock_texts USING (sku_id)",
    "reorder_severity": "SELECT sku_id, gap, severity FROM reorders",
    "anomaly_severity": f"SELECT *, {SCORE_SEVERITY.format(s='decision')} AS severity FROM (SELECT sku_id, {_P}, {r('anomaly_score / 10.0', 4)} AS decision FROM rounded_scores)",
    "stock_table": f"SELECT sku_id, item_name, qty_on_hand, total_available, reorder_point, {r('gap')} AS gap_vs_rop, days_of_stock, status, CASE WHEN contains(status, 'Critical') THEN 'critical' WHEN contains(status, 'Low') THEN 'low' ELSE 'ok' END AS status_level FROM fx_inventory",
    "calendar_flags": f"SELECT sku_id, {_P}, CAST(month(period) AS INT) AS month, CAST(quarter(period) AS INT) AS quarter, {HIGH_SEASON.format(m='month(period)')} AS is_high_season FROM fx_demand",
    "abc_encode": "SELECT sku_id, abc_class, CASE abc_class WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS abc_enc FROM fx_inventory",
    "drop_missing": f"SELECT sku_id, {_P}, net_units, lag_1, lag_3, lag_6 FROM lags WHERE lag_6 IS NOT NULL",
    "clip_negative": f"SELECT sku_id, {_P}, net_units - lag_1 AS change, greatest(net_units - lag_1, 0) AS clipped FROM lags WHERE lag_1 IS NOT NULL",
    "po_pricing": f"""
SELECT po_number, supplier_id, subtotal, gst, {r('subtotal + gst', 2)} AS total, delivery_date FROM (
  SELECT *, {r('subtotal * 0.18::DOUBLE', 2)} AS gst FROM (
    SELECT po_number, supplier_id, {r('qty_ordered * rate_per_unit', 2)} AS subtotal,
           CAST(po_date + CAST(coalesce(lead_time_days, 30) + CAST(qty_ordered AS BIGINT) % 16 - 5 AS INT) AS VARCHAR) AS delivery_date
    FROM fx_po LEFT JOIN fx_terms USING (supplier_id)))""",
    "request_filter": "SELECT conv_id, turn, conv_id % 14 AS horizon, length(text) BETWEEN 3 AND 500 AND conv_id % 14 BETWEEN 1 AND 12 AS valid_for_one, length(text) BETWEEN 3 AND 500 AND conv_id % 14 BETWEEN 1 AND 6 AS valid_for_all FROM conversations",
    "supplier_terms_join": "SELECT t.*, city, state, payment_terms FROM fx_terms t LEFT JOIN fx_directory d USING (supplier_id)",
    "supplier_profile": "SELECT * FROM profiles",
    "sku_suppliers": "SELECT supplier_id, sku_id, supplier_name, lead_time_days, on_time_rate_pct FROM offers",
    "sku_lead_time": "SELECT * FROM lead",
    "sku_stock_lookup": "SELECT sku_id, CAST(coalesce(total_available, 0) AS DOUBLE) AS current_available FROM (SELECT DISTINCT printf('SKU-%06d', l_partkey + 100) AS sku_id FROM lineitem) LEFT JOIN fx_inventory USING (sku_id)",
    "sku_status_default": "SELECT sku_id, CAST(coalesce(total_available, 0) AS DOUBLE) AS current_available, CAST(coalesce(lead_time_days, 30) AS DOUBLE) AS lead_time_days FROM (SELECT DISTINCT printf('SKU-%06d', l_partkey + 100) AS sku_id FROM lineitem) LEFT JOIN fx_inventory USING (sku_id) LEFT JOIN lead USING (sku_id)",
    "semi_join_topk": "SELECT po_number, sku_id, qty_ordered FROM fx_po WHERE sku_id IN (SELECT sku_id FROM fx_demand GROUP BY sku_id ORDER BY sum(net_units) DESC, sku_id LIMIT 5)",
    "period_sku_grid": f"""
SELECT sku_id, CAST(g.period AS VARCHAR) AS period, abc_class, units_sold, units_returned, net_units
FROM (SELECT sku_id, abc_class, CAST(unnest(generate_series((SELECT min(period) FROM fx_demand), (SELECT max(period) FROM fx_demand), INTERVAL 1 MONTH)) AS DATE) AS period
      FROM (SELECT sku_id, arg_min(abc_class, period) AS abc_class FROM fx_demand GROUP BY sku_id)) g
LEFT JOIN (SELECT sku_id, period, units_sold, units_returned, net_units FROM fx_demand) USING (sku_id, period)""",
    "sku_summary": f"SELECT sku_id, sum(net_units) AS total_units, {r('avg(net_units)', 4)} AS avg_monthly, {r('stddev_samp(net_units)', 4)} AS std_dev, count(period) AS periods FROM fx_demand GROUP BY sku_id",
    "abc_units": "SELECT sku_id, abc_class, sum(net_units) AS net_units FROM fx_demand GROUP BY 1, 2",
    "abc_counts": "SELECT abc_class, count(*) AS sku_count FROM (SELECT sku_id, arg_min(abc_class, period) AS abc_class FROM fx_demand GROUP BY sku_id) GROUP BY abc_class",
    "sku_demand_stats": f"SELECT sku_id, {r('avg_monthly', 4)} AS avg_monthly, {r('avg_daily', 4)} AS avg_daily, {r('std_monthly', 4)} AS std_monthly FROM stats",
    "recent_stats": f"SELECT sku_id, {r('mean_3', 4)} AS mean_3, {r('std_6', 4)} AS std_6 FROM recent",
    "top_sku": f"SELECT sku_id, {r('avg_units', 4)} AS avg_units FROM top",
    "distinct_skus": "SELECT 'sku_id' AS \"column\", count(DISTINCT sku_id) AS distinct_values FROM fx_demand UNION ALL SELECT 'channel', count(DISTINCT channel) FROM fx_demand",
    "null_profile": f"""
SELECT 'demand' AS table_name, row_count, missing AS missing_cells, {r('missing * 100.0::DOUBLE / (row_count * 12)', 4)} AS missing_pct
FROM (SELECT count(*) AS row_count, CAST(sum((lag_1 IS NULL)::INT + (lag_3 IS NULL)::INT + (lag_6 IS NULL)::INT) AS BIGINT) AS missing FROM lags)
UNION ALL SELECT 'inventory', count(*), 0, 0.0 FROM fx_inventory
UNION ALL SELECT 'orders', count(*), 0, 0.0 FROM fx_po""",
    "alert_counts": "SELECT count(*) AS total_alerts, count(*) FILTER (alert_type = 'reorder') AS reorder_alerts, count(*) FILTER (alert_type = 'anomaly') AS anomaly_alerts FROM board",
    "anomaly_rate": f"SELECT count(*) AS row_count, count(*) FILTER (is_anomaly) AS flagged, {r('avg(is_anomaly::INT) * 100.0::DOUBLE', 4)} AS flagged_pct FROM scored",
    "rmse": f"SELECT abc_class, {r('sqrt(avg((net_units - lag_1) * (net_units - lag_1)))', 4)} AS rmse FROM lags WHERE lag_1 IS NOT NULL GROUP BY abc_class",
    "mape": f"SELECT abc_class, {r('avg(abs(units_sold - lag_1) / greatest(abs(units_sold), 2.220446049250313e-16)) * 100.0::DOUBLE', 4)} AS mape FROM lags WHERE lag_1 IS NOT NULL GROUP BY abc_class",
    "standardize": "SELECT sku_id, " + _P + ", " + ", ".join(
        r(f"({c} - (SELECT avg({c}) FROM feats)) / (SELECT CASE stddev_pop({c}) WHEN 0 THEN 1 ELSE stddev_pop({c}) END FROM feats)", 6) + f" AS {c}_z"
        for c in ("net_units", "lag_1", "roll_std_3")) + " FROM feats",
    "score_histogram": """
SELECT CAST(least(floor((anomaly_score - low) / ((high - low) / 40.0::DOUBLE)), 39) AS INT) AS bin, is_anomaly, count(*) AS row_count
FROM rounded_scores, (SELECT min(anomaly_score) AS low, max(anomaly_score) AS high FROM rounded_scores) GROUP BY 1, 2""",
    "lag_features": f"SELECT sku_id, {_P}, lag_1, lag_3, lag_6 FROM lags",
    "roll_mean_3": f"SELECT sku_id, {_P}, {r('roll_mean_3', 4)} AS roll_mean_3 FROM lags",
    "roll_std_3": f"SELECT sku_id, {_P}, {r('roll_std_3', 4)} AS roll_std_3 FROM lags",
    "roll_mean_6": f"SELECT sku_id, {_P}, {r('roll_mean_6', 4)} AS roll_mean_6 FROM lags",
    "yoy_growth": f"SELECT sku_id, {_P}, yoy_growth FROM growth",
    "sku_features": f"SELECT sku_id, {_P}, net_units, lag_1, lag_3, lag_6, {r('roll_mean_3', 4)} AS roll_mean_3, {r('roll_std_3', 4)} AS roll_std_3, {r('roll_mean_6', 4)} AS roll_mean_6, yoy_growth, month, quarter, abc_enc, is_high_season FROM feats",
    "supplier_rank": "SELECT sku_id, supplier_id, lead_rank, on_time_rank, score FROM ranked",
    "last_row_per_sku": f"SELECT sku_id, {_P}, net_units, lag_1, {r('roll_mean_3', 4)} AS roll_mean_3 FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY period DESC) AS place FROM feats) WHERE place = 1",
    "history_tail": f"SELECT sku_id, {_P}, net_units, place FROM newest WHERE place <= 12",
    "sort_sku_period": f"SELECT sku_id, {_P}, net_units FROM fx_demand ORDER BY sku_id, fx_demand.period",
    "top5_series": f"SELECT sku_id, {_P}, net_units FROM fx_demand WHERE sku_id IN (SELECT sku_id FROM fx_demand GROUP BY sku_id ORDER BY sum(net_units) DESC, sku_id LIMIT 5)",
    "supplier_performance": "SELECT supplier_id, supplier_name, on_time_rate_pct FROM fx_directory ORDER BY on_time_rate_pct DESC, supplier_id",
    "alerts_order": "SELECT sku_id, alert_type, severity FROM board",
    "anomaly_cap": f"SELECT sku_id, {_P}, place, {r('anomaly_score', 4)} AS anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY period) AS place FROM flagged) WHERE place <= 5",
    "anomaly_scan_cap": f"SELECT sku_id, {_P}, {r('anomaly_score', 4)} AS anomaly_score FROM (SELECT * FROM flagged ORDER BY sku_id, period LIMIT 8)",
    "top_anomalies": f"SELECT sku_id, product_name, {_P}, net_units, {r('roll_mean_3', 4)} AS roll_mean_3, anomaly_score FROM (SELECT * FROM rounded_scores WHERE is_anomaly ORDER BY anomaly_score, sku_id, period LIMIT 10)",
    "supplier_cap": "SELECT sku_id, supplier_id, place FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY supplier_id) AS place FROM offers) WHERE place <= 3",
    "supplier_list": "SELECT * FROM fx_directory ORDER BY supplier_id LIMIT 5",
    "union_alerts": "SELECT * FROM board",
    "distinct_rows": "SELECT DISTINCT sku_id, product_name, abc_class FROM fx_demand",
    "scalar_string": f"""
SELECT conv_id, turn, md5(lower(text)) AS lower_md5, md5(upper(role)) AS upper_md5, starts_with(text, 'The') AS starts,
       contains(text, 'er') AS holds, substring(trim(text, {TRIMMED}), 1, 60) AS prefix,
       len(string_split(text, ' ')) AS word_count, md5(array_to_string(string_split(text, ' '), '; ')) AS joined_md5,
       regexp_replace(text, '[ \\n]+', ' ', 'g') AS collapsed
FROM conversations""",
    "scalar_date": """
SELECT o_orderkey, strftime(d, '%d-%m-%Y') AS day_text, CAST(d AS VARCHAR) AS parsed,
       CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start,
       CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, strftime(d, '%b') AS month_name,
       strftime(d, '%Y-%m') AS year_month, CAST(d + 45 AS VARCHAR) AS plus_45,
       CAST(CAST(d - INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS minus_3_months
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "scalar_format": f"""
SELECT sku_id, {whole('total_available')} AS whole, {signed('gap')} AS signed, {places('days_of_stock / 7.0::DOUBLE', 3)} AS three_places,
       printf('SYN-%05d', qty_on_hand) AS padded, CAST(CAST(sqrt(abs(gap)) AS DECIMAL(18,4)) AS VARCHAR) AS root,
       greatest(gap, 0) AS clipped, {HIGH_SEASON.format(m='qty_wip')} AS season_flag
FROM fx_inventory""",
    "clean_text": None,
    "doc_type": "SELECT DISTINCT source, doc_type FROM chunks",
    "chunk_documents": "SELECT chunk_id, chunk_index, doc_type, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks",
    "chunk_id": "SELECT chunk_id, source, page, chunk_index, collection FROM collected",
    "chunk_id_dedup": "SELECT chunk_id, chunk_index, md5(text) AS text_md5 FROM chunks",
    "minhash_signature": "SELECT chunk_id, CAST(count(*) AS INT) AS width, md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY k)) AS signature_md5 FROM minhash_values GROUP BY chunk_id",
    "shingles": "SELECT chunk_id, md5(unnest(shingles)) AS shingle_md5 FROM shingle_sets",
    "near_dup_pairs": """
SELECT m.chunk_id, coalesce(p.chunk_id, c.chunk_id) AS match_id, coalesce(f.shared, m.size) AS shared, coalesce(f.united, m.size) AS united
FROM members m JOIN members c ON c.ord = m.content_ord
LEFT JOIN first_pairs f ON f.later = m.content_ord LEFT JOIN members p ON p.ord = f.earlier
WHERE f.later IS NOT NULL OR m.ord <> m.content_ord""",
    "dedup_keep_first": None,
    "embed_chunks": f"SELECT chunk_id, token, {r('weight', 6)} AS weight FROM index_rows",
    "knn_join": None,
    "filtered_knn": None,
    "text_retrieve": "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, chunk_id) AS rank FROM plain_scores) WHERE rank <= 5",
    "retrieve": "SELECT query_id, place, chunk_id, score FROM typed_merged",
    "retrieve_by_distance": """
SELECT query_id, place, chunk_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, source_rank, rank) AS place FROM typed_hits)
WHERE place <= search_k""",
    "format_context": "SELECT query_id, length(context) AS n_chars, md5(context) AS context_md5 FROM typed_contexts",
    "forecast_fallback": "SELECT * FROM points WHERE month_offset <= 3",
    "forecast_all": "SELECT * FROM points",
    "forecast_points": "SELECT * FROM points",
    "forecast_text": "SELECT * FROM forecast_texts",
    "forecast_bands": f"SELECT sku_id, {r('greatest(0, avg_monthly - 1.64::DOUBLE * std_monthly)', 1)} AS lower_ci, {r('avg_monthly + 1.64::DOUBLE * std_monthly', 1)} AS upper_ci FROM stats",
    "cv_folds": """
SELECT fold, part, count(*) AS row_count, CAST(min(period) AS VARCHAR) AS first_period, CAST(max(period) AS VARCHAR) AS last_period
FROM (SELECT f.period, fold, CASE WHEN i < total - (4 - fold) * (total // 4) THEN 'train'
                                  WHEN i < total - (3 - fold) * (total // 4) THEN 'test' END AS part
      FROM feats f JOIN (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS total
                         FROM (SELECT DISTINCT period FROM feats)) p USING (period),
           (SELECT CAST(unnest(range(1, 4)) AS INT) AS fold))
WHERE part IS NOT NULL GROUP BY fold, part""",
    "cv_folds_by_row": """
SELECT fold, part, count(*) AS row_count, min(sku_id) AS first_sku, max(sku_id) AS last_sku
FROM (SELECT sku_id, fold, CASE WHEN i < total - (4 - fold) * (total // 4) THEN 'train'
                                WHEN i < total - (3 - fold) * (total // 4) THEN 'test' END AS part
      FROM (SELECT sku_id, row_number() OVER (ORDER BY sku_id, period) - 1 AS i, count(*) OVER () AS total FROM feats),
           (SELECT CAST(unnest(range(1, 4)) AS INT) AS fold))
WHERE part IS NOT NULL GROUP BY fold, part""",
    "holdout_split": f"SELECT sku_id, {_P}, part FROM split",
    "naive_eval": f"SELECT count(*) AS row_count, {r('sqrt(avg((net_units - prediction) * (net_units - prediction)))', 4)} AS rmse, {r('avg(abs(units_sold - prediction) / greatest(abs(units_sold), 2.220446049250313e-16)) * 100.0::DOUBLE', 4)} AS mape FROM naive",
    "actual_vs_pred": f"SELECT sku_id, {_P}, net_units, {r('greatest(prediction, 0)', 4)} AS prediction FROM naive WHERE sku_id = (SELECT sku_id FROM top)",
    "anomaly_features": f"SELECT sku_id, {_P}, product_name, net_units, lag_1, {r('roll_mean_3', 4)} AS roll_mean_3, {r('roll_std_3', 4)} AS roll_std_3, is_high_season FROM arows",
    "zscore_anomaly": f"SELECT sku_id, {_P}, {r('anomaly_score', 6)} AS anomaly_score, is_anomaly FROM scored",
    "zscore_per_sku": f"SELECT sku_id, {_P}, {r('anomaly_score', 6)} AS anomaly_score, is_anomaly FROM scored_sku",
    "detect_anomalies": f"SELECT sku_id, product_name, {_P}, net_units, {r('roll_mean_3', 4)} AS roll_mean_3, {r('anomaly_score', 6)} AS anomaly_score FROM flagged",
    "contamination_sweep": " UNION ALL ".join(
        f"SELECT {level}::DOUBLE AS contamination, count(*) FILTER (anomaly_score < q) AS flagged, {r('count(*) FILTER (anomaly_score < q) * 100.0::DOUBLE / count(*)', 1)} AS flagged_pct FROM rounded_scores, (SELECT quantile_cont(anomaly_score, {level}) AS q FROM rounded_scores)"
        for level in fv.CONTAMINATION_LEVELS),
    "anomaly_overlay": f"SELECT sku_id, {_P}, net_units, is_anomaly FROM scored WHERE sku_id = (SELECT sku_id FROM top)",
    "rop": f"SELECT sku_id, {r('avg_daily', 4)} AS avg_daily, lead_time_days, {r('safety_stock', 4)} AS safety_stock, {r('rop', 4)} AS rop, current_available, current_available < rops.rop AS reorder_now FROM rops",
    "rop_text": "SELECT * FROM rop_texts",
    "reorder_alerts": "SELECT * FROM reorders",
    "reorder_scan_lines": "SELECT * FROM scan_lines",
    "anomaly_alerts": "SELECT * FROM anomaly_board",
    "alerts": "SELECT * FROM board",
    "supplier_recommend": "SELECT * FROM best_supplier",
    "sku_extract": f"SELECT query_id, upper(regexp_extract(question, '(?i){SKU_IN_TEXT}', 0)) AS sku_id, upper(regexp_extract(question, '(?i){fv.SKU_PATTERN}', 0)) AS default_sku_id FROM fx_all_questions",
    "intent_score": "SELECT * EXCLUDE (question) FROM intent_scores",
    "classify_intent": "SELECT query_id, intent, sku_id FROM classified",
    "route": "SELECT query_id, handler, target_sku FROM routed",
    "rag_query_text": "SELECT query_id, search_text, search_k, search_type FROM asked",
    "answer_queries": f"""
SELECT query_id, question, intent, a.sku_id, length(context) > 0 AS context_used, CASE handler
  WHEN 'demand' THEN trim('📊 Demand Forecast — ' || target_sku || {NEWLINE} || {NEWLINE}
       || coalesce(forecast_text, 'No forecast data available for SKU ' || target_sku || '.') || {NEWLINE} || {NEWLINE}
       || '📄 Historical Context:' || {NEWLINE} || substring(context, 1, 400), {TRIMMED})
  WHEN 'reorder' THEN CASE WHEN target_sku = '' THEN
       CASE WHEN (SELECT count(*) FROM scan_lines) = 0 THEN '✓ All SKUs are above their reorder points. No immediate action needed.'
            ELSE '⚠️  ' || (SELECT count(*) FROM scan_lines) || ' SKU(s) at or below reorder point:' END
       ELSE coalesce(stock_text, 'SKU ' || target_sku || ' not found in inventory.') || {NEWLINE} || {NEWLINE}
            || coalesce(rop_text, 'No demand history for ' || target_sku || '.') END
  WHEN 'supplier' THEN CASE WHEN target_sku = '' THEN (SELECT listed_text FROM listed_text)
       ELSE coalesce(supplier_text, 'No supplier mapping found for the specified SKU.') END
  ELSE '🔍 Anomaly Analysis' || {NEWLINE} || {NEWLINE}
       || CASE WHEN target_sku = '' THEN (SELECT scan_text FROM anomaly_scan)
               ELSE coalesce(anomaly_text, 'No anomalies detected for SKU ' || target_sku || '.') END
       || CASE WHEN context = 'No relevant documents found.' THEN ''
               ELSE {NEWLINE} || {NEWLINE} || '📄 Historical Context:' || {NEWLINE} || substring(context, 1, 500) END
  END AS answer
FROM asked a JOIN asked_contexts USING (query_id)
LEFT JOIN forecast_texts f ON f.sku_id = target_sku LEFT JOIN stock_texts s ON s.sku_id = target_sku
LEFT JOIN rop_texts p ON p.sku_id = target_sku LEFT JOIN supplier_texts u ON u.sku_id = target_sku
LEFT JOIN sku_anomaly_texts n ON n.sku_id = target_sku""",
}

_BODIES["clean_text"] = "SELECT source, page, length(text) AS n_chars, md5(text) AS text_md5 FROM loose_cleaned"
VIEWS["loose"] = """
SELECT source, page, chr(10) || ' ' || regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\\. ', '.   ', 'g')
       || '  ' || chr(10) AS text FROM fx_pages
"""
VIEWS["loose_cleaned"] = _cleaned("loose")


def _nearest(condition: str) -> str:
    distance = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
    return f"""
SELECT query_id, vec_id, distance, rank FROM (
  SELECT query_id, vec_id, {r('d', 6)} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {distance} AS d
        FROM embeddings q JOIN embeddings e ON {condition}))
WHERE rank <= 5"""


_BODIES["knn_join"] = _nearest("true")
_BODIES["filtered_knn"] = _nearest("q.label = e.label")

_DENSE = "(ascii(left(w, 1)) * 31 + ascii(right(w, 1)) * 7 + length(w)) % 64"


def _counted(source: str, key: str) -> str:
    words = f"SELECT {key}, unnest(string_split(text, ' ')) AS w FROM {source}"
    return f"SELECT {key}, {_DENSE} AS d, count(*) AS n FROM ({words}) WHERE w <> '' GROUP BY 1, 2"


VIEWS["dense_chunks"] = _counted("chunks", "chunk_id")
VIEWS["dense_queries"] = _counted("(SELECT query_id, search_text AS text FROM searches)", "query_id")
_BODIES["retrieve_dense"] = f"""
SELECT query_id, chunk_id, CAST(distance AS DOUBLE) AS distance, rank FROM (
  SELECT query_id, chunk_id, q2 + c2 - 2 * coalesce(common, 0) AS distance,
         row_number() OVER (PARTITION BY query_id ORDER BY q2 + c2 - 2 * coalesce(common, 0), chunk_id) AS rank
  FROM (SELECT s.query_id, coalesce(q2, 0) AS q2 FROM searches s LEFT JOIN (SELECT query_id, sum(n * n) AS q2 FROM dense_queries GROUP BY 1) USING (query_id))
  CROSS JOIN (SELECT chunk_id, sum(n * n) AS c2 FROM dense_chunks GROUP BY 1)
  LEFT JOIN (SELECT query_id, chunk_id, sum(q.n * c.n) AS common FROM dense_queries q JOIN dense_chunks c USING (d) GROUP BY 1, 2) USING (query_id, chunk_id))
WHERE rank <= 3"""

# The greedy pass walks over the contents that have a similar one, in order, and keeps a list of the kept.
VIEWS["walk_nodes"] = """
SELECT ord, row_number() OVER (ORDER BY ord) AS step,
       (SELECT list(earlier) FROM content_pairs WHERE later = ord) AS before
FROM (SELECT later AS ord FROM content_pairs UNION SELECT earlier FROM content_pairs)
"""
_DROPPED = """
SELECT ord FROM walk_nodes WHERE NOT list_contains((SELECT kept FROM walk ORDER BY step DESC LIMIT 1), ord)"""


def _greedy(last: str) -> str:
    """``last`` after a walk; it may use ``members``, ``walk_nodes`` and ``walk``."""
    body = "SELECT * FROM members JOIN walk_nodes JOIN collected"
    prefix = sql(body).removesuffix(body).replace("WITH ", "WITH RECURSIVE ", 1)
    walk = """, walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT n.step, CASE WHEN n.before IS NOT NULL AND list_has_any(n.before, w.kept) THEN w.kept ELSE list_append(w.kept, n.ord) END
  FROM walk w JOIN walk_nodes n ON n.step = w.step + 1)"""
    return prefix.rstrip() + walk + last


def _within_collections(text: str) -> str:
    """The duplicate views with contents and pairs inside one collection only."""
    return (
        text.replace("FROM shingle_sets\n)", "FROM shingle_sets JOIN (SELECT chunk_id, collection FROM collected) USING (chunk_id)\n)")
        .replace("array_to_string(list_sort(shingles), '|') AS set_key", "collection || array_to_string(list_sort(shingles), '|') AS set_key, collection")
        .replace("SELECT ord, size, unnest(shingles)", "SELECT ord, size, collection, unnest(shingles)")
        .replace("ON a.shingle = b.shingle AND", "ON a.shingle = b.shingle AND a.collection = b.collection AND")
    )


def _share(purpose: str, row: str) -> str:
    """A draw in (0, 1) from an MD5 hash of seed, purpose and row number."""
    return f"((CAST('0x' || substring(md5('42/{purpose}/' || {row}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _noise(purpose: str, row: str, spread: float) -> str:
    radius, angle = _share(purpose + "/radius", row), _share(purpose + "/angle", row)
    return f"(1.0::DOUBLE + {spread}::DOUBLE * sqrt(-2.0::DOUBLE * ln({radius})) * cos(2.0::DOUBLE * pi() * {angle}))"


def _drawn(source: str, order: str, rows: str) -> str:
    return f"""
SELECT * FROM (SELECT row_id, CAST(floor({_share('pick', 'row_id')} * (SELECT count(*) FROM {source})) AS BIGINT) AS row_index
               FROM (SELECT unnest(range(({rows}))) AS row_id))
JOIN (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS row_index FROM {source}) USING (row_index)"""


ROW = "row_id"
_MEASURES = ("units_sold", "units_returned", "net_units", "revenue")


def _bootstrapped(rows: str) -> str:
    cells = ", ".join(f"{r(f'abs({m} * {_noise(m, ROW, 0.12)})')} AS {m}" for m in _MEASURES)
    return f"SELECT row_id, {cells} FROM ({_drawn('fx_demand', 'sku_id, period', rows)})"


def _extended(rows: str) -> str:
    return f"""
SELECT printf('SYN-%05d', row_id) AS record_id, CAST(period AS VARCHAR) AS period, strftime(period, '%b') AS month,
       CAST(year(period) AS INT) AS year, sku_id, product_name, abc_class,
       (SELECT list(DISTINCT channel ORDER BY channel) FROM fx_demand)[CAST(floor({_share('channel', 'row_id')}
          * (SELECT count(DISTINCT channel) FROM fx_demand)) AS BIGINT) + 1] AS channel,
       units_sold, units_returned, greatest(units_sold - units_returned, 0) AS net_units, revenue
FROM (SELECT *, row_number() OVER (ORDER BY period, sku_id) - 1 AS row_id FROM (
        SELECT sku_id, product_name, abc_class, CAST(unnest(generate_series((SELECT min(period) FROM fx_demand),
               (SELECT max(period) FROM fx_demand), INTERVAL 1 MONTH)) AS DATE) AS period
        FROM (SELECT sku_id, arg_min(product_name, period) AS product_name, arg_min(abc_class, period) AS abc_class
              FROM fx_demand GROUP BY sku_id)))
JOIN ({_bootstrapped(rows)}) USING (row_id)"""


_DEMAND_ROWS = "SELECT count(*) FROM fx_demand"
_BODIES["bootstrap_demand"] = _bootstrapped(_DEMAND_ROWS)
_BODIES["extend_demand"] = _extended(_DEMAND_ROWS)
_BODIES["sink_csv"] = f"SELECT * EXCLUDE (revenue), revenue AS revenue_inr FROM ({_extended(_DEMAND_ROWS)})"
_BODIES["bootstrap_po"] = f"""
SELECT *, {r('qty_ordered * rate_per_unit', 2)} AS po_value FROM (
  SELECT printf('SYN-PO-%05d', row_id) AS po_number, CAST(po_date AS VARCHAR) AS po_date, supplier_id, sku_id,
         {r('greatest(qty_ordered * ' + _noise('quantity', 'row_id', 0.15) + ', 10)')} AS qty_ordered,
         {r('rate_per_unit * ' + _noise('rate', 'row_id', 0.08), 2)} AS rate_per_unit
  FROM ({_drawn('fx_po', 'po_number', 'SELECT count(*) FROM fx_po')}))"""
VIEWS["fx_offers"] = """
SELECT supplier_id, b.sku_id, lead_time_days, min_order_qty, p_retailprice * 0.8::DOUBLE AS price_low,
       p_retailprice * 1.2::DOUBLE AS price_high
FROM fx_bridge b JOIN fx_terms USING (supplier_id) JOIN part ON b.sku_id = printf('SKU-%06d', p_partkey)
"""
_BODIES["synthesize_po"] = f"""
SELECT *, {r('subtotal + gst', 2)} AS total FROM (
  SELECT *, {r('subtotal * 0.18::DOUBLE', 2)} AS gst FROM (
    SELECT *, {r('qty * unit_price', 2)} AS subtotal FROM (
      SELECT printf('PO-%d-%04d', year(day), row_id + 1) AS po_number, supplier_id, sku_id, CAST(day AS VARCHAR) AS po_date,
             lead_time_days, offset_days, qty, unit_price, CAST(day + CAST(lead_time_days + offset_days AS INT) AS VARCHAR) AS delivery_date
      FROM (SELECT *, CAST(DATE '2022-01-01' + CAST(floor({_share('day', 'row_id')} * (DATE '2025-05-18' - DATE '2022-01-01' + 1)) AS INT) AS DATE) AS day,
                   CAST(-5 + floor({_share('offset', 'row_id')} * 16) AS BIGINT) AS offset_days,
                   min_order_qty + floor({_share('quantity', 'row_id')} * (min_order_qty * 4 - min_order_qty + 1)) AS qty,
                   {r('price_low + ' + _share('price', 'row_id') + ' * (price_high - price_low)', 2)} AS unit_price
            FROM ({_drawn('fx_offers', 'supplier_id, sku_id', 'SELECT count(*) FROM fx_po')})))))"""

# The Gaussian copula: mean ranks, inverse normal scores (Acklam), Cholesky factor by hand, values by rank.
_MEASURES = ("units_sold", "units_returned", "net_units", "revenue")


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for coefficient in coefficients[1:]:
        text = f"({text}) * ({x}) + {coefficient!r}::DOUBLE"
    return f"({text})"


def _score(p: str) -> str:
    def tail(share: str) -> str:
        q = f"sqrt(-2.0::DOUBLE * ln({share}))"
        return f"{_horner(NORMAL_TAIL[0], q)} / {_horner(NORMAL_TAIL[1], q)}"

    m = f"({p} - 0.5::DOUBLE)"
    middle = f"{_horner(NORMAL_MIDDLE[0], f'{m} * {m}')} * {m} / {_horner(NORMAL_MIDDLE[1], f'{m} * {m}')}"
    return f"CASE WHEN {p} < {NORMAL_EDGE}::DOUBLE THEN {tail(p)} WHEN {p} > {1 - NORMAL_EDGE!r}::DOUBLE THEN -({tail(f'(1.0::DOUBLE - {p})')}) ELSE {middle} END"


for _name in _MEASURES:
    VIEWS[f"ranked_{_name}"] = f"SELECT CAST({_name} AS DOUBLE) AS v, row_number() OVER (ORDER BY {_name}) - 1 AS place FROM fx_demand"
    VIEWS[f"score_{_name}"] = f"SELECT v, {_score('p')} AS s FROM (SELECT v, (min(place) + max(place) + 1) / 2.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM fx_demand) AS p FROM ranked_{_name} GROUP BY v)"
VIEWS["copula_scores"] = "SELECT a.s AS s0, b.s AS s1, c.s AS s2, d.s AS s3 FROM fx_demand x " + " ".join(
    f"JOIN score_{name} {alias} ON {alias}.v = x.{name}" for name, alias in zip(_MEASURES, "abcd", strict=True))
VIEWS["copula_c"] = "SELECT " + ", ".join(f"{r(f'corr(s{i}, s{j})', 9)} AS c{i}{j}" for i in range(4) for j in range(i)) + " FROM copula_scores"
VIEWS["copula_l2"] = "SELECT *, c10 AS l10, sqrt(1.0::DOUBLE - c10 * c10) AS l11, c20 AS l20, c30 AS l30 FROM copula_c"
VIEWS["copula_l3"] = "SELECT *, (c21 - l20 * l10) / l11 AS l21, (c31 - l30 * l10) / l11 AS l31 FROM copula_l2"
VIEWS["copula_l4"] = "SELECT *, sqrt(1.0::DOUBLE - l20 * l20 - l21 * l21) AS l22 FROM copula_l3"
VIEWS["copula_l5"] = "SELECT *, (c32 - l30 * l20 - l31 * l21) / l22 AS l32 FROM copula_l4"
VIEWS["copula_factor"] = "SELECT *, sqrt(1.0::DOUBLE - l30 * l30 - l31 * l31 - l32 * l32) AS l33 FROM copula_l5"


def _normal(purpose: str) -> str:
    return f"sqrt(-2.0::DOUBLE * ln({_share(purpose + '/radius', 'row_id')})) * cos(2.0::DOUBLE * pi() * {_share(purpose + '/angle', 'row_id')})"


def _below(value: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({value})))"
    tail = (f"exp(-abs({value}) * abs({value}) / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE "
            f"+ {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))")
    return f"CASE WHEN {value} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END"


VIEWS["copula_draws"] = "SELECT row_id, " + ", ".join(f"{_normal(name)} AS z{i}" for i, name in enumerate(_MEASURES)) + " FROM (SELECT unnest(range((SELECT count(*) FROM fx_demand))) AS row_id)"
VIEWS["copula_mixed"] = """
SELECT row_id, z0 AS m0, z0 * l10 + z1 * l11 AS m1, z0 * l20 + z1 * l21 + z2 * l22 AS m2, z0 * l30 + z1 * l31 + z2 * l32 + z3 * l33 AS m3
FROM copula_draws CROSS JOIN copula_factor"""
VIEWS["copula_places"] = "SELECT row_id, " + ", ".join(
    f"least(CAST(floor(({_below(f'm{i}')}) * n) AS BIGINT), CAST(n AS BIGINT) - 1) AS k{i}" for i in range(4)
) + " FROM copula_mixed, (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_demand)"
_BODIES["copula_sample"] = "SELECT row_id, " + ", ".join(f"{r(f'abs({a}.v)')} AS {name}" for name, a in zip(_MEASURES, "abcd", strict=True)) + " FROM copula_places " + " ".join(
    f"JOIN ranked_{name} {a} ON {a}.place = k{i}" for i, (name, a) in enumerate(zip(_MEASURES, "abcd", strict=True)))

# The isolation forest, grown level by level: 200 trees of 256 rows, at most eight levels.
_TREES, _LEVELS = 200, 8
_X = [r(name, 6) for name in ("net_units", "lag_1", "roll_mean_3", "roll_std_3", "is_high_season")]
_SPLIT = "((CAST('0x' || substring(md5('42/{purpose}/' || tree || '/' || node), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
_PATH = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} <= 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0 * ({n} - 1.0::DOUBLE) / {n} END"
VIEWS["forest_rows"] = f"SELECT *, sku_id || '/' || CAST(period AS VARCHAR) AS key, [{', '.join(f'CAST({x} AS DOUBLE)' for x in _X)}] AS x FROM arows"
VIEWS["forest_share"] = f"""
SELECT share, greatest(1, least({_TREES}, CAST(floor(1.0::DOUBLE / share) AS BIGINT))) AS per_draw
FROM (SELECT least(1.0::DOUBLE, 384.0::DOUBLE / greatest(count(*), 1)) AS share FROM forest_rows)"""
VIEWS["forest_draws"] = """
SELECT key, x, number, (CAST('0x' || substring(md5('42/sample/' || number || '/' || key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, share, per_draw
FROM (SELECT key, x, share, per_draw, unnest(range(CAST(ceil(200.0::DOUBLE / per_draw) AS BIGINT))) AS number FROM forest_rows CROSS JOIN forest_share)"""
VIEWS["forest_sample"] = f"""
SELECT tree, x, CAST(greatest(1, ceil(log2(greatest(2, count(*) OVER (PARTITION BY tree))))) AS INT) AS most FROM (
  SELECT CAST(number * per_draw + floor(u / share) AS INT) AS tree, x,
         row_number() OVER (PARTITION BY number * per_draw + floor(u / share) ORDER BY u - floor(u / share) * share, key) AS place
  FROM forest_draws WHERE floor(u / share) < per_draw AND number * per_draw + floor(u / share) < {_TREES}
) WHERE place <= 256"""
VIEWS["level_0"] = "SELECT tree, 0 AS node, x, most FROM forest_sample"
for _level in range(_LEVELS + 1):
    _limits = ", ".join(f"min(x[{k}]) AS l{k}, max(x[{k}]) AS h{k}" for k in range(1, 6))
    VIEWS[f"nodes_{_level}"] = f"""
SELECT tree, node, feature, CASE WHEN feature < 0 THEN 0.0 ELSE low[feature + 1] + {_SPLIT.format(purpose='threshold')} * (high[feature + 1] - low[feature + 1]) END AS threshold, row_count
FROM (SELECT *, CASE WHEN {_level} >= most OR row_count <= 1 OR len(varying) = 0 THEN -1
                     ELSE varying[CAST(floor({_SPLIT.format(purpose='feature')} * len(varying)) AS BIGINT) + 1] END AS feature
      FROM (SELECT *, list_filter([0, 1, 2, 3, 4], lambda i: high[i + 1] > low[i + 1]) AS varying
            FROM (SELECT tree, node, most, row_count, [l1, l2, l3, l4, l5] AS low, [h1, h2, h3, h4, h5] AS high
                  FROM (SELECT tree, node, any_value(most) AS most, count(*) AS row_count, {_limits} FROM level_{_level} GROUP BY tree, node))))"""
    VIEWS[f"level_{_level + 1}"] = f"""
SELECT a.tree, 2 * a.node + CASE WHEN x[feature + 1] <= threshold THEN 1 ELSE 2 END AS node, x, most
FROM level_{_level} a JOIN nodes_{_level} n ON n.tree = a.tree AND n.node = a.node WHERE feature >= 0"""
VIEWS["forest_nodes"] = " UNION ALL ".join(f"SELECT *, {level} AS depth FROM nodes_{level}" for level in range(_LEVELS + 1))
_WALK = " ".join(
    f"LEFT JOIN forest_paths n{k} ON n{k}.tree = n{k - 1}.tree AND n{k}.node = CASE WHEN n{k - 1}.feature >= 0 THEN 2 * n{k - 1}.node + CASE WHEN x[n{k - 1}.feature + 1] <= n{k - 1}.threshold THEN 1 ELSE 2 END END"
    for k in range(1, _LEVELS + 1)
)
VIEWS["forest_paths"] = f"SELECT tree, node, feature, threshold, depth + {_PATH.format(n='row_count')} AS path, row_count FROM forest_nodes"
VIEWS["forest_normal"] = f"SELECT {_PATH.format(n='n')} AS normal FROM (SELECT avg(row_count) AS n FROM forest_paths WHERE node = 0)"
VIEWS["forest_raw"] = f"""
SELECT key, {r(f'-pow(2.0::DOUBLE, -(sum(path) / {_TREES}.0::DOUBLE) / any_value(normal))', 9)} AS raw_score
FROM (SELECT key, coalesce({', '.join(f'n{k}.path' for k in range(_LEVELS, -1, -1))}) AS path
      FROM forest_rows JOIN forest_paths n0 ON n0.node = 0 {_WALK}) CROSS JOIN forest_normal GROUP BY key"""
VIEWS["forest_scored"] = """
SELECT a.* EXCLUDE (key, x), raw_score - least_score AS anomaly_score, raw_score - least_score < 0 AS is_anomaly
FROM forest_rows a JOIN forest_raw USING (key), (SELECT quantile_cont(raw_score, 0.05) AS least_score FROM forest_raw)"""


def _of_forest(text: str) -> str:
    """A query of z-scores with the scores of the forest."""
    for name, other in (("rounded_scores", "forest_scored"), ("scored", "forest_scored"), ("flagged", "forest_flagged"), ("anomaly_board", "forest_anomaly_board"), ("board", "forest_board")):
        text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {other}", text)
    return text


VIEWS["forest_flagged"] = _of_forest(VIEWS["flagged"])
VIEWS["forest_anomaly_board"] = _of_forest(VIEWS["anomaly_board"])
VIEWS["forest_board"] = _of_forest(VIEWS["board"])
_BODIES["iforest_fit"] = """
SELECT tree, CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, floor(threshold * 1e4 + 0.5) / 1e4 AS threshold,
       CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 1 END AS INT) AS left_node, CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 2 END AS INT) AS right_node,
       CAST(depth AS INT) AS depth, row_count FROM forest_nodes"""
_BODIES["sink_model"] = "SELECT tree, count(*) AS node_count, CAST(max(depth) AS INT) AS depth, max(row_count) AS row_count FROM forest_nodes GROUP BY tree"
_BODIES["iforest_score"] = f"SELECT sku_id, {_P}, {r('anomaly_score', 6)} AS anomaly_score, is_anomaly FROM forest_scored"
_BODIES["iforest_anomalies"] = f"SELECT sku_id, product_name, {_P}, net_units, {r('roll_mean_3', 4)} AS roll_mean_3, {r('anomaly_score', 6)} AS anomaly_score FROM forest_flagged"
_BODIES["forest_alerts"] = _of_forest(_BODIES["alerts"])
_BODIES["forest_anomaly_alerts"] = "SELECT * FROM (" + VIEWS["forest_anomaly_board"].replace(" ORDER BY sku_id, period LIMIT 10", "") + ")"
_BODIES["forest_contamination_sweep"] = _of_forest(_BODIES["contamination_sweep"])
_BODIES["forest_score_histogram"] = _of_forest(_BODIES["score_histogram"])
_BODIES["forest_top_anomalies"] = f"SELECT sku_id, product_name, {_P}, net_units, {r('roll_mean_3', 4)} AS roll_mean_3, {r('anomaly_score', 6)} AS anomaly_score FROM (SELECT * FROM forest_flagged ORDER BY anomaly_score, sku_id, period LIMIT 10)"
_BODIES["forest_per_sku"] = f"SELECT sku_id, count(*) AS months, count(*) FILTER (is_anomaly) AS flagged, {r('min(anomaly_score)', 6)} AS lowest FROM forest_scored GROUP BY sku_id"

# Boundary chunks: pieces by the first separator that occurs, level by level; runs of short pieces packed one chunk at a time.
_MARKS = "[chr(10) || chr(10), chr(10), '.', ' ', '']"
VIEWS["seg_0"] = "SELECT source, page, []::BIGINT[] AS path, text, 1 AS lowest FROM cleaned"
for _level in range(5):
    VIEWS[f"piece_{_level}"] = f"""
SELECT source, page, path, sep, piece, i, length(piece) < {fv.CHUNK_CHARS} AS short FROM (
  SELECT source, page, path, sep, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM (
    SELECT source, page, path, sep, list_filter(
      CASE WHEN mark = '' THEN list_transform(range(1, length(text) + 1), lambda c: substr(text, c, 1))
           ELSE list_transform(string_split(text, mark), lambda x, c: CASE WHEN c = 1 THEN x ELSE mark || x END) END, lambda x: x <> '') AS pieces
    FROM (SELECT *, {_MARKS}[sep] AS mark
          FROM (SELECT *, list_filter(range(lowest, 6), lambda c: {_MARKS}[c] = '' OR contains(text, {_MARKS}[c]))[1] AS sep FROM seg_{_level}))))"""
    VIEWS[f"seg_{_level + 1}"] = f"SELECT source, page, path || [i, 0] AS path, piece AS text, sep + 1 AS lowest FROM piece_{_level} WHERE NOT short"
    VIEWS[f"run_{_level}"] = f"""
SELECT source, page, path || [min(i)] AS path, list(piece ORDER BY i) AS pieces
FROM (SELECT *, i - row_number() OVER (PARTITION BY source, page, path ORDER BY i) AS island FROM piece_{_level} WHERE short) GROUP BY source, page, path, island"""
VIEWS["short_runs"] = " UNION ALL ".join(f"SELECT * FROM run_{level}" for level in range(5))
VIEWS["measured_runs"] = """
SELECT source, page, path, pieces, list_transform(range(0, len(pieces) + 1), lambda k: CAST(coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) AS BIGINT)) AS p
FROM short_runs"""
_PACKED = f"""
packed AS (
  SELECT source, page, path, pieces, p, CAST(1 AS BIGINT) AS s, CAST(1 AS BIGINT) AS e, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS text, false AS done FROM measured_runs
  UNION ALL
  SELECT source, page, path, pieces, p,
         CASE WHEN j IS NULL THEN s ELSE list_filter(range(s, j + 1), lambda t: p[j] - p[t] <= {fv.CHUNK_OVERLAP} AND (p[j] - p[t] = 0 OR p[j + 1] - p[t] <= {fv.CHUNK_CHARS}))[1] END,
         coalesce(j, e) + 1, k + 1, trim(array_to_string(pieces[s:coalesce(j, len(pieces) + 1) - 1], ''), {TRIMMED}), j IS NULL
  FROM (SELECT *, list_filter(range(greatest(e, s + 1), len(pieces) + 1), lambda c: p[c + 1] - p[s] > {fv.CHUNK_CHARS})[1] AS j FROM packed WHERE NOT done)
)"""


_NUMBERED = "SELECT source, page, text, row_number() OVER (PARTITION BY source, page ORDER BY path, k) - 1 AS i FROM packed WHERE text <> ''"
_BOUNDARY_CHUNKS = re.sub(
    r"FROM \(SELECT \*, unnest\(.*?\) AS i FROM numbered_chunks\)", "FROM numbered_chunks",
    _chunk("numbered_chunks").replace("substring(text, 1 + 1400 * i, 1600) AS text", "text"), flags=re.S,
)


def _boundary(text: str) -> str:
    """A query of fixed chunks with boundary chunks instead."""
    names = [f"{name}_{level}" for level in range(5) for name in ("seg", "piece", "run")] + ["short_runs", "measured_runs"]
    parts = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in names)
    fixed = f"chunks AS MATERIALIZED ({VIEWS['chunks']})"
    assert fixed in text
    text = text.replace(fixed, f"{parts}, {_PACKED}, numbered_chunks AS MATERIALIZED ({_NUMBERED}), chunks AS MATERIALIZED ({_BOUNDARY_CHUNKS})")
    return text if text.startswith("WITH RECURSIVE") else text.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {name: sql(body) for name, body in _BODIES.items() if body is not None}
ORACLE["chunk_boundary"] = _boundary(sql("SELECT chunk_id, chunk_index, doc_type, length(text) AS n_chars, text FROM chunks"))
_KEPT = f"""
SELECT chunk_id FROM members WHERE ord = content_ord AND ord NOT IN ({_DROPPED})"""
ORACLE["dedup_keep_first"] = _greedy(_KEPT)
ORACLE["ingest"] = _within_collections(_greedy(f"""
SELECT chunk_id, collected.collection, doc_type, CAST(1 AS BIGINT) AS version, md5(text) AS text_md5
FROM collected WHERE chunk_id IN ({_KEPT})"""))
ORACLE["ingest_boundary"] = _boundary(_within_collections(_greedy(f"""
SELECT collection, count(*) AS chunk_count FROM collected WHERE chunk_id IN ({_KEPT}) GROUP BY collection""")))
