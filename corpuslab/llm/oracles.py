"""DuckDB SQL equivalent to the registered queries."""

from __future__ import annotations

from corpuslab.llm.pairs import PLACEHOLDERS

_WS = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"
_UNIT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS}]"


def _norm(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '')"


_CURRENT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC, title DESC, text DESC) AS place
  FROM records WHERE {key} IS NOT NULL) WHERE place = 1"""

_TERMS = f"""
WITH cur AS ({_CURRENT.format(key='doc_id')}),
listed AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', title, text)), '\\p{{L}}{{4,}}') AS words FROM cur),
each AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM listed),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM each GROUP BY ALL),
facts AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
sizes AS (SELECT count(*) AS n, sum(dl) AS tokens FROM (SELECT DISTINCT doc_id, dl FROM tf))
"""

_TOKENS = f"""
WITH RECURSIVE cur AS (SELECT *, key AS k FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC, text DESC, source_type DESC, lang DESC, topic DESC) AS place
  FROM (SELECT *, {_norm('doc_id')} AS key FROM records) WHERE key IS NOT NULL) WHERE place = 1),
each AS (SELECT k, unnest(regexp_extract_all(lower(text), '{_UNIT}')) AS unit FROM cur),
distinct_units AS (SELECT unit, length(unit) AS size FROM each GROUP BY unit),
widths AS (SELECT DISTINCT length(piece) AS width FROM tokenizer_vocab WHERE piece <> ''),
steps AS (
  SELECT unit, pos, max(CASE WHEN v.piece IS NULL THEN 1 ELSE width END) AS step
  FROM (SELECT unit, size, unnest(range(1, size + 1)) AS pos FROM distinct_units) u
  CROSS JOIN widths LEFT JOIN (SELECT DISTINCT piece FROM tokenizer_vocab) v ON v.piece = substr(unit, pos, width) AND pos + width - 1 <= size
  GROUP BY unit, pos),
walk AS (
  SELECT unit, 1 AS pos, 0 AS n FROM distinct_units
  UNION ALL SELECT walk.unit, walk.pos + step, n + 1 FROM walk JOIN steps ON walk.unit = steps.unit AND walk.pos = steps.pos),
lengths AS (SELECT unit, max(n) AS length FROM walk GROUP BY unit),
totals AS (SELECT cur.k, any_value(source_type) AS source_type, any_value(lang) AS lang, any_value(topic) AS topic, coalesce(sum(length), 0)::BIGINT AS tokens
  FROM cur LEFT JOIN each ON cur.k = each.k LEFT JOIN lengths ON each.unit = lengths.unit GROUP BY cur.k)
"""

_PIECES = r"""
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, text DESC) AS place
  FROM records WHERE doc_id IS NOT NULL) WHERE place = 1 AND length(text) > 1200),
longest AS (SELECT doc_id,
  list_max(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: length(x))) AS paragraph,
  list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n|\n|' || chr(1)), lambda x: length(x))) AS sentence,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda x: length(x))) AS word FROM cur)
SELECT doc_id, CASE WHEN paragraph <= 1200 THEN 'paragraph' WHEN sentence <= 1200 THEN 'sentence' WHEN word <= 1200 THEN 'word' ELSE 'none' END AS cut_level FROM longest
"""

_LEAKS = """
WITH grams AS (SELECT {id}, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram
  FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}))
SELECT DISTINCT {id}, gram FROM grams"""

_LEAKED = f"""
WITH found AS (SELECT DISTINCT item_id, doc_id FROM ({_LEAKS.format(id='item_id', table='eval_items')}) JOIN ({_LEAKS.format(id='doc_id', table='documents')}) USING (gram))
"""

_MIX_SHARES = f"""
WITH sized AS (SELECT doc_id, {_norm('source')} AS source, len(regexp_extract_all(lower(coalesce(text, '')), '{_UNIT}')) AS tokens FROM documents),
total AS (SELECT sum(tokens) AS all_tokens FROM sized),
goals AS (SELECT t.source, t.target_share, max_repeat, {_norm('t.source')} AS key, s.tokens AS of_source, least(t.target_share * all_tokens::DOUBLE, (s.tokens * max_repeat)::DOUBLE) AS goal
  FROM mix_targets t CROSS JOIN total LEFT JOIN (SELECT source, sum(tokens) AS tokens FROM sized GROUP BY source) s ON s.source = {_norm('t.source')}),
placed AS (SELECT source, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized WHERE tokens > 0),
uses AS (SELECT g.source, g.goal, p.tokens, p.before, g.of_source, unnest(range(1, greatest(max_repeat, 1) + 1)) AS use FROM placed p JOIN goals g ON p.source = g.key),
used AS (SELECT source, sum(tokens)::BIGINT AS used_tokens, count(*) AS uses FROM uses WHERE (use - 1) * of_source + before < goal GROUP BY source)
SELECT source, target_share, coalesce(used_tokens, 0)::BIGINT AS used_tokens, coalesce(uses, 0)::BIGINT AS uses,
  round(coalesce(used_tokens, 0) / (SELECT sum(used_tokens) FROM used), 6)::DOUBLE AS actual_share FROM goals LEFT JOIN used USING (source)
"""

_MIX = f"""
WITH sized AS (SELECT {_norm('source')} AS source, len(regexp_extract_all(lower(coalesce(text, '')), '{_UNIT}')) AS tokens FROM documents)
SELECT source FROM mix_targets t WHERE coalesce((SELECT sum(tokens) FROM sized s WHERE s.source = {_norm('t.source')}), 0) * max_repeat
  < target_share * (SELECT sum(tokens) FROM sized)
"""

ORACLES: dict[str, str] = {
    "p2_found": _TERMS + "SELECT doc_id, term FROM tf JOIN facts USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 6",
    "p2_top_terms": _TERMS
    + """, scored AS (SELECT doc_id, term, tf, df, round((log2(1 + cf / n) + tfn * log2((1 + cf / n) / (cf / n))) / (1 + tfn), 6) AS score
  FROM (SELECT *, tf * log2(1 + tokens / n / dl) AS tfn FROM tf JOIN facts USING (term) CROSS JOIN sizes))
SELECT doc_id, place, term, tf, df, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM scored) WHERE place <= 5""",
    "p4_found": _TOKENS
    + f"""SELECT row_id FROM token_counts JOIN totals ON {_norm('token_counts.doc_id')} = totals.k
WHERE subword IS NULL OR subword <= 0 OR abs(subword - tokens) > 0.2 * tokens""",
    "p4_totals": _TOKENS
    + f"""SELECT coalesce(c.source_type, 'unknown') AS source_type, coalesce({_norm('t.lang')}, 'unknown') AS lang, coalesce({_norm('t.topic')}, 'unknown') AS topic,
  count(*) AS docs, sum(t.tokens)::BIGINT AS tokens
FROM totals t LEFT JOIN cost_by_source c ON {_norm('t.source_type')} = {_norm('c.source_type')} GROUP BY 1, 2, 3""",
    "p5_found": _PIECES,
    "p5_whole": """SELECT doc_id, length(text) AS chars, 0::BIGINT AS first, 0::BIGINT AS over, 0::BIGINT AS changed, 0::BIGINT AS badly_shared, 0::BIGINT AS elsewhere
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, text DESC) AS place FROM records WHERE doc_id IS NOT NULL) WHERE place = 1 AND length(text) > 1200""",
    "p6_empty": f"""SELECT DISTINCT faq_id FROM faq_export WHERE NOT coalesce(regexp_matches(answer, '[\\p{{L}}\\p{{N}}]'), false)
  OR lower(regexp_replace(answer, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) IN ({', '.join(f"'{p}'" for p in sorted(PLACEHOLDERS))})""",
    "p7_items": _LEAKED.rstrip()
    + """,
words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dwords AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM found)),
same AS (SELECT item_id, doc_id, i - j AS diagonal, i FROM (
  SELECT f.item_id, f.doc_id, a.i, b.j FROM found f JOIN (SELECT item_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words) a ON a.item_id = f.item_id
  JOIN (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM dwords) b ON b.doc_id = f.doc_id AND a.x = b.x)),
runs AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, doc_id, diagonal ORDER BY i) AS island FROM same) GROUP BY item_id, doc_id, diagonal, island)
SELECT items.item_id, coalesce(docs, 0) AS docs, coalesce(words, 0) AS words FROM (SELECT DISTINCT item_id FROM eval_items) items
LEFT JOIN (SELECT item_id, count(DISTINCT doc_id) AS docs FROM found GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, max(n) AS words FROM runs GROUP BY 1) USING (item_id)""",
    "p7_found": _LEAKED + "SELECT item_id, doc_id FROM found",
    "p7_clean": _LEAKED + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    "p8_found": _MIX,
    "p8_shares": _MIX_SHARES,
}
