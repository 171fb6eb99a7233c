"""SQL of the queries, over whole tables."""

from adstrata.llm import lookalikes


def _class(chars: str) -> str:
    """The characters as a class of ranges, for a regular expression in SQL."""
    spans: list[list[int]] = []
    for x in sorted(set(map(ord, chars))):
        if spans and spans[-1][1] == x - 1:
            spans[-1][1] = x
        else:
            spans.append([x, x])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_HIDDEN = _class(lookalikes.INVISIBLE)
_WORD = r"[\p{L}\p{N}_]"
_OTHER = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}]"
_LOOKALIKE = "|".join([
    _class("".join(lookalikes.variants()) + lookalikes.spaces() + lookalikes.CROATIAN_LIKE),
    rf"{_WORD}[\x{{300}}-\x{{36f}}]*{_HIDDEN}", f"{_HIDDEN}{_WORD}",
    rf"\p{{Latin}}[\x{{300}}-\x{{36f}}]*{_OTHER}", rf"{_OTHER}[\x{{300}}-\x{{36f}}]*\p{{Latin}}",
    r"\p{Greek}[\x{300}-\x{36f}]*\p{Cyrillic}", r"\p{Cyrillic}[\x{300}-\x{36f}]*\p{Greek}",
])

_LINE = "trim(lower(regexp_replace(regexp_replace({}, '[ \\t\\r]+', ' ', 'g'), '[0-9]+', '#', 'g')))"
_KEPT = f"""
worded AS (SELECT DISTINCT seller_name, listing_id, description FROM observations
           WHERE seller_name IS NOT NULL AND listing_id IS NOT NULL AND description IS NOT NULL),
lined AS (SELECT DISTINCT seller_name, listing_id, {_LINE.format("raw")} AS line
          FROM (SELECT seller_name, listing_id, unnest(string_split(description, chr(10))) AS raw FROM worded)),
held AS (SELECT seller_name, line, count(*) AS docs FROM lined WHERE line <> '' GROUP BY ALL),
sized AS (SELECT seller_name, count(DISTINCT listing_id) AS total FROM worded GROUP BY ALL),
kept AS (SELECT seller_name, line, docs, total FROM held JOIN sized USING (seller_name) WHERE docs >= 4 AND docs >= 0.25 * total)
"""

_WALK = """
first_ AS (SELECT listing_id, min(batch_no) AS batch_no FROM intake_batches WHERE batch_no IS NOT NULL AND listing_id IS NOT NULL GROUP BY 1),
turn AS (SELECT listing_id, batch_no, row_number() OVER (ORDER BY batch_no, listing_id) AS i FROM first_),
k AS (SELECT DISTINCT i, key_type, lower(trim(key_value)) AS v FROM blocking_keys JOIN turn USING (listing_id) WHERE key_type IS NOT NULL AND key_value IS NOT NULL),
n AS (SELECT i, count(*) AS n FROM k GROUP BY i),
met AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM k x JOIN k y ON x.key_type = y.key_type AND x.v = y.v AND x.i < y.i GROUP BY ALL),
hit AS (SELECT a, b FROM met JOIN n p ON p.i = a JOIN n q ON q.i = b WHERE 2 * c >= p.n + q.n - c),
near AS (SELECT t.i, coalesce(list(a) FILTER (a IS NOT NULL), []) AS earlier FROM turn t LEFT JOIN hit ON b = t.i GROUP BY t.i),
walk(i, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT near.i, CASE WHEN list_has_any(taken, earlier) THEN taken ELSE list_append(taken, near.i) END FROM walk JOIN near ON near.i = walk.i + 1),
took AS (SELECT unnest(taken) AS i FROM walk WHERE i = (SELECT max(i) FROM walk))
"""

SQL = {
    "p2_found": """
WITH row_of AS (SELECT DISTINCT cluster_id, id, first_seen, last_seen, category FROM listings WHERE cluster_id IS NOT NULL AND id IS NOT NULL),
grouped AS (SELECT cluster_id, min(id) AS lowest FROM row_of GROUP BY cluster_id HAVING count(DISTINCT id) >= 2),
seen AS (
  SELECT cluster_id, id FROM row_of
  WHERE first_seen >= TIMESTAMPTZ '2000-01-01 00:00:00+00' AND first_seen <= last_seen
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY first_seen, id) = 1),
kind AS (
  SELECT cluster_id, id FROM row_of WHERE regexp_matches(category, '[^ \\t\\r\\n-]')
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY last_seen DESC NULLS LAST, id) = 1)
SELECT g.cluster_id, coalesce(s.id, g.lowest) AS canonical_listing_id, coalesce(k.id, -1) AS category_listing_id
FROM grouped g LEFT JOIN seen s USING (cluster_id) LEFT JOIN kind k USING (cluster_id)""",
    "p3_found": f"""
WITH RECURSIVE {_WALK}
SELECT least(x.listing_id, y.listing_id) AS listing_a, greatest(x.listing_id, y.listing_id) AS listing_b
FROM hit JOIN took ON took.i = a JOIN turn x ON x.i = a JOIN turn y ON y.i = b""",
    "p3_decisions": f"""
WITH RECURSIVE {_WALK}
SELECT listing_id, batch_no::BIGINT AS batch_no, i IN (SELECT i FROM took) AS accepted FROM turn""",
    "p4_found": f"""
WITH {_KEPT},
known AS (SELECT DISTINCT seller_name, {_LINE.format("raw")} AS line
          FROM (SELECT seller_name, unnest(string_split(snippet, chr(10))) AS raw FROM seller_boilerplate))
SELECT k.seller_name, k.line, (n.line IS NOT NULL)::BIGINT AS known
FROM kept k LEFT JOIN known n ON n.seller_name = k.seller_name AND n.line = k.line""",
    "p4_cleaned": f"""
WITH {_KEPT},
marked AS (
  SELECT o.id, o.description, string_split(o.description, chr(10)) AS raws,
         (SELECT list(line) FROM kept k WHERE k.seller_name = o.seller_name) AS lines
  FROM observations o)
SELECT id AS observation_id,
       CASE WHEN description IS NULL OR lines IS NULL THEN description
            ELSE array_to_string(list_filter(raws, lambda x: NOT list_contains(lines, {_LINE.format("x")})), chr(10)) END AS cleaned,
       CASE WHEN description IS NULL OR lines IS NULL THEN 0
            ELSE len(list_filter(raws, lambda x: list_contains(lines, {_LINE.format("x")}))) END::BIGINT AS removed
FROM marked""",
    "p5_found": f"""
WITH t AS (SELECT id AS observation_id, 'title' AS field, title AS text FROM observations
           UNION ALL SELECT id, 'description', description FROM observations)
SELECT observation_id, field FROM t
WHERE regexp_matches(text, '{_LOOKALIKE}') OR length(nfc_normalize(text)) < length(text)""",
    "p6_found": """
WITH RECURSIVE p AS (
  SELECT least(listing_a, listing_b) AS a, greatest(listing_a, listing_b) AS b, lower(trim(decision)) AS decision,
         nullif(lower(trim(human_label)), '') AS label, labeled_at, created_at, id
  FROM dedup_pairs WHERE listing_a <> listing_b),
labelled AS (
  SELECT a, b, label FROM p WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY labeled_at DESC NULLS LAST, id DESC) = 1),
decided AS (
  SELECT a, b, decision FROM p
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
link AS (
  SELECT d.a, d.b FROM decided d LEFT JOIN labelled l USING (a, b)
  WHERE CASE WHEN l.label IS NOT NULL THEN l.label = 'same' ELSE d.decision = 'merge' END),
edge AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT x, x FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT x AS listing_id, min(y) AS group_id FROM reach GROUP BY x""",
}
