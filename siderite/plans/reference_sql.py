"""DuckDB twins of the reference queries."""

from __future__ import annotations

from siderite.functions.units import CURRENCY_WORDS
from siderite.operators.runs import CLASSES, MASSES, REFERENCE, SHOP, SIGNS, TERMS
from siderite.plans.data_sql import CLEAN_TITLE, STATED_MASS

_SEEN = "available IS DISTINCT FROM FALSE"
_TEXT = "lower(concat_ws(' ', coalesce(title, ''), coalesce(canonical_name_display, ''), coalesce(meteorite_type, ''), coalesce(subtype, ''), coalesce(source, '')))"
_CATEGORY = "CASE WHEN lower(trim(coalesce(meteorite_type, ''))) IN ('', 'stone') THEN 'unknown' ELSE lower(trim(meteorite_type)) END"
_RATIO = "coalesce(price_per_g_usd, CASE WHEN coalesce(nullif(trim(currency), ''), 'USD') = 'USD' THEN price_per_g END)"
_CHOSEN = f"{_SEEN} AND contains({_TEXT}, 'slice') AND {_CATEGORY} = 'iron' AND source = 'Halden Bolide Works'"
_FAMILIES = "['lunar', 'martian', 'pallasite', 'mesosiderite', 'iron', 'carbonaceous chondrite', 'enstatite chondrite', 'ordinary chondrite', 'chondrite', 'achondrite', 'unknown']"
_r = "floor({0} * 1e{1} + 0.5) / 1e{1}".format
_NEAR = "abs({a} - {b}) <= 0.01 * greatest(abs({a}), abs({b}), 1.0)"
_HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')".format

#: The family of a recorded class, for the classes that the tables have.
_FAMILY = """CASE WHEN {0} LIKE 'Lunar%' THEN 'lunar' WHEN {0} IN ('Shergottite', 'Nakhlite', 'Chassignite') THEN 'martian' WHEN {0} IN ('PMG', 'Pallasite') THEN 'pallasite' WHEN {0} = 'Mesosiderite' THEN 'mesosiderite'
    WHEN regexp_matches({0}, '^(IAB|IIAB|IIIAB|IVA|IVB|IIE)$') THEN 'iron' WHEN regexp_matches({0}, '^C[A-Z]?[0-9]') THEN 'carbonaceous chondrite' WHEN regexp_matches({0}, '^(E[HL]|R)[3-7]') THEN 'chondrite'
    WHEN regexp_matches({0}, '^(H|L|LL)[3-7]') THEN 'ordinary chondrite' WHEN regexp_matches({0}, '^(Eucrite|Diogenite|Howardite|Ureilite|Aubrite|Angrite)') THEN 'achondrite' END""".format

_RULES = [
    ("missing_key", "id IS NULL OR url IS NULL OR source IS NULL", "error"),
    ("missing_title", "coalesce(trim(title), '') = ''", "error"),
    ("bad_url", "NOT regexp_matches(url, '^https?://[^/\\s]+')", "error"),
    ("bad_confidence", "confidence NOT IN ('low', 'medium', 'high')", "error"),
    ("bad_status", "canonical_name_status NOT IN ('metbull_verified', 'unknown')", "error"),
    ("price_not_positive", "price <= 0", "error"),
    ("mass_not_positive", "weight_g <= 0", "error"),
    ("unpriced_with_usd", "price IS NULL AND price_usd IS NOT NULL", "error"),
    ("ratio_mismatch", "NOT (" + _NEAR.format(a="price_per_g", b="(price / nullif(weight_g, 0))") + ")", "error"),
    ("unverified_with_name", "canonical_name_status = 'unknown' AND canonical_name IS NOT NULL", "error"),
    ("verified_without_name", "canonical_name_status = 'metbull_verified' AND canonical_name IS NULL", "error"),
    ("images_repeated", "len(image_urls) <> len(list_distinct(image_urls))", "error"),
    ("first_image_differs", "image_urls[1] <> image_url", "error"),
    ("sold_but_available", "available AND regexp_matches(lower(title), '\\b(sold|on hold|reserved)\\b')", "warning"),
    ("verified_before_scraped", "last_verified_at < scraped_at", "warning"),
    ("no_availability", "available IS NULL", "error"),
    ("no_moment", "scraped_at IS NULL OR last_verified_at IS NULL", "error"),
    ("bad_currency", "(price IS NOT NULL OR currency IS NOT NULL) AND NOT coalesce(currency IN (" + ", ".join(repr(c) for c in CURRENCY_WORDS) + "), FALSE)", "error"),
    ("priced_without_usd", "price IS NOT NULL AND (price_usd IS NULL OR fx_rate_to_usd IS NULL OR NOT coalesce(regexp_matches(fx_rate_date, '^\\d{4}-\\d{2}-\\d{2}$'), FALSE))", "error"),
    ("unpriced_with_rate", "price IS NULL AND (fx_rate_to_usd IS NOT NULL OR fx_rate_date IS NOT NULL OR price_per_g IS NOT NULL OR price_per_g_usd IS NOT NULL)", "error"),
    ("usd_rate_not_one", "currency = 'USD' AND abs(fx_rate_to_usd - 1) > 1e-6", "error"),
    ("usd_mismatch", "abs(price_usd - " + _r("(price * fx_rate_to_usd)", 2) + ") > 0.0101", "error"),
    ("usd_ratio_mismatch", "NOT (" + _NEAR.format(a="price_per_g_usd", b="(price_usd / nullif(weight_g, 0))") + ")", "error"),
    ("verified_not_official", "canonical_name_status = 'metbull_verified' AND metbull_status IS DISTINCT FROM 'Official'", "error"),
    ("unclean_name", "trim(canonical_name) <> canonical_name OR regexp_matches(canonical_name, '[\\r\\n]|https?://', 'i') OR length(canonical_name) > 120", "error"),
    ("images_without_first", "len(image_urls) > 0 AND image_url IS NULL", "error"),
    ("decorative_image", "regexp_matches(image_url, 'favicon|ajax-loader|logo|spinner|counter|placeholder|sold\\.jpg', 'i')", "error"),
    ("range_without_mark", "regexp_matches(upper(subtype), '^(H|L|LL)[3-7][3-7]$')", "error"),
    ("type_conflict", f"{_FAMILY('subtype')} IS NOT NULL AND NOT coalesce(meteorite_type = {_FAMILY('subtype')}, FALSE)", "error"),
    ("text_conflict", f"coalesce({_FAMILY('subtype')}, meteorite_type) <> 'unknown' AND split_part(classification_text, ', ', 1) <> coalesce({_FAMILY('subtype')}, meteorite_type)", "error"),
    ("mass_missing", "title_g IS NOT NULL AND weight_g IS NULL", "error"),
    ("title_mass_mismatch", "abs(title_g - weight_g) > greatest(0.001, 0.0001 * title_g)", "error"),
]
_VIOLATIONS = " UNION ALL ".join(f"SELECT id, last_verified_at, source, '{n}' AS rule, '{s}' AS severity FROM massed WHERE {c}" for n, c, s in _RULES)
_MASSED = f"clean AS (SELECT *, {CLEAN_TITLE} AS x FROM listings), {STATED_MASS}, massed AS (SELECT * FROM stated)"

_RUNS = """
WITH snap AS (SELECT DISTINCT snapshot_id, url AS id, source FROM listing_snapshots),
old AS (SELECT id, source FROM snap WHERE snapshot_id = {run} - 1),
fresh AS (SELECT id, source FROM snap WHERE snapshot_id = {run}),
scraped AS (SELECT unnest(scraped_sources) AS source FROM inventory_runs WHERE snapshot_id = {run}),
enabled AS (SELECT name AS source FROM sources WHERE coalesce(enabled, TRUE)),
merged AS (
    SELECT id, source, 'fresh' AS origin FROM fresh WHERE id IS NOT NULL
    UNION ALL
    SELECT id, source, 'kept' FROM old
    WHERE id IS NOT NULL AND source IN (SELECT source FROM enabled)
      AND NOT (source IN (SELECT source FROM scraped) AND source IN (SELECT source FROM fresh))
      AND NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.id = old.id) {keep}
)
"""
_MERGED = "SELECT source, origin, count(*) AS n FROM merged GROUP BY source, origin"

_SIGN = "(" + "|".join(x.replace("$", "[$]") for x in SIGNS) + ")"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(words, ' {w} ')" for w in words) + ")"


SQL = {
    "base_visible": f"SELECT source, count(*) AS n FROM listings WHERE {_SEEN} GROUP BY source",
    "search_substring": f"SELECT id, source, last_verified_at FROM listings WHERE contains({_TEXT}, 'museum grade')",
    "filter_conjunction": f"SELECT id, title, price FROM listings WHERE {_CHOSEN}",
    "facet_rollup": f"""
        WITH k AS (SELECT {_CATEGORY} AS category, coalesce(subtype, '__unspecified__') AS subtype FROM listings WHERE {_SEEN})
        SELECT category, subtype, CAST(grouping(category, subtype) AS INT) AS level, count(*) AS n FROM k GROUP BY ROLLUP (category, subtype)
    """,
    "facet_sibling_scope": f"SELECT {_CATEGORY} AS category, count(*) AS n FROM listings WHERE {_SEEN} AND contains({_TEXT}, 'slice') AND source = 'Halden Bolide Works' GROUP BY 1",
    "facet_zero_fill": f"""
        SELECT f.category, count(l.category) AS n FROM (SELECT unnest({_FAMILIES}) AS category) f
        LEFT JOIN (SELECT {_CATEGORY} AS category FROM listings WHERE {_SEEN}) l ON f.category = l.category GROUP BY f.category
    """,
    "summary_avg_min": f"""
        SELECT count(*) AS n, count(DISTINCT nullif(trim(title), '')) AS titles, {_r('avg(v)', 4)} AS mean, min(v) AS least
        FROM (SELECT title, CASE WHEN isfinite({_RATIO}) THEN {_RATIO} END AS v FROM listings WHERE {_CHOSEN})
    """,
    "scope_single_title": f"""
        SELECT count(*) AS n, count(DISTINCT nullif(trim(title), '')) AS titles,
               CASE WHEN count(DISTINCT nullif(trim(title), '')) = 1 THEN avg({_RATIO}) END AS mean,
               CASE WHEN count(DISTINCT nullif(trim(title), '')) = 1 THEN min({_RATIO}) END AS least
        FROM listings WHERE {_SEEN}
    """,
    "price_stats_by_group": f"""
        SELECT meteorite_type AS "group", count(*) AS n, count(DISTINCT source) AS sources, min(v) AS least, median(v) AS middle, {_r('avg(v)', 4)} AS mean, max(v) AS most
        FROM (SELECT meteorite_type, source, {_RATIO} AS v FROM listings WHERE {_SEEN}) WHERE v IS NOT NULL GROUP BY 1
    """,
    "price_histogram": f"""
        WITH known AS (SELECT source AS g, v FROM (SELECT source, {_RATIO} AS v FROM listings WHERE {_SEEN}) WHERE v IS NOT NULL),
        ranges AS (SELECT g, min(v) AS lo, max(v) AS hi, CASE WHEN min(v) = max(v) THEN 1 ELSE CAST(least(8, greatest(2, count(*))) AS INT) END AS b FROM known GROUP BY g),
        placed AS (SELECT k.g, CASE WHEN r.b = 1 THEN 0 ELSE CAST(least(r.b - 1, floor((v - lo) / (hi - lo) * b)) AS INT) END AS bucket FROM known k JOIN ranges r ON k.g = r.g),
        counted AS (SELECT g, bucket, count(*) AS n FROM placed GROUP BY g, bucket),
        frame AS (SELECT g, lo, hi, b, CAST(unnest(range(b)) AS INT) AS bucket FROM ranges)
        SELECT f.g AS "group", f.bucket, {_r('(lo + (hi - lo) / b * f.bucket)', 4)} AS low,
               {_r('(CASE WHEN f.bucket = b - 1 THEN hi ELSE lo + (hi - lo) / b * (f.bucket + 1) END)', 4)} AS high, coalesce(c.n, 0) AS n
        FROM frame f LEFT JOIN counted c ON f.g = c.g AND f.bucket = c.bucket
    """,
    "histogram_filter": "SELECT id, source, price_usd, last_verified_at FROM listings WHERE (price_usd >= 10 AND price_usd < 20) OR (price_usd >= 90 AND price_usd <= 100)",
    "group_cap": f"""
        WITH v AS (SELECT meteorite_type, source FROM listings WHERE {_RATIO} IS NOT NULL),
        a AS (SELECT 'meteorite_type' AS "by", meteorite_type AS "group", count(*) AS n FROM v GROUP BY meteorite_type),
        b AS (SELECT 'source' AS "by", source AS "group", count(*) AS n FROM v GROUP BY source)
        SELECT * FROM a WHERE (SELECT count(*) FROM a) <= 24 UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM b) <= 24
    """,
    "sort_nulls_last": """
        WITH one AS (SELECT id, title, price_usd FROM listings QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_verified_at DESC, title DESC NULLS LAST, price_usd DESC NULLS LAST) = 1),
        ranked AS (
            SELECT 'high' AS way, id, row_number() OVER (ORDER BY price_usd DESC NULLS LAST, title NULLS LAST, id) AS place FROM one
            UNION ALL SELECT 'low', id, row_number() OVER (ORDER BY price_usd NULLS LAST, title NULLS LAST, id) FROM one
        )
        SELECT way, id, CAST(place AS INT) AS place FROM ranked WHERE place <= 50
    """,
    "sort_natural": """
        WITH keyed AS (
            SELECT code, name, regexp_replace(regexp_replace(lower(name), '([0-9]+)', '000000000000\\1', 'g'), '0+([0-9]{12})($|[^0-9])', '\\1\\2', 'g') AS k FROM official_names
        )
        SELECT code, name, CAST(row_number() OVER (ORDER BY k NULLS LAST, name NULLS LAST, code) AS INT) AS place FROM keyed QUALIFY place <= 200
    """,
    "family_order": f"SELECT meteorite_type, CAST(coalesce(nullif(list_position({_FAMILIES}, {_CATEGORY}), 0), 99) AS INT) AS rank, count(*) AS n FROM listings GROUP BY 1, 2",
    "stage_counts": "SELECT stage, count(*) AS sources, count(*) FILTER (WHERE coalesce(enabled, TRUE)) AS enabled FROM sources GROUP BY stage",
    "fx_convert": f"""
        WITH rates AS (SELECT rate_date, currency, rate_to_usd AS rate FROM fx_rates WHERE provider = 'open board' QUALIFY row_number() OVER (PARTITION BY rate_date, currency ORDER BY published_at DESC, rate_to_usd DESC) = 1),
        c AS (SELECT l.*, {_r('(price * rate)', 2)} AS usd FROM listings l LEFT JOIN rates r ON l.fx_rate_date = r.rate_date AND l.currency = r.currency)
        SELECT id, last_verified_at, usd, CASE WHEN weight_g > 0 THEN {_r('(usd / weight_g)', 4)} END AS usd_per_g FROM c
    """,
    "fx_fallback": """
        WITH every AS (
            SELECT concat_ws('/', rate_date, currency) AS key, max(rate_to_usd) AS rate, 0 AS level FROM fx_rates WHERE provider = 'closing board' GROUP BY 1
            UNION ALL SELECT concat_ws('/', rate_date, currency), max(rate_to_usd), 1 FROM fx_rates WHERE provider = 'open board' GROUP BY 1
            UNION ALL SELECT concat_ws('/', fx_rate_date, currency), max(fx_rate_to_usd), 2 FROM listings WHERE currency IN ('EUR', 'GBP', 'CAD') GROUP BY 1
        )
        SELECT key, rate, CAST(level AS INT) AS level FROM every WHERE rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY level) = 1
    """,
    "alias_lookup": "SELECT a.alias, a.code, o.name, o.status FROM (SELECT DISTINCT alias, code FROM name_aliases) a LEFT JOIN official_names o ON a.code = o.code",
    "first_match_lookup": """
        WITH entries AS (SELECT name AS key, min(code) AS code FROM official_names WHERE status = 'Official' GROUP BY name),
        c AS (SELECT id, 0 AS place, canonical_name_display AS key FROM listings UNION ALL SELECT id, 1, canonical_name FROM listings UNION ALL SELECT id, 2, title FROM listings)
        SELECT c.id, CAST(c.place AS INT) AS place, e.code FROM c JOIN entries e ON c.key = e.key
        QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY c.place, c.key, e.code) = 1
    """,
    "status_filter_lookup": """
        WITH listed AS (SELECT title AS name FROM listings UNION SELECT alias FROM name_aliases),
        ok AS (SELECT code, name FROM official_names WHERE status = 'Official'),
        single AS (SELECT alias AS name, max(code) AS code FROM name_aliases GROUP BY alias HAVING count(DISTINCT code) = 1),
        hits AS (
            SELECT l.name, o.code, 0 AS place FROM listed l JOIN ok o ON l.name = o.name
            UNION ALL SELECT l.name, s.code, 1 FROM listed l JOIN single s ON l.name = s.name JOIN ok o ON s.code = o.code
        )
        SELECT name, code, CASE WHEN place = 0 THEN 'name' ELSE 'alias' END AS how FROM hits QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, code) = 1
    """,
    "first_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "newest_listing": "SELECT id, last_verified_at, source, available FROM listings QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_verified_at DESC, source DESC, available DESC) = 1",
    "merge_upsert": _RUNS.format(run=6, keep="") + _MERGED,
    "merge_without_preserve": _RUNS.format(run=4, keep="AND source IN (SELECT source FROM scraped)") + _MERGED,
    "empty_refreshes": "SELECT DISTINCT name AS source FROM sources WHERE name NOT IN (SELECT source FROM listings WHERE source IS NOT NULL)",
    "rotation_pick": """
        SELECT CAST(key AS INT) AS key, CAST(((CASE WHEN key > 0 THEN key - 1 ELSE key END) % n + n) % n AS INT) AS place
        FROM (SELECT unnest(range(-3, 41)) AS key), (SELECT count(*) AS n FROM sources WHERE coalesce(enabled, TRUE))
    """,
    "stable_order_topk": """
        WITH one AS (
            SELECT id, meteorite_type, subtype, price_per_g_usd, title FROM listings
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_verified_at DESC, meteorite_type DESC NULLS LAST, subtype DESC NULLS LAST, price_per_g_usd DESC NULLS LAST, title DESC NULLS LAST) = 1
        )
        SELECT id, title FROM one ORDER BY coalesce(meteorite_type, 'unknown'), coalesce(subtype, ''), coalesce(price_per_g_usd, 1e9), title NULLS FIRST, id LIMIT 100
    """,
    "locf": """
        SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_paid
        FROM events
    """,
    "set_algebra": """
        WITH a AS (SELECT DISTINCT name AS source FROM sources WHERE coalesce(enabled, TRUE)), b AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
        SELECT 'left_except_right' AS op, source FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right_except_left', source FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
        UNION ALL SELECT 'intersect', source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', source FROM (SELECT * FROM a UNION SELECT * FROM b)
    """,
    "dup_keys": "SELECT source, url, title, price, weight_g, count(*) AS n FROM listings GROUP BY ALL HAVING count(*) > 1",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS known, count(DISTINCT {c}) AS distinct_values FROM listings" for c in ("price", "currency", "weight_g", "canonical_name", "subtype", "image_url", "scraped_at", "seller")),
    "violations_row": f"WITH {_MASSED} SELECT id, last_verified_at, rule, severity FROM ({_VIOLATIONS})",
    "violation_counts": f"WITH {_MASSED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, count(*) AS n FROM massed WHERE {c}" for n, c, s in _RULES),
    "violations_meta": """
        WITH scraped AS (SELECT DISTINCT snapshot_id AS run, unnest(scraped_sources) AS source FROM inventory_runs), found AS (SELECT DISTINCT snapshot_id AS run, source FROM listing_snapshots WHERE source IS NOT NULL),
        faults AS (
            SELECT snapshot_id AS run, 'count' AS fault FROM inventory_runs WHERE source_count IS DISTINCT FROM len(scraped_sources)
            UNION ALL SELECT run, 'unknown' FROM scraped WHERE source NOT IN (SELECT name FROM sources)
            UNION ALL SELECT run, 'disabled' FROM scraped WHERE source IN (SELECT name FROM sources WHERE NOT coalesce(enabled, TRUE))
            UNION ALL SELECT run, 'silent' FROM (SELECT * FROM scraped EXCEPT SELECT * FROM found)
            UNION ALL SELECT run, 'unscraped' FROM (SELECT * FROM found WHERE run IN (SELECT snapshot_id FROM inventory_runs) EXCEPT SELECT * FROM scraped)
        )
        SELECT r.snapshot_id AS run, f.fault, (SELECT count(*) FROM faults x WHERE x.run = r.snapshot_id AND x.fault = f.fault) AS n
        FROM inventory_runs r, (VALUES ('count'), ('unknown'), ('disabled'), ('silent'), ('unscraped')) f(fault)
    """,
    "reject_top8": f"""
        WITH {_MASSED}, v AS ({_VIOLATIONS}), c AS (SELECT source, rule AS reason, count(*) AS n FROM v GROUP BY ALL)
        SELECT source, reason, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, reason) AS INT) AS place FROM c QUALIFY place <= 8
    """,
    "confidence_score": """
        WITH p AS (
            SELECT confidence, CAST(regexp_matches(url, '[?&]id=\\d+|/product/') AS INT) + CAST(coalesce(meteorite_type, 'unknown') <> 'unknown' AS INT)
                   + CAST(price IS NOT NULL AS INT) + CAST(weight_g IS NOT NULL AS INT) AS points FROM listings
        )
        SELECT CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS band, confidence, count(*) AS n FROM p GROUP BY 1, 2
    """,
    "row_id_sha1": "SELECT id, substr(sha1(concat_ws('|', source, url, coalesce(title, ''))), 1, 16) AS made_id, last_verified_at FROM listings",
    "domain_norm": f"""
        SELECT name, {_HOST('base_url')} AS host, array_to_string(list_slice(string_split({_HOST('base_url')}, '.'), -2, -1), '.') AS parent, CAST(len(inventory_urls) AS INT) AS pages FROM sources
    """,
    "domain_listings": f"""
        WITH rows AS (SELECT {_HOST('url')} AS host, source, count(*) AS n FROM listing_snapshots GROUP BY 1, 2), known AS (SELECT {_HOST('base_url')} AS host, name FROM sources)
        SELECT r.host, r.source, r.n, k.name IS NOT DISTINCT FROM r.source AS own FROM rows r LEFT JOIN known k ON r.host = k.host
    """,
    "classify_rules": f"SELECT metbull_type, {_FAMILY('metbull_type')} AS family, count(*) AS n FROM listings GROUP BY 1, 2",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "price_changes": "SELECT source, snapshot_id, count(price) AS priced, count(*) FILTER (WHERE NOT available) AS gone FROM listing_snapshots GROUP BY 1, 2",
    "buying_options": "SELECT option, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT unnest(buying_options) AS option, source FROM listings) GROUP BY option",
    "image_lists": """
        WITH u AS (SELECT id, last_verified_at, list_filter(list_concat([image_url], coalesce(image_urls, [])), lambda x: x IS NOT NULL AND regexp_matches(x, '^https?://')) AS urls FROM listings)
        SELECT id, last_verified_at, CAST(len(list_distinct(urls)) AS INT) AS images, urls[1] AS first_image FROM u
    """,
    "renewed_ratios": f"""
        WITH rates AS (SELECT currency AS code, rate_to_usd AS rate, rate_date FROM fx_rates WHERE provider = 'open board' AND rate_date = '2026-05-10' QUALIFY row_number() OVER (PARTITION BY currency ORDER BY published_at DESC, rate_to_usd DESC) = 1),
        c AS (SELECT l.id, l.last_verified_at, l.price, l.weight_g, {_r('(l.price * rate)', 2)} AS usd, rate_date FROM listings l LEFT JOIN rates r ON l.currency = r.code)
        SELECT id, last_verified_at, CASE WHEN weight_g > 0 AND price > 0 THEN {_r('(price / weight_g)', 4)} END AS price_per_g, usd AS price_usd,
               CASE WHEN weight_g > 0 AND price > 0 THEN {_r('(usd / weight_g)', 4)} END AS price_per_g_usd, CASE WHEN usd IS NOT NULL THEN rate_date END AS fx_rate_date
        FROM c
    """,
    "stream_upsert_snapshot": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "event_sessions": """
        WITH t AS (SELECT user_id, epoch_us(ts) AS us FROM events),
        s AS (SELECT *, CASE WHEN us - lag(us) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM s)
        SELECT user_id, min(us) AS start_us, count(*) AS n FROM n GROUP BY user_id, part
    """,
    "candidate_score": f"""
        WITH t AS (SELECT name, concat_ws(' ', name, description, notes) AS x, enabled, parser FROM sources),
        w AS (SELECT *, ' ' || array_to_string(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS words, lower(x) AS y FROM t),
        e AS (SELECT name,
            {_has(TERMS)} OR regexp_matches(y, '\\bnwa\\s*\\d') AS a,
            regexp_matches(y, '{_SIGN}\\s*\\d|\\d[\\d.,]*\\s*{_SIGN}') AS b,
            regexp_matches(y, '\\d[\\d.,]*\\s*({'|'.join(MASSES)})\\b') AS c,
            {_has(SHOP)} AS d,
            {_has(CLASSES)} OR regexp_matches(y, '\\bnwa\\s*\\d') AS f,
            coalesce(parser, 'unknown') <> 'unknown' AS g,
            {_has(REFERENCE)} AS h,
            NOT coalesce(enabled, FALSE) AS i FROM w)
        SELECT name, CAST(greatest(0, least(100, 25 * a::INT + 20 * b::INT + 20 * c::INT + 15 * d::INT + 10 * f::INT + 10 * g::INT - 15 * h::INT - 20 * i::INT)) AS INT) AS score,
               a::INT + b::INT + c::INT + d::INT + f::INT + g::INT + h::INT + i::INT AS found FROM e
    """,
    "domain_blocklist": f"""
        WITH hosts AS (SELECT DISTINCT url, regexp_replace(regexp_replace({_HOST('url')}, ':.*$', ''), '^www\\.', '') AS domain FROM listing_snapshots),
        own AS (SELECT {_HOST('base_url')} AS d FROM sources WHERE stage = 'active_verified' AND name LIKE '%a%' UNION SELECT {_HOST('u')} FROM (SELECT unnest(inventory_urls) AS u FROM sources WHERE stage = 'active_verified' AND name LIKE '%a%')),
        known AS (SELECT d FROM own WHERE d <> '' UNION SELECT array_to_string(list_slice(string_split(d, '.'), -2, -1), '.') FROM own WHERE d <> ''),
        blocked AS (SELECT DISTINCT {_HOST('base_url')} AS d FROM sources WHERE name LIKE '%e%'),
        j AS (SELECT h.*, EXISTS (SELECT 1 FROM known k WHERE k.d = h.domain OR k.d = array_to_string(list_slice(string_split(h.domain, '.'), -2, -1), '.')) AS is_known,
                     EXISTS (SELECT 1 FROM blocked b WHERE h.domain = b.d OR h.domain LIKE '%.' || b.d) AS is_blocked FROM hosts h)
        SELECT domain, CASE WHEN is_known THEN 'known' WHEN is_blocked THEN 'blocked' END AS reason, count(*) AS n FROM j GROUP BY 1, 2
    """,
    "suspicious_topn": f"WITH {_MASSED} SELECT id, last_verified_at, rule, severity FROM ({_VIOLATIONS}) ORDER BY id, last_verified_at, rule LIMIT 20",
    "event_windows": f"SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, {_r('sum(value)', 2)} AS total FROM events GROUP BY 1, 2",
    "subtype_forms": f"""
        WITH k AS (SELECT subtype, count(*) AS n FROM listings GROUP BY 1)
        SELECT subtype, CASE WHEN subtype LIKE 'Lunar (%' THEN regexp_extract(subtype, '\\((.*)\\)', 1) WHEN subtype LIKE 'Eucrite-%' OR subtype IS NULL THEN subtype ELSE upper(subtype) END AS form, {_FAMILY('subtype')} AS family,
               CAST(CASE WHEN subtype IS NULL THEN 0 WHEN subtype LIKE 'Lunar (%' OR subtype LIKE 'Eucrite-%' THEN 80 WHEN regexp_matches(subtype, '^I') THEN 90 WHEN subtype = 'Eucrite' THEN 30 WHEN regexp_matches(subtype, '[-/]') THEN 70 ELSE 50 END AS INT) AS says, n FROM k
    """,
    "subtype_order": """
        WITH k AS (SELECT DISTINCT subtype AS s FROM listings WHERE regexp_matches(subtype, '^(H|L|LL|CI|CM|CO|CV|CR|CK|EH|EL)[0-9]')),
        o AS (SELECT s, list_position(['H', 'L', 'LL', 'CI', 'CM', 'CO', 'CV', 'CR', 'CK', 'EH', 'EL'], regexp_extract(s, '^[A-Z]+', 0)) AS g, CAST(regexp_extract(s, '[0-9.]+', 0) AS DOUBLE) AS t FROM k)
        SELECT s AS subtype, CAST(row_number() OVER (ORDER BY g, t, s) AS INT) AS place FROM o
    """,
    "merged_classes": """
        WITH k AS (SELECT classification_text AS c, subtype AS s, meteorite_type AS m, count(*) AS n FROM listings GROUP BY ALL)
        SELECT c AS classification_text, s AS subtype, m AS meteorite_type, CASE WHEN c IS NULL THEN s WHEN s IS NULL OR list_contains(string_split(lower(c), ', '), lower(s)) THEN c ELSE c || ', ' || s END AS merged, n FROM k
    """,
    "clean_titles": """
        WITH t AS (SELECT id, last_verified_at, title, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' +([,.;:])', '\\1', 'g'), '([(\\[]) +', '\\1', 'g'), ' +([)\\]])', '\\1', 'g') AS cleaned,
                          replace(' ' || regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' sold by ', ' ') AS w FROM listings)
        SELECT id, last_verified_at, cleaned, coalesce(regexp_matches(w, ' (on hold|reserved|unavailable|discontinued|out of stock|outofstock|sold) '), FALSE) AS gone FROM t
    """,
    "url_parts": """
        WITH u AS (SELECT DISTINCT url FROM listing_snapshots), p AS (
            SELECT url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS path FROM u
        ), l AS (SELECT *, url_decode(regexp_extract(regexp_replace(regexp_replace(path, '\\?.*$', ''), '/+$', ''), '([^/]*)$', 1)) AS last FROM p)
        SELECT url, host, path, last, trim(regexp_replace(last, '[-_\\s]+', ' ', 'g')) AS words, coalesce(regexp_matches(url, '^https?://[^/?#]+', 'i'), FALSE) AS remote FROM l
    """,
    "page_hosts": """
        WITH p AS (SELECT name, base_url, unnest(inventory_urls) AS page FROM sources), h AS (
            SELECT name, lower(regexp_extract(base_url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS a, lower(regexp_extract(page, '^[a-zA-Z]+://([^/?#]*)', 1)) AS b FROM p)
        SELECT name, count(*) FILTER (WHERE b = '' OR a = b) AS own, count(*) AS pages FROM h GROUP BY name
    """,
    "written_numbers": """
        WITH w AS (SELECT DISTINCT regexp_replace(regexp_extract(title, '[0-9][0-9.,]*', 0), '[.,]+$', '') AS w FROM listings WHERE regexp_matches(title, '[0-9]'))
        SELECT w AS written,
               TRY_CAST(CASE WHEN regexp_full_match(w, '[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?') OR contains(w, '.') THEN replace(w, ',', '') ELSE replace(w, ',', '.') END AS DOUBLE) AS number,
               TRY_CAST(replace(w, ',', '') AS DOUBLE) AS price,
               TRY_CAST(CASE WHEN regexp_full_match(w, '[0-9]{1,3}(\\.[0-9]{3})+(,[0-9]{1,2})?') THEN replace(replace(w, '.', ''), ',', '.') WHEN contains(w, ',') AND NOT contains(w, '.') THEN replace(w, ',', '.') ELSE replace(w, ',', '') END AS DOUBLE) AS european FROM w
    """,
    "currency_codes": """
        SELECT currency, CASE WHEN upper(trim(currency)) IN ('$', 'US$') THEN 'USD' WHEN trim(currency) = '€' THEN 'EUR' ELSE nullif(upper(trim(currency)), '') END AS code, count(*) AS n FROM listings GROUP BY 1, 2
    """,
    "name_keys": """
        WITH n AS (SELECT name FROM official_names WHERE name IS NOT NULL UNION SELECT alias FROM name_aliases WHERE alias IS NOT NULL)
        SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower(name), 'ł', 'l')), '["''’‘“”`]', '', 'g'), '[\\s_\\-]+', ' ', 'g'), '\\bmeteorites?\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name_key FROM n
    """,
    "saved_rates": """
        SELECT fx_rate_date AS rate_date, currency, fx_rate_to_usd AS rate FROM listings WHERE fx_rate_to_usd > 0 AND currency IS NOT NULL AND fx_rate_date IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY currency ORDER BY fx_rate_date DESC, fx_rate_to_usd DESC) = 1
    """,
    "source_stages": """
        SELECT name, CASE WHEN coalesce(enabled, TRUE) THEN 'enabled' WHEN stage = 'disabled_policy_blocked' THEN 'policyBlocked' WHEN stage = 'disabled_parser_start' THEN 'parserStart' ELSE 'backlog' END AS stage_group,
               CAST(row_number() OVER (ORDER BY lower(coalesce(name, '')), name) AS INT) AS place FROM sources
    """,
}
