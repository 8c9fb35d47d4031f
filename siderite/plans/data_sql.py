"""DuckDB twins of the general data queries."""

from __future__ import annotations

from siderite.functions.units import CURRENCY_WORDS, GRAMS, HUNDREDTH_WORDS, MASS_WORDS, NOTE_WORDS

#: The plain form of a url, as siderite.functions.urls.plain_url gives it.
_PLAIN = """
    'https://' || regexp_replace(lower(split_part(split_part(rest, '?', 1), '/', 1)), '^www\\.', '')
    || regexp_replace(regexp_replace(split_part(rest, '?', 1), '^[^/]*', ''), '/+$', '')
    || CASE WHEN regexp_extract(rest, '[?&](id=[^&]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(rest, '[?&](id=[^&]*)', 1) END
"""

_CHANGES = f"""
WITH bare AS (
    SELECT snapshot_id, available, scraped_at, CASE WHEN isfinite(price) THEN CAST(round(price * 100) AS BIGINT) END AS cents,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
    FROM listing_snapshots WHERE url IS NOT NULL AND snapshot_id IS NOT NULL
), plain AS (SELECT snapshot_id, available, scraped_at, cents, {_PLAIN} AS url FROM bare
), newest AS (
    SELECT snapshot_id, url, cents, available FROM plain
    QUALIFY row_number() OVER (PARTITION BY snapshot_id, url ORDER BY scraped_at DESC NULLS LAST, cents DESC NULLS LAST, available DESC NULLS LAST) = 1
), pairs AS (SELECT lag(snapshot_id) OVER (ORDER BY snapshot_id) AS a, snapshot_id AS b FROM (SELECT DISTINCT snapshot_id FROM inventory_runs)
), old AS (SELECT p.b AS pair, n.* FROM newest n JOIN pairs p ON n.snapshot_id = p.a
), new AS (SELECT p.b AS pair, n.* FROM newest n JOIN pairs p ON n.snapshot_id = p.b WHERE p.a IS NOT NULL
), found AS (
    SELECT coalesce(n.pair, o.pair) AS snapshot_id, coalesce(n.url, o.url) AS url,
           CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM new n FULL JOIN old o ON n.pair = o.pair AND n.url = o.url
    WHERE o.url IS NULL OR n.url IS NULL OR n.cents IS DISTINCT FROM o.cents OR n.available IS DISTINCT FROM o.available
)
"""

_STATES = """
{p}long AS (
    SELECT 'source' AS field, source AS key_value, price_usd, scraped_at FROM {t}
    UNION ALL SELECT 'canonical_name', canonical_name, price_usd, scraped_at FROM {t}
), {p}state AS (
    SELECT field, key_value, count(*) AS {p}_rows, count(price_usd) AS {p}_values, min(price_usd) AS {p}_min,
           max(price_usd) AS {p}_max, max(scraped_at) AS {p}_newest
    FROM {p}long GROUP BY field, key_value
)
"""

SQL = {
    "p3_found": f"{_CHANGES} SELECT snapshot_id, url, change FROM found",
    "p3_change_counts": f"{_CHANGES} SELECT snapshot_id, change, count(*) AS urls FROM found GROUP BY snapshot_id, change",
    "p5_found": """
        SELECT 'source' AS field, source AS key_value FROM listings WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.05 * (SELECT count(*) FROM listings)
        UNION ALL SELECT 'canonical_name', canonical_name FROM listings WHERE canonical_name IS NOT NULL
        GROUP BY canonical_name HAVING count(*) >= 0.05 * (SELECT count(*) FROM listings)
    """,
    "p5_key_ranges": f"""
        WITH {_STATES.format(p='l', t='listings')}, {_STATES.format(p='r', t='listing_snapshots')}
        SELECT coalesce(l.field, r.field) AS field, coalesce(l.key_value, r.key_value) AS key_value,
               coalesce(l_rows, 0) AS l_rows, coalesce(l_values, 0) AS l_values, l_min, l_max, l_newest,
               coalesce(r_rows, 0) AS r_rows, coalesce(r_values, 0) AS r_values, r_min, r_max, r_newest,
               CASE WHEN l.key_value = r.key_value THEN l_rows * r_rows ELSE 0 END AS pairs
        FROM lstate l FULL JOIN rstate r ON l.field = r.field AND l.key_value IS NOT DISTINCT FROM r.key_value
    """,
}


def _number(text: str, whole: str) -> str:
    """A written number as DOUBLE; ``whole``: one comma before three digits parts thousands."""
    t = f"replace({text}, ' ', '')"
    return (
        f"CASE WHEN regexp_matches({t}, '^\\d{{1,3}}(,\\d{{3}})*,\\d{{3}}\\.\\d+$|^\\d{{1,3}}(,\\d{{3}}){{2,}}$') OR ({whole} AND regexp_matches({t}, '^\\d{{1,3}},\\d{{3}}$'))"
        f" THEN TRY_CAST(replace({t}, ',', '') AS DOUBLE)"
        f" WHEN regexp_matches({t}, '^\\d{{1,3}}(\\.\\d{{3}})+,\\d+$|^\\d{{1,3}}(\\.\\d{{3}}){{2,}}$') THEN TRY_CAST(replace(replace({t}, '.', ''), ',', '.') AS DOUBLE)"
        f" ELSE TRY_CAST(replace({t}, ',', '.') AS DOUBLE) END"
    )


_N = r"(?:\d{1,2}(?: \d{3})+|\d+(?:[.,]\d+)*)"
_UNITS = "|".join(sorted((w for ws in MASS_WORDS.values() for w in ws), key=lambda w: (-len(w), w)))
_UNIT_OF = "CASE " + " ".join(f"WHEN lower(g.u) IN ({', '.join(repr(w) for w in ws)}) THEN '{u}'" for u, ws in MASS_WORDS.items()) + " END"
_GRAMS_OF = "CASE {0} " + " ".join(f"WHEN '{u}' THEN {f!r}::DOUBLE" for u, f in GRAMS.items()) + " END"
_WORD = "lower(trim(spelled))"
_CODE = "CASE " + " ".join(f"WHEN {_WORD} IN ({', '.join(repr(w) for w in [*ws, *HUNDREDTH_WORDS.get(c, [])])}) THEN '{c}'" for c, ws in CURRENCY_WORDS.items()) + " END"
_SCALE = f"CASE WHEN {_WORD} IN ({', '.join(repr(w) for ws in HUNDREDTH_WORDS.values() for w in ws)}) THEN 0.01::DOUBLE ELSE 1::DOUBLE END"
_BEFORE = r"(US\$|CA\$|C\$|\$|€|£|¥|\b(?:USD|EURO?|GBP|CAD|CHF|PLN|JPY|zł|zl|SFr\.?|Fr\.))\s?\d"
_AFTER = r"\d\s?(US Dollars?|US\$|CA\$|C\$|\$|€|£|¥|USD|EUROS?|EUR|GBP|CAD|CHF|PLN|JPY|yen|zł|zl|SFr\.?|Fr\.)(?:$|[^\w])"
_NOTES = "CASE " + " ".join(f"WHEN regexp_matches(lower(notes), '{p}') THEN '{u}'" for u, p in NOTE_WORDS) + " ELSE 'g' END"

CLEAN_TITLE = "regexp_replace(regexp_replace(title, '\\s{2,}', ' ', 'g'), '\\(?\\b(?:TKW:?|total known weight:?|of)\\s+\\d[\\d.,]*\\s?(?:kg|g|t)\\b(?:\\s+total known weight)?\\)?', ' ', 'gi')"
#: From ``clean`` with x, a CLEAN_TITLE: ``stated`` with title_g, the mass of the piece in grams as the title states it.
STATED_MASS = f"""matched AS (
    SELECT *, regexp_extract(x, '(^|[^\\w.,#])({_N})(-{_N})?\\s?({_UNITS})($|[^\\w])', ['a', 'n', 'r', 'u', 'z'], 'i') AS g,
           regexp_extract(x, '(^|[^\\w.,#])({_N})\\s?(?:lbs?|pounds?)\\.? ({_N})\\s?(?:oz|ounces?)($|[^\\w])', ['a', 'p', 'o', 'z'], 'i') AS q
    FROM clean
), measured AS (
    SELECT *, {_UNIT_OF} AS unit FROM matched
), weighed AS (
    SELECT *, CASE WHEN q.p <> '' THEN ({_number('q.p', 'FALSE')}) * {GRAMS['lb']!r}::DOUBLE + ({_number('q.o', 'FALSE')}) * {GRAMS['oz']!r}::DOUBLE
                   WHEN g.n = '' OR g.r <> '' THEN NULL ELSE ({_number('g.n', "unit IN ('g', 'mg', 'ct')")}) * {_GRAMS_OF.format('unit')} END AS w FROM measured
), stated AS (SELECT *, CASE WHEN w > 0 THEN w END AS title_g FROM weighed)"""

_CONVERTED = f"""
WITH notes AS (SELECT name AS source, min({_NOTES}) AS declared FROM sources GROUP BY name),
rates AS (
    SELECT rate_date, currency AS code, rate_to_usd AS rate FROM fx_rates WHERE provider = 'open board'
    QUALIFY row_number() OVER (PARTITION BY rate_date, currency ORDER BY published_at DESC, rate_to_usd DESC) = 1
), clean AS (
    SELECT id, source, CASE WHEN NOT isnan(weight_g) THEN weight_g END AS weight_g, price, price_usd, fx_rate_date,
           {CLEAN_TITLE} AS x,
           coalesce(currency, CASE WHEN price IS NOT NULL THEN coalesce(nullif(regexp_extract(title, '{_BEFORE}', 1, 'i'), ''), nullif(regexp_extract(title, '{_AFTER}', 1, 'i'), '')) END) AS spelled
    FROM listings
), {STATED_MASS}, converted AS (
    SELECT s.*, coalesce(title_g, weight_g * {_GRAMS_OF.format("coalesce(n.declared, 'g')")}) AS mass_g, price * scale * rate AS usd
    FROM (SELECT *, {_CODE} AS code, {_SCALE} AS scale FROM stated) s
    LEFT JOIN notes n ON s.source = n.source LEFT JOIN rates r ON s.fx_rate_date = r.rate_date AND s.code = r.code
)
"""

SQL["p1_found"] = f"""{_CONVERTED}
SELECT DISTINCT id, 'weight_g' AS field FROM converted WHERE weight_g IS NOT NULL AND abs(weight_g - mass_g) > 0.01 * abs(mass_g)
UNION ALL
SELECT DISTINCT id, 'price_usd' FROM converted WHERE price_usd IS NOT NULL AND (price IS NULL OR abs(price_usd - usd) > 0.01 * abs(usd))
"""
SQL["p1_settled"] = f"{_CONVERTED} SELECT id, source, mass_g AS grams, usd FROM converted"
