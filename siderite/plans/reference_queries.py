"""Queries over the inventory: exploration, enrichment, merging, quality. Their SQL twins are in reference_sql."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siderite.functions import numbers, taxonomy, text
from siderite.functions.units import with_title_mass
from siderite.operators import enrich, explore, listing, merge, quality, runs
from siderite.operators.enrich import rounded
from siderite.operators.explore import Selection
from siderite.session import ensure_checkpoint_dir
from siderite.sources import rates
from siderite.sources.tables import table
from siderite.streaming import upsert

TEXT = ["title", "canonical_name_display", "meteorite_type", "subtype", "source"]
CHOSEN = Selection(search="slice", category="iron", source="Halden Bolide Works")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "listings")


def _usd_per_g(df: DataFrame) -> DataFrame:
    return df.withColumn("usd_ratio", explore.usd_value(F.col("price_per_g_usd"), F.col("price_per_g"), F.col("currency")))


def base_visible(spark, sf_dir):
    return explore.visible(_listings(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def search_substring(spark, sf_dir):
    return explore.select_rows(_listings(spark, sf_dir), Selection(search="Museum Grade", include_unavailable=True), TEXT).select("id", "source", "last_verified_at")


def filter_conjunction(spark, sf_dir):
    return explore.select_rows(_listings(spark, sf_dir), CHOSEN, TEXT).select("id", "title", "price")


def facet_rollup(spark, sf_dir):
    return explore.facet_counts(explore.visible(_listings(spark, sf_dir)))


def facet_sibling_scope(spark, sf_dir):
    scope = explore.select_rows(_listings(spark, sf_dir), Selection(search=CHOSEN.search, source=CHOSEN.source), TEXT)
    return scope.groupBy(explore.category_key(F.col("meteorite_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def facet_zero_fill(spark, sf_dir):
    return explore.facet_counts_for(explore.visible(_listings(spark, sf_dir)), explore.FAMILY_ORDER)


def summary_avg_min(spark, sf_dir):
    rows = _usd_per_g(explore.select_rows(_listings(spark, sf_dir), CHOSEN, TEXT))
    out = explore.ratio_summary(rows, F.col("usd_ratio"), scoped=True)
    return out.select("n", "titles", rounded(F.col("mean"), 4).alias("mean"), "least")


def scope_single_title(spark, sf_dir):
    rows = _usd_per_g(explore.visible(_listings(spark, sf_dir)))
    return explore.ratio_summary(rows, F.col("usd_ratio"))


def price_stats_by_group(spark, sf_dir):
    rows = _usd_per_g(explore.visible(_listings(spark, sf_dir)))
    stats = explore.group_stats(rows, "meteorite_type", "usd_ratio")
    return stats.select("group", "n", "sources", "least", "middle", rounded(F.col("mean"), 4).alias("mean"), "most")


def price_histogram(spark, sf_dir):
    rows = _usd_per_g(explore.visible(_listings(spark, sf_dir)))
    return explore.histogram(rows, "source", "usd_ratio").select("group", "bucket", rounded(F.col("low"), 4).alias("low"), rounded(F.col("high"), 4).alias("high"), "n")


def histogram_filter(spark, sf_dir):
    rows = _listings(spark, sf_dir).where(explore.in_bucket(F.col("price_usd"), 10.0, 20.0, last=False) | explore.in_bucket(F.col("price_usd"), 90.0, 100.0, last=True))
    return rows.select("id", "source", "price_usd", "last_verified_at")


def group_cap(spark, sf_dir):
    rows = _usd_per_g(_listings(spark, sf_dir))
    few = explore.capped_groups(explore.group_stats(rows, "meteorite_type", "usd_ratio")).select(F.lit("meteorite_type").alias("by"), "group", "n")
    many = explore.capped_groups(explore.group_stats(rows, "source", "usd_ratio")).select(F.lit("source").alias("by"), "group", "n")
    return few.unionByName(many)


def sort_nulls_last(spark, sf_dir):
    rows = merge.last_wins(_listings(spark, sf_dir).select("id", "title", "price_usd", "last_verified_at"), ["id"], "last_verified_at")
    high = explore.top_rows(rows, F.col("price_usd"), 50, descending=True).select(F.lit("high").alias("way"), "id", "place")
    return high.unionByName(explore.top_rows(rows, F.col("price_usd"), 50).select(F.lit("low").alias("way"), "id", "place"))


def sort_natural(spark, sf_dir):
    names = table(spark, sf_dir, "official_names").select("code", F.col("name").alias("title"), "name")
    return explore.top_rows(names, explore.natural_key(F.col("name")), 200, ties=("title", "code")).select("code", "name", "place")


def family_order(spark, sf_dir):
    rows = _listings(spark, sf_dir).groupBy("meteorite_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("meteorite_type", explore.family_rank(F.col("meteorite_type")).alias("rank"), "n")


def stage_counts(spark, sf_dir):
    return explore.stage_counts(table(spark, sf_dir, "sources"))


def _open_rates(spark, sf_dir):
    known = table(spark, sf_dir, "fx_rates").where("provider = 'open board'")
    return known.groupBy(F.col("rate_date").alias("fx_rate_date"), "currency").agg(F.max(F.struct("published_at", "rate_to_usd")).alias("r")).select("fx_rate_date", "currency", F.col("r.rate_to_usd").alias("rate"))


def fx_convert(spark, sf_dir):
    rows = _listings(spark, sf_dir).select("id", "price", "currency", "weight_g", "fx_rate_date", "last_verified_at")
    return enrich.convert(rows, _open_rates(spark, sf_dir), ["fx_rate_date", "currency"]).select("id", "last_verified_at", "usd", "usd_per_g")


def fx_fallback(spark, sf_dir):
    known = table(spark, sf_dir, "fx_rates").withColumn("key", F.concat_ws("/", "rate_date", "currency"))
    by = lambda p: known.where(F.col("provider") == p).groupBy("key").agg(F.max("rate_to_usd").alias("rate"))
    derived = _listings(spark, sf_dir).where("currency IN ('EUR', 'GBP', 'CAD')").groupBy(F.concat_ws("/", "fx_rate_date", "currency").alias("key")).agg(F.max("fx_rate_to_usd").alias("rate"))
    return enrich.first_known(by("closing board"), by("open board"), derived, key="key", value="rate")


def alias_lookup(spark, sf_dir):
    aliases = table(spark, sf_dir, "name_aliases").select("alias", "code").distinct()
    return aliases.join(table(spark, sf_dir, "official_names").select("code", "name", "status"), "code", "left").select("alias", "code", "name", "status")


def first_match_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "official_names").where("status = 'Official'")
    entries = names.groupBy(F.col("name").alias("key")).agg(F.min("code").alias("code"))
    rows = _listings(spark, sf_dir).select("id", F.posexplode(F.array("canonical_name_display", "canonical_name", "title")).alias("place", "key"))
    return enrich.first_match(rows.where("key IS NOT NULL"), "id", "place", "key", entries).select("id", "place", "code")


def status_filter_lookup(spark, sf_dir):
    listed = _listings(spark, sf_dir).select(F.col("title").alias("name")).unionByName(table(spark, sf_dir, "name_aliases").select(F.col("alias").alias("name")))
    return enrich.name_lookup(listed, table(spark, sf_dir, "name_aliases"), table(spark, sf_dir, "official_names"))


def first_wins(spark, sf_dir):
    return merge.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


def last_wins(spark, sf_dir):
    return merge.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def newest_listing(spark, sf_dir):
    return enrich.newest(_listings(spark, sf_dir), ["id"], ["last_verified_at"], ["last_verified_at", "source", "available"])


def _runs(spark, sf_dir, run):
    """(old, fresh, scraped, enabled) of a run: the inventory before it, its own rows, and what it says it scraped."""
    snapshots = table(spark, sf_dir, "listing_snapshots").select("snapshot_id", F.col("url").alias("id"), "source").distinct()
    old, fresh = (snapshots.where(F.col("snapshot_id") == k).drop("snapshot_id") for k in (run - 1, run))
    scraped = table(spark, sf_dir, "inventory_runs").where(F.col("snapshot_id") == run).select(F.explode("scraped_sources").alias("source"))
    enabled = table(spark, sf_dir, "sources").where("coalesce(enabled, true)").select(F.col("name").alias("source"))
    return old, fresh, scraped, enabled


def merge_upsert(spark, sf_dir):
    old, fresh, scraped, enabled = _runs(spark, sf_dir, 6)
    return merge.merge_inventory(old, fresh, scraped, enabled).groupBy("source", "origin").agg(F.count(F.lit(1)).alias("n"))


def merge_without_preserve(spark, sf_dir):
    old, fresh, scraped, enabled = _runs(spark, sf_dir, 4)
    return merge.merge_inventory(old, fresh, scraped, enabled, preserve=False).groupBy("source", "origin").agg(F.count(F.lit(1)).alias("n"))


def empty_refreshes(spark, sf_dir):
    """Sources of the registry that gave the newest inventory no row."""
    registry = table(spark, sf_dir, "sources").select(F.col("name").alias("source"))
    return merge.empty_refreshes(_listings(spark, sf_dir), registry)


def rotation_pick(spark, sf_dir):
    enabled = table(spark, sf_dir, "sources").where("coalesce(enabled, true)").count()  # one number of the registry
    return spark.createDataFrame([(key, merge.rotation_index(str(key), enabled)) for key in range(-3, 41)], "key int, place int")


def stable_order_topk(spark, sf_dir):
    rows = enrich.newest(_listings(spark, sf_dir), ["id"], ["last_verified_at"], ["meteorite_type", "subtype", "price_per_g_usd", "title"])
    return merge.in_display_order(rows).limit(100).select("id", "title")


def locf(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    return enrich.carried(events, "user_id", "event_id", "paid", "last_paid").select("event_id", "last_paid")


def set_algebra(spark, sf_dir):
    registry = table(spark, sf_dir, "sources").where("coalesce(enabled, true)").select(F.col("name").alias("source"))
    return quality.set_algebra(registry, table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source"), "source")


def dup_keys(spark, sf_dir):
    return quality.repeated_keys(_listings(spark, sf_dir), ["source", "url", "title", "price", "weight_g"])


def null_profile(spark, sf_dir):
    return quality.null_profile(_listings(spark, sf_dir), ["price", "currency", "weight_g", "canonical_name", "subtype", "image_url", "scraped_at", "seller"])


def _massed(spark, sf_dir):
    return with_title_mass(_listings(spark, sf_dir)), [*quality.listing_rules(), *quality.mass_rules()]


def violations_row(spark, sf_dir):
    return quality.violations(*_massed(spark, sf_dir), ["id", "last_verified_at"])


def violation_counts(spark, sf_dir):
    return quality.rule_counts(*_massed(spark, sf_dir))


def violations_meta(spark, sf_dir):
    told = table(spark, sf_dir, "inventory_runs").select(F.col("snapshot_id").alias("run"), "source_count", "scraped_sources")
    held = table(spark, sf_dir, "listing_snapshots").select(F.col("snapshot_id").alias("run"), "source").distinct()
    return quality.metadata_faults(told, held, table(spark, sf_dir, "sources").select(F.col("name").alias("source"), "enabled"))


def reject_top8(spark, sf_dir):
    broken = quality.violations(*_massed(spark, sf_dir), ["source", "id"])
    return runs.top_reasons(broken.select("source", F.col("rule").alias("reason")), 8)


def confidence_score(spark, sf_dir):
    evidence = [F.col("url").rlike(r"[?&]id=\d+|/product/"), F.coalesce("meteorite_type", F.lit("unknown")) != "unknown", F.col("price").isNotNull(), F.col("weight_g").isNotNull()]
    return _listings(spark, sf_dir).groupBy(listing.confidence(evidence).alias("band"), "confidence").agg(F.count(F.lit(1)).alias("n"))


def row_id_sha1(spark, sf_dir):
    return _listings(spark, sf_dir).select("id", listing.row_id(F.col("source"), F.col("url"), F.col("title")).alias("made_id"), "last_verified_at")


def domain_norm(spark, sf_dir):
    host = text.domain(F.col("base_url"))
    return table(spark, sf_dir, "sources").select("name", host.alias("host"), text.parent_domain(host).alias("parent"), F.size("inventory_urls").alias("pages"))


def domain_listings(spark, sf_dir):
    known = domain_norm(spark, sf_dir).select(F.col("host"), F.col("name"))
    rows = table(spark, sf_dir, "listing_snapshots").groupBy(text.domain(F.col("url")).alias("host"), "source").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(known, "host", "left").select("host", "source", "n", F.col("name").eqNullSafe(F.col("source")).alias("own"))


def classify_rules(spark, sf_dir):
    kinds = _listings(spark, sf_dir).groupBy("metbull_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("metbull_type", taxonomy.family_of(taxonomy.canonical_subtype(F.col("metbull_type"))).alias("family"), "n")


def subtype_forms(spark, sf_dir):
    """Every recorded subtype in its one spelling, with its family and what it says."""
    kinds = _listings(spark, sf_dir).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
    form = taxonomy.canonical_subtype(F.col("subtype"))
    return kinds.select("subtype", form.alias("form"), taxonomy.family_of(form).alias("family"), taxonomy.precedence(form).alias("says"), "n")


def subtype_order(spark, sf_dir):
    """Subtypes as they are listed, by family and kind."""
    kinds = _listings(spark, sf_dir).where("subtype RLIKE '^(H|L|LL|CI|CM|CO|CV|CR|CK|EH|EL)[0-9]'").select("subtype").distinct()
    return kinds.withColumn("place", F.row_number().over(Window.orderBy(taxonomy.subtype_rank(F.col("subtype")), "subtype")).cast("int"))  # some dozens of subtypes


def title_subtypes(spark, sf_dir):
    """The best subtype that each title names, by the recorded one: titles that state a class of ordinary chondrites."""
    rows = _listings(spark, sf_dir).where("subtype RLIKE '^(H|L|LL)[3-7]$'")
    best = taxonomy.best_subtype(taxonomy.subtype_tokens(F.col("title")))
    return rows.groupBy((best == F.col("subtype")).alias("same"), best.isNull().alias("silent")).agg(F.count(F.lit(1)).alias("n"))


def merged_classes(spark, sf_dir):
    """Classification texts with the subtype added, and without what contradicts the type."""
    rows = _listings(spark, sf_dir).groupBy("classification_text", "subtype", "meteorite_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("classification_text", "subtype", "meteorite_type", taxonomy.merged_text(F.col("classification_text"), F.col("subtype")).alias("merged"), "n")


def clean_titles(spark, sf_dir):
    return _listings(spark, sf_dir).select("id", "last_verified_at", text.clean(F.col("title")).alias("cleaned"), text.unavailable(F.col("title")).alias("gone"))


def display_names(spark, sf_dir):
    names = table(spark, sf_dir, "official_names").select(F.explode(F.array("name", F.upper("name"), "abbrev")).alias("name")).distinct()
    return names.where("name IS NOT NULL").select("name", text.display_case(F.col("name")).alias("shown"), text.selector_key(F.col("name")).alias("key"), text.slug("n", F.col("name")).alias("slug"))


def url_parts(spark, sf_dir):
    urls = table(spark, sf_dir, "listing_snapshots").select("url").distinct()
    return urls.select("url", text.host(F.col("url")).alias("host"), text.path_and_query(F.col("url")).alias("path"), text.last_segment(F.col("url")).alias("last"), text.name_from_url(F.col("url")).alias("words"), text.remote_url(F.col("url")).alias("remote"))


def page_hosts(spark, sf_dir):
    """Inventory pages that stand on another host than their source."""
    pages = table(spark, sf_dir, "sources").select("name", "base_url", F.explode("inventory_urls").alias("page"))
    return pages.groupBy("name").agg(F.count_if(text.same_domain(F.col("base_url"), F.col("page"))).alias("own"), F.count(F.lit(1)).alias("pages"))


def written_numbers(spark, sf_dir):
    """The first number of each title, read in the ways numbers are written."""
    digits = F.regexp_extract("title", r"[0-9][0-9.,]*", 0)
    rows = _listings(spark, sf_dir).select(F.regexp_replace(digits, "[.,]+$", "").alias("written")).where("written <> ''").distinct()
    return rows.select("written", numbers.number(F.col("written")).alias("number"), numbers.price_number(F.col("written")).alias("price"), numbers.price_number(F.col("written"), True).alias("european"))


def title_prices(spark, sf_dir):
    """The prices in dollars and euros that titles state."""
    found = numbers.prices_in(F.col("title"))
    rows = _listings(spark, sf_dir).select("id", "last_verified_at", found.alias("p"))
    return rows.where(F.size("p") > 0).select("id", "last_verified_at", F.size("p").alias("prices"), F.get("p", F.lit(0))["currency"].alias("currency"), F.get("p", F.lit(0))["value"].alias("first"))


def currency_codes(spark, sf_dir):
    rows = _listings(spark, sf_dir).groupBy("currency").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("currency", numbers.currency_of(F.col("currency")).alias("code"), "n")


def name_keys(spark, sf_dir):
    names = table(spark, sf_dir, "official_names").select("name").unionByName(table(spark, sf_dir, "name_aliases").select(F.col("alias").alias("name"))).where("name IS NOT NULL").distinct()
    return enrich.with_name_key(names, "name").select("name", "name_key")


def saved_rates(spark, sf_dir):
    return rates.rates_from_listings(_listings(spark, sf_dir))


def source_stages(spark, sf_dir):
    return explore.sorted_sources(table(spark, sf_dir, "sources"))


def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def price_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "listing_snapshots").groupBy("source", "snapshot_id").agg(F.count("price").alias("priced"), F.count_if(~F.col("available")).alias("gone"))
    return rows


def buying_options(spark, sf_dir):
    return _listings(spark, sf_dir).select(F.explode("buying_options").alias("option"), "source").groupBy("option").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


def image_lists(spark, sf_dir):
    urls = text.image_list(F.concat(F.array("image_url"), F.coalesce("image_urls", F.array().cast("array<string>"))))
    return _listings(spark, sf_dir).select("id", "last_verified_at", F.size(urls).alias("images"), F.get(urls, F.lit(0)).alias("first_image"))


def candidate_score(spark, sf_dir):
    """How much the registry's own descriptions look like a seller's page."""
    rows = table(spark, sf_dir, "sources").withColumn("text", F.concat_ws(" ", "name", "description", "notes"))
    scored = runs.candidate_scores(rows, runs.shop_evidence(F.col("text"), F.col("enabled"), F.col("parser")))
    return scored.select("name", "score", F.size("evidence").alias("found"))


def domain_blocklist(spark, sf_dir):
    """Hosts of the snapshots screened against the registry's known and blocked domains."""
    sources = table(spark, sf_dir, "sources")
    results = table(spark, sf_dir, "listing_snapshots").groupBy("url").agg(F.count(F.lit(1)).alias("seen")).withColumn("seq", F.xxhash64("url"))
    known = runs.known_domains(sources.where("stage = 'active_verified' AND name LIKE '%a%'"))
    blocked = sources.where("name LIKE '%e%'").select(text.domain(F.col("base_url")).alias("domain")).distinct()
    screened = runs.screened(results, known, blocked)
    return screened.groupBy("domain", F.when(F.col("reason") == "repeated", None).otherwise(F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def suspicious_topn(spark, sf_dir):
    return quality.violations(*_massed(spark, sf_dir), ["id", "last_verified_at"]).orderBy("id", "last_verified_at", "rule").limit(20)


def renewed_ratios(spark, sf_dir):
    known = _open_rates(spark, sf_dir).where("fx_rate_date = '2026-05-10'").select("currency", "rate", F.col("fx_rate_date").alias("rate_date"))
    return listing.renewed(_listings(spark, sf_dir), known).select("id", "last_verified_at", "price_per_g", "price_usd", "price_per_g_usd", "fx_rate_date")


def stream_upsert_snapshot(spark, sf_dir):
    """The events as a stream, merged batch by batch: the newest event of each user and type."""
    ensure_checkpoint_dir(spark)
    schema = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value").schema
    home = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    upsert.upsert_stream(stream, f"{home}/table", ["user_id", "event_type"], "event_id", f"{home}/state").awaitTermination()
    return upsert.read_table(spark, f"{home}/table", schema)


def event_sessions(spark, sf_dir):
    """Runs of a user's events without a gap of an hour; on a batch the watermark drops nothing."""
    return upsert.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "1 hour", "1 hour").select(F.col("key").alias("user_id"), F.unix_micros("start").alias("start_us"), "n")


def event_windows(spark, sf_dir):
    """Events of each type by day."""
    counted = upsert.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")
    return counted.select(F.unix_micros("start").alias("start_us"), F.col("key").alias("event_type"), "n", rounded(F.col("total"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        base_visible, search_substring, filter_conjunction, facet_rollup, facet_sibling_scope, facet_zero_fill, summary_avg_min, scope_single_title, price_stats_by_group,
        price_histogram, histogram_filter, group_cap, sort_nulls_last, sort_natural, family_order, stage_counts, fx_convert, fx_fallback, alias_lookup, first_match_lookup,
        status_filter_lookup, first_wins, last_wins, newest_listing, merge_upsert, merge_without_preserve, empty_refreshes, rotation_pick, stable_order_topk, locf, set_algebra,
        dup_keys, null_profile, violations_row, violation_counts, violations_meta, reject_top8, confidence_score, row_id_sha1, domain_norm, domain_listings, classify_rules,
        json_props, price_changes, buying_options, image_lists, candidate_score, domain_blocklist, suspicious_topn, renewed_ratios, stream_upsert_snapshot, event_sessions,
        event_windows, subtype_forms, subtype_order, title_subtypes, merged_classes, clean_titles, display_names, url_parts, page_hosts, written_numbers, title_prices, currency_codes,
        name_keys, saved_rates, source_stages,
    )
}
