"""Explicit schemas of the inventory and of what is landed from sellers; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LISTING = _struct(
    id=_S, source=_S, source_url=_S, url=_S, title=_S, canonical_name=_S, canonical_name_display=_S, canonical_name_source=_S, canonical_name_status=_S, price=_D, currency=_S, weight_g=_D, price_per_g=_D,
    price_usd=_D, price_per_g_usd=_D, fx_rate_to_usd=_D, fx_rate_date=_S, meteorite_type=_S, subtype=_S, classification_text=_S, image_url=_S, image_urls=T.ArrayType(_S), confidence=_S, available=_B, parser=_S,
    scraped_at=T.TimestampType(), last_verified_at=T.TimestampType(), metbull_code=_S, metbull_status=_S, metbull_type=_S, seller=_S, item_end_date=_S, buying_options=T.ArrayType(_S),
)
RATES = _struct(base=_S, target=_S, rates_to_usd=T.MapType(_S, _D), date=_S, source=_S)
INVENTORY = _struct(
    generated_at=_S, source_count=T.IntegerType(), listing_count=T.IntegerType(), scrape_mode=_S, preserve_existing=_B, scraped_sources=T.ArrayType(_S), preserved_sources=T.ArrayType(_S),
    empty_refresh_preserved_sources=T.ArrayType(_S), exchange_rates=RATES, rotation_index=T.IntegerType(), rotation_total=T.IntegerType(), rotation_key=_S, listings=T.ArrayType(LISTING),
)
REGISTRY = _struct(
    name=_S, parser=_S, stage=_S, base_url=_S, inventory_urls=T.ArrayType(_S), enabled=_B, description=_S, notes=_S, max_detail_pages=T.IntegerType(), max_api_pages=T.IntegerType(), max_products=T.IntegerType(),
    max_index_pages=T.IntegerType(), limit=T.IntegerType(), max_pages=T.IntegerType(), marketplace_id=_S, ebay_seller_username=_S, search_queries=T.ArrayType(_S),
)
#: What every payload reader gives: one row for each item offered.
OFFER = _struct(source=_S, item_id=_S, url=_S, title=_S, category=_S, tags=T.ArrayType(_S), description=_S, price=_D, currency=_S, available=_B, seller=_S, image_urls=T.ArrayType(_S), place=T.IntegerType())
PAGE = _struct(source=_S, url=_S, status=T.IntegerType(), body=_S)
