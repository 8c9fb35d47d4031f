"""Exchange rates from landed payloads: dollars for one unit of each currency, with their date and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("USD", "EUR", "CAD")

_PAYLOAD = "struct<base:string,date:string,rates:map<string,double>,rates_to_usd:map<string,double>,time_last_update_unix:bigint,time_last_update_utc:string,source:string>"


def rates_from_payloads(payloads: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(seq, source, rate_date, currency, rate): one row for each currency of each payload that has all required ones.

    payloads: seq, source, body. A payload gives units for one dollar (``rates``, with base USD or no base, to
    be inverted), units for one of another base, or dollars for one unit (``rates_to_usd``). Its date is a
    date, seconds since 1970, or an RFC date. A body that is none of these, a rate that isn't positive, or a
    missing required currency leaves it out.
    """
    p = payloads.select("seq", "source", F.from_json("body", _PAYLOAD).alias("p"))
    # HTTP dates are in English whatever the session's locale
    http = F.to_date(F.try_to_timestamp(F.regexp_extract("p.time_last_update_utc", r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy")))
    date = F.coalesce(F.to_date(F.try_to_timestamp("p.date", F.lit("yyyy-MM-dd"))), F.to_date(F.timestamp_seconds("p.time_last_update_unix")), http)
    base = F.coalesce(F.upper("p.base"), F.lit("USD"))
    per_dollar = F.col("p.rates")
    # of another base, a dollar's units bring the others to dollars
    dollar = F.when(base == "USD", F.lit(1.0)).otherwise(F.col("p.rates")["USD"])
    inverted = F.transform_values(per_dollar, lambda _, r: F.when(r > 0, dollar / r))
    with_base = F.map_concat(F.map_filter(inverted, lambda k, _: k != base), F.create_map(base, dollar))
    to_usd = F.coalesce(F.col("p.rates_to_usd"), with_base)
    usable = F.map_filter(to_usd, lambda _, r: r.isNotNull() & (r > 0))
    rows = p.select("seq", "source", F.date_format(date, "yyyy-MM-dd").alias("rate_date"), usable.alias("m")).where("rate_date IS NOT NULL AND m IS NOT NULL")
    complete = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.map_keys("m"))) == 0
    return rows.where(complete).select("seq", "source", "rate_date", F.explode("m").alias("currency", "rate"))


def rates_from_listings(listings: DataFrame) -> DataFrame:
    """(rate_date, currency, rate): what saved rows were converted with, if no payload was kept; the newest of each currency."""
    known = listings.where("fx_rate_to_usd > 0 AND currency IS NOT NULL AND fx_rate_date IS NOT NULL")
    newest = F.max(F.struct("fx_rate_date", "fx_rate_to_usd")).alias("x")
    return known.groupBy("currency").agg(newest).select(F.col("x.fx_rate_date").alias("rate_date"), "currency", F.col("x.fx_rate_to_usd").alias("rate"))


def dollars_only(spark) -> DataFrame:
    """The rate that is left when nothing else is known."""
    return spark.createDataFrame([("USD", 1.0)], "currency string, rate double")
