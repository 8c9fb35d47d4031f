"""Numbers and prices as text, JVM-side; null where there is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A price with its currency before it: dollar and euro signs and codes.
PRICE = r"(?i)(?:US\$|\$|\bUSD|\bEUR|€)\s*[0-9][0-9,.]*"


def _bare(text: Column) -> Column:
    return F.trim(F.translate(text, " ", ""))


def _in_thousands(whole: Column, mark: str) -> Column:
    """Whether a mark parts a whole number into its thousands."""
    parts = F.split(whole, "[" + mark + "]")
    return (F.size(parts) > 1) & F.length(parts[0]).between(1, 3) & F.forall(F.slice(parts, 2, F.size(parts)), lambda x: x.rlike("^[0-9]{3}$"))


def number(text: Column) -> Column:
    """1,234.5 and 1,234 part thousands, a lone comma otherwise the decimals; a leading comma or point means 0."""
    bare = _bare(text)
    led = F.concat(F.when(F.substring(bare, 1, 1).isin(",", "."), "0").otherwise(""), bare)
    decimal = ~_in_thousands(F.substring_index(led, ".", 1), ",") & (F.instr(led, ".") == 0)
    return F.replace(led, F.lit(","), F.when(decimal, ".").otherwise("")).try_cast("double")


def price_number(text: Column, european: bool = False) -> Column:
    """Commas part thousands; with ``european`` 1.234,56 and 12,5 have decimal commas."""
    bare = _bare(text)
    if not european:
        return F.replace(bare, F.lit(","), F.lit("")).try_cast("double")
    cents = F.length(F.substring_index(bare, ",", -1)) <= 2
    grouped = _in_thousands(F.substring_index(bare, ",", 1), ".") & ((F.instr(bare, ",") == 0) | cents)
    decimal = grouped | (F.instr(bare, ".") == 0)
    tight = F.when(grouped, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return F.replace(tight, F.lit(","), F.when(decimal, ".").otherwise("")).try_cast("double")


def inferred_price(text: Column) -> Column:
    """The last separator has the decimals, unless it is the only kind and three digits follow it."""
    bare = F.regexp_replace(F.translate(text, "  ", ""), r"^[.,]+|[.,]+$", "")
    whole = bare.rlike(r"^[0-9]+(?:,[0-9]+)*,[0-9]{3}$|^[0-9]+(?:\.[0-9]+)*\.[0-9]{3}$")
    comma_last = F.locate(",", F.reverse(bare)) < F.locate(".", F.reverse(bare))
    both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
    cleaned = (
        F.when(both & comma_last, F.translate(F.translate(bare, ".", ""), ",", ".")).when(both, F.translate(bare, ",", ""))
        .when(whole, F.translate(bare, ",.", "")).otherwise(F.translate(bare, ",", "."))
    )
    return cleaned.try_cast("double")


def prices_in(text: Column, european: bool = False) -> Column:
    """Array of (currency, value) in the order of the text."""
    found = F.regexp_extract_all(text, F.lit(f"({PRICE})"), 1)
    value = lambda m: price_number(F.regexp_replace(F.regexp_extract(m, r"[0-9][0-9,.]*", 0), r"[.,]+$", ""), european)
    priced = F.transform(found, lambda m: F.struct(F.when(m.rlike(r"(?i)^(?:EUR|€)"), "EUR").otherwise("USD").alias("currency"), value(m).alias("value")))
    return F.filter(priced, lambda p: p["value"].isNotNull())


def currency_of(symbol: Column) -> Column:
    """$ and US$ are USD, € is EUR, other text in capitals is its own code; '' is null."""
    word = F.upper(F.trim(symbol))
    return F.when(word.isin("$", "US$"), "USD").when(word == "€", "EUR").otherwise(F.nullif(word, F.lit("")))


def minor_units(amount: Column, digits: Column) -> Column:
    """An amount in the smallest coin, of which 10^digits make one."""
    return amount.try_cast("double") / F.pow(F.lit(10.0), digits)
