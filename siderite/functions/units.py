"""Masses and prices as sellers write them, parsed by JVM-side expressions.

The tables below are fixed values: unit factors, unit words and currency spellings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams in one unit.
GRAMS = {"g": 1.0, "kg": 1000.0, "mg": 0.001, "oz": 28.349523125, "ct": 0.2, "lb": 453.59237}
#: How a unit of mass is written in a title.
MASS_WORDS = {
    "g": ["g", "gr", "gm", "gms", "gram", "grams", "gramm", "gramme", "grammes", "gramo", "gramos"],
    "kg": ["kg", "kilo", "kilos", "kilogram", "kilograms", "kilogramm", "kilogrammes", "kilogramos"],
    "mg": ["mg", "milligram", "milligrams", "milligramm", "milligrammes", "miligramos"],
    "oz": ["oz", "ounce", "ounces", "once", "onces", "onza", "onzas", "unze", "unzen"],
    "ct": ["ct", "carat", "carats", "karat", "quilates"],
    "lb": ["lb", "lbs", "pound", "pounds", "pfund", "livres", "libras"],
}
#: How a seller's notes name the unit of all masses, looked for in this order.
NOTE_WORDS = [("mg", r"milligram|miligramo"), ("kg", r"kilogram|kilogramo"), ("oz", r"\bounces?\b|\bunzen?\b|\bonces?\b|\bonzas?\b"), ("ct", r"\bcarats?\b|\bkarat\b|\bquilates\b"), ("lb", r"\bpounds?\b|\bpfund\b|\blivres\b|\blibras\b"), ("g", r"\bgram")]
#: Currency spellings, lower case without outer blanks; then those that count hundredths.
CURRENCY_WORDS = {
    "USD": ["usd", "us dollar", "us dollars", "us$", "$"],
    "EUR": ["eur", "euro", "euros", "€"],
    "GBP": ["gbp", "gb pound", "gb pounds", "£"],
    "CAD": ["cad", "ca$", "c$"],
    "CHF": ["chf", "sfr", "sfr.", "fr."],
    "PLN": ["pln", "zł", "zl"],
    "JPY": ["jpy", "yen", "¥"],
}
HUNDREDTH_WORDS = {
    "USD": ["us cents", "usd (cents)", "usd cents", "¢", "cents"],
    "EUR": ["€ ct", "eur cent", "eur cents", "eurocent", "eurocents"],
    "GBP": ["pence", "p", "gbx"],
    "CAD": ["cad cents"],
    "CHF": ["rappen", "rp."],
    "PLN": ["grosz", "groszy", "gr."],
}

_UNIT = "(" + "|".join(sorted((w for ws in MASS_WORDS.values() for w in ws), key=lambda w: (-len(w), w))) + ")"
#: Space-separated thousands begin with one or two digits, so that the number of a name isn't taken along.
_NUMBER = r"(?:\d{1,2}(?: \d{3})+|\d+(?:[.,]\d+)*)"
#: The mass of the whole find, which says nothing about the piece.
TOTAL_FIND = r"(?i)\(?\b(?:TKW:?|total known weight:?|of)\s+\d[\d.,]*\s?(?:kg|g|t)\b(?:\s+total known weight)?\)?"
MASS = r"(?i)(?<![\w.,#])(?<!\d-)" + f"({_NUMBER})(-{_NUMBER})?" + r"\s?" + _UNIT + r"(?!\w)"
POUNDS_OUNCES = r"(?i)(?<![\w.,#])(" + _NUMBER + r")\s?(?:lbs?|pounds?)\.? (" + _NUMBER + r")\s?(?:oz|ounces?)(?!\w)"
_MONEY = r"US\$|CA\$|C\$|\$|€|£|¥|(?<![a-z])(?:USD|EURO?|GBP|CAD|CHF|PLN|JPY|zł|zl|SFr\.?|Fr\.)"
MONEY_BEFORE = r"(?i)(" + _MONEY + r")\s?\d"
MONEY_AFTER = r"(?i)\d\s?(US Dollars?|US\$|CA\$|C\$|\$|€|£|¥|USD|EUROS?|EUR|GBP|CAD|CHF|PLN|JPY|yen|zł|zl|SFr\.?|Fr\.)(?!\w)"


def _lookup(word: Column, words: dict[str, list[str]]) -> Column:
    """The code whose spellings hold ``word``; null for none. One literal map, not a ladder of branches."""
    return F.create_map(*[F.lit(x) for code, spellings in words.items() for w in spellings for x in (w, code)])[word]


def unit_grams(unit: Column) -> Column:
    """Grams in one ``unit``; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in GRAMS.items() for x in pair])[unit]


def note_unit(notes: Column) -> Column:
    """The unit that free notes give for a seller's masses; grams where they name none or are null."""
    out = F.lit("g")
    for code, pattern in reversed(NOTE_WORDS):
        out = F.when(F.lower(notes).rlike(pattern), code).otherwise(out)
    return out


def written_number(tight: Column, whole_thousands: Column) -> Column:
    """A number without blanks, with a point or comma for decimals or thousands; null where it is none.

    One comma before three digits is ambiguous: ``whole_thousands`` says whether it parts thousands.
    """
    english = tight.rlike(r"^\d{1,3}(,\d{3})*,\d{3}\.\d+$|^\d{1,3}(,\d{3}){2,}$") | (whole_thousands & tight.rlike(r"^\d{1,3},\d{3}$"))
    german = tight.rlike(r"^\d{1,3}(\.\d{3})+,\d+$|^\d{1,3}(\.\d{3}){2,}$")
    return F.when(english, F.translate(tight, ",", "")).when(german, F.translate(F.translate(tight, ".", ""), ",", ".")).otherwise(F.translate(tight, ",", ".")).try_cast("double")


def with_title_mass(df: DataFrame, title: str = "title", out: str = "title_mass_g") -> DataFrame:
    """Adds the mass of the piece in grams as the title states it; null for none, a range, or a null title.

    The mass of the total find doesn't count; pounds and ounces side by side are one mass; of a mass given
    twice in two units the first is taken. Each step is a column of its own, so no pattern runs twice.
    """
    c = {k: f"_{out}_{k}" for k in ("text", "match", "pair", "number", "unit", "pounds", "ounces")}
    col = {k: F.col(f"`{v}`") for k, v in c.items()}
    rows = df.withColumn(c["text"], F.regexp_replace(F.regexp_replace(F.col(title), r"\s{2,}", " "), TOTAL_FIND, " "))
    rows = rows.withColumns({c["match"]: F.regexp_extract(col["text"], MASS, 0), c["pair"]: F.when(col["text"].rlike(r"(?i)\d\s?(?:lbs?|pounds?)\.? \d"), F.regexp_extract(col["text"], POUNDS_OUNCES, 0)).otherwise("")})
    rows = rows.withColumns({
        c["number"]: F.translate(F.regexp_extract(col["match"], r"^[\d.,\- ]*\d", 0), " ", ""),
        c["unit"]: _lookup(F.lower(F.regexp_extract(col["match"], r"([^\W\d_]+)$", 1)), MASS_WORDS),
        c["pounds"]: F.translate(F.regexp_extract(col["pair"], POUNDS_OUNCES, 1), " ", ""),
        c["ounces"]: F.translate(F.regexp_extract(col["pair"], POUNDS_OUNCES, 2), " ", ""),
    })
    grams = written_number(col["number"], col["unit"].isin("g", "mg", "ct")) * unit_grams(col["unit"])
    both = written_number(col["pounds"], F.lit(False)) * GRAMS["lb"] + written_number(col["ounces"], F.lit(False)) * GRAMS["oz"]
    is_range = col["match"].rlike(r"\d-\d")
    mass = F.when(col["pair"] != "", both).when((col["match"] == "") | is_range, None).otherwise(grams)
    return rows.withColumn(out, mass).withColumn(out, F.when(F.col(out) > 0, F.col(out))).drop(*c.values())


def with_currency(df: DataFrame, spelling: str, code: str = "currency_code", scale: str = "currency_scale") -> DataFrame:
    """Adds the ISO code of a freely spelled currency (null for an unknown one) and 0.01 if it counts hundredths, else 1."""
    cents = [w for ws in HUNDREDTH_WORDS.values() for w in ws]
    word = F.col("`_currency_word`")
    rows = df.withColumn("_currency_word", F.lower(F.trim(F.col(spelling))))
    known = {k: [*CURRENCY_WORDS[k], *HUNDREDTH_WORDS.get(k, [])] for k in CURRENCY_WORDS}
    return rows.withColumns({code: _lookup(word, known), scale: F.when(word.isin(cents), 0.01).otherwise(1.0)}).drop("_currency_word")


def title_currency(title: Column) -> Column:
    """The spelling of the currency beside a number in the title; null where there is none."""
    before = F.regexp_extract(title, MONEY_BEFORE, 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(F.regexp_extract(title, MONEY_AFTER, 1), F.lit("")))
