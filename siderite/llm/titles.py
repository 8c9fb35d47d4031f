"""What a listing's title says, apart from masses: the words that may be a name, the dimensions, the collection number.

All of it is JVM-side; each step is a column of its own, so that no pattern runs twice. The tables are fixed
values: accents, words around a name, measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.functions.units import _NUMBER, _UNIT, TOTAL_FIND

#: Accented letters and what they become.
ACCENTED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīıłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuyyzzz"
#: Words that surround a name in a title and are no part of one.
AROUND = """
slice slices tranche scheibe vollscheibe teilscheibe corte lamina plytka plytki pietka individuum individu individual individuo okaz bruchstuck endstuck endschnitt endcut
fragment fragmento frag piece section talon part full thin partial partielle complete completa completo complet parcial final caly pelna czesc ganzer stein bout coupe cut end
type chondrite achondrite ordinary carbonaceous pallasite mesosiderite lunar martian
rare rara rzadki selten superb stunning wow nicely polished poliert etched museum grade museumsqualitat qualite musee museo pieza de espectacular magnifique belle croute frische kruste fresh crust
collector favourite investment certificate certificat certificado zertifikat certyfikatem with avec con mit z neu nouveaute novedad nowosc okazja free shipping
top sold reserved prov meteorite meteorit meteorito no nr
weight wt weighs gew gewicht peso pesa poids masse masa waga tkw art coll collection slg ex
""".split()

_SIZE = r"(\d[\d.,]*)\s?(?:x|×|by)\s?(\d[\d.,]*)\s?(?:x|×|by)\s?(\d[\d.,]*)\s?(mm|cm)(?!\w)"
#: Second words of a collection's name.
_HOUSE = r"([^\W\d_]+(?: (?i:House|Cabinet|Museum|Institute|Trust))?)"
#: The number a piece has in a collection, with the collection's name, in the ways sellers write it.
COLLECTION = [
    rf"(?i)\bex {_HOUSE} coll\. #(\d+)", rf"(?i)\bcoll\. {_HOUSE} (\d+)", rf"(?i)\bSlg\. {_HOUSE} Nr\. (\d+)", rf"\((?=[A-Z][a-z]){_HOUSE} (\d+)\)",
    rf"\b(?=[A-Z]{{3}}){_HOUSE} No (\d+)", rf"\b{_HOUSE} Collection no\. (\d+)",
]
_STOCK = r"(?i)(?:#|\bart\. ?|\[)[a-z]\d{1,5}\b\]?"
_PRICE_AFTER = r"(?i)(?:US\$|CA\$|C\$|\$|€|£|¥|\b(?:USD|EURO?|GBP|CAD|CHF|PLN|JPY|zł|zl|SFr\.?|Fr\.))\s?\d[\d.,]*"
_PRICE_BEFORE = r"(?i)\d[\d.,]*\s?(?:US Dollars?|US\$|CA\$|C\$|\$|€|£|¥|(?:USD|EUROS?|EUR|GBP|CAD|CHF|PLN|JPY|yen|zł|zl|SFr\.?|Fr\.)(?!\w))"
_MASSES = r"(?i)(?<![\w.,#])(?<!\d-)" + f"{_NUMBER}(?:-{_NUMBER})?" + r"\s?" + _UNIT + r"(?!\w)\.?"
_CLASS = r"(?i)(?:\btype )?(?<![\w#-])\(?(?:(?:LL|L|H|EH|EL|CV|CO|CM|CK|CR|CI|R|C)\d(?:[-/.]\d)?|I{1,3}[A-G]{1,2}|IV[AB]|PMG|Mesosiderite-A\d|Lunar \([^)]*\)|[A-Z][a-z]+-mmict|Eucrite|Diogenite|Howardite|Ureilite|Shergottite)\)?(?![\w-])"
_PHRASES = r"\b(?:whole|complete) stone\b|\bone of a kind\b|\bl@@k\b|\bnew arrival\b|\bgreat price\b|\bfrom space\b|\bon hold\b|\bsold out\b|\bbroken (?=frag)"
NOISE = [TOTAL_FIND, r"(?i)" + _SIZE, r"(?i)\d[\d.,]*\s?(?:mm|cm)\b", _MASSES, _PRICE_AFTER, _PRICE_BEFORE, *COLLECTION, _STOCK, _CLASS]


def fold(text: Column) -> Column:
    """Lower case without accents."""
    lower = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.translate(lower, ACCENTED, PLAIN)


def name_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the words of ``text`` that can be part of a name, as one string: letters, numbers apart, (x) as ``@x``.

    Measures, prices, references, classes and the words of AROUND are gone; the order is kept. Null gives null.
    """
    step = f"_{out}"
    rows = df.withColumn(step, F.regexp_replace(F.trim(F.col(text)), r"\s{2,}", " "))
    for i in range(0, len(NOISE), 3):
        cleaned = F.col(step)
        for pattern in NOISE[i : i + 3]:
            cleaned = F.regexp_replace(cleaned, pattern, " | ")
        rows = rows.withColumn(step, cleaned)
    return rows.withColumn(out, squeezed_words(fold(F.col(step)), AROUND)).drop(step)


def squeezed_words(folded: Column, around: list[str]) -> Column:
    """Words of folded text; a zero among letters is an o, letters and digits part, possessive s goes."""
    words = F.regexp_replace(folded, _PHRASES, " ")
    words = F.regexp_replace(words, r"(?<=[a-z])0(?![0-9])|(?<![a-z0-9])0(?=[a-z]{2})", "o")
    words = F.regexp_replace(words, r"\(([a-z])\)", " @$1 ")
    words = F.regexp_replace(words, r"['’`]s?(?![a-z])", " ")
    words = F.regexp_replace(words, r"['’`]", "")
    words = F.regexp_replace(words, r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    words = F.regexp_replace(words, r"[^a-z0-9@]+", " ")
    listed = F.array(*[F.lit(w) for w in around])
    kept = F.filter(F.split(F.trim(words), " "), lambda w: ~F.array_contains(listed, w)) if around else F.split(F.trim(words), " ")
    return F.array_join(kept, " ")


def with_sizes(df: DataFrame, text: str, out: str = "size_key") -> DataFrame:
    """Adds the three dimensions in whole micrometres, in order of size, as one string; null where there aren't three."""
    match, parts = f"_{out}_m", f"_{out}_p"
    rows = df.withColumn(match, F.regexp_extract(F.regexp_replace(F.col(text), r"\s{2,}", " "), r"(?i)" + _SIZE, 0))
    number = lambda s: F.translate(s, ",", ".").try_cast("double")
    scale = F.when(F.lower(F.col(match)).endswith("cm"), 10_000).otherwise(1_000)
    edges = F.transform(F.regexp_extract_all(F.col(match), F.lit(r"(\d[\d.,]*)"), 1), lambda s: F.round(number(s) * scale).cast("bigint"))
    rows = rows.withColumn(parts, F.when(F.col(match) != "", F.array_sort(edges)))
    whole = (F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull())
    return rows.withColumn(out, F.when(whole, F.array_join(F.col(parts), "x"))).drop(match, parts)


def with_collection_number(df: DataFrame, text: str, out: str = "collection_key") -> DataFrame:
    """Adds the collection and number a piece has there, as one folded string; null where the title names none."""
    step, key = f"_{out}_t", F.col(f"_{out}_k")
    rows = df.withColumn(step, F.regexp_replace(F.col(text), r"\s{2,}", " "))
    found = F.lit("")
    for pattern in reversed(COLLECTION):
        hit = F.regexp_extract(F.col(step), pattern, 0)
        found = F.when(hit != "", F.concat_ws("|", F.regexp_extract(F.col(step), pattern, 1), F.regexp_extract(F.col(step), pattern, 2))).otherwise(found)
    rows = rows.withColumn(f"_{out}_k", F.when(F.col(step).rlike(r"(?i)coll|slg\.| No \d|\([A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)? \d+\)"), found).otherwise(""))
    return rows.withColumn(out, F.when(key != "", fold(key))).drop(step, f"_{out}_k")
