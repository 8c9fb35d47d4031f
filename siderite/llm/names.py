"""Free-entered names mapped to a canonical list (problem 2): a partition-based pigeonhole join, in SQL only.

A title becomes its name words, its name words become spans, and equal spans are looked up once. A span that
differs from a listed form by at most K edits leaves one of the form's K + 1 segments whole, so an equality
join on (form length, segment, substring) finds all pairs within K edits; built-in levenshtein verifies them.
Numbers (without leading zeros) and the letters that tell names apart must agree exactly. Titles without a match come out of an
anti-join and are reported with code 0.

Scale: what is compared are distinct spans, which grow far slower than listings. The list and its segments
are small tables that the optimizer may broadcast below its size threshold; no side is hinted, nothing is
collected, all joins are equalities on keys that spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.llm.titles import fold, name_words, squeezed_words
from siderite.session import stored

#: Edits that the pigeonhole join finds; which of them are accepted: see ACCEPTED.
K = 2
#: One edit, or two that swap neighbouring letters; any two in long forms, and in shorter ones that a number confirms.
LONG_FORM, LONG_NUMBERED = 14, 9
#: Spans of at most so many words are looked up; listed forms of more words are found through squeezing.
SPAN_WORDS = 6
SHORTEST_FUZZY = 6

#: Compass adjectives that sellers shorten in area names.
COMPASS = {"northern": "north", "southern": "south", "eastern": "east", "western": "west"}
#: What else the first word of a place name is written as.
HEADS = {"mount": ["mt", "mont", "monte"], "fort": ["ft"], "saint": ["st"], "lake": ["lac", "lago"]}


def _parts(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """Adds words, number and letter of a listed name."""
    words = rows.select(*kept, squeezed_words(fold(F.col(text)), []).alias("_w"))
    return words.select(*kept, F.trim(F.regexp_replace("_w", r"@[a-z]|(?<![a-z0-9])\d+$", "")).alias("words"), F.regexp_extract("_w", r"(?<![a-z0-9])0*(\d+)$", 1).alias("number"), F.regexp_extract("_w", r"@([a-z])", 1).alias("letter"))


def listed_forms(official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(form, number, letter, code): every way a listed entry may be written, squeezed; code 0 for a form of several entries.

    A name beats an alias, a shortened area name one that was made by rule. Entries that aren't Official have
    code 0: their names are known, and name nothing.
    """
    entries = official_names.select("code", F.coalesce(F.col("status") == "Official", F.lit(False)).alias("official"), "name", "display_name", "abbrev")
    spelled = entries.select("code", "official", F.explode(F.array_compact(F.array("name", "display_name", "abbrev"))).alias("text")).select("*", F.lit(0).alias("rank"))
    aliased = name_aliases.where("alias IS NOT NULL").join(entries.select("code", "official"), "code").select("code", "official", F.col("alias").alias("text"), F.lit(1).alias("rank"))
    parts = _parts(spelled.unionByName(aliased), "text", "code", "official", "rank").where("words <> ''")
    words = F.split("words", " ")
    tail = F.array_join(F.slice(words, 2, 99), "")
    compass = F.create_map(*[F.lit(x) for pair in COMPASS.items() for x in pair])
    heads = F.create_map(*[x for k, v in HEADS.items() for x in (F.lit(k), F.array(*[F.lit(h) for h in v]))])
    made = F.when(
        (F.col("number") != "") & (F.size(words) > 1),
        F.array_compact(F.array(F.concat(F.substring("words", 1, 1), tail), F.concat(tail, words[0]), F.concat(compass[words[0]], tail), F.when(F.length(words[0]) > 4, words[0]))),
    ).otherwise(F.transform(F.coalesce(heads[words[0]], F.array().cast("array<string>")), lambda h: F.concat(h, tail)))
    plain = parts.select("code", "official", "rank", "number", "letter", F.translate("words", " ", "").alias("form"))
    ruled = parts.select("code", "official", F.lit(2).alias("rank"), "number", "letter", F.explode(made).alias("form"))
    best = plain.unionByName(ruled).groupBy("form", "number", "letter", "rank").agg(F.count_distinct("code").alias("codes"), F.max("code").alias("code"), F.max("official").alias("official"))
    pick = F.min(F.struct("rank", "codes", "code", "official"))
    chosen = best.groupBy("form", "number", "letter").agg(pick.alias("p"))
    return chosen.select("form", "number", "letter", F.when((F.col("p.codes") == 1) & F.col("p.official"), F.col("p.code")).otherwise(0).cast("bigint").alias("code"))


def name_spans(words: DataFrame) -> DataFrame:
    """(words, span, number, letter): each run of up to SPAN_WORDS letter words, joined, with what follows it.

    A span stands with and without the number and the letter after it; absent ones are ''.
    """
    tokens = words.select("words", F.split("words", " ").alias("t"))
    letters = F.transform("t", lambda w: w.rlike("^[a-z]+$"))
    tokens = tokens.select("words", "t", letters.alias("is_word"))
    starts = F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i")
    runs = tokens.select("*", starts).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(SPAN_WORDS), F.size("t") - F.col("i") + 1))).alias("len"))
    runs = runs.where(F.forall(F.slice("is_word", F.col("i"), F.col("len")), lambda x: x))
    after = lambda n: F.coalesce(F.get("t", F.col("i") + F.col("len") - 1 + n), F.lit(""))
    runs = runs.select("words", F.array_join(F.slice("t", F.col("i"), F.col("len")), "").alias("span"), after(0).alias("a"), after(1).alias("b"))
    is_letter = lambda c: F.col(c).rlike("^@?[a-z]$")
    number = F.when(F.col("a").rlike(r"^\d+$"), F.col("a")).when(is_letter("a") & F.col("b").rlike(r"^\d+$"), F.col("b")).otherwise("")
    letter = F.when(is_letter("a"), F.substring("a", -1, 1)).when((F.col("a") != "") & is_letter("b"), F.substring("b", -1, 1)).otherwise("")
    whole = runs.where("length(span) >= 2").select("words", "span", F.regexp_replace(number, r"^0+(?=\d)", "").alias("number"), letter.alias("letter"))
    numbers = F.explode(F.array_distinct(F.array(F.lit(""), F.col("number")))).alias("number")
    whole = whole.select("words", "span", "letter", numbers)
    return whole.select("words", "span", "number", F.explode(F.array_distinct(F.array(F.lit(""), F.col("letter")))).alias("letter"))


def _segments(forms: DataFrame) -> DataFrame:
    """(form, form_len, seg, piece): the K + 1 segments of each form, the later ones the longer."""
    cut = forms.select("form", F.length("form").alias("form_len")).where(F.col("form_len") >= SHORTEST_FUZZY)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(K))).alias("seg"))
    return cut.selectExpr("form", "form_len", "seg", f"substring(form, {_start('form_len')}, {_size('form_len')}) AS piece")


def _size(length: str) -> str:
    return f"CAST(({length} + seg) DIV {K + 1} AS INT)"


def _start(length: str) -> str:
    return f"CAST(1 + {' + '.join(f'IF(seg > {s}, ({length} + {s}) DIV {K + 1}, 0)' for s in range(K))} AS INT)"


def pigeonhole_pairs(spans: DataFrame, forms: DataFrame) -> DataFrame:
    """(span, form, distance) of all distinct spans and forms within K edits, both at least SHORTEST_FUZZY - K and SHORTEST_FUZZY long.

    Complete for K edits: of K + 1 segments one stays whole, moved by no more than the edits before it.
    """
    sized = spans.select("span").distinct().select("span", F.length("span").alias("len")).where(F.col("len") >= SHORTEST_FUZZY - K)
    wide = sized.select("*", F.explode(F.sequence(F.lit(-K), F.lit(K))).alias("shift")).selectExpr("span", "len", "CAST(len - shift AS INT) AS form_len", "shift")
    wide = wide.where(F.col("form_len") >= SHORTEST_FUZZY).select("*", F.explode(F.sequence(F.lit(0), F.lit(K))).alias("seg"))
    wide = wide.selectExpr("*", f"{_start('form_len')} AS p", f"{_size('form_len')} AS n")
    # a segment moves by at most the edits before it, and what is left of the shift by those after it
    low = f"greatest(1, p - seg, p + shift - ({K} - seg))"
    high = f"least(len - n + 1, p + seg, p + shift + ({K} - seg))"
    wide = wide.selectExpr("*", f"{low} AS low", f"{high} AS high").where("high >= low AND n > 0")
    probes = wide.selectExpr("span", "form_len", "seg", "n", "explode(sequence(low, high)) AS at").selectExpr("span", "form_len", "seg", "substring(span, at, n) AS piece")
    met = probes.join(_segments(forms), ["form_len", "seg", "piece"]).select("span", "form").distinct()
    return met.withColumn("distance", F.levenshtein("span", "form", K)).where("distance >= 0")


def _accepted() -> Column:
    """One edit, a swap of neighbouring letters, or two edits in a form long enough for its kind."""
    same_letters = F.array_sort(F.split("span", "")) == F.array_sort(F.split("form", ""))
    return (F.col("distance") <= 1) | same_letters | (F.length("form") >= F.when(F.col("number") != "", LONG_NUMBERED).otherwise(LONG_FORM))


def map_names(listings: DataFrame, official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(id, code) for each distinct id: the Official entry that ``title`` names, 0 where it names none.

    Of several readings the one that covers most letters at least edits holds; a tie between entries names
    none. A repeated id with different titles has the highest code of them. Null and empty titles give 0,
    other columns are ignored, an empty list gives 0 throughout. A null id has no row.
    """
    rows = listings.where("id IS NOT NULL").select("id", "title")
    return map_words(stored(name_words(rows, "title", "words").select("id", F.coalesce("words", F.lit("")).alias("words"))), official_names, name_aliases)


def map_words(wordy: DataFrame, official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(id, code) as :func:`map_names` has it, for rows (id, words) whose name words are known and stored."""
    forms = stored(listed_forms(official_names, name_aliases))
    spans = stored(name_spans(wordy.select("words").distinct().where("words <> ''")))
    known = forms.select("form").distinct()
    exact = spans.select("span").distinct().join(known, F.col("span") == F.col("form")).select("span", "form", F.lit(0).alias("distance"))
    unknown = spans.select("span").distinct().join(known, F.col("span") == F.col("form"), "left_anti")
    pairs = exact.unionByName(pigeonhole_pairs(unknown, known))
    read = spans.join(pairs, "span").where(_accepted()).join(forms, ["form", "number", "letter"])
    score = F.length("form") + F.length("number") + F.length("letter") - 3 * F.col("distance")
    ranked = read.groupBy("words", score.alias("score")).agg(F.count_distinct("code").alias("codes"), F.max("code").alias("code"))
    named = ranked.groupBy("words").agg(F.max(F.struct("score", "codes", "code")).alias("best")).where("best.codes = 1 AND best.code > 0").select("words", "best.code")
    matched = wordy.join(named, "words").groupBy("id").agg(F.max("code").alias("code"))
    unmatched = wordy.join(named, "words", "left_anti").select("id").distinct().join(matched, "id", "left_anti")
    return matched.unionByName(unmatched.select("id", F.lit(0).cast("bigint").alias("code")))
