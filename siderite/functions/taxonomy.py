"""Classification: subtype tokens in one form, their family and how much they say.

A token is either a listed name or a group with a petrologic type, such as ``L5-6`` or ``EH3/4``: a small
grammar takes it apart, and value tables say what the parts mean. Everything is an expression of the token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of chondrites, by family, and the petrologic types a group can have.
GROUPS = {
    "ordinary chondrite": ["H", "L", "LL", "H/L", "L/LL", "H/LL"],
    "carbonaceous chondrite": ["CI", "CM", "CO", "CV", "CR", "CK", "CH", "CB"],
    "chondrite": ["EH", "EL", "R"],
}
TYPES = {"ordinary chondrite": "34567", "carbonaceous chondrite": "0123456789", "chondrite": "34567"}
#: Subtypes that are names, in capitals without blanks, by family.
NAMES = {
    "ordinary chondrite": ["OC", "H/L", "L/LL", "H/LL", "L(LL)3"],
    "carbonaceous chondrite": ["C2", "C-2", "C1-UNG", "C2-UNG", "C3-UNG", "CBA", "CBB", "CVRED3", "CVOXA3"],
    "chondrite": ["EH-MELTROCK"],
    "achondrite": [
        "ACHONDRITE", "ACHONDRITE-UNG", "HED", "EUC", "EUCRITE", "EUCRITE-MMICT", "EUCRITE-UNBR", "EUCRITE-PMICT", "EUCRITE-BR", "EUCRITE-MELTBRECCIA",
        "DIOGENITE", "HOWARDITE", "UREILITE", "AUBRITE", "ANGRITE", "BRACHINITE", "ACAPULCOITE", "LODRANITE", "WINONAITE",
    ],
    "martian": ["SHERGOTTITE", "NAKHLITE", "CHASSIGNITE"],
    "iron": ["IIA", "IAB", "IIAB", "IIIAB", "IIIE-AN", "IVA", "IVB", "IIE", "IRUNGR", "IC", "OCTAHEDRITE", "ATAXITE", "HEXAHEDRITE"],
    "pallasite": ["PALLASITE", "PAL-MG", "PALMG", "PMG"],
    "mesosiderite": ["MESOSIDERITE"],
}
#: Names that aren't written in capitals without blanks.
WRITTEN = {
    "EH-MELTROCK": "EH-MELT ROCK", "EUCRITE-MMICT": "Eucrite-mmict", "EUCRITE-UNBR": "Eucrite-unbr", "EUCRITE-PMICT": "Eucrite-pmict", "EUCRITE-BR": "Eucrite-br",
    "EUCRITE-MELTBRECCIA": "Eucrite-melt breccia", "ACHONDRITE-UNG": "Achondrite-ung", "PALMG": "PAL-MG",
}
#: What a subtype says, from the least; classes of iron most. Others with a range, a subgroup or a melt say more than plain ones.
VAGUE = {20: ["OCTAHEDRITE", "ATAXITE", "HEXAHEDRITE"], 30: ["ACHONDRITE", "EUCRITE", "EUC", "HED"]}
EXACT = {80: ["EUCRITE-MMICT", "EUCRITE-UNBR", "EUCRITE-PMICT", "EUCRITE-BR", "EUCRITE-MELTBRECCIA", "ACHONDRITE-UNG"], 90: ["IIA", "IAB", "IIAB", "IIIAB", "IIIE-AN", "IVA", "IVB", "IIE", "IRUNGR", "IC"]}
LUNAR_SAYS, PARTED_SAYS, PLAIN_SAYS = 80, 70, 50
#: Lunar lithologies, which keep lower case.
LUNAR = [
    "anorth", "bas/anor", "bas. breccia", "bas/gab brec", "basalt", "feldsp. breccia", "feldsp. melt breccia", "feldsp. melt rock", "frag. breccia", "gabbro",
    "melt breccia", "norite", "olivine gabbro", "olivine gabbronorite", "troct", "troct. anorth.", "troct. anorth. melt breccia", "troct. melt breccia", "troct. melt rock",
]
#: The order in which families are shown within a list of subtypes.
FAMILIES = [*GROUPS, "achondrite", "martian", "lunar", "iron", "pallasite", "mesosiderite"]

#: A group, its type, and what a range has beyond it: a mark, a group again, a second type.
_GRAMMAR = r"^([A-Z]{1,2}(?:/[A-Z]{1,2})?)-?([0-9](?:\.[0-9])?)([-/]?)([A-Z]{0,2})((?:[0-9](?:\.[0-9])?)?)$"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


_NAMED = {name: family for family, names in NAMES.items() for name in names}
_GROUPED = {group: family for family, groups in GROUPS.items() for group in groups}
_SAYS = {name: n for part in (VAGUE, EXACT) for n, names in part.items() for name in names}


def _let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def compact(token: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(token, F.lit(""))), r"\s+", "")


def _parts(token: Column) -> Column:
    """A struct (group, first, mark, again, second, family) of a token of the grammar; family is null for any other."""
    names = ["group", "first", "mark", "again", "second"]
    cut = F.struct(*[F.regexp_extract(token, _GRAMMAR, i + 1).alias(n) for i, n in enumerate(names)])

    def judged(p: Column) -> Column:
        family = _table(_GROUPED)[F.nullif(p["group"], F.lit(""))]
        return F.struct(*[p[n].alias(n) for n in names], family.alias("kin"), _table(TYPES)[family].alias("types"))

    def told(p: Column) -> Column:
        fits = lambda number: F.instr(p["types"], F.substring(number, 1, 1)) > 0
        # only enstatite chondrites name their group twice, only the groups of one family have ranges
        again = (p["again"] == "") | (p["group"].isin("EH", "EL") & p["again"].isin("EH", "EL") & (p["mark"] != ""))
        ranged = (p["second"] == "") | ((p["kin"] != "carbonaceous chondrite") & ~F.contains(p["group"], F.lit("/")) & fits(p["second"]))
        whole = (p["second"] != "") | ((p["mark"] == "") & (p["again"] == ""))
        return F.struct(*[p[n].alias(n) for n in names], F.when(fits(p["first"]) & again & ranged & whole, p["kin"]).alias("family"))

    return _let(_let(cut, judged), told)


def lunar_lithology(token: Column) -> Column:
    """The lithology of ``Lunar (x)`` or of x itself; null if it is none."""
    inner = F.regexp_replace(F.lower(F.trim(token)), r"^lunar\s*\((.*)\)$", "$1")
    return _let(F.regexp_replace(F.trim(inner), r"\s+", " "), lambda text: F.when(text.isin(LUNAR), text))


def canonical_subtype(token: Column) -> Column:
    """One spelling for each subtype: L 5 and L-5 are L5, H56 is H5-6, C 2-ung is C2-UNG; unknown ones in capitals."""

    def rebuilt(p: Column) -> Column:
        mark = F.when(p["second"] == "", "").when(p["group"].isin("EH", "EL"), "/").when(p["mark"] == "", "-").otherwise(p["mark"])
        return F.when(p["family"].isNotNull() & (p["group"] != "R"), F.concat(p["group"], p["first"], mark, p["again"], p["second"]))

    def written(c: Column) -> Column:
        named = F.when(_table(_NAMED)[c].isNotNull(), F.coalesce(_table(WRITTEN)[c], c))
        return F.coalesce(named, _let(_parts(c), rebuilt))

    def spelled(tight: Column) -> Column:
        return F.coalesce(_let(compact(tight), written), F.nullif(F.upper(tight), F.lit("")))

    return F.coalesce(lunar_lithology(token), _let(F.regexp_replace(F.trim(token), r"\s*([/-])\s*", "$1"), spelled))


def family_of(subtype: Column) -> Column:
    """The family of a subtype; null for an unknown one."""
    lunar = lambda t: lunar_lithology(t).isNotNull() | F.lower(F.trim(t)).rlike(r"^lunar(?:\s+meteorite)?$")
    known = lambda c: F.coalesce(_table(_NAMED)[c], _parts(c)["family"])
    return _let(subtype, lambda t: F.when(lunar(t), "lunar").otherwise(_let(compact(t), known)))


def precedence(subtype: Column) -> Column:
    """How much a subtype says; 0 for none."""

    def says(c: Column) -> Column:
        parted = F.contains(c, F.lit("/")) | F.contains(c, F.lit("-")) | F.contains(c, F.lit("UNG")) | F.contains(c, F.lit("MELT"))
        return F.when(c == "", 0).otherwise(F.coalesce(_table(_SAYS)[c], F.when(parted, PARTED_SAYS), F.lit(PLAIN_SAYS)))

    return _let(subtype, lambda t: F.coalesce(F.when(lunar_lithology(t).isNotNull(), LUNAR_SAYS), _let(compact(t), says)))


def best_subtype(tokens: Column) -> Column:
    """Of an array of tokens the canonical form of the one of highest precedence, the first of equals."""
    forms = F.transform(tokens, lambda t: canonical_subtype(t))
    ranked = F.transform(forms, lambda t, i: F.struct(precedence(t).alias("p"), (-i).alias("i"), t.alias("s")))
    return F.array_max(F.filter(ranked, lambda r: r["s"].isNotNull()))["s"]


def more_specific(candidate: Column, current: Column) -> Column:
    """Whether a subtype says more than another of its family, or continues it."""
    one = lambda t: F.struct(compact(t).alias("c"), family_of(t).alias("f"), precedence(t).alias("p"))

    def more(x: Column) -> Column:
        a, b = x["a"], x["b"]
        longer = F.startswith(a["c"], b["c"]) & (F.length(a["c"]) > F.length(b["c"]))
        kin = a["f"].eqNullSafe(b["f"]) & (a["p"] >= PARTED_SAYS) & (a["p"] > b["p"])
        return (a["c"] != "") & ((b["c"] == "") | ((a["c"] != b["c"]) & (longer | kin)))

    return _let(F.struct(one(candidate).alias("a"), one(current).alias("b")), more)


def merged_text(*texts: Column) -> Column:
    """The parts of comma-separated classification texts, each once whatever its case, in order; null for none."""
    parts = F.filter(F.transform(F.split(F.concat_ws(",", *texts), ","), lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.nullif(F.array_join(first, ", "), F.lit(""))


def kept_text(text: Column, family: Column) -> Column:
    """A classification text without the parts that name another family."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(F.filter(parts, lambda x: F.coalesce(family_of(x) == family, F.lit(True))), ", "), F.lit(""))


def text_families(text: Column) -> Column:
    """The families that the parts of a classification text name."""
    return F.array_distinct(F.array_compact(F.transform(F.split(text, ","), lambda x: F.coalesce(family_of(F.trim(x)), F.when(F.lower(F.trim(x)).isin(FAMILIES), F.lower(F.trim(x)))))))


def subtype_rank(subtype: Column) -> Column:
    """Place of a subtype in a list: by family, then by how its kind is listed there, then by petrologic type; unknown ones last."""
    listed = {name: i for names in NAMES.values() for i, name in enumerate(names)}
    grouped = {group: i for groups in GROUPS.values() for i, group in enumerate(groups)}

    def ranked(x: Column) -> Column:
        kind = F.coalesce(_table(grouped)[F.nullif(x["p"]["group"], F.lit(""))], _table(listed)[x["c"]] + 50, F.lit(99))
        number = F.coalesce(x["p"]["first"].try_cast("double"), F.lit(0.0))
        return F.when(x["f"] > 0, x["f"] * 10_000 + kind * 100 + F.floor(number * 10)).otherwise(999_999).cast("int")

    family = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), family_of(subtype))
    return _let(compact(subtype), lambda c: _let(F.struct(c.alias("c"), _parts(c).alias("p"), family.alias("f")), ranked))


def compatible(row_family: Column, text_family: Column) -> Column:
    """Families that don't contradict each other; a plain chondrite agrees with its kinds."""
    kinds = ["ordinary chondrite", "carbonaceous chondrite"]
    return (row_family == text_family) | ((row_family == "chondrite") & text_family.isin(kinds)) | ((text_family == "chondrite") & row_family.isin(kinds))


def subtype_tokens(text: Column) -> Column:
    """What in a text may be a subtype: runs of its words, of three at most, that are a listed name or a token of the grammar."""
    words = F.filter(F.split(F.regexp_replace(text, r"\s*([/-])\s*", "$1"), r"[^A-Za-z0-9/.()-]+"), lambda w: w != "")
    run = lambda w, i, n: F.regexp_replace(F.array_join(F.slice(w, i, n), " "), r"^[.(]+(?=\w)|(?<=\w)[.,]+$", "")
    runs = _let(words, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.array(run(w, i, 3), run(w, i, 2), run(w, i, 1)))))
    return F.filter(runs, lambda r: family_of(r).isNotNull())
