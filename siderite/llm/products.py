"""Listings of the same piece under different titles (problem 4): voting by token combinations.

A title's identifying tokens are the entry its name stands for, the three dimensions and the collection
number, whatever their wording, unit, order or place. All combinations of two and three of them are scored as
k^2 / (1 + mean position) x log2(frequency), frequencies counted over all titles; each title votes for its
best combination, and the titles of one best combination are a cluster. A title that has other frequent
combinations ties its cluster to theirs: tied clusters are merged, so that the vote loses no link. Pairs are
verified within the merged clusters: name, an identifying token, seller and mass.

Scale: only combinations that occur twice leave the counting step. What is merged are combinations, not
listings. Pairs meet on (merged cluster, mass class), so a popular name costs nothing by itself and a popular
piece is split by mass; grouping compares classes of mass, never listings. No cap, no cross join; skewed keys
are left to adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siderite.functions.units import with_title_mass
from siderite.llm.names import map_words
from siderite.llm.titles import fold, name_words, with_collection_number, with_sizes
from siderite.session import stored

MASS_TOLERANCE = 0.005
#: Logarithmic classes: masses of one class agree, masses that agree are at most two classes apart.
CLASS_WIDTH = 0.005


def identified(listings: DataFrame, official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(id, source, code, mass_g, size_key, collection_key, size_at, collection_at, name_at) of the titles that can be told apart.

    The places are those where the name, the dimensions and the collection begin, as shares of the title. Titles
    without an Official name, a mass, or either of dimensions and collection number aren't among them; nor are
    rows without id, source or title. Repeated rows count once.
    """
    rows = listings.where("id IS NOT NULL AND source IS NOT NULL AND title IS NOT NULL").select("id", "source", "title", "canonical_name", "canonical_name_status")
    rows = with_collection_number(with_sizes(with_title_mass(rows), "title"), "title")
    at = lambda pattern: F.greatest(F.regexp_instr("title", F.lit(pattern)), F.lit(1)) / F.length("title")
    places = {"size_at": at(r"\d[\d.,]*\s*(?:x|×|by)\s"), "collection_at": at(r"(?i)coll|slg\.| No \d|\([A-Z]")}
    verified = F.col("canonical_name_status") == "metbull_verified"
    usable = F.col("title_mass_g").isNotNull() & (F.col("size_key").isNotNull() | F.col("collection_key").isNotNull())
    # a filter on parsed columns would be pushed below them and parse every title once more: store first
    parsed = stored(rows.select("id", "source", usable.alias("usable"), F.when(verified, F.col("canonical_name")).alias("name"), F.when(usable, F.col("title")).alias("title"), F.col("title_mass_g").alias("mass_g"), "size_key", "collection_key", *(v.alias(k) for k, v in places.items())))
    worded = name_words(parsed.where("usable").drop("usable"), "title", "words").withColumn("words", F.coalesce("words", F.lit("")))
    first = F.translate(F.substring_index("words", " ", 1), "@", "")
    begins = worded.withColumns({"_first": first, "_folded": fold(F.col("title"))})
    name_at = F.greatest(F.expr("locate(_first, _folded)"), F.lit(1)) / F.length("title")
    kept = stored(begins.withColumn("name_at", name_at).drop("_first", "_folded", "title"))
    official = official_names.where("status = 'Official'").groupBy("name").agg(F.min("code").alias("code"))
    given = kept.join(official, "name").drop("name", "words")
    mapped = map_words(kept.where("name IS NULL").select("id", "words"), official_names, name_aliases).where("code > 0")
    return given.unionByName(kept.where("name IS NULL").join(mapped, "id").drop("name", "words")).distinct()


def combinations(titles: DataFrame) -> DataFrame:
    """titles with combination, k, base and score; one row for each combination that occurs in two titles or more.

    ``base`` marks name + dimensions and name + collection number, which all others with a name contain.
    """
    n, s, c = F.concat(F.lit("n"), F.col("code").cast("string")), F.concat(F.lit("|s"), F.col("size_key")), F.concat(F.lit("|c"), F.col("collection_key"))
    one = lambda text, k, base, place: F.struct(text.alias("combination"), F.lit(k).alias("k"), F.lit(base).alias("base"), place.alias("place"))
    name_at, size_at, collection_at = F.col("name_at"), F.col("size_at"), F.col("collection_at")
    made = F.array(
        one(F.concat(n, s), 2, True, (name_at + size_at) / 2), one(F.concat(n, c), 2, True, (name_at + collection_at) / 2),
        one(F.concat(s, c), 2, False, (size_at + collection_at) / 2), one(F.concat(n, s, c), 3, False, (name_at + size_at + collection_at) / 3),
    )
    kept = ["id", "source", "mass_g", "code", "size_key", "collection_key"]
    long = titles.select(*kept, F.explode(F.filter(made, lambda x: x["combination"].isNotNull())).alias("x")).select(*kept, "x.*")
    frequent = long.groupBy("combination").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")
    score = F.col("k") * F.col("k") / (1 + F.col("place")) * F.log2("frequency")
    return long.join(frequent, "combination").select(*kept, "combination", "k", "base", score.alias("score"))


def voted(scored: DataFrame) -> DataFrame:
    """(id, source, mass_g, code, size_key, collection_key, combination, others): each title with its best combination, the others it has."""
    kept = ["id", "source", "mass_g", "code", "size_key", "collection_key"]
    best = F.max(F.struct("score", "combination"))["combination"].alias("combination")
    votes = scored.groupBy(*kept).agg(best, F.collect_set("combination").alias("_all"))  # four at most
    return votes.select(*kept, "combination", F.array_remove("_all", F.col("combination")).alias("others"))


def merged_clusters(votes: DataFrame) -> DataFrame:
    """(combination, cluster) of the combinations that titles tie to others; any other combination is a cluster of its own."""
    ties = votes.select(F.col("combination").alias("id"), F.explode("others").alias("other")).distinct()
    both = stored(ties.unionByName(ties.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    return components(both).select(F.col("id").alias("combination"), F.col("piece").alias("cluster"))


def same_piece_pairs(votes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: titles of different sellers in one merged cluster, verified: name, an identifying token, mass."""
    clustered = votes.join(merged_clusters(votes), "combination", "left").select("id", "source", "mass_g", "code", "size_key", "collection_key", F.coalesce("cluster", "combination").alias("cluster"), mass_class())
    kept = ["id", "source", "mass_g", "code", "size_key", "collection_key"]
    side = lambda mark, *more: clustered.select(*[F.col(c).alias(f"{c}_{mark}") for c in kept], "cluster", *more)
    left = side("a", F.explode(F.array(*[F.col("mass_class") + d for d in (-2, -1, 0, 1, 2)])).alias("mass_class"))
    same = (F.col("code_a") == F.col("code_b")) & ((F.col("size_key_a") == F.col("size_key_b")) | (F.col("collection_key_a") == F.col("collection_key_b")))
    met = left.join(side("b", "mass_class"), ["cluster", "mass_class"]).where((F.col("id_a") < F.col("id_b")) & (F.col("source_a") != F.col("source_b")) & same & agree("mass_g_a", "mass_g_b"))
    return met.select("id_a", "id_b").distinct()


def mass_class():
    return F.floor(F.log("mass_g") / CLASS_WIDTH).alias("mass_class")


def agree(a: str, b: str):
    return F.abs(F.col(a) - F.col(b)) <= MASS_TOLERANCE * F.greatest(a, b)


def find_pairs(listings: DataFrame, official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """Pairs of listings of one piece; see :func:`identified` for the rows that take part."""
    return same_piece_pairs(stored(voted(combinations(identified(listings, official_names, name_aliases)))))


def group_pieces(listings: DataFrame, official_names: DataFrame, name_aliases: DataFrame) -> DataFrame:
    """(id, piece, combination, links): listings of pieces that two sellers or more offer.

    A piece is what shares name and dimensions or name and collection number, with masses that agree, followed
    transitively; it may stand twice with one seller. ``piece`` is its smallest id, ``combination`` the title's best
    one, ``links`` with how many listings of other sellers it agrees directly. No pairs of listings are made: the
    masses of one class agree, so a class is one node, and classes side by side are tied by their nearest masses.
    """
    scored = stored(combinations(identified(listings, official_names, name_aliases)))
    rows = scored.select("id", "source", "mass_g", "combination", "base", mass_class())
    node = F.concat_ws("@", "combination", "mass_class")
    bases = rows.where("base")
    nodes = stored(bases.groupBy("combination", "mass_class").agg(F.min("mass_g").alias("least"), F.max("mass_g").alias("most"), F.min("id").alias("first")).withColumn("node", node))
    above = [nodes.select("combination", (F.col("mass_class") - d).alias("mass_class"), F.col("node").alias("other"), F.col("least").alias("next")) for d in (1, 2)]
    beside = nodes.join(above[0].unionByName(above[1]), ["combination", "mass_class"]).where(agree("most", "next")).select(F.col("node").alias("id"), "other")
    # a title with both identifying tokens ties two nodes
    tied = bases.groupBy("id", "source", "mass_g").agg(F.min(node).alias("a"), F.max(node).alias("b")).where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other")).distinct()
    edges = beside.unionByName(tied)
    both = stored(edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    roots = components(both).select(F.col("id").alias("node"), "piece")
    placed = bases.select("id", "source", node.alias("node")).join(roots, "node", "left").select("id", "source", F.coalesce("piece", "node").alias("root"))
    held = placed.groupBy("root").agg(F.min("id").alias("piece"), F.min("source").alias("s"), F.max("source").alias("t")).where("s <> t").select("root", "piece")
    best = scored.groupBy("id").agg(F.max_by("combination", F.struct("score", "combination")).alias("combination"))
    found = placed.select("id", "root").distinct().join(held, "root").groupBy("id").agg(F.min("piece").alias("piece"))
    return found.join(best, "id").join(link_counts(rows), "id", "left").select("id", "piece", "combination", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def link_counts(rows: DataFrame) -> DataFrame:
    """(id, links): with how many listings of other sellers a listing agrees, from counts of equal (mass, seller).

    Those that share the dimensions and those that share the collection number, less those that share both. What is
    joined are different masses of a class, of which titles write few, with their sellers.
    """
    signed = rows.where("base OR combination LIKE 'n%|s%|c%'").select("*", F.when(F.col("base"), 1).otherwise(-1).alias("sign"))
    states = stored(signed.groupBy("combination", "sign", "mass_class", "mass_g", "source").agg(F.count_distinct("id").alias("n")))
    left = states.select("combination", "sign", "mass_g", "source", F.explode(F.array(*[F.col("mass_class") + d for d in (-2, -1, 0, 1, 2)])).alias("mass_class"))
    right = states.select("combination", "mass_class", F.col("mass_g").alias("other_g"), F.col("source").alias("other"), "n")
    met = left.join(right, ["combination", "mass_class"]).where((F.col("source") != F.col("other")) & agree("mass_g", "other_g"))
    counted = met.groupBy("combination", "sign", "mass_g", "source").agg(F.sum("n").alias("n"))
    return signed.select("id", "combination", "mass_g", "source").distinct().join(counted, ["combination", "mass_g", "source"]).groupBy("id").agg(F.sum(F.col("sign") * F.col("n")).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, piece) for symmetric edges (id, other): the smallest id that can be reached, by doubling pointers.

    Each round takes the smallest label next door and follows it one step further, so a chain of n needs
    about log n rounds; labels are stored after each, and all that reaches the driver is the count of changes.
    """
    labels = stored(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("piece")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), F.col("piece").alias("offered")), "other").groupBy("id").agg(F.min("offered").alias("offered"))
        stepped = labels.join(near, "id", "left").select("id", F.col("piece").alias("old"), F.least("piece", F.coalesce("offered", "piece")).alias("piece"))
        jump = labels.select(F.col("id").alias("piece"), F.col("piece").alias("further"))
        updated = stored(stepped.join(jump, "piece", "left").select("id", "old", F.coalesce("further", "piece").alias("piece")))
        changed = updated.where("old <> piece").limit(1).count()
        labels = updated.select("id", "piece")
        if not changed:
            return labels
