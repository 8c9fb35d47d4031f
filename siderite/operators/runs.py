"""Runs over sources: the registry of readers, what a run saw, and candidate sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siderite.functions.text import domain, parent_domain
from siderite.operators.merge import last_wins

Reader = Callable[[SparkSession, dict], DataFrame]


@dataclass
class Readers:
    """Readers by parser name; a parser without one gives no rows and a reject."""

    known: dict[str, Reader] = field(default_factory=dict)

    def register(self, parser: str) -> Callable[[Reader], Reader]:
        def add(reader: Reader) -> Reader:
            self.known[parser] = reader
            return reader

        return add

    def scan(self, spark: SparkSession, sources: list[dict], empty: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, rejects): the union of the sources' rows, last wins by id; and the sources without a reader."""
        rows = empty.withColumn("_seq", F.lit(-1))
        for i, s in enumerate(sources):
            if s["parser"] in self.known:
                rows = rows.unionByName(self.known[s["parser"]](spark, s).withColumn("_seq", F.lit(i)), allowMissingColumns=True)
        rejects = spark.createDataFrame([(s["name"], "unknown_parser") for s in sources if s["parser"] not in self.known], "source string, reason string")
        return last_wins(rows.where("id IS NOT NULL"), ["id"], "_seq").drop("_seq"), rejects


def run_log(fetches: DataFrame, rejects: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source, pages, failed, detail_urls, parsed, rejected): one row for each source that any of them names.

    fetches: source, url, status, kind; rejects: source, reason; parsed: source.
    """
    a = fetches.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("status", F.lit(599)) >= 400).alias("failed"), F.count_distinct(F.when(F.col("kind") == "detail", F.col("url"))).alias("detail_urls"))
    b, c = (d.groupBy("source").agg(F.count(F.lit(1)).alias(n)) for d, n in ((parsed, "parsed"), (rejects, "rejected")))
    whole = a.join(b, "source", "full").join(c, "source", "full")
    return whole.select("source", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("pages", "failed", "detail_urls", "parsed", "rejected")])


def top_reasons(rejects: DataFrame, limit: int = 8) -> DataFrame:
    """(source, reason, n, place): each source's most frequent reasons, ties by name."""
    counts = rejects.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "reason"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that rejects a row; null if none does. The order is what is counted."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        out = F.when(F.coalesce(rejects, F.lit(False)), name).otherwise(out)
    return out


def known_domains(registry: DataFrame) -> DataFrame:
    """(domain): the domains of the registry's urls and their parents."""
    urls = registry.select(F.explode(F.concat(F.array("base_url"), F.coalesce("inventory_urls", F.array().cast("array<string>")))).alias("u"))
    own = urls.select(domain(F.col("u")).alias("d")).where("d <> ''")
    return own.select(F.explode(F.array(F.col("d"), parent_domain(F.col("d")))).alias("domain")).distinct()


def screened(results: DataFrame, known: DataFrame, blocked: DataFrame) -> DataFrame:
    """results (url, title, snippet, ...) with domain and reason: known, blocked, repeated, or null if it is new.

    A domain is blocked with all that end in it: its suffixes are joined by equality, not compared one by one.
    Of results of one domain the first by seq is new.
    """
    own = results.withColumn("domain", domain(F.col("url")))
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, 99), "."))
    every = own.select("seq", F.explode(suffixes).alias("suffix"))
    hit = every.join(blocked.select(F.col("domain").alias("suffix")), "suffix", "left_semi").select("seq").distinct().withColumn("_blocked", F.lit(True))
    seen = own.select("seq", F.explode(F.array_distinct(F.array(F.col("domain"), parent_domain(F.col("domain"))))).alias("d")).join(known.select(F.col("domain").alias("d")), "d", "left_semi").select("seq").distinct().withColumn("_known", F.lit(True))
    first = own.groupBy("domain").agg(F.min("seq").alias("_first"))
    joined = own.join(hit, "seq", "left").join(seen, "seq", "left").join(first, "domain")
    return joined.withColumn("reason", first_reason(("no_domain", F.col("domain") == ""), ("known", F.col("_known")), ("blocked", F.col("_blocked")), ("repeated", F.col("seq") > F.col("_first")))).drop("_known", "_blocked", "_first")


@dataclass(frozen=True)
class Evidence:
    name: str
    points: int
    found: Column


def candidate_scores(candidates: DataFrame, evidence: list[Evidence]) -> DataFrame:
    """Adds score (0 to 100) and evidence, the names of what was found, in order."""
    total = sum((F.when(F.coalesce(e.found, F.lit(False)), e.points).otherwise(0) for e in evidence), F.lit(0))
    names = F.array_compact(F.array(*[F.when(e.found, F.lit(e.name)) for e in evidence]))
    return candidates.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"), "evidence": names})


#: Words that speak for a seller of meteorites, for a shop, for a class, and against both.
TERMS = ["meteorite", "meteorites", "chondrite", "achondrite", "pallasite", "mesosiderite", "lunar", "martian", "tektite", "impactite"]
SHOP = ["shop", "store", "cart", "product", "products", "for sale", "inventory"]
CLASSES = ["lunar", "martian", "pallasite", "eucrite", "shergottite", "carbonaceous"]
REFERENCE = ["article", "guide", "how to", "museum", "education", "identification", "blog", "forum", "research"]
#: What stands beside a price and after a mass.
SIGNS = ["us$", "$", "usd", "eur", "€", "cad"]
MASSES = ["kg", "kilogram", "kilograms", "g", "gram", "grams", "gm", "gms", "mg", "oz", "ounce", "ounces"]
#: The points of each kind of evidence.
POINTS = {"terms": 25, "price": 20, "mass": 20, "shop": 15, "class": 10, "style": 10, "reference": -15, "unread": -20}


def shop_evidence(text: Column, fetched: Column, style: Column) -> list[Evidence]:
    """What speaks for and against a seller's page: which listed words its text has, what its numbers stand beside."""
    spoken = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}$€.,]+", " "), F.lit(" "))
    plain = F.regexp_replace(spoken, r"[^\p{L}\p{N} ]+", " ")
    has = lambda words: F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(F.regexp_replace(plain, " +", " "), w))
    # a number and its neighbours: digits parted from letters and signs, one blank between all
    parted = F.regexp_replace(F.regexp_replace(spoken, r"(?<=[0-9])(?=[^0-9.,])|(?<=[^0-9.,])(?=[0-9])", " "), " +", " ")
    tokens = F.split(parted, " ")
    is_number = lambda t: t.rlike("^[0-9][0-9.,]*$")
    beside = F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.size(tokens)).alias("b"))
    numbered = F.exists(beside, lambda p: (p["a"] == "nwa") & is_number(p["b"]))
    found = {
        "terms": has(TERMS) | numbered,
        "price": F.exists(beside, lambda p: (p["a"].isin(SIGNS) & is_number(p["b"])) | (is_number(p["a"]) & p["b"].isin(SIGNS))),
        "mass": F.exists(beside, lambda p: is_number(p["a"]) & F.rtrim(p["b"], F.lit(".,")).isin(MASSES)),
        "shop": has(SHOP),
        "class": has(CLASSES) | numbered,
        "style": F.coalesce(style, F.lit("unknown")) != "unknown",
        "reference": has(REFERENCE),
        "unread": ~F.coalesce(fetched, F.lit(False)),
    }
    return [Evidence(name, POINTS[name], here) for name, here in found.items()]


#: What in a page names the software of its shop, in the order they count.
STYLES = {"shopify": ["cdn.shopify.com", "/products.json"], "woocommerce": ["woocommerce", "add_to_cart_button", "/wp-json/wc/store"], "bigcommerce": ["bigcommerce", "stencil"], "wix/static": ["wixstatic", "wix-code"]}


def page_style(body: Column, url: Column) -> Column:
    """The software of a shop by what its page names, else ``static/shop`` by its url, else ``unknown``."""
    text, path = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    named = [F.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m)), style) for style, marks in STYLES.items()]
    shop = F.exists(F.array(*[F.lit(m) for m in ("/product/", "/shop", "/store", "/catalog")]), lambda m: F.contains(path, m))
    return F.coalesce(*named, F.when(shop, "static/shop"), F.lit("unknown"))


def discovery_report(results: DataFrame, known: DataFrame, blocked: DataFrame, pages: DataFrame) -> DataFrame:
    """(seq, domain, url, reason, style, score, evidence): every search result, screened; new ones scored.

    results: seq, url, title, snippet; pages: url, body of those that were read. A result with a reason has no score.
    """
    beside = screened(results, known, blocked).join(pages.select("url", "body"), "url", "left")
    beside = beside.withColumns({"style": page_style(F.col("body"), F.col("url")), "_text": F.concat_ws(" ", "title", "snippet", F.regexp_replace("body", "<[^>]*>", " "))})
    scored = candidate_scores(beside, shop_evidence(F.col("_text"), F.col("body").isNotNull(), F.col("style")))
    new = F.col("reason").isNull()
    return scored.select("seq", "domain", "url", "reason", *[F.when(new, F.col(c)).alias(c) for c in ("style", "score", "evidence")])


def report_faults(report: DataFrame, known: DataFrame, blocked: DataFrame) -> DataFrame:
    """(fault, n): what a discovery report must not hold: new results of known or blocked domains, repeated domains, scores out of range."""
    new = report.where("reason IS NULL")
    inside = lambda d: new.join(d.select("domain").distinct(), "domain", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    repeated = new.groupBy("domain").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    bad = new.agg(F.count_if(F.col("score").isNull() | ~F.col("score").between(0, 100)).alias("n"))
    faults = [("known", inside(known)), ("blocked", inside(blocked)), ("repeated", repeated), ("score", bad)]
    out = faults[0][1].select(F.lit("known").alias("fault"), "n")
    for name, part in faults[1:]:
        out = out.unionByName(part.select(F.lit(name).alias("fault"), "n"))
    return out
