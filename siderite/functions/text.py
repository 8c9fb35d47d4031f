"""Text and url expressions, all JVM-side unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """One blank for each run of white space, none at the ends, before , . ; : or inside brackets."""
    one = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(one, r" +([,.;:])", "$1"), r"([(\[]) +", "$1"), r" +([)\]])", "$1")


def display_case(name: Column) -> Column:
    """Names in capitals only, longer than three letters, with initial capitals; others as they are."""
    return F.when((F.length(name) > 3) & name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}"), F.initcap(F.lower(name))).otherwise(name)


def host(url: Column) -> Column:
    """Lower-case host with its port; '' for a relative url."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    """Host without user, port and www.; a url without scheme is taken for a host and path."""
    bare = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), host(url)).otherwise(F.lower(F.regexp_extract(url, r"^([^/?#]*)", 1)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^.*@", ""), r":.*$", ""), r"^www\.", "")


def parent_domain(name: Column) -> Column:
    """The last two labels."""
    return F.substring_index(name, ".", -2)


def same_domain(base: Column, url: Column) -> Column:
    return (host(url) == "") | (host(url) == host(base))


def path_and_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")


def last_segment(url: Column) -> Column:
    """The decoded last part of the path; null where it can't be decoded."""
    path = F.regexp_replace(F.regexp_replace(path_and_query(url), r"\?.*$", ""), r"/+$", "")
    return F.try_url_decode(F.substring_index(path, "/", -1))


def name_from_url(url: Column) -> Column:
    return F.trim(F.regexp_replace(last_segment(url), r"[-_\s]+", " "))


def spaced(text: Column) -> Column:
    """Blanks between camelCase words and between letters and numbers."""
    parted = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(parted, "[-_]+", " "), r" {2,}", " "))


def selector_key(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def slug(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


#: What in an image's url marks decoration, not a picture of the piece.
DECORATION = ["favicon", "ajax-loader", "logo", "spinner", "counter", "placeholder", "sold.jpg", "heart/enabled", "heart/disabled", "reddot", "red dot", "red%20dot"]


def _names_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def remote_url(url: Column) -> Column:
    """Whether a url can be fetched: http or https with a host."""
    return F.coalesce(F.lower(F.substring_index(url, ":", 1)).isin("http", "https") & (host(url) != ""), F.lit(False))


def decorative(url: Column) -> Column:
    """Whether an image's url names decoration; null says nothing."""
    return F.coalesce(_names_any(F.lower(url), DECORATION), F.lit(False))


def image_list(urls: Column) -> Column:
    """http(s) urls in order, each once, without decoration."""
    return F.array_distinct(F.filter(F.array_compact(urls), lambda u: remote_url(u) & ~decorative(u)))


def resolved(df: DataFrame, base: str, url: str, out: str) -> DataFrame:
    """Adds ``url`` resolved against ``base``; null for data:, javascript:, mailto:, tel: and other schemes.

    Resolution needs the rules of urls, which no built-in has: an Arrow function over both columns.
    """

    def run(bases: pd.Series, urls: pd.Series) -> pd.Series:
        from urllib.parse import urljoin, urlparse

        def one(b: str | None, u: str | None) -> str | None:
            if not u or not u.strip():
                return None
            try:
                whole = urljoin(b or "", u.strip())
                parts = urlparse(whole)
            except ValueError:
                return None
            return whole if parts.scheme in ("http", "https") and parts.netloc else None

        return pd.Series([one(b, u) for b, u in zip(bases, urls)], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(base), F.col(url)))


def around(text: Column, pattern: str, before: int, after: int) -> Column:
    """The text around the first match of a pattern; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)) + F.length(F.regexp_extract(text, pattern, 0)) + after))


#: What says that a piece is gone; ``sold by`` names a seller and says nothing.
GONE = ["on hold", "reserved", "unavailable", "discontinued", "out of stock", "outofstock", "sold"]
NOT_GONE = "sold by"


def unavailable(text: Column) -> Column:
    """Whether a text says that a piece is gone; null says nothing."""
    spoken = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    spoken = F.replace(spoken, F.lit(f" {NOT_GONE} "), F.lit(" "))
    return F.coalesce(_names_any(spoken, [f" {w} " for w in GONE]), F.lit(False))
