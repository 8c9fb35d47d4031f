"""URL expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Already plain: https, lower-case host without www., no fragment, at most an id parameter, no trailing slash.
PLAIN_URL = r"^https://(?!www\.)[^/?#A-Z]+(?:/[^?#]*[^/?#])?(?:\?id=[^&#]*)?$"


def plain_url(url: Column) -> Column:
    """https, lower-case host without ``www.``, no fragment, no query parameter but ``id``, no trailing slash.

    Null stays null; text without a host comes back as it is after the same clean-up. Most urls are plain
    already and pass on one pattern test.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    before_query = F.substring_index(rest, "?", 1)
    host = F.regexp_replace(F.lower(F.substring_index(before_query, "/", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(before_query, r"^[^/]*", ""), r"/+$", "")
    ident = F.regexp_extract(rest, r"[?&](id=[^&]*)", 1)
    query = F.when(ident == "", F.lit("")).otherwise(F.concat(F.lit("?"), ident))
    return F.when(url.rlike(PLAIN_URL), url).otherwise(F.concat(F.lit("https://"), host, path, query))
