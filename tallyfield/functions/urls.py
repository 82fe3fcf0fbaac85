"""Links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?(?=[/?#]|$)"


def origin(url: Column) -> Column:
    """scheme://host[:port], lower case, without the default port; '' for anything else."""
    url = F.coalesce(url, F.lit(""))
    scheme, port = F.lower(F.regexp_extract(url, _ORIGIN, 1)), F.regexp_extract(url, _ORIGIN, 3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    whole = F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(url, _ORIGIN, 2)), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    return F.when(url.rlike(_ORIGIN), whole).otherwise(F.lit(""))


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def resolve_box_url(raw: Column, base: Column) -> Column:
    """Absolute links stay, ``//x`` is https, all others start at the base's origin; empty ones are null."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(is_absolute(raw), raw)
        .when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw))
        .when(F.startswith(raw, F.lit("/")), F.concat(origin(base), raw))
        .otherwise(F.concat(origin(base), F.lit("/"), raw))
    )


def resolve_url(href: Column, base: Column) -> Column:
    """As above, but all that starts with http stays, ``//x`` follows the origin, and without an origin the link stays."""
    return resolve_from(href, origin(base))


def resolve_from(href: Column, start: Column) -> Column:
    """``resolve_url`` where the base's origin is known."""
    slash = F.when(F.startswith(href, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    none = F.coalesce(href, F.lit("")) == ""
    return F.when(none, F.lit(None).cast("string")).when(F.startswith(href, F.lit("http")) | (start == ""), href).otherwise(F.concat(start, slash, href))


def page_game_id(url: Column, prefix: str) -> Column:
    number = F.regexp_extract(F.coalesce(url, F.lit("")), r"/([0-9]+)(?:$|\?)", 1)
    return F.when(number == "", F.lit("unknown")).otherwise(F.concat(F.lit(f"{prefix}-"), number))


def links(html: Column, pattern: str) -> Column:
    """Distinct matches of a link pattern, in order, with entities undone."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))))


#: Fixed patterns of links to the box scores of another platform and to documents.
OTHER_PLATFORM, DOCUMENT = r"(?i)https?://wmt\.games/[^\s\"'<>]+", r"(?i)https?://[^\s\"'<>]+\.pdf"


def other_platform_link(html: Column) -> Column:
    """The first link to the other platform, null without one."""
    return F.try_element_at(links(html, OTHER_PLATFORM), F.lit(1))


def document_links(html: Column) -> Column:
    return links(html, DOCUMENT)
