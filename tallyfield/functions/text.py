"""Names, keys and slugs as column expressions.

White space is what the source system trims and collapses: it includes no-break spaces and the
byte-order mark, which Java's ``\\s`` and Spark's ``trim`` leave alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a regular-expression class body.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

#: Runs of white space; printable ASCII is ruled out first, as the whole class is slow to try on each letter.
SPACES = f"[[^!-~]&&[{WS}]]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))  # only spaces are left


def hyphenated(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "-")


def undoubled(text: Column) -> Column:
    return F.regexp_replace(collapsed(text), r"(?i)^(.+?) \1$", "$1")


def is_ranked(text: Column) -> Column:
    """True for ``No. 7 Name``, ``No 7 Name``, ``#5 Name`` and ``# 5 Name``."""
    return starts_with_rank(undoubled(text))


def starts_with_rank(once: Column) -> Column:
    return F.coalesce(once.rlike(r"(?i)^(?:No\.?|#) ?\d+ "), F.lit(False))


def clean_team_name(text: Column) -> Column:
    """One space between words, no exact doubling, no rank, no asterisks."""
    return without_rank(undoubled(text))


def without_rank(once: Column) -> Column:
    unranked = F.regexp_replace(once, r"(?i)^(?:No\.?|#) ?\d+ +", "")
    return collapsed(F.regexp_replace(unranked, r"\*+", " "))


def normalize_team_name(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, r"(?i)^No\. ?\d+ +", ""))


def clean_player_name(text: Column) -> Column:
    """Without a leading ``#12``, ``27`` or ``-3``."""
    return trimmed(F.regexp_replace(collapsed(text), r"^[#-]?\d+ +", ""))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def player_key(team: Column, player: Column) -> Column:
    return F.concat(alnum(team), F.lit(":"), alnum(player))


def dedupe_key(date: Column, home: Column, away: Column) -> Column:
    """Symmetric in home and away: names are sorted before they are hyphenated."""
    return F.concat_ws("-", date, hyphenated(F.least(home, away)), hyphenated(F.greatest(home, away)))


def game_id(date: Column, home: Column, away: Column, prefix: str) -> Column:
    return hyphenated(F.concat_ws("-", F.lit(prefix), date, home, away))


def colon_key(date: Column, home_id: Column, away_id: Column) -> Column:
    return F.concat_ws(":", date, home_id, away_id)


def encoded_key(key: Column) -> Column:
    """Base 64 without padding."""
    return F.regexp_replace(F.base64(key.cast("binary")), "[=\\r\\n]", "")


def reconcile_key(date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("__", *[F.lower(trimmed(c)) for c in (date, home, away)])


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def team_before_dash(caption: Column) -> Column:
    name = collapsed(F.substring_index(caption, "-", 1))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown")).otherwise(name)


def initials(text: Column) -> Column:
    """Lower-case first letters; words of up to three letters count whole. All but letters and digits part words."""
    words = F.filter(F.transform(F.split(text, "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 3, w).otherwise(F.substring(w, 1, 1))), "")


def name_forms(text: Column) -> Column:
    """What ``forms_likely_match`` compares, so that it is made once a name."""
    return F.struct(alnum(text).alias("alnum"), initials(text).alias("initials"))


def forms_likely_match(a: Column, b: Column) -> Column:
    x, y = a["alnum"], b["alnum"]
    either = F.contains(x, y) | F.contains(y, x) | (a["initials"] == b["initials"])
    return F.coalesce((x != "") & (y != "") & either, F.lit(False))


def names_likely_match(a: Column, b: Column) -> Column:
    """One name contains the other, or their initials agree."""
    return forms_likely_match(name_forms(a), name_forms(b))


def team_set(home: Column, away: Column) -> Column:
    """Both names as a set, without regard to case and spacing."""
    return F.array_sort(F.array_distinct(F.array(hyphenated(F.lower(home)), hyphenated(F.lower(away)))))


def same_teams(home_a: Column, away_a: Column, home_b: Column, away_b: Column) -> Column:
    """Equal as sets, without regard to case and spacing."""
    return team_set(home_a, away_a) == team_set(home_b, away_b)
