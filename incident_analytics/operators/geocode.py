"""Address → coordinates from a gazetteer table, and circle outlines.

The dashboard asks a web geocoder for the first hit of ``address`` (with the
city appended when missing). Here the lookup is a join against a gazetteer
table: normalise the address to a key, pick each key's first hit (most
incidents, then name) with ``min_by`` — an aggregate, so a key with very many
entries is merged partially and never gathered in one task — then left-join.

``geocode_text`` finds free text too: abbreviations, words in any order, house
numbers inside a block, and one mistyped letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numeric import exact_mean
from ..functions.text import CITY_SUFFIX, address_key, address_words


# A geocoder reply as stored text: a JSON list of hits with text coordinates.
REPLY_TYPE = "array<struct<lat:string,lon:string,display_name:string>>"
MOST_WORDS = 24  # of an address that may hold a mistyped word


def parse_geocoder_reply(reply: Column) -> Column:
    """First hit of a stored geocoder reply as ``struct<lat, lon, display_name>``;
    null for an empty list or unreadable text."""
    first = F.try_element_at(F.from_json(reply, REPLY_TYPE), F.lit(1))
    return F.struct(first["lat"].try_cast("double").alias("lat"),
                    first["lon"].try_cast("double").alias("lon"),
                    first["display_name"].alias("display_name"))


def gazetteer_from_incidents(incidents: DataFrame) -> DataFrame:
    """One entry per (block address, area): mean coordinates, incident count,
    display name ``<address>, <area>, Seattle, WA``."""
    pts = incidents.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                          & F.col("location").isNotNull())
    g = pts.groupBy("location", "area").agg(
        exact_mean(F.col("latitude")).alias("lat"),
        exact_mean(F.col("longitude")).alias("lon"),
        F.count(F.lit(1)).alias("hits"),
    )
    name = F.concat_ws(", ", F.col("location"), F.col("area"), F.lit(CITY_SUFFIX.lstrip(", ")))
    return g.select(F.col("location").alias("address"), "lat", "lon", "hits", name.alias("display_name"))


def first_hits(gazetteer: DataFrame) -> DataFrame:
    """Best entry per normalised address key: most hits, then display name."""
    keyed = gazetteer.withColumn("key", address_key(F.col("address")))
    rank = F.struct((-F.col("hits")).alias("neg_hits"), F.col("display_name"))
    best = F.min_by(F.struct("lat", "lon", "display_name"), rank)
    return (keyed.groupBy("key").agg(best.alias("hit"))
            .select("key", F.col("hit.lat").alias("lat"), F.col("hit.lon").alias("lon"),
                    F.col("hit.display_name").alias("display_name")))


def geocode(addresses: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """Every input row with ``latitude``, ``longitude``, ``display_name``
    (null when the gazetteer has no entry)."""
    hits = first_hits(gazetteer)
    keyed = addresses.withColumn("key", address_key(F.col(address)))
    return (keyed.join(hits, "key", "left")
            .select(*[F.col(c) for c in addresses.columns],
                    F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "display_name"))


def _spellings(words: Column) -> Column:
    """What an address is found by, as (rest, spelling, word): its words as a
    whole, and for each word of three or more letters the other words with that
    word and with each text that is one letter shorter. Two addresses share one
    if at most one word differs, by one letter missing, added, changed or moved."""
    whole = F.array(F.struct(F.array_join(words, " ").alias("rest"), F.lit("").alias("spelling"), F.lit("").alias("word")))

    def typed(word: Column) -> Column:
        rest = F.array_join(F.array_remove(words, word), " ")
        shorter = F.transform(F.sequence(F.lit(1), F.length(word)),
                              lambda k: F.concat(F.substr(word, F.lit(1), k - 1), F.substr(word, k + 1)))
        return F.transform(F.array_distinct(F.concat(F.array(word), shorter)),
                           lambda t: F.struct(rest.alias("rest"), t.alias("spelling"), word.alias("word")))

    letters = F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))
    several = F.when(F.size(words) <= MOST_WORDS, F.flatten(F.transform(letters, typed)))
    return F.when(F.size(words) > 0, F.concat(whole, F.coalesce(several, F.slice(whole, 1, 0))))


def _one_letter(p: Column, q: Column) -> Column:
    """Whether two words that share a spelling differ by one letter at most (the
    other case is two letters: one dropped from each at different places)."""
    def letters(w: Column) -> Column:
        return F.array_sort(F.split(w, ""))
    return (F.levenshtein(p, q) <= 1) | (letters(p) == letters(q))


def geocode_text(addresses: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """Every input row with ``latitude``, ``longitude``, ``display_name`` and
    ``typos`` (0 or 1; all null when no entry is found).

    An address is the set of its words (``text.address_words``). It finds the
    entries with the same set, else those where one word differs by one letter
    missing, added, changed or moved; words with digits are never mistyped, and
    addresses of more than ``MOST_WORDS`` words are only found as they are. Of
    several, the one of least typos, most hits, then least display name. Null
    addresses and those without words find nothing.

    Distinct word sets of both sides are joined on the spellings they share
    (some 10 to 40 a set), so frequent words such as a street's type meet no
    long list: a spelling holds all the other words too."""
    entries = gazetteer.withColumn("_words", address_words(F.col("address"))).where(F.size("_words") > 0)
    rank = F.struct((-F.col("hits")).alias("neg_hits"), F.col("display_name"))
    best = (entries.groupBy("_words").agg(F.min_by(F.struct("lat", "lon", "display_name", "hits"), rank).alias("_hit"))
            .select("_hit", F.explode(_spellings(F.col("_words"))).alias("_s"))
            .select("_hit", F.col("_s.rest").alias("_rest"), F.col("_s.spelling").alias("_spelling"), F.col("_s.word").alias("_found")))
    asked = addresses.withColumn("_words", address_words(F.col(address)))
    sets = (asked.select("_words").where(F.size("_words") > 0).distinct()
            .select("_words", F.explode(_spellings(F.col("_words"))).alias("_s"))
            .select("_words", F.col("_s.rest").alias("_rest"), F.col("_s.spelling").alias("_spelling"), F.col("_s.word").alias("_word")))
    pairs = sets.join(best, ["_rest", "_spelling"]).where(_one_letter(F.col("_word"), F.col("_found")))
    typos = (F.col("_word") != F.col("_found")).cast("int")
    order = F.struct(typos, -F.col("_hit.hits"), F.col("_hit.display_name"))
    hits = pairs.groupBy("_words").agg(F.min_by(F.struct("_hit", typos.alias("typos")), order).alias("_h"))
    return (asked.join(hits, "_words", "left")
            .select(*[F.col(f"`{c}`") for c in addresses.columns], F.col("_h._hit.lat").alias("latitude"),
                    F.col("_h._hit.lon").alias("longitude"), F.col("_h._hit.display_name").alias("display_name"),
                    F.col("_h.typos").alias("typos")))


def circle_outlines(centers: DataFrame, lat: str = "latitude", lon: str = "longitude",
                    radius: str = "radius_m") -> DataFrame:
    """65 outline points (closed) per centre row, plus the radius in miles."""
    pts = geo.circle_outline(F.col(lat), F.col(lon), F.col(radius))
    keep = [c for c in centers.columns if c not in (lat, lon)]
    return (centers.select(*keep, F.explode(pts).alias("p"))
            .select(*keep, F.col("p.i").alias("point"), F.col("p.lat").alias("latitude"),
                    F.col("p.lon").alias("longitude"),
                    geo.metres_to_miles(F.col(radius)).alias("radius_miles")))
