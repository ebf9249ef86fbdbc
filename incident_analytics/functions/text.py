"""Text Column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label cut length, geocoder city suffix.
LABEL_MAX = 40
CITY_WORD = "seattle"
CITY_SUFFIX = ", Seattle, WA"
# Words that mean the same in an address, and words that say nothing about the place.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "rd": "road",
    "ln": "lane", "pl": "place", "ct": "court", "wy": "way", "pkwy": "parkway", "hwy": "highway", "ter": "terrace",
    "sq": "square", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest",
    "se": "southeast", "sw": "southwest",
}
ADDRESS_FILLERS = ("block", "blk", "of", "the", "and", "at", "near", CITY_WORD, "wa", "washington", "usa")


def truncate_label(text: Column, max_len: int = LABEL_MAX) -> Column:
    """First ``max_len`` characters plus ``...`` when longer."""
    return F.when(F.length(text) > max_len,
                  F.concat(F.substring(text, 1, max_len), F.lit("..."))).otherwise(text)


def with_city(address: Column) -> Column:
    """Append the city suffix unless the address already names the city."""
    return F.when(F.lower(address).contains(CITY_WORD), address) \
        .otherwise(F.concat(address, F.lit(CITY_SUFFIX)))


def address_key(address: Column) -> Column:
    """Lookup key: city-qualified, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(with_city(address)), r"\s+", " "))


def address_words(address: Column) -> Column:
    """The distinct words of a free-text address, sorted: lower case, abbreviations
    written out, fillers, unit numbers and postal codes left out, and a house
    number turned into its block of a hundred (``412`` and ``4XX`` are ``4xx``)."""
    text = F.regexp_replace(F.lower(address), r"(#|\b(apt|unit|suite|ste)\b\.?)\s*[0-9a-z-]*", " ")
    words = F.filter(F.split(text, r"[^0-9a-z]+"), lambda w: w != "")
    # five digits are a postal code, unless they come first
    placed = F.filter(words, lambda w, i: (i == 0) | ~w.rlike("^[0-9]{5}$"))
    table = F.create_map(*[F.lit(x) for x in chain(*ADDRESS_WORDS.items())])

    def plain(w: Column) -> Column:
        block = F.regexp_replace(F.regexp_replace(w, "^0+(?=[0-9])", ""), "(?<=^[0-9]{0,12})[0-9]{2}$", "xx")
        block = F.when(block == "xx", F.lit("0xx")).when(block.rlike("^[0-9]$"), F.lit("0xx")).otherwise(block)
        return F.when(w.rlike("^[0-9]{1,14}$"), block).otherwise(F.coalesce(F.try_element_at(table, w), w))

    kept = F.filter(placed, lambda w: ~w.isin(*ADDRESS_FILLERS))
    return F.array_sort(F.array_distinct(F.transform(kept, plain)))


def unknown_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("Unknown"))
