"""Places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN_COUNTRY
from .text import is_cjk, strip

# Names of countries in texts, in the order in which they are looked for.
COUNTRIES = {
    "taiwan": "Taiwan", "china": "China", "japan": "Japan", "korea": "South Korea",
    "south korea": "South Korea", "republic of korea": "South Korea",
    "singapore": "Singapore", "malaysia": "Malaysia", "thailand": "Thailand",
    "vietnam": "Vietnam", "philippines": "Philippines", "indonesia": "Indonesia",
    "india": "India", "hong kong": "Hong Kong", "macau": "Macau",
    "united states": "United States", "usa": "United States", "u.s.a.": "United States",
    "us": "United States", "canada": "Canada", "mexico": "Mexico", "brazil": "Brazil",
    "united kingdom": "United Kingdom", "uk": "United Kingdom", "england": "United Kingdom",
    "scotland": "United Kingdom", "ireland": "Ireland", "germany": "Germany",
    "france": "France", "netherlands": "Netherlands", "the netherlands": "Netherlands",
    "belgium": "Belgium", "switzerland": "Switzerland", "austria": "Austria",
    "italy": "Italy", "spain": "Spain", "portugal": "Portugal", "sweden": "Sweden",
    "norway": "Norway", "denmark": "Denmark", "finland": "Finland", "poland": "Poland",
    "czech republic": "Czech Republic", "czechia": "Czech Republic",
    "hungary": "Hungary", "romania": "Romania", "russia": "Russia",
    "israel": "Israel", "turkey": "Turkey", "australia": "Australia",
    "new zealand": "New Zealand", "south africa": "South Africa",
    "united arab emirates": "United Arab Emirates", "saudi arabia": "Saudi Arabia",
    "luxembourg": "Luxembourg", "slovenia": "Slovenia", "slovakia": "Slovakia",
    "estonia": "Estonia", "lithuania": "Lithuania", "latvia": "Latvia",
    "greece": "Greece", "ukraine": "Ukraine", "bulgaria": "Bulgaria",
}
# What the cards take for a country at the end of a place, and headquarters without meaning.
CARD_COUNTRIES = [
    "china", "japan", "taiwan", "south korea", "korea (south)", "germany", "united states",
    "usa", "u.s.a.", "us", "singapore", "netherlands", "united kingdom", "uk", "france",
    "switzerland", "austria", "italy", "hong kong", "malaysia", "poland", "canada",
    "belgium", "israel", "czech republic", "sweden", "finland", "ireland", "denmark",
    "spain", "australia", "india", "thailand", "vietnam", "philippines", "mexico",
    "brazil", "russia", "norway", "new zealand", "luxembourg", "liechtenstein",
]
SUSPICIOUS = ["united states", "japan", "n/a", ""]


def parts_of(place: Column) -> Column:
    """Parts between commas, without white space and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(place, F.lit("")), ","), strip), lambda p: p != "")


def country_of(place: Column) -> Column:
    """The last part that is a country's name, else the last that holds one, the first in the list; else Unknown."""
    names = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    back = F.reverse(F.transform(parts_of(place), F.lower))
    keys = F.array(*(F.lit(k) for k in COUNTRIES))
    exact = F.filter(F.transform(back, lambda p: F.try_element_at(names, p)), lambda c: c.isNotNull())
    held = F.flatten(F.transform(back, lambda p: F.filter(keys, lambda k: p.contains(k))))
    return F.coalesce(F.get(exact, F.lit(0)), F.try_element_at(names, F.get(held, F.lit(0))), F.lit(UNKNOWN_COUNTRY))


def deduped_place(place: Column) -> Column:
    """Distinct parts in order; null if there are none."""
    return F.nullif(F.array_join(F.array_distinct(parts_of(place)), ", "), F.lit(""))


def headquarters_of(address: Column) -> Column:
    """Struct (location, country) from an address: the two parts before the last, and the last; India where it is empty."""
    valid = F.filter(parts_of(F.regexp_replace(F.coalesce(address, F.lit("")), r"\b\d{5,6}\b", "")), lambda p: ~p.rlike(r"^[\d\s\-#]+$"))
    n, last = F.size(valid), F.try_element_at(valid, F.lit(-1))
    place = F.when(n >= 3, F.array_join(F.slice(valid, -3, 2), ", ")).when(n > 0, F.get(valid, F.lit(0))).otherwise("India")
    return F.struct(place.alias("location"), F.coalesce(last, F.lit("India")).alias("country"))


def is_suspicious(place: Column) -> Column:
    """Headquarters that scraping gives when it finds nothing."""
    return F.lower(strip(place)).isin(SUSPICIOUS)


def card_country(c: Column) -> Column:
    """One spelling of a country for cards."""
    low = F.lower(strip(c))
    return (
        F.when(low.isin("korea (south)", "korea, south", "republic of korea"), "South Korea")
        .when(low.isin("usa", "u.s.a.", "us", "united states of america"), "United States")
        .when(low.isin("uk", "u.k."), "United Kingdom")
        .when(low.contains("hong kong"), "Hong Kong")
        .when(low.contains("taiwan"), "Taiwan")
        .when(low.contains("p.r.china") | low.contains("p.r. china"), "China")
        .otherwise(strip(c))
    )


def card_headquarters(location: Column, country: Column) -> Column:
    """Location and country as a card shows them: the country is added unless it is there, and stands alone for foreign branches."""
    known = F.when(strip(country).isin("", UNKNOWN_COUNTRY), None).otherwise(strip(country))
    loc = F.when(strip(location).rlike(r"(?i)^(#VALUE!|#N/A|N/A|UNKNOWN|-|NONE|\?+)$") | (strip(location) == ""), None).otherwise(strip(location))
    norm = card_country(known)
    clean = loc
    for pattern, name in ((r"(?i)\bKorea\s*\(South\)", "South Korea"), (r"(?i)\bP\.R\.China\b", "China"), (r"(?i)\bTaiwan,\s*China\b", "Taiwan"), (r"(?i)\bHong Kong,\s*China\b", "Hong Kong")):
        clean = F.regexp_replace(clean, pattern, name)
    last = F.lower(card_country(F.coalesce(F.try_element_at(parts_of(clean), F.lit(-1)), F.lit(""))))
    return (
        F.when(loc.isNull(), known)
        .when(known.isNull(), loc)
        .when(is_cjk(loc) | loc.rlike("[\\uac00-\\ud7af]"), norm)
        .when(F.lower(clean).contains(F.lower(norm)) | (last == F.lower(norm)), clean)
        .when(last.isin(CARD_COUNTRIES), norm)
        .otherwise(F.concat_ws(", ", clean, norm))
    )
