"""Categories, tags and content gates as ordered rules over text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import word

# Keyword lists of the tags.
KEYWORDS = {
    "drinking": ["cocktail", "beer", "wine", "happy hour", "margarita", "drinks", "brewery", "taproom", "pub", "spirits", "bottomless", "mimosa", "sangria", "bar crawl"],
    "active": ["pickleball", "yoga", "run", "pickup", "basketball", "volleyball", "tennis", "swim", "hike", "cycling", "crossfit", "bootcamp", "surf", "paddleboard", "kayak", "soccer", "softball", "5k"],
    "outdoor": ["outdoor", "park", "beach", "garden", "rooftop", "patio", "lakeside", "waterfront", "trail", "sunset"],
    "food": ["food", "taco", "bbq", "brunch", "dinner", "chef", "cuisine", "wing", "pizza", "burger", "sushi", "seafood", "cooking class", "food truck", "taste", "culinary"],
    "music": ["live music", "dj", "band", "concert", "jazz", "blues", "acoustic", "karaoke", "open mic", "orchestra", "symphony"],
    "family": ["family", "kids", "children", "all ages", "storytime", "puppet", "face paint", "petting zoo", "carnival"],
    "singles": ["singles", "speed dating", "speed-dating", "mixer", "meet & greet", "meet and greet", "matchmak", "dating event", "dating night", "love connection", "solo travelers", "solo friendly", "singles night", "singles mingle", "eligible bachelor", "first date", "date night"],
    "date": ["date night", "couples", "romantic", "candlelit", "sunset cruise", "wine and paint", "wine & paint", "paint and sip", "dinner show"],
}

# Signs of adult entertainment, per language.
ADULT_PATTERNS = [
    r"\b(strip\s*club|stripclub|topless\s+(?:bar|club|dance|dancers)|gentlemen'?s?\s*club|adult\s+(?:club|entertainment|cabaret)|nude\s+(?:dance|dancers|bar|club)|exotic\s+(?:dance|dancers|club)|burlesque\s+club|peep\s+show|bikini\s+bar|lap\s+dance|cabaret\s+club|swingers\s+club|lifestyle\s+club|after\s+hours\s+club)\b",
    r"\b(club\s+de\s+(?:striptease|caballeros|adultos)|casa\s+de\s+citas|table\s+dance|centro\s+nocturno\s+(?:adulto|para\s+adultos)|club\s+(?:nudista|er[oó]tico|de\s+caballeros)|cabaret\s+(?:adulto|er[oó]tico))\b",
    r"\b(club\s+de\s+strip(?:tease)?|cabaret\s+(?:[eé]rotique|adulte)|bo[iî]te\s+(?:[eé]changiste|de\s+nuit\s+adulte)|club\s+libertin|salon\s+(?:[eé]rotique|adulte))\b",
    r"\b(stripclub|tabledance(?:\s+club|\s+bar)?|bordell|laufhaus|eros\s*center|fkk\s+club|tabledance\s+lokal|nachtclub\s+f[uü]r\s+erwachsene|gentlemen\s+club)\b",
    r"\b(locale\s+a\s+luci\s+rosse|club\s+priv[eé]\s+(?:scambisti|libertino)|centro\s+massaggi\s+erotici|locale\s+per\s+adulti|spogliarello\s+club)\b",
    r"\b(casa\s+de\s+strip(?:tease)?|boate\s+(?:adulta|de\s+strip)|clube\s+(?:de\s+(?:prazeres|adultos)|er[oó]tico)|cabar[eé]\s+adulto)\b",
    r"(キャバクラ|ストリップ劇場|ストリップ\s*クラブ|風俗店|kyabakura|girl'?s?\s+bar\s+(?:tokyo|osaka|kyoto|shibuya|roppongi))",
]
ADULT_NAMES = [
    "cheetah", "cheetah lounge", "cheetah club", "cheetah pompano", "cheetah pompano beach", "cheetah hallandale", "diamond dolls", "tootsie's cabaret", "tootsies cabaret", "hustler club",
    "pure platinum", "the office gentlemens club", "club madonna", "scarlett's cabaret", "scarletts cabaret", "rachels gentlemens club", "spearmint rhino", "deja vu showgirls",
    "sapphire gentlemen's club", "solid gold", "solid gold pompano", "goldfinger", "goldfingers", "foxxxes", "foxxxy lady", "foxy lady", "the penthouse club", "penthouse club",
    "the wishing well lounge", "bare elegance", "the body shop", "thee dollhouse", "the dollhouse", "trapeze", "trapeze club", "trapeze pompano", "vixens", "vixens cabaret",
    "diamond cabaret", "club rolexx", "rolexx", "lambordini's", "secrets cabaret", "thee playmates club", "playmates club",
]
ADULT_TYPES = ["adult_entertainment_club", "adult_entertainment_store", "strip_club"]
CABARET_THEATRES = ["cabaret theatre", "the cabaret", "broadway cabaret", "supper cabaret"]

# Titles that say nothing, titles that do, and words that announce local events.
GENERIC_TITLES = [
    r"^\s*(weekly|recurring|special|live|nightly|daily|monthly|seasonal)\s+(event|special|night)\s*$",
    r"^\s*(event|special|night|happy\s+hour)\s*$",
    r"^\s*every\s+\w+\s*$",
    r"^\s*the\s+(event|night|show)\s*$",
    r"^\s*\w+\s+night\s*$",
    r"^\s*open\s*$",
    r"^\s*tba\s*$",
    r"^\s*tbd\s*$",
]
GOOD_NIGHTS = [
    "trivia night", "comedy night", "karaoke night", "open mic night", "salsa night", "bachata night", "latin night", "country night",
    "ladies night", "drag night", "industry night", "throwback night", "game night", "movie night", "jazz night", "blues night",
]
LOCAL_SIGNALS = [
    "live music", "event calendar", "events calendar", "upcoming events", "buy tickets", "get tickets", "rsvp", "reserve", "trivia", "karaoke",
    "open mic", "comedy night", "dj", "showtime", "showtimes", "happy hour", "paint and sip", "tasting", "class schedule", "workshop",
]


def ascii_bounds(pattern: str) -> str:
    """A pattern with ``\\b`` meant for ASCII words, as Java needs it, without regard to case."""
    start, end = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
    return "(?i)" + pattern.replace(r"\b", f"(?:{start}|{end})")


def has_keyword(text: Column, kind: str) -> Column:
    """Whether a lower-cased text has a keyword between word boundaries."""
    return text.rlike(word("|".join(map(re.escape, KEYWORDS[kind]))))


def any_language(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{ascii_bounds(p)})" for p in ADULT_PATTERNS))


def first_brand(text: Column) -> Column:
    """The first listed brand that the text has as words; null if none."""
    found = F.lit(None).cast("string")
    for name in reversed(ADULT_NAMES):
        found = F.when(text.rlike("(?i)" + word(re.escape(name))), F.lit(name)).otherwise(found)
    # Few texts have one: a single pattern for all of them comes first.
    return F.when(text.rlike("(?i)" + word("|".join(map(re.escape, ADULT_NAMES)))), found)


def is_adult_venue(name: Column, types: Column | None = None) -> Column:
    own = F.coalesce(name, F.lit(""))
    brand = own.rlike("(?i)" + word("|".join(map(re.escape, ADULT_NAMES))))
    cabaret = own.rlike("(?i)(?<![A-Za-z0-9_])[a-z]{3,}\\s+cabaret(?![A-Za-z0-9_])") & ~F.lower(F.trim(own)).isin(CABARET_THEATRES)
    found = brand | any_language(own) | cabaret
    if types is not None:
        found = found | F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, ADULT_TYPES))), F.lit(False))
    return found


def adult_reason(title: Column, description: Column, venue: Column, types: Column | None = None) -> Column:
    """Why an event counts as adult; null if it doesn't."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    brand = first_brand(empty(title))
    phrase = F.lower(F.trim(F.regexp_extract(empty(title), r"(?i)(?<![A-Za-z0-9_])at\s+([a-z'\s]+\s+cabaret)(?![A-Za-z0-9_])", 1)))
    return (
        F.when(is_adult_venue(venue, types), F.concat(F.lit("adult venue: "), empty(venue)))
        .when(any_language(F.concat(empty(title), F.lit(" "), empty(description))), "hard adult pattern in title/desc")
        .when(brand.isNotNull(), F.concat(F.lit("adult brand in title: "), brand))
        .when((phrase != "") & ~phrase.isin(CABARET_THEATRES), F.concat(F.lit("cabaret venue in title: "), phrase))
    )


def scraped_reason(title: Column, description: Column, venue: Column) -> Column:
    """The first quality rule that a scraped event breaks; null if none."""
    t, d, v = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, description, venue))
    low = F.lower(t)
    generic = ~low.isin(GOOD_NIGHTS) & t.rlike("|".join(f"(?i:{p.replace(chr(92) + 'w', '[A-Za-z0-9_]')})" for p in GENERIC_TITLES))
    said = F.trim(F.regexp_replace(d, r"(?i)^\s*(recurring|weekly|nightly|special)\s+event\.?\s*$", ""))
    return (
        F.when(t == "", "empty title")
        .when(F.length(t) < 6, F.concat(F.lit('title too short: "'), t, F.lit('"')))
        .when((v != "") & (low == F.lower(v)), "title is just the venue name")
        .when(generic, F.concat(F.lit('generic title: "'), t, F.lit('"')))
        .when(F.length(said) < 24, F.concat(F.lit('description too short: "'), F.when(said != "", said).otherwise(d), F.lit('"')))
    )


def local_signal(text: Column) -> Column:
    """Points for words, days with times, and dates that announce local events; three suffice."""
    low = F.lower(text)
    points = F.lit(0)
    for s in LOCAL_SIGNALS:
        points = points + F.when(low.contains(s), 2 if " " in s else 1).otherwise(0)
    day = low.rlike(word(r"(?:mon|tue|wed|thu|fri|sat|sun)(?:day)?s?")) & low.rlike(word("am|pm"))
    date = low.rlike(word(r"\d{1,2}/\d{1,2}")) | low.rlike(word(r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}"))
    return points + F.when(day, 2).otherwise(0) + F.when(date, 2).otherwise(0)


def generate_tags(title: Column, description: Column, subcategory: Column, category: Column, is_free: Column, hour: Column, ticket_url: Column, venue_category: Column) -> Column:
    """Tags by twelve rules in order, each once. ``hour`` is the start's local hour."""
    low = F.lower(F.concat(title, F.lit(" "), F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(subcategory, F.lit(""))))
    place, none = F.coalesce(venue_category, F.lit("")), F.lit(None).cast("string")
    tag = lambda condition, name: F.when(condition, F.lit(name))
    bar = place.isin("bar", "club") | (category == "nightlife")
    of_age = bar | low.contains("21+")
    family, singles = has_keyword(low, "family"), has_keyword(low, "singles")
    all_ages = family | (category == "community")
    adult_only = of_age | low.contains("18+")
    listed = F.array(
        F.when(of_age, "21+").when(low.contains("18+"), "18+").otherwise(none),
        tag(all_ages, "all-ages"),
        tag(all_ages, "family"),
        tag(bar | has_keyword(low, "drinking"), "drinking"),
        tag((category == "music") | has_keyword(low, "music"), "live-music"),
        tag((place == "park") | (category == "outdoors") | has_keyword(low, "outdoor"), "outdoor"),
        tag((category == "food") | (place == "restaurant") | has_keyword(low, "food"), "food"),
        tag(category.isin("sports", "fitness") | has_keyword(low, "active"), "active"),
        tag(is_free, "free"),
        tag(singles, "singles"),
        tag(singles, "date-night"),
        tag(singles & ~adult_only & ~all_ages, "21+"),
        tag(category.isin("nightlife", "arts") | has_keyword(low, "date") | ((category == "food") & ~family), "date-night"),
        F.when((hour >= 22) | (hour < 4), "late-night").when(hour < 17, "daytime").otherwise(none),
        tag((F.coalesce(ticket_url, F.lit("")) != "") & ~is_free, "ticketed"),
    )
    return F.array_distinct(F.array_compact(listed))


# Ordered ladders of categories.
CATEGORY_RULES = [
    ("sports", r"football|basketball|baseball|soccer|volleyball|hockey|lacrosse|swimming|tennis|track|cross country|softball|game vs|vs\."),
    ("music", "concert|orchestra|recital|chorus|symphony|jazz|opera|musical|band"),
    ("arts", "exhibition|gallery|theatre|theater|dance recital|art show|film"),
]
SUBCATEGORY_RULES = [
    ("football", "football"),
    ("basketball", "basketball"),
    ("baseball", "baseball"),
    ("soccer", "soccer"),
    ("concert", "concert|recital|symphony|orchestra"),
    ("lecture", "lecture|talk|seminar|panel|colloquium"),
    ("theater", "theatre|theater|play"),
    ("gallery", "exhibition"),
]


def ladder(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose words the text has; a boundary after a mark needs a word to follow."""
    found = F.lit(otherwise)
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(ascii_bounds(rf"\b(?:{pattern})\b")), name).otherwise(found)
    return found


def category_of(title: Column, description: Column, tags: Column) -> Column:
    return ladder(F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit("")), F.array_join(tags, " "))), CATEGORY_RULES, "community")


def subcategory_of(title: Column, description: Column) -> Column:
    return ladder(F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit("")))), SUBCATEGORY_RULES, "event")


def ticket_category(segment: Column, genre: Column) -> Column:
    """struct(category, subcategory) of a ticketing segment and genre."""
    s, g = F.lower(F.coalesce(segment, F.lit(""))), F.lower(F.coalesce(genre, F.lit("")))
    pair = lambda c, sub: F.struct(F.lit(c).alias("category"), sub.alias("subcategory"))
    genre_or = lambda other: F.when(g != "", g).otherwise(other)
    return (
        F.when(s == "music", pair("music", genre_or("concert")))
        .when(s == "sports", pair("sports", genre_or("sports_event")))
        .when(s == "arts & theatre", pair("arts", genre_or("theater")))
        .when(s == "film", pair("movies", F.lit("screening")))
        .when(g.contains("comedy"), pair("nightlife", F.lit("comedy")))
        .otherwise(pair("community", genre_or("event")))
    )


def seat_category(kind: Column) -> Column:
    """struct(category, subcategory) of the legacy ticketing type."""
    t = F.lower(kind)
    pair = lambda c, sub: F.struct(F.lit(c).alias("category"), sub.alias("subcategory"))
    return (
        F.when(t.rlike("concert|music"), pair("music", F.lit("concert")))
        .when(t.rlike("sports|nfl|nba|mlb"), pair("sports", t))
        .when(t.rlike("theater|broadway"), pair("arts", F.lit("theater")))
        .when(t.contains("comedy"), pair("nightlife", F.lit("comedy")))
        .when(t.contains("festival"), pair("community", F.lit("festival")))
        .otherwise(pair("community", t))
    )


def venue_category(types: Column) -> Column:
    """Category of a place from its list of types."""
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return (
        F.when(has("bar", "night_club"), "bar").when(has("restaurant"), "restaurant").when(has("movie_theater"), "cinema").when(has("stadium"), "stadium")
        .when(has("park", "amusement_park"), "park").when(has("gym"), "gym").when(has("performing_arts_theater", "concert_hall"), "venue").otherwise("other")
    )


# Price levels of places, from 0.
PRICE_LEVELS = ["PRICE_LEVEL_FREE", "PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE"]


def price_level(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(PRICE_LEVELS) for x in (name, i)]), level)
