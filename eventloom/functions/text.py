"""Text normalisation, cleaning and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(pattern: str) -> str:
    """The pattern between ASCII word boundaries (Java's own would take accented letters for words)."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def normalized(text: Column) -> Column:
    """Lower case, ``&`` as "and", everything but ASCII words as one space."""
    return F.trim(replaced(F.lower(text), ("&", " and "), (r"[^A-Za-z0-9_\s]", " "), (r"\s+", " ")))


def venue_word(address: Column) -> Column:
    """The normalised address before its first comma; empty for null."""
    return normalized(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1)))


# Words that say nothing about a title.
STOP_WORDS = ["the", "at", "in", "on", "of", "a", "an", "and", "with", "to", "for", "by", "&"]


def tokens(text: Column) -> Column:
    """Distinct words of two letters or more that are no stop words."""
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS)))


def without_venue(title: Column, venue: Column) -> Column:
    """The normalised title without " at <venue>" or " in <venue>" and what follows."""
    t, v = normalized(title), normalized(venue)
    pattern = F.concat(F.lit(r"^(.+?)\s+(?:at|in)\s+\Q"), v, F.lit(r"\E(?![A-Za-z0-9_]).*$"))
    found = F.call_function("regexp_extract", t, pattern, F.lit(1))
    return F.when((v == "") | (found == ""), t).otherwise(F.trim(found))


def similar_titles(title_a: Column, title_b: Column, venue: Column) -> Column:
    """Equal without the venue, or one's words among the other's, or most words in common."""
    a, b = without_venue(title_a, venue), without_venue(title_b, venue)
    ta, tb = tokens(a), tokens(b)
    common, fewer = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    return (a == b) | ((fewer >= 2) & ((common == fewer) | (common / F.size(F.array_union(ta, tb)) >= 0.65)))


_DROP = [(r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", "")]


def clean_text(raw: Column, most: int = 500) -> Column:
    """Plain text of a description: no markup, shortcodes, entities or links; null if nothing is left; cut with an ellipsis."""
    text = F.trim(
        replaced(
            raw, *_DROP, (r"(?is)\[caption.*?\[/caption\]", ""), (r"\[/?[A-Za-z0-9_]+[^\]]*\]", ""), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"),
            ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), (r"&#?[A-Za-z0-9_]+;", ""), (r"https?://\S+", ""), (r"\s+", " "),
        )
    )
    return F.when(text != "", F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(text, 1, most)), F.lit("…"))))


def page_text(html: Column, most: int = 9000) -> Column:
    """Plain text of a page, entities as spaces, cut."""
    steps = [*_DROP, (r"(?is)<noscript.*?</noscript>", ""), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), (r"&#?[A-Za-z0-9_]+;", " "), (r"\s+", " ")]
    return F.substring(F.trim(replaced(html, *steps)), 1, most)


def without_tags(html: Column) -> Column:
    """Scripts, styles and tags as spaces; blanks collapsed, not trimmed."""
    return replaced(html, (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), (r"\s+", " "))


def stored_description(text: Column) -> Column:
    """Clean-up of a stored description: only where markup, shortcodes or entities show."""
    cleaned = F.trim(replaced(text, (r"(?is)\[caption.*?\[/caption\]", ""), (r"\[/?[A-Za-z0-9_]+[^\]]*\]", ""), (r"<[^>]+>", " "), (r"&#?[A-Za-z0-9_]+;", " "), (r"\s+", " ")))
    return F.when(text.rlike(r"<[^>]+>|\[/?[A-Za-z]+|&#?[A-Za-z0-9_]+;"), F.nullif(cleaned, F.lit(""))).otherwise(text)


def slug(text: Column, most: int = 60, trim: bool = False) -> Column:
    """Lower case with dashes for everything but letters and digits, cut."""
    own = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    own = F.regexp_replace(own, "^-+|-+$", "") if trim else own
    return F.substring(own, 1, most)


def source_id(kind: str, *parts: Column) -> Column:
    """Ids of collected events: a prefix and parts joined by dashes."""
    return F.concat_ws("-", F.lit(kind), *parts)


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) url, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def host_and_port(url: Column) -> Column:
    """Lower-cased host of an http(s) url with its port, unless that is the scheme's own; else null."""
    whole = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#\s]+)", 1))
    usual = F.when(url.rlike("(?i)^https:"), F.regexp_replace(whole, ":443$", "")).otherwise(F.regexp_replace(whole, ":80$", ""))
    return F.nullif(F.regexp_replace(usual, ":$", ""), F.lit(""))


# Names and attributions of sources. The name of listings found by a model is our own wording.
SOURCE_NAMES = {
    "ticketmaster": "Ticketmaster", "google_places": "Google", "municipal": "City website", "community": "Community listing", "reddit": "Local roundup", "claude": "AI listing",
    "meetup": "Meetup", "espn": "ESPN", "pickleheads": "Pickleheads", "university": "Campus calendar", "highschool": "School sports",
}
SOURCE_LABELS = {
    "ticketmaster": "via Ticketmaster", "community": "via Eventbrite", "reddit": "from the local roundup", "scraped": "via venue page", "claude": "hand-picked by your AI",
    "meetup": "via Meetup", "espn": "via ESPN", "pickleheads": "via Pickleheads", "university": "via campus calendar", "highschool": "via school sports",
}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def source_name(source: Column, url: Column) -> Column:
    return F.when(source == "scraped", F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit("source"))).otherwise(looked_up(SOURCE_NAMES, source))


def source_label(source: Column) -> Column:
    return looked_up(SOURCE_LABELS, source)


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves upward."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f", F.floor(x * scale + F.lit(0.5)) / F.lit(float(scale)))


def distance_label(miles: Column) -> Column:
    return (
        F.when(miles < 0.1, "Right here").when(miles < 1, F.concat(_fixed(miles * 5280, 0), F.lit(" ft"))).otherwise(F.concat(_fixed(miles, 1), F.lit(" mi")))
    )


def price_label(is_free: Column, low: Column, high: Column) -> Column:
    """Free, a range, or a lower bound; null without a price."""
    shown = lambda x: F.format_string("$%d", x.cast("long"))
    return F.when(is_free, "Free").when(low.isNotNull() & high.isNotNull() & (high > low), F.concat(shown(low), F.lit("–"), shown(high))).when(low.isNotNull(), F.concat(shown(low), F.lit("+")))


# Display labels of categories and tags; others show as they are.
CATEGORY_LABELS = {
    "nightlife": "Nightlife", "music": "Music", "sports": "Sports", "food": "Food & Drink", "arts": "Arts & Culture", "outdoors": "Outdoors",
    "movies": "Movies", "fitness": "Fitness", "community": "Community",
}
TAG_LABELS = {
    "late-night": "Late Night", "daytime": "Daytime", "21+": "21+", "18+": "18+", "all-ages": "All Ages", "singles": "Singles", "family": "Family",
    "date-night": "Date Night", "drinking": "Drinking", "live-music": "Live Music", "outdoor": "Outdoor", "active": "Active", "free": "Free", "ticketed": "Ticketed",
}


def labelled(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, else the key."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[key], key)


def why_this(blurb: Column, category: Column, tags: Column, is_free: Column, source: Column, categories: list[str], own_tags: list[str]) -> Column:
    """The blurb, else the reasons why an event is shown (fixed sentences)."""
    matched = F.transform(F.slice(F.filter(tags, lambda t: t.isin(own_tags)), 1, 2), lambda t: labelled(t, TAG_LABELS))
    reasons = F.array_compact(
        F.array(
            F.when(category.isin(categories), F.concat(F.lit("matches your "), F.lower(labelled(category, CATEGORY_LABELS)), F.lit(" interest"))),
            F.when(F.size(matched) > 0, F.concat(F.lit("tagged "), F.array_join(matched, " + "))),
            F.when(is_free, "free entry"),
            F.when(source == "claude", "hand-picked by your AI"),
        )
    )
    said = F.when(F.size(reasons) == 0, "Showing because it's nearby and on your radar.").otherwise(F.concat(F.lit("Matches you on: "), F.array_join(reasons, ", "), F.lit(".")))
    return F.coalesce(F.nullif(blurb, F.lit("")), said)


def joined_address(*parts: Column) -> Column:
    """Parts that are not blank, joined by commas."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def ids_hash(ids: Column) -> Column:
    """FNV-1a (32 bits, hex) of the sorted ids joined by bars; ids are ASCII."""
    codes = F.filter(F.split(F.array_join(F.array_sort(ids), "|"), ""), lambda c: c != "")
    hashed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(hashed)), 8, "0")


# Entities that attributes are decoded from, in order.
ATTRIBUTE_ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]
_ATTRIBUTE = r"""([\w:-]+)\s*=\s*["']([^"']*)["']"""


def attribute_text(raw: Column) -> Column:
    """An attribute's value with the five entities decoded, trimmed."""
    for entity, plain in ATTRIBUTE_ENTITIES:
        raw = F.regexp_replace(raw, "(?i)" + entity, plain)
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def attributes(tag: Column) -> Column:
    """The attributes of a tag's text as a map, names in lower case; the last of a repeated name counts. Empty without any, null for null."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)), attribute_text)
    # Backwards, the first of a name is its last.
    back = F.reverse(F.arrays_zip(names.alias("name"), values.alias("value")))
    first = F.filter(back, lambda a, i: F.array_position(F.transform(back, lambda b: b["name"]), a["name"]) == i + 1)
    return F.map_from_entries(first)


def first_json(text: Column, kind: str = "array") -> Column:
    """The text from the first opening to the last closing bracket, for ``from_json``; null if there is none."""
    pattern = r"(?s)\[.*\]" if kind == "array" else r"(?s)\{.*\}"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
