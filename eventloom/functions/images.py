"""The photo an event is shown with where it brings none of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHOTO = "https://images.unsplash.com/photo-{}?w=600"

# Photos by subcategory, the kinds of tags and of words in the text (the first rule that fits counts), and by category.
SUBCATEGORIES = {
    "pickleball": "1554068865-24cecd4e34b8",
    "basketball": "1546519638-68e109498ffc",
    "volleyball": "1612872087720-bb876e2e67d1",
    "soccer": "1574629810360-7efbbe195018",
    "tennis": "1554068865-24cecd4e34b8",
    "softball": "1529768167801-9173d94c2a42",
    "golf": "1535131749006-b7f58c99034b",
    "swimming": "1530549387789-4c1017266635",
    "surfing": "1507525428034-b723cf961d3e",
    "bowling": "1545232979-8bf68ee9b1af",
    "sports_event": "1546519638-68e109498ffc",
    "yoga": "1544367567-0f2fcb009e0b",
    "zumba": "1524594152303-9fd13543fe6e",
    "running": "1552674605-db6ffd4facb5",
    "crossfit": "1534438327276-14e5300c3a48",
    "bootcamp": "1534438327276-14e5300c3a48",
    "pilates": "1518611012118-696072aa579a",
    "concert": "1501281668745-f7f57925c3b4",
    "live_music": "1511671782779-c97d3d27a1d4",
    "jam_session": "1415201364774-f6f0bb35f28f",
    "open_mic": "1478147427282-58a87a120781",
    "dj_set": "1504609813442-a8924e83f76e",
    "jazz": "1415201364774-f6f0bb35f28f",
    "karaoke": "1516450360452-9312f5e86fc7",
    "trivia": "1606326608606-aa0b62935f2b",
    "game_night": "1610890716171-6b1bb98ffd09",
    "happy_hour": "1551024709-8f23befc6f87",
    "comedy": "1585699324551-f6c309eedeca",
    "dancing": "1504609813442-a8924e83f76e",
    "bar_crawl": "1572116469696-31de0f17cc34",
    "dining": "1414235077428-338989a2e8c0",
    "brunch": "1504754524776-8f4f37790ca0",
    "market": "1488459716781-31db52582fe9",
    "food_truck": "1565123409695-7b5ef63a2efb",
    "wine_tasting": "1510812431401-41d2bd2722f3",
    "cooking_class": "1556910103-1c02745aae4d",
    "beer": "1535958636474-b021ee887b13",
    "theater": "1503095396549-807759245b35",
    "gallery": "1513364776144-60967b0f800f",
    "workshop": "1460661419201-fd4cecdf8a8b",
    "magic_show": "1503095396549-807759245b35",
    "museum": "1554907984-15263bfd63bd",
    "painting": "1460661419201-fd4cecdf8a8b",
    "hiking": "1551632811-561732d1e306",
    "kayaking": "1472745942893-4b9f730c7668",
    "birding": "1441974231531-c6227db76b6e",
    "fishing": "1507525428034-b723cf961d3e",
    "camping": "1504280390367-361c6d9f38f4",
    "beach": "1507525428034-b723cf961d3e",
    "nature": "1441974231531-c6227db76b6e",
    "paddleboard": "1472745942893-4b9f730c7668",
    "screening": "1489599849927-2ee91cede3ba",
    "outdoor_movie": "1517604931442-7e0c8ed2963c",
    "speed_dating": "1522202176988-66273c2fd55f",
    "singles_mixer": "1529333166437-7750a6dd5a70",
    "matchmaking": "1522202176988-66273c2fd55f",
    "date_night": "1551024601-bec78aea704b",
    "couples": "1414235077428-338989a2e8c0",
    "paint_sip": "1460661419201-fd4cecdf8a8b",
    "tasting": "1510812431401-41d2bd2722f3",
    "volunteer": "1559027615-cd4628902d4a",
    "networking": "1515187029135-18ee286d815b",
    "lecture": "1475721027785-f74eccf877e2",
    "class": "1524178232363-1fb2b075b655",
    "kids": "1533174072545-7a4b6ad7a6c3",
    "social": "1529156069898-49953e39b3ac",
    "language": "1543269865-cbf427effbad",
    "festival": "1533174072545-7a4b6ad7a6c3",
    "charity": "1559027615-cd4628902d4a",
}
TAGS = {
    "singles": "singles_mixer",
    "date-night": "date_night",
    "couples": "couples",
    "21+": "happy_hour",
    "live-music": "live_music",
    "happy-hour": "happy_hour",
    "trivia": "trivia",
    "karaoke": "karaoke",
    "outdoor": "nature",
    "active": "running",
}
WORDS = [
    (["pickleball"], "pickleball"),
    (["basketball", "hoops"], "basketball"),
    (["volleyball"], "volleyball"),
    (["soccer", "futsal"], "soccer"),
    (["tennis"], "tennis"),
    (["bowling", "bowl", "bowlero", "bowlmor", "strikes"], "bowling"),
    (["golf"], "golf"),
    (["swim"], "swimming"),
    (["surf"], "surfing"),
    (["yoga"], "yoga"),
    (["zumba", "dance fitness"], "zumba"),
    (["run ", "running", "5k", "marathon"], "running"),
    (["crossfit", "bootcamp"], "crossfit"),
    (["pilates"], "pilates"),
    (["karaoke"], "karaoke"),
    (["trivia"], "trivia"),
    (["board game", "game night"], "game_night"),
    (["open mic"], "open_mic"),
    (["comedy", "improv", "stand-up"], "comedy"),
    (["salsa", "bachata", "latin dance", "line dancing", "dancing"], "dancing"),
    (["happy hour"], "happy_hour"),
    (["dj"], "dj_set"),
    (["jazz", "blues"], "jazz"),
    (["jam session"], "jam_session"),
    (["brunch"], "brunch"),
    (["farmer", "market"], "market"),
    (["food truck"], "food_truck"),
    (["wine tasting", "wine "], "wine_tasting"),
    (["cooking class", "chef"], "cooking_class"),
    (["beer", "brew", "taproom"], "beer"),
    (["paint and sip", "paint & sip", "wine and paint"], "paint_sip"),
    (["tasting"], "tasting"),
    (["theater", "theatre", "play", "musical"], "theater"),
    (["gallery", "exhibit"], "gallery"),
    (["workshop", "craft", "mosaic", "pottery"], "workshop"),
    (["magic"], "magic_show"),
    (["museum"], "museum"),
    (["paint", "art class"], "painting"),
    (["hike", "trek", "trail", "walk"], "hiking"),
    (["kayak", "canoe", "paddle"], "kayaking"),
    (["bird"], "birding"),
    (["fish"], "fishing"),
    (["beach", "ocean"], "beach"),
    (["camp"], "camping"),
    (["movie", "film", "cinema", "screening"], "screening"),
    (["volunteer", "cleanup"], "volunteer"),
    (["network", "meetup"], "networking"),
    (["lecture", "talk", "seminar"], "lecture"),
    (["kids", "children", "tot ", "toddler"], "kids"),
    (["festival", "fair"], "festival"),
    (["speed dating", "speed-dating"], "speed_dating"),
    (["singles mixer", "singles night", "singles mingle", "singles event"], "singles_mixer"),
    (["matchmaking", "matchmaker"], "matchmaking"),
    (["couples & single", "couples and single", "couples & ladies", "couples and ladies", "singles & couples", "singles and couples", "for couples", "date night", "couples night", "couples event", "romantic"], "date_night"),
    (["single ladies"], "date_night"),
    (["flirty", "flirt night", "flirt event"], "date_night"),
    (["girls night", "girls' night", "ladies' night", "ladies night"], "social"),
    (["mixer"], "networking"),
]
CATEGORIES = {
    "nightlife": "1566737236500-c8ac43014a67",
    "music": "1501281668745-f7f57925c3b4",
    "sports": "1546519638-68e109498ffc",
    "food": "1414235077428-338989a2e8c0",
    "arts": "1513364776144-60967b0f800f",
    "outdoors": "1441974231531-c6227db76b6e",
    "movies": "1489599849927-2ee91cede3ba",
    "fitness": "1571019614242-c5c5dee9f50b",
    "community": "1529156069898-49953e39b3ac",
}


def _photo(kind: str) -> Column:
    return F.lit(PHOTO.format(SUBCATEGORIES[kind]))


def _by(photos: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, photo in photos.items() for x in (name, PHOTO.format(photo))]), key)


def by_tags(tags: Column, category: Column) -> Column:
    """The photo of the strongest tag, else of the first with one.

    Where every night out carries the tags of couples (nightlife and community), they say nothing.
    """
    photos = {tag: SUBCATEGORIES[kind] for tag, kind in TAGS.items()}
    crowd = F.coalesce(category.isin("nightlife", "community"), F.lit(False))
    strong = F.when(crowd, F.array(*map(F.lit, ("singles", "live-music", "happy-hour")))).otherwise(F.array(*map(F.lit, ("date-night", "couples", "singles"))))
    usable = F.filter(tags, lambda t: t.isin(*photos) & ~(crowd & t.isin("date-night", "couples")))
    first = F.get(F.concat(F.array_intersect(strong, usable), usable), F.lit(0))
    return _by(photos, first)


def with_image(events: DataFrame, context: Column | None = None) -> DataFrame:
    """Add ``image``: the event's own, else by words of its text, subcategory, tags, category; never null.

    Nulls count as empty; an empty image or subcategory is none. ``context`` is more text, such as the venue's name.
    """
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("description"), context if context is not None else F.lit(""))]
    text = events.withColumn("__text", F.lower(F.concat_ws(" ", *parts)))
    by_word = F.lit(None).cast("string")
    for words, kind in reversed(WORDS):
        fits = F.lit(False)
        for w in words:
            fits = fits | F.col("__text").contains(w)
        by_word = F.when(fits, _photo(kind)).otherwise(by_word)
    category = F.coalesce(F.col("category"), F.lit("community"))
    image = F.coalesce(
        F.nullif(F.col("image_url"), F.lit("")), by_word, _by(SUBCATEGORIES, F.coalesce(F.col("subcategory"), F.lit(""))), by_tags(F.col("tags"), category), _by(CATEGORIES, category), _by(CATEGORIES, F.lit("community"))
    )
    return text.withColumn("image", image).drop("__text")
