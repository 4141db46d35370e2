"""Products and reviews out of an archive of crawled pages (page_id, url, html)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fv
from shelfscope.fixed_values import (
    BASIC_AUTHOR,
    BASIC_DATE,
    BASIC_OPTION,
    BASIC_STARS,
    BASIC_TEXT,
    ENHANCED_AUTHOR,
    ENHANCED_DATE,
    ENHANCED_HELPFUL,
    ENHANCED_IMAGE,
    ENHANCED_OPTION,
    ENHANCED_RATING,
    ENHANCED_STARS,
    ENHANCED_TEXT,
)
from shelfscope.functions.matching import computed_once
from shelfscope.functions.values import first_number, has_image, parse_rating
from shelfscope.sources import elements as el
from shelfscope.sources.elements import STEP

NAMED = "\n".join(f"{name}\t{chr(code)}" for name, code in {**name2codepoint, "apos": 39}.items())


@dataclass(frozen=True)
class CardRules:
    """Which anchors are product cards, and the attribute holding each field."""

    card_class: str | None = fv.CARD_CLASS
    attributes: Mapping[str, str] = field(default_factory=lambda: dict(fv.CARD_ATTRIBUTES))
    name_attribute: str = fv.CARD_NAME_ATTRIBUTE
    name_suffix: str = fv.CARD_NAME_SUFFIX


@dataclass(frozen=True)
class DisplayRules:
    """Selectors of cards that show their fields as text. ``complete`` skips cards without link,
    image, brand and name; otherwise only the link is needed."""

    card: str = fv.DISPLAY_CARD
    link: str = fv.DISPLAY_LINK
    brand: str = fv.DISPLAY_BRAND
    name: str = fv.DISPLAY_NAME
    price: str = fv.DISPLAY_PRICE
    discount: str = fv.DISPLAY_DISCOUNT
    rating: str | None = None
    reviews: str | None = None
    complete: bool = True


LOOSE_DISPLAY = DisplayRules(
    brand=fv.LOOSE_BRAND, name=fv.LOOSE_NAME, price=fv.LOOSE_PRICE, discount=fv.LOOSE_DISCOUNT,
    rating=fv.LOOSE_RATING, reviews=fv.LOOSE_REVIEWS, complete=False,
)


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with its entity (named or numeric) decoded."""
    entity = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    hexadecimal = F.regexp_extract(entity, "^#[xX](.+)$", 1)
    decimal = F.regexp_extract(entity, "^#([0-9]+)$", 1)
    code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("int")
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.element_at(F.str_to_map(F.lit(NAMED), F.lit("\n"), F.lit("\t")), entity)
    value = F.when(code.isNull(), named).when(known, character).otherwise("\ufffd")
    rest = F.substring(piece, F.length(entity) + 2, F.length(piece))
    return F.coalesce(F.when(entity != "", F.concat(value, rest)), F.concat(F.lit("&"), piece))


def unescape(text: Column) -> Column:
    """Text with named and numeric entities decoded; unknown ones stay."""
    pieces = F.split(text, "&")
    decoded = F.transform(F.slice(pieces, 2, F.size(pieces)), _decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(decoded, ""))).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not, in an opening tag; NULL when absent. Names are looked
    for from step to step, so never inside another value."""
    head = rf"(?is)^(?:<\w+)?{STEP}*?{re.escape(name)}\s*+=\s*+"
    pattern = head + r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=[\s>]))"""
    found = F.regexp_extract(tag, pattern, 0) != ""
    return F.when(found, unescape(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))


def anchors(pages: DataFrame) -> DataFrame:
    """Every anchor of every page in page order: opening tag and inner HTML. Comments, scripts and
    styles are not looked into. An anchor that is not closed ends where the next one begins. Built-in
    expressions only, one row per anchor."""
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    pieces = F.split(clean, r"(?i)<a(?=[\s>/])")
    opened = F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p.rlike(rf"(?is)^{STEP}*+>"))
    others = [c for c in pages.columns if c != "html"]
    return (
        pages.select(*others, F.posexplode(opened).alias("pos", "piece"))
        .withColumn("tag", F.regexp_extract("piece", rf"(?is)^{STEP}*+>", 0))
        .withColumn("inner", F.split(F.expr("substring(piece, length(tag) + 1)"), r"(?i)</a(?=[\s>])", 2)[0])
        .withColumn("tag", F.concat(F.lit("<a"), "tag"))
        .drop("piece")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """href and plain text of every anchor, with page_id and position."""
    text = F.trim(unescape(F.regexp_replace("inner", "<[^>]*>", "")))
    return anchors(pages).select(
        "page_id", "pos", F.coalesce(attribute(F.col("tag"), "href"), F.lit("")).alias("link"),
        text.alias("text"),
    )


def extract_product_cards(pages: DataFrame, rules: CardRules = CardRules()) -> DataFrame:
    """One row per product card anchor, fields from its data attributes, image from the first image
    inside (``src``, else ``data-src``), name from the label without its suffix."""
    cards = anchors(pages)
    tag = F.col("tag")
    if rules.card_class is not None:
        classes = F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+")
        cards = cards.filter(F.array_contains(classes, rules.card_class))
    image = F.regexp_extract("inner", rf"(?is)<img(?=[\s>/]){STEP}*+>", 0)
    source = F.coalesce(F.nullif(attribute(image, "src"), F.lit("")), attribute(image, "data-src"))
    label = F.coalesce(attribute(tag, rules.name_attribute), F.lit(""))
    fields = {
        name: F.coalesce(attribute(tag, source_name), F.lit(""))
        for name, source_name in rules.attributes.items()
    }
    return cards.select(
        *[c for c in cards.columns if c not in ("tag", "inner")],
        *[column.alias(name) for name, column in fields.items()],
        F.trim(F.replace(label, F.lit(rules.name_suffix), F.lit(""))).alias("name"),
        F.coalesce(source, F.lit("")).alias("image_url"),
        F.coalesce(attribute(tag, "href"), F.lit("")).alias("link"),
    )


class _Page:
    """Expressions over the elements of a page; each selector is evaluated once per page, and each attribute
    that one looks at (or ``attributes`` names) is read once per tag."""

    def __init__(self, pages: DataFrame, selectors: Iterable[str | None], attributes: Iterable[str] = ()):
        self.kept = [c for c in pages.columns if c != "html"]
        self.names = {s: f"_chosen{i}" for i, s in enumerate(dict.fromkeys(s for s in selectors if s))}
        read = sorted({*attributes, *[a for s in self.names for a in el.attributes_of(s)]})
        cut = computed_once(pages, _pieces=el.pieces(F.col("html"), unescape, attribute, read)).drop("html")
        found = computed_once(cut, _elements=el.elements(F.col("_pieces")))
        chosen = {name: el.select(F.col("_elements"), F.col("_pieces"), s) for s, name in self.names.items()}
        self.frame = computed_once(found, **chosen)

    def all(self, element: Column, selector: str) -> Column:
        return el.inside(F.col(self.names[selector]), element)

    def first(self, element: Column, selector: str) -> Column:
        """First descendant that matches, or NULL."""
        return F.get(self.all(element, selector), F.lit(0))

    def attribute(self, element: Column, name: str) -> Column:
        return F.get(F.col("_pieces"), element["at"])[el.field(name)]

    def text(self, element: Column, separator: str = "", strip: bool = True) -> Column:
        return el.text_of(F.col("_pieces"), element, separator, strip)

    def rows(self, blocks: Column, fields: Callable[[Column], dict[str, Column]], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
        """One row per block, in page order, with the page's other columns and `pos`."""
        if wanted is not None:
            blocks = F.filter(blocks, wanted)
        made = F.transform(blocks, lambda b: F.struct(*[c.alias(n) for n, c in fields(b).items()]))
        found = self.frame.select(*self.kept, F.posexplode(made).alias("pos", "_row"))
        return found.select(*self.kept, "pos", "_row.*")


def extract_display_cards(pages: DataFrame, rules: DisplayRules = DisplayRules()) -> DataFrame:
    """Cards whose brand, name, price, discount (and rating, review count) are display text."""
    shown = [rules.link, "img", rules.brand, rules.name, rules.price, rules.discount, rules.rating, rules.reviews]
    page = _Page(pages, [rules.card, *shown], ("href", "src", "aria-label"))

    def label(card: Column, selector: str | None) -> Column:
        if not selector:
            return F.lit("")
        return F.coalesce(el.stripped(page.text(page.first(card, selector), strip=False)), F.lit(""))

    def href(card: Column) -> Column:
        return F.coalesce(page.attribute(page.first(card, rules.link), "href"), F.lit(""))

    def wanted(card: Column) -> Column:
        complete = href(card) != ""
        if rules.complete:
            for selector in ("img", rules.brand, rules.name):
                complete = complete & page.first(card, selector).isNotNull()
        return complete

    def fields(card: Column) -> dict[str, Column]:
        price = label(card, rules.price)
        if not rules.complete:
            price = F.coalesce(page.attribute(page.first(card, rules.price), "aria-label"), price)
        return {
            "link": href(card),
            "image_url": F.coalesce(page.attribute(page.first(card, "img"), "src"), F.lit("")),
            "brand": label(card, rules.brand), "name": label(card, rules.name), "price": price,
            "discount_pct": label(card, rules.discount), "rating": label(card, rules.rating),
            "review_count": label(card, rules.reviews),
        }

    cards = page.rows(F.col(page.names[rules.card]), fields, wanted)
    return cards.withColumn("text", F.concat("brand", F.lit(" "), "name"))


def extract_review_blocks(
    pages: DataFrame, enhanced: bool = True, blocks: Sequence[str] | None = None,
    fallback_chars: int = 500,
) -> DataFrame:
    """Review blocks of every page in page order. The first block selector with matches on a page
    is used, and fields fall back through their selectors. Columns of ``pages`` other than ``html``
    (product_id, brand, product_url, page_number) are kept. A block without a text element gives the
    first ``fallback_chars`` characters of its whole text (asked-for behaviour)."""
    selectors = list(blocks or (fv.ENHANCED_BLOCK if enhanced else fv.BASIC_BLOCK))
    if enhanced:
        lists = [ENHANCED_TEXT, ENHANCED_AUTHOR, ENHANCED_DATE, ENHANCED_OPTION]
        shown = [s for group in lists for s in group] + [ENHANCED_STARS, ENHANCED_RATING, ENHANCED_HELPFUL, ENHANCED_IMAGE]
    else:
        shown = [BASIC_TEXT, BASIC_STARS, BASIC_AUTHOR, BASIC_DATE, BASIC_OPTION]
    page = _Page(pages, [*selectors, *shown], ("class",))

    def first_text(block: Column, wanted: Sequence[str], longer_than: int) -> Column:
        """Text of the first selector that is long enough, else of the last one that matched."""
        texts = F.array_compact(F.array(*[page.text(page.first(block, s)) for s in wanted]))
        enough = lambda found: F.filter(found, lambda t: F.length(t) > longer_than)
        return el.let(texts, lambda found: F.coalesce(F.get(enough(found), F.lit(0)), F.try_element_at(found, F.lit(-1)), F.lit("")))

    def text(block: Column, selector: str) -> Column:
        return F.coalesce(page.text(page.first(block, selector)), F.lit(""))

    def basic_fields(block: Column) -> dict[str, Column]:
        whole = page.text(block, " ")
        content = page.text(page.first(block, BASIC_TEXT))
        return {
            "text": F.coalesce(content, F.substring(whole, 1, fallback_chars)),
            "author": text(block, BASIC_AUTHOR), "date": text(block, BASIC_DATE), "option": text(block, BASIC_OPTION),
            "rating": parse_rating(whole, F.size(page.all(block, BASIC_STARS))),
        }

    def enhanced_fields(block: Column) -> dict[str, Column]:
        icons = page.all(block, ENHANCED_STARS)
        filled = F.filter(icons, lambda i: F.contains(F.coalesce(page.attribute(i, "class"), F.lit("")), F.lit("fill")))
        stars = F.when(F.size(icons) > 0, F.size(filled).cast("string"))
        score = F.coalesce(page.text(page.first(block, ENHANCED_RATING), strip=False), F.lit(""))
        helpful = page.text(page.first(block, ENHANCED_HELPFUL), strip=False)
        return {
            "text": el.let(first_text(block, ENHANCED_TEXT, 10), lambda long: F.when(long != "", long).otherwise(
                F.substring(page.text(block, " "), 1, fallback_chars))),
            "author": first_text(block, ENHANCED_AUTHOR, 1), "date": first_text(block, ENHANCED_DATE, 0),
            "option": first_text(block, ENHANCED_OPTION, 0),
            "rating": F.coalesce(stars, first_number(score), F.lit("")),
            "helpful_count": F.when(helpful.isNull(), "0").otherwise(first_number(helpful)),
            "has_image": has_image(F.size(page.all(block, ENHANCED_IMAGE))),
        }

    found = F.col(page.names[selectors[-1]])
    for selector in reversed(selectors[:-1]):
        own = F.col(page.names[selector])
        found = F.when(F.size(own) > 0, own).otherwise(found)
    return page.rows(found, enhanced_fields if enhanced else basic_fields)


def valid_reviews(reviews: DataFrame, min_chars: int = 10) -> DataFrame:
    """Reviews whose text is longer than ``min_chars`` (0: not empty)."""
    return reviews.filter(F.length("text") > min_chars)
