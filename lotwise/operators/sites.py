"""The sources as data: how pages of each are read, and how its rows are treated.

Jobs and the extraction take a table of ``Site`` by source name (``SITES`` by
default), so a further source is an entry more, not a change of the library.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from lotwise.operators.htmldom import attr, cls, tag
from lotwise.schema import COMBINED_RANK, FILE_STEM, SOURCE_A, SOURCE_B, SOURCE_C

# ---- fixed values: per-site rule tables ------------------------------------------------
BASE_A = "https://www.cars.com"
BASE_B = "https://www.cargurus.com"
BASE_C_DEFAULT = "https://philadelphia.craigslist.org"

RULES_A = {
    "card": [cls("vehicle-card"), cls("vehicle-card", "article")],
    "link": [cls("vehicle-card-link", "a"), attr("href", "/vehicledetail/", "a", "*=")],
    "title": [tag("h2"), cls("vehicle-card-link", "a")],
    "price": [cls("primary-price"), attr("data-test", "vehicleCardPricingBlockPrice")],
    "mileage": [cls("mileage"), attr("data-test", "vehicleMileage")],
    "dealer": [cls("dealer-name"), attr("data-test", "vehicleCardDealerInfo")],
    "location": [cls("dealer-name__location"), cls("vehicle-card-location"), attr("data-test", "vehicleCardLocation")],
}
RULES_B = {
    "card": [attr("data-test", "inventory-listing"), attr("data-cg-ft", "inventory-listing"),
             attr("data-listingid", None, "div")],
    "link": [attr("data-test", "listing-link", "a"), attr("itemprop", "url", "a"), attr("href", None, "a")],
    "price": [attr("data-test", "listing-price"), attr("itemprop", "price"), attr("data-cg-ft", "listing-price")],
    "mileage": [attr("data-test", "mileage"), attr("data-test", "listing-mileage"), attr("itemprop", "mileage")],
    "dealer": [attr("data-test", "dealer-name"), attr("itemprop", "seller"), attr("data-cg-ft", "dealer-name")],
    "location": [attr("data-test", "dealer-address"), attr("data-test", "listing-location"),
                 attr("itemprop", "address")],
}
RULES_C = {
    "card": [cls("result-row", "li"), cls("cl-search-result", "li")],
    "link": [cls("result-title", "a"), cls("hdrlnk", "a")],
    "price": [cls("result-price", "span"), cls("price", "span")],
    "location": [cls("result-hood", "span"), cls("nearby", "span")],
}


@dataclass(frozen=True)
class Site:
    """A source.

    ``rules``: the card rule table (card, link and fields; see ``htmldom``), ``base``: what
    relative links belong to, unless ``page_host`` says the host of the page; ``separators``
    of the text pieces of a field; ``bare_place``: brackets around a location go.
    ``structured``: where rows are looked for before the cards: "embedded" (a listing
    list in some script's JSON), "linked" (linked data), or "" (nowhere).
    ``dedupes``: a repeated URL counts once, within a page and over all; ``banner_stops``: an
    out-of-area banner ends a crawl; ``limits_mileage``: the row filter looks at mileage.
    ``rank``: its place among the sources of a combined run; ``file_stem``: of its result file;
    ``reported``: fields whose gaps the summary counts; ``categories`` in the order they are crawled."""

    rules: Mapping[str, list]
    base: str
    rank: int
    file_stem: str
    structured: str = ""
    separators: Mapping[str, str] = field(default_factory=dict)
    page_host: bool = False
    bare_place: bool = False
    dedupes: bool = True
    banner_stops: bool = False
    limits_mileage: bool = True
    reported: tuple[str, ...] = ("dealer", "location")
    categories: tuple[str, ...] = ()

    def __post_init__(self):
        if self.structured not in ("", "embedded", "linked"):
            raise ValueError(f"no such place for structured rows: {self.structured!r}")
        if not {"card", "link"} <= set(self.rules):
            raise ValueError("a rule table needs rules for card and link")


SITES: dict[str, Site] = {
    SOURCE_A: Site(RULES_A, BASE_A, COMBINED_RANK[SOURCE_A], FILE_STEM[SOURCE_A], separators={"dealer": " ", "location": " "},
                   banner_stops=True),
    SOURCE_B: Site(RULES_B, BASE_B, COMBINED_RANK[SOURCE_B], FILE_STEM[SOURCE_B], "embedded", dedupes=False),
    SOURCE_C: Site(RULES_C, BASE_C_DEFAULT, COMBINED_RANK[SOURCE_C], FILE_STEM[SOURCE_C], "linked", page_host=True, bare_place=True,
                   limits_mileage=False, reported=("title", "location"), categories=("cto", "cta")),
}


def names(sites: Mapping[str, Site], **want) -> list[str]:
    """The sources whose fields have the wanted values."""
    return [n for n, s in sites.items() if all(getattr(s, k) == v for k, v in want.items())]
