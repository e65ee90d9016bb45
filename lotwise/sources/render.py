"""Pages rendered from derived listings, for the extraction round trip.

The driver tables hold no listing pages, so pages are built from the derived
listing rows with Spark expressions: each row becomes a card (or a JSON /
JSON-LD object) in the markup of its source, and the cards of one page are
joined in reading order.  Page geometry (all from the order key ``o`` and
part key ``k``):

* page     = (source, order, block); crawl_id = o div 1000 (x 1e5 + block),
             page_no = o % 1000 + 1; source C's category is cto/cta by crawl
             parity.  A block is 150 rows of a source's order in reading
             order, so no page grows with the size of one order.
* o even   -> structured data (B: embedded JSON, C: JSON-LD); odd -> cards.
             Source A always has cards.
* o % 101 = 7  -> bot-check page (no cards); o % 103 = 11 -> cards plus the
             out-of-area banner; o % 107 = 13 -> fetch failed (status 503);
             o % 109 = 17 -> a page of cards holds a link that cannot be
             resolved, so parsing it fails; o % 7 = 3 -> no fetch time.
* k % 11 = 0 -> the card has neither link nor title.
* k % 5 = 1  -> relative link (resolved against the site).
* k % 7 = 0  -> source A card nested in another card.

The variants of fields per ``k`` are listed with each renderer below; the
oracle in ``lotwise.plans.catalog`` states the expected values per variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scalars import utc_stamp
from lotwise.schema import SOURCE_A, SOURCE_B, SOURCE_C
from lotwise.sources.derived import ORDER, URL_BASE, line_seq, text_of

PAGE_ROWS = 150


def esc(c: Column) -> Column:
    """HTML-escape text (&, <, >, ")."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _opt(cond: Column, c: Column) -> Column:
    return F.when(cond, c).otherwise(F.lit(""))



def _k():
    return F.col("l_partkey")

def _o():
    return F.col("l_orderkey")

def _guard():
    return _k() % 11 == 0

def _rel():
    return _k() % 5 == 1

def _href_abs():
    return F.col("raw_url")

def _href_rel():
    return F.regexp_replace(F.col("raw_url"), "^https://www\\.example\\.com", "")

def _href():
    return F.when(_rel(), _href_rel()).otherwise(_href_abs())

def _price_n():
    return F.floor("l_extendedprice").cast("bigint")

def _miles_n():
    return F.floor(F.col("l_quantity") * 4000).cast("bigint")

def _has_loc():
    return F.col("location").isNotNull()

def _year():
    return F.substring("title", 1, 4)

def _name():
    return F.substring("title", 6, 1 << 20)


def card_a() -> Column:
    # k even: title in the link; k odd: title in <h2> with the year in <b>
    # (pieces join with no separator), link found by its href.
    link = F.when(_k() % 2 == 0, _s('<a class="vehicle-card-link" href="', esc(_href()), '">', esc(F.col("title")), "</a>")) \
        .otherwise(_s("<h2><b>", _year(), "</b> ", esc(_name()), '</h2><a href="', esc(_href()), '">details</a>'))
    price = F.when(_k() % 3 == 0, _s('<div data-test="vehicleCardPricingBlockPrice">', F.col("price_text"), "</div>")) \
        .otherwise(_s('<span class="primary-price">', F.col("price_text"), "</span>"))
    body = _s(
        _opt(~_guard(), link), price,
        '<div class="mileage">', F.col("mileage_text"), "</div>",
        '<div class="dealer-name">', esc(F.col("dealer")), "</div>",
        _opt(_has_loc(), _s('<div class="vehicle-card-location">', esc(F.col("location")), "</div>")),
    )
    card = _s('<div class="vehicle-card">', body, "</div>")
    return F.when(_k() % 7 == 0, _s('<div class="vehicle-card">', card, "</div>")).otherwise(card)


def card_b() -> Column:
    # k % 3: 0 data-test marks, 1 data-cg-ft / itemprop marks, 2 data-listingid with a plain relative link.
    loc = F.col("location")
    v0 = _s('<div data-test="inventory-listing">',
            _opt(~_guard(), _s('<a data-test="listing-link" href="', esc(_href_abs()), '">', esc(F.col("title")), "</a>")),
            '<span data-test="listing-price">', F.col("price_text"), "</span>",
            '<span data-test="mileage">', F.col("mileage_text"), "</span>",
            '<span data-test="dealer-name">', esc(F.col("dealer")), "</span>",
            _opt(_has_loc(), _s('<span data-test="dealer-address">', esc(loc), "</span>")), "</div>")
    v1 = _s('<div data-cg-ft="inventory-listing">',
            _opt(~_guard(), _s('<a itemprop="url" href="', esc(_href_abs()), '">', esc(F.col("title")), "</a>")),
            '<span itemprop="price">', F.col("price_text"), "</span>",
            '<span itemprop="mileage">', F.col("mileage_text"), "</span>",
            '<span itemprop="seller">', esc(F.col("dealer")), "</span>",
            _opt(_has_loc(), _s('<span itemprop="address">', esc(loc), "</span>")), "</div>")
    v2 = _s('<div data-listingid="', _k().cast("string"), '">',
            _opt(~_guard(), _s('<a href="', esc(_href_rel()), '">', esc(F.col("title")), "</a>")),
            '<span data-cg-ft="listing-price">', F.col("price_text"), "</span>",
            '<span data-test="listing-mileage">', F.col("mileage_text"), "</span>",
            '<span data-cg-ft="dealer-name">', esc(F.col("dealer")), "</span>",
            _opt(_has_loc(), _s('<span data-test="listing-location">', esc(loc), "</span>")), "</div>")
    return F.when(_k() % 3 == 0, v0).when(_k() % 3 == 1, v1).otherwise(v2)


def item_b() -> Column:
    # k % 4 picks which alternative keys carry each field; k % 11 = 0 has no
    # title and no link at all (kept: the JSON path has no guard).
    t, d, loc = F.col("title"), F.col("dealer"), F.col("location")
    v0 = F.to_json(F.struct(t.alias("title"), _price_n().alias("price"), F.col("mileage_text").alias("mileage"),
                            F.struct(d.alias("name"), loc.alias("address")).alias("dealer"), _href_abs().alias("url")))
    v1 = F.to_json(F.struct(t.alias("name"), F.lit(0).alias("price"), F.col("price_text").alias("listingPrice"),
                            F.col("mileage_text").alias("mileageString"), d.alias("dealerName"),
                            loc.alias("dealerLocation"), _href_abs().alias("canonicalUrl")))
    v2 = F.to_json(F.struct(t.alias("header"), F.col("price_text").alias("priceString"), _miles_n().alias("mileage"),
                            d.alias("sellerName"), loc.alias("location"), _href_rel().alias("detailUrl")))
    v3 = F.to_json(F.struct(t.alias("heading"), (_price_n() + F.lit(0.5)).alias("price"), _miles_n().alias("mileage"),
                            F.struct(d.alias("name"), loc.alias("location")).alias("dealer"), _href_abs().alias("link")))
    g = F.to_json(F.struct(_price_n().alias("price"), _miles_n().alias("mileage"), d.alias("dealerName")))
    return F.when(_guard(), g).when(_k() % 4 == 0, v0).when(_k() % 4 == 1, v1).when(_k() % 4 == 2, v2).otherwise(v3)


def item_c() -> Column:
    # k % 3: 0 name/url/offers.price text with cents/areaServed.addressLocality;
    # 1 name/url/item price/address text; 2 headline/@id/offers.price/areaServed.name.
    t, loc = F.col("title"), F.col("location")
    v0 = F.to_json(F.struct(t.alias("name"), _href().alias("url"),
                            F.struct(F.concat(_price_n().cast("string"), F.lit(".00")).alias("price")).alias("offers"),
                            F.struct(loc.alias("addressLocality")).alias("areaServed")))
    v1 = F.to_json(F.struct(t.alias("name"), _href().alias("url"), _price_n().alias("price"), loc.alias("address")))
    v2 = F.to_json(F.struct(t.alias("headline"), _href().alias("@id"), F.struct(_price_n().alias("price")).alias("offers"),
                            F.struct(loc.alias("name")).alias("areaServed")))
    g = F.to_json(F.struct(F.struct(_price_n().alias("price")).alias("offers")))
    item = F.when(_guard(), g).when(_k() % 3 == 0, v0).when(_k() % 3 == 1, v1).otherwise(v2)
    return F.concat(F.lit('{"@type":"ListItem","item":'), item, F.lit("}"))


def card_c() -> Column:
    loc = F.col("location")
    v0 = _s('<li class="result-row">',
            _opt(~_guard(), _s('<a class="result-title" href="', esc(_href()), '">', esc(F.col("title")), "</a>")),
            '<span class="result-price">', F.col("price_text"), "</span>",
            _opt(_has_loc(), _s('<span class="result-hood"> (', esc(loc), ")</span>")), "</li>")
    v1 = _s('<li class="cl-search-result">',
            _opt(~_guard(), _s('<a class="hdrlnk" href="', esc(_href()), '">', esc(F.col("title")), "</a>")),
            '<span class="price">', F.col("price_text"), "</span>",
            _opt(_has_loc(), _s('<span class="nearby">(', esc(loc), ")</span>")), "</li>")
    return F.when(_k() % 2 == 0, v0).otherwise(v1)


def placed(lines: DataFrame) -> DataFrame:
    """Lines with their place (from 0) among those of their source and order.  Numbered by a
    streaming window; nothing of an order is collected here.  Lines are dealt out as they are in the
    tables: their texts, several times as long, are made where they arrive."""
    order = [{"seq": line_seq(), "first_seen": utc_stamp("l_shipdate")}.get(c, F.col(c)) for c in ORDER]
    number = F.row_number().over(Window.partitionBy("source", "l_orderkey").orderBy(*order))
    # Told how many, as few bytes of lines become much work: small neighbours are not to be merged.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "source", "l_orderkey").withColumn("place", number - 1)


def page_keys() -> list[Column]:
    number = F.col("place")
    crawl = (_o().cast("bigint") / 1000).cast("bigint") * 100000 + F.floor(number / PAGE_ROWS)
    return [
        crawl.alias("crawl_id"),
        ((_o() % 1000) + 1).cast("int").alias("page_no"),
        F.when(F.col("source") == SOURCE_C,
               F.when((_o() / 1000).cast("bigint") % 2 == 0, F.lit("cto")).otherwise(F.lit("cta")))
        .otherwise(F.lit("")).alias("category"),
    ]


def refetched(o: Column) -> Column:
    """Bot-check pages that were fetched a second time, with success."""
    return (o % 202 == 7) & (o % 109 != 17)


def render_pages(lines: DataFrame, second_fetch: bool = False) -> DataFrame:
    """Derived lines -> ``PAGES`` (source, category, crawl_id,
    page_no, url, status, fetched_at, html).  With ``second_fetch`` only the pages that
    were fetched again, as they came the second time."""
    if second_fetch:
        lines = lines.where(refetched(_o()))
    text = text_of(placed(lines))
    structured = _o() % 2 == 0
    piece = (F.when(F.col("source") == SOURCE_A, card_a())
             .when(F.col("source") == SOURCE_B, F.when(structured, item_b()).otherwise(card_b()))
             .otherwise(F.when(structured, item_c()).otherwise(card_c())))
    rows = text.select("source", "l_orderkey", *page_keys(), "first_seen", structured.alias("structured"),
                       F.struct(*[F.col(c) for c in ORDER], piece.alias("piece")).alias("p"))
    pages = rows.groupBy("source", "l_orderkey", "crawl_id", "page_no", "category", "structured").agg(
        F.array_sort(F.collect_list("p")).alias("ps"), 
        F.when(F.col("l_orderkey") % 7 != 3, F.min("first_seen")).alias("fetched_at"))
    # Stage 1: the joined pieces, once per page (later stages refer to them
    # by name, so they are not rebuilt per use).
    as_cards = (F.col("source") == SOURCE_A) | ~F.col("structured")
    pieces = F.transform("ps", lambda x: x["piece"])
    joined = F.when(as_cards, F.array_join(pieces, "")).otherwise(F.array_join(pieces, ","))
    staged = pages.select("source", "l_orderkey", "crawl_id", "page_no", "category", "structured", "fetched_at",
                          joined.alias("joined"), F.size("ps").alias("n"))
    o = F.col("l_orderkey")
    src, structured, joined = F.col("source"), F.col("structured"), F.col("joined")
    listing_doc = _s('{"meta":{"page":', F.col("page_no").cast("string"), ',"tags":["used"]},"empty":[],',
                     '"search":{"facets":[{"facet":"make","count":', F.col("n").cast("string"), '}],',
                     '"results":{"listings":[', joined, "]}}}")
    b_json = F.concat(F.when(o % 4 == 0, F.lit("<script>window.__DATA__ = ")).otherwise(
        F.lit('<script type="application/json">')), listing_doc,
        F.when(o % 4 == 0, F.lit(";</script>")).otherwise(F.lit("</script>")))
    c_jsonld = _s('<script type="application/ld+json" id="ld_searchpage_results">',
                  '{"@context":"https://schema.org","@type":"ItemList","itemListElement":["ad",', joined, "]}</script>")
    head_extra = (F.when((src == SOURCE_B) & structured, _s("<script>var t = 1;</script><script>{bad json</script>", b_json))
                  .when((src == SOURCE_C) & structured, c_jsonld).otherwise(F.lit("")))
    broken = (F.when(src == SOURCE_A, F.lit('<div class="vehicle-card"><a class="vehicle-card-link" href="http://[">x</a></div>'))
              .when(src == SOURCE_B, F.lit('<div data-listingid="0"><a href="http://[">x</a></div>'))
              .otherwise(F.lit('<li class="result-row"><a class="result-title" href="http://[">x</a></li>')))
    cards = F.when((src != SOURCE_A) & structured, F.lit("")).otherwise(F.concat(joined, _opt(o % 109 == 17, broken)))
    body = F.when(src == SOURCE_C, _s('<ul class="rows">', cards, "</ul>")).otherwise(
        _s('<div class="results">', cards, "</div>"))
    banner = _opt(o % 103 == 11, F.lit('<div class="notice">We found partial matches outside your search area.</div>'))
    normal = _s("<!DOCTYPE html><html><head><title>Results</title>", head_extra, "</head><body><!-- results -->",
                banner, body, "</body></html>")
    challenge = F.lit("<html><head><title>Just a moment...</title></head>"
                      "<body><p>Checking your browser before accessing the site.</p></body></html>")
    status = F.when(o % 107 == 13, F.lit(503)).otherwise(F.lit(200))
    html = F.when(status != 200, F.lit(None).cast("string")).when(
        F.lit(False) if second_fetch else o % 101 == 7, challenge).otherwise(normal)
    url = (F.when(src == SOURCE_A, _s("https://www.cars.com/shopping/results/?page=", F.col("page_no").cast("string")))
           .when(src == SOURCE_B, _s("https://www.cargurus.com/Cars/inventorylisting/"
                                     "viewDetailsFilterViewInventoryListing.action?page=",
                                     F.col("page_no").cast("string")))
           .otherwise(_s("https://philadelphia.craigslist.org/search/", F.col("category"), "?s=",
                         ((F.col("page_no") - 1) * 120).cast("string"))))
    return staged.select("source", "category", "crawl_id", "page_no", url.alias("url"),
                         status.cast("int").alias("status"), "fetched_at", html.alias("html"))


__all__ = ["render_pages", "refetched", "URL_BASE"]
