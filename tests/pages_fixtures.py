"""Pages made up for the tests: only class names, attributes and keys are those of the sites."""


def page(body: str, head: str = "") -> str:
    return f"<!doctype html><html><head><meta charset=utf-8>{head}</head><body><main>{body}</main></body></html>"


def card_a(title, price, miles, seller, place, link) -> str:
    return (f'<article class="vehicle-card wide"><h2>{title}</h2><a href="{link}">see it</a>'
            f'<b class="primary-price">{price}</b><i class="mileage">{miles}</i>'
            f'<p class="dealer-name"> {seller} </p><p class="vehicle-card-location"><u>{place}</u></p></article>')


def card_b(title, price, miles, seller, place, link) -> str:
    return (f'<section data-cg-ft="inventory-listing"><a itemprop="url" href="{link}">{title}</a><em itemprop="price">{price}</em>'
            f'<em data-test="listing-mileage">{miles}</em><em itemprop="seller">{seller}</em>'
            f'<em itemprop="address">{place}</em></section>')


def row_c(title, price, place, link) -> str:
    return (f'<li class="cl-search-result"><a class="hdrlnk" href="{link}">{title}</a><span class="price">{price}</span>'
            f'<span class="nearby"> ({place}) </span></li>')


A_VAN = page(card_a("1997 Harbour Van", "$1,250 firm", "231,007 mi.", "Quayside Motors", "Anchor Bay", "/vehicledetail/van-7?ref=9#x"))
A_TWO = page(card_a("1997 Harbour Van", "$1,250", "231,007", "Quayside", "Anchor Bay", "/vehicledetail/van-7?a")
             + card_a("1997 Harbour Van again", "$1", "1", "Q", "A", "/vehicledetail/van-7?b")
             + card_a("2016 Moss Hatch", "ask", "", "", "", "https://elsewhere.example/vehicledetail/m"))
A_NESTED = page('<div class="vehicle-card"><div class="vehicle-card"><a class="vehicle-card-link" href="/vehicledetail/nest/">'
                "<b>2003</b> Pebble</a></div></div>")
B_CARDS = page(card_b("2006 Tundra Box", "$7,300", "98,400 mi", "North Lot", "Pine, ME", "/Cars/box?x=1")
               + card_b("1999 Ember", "$2,150", "171,000 mi", "South Lot", "Oak, ME", "/Cars/ember"))
C_ROWS = page("<ul>" + row_c("2013 Lark Wagon", "$5,400", "Elm Hill", "/cto/lark.html?s=1")
              + row_c("2002 Finch", "$1,900", "Low Ford", "https://philadelphia.craigslist.org/cto/finch.html") + "</ul>")
C_MORE = page("<ul>" + row_c("2018 Heron", "$9,100", "Mill", "/cto/heron.html") + "</ul>")


def script(text: str, attributes: str = "") -> str:
    return page("", f"<script {attributes}>{text}</script>")


B_ASSIGNED = script('window.state = {"view":{"rows":[{"heading":"2014 Comet","price":6150,"mileage":"77,310 miles",'
                    '"dealer":{"name":"Orbit","location":"Apogee, NV"},"link":"/Cars/comet?i=3"}]},"n":[{"k":1}]};')
B_ZERO = script('{"list":[{"name":"2008 Gnat","price":0,"priceString":"$2,750","detailUrl":"/g"}]}')
B_HALF = script('{"list":[{"name":"2008 Gnat","price":2750.5,"url":"https://gnat.example/a?b"}]}')
B_BROKEN = page(card_b("2011 Reed", "$4,480", "1", "", "", "/Cars/reed"), "<script>{oops</script><script>var a = [1];</script>")

LD = 'type="application/ld+json"'
C_LINKED = script('{"itemListElement":["x",{"item":{"name":"2012 Otter","url":"/cto/otter.html?q","offers":{"price":"3100.00"},'
                  '"areaServed":{"name":"","addressLocality":"Weir"}}},{"item":{"headline":"again","@id":"/cto/otter.html"}},'
                  '{"item":{}},{"headline":"2001 Stoat","price":880,"address":"Ridge"}]}', f'{LD} id="ld_searchpage_results"')
C_LINKED_LIST = page("<ul>" + row_c("1994 Wren", "$640", "Tarn", "/cto/wren.html") + "</ul>",
                     f'<script {LD}>[{{"name":"not a list of listings"}}]</script>')

BANNER = page('<p>We found partial matches.</p>' + card_a("2005 Drift", "$2", "2", "d", "p", "/vehicledetail/drift"))
CHALLENGE = "<html><head><title>Just a moment...</title></head><body>Checking your browser</body></html>"
#: A link that cannot be resolved: parsing the page fails.
BROKEN_LINK = page(card_a("2000 Snag", "$3", "3", "d", "p", "/vehicledetail/snag")
                   + '<div class="vehicle-card"><a class="vehicle-card-link" href="http://[">x</a></div>')
EMPTY = "<html></html>"
