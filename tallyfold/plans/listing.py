"""Templates of listing and place pages, and pages made up from customers to run them on."""

from __future__ import annotations

PLACE = "https://www.google.com/maps/place/"
_STARS = ".//span[@role='img' and contains(@aria-label, 'stars')]"
_DOT = ".//div[.//span[@aria-hidden='true' and text()='·']]"
_TYPE = "not(@aria-hidden='true') and not(span[@aria-hidden='true']) and not(contains(text(), 'Closed')) and not(contains(text(), 'Open')) and not(starts-with(text(), '('))"


def _field(name, xpath, regex="", required=False, **more):
    return {"label": name, "target_field": name, "xpath": xpath, "regex": regex, "required": required, **more}


def _first(name, xpath, regex="", required=False):
    """A field of a list: the first that its path finds."""
    return _field(name, xpath, regex, required, first=True)


# Where a listing's blocks and their values stand.
LISTING = {
    "fast": {
        "block_xpath": f"//div[@role='feed']//a[starts-with(@href, '{PLACE}')]/parent::div",
        "fields": [
            _first("name", ".//div[contains(@class, 'fontHeadlineSmall')]/text()"),
            _first("url", f".//a[starts-with(@href, '{PLACE}')]/@href", required=True),
            _first("rating", f"{_STARS}/span[1]/text()"),
            _first("reviews", f"{_STARS}//span[contains(text(), '(')]/text()", r"^[()]*(.*?)[()]*$"),
            _first("business_type", f"{_DOT}[1]//span[{_TYPE}][1]/span/text()"),
            _first("address", f"{_DOT}//span[preceding-sibling::span[@aria-hidden='true' and text()='·'] and not(.//a[@href])]/text()"),
            _first("hours", f"{_DOT}//span[contains(text(), 'Open') or contains(text(), 'Closed')]/text()"),
            _first("phone", f"{_DOT}//span[starts-with(text(), '(') and contains(text(), ')') and contains(text(), '-') and string-length(normalize-space(text())) >= 10]/text()"),
            _first("site", ".//a[@data-value='Website']/@href", r"^([a-z]+://[^/?#]+)"),
            _first("sponsored", ".//h1[.//span[text()='Sponsored']]//span[text()='Sponsored']/text()"),
        ],
    }
}
# Where a place page's values stand.
DETAIL = [
    _field("name", "(//h1)[1]"),
    *(_field(name, f"(//*[@data-item-id='{item}'])[1]") for name, item in (("address", "address"), ("located_in", "locatedin"), ("plus_code", "oloc"))),
    _field("phone", "(//button[starts-with(@data-item-id, 'phone:')])[1]"),
    _field("site", "(//a[@data-item-id='authority'])[1]/@href", r"^([a-z]+://[^/?#]+)"),
    _field("booking_link", "(//a[starts-with(@data-item-id, 'action:')])[1]/@href"),
    _field("rating", "(//span[@role='img' and contains(@aria-label, 'stars')])[1]/@aria-label", r"([0-9]+(?:\.[0-9]+)?)"),
    _field("reviews", "//*[self::button or self::a or self::span or self::div][contains(translate(@aria-label, 'REVIW', 'reviw'), 'review')]/@aria-label", r"([0-9][0-9,.]*)"),
    _field("category", "(//button[contains(@jsaction, 'category')])[1]"),
    _field("hours", "(//div[contains(@jsaction, 'openhours')])[1]"),
    _field("hours_detail", "//table[contains(@class, 'eK4R0e')]//tr[count(td) >= 2]"),
]


#: Listing pages of up to ten blocks, and place pages, from customers.
LISTING_PAGES = f"""SELECT page_id, 'https://maps.example.net/list' AS url, concat('<div role="feed">', array_join(transform(sort_array(collect_list(struct(c, block))), b -> b.block), ''), '</div>') AS html FROM (
  SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, c_custkey AS c, concat('<div><a href="{PLACE}', c_custkey, '/"></a><div class="x fontHeadlineSmall">Shop ', c_custkey, '</div><span role="img" aria-label="4.5 stars"><span>4.', c_custkey % 10,
    '</span><span>(', c_custkey, ')</span></span><div><span><span>', lower(c_mktsegment), '</span></span><span aria-hidden="true">·</span><span>', c_custkey % 13, ' Main St</span><span> Open until 5 </span><span>(555) 000-', 1000 + c_custkey % 9000, '</span></div>',
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('<a data-value="Website" href="https://shop', c_custkey, '.com/a?b=1">site</a>') END, '</div>') AS block FROM customer) b GROUP BY page_id"""
PLACE_PAGES = f"""SELECT c_custkey AS page_id, concat('{PLACE}', c_custkey) AS url, concat('<h1>Shop ', c_custkey, ' &amp; Sons</h1><button data-item-id="address"> ', c_custkey % 13, '  Main St</button><button data-item-id="phone:tel:1">+1 555 ', c_custkey % 17,
  '</button><a data-item-id="authority" href="https://shop', c_custkey, '.com/x">w</a><span role="img" aria-label="4.', c_custkey % 10, ' stars"></span><button aria-label="', c_custkey, ' reviews"></button><button jsaction="pane.rating.category">',
  c_mktsegment, '</button><table class="eK4R0e"><tr><td>Mon:</td><td>', c_custkey % 9, '-18</td></tr><tr><td>alone</td></tr></table>') AS html FROM customer WHERE c_custkey % 2 = 0"""
