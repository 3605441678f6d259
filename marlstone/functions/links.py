"""Links of pages: the hrefs in their html, resolved against the page's own address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import Value, _c

#: Endings of attachments by kind.
KINDS = {"SPREADSHEET": r"\.(?:xls|xlsx)$", "PDF": r"\.pdf$", "ARCHIVE": r"\.zip$"}


def hrefs(html: Value) -> Column:
    """The double-quoted hrefs of a page's anchors, in their order, character references for & decoded; none for a null page."""
    found = F.regexp_extract_all(_c(html), F.lit(r"""<a\s[^>]*?href="([^"]*)\""""), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def resolved(href: Value, page: Value) -> Column:
    """An href against its page's address, without query and fragment; empty where it names no page of the web.

    One step up and any steps that stay are taken out of the path.
    """
    h, own = _c(href), F.regexp_replace(_c(page), "[#?].*$", "")
    origin, scheme = F.regexp_extract(own, "^(https?://[^/]+)", 1), F.regexp_extract(own, "^(https?:)", 1)
    folder = F.concat(origin, F.lit("/"), F.regexp_extract(F.regexp_replace(own, "^https?://[^/]+", ""), "^/(.*/)", 1))
    url = (
        F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(origin, h))
        .when((h == "") | h.rlike("^[#?]"), own).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "").otherwise(F.concat(folder, h)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[#?].*$", ""), r"/[^/]+/\.\./", "/"), r"/(?:\./)+", "/")


def kind(url: Value, page: Value) -> Column:
    """What a resolved link is: NOT_A_PAGE, FOREIGN (another host), INSECURE, an attachment's kind, SELF or PAGE."""
    u, host = _c(url), lambda x: F.lower(F.regexp_extract(x, "^https?://([^/?#]+)", 1))
    found = F.when(u == "", "NOT_A_PAGE").when(host(u) != host(_c(page)), "FOREIGN").when(~u.startswith("https://"), "INSECURE")
    for name, ending in KINDS.items():
        found = found.when(F.lower(u).rlike(ending), name)
    return found.when(u == F.regexp_replace(_c(page), "[#?].*$", ""), "SELF").otherwise("PAGE")
