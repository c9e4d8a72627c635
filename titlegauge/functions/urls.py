"""URL normalisation as one native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose links never identify shared content, tracking parameters.
SKIP_HOSTS = [
    "i.redd.it", "v.redd.it", "reddit.com", "www.reddit.com", "redd.it", "old.reddit.com",
]
TRACKING_PARAMS = [
    "si", "feature", "t", "start_radio", "ref", "ref_src", "ref_url", "fbclid", "gclid",
    "share", "app", "smid", "partner", "sns", "spm", "source", "cmpid", "ncid",
]
TRACKING_PREFIX = "utm"

# scheme? // host  path  ?query  (fragment ignored)
_URL_PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    """Lower-cased host with port, without a leading ``www.``; null when there is none."""
    host = F.regexp_replace(
        F.lower(F.regexp_extract(F.trim(url), _URL_PARTS, 1)), r"^www\.", ""
    )
    return F.when(host != "", host)


def _decode(text: Column) -> Column:
    # A percent sign without two hex digits stays as text.
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), text)


def _encode(text: Column) -> Column:
    java = F.url_encode(text)
    return F.replace(F.replace(java, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _clean_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda part: part.rlike("^[^=]*=.+$")),
        lambda part: F.struct(
            _decode(F.substring_index(part, "=", 1)).alias("k"),
            _decode(F.regexp_replace(part, "^[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS)
        & ~F.lower(p["k"]).startswith(TRACKING_PREFIX),
    )
    encoded = F.transform(
        F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
    )
    return F.array_join(encoded, "&")


def norm_url(url: Column) -> Column:
    """host + path + sorted query without trackers; null for skipped hosts or no host."""
    text = F.trim(url)
    host = url_host(url)
    path = F.regexp_replace(F.regexp_extract(text, _URL_PARTS, 2), "/+$", "")
    query = _clean_query(F.regexp_extract(text, _URL_PARTS, 3))
    base = F.concat(host, path)
    return F.when(
        ~host.isin(SKIP_HOSTS),
        F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base),
    )
