"""Normal forms of addresses and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


# Query parameters that only say where a reader came from.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, fragment, tracking parameters and a slash at the end; host in lower
    case, with its port; other query parameters in order."""
    bare = F.regexp_replace(url, r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    port = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?:]*(:[0-9]+)", 1)
    path = F.regexp_replace(F.substring_index(rest, "?", 1), r"/+$", "")
    given = F.when(F.instr(rest, "?") > 0, F.split(F.regexp_replace(rest, r"^[^?]*[?]", ""), "&")).otherwise(F.array().cast("array<string>"))
    kept = F.array_join(F.array_sort(F.filter(given, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), port, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def normal_title(title: Column) -> Column:
    """Lower case A-Z, other than letters, digits and non-ASCII characters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
