"""URL functions as Column expressions over regular expressions, the same in any engine that has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import ascii_lower

#: Query parameters whose values are credentials (fixed values).
CREDENTIALS = ["token", "sig", "signature", "key", "auth", "apikey", "access_token", "api_key", "sid", "password", "passwd", "pwd", "secret", "client_secret", "bearer", "jwt", "session", "sessionid"]
REDACTED = "…redacted…"
LOOPBACK = "^(localhost|127(\\.[0-9]{1,3}){3}|\\[?::1\\]?|.*\\.localhost|.*\\.local)$"
PRIVATE_V4 = "^(10\\..*|127\\..*|0\\..*|169\\.254\\..*|192\\.168\\..*|172\\.(1[6-9]|2[0-9]|3[01])\\..*|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\..*)$"


def scheme(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host and port, lower-cased, without user information."""
    return ascii_lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), ":[0-9]*$", "")


def origin(url: Column) -> Column:
    """Scheme, host and port if it isn't the scheme's own; empty for other schemes than http and https."""
    s, a = scheme(url), authority(url)
    bare = F.when(s == "http", F.regexp_replace(a, ":(80)?$", "")).otherwise(F.regexp_replace(a, ":(443)?$", ""))
    return F.when(s.isin("http", "https") & (a != ""), F.concat(s, F.lit("://"), bare)).otherwise("")


def path(url: Column) -> Column:
    """The path of an absolute or relative URL; the empty path of an absolute one is a slash."""
    rest = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.when((rest == "") & url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "/").otherwise(rest)


def query(url: Column) -> Column:
    """The query with its question mark, or empty."""
    return F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1)


def path_query(url: Column) -> Column:
    return F.concat(path(url), query(url))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def resolve(href: Column, base: Column) -> Column:
    """Absolute and root-relative references against a base; others below the base's directory."""

    def below(b):
        home = F.concat(b["scheme"], F.lit("://"), b["host"])
        return F.when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href)).when(href.startswith("/"), F.concat(home, href)).when(href.startswith("?"), F.concat(home, path(base), href)).otherwise(F.concat(home, page_dir(base), href))

    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).otherwise(let(F.struct(scheme(base).alias("scheme"), authority(base).alias("host")), below))


def norm_href(href: Column, page: Column) -> Column:
    """Path and query on the page's own host, else the absolute URL; fragments go; empty and fragment-only stay."""
    h = F.trim(href)
    inside = lambda whole: F.when((h == "") | h.startswith("#"), h).when(host(whole) == host(page), path_query(whole)).otherwise(whole)
    return let(without_fragment(resolve(h, page)), inside)


def norm_href_cross_origin(href: Column, page: Column, other: Column) -> Column:
    """As norm_href, but absolute URLs on either page's origin become path and query."""
    h = F.trim(href)
    either = let(origin(h), lambda own: (own != "") & ((own == origin(page)) | (own == origin(other))))
    return F.when(either, path_query(without_fragment(h))).otherwise(norm_href(href, page))


def _href_sim(a: Column, b: Column, x: Column, y: Column) -> Column:
    known = lambda v: F.when((a == b) | (v["x"] == v["y"]), 1.0).when(path_query(v["x"]) == path_query(v["y"]), 0.9).when(path(v["x"]) == path(v["y"]), 0.7).otherwise(0.0)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(let(F.struct(x.alias("x"), y.alias("y")), known))


def href_sim(a: Column, b: Column, page_a: Column, page_b: Column) -> Column:
    """References compared as they resolve on their own pages: the same, the same path and query, the same path."""
    return _href_sim(a, b, norm_href(a, page_a), norm_href(b, page_b))


def href_sim_cross_origin(a: Column, b: Column, page_a: Column, page_b: Column) -> Column:
    """As href_sim, but links to either page's origin count as links within the page's site."""
    return _href_sim(a, b, norm_href_cross_origin(a, page_a, page_b), norm_href_cross_origin(b, page_b, page_a))


def registrable(host_name: Column) -> Column:
    """The last two labels of a host, or three where the last two are a common public suffix pair."""
    labels = F.split(host_name, "\\.")
    pair = F.get(labels, F.size(labels) - 2).isin("co", "com", "net", "org", "ac", "gov", "edu") & (F.length(F.get(labels, F.size(labels) - 1)) == 2)
    n = F.when(pair, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def probe_reason(url: Column, page: Column) -> Column:
    """Why a capture may not probe a URL: its scheme, a private address, another registrable domain; null if it may."""
    reason = egress_reason(url, page)
    return F.when(reason.isin("scheme", "private"), reason).when(registrable(host(url)) != registrable(host(page)), "external")


def page_dir(url: Column) -> Column:
    return F.regexp_extract(path(url), "^(.*/)", 1)


def request_key(url: Column, page: Column) -> Column:
    """On the page's origin: the path below the page's directory, with the query; else the URL."""
    own, pq, base = origin(url) == origin(page), path_query(url), page_dir(page)
    return F.when(own & F.startswith(pq, base), F.substring(pq, F.length(base) + 1, F.length(pq))).when(own, pq).otherwise(url)


def id_stable_url(url: Column) -> Column:
    """Without query and fragment; absolute URLs with a lower-case host and a path."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(scheme(url), F.lit("://"), authority(url), path(bare))).otherwise(bare)


def file_name(url: Column) -> Column:
    return F.regexp_extract(path(url), "([^/]*)$", 1)


def normalize_for_compare(url: Column, trailing: str = "never") -> Column:
    """Without fragment and, unless slashes are always wanted, without one at the end of a path other than the root."""
    bare = without_fragment(url)
    if trailing == "always":
        return bare
    return F.when(path(bare) == "/", bare).otherwise(F.regexp_replace(bare, "^([^?]*[^/?])/+(\\?.*)?$", "$1$2"))


def slash_violation(url: Column, policy: str = "never") -> Column:
    p = path(url)
    if policy == "never":
        return (p != "/") & p.endswith("/")
    if policy == "always":
        return (p != "/") & ~p.endswith("/") & ~file_name(url).contains(".")
    return F.lit(False)


def is_loopback(url: Column) -> Column:
    return host(url).rlike(LOOPBACK)


def egress_reason(url: Column, page: Column) -> Column:
    """Why a URL may not be probed: its scheme, a private address, another host and port; null if it may."""
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(host(url).rlike(PRIVATE_V4) | host(url).rlike("^\\[(::1|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*)\\]$"), "private")
        .when(F.regexp_replace(origin(url), "^[a-z]+://", "") != F.regexp_replace(origin(page), "^[a-z]+://", ""), "external")
    )


def redact(url: Column, names: list[str] = CREDENTIALS, mark: str = REDACTED) -> Column:
    """The values of the named parameters give way to the mark."""
    return F.regexp_replace(url, f"(?i)([?&])({'|'.join(names)})=[^&#]*", f"$1$2={mark}")


def has_credential(url: Column, names: list[str] = CREDENTIALS) -> Column:
    """Is there a credential parameter with a value that isn't the mark?"""
    return F.replace(url, F.lit(f"={REDACTED}"), F.lit("=")).rlike(f"(?i)[?&]({'|'.join(names)})=[^&#]")
