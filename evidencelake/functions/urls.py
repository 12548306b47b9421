"""URL keys as column expressions. Each rule has a place of its own; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INTERACTIVE_PATH, INTERACTIVE_QUERY, TRACKING_PARAMS

#: scheme, authority, path, query, fragment, for any text (java.net.URI is too strict for archived URLs).
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
PARTS_ALL = r"(?s)" + PARTS


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS_ALL, k)


def _text(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit("")))


def _encode(x: Column) -> Column:
    """Form encoding: keeps ~ and encodes *."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def canonical_url(url: Column) -> Column:
    """The key of results and evidence: lower scheme and host, no parameters, fragment or tracking, sorted query."""
    raw = _text(url)
    full = F.when(raw.startswith("http://") | raw.startswith("https://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    path = F.regexp_replace(_part(full, 3), r";[^/]*$", "")
    path = F.when(path == "", "/").when(path == "/", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    fields = F.filter(F.split(_part(full, 4), "&"), lambda p: p != "")
    pairs = F.transform(fields, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    key = lambda p: F.lower(F.trim(p["k"]))
    kept = F.filter(pairs, lambda p: ~(key(p).startswith("utm_") | key(p).isin(*TRACKING_PARAMS)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    built = F.concat(F.lower(_part(full, 1)), F.lit("://"), F.lower(_part(full, 2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw == "", "").otherwise(built)


def conversation_url_key(url: Column) -> Column:
    """The key of capsules: query and tracking stay as they are."""
    raw = _text(url)
    whole = (_part(raw, 1) != "") & (_part(raw, 2) != "")
    query = F.when(_part(raw, 4) == "", "").otherwise(F.concat(F.lit("?"), _part(raw, 4)))
    built = F.concat(F.lower(_part(raw, 1)), F.lit("://"), F.lower(_part(raw, 2)), F.regexp_replace(_part(raw, 3), "/+$", ""), query)
    return F.when(whole, built).otherwise(F.regexp_replace(raw, "/+$", ""))


def url_domain(url: Column) -> Column:
    """Lower-case authority without a leading ``www.``; a port stays."""
    return F.regexp_replace(F.trim(F.lower(_part(F.coalesce(url, F.lit("")), 2))), r"^www\.", "")


def url_host(url: Column) -> Column:
    """Lower-case authority up to the first colon."""
    return F.substring_index(F.lower(_part(F.coalesce(url, F.lit("")), 2)), ":", 1)


def _path_without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(F.filter(parts, lambda x: x != "."), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def resolve_url(base: Column, reference: Column) -> Column:
    """The URL that a reference on the page ``base`` means: paths are merged and . and .. taken out; a query or fragment alone keeps the page's path. References of another scheme, or with a host, keep their path; an empty one is the page."""
    ref = F.regexp_replace(F.regexp_replace(F.coalesce(reference, F.lit("")), r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = lambda u: F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = lambda u: F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    own, other = rest(_text(base)), rest(ref)
    mark = lambda m, x: F.when(x == "", "").otherwise(F.concat(F.lit(m), x))
    path, own_path = _part(other, 3), _part(own, 3)
    folder = F.when(own_path.contains("/"), F.regexp_replace(own_path, "[^/]*$", "")).otherwise("/")
    merged = F.when(path == "", own_path).otherwise(_path_without_dots(F.when(path.startswith("/"), path).otherwise(F.regexp_replace(F.concat(folder, path), "/{2,}", "/"))))
    query = F.when((path == "") & (_part(other, 4) == ""), _part(own, 4)).otherwise(_part(other, 4))
    host = other.startswith("//") & (_part(other, 2) != "")
    slash = lambda x: F.when((x != "") & ~x.startswith("/"), F.concat(F.lit("/"), x)).otherwise(x)
    built = F.concat(
        scheme(_text(base)), F.lit("://"), F.when(host, _part(other, 2)).otherwise(_part(own, 2)), slash(F.when(host, path).otherwise(merged)),
        mark("?", F.when(host, _part(other, 4)).otherwise(query)), mark("#", _part(other, 5)),
    )
    return F.when(ref == "", _text(base)).when((scheme(ref) != "") & (scheme(ref) != scheme(_text(base))), ref).otherwise(built)


def request_url(url: Column) -> Column:
    """What to fetch: the URL as it came if it is http(s) with a host (signed queries must survive), else the key."""
    raw = _text(url)
    fit = F.lower(_part(raw, 1)).isin("http", "https") & (_part(raw, 2) != "")
    return F.when(fit, raw).otherwise(canonical_url(raw))


def url_risk(url: Column) -> Column:
    """Why a URL must not be fetched, judged by its text alone; null if nothing is wrong with it."""
    raw = _text(url)
    authority = _part(raw, 2)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":\d*$", ""), r"\.$", "")
    octet = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    inside = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    six = host.rlike(r"^\[(::1?|f[cde].*|fe[89ab].*|::ffff:.*)\]$")
    return (
        F.when(~F.lower(_part(raw, 1)).isin("http", "https"), "scheme")
        .when(host == "", "no_host")
        .when(authority.contains("@"), "user_info")
        .when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"), "local_name")
        .when(F.coalesce(inside, F.lit(False)) | six, "private_address")
    )


def is_interactive_url(url: Column) -> Column:
    """Paths or queries of forums and comment pages; never a PDF."""
    path, query = F.lower(_part(F.coalesce(url, F.lit("")), 3)), F.lower(_part(F.coalesce(url, F.lit("")), 4))
    return ~path.endswith(".pdf") & (path.rlike(f"(?i){INTERACTIVE_PATH}") | query.rlike(f"(?i){INTERACTIVE_QUERY}"))


def is_thread_url(url: Column) -> Column:
    """Pages of one discussion thread on the forum whose listings are archived as JSON."""
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://(?:www\.|old\.|new\.)?reddit\.com/r/[^/]+/comments/[^/]+")


def thread_key(url: Column) -> Column:
    """The archive key of a thread: without query and fragment, ``.json`` once at the end."""
    bare = F.regexp_replace(_text(url), r"[?#].*$", "")
    return F.when(bare.endswith(".json"), bare).otherwise(F.concat(F.regexp_replace(bare, "/+$", ""), F.lit(".json")))


def quoted(text: Column, safe: str) -> Column:
    """The text with all characters but ASCII letters, digits and ``safe`` ones percent-encoded; texts without such are not taken apart."""
    plain = "[A-Za-z0-9" + "".join("\\" + c for c in safe) + "]"
    one = lambda c: F.when(c.rlike(f"^{plain}$"), c).when(c == " ", "%20").when(c == "*", "%2A").otherwise(F.url_encode(c))
    return F.when(text.rlike(f"^{plain}*$"), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), ""))


def citation_id(url: Column) -> Column:
    """``//host/path?query#fragment`` of an http(s) URL with a host, percent-encoded where a character would break the mark; else the URL, encoded."""
    part = lambda k, mark: F.when(_part(url, k) == "", "").otherwise(F.concat(F.lit(mark), quoted(_part(url, k), "=&%/?+;,._~-")))
    path = F.when(_part(url, 3) == "", "/").otherwise(quoted(_part(url, 3), "/%._~-"))
    built = F.concat(F.lit("//"), quoted(_part(url, 2), "[]@%._~-"), path, part(4, "?"), part(5, "#"))
    return F.when(F.lower(_part(url, 1)).isin("http", "https") & (_part(url, 2) != ""), built).otherwise(quoted(url, "/%?&=+;,._~-"))
