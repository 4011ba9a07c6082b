"""URL functions as Columns. Regular expressions instead of parse_url, so that Unicode URLs survive; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Public suffixes of more than one label that are known here; any other last label counts as a suffix of one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.sg", "com.tw", "com.ua", "github.io", "blogspot.com")
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(url: Column | str, i: int) -> Column:
    """Group i of scheme, authority, path, query (with ?), fragment (with #); null if url has no scheme."""
    u = _c(url)
    return F.when(u.rlike(_PARTS), F.regexp_extract(u, _PARTS, i))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it; its code stays small, too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(url: Column | str) -> Column:
    """Scheme, authority, path, query (with ?) and fragment (with #) as a struct; null if url has no scheme. For let()."""
    u = _c(url)
    names = ("scheme", "authority", "path", "query", "fragment")
    return F.when(u.rlike(_PARTS), F.struct(*[F.regexp_extract(u, _PARTS, i).alias(n) for i, n in enumerate(names, 1)]))


def parsed_once(url: Column | str) -> Column:
    """parsed(), with url named once."""
    return let(_c(url), parsed)


def _site(p: Column) -> Column:
    """scheme, authority (both lower case), host and host with port of parsed()."""
    known, at = F.lower(p["scheme"]), F.lower(F.regexp_replace(p["authority"], "^.*@", ""))
    host = F.regexp_replace(at, r":\d*$", "")
    shown = at
    for name, number in DEFAULT_PORTS.items():
        shown = F.when(known == name, F.regexp_replace(at, f":{number}$", "")).otherwise(shown)
    return F.struct(known.alias("scheme"), at.alias("authority"), F.when(host != "", host).alias("host"), shown.alias("shown"))


def _origin(s: Column) -> Column:
    return F.when(s["host"].isNotNull(), F.concat(s["scheme"], F.lit("://"), s["shown"]))


def trimmed(text: Column | str) -> Column:
    """Without white space at the ends, of any kind."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))


def hostname(url: Column | str) -> Column:
    """Lower-case host without user and port; null if there's none."""
    h = F.regexp_replace(authority(url), r":\d*$", "")
    return F.when(h != "", h)


def port(url: Column | str) -> Column:
    p = F.regexp_extract(authority(url), r":(\d+)$", 1)
    return F.when(p != "", p)


def path(url: Column | str) -> Column:
    return part(url, 3)


def query(url: Column | str) -> Column:
    return F.regexp_replace(part(url, 4), r"^\?", "")


def fragment(url: Column | str) -> Column:
    return F.regexp_replace(part(url, 5), "^#", "")


def origin(url: Column | str) -> Column:
    """scheme://host[:port], the scheme's own port left out; null without host."""
    return let(parsed_once(url), lambda p: let(_site(p), _origin))


def host_and_origin(url: Column | str) -> Column:
    """struct(host, origin), the URL looked at once."""
    return let(parsed_once(url), lambda p: let(_site(p), lambda s: F.struct(s["host"].alias("host"), _origin(s).alias("origin"))))


def plain_host(host: Column | str) -> Column:
    """Lower case, one dot at the end removed."""
    return F.regexp_replace(F.lower(_c(host)), r"\.$", "")


def registrable_domain(host: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the public suffix and the suffix; null for addresses and hosts of one label.

    suffixes: those of more labels than one, a list whose size is fixed in code."""
    h = plain_host(host)
    known = "|".join(s.replace(".", r"\.") for s in suffixes)
    longer, plain = F.regexp_extract(h, rf"(?:^|\.)([^.]+\.(?:{known}))$", 1), F.regexp_extract(h, r"(?:^|\.)([^.]+\.[^.]+)$", 1)
    ip = h.rlike(r"^\d+\.\d+\.\d+\.\d+$") | h.contains(":")
    bare = h.rlike(rf"^(?:{known})$")
    return F.when(ip | bare, F.lit(None).cast("string")).when(longer != "", longer).when(plain != "", plain)


def normalize_url(url: Column | str, *, keep_fragment: bool = False, drop_tracking: bool = True) -> Column:
    """Lower-case scheme and host, no slash at the path's end, parameters in order of their names (equal names keep
    theirs), utm_ ones dropped, no fragment unless asked. What isn't a URL stays as it is."""

    def build(p: Column) -> Column:
        q = F.split(F.regexp_replace(p["query"], r"^\?", ""), "&")
        items = F.transform(q, lambda x, i: F.struct(F.regexp_extract(x, "^[^=]*", 0).alias("k"), i.alias("i"), x.alias("v")))
        items = F.filter(items, lambda s: (s["v"] != "") & (~s["k"].startswith("utm_") if drop_tracking else F.lit(True)))
        params = F.array_join(F.transform(F.array_sort(items), lambda s: s["v"]), "&")
        tail = let(params, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(F.lit("")))
        tail = F.concat(tail, p["fragment"]) if keep_fragment else tail
        return let(_site(p), lambda s: F.concat(_origin(s), F.regexp_replace(p["path"], "/$", ""), tail))

    return let(_c(url), lambda u: F.coalesce(let(parsed_once(trimmed(u)), build), u))


def short_hash(text: Column | str, length: int) -> Column:
    """First characters of base64(sha256(text)) without + / =."""
    return F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(_c(text).cast("binary"), 256))), "[+/=]", ""), 1, length)


def payload_hash(payload: Column | str) -> Column:
    return short_hash(F.coalesce(_c(payload), F.lit("")), 8)


def unique_key(url: Column | str, method: Column | None = None, payload: Column | None = None, *, keep_fragment: bool = False, extended: bool = False, always: bool = False) -> Column:
    """The normalised URL; extended: METHOD|payload hash|URL; always: a random prefix, so nothing is a duplicate."""
    key = normalize_url(url, keep_fragment=keep_fragment)
    if extended:
        key = F.concat_ws("|", F.upper(F.coalesce(method if method is not None else F.lit(None).cast("string"), F.lit("GET"))), payload_hash(payload if payload is not None else F.lit("")), key)
    return F.concat(F.expr("uuid()"), F.lit("|"), key) if always else key


def request_id(key: Column | str) -> Column:
    return short_hash(key, 15)


def fnv1a_bucket(key: Column | str, buckets: int) -> Column:
    """32-bit FNV-1a over UTF-16-free code points (characters above FFFF count as one), modulo buckets."""
    codes = F.transform(F.split(_c(key), ""), lambda x: F.when(x == "", F.lit(0)).otherwise(F.ascii(x)).cast("long"))
    h = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.pmod(h, F.lit(buckets))


def _without_dots(p: Column) -> Column:
    """RFC 3986 removal of dot segments; p starts with a slash."""
    segments = F.slice(F.split(p, "/", -1), 2, 1 << 20)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(segments, empty, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    last = F.element_at(segments, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """href as seen from base; null if it can't be resolved."""

    def seen(x: Column) -> Column:
        h, b, s = x["h"], x["b"], x["s"]
        root = F.concat(s["scheme"], F.lit("://"), s["authority"])
        own_path = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
        rest, tail = F.regexp_extract(h, "^[^?#]*", 0), F.regexp_extract(h, "[?#].*$", 0)
        folder = F.regexp_replace(own_path, "[^/]*$", "")
        # One removal of dots for paths of either kind: its code is long.
        led = _without_dots(F.when(h.startswith("/"), rest).otherwise(F.concat(folder, rest)))
        found = (
            F.when(h.startswith("//"), F.concat(s["scheme"], F.lit(":"), h))
            .when(h.startswith("?"), F.concat(root, own_path, h))
            .when(h.startswith("#"), F.concat(root, own_path, b["query"], h))
            .when(h == "", F.concat(root, own_path, b["query"]))
            .otherwise(F.concat(root, led, tail))
        )
        return F.when(s["host"].isNotNull(), found)

    def whole(h: Column) -> Column:
        def build(p: Column) -> Column:
            path_ = F.when(p["path"] == "", F.lit("/")).otherwise(_without_dots(p["path"]))
            return let(_site(p), lambda s: F.concat(_origin(s), path_, p["query"], p["fragment"]))

        return F.when(h.rlike("^(?i)https?:"), let(parsed(h), build)).otherwise(h)

    from_base = lambda h: let(parsed_once(base), lambda b: let(F.struct(h.alias("h"), b.alias("b"), _site(b).alias("s")), seen))
    return let(trimmed(href), lambda h: F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), whole(h)).otherwise(from_base(h)))


def with_search_params(url: Column | str, params: Column) -> Column:
    """Adds params (map of strings, null values count as empty), form-encoded; a name that's there is set anew."""
    u = _c(url)
    names = F.map_keys(params)
    old = F.filter(F.split(query(u), "&"), lambda x: (x != "") & ~F.array_contains(names, F.url_decode(F.regexp_extract(x, "^[^=]*", 0))))
    new = F.transform(F.map_entries(params), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit("")))))
    q = F.array_join(F.concat(old, new), "&")
    return F.concat(F.regexp_extract(u, "^[^?#]*", 0), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")), part(u, 5))


def robots_url(url: Column | str) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def url_components(url: Column | str) -> Column:
    """Host and the segments of the path."""
    return F.concat(F.array(hostname(url)), F.split(path(url), "/", -1))


def filter_base_url(strategy: Column | str, original: Column | str, final: Column | str | None = None, user_base: Column | str | None = None) -> Column:
    """The base that links are qualified by: the user's; for `all` the final origin; for `same-domain` the final origin
    unless the domain changed (then null); else the original origin."""
    s = _c(strategy)
    last = F.coalesce(_c(final), _c(original)) if final is not None else _c(original)
    same = registrable_domain(hostname(last)).eqNullSafe(registrable_domain(hostname(original)))
    found = F.when(s == "all", origin(last)).when(s == "same-domain", F.when(same, origin(last))).otherwise(origin(original))
    return F.coalesce(origin(user_base), found) if user_base is not None else found


def crawl_depth(own: Column | str, parent: Column | str) -> Column:
    return F.coalesce(_c(own), _c(parent) + 1, F.lit(0))


def label(user_data: Column | str) -> Column:
    return F.get_json_object(_c(user_data), "$.label")


def retry_after_ms(value: Column | str, now: Column) -> Column:
    """Milliseconds of a Retry-After value, seconds or an HTTP date; null if it isn't above 0."""
    v = trimmed(value)
    when = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.when(v.rlike(r"^\d{1,15}$"), F.expr("try_cast(0 as bigint)") + v.try_cast("bigint") * 1000).otherwise(F.unix_millis(when) - F.unix_millis(now))
    return F.when(ms > 0, ms)


def proxy_info(url: Column | str) -> Column:
    user = F.regexp_extract(part(url, 2), "^(.*)@", 1)
    return F.struct(scheme(url).alias("scheme"), F.try_url_decode(F.regexp_extract(user, "^[^:]*", 0)).alias("username"), F.try_url_decode(F.regexp_extract(user, "^[^:]*:(.*)$", 1)).alias("password"), hostname(url).alias("hostname"), port(url).alias("port"))


def sanitized(url: Column | str) -> Column:
    """For logs: user, password and parameters hidden."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"//[^/@]*@", "//***@"), r"\?.*$", "?***")
