"""Predicates over requests and responses, and the ordered pipeline of reasons why a link is skipped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import urls as U

STRATEGIES = ("all", "same-hostname", "same-domain", "same-origin")
# Statuses that mean blocking, selectors of challenge pages, markers of proxy errors.
BLOCKED_STATUS = (401, 403, 429)
BLOCKED_SELECTORS = ('#turnstile-wrapper iframe[src^="https://challenges.cloudflare.com"]', 'div#infoDiv0 a[href*="//www.google.com/policies/terms/"]', 'iframe[src*="_Incapsula_Resource"]')
PROXY_ERRORS = ("ECONNRESET", "ECONNREFUSED", "ERR_PROXY_CONNECTION_FAILED", "ERR_TUNNEL_CONNECTION_FAILED", "Proxy responded with")
MIME_TYPES = ("text/html", "text/xml", "application/xhtml+xml", "application/xml", "application/json")
TRANSIENT_STATUS = (408, 429, 500, 502, 503, 504)


def is_web(url: Column | str) -> Column:
    web = lambda p: p["scheme"].rlike("^(?i)https?$") & F.regexp_replace(p["authority"], r"^.*@|:\d*$", "").rlike("(?s).")
    return F.coalesce(U.let(U.parsed_once(url), web), F.lit(False))


def matches_strategy(strategy: Column | str, target: Column | str, base: Column | str) -> Column:
    """Whether target may be followed from base; hosts are compared without a dot at the end."""
    s = F.col(strategy) if isinstance(strategy, str) else strategy

    def compared(x: Column) -> Column:
        host_t, host_b = U.plain_host(x["t"]["host"]), U.plain_host(x["b"]["host"])
        dom_t, dom_b = U.registrable_domain(host_t), U.registrable_domain(host_b)
        same_origin = x["t"]["origin"] == x["b"]["origin"]
        same_domain = F.when(dom_b.isNull(), same_origin).otherwise(dom_t.eqNullSafe(dom_b))
        return F.when(s == "all", F.lit(True)).when(s == "same-hostname", host_t == host_b).when(s == "same-domain", same_domain).when(s == "same-origin", same_origin)

    both = F.struct(U.host_and_origin(target).alias("t"), U.host_and_origin(base).alias("b"))
    return F.coalesce(U.let(both, compared), F.lit(False))


def filter_url(target: Column | str, base: Column | str, strategy: Column | str) -> Column:
    """struct(allowed, reason)."""
    reason = F.when(~is_web(target), F.lit("only http and https URLs are followed")).when(U.origin(base).isNull(), F.lit("the origin is no URL")).when(~matches_strategy(strategy, target, base), F.concat(F.lit("the URL doesn't match the strategy "), strategy if isinstance(strategy, Column) else F.col(strategy)))
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def glob_to_regex(glob: str) -> str:
    """A glob as a Java regular expression for whole URLs, letters in either case.

    ** (a whole segment) crosses slashes, * and ? don't; {a,b}, {1..3}, [ab], [!ab], ?(x) *(x) +(x) @(x) and \\ work.
    """
    out, i, n = [], 0, len(glob)
    closers: list[str] = []
    braces = 0
    while i < n:
        c = glob[i]
        if c in "?*+@" and i + 1 < n and glob[i + 1] == "(":
            out.append("(?:")
            closers.append({"@": ")", "?": ")?", "*": ")*", "+": ")+"}[c])
            i += 2
            continue
        if c == "|" and closers:
            out.append("|")
        elif c == ")" and closers:
            out.append(closers.pop())
        elif c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            alone = (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/")
            if j - i >= 2 and alone and j < n:
                out.append("(?:[^/]*/)*")
                j += 1
            else:
                out.append(".*" if j - i >= 2 and alone else "[^/]*")
            i = j
            continue
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = j + 1
            continue
        elif c == "{" and (m := re.match(r"\{(-?\d+)\.\.(-?\d+)\}", glob[i:])):
            low, high = sorted((int(m[1]), int(m[2])))
            out.append("(?:" + "|".join(str(k) for k in range(low, high + 1)) + ")")
            i += m.end()
            continue
        elif c == "{" and "," in glob[i : glob.find("}", i)] and glob.find("}", i) > 0:
            out.append("(?:")
            braces += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
        elif c == "," and braces:
            out.append("|")
        elif c == "\\" and i + 1 < n:
            out.append(re.escape(glob[i + 1]))
            i += 1
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "(?is)^" + "".join(out) + "$"


def strategy_patterns(base: str, strategy: str) -> list[str]:
    """The strategy as globs: origin or host with either scheme; for same-domain the domain and what is below it."""
    if strategy == "all":
        return ["http{s,}://**"]
    m = re.match(r"(?i)^(https?)://([^/?#@]*@)?([^/?#]+)", base)
    if not m:
        return []
    host = m[3].lower()
    if strategy == "same-origin":
        return [f"{m[1].lower()}://{host}/**"]
    if strategy == "same-hostname":
        return [f"http{{s,}}://{host}/**"]
    labels = host.split(":")[0].rstrip(".").split(".")
    keep = 3 if ".".join(labels[-2:]) in U.SUFFIXES else 2
    if len(labels) < keep or re.fullmatch(r"[\d.]+", host):
        return [f"{m[1].lower()}://{host}/**"]
    domain = ".".join(labels[-keep:])
    return [f"http{{s,}}://*.{domain}/**", f"http{{s,}}://{domain}/**"]


def one_pattern(patterns: list[str | re.Pattern]) -> str | None:
    """Globs (text) and regular expressions as one alternation, so that a scan tests each URL once."""
    if not patterns:
        return None
    return "|".join(f"(?:{glob_to_regex(p) if isinstance(p, str) else ('(?i)' if p.flags & re.I else '') + p.pattern})" for p in patterns)


def matches_patterns(url: Column | str, include: list | None = None, exclude: list | None = None) -> Column:
    """Excluded wins; then any of include, or all URLs if include is empty."""
    u = F.col(url) if isinstance(url, str) else url
    out = F.lit(True)
    if include:
        out = u.rlike(one_pattern(include))
    return out & ~u.rlike(one_pattern(exclude)) if exclude else out


def by_pattern_table(requests: DataFrame, patterns: DataFrame, url: str = "url", most: int = 10_000) -> DataFrame:
    """requests that match any row of patterns(regex). Up to most patterns, which are configuration, are folded to one
    literal; more are met one by one in a join, which takes requests times patterns but leaves none out."""
    own = patterns.select("regex").where("regex is not null").distinct()
    found = [r["regex"] for r in own.limit(most + 1).collect()]
    if len(found) > most:
        return requests.join(own.withColumnRenamed("regex", "_regex"), F.rlike(F.col(url), F.col("_regex")), "left_semi")
    return requests.where(F.col(url).rlike("|".join(f"(?:{x})" for x in sorted(found)))) if found else requests.limit(0)


def is_blocked_status(status: Column | str, codes: tuple[int, ...] = BLOCKED_STATUS) -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*codes)


def is_error_status(status: Column | str, ignored: tuple[int, ...] = (), added: tuple[int, ...] = ()) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    out = (s >= 500) & ~s.isin(*ignored) if ignored else s >= 500
    return out | s.isin(*added) if added else out


def is_blocked_page(html: Column | str) -> Column:
    """Whether a page holds one of the challenge elements (by their attributes)."""
    h = F.col(html) if isinstance(html, str) else html
    frames = r'(?is)<iframe\b[^>]*\bsrc\s*=\s*["\'](?:https://challenges\.cloudflare\.com|[^"\']*_Incapsula_Resource)'
    terms = r'(?is)id\s*=\s*["\']infoDiv0["\'].*?<a\b[^>]*\bhref\s*=\s*["\'][^"\']*//www\.google\.com/policies/terms/'
    return h.rlike(frames) | h.rlike(terms)


def content_type(header: Column | str, url: Column | str | None = None) -> Column:
    """struct(type, charset) of a Content-Type; without one by the path's extension, else octet-stream."""
    # Types by extension.
    known = {"html": "text/html", "htm": "text/html", "xml": "application/xml", "json": "application/json", "txt": "text/plain", "csv": "text/csv", "js": "application/javascript", "css": "text/css", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf"}
    h = F.col(header) if isinstance(header, str) else header
    kind = U.trimmed(F.lower(F.regexp_extract(h, "^[^;]*", 0)))
    charset = F.lower(F.regexp_extract(h, r"(?i)charset\s*=\s*\"?([^\s;\"]+)", 1))
    by_name = F.lit(None).cast("string")
    if url is not None:
        ext = F.lower(F.regexp_extract(U.path(url), r"\.([A-Za-z0-9]+)$", 1))
        for e, t in known.items():
            by_name = F.when(ext == e, F.lit(t)).otherwise(by_name)
    return F.struct(F.coalesce(F.when(kind != "", kind), by_name, F.lit("application/octet-stream")).alias("type"), F.when(charset != "", charset).alias("charset"))


def allowed_mime(kind: Column | str, status: Column | str, extra: tuple[str, ...] = ()) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    s = F.col(status) if isinstance(status, str) else status
    return k.isin(*MIME_TYPES, *extra) | s.isin(*TRANSIENT_STATUS)


def is_proxy_error(message: Column | str) -> Column:
    m = F.col(message) if isinstance(message, str) else message
    return m.rlike("|".join(map(re.escape, PROXY_ERRORS)))


def is_retryable(no_retry: Column, retry_requested: Column, retry_count: Column, max_retries: Column | None = None, default: int = 3) -> Column:
    limit = F.coalesce(max_retries, F.lit(default)) if max_retries is not None else F.lit(default)
    return F.when(F.coalesce(no_retry, F.lit(False)), F.lit(False)).when(F.coalesce(retry_requested, F.lit(False)), F.lit(True)).otherwise(retry_count < limit)


def redirect_stays(url: Column | str, loaded_url: Column | str, strategy: Column | str) -> Column:
    """Whether a page that redirects led to still satisfies the strategy; hosts are compared as they are. Null: yes."""
    s = F.col(strategy) if isinstance(strategy, str) else strategy
    loaded = F.col(loaded_url) if isinstance(loaded_url, str) else loaded_url
    same = F.when(s == "same-hostname", U.hostname(url) == U.hostname(loaded)).when(s == "same-domain", U.registrable_domain(U.hostname(url)).eqNullSafe(U.registrable_domain(U.hostname(loaded)))).when(s == "same-origin", U.origin(url) == U.origin(loaded))
    return F.when(s.isNull() | loaded.isNull() | (s == "all"), F.lit(True)).otherwise(F.coalesce(same, F.lit(False)))


def is_json_object(text: Column | str) -> Column:
    """Whether a dataset accepts the item: a JSON object."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(r"^\s*\{") & F.try_parse_json(t).isNotNull(), F.lit(False))


@dataclass
class EnqueueOptions:
    strategy: str = "all"
    include: list = field(default_factory=list)
    exclude: list = field(default_factory=list)
    max_depth: int | None = None
    budget: int | None = None


def skip_reason(options: EnqueueOptions, url: str = "url", base: str = "base", depth: str | None = None, allowed: str | None = None, transform_skips: Column | None = None) -> Column:
    """The first reason to skip a request, or null: depth, robotsTxt, filters (patterns, then strategy), transform."""
    out = F.lit(None).cast("string")
    if transform_skips is not None:
        out = F.when(transform_skips, F.lit("transform")).otherwise(out)

    def filtered(x: Column) -> Column:
        off = x["base"].isNotNull() & ~matches_strategy(F.lit(options.strategy), x["url"], x["base"])
        return F.coalesce(~matches_patterns(x["url"], options.include, options.exclude), F.lit(False)) | off

    # url is named once: where a condition on the reason moves below what makes the URL, that isn't made again for each use.
    out = F.when(U.let(F.struct(F.col(url).alias("url"), F.col(base).alias("base")), filtered), F.lit("filters")).otherwise(out)
    if allowed:
        out = F.when(~F.coalesce(F.col(allowed), F.lit(True)), F.lit("robotsTxt")).otherwise(out)
    if depth and options.max_depth is not None:
        out = F.when(F.col(depth) > options.max_depth, F.lit("depth")).otherwise(out)
    return out
