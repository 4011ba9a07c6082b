"""Extraction from text by regular expressions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.urls import trimmed

# The patterns of URLs, e-mail addresses, phone numbers and social handles that results must equal.
URL_NO_COMMAS = r"https?://(www\.)?([\p{L}0-9]|[\p{L}0-9][-\p{L}0-9@:%._+~#=]{0,254}[\p{L}0-9])\.[a-z]{2,63}(:\d{1,5})?(/[-\p{L}0-9@:%_+.~#?&/=()'*]*)?"
URL_WITH_COMMAS = r"https?://(www\.)?([\p{L}0-9]|[\p{L}0-9][-\p{L}0-9@:%._+~#=]{0,254}[\p{L}0-9])\.[a-z]{2,63}(:\d{1,5})?(/[-\p{L}0-9@:%_+,.~#?&/=()'*]*)?"
EMAIL = (
    r"(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]{1,64}(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]{1,64}){0,32}"
    r'|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")'
    r"@(?:(?:[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?"
    r"|\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?"
    r"|[a-z0-9-]*[a-z0-9]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])"
)
PHONES = (
    r"[0-9]{6,15}",
    r"([0-9]{1,4}( )?)?\([0-9]{2,4}\)( )?[0-9]{2,4}(( )?(-|.))?( )?[0-9]{2,6}",
    r"\([0-9]{2}\)( )?[0-9]{4,5}-[0-9]{4}",
    r"([0-9]{1,4}( )?)?\([0-9]{2,4}\)( )?[0-9]{2,4}(( )?(-|.))?( )?[0-9]{2,6}",
    r"[0-9]{2,4}-[0-9]{2,4}-[0-9]{2,4}-[0-9]{2,6}",
    r"[0-9]{2,4}-[0-9]{2,4}-[0-9]{2,6}",
    r"[0-9]{2,4}-[0-9]{2,6}",
    r"[0-9]{2,4}\.[0-9]{2,4}\.[0-9]{2,4}\.[0-9]{2,6}",
    r"[0-9]{2,4}\.[0-9]{2,4}\.[0-9]{2,6}",
    r"[0-9]{2,4}\.[0-9]{2,6}",
    r"[0-9]{2,4} [0-9]{2,4} [0-9]{2,4} [0-9]{2,6}",
    r"[0-9]{2,4} [0-9]{2,4} [0-9]{2,6}",
    r"[0-9]{2,4} [0-9]{3,8}",
)
PHONE_MIN_DIGITS = 7
PHONE_SKIP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
PHONE_PREFIX = r"(?i)^(tel|phone|telephone|callto):(/)?(/)?"
LINKEDIN = r"(?<!\w)(?:(?:http(?:s)?://)?(?:(?:(?:[a-z]+\.)?linkedin\.com/(?:in|company)/)([a-z0-9\-_%=]{2,60})(?![a-z0-9\-_%=])))(?:/)?"
INSTAGRAM = r"(?<!\w)(?:http(?:s)?://)?(?:(?:www\.)?(?:instagram\.com|instagr\.am)/)(?!explore|_n|_u)([a-z0-9_.]{2,30})(?![a-z0-9_.])(?:/)?"
TWITTER_RESERVED = "oauth|account|tos|privacy|signup|home|hashtag|search|login|widgets|i|settings|start|share|intent|oct|messages|explore|notifications|jobs|compose/post"
X_SUBDOMAINS = "business|help|about|blog|careers|developer|ads"
TWITTER = rf"(?<!\w)(?:http(?:s)?://)?(?:www.)?(?<!(?:{X_SUBDOMAINS})\.)(?:x|twitter)(?:.com)/(?!(?:{TWITTER_RESERVED})(?:[\'\"\?\./]|$))(?:@)?([a-z0-9_]{{1,15}})(?![a-z0-9_])(?:/)?"
FACEBOOK_RESERVED = r"rsrc\.php|apps|groups|events|l\.php|friends|images|photo.php|chat|ajax|dyi|common|policies|login|recover|reg|help|security|messages|marketplace|pages/(?:create|merge|search)|live|bookmarks|games|fundraisers|saved|gaming|salesgroups|jobs|people|ads|ad_campaign|weather|offers|recommendations|crisisresponse|onthisday|developers|settings|connect|business|plugins|intern|sharer"
FACEBOOK = rf"(?<!\w)(?:http(?:s)?://)?(?:www.)?(?:facebook.com|fb.com)/(?!(?:{FACEBOOK_RESERVED})(?:[\'\"\?\./]|$))(profile\.php\?id=[0-9]{{3,20}}|pages/[a-z0-9-_][a-z0-9-_\./]{{0,150}}|(?!pages|profile\.php)[a-z0-9-\.]{{5,51}}(?![a-z0-9\.]))(?:/)?"
YOUTUBE = r"(?<!\w)(?:https?://)?(?:youtu\.be/|(?:www\.|m\.)?youtube\.com(?:(?:(?:/(?:watch|v|embed|user|c(?:hannel)?)(?:\.php)?)?(?:\?[^ ]*v=|/))|(?:(?:/c)?/@)))([a-zA-Z0-9\-_]{2,100})"
TIKTOK = r"(?<!\w)(?:http(?:s)?://)?(?:(?:www|m)\.)?(?:tiktok\.com)/(((?:(?:v|embed|trending)(?:\?shareId=|/))[0-9]{2,50}(?![0-9]))|(?:@)[a-z0-9\-_\.]+((?:/video/)[0-9]{2,50}(?![0-9]))?)(?:/)?"
PINTEREST = r"(?<!\w)(?:http(?:s)?://)?(?:(?:(?:(?:www\.)?pinterest(?:\.com|(?:\.[a-z]{2}){1,2}))|(?:[a-z]{2})\.pinterest\.com)(?:/))((pin/[0-9]{2,50})|((?!pin)[a-z0-9\-_\.]+(/[a-z0-9\-_\.]+)?))(?:/)?"
DISCORD = r"(?<!\w)(?:https?://)?(?:www\.)?((?:(?:(?:canary|ptb).)?(?:discord|discordapp)\.com/channels(?:/)[0-9]{2,50}(/[0-9]{2,50})*)|(?:(?:(?:canary|ptb).)?(?:discord\.(?:com|me|li|gg|io)|discordapp\.com)(?:/invite)?)/(?!channels)[a-z0-9\-_]{2,50})(?:/)?"

PHONE = "(" + "|".join(rf"(00|\+)?{p}" for p in PHONES) + ")"
NETWORKS = {"linkedIns": LINKEDIN, "twitters": TWITTER, "instagrams": INSTAGRAM, "facebooks": FACEBOOK, "youtubes": YOUTUBE, "tiktoks": TIKTOK, "pinterests": PINTEREST, "discords": DISCORD}

#: What any handle of a network holds.
HOSTS = {"linkedIns": ("linkedin.com/",), "twitters": ("com/",), "instagrams": ("instagram.com/", "instagr.am/"), "facebooks": ("facebook", "fb"), "youtubes": ("youtu.be/", "youtube.com"), "tiktoks": ("tiktok.com/",), "pinterests": ("pinterest",), "discords": ("discord",)}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(text: Column | str, pattern: str) -> Column:
    """All matches in order, duplicates kept; none for null."""
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _if_any(text: Column, literals: tuple[str, ...], found: Column) -> Column:
    """found where the text holds one of literals (in either case), else nothing: a cheap test before a costly pattern."""
    low = F.lower(text)
    some = F.lit(False)
    for x in literals:
        some = some | F.contains(low, F.lit(x))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def extract_urls(text: Column | str, commas: bool = False) -> Column:
    """URLs in order, line by line."""
    return all_matches(text, "(?iu)" + (URL_WITH_COMMAS if commas else URL_NO_COMMAS))


def emails(text: Column | str) -> Column:
    return _if_any(_c(text), ("@",), all_matches(text, "(?i)" + EMAIL))


def emails_from_urls(urls: Column | str) -> Column:
    found = F.transform(F.filter(_c(urls), lambda u: u.rlike("(?i)^mailto:")), lambda u: trimmed(F.regexp_replace(u, "(?i)^mailto:", "")))
    return F.filter(found, lambda e: e.rlike(rf"(?i)^(?:{EMAIL})\z"))


def phones(text: Column | str) -> Column:
    """Numbers of at least PHONE_MIN_DIGITS digits that aren't dates."""
    # Every number begins with one of these, so the alternatives aren't tried elsewhere.
    return F.filter(all_matches(text, "(?=[0-9+(])" + PHONE), lambda p: (F.length(F.regexp_replace(p, "[^0-9]", "")) >= PHONE_MIN_DIGITS) & ~p.rlike(PHONE_SKIP))


def phones_from_urls(urls: Column | str) -> Column:
    found = F.transform(F.filter(_c(urls), lambda u: u.rlike(PHONE_PREFIX)), lambda u: trimmed(F.regexp_replace(u, PHONE_PREFIX, "")))
    return F.filter(found, lambda p: p.rlike(rf"(?i)^(?:{PHONE})\z"))


def handles(text: Column | str, network: str) -> Column:
    return _if_any(_c(text), HOSTS[network], all_matches(text, "(?i)" + NETWORKS[network]))


def is_handle(text: Column | str, network: str) -> Column:
    return _c(text).rlike(rf"(?i)^(?:{NETWORKS[network]})\z")


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def page_title(html: Column | str) -> Column:
    t = F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(t != "", trimmed(t))


def charset(body: Column | str) -> Column:
    """The charset that a page's first 1024 bytes name."""
    head = F.decode(F.substring(_c(body).cast("binary"), 1, 1024), "ISO-8859-1")
    found = F.lower(F.regexp_extract(head, r"(?is)<meta\b[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:.]+)", 1))
    return F.when(found != "", found)


def hrefs(html: Column | str) -> Column:
    """Values of double-quoted href attributes, by regular expression alone."""
    return F.coalesce(F.regexp_extract_all(_c(html), F.lit('href="([^"]*)"'), F.lit(1)), F.array().cast("array<string>"))


def cookies(header: Column | str) -> Column:
    """A Cookie header as a map; of equal names the last counts."""
    items = F.filter(F.transform(F.split(_c(header), ";"), trimmed), lambda x: x.contains("="))
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, "^[^=]*", 0).alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["k"] == p["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def merged_cookies(*headers: Column | str) -> Column:
    """One Cookie header of several; later values win and keep the earlier name's place."""
    every = F.concat(*[F.map_entries(F.coalesce(cookies(h), F.create_map().cast("map<string,string>"))) for h in headers])
    names = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.element_at(F.filter(every, lambda e: e["key"] == n), -1)["value"])), "; ")


def set_cookie(header: Column | str, host: Column | str) -> Column:
    """A Set-Cookie header as struct(name, value, domain, path, expires, secure, http_only)."""
    h = _c(header)
    attr = lambda n: F.regexp_extract(h, rf"(?i);\s*{n}\s*=\s*([^;]*)", 1)
    text = lambda v, otherwise: F.when(v != "", trimmed(v)).otherwise(otherwise)
    return F.struct(trimmed(F.regexp_extract(h, "^([^=;]*)=", 1)).alias("name"), trimmed(F.regexp_extract(h, "^[^=;]*=([^;]*)", 1)).alias("value"), text(F.regexp_replace(attr("domain"), r"^\.", ""), _c(host)).alias("domain"), text(attr("path"), F.lit("/")).alias("path"), text(attr("expires"), F.lit(None)).alias("expires"), h.rlike(r"(?i);\s*secure\s*(;|$)").alias("secure"), h.rlike(r"(?i);\s*httponly\s*(;|$)").alias("http_only"))


def form_encoded(fields: Column) -> Column:
    """A map as an application/x-www-form-urlencoded body."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit(""))))), "&")


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat_ws(":", user, password).cast("binary")))


def error_message(value: Column | str) -> Column:
    """The message of an error given as text or as a JSON object with message, else what was given."""
    v = _c(value)
    return F.when(v.isNull(), F.lit("Received null instead of an error")).otherwise(F.coalesce(F.try_variant_get(F.try_parse_json(v), "$.message", "string"), v))


def snapshot_name(stack: Column | str, message: Column | str) -> Column:
    """The key under which an error's snapshot is stored."""
    plain = lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9!\-_.'()]", "-")
    return F.substring(F.concat_ws("_", F.lit("ERROR_SNAPSHOT"), F.substring(F.sha1(_c(stack).cast("binary")), 1, 30), plain(F.substring(_c(message), 1, 30))), 1, 250)
