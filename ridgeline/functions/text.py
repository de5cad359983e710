"""Keys, similarities and labels from text, all as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^0-9a-z가-힣]", "")


def loose_key(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", ""), "아파트", ""), r"[()\[\]{}·ㆍ._/-]", "")


def squeezed(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")


def joined(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of x, each padded by two spaces before and one after."""
    word = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    ws = F.filter(F.split(F.lower(x), "[^0-9a-z가-힣]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(ws, lambda w: grams(word(w)))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 for texts without any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def name_score(a: Column, b: Column) -> Column:
    """0 if one is empty, 100 if equal, 90 if one holds the other (both of 2 or more), else similarity in percent."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    held = (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))
    return F.when((a == "") | (b == ""), 0).when(a == b, 100).when(held, 90).otherwise(F.rint(similarity(a, b) * 100)).cast("int")


def holds(columns: list[Column], keyword: str) -> Column:
    """Case-insensitive search for the keyword as it is; % and _ have no meaning."""
    return reduce(lambda x, y: x | y, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower())) for c in columns))


def search_score(name: Column, keyword: str) -> Column:
    """0 equal, 10 at the head, 20 inside, else 40."""
    n, k = squeezed(F.lower(name)), F.regexp_replace(F.lower(F.lit(keyword)), r"\s+", "")
    return F.when(n == k, 0).when(F.startswith(n, k), 10).when(F.contains(n, k), 20).otherwise(40)


def slug(x: Column, most: int = 80, other: str = "page_view") -> Column:
    """An event's name: lower case, runs of other characters as one underscore, none at the ends; `other` if empty."""
    made = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[^a-z0-9_.:-]+", "_")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(made, "^_+|_+$", ""), F.lit(most)), F.lit("")), F.lit(other))


def is_uuid(x: Column) -> Column:
    return F.lower(x).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


#: Names of browsers and the pattern that tells each and holds its version; the first that matches counts.
BROWSERS = (
    ("Edge", r"\bedg(?:e|ios|a)?/([\d.]+)"), ("Samsung Internet", r"samsungbrowser/([\d.]+)"), ("Naver Whale", r"whale/([\d.]+)"), ("KakaoTalk", r"kakaotalk/([\d.]+)"),
    ("Chrome", r"(?:chrome|crios)/([\d.]+)"), ("Firefox", r"(?:firefox|fxios)/([\d.]+)"), ("Safari", r"version/([\d.]+).*safari"),
)
#: Names of systems, the pattern that tells each, and that of its version.
SYSTEMS = (("iOS", "iphone|ipad|ipod", r"os ([\d_]+)"), ("Android", "android", r"android ([\d.]+)"), ("Windows", "windows nt", r"windows nt ([\d.]+)"), ("macOS", "mac os x", r"mac os x ([\d_]+)"), ("Linux", "linux", ""))


def user_agent(ua: Column) -> Column:
    """struct<browser, version, os, os_version, device>; what isn't told is Unknown, its version empty."""
    u = F.lower(F.coalesce(ua, F.lit("")))
    first = lambda cases, other: reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(other)
    version = lambda pattern: F.translate(F.regexp_extract(u, pattern, 1), "_", ".") if pattern else F.lit("")
    device = F.when(u.rlike("mobi|iphone|ipod"), "mobile").when(u.rlike("ipad|tablet|android"), "tablet").when(u.rlike("bot|crawler|spider|slurp"), "bot").otherwise("desktop")
    return F.struct(
        first([(u.rlike(p), F.lit(n)) for n, p in BROWSERS], "Unknown").alias("browser"),
        first([(u.rlike(p), version(p)) for _, p in BROWSERS], "").alias("version"),
        first([(u.rlike(p), F.lit(n)) for n, p, _ in SYSTEMS], "Unknown").alias("os"),
        first([(u.rlike(p), version(v)) for _, p, v in SYSTEMS], "").alias("os_version"),
        device.alias("device"),
    )


#: Hosts of the machine itself, and how addresses of local networks begin.
LOCAL_HOSTS, LOCAL_NETWORKS = ("localhost", "127.0.0.1", "::1"), ("192.168.", "10.")


def host_of(host: Column) -> Column:
    """A host without scheme, path and port."""
    h = F.split_part(F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), "^https?://", ""), F.lit("/"), F.lit(1))
    v6 = F.regexp_extract(h, r"^\[([^\]]+)\](:\d+)?$", 1)
    return F.when(v6 != "", v6).when(h.rlike("^[^:]*:[^:]*$"), F.regexp_replace(h, r":\d+$", "")).otherwise(h)


def environment(host: Column, production: tuple[str, ...] = (), development: tuple[str, ...] = ()) -> Column:
    """The environment of a host: named ones, else local addresses, else unknown."""
    h = host_of(host)
    local = reduce(lambda x, net: x | F.startswith(h, F.lit(net)), LOCAL_NETWORKS, h.isin(*LOCAL_HOSTS))
    return F.when(h.isin(*development), "development").when(h.isin(*production), "production").when(local, "local").otherwise("unknown")


def bounded_map(m: Column, keys: int = 30, chars: int = 300) -> Column:
    """At most so many entries of a map<string, string>, by key, each value cut."""
    kept = F.slice(F.array_sort(F.map_entries(m)), 1, keys)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.left(e["key"], F.lit(80)).alias("key"), F.left(e["value"], F.lit(chars)).alias("value"))))
