"""Metadata and user information of events, cut to bounds: JSON of any shape read as VARIANT, all native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import text
from ridgeline.functions.numbers import js_round

#: How much of a metadata object is kept.
KEYS, INNER_KEYS, ITEMS, KEY_CHARS, CHARS, ALL_CHARS = 30, 12, 20, 80, 500, 4000
DEPTH = 4  # objects and arrays inside each other; what lies deeper is kept as its JSON text
DEEP_CHARS = 200


def quoted(x: Column) -> Column:
    """A text as JSON; only one with signs to escape takes the way over an array."""
    escaped = lambda t: once(F.to_json(F.array(t)), lambda inside: F.substring(inside, F.lit(2), F.length(inside) - 2))
    return once(x, lambda t: F.when(t.rlike(r'["\\\x00-\x1f]'), escaped(t)).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, or a number's type."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed a single time: Spark computes an expression inside a lambda again at every mention, which
    multiplies with each level of nesting."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _inside(v: Column, of: Column, keys: int, depth: int) -> Column:
    """An object's keys in order, each cut (of keys that agree when cut the first counts), or an array's items.

    Both are shown by one expression, so that its size grows with the depth and not with its power of two.
    """
    entry = lambda p, x: F.struct(p.alias("p"), x.alias("v"))
    pairs = once(v.cast("map<string, variant>"), lambda held: F.transform(F.slice(F.array_sort(F.map_keys(held)), 1, keys), lambda k: entry(F.concat(quoted(F.left(k, F.lit(KEY_CHARS))), F.lit(":")), F.try_element_at(held, k))))
    items = F.transform(F.slice(v.cast("array<variant>"), 1, ITEMS), lambda x: entry(F.lit(""), x))
    shown = F.transform(F.when(of == "OBJECT", pairs).otherwise(items), lambda e: F.concat(e["p"], bounded(e["v"], depth - 1)))
    return F.concat(F.when(of == "OBJECT", "{").otherwise("["), F.array_join(shown, ","), F.when(of == "OBJECT", "}").otherwise("]"))


def bounded(v: Column, depth: int = DEPTH) -> Column:
    """A VARIANT as JSON text within the bounds; null is null, numbers and booleans stay, texts and lists are cut."""

    def shown(of: Column) -> Column:
        inside = of.isin("OBJECT", "ARRAY")
        plain = F.when(v.isNull() | F.is_variant_null(v), "null").when(of == "STRING", quoted(F.left(v.cast("string"), F.lit(CHARS))))
        return plain.when(inside, quoted(F.left(F.to_json(v), F.lit(DEEP_CHARS))) if depth == 0 else _inside(v, of, INNER_KEYS, depth)).otherwise(F.to_json(v))

    return once(kind(v), shown)


def metadata(json: Column) -> Column:
    """JSON text of an event's metadata within the bounds: '{}' for what is no object or no JSON, and
    '{"truncated":true}' where more than ALL_CHARS would remain."""
    found = once(F.try_parse_json(json), lambda v: once(kind(v), lambda of: F.when(of == "OBJECT", _inside(v, of, KEYS, DEPTH + 1)).otherwise("{}")))
    return once(found, lambda x: F.when(F.length(x) > ALL_CHARS, '{"truncated":true}').otherwise(F.coalesce(x, F.lit("{}"))))


def number(v: Column) -> Column:
    """A VARIANT as a number: texts that are one, true and false as 1 and 0, null and blank as 0; missing and else null."""
    of = kind(v)
    said = F.trim(v.cast("string"))
    read = F.when(F.is_variant_null(v), 0.0).when(of == "STRING", F.when(said == "", 0.0).otherwise(said.try_cast("double"))).when(of == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0)).otherwise(F.try_variant_get(v, "$", "double"))
    return F.when(v.isNotNull() & ~F.isnan(read) & (F.abs(read) < float("inf")), read)


def user_info(json: Column, agent: Column) -> Column:
    """JSON text of what is known of an event's user: first names of a place, cut texts, bounded sizes; empty ones go.
    Browser, system and device come from the user agent where the user's own information is silent."""
    v = F.try_parse_json(json)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")

    def first(*keys: str, chars: int, other: Column | None = None) -> Column:
        told = F.coalesce(*(F.nullif(F.trim(F.left(F.try_variant_get(v, f"$.{k}", "string"), F.lit(chars))), F.lit("")) for k in keys))
        return told if other is None else F.coalesce(told, F.nullif(F.left(other, F.lit(chars)), F.lit("")))

    def whole(k: str, most: int) -> Column:
        n = number(get(k))
        return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(js_round(n), F.lit(most))).cast("long"))

    parsed = text.user_agent(agent)
    languages = F.slice(F.filter(F.transform(F.try_variant_get(v, "$.languages", "array<string>"), lambda x: F.trim(F.left(x, F.lit(40)))), lambda x: x != ""), 1, 5)
    ratio = F.greatest(F.lit(0.0), F.least(F.round(number(get("devicePixelRatio")), 2), F.lit(10.0)))
    fields = {
        "country": first("country", "countryCode", "geoCountry", chars=80), "region": first("region", "regionName", "geoRegion", chars=120), "city": first("city", "geoCity", chars=120),
        "timezone": first("timezone", chars=120), "language": first("language", chars=40, other=F.trim(F.split_part(F.coalesce(F.try_variant_get(v, "$.acceptLanguage", "string"), F.lit("")), F.lit(","), F.lit(1)))),
        "languages": F.when(F.size(languages) > 0, languages),
        "browser": first("browser", chars=80, other=parsed["browser"]), "browserVersion": first("browserVersion", chars=40, other=parsed["version"]), "os": first("os", chars=80, other=parsed["os"]), "osVersion": first("osVersion", chars=40, other=parsed["os_version"]), "deviceType": first("deviceType", chars=40, other=parsed["device"]),
        "platform": first("platform", chars=80), **{k: whole(k, 10_000) for k in ("viewportWidth", "viewportHeight", "screenWidth", "screenHeight")}, "devicePixelRatio": F.when(number(get("devicePixelRatio")).isNotNull(), ratio),
        "touchSupported": F.when(kind(get("touchSupported")) == "BOOLEAN", F.try_variant_get(v, "$.touchSupported", "boolean")),
        "utmSource": first("utmSource", chars=120), "utmMedium": first("utmMedium", chars=120), "utmCampaign": first("utmCampaign", chars=160),
    }
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
