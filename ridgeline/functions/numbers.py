"""Rounding, growth, bands and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M2_PER_PYEONG = 3.305785
EOK = 10_000  # prices are in units of 10^4 won


def js_round(x: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(x + 0.5)


def rounded(x: Column | str, digits: int) -> Column:
    """Half away from zero of x times the power of ten, as SQL engines round doubles: 0.0715 * 100, which is a little below
    7.15, becomes 7.2. What is too large for that stays. F.round would take the digits of the double itself."""
    x, scale = (F.col(x) if isinstance(x, str) else x), 10.0**digits
    made = F.round(x * scale) / scale
    return F.when(F.abs(made) < float("inf"), made).otherwise(x)


def growth(start: Column, end: Column) -> Column:
    """end / start - 1 for positive starts, else null."""
    return F.when(start > 0, end / start - 1)


def band_key(price: Column) -> Column:
    """Price band in eok: 0, then single ones up to 9, then tens."""
    eok = price / EOK
    return F.when(eok < 1, 0).when(eok < 10, F.floor(eok)).otherwise(F.floor(eok / 10) * 10).cast("int")


def band_range(key: int) -> tuple[int | None, int]:
    """Half-open price range of a band."""
    if key <= 0:
        return None, EOK
    return key * EOK, (key + (1 if key < 10 else 10)) * EOK


def area_band(pyeong: Column) -> Column:
    """under10 holds 10 itself; then tens; 60plus from 60 on."""
    tens = (F.floor(pyeong / 10) * 10).cast("int").cast("string")
    return F.when(pyeong <= 10, "under10").when(pyeong >= 60, "60plus").otherwise(tens)


def percent(rate: Column) -> Column:
    """Percent to one decimal, never minus zero."""
    shown = rounded(rate * 100, 1)
    return F.when(shown == 0, F.lit(0.0)).otherwise(shown)


def tone(rate: Column, mode: int = 4) -> Column:
    p = percent(rate)
    out = F.when(p.isNull() | (p == 0), "neutral").when(p < 0, "negative")
    return out.when(p >= 10, "top1").otherwise("top3") if mode == 3 else out.when(p >= 20, "top1").when(p >= 10, "top2").otherwise("top3")


def period_bucket(months: Column) -> Column:
    return F.when(months >= 54, 60).when(months >= 30, 36).when(months >= 9, 12).when(months >= 5, 6).otherwise(3)


def parse_number(x: Column) -> Column:
    """Numbers with thousands commas; null if it is none."""
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def pyeong_price(amount: Column, m2: Column) -> Column:
    return js_round(amount / (m2 / M2_PER_PYEONG))


def quote_pyeong(mid: Column, supply: Column, exclusive: Column) -> Column:
    """Price per pyeong of a quote: by the supplied area where it is known, else by the exclusive one; null without either."""
    size = F.coalesce(F.nullif(supply, F.lit(0.0)), F.nullif(exclusive, F.lit(0.0)))
    return F.when((mid != 0) & size.isNotNull(), js_round(mid / size))


def zoom_level(zoom: float) -> str:
    return next((level for least, level in ((16, "apartment"), (13, "dong"), (11, "sigungu")) if zoom >= least), "sido")


def page_size(n: int) -> int:
    return max(10, min(100, n))


def page_of(page: int, rows: int, size: int) -> tuple[int, int]:
    """(page within range, number of pages, at least 1)."""
    pages = max(1, -(-rows // size))
    return max(1, min(page, pages)), pages


def stored_years(years: float) -> int:
    """0 for periods of less than a year."""
    return int(years) if years >= 1 else 0
