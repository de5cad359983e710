"""Parameters as callers give them, made to what plans take: clamped, without repeats, in order. Plan-time Python."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

#: Fixed values: (least, most, what an unreadable value counts as) of each kind of limit.
LIMITS = {
    "page_size": (10, 100, 50),
    "rows": (1, 500, 50),
    "runs": (1, 50, 20),
    "markers": (10, 300, 100),
    "hits": (1, 20, 10),
    "days": (1, 90, 7),
}


def number(value) -> float | None:
    """A finite number, also out of text; True and False aren't any."""
    try:
        found = float(value) if not isinstance(value, bool) else math.nan
    except (TypeError, ValueError):
        return None
    return found if math.isfinite(found) else None


def clamp(kind: str, value) -> int:
    """A limit within its bounds; nothing, zero or no number gives its default."""
    least, most, other = LIMITS[kind]
    return max(least, min(most, int(number(value) or other)))


def _several(values) -> Iterable:
    return values if isinstance(values, Iterable) and not isinstance(values, str) else [values]


def periods(years) -> list[tuple[int, int]]:
    """(months, years stored) of periods given in years, each once, shortest first; below a year 0 is stored."""
    read = (number(y) for y in _several(years))
    found = {max(1, math.floor(y * 12 + 0.5)) for y in read if y is not None and y > 0}
    return [(m, 0 if m < 12 else math.floor(m / 12 + 0.5)) for m in sorted(found)]


def period_months(values) -> list[int]:
    """Whole positive numbers of months, each once, in order."""
    return sorted({int(n) for n in map(number, _several(values)) if n is not None and n > 0 and n == int(n)})


def households(values) -> list[int]:
    """Household limits, each once, in order; what is no positive number is 0."""
    return sorted({max(0, math.floor(number(v) or 0)) for v in _several(values)})


def bases(values) -> list[str]:
    """'start' before 'end'; everything but 'end' means 'start'."""
    return [b for b in ("start", "end") if b in {v if v == "end" else "start" for v in _several(values)}]


def areas(values, known: Sequence[str]) -> list[str]:
    """Size bands in their own order; unknown ones mean all sizes, the first."""
    asked = {str(v) if str(v) in known else known[0] for v in _several(values)}
    return [a for a in known if a in asked]


def region(dong: str = "", sigungu: str = "", sido: str = "") -> dict[str, str]:
    """Codes of a place: a district is read off the neighbourhood's key and a province off the district where they are
    missing; codes of another length count as none."""
    dong, sigungu, sido = ((x or "").strip() for x in (dong, sigungu, sido))
    if not sigungu and re.match(r"\d{5}", dong):
        sigungu = dong[:5]
    if not sido and re.fullmatch(r"\d{5}", sigungu):
        sido = sigungu[:2]
    return {"sido": sido if re.fullmatch(r"\d{2}", sido) else "", "sigungu": sigungu if re.fullmatch(r"\d{5}", sigungu) else "", "dong": dong}
