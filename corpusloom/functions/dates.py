"""Timestamps in mixed notations and zones to one UTC instant.

All notations are one regex alternation with named groups. A value is matched once, its parts are checked against the
calendar, and the instant is put together by integer day arithmetic; zone rules enter as transition tables.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and abbreviations in English, French, German and Spanish.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "fevrier": 2, "aout": 8, "decembre": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "okt": 10, "dez": 12, "mär": 3, "maerz": 3,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}

# Zone abbreviations in minutes east of UTC, for any country and then by country of the locale.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "ist": 330, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "sast": 120,
}
ZONES_BY_COUNTRY = {
    "AU": {"est": 600, "edt": 660, "cst": 570, "cdt": 630, "wst": 480, "eest": 660},
    "IE": {"ist": 60},
    "IL": {"ist": 120, "idt": 180},
    "CN": {"cst": 480},
    "TW": {"cst": 480},
    "CU": {"cst": -300, "cdt": -240},
    "BD": {"bst": 360},
    "PH": {"pst": 480},
    "GB": {"bst": 60},
}

_MONTH = "(?:" + "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True)) + r")\.?"
_WEEKDAY = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_TIME = r"(?P<@h>\d{1,2})[:h.](?P<@mi>\d{2})(?::(?P<@s>\d{2})(?:[.,](?P<@fr>\d{1,9}))?)?(?:\s*(?P<@ap>[ap]\.?m\.?)\b)?(?:\s*(?:uhr|heures)\b)?"
_ZONE = r"(?:\s*(?P<@off>(?:utc|gmt)?\s?[+\-−]\d{1,2}(?::?\d{2})?)(?:\s*[\[(][\w/+\-]+[\])])?|\s*(?P<@iana>[a-z]+(?:/[a-z_+\-]+){1,2})|\s*(?P<@ab>z|[a-z]{2,5})\b)?"


def _shape(date: str, sep: str) -> str:
    return f"{date}(?:{sep}{_TIME}{_ZONE})?"


#: Every notation; @ stands for the prefix of its groups.
SHAPES = {
    "a": _shape(r"(?P<@y>\d{4})-(?P<@mo>\d{1,2})-(?P<@d>\d{1,2})", r"(?:t|,?\s+)"),
    "b": _shape(r"(?P<@y>\d{4})/(?P<@mo>\d{1,2})/(?P<@d>\d{1,2})", r"(?:t|,?\s+)"),
    "c": r"(?P<@y>\d{4})(?P<@mo>\d{2})(?P<@d>\d{2})(?:t(?P<@h>\d{2})(?P<@mi>\d{2})(?P<@s>\d{2})?(?:[.,](?P<@fr>\d{1,9}))?" + _ZONE + ")?",
    "e": _shape(r"(?P<@q1>\d{1,2})/(?P<@q2>\d{1,2})/(?P<@y>\d{4}|\d{2})", r",?\s+"),
    "f": _shape(r"(?P<@d>\d{1,2})\.\s?(?P<@mo>\d{1,2})\.\s?(?P<@y>\d{4}|\d{2})", r",?\s+"),
    "g": _shape(r"(?P<@y2>\d{2})-(?P<@mo>\d{1,2})-(?P<@d>\d{1,2})", r"(?:t|,?\s+)"),
    "i": _shape(_WEEKDAY + rf"(?P<@d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?[\s\-]+(?:de\s+)?(?P<@mn>{_MONTH}),?[\s\-]+(?:de\s+|del\s+)?(?P<@y>\d{{4}})", r",?\s+(?:(?:à|a|at|um|a\s+las|-)\s+)?"),
    "j": _shape(_WEEKDAY + rf"(?P<@mn>{_MONTH})\s+(?P<@d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<@y>\d{{4}})", r",?\s+(?:(?:at|-)\s+)?"),
    "k": r"(?P<@ms>\d{13})",
    "l": r"(?P<@sec>\d{10})",
}
_LEAD = r"(?:(?:first\s+)?(?:published|posted|updated|last\s+updated|modified|created|publié|mis\s+à\s+jour|veröffentlicht|aktualisiert|publicado|actualizado|stand)\s*(?:on|le|am|el|at)?\s*:?\s*)?"
PATTERN = re.compile(_LEAD + "(?:" + "|".join(f"(?P<k_{t}>{p.replace('@', t)})" for t, p in SHAPES.items()) + r")\s*\.?", re.I)
_SPACE = re.compile(r"[\s   ​]+")


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a Gregorian date, in integers only."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def civil_from_days(z: int) -> tuple[int, int, int]:
    z += 719468
    era = z // 146097
    doe = z - era * 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + (3 if mp < 10 else -9)
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def month_days(y: int, m: int) -> int:
    if m == 2:
        return 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28
    return 30 if m in (4, 6, 9, 11) else 31


@lru_cache(maxsize=1024)
def _zone_table(name: str) -> tuple[list[int], list[int]] | None:
    """(UTC second of each change from 1969 to 2100, offset in seconds from then on) of an IANA zone; None if there is none."""
    try:
        z = ZoneInfo(name)
    except Exception:
        return None
    off = lambda t: int((datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    lo = days_from_civil(1969, 1, 1) * 86400
    hi = days_from_civil(2100, 1, 1) * 86400
    at, offs, step = [-(1 << 62)], [off(lo)], 7 * 86400
    t = lo
    while t < hi:
        if off(t + step) != offs[-1]:
            a, b = t, t + step
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == offs[-1] else (a, m)
            at.append(b)
            offs.append(off(b))
        t += step
    return at, offs


def local_to_utc(local: int, zone: str) -> int | None:
    """UTC second of a wall-clock second; the earlier of two where the clock was set back, None where it skipped that second."""
    table = _zone_table(zone)
    if table is None:
        return None
    at, offs = table
    i = bisect_right(at, local) - 1
    found = [local - offs[k] for k in range(max(0, i - 1), min(len(at), i + 2)) if bisect_right(at, local - offs[k]) - 1 == k]
    return min(found) if found else None


def _offset(text: str) -> int | None:
    t = text.lower().replace("utc", "").replace("gmt", "").strip().replace("−", "-")
    digits = t[1:].replace(":", "")
    h, m = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    return None if h > 14 or m > 59 else (h * 3600 + m * 60) * (-1 if t[0] == "-" else 1)


def to_epoch(value: str | None, locale: str | None = None, zone: str | None = None) -> int | None:
    """UTC second that value means on a site with this locale and zone; None where it means no single instant.

    Null, empty and unknown text, dates out of the calendar, years outside 1900-2099, and local times without a zone to read them by give None.
    """
    if not value:
        return None
    text = _SPACE.sub(" ", html.unescape(value)).strip()
    m = PATTERN.fullmatch(text)
    if not m:
        return None
    kind = m.lastgroup if m.lastgroup and m.lastgroup.startswith("k_") else next(k for k in m.groupdict() if k.startswith("k_") and m.group(k) is not None)
    t = kind[2:]
    if t == "k":
        return int(m.group("kms")) // 1000
    if t == "l":
        return int(m.group("lsec"))
    g = {k[len(t) :]: v for k, v in m.groupdict().items() if v is not None and k[: len(t)] == t and k[0] == t and not k.startswith("k_")}
    if t == "e":
        q1, q2 = int(g["q1"]), int(g["q2"])
        mo, d = (q1, q2) if (locale or "") == "en-US" else (q2, q1)
    else:
        mo = MONTHS[g["mn"].lower().rstrip(".")] if "mn" in g else int(g["mo"])
        d = int(g["d"])
    year = g.get("y") or g["y2"]
    y = int(year) + (0 if len(year) == 4 else 2000 if int(year) < 70 else 1900)
    if not (1900 <= y <= 2099 and 1 <= mo <= 12 and 1 <= d <= month_days(y, mo)):
        return None
    h, mi, s = int(g.get("h", 0)), int(g.get("mi", 0)), int(g.get("s", 0))
    if "ap" in g:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    local = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    if "off" in g:
        off = _offset(g["off"])
        return None if off is None else local - off
    if "iana" in g:
        name = next((n for n in (g["iana"], "/".join("_".join(w.capitalize() for w in p.split("_")) for p in g["iana"].split("/"))) if _zone_table(n)), None)
        return local_to_utc(local, name) if name else None
    if "ab" in g:
        ab = g["ab"].lower()
        by = ZONES_BY_COUNTRY.get((locale or "").rpartition("-")[2], {})
        off = by.get(ab, ZONES.get(ab))
        return None if off is None else local - off * 60
    return local_to_utc(local, zone) if zone else None


def iso_utc(epoch: int) -> str:
    days, rest = divmod(epoch, 86400)
    y, m, d = civil_from_days(days)
    return f"{y:04d}-{m:02d}-{d:02d}T{rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}Z"
