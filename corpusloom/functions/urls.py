"""Addresses as columns: canonical form, dedupe keys, scope, patterns and scores."""

from __future__ import annotations

import fnmatch
import posixpath
import re
from functools import reduce
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters that track visitors or sessions, and prefixes of such.
TRACKING_PREFIXES = ("utm_", "mc_", "pk_", "vero_")
TRACKING_NAMES = "_ga _gl _hsenc _hsmi dm_i fbclid gclid gbraid hs_amp igshid mkt_tok msclkid oly_anon_id oly_enc_id rb_clickid s_cid wickedid wbraid yclid".split()
SESSION_NAMES = "jsessionid phpsessid session session_id sessionid".split()
_DEFAULT_PORT = {"http": 80, "https": 443}


def is_tracking(name: str) -> bool:
    n = name.strip().lower()
    return n in TRACKING_NAMES or n in SESSION_NAMES or n.startswith(TRACKING_PREFIXES)


def normalize_url_text(url: str, drop_tracking: bool = False, keep_blank: bool = False, keep_fragment: bool = False, sort_query: bool = True) -> str | None:
    """One address in canonical form; None where its host or port is none. Escapes in the path are escaped again."""
    try:
        p = urlsplit(url.strip())
        host = (p.hostname or "").encode("idna").decode("ascii").lower() if p.hostname else ""
        port = p.port
    except (ValueError, UnicodeError):
        return None
    user = p.netloc.rpartition("@")[0]
    scheme = p.scheme.lower()
    place = (user + "@" if user else "") + (f"[{host}]" if ":" in host else host) + (f":{port}" if port and port != _DEFAULT_PORT.get(scheme) else "")
    raw = p.path.rpartition(";")[0] if ";" in p.path.rpartition("/")[2] else p.path
    path = re.sub(r"/{2,}", "/", raw or "/")
    flat = posixpath.normpath(path)
    flat = flat if flat != "." else "/"
    if path.endswith("/") and not flat.endswith("/"):
        flat += "/"
    if not flat.startswith("/"):
        flat = "/" + flat
    path = quote(flat, safe="/:@!$&'()*+,;=-._~")
    pairs = [(k.strip().lower(), v) for k, v in parse_qsl(p.query, keep_blank_values=True)]
    pairs = [(k, v) for k, v in pairs if (keep_blank or v) and not (drop_tracking and is_tracking(k))]
    query = urlencode(sorted(pairs) if sort_query else pairs)
    return f"{scheme}://{place}{path}" + (f"?{query}" if query else "") + (f"#{p.fragment}" if keep_fragment and p.fragment else "")


@F.pandas_udf(T.StringType())
def _key_udf(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else normalize_url_text(u, drop_tracking=True))


def url_parts(url: Column) -> Column:
    """struct(scheme, host, path, query) of an address, lower-cased where case plays no part."""
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
    )


def _plain_key(url: Column) -> Column:
    """The dedupe key of plain addresses, in built-in expressions."""
    p = url_parts(url)
    path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "/{2,}", "/")
    pair = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring_index(x, "=", -1)).otherwise("").alias("v")))
    keep = F.filter(pair, lambda x: (x["v"] != "") & ~x["k"].isin(*TRACKING_NAMES, *SESSION_NAMES) & ~x["k"].rlike("^(utm_|mc_|pk_|vero_)"))
    query = F.array_join(F.transform(F.array_sort(keep), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return F.concat(p["scheme"], F.lit("://"), p["host"], path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


#: Addresses that the built-in expressions treat as the general rule does: no escapes, dot segments, ports, users, or characters that must be quoted.
PLAIN = r"^[A-Za-z]+://[A-Za-z0-9.\-]+(?:/(?!\.{1,2}(?:/|[?#]|$))[A-Za-z0-9._~\-]*)*(?:\?(?:[A-Za-z0-9._~\-]*(?:=[A-Za-z0-9._~\-]*)?&?)*)?(?:#.*)?$"


def url_key(url: Column) -> Column:
    """Dedupe key: canonical address without tracking parameters, blank values and fragment, its parameters sorted. Null stays null, and so does what has no valid host.

    Plain addresses never leave the JVM; only the others go through Arrow.
    """
    plain = url.rlike(PLAIN)
    return F.when(plain, _plain_key(url)).otherwise(_key_udf(F.when(~plain, url)))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)(\?|$)", "$1/$2")


def canonical_key(url: Column, canonical: Column) -> Column:
    """Key of the canonical address where that is of the same host but for a leading www., else of the address."""
    bare = lambda c: F.regexp_replace(url_parts(c)["host"], r"^www\.", "")
    return F.when((F.coalesce(canonical, F.lit("")) != "") & (bare(url) == bare(canonical)), url_key(canonical)).otherwise(url_key(url))


def same_scope(url: Column, base: str, subdomains: bool = False, allowed: list[str] | None = None) -> Column:
    """Whether the host is the base, an allowed domain or below one; below the base only with subdomains."""
    host = url_parts(url)["host"]
    doms = sorted({(urlsplit(d).netloc if "://" in d else d).lower() for d in allowed or [] if d})
    tests = [host == base.lower()] + [host == d for d in doms] + [F.endswith(host, F.lit("." + d)) for d in doms]
    if subdomains:
        tests.append(F.endswith(host, F.lit("." + base.lower())))
    return (host != "") & reduce(lambda a, b: a | b, tests)


def _compiles(p: str) -> bool:
    try:
        re.compile(p)
    except re.error:
        return False
    return True


def matches(url: Column, patterns: list[str], mode: str = "auto") -> Column:
    """Whether any pattern fits: substring, glob or regex; auto tries glob, then regex, then substring where the regex is none. No pattern fits all."""
    if not patterns:
        return F.lit(True)

    def one(p: str) -> Column:
        glob = url.rlike("(?s)^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$")
        if mode == "substring":
            return F.contains(url, F.lit(p))
        if mode == "glob":
            return glob
        if mode == "regex":
            return url.rlike(p) if _compiles(p) else F.lit(False)
        return glob | (url.rlike(p) if _compiles(p) else F.contains(url, F.lit(p)))

    return reduce(lambda a, b: a | b, [one(p) for p in patterns])


def url_score(url: Column, query: str) -> Column:
    """1 for each query token in the address, and a half where it is in the address with - and _ as /."""
    toks = re.sub("[/-]", " ", query).lower().split()
    low = F.lower(url)
    soft = F.translate(low, "-_", "//")
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(t)), 1.0).otherwise(0.0) + F.when(F.contains(soft, F.lit(t)), 0.5).otherwise(0.0) for t in toks], F.lit(0.0))
