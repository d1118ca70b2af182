"""Rules about responses as columns: block detection, retries, throttling, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# States and marks of blocked responses.
BLOCK_STATUS = (403, 429, 503, 520, 521, 522, 523, 524, 525, 526, 527, 528, 529, 530)
BODY_MARKS = ("__cf_bm", "captcha", "cf-challenge", "cf-turnstile", "challenge-platform", "cloudflare", "data-sitekey", "ddos protection", "g-recaptcha", "hcaptcha", "datadome", "enable javascript and cookies")
TITLE_MARKS = ("access denied", "attention required", "forbidden", "just a moment", "security check", "verify you are human")
SERVERS = ("cloudflare", "akamai", "imperva", "ddos-guard")
SERVER_WORDS = ("captcha", "forbidden", "access denied", "just a moment", "verify")
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def block_reason(status: Column, html: Column, server: Column | None = None) -> Column:
    """First sign that a response is a block or challenge; null for none. Null status and html count as absent and empty."""
    low = F.lower(F.coalesce(html, F.lit("")))
    srv = F.lower(F.coalesce(server, F.lit(""))) if server is not None else F.lit("")

    def marked(body: Column) -> Column:
        holds = {m: F.contains(body, F.lit(m)) for m in (*TITLE_MARKS, *BODY_MARKS, *SERVER_WORDS)}
        out = F.when(~body.rlike(r"\S"), F.lit("empty_body"))
        said = reduce(lambda a, b: a | b, [holds[w] for w in SERVER_WORDS])
        for s in SERVERS:
            out = out.when(F.contains(srv, F.lit(s)) & said, F.lit(f"server_challenge:{s}"))
        for m in TITLE_MARKS:
            out = out.when(holds[m] & body.rlike(rf"<title>\s*(?:\d+\s+)?{m}\b|<h1[^>]*>\s*(?:\d+\s+)?{m}\b"), F.lit(f"body_marker:{m}"))
        for m in BODY_MARKS:
            out = out.when(holds[m], F.lit(f"body_marker:{m}"))
        return out

    return F.when(status.isin(*BLOCK_STATUS) | (status >= 500), F.concat(F.lit("http_status:"), status)).otherwise(let(low, marked))


def should_retry(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False))


def backoff_ms(attempt: Column, base: int = 500) -> Column:
    return (F.lit(max(0, base)) * F.pow(F.lit(2), attempt)).cast("long")


def retry_after_ms(headers: Column) -> Column:
    """Seconds of a Retry-After header in milliseconds, at least 0; null where it is no number."""
    v = F.coalesce(headers["retry-after"], headers["Retry-After"])
    return F.greatest(F.lit(0), (F.try_cast(F.trim(v), "double") if hasattr(F, "try_cast") else v.try_cast("double")) * 1000).cast("long")


def throttle_ms(elapsed: Column, minimum: int = 0, maximum: int = 5000) -> Column:
    """Aggregate: half the mean time, within bounds; the minimum for no rows."""
    return F.greatest(F.lit(minimum), F.least(F.lit(maximum), F.coalesce((F.avg(elapsed) * 0.5).cast("int"), F.lit(minimum))))


def autoscale(current: Column, cpu: Column, memory: Column, low: int = 1, high: int = 8, cpu_target: float = 75.0, memory_target: float = 80.0) -> Column:
    """struct(value, action): one step down when overloaded by 10, one up when 20 below both targets, else the same, within bounds."""
    over = (cpu >= cpu_target + 10) | (memory >= memory_target + 10)
    under = (cpu <= cpu_target - 20) & (memory <= memory_target - 20)
    down, up = F.greatest(F.lit(low), current - 1), F.least(F.lit(high), current + 1)
    value = F.when(over, down).when(under, up).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), current)))
    action = F.when(over & (down < current), "decrease").when(~over & under & (up > current), "increase").otherwise("keep")
    return F.struct(value.cast("int").alias("value"), action.alias("action"))
