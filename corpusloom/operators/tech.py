"""Technology fingerprints: a catalogue of rules becomes a table, signals of pages another, and evidence is their join."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.dom import parse
from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

_RULE = "tech string, channel string, key string, pattern string, token string, confidence int, version string"


#: Groups of a pattern that a version may name.
GROUPS = 9


def compile_rule(raw: str) -> tuple[str, str, int, str] | None:
    r"""(pattern, token, confidence, version template) of `pattern\;confidence:NN\;version:\1`; None where the pattern is no regex.

    Empty parts are dropped first. The token is the longest literal-looking run of three or more characters, which a value must hold.
    """
    parts = [p for p in raw.split("\\;") if p]
    pattern = parts[0] if parts else ""
    conf, version = 100, ""
    for p in parts[1:]:
        k, _, v = p.partition(":")
        if k == "confidence" and v.isdigit():
            conf = max(1, int(v))
        elif k == "version":
            version = v
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return None
    version = re.sub(r"\\([1-9])", lambda m: m.group(0) if int(m.group(1)) <= groups else "", version)
    runs = re.findall(r"[A-Za-z0-9_]{3,}", re.sub(r"\\.|\[[^\]]*\]|\(\?[^)]*\)|\{[^}]*\}", " ", pattern))
    return pattern, max(runs, key=len, default="").lower(), conf, version


def rules_table(spark: SparkSession, catalog: dict) -> tuple[DataFrame, DataFrame]:
    """(rules, implies) of a catalogue {technologies: {name: {html, scripts, url, headers, cookies, meta, implies}}}."""
    rules, implies = [], []
    listed = lambda v: [v] if isinstance(v, str) else list(v or [])
    for name, d in catalog.get("technologies", {}).items():
        for channel in ("html", "scripts", "url"):
            for raw in listed(d.get(channel)):
                if r := compile_rule(raw):
                    rules.append((name, channel, "", *r))
        for channel in ("headers", "cookies", "meta"):
            for k, raws in (d.get(channel) or {}).items():
                for raw in listed(raws) or [""]:
                    if r := compile_rule(raw):
                        rules.append((name, channel, k.lower(), *r))
        implies.extend((name, i.split("\\;")[0]) for i in listed(d.get("implies")))
    return spark.createDataFrame(rules, _RULE), spark.createDataFrame(implies, "tech string, implied string")


def signals(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, channel, key, value): what the rules look at. pages: id, url, html, headers."""

    def one(rid, url, html):  # noqa: ANN001, ANN202
        d = parse(html)
        out = [(rid, "scripts", "", n.get("src")) for n in d.find_all("script") if n.get("src")]
        for m in d.find_all("meta"):
            out.extend((rid, "meta", m.get(a).lower(), m.get("content")) for a in ("name", "property", "http-equiv") if m.get(a))
        return out

    kind = pages.schema[id_col].dataType.simpleString()
    parsed = map_rows(pages.select(id_col, "url", "html"), f"{id_col} {kind}, channel string, key string, value string", one)
    plain = lambda ch, c: pages.select(id_col, F.lit(ch).alias("channel"), F.lit("").alias("key"), F.col(c).alias("value"))
    head = pages.select(id_col, F.explode("headers").alias("k", "value")).select(id_col, F.lit("headers").alias("channel"), F.lower("k").alias("key"), "value")
    cookie = head.where("key = 'set-cookie'").select(id_col, F.lit("cookies").alias("channel"), F.lower(F.trim(F.split_part("value", F.lit("="), F.lit(1)))).alias("key"), F.split_part(F.split_part("value", F.lit(";"), F.lit(1)), F.lit("="), F.lit(2)).alias("value"))
    small = parsed.unionByName(head).unionByName(cookie).distinct()  # html itself is never shuffled
    return small.unionByName(plain("url", "url")).unionByName(plain("html", "html")).where("value is not null")


def fingerprint(pages: DataFrame, rules: DataFrame, implies: DataFrame, aggression: int = 3, id_col: str = "page_id") -> DataFrame:
    """(id, tech, confidence, version, matched_on): evidence added up to 100, versions sorted, and what technologies imply with confidence 100.

    url, headers, cookies and meta always count, scripts from aggression 2, html from 3. Rules and signals are
    equi-joined on channel and key; the rule side is a catalogue, and the planner broadcasts it by its size.
    """
    use = ["url", "headers", "cookies", "meta"] + (["scripts"] if aggression >= 2 else []) + (["html"] if aggression >= 3 else [])
    s = signals(pages, id_col).where(F.col("channel").isin(use))
    j = s.join(rules, ["channel", "key"]).where((F.col("token") == "") | F.contains(F.lower("value"), F.col("token")))
    hit = j.where(F.expr("rlike(value, concat('(?iu)', pattern))"))
    named = r"aggregate(sequence(1, {}), version, (v, i) -> if(contains(v, concat('\\', i)), replace(v, concat('\\', i), regexp_extract(value, concat('(?iu)', pattern), i)), v))"
    ver = F.when(F.contains("version", F.lit("\\")), F.expr(named.format(GROUPS))).otherwise(F.col("version"))
    got = hit.withColumn("v", ver).groupBy(id_col, "tech").agg(F.least(F.lit(100), F.sum("confidence")).cast("int").alias("confidence"), F.element_at(F.concat(F.array_sort(F.collect_set(F.nullif("v", F.lit("")))), F.array(F.lit(""))), 1).alias("version"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("matched_on"))
    got = materialize(got)
    out, level = got, got.select(id_col, "tech")
    while True:
        level = materialize(level.join(implies, "tech").select(id_col, F.col("implied").alias("tech")).distinct().join(out.select(id_col, "tech"), [id_col, "tech"], "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level.select(id_col, "tech", F.lit(100).alias("confidence"), F.lit("").alias("version"), F.lit("implied").alias("matched_on")))
    return out


def grep(pages: DataFrame, text: str | None = None, regex: str | None = None, column: str = "html") -> DataFrame:
    """Pages whose column holds the text or fits the regex; null columns do not."""
    c = F.col(column)
    tests = ([F.contains(F.lower(c), F.lit(text.lower()))] if text else []) + ([c.rlike("(?i)" + regex)] if regex else [])
    return pages.where(tests[0] if len(tests) == 1 else tests[0] | tests[1]) if tests else pages.limit(0)


def search_catalog(spark: SparkSession, catalog: dict, search: str | None = None, limit: int = 50) -> DataFrame:
    """(name, website, categories) whose name, website or categories hold the text, by name."""
    cats = catalog.get("categories", {})
    rows = [(n, d.get("website", ""), ",".join(cats.get(str(c), {}).get("name", str(c)) for c in d.get("cats", []))) for n, d in catalog.get("technologies", {}).items()]
    df = spark.createDataFrame(rows, "name string, website string, categories string")
    return (df.where(F.contains(F.lower(F.concat_ws(" ", "name", "website", "categories")), F.lit(search.lower()))) if search else df).orderBy(F.lower("name")).limit(limit)


def parse_plugin(text: str) -> dict | None:
    """Name, version and match rules of a signature plugin in Ruby syntax; None where it defines none."""
    name = re.search(r"\bname\s+[\"']([^\"']+)", text)
    block = re.search(r"matches\s+\[(.*?)^\s*\]", text, re.S | re.M)
    if not name and not block:
        return None
    field = lambda e, k: next((m.group(2) for m in [re.search(rf":{k}\s*=>\s*([\"'])((?:\\.|(?!\1).)*)\1", e)] if m), "")
    rules = []
    for e in re.findall(r"\{(.*?)\}\s*,?\s*(?=\{|$|#|\n)", block.group(1) if block else "", re.S):
        rx = re.search(r":(?:regexp|version)\s*=>\s*/((?:\\.|[^/])+)/", e)
        pattern, kind = (rx.group(1), "regex") if rx else (re.escape(field(e, "text")), "text")
        if field(e, "md5"):
            pattern, kind = field(e, "md5"), "md5"
        sure = re.search(r":certainty\s*=>\s*(\d+)", e)
        if pattern:
            rules.append({"context": field(e, "search") or "body", "pattern": pattern, "type": kind, "certainty": int(sure.group(1)) if sure else 100, "url": field(e, "url"), "name": field(e, "name")})
    ver = re.search(r"\bversion\s+[\"']([^\"']+)", text)
    return {"name": name.group(1) if name else "", "plugin_version": ver.group(1) if ver else "", "rules": rules}


def import_plugins(spark: SparkSession, folder: str) -> DataFrame:
    """(path, disabled, name, plugin_version, rules as JSON): the plugin files under a folder, read by the executors."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")

    def one(path, text):  # noqa: ANN001, ANN202
        p = parse_plugin(text or "")
        return [(path, "disabled" in path.lower(), p["name"], p["plugin_version"], json.dumps(p["rules"]))] if p else []

    return map_rows(files, "path string, disabled boolean, name string, plugin_version string, rules string", one)
