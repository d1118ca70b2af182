"""Variant spellings of names: suffix blocking on tokens, comparison by longest-common-subsequence ratio, one entity per hub spelling."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

#: Shortest suffix in the index, and most spellings a suffix may block before it is refined by the other tokens' initials.
MIN_SUFFIX, COMMON = 3, 40
#: Least LCS ratio of two whole names of which both parts differ.
RATIO = 0.8
#: A token is an own name, not a typo of another, when it stands in so many spellings of the host.
ESTABLISHED = 3

# Short forms of given names.
NICKNAMES = {
    "al": "albert alan alexander", "alex": "alexander alexandra alexis", "andy": "andrew andreas", "annie": "anne anna", "ben": "benjamin", "bert": "albert herbert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine", "charlie": "charles charlotte", "chris": "christopher christian christine", "dan": "daniel daniela",
    "dani": "daniela daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "dick": "richard", "don": "donald", "ed": "edward edgar edmund", "eddie": "edward", "eliza": "elizabeth", "ella": "eleanor", "fran": "frances francis",
    "fred": "frederick alfred", "freddie": "frederick", "gabi": "gabriela gabriele", "gabby": "gabriela gabrielle", "gabe": "gabriel", "greg": "gregory", "hal": "henry harold", "hank": "henry", "hans": "johannes", "harry": "henry harold", "hetty": "henrietta",
    "etta": "henrietta", "jack": "john", "jake": "jacob", "jamie": "james", "jan": "janet johannes", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan",
    "johnny": "john", "josh": "joshua", "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard leopold", "liz": "elizabeth",
    "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret margarete", "matt": "matthew", "max": "maximilian maxwell", "mike": "michael", "mick": "michael", "mickey": "michael", "nate": "nathan nathaniel", "ned": "edward",
    "nick": "nicholas", "nico": "nicholas", "ollie": "oliver", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "paco": "francisco", "pepe": "jose", "pete": "peter", "phil": "philip philippa", "pip": "philippa philip", "pippa": "philippa", "quin": "quentin", "ray": "raymond",
    "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "ross": "roswell", "sam": "samuel samantha", "sandy": "alexander sandra", "sasha": "alexander", "sepp": "josef", "steve": "stephen steven", "sue": "susan susanna", "susi": "susanna", "susie": "susan susanna", "suzy": "susanna",
    "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tony": "anthony antonio", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vince": "vincent", "vinnie": "vincent", "walt": "walter", "wes": "wesley", "will": "william", "willy": "william",
    "oz": "oscar", "ossie": "oscar", "inga": "ingrid", "inge": "ingrid", "hanna": "hannah", "yus": "yusuf", "bjorn": "bjoern",
}
# Words of organisations' names, of their legal forms, of titles and roles, and of bylines that name nobody.
ORG_WORDS = frozenset("agency association bureau center centre club co collective committee company corporation council department desk editors foundation group institute journal lab labs laboratory magazine media ministry network news office organization press redaktion rédaction redaccion research service services society staff studio studios team trust union university verlag".split())
LEGAL = frozenset("inc ltd llc llp gmbh ag sa sarl sl plc corp limited bv kg ug co company incorporated".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame herr frau mme mlle monsieur madame sr sra señor señora don doña ing dipl".split())
GENERIC = frozenset("admin administrator webmaster editor editors editorial staff guest author anonymous unknown user test root moderator team redaktion rédaction redaction redacción none null na n/a website system contributor writer reporter".split())
_LEAD = re.compile(r"^\s*(?:(?:written|posted|words|text|texte|story|reported)\s*(?:by|von|de|:)|by|von|par|por)\s*:?\s+", re.I)
_TWO = re.compile(r"\s+(?:and|und|et|y|e|with|mit|avec|con)\s+|\s*[&;/]\s*|\s\+\s", re.I)


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("æ", "ae"))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def parse_name(author: str | None) -> tuple[str, list[str], list[str]] | None:
    """(kind p or o, full tokens, initials) of an author string; None for null, empty and generic ones and for strings that name two.

    Bylines' lead-ins, titles, roles in brackets, what follows a bar, trailing numbers and legal forms are dropped; a
    nickname in quotes is dropped beside the full name. Tokens are sorted, as parts may come in any order.
    """
    if not author:
        return None
    s = unescape(author).replace(" ", " ").split("|")[0]
    s = re.sub(r"[\[(][^\])]*[\])]", " ", s)
    s = _LEAD.sub("", " ".join(s.split()))
    s = re.sub(r"[“\"«„‘][^”\"»“’]*[”\"»“’]", " ", s)
    s = re.sub(r"\S+@(\S+)", " ", s) if "@" in s else s
    if _TWO.search(s.strip()):
        return None
    words = [w for w in re.split(r"[\s,]+", re.sub(r"([^\W\d_])\.(?=[^\W\d_])", r"\1. ", s)) if w]
    low = [fold(w).strip(".'’-") for w in words]
    if any(x in ORG_WORDS for w in low for x in w.split("-")) or re.search(r"(?:Press|Media|News|Research|Data|Editorial)(?:[A-Z]|$| )", s):
        parts = [p for w in words for p in re.split(r"[-]+|(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", w)]
        toks = [fold(p).strip(".'’") for p in parts]
        toks = [t for i, t in enumerate(toks) if t and not (t in LEGAL and i == len(toks) - 1) and not (t in ("the", "die", "der", "das", "la", "le", "el", "les", "los") and i == 0)]
        toks = [t for t in toks if not t.isdigit()]
        return ("o", sorted(toks), []) if toks and not all(t in GENERIC or t in ORG_WORDS for t in toks) else None
    full, initials = [], []
    for w, t in zip(words, low):
        t = re.sub(r"\d+", "", t)
        bare = w.strip(".'’-")
        if not t or t in TITLES and not (len(bare) == 2 and bare.isupper()):
            continue
        if len(t) == 1:
            initials.append(t)
        elif len(bare) == 2 and bare.isupper() and len(words) > 1:
            initials.extend(t)
        else:
            full.append(t)
    if not full or all(t in GENERIC for t in full):
        return None
    return "p", sorted(full), initials


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def close(a: str, b: str, seen: dict[str, int]) -> bool:
    """Whether two tokens are one but for a slip: their LCS ratio is what one slip leaves of the longer; never two established names."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if n < 4 or lcs_ratio(a, b) < 1 - 1 / n - 1e-9:
        return False
    return not (seen.get(a, 0) >= ESTABLISHED and seen.get(b, 0) >= ESTABLISHED)


def _expand(t: str) -> set[str]:
    return {t, *NICKNAMES.get(t, "").split()}


def same_name(a: tuple[str, list[str], list[str]], b: tuple[str, list[str], list[str]], seen: dict[str, int]) -> int:
    """0: different; 1: an initial stands for a name; 2: both are full and agree."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    if len(x) >= 2 and len(y) >= 2 and a[2] and b[2] and a[2][0] != b[2][0]:  # middle initials that differ
        return 0
    if a[0] == "o":
        if len(x) == len(y):
            left = list(y)
            slips = 0
            for t in x:
                if t in left:
                    left.remove(t)
                else:
                    m = next((u for u in left if close(t, u, seen) or (min(len(t), len(u)) >= 3 and (t.startswith(u) or u.startswith(t)) and max(len(t), len(u)) <= len(min(t, u, key=len)) + 6 and (t in ORG_WORDS or u in ORG_WORDS))), None)
                    if m is None:
                        return 0
                    left.remove(m)
                    slips += 1
            return 2 if slips <= 1 else 0
        p, q = "".join(x), "".join(y)
        return 2 if sorted(p) == sorted(q) and abs(len(x) - len(y)) == 1 and lcs_ratio(p, q) >= 0.5 else 0
    if len(x) == len(y) == 2 and not (x == y):
        for u, v in ((y[0], y[1]), (y[1], y[0])):
            first = close(x[0], u, seen) or _expand(x[0]) & _expand(u)
            second = close(x[1], v, seen) or _expand(x[1]) & _expand(v)
            if first and second and (x[0] == u or x[1] == v or lcs_ratio(x[0] + x[1], u + v) >= RATIO or _expand(x[0]) & _expand(u) or _expand(x[1]) & _expand(v)):
                return 2
        return 0
    if x == y and len(x) >= 2:
        return 2
    if abs(len(x) - len(y)) == 1 and not a[2] and not b[2] and min(len(x), len(y)) == 1:
        one, two = (x, y) if len(x) == 1 else (y, x)
        if len(one[0]) >= 8 and one[0] in (two[0] + two[1], two[1] + two[0]):
            return 2
    # one side gives only the initial of the given name
    for short, ini, long_, ini2 in ((x, a[2], y, b[2]), (y, b[2], x, a[2])):
        if len(short) == 1 and ini:
            for i, t in enumerate(long_):
                if close(short[0], t, seen):
                    rest = [u for k, u in enumerate(long_) if k != i]
                    if rest:
                        if any(v[0] == ini[0] for u in rest for v in _expand(u)):
                            return 1
                    elif ini2 and ini2[0] == ini[0]:
                        return 1
    return 0


def _keys(kind: str, full: list[str], initials: list[str]) -> list[tuple[str, str, bool]]:
    """(suffix, refined suffix, whether it is a whole token) of a name's tokens, read from both ends. A token and a slip of it share one of at least half their length."""
    out = set()
    for i, t in enumerate(full):
        others = "".join(sorted({v[0] for k, u in enumerate(full) if k != i for v in _expand(u)} | set(initials[:1])))
        least = max(MIN_SUFFIX, (len(t) - 2) // 2)
        for w, tag in ((t, ">"), (t[::-1], "<")):
            for k in range(min(least, len(w)), len(w) + 1):
                s = tag + w[len(w) - k :]
                out.update((s, s + "|" + c, k == len(w)) for c in (others or "-"))
        for v in _expand(t):
            if v != t:
                out.update((">" + v, ">" + v + "|" + c, True) for c in (others or "-"))
    return list(out)


def _node(p: tuple[str, list[str], list[str]]) -> str:
    return f"{p[0]}|{' '.join(p[1])}|{' '.join(p[2][:1])}"


def _unnode(n: str) -> tuple[str, list[str], list[str]]:
    k, f, i = n.split("|")
    return k, f.split(), i.split()


def name_variants(articles: DataFrame, host_col: str = "host", author_col: str = "author") -> DataFrame:
    """(host, author, entity): each distinct author string of a host with the spelling its entity goes by.

    Spellings with the same parts are one node. Nodes that share a token suffix are compared; a suffix that blocks more
    than COMMON nodes is refined by the initials of the other tokens, and a refined suffix that is still common is
    discarded; whole tokens and longer suffixes are indexed too and whole tokens are never discarded. A node joins the hub (the full spelling with most support) it agrees with; initials that fit
    several hubs of a host stay apart, and so do full names with different middle initials. Null, empty and generic authors, strings that name two people, and null hosts
    give no rows; repeated rows count once.
    """
    raw = articles.select(F.col(host_col).alias("host"), F.col(author_col).alias("author")).where(F.col("host").isNotNull() & F.col("author").isNotNull()).distinct()

    def parsed(host, author):  # noqa: ANN001, ANN202
        p = parse_name(author)
        return [(host, author, _node(p), p[1])] if p else []

    names = materialize(map_rows(raw, "host string, author string, node string, tokens array<string>", parsed))
    nodes = names.groupBy("host", "node").agg(F.count("*").alias("support"), F.first("tokens").alias("tokens"))
    seen = nodes.select("host", "support", F.explode("tokens").alias("token")).groupBy("host", "token").agg(F.sum("support").alias("seen"))
    with_seen = nodes.select("host", "node", F.explode("tokens").alias("token")).join(seen, ["host", "token"]).groupBy("host", "node").agg(F.map_from_entries(F.collect_set(F.struct("token", "seen"))).alias("seen"))

    def keyed(host, node):  # noqa: ANN001, ANN202
        return [(host, node, s, r, w) for s, r, w in _keys(*_unnode(node))]

    keys = materialize(map_rows(nodes.select("host", "node"), "host string, node string, suffix string, refined string, whole boolean", keyed))
    common = keys.select("host", "suffix", "node").distinct().groupBy("host", "suffix").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("host", "suffix", F.lit(True).alias("common"))
    block = keys.join(common, ["host", "suffix"], "left").select("host", "node", "common", "whole", F.when(F.col("common"), F.col("refined")).otherwise(F.col("suffix")).alias("key")).distinct()
    still = block.where(F.col("common") & ~F.col("whole")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("host", "key")
    block = block.join(still.withColumn("drop", F.lit(True)), ["host", "key"], "left").where(F.col("whole") | F.col("drop").isNull()).select("host", "node", "key").distinct()
    x, y = block.alias("x"), block.alias("y")
    pairs = x.join(y, (F.col("x.host") == F.col("y.host")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.host").alias("host"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    s1 = with_seen.select("host", F.col("node").alias("a"), F.col("seen").alias("sa"))
    s2 = with_seen.select("host", F.col("node").alias("b"), F.col("seen").alias("sb"))

    def compared(host, a, b, sa, sb):  # noqa: ANN001, ANN202
        r = same_name(_unnode(a), _unnode(b), dict(sa or ()) | dict(sb or ()))
        return [(host, a, b, r)] if r else []

    links = map_rows(pairs.join(s1, ["host", "a"]).join(s2, ["host", "b"]).select("host", "a", "b", "sa", "sb"), "host string, a string, b string, strength int", compared)
    links = materialize(links)
    both = links.select("host", F.col("a").alias("node"), F.col("b").alias("to"), "strength").unionByName(links.select("host", F.col("b").alias("node"), F.col("a").alias("to"), "strength"))
    degree = both.where("strength = 2").groupBy("host", "node").agg(F.count("*").alias("degree"))
    rank = nodes.join(degree, ["host", "node"], "left").select("host", "node", F.struct("support", F.coalesce("degree", F.lit(0)).alias("degree")).alias("support"), F.when(F.size("tokens") >= 2, 1).otherwise(0).alias("whole"))
    to_rank = rank.select("host", F.col("node").alias("to"), F.col("support").alias("to_support"), F.col("whole").alias("to_whole"))
    b = both.join(rank, ["host", "node"]).join(to_rank, ["host", "to"])
    above = (F.col("to_whole") == 1) & ((F.col("whole") == 0) | (F.col("strength") == 2) & ((F.col("to_support") > F.col("support")) | (F.col("to_support") == F.col("support")) & (F.col("to") < F.col("node"))))
    b = materialize(b.withColumn("above", above))
    beaten = b.where("above").select("host", "node").distinct()
    hubs = rank.join(beaten, ["host", "node"], "left_anti").select("host", F.col("node").alias("to"))
    to_hub = b.where("above").join(hubs, ["host", "to"]).groupBy("host", "node").agg(F.count("*").alias("hubs"), F.max("strength").alias("best"), F.max_by("to", F.struct("strength", "to_support", "to")).alias("hub"), F.max("whole").alias("whole"))
    label = to_hub.where("hubs = 1 or whole = 1").select("host", "node", "hub")
    unclear = to_hub.where("hubs > 1 and whole = 0").select("host", "node", F.lit(True).alias("unclear"))
    whole = F.size(F.split(F.split("node", r"\|")[1], " ")) >= 2
    middle = F.split("node", r"\|")[2]
    placed = nodes.select("host", "node").join(label, ["host", "node"], "left").select("host", "node", F.coalesce("hub", "node").alias("entity"), F.when(whole, middle).otherwise("").alias("middle"))
    several = placed.where("middle <> ''").groupBy("host", "entity").agg(F.count_distinct("middle").alias("n")).where("n > 1").select("host", "entity", F.lit(True).alias("several"))
    placed = placed.join(several, ["host", "entity"], "left").select("host", "node", F.when(F.col("several") & (F.col("middle") != ""), F.concat_ws("|", "entity", "middle")).otherwise(F.col("entity")).alias("entity"))
    out = names.join(placed, ["host", "node"]).join(unclear, ["host", "node"], "left")
    return out.select("host", "author", F.when(F.col("unclear"), F.concat(F.lit("?|"), "author")).otherwise(F.col("entity")).alias("entity"))


def variant_pairs(variants: DataFrame) -> DataFrame:
    """(host, author_a, author_b) with author_a < author_b by code point: all pairs of spellings of one entity of a host."""
    x, y = variants.alias("x"), variants.alias("y")
    p = x.join(y, (F.col("x.host") == F.col("y.host")) & (F.col("x.entity") == F.col("y.entity")) & (F.col("x.author") < F.col("y.author")))
    return p.select(F.col("x.host").alias("host"), F.col("x.author").alias("author_a"), F.col("y.author").alias("author_b"))
