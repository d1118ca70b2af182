"""Operators for training data: brute force, round trips and held-out accuracy on small tables; null, empty, long and repeated inputs."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, errorpages, leakage, lines, names, neardup, packing, pii, residue
from corpusloom.llm.blocks import html_blocks, markdown_blocks
from corpusloom.llm.pii_labels import labelled_sentences

PAGES = "kind string, id long, host string, source string, extra int"
WORDS = [a + b for a in "ba ko mi ne ru sa to vu".split() for b in "lan mer tis dok pel gun".split()]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def md(r, title, body, extra=""):
    return f"# {title}\n\nBy Some Writer\n\n" + "\n\n".join(body) + f"\n\nPrint this page\n\nTags: {r.choice(WORDS)}, {r.choice(WORDS)}\n\n© {r.randint(2000, 2024)} Site. All rights reserved.{extra}"


@pytest.fixture(scope="module")
def site():
    r = random.Random(7)
    return [("markdown", i, "h.example", md(r, prose(r, 4)[:-1] + str(i), [prose(r, 30) for _ in range(4)]), 0) for i in range(12)]


def test_blocks_number_tags_in_source_order():
    _, b, _ = html_blocks("<body><ul><LI>a<li>b</ul><p>c<p>d<h1>e</h1><script>'<p>'</script><!-- <p> --><p></p>")
    assert [(x.tag, x.pos, x.text) for x in b] == [("li", 1, "a"), ("li", 2, "b"), ("p", 3, "c"), ("p", 4, "d"), ("h1", 5, "e"), ("p", 6, "")]
    m = markdown_blocks("# t\n\na\nb\n\n```\nx\n\ny\n```\n- l")
    assert [(x.tag, x.pos, x.path) for x in m] == [("h1", 1, "1"), ("p", 3, "4"), ("pre", 6, "10"), ("li", 11, "11")]


def test_boilerplate(spark, site):
    rows = [*site, ("markdown", 90, "h.example", None, 0), ("markdown", 91, None, "", 0), ("html", 92, "h.example", "{}", 0), site[0]]
    got = {(r.id, r.pos) for r in boilerplate.boilerplate_positions(spark.createDataFrame(rows, PAGES)).collect()}
    for _, i, _, text, _ in site:
        marks = [n for n, x in enumerate(text.split("\n"), 1) if x.startswith(("By ", "Print", "Tags", "©"))]
        assert {p for k, p in got if k == i} == set(marks)
    assert not {k for k, _ in got} & {90, 91, 92}
    assert boilerplate.boilerplate_positions(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("text", "form", "want"),
    [
        ("see [[a|b]] here", "markdown", ["wiki"]),
        ("{{cite web|title=x|year=2}}", "html", ["wiki"]),
        ("{{ user.name }} and __PRICE__ and {0}", "html", []),
        ("\\textbf{x} y", "html", ["latex"]),
        ("cost $5 and $12, C:\\temp\\x, rows [1] and [2], a < b and b > 3, max_page_limit, 3 ** 4", "html", []),
        ("$x_{3} \\leq \\alpha$", "markdown", ["latex"]),
        ("a <b>c</b> &amp; d", "markdown", ["html"]),
        ("**x y** and ~~z~~", "html", ["markdown"]),
        ("**x y** and ~~z~~", "markdown", []),
    ],
)
def test_markup_kinds(text, form, want):
    assert residue.markup_kinds(text, form) == want


def test_residue_and_clean(spark, site):
    rows = [*site[:3], ("markdown", 50, "h.example", "# t\n\nA [[b|c]] d.\n\n`[[code]]`\n\n```\n[[x]]\n```", 0), ("page_data", 51, "h.example", '{"html": "<p>A \\\\emph{b} c"}', 0), ("page_data", 52, None, '{"html": ', 0)]
    df = spark.createDataFrame(rows, PAGES)
    assert {(r.kind, r.id, r.markup) for r in residue.markup_residue(df).collect()} == {("markdown", 50, "wiki"), ("page_data", 51, "latex")}
    t = {r.id: r.text for r in residue.clean_documents(df).collect()}
    assert "A c d." in t[50] and "```" in t[50] and t[51] == "A b c"


def test_repeated_lines(spark):
    r = random.Random(2)
    rows = [(i, f"https://{h}/x", h, "\n".join(["Share 3 times", prose(r, 6)] + (["Rare line"] if i < 4 else []))) for i, h in enumerate(["a.example"] * 9 + ["b.example"] * 3)]
    rows += [rows[0], (90, "https://a.example/", None, None), (91, None, None, "Share 4 times")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, markdown string")
    assert {(x.host, x.line_key) for x in lines.repeated_lines(df).collect()} == {("a.example", "share 0 times")}
    out = {x.page_id: (x.text, x.removed) for x in lines.strip_repeated_lines(df).collect()}
    assert out[0][1] == 1 and "Share" not in out[0][0] and out[9][1] == 0 and out[90] == (None, 0)


def test_error_pages(spark, site):
    schema = "kind string, id long, host string, url string, status int, source string"
    ok = [(k, i, h, f"https://{h}/{i}", 200, s) for k, i, h, s, _ in site]
    bad = [("markdown", 100, "h.example", "https://h.example/x", 200, "# Page not found\n\nThe address does not exist."), ("markdown", 101, "h.example", "u", None, site[0][3].replace("# ", "# {{ page.title }} ")), ("markdown", 102, "h.example", "u", None, site[1][3] + "\n\nLorem ipsum dolor sit amet elit sed do eiusmod tempor.")]
    talk = [("markdown", 103, "h.example", "u", 200, site[2][3].replace(".", ". Printers used lorem ipsum, and a 404 page not found.", 1)), ("markdown", 104, None, None, None, None)]
    got = {r.id for r in errorpages.unusable_pages(spark.createDataFrame([*ok, *bad, *talk], schema)).collect()}
    assert got == {100, 101, 102}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    base = [[prose(r, 12) for _ in range(8)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for k in (1, 2, 4):
            c = list(b)
            for i in r.sample(range(8), k):
                c[i] = prose(r, 12)
            texts.append(c)
    texts.append(texts[0])
    rows = [("markdown", i, f"h{i % 3}.example", f"# {i % 4} t\n\n" + "\n\n".join(t), 0) for i, t in enumerate(texts)]
    rows += [("markdown", 900, None, "short", 0), ("markdown", 901, None, None, 0)]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, PAGES), 0.6, 3, 40)
    got = {(x.id_a, x.id_b) for x in neardup.duplicate_pairs(members, links).collect()}

    def grams(row):
        w = residue.re.findall(r"[^\W_]+", row[3].lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    g = [grams(x) for x in rows[: len(texts)]]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(g[a] & g[b]) >= 0.6 * len(g[a] | g[b])}
    assert got == want
    classes = {x.id: x for x in neardup.duplicate_classes(members, links).collect()}
    assert len(classes) == len(texts)


def test_signature_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        n = 400
        both = int(2 * n * j / (1 + j))
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = np.concatenate((a[:both], rng.integers(0, 1 << 32, n - both, dtype=np.uint32)))
        assert abs(neardup.estimate(neardup.signature(a), neardup.signature(b), n, n) - j) < 0.17


@pytest.mark.parametrize(
    ("author", "want"),
    [
        ("By Leonard K. Melbarmel", ("p", ["leonard", "melbarmel"], ["k"])),
        ("MELBARMEL, K.", ("p", ["melbarmel"], ["k"])),
        ("HP Telbartel", ("p", ["telbartel"], ["h", "p"])),
        ("Dr. Zoë Ostrabfro (Editor)", ("p", ["ostrabfro", "zoe"], [])),
        ("The Osthaltab Editorial Desk", ("o", ["desk", "editorial", "osthaltab"], [])),
        ("A Writer and B Other", None),
        ("admin", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_name(author, want):
    assert names.parse_name(author) == want


def test_name_variants(spark):
    forms = ["Leonard Melbarmel", "By Leonard Melbarmel", "Melbarmel, Leo", "L. Melbarmel", "Leonard Mellbarmel", "LEONARD MELBARMEL"]
    others = ["Katherine Melbarmel", "Kate Melbarmel", "MELBARMEL, K."]
    rows = [("h", a, 1) for a in forms + others + forms] + [("g", forms[0], 1), (None, forms[0], 1), ("h", None, 1), ("h", "admin", 1), ("h", "Leonard Melbarmel and Kate Melbarmel", 1)]
    got = {(x.host, x.author_a, x.author_b) for x in names.variant_pairs(names.name_variants(spark.createDataFrame(rows, "host string, author string, entity int"))).collect()}
    want = {("h", *sorted(p)) for g in (forms, others) for p in itertools.combinations(g, 2)}
    assert got == want


def test_lcs_against_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert names.lcs(a, b) == t[-1][-1]


def test_leakage_against_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 7, 30])]
    docs = []
    for k in range(60):
        w = [r.choice(WORDS) for _ in range(60)]
        _, t = items[k % 6]
        t = t.split()
        a = r.randint(0, max(0, len(t) - 9))
        piece = t[a : a + r.choice([8, 9, 10, 11])] if len(t) > 9 else t[: r.choice([len(t), len(t) - 1])]
        docs.append((k, " ".join(w[:20]) + ",\n" + ", ".join(piece).upper() + " " + " ".join(w[20:])))
    docs += [(900, None), (901, ""), docs[0]]

    def runs(t, n):
        w = residue.re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t in docs if t for i, x in items for n in [min(10, len(x.split()))] if runs(t, n) & runs(x, n)}
    got = {(x.doc_id, x.item_id) for x in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and got


def test_packing(spark):
    r = random.Random(8)
    rows = [(i, r.randint(1, 900)) for i in range(500)] + [(1000, 5000), (1001, 0), (1002, None), (1003, 2048), (0, 1)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens int"), 2048).collect()
    by, load = {}, {}
    for x in out:
        by[x.doc_id] = by.get(x.doc_id, 0) + x.size
        load[x.container] = load.get(x.container, 0) + x.size
    want = {i: max(n or 0 for j, n in rows if j == i) for i, _ in rows}
    assert by == want and max(load.values()) <= 2048 and all(load[x.container] == x.load for x in out)
    assert all(x.piece == 1 for x in out if want[x.doc_id] <= 2048)
    assert len(load) <= -(-sum(want.values()) // 2048) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), 10).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_token_sizes(spark):
    got = {r.doc_id: r.tokens for r in packing.token_sizes(spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_personal_data_held_out(spark):
    rows = labelled_sentences(600, seed=123)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(9000, None), (9001, "")], "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.value) for r in pii.personal_data(df).collect()}
    want = {(i, k, t[a:b]) for i, (t, s) in enumerate(rows) for a, b, k in s}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    red = {r.doc_id: r.text for r in pii.personal_data(df, redact=True).collect()}
    assert len(red) == len(rows) + 2 and red[9000] is None
    i, (t, s) = next((i, x) for i, x in enumerate(rows) if len(x[1]) == 1 and (i, x[1][0][2], x[0][x[1][0][0] : x[1][0][1]]) in got)
    a, b, k = s[0]
    assert red[i] == t[:a] + f"[{k.upper()}]" + t[b:]


def test_long_text(spark):
    r = random.Random(1)
    long = " ".join(prose(r, 15) for _ in range(20_000)) + " Contact Hannah Telbartel at h@t.example now."
    got = {(x.kind, x.value) for x in pii.personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()}
    assert {("person_name", "Hannah Telbartel"), ("email", "h@t.example")} <= got


def test_sql_keys():
    from corpusloom.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert F is not None


def test_names_with_capitals_of_any_alphabet_are_decoded():
    from corpusloom.llm import pii

    texts = ["Contact Łukasz Żak for details.", "el archivo y Plaafal"]
    assert [[(t[s:e], k) for s, e, k in f] for t, f in zip(texts, pii.mentions(texts, pii.tagger()))] == [[("Łukasz Żak", "person_name")], []]
