"""Pages, vectors, conversations and the pipeline."""

import hashlib
import math
import time

import numpy as np
import pytest
from conftest import DATA, normal
from pyspark.sql import functions as F

from histoplane.llm import chat, html_text, queries, vector_search, warc
from histoplane.llm.common import scratch_path


@pytest.mark.parametrize("name", ["op6_warc", "op8_exact_top_k", "op10_chat_format"])
def test_sql(spark, duck, name):
    assert normal(queries.QUERIES[name](spark, DATA).toPandas()) == normal(duck.sql(queries.ORACLE_SQL[name]).df())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this long and winding page of ours, dear reader.</div>
%s
<div id="comments"><p>First! What a long comment this is, longer than the text itself, with many words in it.</p></div>
<form><p>Search <input name=q></p></form><footer>&copy; 2024 A very long footer text that goes on and on for quite a while.</footer></body></html>"""


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<article><h1>Title</h1><p><b>Bold te<i>xt</i> &amp; more<br>next<p>Second\n  par&#233;<ul><li>x<li>y</ul><aside>no</aside></article>", "Title Bold text & more next Second paré x y"),
        ("<article><p>a", "a"),
        ("<div><p>Some text of the page here, not short at all.</p><p>And some more <a href=x>linked</a> text in it.</p></div>", "Some text of the page here, not short at all. And some more linked text in it."),
        ("<main><p>t1</p><div style='display:none'>hidden</div><p hidden>h</p></main>", "t1"),
        ("", ""),
    ],
)
def test_main_text(inner, want):
    assert html_text.main_text(PAGE % inner) == want


ARTICLE = "<article><h1>Title</h1><p>Some text of the page here, not short at all, as articles are.</p></article>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        (f'<div class="layout has-sidebar">{ARTICLE}<div class="sidebar">{"side " * 40}</div></div>', "Title Some text of the page here, not short at all, as articles are."),
        (f'<div id="search-page"><div class="header-form"><main><p>Some text of the page here, not short at all, as articles are.</p></main></div></div>', "Some text of the page here, not short at all, as articles are."),
        (f'<div class="has-sidebar">{ARTICLE}<div id="replies"><article>{"Reply. " * 60}</article></div></div>', "Title Some text of the page here, not short at all, as articles are."),
        (f'{ARTICLE}<div class="related"><article>{"Another story. " * 60}</article></div>', "Title Some text of the page here, not short at all, as articles are."),
        (f'<div class="page-with-ads"><p>{"Some text of the page here, not short at all, as articles are. " * 9}</p><div class="ads">Buy this</div></div>', " ".join(["Some text of the page here, not short at all, as articles are."] * 9)),
        ("<div><article><p>First of the two articles, and not short.</p></article><article><p>Second of the two articles, a little longer.</p></article></div>", "First of the two articles, and not short. Second of the two articles, a little longer."),
    ],
)
def test_main_text_in_wrappers(inner, want):
    assert html_text.main_text(PAGE % inner) == want


PARAGRAPHS = "".join(f"<p>{'Words and more words of the text here. ' * 8}</p>" for _ in range(4))


def brute_leader(page):
    """The tag path of the node whose children's densities add up to most, from the definition, node by node."""
    p = html_text._Page(page)
    n = len(p.tag)
    inside = lambda i, j: j == i or (p.parent[j] >= 0 and inside(i, p.parent[j]))
    live = [i for i in range(n) if not p.out[i]]

    def of(i):
        below = [j for j in live if inside(i, j)]
        chars = [(len(" ".join(t.split())), p.link[j]) for j, t in p.parts if t and j in below]
        c, links = sum(x for x, _ in chars), sum(x for x, linked in chars if linked)
        return c, links, len(below) - 1, sum(p.tag[j] == "a" for j in below if j != i)

    c0, l0 = of(0)[:2]

    def density(i):
        c, links, tags, link_tags = of(i)
        if not c:
            return 0.0
        inner = math.log(max(c / (links or 1) * (tags or 1) / (link_tags or 1), 1.0))
        base = math.log(c / max(c - links, 1) * links + l0 / c0 * c + math.e)
        return c / (tags or 1) * (inner / math.log(base) if base > 1.0001 else inner + 1.0)

    rank = {i: html_text.RANK_FACTOR.get(p.tag[i], 1.0) * sum(density(j) for j in live if p.parent[j] == i) for i in live}
    best = max(rank, key=lambda i: (rank[i], density(i), -i))
    return " ".join("".join(" " if t is None else t for j, t in p.parts if inside(best, j) and not p.out[j]).split())


@pytest.mark.parametrize("page", [f"<nav><a href=x>m</a></nav><article><h1>T</h1><p><b>One long bold line of text, and more.<br></article><div>some aside line</div>", f"<main>{PARAGRAPHS}<div><p>x <a href=y>link</a></p></div></main><div><a href=1>a</a><a href=2>b</a></div>", f"<body><article><h2>S</h2>{PARAGRAPHS}</article><div><ul><li><a href=1>one link</a><li><a href=2>two links</a></ul></div>"])
def test_leader_by_definition(page):
    assert html_text.main_text(page) == brute_leader(page) != ""


def test_weaker_names_are_evidence():
    text = " ".join(["Words and more words of the text here."] * 32)
    assert html_text.main_text(f"<nav><a href=x>m</a></nav><div class='page-widget'><h1>T</h1>{PARAGRAPHS}</div>") == "T " + text
    assert html_text.main_text(f"<article><h1>T</h1>{PARAGRAPHS}<div class='related-work'><h2>R</h2>{PARAGRAPHS}</div></article>") == f"T {text} R {text}"
    assert html_text.main_text(f"<article><h1>T</h1>{PARAGRAPHS}<div class='related-links'><a href=1>A</a><a href=2>B</a></div></article>") == f"T {text}"


def test_stray_ends_cost_little():
    began = time.time()
    assert html_text.main_text("<b>" * 50_000 + "x" + "</p>" * 50_000) == "x"
    assert html_text.main_text("<b><table><tr><td>" + "<i>" * 50_000 + "y" + "</b>" * 50_000) == "y"
    assert time.time() - began < 20


def test_main_text_odd():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("just &lt;text&gt;\n here") == "just <text> here"
    assert html_text.main_text("<p>x<!-- open") == "x" and html_text.main_text("<p>x</p><foo bar='") == "x"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<article><p>" + "word " * 200_000).count("word") == 200_000


def test_block_of_many_tiles(monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATE_TILE", 16)
    monkeypatch.setattr(vector_search, "QUERY_TILE", 3)
    rnd = np.random.default_rng(5)
    ids = np.sort(rnd.integers(0, 150, 200))  # some ids twice
    exact = rnd.integers(-4, 5, (200, 6)).astype(np.int32)  # many ties
    low, width = exact.min(0).astype(np.int64), np.full(6, 2, dtype=np.int64)
    cells = ((exact - low) // width).astype(np.uint8)
    asked = ids[::20]
    for k in (1, 7, 300):
        got = vector_search.block_top_k(asked, exact[::20], ids, cells, exact, low, width, k)
        want = [(q, i, s) for q, x in zip(asked, exact[::20]) for s, i in sorted([(int(s), int(i)) for s, i in zip(exact @ x, ids) if i != q], key=lambda p: (-p[0], p[1]))[:k]]
        assert list(zip(*[g.tolist() for g in got])) == want
    assert [len(g) for g in vector_search.block_top_k(asked[:0], exact[:0], ids, cells, exact, low, width, 3)] == [0, 0, 0]


def test_extract_table(spark):
    rows = [(1, "u", "<article><p>a</article>", "t"), (None, None, None, None), (1, "u", "<article><p>a</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(["(1, 'u', 'a')", "(None, None, '')", "(1, 'u', 'a')"])
    assert html_text.extract(df.where("false")).count() == 0


def test_warc(spark):
    big = "é<p>" * 60
    rows = [(5, "http://x/ y\r\nz", big), (3, "http://b", big), (9, None, big), (3, "http://b", big), (None, "n", big), (7, "s", "short"), (8, "s", "short"), (11, "u", None), (12, "u", ""), (13, "u", "q" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "file", "offset", "payload")})
    folder = scratch_path(spark, "warc-test")
    index = warc.write_warc(df.repartition(3), folder)
    assert index.count() == len(rows)
    back = warc.read_warc(index, folder).collect()
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload_digest) for r in back)
    want = sorted((str(p), "revisit" if h == big and p != 3 else "response", "3" if h == big and p != 3 else "None", len((h or "").encode()), sha(h)) for p, _, h in rows)
    assert got == want
    assert all(bytes(r.payload).decode() == next(h or "" for p, _, h in rows if p == r.page_id) for r in back if r.record_type == "response")
    one = warc.read_warc(index.where("page_id = 13"), folder).collect()
    assert len(one) == 1 and len(one[0].payload) == 3_000_000
    assert warc.read_warc(warc.write_warc(df.where("false"), folder), folder).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(4)
    vectors = np.round(rnd.normal(0, 0.2, (400, 8)), 2)
    vectors[50:120] = vectors[50]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1020, [None] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [float("inf")] * 8, 1), (1080, [1.0], 1), (None, [0.1] * 8, 1), (60, rows[60][1], 1), (1100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumns({"id": F.lit(1), "q": F.lit(2), "rank": F.lit(3)})
    vector_search.CANDIDATES_PER_BLOCK, vector_search.QUERIES_PER_BLOCK = 90, 7
    try:
        got = sorted(tuple(r) for r in vector_search.exact_top_k(df, F.pmod("id", F.lit(20)) == 0).collect())
    finally:
        vector_search.CANDIDATES_PER_BLOCK, vector_search.QUERIES_PER_BLOCK = 4096, 1024
    live = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v, _ in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in {i: q for i, q in live if i % 20 == 0}.items():
        best = sorted((-int(q @ x), j) for j, x in live if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert vector_search.exact_top_k(df.where("false"), F.pmod("id", F.lit(20)) == 0).count() == 0
    assert vector_search.exact_top_k(df.where("vec_id = 1"), F.pmod("id", F.lit(20)) == 0).count() == 0
    assert vector_search.exact_top_k(df.where("vec_id = 20"), F.pmod("id", F.lit(20)) == 0).count() == 0


@pytest.mark.parametrize(("large", "share"), [(300_000.0, 5), (4e7, 3), (1e12, 1)])
def test_top_k_large_components(spark, large, share):
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(0, 0.2, (150, 8))
    vectors[::share, 2] = rnd.normal(0, 0.2, len(vectors[::share])) * (large if large < 1e12 else 1e7)
    if large == 1e12:  # products past 2 ** 63 that cancel, and one past what doubles tell apart
        vectors[0, :2], vectors[20, :2] = (large, large), (large, -large)
        vectors[40, 3], vectors[41, 3] = 1e300, 0.0
        vectors[:, 3] = np.where(np.arange(150) == 40, 1e300, 0.0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (160, [float("inf")] * 8), (180, None)], "vec_id long, embedding array<double>")
    vector_search.CANDIDATES_PER_BLOCK, vector_search.QUERIES_PER_BLOCK = 40, 4
    try:
        got = sorted(tuple(r) for r in vector_search.exact_top_k(df, F.pmod("id", F.lit(20)) == 0).collect())
    finally:
        vector_search.CANDIDATES_PER_BLOCK, vector_search.QUERIES_PER_BLOCK = 4096, 1024
    live = [(i, [int(x) * 64 if abs(x) > 2**53 else int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for i, q in live:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in live if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_score_beyond_long(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no 64-bit integer"):
        vector_search.exact_top_k(df, F.pmod("id", F.lit(20)) == 0).collect()


def test_chat(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\n\\<|x|> \\\\<\\|im_end|> <\\/ é😀"
    rows = [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"),
        (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, "assistant", "last"), (2, 1, "assistant", "a"),
        (3, 0, "user", "only"), (None, 0, "system", "s"), (None, 1, "assistant", "t"), (4, 0, "odd\nrole<|\\", "x"), (4, 1, None, "y"),
        (5, 0, "assistant", "long " * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n_turns": F.lit(1), "target": F.lit(2), "parts": F.lit(3)})
    examples = chat.format_examples(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(by) == set(back)
    for c, turns in by.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    for r in examples.collect():
        assert (r.target is None) == (r.loss_end == 0 and by[r.conv_id][-1][0] != "assistant" and r.n_turns == len(by[r.conv_id]))
    assert chat.format_examples(df.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, "x " * 60_000, "en", "src0", 1), (10**6 + 1, "x " * 60_000, "en", "src0", 1)], docs.schema)
    docs = docs.unionByName(odd)
    kept = None
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.where("false"), DATA).count() == 0, name
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = docs = spark.createDataFrame(out.collect(), docs.schema)
            assert docs.count() > 0
    out = out.toPandas()
    assert len(out) == kept.count() and (out.n_tokens >= 0).all()
    assert P.run(spark, DATA).count() > 0
