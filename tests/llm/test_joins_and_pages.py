"""Near-duplicate join, page extraction, pipeline and registration against brute force."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline
from alloscan.llm import decontaminate as dc
from alloscan.llm import jaccard_forest as jf
from alloscan.llm import main_text as mt
from alloscan.llm import piece_codec as pc
from alloscan.llm import quality_hosts as qh
from alloscan.llm.queries import ORACLES, QUERIES
from alloscan.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def package(spark):
    ship_package(spark)


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names).repartition(4)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_join(rows):
    """Class (least id of the component) and number of links of every row, by all pairs that share a shingle."""
    sets, inverse = [shingles(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverse[x].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverse[x] if j > i)
        for j, n in shared.items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], least[root(i)], links[i]) for i in range(len(rows)))


def near_copies(rng, n, length, edits):
    base = [f"b{i}" for i in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket,cluster,chars", [(2048, 1024, 1_000_000), (8, 5, 300)])
def test_join_equals_all_pairs(spark, monkeypatch, bucket, cluster, chars):
    monkeypatch.setattr(jf, "BUCKET_BLOCK", bucket)
    monkeypatch.setattr(jf, "CLUSTER_BLOCK", cluster)
    monkeypatch.setattr(jf, "BLOCK_CHARS", chars)
    rng = random.Random(8)
    texts = near_copies(rng, 60, 120, 6) + [" ".join(f"r{rng.randrange(5000)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{k}-{i}" for i in range(60)) for k in range(20)]  # a shared passage alone is no link
    texts += ["same text in many rows of the table"] * 40 + ["two words", "two words", "two  words", "x", "  ", ""]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts, 1)] + [(5, texts[4]), (900, None), (None, None)]
    got = jf.join(frame(spark, rows)).collect()
    blank = {r[0] for r in rows if not shingles(r[1])}
    want = plain_join([r for r in rows if shingles(r[1])])
    have = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got)
    for r in rows:
        if not shingles(r[1]):
            want[(r[0], r[0], 0)] += 1
    assert have == want and blank
    kept = jf.one_of_each(frame(spark, rows)).collect()
    classes = {c for (_, c, _), n in plain_join([r for r in rows if shingles(r[1])]).items() if c is not None}
    assert sorted(r["doc_id"] for r in kept if shingles(r["text"]) and r["doc_id"] is not None) == sorted(classes)
    assert sum(not shingles(r["text"]) for r in kept) == sum(not shingles(t) for _, t in rows)


def test_classes_with_null_or_shared_ids_keep_one_text_each(spark):
    text = lambda k, n=100: " ".join(f"{k}{i}" for i in range(n))
    near = lambda k: text(k) + " and more"
    rows = [(None, text("a")), (None, text("b")), (None, near("b")), (None, text("c")), (None, text("c")), (7, near("c")), (3, text("d")), (3, text("e")),
            (3, near("e")), (4, near("e")), (9, text("f")), (None, near("f")), (None, None), (3, "")]
    kept = [(r["doc_id"], (r["text"] or "").split(" ")[0][:1]) for r in jf.one_of_each(frame(spark, rows)).collect()]
    assert Counter(kept) == Counter([(None, "a"), (None, "b"), (7, "c"), (3, "d"), (3, "e"), (9, "f"), (None, ""), (3, "")])


def test_join_of_no_rows(spark):
    assert jf.join(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_reached():
    k = jf.prefix_depth()
    recall = lambda d: 1 - (1 - jf.THRESHOLD ** d) ** jf.TREES
    assert recall(k) >= jf.TARGET_RECALL > recall(k + 1)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        n = 3000
        both = rng.integers(0, 2 ** 63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2 ** 63, n - len(both), dtype=np.uint64)))) for _ in range(2))
        assert abs((jf.signature(a) == jf.signature(b)).mean() - j) < 0.15


@pytest.mark.parametrize("edges", [[(str(i), str(i + 1)) for i in range(10, 40)], [("a", "b"), ("c", "d"), ("d", "a"), ("x", "y"), ("y", "x"), ("q", "q")], []])
def test_components(spark, edges):
    got = {r["key"]: r["root"] for r in jf.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            group = {x for x, r in want.items() if r in (want.get(a, a), want.get(b, b))} | {a, b}
            want |= dict.fromkeys(group, min(group))
    assert got == want


# --- pages

PAGES = [
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b  c\n d", "a\nb c d"),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One, two.<br>three <b>bold</b> &#233;&nbsp;x</p></article>"
     "<footer>&copy;</footer></body></html>", "T & U\nOne, two.\nthree bold é x"),
    ("<body><div class='menu'><a href=1>Home</a></div><div id=main><h2>Head</h2><div class=post-content><p>One, two, three and many more words, long enough.</p>"
     "<p>Second para, again.</p><div class=advert>Buy</div><form>name</form></div><div class=sidebar>links</div><div id=comments><p>reader, says, a, lot, with, commas, "
     "here and there, and more</p></div></div>", "Head\nOne, two, three and many more words, long enough.\nSecond para, again."),
    ("<article><p>x &lt;b&gt; y<script>var a='</p>';</script><style>p{}</style><!-- no <p> --> z</p></article", "x <b> y\nz"),
    ("<div><p>Cut off in a ta<a hre", "Cut off in a ta"),
    ("<html class=cookie><body class=ads><main class='sidebar-right'><p>Main words, here.</p><div id=comment-1><p>reader, says</p></div></main></body>", "Main words, here."),
    ("<article><p>One <svg class=icon viewBox='0 0 1 1'/> two.</p><p>Three, four.</p><svg><path d=x /></svg><p>Five.</p></article>", "One two.\nThree, four.\nFive."),
    ("<article><p>One, two.</p><noscript>Three.<p>Four.</p></article><footer>x</footer>", "One, two.\nThree.\nFour."),
    ("<article><p>One, two.</p><object data=x><p>Three</p><noscript><p>no</p></noscript><p>Four.</p>", "One, two.\nThree\nFour."),
    ("<article><p>One, two.</p><noscript><p>no</p><iframe>no</noscript><video src=x>no <b>no</b></video><p>Three.</p></article>", "One, two.\nThree."),
    ("<article><p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> hold.</p></article>", "Let x = 1 hold."),
    ("<div class='content has-sidebar'><p>Kept text, with commas, here.</p></div>", "Kept text, with commas, here."),
]


LONG = "A long, quiet sentence about rivers, hills, and the weather of the year. " * 6
WHOLE_ARTICLES = {
    "sections": (f"<main><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Short end.</p></section></main>",
                 ["One", LONG, "Two", "Short end."]),
    "divs": (f"<main><div class=lead><p>First.</p></div><div class=body><p>{LONG}</p></div><div class=outro><p>Last.</p></div></main>",
             ["First.", LONG, "Last."]),
    "short_neighbours": (f"<body><p>Short intro.</p><div><p>{LONG}</p></div><p>End.</p></body>", ["Short intro.", LONG, "End."]),
    "other_text": (f"<body><h4>Head</h4><div><p>{LONG}</p></div><ul><li>one</li><li>two</li></ul><pre>x = 1</pre></body>",
                   ["Head", LONG, "one", "two", "x = 1"]),
    "names_in_article": (f"<article><div class=header><h1>Title</h1></div><p class=search>On search.</p><p>{LONG}</p>"
                         "<p class=advert>Buy now.</p><div class=related><p>Other news.</p></div></article>", ["Title", "On search.", LONG]),
    "form_as_frame": (f"<form><article><h1>T</h1><p>{LONG}</p></article><input name=q><button>Go</button></form>", ["T", LONG]),
}


@pytest.mark.parametrize("form", WHOLE_ARTICLES)
def test_articles_in_several_containers_are_whole(form):
    page, want = WHOLE_ARTICLES[form]
    around = "<nav><a href=/>Home</a></nav><div><a href=/a>A page</a> <a href=/b>B page</a></div><footer>Imprint</footer>"
    for html in (page, f"<html><body>{around}{page.removeprefix('<body>').removesuffix('</body>')}{around}</body></html>"):
        assert mt.main_text(html) == "\n".join(x.strip() for x in want)


def test_small_and_empty_forms_are_left_out():
    page = f"<body><div><p>{LONG}</p><form><p>Your name, please.</p></form></div></body>"
    assert mt.main_text(page) == LONG.strip()
    assert mt.main_text("<form><p>Name</p><p>Password</p></form>") == ""


def test_lists_of_links_end_the_article():
    links = "<div class=more>" + "".join(f"<p><a href=/{i}>Some other page {i}</a></p>" for i in range(9)) + "</div>"
    page = f"<div><div><p>{LONG}</p></div>{links}</div>"
    assert mt.main_text(page) == LONG.strip()


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text_by_hand(page, want):
    assert mt.main_text(page) == want


def test_pages_equal_their_articles(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in mt.extract(pages).collect()}
    for r in pages.collect():
        page = r["html"]
        start, end = page.index("<article>") + 9, page.find("</article>")
        blocks = re.sub(r"</?(?:p|h1|br)[^>]*>", "\x00", page[start:end if end >= 0 else len(page)])
        parts = (" ".join(html.unescape(x).split()) for x in re.sub("</?b>", "", blocks).split("\x00"))
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert mt.extract(pages.limit(0)).count() == 0


def test_page_of_many_blocks_is_whole():
    page = "<article>" + "".join(f"<p>row {i}, of a page.</p>" for i in range(3000)) + "</article>"
    assert mt.main_text(page).split("\n")[-1] == "row 2999, of a page." and mt.main_text("<div>" * 3000 + "deep, text" + "</div>" * 3000) == "deep, text"


# --- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in qh.verdicts(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["kept"]}
    rows = sorted((i, t) for i, t, _ in docs if i in kept)
    heads = {c for _, c, _ in plain_join(rows)}
    from test_native import plain_matches, plain_spans
    last = [(i, t) for i, t in rows if i in heads and not plain_matches([(i, t)], items)]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(out) == sorted(i for i, _ in last) and len(out) > 50
    codec = pc.Codec(pc.load())
    for i, t in last:
        text = codec.decode(np.array(out[i]["ids"], np.int32))
        spans = plain_spans(t)
        assert out[i]["round_trip"] and ("[SECRET]" in text if spans else True)
        if "[SECRET]" not in text:
            assert text == t
        else:  # what is left of the text is in order around the marks
            assert re.fullmatch(".*?".join(map(re.escape, text.split("[SECRET]"))), t, re.S)


def test_stages_follow_the_order_and_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_overlap", "secrets", "token_ids"]
    rows = [(1, "w " * 3, "en", "s", 6), (2, " ".join(f"u{i}" for i in range(90)) + ' token = "0123456789abcdef0123456789abcdef"', None, None, 1), (None, None, None, "s", None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    r = docs.collect()
    assert len(r) == 1 and r[0]["text"].endswith("[SECRET]\"") and r[0]["n_chars"] == len(r[0]["text"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    from compare import compare, duck
    res = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert res["ok"] and "types" not in res, res


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for f in (root / "alloscan").rglob("*.py"):
        if "llm" not in f.parts:
            assert "alloscan.llm" not in f.read_text(), f
    assert dc.LEAST_MASKED == 13
