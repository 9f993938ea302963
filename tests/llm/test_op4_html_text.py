from __future__ import annotations

import html
import re

import numpy as np
import pytest
from groovehouse.llm import html_text as H
from groovehouse.llm.queries import queries

SF = "/root/testdata/sf0.01"


def landmark_text(page):
    """The article element of the given pages, by regular expressions."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [re.sub(r"<br>", " ", x) for x in re.split(r"</?(?:p|h1)>", inner)]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in blocks]
    return "\n".join(x for x in blocks if x)


def test_query_extracts_the_article_of_every_page(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries()["op4_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = landmark_text(pages[r["page_id"]]["html"])
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_held_out_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    model, rng = H.fit(pages[:120]), np.random.default_rng(99)
    right = total = 0
    for page in pages[150:250]:
        blocks = H.leaf_blocks(page)
        own = [b.text for b, y in zip(blocks, H.landmark_labels(blocks), strict=True) if y]
        made, article = H.layout(own[0][:80], own[1:9] or own, own, rng)
        found = H.leaf_blocks(made)
        begins = np.arange(len(found)) == 0
        label = H.Chains(begins, 10_000).best(model.emissions(H.block_features(found)), model.moves)
        gold = H.layout_labels(found, article)
        right += sum(x == y for x, y in zip(gold, label, strict=True))
        total += len(found)
    assert right / total > 0.95


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a&amp;b &#233; &nbsp; c<p>d<br>e</p>", ["a&b é c", "d e"]),
    ("<script>var t='<p>x</p>'</script><style>p{}</style><p>y", ["y"]),
    ("<!-- <p>no</p> --><div>1 < 2 <i>i</i>n</div><li>a<li>b", ["1 < 2 in", "a", "b"]),
    ("<title>t</title><textarea><p>q</textarea><td>u</td>", ["u"]),
    ("<p title='a>b'>x</p></div></p>z<unclosed", ["x", "z<unclosed"]),
    ("", []), ("plain", ["plain"])])
def test_leaf_blocks(page, want):
    assert [b.text for b in H.leaf_blocks(page)] == want


def test_viterbi_against_all_paths():
    from itertools import product
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    begins = np.zeros(11, bool)
    begins[[0, 4, 5]] = True
    got = H.Chains(begins, 99).best(emit, move)
    for a, b in ((0, 4), (4, 5), (5, 11)):
        score = lambda p, a=a: sum(emit[a + k, x] for k, x in enumerate(p)) + sum(
            move[x, y] for x, y in zip(p, p[1:], strict=False))
        assert tuple(got[a:b]) == max(product((0, 1), repeat=b - a), key=score)


def test_awkward_pages_and_empty_table(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "y"), (2, "v", "<script>a</script>", "z"),
            (3, "w", "<div>" * 3000 + "deep", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    model = H.train(pages)
    found = H.extract(pages, model).collect()
    assert len(found) == 5 and all(r["text"] == "" for r in found if r["html"] is None or "deep" not in r["html"])
    assert H.extract(pages.limit(0), H.train(pages.limit(0))).count() == 0


def test_broken_tags_take_time_in_proportion_to_the_page():
    """1 MB of each; the first two are one text, the others hold no text or one block."""
    import time
    pages = {"<a " * 333_000: 1, "<" * 1_000_000: 1, "<!" * 500_000: 1, "<a" * 500_000: 1, '<a "' * 250_000 + ">": 0,
             "<p '" * 250_000: 1, "<!--" * 250_000: 0, "<div>" * 200_000 + "x": 1}
    for page, n in pages.items():
        t = time.time()
        assert len(H.leaf_blocks(page)) == n
        assert time.time() - t < 10
    assert [b.text for b in H.leaf_blocks("<p>a < b <i c")] == ["a < b <i c"]
    assert [b.text for b in H.leaf_blocks("<p title='x>y'>a<!-- > -->b<br/>c</p><q 'z>d")] == ["ab c", "<q 'z>d"]
