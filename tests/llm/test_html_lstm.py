import html
import random
import re

import numpy as np
import pytest

from bandwarden.llm import html_lstm as H
from bandwarden.llm.html_blocks import page_blocks


@pytest.fixture(scope="module")
def labeller():
    import pyarrow.parquet as pq
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    sets = H.training_pages(pages)
    return H.Labeller().fit([H.block_vectors(b) for b in sets], [np.array([H.teacher(x) for x in b], float) for b in sets])


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|b)>|<br>", inside)
    return "\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts) if t)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = H.Labeller(width=5, units=3, seed=1)
    x, mask = H.padded([rng.normal(size=(n, 5)) for n in (4, 2, 1)])
    label = (rng.random(mask.shape) < .5) * 1.0
    _, grad = m.gradients(x, mask, label)
    for k, v in m.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 7)]:
            kept, eps = v[at], 1e-6
            v[at] = kept + eps
            up = m.gradients(x, mask, label)[0]
            v[at] = kept - eps
            down = m.gradients(x, mask, label)[0]
            v[at] = kept
            assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-6


def test_padding_changes_nothing(labeller):
    rng = np.random.default_rng(1)
    pages = [rng.normal(size=(n, H.PATH + H.WORDS + H.SHAPE)) for n in (1, 9, 30)]
    together = labeller.label([*pages, np.zeros((0, pages[0].shape[1]))])
    assert all(np.allclose(a, labeller.label([p])[0]) for a, p in zip(together, pages)) and len(together[3]) == 0


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_texts(pages, H.train(pages)).collect()}
    rows = pages.collect()
    right = [got[r.page_id].text == article(r.html) and got[r.page_id].url == r.url for r in rows]
    assert len(got) == len(rows) and np.mean(right) > 0.99
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_other_templates(labeller):
    rng = random.Random(77)
    texts = [f"Sentence number {i} of an unseen text, {'and more of it ' * (i % 7)}ends here." for i in range(50)]
    sets = [page_blocks(H.other_template(rng.choices(texts, k=rng.randint(1, 10)), ["Home", "About us", "Log in"], rng)) for _ in range(200)]
    marks = labeller.label([H.block_vectors(b) for b in sets])
    assert np.mean([(m >= .5) == H.teacher(x) for b, p in zip(sets, marks) for x, m in zip(b, p)]) > 0.97


def test_reader():
    page = """<!DOCTYPE html><head><title>T</title><script>var a="</p>";</script><body><p class="x y">One &amp;
      two<br>three <b>four<p>five<!-- no > --> six</div><ul><li>a<li>b</ul><style>p{}</style>&lt;end"""
    blocks = page_blocks(page)
    assert [b.text for b in blocks] == ["One & two three four", "five six", "a", "b", "<end"]
    assert blocks[0].path == (("body",), ("p", "x", "y")) and blocks[2].path[-2:] == (("ul",), ("li",))
    assert page_blocks(None) == page_blocks("") == page_blocks("<p> </p>") == []
    assert [b.text for b in page_blocks("a < b <3 <a href='>'>c</a>")] == ["a < b <3 c"]


def test_odd_pages(spark, labeller):
    long = "<html><body><article>" + "<p>word and word.</p>" * 3000 + "</article></body></html>"
    rows = [(1, "u", None, "a"), (1, "u", None, "a"), (2, None, "", "b"), (3, "v", "<p", "c"), (4, "w", long, "d"), (None, "x", "<nav>m</nav>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_texts(df, labeller).collect()
    assert len(got) == 6 and {r.page_id: r for r in got}[1].text == "" and {r.page_id: r for r in got}[4].text.count("\n") == 2999
    assert H.main_texts(df.where("false"), H.train(df.where("false"))).count() == 0


@pytest.mark.parametrize("page, texts", [
    ("<head><title>t</title><article><p>text", ["text"]),
    ("<head><script>if (a < b) '<body>'</script><meta x><p>nine", ["nine"]),
    ("<div><select><option>a<option>b</div><p>after", ["after"]),
    ("<p>one</p><svg><path d='x'><p>two", ["one", "two"]),
    ("<p title='it's'>three</p><p>four", ["three", "four"]),
    ("<object><param name=a>five<p>six", ["five", "six"]),
    ("<div><canvas>no</div><p>seven", ["seven"]),
    ("<svg><foreignObject><div>x</div></foreignObject></svg><p>eight", ["eight"]),
    ("<textarea>ten <p>eleven", ["ten", "eleven"]),
    ("<div>a<object>b<div>c</div>d</object>e</div>", ["a", "e"]),
])
def test_unclosed_and_misquoted_elements_hide_nothing_else(page, texts):
    assert [b.text for b in page_blocks(page)] == texts


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<!x", "<p '", "<object>", "<svg><title>", "<", "<a b='\"", "<p ="])
def test_long_malformed_pages_end_in_seconds(part):
    import time
    start = time.perf_counter()
    page_blocks(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 20
