"""Main text: the field against brute force, the walk against written pages, held-out pages."""

import random
from itertools import product

import numpy as np

from fieldrail.llm import crf as C
from fieldrail.llm import html_extract as H
from fieldrail.llm.dom_blocks import DEPTH, blocks, root

from .conftest import prose


def score(emission, labels, f):
    s = f.begin[labels[0]] + f.end[labels[-1]] + sum(x for x, y in zip(emission, labels) if y)
    return s + sum(f.step[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_and_sums_equal_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        f = C.Field(np.zeros(1), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
        emission = r.normal(size=n)
        every = {y: score(emission, y, f) for y in product((0, 1), repeat=n)}
        assert tuple(C.viterbi(emission.tolist(), f)) == max(every, key=every.get)
        total, share, steps = C.expectations(np.r_[emission, 0, 0][None], np.array([n]), f)
        z = sum(np.exp(v) for v in every.values())
        assert abs(total[0] - np.log(z)) < 1e-9
        assert np.allclose(share[0, :n], [sum(np.exp(v) for y, v in every.items() if y[k]) / z for k in range(n)])
        assert np.allclose(steps, [[sum(np.exp(v) * sum((p, q) == (a, b) for p, q in zip(y, y[1:])) for y, v in every.items()) / z for b in (0, 1)] for a in (0, 1)])
    flat = C.Field(np.zeros(1), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    assert C.viterbi([0.0, 0.0], flat) == [1, 1] and C.viterbi([], flat) == []


def test_gradient_equals_differences():
    r = np.random.default_rng(2)
    sequences = [[[0, 2], [1], [2, 3]], [[3]], [[1, 2], [0]]]
    labels = [[1, 0, 1], [0], [1, 1]]
    f = C.Field(r.normal(size=5), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
    _, grad = C.loss(sequences, labels, f, 0.1)
    for value, own in ((f.weight, grad.weight), (f.step, grad.step), (f.begin, grad.begin), (f.end, grad.end)):
        for at in np.ndindex(value.shape):
            kept, sides = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = kept + step
                sides.append(C.loss(sequences, labels, f, 0.1)[0])
            value[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - own[at]) < 1e-6


def walk(page):
    found, _ = blocks(page, root())
    out = []
    for b in found:
        path, node = [], b.node
        while node.parent:
            path.append(node.tag)
            node = node.parent
        out.append((b.text, " ".join(path[::-1])))
    return out


def test_blocks_and_their_paths():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
      <p><b>One&nbsp;&lt;1&gt;<br>two<p>three &copy &#8364;</p><ul><li>a<li>b<div>c</div></ul>
      <script>var t="</p><p>x";</script><table><tr><td>d<td>e</table><!-- <p>no</p> --> tail < 3 <a href="x>y">link</a>
      <section><p>in</section>out</b></p><a title='cut"""
    assert walk(page) == [
        ("One <1> two", "p"), ("three © €", "p"), ("a", "ul li"), ("b", "ul li"), ("c", "ul li div"),
        ("d", "table tr td"), ("e", "table tr td"), ("tail < 3 link", ""), ("in", "section p"), ("out", ""),
    ]
    assert blocks(page, root())[1] == "T & t"
    assert [b.linked for b in blocks("<p><a href=/>four</a> more</p>", root())[0]] == [4]
    assert walk("") == [] and walk("plain &amp; simple") == [("plain & simple", "")]


def test_hostile_pages_take_linear_work():
    for page in ("<div>" * 200_000 + "x", "<a href=\"" * 100_000, "<script>" * 100_000, "<!--" * 200_000, "<p class='" * 100_000, "</x>" * 200_000, "<li>y" * 50_000, "<" * 300_000):
        found, _ = blocks(page, root())
        assert sum(len(b.text) for b in found) <= len(page)
    deep = blocks("<div>" * (DEPTH + 50) + "x" + "</div>" * DEPTH + "y", root())[0]
    assert [b.text for b in deep] == ["x", "y"]


def page(r, k, article="article", extra=""):
    title = prose(r, 6).capitalize()
    text = [prose(r, r.randint(8, 60)).capitalize() + "." for _ in range(r.randint(2, 9))]
    menu = "".join(f'<li><a href="/{k}">{w}</a></li>' for w in prose(r, 5).split())
    body = f'<div class="ad">{prose(r, 9)}</div><{article}><h1>{title}</h1>' + "".join(f"<p>{t}</p>" for t in text)
    return (
        f"<html><head><title>{title}</title><script>var a='</p>'</script></head><body><nav><ul>{menu}</ul></nav>{body}{extra}</{article.split()[0]}><footer>&copy; {prose(r, 4)}</footer></body></html>",
        "\n\n".join([title, *text]),
    )


def test_pages_give_their_articles(spark):
    r = random.Random(9)
    made = [page(r, k) for k in range(60)]
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(made)] + [(90, None, None, "x"), (91, "", "", "x"), (None, "n", made[0][0], "x"), (0, "again", made[0][0], "x"), (92, "s", "<script>only()</script>", "x")]
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4), H.Bound(pages=40, layouts=2)).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    want = {k: t for k, (_, t) in enumerate(made)} | {90: "", 91: "", None: made[0][1], 92: ""}
    assert {(x.page_id, x.text) for x in got} == set(want.items())
    assert {x.url for x in got if x.page_id in (None, 90)} == {"n", None}


def test_other_layouts_and_comments(spark):
    r = random.Random(4)
    field = C.fit(*H.labelled([page(r, k)[0] for k in range(80)], 5), features=1 << 16, rounds=100)
    made = H.Extractor(field)
    comments = lambda: f'<div class="comments"><h3>2 comments</h3><div class="comment"><p>{prose(r, 20)}.</p></div><div class="comment"><p>{prose(r, 30)}.</p></div></div><form><label>Name</label><button>Send</button></form>'
    right = total = 0
    for k in range(60):
        html, want = page(r, k, r.choice(["article", "main", 'div class="post-content"', 'div id="content"', "section class=story"]), comments() if k % 2 else "")
        right, total = right + (made.text(html) == want), total + 1
    assert right >= 0.9 * total


def test_no_labelled_pages_keep_all_blocks(spark):
    docs = spark.createDataFrame([(1, "u", "<p>a</p><nav>b</nav>"), (2, "u", None)], "page_id long, url string, html string")
    assert [x.text for x in H.main_texts(docs).orderBy("page_id").collect()] == ["a\n\nb", ""]
    assert H.main_texts(docs.limit(0)).count() == 0


def test_own_labels():
    label = lambda h: H.own_labels(blocks(h, root())[0], h)
    assert label("<nav>m</nav><article><h1>t</h1><aside>s</aside><p>p</p></article>") == [0, 1, 0, 1]
    assert label("<article>a</article><article>b</article><p>c") is None
    assert label("<article>a</article>") is None and label("<p>a") is None
    assert label("<p>x</p><article>a<div><article>comment</article></div></article>") is None
    assert label("<ARTICLE >a<form>b</form></article><p>c") == [1, 0, 0]
