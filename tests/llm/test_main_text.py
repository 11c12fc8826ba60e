"""Main text: broken mark-up, wrappers, deep and long pages, and the run itself against brute force."""

import time

import numpy as np
import pytest

from tessera.llm import mainregion

TEXT = "Enough words of running text to stand as a paragraph of the article that is wanted here."
OTHER = "Second paragraph of the same article which also has words enough to count as one."
PAGE = f"<header><h2>Brand</h2></header><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav>%s<div class='sidebar'><p>Side words that go on for long enough to look like text.</p></div><footer>end</footer>"
ARTICLE = f"<article><h1>Title</h1><p>{TEXT}</p><p>{OTHER}</p></article>"
WANT = f"Title\n\n{TEXT}\n\n{OTHER}"


@pytest.fixture(scope="module")
def weights():
    return mainregion.learn([PAGE % ARTICLE] * 5)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar">{ARTICLE}</div>',
        f'<div class="site no-header">{ARTICLE}</div>',
        f"<body class='menu-open'><form action=/x>{ARTICLE}</form>",
        f"<div id=sidebar><div class=widget>{ARTICLE}</div></div>",
        f"<button>{ARTICLE}",
        f"<p>x<svg><path d=1>{ARTICLE}",
        f"<select><option>one<option>two{ARTICLE}",
        f"<object data=x>{ARTICLE}",
        "<div>" * 600 + ARTICLE + "</div>" * 600,
        "<article>" + "<div>" * 600 + f"<h1>Title</h1><p>{TEXT}</p>" + "</div>" * 600 + f"<p>{OTHER}</p></article>",
        f"<div role=main><h1>Title</h1><p>{TEXT}<p>{OTHER}</div>",
        f"<article><header><h1>Title</h1><p>By Someone</p></header><p>{TEXT}</p><aside><p>{OTHER * 9}</p></aside><p>{OTHER}</p><section class='comments-area'><p>{OTHER}</p></section></article>",
        f"<article><h1>Title</h1><p>{TEXT}</p><form><input name=x><p>{OTHER}</p></form><p>{OTHER}</p><article class=comment><p>{OTHER}</p></article></article>",
        f"<article><h1>Title</h1><p>{TEXT[:30]}<span class=ad>Buy now</span>{TEXT[30:]}</p><p hidden>secret</p><p>{OTHER}<!-- a > b --></p></article>",
        f"<article title='a > b' class=\"x\"><h1>Title</h1><p data-x='<p>'>{TEXT}</p><p>{OTHER}</article>",
        f"<article><h1>Title</h1><script>if (a</b/.test('</p>')) x</script><style>p{{}}</style><textarea>{OTHER}</textarea><p>{TEXT}</p><p>{OTHER}</p></article>",
    ],
)
def test_marked_pages(page, weights):
    assert mainregion.extract(PAGE % page, weights) == WANT
    assert mainregion.extract(PAGE % page, {}) == WANT


@pytest.mark.parametrize("wrap", ["<div class=content>%s</div>", "<form id=aspnetForm>%s</form>", "<div class='page sidebar'>%s</div>", "<table><tr><td>%s</table>"])
def test_unmarked_pages(wrap, weights):
    body = f"<h1>Title</h1><p>{TEXT}</p><p>{OTHER}</p>"
    assert mainregion.extract(PAGE % (wrap % body), weights) == WANT


def test_small_words_in_names_and_lines():
    assert mainregion.extract(f"<article><p class=meta>{TEXT}</p><p class='entry-tags'>{OTHER}</p></article>", {}) == f"{TEXT}\n\n{OTHER}"
    assert mainregion.extract("<article><p>code <span class='token comment'>// note</span> a<b>b</b>c 1 < 2 &lt;i&gt; &amp;amp;</p></article>", {}) == "code // note abc 1 < 2 <i> &amp;"
    assert mainregion.named("cookieBanner") and mainregion.named("site-header") and mainregion.named("widget-area-2") and not mainregion.named("has-sidebar") and not mainregion.named("footnote")


@pytest.mark.parametrize(
    "unit, end",
    [("<b ", ""), ("<a x='", ""), ("<a b='>'", ""), ("<div>", "</p>"), ("<i class=ad><b>", "</span></i>"), ("<svg>", ""), ("<button>x", "</button>"), ("<li><p>", "</div>"), ("<!", ">"), ("<", ">"), ("<td>", "</tr>"), ("<!-- ", ""), ('<a ="', ">")],
)
def test_broken_pages_take_linear_time(unit, end):
    began = time.process_time()
    mainregion.extract(unit * 100_000 + end * 100_000, {})
    assert time.process_time() - began < 20  # a quadratic scan takes many minutes
    small = mainregion.parse(unit * 3 + end * 3 + f"<p>{TEXT}")
    assert len(small) <= 4


def test_run_equals_brute_force():
    """The largest sum of any contiguous run, of equal sums the earliest and longest."""
    rng = np.random.default_rng(3)
    kinds = ["p", "li", "div", "td"]
    for _ in range(200):
        blocks = [mainregion.Block("x", kinds[int(rng.integers(4))], 0, "", int(rng.integers(1, 6)), 0, ["p"] * int(rng.integers(0, 3))) for _ in range(int(rng.integers(0, 9)))]
        weights = {f"w:{k}": float(rng.integers(-2, 3)) for k in kinds} | {"t:p": -1.0}
        value = [b.words * weights["w:" + b.inner] for b in blocks]

        def total(i, j):
            return value[i] + sum(value[k] - len(blocks[k].tags) for k in range(i + 1, j))

        best = max([0.0] + [total(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)])
        start, end = mainregion.region(blocks, weights)
        assert (total(start, end) if end > start else 0.0) == best


def test_long_page(spark):
    paragraphs = [f"Paragraph {i} {TEXT}" for i in range(20_000)]
    page = PAGE % ("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")
    df = spark.createDataFrame([(1, "u", page), (2, "v", "<article><p>" + "x" * 3_000_000)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in mainregion.main_text(df).collect()}
    assert out[1] == "\n\n".join(paragraphs) and len(out[2]) == 3_000_000
