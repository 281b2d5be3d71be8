"""Pages made to be deep, unbalanced or endless cost time and memory in proportion to their length."""

import time
import tracemalloc

import pytest

from pricelattice.llm import html_paths


def read(html):
    page = html_paths.blocks(html)
    return html_paths.text_of(page, [p for p, _ in html_paths.votes(page)])


ENDLESS = {
    "nested": lambda n: "<div>" * n + "deep text", "closed": lambda n: "<div class='a b'>" * n + "deep text" + "</div>" * n,
    "quotes": lambda n: '<a "' * n + ">deep text", "mixed quotes": lambda n: "<a '\"" * n + ">deep text", "open quotes": lambda n: '<a "' * n,
    "stray end tags": lambda n: "<p>deep text" + "</i>" * n, "open links": lambda n: "<a>" * n + "<div></div>" * n + "deep text",
    "attributes": lambda n: "<p " + 'a="b ' * n + ">deep text", "no value": lambda n: "<p " + "a" * n + ">deep text", "no end": lambda n: "deep text" + "<a" * n,
    "inline": lambda n: "<i><div>" * n + "deep text", "comments": lambda n: "deep text" + "<!--" * n,
}


@pytest.mark.parametrize("name", ENDLESS)
def test_cost_is_linear(name):
    took = []
    for n in (12_500, 100_000):
        html = ENDLESS[name](n)
        best = 1e9
        for _ in range(2):
            start = time.process_time()
            text = read(html)
            best = min(best, time.process_time() - start)
        took.append(best)
        if name not in ("quotes", "mixed quotes", "open quotes", "attributes", "open links", "no end"):
            assert text == "deep text"
    assert took[1] < 30 * took[0] + 0.5, took  # eight times the page


@pytest.mark.parametrize("name", ["nested", "closed", "quotes", "inline"])
def test_memory_is_bounded(name):
    html = ENDLESS[name](100_000)
    tracemalloc.start()
    try:
        read(html)
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()


def test_ends_of_tags():
    cases = {
        "<p title='a > b' class=\">\">one": "one", '<p title="never closed>two</p>': "two", "<p a='x>three</p><p>it's</p>": None,
        "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2", "<p>four<a href='u' b>five</a></p><": "fourfive\n<", "<P CLASS=x>six</P >": "six", "<p>a</p><!-- <p>b</p> --><p>c": "a\nc",
        "<p>x</p><p y": "x\n<p y", "": "",
    }
    for html, want in cases.items():
        got = read(html)
        assert want is None or got == want, (html, got)


def test_containers_count_what_lies_in_them():
    page, nodes = html_paths.blocks("<body><div>one <div><p>two</p><nav>menu</nav></div></div><div id=x>three</div>")
    assert [(t, at, side) for t, at, side, _ in page] == [("one", 1, False), ("two", 2, False), ("menu", 2, True), ("three", 3, False)]
    assert [(n.tag, n.text, n.blocks, n.within) for n in nodes] == [("body", 11, 3, -1), ("div", 6, 2, 0), ("div", 3, 1, 1), ("div", 5, 1, 0)]


def test_long_paths_stay_apart_and_short():
    html = "<body>" + "".join(f'<div class="part{"abc"[k % 3] * 40}">' for k in range(200)) + "text"
    _, nodes = html_paths.blocks(html)
    assert len({n.path for n in nodes}) == len(nodes) and max(len(n.path) for n in nodes) < html_paths.LONG_PATH + 200
