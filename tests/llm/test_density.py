import pytest

from sedimenta.llm import density as D

BODY = "<p>Plenty of words make up the first paragraph of this article, and more follow.</p><p>The second one has a <a href=x>link</a> &amp; ends.</p>"
TEXT = "Plenty of words make up the first paragraph of this article, and more follow.\nThe second one has a link & ends."


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\nb"),
        (f"<html><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>&copy; x</footer></body></html>", TEXT),
        (f"<body><div id=wrap><div class='ad'>buy</div><div>{BODY}</div><div class='comments'>{BODY}</div></div>", TEXT),
        (f"<body><main><article><header><h1>T</h1></header>{BODY}<footer>by me</footer><form><input><label>Mail</label></form></article><aside>{BODY}</aside></main>", "T\n" + TEXT),
        ("<article><p><b>open<br><p>x  y\n z&eacute;<script>var t='</p>'</script></article>", "open\nx y zé"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
        ("<article>a<!-- c -->b<i>c</i></article>", "abc"),
        ("<article>&amp;lt; &#65;&#x42; &unknown;</article>", "&lt; AB &unknown;"),
        (f'<main><div class="side-by-side">{BODY}</div><section id="legal-history"><p>One.</p></section><div class="post-comments">{BODY}</div></main>', TEXT + "\nOne."),
        (f"<article>{BODY}<div class=related><a href=1>One</a> <a href=2>Two</a></div><div class=related>{BODY}</div></article>", TEXT + "\n" + TEXT),
        ("<p title=it's>a</p><p>don't</p>", "a\ndon't"),
        ("<article>a<!-- open", "a"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<p class=", '<p class='),
    ],
)
def test_extract(html, text):
    assert D.extract(html) == text


def test_long_page_is_read_whole():
    parts = [f"Paragraph {i} with a number of words in it." for i in range(20000)]
    assert D.extract("<body><nav>x</nav><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>") == "\n".join(parts)


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>"), (2, None, None), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = D.extracted(df).collect()
    assert sorted(r.text for r in got) == ["", "", "", TEXT] and all(r.n_chars == len(r.text) for r in got)
    assert D.extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize("html", ["<a" * 500_000, "<" + "a" * 1_000_000, "<a " * 300_000 + ">", '<a b="' * 200_000 + ">", "<a b='>" * 100_000, "<!--" * 200_000, "<i>" * 100_000 + "</b>" * 100_000, "<p><i>" * 50_000])
def test_broken_pages_take_linear_time(html):
    import time

    began = time.time()
    D.extract(html)
    assert time.time() - began < 8


def _plain_densities(x, share):
    """(characters, link characters, tags, link tags, density, sum) of every node, straight from the definition."""
    import math
    import re

    kids = [p for p in x.parts if isinstance(p, D.Node) and not p.gone]
    below = {id(k): _plain_densities(k, share) for k in kids}
    c = sum(len(re.sub(r"\s+", " ", p).strip()) for p in x.parts if isinstance(p, str)) + sum(below[id(k)][0] for k in kids)
    links = sum(below[id(k)][0] if k.tag == "a" else below[id(k)][1] for k in kids)
    t = len(kids) + sum(below[id(k)][2] for k in kids)
    lt = sum(k.tag == "a" for k in kids) + sum(below[id(k)][3] for k in kids)
    density = 0.0
    if c:
        plain = max(c - links, 1)
        base = math.log(c / plain * max(links, 1) + share * c + math.e)
        density = c / max(t, 1) * math.log(max(c / max(links, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(base) if base > 1 else c / max(t, 1)
    x_sum = sum(below[id(k)][4] for k in kids)
    _plain_densities.all[id(x)] = (density, x_sum)
    return c, links, t, lt, density, x_sum


def test_densities_equal_their_definition():
    import random

    rng = random.Random(3)

    def page(depth):
        if depth == 0 or rng.random() < 0.2:
            return " ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))
        tag = rng.choice(["div", "p", "a href=x", "ul", "li", "section", "b", "nav", "td"])
        return f"<{tag}>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"

    for _ in range(60):
        root = D.parse("<body>" + "".join(page(5) for _ in range(3)) + "</body>")
        top, threshold = D.main_node(root)
        body = next(p for p in root.parts if isinstance(p, D.Node))
        _plain_densities.all = {}
        c, links, *_ = _plain_densities(body, 0.0)
        share = links / max(c, 1)
        _plain_densities.all = {}
        _plain_densities(root, share if c else 0.0)
        every, stack = [], [root]
        while stack:
            x = stack.pop()
            every.append(x)
            stack += [p for p in x.parts if isinstance(p, D.Node) and not p.gone]
        for x in every:
            want = _plain_densities.all[id(x)]
            assert x.density == pytest.approx(want[0]) and x.total == pytest.approx(want[1])
        best = max(every, key=lambda x: x.total)
        if best.total > 0:
            path, up = [], best
            while up is not None and up is not root:
                path.append(up.density)
                up = up.parent
            assert threshold == pytest.approx(min(path) if best is not root else best.density)


def test_result_columns_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, f"<article>{BODY}</article>", "old", "old", "x")], "page_id long, html string, text string, n_chars string, other string")
    row = D.extracted(df).first()
    assert (row.text, row.n_chars, row.other, row.html[:9]) == (TEXT, len(TEXT), "x", "<article>")
