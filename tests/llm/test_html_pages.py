"""Main texts of labelled pages, of deep pages, and tree matching against a plain recursion."""

import random

from voltaloom.llm import html_text

WORDS = [f"w{i}" for i in range(300)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(rng, style):
    """(html, main text): menus, adverts, notices and comments vary in place and name by the host's style."""
    parts = [words(rng, rng.randint(4, 60)) for _ in range(rng.randint(2, 6))]
    title = words(rng, 5)
    menu = "".join(f"<li><a href=/{k}>{words(rng, 1)}</a>" for k in range(5))
    body = "".join(f"<p>{p}</p>" for p in parts)
    nav, promo, foot, notes = [
        (f"<nav><ul>{menu}</ul></nav>", f'<div class="ad">{words(rng, 9)}</div>', "<footer>Same foot</footer>", f'<div id="comments"><p>{words(rng, 8)}</p></div>'),
        (f'<div class="main-nav"><ul>{menu}</ul></div>', '<p class="cookie-notice">We use cookies</p>', '<div class="site-footer">Same foot</div>', f'<section class="reader comments">{words(rng, 8)}</section>'),
        (f"<header>Site {words(rng, 2)}</header><aside>{words(rng, 5)}</aside>", "<div>Sign up for our letter today</div>", "<form><label>Mail</label><input></form>", f"<aside>{words(rng, 6)}</aside>"),
    ][style]
    inside = f"<article><h1>{title}</h1>{body[: len(body) // 2].rsplit('<p>', 1)[0]}{promo}{'<p>' + body[: len(body) // 2].rsplit('<p>', 1)[1] + body[len(body) // 2 :]}{notes}</article>"
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{nav}{inside}{foot}<script>x('</p>')</script></body></html>", "\n".join([title, *parts])


def f1(got, want):
    a, b = got.split("\n"), want.split("\n")
    both = sum(min(a.count(x), b.count(x)) for x in set(a))
    return 2 * both / max(1, len(a) + len(b))


def test_labelled_pages(spark):
    rng = random.Random(5)
    made = [(k, f"https://h{k % 3}.example/p{k}", *page(rng, k % 3)) for k in range(60)]
    got = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string")).collect()}
    scores = [f1(got[k].text, want) for k, _, _, want in made]
    assert min(scores) == 1.0  # every block of every page, and no other
    assert all(got[k].text == want and got[k].n_chars == len(want) for k, _, _, want in made)


def test_deep_and_broken_pages(spark):
    rows = [(k, "https://deep.example/", "<body><article>" + f"<{t}>" * 5000 + f"inner {t}") for k, t in enumerate(["div", "b", "font", "li", "p", "table"])]
    rows += [(20, "https://deep.example/", '<article><a href="x>cut</a> on</article>'), (21, None, None), (22, "", ""), (None, "https://deep.example/", "<p>x"), (20, "https://deep.example/", "<p>y")]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "host")).toPandas()
    text = {(p, t) for p, t in zip(got.page_id.fillna(-1).astype(int), got.text, strict=True)}
    assert {(k, f"inner {t}") for k, t in enumerate(["div", "b", "font", "li", "p", "table"])} < text
    assert (20, "cut on") in text and (21, "") in text and (22, "") in text and (-1, "x") in text


def test_names_mark_whole_class_names_only():
    html = '<main><h1>T</h1><article><div class="legal-analysis">A</div><blockquote class="comment">Q</blockquote><div class="comment-list">no</div><div class="search">S</div></article><article class="related">no</article><article><p><a href=x>More</a> of all this</article><article><p><a href=x>teaser</a></article></main>'
    assert html_text.extract(html, None, frozenset()) == "T\nA\nQ\nS\nMore of all this"
    assert html_text.extract("<p><a>all links</a> x<p>y", None, frozenset()) == "all links x\ny"


def test_matching_equals_recursion():
    rng = random.Random(1)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["<p>t</p>", "<div class=a>x</div>", "<ul><li>1<li>2</ul>"])
        t = rng.choice(["div", "section", "ul"])
        return f"<{t}{rng.choice(['', ' class=k'])}>" + "".join(element(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{t}>"

    def plain(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(x, y))
        return 1 + m[-1][-1]

    for _ in range(150):
        a, b = (html_text.shape(html_text.parse("<body>" + "".join(element(4) for _ in range(3)))) for _ in range(2))
        pairs = html_text.matching(a, b)
        assert len(pairs) == plain(a, b) and all(x.label == y.label for x, y in pairs)
