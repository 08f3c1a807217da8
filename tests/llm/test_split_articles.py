"""An article that stands in several elements is kept whole."""

import pytest

from voltaloom.llm import html_text

TEASER = "<article class='teaser'><p>Another story</p></article><article><p><a href='/x'>A linked headline elsewhere</a></p></article>"


@pytest.mark.parametrize("tag", ["article", "div class='content'", "main"])
def test_all_parts_are_kept(spark, tag):
    end = tag.split()[0]
    page = f"<html><body><nav>menu</nav><{tag}><p>First part of the story.</p></{end}><p class='ad'>Buy</p><{tag}><p>Second and longer part of the story.</p></{end}>{TEASER if end == 'article' else ''}</body></html>"
    df = spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")
    assert [r.text for r in html_text.main_texts(df).collect()] == ["First part of the story.\nSecond and longer part of the story."]
