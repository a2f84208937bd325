"""Elements without an end tag cut nothing off; text that only looks like a label breaks nothing."""

import pytest

from tesserspark.llm import html

FIRST, SECOND = "The first paragraph of the story goes here, it is long enough.", "The second one follows and it is long enough as well."


@pytest.mark.parametrize("tag", ["noscript", "template", "iframe", "canvas", "video", "audio", "svg", "select", "button", "option", "datalist", "object", "math"])
def test_unclosed_elements_keep_the_article(tag):
    page = f"<html><head><title>x</title></head><body><article><p>{FIRST}</p><{tag}><p>{SECOND}</p></article></body></html>"
    assert html.main_text(page, html.default_model()) == f"{FIRST} {SECOND}"
    again = page.replace("</article>", f"</article><footer><{tag}>x</{tag}></footer>")  # the end tag of another element
    assert SECOND in html.main_text(again, html.default_model())


def test_head_without_end_tag():
    page = f"<html><head><meta charset=utf-8><title>x</title><style>p{{}}</style><body><article><p>{FIRST}<p>{SECOND}</article>"
    assert html.main_text(page, html.default_model()) == f"{FIRST} {SECOND}"


def test_closed_elements_are_left_out_and_content_kept():
    page = f"<article><p>{FIRST}<svg><title>t</title><text>no</text></svg><button>no</button></p><video><p>no</p></video><select><option>no<option>no</select><p>{SECOND} Here <math><mi>x</mi></math> <object>stands</object>.</p></article>"
    assert html.main_text(page, html.default_model()) == f"{FIRST} {SECOND} Here x stands."


def test_labels_of_pages_are_not_read():
    page = f'<article data-label="new"><p>{FIRST}</p></article>'
    assert html.main_text(page, html.default_model()) == FIRST


@pytest.mark.parametrize("wrap", ["{}", "<nav><a href=/>Home</a><a href=/n>News</a></nav>{}<aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside>"])
@pytest.mark.parametrize(
    "inside",
    [
        "<h1>Yes</h1><p>{0}</p><p>{1}</p>",
        "<p>{0}</p><h2>No</h2><h3>Yes</h3><p>Ok.</p><p>{1}</p>",
        "<p>{0}</p><p>The mark \N{COPYRIGHT SIGN} stands for a claim, and the story says so.</p><p>{1}</p>",
        "<p>{0}</p><p>&copy; is a sign that many people know from books.</p><p>{1}</p>",
        "<p>{0}</p><p>Photo &copy; Jane Doe</p><p>{1}</p>",
        "<p>{0}</p><p>" + "many words of it " * 400 + "&copy; and " + "many words of it " * 400 + "</p><p>{1}</p>",
    ],
)
def test_all_of_an_article_is_kept(wrap, inside):
    import html as entities
    import re

    inside = inside.format(FIRST, SECOND)
    page = "<html><head><title>x</title></head><body>" + wrap.format(f"<article>{inside}</article>") + "<footer>&copy; 2020 Example, all rights reserved.</footer></body></html>"
    assert html.main_text(page, html.default_model()) == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<div>" * n + "<li>" + "</section>" * n + "text of the page that is deep." + "</div>" * n
        begun = time.perf_counter()
        html.main_text(page, html.default_model())
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)


def test_long_text_is_whole():
    text = "A sentence of the story that goes on and on. " * 40_000
    page = f"<article><p>{FIRST}</p><p>{text}</p></article><footer><p>\N{COPYRIGHT SIGN} 2020</p></footer>"
    assert html.main_text(page, html.default_model()) == f"{FIRST} {text.strip()}"
