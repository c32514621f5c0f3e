"""Main text of pages against texts set down by hand, and the time of hostile pages."""

from __future__ import annotations

import time

import pytest

from tidebars.llm import html_text

A = "The harbour was quiet in the morning, and the boats that had come in at night were still at the quay with their nets on the deck."
B = "By noon it was full of people who had come from the villages to buy fish, and of the children who were with them for the day."
C = "Nobody in the town could say when the market had first been held, but all of them knew that it was older than the church."
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
JA = "港は朝のうち静かだった。夜に入ってきた船はまだ岸壁にあり、網は甲板の上に置かれていた。" * 3
RU = "Утром гавань была тиха. Лодки, пришедшие ночью, ещё стояли у причала. Сети лежали на палубах, и никто их не трогал. " * 3

PAGES = {
    "article": (f"<body>{NAV}<article><h1>Market</h1><p>{A}</p><p>{B}</p></article><footer>&copy; Town</footer></body>", f"Market\n{A}\n{B}"),
    "short page": ("<html><body><p>short</p></body></html>", "short"),
    "short lines between menus": (f"<body>{NAV}<div>One line</div><div>Another line</div><footer>Imprint</footer></body>", "One line\nAnother line"),
    "no markup": ("just a text", "just a text"),
    "state in class": (f'<article class="overflow-hidden"><p>{A}</p><p>{B}</p></article>', f"{A}\n{B}"),
    "hint beside content word": (f'<body><div class="intro"><p>{A}</p></div><div class="social-history"><p>{B}</p></div></body>', f"{A}\n{B}"),
    "hint beside place word": (f'<body><div class="story"><p>{A}</p></div><div class="social-box"><p>{B}</p></div></body>', A),
    "japanese": (f"<body>{NAV}<div><p>{JA}</p></div></body>", JA),
    "russian": (f"<body>{NAV}<div><p>{RU}</p></div><footer>Город</footer></body>", RU.strip()),
    "page in a form": (f"<form id=aspnetForm>{NAV}<div><p>{A}</p><p>{B}</p></div></form>", f"{A}\n{B}"),
    "form beside text": (f"<div><p>{A}</p></div><form><p>{B}</p><label>Name</label></form>", A),
    "comments": (f"<div><p>{A}</p><p>{B}</p></div><section id=comments class='comments-area'><h2>3 comments</h2><p>{C}</p></section>", f"{A}\n{B}"),
    "hidden attribute": (f"<div><p>{A}</p></div><div hidden><p>{B}</p></div><p>{C}</p>", f"{A}\n{C}"),
    "hidden words": (f"<p>{A} <span style='display: none'>secret</span>So it was.</p>", f"{A} So it was."),
    "scripts and styles": (f"<head><title>T</title><style>p{{}}</style></head><script>document.write('<p>no</p>')</script><p>{A}</p><noscript>Please enable</noscript><template><p>{B}</p></template>", A),
    "comments of the markup": (f"<!-- <p>{B}</p> --><p>{A}</p><!-- x -- y > -->", A),
    "references": (f"<p>{A} Fish &amp; chips &lt;5&#8364; &eacute;t&eacute;&nbsp;x &bogus; &#x41;</p>", f"{A} Fish & chips <5€ été x &bogus; A"),
    "white space": (f"<p>\n  {A}\t\r\n <b>and</b>\n\n more </p>", f"{A} and more"),
    "br": (f"<p>{A}<br>{B}<br/>end.</p>", f"{A} {B} end."),
    "list in the text": (f"<main><p>{A}</p><ul><li>Cod</li><li>Plaice</li></ul><p>{B}</p></main>", f"{A}\nCod\nPlaice\n{B}"),
    "table in the text": (f"<article><p>{A}</p><table><tr><td>Cod<td>3</tr><tr><td>Plaice<td>4</table><p>{B}</p></article>", f"{A}\nCod\n3\nPlaice\n4\n{B}"),
    "unclosed paragraphs": (f"<article><p>{A}<p>{B}<p>End.</article>", f"{A}\n{B}\nEnd."),
    "quotes in attributes": (f"<p title='a > b' data-x=\"<p>\">{A}</p><p it's>{B}</p>", f"{A}\n{B}"),
    "cookie notice and advert": (f"<div class='cookie-banner'><p>{C}</p></div><div class=content><p>{A}</p></div><div class=ad>Buy fish</div>", A),
    "sidebar and related": (f"<div class=content><p>{A}</p><p>{B}</p></div><aside><p>{C}</p></aside><div class='related-posts'><a href=1>The tide</a></div>", f"{A}\n{B}"),
    "header inside the article": (f"<header><p>{C}</p></header><article><header><h1>Market</h1></header><p>{A}</p><footer>Filed under fish</footer></article>", f"Market\n{A}"),
    "links between": (f"<div><p>{A}</p><p><a href=1>Read this</a> <a href=2>and that</a></p><p>{B}</p></div>", f"{A}\n{B}"),
    "linked words in the text": (f"<div><p>{A} <a href=1>Nets</a> dry.</p></div>", f"{A} Nets dry."),
    "heading before the text": (f"{NAV}<h2>Noon</h2><p>{B}</p><h2>More</h2><ul><li><a href=1>x</a></li></ul>", f"Noon\n{B}"),
    "teaser article beside the text": (f"<div><p>{A}</p><p>{B}</p><p>{C}</p></div><article><h3>Next</h3><p>Tides.</p></article>", f"{A}\n{B}\n{C}\nNext\nTides."),
    "aria": (f"<div role=navigation><p>{C}</p></div><div role=main><p>{A}</p></div><div role=contentinfo>Imprint</div>", A),
    "upper case": (f"<BODY><NAV>x</NAV><ARTICLE><P>{A}</P></ARTICLE></BODY>", A),
    "unclosed select": (f"<p>{A}</p><select><option>One<p>{B}</p>", f"{A}\nOne\n{B}"),
    "unfinished tag": (f"<p>{A}</p><p>{B} <a href", f"{A}\n{B} <a href"),
    "empty": ("", ""),
    "only a menu": (f"<body>{NAV}</body>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_deep_and_long_page():
    page = "<div>" * 3000 + "".join(f"<p>{A} {i}</p>" for i in range(3000)) + "</div>" * 3000
    assert html_text.main_text(page) == "\n".join(f"{A} {i}" for i in range(3000))


@pytest.mark.parametrize("piece", ["<a ", "<!x", "<a b=\"", "<a b=\">\"", "<p title='", "<div class=ad>x", "<select>x", "<svg ", "<", "</p>", "&amp", "<!--"])
def test_hostile_pages_take_linear_time(piece):
    def seconds(k: int) -> float:
        start = time.perf_counter()
        html_text.main_text(piece * k)
        return time.perf_counter() - start

    half, whole = seconds(50_000), seconds(100_000)
    assert whole < 5 and whole < 4 * half + 0.3
