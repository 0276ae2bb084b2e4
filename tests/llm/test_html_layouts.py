"""Hand-written page layouts, none of which the made-up training pages are: the main text exactly."""

import duckdb
import pytest

from viewlens.llm import html_extraction as H

PAGES = "/root/testdata/sf0.01/pages.parquet"

A = ("The valley lies far behind the hills, and few people have been there since the old road was closed in spring.")
B = ("Those who went say that the river is wide, that it floods the meadows every year, and that nobody minds.")
C = ("In the evening the lights of the village can be seen from the pass, if the weather is clear enough.")
D = ("A guide who has lived there all his life says that he would not leave it for any town in the world.")
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Valley Press, all rights reserved</footer>"


def page(body, title="", head=""):
    return f"<!DOCTYPE html><html><head><title>{title}</title>{head}</head><body>{body}</body></html>"


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LAYOUTS = {
    "headline in the article's header": (
        page(f"{NAV}<article><header><h1>Behind the hills</h1></header>{p(A, B, C)}</article>{FOOT}", "Behind the hills"),
        ["Behind the hills", A, B, C]),
    "headline in a header, no title": (
        page(f"{NAV}<article><header><h1>Behind the hills</h1></header>{p(A, B)}</article>{FOOT}"),
        ["Behind the hills", A, B]),
    "one-word headline in a nameless div": (
        page(f"{NAV}<div><h1>Floods</h1>{p(A, B, C)}</div>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "one-word headline in prose": (
        page(f'{NAV}<div class="prose"><h1>Floods</h1>{p(A, B)}</div>{FOOT}', "Floods - Valley Press"), ["Floods", A, B]),
    "one-word headline, German names": (
        page(f'{NAV}<div class="inhalt"><h1>Hochwasser</h1>{p(A, B, C)}</div><div class="fusszeile">Impressum und Datenschutz</div>',
             "Hochwasser"), ["Hochwasser", A, B, C]),
    "one-word headline in a table layout": (
        page(f'<table><tr><td><a href="/">Home</a> <a href="/n">News</a></td><td><h1>Floods</h1>{p(A, B, C)}</td></tr></table>',
             "Floods"), ["Floods", A, B, C]),
    "German reader comments": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A, B, C)}<div class="kommentare"><h3>Kommentare</h3><p>Sehr schön!</p>'
             f"<p>Ich war auch schon dort, es lohnt sich.</p></div></article>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "related links in an aside inside the article": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A)}<aside><p>Related: the river in winter</p></aside>{p(B, C)}</article>{FOOT}',
             "Floods"), ["Floods", A, B, C]),
    "a list of several items": (
        page(f"{NAV}<article><h1>What to take along</h1>{p(A)}<ul><li>warm clothes</li><li>a map of the valley</li>"
             f"<li>something to eat</li></ul>{p(B)}</article>{FOOT}", "What to take along"),
        ["What to take along", A, "warm clothes", "a map of the valley", "something to eat", B]),
    "a numbered list": (
        page(f"{NAV}<main><h1>How to get there</h1>{p(A)}<ol><li>Take the train to the last stop.</li><li>Walk for two hours."
             f"</li><li>Ask for the bridge.</li></ol>{p(B)}</main>{FOOT}", "How to get there"),
        ["How to get there", A, "Take the train to the last stop.", "Walk for two hours.", "Ask for the bridge.", B]),
    "a table of figures": (
        page(f"{NAV}<article><h1>Floods in figures</h1>{p(A)}<table><tr><th>Year</th><th>Level</th></tr><tr><td>2020</td>"
             f"<td>3 m</td></tr><tr><td>2021</td><td>4 m</td></tr></table>{p(B, C)}</article>{FOOT}", "Floods in figures"),
        ["Floods in figures", A, "Year", "Level", "2020", "3 m", "2021", "4 m", B, C]),
    "code": (
        page(f"{NAV}<article><h1>Reading the gauge</h1>{p(A)}<pre><code>read gauge\n  print level</code></pre>{p(B)}</article>{FOOT}",
             "Reading the gauge"), ["Reading the gauge", A, "read gauge print level", B]),
    "a quotation": (
        page(f"{NAV}<article><h1>A life in the valley</h1>{p(A)}<blockquote><p>{D}</p></blockquote>{p(B)}</article>{FOOT}",
             "A life in the valley"), ["A life in the valley", A, D, B]),
    "a figure with its caption": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A)}<figure><img src="r.jpg"><figcaption>The river near the bridge, last May'
             f"</figcaption></figure>{p(B, C)}</article>{FOOT}", "Floods"),
        ["Floods", A, "The river near the bridge, last May", B, C]),
    "subheadings": (
        page(f"{NAV}<article><h1>The valley</h1>{p(A)}<h2>The river</h2>{p(B)}<h2>The people</h2>{p(D)}</article>{FOOT}",
             "The valley"), ["The valley", A, "The river", B, "The people", D]),
    "no wrapper at all": (
        page(f"{NAV}<h1>Behind the hills</h1>{p(A, B, C)}{FOOT}", "Behind the hills"), ["Behind the hills", A, B, C]),
    "meaningless names": (
        page(f'{NAV}<div class="x1 qof"><div id="zuk"><h1>Behind the hills</h1>{p(A, B, C)}</div></div>{FOOT}',
             "Behind the hills"), ["Behind the hills", A, B, C]),
    "French names": (
        page(f'{NAV}<div class="contenu"><h1>Derriere les collines</h1>{p(A, B)}</div><div class="barre-laterale"><ul><li>'
             f'<a href="/1">La pluie</a></li><li><a href="/2">Le pont</a></li></ul></div><div class="commentaires">'
             f"<p>Merci pour ce texte.</p></div>{FOOT}", "Derriere les collines"), ["Derriere les collines", A, B]),
    "Spanish names": (
        page(f'{NAV}<div id="contenido"><h1>Tras las colinas</h1>{p(A, B, C)}</div><div class="publicidad">Compre ahora y ahorre.'
             f'</div><div class="comentarios"><p>Muy bonito.</p><p>Gracias.</p></div>{FOOT}', "Tras las colinas"),
        ["Tras las colinas", A, B, C]),
    "cookie notice and newsletter": (
        page(f'<div class="cookie-consent"><p>We use cookies to make this site work better for you.</p><button>OK</button></div>'
             f'{NAV}<article><h1>Floods</h1>{p(A, B, C)}</article><div class="newsletter-signup"><p>Get our best stories every '
             f"morning.</p><form><input><button>Sign up</button></form></div>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "a form inside the article": (
        page(f"{NAV}<article><h1>Floods</h1>{p(A)}<form><label>Your mail</label><input><button>Send</button></form>{p(B)}"
             f"</article>{FOOT}", "Floods"), ["Floods", A, B]),
    "an advert inside the article": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A)}<div class="ad-slot">Boots for every weather, now cheaper.</div>{p(B, C)}'
             f"</article>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "two side bars": (
        page(f'{NAV}<aside class="left"><h3>Topics</h3><ul><li><a href="/a">Rivers</a></li><li><a href="/b">Roads</a></li></ul>'
             f'</aside><main><h1>Floods</h1>{p(A, B, C)}</main><aside class="right"><h3>Most read</h3><ul><li><a href="/c">'
             f"The bridge</a></li></ul></aside>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "a site header with its name": (
        page(f'<header class="site-header"><a href="/">Valley Press</a></header>{NAV}<article><h1>Floods</h1>{p(A, B)}</article>'
             f"{FOOT}", "Floods - Valley Press"), ["Floods", A, B]),
    "English comments after the article": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A, B, C)}</article><section id="comments"><h2>2 comments</h2><div class="comment">'
             f'<b>Ann</b><p>I was there too, it is lovely.</p></div><div class="comment"><b>Ben</b><p>Thanks for this.</p></div>'
             f"</section>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "comments as articles inside the main element": (
        page(f'{NAV}<main><h1>Floods</h1>{p(A, B, C)}<section class="responses"><article><b>Ann</b><p>I was there too.</p>'
             f"</article><article><b>Ben</b><p>Thanks for this text.</p></article></section></main>{FOOT}", "Floods"),
        ["Floods", A, B, C]),
    "inline markup and references": (
        page(f'{NAV}<article><h1>Caf&eacute; &amp; more</h1><p>The <b>old</b> <a href="/r">road</a> was&nbsp;closed,<br>as '
             f"<i>everybody</i> knows &mdash; and nobody minds any more, at least not here.</p>{p(B)}</article>{FOOT}",
             "Café & more"),
        ["Café & more", "The old road was closed, as everybody knows — and nobody minds any more, at least not here.", B]),
    "scripts and styles between blocks": (
        page(f"{NAV}<article><h1>Floods</h1><style>p {{ margin: 0 }}</style>{p(A)}<script>var x = '<p>no</p>';</script>{p(B)}"
             f"<noscript><img src=t></noscript></article>{FOOT}", "Floods"), ["Floods", A, B]),
    "divs for paragraphs": (
        page(f'{NAV}<div class="story"><h1>Floods</h1><div>{A}</div><div>{B}</div><div>{C}</div></div>{FOOT}', "Floods"),
        ["Floods", A, B, C]),
    "unclosed paragraphs": (
        page(f"{NAV}<article><h1>Floods</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}", "Floods"), ["Floods", A, B, C]),
    "breadcrumbs and share buttons": (
        page(f'{NAV}<div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div><article><h1>Floods</h1>'
             f'{p(A, B)}<div class="share"><a href="/f">Share</a> <a href="/m">Mail</a></div></article>{FOOT}', "Floods"),
        ["Floods", A, B]),
    "a long menu before the article": (
        page("<nav>" + "".join(f'<a href="/{k}">Topic number {k}</a> ' for k in range(40)) + f"</nav><article><h1>Floods</h1>"
             f"{p(A, B)}</article>{FOOT}", "Floods"), ["Floods", A, B]),
    "a definition list": (
        page(f"{NAV}<article><h1>Words of the valley</h1>{p(A)}<dl><dt>Beck</dt><dd>a small river that never dries out</dd>"
             f"<dt>Fell</dt><dd>a hill without trees</dd></dl>{p(B)}</article>{FOOT}", "Words of the valley"),
        ["Words of the valley", A, "Beck", "a small river that never dries out", "Fell", "a hill without trees", B]),
    "related stories after the article": (
        page(f'{NAV}<article><h1>Floods</h1>{p(A, B, C)}</article><div class="related-stories"><h3>More stories</h3><ul><li>'
             f'<a href="/1">The bridge is closed again</a></li><li><a href="/2">A winter in the valley</a></li></ul></div>{FOOT}',
             "Floods"), ["Floods", A, B, C]),
    "a page without any article": (
        page(f'{NAV}<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>{FOOT}'), []),
}


@pytest.fixture(scope="module")
def model():
    return H.fit([h for h, in duckdb.sql(f"SELECT html FROM '{PAGES}' ORDER BY page_id LIMIT 150").fetchall()])


def test_hand_written_layouts(model):
    wrong = []
    for name, (source, want) in LAYOUTS.items():
        got = H.extract([source], model)[0]
        if got != "\n".join(want):
            wrong.append((name, got, want))
    assert len(LAYOUTS) >= 30 and not wrong, "\n".join(f"{n}: {g!r}" for n, g, _ in wrong)
