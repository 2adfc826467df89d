import html
import random

from lorespan.llm import html_text

LONG = "The river was in the house of the stone and it was on that day that the cat had been there with all of them for the light."
MORE = "Das Haus ist in der Stadt und die Leute sind nicht da, weil es für sie auch ein anderes Haus mit einem Garten gibt, das sie mögen."
SHORT = "One short line."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title of page</title>{head}</head><body>{body}</body></html>"


def test_article_between_furniture():
    body = f"""<header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav></header><div class="cookie-notice"><p>{LONG}</p></div>
      <article><header><h1>A &amp; B</h1></header><p>{LONG}<br>{SHORT}</p><aside><p>{MORE}</p></aside><p>{SHORT}</p><div class="share"><a href=#>Share it</a></div>
      <script>var x = "<p>{LONG}</p>";</script><style>p {{ }}</style><!-- <p>{LONG}</p> --><p>{MORE}<form><p>{LONG}</p><input></form></article>
      <section id="comments"><p>{LONG}</p></section><div class="sidebar">{MORE}</div><footer>{LONG}</footer>"""
    assert html_text.main_text(page(body)) == "\n".join(("A & B", f"{LONG} {SHORT}", SHORT, MORE))


def test_page_without_article():
    body = f"<div class=top><a href=1>one</a> <a href=2>two</a></div><div><h2>Heading of it</h2><p>{LONG} {LONG}</p><p>{SHORT}</p><p>{MORE} {MORE}</p></div><div><a href=3>{LONG}</a></div><p>© x</p>"
    assert html_text.main_text(page(body)) == "\n".join(("Heading of it", f"{LONG} {LONG}", SHORT, f"{MORE} {MORE}"))


def test_lone_short_article_is_kept():
    assert html_text.main_text(page(f"<nav><a href=1>menu</a></nav><main><p>{SHORT}</p></main><footer>x</footer>")) == SHORT


def test_references_white_space_and_broken_markup():
    text = "a < b > c & d é €"
    assert html_text.main_text(f"<article><p>{html.escape(text)} &#8364;&nbsp;&eacute\n\t x</p>") == f"{text} € é x"
    assert html_text.main_text("<article><p>one<p>two<b>bold<p>three") == "one\ntwobold\nthree"
    assert html_text.main_text(f"<article><p title='a>b' class=x>{SHORT}</p><p>2 < 3") == f"{SHORT}\n2 < 3"
    assert html_text.main_text(f"<article><p>{SHORT}</p><!-- open {LONG}") == SHORT
    assert html_text.main_text(f"<article><p>{SHORT}</p><script>open {LONG}") == SHORT


def test_odd_pages(spark):
    deep = "<div>" * 30_000 + "<p>" + LONG
    many = "<article>" + f"<p>{SHORT}</p>" * 30_000
    quotes = "<a title=\"" * 5_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p></p>"), (None, "u", f"<article>{SHORT}</article>"), (3, "u", "<p></p>"), (4, "u", deep), (5, "u", many), (6, "u", quotes)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), name="text").collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 15), (1, 0), (2, 0), (3, 0), (3, 0), (4, len(LONG)), (5, 16 * 30_000 - 1), (6, 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


_PARAGRAPH = "The river was high in the spring and the people of the town had to take the boat to the other side for their bread. " * 3


def test_names_of_wrappers_and_page_wide_forms_lose_no_article():
    asides = '<div class="sidebar"><p>' + "This is a note of the sidebar that is not a part of the text and was set here by the editor. " * 2 + "</p></div>"
    for opened, closed in (
        ('<div class="layout has-sidebar">', "</div>"), ('<div class="no-sidebar"><article>', "</article></div>"), ('<div id="content-with-toc">', "</div>"),
        ('<div class="legal-article">', "</div>"), ('<form method="post" action="/">', "</form>"), ('<div class="has-sidebar"><main>', "</main></div>"),
    ):
        text = html_text.main_text(f"<html><body>{opened}<h1>Of the river</h1><p>{_PARAGRAPH}</p><p>{_PARAGRAPH}</p>{asides}{closed}</body></html>")
        assert text.count("The river was high") == 6 and "note of the sidebar" not in text, opened


def test_long_comments_beside_an_article_stay_outside():
    text = html_text.main_text(f'<body><div><h1>Of the river</h1><p>{_PARAGRAPH}</p></div><div class="comments">' + f"<p>I was there and {_PARAGRAPH}</p>" * 4 + "</div></body>")
    assert text.count("The river was high") == 3 and "I was there" not in text


def test_other_languages_and_code_in_pages_of_plain_divs():
    polish = "Rzeka płynie przez miasto spokojnie, jej brzegi porastają stare drzewa, mieszkańcy chętnie spacerują tędy każdego wieczoru. " * 2
    menu = '<div><a href="/a">Strona</a> <a href="/b">Kontakt</a></div>'
    text = html_text.main_text(f"<body>{menu}<div><h1>Rzeka</h1><div>{polish}</div><div>{polish}</div></div>{menu}</body>")
    assert text.count("Rzeka płynie") == 4 and "Kontakt" not in text
    code = "def total(rows): return sum(row.price * row.count for row in rows if row.price > 0) # totals, prices, counts"
    names = "Anna Kowalska, Jan Nowak, Piotr Zieliński, Maria Wójcik, Ewa Kamińska, Adam Lewandowski, Zofia Dąbrowska"
    text = html_text.main_text(f"<body>{menu}<div>{_PARAGRAPH}</div><pre>{code}</pre><div>{names}</div><div>{_PARAGRAPH}</div>{menu}</body>")
    assert code in text and names in text and "Kontakt" not in text


def test_quotes_in_unquoted_values_and_elements_that_close_themselves():
    three = f"<article><p>{LONG}</p><p><b title=don't lang=x>{SHORT}</b> it's</p><p>{MORE}</p></article>"
    assert html_text.main_text(three) == "\n".join((LONG, f"{SHORT} it's", MORE))
    for icon in ('<svg class="i"/>', "<svg viewBox='0 0 1 1'/>", "<math/>", '<iframe src="x"/>', "<svg><path d='x'/></svg>"):
        assert html_text.main_text(f"<article><p>{icon}{SHORT}</p><p>{LONG}</p></article>") == f"{SHORT}\n{LONG}", icon
    assert html_text.main_text(f"<article><p title = 'a > b' data-x=\"it's\">{SHORT}</p><p x='>{LONG}</p></article>") == f"{SHORT}\n{LONG}"


def test_deeply_marked_pages_take_no_time():
    import time

    page = "".join(f"<div class=menu>word {n} " for n in range(5000))
    start = time.perf_counter()
    html_text.main_text(page)
    html_text.main_text(page + f"<article><p>{LONG}</p></article>")
    assert time.perf_counter() - start < 1


def test_a_text_column_is_replaced(spark):
    rows = spark.createDataFrame([(f"<article><p>{SHORT}</p>", "old")], "html string, text string")
    found = html_text.extract(rows)
    assert found.columns == ["html", "text"] and found.first().text == SHORT


def by_hand(blocks):
    """The two passes of the rules, from a list of (text, linked share, stop-word share) of one page without regions."""
    labels = []
    for text, linked, stops in blocks:
        if linked > 0.4:
            labels.append(0)
        elif len(text) < 70:
            labels.append(-1)
        else:
            labels.append(1 if stops >= 0.2 or stops >= 0.1 and len(text) >= 200 else -1)
    out = []
    for k, label in enumerate(labels):
        near = sorted((abs(j - k), -x) for j, x in enumerate(labels) if x != -1)
        out.append(label if label != -1 else -near[0][1] if near else 0)
    return [text for (text, *_), label in zip(blocks, out, strict=True) if label == 1]


def test_random_pages_equal_the_rules_by_hand():
    rng = random.Random(4)
    for _ in range(150):
        blocks = []
        for _ in range(rng.randrange(1, 25)):
            kind, n = rng.randrange(5), rng.randrange(1, 60)
            words = ["the" if rng.random() < (0, 0.05, 0.15, 0.3, 0.3)[kind] else rng.choice(["river", "stone", "cat", "lamp"]) for _ in range(n)]
            text = " ".join(words)
            blocks.append((text, float(kind == 4 and rng.random() < 0.5), sum(w == "the" for w in words) / n))
        if not any(len(t) >= 70 and not linked and stops >= 0.1 for t, linked, stops in blocks):
            continue  # another language by the rules
        page = "<body>" + "".join(f"<p><a href=x>{t}</a></p>" if linked else f"<p>{t}</p>" for t, linked, _ in blocks) + "</body>"
        assert html_text.main_text(page) == "\n".join(by_hand(blocks))
