import pytest

from laurel.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<div id="cookie-notice"><p>We use cookies.</p></div><main><article><h1>T&eacute;st &amp;amp; more</h1>
<p><b>One<br>two\t <i>three</i>.<br><p>Next <a href="x>y">link</a> a &lt; b.</p><ul><li>first<li>second</ul>
<form><p>Your mail</p></form><aside>Side</aside><section class="comments"><p>Nice!</p></section></article></main>
<div class="sidebar"><p>More</p></div><footer>&copy; host</footer></body></html>"""


def test_article_without_the_rest():
    assert html_text.main_text(PAGE) == "Tést &amp; more\n\nOne two three.\n\nNext link a < b.\n\nfirst\n\nsecond"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p", ""), ("<article><p>a</p><p>b <em>c</em", "a\n\nb c"), ("<article>x &am", "x &am"),
    ("<article>a < b <3</article>", "a < b <3"), ("<article><script>if (a</b) {}", ""), ("<nav>menu</nav>", ""),
    ("<article><!-- never ends <p>x", ""), ("<article>a<!-- <p> -->b</article>", "ab"),
    ("<article><div style='display: none'>x</div><p>y z</article>", "y z"),
])
def test_broken_and_bare_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_an_article_are_judged_by_their_blocks():
    prose = "It is said that the house on the hill was built by the man who has it, and that he will be in it for the year. "
    page = (f"<body><div><a href=1>one</a> <a href=2>two</a></div><h2>On the hill</h2><p>{prose * 3}</p><p>Short one.</p>"
            f"<p>{prose * 2}</p><div>Contact</div><div><a href=3>{prose}</a></div></body>")
    found = html_text.main_text(page).split("\n\n")
    assert found == ["On the hill", (prose * 3).strip(), "Short one.", (prose * 2).strip()]


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<article>" + "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r["page_id"], r["url"]): r for r in html_text.extract(df).collect()}
    assert found[2, None]["text"] == "" and found[2, None]["n_chars"] == 0
    assert found[None, "v"]["n_chars"] == 50_000 * 5 - 1
    assert html_text.extract(df).count() == 4
    assert html_text.extract(df.limit(0)).collect() == []


def test_registered_query(spark):
    from laurel.llm.queries import op4_html_text

    rows = op4_html_text(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("track(" in r["text"] or "©" in r["text"] for r in rows)


PROSE = "It is said that the house on the hill was built by the man who has it, and that he will be in it for the year. "


@pytest.mark.parametrize("wrapper", [
    'class="content has-sidebar"', 'class="no-sidebar"', 'class="with-header"', 'id="search-results"', 'class="layout-sidebar-right"',
    'class="overflow-hidden"', 'class=widget', 'class="page header"'])
def test_a_name_drops_no_element_that_holds_the_text(wrapper):
    side = f'<div class="sidebar"><p>{PROSE}</p></div><div class="comment-list"><p>{PROSE}</p></div>'
    for inner in (f"<article><h1>On the hill</h1><p>{PROSE * 3}</p></article>", f"<h1>On the hill</h1><p>{PROSE * 3}</p>"):
        page = f"<body><nav>menu</nav><div {wrapper}>{inner}</div>{side}</body>"
        assert html_text.main_text(page) == "On the hill\n\n" + (PROSE * 3).strip()


def test_named_elements_beside_the_text_still_go():
    cards = '<div class="related"><article><a href=1>More</a></article><article><a href=2>Other</a></article></div>'
    talk = f'<section class="comments"><article><p>{PROSE * 9}</p></article></section>'
    page = f'<article><p>{PROSE * 3}</p><div id="cookie-notice"><p>We use cookies.</p></div>{cards}{talk}</article>'
    assert html_text.main_text(page) == (PROSE * 3).strip()


def test_text_in_a_div_beside_teasers_that_are_articles():
    teasers = "".join(f"<article><h3><a href={i}>Teaser {i}</a></h3><p>It is of the day.</p></article>" for i in range(5))
    page = f"<body><div><h1>On the hill</h1><p>{PROSE * 4}</p><p>Short one.</p><p>{PROSE * 3}</p></div><div>{teasers}</div></body>"
    assert html_text.main_text(page).split("\n\n") == ["On the hill", (PROSE * 4).strip(), "Short one.", (PROSE * 3).strip()]


def test_link_lists_in_an_article_go_and_its_other_blocks_stay():
    links = "<ul><li><a href=1>The first of them</a></li><li>More</li><li><a href=2>The second of them</a></li></ul>"
    page = f"<article><h1>T</h1><p>{PROSE * 2}</p>{links}<p>Числа и слова, {'и слова ' * 30}.</p><p>End.</p></article><p>Contact</p>"
    found = html_text.main_text(page).split("\n\n")
    assert found == ["T", (PROSE * 2).strip(), f"Числа и слова, {'и слова ' * 30}.", "End."]


def test_a_long_text_outside_of_the_article_is_judged_too():
    page = f"<body><article><p>{PROSE * 3}</p></article><div><p>{PROSE * 3}And more.</p></div><div>Contact us</div></body>"
    assert html_text.main_text(page) == (PROSE * 3).strip() + "\n\n" + PROSE * 3 + "And more."


# Three paragraphs and a heading in languages whose stop words are not known, or hardly.
FOREIGN = {
    "russian": ("Дом на холме", "Говорят, что дом на холме построил человек, который до сих пор в нём живёт и не собирается никуда уезжать. "),
    "greek": ("Το σπίτι", "Λένε πως το σπίτι πάνω στον λόφο χτίστηκε από τον άνθρωπο που μένει ακόμη εκεί και δεν σκοπεύει να φύγει ποτέ. "),
    "arabic": ("البيت على التل", "يقال إن البيت الواقع فوق التل بناه الرجل الذي لا يزال يعيش فيه ولا ينوي الرحيل عنه في هذه السنة أو بعدها. "),
    "hindi": ("पहाड़ी पर घर", "कहा जाता है कि पहाड़ी पर बना घर उसी आदमी ने बनाया था जो आज भी उसमें रहता है और कहीं नहीं जाना चाहता। "),
    "chinese": ("山上的房子", "据说山上的那座房子是由至今仍然住在里面的那个人建造的,他今年也没有打算离开这里到别处去生活。"),
    "japanese": ("丘の上の家", "丘の上にあるその家は、今でもそこに住んでいる人が自分で建てたものだと言われており、引っ越す予定はないそうです。"),
    "korean": ("언덕 위의 집", "언덕 위에 있는 그 집은 지금도 그곳에 살고 있는 사람이 직접 지었다고 하며 올해도 떠날 생각이 없다고 합니다. "),
    "finnish": ("Talo mäellä", "Sanotaan, että mäellä seisovan talon rakensi mies, joka yhä asuu siinä eikä aio muuttaa sieltä minnekään tänä vuonna. "),
    "turkish": ("Tepedeki ev", "Tepenin üstündeki evi hâlâ içinde yaşayan adamın yaptığı ve bu yıl başka yere taşınmayı düşünmediği söyleniyor. "),
    "hungarian": ("Ház", "Azt mondják, hogy hegyen álló házat olyan ember építette, aki máig benne lakik, és idén sem készül elköltözni onnan. "),
}
AROUND = ("{}", '<form id="aspnetForm" action="/"><input type="hidden" name="s" value="x">{}</form>',
          '<div class="page-header-wide">{}</div>', "<fieldset><div>{}</div></fieldset>")


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("language", [*FOREIGN, "english"])
def test_pages_of_any_language_without_an_article(language, around):
    heading, sentence = FOREIGN.get(language, ("On the hill", PROSE))
    text = [heading, (sentence * 3).strip(), (sentence * 4).strip(), (sentence * 2).strip()]
    inner = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    page = f"<body>{around.format(menu + f'<div>{inner}</div>')}<nav>menu</nav><footer><p>{sentence * 2}</p></footer></body>"
    assert html_text.main_text(page).split("\n\n") == text


@pytest.mark.parametrize("page, text", [
    ("<body><p>One short paragraph.</p></body>", "One short paragraph."),
    ("<body><nav>menu</nav><div>It is gone!</div><div>Contact</div></body>", "It is gone!"),
    ("<body><form><p>Your mail.</p></form></body>", ""),
    ("<body><div><a href=1>Home.</a></div><div>Contact</div></body>", ""),
    (f"<body><header><h1>Site</h1></header><p>{PROSE * 3}</p><form><label>Mail</label><p>Your name.</p></form></body>", (PROSE * 3).strip()),
    (f'<body><form><div class="sidebar"><p>{PROSE}</p></div><p>{PROSE * 4}</p></form></body>', (PROSE * 4).strip()),
])
def test_short_pages_and_forms(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("unit, end", [
    ('<a "', ""), ('<a "', ">"), ('<a "x>" ', ""), ("<a '\"", "'>"), ("<" + "a" * 50, ""), ("<b>", "</i>" * 150_000), ("<i><div>", ""),
    ("<b>", "<div></div>" * 50_000), ("<i><div>", "</i>" * 150_000), ("</div>", ""), ("<!--", ""), ("<script>", ""), ("<div class=", ""),
    ('<div class="ad">', ""), ("<p>a. <b>", ""), ("<", ""), ("&am", ""),
])
def test_broken_pages_are_read_in_linear_time(unit, end):
    from time import process_time

    def seconds(size):
        began = process_time()
        html_text.main_text(unit * (size // len(unit)) + end)
        return process_time() - began

    assert seconds(1_000_000) < 10


def test_text_after_quotes_that_never_close():
    assert html_text.main_text(f"<article><p title='x>{PROSE}</p><p class=\"y\">{PROSE}</p></article>") == "\n\n".join([PROSE.strip()] * 2)
