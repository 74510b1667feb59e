import random

from veilframe.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name and motto, long.</header>
<div id="cookie-notice">We use cookies. Accept them now please, thanks.</div><nav><ul><li><a href=a>Home</a></li></ul></nav>
<div class="content"><h1>Title</h1><div><p>Para one, with &lt;b&gt; text &amp; more.</p><ul><li>Item one is here.<li>Item two</ul>
<p title="a > b">Second   paragraph <a href=x>link</a>,<br>and <i>so</i> on.<script>x="<p>no</p>"</script></p></div><pre>a
 b</pre></div><div class="sidebar"><p>Side text, that is long. And more of it is here.</p></div>
<section id="comments"><p>Great article, I loved it!</p></section><form><p>Sign up</p></form><footer>&copy; 2020</footer></body></html>"""


def test_article_blocks():
    assert main_text(PAGE).split("\n\n") == ["Title", "Para one, with <b> text & more.", "Item one is here.", "Item two", "Second paragraph link, and so on.", "a b"]


def test_generated_pages_without_a_template_of_their_own():
    rng = random.Random(8)
    for _ in range(60):
        words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
        article = [words(rng.randint(1, 6))] + [", ".join(words(rng.randint(5, 20)) for _ in range(3)) + "." for _ in range(rng.randint(1, 8))]
        box = rng.choice(["article", "main", "div class=post", "section"])
        body = f"<h2>{article[0]}</h2>" + "".join(f"<p>{p}</p>" for p in article[1:])
        page = f"<body><nav>{'<a href=#>x</a> ' * 5}</nav><{box}>{body}</{box.split()[0]}><aside><p>{words(30)}.</p></aside><footer>{words(9)}</footer>"
        assert main_text(page) == "\n\n".join(article)


def test_odd_pages(frame):
    odd = {None: "", "": "", "plain text only": "plain text only", "<p>unclosed <b>x": "unclosed x", "a < b and c": "a < b and c", "<!-- x": "", "<p>a<p>b<div>c": "a\n\nb\n\nc",
           "<nav>only</nav>": "", "<p>&#233;&nbsp;x</p>": "é x"}
    rows = [(i, "u", p, "clash") for i, p in enumerate(odd)] + [(0, "u", "", "clash"), (None, None, "<p>x</p>", None)]
    got = extract(frame(rows, "page_id long, url string, html string, main_text string").drop("main_text")).collect()
    assert {(r["page_id"], r["main_text"]) for r in got} == {*enumerate(odd.values()), (None, "x")} and len(got) == len(rows)
    assert extract(frame(rows[:1], "page_id long, url string, html string, x string").limit(0)).count() == 0


def test_hard_markup_is_linear():
    assert main_text("<div>" * 20_000 + "x") == "x"
    assert main_text('<a "' * 20_000) == ""
    assert len(main_text("<p>hello, world.</p>" * 20_000)) == 20_000 * 15 - 2


def test_large_elements_are_not_left_aside_for_a_word():
    paras = [f"This is paragraph {i} of the text, with some commas, and it ends with a full stop." for i in range(6)]
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in paras)
    rest = "<nav><a href=#>Home</a></nav>%s<div class=sidebar><p>Side text, that is long.</p></div><form><p>Sign up, now.</p></form><footer>Foot, x.</footer>"
    want = "\n\n".join(["Title", *paras])
    for box in ("<div class='content has-sidebar'>%s</div>", "<div id='page' class='with-nav'>%s</div>", "<section class='search-results'>%s</section>",
                "<div class='has-sidebar'><article>%s</article></div>", "<div class='with-nav'><div class='content has-sidebar'>%s</div></div>"):
        assert main_text("<body>" + rest % (box % body)) == want, box
    # a form around the whole page, with the other parts inside
    assert main_text("<body><form id='aspnetForm'>" + (rest % f"<div>{body}</div>").replace("form>", "div>").replace("<div><p>Sign", "<div class=signup><p>Sign") + "</form>") == want
    comments = "<section id=comments>" + "".join(f"<article><p>Comment {i}, that I wrote, is not the text.</p></article>" for i in range(9)) + "</section>"
    assert main_text("<body>" + rest % f"<main>{body}</main>{comments}") == want
    assert main_text("<body>" + rest % f"<main>{body}</main><div class=comments><p>{' '.join(paras * 2)}</p></div>") == want
    assert main_text("<div class=sidebar>" * 20_000 + "x") == "x"
    assert main_text("<body>" + rest % f"<div class=with-nav><article>{body}</article>{comments}</div>") == want
