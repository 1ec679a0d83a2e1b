import random

from corpusmill.llm import html_wrapper as H


def run(pages):
    w = None
    for p in pages:
        x = H.of_page(H.parse(p))
        w = x if w is None else H.merge(w, x)
    w = H.judge(w)
    return [H.page_text(p, w) for p in pages]


def test_article_page_with_broken_markup():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>one.<br><p>two\n  &quot;three&quot; &am</p></article><footer>&copy; x</footer>'
    assert run([page]) == ['Head & line one. two "three" &am']


def test_places_of_a_host_without_article_element():
    pages = [f'<body><div id=top><a href=/>Home</a> <a href=/b>About</a></div><div><p>Story number {i} is long enough.<p>Its second part {i * 7}</div><div>Copyright of all pages</div></body>' for i in range(5)]
    assert run(pages) == [f"Story number {i} is long enough. Its second part {i * 7}" for i in range(5)]


def test_texts_of_copies_are_no_template():
    page = lambda i, more="": f"<body><div id=top><a href=/>Home</a> <a href=/b>About</a></div><div><p>Story number {i} is long enough.</div>{more}<div id=end>Copyright of all pages</div></body>"
    copy = page(99, "<section><p>Only here.</section>")
    for others, copies in ((20, 3), (4, 6)):
        want = [f"Story number {i} is long enough." for i in range(others)] + ["Story number 99 is long enough. Only here."] * copies
        pages = [page(i) for i in range(others)] + [copy] * copies
        assert run(pages) == want
        assert run(pages[::-1]) == want[::-1]


def test_what_is_not_the_article():
    page = '<html><body><header><h1>Site</h1></header><div class="side-bar sidebar">s</div><main><article><header><h2>T</h2></header><p>x<ul><li>a<li>b</ul><form>f<input></form><div class="cookie-notice">c</div><table><tr><td>1<td>2</table></article><aside>q</aside><section id="comments"><article class="comment"><p>no</p></article></section></main><div hidden>h</div><footer>f</footer>'
    assert run([page]) == ["T x a b 1 2"]


def test_wrappers_find_repeats_and_options():
    a = H.of_page(H.parse("<article><h1>A</h1><p>1</p><p>2</p><p>3</p></article>"))
    b = H.of_page(H.parse("<article><h1>B</h1><p>1</p><hr><div>note</div></article>"))
    w = H.merge(a, b)
    article = w.parts[0]
    assert [p.sig for p in article.parts] == ["h1", "p", "div"]
    assert article.parts[1].repeated and article.parts[2].seen == 1 < article.seen
    assert article.parts[0].parts[0].text is None
    c = H.of_page(H.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert [p.sig for p in c.parts[0].parts] == ["(dt dd)"]


def test_groups_with_equal_neighbours_keep_their_width():
    for tags in (["h2", "p", "p"] * 2, ["dt", "dd", "dd"] * 3):
        pages = ["<article>" + "".join(f"<{t}>{t} {i} {k}</{t}>" for k, t in enumerate(tags)) + "</article><footer>f</footer>" for i in range(3)]
        assert run(pages) == [" ".join(f"{t} {i} {k}" for k, t in enumerate(tags)) for i in range(3)]
    group = H.merge(*[H.of_page(H.parse(p)) for p in pages[:2]]).parts[0].parts[0]
    assert group.sig == "(dt dd dd)" and [p.sig for p in group.parts] == ["dt", "dd", "dd"]


def test_merging_is_the_same_in_any_grouping():
    rng = random.Random(3)
    pages = ["<article>" + "".join(f"<{t}>{rng.randrange(9)}</{t}>" for t in rng.choices(["p", "h2", "ul"], k=rng.randrange(1, 8))) + "</article><footer>f</footer>" for _ in range(12)]
    whole = run(pages)
    left = H.merge(*[__import__("functools").reduce(H.merge, [H.of_page(H.parse(p)) for p in part]) for part in (pages[:5], pages[5:])])
    H.judge(left)
    for p, want in zip(pages, whole, strict=True):
        out = []
        H.extract(H.parse(p), left, out)
        assert " ".join(out) == want


def test_query_rows(spark, monkeypatch):
    rows = [(1, "http://h.x/a", "<article><p>a  b</p></article>"), (2, "http://h.x/b", None), (3, None, "plain &lt;text&gt;"), (4, "http://h.x/c", ""), (5, "nonsense", "<nav>x</nav>"), (1, "http://h.x/a", "<article><p>a  b</p></article>"), (6, "http://h.x/d", "<article><p>é😀</p></article>"), (7, "http://h.x/e", "<p>lost its article")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, main_text int")
    want = {1: "a b", 2: "", 3: "plain <text>", 4: "", 5: "", 6: "é😀", 7: "lost its article"}
    got = H.op6(pages).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    monkeypatch.setattr(H, "MOST_BROADCAST", 0)  # wrappers that meet their pages in a join
    assert sorted((r["page_id"], r["text"]) for r in H.op6(pages).collect()) == sorted((r["page_id"], r["text"]) for r in got)
    assert H.op6(pages.limit(0)).count() == 0


def test_inline_elements_are_judged_too():
    page = '<article><p>One <span class="advert">buy <b>now</b></span>two <span hidden>secret</span>three <a class="related" href=x>four</a><i style="display: none">no</i>.</p><p>Five <span class="ad">never closed</p><p>six</p></article>'
    assert run([page]) == ["One two three four. Five six"]


def test_raw_content_ends_where_it_is_closed():
    assert run(["<article><script src=/js/>code</script><p>a</p><svg class=x /><p>b</p><svg><text>c</text></svg></article>"]) == ["a b"]


def test_names_are_read_whole():
    inside = lambda attributes, text="kept": f"<article><p>x</p>{attributes.replace('>', '>' + text, 1)}<p>y</p></article>"
    for kept in ('<div class="story related-topic"></div>', '<section class="notice-board"></section>', '<p class="social"></p>', '<div class="adverbs"></div>', '<div id="header-story"></div>'):
        assert run([inside(kept)]) == ["x kept y"], kept
    for gone in ('<div class="cookie-notice"></div>', '<div class="adSlot"></div>', '<section id="comments-list"></section>', '<div class="related-posts"></div>', '<div class="share_buttons"></div>', '<p class="ad"></p>', '<ul class="nav-main"></ul>', '<div class="newsletter-signup-box"></div>', "<footer></footer>", "<aside></aside>"):
        assert run([inside(gone, "gone")]) == ["x y"], gone
    assert run(['<body><nav>n</nav><div class="post-comments-open"><p>kept</p></div><div class="comments">c</div></body>']) == ["kept"]


def test_what_pages_show_decides_inside_an_article_too():
    pages = [f"<nav>n</nav><article><h1>News</h1><p>Story {i} of many.</p><div>Read more on our app today</div><p>Its end, number {i * 3}.</p></article>" for i in range(20)]
    assert run(pages) == [f"News Story {i} of many. Its end, number {i * 3}." for i in range(20)]
    # long varying prose outweighs a weak name, short or unchanging text does not
    prose = lambda i: " ".join(f"sentence {i} {k} of a section on society" for k in range(20))
    assert run([f'<article><p>a {i}</p><div class="social">{prose(i)}</div></article>' for i in range(4)]) == [f"a {i} {prose(i)}" for i in range(4)]
    assert run([f'<article><p>a {i}</p><div class="social">follow us</div></article>' for i in range(4)]) == [f"a {i}" for i in range(4)]
    # pages of one article are no template, whatever else changes
    assert run([f"<div class=ad>{i}</div><article><p>One story.</p></article>" for i in range(9)]) == ["One story."] * 9


def test_pages_of_any_depth_and_width():
    deep = "<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>end</article>"
    wide = "<article>" + "<p>w</p><h2>v</h2><ul><li>u</ul><h3>t" * 25_000 + "</article>"
    rng = random.Random(5)
    mixed = ["<article>" + "".join(f"<{t} class={rng.choice('abcdefgh')}>{t}</{t}>" for t in rng.choices(["p", "h2", "div", "section", "table"], k=30_000)) + "</article>" for _ in range(2)]
    pages = [deep, deep.replace("deep", "two"), wide, *mixed]
    got = run(pages)
    assert got[0] == "deep end" and got[1] == "two end" and got[2] == " ".join(["w v u t"] * 25_000)
    for page, text in zip(mixed, got[3:], strict=True):
        assert text.split() == [x.split(">")[0] for x in page.split("</")[1:-1]]
    w = H.of_page(H.parse(deep))
    assert H._pack(H._unpack(H._pack(w))) == H._pack(w)
    assert run(["<div>" * 3000 + "</p>" * 3000 + "<li>" * 3000 + "x"]) == ["x"]


def test_alignment_keeps_order_and_finds_what_is_common():
    rng = random.Random(6)
    for size, names in ((30, 4), (1500, 40), (1500, 5000)):
        a, b = ([str(rng.randrange(names)) for _ in range(size)] for _ in range(2))
        pairs = H.align(a, b)
        assert [i for i, _ in pairs if i >= 0] == list(range(size)) and [j for _, j in pairs if j >= 0] == list(range(size))
        assert all(i < 0 or j < 0 or a[i] == b[j] for i, j in pairs)
    assert sum(i >= 0 <= j for i, j in H.align(a, a[:700] + ["new"] + a[700:])) == size


def test_wide_varied_hosts_keep_every_text(monkeypatch):
    monkeypatch.setattr(H, "WIDEST", 20)
    pages = ["<article>" + "".join(f'<div class="x{chr(97 + (i * 7 + k) % 26)}{chr(97 + k % 26)}"><p>t{i} {k}</p></div><div class="ad">a</div>' for k in range(40)) + "</article>" for i in range(6)]
    assert run(pages) == [" ".join(f"t{i} {k}" for k in range(40)) for i in range(6)]


def _made_page(rng, i):
    """A page with its main text known: blocks of an article among furniture."""
    word = lambda: rng.choice(["river", "stone", "über", "naïve", "a&amp;b", "x &lt; y", "漢字", "end."])
    say = lambda n: " ".join(word() for _ in range(rng.randrange(1, n)))
    plain = lambda t: t.replace("&amp;", "&").replace("&lt;", "<")
    body, want = "", []
    for _ in range(rng.randrange(0, 9)):
        kind = rng.choice(["p", "h2", "ul", "quote", "inline", "ad", "nav", "share", "script", "comment"])
        t = f"{say(30)} {i} {rng.randrange(10**6)}"
        if kind in ("p", "h2"):
            body += f"<{kind}>{t}" + ("" if kind == "p" and rng.random() < 0.5 else f"</{kind}>")
            want.append(plain(t))
        elif kind == "ul":
            items = [say(5) + f" {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 5))]
            body += "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
            want += map(plain, items)
        elif kind == "quote":
            body += f"<blockquote><p>{t}</p>\n<p>{t}</p></blockquote>"
            want += [plain(t)] * 2
        elif kind == "inline":
            body += f"<p>{t}\n <b>bold</b><span class=ad>{say(4)}</span> <em>so</em></p>"
            want.append(plain(t) + " bold so")
        else:
            body += {"ad": f'<div class="ad">{t}</div>', "nav": f"<nav><a href=x>{t}</a></nav>", "share": f'<div class="share-buttons">{say(5)}</div>', "script": f"<script>var a = '<p>{i}</p>';</script>", "comment": f"<!-- {t} -->"}[kind]
    main = rng.choice(["article", "main", 'div class="post-content"'])
    page = f"<html><head><title>{say(5)}</title></head><body><header>{say(5)}</header><nav><ul><li><a href=/>{say(3)}</a></ul></nav><{main}>{body}</{main.split()[0]}><aside>{say(9)}</aside><section class=comments><p>{say(9)}</p></section><footer>&copy; {say(9)}</footer></body></html>"
    return page, " ".join(want)


def test_query_gives_the_texts_that_pages_were_made_of(spark, monkeypatch):
    rng = random.Random(11)
    made = [_made_page(rng, i) for i in range(300)]
    rows = [(i, f"https://www.h{i % 7}.example/{i}", page) for i, (page, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for limit, unit in ((16 << 20, 4096), (0, 10)):
        monkeypatch.setattr(H, "MOST_BROADCAST", limit)
        monkeypatch.setattr(H, "PAGES_A_UNIT", unit)
        got = {r["page_id"]: r for r in H.op6(pages).collect()}
        assert len(got) == 300
        for i, (page, want) in enumerate(made):
            assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want)), page
