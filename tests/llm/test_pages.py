"""Wrappers: the notation, awkward markup, and articles of hosts without an article element."""

from latelane.llm import wrappers as W
from latelane.llm.queries import op5_html_extraction, oracle_sql
from registry.compare import difference, duck
from tests.conftest import SF


def shape(page):
    return W.shape(list(W.blocks(page)))


def texts(page):
    return [(".".join(p), t) for p, t, _ in W.blocks(page) if t]


def test_blocks_of_awkward_markup():
    page = "<p>a &amp; <b>b\n\n c</b><br>d<p>e<script>var x='</p>'</script><ul><li>1<li>2 &lt;x&gt;</ul>tail<!-- no --> <a href='x'>y"
    assert [t for _, t in texts(page)] == ["a & b c d", "e", "1", "2 <x>", "tail y"]
    assert texts("") == [] and texts("<<<>") != [] and list(W.blocks("<div" * 5)) == []
    assert texts('<p style="overflow:hidden" title="class=ad">x</p>')[0][0] == "p"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert [t for _, t in texts(deep)] == ["x"] and W.load(W.dump(shape(deep))) == shape(deep)
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == [("table.tr.td", "a"), ("table.tr.td", "b"), ("table.tr.td", "c")]


def test_repetitions_and_options():
    one = shape("<nav><ul><li><a>x</a><li>y</ul></nav><h1>t</h1><p>a<p>b")
    assert W.expression(one) == "nav(ul((li(#))+)) h1(#) (p(#))+"
    two = shape("<nav><ul><li>x</ul></nav><div class='ad'>buy</div><h1>t</h1><p>a")
    both = W.align(one, two)
    assert W.expression(both) == "nav(ul((li(#))+)) (div.ad(#))? h1(#) (p(#))+"
    assert W.align(both, one) == both and W.align(both, two) == both
    assert W.expression(shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "dl((dt(#))+ (dd(#))+)"
    assert W.align((), one) == tuple((n[0], n[1], True, n[3]) for n in one)


def filled(wrapper, page):
    parts = list(W.blocks(page))
    slots = W.Template(wrapper).match(parts)
    return [(slot, text) for (slot, _), text in zip(slots, [t for _, t, _ in parts if t], strict=True)]


def test_pages_fill_the_slots_of_a_wrapper():
    one, two = "<div>menu</div><h1>t</h1><dl><dt>a<dd>b<dt>c<dd>d</dl><div>end</div>", "<h1>t</h1><p>x<p>y<dl><dt>e</dl><div>end</div>"
    wrapper = W.align(shape(one), shape(two))
    assert W.expression(wrapper) == "(div(#))? h1(#) (p(#))* dl((dt(#))+ (dd(#))*) div(#)"
    first, second = dict((t, s) for s, t in filled(wrapper, one)), dict((t, s) for s, t in filled(wrapper, two))
    assert first["menu"] != first["end"] == second["end"] and first["t"] == second["t"]
    assert first["a"] == first["c"] == second["e"] and first["b"] == first["d"] != first["a"] and second["x"] == second["y"]
    # Passing over something needed only where no repetition can be taken up again.
    again = W.align(shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>"), shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert len({s for s, t in filled(again, "<dl><dt>1<dd>2<dt>3<dd>4<dt>5</dl>") if t in "135"}) == 1
    # What the wrapper lacks is filled too, under its own labels.
    assert [t for _, t in filled(wrapper, "<h2>new</h2><div>menu</div><section><p>deep</p></section>")] == ["new", "menu", "deep"]
    assert filled((), "") == [] and [t for _, t in filled((), "<p>x")] == ["x"]


def test_boxes_inserted_into_articles(spark):
    """An optional box with one text on many pages is the host's; headings, repeated pages and boxes of their own text are not."""
    box = "<div class=x><p>Our spring offer ends soon.</p></div>"
    page = "<article><h1>T{0}</h1><p>story {0} of many words, unlike the others</p>{1}<h2>Sources</h2><p>end {0}</p></article>"
    rows = [(i, f"http://box.org/{i}", page.format(i, box if i % 3 else "")) for i in range(30)]
    rows += [(100 + i, f"http://copy.org/{i}", page.format(0, box)) for i in range(12)] + [(120, "http://copy.org/x", page.format(1, ""))]
    rows += [(200 + i, f"http://own.org/{i}", page.format(i, f"<div class=x><p>aside {i}</p></div>" if i % 3 else "")) for i in range(30)]
    got = {r.page_id: r.text for r in W.extract(site(spark, rows)).collect()}
    story = "T{0}\nstory {0} of many words, unlike the others\n{1}Sources\nend {0}"
    assert [got[i] for i in range(30)] == [story.format(i, "") for i in range(30)]
    assert {got[100 + i] for i in range(12)} == {story.format(0, "Our spring offer ends soon.\n")}
    assert [got[200 + i] for i in range(30)] == [story.format(i, f"aside {i}\n" if i % 3 else "") for i in range(30)]


def test_slots_of_one_path_are_told_apart(spark):
    """Two plain blocks of one path, the host's before the heading and the story after it."""
    page = "<body><div>Daily news from the town and the country around it, every morning at six</div><h3>{0}</h3><div>story {0} here</div></body>"
    rows = [(i, f"http://town.org/{i}", page.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in W.extract(site(spark, rows)).collect()}
    assert [got[i] for i in range(20)] == [f"{i}\nstory {i} here" for i in range(20)]


ARTICLE = "<article class=post><h1>T</h1><p>one</p><div class='share-bar'>Share</div><p>two</p></article>"


def site(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, ["y"]) for i, u, h in rows], "page_id long, url string, html string, host string, k int, article array<string>")


def test_articles(spark):
    frame = "<html><head><title>x</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>home</a></ul></nav>{}<footer>f</footer>"
    rows = [(1, "http://a.org/1", frame.format(ARTICLE)), (2, "http://A.org:80/2?x", frame.format("<p>no article here")),
            (3, "https://b.org", frame.format("<div id=main-content><p>only</p></div><div class=sidebar><p>side</p></div>")),
            (4, None, None), (5, "http://c.org", ""), (None, "bad url", "<article>&eacute;&#x41;</article>"), (6, "http://d.org", ARTICLE + "<div class=comments><p>reader</p></div>")]
    story = "<div class=top>Welcome back</div><div class=x1><div class=y><p>{0} story of page {0} " + "long " * 30 + "</p><p>second {0}</p></div></div>"
    rows += [(100 + i, f"http://plain.org/{i}", frame.format(story.format(i))) for i in range(12)]
    got = {r.page_id: r for r in W.extract(site(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1].text == "T\none\ntwo" and got[1].n_chars == 9 and got[1].url == "http://a.org/1"
    assert got[2].text == "no article here" and got[3].text == "only" and got[4].text == "" and got[5].text == ""
    assert got[None].text == "éA" and got[6].text == "T\none\ntwo"
    assert got[105].text.startswith("5 story of page 5") and got[105].text.endswith("\nsecond 5")
    assert W.extract(site(spark, [])).count() == 0


def test_mixed_templates_and_pages_without_a_host(spark):
    """Each page's article is where its own template has it; truths written by hand."""
    frame = "<body><nav><a href=/>home</a></nav>{}<footer>f</footer></body>"
    pages = ["<article><p>first</p></article>", "<main><h1>M</h1><p>second</p></main>", "<div id=content><p>third</p></div>",
             "<div><p>fourth of plain blocks</p><p>more of it</p></div>"]
    want = ["first", "M\nsecond", "third", "fourth of plain blocks\nmore of it"]
    rows = [(i, f"http://mixed.org/{i}", frame.format(p)) for i, p in enumerate(pages)]
    rows += [(10 + i, None if i % 2 else "no host", frame.format(p)) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in W.extract(site(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == want == [got[10 + i] for i in range(4)]


def test_names_inside_the_article(spark):
    page = ("<article><h1>T</h1><div class=related-work><p>Earlier papers.</p></div><div class=search-algorithms><p>A star.</p></div>"
            "<div class=related-posts><p>More</p></div><div class='ad-slot top'>Buy</div><div class=share-bar>Share</div><p>end</p></article>")
    got = W.extract(site(spark, [(1, "http://a.org", page)])).first()
    assert got.text == "T\nEarlier papers.\nA star.\nend"


def test_deep_markup_inside_the_article(spark):
    deep = "<body><article><div>" + "<div>" * 150 + "<p>deep</p>" + "</div>" * 150 + "<p>after</p></div><p>last</p></article><footer>f</footer>"
    got = W.extract(site(spark, [(1, "http://a.org", deep)])).first()
    assert got.text == "deep\nafter\nlast"


def test_a_site_whose_pages_are_all_alike(spark):
    rows = [(i, f"http://same.org/{i}", "<div class=x><p>The one text of this site.</p></div>") for i in range(12)]
    assert {r.text for r in W.extract(site(spark, rows)).collect()} == {"The one text of this site."}


def test_hot_host_is_reduced_in_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)
    rows = [(i, "http://one.org/", "<article>" + "".join(f"<h{1 + (i >> b & 1)}>x</h{1 + (i >> b & 1)}>" for b in range(5)) + f"<p>{i}</article>") for i in range(32)]
    found = W.infer(site(spark, rows)).collect()
    assert len(found) == 1 and found[0].host == "one.org"
    assert all(r.text.endswith(f"\n{r.page_id}") for r in W.extract(site(spark, rows)).collect())


def test_query_equals_sql(spark):
    ours = op5_html_extraction(spark, SF).toPandas()
    assert difference(ours, duck(SF).execute(oracle_sql()["op5_html_extraction"]).df()) is None
