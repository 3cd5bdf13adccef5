"""What belongs to an article stays, whatever its anchors are called."""

import re
from collections import Counter

import pytest

from scholia.llm import html as H


def test_anchors_and_names_inside_an_article_are_text():
    body = "<section id='discussion'><h2 id='side-effects'>Side</h2><p class='legal'>law</p></section><h3 id='related-work'>Rel</h3><div id='search-algorithms'>alg</div><div class='search-tree'>tree</div>"
    for page in (f"<article>{body}</article>", f"<body>{body}</body>"):
        assert H.lone_text(H.parse(page)) == "Side\nlaw\nRel\nalg\ntree"
    for gone in ("<div class='x ad'>", "<div id='comments'>", "<div class='cookie-notice'>", "<ul class='pagination'>", "<section class='comment-list'>", "<div class='newsletter'>", "<div role='navigation'>", "<div class='site-header'>"):
        assert H.lone_text(H.parse(f"<article><p>kept</p>{gone}out")) == "kept"


def test_a_logo_as_heading_and_notices_inside_articles(spark):
    page = lambda i, top: f"<html><head><title>News {i}</title></head><body>{top}<div class='top'>Welcome</div>%s</body></html>"
    article = lambda i: f"<article><h1>Title {i}</h1><h2>Sources</h2><p>Own {i}</p><p>Read more with us.</p><ul><li>Join</li></ul></article>"
    logo = "<header><h1>Site</h1></header>"
    rows = [(i, "http://a.org", page(i, logo) % article(i)) for i in range(8)]
    rows += [(10 + i, "http://b.org", page(i, logo) % f"<p>Own {i}</p>") for i in range(8)]
    rows += [(20 + i, "http://c.org", page(i, logo) % f"<main><p>Own {i}</p><div>Follow</div></main>") for i in range(8)]
    rows += [(30 + i, "http://d.org", page(i, "<div><h1>Site</h1></div>") % f"<h1>Title {i}</h1><p>Own {i}</p>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\nSources\nOwn {i}" and got[10 + i] == got[20 + i] == f"Own {i}" and got[30 + i] == f"Title {i}\nOwn {i}"


def test_an_article_keeps_what_only_sounds_like_furniture():
    page = "<article><h1>Side effects</h1><div class='search-results'><p>Body</p></div><p class='legal'>Law text</p><div class='legal-analysis'>Case</div><section class='search'>Trees</section><math>x</math> <label>l</label><fieldset>f</fieldset></article>"
    assert H.lone_text(H.parse(page)) == "Side effects\nBody\nLaw text\nCase\nTrees\nx l\nf"


def test_counts_alone_tell_furniture(spark):
    """Pages without articles, telling tags or telling names: only what recurs goes. Rare names stay where a host can be counted."""
    page = lambda i: f"<html><body><div class='q1'><span>Our site</span><div>Home</div></div><div class='q2'><h1>Title {i}</h1><div>First {i}</div><div>Second {i}</div></div><div class='q3'>All rights {'kept' if i % 2 else 'held'}</div></body></html>"
    rows = [(i, "http://plain.org/a", page(i)) for i in range(12)] + [(50, "http://few.org/a", page(0))]
    # with articles, what stands outside is known by its structure: other words, or other numbers of like entries, don't hide it; text that doesn't recur stays
    with_article = lambda i: f"<body><div class='m'>{'<a>x</a>' * (i % 3 + 1)}</div><article><h1>Title {i}</h1><p>Own {i}</p></article><div class='z'><b>Word {i}</b></div>{'<p>Late addition</p>' if i == 3 else ''}</body>"
    rows += [(100 + i, "http://art.org/a", with_article(i)) for i in range(12)]
    # names count as well: adverts of other words in every article go, a name that one article has stays
    named = lambda i: f"<article><h1>Title {i}</h1><div class='ad'>Buy {i}</div><p>Own {i}</p>{'<div class=share>Shares of the firm</div>' if i == 3 else ''}</article>"
    rows += [(200 + i, "http://ads.org/a", named(i)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(pages).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nFirst {i}\nSecond {i}"
        assert got[100 + i] == f"Title {i}\nOwn {i}" + ("\nLate addition" if i == 3 else "")
        assert got[200 + i] == f"Title {i}\nOwn {i}" + ("\nShares of the firm" if i == 3 else "")
    assert got[50] == "Our site\nHome\nTitle 0\nFirst 0\nSecond 0\nAll rights held"


def test_templates_decide_on_the_table(spark):
    """Without templates the adverts of hosts that can be counted would stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", H.host_of(pages.url).alias("host"))
    templates = {r["host"]: r["template"] for r in H.site_templates(rows).collect() if not r["by_name"]}
    changed = counted = 0
    for r in rows.collect():
        if r["host"] in templates:
            counted += 1
            changed += H.main_text(H.parse(r["html"])[0]) != H.lone_text(H.parse(r["html"]))
            nodes = H.parse(r["html"])
            for d, _, node in H.candidates(nodes):
                node.gone = node.gone or d in templates[r["host"]]
            assert H.main_text(nodes[0]) == H.lone_text(H.parse(r["html"])), "counts alone tell what names tell"
    assert counted > 100 and changed == counted


ODD = {
    "attribute values": ("<article data-title='The hidden river' data-x=class=ad><p title='a hidden gem' aria-label='style=display:none'>One</p><p data-id=comments>Two</p></article>", "One\nTwo"),
    "a form round the page": ("<form id=aspnetForm action='/x'><div><input value=v><label>Search</label></div><article><h1>Head</h1><p>Body</p></article><select><option>o</select></form><form><p>Write to us</p><label>Mail</label></form>", "Head\nBody"),
    "a form round a page without article": ("<form><label>Find</label><h1>Head</h1><p>Body</p><button>Go</button></form>", "Head\nBody"),
    "stray quotes": ("<article><p title=it's>One</p><p class=a\"b>Two</p><p>it's</p><a href=x'y>three</a><p \">Four</p></article>", "One\nTwo\nit's\nthree\nFour"),
    "quoted brackets": ("<article><p title='a > b' data-y=\"</p><p>\">One</p><br/><img alt='>'/>x</article>", "One\nx"),
    "comments": ("<article><p>One</p><section id='comments'><p>c</p></section><div class='user-comments'>d</div><div class='reader_comments x'>e</div><ul class='article-replies'><li>f</ul></article>", "One"),
    "states that name comments": ("<body><div class='has-comments'><p>One</p></div><div class='no-comments page'>Two</div></body>", "One\nTwo"),
    "hidden": ("<article><p hidden>a</p><p hidden=''>b</p><p style='color:red; display : none'>c</p><p aria-hidden=true>d</p><p HIDDEN CLASS=x>e</p><p style='--hidden:1'>One</p></article>", "One"),
    "repeated attributes": ("<article><div class=a class=ad>One</div><div id='x' class='&#97;d'>no</div></article>", "One"),
    "unfinished tags": ("<article><p>One</p><p title='never closed>Two</p></article>", "One"),
}


@pytest.mark.parametrize("case", sorted(ODD))
def test_odd_markup(case):
    page, text = ODD[case]
    assert H.lone_text(H.parse(page)) == text


def test_notices_outside_articles_go_on_counted_hosts(spark):
    rows = [(i, "http://n.org", f"<div class='m1'>M</div>{'<div class=notice>one-off notice</div>' if i == 3 else ''}<article><h1>T{i}</h1><p>Own {i}</p><div class='user-comments'>Nice {i}</div></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nOwn {i}" for i in range(8)}


def test_small_hosts_are_counted_by_domain_then_together(spark):
    page = lambda i, top: f"<div class='q'>{top}</div><div class='z'><h1>Title {i}</h1><div>Own {i}</div></div>"
    rows = [(i, f"http://u{i}.blog.org/", page(i, "Hosted by Blog")) for i in range(6)] + [(20 + i, f"http://s{i}.net/", page(20 + i, "We value your privacy")) for i in range(6)] + [(40, "http://alone.com/", page(40, "Alone"))]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {r[0]: f"Title {r[0]}\nOwn {r[0]}" if r[0] < 40 else "Alone\nTitle 40\nOwn 40" for r in rows}


def counted_by_hand(pages, share=0.5, loose_share=0.02, least=5):
    """Templates by dictionaries: host, then domain, then all, each over the pages that the one before has too few of."""
    seen = {}
    for url, page in pages:
        host = re.match(r"https?://([^/?#:]*)", url or "").group(1).lower() if re.match(r"https?://", url or "") else ""
        nodes = H.parse(page or "")
        seen.setdefault(host, {}).setdefault(H._article(nodes, page or ""), set()).update((d, loose) for d, loose, _ in H.candidates(nodes))
    out, left = {}, dict.fromkeys(seen)
    for level in (lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: "*"):
        sites = {}
        for host in left:
            for article, digests in seen[host].items():
                sites.setdefault(level(host), {}).setdefault(article, set()).update(digests)
        for host in list(left):
            articles = sites[level(host)]
            if len(articles) >= least:
                counts = Counter(d for digests in articles.values() for d in digests)
                out[host] = ({d for (d, loose), n in counts.items() if n >= least and n >= (loose_share if loose else share) * len(articles)}, level(host) != host)
        left = {h: None for h in left if h not in out}
    return out | {h: (set(), True) for h in left}


def test_counting_equals_dictionaries(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html")
    extra = [(f"http://h{i}.{'few.org' if i % 2 else f'd{i}.net'}/", f"<div class=m>Menu</div><div><h1>T {i}</h1><p>{'same' if i % 3 else i}</p></div>") for i in range(14)]
    extra += [("http://h1.few.org/", "<h1>T 1</h1>"), ("", "<p>x</p>")]
    table = pages.union(spark.createDataFrame(extra, "url string, html string"))
    want = counted_by_hand([tuple(r) for r in table.collect()])
    got = {r["host"]: (set(r["template"]), r["by_name"]) for r in H.site_templates(table.select("html", H.host_of(table.url).alias("host"))).collect()}
    assert got == want and any(t for t, by_name in want.values() if by_name)
