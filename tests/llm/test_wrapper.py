import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import wrapper

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">{n} menu</a></li></ul></nav><div class="ad">buy {n}</div><div class="cookie-notice">We use cookies</div>
<{tag} id="c"><h2>Head {n}</h2><p>First &eacute; <b>bold</b>
 text {n}.<p>Second {long}<br>third<form><input>Send</form><aside>side</aside><div class="comments">said {n}</div></{tag}><footer>&copy; {n}</footer></body></html>"""


def page(n, tag="article"):
    return PAGE.format(n=n, tag=tag, long=f"part {n} " * 20)


def body(n):
    return f"Head {n}\nFirst é bold text {n}.\nSecond {' '.join([f'part {n}'] * 20)}\nthird"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text(spark, tag):
    rows = [(i, f"http://h.example/{i}", page(i, tag)) for i in range(8)] + [(99, None, None), (98, "::", ""), (97, "http://one.example/", page(5, tag)), (0, "http://h.example/0", page(0, tag))]
    docs = spark.createDataFrame([(*r, "host", "wrapper", 1) for r in rows], "page_id long, url string, html string, host string, wrapper string, h int")
    got = wrapper.extract_pages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r["page_id"] in (98, 99) else body(5 if r["page_id"] == 97 else r["page_id"])
        assert r["text"] == want and r["n_chars"] == len(want)
    assert wrapper.extract_pages(docs.limit(0)).count() == 0


def test_constant_text_is_template():
    plain = "<html><body><div class='box'><p>Same line on all pages of the site, always.</p></div><div class='main'><p>{0} {0} {0} own words here, and more of them to read.</p></div></body></html>"
    pages = [plain.format(f"w{i}") for i in range(6)]
    got = wrapper.extract(pages[0], wrapper.induce(pages))
    assert got == "w0 w0 w0 own words here, and more of them to read."


def test_tree_matching_counts_nodes():
    a, b = (wrapper.read(x)[0] for x in ("<div><p>a</p><ul><li>x</li></ul></div>", "<div><p>b</p><ol></ol><ul><li>y</li></ul></div>"))
    weight, pairs = wrapper.tree_match(a, b)
    assert weight == 5 and [(x.tag, y.tag) for x, y in sorted(pairs, key=lambda p: p[0].tag)] == [(t, t) for t in ("#", "div", "li", "p", "ul")]


@pytest.mark.parametrize("broken", ["<p>a<b", "<p>x</b></i></p>y", "<script>never closed", "<!-- open", "&#xZZ; &unknown; &amp", "<a href='>'>t</a>", "<div/>z"])
def test_broken_pages_do_not_fail(broken):
    assert isinstance(wrapper.extract(broken, {}), str)


def test_very_long_page():
    assert wrapper.extract("<article>" + "<p>word</p>" * 50_000 + "</article>", {}).count("\n") == 49_999
    assert wrapper.extract("<div>" * 3000 + "deep" + "</div>" * 3000, {}) == "deep"


@pytest.mark.parametrize(
    "plain, want",
    [
        ("<div id=wrap><h1>Head {0}</h1><div class=body>{1}</div></div>", "Head {0}\n{1}"),
        ("<div class=lead>Lead {0}</div><div class=box><p>Same box</p></div><div class=body>{1}<br>fixed</div>", "Lead {0}\n{1}\nfixed"),
        ("<main><h1>Head {0}</h1><article class=a>{1}</article><div>Same line</div></main>", "Head {0}\n{1}"),
        ("<article class=a>{1}</article><div><article class=b>Other {0}<p>Same</p></article></div>", "{1}\nOther {0}\nSame"),
    ],
)
def test_all_varying_text_is_kept(plain, want):
    values = [(f"n{i}", " ".join([f"long{i}"] * 60)) for i in range(8)]
    pages = [f"<html><body>{plain.format(*v)}</body></html>" for v in values]
    learned = wrapper.induce(pages)
    assert [wrapper.extract(p, learned) for p in pages] == [want.format(*v) for v in values]


def test_every_page_and_layout_teaches(spark):
    """A layout with few of a host's pages has its own wrapper, and its pages lose nothing to the common layout."""
    common = "<html><body><div class=content><p>Fixed teaser</p></div><div class=text><p>{0}</p></div></body></html>"
    rare = "<html><body><div class=content><p>{0}</p></div><div class=note><p>Fixed note</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", (rare if i % 40 == 0 else common).format(f"own{i} " * 9)) for i in range(200)]
    got = wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: " ".join([f"own{i}"] * 9) for i, _, _ in rows}


def test_content_with_odd_names_stays_inside_an_article():
    page = '<article><p class="notice period">Two months.</p><section id="search">How to search.</section><div class="ad">Buy</div><div id="comments">said</div></article>'
    assert wrapper.extract(page, {}) == "Two months.\nHow to search."


@pytest.mark.parametrize("part", ["<a ", "</b>", "<b>", "<p><b>", "<li><i>", "<a href='", '<a x="', "<script>", "&amp", "<!--", "<div id={0}>x</div>", "<ul><li>"])
def test_broken_pages_take_linear_time(part):
    """A megabyte of one broken part is read in seconds."""
    page = "".join(part.format(i) for i in range(1_000_000 // len(part)))
    start = time.process_time()
    wrapper.extract(page, {"0": []})
    assert time.process_time() - start < 30


def brute_match(a, b):
    """The most nodes that an order-preserving match of equal nodes pairs, by trying every pairing of children."""
    if a.tag != b.tag:
        return 0
    own = 3 if a.mark and a.mark == b.mark else 1

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute_match(a.children[i], b.children[j]) + best(i + 1, j + 1))

    return own + best(0, 0)


slots = st.recursive(
    st.builds(wrapper.Slot, st.sampled_from(["div", "p", "ul"]), st.sampled_from(["", "x", "y"])),
    lambda inner: st.builds(wrapper.Slot, st.sampled_from(["div", "p", "ul"]), st.sampled_from(["", "x"]), st.just(1.0), st.lists(inner, max_size=4)), max_leaves=9,
)


@settings(max_examples=150, deadline=None)
@given(slots, slots)
def test_tree_matching_is_the_best_in_order(a, b):
    a, b = wrapper.Slot("#", "", 1.0, [a]), wrapper.Slot("#", "", 1.0, [b])
    weight, pairs = wrapper.tree_match(a, b)
    assert weight == brute_match(a, b) == sum(3 if x.mark and x.mark == y.mark else 1 for x, y in pairs)
    place = [{id(s): k for k, s in enumerate(t.all())} for t in (a, b)]
    found = [(place[0][id(x)], place[1][id(y)]) for x, y in pairs]
    assert all(x.tag == y.tag for x, y in pairs) and sorted(found) == sorted(found, key=lambda f: f[1]) and len(set(found)) == len(found)
    assert wrapper._greedy(a, b, 1)[0] <= weight
    merged = wrapper.merge(wrapper.Slot.of(a.plain()), b)
    assert len(merged.all()) == len(a.all()) + len(b.all()) - len(pairs)
    assert wrapper.tree_match(merged, a)[0] >= brute_match(a, a) and wrapper.tree_match(merged, b)[0] >= brute_match(b, b) - 2 * len(pairs)


def site(r, pages):
    """Pages of one template: fixed and varying blocks in nested containers, an optional block, an id per page, and neighbours that change places."""
    own = lambda i, k: f"own {i} {k} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(8))
    out = []
    for i in range(pages):
        varying = [own(i, k) for k in range(3)]
        head, lead = "<section><p>Fixed head</p></section>", f"<section class='lead'><p>{varying[0]}</p></section>"
        first = [(head, None), (lead, varying[0])]
        if r.random() < 0.3:
            first.reverse()
        extra = "<blockquote>Fixed extra</blockquote>" if i % 5 < 3 else ""
        body = f"<div id='p{i}'><h2>{varying[1]}</h2>{extra}<ul><li>Fixed item</li></ul><p>{varying[2]}</p></div>"
        page = f"<html><body><div class='box post-{i}'>{''.join(h for h, _ in first)}{body}</div><section><p>Fixed end</p></section></body></html>"
        out.append((page, "\n".join([t for _, t in first if t] + varying[1:])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_generated_sites_equal_their_slots(spark, seed):
    """The whole operator against the values that filled the slots, on several sites at once, one of them far larger than a partial template."""
    import random

    r = random.Random(seed)
    rows = [(h, *p) for h in range(3) for p in site(r, [12, 25, 60][h])]
    frame = spark.createDataFrame([(i, f"http://host{h}.example/{i}", page) for i, (h, page, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in wrapper.extract_pages(frame.repartition(5)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}
    one = [page for h, page, _ in rows if h == 2]
    known = wrapper.induce(one)
    assert [wrapper.extract(p, known) for p in one] == [want for h, _, want in rows if h == 2]


def test_partial_templates_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "SHAPES", 1)
    import random

    rows = [(i, "http://h.example/", page, want) for i, (page, want) in enumerate(site(random.Random(7), 80))]
    frame = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string")
    assert {x["page_id"]: x["text"] for x in wrapper.extract_pages(frame).collect()} == {x[0]: x[3] for x in rows}


def induced(pages):
    known = wrapper.induce(pages)
    return [wrapper.extract(p, known) for p in pages]


def test_ids_of_pages_do_not_stop_the_alignment():
    pages = [f"<html><body><div id='p{i}'><p>Fixed line</p><p class='t{i}'>own words {i}</p></div></body></html>" for i in range(8)]
    assert induced(pages) == [f"own words {i}" for i in range(8)]


def test_a_page_of_which_nothing_varies_is_empty():
    pages = [f"<html><body><div><p>Fixed A line</p></div><div class='slot'><p>own {i} text</p></div><div><p>Fixed B line</p></div></body></html>" for i in range(8)]
    blank = "<html><body><div><p>Fixed A line</p></div><div class='slot'></div><div><p>Fixed B line</p></div></body></html>"
    assert induced([*pages, blank]) == [*(f"own {i} text" for i in range(8)), ""]


def test_names_do_not_remove_aligned_varying_text():
    pages = [f"<html><body><div class='search-results'><p>long main text {i}</p></div><div class='post'><section class='notice'>note {i}</section></div><div class='banner-box'>Fixed</div></body></html>" for i in range(8)]
    assert induced(pages) == [f"long main text {i}\nnote {i}" for i in range(8)]


def test_copies_of_one_article_keep_it():
    pages = [f"<html><body><nav>n{i}</nav><div class=ad>ad {i}</div><article><h1>Same</h1><p>The same article.</p></article></body></html>" for i in range(8)]
    assert induced(pages) == ["Same\nThe same article."] * 8


def test_constant_containers_of_an_article_are_template():
    pages = [f"<html><body><article><h1>Head {i}</h1><h2>Summary</h2><p>words {i}</p><div class='mail'><p>Get our mail</p></div></article></body></html>" for i in range(8)]
    assert induced(pages) == [f"Head {i}\nSummary\nwords {i}" for i in range(8)]


@settings(max_examples=150, deadline=None)
@given(slots, slots)
def test_long_lists_of_children_are_matched_as_short_ones(a, b):
    a, b = wrapper.Slot("#", "", 1.0, [a, *a.children, a]), wrapper.Slot("#", "", 1.0, [*b.children, b, b])
    weight, pairs = wrapper.tree_match(a, b)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wrapper, "WIDEST", 0)
        other, found = wrapper.tree_match(a, b)
    assert other == weight and [(id(x), id(y)) for x, y in found] == [(id(x), id(y)) for x, y in pairs]


def test_a_moved_child_of_many_costs_its_own_match_only():
    a = wrapper.Slot("#", "", 1.0, [wrapper.Slot("div", f"c{k}") for k in range(300)])
    b = wrapper.Slot("#", "", 1.0, a.children[1:] + a.children[:1])
    assert wrapper.tree_match(a, b)[0] == 1 + 3 * 299
