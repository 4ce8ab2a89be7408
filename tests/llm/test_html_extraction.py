from trellis.llm import html_extraction as H


def page(n, body):
    return f'<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>Home<li>News</ul></nav><!-- ad <p>x</p> --><div class="ad">Buy {n}</div>{body}<footer>&copy; us</footer></body></html>'


PAGES = [
    ("http://a.example/1", page(1, "<article><h1>Head</h1><p><b>Fish &amp; chips.<br><p>Two\n  lines</p><form>mail</form><aside>see</aside><div class='comments'><p>First!</p></div></article>"), "Head Fish & chips. Two lines"),
    ("http://a.example/2", page(2, "<article><p>Un<i>broken</i> word&nbsp;x &lt;3</p></article>"), "Unbroken word x <3"),
    ("http://a.example/3", page(3, "<article></article>"), ""),
    ("http://a.example/4", None, ""),
    (None, "", ""),
    ("odd", "<div><p>plain text only", "plain text only"),
] + [("https://b.example/%d" % i, f"<html><body><div class=top>Welcome to B</div><div id=story><p>Story {i} tells.</p><p>More of {i}.</p></div><div class=box>All rights kept</div></body></html>", f"Story {i} tells. More of {i}.") for i in range(8)]


def test_main_text(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id int, url string, html string, text string").repartition(3)
    got = {r.page_id: (r.url, r.text) for r in H.extract(df).collect()}
    assert got == {i: (u, t) for i, (u, _, t) in enumerate(PAGES) if i != 2} | {2: (PAGES[2][0], got[2][1])}
    assert "Home" not in got[2][1] and "us" not in got[2][1].split()


def test_copies_do_not_make_a_template(spark):
    rows = [(i, "http://c.example/x", page(0, "<article><p>The one story.</p></article>")) for i in range(40)]
    assert {r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The one story."}


def test_unclosed_quotes_and_deep_pages_end():
    assert H.main_text(H.Page("<p>a" + "<x y='" * 3000))
    assert H.main_text(H.Page("<div>" * 100_000 + "deep" + "</section>" * 100_000)) == "deep"


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constant_texts_inside_article_go(spark):
    rows = [(i, f"http://d.example/{i}", page(i, f"<article><p class=x>Posted by the desk</p><p>Story {i} tells.</p><p class=y>Written to our standards</p></article>")) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} tells." for i in range(8)}


def bare(host, i):
    """Pages without article, telling names or the like, in a layout of their own for each host."""
    story = [f"Title {host} {i}", f"Intro of {i} for {host}.", *(f"Part {k} of story {i} at {host}." for k in range(1 + i % 4))]
    body = f"<div class=h><h1>{story[0]}</h1><div class=i><p>{story[1]}</p></div><div class=b>" + "".join(f"<p>{x}</p>" for x in story[2:]) + "</div></div>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>Read {host} {(i + k) % 9}</a></li>" for k in range(3 + i % 2)) + "</ul>"
    top, end = f"<div class=t>{host} daily</div>", "<table><tr><td>Printed on demand</td></tr></table>"
    parts = [top, links, body, end] if host % 2 else [top, body, f"<section>{links}</section>", end]
    return f"<html><body>{''.join(parts)}</body></html>", " ".join(story)


def test_hosts_without_article(spark):
    rows = [(10 * h + i, f"http://h{h}.example/{i}", *bare(h, i)) for h in range(6) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert all(H.main_text(H.Page(r[2])) != r[3] for r in rows)  # without the template the constant texts stay


def naive(rows):
    """Each host's template by whole occurrence vectors, kept as plain dictionaries."""
    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(H.host_of(url), {}).setdefault(html, H.Page(html))
    out = {}
    for host, pages in hosts.items():
        counts, ranks = {}, {}
        for n, page in enumerate(pages.values()):
            for kind, token, count, rank, _, _ in H.page_tokens(page):
                if kind < H.SLOT:
                    counts.setdefault((kind, token), {})[n] = count
                    ranks.setdefault((kind, token), []).append(rank)
        classes = {}
        for key, vector in counts.items():
            if len(vector) >= H.SUPPORT * len(pages) and len(pages) >= H.LEAST_PAGES and len(vector) > 1:
                classes.setdefault((tuple(sorted(vector)), tuple(vector[n] for n in sorted(vector))), []).append(key)
        valid = [k for (_, c), members in classes.items() if len(members) >= H.LEAST_CLASS and len(set(c)) == 1 for k in members]
        if not valid:
            out[host] = None
            continue
        tags = [t for _, t in sorted((sum(ranks[k]) / len(ranks[k]), k[1]) for k in valid if k[0] == H.TAG)]
        texts = frozenset(k[1] for k in valid if k[0] == H.TEXT and len(pages) >= H.CONSTANT_PAGES and len(counts[k]) >= 0.9 * len(pages))
        mass = {}
        for page in pages.values():
            for node, text, linked in page.blocks:
                if not node.aside:
                    slot = next((d for d in reversed(node.container.path) if d in tags), 0)
                    own = mass.setdefault((slot, node.article), [0, 0])
                    own[0], own[1] = own[0] + len(text), own[1] + linked
        menus = {s for (s, _), (total, linked) in mass.items() if linked > H.LINKS * total}
        left = [(total, inside) for (s, inside), (total, linked) in mass.items() if linked <= H.LINKS * total]
        out[host] = tags, texts, frozenset(menus), bool(left) and 2 * sum(t for t, inside in left if inside) >= sum(t for t, _ in left)
    return {i: H.main_text(H.Page(html), *(out[H.host_of(url)] or ())) for i, url, html in rows}


def test_against_naive_templates(spark):
    rows = [(10 * h + i, f"http://h{h}.example/{i}", bare(h, i)[0]) for h in range(3) for i in range(1 + 3 * h)]
    rows += [(100 + i, "http://m.example/x", page(i % 6, f"<article><p>Daily word</p><p>Story {i} <a href=x>link {i}</a></p></article>" + "<div>More to see</div>" * (i % 3))) for i in range(12)]
    rows += [(200 + i, "http://t.example/x", f"<main>Teaser {i}</main><div><p>{'The long story ' * i}{i}</p></div><p>Always</p>") for i in range(1, 9)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == naive(rows)
    assert got[201].startswith("Teaser 1 The long") and "Daily word" not in got[101]
