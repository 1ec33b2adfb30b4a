"""The site style tree: texts of pages, entropies against plain loops, deep and odd pages."""

import collections
import math
import random
import re

import pytest

from tidegraph.llm import sitestyle

rng = random.Random(8)
POOL = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(POOL) for _ in range(n))


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body>{body}</body></html>"


CASES = [
    ("", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp;&#233;<p>c <b>d</b>e", "a & b é\nc de"),
    (page("<nav><a>menu</a></nav><article><h1>Head</h1><p><b>one\n two<br><p>three</article><footer>f</footer>"), "Head\none two\nthree"),
    (page("<div class='ad'>buy</div><div id=main-content><p>x<aside>no</aside>y</div><div class='comments-list'><p>c</div>"), "x\ny"),
    (page("<article><p>a</p><form>f</form><section class='comments'>r</section><table><tr><td>1<td>2</table><ul><li>p<li>q</ul></article><p>outside"), "a\n1\n2\np\nq"),
    (page("<header>site</header><div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><p>t <span class=ad>buy</span>u"), "t u"),
    (page("<div class=site-header>s</div><article><div class='post-header'><h1>Head</h1></div><header><p>by me</p></header><p>a</p></article>"), "Head\nby me\na"),
    (page("<div class='post-header'><h1>Head</h1></div><div class=header>site</div><p>a"), "Head\na"),
    ("<p>unclosed <a href='x>y'>link</a> <!-- no --> end<script>z", "unclosed link end"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text(html, text):
    assert sitestyle.main_text(html) == text


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, node string")


def site(n, host="h.org"):
    return [(i, f"http://{host}/{i}", page(f"<div class=top>Welcome to our site</div><div class=body><p>{prose(30)}</p><p>{prose(30)}</p></div><div class=tail>All our pages</div>")) for i in range(n)]


def odd():
    rows = [(20, "http://alone.org/", page("<div class=top>Only</div><div class=body><p>here</p></div>")), (21, None, None), (None, "http://h.org/x", ""), (22, "http://[bad", "<p>t")]
    return rows + [(30 + i, f"http://same.org/{i}", page("<div>all alike</div>")) for i in range(12)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_unmarked_boilerplate_goes(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sitestyle, "BROADCAST_ROWS", 0)
    rows = site(14) + odd()
    got = {r.page_id: r for r in sitestyle.extract(frame(spark, rows + rows[:2])).collect()}
    for i, _, html in rows[:14]:
        assert got[i].text == "\n".join(re.findall(r"<p>([^<]*)</p>", html))
    assert (got[20].text, got[21].text, got[None].text, got[22].text, got[30].text) == ("Only\nhere", "", "", "t", "all alike")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert sitestyle.extract(frame(spark, rows)).count() == len(rows)
    assert sitestyle.extract(frame(spark, rows).where("false")).count() == 0


def test_boilerplate_within_the_main_element_goes(spark):
    box = "<div class=box><p>Get our letter every week</p></div>"
    rows = [(i, f"http://h.org/{i}", page(f"<main><article><div class=body><p>{prose(30)}</p></div>{box}</article></main>")) for i in range(14)]
    rows += [(30 + i, f"http://same.org/{i}", page("<article><p>all alike</p></article>")) for i in range(12)]
    got = {r.page_id: r.text for r in sitestyle.extract(frame(spark, rows)).collect()}
    for i, _, html in rows[:14]:
        assert got[i] == re.findall(r"<p>([^<]*)</p>", html)[0]
    assert all(got[30 + i] == "all alike" for i in range(12))


def test_copies_prove_nothing(spark):
    """Many copies of one page, and others that share its title."""
    same = page(f"<article><h1>Our title</h1><p>{prose(40)}</p></article>")
    rows = [(i, f"http://h.org/{i}", same) for i in range(60)] + [(100 + i, f"http://h.org/{100 + i}", page(f"<article><h1>{'Our title' if i < 2 else prose(4)}</h1><p>{prose(40)}</p></article>")) for i in range(6)]
    got = {r.page_id: r.text for r in sitestyle.extract(frame(spark, rows)).collect()}
    for i, _, html in rows:
        assert got[i] == "\n".join(re.findall(r"<(?:h1|p)>([^<]*)<", html.partition("<body>")[2]))


def plain_importance(pages):
    """For each host and path (as tags and classes): m and importance, all sums written out."""
    shown = collections.defaultdict(lambda: (collections.Counter(), collections.defaultdict(set), set()))
    for host, tree in {(h, t) for h, t in pages}:
        styles, texts = collections.defaultdict(list), collections.defaultdict(set)

        def walk(node, path):
            name, content = node
            here = (*path, name)
            steps = [c[0] for c in content if not isinstance(c, str)]
            styles[here].append(tuple(x for i, x in enumerate(steps) if not i or steps[i - 1] != x))
            for c in content:
                if isinstance(c, str):
                    for k in range(1, len(here) + 1):
                        texts[here[:k]].add(c)
                elif not c[0].startswith("nav"):
                    walk(c, here)
                else:
                    styles[(*here, c[0])].append(())

        walk(tree, ())
        for path, own in styles.items():
            counts, found, _ = shown[host, path]
            counts[tuple(sorted(set(own)))] += 1
            for t in texts[path]:
                found[t].add(tree)
    out = {}
    for key, (counts, found, _) in shown.items():
        m = sum(counts.values())
        if m > 1:
            presentation = -sum(k / m * math.log(k / m, m) for k in counts.values())
            entropies = [-sum(1 / len(x) * math.log(1 / len(x), m) for _ in x) for x in found.values()]
            content = 1 - (sum(entropies) / len(entropies) if entropies else 1)
            told = (1 - sitestyle.GAMMA ** len(counts)) * presentation + sitestyle.GAMMA ** len(counts) * content
        else:
            told = 1.0
        w = sitestyle.PRIOR / (sitestyle.PRIOR + m - 1)
        said = 1.0
        if key[1][-1].startswith("nav"):
            w, said = max(w, sitestyle.SAID), 0.0
        out[key] = (m, w * said + (1 - w) * told)
    return out


def written(node):
    name, content = node
    tag, _, cls = name.partition(".")
    inner = "".join(c if isinstance(c, str) else written(c) for c in content)
    return f"<{tag} class={cls}>{inner}</{tag}>" if cls else f"<{tag}>{inner}</{tag}>"


def test_importance_is_that_of_plain_loops(spark):
    draw = random.Random(4)
    names = ["div.a", "div.b", "section.c", "p", "nav.d"]

    def grown(depth):
        content = []
        for _ in range(draw.randint(1, 3)):
            name = draw.choice(names)
            if name.startswith(("p", "nav")) or not depth:
                content.append((name, (draw.choice(["x", "y", f"own {draw.random()}"]),)))
            else:
                content.append((name, grown(depth - 1)))
        return tuple(content)

    pages = [(draw.choice(["a.org", "b.org", "c.org"]), ("div.all", grown(2))) for _ in range(60)]
    pages += pages[:10]  # copies count once
    rows = [(i, f"http://{h}/{i}", written(t)) for i, (h, t) in enumerate(pages)]
    got = {r.node: (r.pages, r.importance) for r in sitestyle.importance(sitestyle.evidence(frame(spark, rows))).collect()}
    want = plain_importance(pages)

    def ident(host, path):
        node = None
        parent = sitestyle.Node("", "", None, "plain")
        for name in path:
            kind = "furniture" if name.startswith("nav") else "plain"
            node = parent = sitestyle.Node(name.partition(".")[0], name + "!" * (kind == "furniture"), parent, kind)
        return sitestyle._node_id(host, node.id)

    assert len(got) == len(want)
    for (host, path), (m, value) in want.items():
        assert got[ident(host, path)] == (m, pytest.approx(value, abs=1e-9))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>down here</p>" + "</div>" * 5000 + "<p>up</p>"
    wide = "".join(f"<p>{prose(3)} {i}</p>" for i in range(20000))
    rows = [(1, "http://h.org/1", deep), (2, "http://h.org/2", "<article>" + wide + "</article>"), (3, None, "<b>" * 5000 + "x")]
    rows += [(10 + i, f"http://d.org/{i}", "<div>" * 300 + f"{'text' * 10} {i}" + "</div>" * 300) for i in range(12)]
    got = {r.page_id: r.text for r in sitestyle.extract(frame(spark, rows)).collect()}
    assert got[1] == "down here\nup" and got[3] == "x" and got[2].count("\n") == 19999
    assert got[10] == "text" * 10 + " 0"
