"""Main text of pages and tool-call linking."""

import random
import time
import json

from plyforge.llm import html, toolcalls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<nav class="x"><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies here</div>
<article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld&nbsp;word.<br>Next
line<p>{body}<div class="ad">buy now</div><aside>side</aside><form><input name=a>f</form>
<script>if (a < b) document.write("<p>no</p>")</script></article>
<section id="comments"><p>first!</p></section><footer>&copy; site</footer></body></html>"""


def test_blocks():
    found = [text for kind, text in html.blocks(PAGE.format(body="Body 1 &lt; 2")) if kind == html.ARTICLE]
    assert found == ["Title & more", "One bold word.", "Next line", "Body 1 < 2"]
    assert html.blocks("") == [] and html.blocks("<p") == [] and html.blocks("a <!-- b") == [(html.LOOSE, "a")]
    cut = html.blocks("<article><p>kept <a href='x")
    assert cut == [(html.ARTICLE, "kept")]


def test_main_text(spark):
    common = "This site is run by a club of friends of old books"
    loose = lambda own: f"<body><div>{common}</div><p>{own}</p><div>{common}</div></body>"
    rows = [
        (1, "http://a.org/1", PAGE.format(body="Body"), "x"),
        (2, "http://a.org/2", PAGE.format(body="Body"), "x"),
        (3, "http://b.org/1", loose("Only here and nowhere else"), "x"),
        (4, "http://b.org/2", loose("Another text of its own, again"), "x"),
        (5, "http://c.org/2", loose("One page"), "x"),
        (6, None, None, "x"),
        (7, "http://b.org/9", "", "x"),
        (None, "http://b.org/9", "<p>no id</p>", "x"),
        (3, "http://b.org/1", loose("Only here and nowhere else"), "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0), r["text"]) for r in html.main_text(pages).collect())
    whole = "Title & more One bold word. Next line Body"
    assert got == [
        (0, "no id"),
        (1, whole),
        (2, whole),
        (3, "Only here and nowhere else"),
        (3, "Only here and nowhere else"),
        (4, "Another text of its own, again"),
        (5, f"{common} One page {common}"),
        (6, ""),
        (7, ""),
    ]
    assert html.main_text(pages.where("false")).count() == 0


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, x int"
RESULTS = "conv_id long, turn long, call_id string, content string, x int"
FIELDS = "name string, field string, kind string, required boolean"


def test_link(spark):
    calls = [
        (1, 1, "a", "add", '{"b": 2, "a": 1.5}', [], 0),
        (1, 3, "b", "add", '{"a": 1}', ["a", "gone"], 0),
        (1, 3, "b", "add", '{"a": 9}', ["a"], 0),
        (1, 5, "c", "add", '{"a": 1, "b": 2, "c": 3}', None, 0),
        (1, 6, "d", "add", "not json", ["c"], 0),
        (1, 7, "e", "none", "{}", [], 0),
        (2, 1, "a", "add", '{"a": 1, "b": 2}', ["z"], 0),
        (2, 2, "z", "add", '{"a": 1, "b": 2}', [], 0),
        (2, 3, "p", "add", '{"a": 1, "b": 2}', ["q"], 0),
        (2, 4, "q", "add", '{"a": 1, "b": 2}', ["p"], 0),
        (3, 1, None, "add", None, None, 0),
        (None, None, "n", None, "", None, 0),
    ]
    results = [
        (1, 2, "a", "3.5", 0),
        (1, 9, "a", "late", 0),
        (1, 4, "b", None, 0),
        (2, 9, "lost", "x", 0),
        (None, 1, "a", "y", 0),
    ]
    fields = [("add", "a", "number", True), ("add", "b", "integer", True)]
    linked = toolcalls.link(
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(results, RESULTS),
        spark.createDataFrame(fields, FIELDS),
    ).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in linked if r["n_calls"]}
    status = lambda c, i: got[c, i]["status"]
    assert status(1, "a") == "linked" and got[1, "a"]["n_results"] == 2
    assert json.loads(got[1, "a"]["line"])["result"] == "3.5"
    assert got[1, "a"]["line"].startswith('{"arguments":{"a":1.5,"b":2},"id":"a","name":"add"')
    assert status(1, "b") == "invalid" and got[1, "b"]["n_calls"] == 2
    assert status(1, "c") == status(1, "d") == "invalid" and status(1, "e") == "unknown_tool"
    assert status(2, "a") == "unanswered" and status(3, None) == "no_id" == status(None, "n")
    level = lambda c, i: got[c, i]["level"]
    assert [level(1, i) for i in "abcde"] == [0] * 5
    assert level(2, "z") == 0 and level(2, "a") == 1 and level(2, "p") is None and level(2, "q") is None
    orphans = [r for r in linked if not r["n_calls"]]
    assert len(orphans) == 2 and all(r["status"] == "orphan" for r in orphans)


def test_link_of_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (CALLS, RESULTS, FIELDS)]
    assert toolcalls.link(*empty).count() == 0


def test_turns_become_calls(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (None, 5, "user", ""), (2, None, "assistant", "x")],
        "conv_id long, turn long, role string, text string",
    )
    rows = toolcalls.link(
        toolcalls.calls_of(turns), toolcalls.results_of(turns), toolcalls.turn_schemas(spark)
    ).collect()
    assert sorted(r["status"] for r in rows) == ["linked", "no_id", "orphan", "unanswered"]


def article_text(page):
    return " ".join(text for kind, text in html.blocks(page) if kind == html.ARTICLE)


def test_quotes_and_names_lose_no_text():
    page = "<article><p title=don't>one</p><p>it's two</p></article>"
    assert article_text(page) == "one it's two"
    assert article_text('<article><p class="share-price">own text</p></article>') == "own text"
    assert article_text('<article><p class="article-notice">a</p><div id=article-header>b</div></article>') == "a b"
    kinds = ["comments", "comment-list", "site-footer", "ad-banner", "cookie-notice", "Sidebar_left", "x comments"]
    assert all(article_text(f'<article>a<div class="{k}">b</div>c</article>') == "a c" for k in kinds)
    assert article_text('<article>a<div data-class="ad" class="lead">b</div></article>') == "a b"
    assert article_text("<article>a < b <i x='1>2' y=\"<p>\">c</i> d<!-- e > f --> g</article>") == "a < b c d g"
    assert article_text("<article>one<script>var t='</p>'; '<b'</script>two</article> <b") == "onetwo"
    assert article_text('<article><p title="open>one</p><p>two</p></article>') == "one two"


def test_long_odd_pages_take_one_pass():
    for page in ("<a " * 350_000, "<title " * 150_000, '<a ="' * 200_001 + ">", "<!--" * 250_000, "<" * 1_000_000,
                 "<div>" * 100_000 + "</span>" * 100_000, "<b><i>" * 80_000 + "</b></i>" * 80_000):
        started = time.perf_counter()
        html.blocks("<article>x</article>" + page)
        assert time.perf_counter() - started < 10


def plain_levels(calls):
    """Late dependencies on the worst path to each call, found call by call; None on and after a cycle."""
    turns, out = {i: turn for i, turn, _ in calls}, {}
    left = {i: [d for d in deps if d in turns] for i, _, deps in calls}
    while ready := [i for i, deps in left.items() if all(d in out for d in deps)]:
        for i in ready:
            own = [out[d] + (turns[d] is None or turns[i] is None or turns[d] >= turns[i]) for d in left.pop(i)]
            out[i] = max(own, default=0)
    return out | dict.fromkeys(left)


def test_all_calls_get_a_level(spark):
    draw, conversations = random.Random(6), {}
    for conv in range(8):
        ids = [f"{conv}-{i}" for i in range(30)]
        calls = []
        for i in range(30):
            near = [draw.choice(ids[max(0, i - 4) : i + (4 if conv > 1 else 0)] or ["gone"]) for _ in range(draw.randrange(3))]
            calls.append((ids[i], draw.choice([i, i, i, None]) if conv == 7 else i, near))
        conversations[conv] = calls
    conversations[8] = [(f"{i}", i, [f"{i + 1}"]) for i in range(60)]  # all late
    conversations[9] = [(f"{i}", i, [f"{(i + 1) % 7}"]) for i in range(7)] + [("x", 9, ["3", "y"]), ("y", 8, [])]
    rows = [(conv, *call) for conv, calls in conversations.items() for call in calls]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, depends_on array<string>")
    found = {(r["conv_id"], r["call_id"]): r["level"] for r in toolcalls.levels(df).collect()}
    expected = {(c, i): level for c, calls in conversations.items() for i, level in plain_levels(calls).items()}
    assert found == expected and found[8, "0"] == 59 and found[9, "x"] is None


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    steps, kept = [], toolcalls.checkpointed
    monkeypatch.setattr(toolcalls, "checkpointed", lambda df: steps.append(1) or kept(df))
    calls = [(1, f"{i}", i, [f"{i + 1}"]) for i in range(120)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, depends_on array<string>")
    found = {r["call_id"]: r["level"] for r in toolcalls.levels(df).collect()}
    assert found == {f"{i}": 119 - i for i in range(120)}
    assert len(steps) <= 50  # 120 rounds if each took off one call


def test_all_pages_and_all_text_take_part(spark):
    """Loose text beside an article is cut and kept as elsewhere, and article text counts as a repeat."""
    notice = "This site is run by a club of friends of old books"
    story = "Once there was a river that ran up the hill at night"
    page = lambda *parts: f"<body><nav>Home</nav>{''.join(parts)}</body>"
    rows = [
        (1, "http://a.org/1", page(f"<div>{notice}</div>", f"<article><p>{story}</p></article>", "<div>By A. Writer, a friend of birds</div>")),
        (2, "http://a.org/2", page(f"<div>{notice}</div>", "<article><p>Another story</p></article>")),
        (3, "http://a.org/3", page(f"<p>{story}</p>", "<p>All that we have read in this year</p>")),
        (4, "http://b.org/3", page(f"<p>{story}</p>", "<p>All that we have read in this year</p>")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(pages).collect()} == {
        1: f"{story} By A. Writer, a friend of birds",
        2: "Another story",
        3: "All that we have read in this year",
        4: f"{story} All that we have read in this year",
    }


def test_repeated_runs_equal_those_of_all_pairs_of_pages(spark):
    draw, tags = random.Random(3), ["div", "article", "nav", "p"]
    pages = []
    for i in range(24):
        parts = [(draw.choice(tags), " ".join(draw.choice("ab") for _ in range(draw.randrange(1, 9)))) for _ in range(4)]
        pages.append((i, f"http://{i % 3}.org/{i}", "".join(f"<{t}>{text}</{t}>" for t, text in parts)))
    expected, run = {}, html.RUN
    streams = {i: [(kind, w) for kind, text in html.blocks(page) for w in text.split()] for i, _, page in pages}
    for i, own in streams.items():
        covered = set()
        for at in range(len(own) - run + 1):
            prefix = [w for _, w in own[at : at + run]]
            for j, other in streams.items():
                if j % 3 == i % 3 and j != i and any([w for _, w in other[k : k + run]] == prefix for k in range(len(other) - run + 1)):
                    covered.update(range(at, at + run))
        expected[i] = " ".join(w for n, (kind, w) in enumerate(own) if kind == html.ARTICLE or kind == html.LOOSE and n not in covered)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == expected
