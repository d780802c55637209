"""URL verdicts and main texts."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from grovemeter.llm import html_text, url_filter

URLS = [
    "https://a.example.org/en/2", "http://example.org/es/x?y", "https://www.EXAMPLE.org/en/17#top", "http://shop.com/fr/1", "http://shop.com/de/1",
    "http://shop.com/en/1", "http://org", "http://notorg/x", "ftp://x.net//es/", "no scheme", None, "", "http://", "x://a://b/c", "HTTPS://Bad.com?x=/de/",
]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest.split("?")[0].split("#")[0]


def plain_rule(host, path):
    fitting = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.name), default=None)


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.withColumns({name: F.lit(name) for name in ("host", "path", "pages", "id", "score", "trust", "shelf", "text")})


def links(*hosts):
    return "".join(f'<p><a class="x" href="http://{h}/p">x</a>' for h in hosts)


def test_rules_equal_the_plain_version(spark):
    rows = [(i, url, None) for i, url in enumerate(URLS)] + [(0, URLS[0], None)]
    found = url_filter.judge_urls(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "allow")
    assert url_filter.judge_urls(pages(spark, [])).count() == 0


def plain_scores(rows, damping=url_filter.DAMPING):
    """(trust, distrust) of every host, from linear equations."""
    read = []
    for _, url, html in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        to = {plain_parts("http:" + h if h.startswith("//") else h)[0] for h in re.findall(r"href=[\"']?([^\"'\s>]+)", html or "")}
        read.append((host, rule and rule.verdict, sorted(to - {host, ""})))
    read = [page for page in read if page[0]]
    hosts = sorted({h for host, _, to in read for h in (host, *to)})
    at = {h: i for i, h in enumerate(hosts)}
    count, good, bad = (np.zeros(len(hosts)) for _ in range(3))
    links, parts = np.zeros((len(hosts),) * 2), np.zeros((len(hosts),) * 2)
    for host, verdict, to in read:
        count[at[host]] += 1
        good[at[host]] += verdict == "allow"
        bad[at[host]] += verdict == "block"
        for target in to:
            links[at[host], at[target]] += 1
            parts[at[host], at[target]] += (verdict is None) / len(to)
    pages, out = np.maximum(count, 1), np.maximum(links.sum(axis=1, keepdims=True), 1)
    one = np.eye(len(hosts))
    trust = np.linalg.solve(one - damping * (links / out).T, good / pages)
    distrust = np.linalg.solve(one - damping * parts / pages[:, None], bad / pages)
    return {h: (trust[i], distrust[i]) for h, i in at.items()}


def test_scores_equal_the_fixed_point(spark):
    rows = [
        (1, "http://good.org/a", links("n1.net", "n2.net", "good.org")),
        (2, "http://n1.net/a", links("n3.net")),
        (3, "http://n3.net/a", links("n1.net", "spam.com")),
        (4, "http://spam.com/de/1", links("n4.net")),
        (5, "http://farm.net/1", links("spam.com", "spam.com")),
        (6, "http://farm.net/2", links("spam.com", "//n4.net".removeprefix("//"))),
        (7, "http://n4.net/1", "<a href='/own'>x</a><a href=//spam.com/x>y</a>"),
        (8, "http://spam.com/en/1", ""),
        (9, None, links("spam.com")),
    ]
    found = {r.page_id: r for r in url_filter.judge_urls(pages(spark, rows)).collect()}
    want = plain_scores(rows)
    for r in found.values():
        trust, distrust = want.get(r.host, (0, 0))
        assert abs(r.trust - trust) < 1e-4 and abs(r.distrust - distrust) < 1e-4
        if not r.rule:
            assert r.verdict == ("block" if distrust - trust > 0.5 else "allow")


def test_trust_that_links_bring_outweighs_distrust(spark):
    """Two hosts that link to the blocked one alike; a trusted host links to one of them, over a third."""
    rows = [(1, "http://spam.com/de/1", ""), (2, "http://good.org/1", links("between.net")), (3, "http://between.net/1", links("liked.net"))]
    rows += [(4, "http://liked.net/1", links("spam.com")), (5, "http://alone.net/1", links("spam.com"))]
    found = {r.host: r.verdict for r in url_filter.judge_urls(pages(spark, rows)).collect() if not r.rule}
    assert found == {"between.net": "allow", "liked.net": "allow", "alone.net": "block"}


ARTICLE = "<nav><ul><li><a href=/a>Home</a></ul></nav><div class='side-bar ad'>Buy</div><article><h1>Title &amp; more</h1><p>One\n two<b> bold</b><br>three<p>Next &eacute;&#233;</article><div id=comments><p>me too</div><footer>&copy; x</footer>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (ARTICLE, "Title & more\nOne two bold three\nNext éé"),
        ("<body><div>Plain text here</div><script>var a='<p>x</p>'</script><form>Name <input></form></body>", "Plain text here"),
        ("<main><p>Kept<aside>not</aside><p>Also kept &am", "Kept\nAlso kept &am"),
        ("", ""), ("<p", ""), ("no markup", "no markup"), ("<article>" * 3000 + "deep", "deep"),
        ("<article><p>a</p><div class=newsletter>sign up</div><p>b <span class='share'>share</span>c</p></article>", "a\nb\nc"),
        ("<ul><li>one<li>two</ul><style>x</style><!-- no -->", "one\ntwo"),
    ],
)
def test_main_text(html, text):
    assert html_text.choose([([z for z, _ in html_text.blocks_of(html)], [b for _, b in html_text.blocks_of(html)])]) == [text]


def plain_repeats(tokens, owners, long):
    covered = [False] * len(tokens)
    for i in range(len(tokens) - long + 1):
        if owners[i] != owners[i + long - 1]:
            continue
        gram = tokens[i : i + long]
        if any(tokens[j : j + long] == gram and owners[j] == owners[j + long - 1] != owners[i] for j in range(len(tokens) - long + 1)):
            covered[i : i + long] = [True] * long
    return covered


def test_repeated_tokens_equal_the_plain_version():
    rng = np.random.default_rng(4)
    for long in (3, 4, 8):
        tokens = rng.integers(0, 3, 160)
        owners = np.sort(rng.integers(0, 6, 160))
        got = html_text.repeated_tokens(tokens, owners, long)
        assert got.tolist() == plain_repeats(tokens.tolist(), owners.tolist(), long)


def test_unmarked_boilerplate_of_a_host_goes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHELF", 5)
    same = "Read all our other stories about gardens and garden tools every single week"
    rows = [(i, f"http://h.net/{i}", f"<div>{same}</div><div>Story number {i} is short</div><div>{same} again {i}</div>") for i in range(12)]
    rows += [(50, "http://lone.net/1", f"<div>{same}</div>"), (51, None, None), (52, "x", "<article>a &lt; b</article>"), (0, "http://h.net/0", rows[0][2])]
    found = html_text.extract_text(pages(spark, rows))
    texts = {r.page_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert texts[50].text == same and texts[51].text == "" and texts[52].text == "a < b" and texts[52].n_chars == 5
    assert all(same not in texts[i].text and (i == 0 or f"Story number {i}" in texts[i].text) for i in range(12))
    assert html_text.extract_text(pages(spark, [])).count() == 0


def test_articles_are_kept_however_often_they_repeat(spark):
    text = "An article that stands on two pages of the same host word for word"
    rows = [(i, f"http://h.net/{i}", f"<article><p>{text}</p></article>") for i in range(3)]
    assert {r.text for r in html_text.extract_text(pages(spark, rows)).collect()} == {text}


@pytest.mark.parametrize("shelf", [5, 200])
def test_a_repeat_on_two_pages_of_a_large_host_goes(spark, monkeypatch, shelf):
    monkeypatch.setattr(html_text, "SHELF", shelf)
    same = "Read all our other stories about gardens and garden tools every single week"
    copied = "This whole text stands word for word on two pages of the host"
    rows = [(i, f"http://h.net/{i}", f"<div>Story number {i} is short</div>") for i in range(60)]
    for i in range(0, 60, 2):
        rows[i] = (i, rows[i][1], rows[i][2] + f"<div>{same} {i // 4}</div>")
    rows += [(i, f"http://h.net/{i}", f"<nav>page {i}</nav><div>{copied}</div>") for i in (70, 71)]
    rows += [(80, "http://lone.net/1", f"<div>{same} 1</div>")]
    texts = {r.page_id: r.text for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert texts == {i: f"Story number {i} is short" for i in range(60)} | {70: copied, 71: copied, 80: f"{same} 1"}


def test_runs_over_buckets_equal_the_suffix_array(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(html_text, "BATCH_PAGES", 3)
    rows = []
    for i in range(40):
        blocks = [" ".join(f"w{n}" for n in rng.integers(0, 3, rng.integers(1, 30))) for _ in range(4)]
        rows.append((i, f"http://h{i % 2}.net/{i}", "".join(f"<{t}>{b}</{t}>" for t, b in zip(rng.choice(["div", "nav", "p"], 4), blocks))))
    texts = []
    for shelf in (200, 5):
        monkeypatch.setattr(html_text, "SHELF", shelf)
        texts.append({r.page_id: r.text for r in html_text.extract_text(pages(spark, rows)).collect()})
    assert texts[0] == texts[1] and len(set(texts[0].values())) > 5


def by(tables, column):
    whole = pa.concat_tables(tables)
    return {key: whole.filter(pc.equal(whole.column(column), key)) for key in set(whole.column(column).to_pylist())}


def in_rounds(pages, hosts, size, buckets):
    """The texts of pages in batches of ``size``, and how many runs the second round sends."""
    held = {"zones": pa.array([z for z, _ in pages], pa.list_(pa.int32())), "blocks": pa.array([b for _, b in pages], pa.list_(pa.string()))}
    rows = pa.table({"batch": [i // size for i in range(len(pages))], "host": hosts, "id": range(len(pages)), "url": hosts, **held})
    batches, rounds = [rows.slice(at, size) for at in range(0, len(pages), size)], html_text._Rounds(buckets)
    answers = [html_text._answer_marks(t) for t in by([rounds.marks(b) for b in batches], "bucket").values()]

    def back(n):
        return pa.concat_tables(answers).filter(pc.equal(pa.concat_tables(answers).column("batch"), n))

    sent = [rounds.runs(b, back(n)) for n, b in enumerate(batches)]
    answers += [html_text._answer_runs(t) for t in by(sent, "bucket").values()]
    texts = [text for n, b in enumerate(batches) for text in rounds.texts(b, back(n)).column("text").to_pylist()]
    return texts, sum(len(html_text.unpacked(cell)) for cell in pa.concat_tables(sent).column("sent").to_pylist())


def test_rounds_equal_whole_hosts_and_send_only_what_others_have(monkeypatch):
    rng = np.random.default_rng(7)
    pages = [
        (rng.choice([0, 1, 2], 4).tolist(), [" ".join(f"wörd{n}" for n in rng.integers(0, 4, rng.integers(1, 30))) for _ in range(4)])
        for _ in range(300)
    ]
    pages[7], pages[8], pages[9] = ([], []), ([2], ["only this stands here"]), pages[19]
    hosts = [f"h{i % 3}" for i in range(300)]
    want = [""] * 300
    for host in range(3):
        want[host::3] = html_text.choose(pages[host::3])
    assert in_rounds(pages, hosts, 7, 5)[0] == want and len(set(want)) > 250
    monkeypatch.setattr(html_text, "HASHED_BYTES", 50)
    assert in_rounds(pages, hosts, 300, 1)[0] == want

    shared = "Read all our other stories about gardens today"
    pages = [([0, 0], [" ".join(f"w{rng.integers(0, 10**9)}" for _ in range(200)), shared + (" too" if i < 2 else "")]) for i in range(40)]
    texts, sent = in_rounds(pages, ["h"] * 40, 4, 3)
    assert texts == [blocks[0] for _, blocks in pages]
    # of 200 runs a page only the common one goes on, at most with its neighbours of the same mark
    assert 0 < sent <= 40 * 5


def test_packed_numbers_come_back():
    numbers = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert html_text.unpacked(html_text.packed(numbers)).tolist() == numbers.tolist()
    assert html_text.unpacked(html_text.packed(numbers[:0])).tolist() == []
    cells = html_text.cells_of(numbers, 64, 7)
    assert [a for _, a, _ in cells] == [0, *[b for _, _, b in cells[:-1]]] and cells[-1][2] == len(numbers)


@pytest.mark.parametrize("shelf", [2, 200])
def test_repeats_decide_in_the_article_and_beside_it(spark, monkeypatch, shelf):
    monkeypatch.setattr(html_text, "SHELF", shelf)
    notice = "Please note that our garden shops are closed on all public holidays"
    rows, want = [], {}
    for i in range(6):
        story = " ".join(f"word{i}x{n}" for n in range(40))
        rows.append((i, f"http://h.net/{i}", f"<div>Headline {i}</div><article><p>{story}</p><p>{notice}</p></article><p>Second part {i}</p><div>{notice}</div>"))
        want[i] = f"Headline {i}\n{story}\nSecond part {i}"
    edited = want[0].split("\n")[1]
    rows.append((9, "http://h.net/9", f"<article><p>{edited}</p><p>And one new line</p></article>"))
    texts = {r.page_id: r.text for r in html_text.extract_text(pages(spark, rows)).collect()}
    # the story of page 0 is on page 9 too: both articles are copies and stay whole
    want[0] = f"Headline 0\n{edited}\n{notice}\nSecond part 0"
    assert texts == want | {9: f"{edited}\nAnd one new line"}


def test_verdicts_do_not_depend_on_the_number_of_pages(spark):
    """Farms outnumber the blocked page 100 to 1, share it, or reach it through a large host; good hosts stay."""
    rows = [(1, "http://spam.com/de/1", ""), (2, "http://good.org/1", links("liked.net"))]
    rows += [(0, f"http://farm{f}.net/{i}", links("spam.com")) for f in range(3) for i in range(100)]
    rows += [(0, f"http://far.net/{i}", links("farm0.net")) for i in range(40)]
    rows += [(0, f"http://once.net/{i}", links("spam.com") if i == 0 else "") for i in range(100)]
    rows += [(0, "http://single.net/1", links("spam.com")), (0, "http://liked.net/1", links("spam.com"))]
    rows += [(0, f"http://half.net/{i}", links("spam.com", "other.net")) for i in range(4)]
    found = {(r.host, r.verdict) for r in url_filter.judge_urls(pages(spark, rows)).collect() if not r.rule}
    blocked = {(h, "block") for h in ("farm0.net", "farm1.net", "farm2.net", "far.net", "single.net")}
    assert found == blocked | {(h, "allow") for h in ("once.net", "liked.net", "half.net")}


def test_random_graphs_equal_the_linear_equations(spark):
    rng = np.random.default_rng(3)
    names = ["a.org", "b.com", "c.net", "d.net", "e.net", "f.com"]
    rows = []
    for i in range(60):
        host = names[rng.integers(6)]
        path = ["/de/", "/fr/", "/x/"][rng.integers(3)]
        to = sorted({names[n] for n in rng.integers(0, 6, rng.integers(0, 4))})
        rows.append((i, f"http://{host}{path}{i}", links(*to)))
    want = plain_scores(rows)
    for r in url_filter.judge_urls(pages(spark, rows)).collect():
        trust, distrust = want[r.host]
        assert abs(r.trust - trust) < 1e-3 and abs(r.distrust - distrust) < 1e-3
        rule = plain_rule(r.host, r.path)
        assert r.verdict == (rule.verdict if rule else "block" if distrust - trust > 0.5 else "allow")


def test_damping_is_checked(spark):
    with pytest.raises(ValueError):
        url_filter.spread(None, None, 1.0)
