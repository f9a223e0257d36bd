"""Each operator against brute force, and on odd input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import same
from trailmark.llm import decontam, html, licenses, neardup, pieces, quality, queries, sharding, toxicity, urls, warc
from trailmark.llm.shared import written

SQL = queries.oracle_sql()
BLANK = " \t\n\r\x0b\x0c"


def words(text):
    """Between ASCII white space."""
    out = [""]
    for c in text or "":
        if c in BLANK:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    out = "".join(c if ord(c) > 127 or c.isdigit() or c.isalpha() else " " for c in lowered(text))
    return [w for w in out.split(" ") if w]


def documents(spark, rows):
    """Rows (doc_id, text) with columns that clash with what operators make."""
    full = [(i, t, "en", "s", len(t or ""), 1, "x", 5, True) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, record string, shard int, kept boolean")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ähre", "ähre", "😀", "İx"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    near = base.split()
    near[50] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, base.upper()), (9, " ".join(near)), (9, " ".join(near))]
    rows += [(10, text(30_000)), (None, text(60)), (None, text(60)), (11, "a b c " * 200), (12, "# * $ % & | < >\n" * 40), (13, "line one\n\nline one\nline two\r\nline one"), (14, "  x y"), (15, base + " under the MIT License. " + base)]
    rows += [(20 + i, text(rng.randint(40, 90))) for i in range(40)]
    return documents(spark, rows).cache()


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    same(queries.queries()[name](spark, small), SQL[name], small)


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names


# -- quality rules


def ledger_by_hand(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), inside


def test_quality_ledger(spark, odd):
    rows = quality.ledger(odd).select("record.doc_id", "record.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits").collect()
    assert len(rows) == odd.count()
    for r in rows:
        n, chars, symbols, dup, inside = ledger_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        assert r.n_repeat_words == len(inside)
        assert bool(r.fail_bits & quality.BITS["too_short"]) == (n < 50)
    assert quality.ledger(empty(odd)).count() == 0
    kept = quality.accepted(odd)
    assert kept.columns == odd.columns and {6, 7} <= {r.doc_id for r in kept.collect()} and 11 not in {r.doc_id for r in kept.collect()}


def test_repeated_windows_are_compared_by_their_words(spark, odd, monkeypatch):
    """Hashes of three bits, so that unlike windows have equal ones in every text."""
    monkeypatch.setattr(quality, "HASHED", 7 << 60)
    rows = quality.ledger(odd.where("doc_id is null or doc_id <> 10")).select("record.text", "n_repeat_words").collect()
    assert rows and all(r.n_repeat_words == len(ledger_by_hand(r.text)[4]) for r in rows)


def test_quality_ablation(spark, odd):
    rows = written(quality.ledger(odd).select("fail_bits"), "ledger")
    bits = [r.fail_bits & quality.mask_of("strict") for r in rows.collect()]
    for r in quality.ablation(rows, "strict").collect():
        assert r.n_failed == sum(bool(b & r.bit) for b in bits) and r.n_only == sum(b == r.bit for b in bits)


# -- sharding


def test_shards_are_a_shuffle(spark, odd):
    for bucket in (16 << 20, 2000):
        rows = sharding.write_shards(odd, n_shards=8, bucket_bytes=bucket).select("record.*", F.col("shard").alias("s"), "slot")
        got = rows.collect()
        assert len(got) == odd.count()
        by = {}
        for r in got:
            by.setdefault(r.s, []).append(r.slot)
        sizes = [len(by.get(i, [])) for i in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    again = sharding.shuffled(odd.where("doc_id is not null"), seed=1).select("record.doc_id", "shard", "slot")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, again.collect()))
    other = sharding.shuffled(odd.where("doc_id is not null"), seed=2).select("record.doc_id", "shard", "slot")
    assert sorted(map(tuple, again.collect())) != sorted(map(tuple, other.collect()))
    assert sharding.shuffled(empty(odd)).count() == 0
    few = sharding.shuffled(odd.where("doc_id in (1, 2, 3)"), n_shards=8).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)


def test_shards_follow_from_rows_and_seed_alone(spark, odd, monkeypatch):
    """Whatever the partitions and the plan; a hot row scatters like any other."""
    hot = spark.range(9000).select(F.lit(77).cast("long").alias("doc_id"), F.lit("hot").alias("text"))
    docs = odd.select("doc_id", "text").unionByName(hot)
    n, got = docs.count(), []
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k) for k in keys]
    try:
        for values, parts, few in ((("true", "4", "10MB"), None, 1 << 20), (("false", "8", "-1"), 3, 1 << 20), (("true", "200", "-1"), 7, 1)):
            for k, v in zip(keys, values, strict=True):
                spark.conf.set(k, v)
            monkeypatch.setattr(sharding, "FEW", few)
            rows = sharding.shuffled(docs.repartition(parts) if parts else docs, bucket_bytes=20_000)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(bucket" not in plan and plan.count("Exchange shufflepartitionid") <= 2  # the records move once
            got.append(sorted((r.shard, r.slot, str(r.record.doc_id), r.record.text or "") for r in rows.collect()))
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert len(got[0]) == n and got[0] == got[1] == got[2]
    each = [sum(x[0] == i and x[2] == "77" for x in got[0]) for i in range(8)]
    assert min(each) > 1000


def test_shard_query(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op2_sharding(spark, small).collect()
    assert len(rows) == len(docs) and len({r.doc_id for r in rows}) == len(docs)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())


# -- html


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad-banner">Buy this now, it is cheap and good.</div><div id="cookie-notice">We use cookies on this site, please agree.</div>
<article><h1>A &lt;title&gt;</h1><p>First&nbsp;&nbsp;part <b>with <i>mark</i></b>up.<br>Second line.<p>Short.<ul><li>one<li>two</ul><form>Name <input><button>Send</button></form><aside>See also this</aside><div class="comments"><p>I like it, said a reader at length, and so on and on.</p></div><p>Last &#233;.</p></article>
<div class="sidebar"><p>A sidebar with a long text that reads like an article, with commas, and stops.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE).split("\n") == ["A <title>", "First part with markup. Second line.", "Short.", "one", "two", "Last é."]
    assert [html.main_text(x) for x in (None, "", "   ", "<nav>a</nav>", "<p")] == [""] * 5
    plain = "<body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>This is a long paragraph, which has enough words to be the text of a page.</p><p>So it is.</p><p>And another long paragraph follows here, with commas, and with an end.</p></div></body>"
    assert "So it is." in html.main_text(plain) and "About" not in html.main_text(plain)
    assert html.main_text("<article><p>" + "x " * 200_000 + "</p></article>") == ("x " * 200_000).strip()
    assert html.main_text("<article>" + "<div>" * 3000 + "deep." + "</div>" * 3000 + "</article>") == "deep."


def test_html_class_words_are_finite_costs():
    body = "<p>A first sentence of the story, as long as others are.</p><p>A second one that follows it.</p>"
    text = "A first sentence of the story, as long as others are.\nA second one that follows it."
    for around in ("layout has-sidebar", "page sidebar", "share", "header search"):
        assert html.main_text(f'<div class="{around}"><article>{body}</article></div>') == text
        assert html.main_text(f'<div class="{around}"><main>{body}</main></div>') == text
    assert html.main_text(f'<article><header class="entry-header"><h1>Title</h1></header>{body}</article>') == "Title\n" + text
    assert html.main_text(f'<body><div class="page sidebar">{body}</div><div class="ad">Buy.</div></body>') == text
    assert html.main_text(f'<div class="content sidebar">{body}</div>') == text
    assert html.main_text(f'<form id="aspnetForm"><main>{body}</main></form>') == text
    essay = "Many words of a reader on the story. " * 40
    assert essay.strip() in html.main_text(f'<article>{body}<div class="comments"><p>{essay}</p></div></article>')
    # what is beside the text is still left out
    for beside in ("sidebar", "ad", "share", "comments", "related"):
        assert html.main_text(f'<article>{body}</article><div class="{beside}"><p>A short text beside it.</p></div>') == text
        assert html.main_text(f'<article>{body}<div class="{beside}"><p>A short text in it.</p></div></article>') == text
    for beside in ("<nav>", "<aside>", "<div hidden>", '<div id="comments">'):
        assert html.main_text(f"<article>{body}</article>{beside}<article><p>A short text.</p></article>") == text


def test_html_self_closed_and_formulas():
    assert html.main_text('<article><p>Before <svg class="i"/>the icon.</p><p>After <math/>it all.</p><svg><title>no</title></svg></article>') == "Before the icon.\nAfter it all."
    assert html.main_text("<article><p>Let <math><mi>x</mi><mo>&lt;</mo><mspace/><mn>1</mn></math> hold.</p><xmp><b>&amp;</b> as is</xmp><p>End.</p></article>") == "Let x<1 hold.\n<b>&amp;</b> as is\nEnd."


def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(1, 8)
        unary = [(rng.random() * 3, 0.0) if rng.random() < 0.5 else (0.0, rng.random() * 3) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda on: sum(u[0] if i in on else u[1] for i, u in enumerate(unary)) + sum(w for a, b, w in edges if (a in on) != (b in on))  # noqa: E731, B023
        best = min(cost({i for i in range(n) if m >> i & 1}) for m in range(1 << n))
        assert cost(html.content_side(unary, edges)) == pytest.approx(best)


def test_html_articles_in_ordinary_layouts():
    said = [f"This is paragraph {i} of the page, which goes on for more than a line and says something." for i in range(3)]
    inner = "".join(f"<p>{p}</p>" for p in said)
    for layout in ('<div class="content-with-sidebar">', '<div class="post with-sidebar">', '<div class="page header-small">', '<div class="share-price-story">', '<article><div class="post text tags">'):
        assert html.main_text(f"<body>{layout}{inner}") == "\n".join(said), layout


def test_html_labels_are_the_cheapest_of_all():
    """Small random pages: the text is that of the cheapest of all labellings, and of equal ones of the fewest blocks."""
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "section", "article", "aside", "p", "ul", 'div class="sidebar"', 'div class="comments"', 'div class="post"'])
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["words " * rng.randint(1, 30), f"<a href=x>{'link ' * rng.randint(1, 4)}</a>", "A sentence. "]) for _ in range(rng.randint(1, 3)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    n_cut = 0
    for _ in range(150):
        page = tree(3)
        found, unary, edges = html.graph(page)
        if not 1 < len(found) <= 11:
            continue
        best = []
        for bits in range(1 << len(found)):
            cost = sum(u[0] if bits >> i & 1 else u[1] for i, u in enumerate(unary)) + sum(w for a, b, w in edges if (bits >> a ^ bits >> b) & 1)
            best.append((round(cost, 6), bits.bit_count(), bits))
        least = min(best)
        assert html.main_text(page) == "\n".join(b.text for i, b in enumerate(found) if least[2] >> i & 1)
        n_cut += least[2] != sum(1 << i for i, u in enumerate(unary) if u[0] < u[1])  # the edges decide something
    assert n_cut > 3


def test_html_long_and_deep_pages_take_linear_time():
    import time

    pages = [
        "".join(f"<div class=sidebar><p>Side text {i} here</p></div><article><p>Article text number {i}, which goes on for a while.</p></article>" for i in range(10_000)),
        "".join(f"<div><p>Text {i}.</p>" for i in range(20_000)),
        "".join("<p>" + "word " * (7 + i % 4) + "<p><a href=x>w w</a> ab cde" for i in range(10_000)),
        "<div>" * 20_000 + "</section>" * 20_000 + "A sentence that is long enough to be the page's own text, and so is kept.",
    ]
    for page in pages:
        began = time.process_time()
        text = html.main_text(page)
        assert text.count("\n") < 20_000
        assert time.process_time() - began < 2


def test_html_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = queries.op3_html_extraction(spark, small).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 and "<" not in r.text[:1] for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 3)], "page_id bigint, url string, html string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extracted(odd).collect()] == [(None, "", 0), (1, "", 0), (1, "", 0)]
    assert html.extracted(empty(odd)).count() == 0


# -- archives


def archive_by_hand(rows):
    first = {}
    for i, h in rows:
        data = (h or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, h in rows:
        data = (h or "").encode()
        again = i is not None and data in first and i > first[data]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def test_archives_come_back(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 200
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long), (6, long), (7, fake * 3 + "x"), (8, fake), (9, "WARC/1.1\r\n"), (10, "a\r\n\r\nb" + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + "z" * 300), (11, long), (None, long), (12, "y" * 300_000), (13, fake * 3 + "x"), (14, "\r\n\r\n"), (3, "short")]
    df = spark.createDataFrame([(i, f"http://h/{i}\n", h, "extra") for i, h in rows], "page_id bigint, url string, html string, payload_digest string")
    for n in (1, 5):
        got = warc.read_archive(spark, warc.write_archive(df.repartition(n))).collect()
        assert all(r.sound for r in got)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == archive_by_hand(rows)


def test_archives_over_many_blocks(spark):
    fake = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000))) + (fake * rng.randint(0, 3)) + "end") for i in range(400)]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id bigint, url string, html string").coalesce(1)
    path = warc.write_archive(df)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_archive(spark, path).collect()
        assert warc.candidates(spark, path).select("block").distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == archive_by_hand(rows)


def test_archives_survive_other_splits(spark):
    """Splits change between the scan that finds the records and the one that fetches their texts."""
    fake = "WARC/1.1\r\nContent-Length: {n}\r\n\r\n{t}\r\n\r\n"
    rng = random.Random(2)
    whole = lambda t: fake.format(n=len(t), t=t)
    rows = [(i, "".join(whole("x" * rng.randint(0, 400)) for _ in range(4)) + f"tail {i}") for i in range(400)]
    path = warc.write_archive(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id bigint, url string, html string").coalesce(2))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for first, then in (("15000", "40000"), (before, "7000"), ("7000", before)):
            spark.conf.set(key, first)
            records = warc.read_archive(spark, path)
            spark.conf.set(key, then)
            got = records.collect()
            assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == archive_by_hand(rows)
            assert all(r.sound for r in got)
    finally:
        spark.conf.set(key, before)


def test_archive_query(spark, small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_warc(spark, small).collect()), key=str) == archive_by_hand(pages)
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(none)).count() == 0


# -- near duplicates


def sets_by_hand(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups_by_hand(rows, k, percent):
    sets = [sets_by_hand(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0] is not None and sets[i] and sets[j]:
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = neardup.groups(odd, k=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == groups_by_hand(rows, 4, 80)
    assert neardup.groups(empty(odd)).count() == 0
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 6, None} and 7 not in {r.doc_id for r in kept.collect()}


def test_one_row_of_each_group_is_kept(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    near = text("a") + " more"
    rows = [(5, text("a")), (5, text("a")), (7, near), (None, text("a")), (None, near), (None, text("a"))]
    rows += [(None, text("b")), (None, text("b")), (None, text("b") + " x"), (8, text("c")), (8, text("d")), (8, text("d")), (9, ""), (9, ""), (10, ""), (None, text("e"))]
    df = documents(spark, rows)
    got = [(r.doc_id, (r.text or "")[:1]) for r in neardup.deduplicated(df).collect()]
    assert sorted(got, key=str) == sorted([(5, "a"), (None, "b"), (8, next(t for i, t in got if i == 8)), (9, ""), (10, ""), (None, "e")], key=str)
    alone = neardup.deduplicated(df.where("doc_id is null"))
    assert alone.columns == df.columns and sorted(r.text[:1] for r in alone.collect()) == ["a", "b", "e"]


def test_chains_and_hubs_lose_no_link(spark):
    """Groups in which neighbours are linked and the ends are not, and members on both sides of a pivot."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        text = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(160)]
        for i in range(12):
            rows.append((1000 * g + rng.randint(0, 999), " ".join(text)))
            for _ in range(rng.choice((1, 2, 3, 4))):
                text[rng.randrange(len(text))] = f"n{rng.randint(0, 10**6)}"
    rows = list({i: t for i, t in rows}.items())
    rng.shuffle(rows)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == groups_by_hand(rows, 4, 80)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for share in (0.2, 0.5, 0.8):
            both = rng.integers(0, 2**63, 400).astype(np.uint64)
            n = int(400 * share)
            a, b = np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2).astype(np.uint64)]), np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2).astype(np.uint64)])
            same = [(neardup.sketch(neardup.mixed(a + np.uint64(s))) == neardup.sketch(neardup.mixed(b + np.uint64(s)))).mean() for s in range(20)]
            assert abs(np.mean(same) - n / (400 - n + n)) < 0.06
        assert (neardup.sketch(np.array([7], np.uint64)) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # one item fills all bins


def test_components_of_a_path(spark):
    n = 70
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501)], "a bigint, b bigint")
    assert {(r.node, r.label) for r in neardup.components(links).collect()} == {(i, 0) for i in range(n)} | {(500, 500), (501, 500)}


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    vocabulary = [f"term{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 8 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", f"snarg{rng.randint(0, 9)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(None, None), (1000, ""), (1001, "x " * 100_000)], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    scorer = toxicity.trained(docs, marks)
    got = {r.doc_id: r for r in toxicity.scored(docs, scorer).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if i is not None and r.held_out and i < 600} == set(held)
    assert sum(got[i].predicted == (i % 8 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[1000].predicted and not got[None].held_out
    # labels of held-out rows change nothing
    turned = marks.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.trained(docs, turned)).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items())
    kept = toxicity.harmless(docs.withColumn("score", F.lit("x")), scorer)
    assert kept.columns == ["doc_id", "text", "score"]


def test_toxicity_inputs_by_hand(spark):
    """Votes, inputs and score of whole texts, counted word by word."""
    voters = toxicity.Voters([b"vile", b"grim*", b"nasty"])
    weights = np.linspace(-1, 1, 8 + toxicity.DEALT + 1)
    scorer = toxicity.Scorer(voters, weights)
    rng = random.Random(4)
    vocabulary = ["vile", "grimly", "grimmest", "grim", "Nasty!", "IDIOT", "good", "day", "!", "Ähre", "SHOUT", "x"]
    texts = [None, "", "!!!"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 600))) for _ in range(60)]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(toxicity.score_of(scorer, spark)(F.col("t")).alias("s")).collect()]
    for text, score in zip(texts, got, strict=True):
        w = alnum(text)
        n = max(1, len(w))
        term = lambda x: next((i for i, t in enumerate(voters.all) if (x == t.decode() if not t.endswith(b"*") else len(x) > len(t) - 1 and x.startswith(t[:-1].decode()))), -1)
        hits = [t for t in map(term, w) if t >= 0]
        each = [sum(voters.voter[t] == v for t in hits) for v in range(toxicity.DEALT + 1)]
        bangs, upper = (text or "").count("!") / n, sum(map(str.isupper, text or "")) / max(1, len(text or ""))
        votes = [toxicity.TOXIC if e else toxicity.ABSTAIN for e in each]
        votes += [toxicity.TOXIC if len(hits) >= 2 and len(hits) / n >= 1 / 200 else toxicity.CLEAN if not hits else toxicity.ABSTAIN]
        votes += [toxicity.TOXIC if len(set(hits)) >= 2 else toxicity.CLEAN if not hits else toxicity.ABSTAIN]
        votes += [toxicity.CLEAN if bangs < 0.05 else toxicity.ABSTAIN, toxicity.CLEAN if upper < 0.2 else toxicity.ABSTAIN]
        inputs = [1, np.log1p(len(hits)), min(1, len(hits)), np.log1p(100 * len(hits) / n), np.log1p(len(set(hits))), bangs, upper, np.log(n) / 10, *np.log1p(each)]
        seen = voters.look(text)
        assert seen[0].tolist() == votes
        assert seen[1] == pytest.approx(inputs)
        assert score == pytest.approx(1 / (1 + np.exp(-np.dot(inputs, weights))))


def test_label_model_counts_repeated_voters_once():
    """Two classes, independent voters: the posterior is Bayes'; voters that repeat one change nothing."""
    share = {0: (0.9, 0.2), 1: (0.8, 0.1), 2: (0.7, 0.3)}  # P(toxic vote | toxic), P(toxic vote | clean)
    for copies in ((), (3, 4, 5, 6)):
        counts, truth = {}, {}
        for bits in range(8):
            p = {y: np.prod([share[j][1 - y] if bits >> j & 1 else 1 - share[j][1 - y] for j in range(3)]) for y in (0, 1)}
            votes = [toxicity.TOXIC if bits >> j & 1 else toxicity.CLEAN for j in range(3)]
            votes += [votes[0] if j in copies else toxicity.ABSTAIN for j in range(3, toxicity.N_VOTERS)]
            code = toxicity._code(np.array(votes))
            counts[code, 1], counts[code, 0] = round(2e5 * p[1]), round(8e5 * p[0])
            counts[code, -1] = counts[code, 0] + counts[code, 1]
            truth[code] = 0.2 * p[1] / (0.2 * p[1] + 0.8 * p[0])
        got = toxicity.label_model(counts)
        assert all(abs(got[c] - truth[c]) < 0.02 for c in truth)


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "a fine day")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.trained(docs, none)).collect()}
    assert len(rows) == 2
    assert toxicity.scored(empty(docs), toxicity.trained(empty(docs), none)).count() == 0


def test_shouting_is_measured_on_the_whole_text():
    rng = random.Random(12)
    for _ in range(50):
        text = "".join(rng.choice("aB cÄß😀İ!") for _ in range(rng.randint(1, 3000)))
        assert toxicity.shouted(text) == sum(map(str.isupper, text)) / len(text)
    assert toxicity.shouted("") == 0
    voters = toxicity.Voters([])
    short, long, hidden = "HEY" * 20, "HEY" * 333, "aB" * 2000
    assert [voters.look(t)[1][6] for t in (short, long, hidden)] == [1, 1, 0.5]
    assert [voters.look(t)[0][-1] for t in (short, long, hidden)] == [toxicity.ABSTAIN] * 3 and voters.look("hey" * 20)[0][-1] == toxicity.CLEAN


# -- licences


def phrases_by_hand(text):
    w, found = alnum(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        found += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), found


def test_licence_phrases(spark, odd):
    rng = random.Random(4)
    tokens = "under the mit license apache version 2 cc by nc 0 x Ünder".split()
    rows = [(i, " ".join(rng.choice(tokens) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, "UNDER the MIT-License,under the mit license"), (901, "cc by nc by nc cc by nc"), (902, "the MIT license")]
    df = documents(spark, rows).unionAll(odd)
    texts = sorted(df.select("doc_id", "text").collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    got = sorted(licenses.scanned(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    assert len(got) >= 300
    for r in got:
        n, found = phrases_by_hand(r.text)
        if r.doc_id is None or [t.doc_id for t in texts].count(r.doc_id) > 1:
            continue
        starts = [i for _, i in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scanned(empty(odd)).count() == 0


def test_matching_statistics_are_longest():
    auto = licenses.Automaton((("a", "x y z x y w"), ("b", "y z y")), (("p", "z x"),))
    texts = [t.split() for _, t in (("a", "x y z x y w"), ("b", "y z y"), ("p", "z x"))]
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
    rng = random.Random(6)
    for _ in range(200):
        w = [rng.choice("xyzw") for _ in range(12)]
        got = [n for _, n in auto.statistics([auto.ids[x.encode()] for x in w])]
        want = [max(k for k in range(i + 2) if tuple(w[i + 1 - k : i + 1]) in inside) for i in range(12)]
        assert got == want


def test_licence_spans():
    auto = licenses.Automaton()
    text = "foo bar " + licenses.TEMPLATES[1][1].replace("charge to any", "charge, hm, to any") + " baz"
    _, _, spans = auto.scan(text)
    assert [(auto.labels[t], a) for t, a, _, _ in spans] == [("mit", 2)]
    assert auto.scan("redistribution and use in source") [2] == []


def best_cover(w, template):
    """Words of a template that the best chain of its runs covers, from the definition."""

    def longest(end):
        return max(k for k in range(end + 1) if any(template[a : a + k] == w[end - k : end] for a in range(len(template) - k + 1)))

    runs = [(end, k) for end in range(1, len(w) + 1) if (k := longest(end)) >= licenses.LEAST_RUN and (end == len(w) or longest(end + 1) <= k)]
    most = {}
    for end, k in runs:
        for e in [a + k for a in range(len(template) - k + 1) if template[a : a + k] == w[end - k : end]]:
            more = [c + min(k, e - e2, end - end2) for (end2, e2), c in most.items() if e > e2 and end > end2 and end - k - end2 <= licenses.GAP]
            most[end, e] = max([k, *more, most.get((end, e), 0)])
    return max(most.values(), default=0)


def test_licence_spans_by_brute_force():
    """All templates of one label, so that none is left out for another's sake; some begin or hold others."""
    texts = ["x y z", "x y z w v u", "y z w x y z", "p q r s t p q r", "q r s u v w x", "w v u x y z w v u"]
    auto = licenses.Automaton([("a", t) for t in texts], ())
    rng, n_found = random.Random(9), 0
    for _ in range(400):
        w = []
        while len(w) < 25:
            t = rng.choice(texts).split()
            a = rng.randrange(len(t) - 2)
            w += t[a : rng.randint(a + 3, len(t))] + ["foo"] * rng.choice((0, 0, 1, 9))
        spans = auto.scan(" ".join(w))[2]
        for i, t in enumerate(texts):
            want = best_cover(w, t.split())
            own = [s for s in spans if s[0] == i]
            assert round(max((s[3] for s in own), default=0) * len(t.split())) == (want if want >= licenses.COVER * len(t.split()) else 0)
            assert all(a[2] <= b[1] for a, b in zip(own, own[1:], strict=False))
            n_found += len(own)
    assert n_found > 300
    auto = licenses.Automaton((("p", "x y z"), ("q", "x y z w v u")), ())
    assert auto.scan("x y z w")[2] == [(0, 0, 3, 1.0)]


def test_licence_likely_and_complete_notices():
    """A notice that another label's nearly holds is not that label's; a whole licence is found with its notice."""
    auto = licenses.Automaton()
    named = lambda text: {auto.labels[s[0]] for s in auto.scan(text)[2]}
    assert named("This work is licensed under the GNU General Public License, version 3") == {"gpl-3"}
    assert named("This work is licensed under a Creative Commons Attribution 4.0 International License.") == {"cc-by"}
    for label, text in licenses.TEMPLATES[-3:]:
        spans = auto.scan(f"Copyright (c) 2020 A. Body. {text.capitalize()}.")[2]
        assert {auto.labels[s[0]] for s in spans} == {label} and max(s[2] - s[1] for s in spans) == len(text.split())


def test_licence_notices_behind_their_own_words():
    auto = licenses.Automaton()
    for i, (label, notice) in enumerate(licenses.TEMPLATES):
        w = notice.split()
        for a in range(0, len(w) - 2, 1 + len(w) // 40):
            for gap in (0, 1, licenses.GAP):
                head = [*w[a : a + 3], *["foo"] * gap]
                spans = [s for s in auto.scan(" ".join([*head, *w, "bar"]))[2] if s[0] == i]
                assert [s[3] for s in spans] == [1.0] and spans[0][2] == len(head) + len(w), (label, a, gap)
    for title, i in (("GNU General Public License", 4), ("Creative Commons Attribution", 14)):
        assert (i, len(title.split()), len(title.split()) + len(licenses.TEMPLATES[i][1].split()), 1.0) in auto.scan(f"{title}\n{licenses.TEMPLATES[i][1]}.")[2]
    twice = licenses.TEMPLATES[4][1] + ". " + licenses.TEMPLATES[4][1]
    assert [s[1:] for s in auto.scan(twice)[2] if s[0] == 4] == [(0, 12, 1.0), (12, 24, 1.0)]


# -- urls


def test_url_rules(spark):
    rows = [("http://a.COM/x", "a.com", "/x", "com/", "allow"), ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow")]
    rows += [("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"), ("http://x.net/fr", "x.net", "/fr", None, None), ("http://a.com", "a.com", "", None, None), ("http://acom/x", "acom", "/x", None, None)]
    rows += [("nothing", "", "", None, None), (None, "", "", None, None), ("ftp://h.org?x=/p", "h.org", "", None, None), ("http://h.org#a/b", "h.org", "", None, None), ("://q.com/", "q.com", "/", "com/", "allow"), ("http://sub.example.com/de/", "sub.example.com", "/de/", "com/", "allow")]
    df = spark.createDataFrame([(i, r[0], "host") for i, r in enumerate(rows)] + [(7, "nothing", "h")], "page_id bigint, url string, host string")
    got = urls.judged(df).select("record.page_id", "record.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = next(x for x in rows if x[0] == r.url)
        assert (r.host, r.path, r.rule) == want[1:4] and (want[4] is None or r.verdict == want[4]) and r.verdict in ("allow", "block")
    assert urls.judged(empty(df)).count() == 0


def test_url_models(spark):
    """Scores of all grams against a direct computation."""
    rows = [("good.org/abc", "allow", 3), ("good.org/abd", "allow", 1), ("bad.org/xyz", "block", 2), ("other.org/abz", None, 1), ("", None, 1)]
    got = {r.g: r.score for r in urls.gram_scores(spark.createDataFrame(rows, "said string, verdict string, n bigint"), 2).collect()}

    from math import log

    counts = {v: Counter() for v in ("allow", "block")}
    every = set()
    for said, verdict, n in rows:
        s = urls.START * 2 + said + urls.STOP
        grams = [s[i : i + 3] for i in range(len(s) - 2)]
        every |= set(grams)
        for g in grams if verdict else ():
            counts[verdict][g] += n

    def p(c, head, last):
        low = p(c, head[1:], last) if head else urls.FLOOR
        follow = Counter()
        for g, n in c.items():
            if g[2 - len(head) : 2] == head:
                follow[g[2]] += n
        seen = sum(follow.values()) + len(follow)
        return (follow[last] + len(follow) * low) / seen if seen else low

    assert set(got) == every
    for g in every:
        assert abs(got[g] - 1e6 * (log(p(counts["allow"], g[:2], g[2])) - log(p(counts["block"], g[:2], g[2])))) <= 1
    page = spark.createDataFrame([(i, f"http://h.com/good{i}") for i in range(20)] + [(100 + i, f"http://h.net/es/bad{i}") for i in range(20)] + [(200, "http://h.org/good7"), (201, "http://h.org/es/bad7")], "page_id bigint, url string")
    said = {r.page_id: r.verdict for r in urls.judged(page).select("record.page_id", "verdict").collect()}
    assert said[200] == "allow" and said[201] == "block"


def test_url_models_see_whole_urls(spark):
    rows = [(i, f"http://h.com/p?good={i}#fine") for i in range(20)] + [(100 + i, f"https://h.net/es/p?bad={i}#vile") for i in range(20)]
    rows += [(200, "http://h.org/p?good=7#fine"), (201, "http://h.org/p?bad=7#vile"), (202, "//h/p?good=7#fine"), (203, "//h/p?bad=7#vile"), (204, "http://h.org/p?good=7#fine"), (205, None), (206, "")]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).select("record.page_id", "rule", "score", "verdict").collect()}
    assert len(got) == len(rows)
    assert [got[i].verdict for i in (200, 201, 202, 203)] == ["allow", "block", "allow", "block"]
    assert got[200].score > got[201].score and got[202].score > got[203].score
    assert got[200].score == got[204].score and got[205].score == got[206].score and got[200].rule is None


# -- decontamination


def hits_by_hand(rows, items, size):
    out = []
    for i, text in rows:
        w, hit, found = alnum(text), set(), set()
        for item, t in items:
            v = alnum(t)
            for s in range(max(1, len(v) - size + 1)) if v else ():
                win = v[s : s + size]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found |= {str(item)} if item is not None else set()
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 10").collect()]
    base = next(t for i, t in rows if i == 6)
    w = base.split()
    items = [(1, " ".join(w[5:25])), (2, "One"), (3, None), (4, ""), (10, " ".join(w[20:29])), (5, "a b c a b c a b c a b c"), (6, "nowhere to be found"), (None, " ".join(w[60:75])), (1, " ".join(w[5:25])), (7, "!!"), (8, "W1")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_words string")
    docs = odd.where("doc_id is null or doc_id <> 10")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = hits_by_hand(rows, items, 10)
    for block in (decontam.BLOCK, 3):
        got = decontam.contamination(docs, bench, block=block).select(*names).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert decontam.contamination(empty(docs), bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, empty(bench)).collect())
    clean = decontam.clean(odd, bench)
    bad = {x[0] for x in want if x[5]}
    assert clean.columns == odd.columns and not bad & {str(r.doc_id) for r in clean.collect() if r.doc_id is not None} and {1, 2, 3, 10} <= {r.doc_id for r in clean.collect()} | {10}


# -- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_the_librarys(spark, odd, library, small):
    texts = [r.text for r in odd.collect()] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(100).collect()]
    texts += ["", " ", "  a  b  ", "\n\n\tx", "a\u0000b", "日本語 テキスト", "🎉🎉 é́", "▁▁x ▁", "x" * 3000, " " * 50 + "y", "http://a.b/c?d=e&f=1#g\r\nZ"]
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    for text, raw in zip(texts, m.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == library.encode(text or "")
        assert m.decode(ids) == library.decode(ids)
        if "▁" not in (text or ""):
            assert m.decode(ids) == (text or "")


def test_viterbi_finds_the_best_segmentation():
    """A unigram model, made by hand, against all segmentations."""

    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    import struct

    pieces_ = {"<unk>": 0.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -4.4, "▁": -1.0, "▁a": -2.2}
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, b"\x02" if p == "<unk>" else b"\x01")) for p, s in pieces_.items())
    m = pieces.Model(data + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00")))
    assert m.kind == pieces.UNIGRAM and m.dummy
    names = list(pieces_)

    def best(word):
        if not word:
            return 0.0, ()
        return max((pieces_[p] + best(word[len(p) :])[0], (p, *best(word[len(p) :])[1])) for p in pieces_ if word.startswith(p))

    rng = random.Random(8)
    for _ in range(100):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        ids = np.frombuffer(m.encode([text])[0], "<i4")
        assert sum(pieces_[names[i]] for i in ids) == pytest.approx(best("▁" + text)[0], abs=1e-5)
        assert m.decode(ids.tolist()) == text


def test_piece_query(spark, odd):
    rows = pieces.digest(pieces.encoded(odd)).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert pieces.digest(pieces.encoded(empty(odd))).count() == 0


# -- pipeline


def test_pipeline_on_odd_documents(spark, small, odd, tmp_path):
    """Nulls, repeated rows, clashing columns, empty tables: each stage keeps the columns and drops what its rule says."""
    import corpus_pipeline as c

    docs = odd
    for name, stage in c.STAGES[:-1]:
        after = written(stage(spark, docs, small), "odd")
        assert after.columns == odd.columns and 0 < after.count() <= docs.count(), name
        if name == "quality rules":  # the empty ones and the repetitive one go, those without an id stay
            ids = [r.doc_id for r in after.collect()]
            assert not {1, 2, 3, 4, 5, 11, 14} & set(ids) and None in ids
        if name == "near duplicates":
            ids = [r.doc_id for r in after.collect()]
            assert len({6, 7, 8, 9} & set(ids)) == 1 and len(ids) == len(set(ids)) + (ids.count(None) or 1) - 1
        docs = after
        assert stage(spark, empty(odd), small).columns == odd.columns and stage(spark, empty(odd), small).count() == 0, name
    assert c.STAGES[-1][1](spark, docs, small).count() == docs.count() and c.STAGES[-1][1](spark, empty(odd), small).count() == 0
    # tables without rows
    none = str(tmp_path)
    empty(odd).write.parquet(f"{none}/documents.parquet")
    for table in ("labels", "benchmark"):
        empty(spark.read.parquet(f"{small}/{table}.parquet")).write.parquet(f"{none}/{table}.parquet")
    assert c.run(spark, none).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    names = [n for n, _ in c.STAGES]
    assert names == ["toxicity", "quality rules", "near duplicates", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    n, columns = docs.count(), docs.columns
    for name, stage in c.STAGES[:-1]:
        after = written(stage(spark, docs, small), "stage")
        assert after.columns == columns and 0 < after.count() <= n, name
        lost = {r.doc_id for r in docs.select("doc_id").exceptAll(after.select("doc_id")).collect()}
        if name == "near duplicates":
            want = groups_by_hand([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert lost == {int(d) for d, _, comp in want if d != comp}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert lost == {int(h[0]) for h in hits_by_hand([(r.doc_id, r.text) for r in docs.collect()], items, 10) if h[5]}
        docs, n = after, after.count()
    assert c.STAGES[-1][1](spark, docs, small).count() == n
    assert labels
    kept = c.run(spark, small)
    assert kept.count() == n and all(r.round_trip for r in kept.collect())
