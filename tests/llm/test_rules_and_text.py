import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decision_list as dl
from millrace.llm import line_blocks as lb
from millrace.llm import line_spread as ls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(tri), set()
    for i, x in enumerate(tri):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def test_op4_statistics_equal_plain_ones(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in dl.op4_decision_list(spark, sf).collect():
        own = plain_statistics(texts[r.doc_id])
        assert list(r)[1:6] == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.base_failed and r.kept)


def test_op4_statistics_of_odd_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\r\nx\r\nx", "é#é é#é é#é", "\x1c\x85\u00a0 \u2003", "w " * 5000, "\n".join(["same line here"] * 40)]
    texts += ["".join(rng.choice("ab #\n\té") for _ in range(rng.randrange(400))) for _ in range(200)]
    got = dl.text_statistics(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert [int(got[x][k]) for x in dl.STATS[:5]] == plain_statistics(t), t


def test_op4_learns_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in dl.op4_decision_list(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(x.quality, rows[x.doc_id].kept) for x in labels if not rows[x.doc_id].base_failed]
    assert sum(kept for q, kept in judged if q == 1) >= 0.98 * sum(q == 1 for q, _ in judged)
    assert sum(not kept for q, kept in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)


def test_sequential_covering_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = {n: rng.random(6000) for n in ("mean_word", "symbol_share", "upper_share")}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.5) & (x["mean_word"] < 0.2))
    train = {k: v[:4000] for k, v in x.items()}
    rules = dl.learn(train, bad[:4000])
    assert (rules.rejects({k: v[4000:] for k, v in x.items()}) == bad[4000:]).mean() > 0.98
    assert 2 <= len(rules.rules) <= 4 and str(rules).endswith("else: keep")
    assert dl.learn(train, np.zeros(4000, bool)).rules == [] and dl.learn(train, np.ones(4000, bool)).rules == []


def test_op4_edges(spark):
    good = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, None, 9, "a"), (None, good, 9, "b"), (2, good, 9, "c"), (2, good, 9, "c"), (3, "", 9, "d")], "doc_id long, text string, n_words int, s string")
    labels = spark.createDataFrame([(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    kept = dl.filter_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, good, 9, "b"), (2, good, 9, "c"), (2, good, 9, "c")], key=repr)
    assert dl.filter_quality(docs.limit(0), labels).count() == 0 and dl.judged(docs, dl.DecisionList()).count() == 5


def test_filter_equals_verdicts(spark):
    from millrace.llm.common import read

    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    kept = {r.doc_id for r in dl.filter_quality(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in dl.op4_decision_list(spark, sf).where("kept").collect()}


def test_op5_articles(spark, sf):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = lb.op5_line_blocks(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><header><h2>Site</h2></header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of our readers everywhere.</div>
<div id="content"><h1>A &amp; B &lt;i&gt;</h1><p>First   paragraph
with enough words to be a body of text, &eacute;&#233;&nbsp;x.</p><p>Second <b>one</b>, also with a good many words in it.</p><div class="ad">Buy now</div><p>Third.</p></div>
<section class="comments"><p>Reader: I disagree with every word of this long article and its author too.</p></section><form>Sign up <input></form><aside>Related</aside><footer>c</footer></body></html>"""


def test_op5_without_article_element():
    assert lb.main_text(PAGE) == "A & B <i>\nFirst paragraph with enough words to be a body of text, éé x.\nSecond one, also with a good many words in it.\nThird."


def test_op5_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "plain text", "x"), (2, "u", "plain text", "x"), (3, "u", "<p>" + "w " * 200_000, "x"), (4, "u", "<div class='ad'>never closed <article><p>in</p>", "x")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in lb.extract_main_text(df).collect()}
    assert got[1, None] == "" and got[None, "u"] == "" and got[2, "u"] == "plain text" and len(got[3, "u"]) == 399_999 and got[4, "u"] == "in"
    assert lb.extract_main_text(df).count() == 6 and lb.extract_main_text(df.limit(0)).count() == 0


def test_op5_stretches_decide_beside_articles():
    body = "A paragraph of the body with more than enough words in it to be the main text of this page."
    teaser = "<article><h2>Teaser</h2><p>Read on.</p></article>"
    assert lb.main_text(f"<body>{teaser}<div><p>{body}</p><p>Two. {body}</p></div></body>") == f"{body}\nTwo. {body}"
    comment = f"<article class='comment' id='div-comment-7'><p>I disagree. {body}</p></article>"
    assert lb.main_text(f"<body><article class='post'><p>{body}</p></article>{comment}</body>") == body
    assert lb.main_text(f"<body><div><p>{body}</p></div><section class='comments'><h3>Two</h3>{comment}<p>Log in. {body}</p></section></body>") == body
    assert lb.main_text(f"<body><div>{body[:60]}</div><article><p>{body[:60]}</p></article></body>") == body[:60]


def test_op5_leaves_out_whole_names_and_real_hiding_only():
    kept = ["style='overflow:hidden'", 'class="overflow-hidden"', "data-x='a hidden thing'", "title='display:none'", 'class="content with-sidebar"', 'class="share-price"', "class=navy", "hidden=false"]
    gone = ["hidden", "HIDDEN=''", "style='color:red; Display : none !important'", "style=visibility:hidden", "aria-hidden=true", 'class="x sidebar"', "id=site-footer", "class='cookie-notice'", "class='comment-list'", "role=navigation", "aria-label=Breadcrumb"]
    for attrs in kept + gone:
        text = lb.main_text(f"<body><div><p>Before.</p><div {attrs}>Inside.</div><p>After.</p></div></body>")
        assert text == ("Before.\nInside.\nAfter." if attrs in kept else "Before.\nAfter."), attrs
    assert lb.main_text("<p>See <a href='/hidden-gems'>hidden gems</a>.</p>") == "See hidden gems."


def test_op5_unclosed_and_self_closed_elements():
    for icon in ('<svg class="icon"/>', "<math/>", "<svg class=icon>", "<math>", "<svg viewBox='0 0 1 1'><path d='M0'/></svg>", "<math><mi>x</mi></math>", "<iframe src=x>", "<object data='y'>", "<svg><title>Icon</title><text>Label</text></svg>"):
        for later in ("", "<div><svg><path/></svg></div>"):
            assert lb.main_text(f"<body><div><p>Before {icon}</p><p>After.</p>{later}<p>End.</p></div></body>") == "Before\nAfter.\nEnd.", icon
    assert lb.main_text("<p>Text.</p><script>if (a) { b = '<p>no</p>'") == "Text."


def test_op5_by_lengths_alone(spark, monkeypatch):
    """Without article elements and without the list of names, the article still comes out and the rest stays out."""
    monkeypatch.setattr(lb, "_CHROME_NAME", re.compile(r"(?!)"))
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)
        article, got = lb.main_text(r.html).split("\n"), lb.main_text(plain).split("\n")
        rest = [x for x in lb.strip_markup(re.sub(r"</?(?:nav|footer)>", "", r.html))[0] if x and x not in article]
        assert sum(map(len, set(article) & set(got))) >= 0.9 * sum(map(len, set(article))) and sum(len(x) for x in got if x in rest) <= 0.1 * sum(map(len, rest))


def test_op5_windows_surge_and_dive():
    """Stretches against their definition: maximal runs without ``width`` empty lines, and the highest sum of ``width`` lines."""
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.choice((0, 0, 0, 5, 40, 90)) for _ in range(rng.randrange(30))]
        runs, k = [], 0
        while k < len(lengths):
            if lengths[k]:
                end = last = k
                while end < len(lengths) and end - last <= 3:
                    last = end if lengths[end] else last
                    end += 1
                runs.append((k, last + 1, max(sum(lengths[max(k, i - 2) : i + 1]) for i in range(k, last + 1))))
                k = last + 1
            else:
                k += 1
        assert lb.stretches(lengths) == runs


def test_op5_short_stretches_beside_the_text():
    body = "A paragraph of the body with more than enough words in it to be the main text of this page."
    ad = "<aside>Buy this now.</aside>"
    page = f"<div><p>Start.</p></div>{ad}<div><p>{body}</p></div>{ad}<div><p>The end.</p></div>"
    assert lb.main_text(f"<body>{page}</body>") == f"Start.\n{body}\nThe end."
    assert lb.main_text(f"<body><div>Far.</div>{ad}{page}</body>") == f"Start.\n{body}\nThe end."
    assert lb.main_text(f"<body><div>Out.</div><article>{page}</article><div>Out.</div></body>") == f"Start.\n{body}\nThe end."


def test_op10_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, ls.op10_line_spread(spark, sf).collect())) == sorted(c.sql(ls.ORACLE_SQL).fetchall())


def test_op10_thresholds(spark):
    """Lines on 9, 10, 11 and 60 sites; short lines and one site's repetitions stay."""
    rows, n = [], 0
    for name, sites in (("nine", 9), ("ten", 10), ("eleven", 11), ("sixty", 60)):
        for k in range(sites):
            rows.append((n, f"own line number {n}\nthe shared {name} line\nshort one\n", f"site{k}"))
            n += 1
    rows += [(n + k, "only on one site here\n", "site1") for k in range(50)]
    rows += [(n + 50, None, "a"), (n + 51, "", None), (None, "the shared ten line", None), (n + 52, "the shared ten line", "site1")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, line int")
    out = ls.without_boilerplate(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    with_line = lambda name: sorted((r.doc_id for r in got if r.text and f"the shared {name} line" in r.text), key=repr)
    assert with_line("nine") == list(range(9)) and with_line("ten") == [9] and with_line("eleven") == [19] and with_line("sixty") == [30]
    assert sum("only on one site" in (r.text or "") for r in got) == 50 and sum("short one" in (r.text or "") for r in got) == 90
    assert {r.doc_id: r.text for r in got}[10] == "own line number 10\nshort one\n" and {r.doc_id: r.text for r in got}[n + 50] is None
    assert ls.without_boilerplate(df.limit(0)).count() == 0


def test_sketch_estimates(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select((F.col("id") % 2000).alias("doc_id"), F.explode(F.array(*(F.when(F.col("id") < k, F.lit(k)) for k in (1, 5, 20, 200, 2000)))).alias("k")).where("k IS NOT NULL").withColumn("site", F.col("doc_id").cast("string"))
    got = {r.k: r.sites for r in ls.sketched(rows, "k", "site").collect()}
    assert all(abs(got[k] - k) <= 0.1 * k for k in got) and len(got) == 5


@pytest.mark.parametrize("sites", [10, 1_000, 30_000, 100_000])
def test_op10_any_threshold_is_exact(spark, sites):
    """Lines on just fewer, just enough, half and many more sites than the threshold."""
    from pyspark.sql import functions as F

    spread = {"half": sites // 2, "less": sites - 1, "just": sites, "three": 3 * sites}
    docs = spark.range(3 * sites).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.concat_ws("\n", *(F.when(F.col("id") < n, F.lit(f"the line of {name} sites")) for name, n in spread.items())).alias("text"))
    flagged = {r.line for r in ls.boilerplate(docs, sites).collect()}
    assert flagged == {r.h for r in spark.range(1).select(F.explode(F.array(*(F.xxhash64(F.lit(f"the line of {n} sites")) for n in ("just", "three")))).alias("h")).collect()}


def test_op10_joined_as_broadcast(spark, monkeypatch):
    """Beyond the bound of the broadcast the result is the same; ids are missing and repeated."""
    rows = [(n % 7 if n % 3 else None, f"own line number {n}\nthe shared line here is long\n", f"site{n}", 1) for n in range(40)] + [(99, None, "a", 1), (98, "", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int")
    broadcast = sorted((tuple(r)[:3] for r in ls.without_boilerplate(df).collect()), key=repr)
    monkeypatch.setattr(ls, "MOST_BROADCAST_ROWS", -1)
    joined = ls.without_boilerplate(df)
    assert joined.columns == df.columns and sorted((tuple(r)[:3] for r in joined.collect()), key=repr) == broadcast
    assert sum("shared" in (r[1] or "") for r in broadcast) == sum(r[0] == 0 for r in rows)
