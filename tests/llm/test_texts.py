"""Page extraction, personal data, toxicity and the pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, private_data, queries, quality, shingle_join, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>gone</p> --><main><article><h1>Head &amp; line</h1>
<p>One <b>bold</b>ly   put&nbsp;word<br>next<p>Two &lt;tags&gt; &copy <img alt="a>b" src=x> end
<aside>Aside</aside><div class="ad">Buy</div><form><p>mail</p></form><ul><li>first<li>second</ul></article></main>
<section id="comments"><p>Nice post!</p></section><footer>&copy; x</footer></body></html>"""


def test_zones_and_references():
    found = html_text.blocks(PAGE)
    assert [t for t, z in found if z == html_text.MAIN] == [
        "Head & line", "One boldly put word next", "Two <tags> © end", "first", "second"]
    assert all(t not in ("gone", "T") and "no" != t for t, _ in found)


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("plain words", "plain words"), ("<article>a<p>b", "a b"), ("<article>x &am", "x &am"),
    ("<article>x &amp", "x &"), ("<article>1 < 2 <p", "1 < 2"), ("<article><script>never", ""), ("<article>a<b", "a"),
    ("<main><p>in</main><p>out words", "in out words"), ("<p title='it''s>x</p>", "x"), ("<article/>", "")])
def test_pages_that_end_anywhere(page, text):
    found = html_text.blocks(page or "")
    assert " ".join(t for t, z in found if z != html_text.FURNITURE) == text


@pytest.mark.parametrize("page, text", [
    ('<div class="layout with-sidebar"><main><p>The real article text here.</p></main></div>', "The real article text here."),
    ('<div class="page no-comments"><article>Kept text</article></div>', "Kept text"),
    ('<div id="sidebar-layout"><article>Kept</article><p>menu</p></div>', "Kept"),
    ('<div class="has-banner"><p>open</p></div>', "open"),
    ('<article>a <span hidden>secret</span>b <span aria-hidden="true">x <span>y</span></span>c</article>', "a b c"),
    ('<article><i style="display: none">no</i>yes<p><b hidden>no<p>next</article>', "yes next"),
    ('<article>text<div style="display:none">no</div></article>', "text"),
    ('<section id="comments"><article>Nice post!</article></section><div class="related-posts"><article>Other</article></div>', ""),
    ('<article class="comment">Nice</article><article class="post">Own</article>', "Own"),
    ('<div class="cookie-notice">c</div><div class="main-content"><p>t</p></div><div class="site-footer">f</div>', "t"),
    ('<div class="post-sidebar"><p>side</p></div><p class="lead no-ad">lead</p>', "lead"),
])
def test_wrappers_and_hidden_text(page, text):
    assert " ".join(t for t, z in html_text.blocks(page) if z != html_text.FURNITURE) == text


def test_long_and_repeated_pages_and_other_columns(spark):
    long = "<article>" + "<p>" + "word " * 60_000 + "</p>" * 2 + "<p>" * 5_000 + "end" + "</article>"
    rows = [(1, "http://a.org", long, "x", 1, b"z"), (1, "http://a.org", long, "y", 2, b"z"), (2, None, None, None, None, None), (None, "u", "<p" * 50_000, "x", 3, b"")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, chunk int, mark binary")
    got = html_text.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.n_chars) for r in got.collect())
    assert found == [(0, 0), (1, 300_003), (1, 300_003), (2, 0)]


def test_articles_of_pages(spark, small):
    got = {r.page_id: r for r in queries.QUERIES["op2_host_suffixes"](spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    import html

    for page in pages:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        plain = re.sub(r"</?b>", "", inside[1]) if inside else ""
        plain = html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", plain))
        assert got[page.page_id].text == " ".join(plain.split()) and got[page.page_id].n_chars == len(got[page.page_id].text)


def test_repeated_runs_of_a_host_go(spark, monkeypatch):
    monkeypatch.setattr(html_text, "CHUNK_BYTES", 700)
    monkeypatch.setattr(html_text, "BUCKET_BYTES", 700)
    line = "read more stories from our partner sites every day"
    body = lambda i: f"<body><p>{line}</p><p>" + " ".join(f"own{i}word{j}" for j in range(30)) + f"</p><p>s{i} {line} tail{i}</p></body>"
    rows = [(i, f"http://www.One.org/{i}", body(i)) for i in range(20)]
    rows += [(100, "http://two.org/x", body(100)), (101, None, body(101)), (None, "http://one.org/n", body(102))]
    rows += [(200 + i, f"http://copy.org/{i}", "<body><p>" + " ".join(f"same{j}" for j in range(80)) + f"</p><p>unlike{i}</p></body>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == " ".join(f"own{i}word{j}" for j in range(30)) + f" s{i} tail{i}"
    assert got[100].startswith(line) and got[101].startswith(line) and got[None].startswith("own102word0")
    assert all(got[200 + i].startswith("same0 same1") for i in range(3))


def test_equal_streams_are_one_page_and_phrases_stay(spark):
    copy = "<body><p>" + " ".join(f"once{j}" for j in range(40)) + "</p></body>"
    rows = [(i, f"http://c.org/{i}", f"<!-- {i} -->" + copy) for i in range(12)]
    prose = lambda i: " ".join(f"a{i}x{j}" for j in range(8)) + " at the end of the day " + " ".join(f"b{i}x{j}" for j in range(8))
    line = "all rights are reserved by us"
    rows += [(100 + i, f"http://p.org/{i}", f"<body><p>{prose(i)}</p><p>{line}</p></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(f"once{j}" for j in range(40)) for i in range(12))
    assert all(got[100 + i] == prose(i) for i in range(12))


def test_pages_are_dealt_once_for_all_passes(spark, small):
    """Before, the hashes of streams were a job of their own, which dealt the pages once more."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = html_text.extract(pages)
    assert found.count() == pages.count() and set(os.listdir(folder)) == before


def test_hosts():
    assert [html_text.host_of(u) for u in ("https://u:p@WWW.A.org:80/x", "a.org", None, "http://b.a.org?x")] == ["a.org", "", "", "b.a.org"]


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_spans(rows, texts):
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], r.spans)
        assert r.spans.split(",")[:len(want)] == want or (not want and (r.spans == "" or r.spans.startswith("id:")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in PATTERNS]


def test_base_spans_of_documents(spark, small, small_docs):
    rows = queries.QUERIES["op6_context_bootstrap"](spark, small).collect()
    assert len(rows) == len(small_docs)
    check_spans(rows, dict(small_docs))


HARD = [
    "a@b.c%x@d.e", "a@b.c.d@e.f", "..a..@x-.y", "a@b", "@a.b", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "01.002.0003.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111111111111111" * 2, "12 34 56", "+1 (988) 555-2485.", "+12", "++1 2345678", "+1 23 (",
    "😀 é a@b.co 😀 1.2.3.4 漢 +49 30 1234567", "4111  1111 1111 1111", "1" * 3000, "a" * 5000 + "@", "1.1.1.256 4012888888881881x", None, "",
]


def test_base_spans_of_hard_texts(spark):
    rows = list(enumerate(HARD))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check_spans(private_data.report(private_data.find(frame)).collect(), dict(rows))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"he wrote: reach me at user{i}@site{i}.org or never") for i in range(8)]
    rows += [(50, "reach me at AB-204-9917 please"), (51, "version 2024-11-05 of the text"), (52, "reach me at noon"), (53, "page 204991 at last")]
    got = {r.doc_id: r.spans for r in private_data.report(private_data.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50] == "id:12:23" and got[51] == got[52] == got[53] == ""


def brute_patterns(rows):
    """Confidence of each pattern after the rounds, from (pattern, instance) -> seed."""
    edges = {}
    for r in rows:
        for pattern in r.patterns:
            edges[pattern, r.instance] = edges.get((pattern, r.instance), False) or r.seed
    score = {edge: float(seed) for edge, seed in edges.items()}
    for _ in range(private_data.ROUNDS):
        of_pattern = {p: [s for (q, _), s in score.items() if q == p] for p, _ in edges}
        confidence = {p: sum(s) / (len(s) + 0.5) for p, s in of_pattern.items()}
        best = {}
        for p, i in edges:
            best[i] = max(best.get(i, 0), confidence[p])
        score = {(p, i): 1.0 if seed else best[i] for (p, i), seed in edges.items()}
    seeds = {p: sum(seed for (q, _), seed in edges.items() if q == p) for p, _ in edges}
    return {p: c for p, c in confidence.items() if c >= private_data.CONFIDENCE and seeds[p] >= private_data.SUPPORT}


@pytest.mark.parametrize("most", [500_000, 0])
def test_patterns_against_brute_force(spark, monkeypatch, most):
    rows = [(i, f"{'write to' if i % 3 else 'so ask'} user{i % 9}@site{i % 5}.org, account number {i}55-{i % 7} and write to AB-{i % 4}-{i}1") for i in range(40)]
    rows += [(100 + i, f"seen on page {i}10 with id=QX{i % 3}7{i}") for i in range(30)]
    # one instance behind a third of all patterns
    rows += [(200 + i, f"word{i} hot{i}00@x.org then word{i} same@hot.org") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = private_data._with_base(docs, "doc_id", "text").select("row", F.col("__text").alias("text"), "base")
    found = private_data.instances(whole)
    monkeypatch.setattr(private_data, "MAX_SENT", most)
    got = {r.pattern: r.confidence for r in private_data.confident_patterns(found).collect()}
    want = brute_patterns(found.collect())
    assert want and got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_masking(spark, odd):
    frame = spark.createDataFrame([(1, "x", "to a@b.co, from 1.2.3.4 é+49 30 1234567.", None), (2, "y", None, 7)], "doc_id long, base string, text string, row int")
    got = {r.doc_id: r for r in private_data.masked(frame).collect()}
    assert got[1].text == "to <EMAIL>, from <IP> é<PHONE>." and got[1].base == "x" and got[2].text is None and got[2].row == 7
    assert private_data.masked(odd).count() == odd.count() and private_data.masked(odd).columns == odd.columns


def test_private_data_runs_without_python(spark, small):
    frame = private_data.masked(spark.read.parquet(f"{small}/documents.parquet"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_toxicity_of_documents(spark, small):
    rows = queries.QUERIES["op1_weak_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    import zlib

    assert len(rows) == 1000
    right = seen = found = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            right += r.predicted == labels[r.doc_id]
            seen += 1
            found += r.predicted and labels[r.doc_id]
    assert right / seen > 0.95 and found


def test_toxicity_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (99, 1), (3, 7)], "doc_id long, toxic int")
    for known in (labels, labels.where("doc_id = -1")):
        rows = toxicity.score(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(none, labels).count() == 0
    words = spark.createDataFrame([(1, "you are an idiot and a worthless moron"), (2, "you are on the tram")], "doc_id long, text string")
    rude, plain = toxicity.score(words, labels.where("doc_id = -1")).orderBy("doc_id").collect()
    assert rude.score > 0.5 > plain.score


def test_labels_of_held_out_rows_change_no_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, known).collect()} for known in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-12) and len(a) == 200


def test_label_model_weighs_the_given_label_by_its_rates():
    import numpy as np

    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.2
    voters = np.stack([np.where(truth, draw.random(4000) < 0.5, draw.random(4000) < 0.03) for _ in range(8)], axis=1)
    copies = np.repeat(voters[:, :1], 6, axis=1)  # one voter six times over
    wrong = draw.random(4000) < 0.15
    for given, least in ((truth, 0.99), (truth ^ wrong, 0.93)):
        found = toxicity.label_model(np.column_stack([voters, copies, given]).astype(np.uint8)) > 0.5
        assert (found == truth).mean() > least
    assert (found == truth).mean() > (given == truth).mean() + 0.05


def test_every_entry_of_the_lexicon_votes_by_itself():
    reader = toxicity.Reader({}, {"=tram": 0})
    votes = lambda text: reader.votes(text, toxicity.word_counts(text))
    assert votes("the tram") == [0] and votes("on time") == []
    idiot, moron = votes("idiot"), votes("moron")
    assert len(idiot) == len(moron) == 1 and idiot != moron and votes("Idiot, moron!") == sorted(idiot + moron)


def test_pages_and_private_data_of_nothing(spark, none):
    assert private_data.find(none).count() == 0 and private_data.masked(none).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_survivors(texts, width=5, percent=80):
    """The least id of each group of texts that share 80 % of their five-word shingles."""
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j:j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {root(i) for i in sets}


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, frames = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], small).write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(names) - 1:
            assert frames[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert ids[1] == sorted(r.doc_id for r in quality.apply_rules(docs).where("kept").select("doc_id").collect())
    assert ids[2] == sorted(plain_survivors([(r.doc_id, r.text) for r in frames[1].select("doc_id", "text").collect()]))
    assert ids[3] == ids[2]
    texts = {r.doc_id: r.text for r in frames[2].collect()}
    for r in frames[3].collect():
        assert r.n_chars == len(r.text) and not plain_spans(r.text)
        assert bool(plain_spans(texts[r.doc_id])) <= (r.text != texts[r.doc_id])
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, set(ids[4]))) <= 2
    last = frames[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in last)
    assert frames[5].where("piece = 0").count() == len(ids[4])


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
