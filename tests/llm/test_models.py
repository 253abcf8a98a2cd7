import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextloom.llm import htmlblocks, langid, lm, mincut, toxicity, warc
from contextloom.llm.lattice import Pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language(spark):
    r = random.Random(0)
    sounds = {"en": ["th", "ing", "er", "on", "wh"], "fr": ["eau", "oi", "é", "que", "ou"], "zz": ["kx", "qo", "zu", "xi", "ka"]}
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(3)) for _ in range(30)), lang) for i, (lang, s) in enumerate(list(sounds.items()) * 40)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (None, "thing", "en"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert {x.lang_pred for x in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_more_than_256_languages(spark):
    rows = [(5 * k + i, " ".join([chr(0x4E00 + k) * (1 + i % 3)] * 6), f"l{k:03}") for k in range(262) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.names == [f"l{k:03}" for k in range(262)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert [i for i, _, lang in rows if got[i] != lang] == []


def test_follow_the_regularised_leader_step_by_step():
    r = random.Random(3)
    idf = np.array([1 + (i % 7) / 4 for i in range(langid.BUCKETS)])
    rows = []
    for k in range(40):
        found = sorted(r.sample(range(30), 6))
        found = [x + 30 * (k % 3) * (r.random() < 0.8) for x in found]
        found = sorted(set(found))
        rows.append((np.array(found), np.array([r.randrange(1, 5) for _ in found], dtype=float), k % 3))
    got, temperature = langid.fit(rows, 3, idf)

    cases = []
    for found, often, y in rows:  # the last value is the constant
        x = [(1 + math.log(o)) * idf[f] for f, o in zip(found, often, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        cases.append(([(int(f), v / norm) for f, v in zip(found, x, strict=True)] + [(langid.BUCKETS, 0.1)], y))
    z, n = {}, {}

    def weight(i, c):
        zi = z.get((i, c), 0.0)
        if abs(zi) <= langid.L1:
            return 0.0
        return -(zi - math.copysign(langid.L1, zi)) / ((langid.BETA + math.sqrt(n.get((i, c), 0.0))) / langid.ALPHA + langid.L2)

    def chances(x, t=1.0):
        logits = [sum(v * weight(i, c) for i, v in x) / t for c in range(3)]
        e = [math.exp(v - max(logits)) for v in logits]
        return [v / sum(e) for v in e]

    train = [c for i, c in enumerate(cases) if i % 5]
    for epoch in range(langid.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            x, y = train[k]
            p = chances(x)
            old = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            for i, v in x:
                for c in range(3):
                    g, at = (p[c] - (c == y)) * v, n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(at + g * g) - math.sqrt(at)) / langid.ALPHA * old[i, c]
                    n[i, c] = at + g * g
    want = np.zeros_like(got)
    for i, c in z:
        want[i, c] = weight(i, c)
    assert np.allclose(got, want, atol=1e-9)
    assert ((got == 0) == (want == 0)).all() and (want[sorted({i for i, _ in z})] == 0).any()
    held = [c for i, c in enumerate(cases) if not i % 5]
    loss = lambda t: -sum(math.log(chances(x, t)[y] + 1e-12) for x, y in held)
    assert loss(temperature) <= min(loss(math.exp(math.log(0.5) + k * math.log(20) / 300)) for k in range(301)) + 1e-6


def test_document_frequencies_and_blank_languages(spark):
    texts = ["thing and other things", "und die anderen Dinge", "thing", "ça et là", "word " * 30000, "thing"]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(9, None, "a"), (8, "left out", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    seen = [set(langid.features(t).tolist()) for t in texts]
    want = [math.log((1 + len(texts)) / (1 + sum(b in s for s in seen))) + 1 for b in range(langid.BUCKETS)]
    assert np.allclose(model.idf, want)
    clash = docs.withColumn("LANG_PRED", F.lit("x"))
    got = langid.identify(clash.unionAll(clash), model).collect()
    assert len(got) == 16 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 8
    assert langid.identify(clash.limit(0), model).count() == 0


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(0)
    trans = r.normal(size=(2, 2))
    lengths = np.array([3, 0, 1, 5])
    u = r.normal(size=lengths.sum())
    p, pair = toxicity.runs(u, lengths, trans)
    at = 0
    for n in lengths:
        total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            # the first token is entered with the weight of other to its label, where other to other counts as 1
            enter = trans[0, 1] if n and y[0] else 0.0
            w = math.exp(enter + sum(u[at + k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            one += w * np.array(y)
            for k in range(n - 1):
                two[k, y[k], y[k + 1]] += w
        assert np.allclose(p[at : at + n], one / total)
        assert np.allclose(pair[at : at + n], two / total)
        at += n


def test_toxicity(spark):
    r = random.Random(1)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "ls")]
    bad = ["grumblex", "snarkoid", "vilehead"]
    rows, labels = [], []
    for i in range(240):
        ws = [r.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            for k in r.sample(range(40), 3):
                ws[k] = r.choice(bad) + r.choice(["", ",", "!!"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(500, None), (501, ""), (502, "bo " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.train(docs.where("doc_id < 160"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 160"))
    got = {x.doc_id: x for x in toxicity.tag(docs, field).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(160, 240))
    text = dict(rows)
    assert all(any(b in text[i][s.begin : s.end] for b in bad) for i in range(0, 240, 3) for s in got[i].spans)
    assert [got[i].predicted for i in (500, 501, 502)] == [0, 0, 0]
    assert {x.score for x in toxicity.tag(docs, None).collect()} == {0.0}


def brute_likelihood(pieces, byte_ids, logp, word):
    known = {p: logp[i] for i, p in enumerate(pieces) if p and i not in set(byte_ids)}
    word = "▁" + word
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            part = word[i:j]
            w = known.get(part)
            if w is None and j - i == 1:
                w = sum(logp[byte_ids[b]] for b in part.encode())
            if w is not None:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + w)
    return alpha[-1]


def test_lattice_against_brute_force():
    pieces, byte_ids, logp = lm.load_pieces()
    model = Pieces(pieces, byte_ids, logp)
    words = ["the", "a", "ciónque", "réeux", "中x😀", "thntblere", "z" * 70, ""]
    assert np.allclose(model.likelihood(words), [brute_likelihood(pieces, byte_ids, logp, w) for w in words])
    often = np.array([2.0] * len(words))
    uses, step = model.expected(words, often), 1e-5
    for i in np.argsort(-uses)[:5]:  # the expected uses are the gradient of the log likelihood
        more = logp.copy()
        more[i] += step
        gain = (Pieces(pieces, byte_ids, more).likelihood(words) - model.likelihood(words)).sum() * 2 / step
        assert gain == pytest.approx(uses[i], rel=1e-3)


def test_language_model(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["The", "cat", "sat", "OÉ", "zig"]) + r.choice(["", "s", "x" * (i % 5)]) for _ in range(20))) for i in range(30)]
    rows += [(100, None), (101, ""), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    got = lm.score_documents(docs, "held", frequent=4).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*WORD.findall((t or "").translate(low)), "\n"]) for i, t in rows]
    counts: dict = {}
    for i, ws in tokens:
        if i % 7 != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    again = {r.doc_id: r.score for r in lm.score_documents(docs.repartition(5), "held", frequent=100).collect()}
    assert all(r.score == pytest.approx(again[r.doc_id], rel=1e-6) for r in got)
    assert lm.score_documents(docs.limit(0), "held").count() == 0


def test_minimum_cut_against_all_labellings():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(2, 8)
        bias = [r.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda y: sum(abs(b) for b, x in zip(bias, y, strict=True) if (b > 0) != x) + sum(w for a, b, w in links if y[a] != y[b])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert cost(mincut.minimum_cut(bias, links)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><script>var x = "</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- ad 1 --><div class="ad">Buy this now, really good</div><div class="cookie-notice"><p>We use cookies to make this page better for all of our readers and friends.</p></div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph with &lt;tags&gt;.<br><p>Second, 1 < 2.</p><aside>See also</aside><p>End</p></article>
<div class="sidebar"><p>Some long text of a sidebar that reads as if it were a paragraph of the article itself.</p></div>
<section id="comments"><p>I agree with all that was said in this article, thank you very much indeed.</p></section>
<form><label>Name</label><input></form><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", PAGE[: PAGE.index("End")]), (5, "u", "<p>" + "word and, more. " * 5000), (6, "u", PAGE)]
    got = {r.page_id: r for r in mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nFirst paragraph with <tags>.\nSecond, 1 < 2.\nEnd" == got[6].text
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].text == "Head & line\nFirst paragraph with <tags>.\nSecond, 1 < 2."
    assert got[5].text == ("word and, more. " * 5000).strip() and got[5].n_chars == len(got[5].text)


def test_extraction_of_wrapped_pages():
    one, two = "First words of the story, told at some length. " * 8, "Second words, a few more of them, for the end of it. " * 3
    body, said = f"<h2>Head</h2><p>{one}</p><p>{two}</p>", "I agree with all of it, and I should like to add some words of my own. " * 20
    want = f"Head\n{one.strip()}\n{two.strip()}"
    nav, foot = "<nav><p>Go here, go there, go on and on to all of the other places of this site.</p></nav>", "<footer>Me</footer>"
    for box in ("form id=f", "div class='has-sidebar'", "div class='no-comments'", "div class=hasSidebar", "div id=page class='sidebar left'", "div class='discussion'"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>", f"<div><div class=x>{body}</div></div>"):
            assert mincut.main_text(f"<html><body>{nav}<{box}>{inner}</{box.split()[0]}>{foot}</body></html>") == want, (box, inner)
    for box in ("article class='has-comments'", "main class='with-sidebar'", "article class=share"):
        assert mincut.main_text(f"<body>{nav}<{box}>{body}</{box.split()[0]}>{foot}</body>") == want, box
    # each of two forms holds half
    assert mincut.main_text(f"<form><article><p>{one}</p></article></form><form><article><p>{one}</p></article></form>") == f"{one.strip()}\n{one.strip()}"
    # what is no wrapper stays boilerplate, whatever it holds
    for rest in (f"<section id=comments><article class=comment><p>{said}</p></article></section>", f"<aside><article><p>{said}</p></article></aside>", f"<div class=sidebar><p>{said}</p></div>", "<div class=related><article><a href=/>Some other story that is told elsewhere</a></article></div>"):
        assert mincut.main_text(f"<body>{nav}<form><article>{body}</article>{rest}</form>{rest}{foot}</body>") == want, rest
        assert mincut.main_text(f"<body>{nav}<article>{body}</article>{rest}{foot}</body>") == want, rest
    assert mincut.main_text(f"<body><p>{one}</p><div id=comments><p>{said}</p></div></body>") == one.strip()
    assert mincut.main_text(f"<body>{nav}<div class=cookie-notice><p>We use cookies to make this page better for all of our readers.</p></div>{foot}") == ""
    assert mincut.main_text(f"<body>{nav}<form><label>Name</label></form>{foot}") == ""


def test_silent_elements_without_end_tags():
    text = lambda x: "\n".join(b.text for b in htmlblocks.parse(x).blocks)
    assert text("<html><head><title>t</title><meta name=a><script>'<p>'</script><h1>Head</h1><p>One<p>Two") == "Head\nOne\nTwo"
    assert text("<head><title>t</title><link rel=x> Just words") == "Just words"
    assert text("<head><title>t</title><!-- <body> --><noscript><img></noscript></head>One") == "One"
    assert text("<head><title>t</title><template><p>no</p></template><body>One") == "One"
    assert text("<head><head><head><p>One") == "One"
    for name in ("button", "select", "object", "iframe", "video", "canvas", "svg", "noscript", "map"):
        assert text(f"<p>One</p><{name} a=b><p>Two</p><p>Three</p>") == "One\nTwo\nThree", name
        assert text(f"<p>One</p><{name}><p>Two</p><{name}>no</{name}><p>Three</p>") == "One\nTwo\nThree", name
        assert text(f"<p>One</p><{name}>no<{name}>no</{name}>no</{name}><p>Two</p>") == "One\nTwo", name
    # code goes on to the end, as in a browser
    assert text("<p>One</p><script>var a = 1; <p>Two</p>") == "One" == text("<p>One</p><style>p {} <p>Two</p>")
    assert text("<p>One</p><script>'<script>'</script><p>Two</p>") == "One\nTwo"
    many = "<script>var a;</script><style>p {}</style>" * 40 + "<script>'<body>no'</script>"
    assert text(f"<head>{many}<title>t</title></head><p>One</p>") == "One"
    assert text(f"<head>{many}<title>t</title><body><p>One</p>") == "One"
    assert mincut.main_text("<head><title>t</title><p>" + "Some words, and more. " * 20) == ("Some words, and more. " * 20).strip()
    assert warc.plain_text("<p>One</p><button><p>Two</p>") == "One\nTwo"


def test_derivatives_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    responses = warc.responses_of(pages)
    made = warc.derivatives(responses).collect()
    assert len(made) == 6
    ids = {r.record_id for r in responses.collect()}
    assert {r.refers_to for r in made} == ids
    meta = next(r for r in made if r.kind == "metadata" and r.target_uri)
    assert b"title: t & u\r\n" in bytes(meta.block) and b"outlink: /a\r\n" in bytes(meta.block) and b"source-http-content-type: text/html; charset=utf-8" in bytes(meta.block)
    assert meta.block_digest == warc.digest(bytes(meta.block)) and meta.payload_digest == warc.digest(PAGE.encode())
    again = warc.read_files(warc.file_contents(warc.derivatives(responses))).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    plain = {"record_id": "<x>", "kind": "response", "target_uri": "u", "warc_date": "d", "payload_digest": None, "headers": [], "block": b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"}
    assert [r["kind"] for r in warc.derive(plain)] == ["metadata"]


def test_marked_leaves_hold_no_scripts():
    page = '<article><p class="lead">Hello there <script>var a=1;</script><style>p{}</style>world, <button>Buy</button>this is the <a href="x">linked</a> text of a page that says much.</p></article>'
    assert mincut.main_text(page) == "Hello there world, this is the linked text of a page that says much."
    assert mincut.main_text('<article><p id=a>One two three four five.<p id=b>Six seven eight nine.</article>') == "One two three four five.\nSix seven eight nine."


def test_extraction_of_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 40 + "</p>", "x", 7)], "page_id long, url string, html string, Text string, _row int")
    row = mincut.extract(df).first()
    assert row["_row"] == 7 and row["text"].startswith("word word") and row["n_chars"] == 199
    assert mincut.extract(df.limit(0)).count() == 0


def test_odd_responses(spark):
    import gzip

    def response(head, payload):
        return {"record_id": "<r>", "target_uri": "u", "warc_date": "d", "payload_digest": None, "headers": [], "block": b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload}

    def text(head, payload):
        return [x["block"].decode() for x in warc.derive(response(head, payload)) if x["kind"] == "conversion"]

    page = "<p>Grüße an alle</p>"
    for charset in (b"idna", b"undefined", b"nothing", b"utf-8"):
        assert text(b"Content-Type: text/html; charset=" + charset, page.encode()) == ["Grüße an alle"]
    assert text(b"Content-Type: text/html", b'<meta charset="iso-8859-1">' + page.encode("latin-1")) == ["Grüße an alle"]
    packed = gzip.compress(page.encode())
    assert text(b"Content-Type: text/html\r\nContent-Encoding: gzip", packed) == ["Grüße an alle"]
    chunked = b"%x\r\n" % 10 + packed[:10] + b"\r\n%x;a=b\r\n" % (len(packed) - 10) + packed[10:] + b"\r\n0\r\n\r\n"
    assert text(b"Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked) == ["Grüße an alle"]
    assert text(b"Content-Type: text/html\r\nContent-Encoding: gzip", b"not packed") == ["not packed"]


def test_cut_files():
    record = {"kind": "response", "record_id": "<a>", "warc_date": "d", "target_uri": "u", "refers_to": None, "payload_digest": None, "block_digest": None, "content_type": "t", "headers": [], "block": b"x" * 50}
    whole = warc.to_bytes(record) * 2
    assert len(list(warc.from_bytes(whole))) == 2
    assert [len(x["block"]) for x in warc.from_bytes(whole[:-30])] == [50, 24]
    assert len(list(warc.from_bytes(whole[: len(whole) // 2 + 20]))) == 1
    import gzip

    packed = gzip.compress(warc.to_bytes(record))
    assert len(list(warc.from_bytes(packed + packed[:-12]))) >= 1


def test_toxicity_of_empty_tables_clashes_and_contradictions(spark):
    texts = [(i, ("bad " if i % 2 else "") + f"plain text number{i} of many words") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("Score", F.lit("x")).withColumn("_row", F.lit(3))
    both = [(i, i % 2) for i in range(80)] + [(1, 0), (3, 0), (5, 1)]
    field = toxicity.train(docs, spark.createDataFrame(both, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    assert all(got[i].predicted == i % 2 and got[i]["_row"] == 3 for i in range(80))
    assert toxicity.tag(docs.limit(0), field).count() == 0
    assert toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_spans_are_runs():
    p = np.array([0.1, 0.9, 0.6, 0.2, 0.7])
    assert toxicity._spans("a bb cc d ee", p) == [{"begin": 2, "end": 7, "marginal": 0.9}, {"begin": 10, "end": 12, "marginal": 0.7}]


LONG = "A sentence of the story, which goes on for a while, as stories do, and then it ends. " * 4


@pytest.mark.parametrize(
    ("page", "less", "want"),
    [
        # a short line between paragraphs of an unmarked page, a long line among short ones beside an article
        (f"<body><p>{LONG}<p>{LONG}<p>So it<p>{LONG}<p>{LONG}</body>", 1.0, [True] * 5),
        (f"<body><article><p>{LONG}</p></article><div><p>One<p>Two<p>{LONG * 2}<p>Three<p>Four</div></body>", 0.0, [True] + [False] * 5),
    ],
)
def test_neighbours_outvote_a_block(page, less, want):
    costs = [x - less for x in mincut.FIXED_COSTS]
    parsed = htmlblocks.parse(page)
    scores = mincut.block_scores(parsed, costs)
    labels = mincut.minimum_cut(scores + [0.0] * len(parsed.boxes), mincut.edges(parsed))[: len(scores)]
    assert labels == want and sum((s > 0) != x for s, x in zip(scores, labels, strict=True)) == 1


def test_whole_pages_against_all_labellings():
    r = random.Random(8)
    for _ in range(40):
        parts = [r.choice(["<div>", "</div>", "<article>", "</article>", "<p>"]) + r.choice(["word ", "Some words here. ", LONG]) for _ in range(6)]
        costs = [x + r.uniform(-2, 2) for x in mincut.FIXED_COSTS]
        page = htmlblocks.parse("<body>" + "".join(parts))
        bias, links = mincut.block_scores(page, costs) + [0.0] * len(page.boxes), mincut.edges(page)
        n, size = len(bias), len(page.blocks)
        cost = lambda k: sum(abs(b) for i, b in enumerate(bias) if (b > 0) != bool(k >> i & 1)) + sum(w for a, b, w in links if (k >> a & 1) != (k >> b & 1))  # noqa: B023, E731
        every = [(cost(k), k) for k in range(2**n)]
        least = min(c for c, _ in every)
        texts = {"\n".join(b.text for i, b in enumerate(page.blocks) if k >> i & 1) for c, k in every if c < least + 1e-9}
        assert size and mincut.main_text("<body>" + "".join(parts), costs) in texts


def test_costs_are_fitted():
    assert mincut.fit_costs({}) == mincut.FIXED_COSTS == mincut.fit_costs({(3, True): 9})
    line, prose = (htmlblocks.parse(f"<p>{x}</p>").blocks[0] for x in ("Short words of a story.", LONG))
    short, long = mincut.cues(line), mincut.cues(prose)
    counts = {(short, True): 900, (short, False): 100, (long, False): 700, (long, True): 100}
    costs = mincut.fit_costs(counts)
    assert costs[short] > 1 > mincut.FIXED_COSTS[short] and costs[long] < -1 < mincut.FIXED_COSTS[long]
    assert max(map(abs, costs)) <= mincut.MOST
    # with many blocks the penalty is nothing, and two cells have the odds of their weighted counts
    many = mincut.fit_costs({k: 10000 * v for k, v in counts.items()})
    assert many[short] == pytest.approx(math.log(900 * 800 / (100 * 1000)), abs=0.01)
    assert many[long] == pytest.approx(math.log(100 * 800 / (700 * 1000)), abs=0.01)


def test_costs_of_a_table(spark):
    page = f"<body><nav><p>{LONG}</p></nav><article><p>Short words of it</p></article></body>"
    pages = spark.createDataFrame([(page,), (page,), (None,), ("",)], "html string")
    want = mincut.labelled_cells(htmlblocks.parse(page))
    assert mincut.learn_costs(pages) == mincut.fit_costs({c: 2 for c in want}) != mincut.FIXED_COSTS
    assert mincut.learn_costs(pages.limit(0)) == mincut.FIXED_COSTS


def test_long_pages_take_bounded_time():
    import time

    r = random.Random(1)
    bias = [r.uniform(-2, 2) for _ in range(20000)]
    begun = time.time()
    mincut.minimum_cut(bias, [(i, i + 1, 1.0) for i in range(19999)] + [(i, i // 5, 0.5) for i in range(1, 20000)])
    assert time.time() - begun < 60
