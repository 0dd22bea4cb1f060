import html
import re
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import html_text, license_scan, toxicity

PAGES = {
    "<body><div class='cookie-notice'>We use cookies on this site to do things.</div><div class='with-sidebar'><div class='post'><h1>Title &amp; more</h1>"
    "<p>First  para\n with <i>inline</i>text &lt;x&gt;.<p>Second paragraph is quite a long one, with words.<ul><li>a<li>b</ul></div>"
    "<div class='sidebar'>Other stories you may like</div></div><div class='comments'><article>me too, I like that very much</article></div><footer>c</footer>": "Title & more First para with inlinetext <x>. Second paragraph is quite a long one, with words. a b",
    "<main><header><h1>T</h1></header><p>x</p><section class='comments'><p>foo bar baz long long long comment</p></section><form>Sub <input></form></main>": "T x",
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article><p>Short.</p><p>A longer paragraph.<br>More.</p><div class='ad'>Buy now</div>"
    "<aside>x</aside><script>var a='</p>';</script><!-- no --></article></body></html>": "Short. A longer paragraph. More.",
    "plain text only": "plain text only",
    "<p>a<p>b": "a b",
    "<p hidden>a</p>": "",
    "<br><hr>": "",
    "": "",
    "<": "<",
}


@pytest.mark.parametrize("page", list(PAGES) + [None])
def test_main_text(page):
    assert html_text.main_text(page) == PAGES.get(page, "")


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():  # these pages hold one article element of plain blocks
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(b) for b in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))]
        assert got[r.page_id].text == " ".join(" ".join(b.split()) for b in blocks if b.strip())
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_text.extract(df).collect())) == Counter([(1, None, "", 0), (1, "u", "", 0), (None, "u", "a", 1)])
    assert html_text.extract(df.limit(0)).collect() == []


def test_smoothing_keeps_the_sum_inside():
    x = np.zeros(20)
    x[10] = 1
    assert html_text.smoothed(x).sum() == pytest.approx(1) and len(html_text.smoothed(np.ones(3))) == 3


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(df).collect()}


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, phrase in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", " .,; ", "MIT License", "mit\nlicense! MIT-LICENSE mit license", "mitt license", "the Apache License, Version 2.0.", "general public", "public license of the general public license",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "é mit licenseé mit license é",
    "License MIT general. Apache-license general public license mit license", "license " * 500 + "mit license",
]


def test_base_phrases(spark):
    got = scanned(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in (9, 10, 11, 12, 1, 7)] == ["gpl", "mit", "cc-by-nc", "reserved", "", ""]


def test_documents(spark, documents):
    got = {r.doc_id: r for r in license_scan.scan(documents).collect()}
    for r in documents.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain_scan(r.text)


def test_odd_licences(odd):
    got = license_scan.scan(odd)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in odd.collect())
    assert license_scan.scan(odd.limit(0)).collect() == []


def features(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(toxicity.text_features(raw, np.array([0, len(raw)]))[1])


def made_texts(n, seed, share):
    rng = np.random.default_rng(seed)
    words = [f"{chr(97 + a)}{chr(97 + b)}word{a}{b}" for a in range(20) for b in range(20)]
    out = []
    for _ in range(n):
        w = list(rng.choice(words, 40))
        toxic = rng.random() < share
        if toxic:
            w[3], w[9] = rng.choice(["scumbag", "moronic", "filthy"], 2)
        out.append((" ".join(w), toxic))
    return out


def test_training_from_positive_and_unlabelled():
    train = made_texts(1500, 0, 0.2)
    toxic = [features(t) for t, y in train if y][:150]
    model = toxicity.train(toxic, [features(t) for t, _ in train], 0.2)
    test = made_texts(400, 1, 0.2)
    raw = [t.encode() for t, _ in test]
    z = model.logits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([y for _, y in test])
    assert (z[y] >= 0).mean() > 0.95 and (z[~y] >= 0).mean() < 0.02
    one = model.logits(np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])]))
    assert one[0] == pytest.approx(z[0])  # a score doesn't depend on the batch


def test_no_positives_score_the_prior(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd.drop("score"), model).collect()
    assert len(got) == odd.count() and {round(r.score, 6) for r in got} == {round(model.prior, 6)}
    assert toxicity.score(odd.drop("score").limit(0), model).collect() == []


def test_clashing_names(spark, odd):
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    with pytest.raises(ValueError):
        toxicity.score(odd, toxicity.fit(odd, labels))


def test_held_out_documents(spark):
    rows = [(i, t, int(y)) for i, (t, y) in enumerate(made_texts(1200, 5, 0.15))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {r.doc_id for r in docs.where(toxicity.in_fold(docs["doc_id"])).collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    toxic = [scores[i] for i, _, y in rows if y and i in held]
    clean = [scores[i] for i, _, y in rows if not y and i in held]
    assert np.mean(np.array(toxic) >= 0.5) > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.03
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}


def test_labels_of_the_fold_are_not_read(spark):
    rows = made_texts(300, 9, 0.3)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    held = toxicity.in_fold(labels["doc_id"])
    flipped = labels.withColumn("toxic", toxicity.F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.features == b.features).all() and (a.weights == b.weights).all() and a.bias == b.bias
