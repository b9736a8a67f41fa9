"""HTML extraction, pseudonyms, toxicity, WARC and nearest neighbours."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from kapspark.llm import ann, html_extract, pii, toxicity, warc
from kapspark.llm.shared import new_path

ARTICLE = "<article><h1>A title</h1><p>First,  with a\n comma &amp; an <b>inline</b> tag.</p><p>Ok.</p><p>Second paragraph, rather longer than the first one.</p></article>"
WANT = "A title\nFirst, with a comma & an inline tag.\nOk.\nSecond paragraph, rather longer than the first one."
LONG = "This advert is a good deal longer, louder, and richer in commas, than the article itself, and so on, and on."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>&copy; us, all rights, reserved</footer>",
        f"<div class='ad'>{LONG}</div>{{}}",
        f"<aside><p>{LONG}</p><p>{LONG}</p></aside>{{}}",
        f"<div id='cookie-notice'><p>{LONG}</p></div>{{}}<script>var a='</p>';</script>",
        f"{{}}<section class='comments'><h2>Comments</h2><article class='comment'><p>{LONG}</p><p>{LONG}</p></article></section>",
        f"<header><p>{LONG}</p></header><form><label>{LONG}</label><input></form>{{}}",
        f"<!-- <p>{LONG}</p> --><style>p{{{{}}}}</style>{{}}<div hidden>{LONG}</div><p style='display: none'>{LONG}</p>",
        f"<div class='layout with-sidebar'><div class='sidebar'><p>{LONG}</p></div>{{}}</div>",
        f"<div class='content'>{{}}<div id='comments'><article><p>{LONG}</p><p>{LONG}</p></article></div></div>",
        f"<main class='has-sidebar'><div class='notice-box'>{LONG}</div>{{}}<div class='shareButtons'><a href=x>Share, share</a></div></main>",
        "<div><ul>" + "<li><a href='#'>Some related story, with a comma</a></li>" * 12 + "</ul></div>{}",
    ],
)
def test_the_article_without_its_surroundings(around):
    page = f"<!DOCTYPE html><html><head><title>T, t</title></head><body>{around.format(ARTICLE)}</body></html>"
    assert html_extract.main_text(page) == WANT


def test_containers_without_semantic_elements():
    text = ["A paragraph of some length, with commas, and words that go on for a while."] * 6
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><div class=menu><a href=x>one</a></div><div><div>{body}</div></div><div><a href=y>more</a> <a href=z>links</a></div></body>"
    assert html_extract.main_text(page) == "\n".join(text)
    split = f"<body><div class='sidebar'><p>{LONG}</p></div><div>{body}</div><div>{body}</div></body>"
    assert html_extract.main_text(split) == "\n".join(text * 2)


def test_a_self_closed_icon_hides_nothing():
    for icon in ('<svg class="icon"/>', "<math/>", "<svg><path d='M0'/></svg>"):
        page = f"<body>{ARTICLE.replace('<h1>', '<h1>' + icon)}</body>"
        assert html_extract.main_text(page) == WANT


def test_broken_and_empty_pages():
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == ""
    assert html_extract.main_text("no markup &lt;here&gt;") == "no markup <here>"
    assert html_extract.main_text("<p><b>open<br>tags<p>go on</p") == "open tags\ngo on"
    assert html_extract.main_text("<article><p>one<p>two &amp three</article") == "one\ntwo & three"
    assert html_extract.main_text("<p>cut <img src='a") == "cut"
    assert html_extract.main_text("a < b and <3") == "a < b and <3"
    deep = "<div>" * 20_000 + "<p>deep text</p>"
    assert html_extract.main_text(deep) == "deep text"
    assert html_extract.main_text("<article><p>" + "word, " * 200_000 + "</p></article>") == ("word, " * 200_000).strip()


SENTENCE = "The council met on Monday, heard the mayor, and voted on the new bridge after a long debate. "


@pytest.mark.parametrize(
    "piece",
    [
        '<p class="more">{}</p>',
        '<p class="print">{}</p>',
        '<h2 id="legal">{}</h2>',
        '<section class="discussion"><p>{}</p></section>',
        '<div class="post-header"><p>{}</p></div>',
        '<div class="text side"><p>{}</p></div>',
        '<p class="hidden-gem">{}</p>',
        '<div class="social"><p>{0}</p><p>{0}</p><p>{0}</p></div>',  # the larger part of the article's text
    ],
)
def test_names_do_not_cost_an_article_its_text(piece):
    page = f"<body><article><p>{SENTENCE}</p>{piece.format(SENTENCE)}</article></body>"
    assert html_extract.main_text(page) == "\n".join([SENTENCE.strip()] * (1 + piece.format(SENTENCE).count("council")))


@pytest.mark.parametrize(
    "box",
    [
        '<div class="ad">Buy now!</div>',
        '<div class="share-bar"><a href="#">Post</a> <a href="#">Mail</a></div>',
        '<ul class="nav"><li>Home</li><li>About</li></ul>',
        '<section id="comments"><p>First!</p><p>' + SENTENCE * 5 + "</p></section>",
        '<p class="cookie-notice">We use cookies.</p>',
        '<div class="newsletter-signup"><p>Get our letter.</p></div>',
        "<form><p>Name</p></form>",
        "<aside>Beside</aside>",
    ],
)
def test_boxes_inside_an_article_go(box):
    page = f"<body><article><p>{SENTENCE}</p>{box}<p>{SENTENCE}</p></article></body>"
    assert html_extract.main_text(page) == "\n".join([SENTENCE.strip()] * 2)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "</span>" * 100_000 + "text",
        "<div>" * 100_000 + "<li>x</li>" * 50_000,
        "<ul><li><ul>" + "<div>" * 100_000 + "<li>x</li>" * 50_000,
        "<b>" * 100_000 + "<p>x</p>" * 50_000,
        "<table><tr><td>" + "<i>" * 100_000 + "<tr><td>x" * 20_000,
    ],
)
def test_deep_and_unclosed_markup_takes_linear_time(page):
    """Time for twice the elements is about twice the time (the limit leaves room for a busy machine)."""
    began = time.process_time()
    html_extract.main_text(page[: len(page) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 10 * quarter + 2


class PlainArticle(HTMLParser):
    """Text of the page's article by the standard library's parser, block by block."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "blockquote", "article", "div", "section", "pre", "table", "tr", "td"}
    AWAY = {"script", "style", "nav", "aside", "footer", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.away, self.blocks, self.run = 0, 0, [], []

    def close_run(self):
        text = " ".join("".join(self.run).split())
        if text:
            self.blocks.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.away += tag in self.AWAY
        if tag in self.BLOCKS:
            self.close_run()
        if tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.close_run()
        self.inside -= tag == "article"
        self.away -= tag in self.AWAY

    def handle_data(self, data):
        if self.inside and not self.away:
            self.run.append(data)


def test_given_pages_against_a_plain_parser(spark):
    """Every page that has one article: exactly its text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    checked = 0
    for (html,) in rows:
        if not html or html.count("<article") != 1 or 'class="comment' in html:
            continue
        plain = PlainArticle()
        plain.feed(html)
        plain.close()
        plain.close_run()
        assert html_extract.main_text(html) == "\n".join(plain.blocks)
        checked += 1
    assert checked > 50


def test_extraction_as_a_frame(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract(df, keep_cols=["page_id", "url"]).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "", 0)] + [(1, WANT, len(WANT))] * 2
    assert html_extract.extract(df.filter("page_id > 5")).collect() == []


KEY = b"test key"
PRIVATE = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234567", "(212) 555-0142"],
    "ip": ["97.51.17.173"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "01.02.2003"],
    "email": ["jane.doe.34@mail7.example.com", "éric.07@mail2.example.com"],
    "token": ['b44e15e09fd311c3cf3163b66d5a9875b883d8ce', "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
}


@pytest.mark.parametrize("kind", PRIVATE)
def test_values_are_replaced_within_their_format(kind):
    p = pii.Permutation(KEY)
    for value in PRIVATE[kind]:
        given = f'"{value}"' if kind == "token" else value
        text = f"before {given}, then {given}. after"
        new, found = pii.rewrite(text, p)
        assert found == {kind: 2} and value not in new, (value, new)
        parts = re.fullmatch(r"before (.*), then (.*)\. after", new)
        assert parts[1] == parts[2]
        if kind not in ("ip",):
            assert [c.isdigit() for c in parts[1] if kind not in ("token", "email")] == [c.isdigit() for c in given if kind not in ("token", "email")]
            assert len(parts[1]) == len(given)
        again, _ = pii.rewrite(new, p, back=True)
        assert again == text
        assert pii.rewrite(text, pii.Permutation(b"another key"))[0] != new


def test_checks_hold_before_and_after():
    p = pii.Permutation(KEY)
    for text in ("4111 1111 1111 1112", "DE89370400440532013001", "000-12-3456", "256.1.1.1", "2023-02-30", "version 4.0 of 2024", "+12", "1234567890123456"):
        assert pii.rewrite(text, p) == (text, {}), text
    card, _ = pii.rewrite("4111111111111111", p)
    assert pii.luhn_digit(card[:-1]) == int(card[-1])
    iban, _ = pii.rewrite("DE89370400440532013000", p)
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4]


def test_a_value_inside_a_failed_candidate():
    p = pii.Permutation(b"k")
    rnd = random.Random(3)
    for k in range(300):
        lead = " ".join(str(rnd.randrange(1, 100)) for _ in range(1 + k % 4)) if k else "2"
        text = f"Qty {lead} 4111 1111 1111 1111"
        new, found = pii.rewrite(text, p)
        assert sum(found.values()) >= 1
        assert pii.rewrite(new, p, back=True)[0] == text
        if k == 0:
            assert found == {"card": 1} and new.startswith("Qty 2 ") and not new.endswith(" 4111 1111 1111 1111")


def test_the_permutation_is_one_to_one():
    p = pii.Permutation(KEY)
    for size in (1, 2, 7, 100, 1000):
        image = [p("kind", size, v) for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [p("kind", size, v, True) for v in image] == list(range(size))
    dates = [pii._date(p, f"2020-01-{d:02d}", False) for d in range(1, 32)]
    assert len(set(dates)) == 31


def test_pseudonyms_as_a_frame(docs_of):
    rows = [(1, "card 4111111111111111"), (2, "CARD 4111111111111111!"), (3, None), (4, ""), (None, "clean text, 12 words"), (1, "card 4111111111111111")]
    out = pii.pseudonymise(docs_of(rows, extra=True), KEY).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by_id[3]["text"] is None and by_id[4]["text"] == "" and by_id[None]["text"] == "clean text, 12 words"
    assert by_id[1]["text"][5:] == by_id[2]["text"][5:-1] != "4111111111111111" and by_id[1]["n_card"] == 1
    assert pii.pseudonymise(docs_of(rows).filter("doc_id > 9"), KEY).collect() == []


@pytest.mark.parametrize("run", ["x" * 300_000 + " 7", "a.b" * 100_000 + " 7", "1" * 200_000, "a@" + "a" * 200_000, "1 " * 100_000, "@" * 100_000])
def test_long_texts_take_linear_time(run):
    import time

    began = time.time()
    pii.rewrite(run, pii.Permutation(KEY))
    assert time.time() - began < 10


def brute_keys(text, history):
    out = []
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode()):
        padded = b" " + word
        for i in range(1, len(padded)):
            out.append(int.from_bytes(padded[max(0, i - history) : i + 1], "big"))
    return out


def test_gram_keys_against_brute_force():
    texts = ["Ab c", "", "é-zu lang!", "  x", "9lives" * 5]
    keys, contexts, heads, per_text = toxicity.gram_keys(texts, 5)
    assert keys.tolist() == [k for t in texts for k in brute_keys(t, 5)]
    assert (contexts == keys >> 8).all()
    assert per_text.tolist() == [len(brute_keys(t, 5)) for t in texts]
    assert heads.sum() == sum(len(re.findall(r"\w+", t)) for t in texts)


def test_probabilities_of_a_context_sum_to_one(spark):
    rnd = random.Random(1)
    rows = []
    for label in (0, 1):
        for _ in range(60):
            rows += [(k, label, 1) for k in brute_keys("".join(rnd.choice("abc") for _ in range(4)), 3)]
    grams = spark.createDataFrame(rows, "key long, toxic int, n int").groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"),
    )
    shared = toxicity.shared_backoff(grams, 3).collect()
    totals = {}
    for r in shared:
        totals.setdefault(r["key"] >> 8, []).append(r["shared"])
    # what is missing to one is the discounted mass of bytes not seen there
    assert all(0.3 < sum(v) <= 1 + 1e-9 for v in totals.values())


def plain_ratio(words, history, discount=toxicity.DISCOUNT):
    """Log-likelihood ratio of a gram (history, byte) from the words (text, label), by the textbook:
    absolute discounting per class, backing off to continuation counts of both classes together."""
    counts = [defaultdict(int), defaultdict(int)]
    for word, label in words:
        seen = b" "
        for byte in word.encode():
            counts[label][seen[-history:], byte] += 1
            seen += bytes([byte])
    both = set(counts[0]) | set(counts[1])

    def continuations(length):
        """For grams with `length` bytes of history: how many grams precede them by one more byte (or begin a word)."""
        if length == history:
            return {g: 1 for g in both if len(g[0]) == history}
        found = defaultdict(int)
        for h, byte in continuations(length + 1):
            found[h[1:], byte] += 1
        for h, byte in both:
            if len(h) == length:
                found[h, byte] += 1
        return found

    levels = [continuations(m) for m in range(history)]

    def shared(h, byte):
        if (h, byte) not in levels[len(h)]:
            return 1 / 256
        own = {g: c for g, c in levels[len(h)].items() if g[0] == h}
        lower = shared(h[1:], byte) if h else 1 / 256
        return (max(own[h, byte] - discount, 0) + discount * len(own) * lower) / sum(own.values())

    def probability(label, h, byte):
        own = {g: c for g, c in counts[label].items() if g[0] == h}
        lower = shared(h[1:], byte)
        if not own:
            return lower
        return (max(own.get((h, byte), 0) - discount, 0) + discount * len(own) * lower) / sum(own.values())

    return {g: np.log(probability(1, *g)) - np.log(probability(0, *g)) for g in both}


@pytest.mark.parametrize("history", [2, 3, 5])
def test_ratios_against_plain_kneser_ney(spark, history):
    rnd = random.Random(history)
    words = [("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 8))), int(rnd.random() < 0.4)) for _ in range(150)]
    rows = [(int(k), y, 1) for w, y in words for k in toxicity.gram_keys([w], history)[0]]
    grams = spark.createDataFrame(rows, "key long, toxic int, n int").groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"),
    )
    seen, _ = toxicity.log_ratios(grams, history)
    got = {r["key"]: r["ratio"] for r in seen.collect()}
    want = plain_ratio(words, history)
    assert len(got) == len(want)
    for (h, byte), ratio in want.items():
        assert got[int.from_bytes(h + bytes([byte]), "big")] == pytest.approx(ratio, abs=1e-12)


def toxic_rows(n=400):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["ba", "ko", "mi", "re", "tu"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 30):
                words[rnd.randrange(len(words))] = "vexor" + rnd.choice(["ba", "ko", "mi"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark, docs_of):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1002, "vexorre " * 50_000), (None, "ba ko"), (3, rows[3][1])]
    frame = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs_of(rows, extra=True), frame).collect()
    assert len(out) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 60 and right >= 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1002]["predicted"] == 1 and by_id[1000]["score"] == by_id[1001]["score"]


def test_scores_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs_of([(1, "a b c"), (2, None)]), none).collect()
    assert [(r["score"], r["predicted"]) for r in out] == [(0.0, 0)] * 2
    assert toxicity.score(docs_of([(1, "a")]).filter("doc_id > 1"), none).collect() == []


def plain_scores(spark, rows, labels, chosen=None):
    """Scores by id from a dictionary of all ratios, without blocks or tables."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    truth = {i: t for i, _, t in labels}

    def evidence(fit_rows, folds):
        """Evidence by id from the counts of the rows of some folds, `fit_rows` left out."""
        counts = defaultdict(lambda: [0, 0])
        for i, text in rows:
            for k in brute_keys(text, 5) if fold(i) in folds and i not in fit_rows else ():
                counts[k][truth[i]] += 1
        grams = spark.createDataFrame([(k, *c) for k, c in counts.items()], "key long, c0 long, c1 long")
        seen, unseen = (dict(part.select("key", "ratio").collect()) for part in toxicity.log_ratios(grams, 5))
        x = {}
        for i, text in rows:
            words = [sum(seen.get(k, unseen.get(k >> 8, 0.0)) for k in brute_keys(w, 5)) for w in re.findall(r"\w+", text)]
            size = min(24, len(words))
            runs = [sum(words[a : a + size]) / size for a in range(len(words) - size + 1)]
            x[i] = [sum(words) / len(words), max(runs), max(words), np.log1p(len(words))]
        return x

    fit = chosen if chosen is not None else [i for i, _ in rows if fold(i) == 3]
    x = evidence(fit, {0, 1, 3})
    weights, bias = toxicity.fit_logistic(np.array([x[i] for i in fit]), np.array([float(truth[i]) for i in fit]))
    return {i: 1 / (1 + np.exp(-(np.array(f) @ weights + bias))) for i, f in evidence([], {0, 1, 3}).items()}


def test_every_gram_counts_in_the_scores(spark, docs_of):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(120):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(5, 90))]
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = "vexor" + rnd.choice("abc")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = (
        frame.filter(toxicity.fold() == 3).orderBy(F.xxhash64("doc_id")).limit(20).select("doc_id").collect()
    )
    for limit, chosen in ((toxicity.FIT_ROWS, None), (20, [r["doc_id"] for r in first])):
        want = plain_scores(spark, rows, labels, chosen)
        out = toxicity.score(docs_of(rows), frame, fit_rows=limit).collect()
        assert len(out) == len(rows)
        assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in out)


def test_other_training_documents(spark, docs_of):
    """The labels of `training` are learnt, and any other texts are scored."""
    rows, labels = toxic_rows()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    own = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(rows), frame).collect()}
    new = [(1_000 + i, text) for i, text in rows[:60]] + [(None, None)]
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(new), frame, training=docs_of(rows)).collect()}
    assert len(out) == 61 and all(abs(out[1_000 + i] - own[i]) < 1e-9 for i, _ in rows[:60])


def test_words_return_to_their_blocks(spark, docs_of):
    texts = ["ba ko, ba", None, "", "İx ΑΣ é" + "z" * 300, "Ko ba ko " * 40, "--", "tu"] * 30
    docs = docs_of(list(enumerate(texts))).repartition(3)
    keys = {k for t in texts for k in brute_keys((t or "").lower(), 5)}
    seen = {k: (k * 7919 % 1009 - 500) / 128 for k in keys if k % 3}
    unseen = {k >> 8: (k % 11 - 5) / 16 for k in keys if k % 2}
    ratios = tuple(spark.createDataFrame(list(part.items()), "key long, ratio double") for part in (seen, unseen))
    for block_chars in (1, 500, 10**6):
        out = toxicity.features(docs, ["doc_id"], "text", ratios, 5, 3, block_chars).collect()
        assert len(out) == len(texts)
        for r in out:
            text = (texts[r["doc_id"]] or "").lower()
            words = [b.decode() for b in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
            own = [sum(seen.get(k, unseen.get(k >> 8, 0.0)) for k in brute_keys(w, 5)) for w in words]
            size = max(1, min(3, len(own)))
            runs = [sum(own[a : a + size]) / size for a in range(len(own) - size + 1)]
            want = [sum(own) / len(own), max(runs), max(own), np.log1p(len(own))] if own else [0.0] * 4
            assert np.allclose([r["__mean"], r["__window"], r["__word"], r["__length"]], want, atol=1e-7)


def test_the_table_decides_no_score(spark, docs_of):
    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += ["a" * 5000, "ab " * 3000, "zz qq"]
    docs = docs_of(list(enumerate(texts))).repartition(2)
    keys = sorted({k for t in texts for k in brute_keys(t, 5)})
    seen = spark.createDataFrame([(k, (k * 7919 % 1009 - 500) / 128) for k in keys if k % 4], "key long, ratio double")
    times = defaultdict(int)
    for t in texts:
        for k in brute_keys(t, 5):
            times[k >> 8] += 1
    rest = [(h, (h % 11 - 5) / 16, n) for h, n in times.items() if h % 5]
    contexts = toxicity.context_ratios(seen, spark.createDataFrame(rest, "key long, ratio double, n long")).cache()
    tables = {limit: toxicity.ratio_table(contexts, limit) for limit in (0, 40, len(keys) // 2, 1 << 21)}
    sizes = [len(t.keys) + len(t.contexts) for t in tables.values()]
    assert sizes[0] == 0 and all(size <= limit for size, limit in zip(sizes, tables))
    assert sizes == sorted(set(sizes)) and [t.complete for t in tables.values()] == [False] * 3 + [True]
    results = [
        sorted(map(tuple, toxicity.features_by(docs, ["doc_id"], "text", contexts, 5, 3, 700, limit).collect()))
        for limit in tables
    ]
    assert len(results[0]) == len(texts) and all(r == results[0] for r in results)


PAGES = [
    (5, "http://a/1", "x" * 150), (3, "http://a/2\r\nX: y", "x" * 150), (9, None, "x" * 150), (1, "http://b", "short"), (2, "http://b", "short"),
    (4, "http://c", None), (6, "http://c", ""), (7, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 20), (3, "http://a/2", "x" * 150),
    (8, "http://e", "large " * 400_000), (None, "http://f", "no id"),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "w") for p in PAGES], "page_id long, url string, html string, warc_type string").repartition(3)
    out = warc.round_trip(df).collect()
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = min((j for j, _, g in PAGES if j is not None and (g or "") == (h or "")), default=None) if len(data) >= 100 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert warc.round_trip(df.filter("page_id > 99")).collect() == []


def test_filters_are_pushed_into_the_archive(spark):
    path = new_path(spark, "warc-test")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(warc.page_records(df), path)
    read = warc.read_archive(spark, path)
    assert read.filter("warc_type = 'revisit'").count() == 2
    one = read.filter("target_uri = 'http://d' AND warc_type IN ('response')")
    assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString()
    assert [bytes(r["payload"]).decode() for r in one.collect()] == [PAGES[7][2]]
    assert read.filter("target_uri LIKE 'http://b%'").count() == 2
    assert read.filter("warc_type = 'warcinfo'").count() >= 1
    heads = warc.read_archive(spark, path, payload=False).filter("warc_type = 'response'").collect()
    assert all(r["payload"] is None for r in heads) and len(heads) == 9


def test_other_archives_and_cut_files(spark, tmp_path):
    record = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x:1>"), ("Content-Type", "text/plain")], b"body\r\n")
    (tmp_path / "plain.warc").write_bytes(record * 3)
    import gzip

    (tmp_path / "foreign.warc.gz").write_bytes(gzip.compress(record) * 2)
    rows = warc.read_archive(spark, str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in rows] == [b"body\r\n"] * 5 and rows[0]["headers"]["WARC-Type"] == "resource"
    assert warc.read_archive(spark, str(tmp_path)).filter("warc_type = 'response'").count() == 0
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(record[:-8])
    with pytest.raises(Exception, match="ends too early"):
        warc.read_archive(spark, str(cut)).collect()


def vectors(n=900, d=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, d))
    x[100] = x[200] = x[300] = x[700]
    return x


def exact(x, ids, q, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u[q]
    order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]]
    return [(int(ids[i]), s[i]) for i in order[:k]]


def test_neighbours_recall_and_order(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [1.0, None] * 8, 0), (2150, [float("nan")] * 16, 0), (2200, [1.0], 0), (2250, [float("inf")] * 16, 0)]
    rows += [(7, rows[7][1], 0), (None, rows[8][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = ann.nearest(df, F.col("id") % 50 == 0, row_block=100, query_block=5, fit_rows=300).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    ids = np.arange(len(x))
    assert sorted(found) == list(range(0, 900, 50))
    hits = 0
    for q, got in found.items():
        assert [g[2] for g in got] == [1, 2, 3, 4, 5]
        want = exact(x, ids, q)
        hits += len({i for i, _ in want} & {g[0] for g in got})
        for i, s, _ in got:
            assert s == pytest.approx(float(x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])), abs=1e-12)
    assert hits >= 0.9 * 5 * len(found)
    assert [g[0] for g in found[100]][:3] == [200, 300, 700]


def test_few_candidates_and_none(spark):
    ddl = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], ddl)
    out = ann.nearest(few, F.col("id") == 0).collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, -1.0)]
    assert ann.nearest(few.filter("vec_id < 0"), F.col("id") == 0).collect() == []
    assert ann.nearest(few.filter("vec_id = 0"), F.col("id") == 0).collect() == []


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    index = rng.integers(0, 256, (8, 2000), dtype=np.uint8)
    for radius in (0, 5, 12, 20, 30):
        for q in index.T[:20]:
            got = ann.probe(index, q, radius)
            want = np.flatnonzero(np.bitwise_count(index.T ^ q).sum(axis=1) <= radius)
            assert got.tolist() == want.tolist()
