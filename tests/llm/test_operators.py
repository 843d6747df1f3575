"""Brute-force comparisons, nulls, empty tables, ties, repeats and clashing names of the corpus operators."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import chat, html_extraction, language_id, nn_descent, packing, pieces, simhash, suffix_dedup, topk, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that bear the names of intermediate ones.
CLASH = ("row", "text_", "k1", "spans", "bits", "group", "component", "piece", "score", "ids")


def documents(spark, texts, clash=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH)) if clash else df


def words(rng, n, vocabulary=200):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 300)) for _ in range(25)]
    shared = words(rng, 120)
    odd = [None, "", " ", "é" * 900, "a" * 5000, "ab " * 700, shared + base[0], base[1] + " " + shared, base[2], base[2], base[3][:-7] + " changed", "\x00\x01 <|endoftext|> x", words(rng, 9000)]
    return base + odd


# --- suffix arrays -------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 1 << 12])
def test_remove_repeats(spark, texts, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # a small one splits names over blocks
    out = suffix_dedup.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    import hashlib

    found = [(len(r["kept"]) + sum(s["end"] - s["start"] for s in r["spans"]), sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out]
    assert found == brute.remove_repeats(texts)


def test_remove_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(documents(spark, ["x"]), length=20)


def test_repeated_rows_and_null_ids(spark):
    text = words(random.Random(1), 100)
    rows = spark.createDataFrame([(None, text), (None, text), (1, "short"), (1, "short")], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(rows).collect()
    assert sorted(len(r["kept"]) for r in out) == [0, 0, 5, 5]


@pytest.mark.parametrize("letters", [512, 1024])
def test_words_that_collide_in_polynomial_hashes(spark, letters):
    """Thue-Morse words and their twins have equal hashes modulo 2**64 for any odd base."""
    texts = ["".join(pair[i.bit_count() & 1] for i in range(letters)) for pair in ("EJ", "JE")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(len(t), len(t) - len(r["kept"]), len(r["spans"])) for t, r in zip(texts, out, strict=True)] == [e[:3] for e in brute.remove_repeats(texts)]


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    """Documents over many parts, runs over many pieces, and repeats across the cuts."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "LONGEST_RUN", 100)
    rng = random.Random(9)
    shared = words(rng, 150)
    texts = [words(rng, 900) + shared + words(rng, 300), shared + words(rng, 2000), "ab" * 4000, "x" * 3000 + shared, words(rng, 30) * 12]
    out = suffix_dedup.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(len(r["kept"]), len(r["spans"])) for r in out] == [(n - gone, spans) for n, gone, spans, _ in brute.remove_repeats(texts)]


def test_characters_that_a_cut_goes_through(spark):
    """Cuts through characters of two, three and four bytes; genuine replacement characters stay."""
    import random

    rng = random.Random(3)
    texts = []
    for k in range(12):
        shared = "".join(rng.choice("aé\u20ac\U0001f600\ufffd") for _ in range(400))
        # The bytes of a character before and after the shared part agree in part only.
        for before, after in rng.sample([("\u00e9", "\u00e8"), ("\ufffd", "\ufffd\ufffdx"), ("\U0001f600", "\U0001f601"), ("\u20ac", "\u20ad"), ("b\ufffd", "\ufffe")], 3):
            texts.append(f"{k}\ufffd start {before}{shared}{after} end \ufffd{k}")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame).collect()}
    cut = 0
    for i, text in enumerate(texts):
        raw, kept = text.encode(), []
        gone = {k for s in out[i]["spans"] for k in range(s["start"], s["end"])}
        at = 0
        for c in text:
            size = len(c.encode())
            if not gone.intersection(range(at, at + size)):
                kept.append(c)
            at += size
        cut += bool(gone)
        assert out[i]["whole"] == "".join(kept) and bytes(out[i]["kept"]) == bytes(b for k, b in enumerate(raw) if k not in gone)
    assert cut == len(texts)
    with pytest.raises(ValueError, match="columns of the result"):
        suffix_dedup.remove_repeats(frame.withColumn("kept", F.lit(1)), keep=("doc_id", "kept"))


def test_repeated_windows_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        pieces = [bytes(rng.choices(rng.choice([b"ab", b"abc", b"a", b"abcdefgh"]), k=rng.randrange(8, 40))) for _ in range(rng.randrange(1, 6))]
        pieces += rng.choices(pieces, k=rng.randrange(3))
        flagged, first = suffix_dedup.repeated_windows(pieces, 8)
        windows = [[p[i : i + 8] for i in range(len(p) - 7)] for p in pieces]
        every = [w for x in windows for w in x]
        at = 0
        for piece, own in zip(pieces, windows, strict=True):
            assert [bool(f) for f in flagged[at : at + len(own)]] == [every.count(w) > 1 for w in own]
            assert not flagged[at + len(own) : at + len(piece) + 1].any()
            at += len(piece) + 1
        assert first.sum() == len(set(every))


def test_suffix_order_is_a_suffix_array():
    rng = random.Random(2)
    for _ in range(300):
        text = np.frombuffer(bytes(rng.choices(rng.choice([b"a", b"ab", b"abc", b"abcdefgh"]), k=rng.randrange(1, 120))), np.uint8)
        order = suffix_dedup.suffix_order(text, np.full(len(text), len(text) + 1))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: bytes(text[i:]))


# --- SimHash -------------------------------------------------------------------------------


@pytest.mark.parametrize("many", [1 << 20, 0])
def test_simhash_against_brute_force(spark, texts, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)  # keys of two bytes, and of three
    rng = random.Random(5)
    near = [t.replace("a", "b", 1) for t in texts[:10]]
    base = words(rng, 400).split()
    chain = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 60)]
    every = texts + near + chain
    out = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, every)).collect()}
    prints = [brute.simhash(t) for t in every]
    assert [out[i]["bits"] % 2**64 for i in range(len(every))] == prints
    assert [out[i]["component_id"] for i in range(len(every))] == brute.simhash_classes(list(range(len(every))), prints)


def test_long_posting_lists_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(simhash, "SHORT", 4)
    rng = random.Random(8)
    prints = [0x0123456789ABCDEF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)] + [rng.getrandbits(64) for _ in range(40)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "bits long")
    links = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.fingerprint_links(df).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    expected = brute.simhash_classes(list(range(len(prints))), prints)
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(root(p), []).append(i)
    assert sorted(min(g) for g in groups.values()) == sorted(set(expected))


def test_one_of_each(spark):
    text = words(random.Random(1), 50)
    rows = spark.createDataFrame([(3, text), (None, text), (2, text), (2, text), (9, "other words here now"), (None, None)], "doc_id long, text string")
    kept = simhash.one_of_each(rows).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept) == [-1, 2, 9]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "most"), [(2, 7), (3, 6)])
def test_positions_hold_a_set(size, most):
    from itertools import combinations

    for distance in range(most - size + 2):
        sets = simhash.position_sets(distance, size)
        for kept in combinations(range(8), 8 - distance):
            assert any(set(s) <= set(kept) for s in sets)
    assert len(simhash.position_sets(4, 2)) == 7 and len(simhash.position_sets(4, 3)) == 20
    with pytest.raises(ValueError, match="equal bytes"):
        simhash.position_sets(7, size)


# --- packing -------------------------------------------------------------------------------


def test_pack(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts).drop("piece")).collect()
    sequences = brute.check_packing(rows, ids)
    assert sequences <= 1.2 * -(-sum(len(x) + 1 for x in ids.values()) // 2048) + 2
    assert packing.pack(documents(spark, ["x"]).limit(0)).count() == 0


def test_open_bins_are_bounded_and_best():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(n)[0] for n in (9, 5, 8, 5)] == [0, 1, 2, 1]  # the bin with one free closes first
    assert bins.open == 1


# --- languages and toxicity ------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(4)
    stems = {"en": ("the", "ing", "wh"), "de": ("sch", "ung", "ein"), "fr": ("eau", "que", "oi"), "es": ("ción", "os", "rr")}
    make = lambda lang: " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(stems) * 30)]
    train = spark.createDataFrame(rows + [(None, None, "en"), (1, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    asked = [make(lang) for lang in stems] + [None, "", "123 !?", "é"]
    out = language_id.predict(documents(spark, asked).drop("score"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out][:7] == [*stems, "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.fit(train.limit(0)) is None
    none = language_id.predict(documents(spark, ["text"]).drop("score"), None).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def test_features_do_not_depend_on_neighbours():
    texts = ["Guten Tag", "", "a b", "ééé"]
    together, _ = language_id.ngram_features(texts)
    alone = np.concatenate([language_id.ngram_features([t])[0] for t in texts])
    assert np.array_equal(together, alone)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        text = words(rng, 60).split()
        if i % 5 == 0:
            text[rng.randrange(60)] = "idiotx" + rng.choice("abcdef")
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + [(None, "x"), (401, None)], "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(401, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, None)
    asked = [words(rng, 50) for _ in range(20)] + [words(rng, 30) + " Idiotxz! " + words(rng, 30) for _ in range(20)] + [None, ""]
    out = toxicity.score(documents(spark, asked).drop("score"), model).orderBy("doc_id").collect()
    assert sum(r["predicted"] for r in out[:20]) <= 1 and sum(r["predicted"] for r in out[20:40]) >= 19
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.fit(docs, labels.limit(0), None) is None
    assert toxicity.score(documents(spark, ["x"]).drop("score"), None).first()["predicted"] == 0


# --- pages -----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a = "</p><p>no";</script></head><body class="main-page"><header><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies, all of them, for your own good and ours too.</div><div class="layout"><div class="sidebar"><ul><li><a>A long and linked title</a></ul></div>
<div class="content"><h1>Title&nbsp;of it</h1><p>First <b>bold</b>er text &amp; &eacute; with more words to see.<p>Second one, unclosed<div class="ad">Buy now</div><ul><li>item one of a list</li></ul>
<form>Subscribe<input></form><section id=comments><p>I think this article is wrong in so many ways, said the reader.</p></section></div></div><footer>&copy; us</footer></body></html>"""


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<article><p>cut off in the mid")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_extraction.extract(rows.withColumn("text", F.lit("clash"))).collect()}
    assert out[1]["text"] == "Title of it First bolder text & é with more words to see. Second one, unclosed item one of a list"
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[None]["text"] == "cut off in the mid"
    assert html_extraction.extract(rows.limit(0)).count() == 0


def prose(rng, n):
    return " ".join(rng.choice("stone river walks under light morning of the and carried over".split()) for _ in range(n)).capitalize() + "."


NAVIGATION = "<nav><ul><li><a href=/>Home</a><li><a href=/x>About us all</a></ul></nav>"
SIDEBAR = """<div class="sidebar"><div class="widget"><h3>Popular posts</h3><ul><li><a href=a>A long and linked title of something</a></li></ul></div>
<p>About the author of this site who writes a lot about many things.</p></div>"""
COOKIES = '<div id="cookie-notice"><p>We use cookies, all of them, for your own good and ours too, so that you can enjoy them.</p><button>OK</button></div>'
NEWS = "<form action=x><label>Subscribe to our newsletter and get all the news that you need every week.</label><input><button>Go</button></form>"
HEADER, FOOTER = "<header><h1>Site name</h1><p>Just another site with a tag line</p></header>", "<footer><p>&copy; 2020 Some site. All rights reserved.</p></footer>"


@pytest.fixture(scope="module")
def weights(spark):
    """Fitted on the pages of the smallest tables, all of one layout."""
    return html_extraction.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("opening", [
    '<div class="content overflow-hidden">', '<div class="post has-comments">', '<div class="content with-sidebar">', '<article aria-hidden="false">', '<div id="main-content" class="sidebar-right">',
    "<div>", '<form id="all"><div>', '<section class="page-header-fixed">', "<td>", '<div class="related-header wrapper">',
])
def test_names_of_wrappers_condemn_no_page(weights, opening):
    rng = random.Random(1)
    texts = [prose(rng, 60), prose(rng, 60)]
    page = f"<html><body>{opening}" + "".join(f"<p>{x}</p>" for x in texts)
    assert html_extraction.main_text(page) == html_extraction.main_text(page, weights) == " ".join(texts)


@pytest.mark.parametrize(("opening", "inner"), [
    ("<article class='post comments-open'>", ""), ("<main id='comment-policy'>", ""), ("<article>", "<div class='reply-to-critics'>"), ("<div class='comments-enabled'>", "<article>"), ("<main class='comments'>", ""),
    ("<div id=comments><main>", "<div class='post'>"), ("<article class='comment-of-the-week'>", ""), ("<section class='no-comment'>", ""), ("<div class='replies-off'>", "<div class='story'>"),
])
def test_no_article_is_lost_by_a_name(weights, opening, inner):
    rng = random.Random(4)
    texts = [prose(rng, 70), prose(rng, 60)]
    page = f"<html><body>{NAVIGATION}{opening}{inner}" + "".join(f"<p>{x}</p>" for x in texts)
    assert html_extraction.main_text(page) == html_extraction.main_text(page, weights) == " ".join(texts)


@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "leave-a-reply", "comments-area", "userComments"])
def test_comments_go_by_any_of_their_names(weights, name):
    rng = random.Random(5)
    text = prose(rng, 80)
    comments = f"<div class='{name}'><p>{prose(rng, 30)}</p><p>{prose(rng, 20)}</p></div>"
    for page in (f"<html><body><article><p>{text}</p></article>{comments}", f"<html><body><article><p>{text}</p>{comments}</article>"):
        assert html_extraction.main_text(page) == html_extraction.main_text(page, weights) == text


def test_words_are_evidence(spark):
    """Notices without a telling name go by their words, where marked pages have taught them."""
    rng = random.Random(6)
    notice = "We use cookies to improve your experience and measure visits, by going on you accept all of our cookies."
    shown = "Sponsored offer of the day, order today and save a lot on your next purchase with this coupon."
    taught = [f"<html><body><div class=x{k}><p>{rng.choice([notice, shown])}</p></div><main>" + "".join(f"<p>{prose(rng, rng.randrange(10, 40))}</p>" for _ in range(3)) + f"</main><div><p>{rng.choice([notice, shown])}</p></div>" for k in range(60)]
    weights = html_extraction.fit(spark.createDataFrame([(t,) for t in taught], "html string"))
    text = prose(rng, 60)
    page = html_extraction.read_page(f"<html><body><div class='ccpa'><p>{notice}</p></div><div><p>{text}</p></div><div class='adsbygoogle'><p>{shown}</p></div>")
    scores = html_extraction.content_scores(page, weights)
    assert scores[0] < scores[1] and scores[2] < scores[1] and scores[1] > 0
    assert all(a < b for a, b in zip((scores[0], scores[2]), (html_extraction.content_scores(page, html_extraction.PRIOR)[k] for k in (0, 2)), strict=True))


@pytest.mark.parametrize("start", [prose(random.Random(7), 70), "x" * 1100, prose(random.Random(7), 3000)])
def test_words_are_evidence_wherever_they_stand(spark, start):
    """Blocks that begin alike, with many words or a long one, are told apart by what comes later."""
    rng = random.Random(8)

    def notice():
        return "We use cookies to improve your experience and measure visits, by going on you accept all of our cookies. " * (1 + len(start.split()) // 50)

    def text():
        return " ".join(prose(rng, 19) for _ in range(1 + len(start.split()) // 50))

    taught = [f"<html><body><div><p>{start} {notice()}</p></div><main><p>{start} {text()}</p></main>" for _ in range(60)]
    weights = html_extraction.fit(spark.createDataFrame([(t,) for t in taught], "html string"))
    page = html_extraction.read_page(f"<html><body><div><p>{start} {notice()}</p></div><div><p>{start} {text()}</p></div>")
    assert html_extraction.labels(page, weights) == [False, True]


@pytest.mark.parametrize("opening", ['<div class="post">', "<article>", '<div id="main" role="main">', '<div class="c1">', "<table><tr><td>"])
@pytest.mark.parametrize("inside", [False, True])
def test_layouts(weights, opening, inside):
    """Menus, notices, sidebars, adverts, forms, comments and footers around the article or in it."""
    rng = random.Random(2)
    texts = [prose(rng, 60), prose(rng, 50)]
    comments = f'<div id="comments"><h3>2 comments</h3><div class="comment"><p>I think this is wrong in so many ways, said the reader.</p></div><div class="comment"><p>Agreed. {prose(rng, 40)}</p></div></div>'
    article = f"{opening}<h1>The title</h1><p>{texts[0]}</p><p>Short one.</p><ul><li>First item of a list in it</li><li>Second item</li></ul><blockquote>{texts[1]}</blockquote>"
    closing = opening.split()[0].replace("<", "</").rstrip(">") + ">"
    aside = '<aside><h4>Related</h4><p><a href=q>Another article to read next</a></p></aside><div class="ad">Buy now, it is cheap today.</div>'
    if inside:
        page = f"<html><body>{NAVIGATION}{article}{aside}{comments}{NEWS}{closing}{FOOTER}"
    else:
        page = f"<html><body>{HEADER}{NAVIGATION}{COOKIES}<div class=layout>{article}{closing}{SIDEBAR}</div>{comments}{NEWS}{FOOTER}"
    expected = f"The title {texts[0]} Short one. First item of a list in it Second item {texts[1]}"
    assert html_extraction.main_text(page) == html_extraction.main_text(page, weights) == expected


def test_cut_against_all_labellings(weights):
    """On small pages without marks, the extracted text is that of the cheapest of all labellings."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(60):
        parts = [rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", '<div class="ad">{}</div>', "<div><p>{}</p></div>", "<p><a href=x>{}</a></p>", "<h2>{}</h2>"]).format(prose(rng, rng.choice([1, 2, 3, 8, 30]))) for _ in range(rng.randrange(1, 9))]
        page = html_extraction.read_page("".join(parts))
        scores, edges = html_extraction.content_scores(page, weights), html_extraction.smoothness_edges(page.blocks)
        assert len(page.blocks) == len(parts)

        def cost(marks, scores=scores, edges=edges):
            return sum(-s if x else s for s, x in zip(scores, marks, strict=True)) + 2 * sum(c for a, b, c in edges if marks[a] != marks[b])

        cheapest = min(cost(x) for x in product([False, True], repeat=len(scores)))
        chosen = html_extraction.labels(page, weights)
        assert cost(chosen) == cheapest
        assert html_extraction.main_text("".join(parts), weights) == " ".join(b.text for b, x in zip(page.blocks, chosen, strict=True) if x)


def test_the_cut_mends_what_the_classifier_gets_wrong(spark):
    """With the prior weights, and marks of main parts left unread, the cut sets short blocks of articles right."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    before = after = 0
    for r in rows:
        page = html_extraction.read_page(r["html"].replace("article>", "section>"))
        truth = [b.part == "main" for b in html_extraction.read_page(r["html"]).blocks]
        scores = html_extraction.content_scores(page, html_extraction.PRIOR)
        before += sum((s > 0) != t for s, t in zip(scores, truth, strict=True))
        after += sum(x != t for x, t in zip(html_extraction.labels(page, html_extraction.PRIOR), truth, strict=True))
    assert after < before / 2


@pytest.mark.parametrize("part", ["<x ", '<a " > ', "<a '>", "<div>", "<div>x", "<a>x", "</script ", "<!--", "<!x", "<", "<li/>", "<p><b>", "<form><div class=ad>x", "</p>", "&", "b=c "])
@pytest.mark.parametrize("before", ["", "<script>", "<ul><b>", "<a ", "<p>"])
def test_hostile_pages_take_linear_time(part, before):
    import time

    began = time.process_time()
    html_extraction.main_text(before + part * 40_000)
    assert time.process_time() - began < 6


def test_minimum_cut_is_minimal():
    from itertools import product

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, j, rng.randrange(6)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(labels, scores=scores, edges=edges):
            own = sum(s if s > 0 and not x else -s if s < 0 and x else 0 for s, x in zip(scores, labels, strict=True))
            return own + sum(c for a, b, c in edges if labels[a] != labels[b])

        assert cost(html_extraction.minimum_cut(scores, edges)) == min(cost(x) for x in product([False, True], repeat=n))


# --- pieces ----------------------------------------------------------------------------------


def test_pieces_round_trip_and_match_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    odd = [*texts, "▁x", "  two  spaces ", "😀 ok", "x y" * 40]
    docs = documents(spark, odd).drop("ids")
    plain = pieces.encode(docs, dropout=0.0).orderBy("doc_id").collect()
    for r in plain:
        if "▁" not in (r["text"] or ""):
            assert r["ids"] == library.encode(r["text"] or "")
    one, again, other = (pieces.encode(docs.repartition(n), seed=s) for n, s in ((1, 1), (5, 1), (3, 2)))
    first = {r["doc_id"]: r["ids"] for r in one.collect()}
    assert first == {r["doc_id"]: r["ids"] for r in again.collect()}
    assert first != {r["doc_id"]: r["ids"] for r in other.collect()}
    back = pieces.decode(one, keep=("doc_id", "text")).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    odd = one.withColumnsRenamed({"doc_id": "_ids", "text": "ids_"})
    assert pieces.decode(odd, keep=("_ids", "ids_", "ids")).columns == ["_ids", "ids_", "ids", "decoded"]
    assert pieces.encode(docs.limit(0)).count() == 0


def test_pieces_against_a_plain_agenda(texts):
    model = pieces.Pieces(pieces.public_model())
    some = [t for t in texts if t and len(t) < 1200 and t.isascii() and t.isprintable()][:12] + ["  two  spaces ", "a"]
    keys = np.arange(100, 100 + len(some), dtype=np.int64)
    for dropout in (0.0, 0.1, 0.5):
        found = pieces.encode_texts(model, some, keys, 3, dropout)
        for text, key, ids in zip(some, keys.tolist(), found, strict=True):
            assert ids.tolist() == brute.merge_dropout(text, key, 3, dropout, model)


def test_heap_and_rounds_agree(texts, monkeypatch):
    model = pieces.Pieces(pieces.public_model())
    some = [t for t in texts if t][:12]
    keys = np.arange(len(some), dtype=np.int64)
    rounds = pieces.encode_texts(model, some, keys, 1, 0.2)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    heap = pieces.encode_texts(model, some, keys, 1, 0.2)
    assert all(a.tolist() == b.tolist() for a, b in zip(rounds, heap, strict=True))


def test_very_long_texts_in_parts(texts, monkeypatch):
    """Languages, toxicity filters and pieces of a text are the same, or nearly, in parts."""
    model = pieces.Pieces(pieces.public_model())
    rng = random.Random(11)
    long = "  ".join([*(t for t in texts if t), words(rng, 500), "x" * 3000, "é▁😀 " * 200]) * 2
    whole = pieces.encode_texts(model, [long], np.array([5]), 1, 0.2)[0]
    monkeypatch.setattr(pieces, "LONG_TEXT", 700)
    assert pieces.encode_texts(model, [long], np.array([5]), 1, 0.2)[0].tolist() == whole.tolist()
    features, letters = language_id.ngram_features([long, "", "12"])
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 5000)
    again, some = language_id.ngram_features([long, "", "12"])
    assert letters.tolist() == some.tolist() == [True, False, False] and np.abs(features - again).max() < 0.01
    net = toxicity.train([np.array([[1] * 6, [0] * 6, [0] * 6, [0] * 6], np.int32)] * 4, np.array([0, 1, 0, 1]), epochs=1)
    net.embedding += rng.random()
    net.embedding[:] = np.random.default_rng(1).normal(size=net.embedding.shape)
    net.embedding[0] = 0
    raw = np.frombuffer(long.encode(), np.uint8)
    table = net.table()
    once = net.pooled(*toxicity.word_ids(raw, np.array([0, len(raw)])), table)
    for size in (50, 777, 20_000):
        assert np.allclose(net.pooled_in_parts(raw, table, size), once, atol=1e-5)


def test_pieces_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2), (2, None, None, None)], "doc_id long, text string, _text string, _key int")
    out = pieces.encode(docs, keep=("doc_id", "_text", "_key")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["_text"], r["_key"], len(r["ids"]) > 0) for r in out] == [(1, "x", 2, True), (2, None, None, False)]


def test_language_with_many_copies_of_one_text(spark):
    """Copies count once, so that a language of few texts is learnt and predicted."""
    rng = random.Random(7)
    rows = [(words(rng, 40), "en") for _ in range(300)] + [("der schöne Baum über dem großen Fluß", "de")] * 3000 + [("die Straße zum Müller", "de"), (None, "de"), ("x", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=20)
    asked = spark.createDataFrame([(1, "der große Baum"), (2, words(rng, 30))], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(asked, model).orderBy("doc_id").collect()] == ["de", "en"]


# --- vectors ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rng, n=300, dims=8):
    x = rng.normal(size=(n, dims))
    x[: n // 3] = x[0] + rng.normal(scale=0.02, size=(n // 3, dims))
    x[n // 3 : n // 2] = x[n // 3]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [0.0] * dims, 0), (n + 2, [float("nan")] * dims, 0), (n + 3, [None] * dims, 0), (n + 4, [1.0, 2.0], 0), (n + 50, [float(v) for v in x[0]], 0)]
    return spark.createDataFrame(rows + odd, VECTORS)


def test_top_k_against_brute_force(spark):
    df = vectors(spark, np.random.default_rng(1))
    rows = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in df.collect() if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"])}
    expected = []
    for q in [i for i in rows if i % 50 == 0]:
        scored = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    out = topk.top_k(df.withColumn("dims", F.lit(1)), lambda c: c % 50 == 0).collect()
    assert sorted(map(tuple, out)) == sorted(expected)
    assert topk.top_k(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    """Equal rows are one query and many candidates; rows that share an id and differ are asked each for itself."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.4, 0.0]), (3, [0.4, 0.0]), (3, [0.4, 0.0]), (4, [0.1, 0.9]), (5, [0.0, 0.1]), (100, [0.0, 1.0]), (100, [0.0, 0.5])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)
    out = sorted(map(tuple, topk.top_k(df, lambda c: c % 50 == 0).collect()))
    v = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows]
    expected = []
    for i, q in {(i, tuple(x)): (i, x) for i, x in v if i % 50 == 0}.values():
        scored = sorted((-int(q @ x), j) for j, x in v if j != i)[:5]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert out == sorted(expected)


def test_blocks_are_sent_to_long_buckets_alone(spark, monkeypatch):
    """Where lengths differ widely, most pairs of a block and a bucket are ruled out before anything is sent."""
    monkeypatch.setattr(topk, "BUCKET", 20)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SAMPLE", 200)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 5)) * 10 ** rng.uniform(-1, 2, (800, 1))
    df = spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(x)], VECTORS)
    pairs, meet = [], topk.meet
    monkeypatch.setattr(topk, "meet", lambda buckets, blocks, number, k: pairs.append((buckets.count(), blocks.count(), blocks.select("dims", "block" if "block" in blocks.columns else "bucket").distinct().count())) or meet(buckets, blocks, number, k))
    out = topk.top_k(df, lambda c: c % 20 == 0)
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    expected = []
    for i in range(0, 800, 20):
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-int(v[i] @ v[j]), j) for j in range(800) if j != i)[:5])]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    buckets, sent, blocks = pairs[1]
    assert buckets >= 40 and blocks >= 10 and sent * 3 < buckets * blocks, pairs


def test_packed_rows_are_as_wide_as_they_must_be(spark):
    for top, width in ((2.0, 2), (1e4, 4), (1e9, 8)):
        rows = topk.quantized(spark.createDataFrame([(1, [top, -1.0, 0.5], 0), (2, [0.0, 0.25, -top], 0)], VECTORS), "embedding", "vec_id", 256)
        (row,) = topk.pack(rows.withColumn("bucket", F.lit(0).cast("long")), "bucket").collect()
        assert len(row["matrix"]) == 6 * width
        ids, matrix = topk.unpacked(row["ids"], row["matrix"], 3)
        assert dict(zip(ids.tolist(), matrix.tolist(), strict=True)) == {r["id"]: list(r["v"]) for r in rows.collect()}


def test_many_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)) * rng.choice([1, 5], (600, 1))
    df = spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(x)], VECTORS)
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    expected = []
    for i in range(0, 600, 20):
        scored = sorted((-int(v[i] @ v[j]), j) for j in range(600) if j != i)[:5]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k(df, lambda c: c % 20 == 0).collect())) == sorted(expected)


def test_pruning_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-200, 200, (500, 16)) * rng.integers(1, 4, (500, 1))
    matrix = matrix[np.argsort(-(matrix.astype(float) ** 2).sum(axis=1))]
    bucket = topk.Bucket(np.arange(500), matrix)
    for query in rng.integers(-200, 200, (40, 16)):
        scores = matrix @ query
        for threshold in (int(np.sort(scores)[-5]), int(scores.max()), int(scores.max()) + 1):
            assert set(np.flatnonzero(scores >= threshold)) <= set(bucket.candidates(query, threshold).tolist())


def test_nn_descent_against_brute_force(spark):
    df = vectors(spark, np.random.default_rng(3))
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect() if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])}
    linked = {i: {j for j, b in rows.items() if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9} for i, a in rows.items()}
    out = {r["vec_id"]: r for r in nn_descent.near_duplicates(df.withColumn("node", F.lit(1))).collect()}
    assert len(out) == df.count()
    for i, r in out.items():
        reach, stack = {i}, [i]
        while stack:
            for j in linked.get(stack.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    stack.append(j)
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(linked.get(i, ())), min(reach), min(reach) == i)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def exact_links(x, threshold=0.9):
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize(("between", "noise"), [(0.94, 0.012), (0.875, 0.035)])
def test_links_between_full_lists(spark, between, noise):
    """Two tight groups: every list fills up inside its group, so the links between them are in no list."""
    rng = np.random.default_rng(5)
    centre = np.zeros((2, 32))
    centre[0, 0], centre[1, :2] = 1, (between, np.sqrt(1 - between**2))
    x = np.repeat(centre, 80, axis=0) + rng.normal(scale=noise, size=(160, 32))
    x = np.concatenate([x, rng.normal(size=(40, 32))])
    linked = exact_links(x)
    assert linked[:80, 80:160].any()
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = sorted(map(tuple, nn_descent.near_duplicates(df).select("vec_id", "n_links", "component_id").collect()))
    assert out == [(i, int(linked[i].sum()), 0 if i < 160 else i) for i in range(200)]


@pytest.mark.parametrize("noise", [0.0005, 0.03, 0.045])
def test_links_of_classes_with_and_without_core(spark, monkeypatch, noise):
    """All, some or none of a class near enough to its centre; parts of few vectors; copies."""
    monkeypatch.setattr(nn_descent, "PART", 16)
    rng = np.random.default_rng(9)
    x = np.repeat(np.eye(32)[:2] + 0.02, [70, 40], axis=0) + rng.normal(scale=noise, size=(110, 32))
    nodes = spark.createDataFrame([(int(k >= 70), k, r.tobytes(), 1 + k % 3) for k, r in enumerate(x)], "component long, id long, v binary, copies long")
    copies = 1 + np.arange(110) % 3
    linked = exact_links(x)
    linked[:70, 70:] = linked[70:, :70] = False
    found = dict(map(tuple, nn_descent.class_links(nodes, 0.9).collect()))
    assert [found[k] for k in range(110)] == (linked @ copies).tolist()


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (None, None), (3, [0.0, 1.0])]
    out = sorted(map(str, map(tuple, nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    assert out == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, None), (None, 0, None, None), (3, 0, 3, True)]))


def test_a_missed_audit_is_not_returned(spark, monkeypatch):
    """Lists that find nothing: the audit sees it, also in groups larger than a list, and blocks give the exact answer."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.normal(size=(3, 16)), 40, axis=0) + rng.normal(scale=0.05, size=(120, 16)), rng.normal(size=(30, 16))])
    linked = exact_links(x)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(nn_descent, "descend", lambda lists, nodes, threshold: lists.where((F.col("node") % 40 < 9) & (F.col("near") % 40 < 9)))
    monkeypatch.setattr(nn_descent, "PART", 32)
    out = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    assert [out[i]["n_links"] for i in range(150)] == linked.sum(axis=1).tolist()
    assert [out[i]["component_id"] for i in range(120)] == [i // 40 * 40 for i in range(120)]


def test_audit_counts_all_links(spark):
    x = np.eye(1, 16) + np.random.default_rng(7).normal(scale=0.01, size=(60, 16))
    nodes = spark.createDataFrame([(i, 1, r.tobytes()) for i, r in enumerate(x)], "id long, copies long, v binary")
    answer = spark.createDataFrame([(i, 0, 8) for i in range(60)], "id long, component long, n long")
    assert nn_descent.sampled_recall(answer, nodes, 60, 0.9) == (pytest.approx(8 / 59), 60 * 59)


def test_independent_links_show_what_is_missing(spark):
    """Links weigh as much as such links are rarely found; those between two classes are missing."""
    found = spark.createDataFrame([(1, 2, 1.0), (3, 4, 0.9), (5, 6, 0.9), (7, 8, 0.95)], "node long, near long, cos double")
    answer = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0), (5, 5, 1), (6, 5, 1)], "id long, component long, n long")
    out = {r["node"]: r for r in nn_descent.missed_links(answer, found, 8, 3).collect()}
    assert {i: r["missed"] for i, r in out.items()} == {1: False, 3: True, 5: False, 7: True}
    assert out[1]["weight"] == pytest.approx(1) and all(out[i]["weight"] == pytest.approx(1 / nn_descent.met(c, 8, 3)) for i, c in ((3, 0.9), (7, 0.95)))


@pytest.mark.parametrize(("count", "least"), [(1000, 0.995), (10**5, 0.995), (10**9, 0.995)])
def test_tables_grow_with_the_vectors(count, least):
    assert nn_descent.met(0.9, nn_descent.planes_of(count), nn_descent.tables_of(count, 0.9)) >= least


def test_rare_links_among_many_cells(spark, monkeypatch):
    """A hundred planted pairs just over the threshold among 8,000 vectors in 500 cells of each table."""
    monkeypatch.setattr(nn_descent, "CELL", 16)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = rng.permutation(8000)[:200].reshape(-1, 2)
    for a, b in pairs:
        side = rng.normal(size=64)
        side -= side @ x[a] * x[a]
        x[b] = 0.902 * x[a] + np.sqrt(1 - 0.902**2) * side / np.linalg.norm(side)
    linked = exact_links(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(df).collect()}
    ends = np.flatnonzero(linked.any(axis=1))
    assert len(ends) >= 200 and sum(out[i] == linked[i].sum() for i in ends) >= 0.99 * len(ends)
    assert not any(out[i] for i in set(range(8000)) - set(ends.tolist()))


def test_forest_connects_what_the_links_connect():
    rng = np.random.default_rng(8)
    for _ in range(50):
        linked = rng.random((12, 9)) < 0.12
        a, b = nn_descent.forest(linked)
        assert linked[a, b].all()
        kept = np.zeros_like(linked)
        kept[a, b] = True
        reach = [np.linalg.matrix_power(np.block([[np.eye(12), m], [m.T, np.eye(9)]]).astype(float), 21) > 0 for m in (linked, kept)]
        assert (reach[0] == reach[1]).all() and len(a) <= 20


# --- conversations -----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, slice string"


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (2, 0, "user", "hi", "x"), (2, 1, "assistant", "yes", "x"), (3, 0, "user", "hi", "x"), (3, 1, "assistant", "yes", "x"),
        (4, None, None, None, "x"), (5, 0, "user", "", "x"), (6, 0, "user", None, "x"), (6, 1, "user", "a<|im_end|>b", "x"), (None, 0, "user", "lost", "x"),
    ]
    out = {r["conv_id"]: r["rendered"] for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert out.keys() == {2, 4, 5, 6, None}
    assert out[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert out[4] == "<|im_start|>unknown\n<|im_end|>\n" and "a< |im_end|>b" in out[6]
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_in_parts(spark):
    long = [(1, k, "user", str(k), "x") for k in range(700)]
    prefix = [(2, k, "user", str(k), "x") for k in range(699)]
    out = chat.format_conversations(spark.createDataFrame(long + prefix, TURNS)).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in out] == [(1, 0, 256), (1, 1, 256), (1, 2, 188)]
    assert "".join(r["rendered"] for r in out) == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(700))


def plain_conversations(rows):
    """Conversation ids and their turns in order, for those that no longer one starts with; of equal ones the smallest id."""
    logs = {}
    for c, turn, role, text, _ in rows:
        logs.setdefault(c, []).append((turn, role, text))
    null_first = lambda v: (v is not None, v if v is not None else 0)
    logs = {c: [t[1:] for t in sorted(log, key=lambda t: tuple(map(null_first, t)))] for c, log in logs.items()}
    order = sorted(logs, key=null_first)
    keep = [c for c in order if not any((len(logs[d]) > len(logs[c]) or (len(logs[d]) == len(logs[c]) and null_first(d) < null_first(c))) and logs[d][: len(logs[c])] == logs[c] for d in order)]
    return {c: "".join(f"<|im_start|>{'unknown' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in logs[c]) for c in keep}


def test_conversations_against_plain_loops(spark, monkeypatch):
    """Turns without a number, ties, repeats, equal and nested conversations; small parts and slices."""
    monkeypatch.setattr(chat, "PART", 4)
    monkeypatch.setattr(chat, "SLICE", 3)
    monkeypatch.setattr(chat, "HEAD", 1)
    rng = np.random.default_rng(8)
    rows = []
    for c in [None, *range(60)]:
        pool = [(None if rng.random() < 0.3 else int(rng.integers(0, 9)), [None, "user", "u"][rng.integers(0, 3)], [None, "", "a", "ab", "b", "ä"][rng.integers(0, 6)]) for _ in range(rng.integers(1, 20))]
        rows += [(c, *p, "x") for p in pool]
    for c in range(60, 120):  # logs that stop early, and whole copies
        of = int(rng.integers(0, 60))
        log = sorted([r for r in rows if r[0] == of], key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:4]))
        rows += [(c, *r[1:]) for r in log[: int(rng.integers(1, len(log) + 1))]]
    rng.shuffle(rows)
    rows = [tuple(None if v is None else int(v) if k < 2 else str(v) for k, v in enumerate(r)) for r in rows]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "part").collect()
    texts = {}
    for r in out:
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["rendered"]
    assert texts == plain_conversations(rows)


def test_texts_of_conversations_move_twice(spark, monkeypatch, tmp_path):
    plans = []

    def moved(df):
        text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [b for b in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text) if "text#" in b or "line#" in b]

    stored = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df: plans.append(moved(df)) or stored(df))
    monkeypatch.setattr(chat, "PART", 2)
    path = str(tmp_path / "turns")
    spark.createDataFrame([(c, k, "user", f"{c % 3} {k}", "x") for c in range(20) for k in range(5)], TURNS).write.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the limit
    try:
        out = chat.format_conversations(spark.read.parquet(path))
        plans.append(moved(out))
        assert [len(p) for p in plans] == [1, 1], plans
        assert "Python" not in out._jdf.queryExecution().toString() and out.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_prefixes_of_one_hash_are_told_apart(spark):
    """Equal sums of hashes with different turns are an error, not a lost conversation."""
    rows = spark.createDataFrame([((1,), 1, b"a", 5, 6, True), ((2,), 1, b"b", 5, 6, True)], "conv struct<conv_id: long>, position long, digest binary, h1 long, h2 long, is_last boolean")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chat, "prefix_hashes", lambda turns, seed: rows)
        with pytest.raises(Exception, match="another seed"):
            chat.maximal_conversations(rows).collect()


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
