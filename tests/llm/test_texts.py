"""Operators that read each text for itself."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontam, html, langid, media, secrets, sentencepiece, tables
from tidemark.llm.tokens import WordHashes

# SentencePiece


@pytest.fixture(scope="module")
def codec():
    if not os.path.exists(sentencepiece.MODEL):
        pytest.skip("no piece model")
    return sentencepiece.Codec(sentencepiece.Pieces.load())


def best_score(codec, part):
    """The highest sum over all segmentations, by plain dynamic programming over substrings."""
    scores = {p: s for i, (p, s) in enumerate(zip(codec.pieces.text, codec.pieces.score, strict=True)) if i not in codec.pieces.special}
    best = [0.0] + [-math.inf] * len(part)
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - 16), end):
            step = scores.get(part[start:end])
            if step is None and end - start == 1:
                step = codec.unknown
            if step is not None:
                best[end] = max(best[end], best[start] + step)
    return best[-1]


def path_score(codec, ids):
    """The sum of a segmentation's scores; a character in bytes counts once, at its first byte."""
    first = sum(codec.byte_of.get(i, 128) & 0xC0 != 0x80 for i in ids)
    return codec.unknown * first + sum(codec.pieces.score[i] for i in ids if i not in codec.byte_of)


RARE = st.text(st.sampled_from("abcdeinrst  \n..,'_-()0129éñßüЖя中文日🙂𝄞▁\x00\u0301½²"), max_size=40)


def test_viterbi_finds_the_best_segmentation(codec, texts):
    words = ["internationalization", "thththeron", "naïveté", "x𝄞y", "....---", "ciónmenteada", "zzzzzzzz", "日本語", "𝄞", "a\x00b🙂"]
    for part in [" " + w for w in words] + words:
        assert codec.decode(codec.encode(part)) == part
        assert path_score(codec, codec.viterbi(part)) == pytest.approx(best_score(codec, part))
    assert any(i in codec.byte_of for i in codec.viterbi("x𝄞y"))


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(RARE)
def test_any_text_is_cut_without_loss_and_segmented_as_a_whole(codec, text):
    ids = codec.encode(text)
    assert codec.decode(ids) == text and "".join(codec.cut.findall(text)) == text
    if text:
        assert path_score(codec, ids) == pytest.approx(best_score(codec, " " + text))


def test_ids_of_no_piece_are_left_out(codec, spark):
    ids = codec.encode("well known")
    rows = spark.createDataFrame([(1, [*ids, None, 10**6, -1]), (2, None), (3, [])], "doc_id int, ids array<int>").withColumn("decoded", F.lit("x"))
    assert [r["decoded"] for r in sentencepiece.decode(rows).orderBy("doc_id").collect()] == ["well known", None, ""]


def test_encoding_of_odd_rows(codec, docs, empty, texts):
    found = sentencepiece.encode(docs).collect()
    assert len(found) == docs.count() and all(r["round_trip"] for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[4]["ids"] == [] and by_id[5]["n_tokens"] == 0 and by_id[8]["n_tokens"] == len(by_id[8]["ids"])
    assert {r["doc_id"]: r["decoded"] for r in sentencepiece.decode(sentencepiece.encode(docs)).collect() if r["doc_id"]} == {i: t or "" for i, t in texts.items()}
    assert sentencepiece.encode(empty).collect() == []


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><p>Site header, with, commas, and, more, words that are long enough to count as prose here.</p></header>
<nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, lots, of, cookies.</div>
<div id="content"><h1>Title &amp; more</h1><p>First   paragraph,
with a <b>bold</b> word, and a <a href="x">link</a>.<br>Next line &lt;here&gt;.<p>Second paragraph, unclosed, as is often done, and quite long.
<ul><li>one</li><li>two</li></ul><div class="ad">Buy, buy, buy, now, and again, and again.</div><form><p>Your mail, please, here.</p></form>
<blockquote>Quoted, at some length, to be kept with the rest of it.</blockquote></div>
<div class="sidebar"><p>Other, news, of, the, day, that, nobody, needs.</p></div>
<section id="comments"><p>First! I think, as a reader, that this, is, great.</p></section><footer>&copy; us, all, rights</footer></body></html>"""
EXPECTED = "Title & more\nFirst paragraph, with a bold word, and a link. Next line <here>.\nSecond paragraph, unclosed, as is often done, and quite long.\none\ntwo\nQuoted, at some length, to be kept with the rest of it."


def test_main_text():
    assert html.main_text(PAGE) == EXPECTED
    assert html.main_text(PAGE.replace('<div id="content">', "<article>").replace("kept with the rest of it.</blockquote></div>", "kept with the rest of it.</blockquote></article>")) == EXPECTED


@pytest.mark.parametrize("names", ["content-sidebar-wrap", "site has-sidebar", "no-comments", "form-page", "page sidebar"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_named_after_what_they_hold_or_lack_keep_their_text(names, inner):
    body = "".join(f"<p>Sentence {i} of a text, with commas, and long enough to count as prose.</p>" for i in range(6))
    page = f"""<body><div class="site-header"><h1><a href="/">Site</a></h1></div><div class="{names}"><{inner}><div class="post-header"><h1>Headline</h1></div>{body}</{inner}>
    <div class="left-sidebar"><p>Other, news, of the day.</p></div></div><div class="related-posts"><article><p>More, to read.</p></article></div>
    <div id="comments" class="comments-area"><article class="comment-body"><p>First, of all.</p></article></div></body>"""
    found = html.main_text(page).split("\n")
    assert [x for x in found if x.startswith("Sentence")] == [f"Sentence {i} of a text, with commas, and long enough to count as prose." for i in range(6)]
    assert "Headline" in found
    assert not {"Other, news, of the day.", "First, of all.", "Site"} & set(found)


def test_many_comments_do_not_outdo_the_text():
    said = "".join(f'<li><p>Comment {i}, with commas, and some more words in it.</p></li>' for i in range(40))
    body = "".join(f"<p>Sentence {i} of a text, with commas, and long enough to count as prose.</p>" for i in range(8))
    for names in ("comment-list", "comments"):
        assert "Comment" not in html.main_text(f'<div class="post"><h1>Headline</h1>{body}</div><ol class="{names}">{said}</ol>')


def test_all_parts_of_an_article_without_an_article_element_are_kept():
    long = "".join(f"<p>Sentence {i} of a text, with commas, and long enough to count as prose.</p>" for i in range(9))
    lines = [f"Sentence {i} of a text, with commas, and long enough to count as prose." for i in range(9)]
    links = '<ul class="x"><li><a href="/a">Some page</a></li><li><a href="/b">Another page</a></li></ul>'
    parts = "<section><h2>Short</h2><p>Few words</p></section><table><tr><td>1</td><td>2</td></tr></table><pre>code</pre><blockquote>said</blockquote>Loose"
    page = f'<body>{links}<div class="post"><h1>Title</h1><div class="text">{long}</div>{parts}</div></body>'
    assert html.main_text(page).split("\n") == ["Title", *lines, "Short", "Few words", "1", "2", "code", "said", "Loose"]
    inner = f'<div class="part"><div class="inner">{long}</div></div>'
    assert html.main_text(f'<body>{links}<div class="post"><h1><a href="/me">Title</a></h1>{inner}{inner}</div></body>').split("\n") == ["Title", *lines, *lines]


SENTENCES = [f"Sentence {i} of a text, with commas, and long enough to count as prose." for i in range(6)]
BODY = "".join(f"<p>{s}</p>" for s in SENTENCES)


@pytest.mark.parametrize("box", ["article", "div"])
@pytest.mark.parametrize(
    ("inside", "lines"),
    [
        ('<h2 id="social-effects">Social effects</h2><h2 id="search">Search</h2><h3 class="related">More</h3>', ["Social effects", "Search", "More"]),
        ('<p id="notice-period">Notice is given, in writing.</p><p class="notice">Cookies!</p>', ["Notice is given, in writing."]),
        ('<section id="search"><h2>Search</h2><p>How one looks, and finds.</p></section>', ["Search", "How one looks, and finds."]),
        ('<section id="comments"><h2>Comments</h2><p>First, of all, I say.</p></section>', []),
        ('<section id="related"><h2>Related</h2><ul><li><a href="x">One of the other pages</a></li></ul></section>', []),
        ('<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, <label>Fig. 1</label><object> shows</object>.</p>', ["If x=2, Fig. 1 shows."]),
        ('<form><label>Name</label></form><p>End, of it.</p>', ["End, of it."]),
        ("<p title='broken>One, two.</p>", ["One, two."]),
    ],
)
def test_nothing_of_the_article_but_what_is_listed_goes(box, inside, lines):
    page = f"<html><head><title>T</title><meta charset=x><link rel=y><{box}><h1>Headline</h1>{BODY}{inside}</{box}>"
    assert html.main_text(page).split("\n") == ["Headline", *SENTENCES, *lines]


def test_a_head_need_not_end():
    for before in ("<head><title>T</title><body>", "<html><head><meta a=b><style>p{}</style>", "<head><title>T</title></head>", "<head>"):
        assert html.main_text(f"{before}<article><h1>Headline</h1>{BODY}</article>").split("\n") == ["Headline", *SENTENCES]


def test_fifty_made_pages_without_an_article_element():
    pick = random.Random(7)
    words = "river stone market bridge winter garden letter window harbour mountain music science paper forest".split()

    def sentence(n):
        return (" ".join(pick.choices(words, k=n)) + ", and " + " ".join(pick.choices(words, k=n)) + ".").capitalize()

    for k in range(50):
        blocks = [("h1", f"Headline {k}")]
        for _ in range(pick.randrange(2, 5)):
            blocks.append(("h2", " ".join(pick.choices(words, k=2)).capitalize()))
            blocks += [("p", sentence(pick.randrange(4, 20))) for _ in range(pick.randrange(1, 5))]
            blocks += [(pick.choice(("blockquote", "pre", "li", "td")), sentence(3)) for _ in range(pick.randrange(3))]
        wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}
        parts = [wrap.get(tag, f"<{tag}>{{}}</{tag}>").format(text) for tag, text in blocks]
        cut = pick.randrange(1, len(parts)) if k % 2 else 1
        text = "".join(parts[:cut]) + f'<div class="{pick.choice(("text", "body", "x1"))}">' + "".join(parts[cut:]) + "</div>"
        page = (
            '<html><head><title>T</title></head><body><div class="navbar"><a href="/">Home</a> <a href="/a">About us</a></div>'
            f'<div class="{pick.choice(("content", "post", "page-wrap", "has-sidebar"))}">{text}</div>'
            '<div class="sidebar"><ul><li><a href="/x">Latest story of the day</a></li></ul><p>Follow us, daily.</p></div>'
            '<div id="comments"><p>I like it, a lot.</p></div><div class="footer">All rights, reserved.</div></body></html>'
        )
        assert html.main_text(page).split("\n") == [t for _, t in blocks], k


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "<p>deep, deep down</p>"
    odd = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (4, "u", "<p>cut off in a t"), (5, "u", "<p>a</p"), (6, "u", "<<>><p>x &am"), (7, "u", deep), (8, "u", "<!-- never closed <p>x"), (8, "u", "</p></div>stray")]
    table = spark.createDataFrame(odd, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    found = {(r["page_id"], r["text"]) for r in html.extract(table).collect()}
    assert found == {(1, ""), (2, ""), (3, "no markup at all"), (4, "cut off in a t"), (5, "a"), (6, "<<>>\nx &am"), (7, "deep, deep down"), (8, ""), (8, "stray")}
    assert html.extract(table.limit(0)).collect() == []


# language ID


def test_language_by_words_then_grams(spark):
    data = [(i, lang, t) for i, (lang, t) in enumerate([("en", "the house and the garden"), ("de", "das haus und der garten"), ("fr", "la maison et le jardin")] * 20)]
    table = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    model = langid.fit(table)
    scorer = langid.Scorer(model)
    asked = ["the the the", "das und", "maisons jardins", "gärten", "", None, "123 !?", "qqq"]
    found = scorer.predict(asked)
    assert [f[0] for f in found[:3]] == ["en", "de", "fr"] and [f[0] for f in found[4:7]] == ["und"] * 3
    assert all(0 <= s <= 1 for _, s in found)
    assert [scorer.predict([a])[0] for a in asked] == found  # a text's answer does not hang on the others
    out = langid.identify(table).collect()
    assert all(r["lang_pred"] == data[r["doc_id"]][1] for r in out) and {r["held_out"] for r in out} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)


PROSE_OF_A_PAGE = "Long text of the article, with commas, and more words, that goes on for a while so that it scores well. " * 3
KEPT_BY_TOPIC = [
    '<p class="ad-free">{}</p>', '<section class="related-work"><h2>Related</h2><p>{}</p></section>', '<div class="share-price">{}</div>',
    '<table class="login-methods"><tr><td>{}</td></tr></table>', '<ul class="menu-items"><li>{}</li></ul>', '<div class="alert-system-history">{}</div>',
    '<p>This <span class="notice-number">{}</span> is in a line.</p>', '<p>A <b class="ad">{}</b> in a line.</p>',
]
GONE_BY_NAME = [
    '<ol class="commentlist"><li>{}</li></ol>', '<div class="reader-feedback">{}</div>', '<div class="adbox">{}</div>', '<div id="cookiebar">{}</div>',
    '<div class="sidenav">{}</div>', '<div class="ad-slot">{}</div>', '<div class="ad">{}</div>', '<div class="share-price"><a href="x">{}</a></div>',
]


@pytest.mark.parametrize("around", ("<article>{}</article>", "<div id=x>{}</div>"))
def test_names_with_a_topic_are_won_back_and_joined_names_are_known(around):
    for kept, parts in ((True, KEPT_BY_TOPIC), (False, GONE_BY_NAME)):
        for part in parts:
            inside = f"<h1>Title</h1><p>{PROSE_OF_A_PAGE}</p>{part.format('the words asked for')}<p>{PROSE_OF_A_PAGE}</p>"
            text = html.main_text(f"<html><body>{around.format(inside)}</body></html>")
            assert ("the words asked for" in text) == kept, part
            assert text.startswith("Title\nLong text") and text.count("scores well") == 6


def test_a_linked_introduction_stays():
    page = f"<div><p><a href=x>A very long linked introduction that is over half of it</a> Read it. All of it.</p><div class=text><p>{PROSE_OF_A_PAGE}</p><p>{PROSE_OF_A_PAGE}</p></div></div>"
    assert "Read it. All of it." in html.main_text(page)


def test_numerals_are_no_letters(spark):
    table = spark.createDataFrame([(1, "en", "alpha beta"), (2, "de", "eins zwei")], "doc_id bigint, lang string, text string")
    scorer = langid.Scorer(langid.fit(table))
    assert [f[0] for f in scorer.predict(["½ ²", "Ⅷ ٣ 12_3", "½eins², zwei"])] == ["und", "und", "de"]
    assert langid.words("a½b x²") == ["a", "b", "x"]


@pytest.mark.parametrize("most", [0, 100_000])
def test_all_labels_are_learned_from_a_bounded_sample(spark, monkeypatch, most):
    monkeypatch.setattr(langid, "MOST_BROADCAST", most)
    names = ["".join(p) for p in itertools.product("abcdefgh", repeat=2)][:40]
    data = [(i, names[i % 40], f"mot{names[i % 40]} {names[i % 40]}wort") for i in range(400)]
    table = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    model = langid.fit(table, max_docs=40)
    assert len(model.langs) == 40 and len(model.words.hashes) == 80 and len(model.words.langs) == 80


def test_held_out_texts_that_share_no_sentence_with_learned_ones(spark):
    """Sentences of one grammar and word list a language; held-out texts draw on other sentences and on words never learned."""
    stems = {"en": "house garden water stone bridge winter", "de": "haus garten wasser stein straße winter", "fr": "maison jardin eau pierre rivière hiver"}
    glue = {"en": "the {} was near the {}ing and they were {}ed", "de": "das {} war bei dem {}ung und sie sind ge{}t", "fr": "la {} était près du {}ment et ils ont {}é"}
    pick, data, seen = random.Random(2), [], set()
    while len(data) < 600:
        lang = pick.choice(list(stems))
        made = [pick.choice(stems[lang].split()) + "".join(pick.choices("aeiou", k=2)) for _ in range(3)]
        text = glue[lang].format(*made)
        if text not in seen:
            seen.add(text)
            data.append((len(data), lang, text))
    found = langid.identify(spark.createDataFrame(data, "doc_id bigint, lang string, text string")).collect()
    out = [r for r in found if r["held_out"]]
    assert len(out) > 150 and sum(r["lang_pred"] == data[r["doc_id"]][1] for r in out) >= 0.98 * len(out)


def test_memory_of_words_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MEMO_CELLS", 100)
    table = spark.createDataFrame([(1, "en", "alpha beta"), (2, "de", "eins zwei")], "doc_id bigint, lang string, text string")
    small = langid.Scorer(langid.fit(table))
    monkeypatch.setattr(langid, "MEMO_CELLS", 10_000)
    large = langid.Scorer(langid.fit(table))
    made = [" ".join("".join(random.Random(i * 100 + j).choices("abeinzw", k=5)) for j in range(60)) for i in range(9)]
    assert small.predict(made) == large.predict(made)


def test_language_scores_equal_plain_code(spark):
    """Every word and n-gram by its own log share, from the texts themselves."""
    pick = random.Random(6)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgha"}
    data = [(i, lang, " ".join("".join(pick.choices(letters[lang], k=pick.choice((1, 3, 6)))) for _ in range(8))) for i, lang in enumerate(["aa", "bb", "cc"] * 15)]
    scorer = langid.Scorer(langid.fit(spark.createDataFrame(data, "doc_id bigint, lang string, text string")))
    counts = {(lang, n): Counter() for lang in letters for n in range(6)}
    for _, lang, text in data:
        for word in text.split():
            counts[lang, 0][word] += 1
            for n in range(1, 6):
                counts[lang, n].update(f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n))

    def share(lang, n, entry):
        return math.log(max(counts[lang, n][entry], 0.5) / counts[lang, n].total())

    def plain(text):
        total = dict.fromkeys(letters, 0.0)
        for word in text.split():
            if any(counts[lang, 0][word] for lang in letters):
                found = [(0, word)]
            else:
                padded = f"<{word}>"
                places = [[(n, padded[i : i + n]) for n in range(min(5, len(padded) - i), 0, -1)] for i in range(len(padded))]
                found = [next(g for g in p if any(counts[lang, g[0]][g[1]] for lang in letters)) for p in places if any(counts[lang, n][g] for n, g in p for lang in letters)]
            for lang in letters:
                steps = [share(lang, n, g) + ((5 - n) * math.log(0.4) if n else 0) for n, g in found]
                total[lang] += sum(steps) / max(1, len(steps))
        top = max(total.values())
        return max(sorted(total), key=total.get), 1 / sum(math.exp(t - top) for t in total.values())

    asked = [" ".join(pick.choices([*data[i][2].split(), "".join(pick.choices("abcdefghz", k=4)), "".join(pick.choices("zyx", k=3))], k=pick.choice((1, 2, 5)))) for i in range(45)]
    for text, (lang, score) in zip(asked, scorer.predict(asked), strict=True):
        assert plain(text) == (lang, pytest.approx(score, abs=2e-6))


def test_a_model_of_many_labels_is_small(spark):
    """1000 labels of their own words: what is held follows the pairs that occur, not words times labels."""
    frame = spark.range(4000).selectExpr("id as doc_id", "concat('l', id % 1000) as lang", "concat('wort', conv(id % 1000, 10, 26), ' rest') as text")
    model = langid.fit(frame)
    held = sum(a.nbytes for e in (model.words, model.grams) for a in (e.hashes, e.starts, e.langs, e.gains, e.size)) + model.base.nbytes
    assert len(model.langs) == 1000 and held < 4_000_000


def test_a_sample_of_long_texts_is_bounded_by_bytes(spark):
    frame = spark.range(40).selectExpr("id as doc_id", "if(id % 2 = 0, 'even', 'odd') as lang", "repeat(concat('w', chr(97 + id % 26), ' '), 1000) as text")
    assert 4 <= len(langid.fit(frame, max_bytes=12_000).words.hashes) <= 6


def test_language_of_odd_rows(docs, empty):
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert found[4]["lang_pred"] == found[5]["lang_pred"] == found[7]["lang_pred"] == "und" and found[1]["lang_pred"] == "en"
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# FLAC


@pytest.mark.parametrize("lpc", [False, True])
def test_flac_round_trip(lpc):
    wave = bytes(int(128 + 100 * math.sin(i / 9) + 20 * math.sin(i / 2)) for i in range(10_000))
    for data in (b"", b" " * 192, wave, random.Random(1).randbytes(9000), bytes(range(256)) * 40, bytes(5000), b"ab" * 3000):
        stream = media.encode(data, lpc)
        assert media.decode(stream) == data and stream[:4] == b"fLaC"
        blocks = media.frames_of([stream])[0]
        assert [b[0] for b in blocks] == list(range(0, len(data), media.BLOCK))
    assert len(media.encode(wave, lpc)) < 0.8 * len(wave)


def test_flac_damage_is_found():
    stream = bytearray(media.encode(bytes(range(200)) * 60))
    for at in (60, len(stream) // 2, len(stream) - 1):
        bad = stream.copy()
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    bad = stream.copy()
    bad[30] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(bad))


def test_escaped_and_partitioned_residuals_are_read():
    """A frame written by hand: fixed order 1, two partitions, the first of raw 5-bit numbers, the second Rice coded with parameter 1."""
    import numpy as np

    steps = [1, -3, 7, 0, -1, 2, 1]
    samples = np.cumsum([10, *steps])
    bits = [media._bits(0, 1), media._bits(9, 6), media._bits(0, 1), media._bits(10, 8), media._bits(0, 2), media._bits(1, 4)]
    bits += [media._bits(15, 4), media._bits(5, 5)] + [media._bits(s & 31, 5) for s in steps[:3]]
    folded = np.array([2 * s if s >= 0 else -2 * s - 1 for s in steps[3:]])
    bits += [media._bits(1, 4), media._rice_bits(folded, 1)]
    reader = media._Reader(np.packbits(np.concatenate(bits)))
    assert media._subframe(reader, 8, 8).tolist() == samples.tolist()


def bit_string(fields):
    """Fields (value, width) as bytes, by text."""
    text = "".join(format(v & ((1 << w) - 1), f"0{w}b") if w else "" for v, w in fields)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def plain_crc(data, poly, bits):
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (bits - 1) else crc << 1) & ((1 << bits) - 1)
    return crc


def test_a_stream_written_by_hand():
    """Linear prediction of order 2 with coefficients 3 and -2 over a shift of 1, Rice parameter 2, header and checksums by plain code."""
    samples = [5, -7, 3, 12, 0, -20, 33, 1, 1, -1]
    fields = [(0, 1), (33, 6), (0, 1), (5, 8), (-7, 8), (4, 4), (1, 5), (3, 5), (-2, 5), (0, 2), (0, 4), (2, 4)]
    for i in range(2, len(samples)):
        left = samples[i] - ((3 * samples[i - 1] - 2 * samples[i - 2]) >> 1)
        folded = 2 * left if left >= 0 else -2 * left - 1
        fields += [(0, folded >> 2), (1, 1), (folded & 3, 2)]
    head = bytes([0xFF, 0xF8, 0x60 | 0x04, 0x02, 0, len(samples) - 1])
    frame = head + bytes([plain_crc(head, 0x07, 8)]) + bit_string(fields)
    frame += plain_crc(frame, 0x8005, 16).to_bytes(2, "big")
    pcm = bytes(s & 255 for s in samples)
    info = bytes([0, 16, 0, 16]) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    seek = (0).to_bytes(8, "big") + (0).to_bytes(8, "big") + len(samples).to_bytes(2, "big")
    stream = b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x83, 0, 0, 18]) + seek + frame
    assert media.frames_of([stream])[0][0][2].tolist() == samples
    assert media.frames_of([None, stream, media.encode(b"abc" * 99)])[1][0][2].tolist() == samples


def test_frames_side_by_side_are_those_one_by_one():
    pick = random.Random(3)
    made = [bytes(pick.choices(b"the quick brown fox, ", k=pick.randrange(1, 9000))) for _ in range(60)] + [bytes(range(256)) * 17, b"a" * 5000, b""]
    streams = [media.encode(m) for m in made]
    assert any(media._common(f[3], f[2]) and f[3][0] >= 64 for s in streams for f in media._checked(s)[0])  # general predictors are used
    together = media.frames_of(streams)
    for data, stream, own in zip(made, streams, together, strict=True):
        assert b"".join(media._pcm(s) for *_, s in own) == data
        for (first, _, n, body), (_, _, found) in zip(media._checked(stream)[0], own, strict=True):
            assert media._subframe(media._Reader(body), n, 8).tolist() == found.tolist(), first


def test_media_of_odd_rows(docs, empty, texts):
    stored = media.encode_texts(docs)
    found = {r["doc_id"]: r for r in media.media_digest(stored).collect()}
    for i, text in texts.items():
        data = media.payload(text)
        assert len(data) % 192 == 0 and len(data) > 0
        assert found[i]["payload_sha256"] == hashlib.sha256(data).hexdigest() and found[i]["tail_crc32"] == zlib.crc32(data[-16:])
        assert (found[i]["n_bytes"], found[i]["payload_bytes"]) == (len((text or "").encode()), len(data))
    assert {k: v for k, v in found[1].asDict().items() if k != "doc_id"} == {k: v for k, v in found[2].asDict().items() if k != "doc_id"}
    blocks = sorted((r["block"], r["first_sample"], bytes(r["pcm"])) for r in media.pcm_blocks(stored.where("doc_id = 8")).collect())
    assert b"".join(b[2] for b in blocks) == media.payload(texts[8]) and [b[1] for b in blocks] == [b[0] * media.BLOCK for b in blocks]
    assert media.media_digest(media.encode_texts(empty)).collect() == []
    lost = media.media_digest(stored.where("doc_id = 1").withColumn("media", F.lit(None).cast("binary"))).collect()
    assert len(lost) == 2 and all(r["media_sha256"] is None and r["payload_bytes"] is None for r in lost)


# secrets


def base_secrets(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_of_odd_rows(docs, empty, texts):
    found = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    for i, text in texts.items():
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_secrets(text or ""))
        assert found[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert [found[11][c] for c in ("n_assign", "n_access", "n_hex")] == [1, 1, 1]
    assert secrets.find_secrets(empty).collect() == []


def test_secrets_of_made_up_texts():
    parts = ["password", "token", ":", "=", " ", '"', "abc", "abcdefgh12", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "api_key", "API-KEY", "Passwort: ", "xK9#mQ2$vL", "é"]
    for seed in range(300):
        text = "".join(random.Random(seed).choices(parts, k=14))
        base, added = secrets.spans(text)
        assert [(s[0], s[1], s[2]) for s in base] == [(a, b, k) for a, _, b, k in base_secrets(text)], text
        assert all(not (s[0] < b[1] and b[0] < s[1]) for s in added for b in base)


def test_guess_cost():
    costs = {v: secrets.guess_bits(v) for v in ("password", "P@ssw0rd1", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-02", "abcabcabc", "xK9#mQ2$vL")}
    assert all(c < secrets.MIN_BITS for v, c in costs.items() if v != "xK9#mQ2$vL") and costs["xK9#mQ2$vL"] > 50
    assert secrets.guess_bits("") == 0 and secrets.guess_bits("a" * 5000) < 40
    # No segmentation into words and single characters is cheaper.
    for value in ("loveabc", "sunxmonkey", "dragon7"):
        letter = secrets._alphabet(value)
        cheapest = math.inf
        for cuts in itertools.product([0, 1], repeat=len(value) - 1):
            parts, last = [], 0
            for at, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(value[last:at])
                    last = at
            known = [secrets._BITS.get(p, len(p) * letter) + secrets.SEGMENT_BITS for p in parts]
            cheapest = min(cheapest, sum(known))
        assert secrets.guess_bits(value) <= cheapest + 1e-9
    base, added = secrets.spans("the pwd: xK9#mQ2$vL, the passphrase: changeme1")
    assert base == [] and [s[2] for s in added] == ["guess"]


def test_guess_cost_is_the_least_of_all_cuts():
    """Against a search that tries every start of every kind of segment."""

    def whole(v, per_char, low):
        out = [secrets.SEGMENT_BITS + per_char * len(v)]
        out += [secrets.SEGMENT_BITS + secrets._BITS[f] + extra for f, extra in ((low, 0), (low.translate(secrets.LEET), 1)) if len(v) > 2 and f in secrets._BITS]
        out += [secrets.SEGMENT_BITS + (secrets.YEAR_BITS if len(v) == 4 else secrets.DATE_BITS)] if secrets.DATE.fullmatch(v) else []
        if len(v) > 2 and all(p in secrets._NEXT for p in itertools.pairwise(low)):
            out.append(secrets.SEGMENT_BITS + secrets.WALK_BITS + math.log2(len(v)))
        if len(v) > 2 and len(set(v)) == 1:
            out.append(secrets.SEGMENT_BITS + per_char + math.log2(len(v)))
        return min(out)

    pick = random.Random(8)
    parts = ["password", "efghijkl", "dragon", "aaaa", "a", "9", "2024", "19990102", "1.2.2020", "defg", "zz", "poiuy", "ab"]
    for value in ["passwordefghijkl", "ppppassword", "12024-01-02", "abc1234567", *("".join(pick.choices(parts, k=4)) for _ in range(300))]:
        per_char, best = secrets._alphabet(value), [0.0]
        for end in range(1, len(value) + 1):
            best.append(min(best[s] + whole(value[s:end], per_char, value[s:end].lower()) for s in range(end)))
            for w in (2, 3, 4):
                if end >= 2 * w and value[end - w : end] == value[end - 2 * w : end - w]:
                    best[end] = min(best[end], best[end - w] + secrets.SEGMENT_BITS + 1)
        assert secrets.guess_bits(value) == pytest.approx(best[-1]), value
    assert secrets.guess_bits("passwordefghijkl") < 12
    assert secrets.guess_bits("ab" * 20_000) < 40


def test_words_of_prose_are_no_secrets_whatever_else_the_input_holds(spark):
    prose = ["patience pays on monday", "on monday, patience", "Patience is unknown; Monday is unknown", "unknown"]
    asked = ["her secret is patience", "the bearer is unknown", "token: monday", "pwd: kqzvjxwmp", "pwd: kqzvjxwmp", "pwd: kqzvjxwmp", None]
    frame = spark.createDataFrame(list(enumerate(asked + prose)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame).collect()}
    assert [found[i] for i in range(7)] == ["", "", "", *["guess:5:14"] * 3, ""]
    alone = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame.where("doc_id < 5")).collect()}
    assert alone == {i: found[i] for i in range(5)}
    assert secrets.vocabulary(None, None) == secrets._BITS


@pytest.mark.skipif(not os.path.exists(secrets.VOCABULARY), reason="no vocabulary")
def test_words_and_walks_of_the_vocabulary_are_no_secrets():
    words = secrets.vocabulary()
    assert len(words) > 30_000
    for value in ("sunnyday2019", "1qaz2wsx3edc", "iamthehorse", "letmein1999", "batterystaple", "hausgarten", "maisonette", "derhimmel"):
        assert secrets.guess_bits(value, words) < secrets.MIN_BITS, value
    for value in ("kqzvjxwmp", "xK9#mQ2$vL", "a8f5f167f44f4964"):
        assert secrets.guess_bits(value, words) > secrets.MIN_BITS, value


def test_many_spans_of_a_text_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        text = " ".join("token=abcdefgh1 pwd: xK9#mQ2$vL" for _ in range(n // 4))
        began = time.perf_counter()
        base, added = secrets.spans(text)
        took.append(time.perf_counter() - began)
        assert len(base) == len(added) == n // 4
    assert took[1] < 8 * took[0]


# decontamination


def brute_leaks(docs, items):
    """Every pair of texts laid side by side at every shift."""
    hashes, out = WordHashes(), set()
    for d, text in docs:
        for i, item in items:
            a, b = hashes.of(text), hashes.of(item)
            if len(b) and any(_best(a, b, s) for s in range(-len(b) + 1, len(a))):
                out.add((d, i))
    return out


def _best(a, b, shift):
    first, last = max(0, shift), min(len(a), shift + len(b))
    return decontam.longest(a[first:last] == b[first - shift : last - shift], min(decontam.LEAST_WORDS, len(b)))


def test_longest_stretch_equals_brute_force():
    import numpy as np

    pick = random.Random(6)
    for _ in range(300):
        same = np.array([pick.random() < pick.choice((0.6, 0.8, 0.9)) for _ in range(pick.randrange(1, 40))])
        whole = [(b - a, a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and 5 * same[a:b].sum() >= 4 * (b - a)]
        longest = max((n for n, _ in whole), default=0)
        found = decontam.longest(same, 5)
        assert (found[1] if found else 0) == (longest if longest >= 5 else 0)
        assert found is None or same[found[0] : found[0] + found[1]].mean() >= 0.8 - 1e-9


def sought(text, item):
    """The best overlap on the diagonals that a seed hits."""
    import numpy as np

    shifts = set()
    for mask, found, places in decontam.item_seeds(item):
        own = decontam.seed_hashes(text, mask)
        shifts |= {int(at - p) for h, p in zip(found, places, strict=True) for at in np.flatnonzero(own == h)}
    return decontam.overlap(text, 0, item, sorted(shifts))


@pytest.mark.parametrize("n", range(1, 21))
def test_no_tolerated_substitution_hides_an_item(n):
    """All ways to substitute a fifth of the words. The first and last words agree in stretches, else the stretch is a shorter one."""
    hashes = WordHashes()
    for size in {n, n + 9} if n >= decontam.LEAST_WORDS else {n}:  # the item, or a stretch inside a longer one
        item = hashes.of(" ".join(f"w{i}" for i in range(size)))
        at = (size - n) // 2
        for gone in itertools.combinations(range(at + 1, at + n - 1), n // 5):
            kept = [f"w{i}" if at <= i < at + n and i not in gone else "zz" for i in range(size)]
            assert sought(hashes.of("x y " + " ".join(kept) + " q"), item), gone


def test_leaks_equal_brute_force(spark):
    pick = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(pick.choices(words, k=n))) for i, n in enumerate((3, 5, 9, 13, 20, 40))] + [(90, None), (91, ""), (None, "a b c d e f g h i j k l m n")]
    docs = []
    for d in range(60):
        own = pick.choices(words, k=30)
        item = items[d % 6][1].split()
        changed = [w if pick.random() > 0.12 else "other" for w in item]
        docs.append((d, " ".join(own[:10] + changed[d % 3 :] + own[10:])))
    docs += [(None, items[5][1]), (99, None), (98, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()}
    expected = brute_leaks([x for x in docs if x[1]], [x for x in items if x[1]])
    assert found == expected and len(found) > 30


def test_a_task_of_decontamination_holds_one_python_worker(spark, docs, texts):
    bench = spark.createDataFrame([(i, t) for i, t in texts.items()], "item_id bigint, text string")
    found = decontam.leaks(docs, bench)
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1 and found.count() > 0


def test_a_batch_is_read_by_parts_of_few_bytes():
    texts = ["a" * 40, None, "é" * 30, "b" * 500, "", "c" * 99, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["key", "text"])
    parts = [p.column(1).to_pylist() for p in tables.slices(batch, 1, 100)]
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100 for p in parts)
    assert list(tables.slices(batch.slice(0, 0), 1, 100)) == []


def test_a_full_bitmap_and_odd_rows_give_the_same(spark, docs, monkeypatch, texts):
    bench = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, texts[1])], "item_id bigint, text string")
    one = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    assert one and any("doc_id=None" not in r for r in one)
    monkeypatch.setattr(decontam, "LEAST_BITS", 8)
    monkeypatch.setattr(decontam, "MOST_BITS", 8)  # lets nearly every window pass
    assert sorted(map(str, decontam.contaminated(docs, bench).collect())) == one
    assert decontam.contaminated(docs, bench.limit(0)).collect() == [] and decontam.contaminated(docs.limit(0), bench).collect() == []
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, None}
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert decontam.without_leaks(docs, bench).count() == kept.count()
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()
