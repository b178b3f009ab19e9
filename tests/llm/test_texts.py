"""Leaks, pieces and mixes on small fixtures."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from streamloom.llm.contamination import bloom_filter, find_leaks, may_contain, word_lists
from streamloom.llm.mixing import mix_sources, rake
from streamloom.llm.splitting import merged, split_oversized, split_text
from streamloom.llm.tokens import DIRECTORY, VOCABULARY, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(DIRECTORY, VOCABULARY)), reason="no vocabulary file")
WORDS = [f"w{i}" for i in range(60)]


# --- leaks ---------------------------------------------------------------------------------------------------
def leaks(doc: list[str], item: list[str]) -> bool:
    """All alignments, all spans."""
    for shift in range(-len(item), len(doc)):
        equal = [doc[q + shift] == w if 0 <= q + shift < len(doc) else None for q, w in enumerate(item)]
        for a in range(len(item)):
            bad = 0
            for b in range(a, len(item)):
                if equal[b] is None:
                    break
                bad += not equal[b]
                if b - a + 1 >= 30 and bad * 10 <= b - a + 1:
                    return True
    return False


def test_words():
    text = "The '''[[Big river|river]]''' &amp; <i>its</i>&nbsp;bank<!-- no --> {{quote|text=GROSSE Straße}}<ref name=\"a\">{{cite book|title=x}}</ref> ca\u00adnal a_b [https://x.org site]"
    running = ["the", "river", "its", "bank", "canal", "a", "b", "site"]
    assert word_lists(text, 4) == [running]
    assert ["quote", "grosse", "strasse"] in word_lists(text) and ["cite", "book", "x"] in word_lists(text)
    assert word_lists(None) == word_lists("") == word_lists(" ?! ") == []
    assert word_lists("Ähre") == word_lists("ÄHRE")
    # what is never closed is running text; nameless parameters are read in place, too
    assert word_lists("a <ref>b {{c <ref name=x/> d <ref>e</ref> f <!-- g", 2) == [["a", "b", "c", "d", "f", "g"]]
    assert ["a", "b", "c", "d"] in word_lists("a {{nowrap|b c}} {{cn|date=1}} d") and ["a", "d"] in word_lists("a {{nowrap|b c}} d")
    for deep in ("{{" * 20_000 + "<ref>" * 20_000, "{{a|" * 3000 + "}}" * 3000, "<!--" * 50_000, "[[a|" * 20_000, "<ref" * 20_000):
        word_lists(deep + " end")


def test_markup_of_any_length(spark):
    """References, tags and templates of any name and length inside a passage, and passages inside them."""
    item = [f"p{i}" for i in range(30)]
    def at(s): return " ".join([*item[:15], s, *item[15:]])  # noqa: E704
    long = " ".join(f"q{i}" for i in range(1500))
    docs = [at(f"<ref>{long}</ref>"), at(f"<ref name='{long}'/>"), at(f"<span title='{long}'>"), at("{{refn|" + long + "}}"), at("{{zzz|date=x}}"), at("{{sfn|" + long + "|{{a|b}}}}")]
    docs += [f"{long} <ref>{' '.join(item)} {long}</ref>", f"<span title='{' '.join(item)}'>", "{{any|x=" + at("<ref>y z</ref>") + "}}", " ".join(item[:14]) + " {{nowrap|" + " ".join(item[14:16]) + "}} " + " ".join(item[16:])]
    docs += ["{| class=x\n|" + "\n|-\n|".join(item) + "\n|}", "{{unclosed " + at("<ref>"), at("<!-- " + long + " -->")]
    none = [at(long), " ".join(item[:15]) + "<!-- " + " ".join(item[15:]) + " -->", " ".join(reversed(item))]
    df = spark.createDataFrame(list(enumerate(docs + none)), "doc_id bigint, text string")
    got = find_leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(docs)))


def test_filter(spark):
    import numpy as np

    from streamloom.llm.contamination import Shape, gram_hashes

    shape, rng = Shape(30, 6), np.random.default_rng(1)
    words = rng.integers(1, 2**63, (50, shape.width), dtype=np.uint64)
    table = bloom_filter(spark.createDataFrame([(bytearray(w.tobytes()),) for w in words], "words binary"), shape, 6, len(words))
    mine = np.concatenate([gram_hashes(w[shape.reach : shape.reach + 69], 6) for w in words])
    others = rng.integers(1, 2**63, 20_000, dtype=np.uint64)
    assert len(may_contain(table, mine)) == len(mine) == 3200 and len(may_contain(table, others)) < 100
    assert len(may_contain(np.zeros(4, np.uint64), mine)) == 0


def test_leaks_against_all_alignments(spark):
    rng = random.Random(3)
    items = [(i, [rng.choice(WORDS) for _ in range(rng.randrange(25, 90))]) for i in range(12)]
    docs = []
    for n in range(120):
        item = rng.choice(items)[1]
        size = rng.choice([20, 28, 29, 30, 31, 34, 40, 60])
        a = rng.randrange(max(1, len(item) - size + 1))
        part = list(item[a : a + size])
        for p in rng.sample(range(len(part)), min(len(part), rng.choice([0, 0, 1, 2, 3, 4, 6]))):
            part[p] = rng.choice(WORDS + ["other"])
        if rng.random() < 0.1:
            rng.shuffle(part)
        noise = lambda: [rng.choice(WORDS) for _ in range(rng.randrange(40))]
        docs.append((n, noise() + part + noise()))
    rows = [(n, " ".join(d), "x") for n, d in docs] + [(900, None, ""), (901, "", ""), (902, " ".join(items[0][1] * 400), "")]
    docs.append((902, items[0][1] * 400))
    want = {(n, i) for n, d in docs if n < 900 for i, w in items if leaks(d, w)} | {(902, i) for i, w in items if i == 0}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    its = spark.createDataFrame([(i, " ".join(w), "s") for i, w in items] + [(99, None, "s")], "item_id bigint, text string, doc_id string")
    for few in (10**6, 0):  # the items' side sent to the tasks, or split by hot keys
        got = [tuple(r) for r in find_leaks(df, its, few=few).collect()]
        assert {p for p in got if p[0] != 902 or p[1] == 0} == want and len(got) == len(set(got))
    assert find_leaks(df.limit(0), its).count() == 0 and find_leaks(df, its.limit(0)).count() == 0


# --- pieces --------------------------------------------------------------------------------------------------
def test_merging_weakest_first():
    assert merged([4, 4, 4, 4], [5, 2, 3, 2], 8) == [0, 2]
    assert merged([4, 4, 4], [5, 3, 1], 8) == [0, 1]
    assert merged([], [], 8) == [] and merged([9], [5], 8) == [0]


TEXTS = {
    "sections": "".join(f"== Part {i} ==\n" + "".join(f"Sentence {j} of part {i} tells a short story. " for j in range(12)) + "\n\n" for i in range(40)),
    "rows": "{|\n" + "".join(f"|-\n| {i} || name {i} || {i * i}\n" for i in range(900)) + "|}",
    "letters": "x" * 40_000,
    "japanese": "東京の川は長い。" * 900,
    "unbroken": "漢" * 5000,
    "emoji": "\U0001f469‍\U0001f680" * 1500,
    "spaces": "word" + " " * 9000 + "word" + "\n" * 5000,
}


@needs_vocabulary
@pytest.mark.parametrize("limit,overlap", [(2000, 100), (300, 0), (120, 40)])
def test_pieces(spark, limit, overlap):
    tok = tokenizer()
    rows = [(k, t, 1) for k, t in TEXTS.items()] + [("short", "tiny", 1), ("none", None, 1), ("empty", "", 1)]
    got = split_oversized(spark.createDataFrame(rows, "id string, text string, piece int"), item_id="id", text="text", limit=limit, overlap=overlap).collect()
    over = {k for k, t in TEXTS.items() if tok.count(t) > limit}
    assert {r.id for r in got} == over
    for k in over:
        pieces = sorted((r for r in got if r.id == k), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(pieces[0].n_pieces))
        assert "".join(TEXTS[k][r.body_start : r.end] for r in pieces) == TEXTS[k]
        for a, b in zip([None, *pieces], pieces):
            assert b.text == TEXTS[k][b.text_start : b.end]
            assert tok.count(b.text) == b.n_tokens <= limit
            if a:
                repeated = TEXTS[k][b.text_start : b.body_start]
                assert a.text.endswith(repeated) and (tok.count(repeated) >= overlap - 12 or a.text == repeated)
    if limit == 2000:
        text = TEXTS["sections"]
        assert all(text[r.body_start :].startswith("==") for r in got if r.id == "sections")
        assert all(TEXTS["rows"][: r.body_start].endswith("\n") for r in got if r.id == "rows" and r.piece)
        assert all(TEXTS["japanese"][: r.body_start].endswith("。") for r in got if r.id == "japanese" and r.piece)


@needs_vocabulary
def test_long_text_parts():
    tok = tokenizer()
    text = " ".join(f"word{i} and more" for i in range(60_000))
    assert tok.encode(text) == tok.encoding.encode_ordinary(text)
    import streamloom.llm.tokens as m

    rng, kept = random.Random(2), m.LONG
    m.LONG = 5
    try:
        small = m.Tokenizer(os.path.join(DIRECTORY, VOCABULARY))
        for _ in range(300):
            text = "".join(rng.choice(["a", "bc", "1", ".", " ", "\n", "\t", "      ", "\n\n\n\n\n\n", "\u3000" * 7, "é"]) for _ in range(30))
            assert small.encode(text) == small.encoding.encode_ordinary(text)
    finally:
        m.LONG = kept
    for text in ("a" + " " * 400_000 + "b", "\n" * 400_000, "漢" * 100_000):
        pieces = split_text(text, tok, 2000, 100)
        assert "".join(text[p[1] : p[2]] for p in pieces) == text and max(p[3] for p in pieces) <= 2000


# --- mixes ---------------------------------------------------------------------------------------------------
def test_rake():
    import numpy as np

    tokens = np.array([10.0, 20, 30, 40])
    w = rake(tokens, tokens * 10, [(np.array([0, 1, 0, 1]), np.array([30.0, 70])), (np.array([0, 0, 1, 1]), np.array([50.0, 50]))])
    assert w[:2].sum() == pytest.approx(50) and w[[0, 2]].sum() == pytest.approx(30, rel=1e-6)
    capped = rake(tokens, tokens, [(np.array([0, 0, 1, 1]), np.array([60.0, 40]))])
    assert (capped <= tokens + 1e-9).all() and capped[:2].sum() == pytest.approx(30)


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["big"] * 8 + ["Small ", "mid-size"]), rng.choice(["en", "de", None]), " ".join(["word"] * rng.randrange(5, 60)), 7) for i in range(4000)]
    docs += [(-1, None, "en", "x y", 7), (-2, "unlisted", "en", "x y", 7), (-3, "big", "en", None, 7), (-4, "big", "en", "", 7)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 3), ("mid_size", 0.2, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    args = {"doc_id": "doc_id", "text": "text", "source": "source", "language": F.col("lang"), "topic": F.lit("t"), "languages": ["en", "de"], "topics": ["t"]}
    chosen, report = mix_sources(df, targets, **args)
    rows = chosen.collect()
    caps = {"big": 1, "small": 3, "mid_size": 3}
    assert all(0 < r.repeats <= caps[r.source] and r.doc_id >= 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r.actual_share for r in report.collect()}
    for s, goal in (("big", 0.5), ("small", 0.25), ("mid_size", 0.2), ("absent", 0.0)):
        assert shares[s] == pytest.approx(goal / 0.95, abs=0.005)
    # a total beyond reach: every source is used up to its cap
    _, full = mix_sources(df, targets, total_tokens=1e12, **args)
    top = {r.source: r.n_tokens for r in full.collect()}
    sizes = {s: tokenizer() for s in caps}
    for s in caps:
        want = caps[s] * sum(sizes[s].count(t) for _, src, _, t, _ in docs if src and src.strip().lower().replace("-", "_") == s and t)
        assert top[s] == want
    nothing, none = mix_sources(df.limit(0), targets, **args)
    assert nothing.count() == 0 and {r.n_tokens for r in none.collect()} == {0}
