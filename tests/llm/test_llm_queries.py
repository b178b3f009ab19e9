"""The queries of this subpackage over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_runs import brute

import __spark_entry__ as entry
from oracle import differences
from streamloom.llm.tokens import tokenizer

TABLES = os.environ.get("STREAMLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def run(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, TABLES).collect()]


@pytest.mark.parametrize("name", ["p1_found", "p1_collapsed", "p3_found", "p3_matched"])
def test_sql(spark, name):
    assert not differences(entry.queries()[name](spark, TABLES), entry.oracle_sql()[name], TABLES)


def test_runs(spark):
    rows = duckdb.sql(f"SELECT seq, ticker, time, bid, bidDepth, ask, askDepth FROM '{TABLES}/quotes.parquet'").fetchall()
    tick = dict(duckdb.sql(f"SELECT ticker, tick FROM '{TABLES}/instruments.parquet'").fetchall())
    assert set(run(spark, "p1_found")) == {r[:3] for r in brute(rows, tick, 2)}
    kept = duckdb.sql(f"SELECT count(*) FROM (SELECT DISTINCT ticker, time, bid, bidDepth, ask, askDepth FROM '{TABLES}/quotes.parquet')").fetchall()[0][0]
    assert sum(r[4] for r in run(spark, "p1_collapsed")) == kept


def test_pieces(spark):
    tok = tokenizer()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet' WHERE text IS NOT NULL").fetchall())
    over = {d for d, t in texts.items() if tok.count(t) > 2000}
    assert {r[0] for r in run(spark, "p8_found")} == over
    pieces = entry.queries()["p8_pieces"](spark, TABLES).orderBy("doc_id", "piece").collect()
    joined = {}
    for r in pieces:
        joined[r.doc_id] = joined.get(r.doc_id, "") + texts[r.doc_id][r.body_start : r.end]
        assert tok.count(r.text) <= 2000
    assert joined == {d: texts[d] for d in over}


def test_mix(spark):
    targets = {r[0]: r[1:] for r in duckdb.sql(f"SELECT source, target_share, max_repeats FROM '{TABLES}/mix_targets.parquet'").fetchall()}
    chosen = run(spark, "p7_mix")
    assert len({r[0] for r in chosen}) == len(chosen) and all(0 < r[3] <= targets[r[1]][1] for r in chosen)
    shares = {r.source: r for r in entry.queries()["p7_shares"](spark, TABLES).collect()}
    assert set(shares) == set(targets) and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    tokens = {s: sum(r[2] * r[3] for r in chosen if r[1] == s) for s in targets}
    assert tokens == {s: r.n_tokens for s, r in shares.items()}
    there = sum(targets[s][0] for s in targets if tokens[s])
    for s, r in shares.items():  # within the largest document
        if tokens[s]:
            assert abs(r.actual_share - targets[s][0] / there) <= max(x[2] for x in chosen) / sum(tokens.values()) + 0.01


def test_languages(spark):
    rows = entry.queries()["p7_languages"](spark, TABLES).collect()
    assert sum(r.actual_share for r in rows) == pytest.approx(1) and {r.language for r in rows} <= {"en", "de", "es", "ja", "other"}


def test_leaks(spark):
    """Every pair has a shared stretch of seven words, the least that a passage must have."""
    from streamloom.llm.contamination import word_lists

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{TABLES}/eval_items.parquet'").fetchall())
    grams = lambda t: {tuple(w[i : i + 7]) for w in word_lists(t, 30) for i in range(len(w) - 6)}
    of_items = {i: grams(t) for i, t in items.items()}
    found = set(run(spark, "p6_found"))
    assert found and all(grams(texts[d]) & of_items[i] for d, i in found)
    # whole items that stand in a text word for word are all found
    joined = {i: " ".join(word_lists(t, 30)[0]) for i, t in items.items() if word_lists(t, 30)}
    whole = {(d, i) for d, t in texts.items() for w in word_lists(t, 30) for i, x in joined.items() if x in " ".join(w)}
    assert whole <= found
