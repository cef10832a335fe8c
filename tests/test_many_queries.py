"""Queries too many to broadcast stay in blocks: rankings and totals as the general way gives them."""

import random
from dataclasses import replace

import numpy as np
import pytest

from rankspark.operators import batch
from rankspark.operators import search as S
from rankspark.plans import queries as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Frequent and rare words, exact copies, repeated document ids and turns, a null text, a turn without words."""
    rng, where = random.Random(5), tmp_path_factory.mktemp("tables")
    words = [f"w{i}" for i in range(200)]
    share = [1 / (1 + i) for i in range(200)]
    texts = [" ".join(rng.choices(words, share, k=rng.randrange(1, 40))) for _ in range(700)] + ["w3 w5 w190"] * 60
    documents = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:50])] + [(900, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    turns = [(i // 3, i % 3, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(90)]
    turns += [turns[0], (50, 0, "!"), (50, 1, "w3 w190 nosuch"), (50, 2, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{where}/conversations.parquet")
    return str(where)


@pytest.fixture()
def general(spark, tables):
    collection = Q.shared_index(spark, tables).collection()
    return collection, replace(Q.turn_queries(spark, tables), small=False)


@pytest.fixture()
def chunked(monkeypatch, general):
    def never(*args, **kwargs):
        raise AssertionError("every pair of query and posting becomes a row")

    def start():
        monkeypatch.setattr(S, "measured_small", lambda *args: False)
        monkeypatch.setattr(S, "scores", never)
        monkeypatch.setattr(batch, "CHUNK_ROWS", 400)

    return start


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cells", [8_000_000, 5_000])
def test_rankings(spark, tables, general, chunked, monkeypatch, cells):
    want = rows_of(Q._six(S.search(*general, Q.K), "score"))
    chunked()
    monkeypatch.setattr(batch, "BLOCK_CELLS", cells)
    monkeypatch.setattr(batch, "BLOCK_PAIRS", cells)
    assert len(want) > 800
    assert rows_of(Q.bm25_topk_blocks(spark, tables)) == want


def test_totals(spark, tables, general, chunked):
    want = rows_of(Q._six(S.totals(S.scores(*general), general[1]), "max_score"))
    chunked()
    assert len(want) == 93 and ("50-0", 0, None) in want
    assert rows_of(Q.total_hits_blocks(spark, tables)) == want


def test_chunks_meet_the_documents_together(spark, tables, general, chunked, monkeypatch):
    want = rows_of(Q._six(S.search(*general, Q.K), "score"))
    runs, run = [], batch.Blocks.numbered
    chunked()
    monkeypatch.setattr(batch.Blocks, "numbered", lambda self, *args: runs.append(len(self.shared)) or run(self, *args))
    # Blocks that are cut and put together, and every way to add up pairs.
    monkeypatch.setattr(batch, "BLOCK_POSTINGS", 700)
    monkeypatch.setattr(batch, "FEW_POSTINGS", 3)
    monkeypatch.setattr(batch, "GROUPS", 16)
    assert rows_of(Q.bm25_topk_blocks(spark, tables)) == want
    assert len(runs) < sum(runs)


def test_blocks_hold_every_posting_once():
    n = np.array([3, 1, 9, 2, 2, 2])
    row, term = np.repeat(np.arange(6, dtype=np.int32), n), np.arange(n.sum(), dtype=np.int32)
    whole = batch.Documents(np.arange(6) + 10, row, term, term / 2)
    parts = [batch.Documents(d, r, t, s) for d, r, t, s in [(whole.doc_id[:2], row[:4], term[:4], term[:4] / 2), (whole.doc_id[2:], row[4:] - np.int32(2), term[4:], term[4:] / 2)]]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(batch, "BLOCK_POSTINGS", 5)
        blocks = list(batch.Documents.joined(iter(parts)))
    assert [len(b.doc_id) for b in blocks] == [2, 1, 2, 1]
    assert np.array_equal(np.concatenate([b.doc_id[b.row] for b in blocks]), whole.doc_id[row])
    assert np.array_equal(np.concatenate([b.term_no for b in blocks]), term)


def test_terms_too_many_to_broadcast(spark, tables, general, chunked, monkeypatch):
    want = rows_of(Q._six(S.totals(S.scores(*general), general[1]), "max_score"))
    chunked()
    monkeypatch.setattr(batch, "measured_small", lambda *args: False)
    assert rows_of(Q.total_hits_blocks(spark, tables)) == want
