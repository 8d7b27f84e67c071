"""Searches of many queries: bounds leave most documents alone and change no result; queries are planned once."""

import random

import numpy as np

from quarryline.operators import lexical, lexical_scan
from quarryline.plans import planner_queries


def _pieces(rng, documents, tokens):
    docs = [sorted({int(tokens * rng.random() ** 3) for _ in range(rng.randrange(0, 12))}) for _ in range(documents)]
    docs[7] = docs[3]  # equal scores go to the smaller id
    doc = np.repeat(np.arange(documents), [len(d) for d in docs])
    token = np.array([t for d in docs for t in d], np.int64)
    return np.arange(documents)[::-1] * 3, np.array([len(d) for d in docs]), doc, token, np.array([1.0 + t % 3 for t in token]), np.ones(documents, bool)


def test_window_gives_what_all_scores_give():
    rng = random.Random(5)
    pieces = [_pieces(rng, 90, 60) for _ in range(3)]
    pieces = [(p[0] + 1000 * i, *p[1:]) for i, p in enumerate(pieces)]
    window = lexical_scan._Window(pieces, 70, 5.0, 1.5, 0.75)
    docs = np.repeat(np.arange(270), np.diff(window.first))
    for _ in range(200):
        ts = np.array(rng.sample(range(70), rng.randrange(1, 9)))
        ws = np.array([rng.random() * 5 + 0.01 for _ in ts])
        weight = np.zeros(70)
        weight[ts] = ws
        every = np.round(np.bincount(docs, weight[window.token] * window.part, 270), 6)
        want = sorted((-s, d) for s, d in zip(every.tolist(), window.ids.tolist()) if s > 0)
        for least in (-np.inf, *(-w[0] for w in want[:6:5])):
            ids, scores = window.best(ts, ws, 5, least)
            got = sorted((-round(s, 5), d) for s, d in zip(scores.tolist(), ids.tolist()))
            assert got == [(round(s, 5), d) for s, d in want[:5] if -s >= least - 1e-6]


def test_frequent_tokens_are_not_looked_up(monkeypatch):
    n = 5000
    doc, token = np.concatenate([np.arange(n), np.arange(10)]), np.concatenate([np.zeros(n, np.int64), np.ones(10, np.int64)])
    order = np.lexsort((token, doc))
    piece = np.arange(n), np.full(n, 2), doc[order], token[order], np.ones(n + 10), np.ones(n, bool)
    window = lexical_scan._Window([piece], 2, 2.0, 1.5, 0.75)
    asked, sums = [], window._sums
    monkeypatch.setattr(window, "_sums", lambda ts, ws: asked.append(ts.tolist()) or sums(ts, ws))
    ids, scores = window.best(np.array([0, 1]), np.array([0.1, 9.0]), 5, 9.05)
    assert ids.tolist() == [0, 1, 2, 3, 4] and np.allclose(scores, 9.1) and asked == [[1]]


def test_weights_of_zero_and_less_are_not_bounded():
    batch = lexical_scan.Batch([1, 2, 3], [[0, 1], [1, 2], [2]], [[1.0, 2.0], [1.0, -1.0], [0.0]], 2.0, 3, None, True)
    assert batch.bounded.tolist() == [0] and batch.tokens.tolist() == [0, 1] and [(b[0], b[1], b[3].tolist()) for b in batch.blocks] == [(0, 3, [0, 1, 1])]


def test_turns_are_planned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lexical, "search", lambda queries, docs, k: seen.append(queries) or docs)
    planner_queries.search(spark, "/root/testdata/sf0.001")
    files = seen[0].inputFiles()
    assert seen[0].count() > 0 and not any("conversations" in f for f in files)
