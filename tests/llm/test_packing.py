import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from polyquarry.llm import packing as p

needs_tokenizer = pytest.mark.skipif(not Path(p.TOKENIZER).exists(), reason="no vocabulary here")


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in enumerate(histogram) if n)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        h = np.zeros(13, dtype=np.int64)
        for _ in range(rng.randrange(1, 9)):
            h[rng.randrange(1, 13)] += rng.randrange(1, 9)
        sizes = np.flatnonzero(h).tolist()
        for k in (1, 2, 3):
            best = min(padding(h, c) for r in range(1, k + 1) for c in itertools.combinations(sizes, min(r, len(sizes))) if c[-1] == sizes[-1])
            assert padding(h, p.boundaries(h, k)) == best
    assert p.boundaries(np.zeros(5, dtype=np.int64)) == []


def test_plan_places_every_rank_within_capacity():
    rng = random.Random(4)
    for _ in range(30):
        h = np.zeros(101, dtype=np.int64)
        for _ in range(60):
            h[rng.randrange(1, 101)] += rng.randrange(1, 20)
        plan = p.plan(h, 100, 12)
        load, edges = {}, [-1, *plan.bounds]
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            n = int(h[lo + 1 : hi + 1].sum())
            for c in plan.place(np.full(n, b), np.arange(n)):
                load[c] = load.get(c, 0) + hi
        assert max(load.values()) <= 100 and set(load) == set(range(plan.containers))


def test_every_piece_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 7, 500, 1024, 2048, rng.randrange(1, 2049)]), "c") for i in range(3000)] + [(10_000 + i, 333, "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, bucket string").repartition(7)
    out = p.pack_sizes(df).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((a, b) for a, b, _ in rows)
    load = {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048 and sum(load.values()) / (2048 * len(load)) > 0.9
    assert p.pack_sizes(df.limit(0)).count() == 0


@needs_tokenizer
def test_texts(spark):
    texts = [None, "", "one two", "word " * 5000, "日本語のテキスト", "one two"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = p.pack(df).collect()
    e = p.encoding(p.TOKENIZER)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, 2, 3, 4, 5}
    for i, pieces in got.items():
        assert sum(r.n_tokens for r in pieces) == len(e.encode_ordinary(texts[i])) and {r.n_pieces for r in pieces} == {len(pieces)}
    assert len(got[3]) == 3 and p.fill(p.pack(df)).first().fullest <= 2048
