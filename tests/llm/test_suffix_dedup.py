from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from incident_analytics.llm import _repeats, suffix_dedup

from .conftest import EDGE


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                gone[k:k + width] = [True] * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((*r[:5], bytes(r["text"])) for r in suffix_dedup.remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_deep_shallow_order(seed):
    r = np.random.default_rng(seed)
    n, length = int(r.integers(1, 200)), int(r.integers(9, 60))
    strings = r.integers(0, 3, (5, length)).astype(np.uint8)[r.integers(0, 5, n)]
    for i in range(n):
        if r.random() < 0.6:
            strings[i, r.integers(0, length):] = r.integers(0, 3)
    group = r.integers(0, 4, n)
    order = _repeats.deep_shallow_order(strings, group, int(r.integers(0, 40)))
    assert sorted(order.tolist()) == list(range(n))
    sorted_rows = [(group[i], strings[i].tobytes()) for i in order]
    assert sorted_rows == sorted(sorted_rows)


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000), dtype=np.uint8)
    monkeypatch.setattr(_repeats, "STEP", 700)
    keys, first, last, place = _repeats.anchors(data, 60, 12)
    assert first[0] == 0 and last[-1] == len(data) - 60 and (first[1:] == last[:-1] + 1).all()
    monkeypatch.setattr(_repeats, "STEP", 1 << 16)
    whole = _repeats.anchors(data, 60, 12)
    by_start = {s: (k, p) for k, a, b, p in zip(*whole, strict=True) for s in range(a, b + 1)}
    assert all(by_start[s] == (k, p) for k, a, b, p in zip(keys, first, last, place, strict=True) for s in range(a, b + 1))


def corpus(seed, letters="abc ", size=40):
    r = random.Random(seed)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 160))) for _ in range(size)]
    texts += [r.choice(texts) for _ in range(size // 3)]                     # copies
    for _ in range(size // 2):                                               # near copies and shared passages
        t = r.choice(texts)
        k = r.randint(0, len(t))
        texts.append(t[:k] + r.choice(["é", "漢", "x"]) + t[k + 1:])
        u = r.choice(texts)
        texts.append(u[:k] + t[k // 2:k // 2 + 40] + u[k:])
    texts += ["ab" * 60, "a" * 90, "a" * 19, "a" * 20]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, make_docs, seed):
    rows = corpus(seed)
    df = make_docs(rows).repartition(5)
    assert run(df, width=20, gram=4) == brute(rows, 20)


def test_large_keys_are_halved(make_docs):
    """With at most one block a key in a task every key is split down to single windows."""
    rows = corpus(7, size=12)
    assert run(make_docs(rows), width=20, gram=4, key_rows=1) == brute(rows, 20)
    assert run(make_docs(rows), width=20, gram=4, key_rows=3) == brute(rows, 20)


def test_two_hundred_bytes(make_docs):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    word = lambda n: "".join(r.choice("stuvw é") for _ in range(n))
    rows = [(1, word(300) + passage + word(90)), (2, word(40) + passage[:200] + word(40)), (3, word(40) + passage[1:199] + word(9)),
            (4, passage + word(10) + passage), *[(10 + i, passage[i:] + word(50) + passage[:i]) for i in range(0, 40, 7)],
            (90, passage), (90, passage), (91, "same short text"), (92, "same short text")]
    assert run(make_docs(rows)) == brute(rows, 200)


def test_edge_rows(edge_docs, no_docs):
    assert run(edge_docs) == brute(EDGE, 200)
    assert run(no_docs) == []
    assert suffix_dedup.remove_repeats(no_docs, texts=False).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
