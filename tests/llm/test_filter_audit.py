from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from incident_analytics.llm import filter_audit

from .conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """rows: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marks = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        smaller = [j for j, u, _ in rows if (u or "") == t and j is not None and i is not None and j < i]
        bits = ("A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
                + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
                + "D" * any(c in "#$%&*|" for c in t) + "E" * bool(smaller))
        marks.append((lang or "", bits, i in good, i in toxic))
    out = []
    for part in {m[0] for m in marks}:
        mine = [m[1:] for m in marks if m[0] == part]
        shapley: dict[str, int] = {}
        table = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [m for m in mine if f in m[0] and not before & set(m[0])]
                shapley[f] = shapley.get(f, 0) + len(here)
                table.append([part, "".join(order), k + 1, sum(not (before | {f}) & set(m[0]) for m in mine), len(here),
                              sum(f in m[0] and bool(before & set(m[0])) for m in mine), sum(m[0] == f for m in mine),
                              sum(m[1] for m in here), sum(m[2] for m in here), f])
        out += [(*row[:-1], shapley[row[-1]]) for row in table]
    return sorted(out)


def random_rows(seed):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        n = r.choice([0, 3, 99, 100, 140])
        t = " ".join(r.choice([f"w{k}" for k in range(r.choice([40, 400]))]) for _ in range(n))
        t += r.choice(["", "", " #", "|", " " + "X" * r.choice([1, 9, 40, 200])])
        rows.append((i, t, r.choice(["en", "de", "", None])))
    for _ in range(25):
        rows.append((r.choice([None, *range(100)]), r.choice(rows)[1], r.choice(["en", "de", None])))
    rows += [rows[5], rows[5], (None, None, None), (3, None, "en"), (2, "", "fr")]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_audit(spark, seed):
    rows = random_rows(seed)
    r = random.Random(seed)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 80, 2), 4, 4, None]]
    docs = spark.createDataFrame([(i, t, g, "x", "y") for i, t, g in rows],
                                 "doc_id LONG, text STRING, lang STRING, part STRING, key STRING").repartition(6)
    table = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    assert sorted(map(tuple, filter_audit.audit(docs, table).collect())) == brute(rows, labels)


def test_edge_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert sorted(map(tuple, filter_audit.audit(edge_docs, none).collect())) == brute([(i, t, "en") for i, t in EDGE], [])
    assert filter_audit.audit(no_docs, none).count() == 0
