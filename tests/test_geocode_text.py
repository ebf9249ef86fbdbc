"""Free-text addresses: words of an address, and lookup against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from incident_analytics.functions.text import address_words
from incident_analytics.operators import geocode

STREETS = ["BROAD ST", "BOARD ST", "PIKE ST", "PINE ST", "MADISON AVE", "RAINIER AVE S", "E UNION ST", "MLK JR WAY S", "NE 45TH ST"]


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = [(f"{n}XX BLOCK OF {s}", 47.0 + k / 100, -122.0 - n / 100, (k * 7 + n) % 5, f"{n} {s}")
            for k, s in enumerate(STREETS) for n in (0, 1, 4, 12)]
    rows += [("PIKE ST / 3RD AVE", 1.0, 2.0, 1, "corner"), ("4XX BLOCK OF BROAD ST", 9.0, 9.0, 9, "more hits"), (None, 0.0, 0.0, 1, "null")]
    return spark.createDataFrame(rows, "address STRING, lat DOUBLE, lon DOUBLE, hits INT, display_name STRING").cache()


def test_words(spark):
    texts = {"400 Broad St, Seattle": ["4xx", "broad", "street"], "4XX BLOCK OF BROAD ST": ["4xx", "broad", "street"],
             "broad street 412 #7": ["4xx", "broad", "street"], "7 N Pike": ["0xx", "north", "pike"], "0XX BLOCK OF PIKE ST": ["0xx", "pike", "street"],
             "12345 Lake Ave, WA 98101": ["123xx", "avenue", "lake"], "Pike St / 3rd Ave": ["3rd", "avenue", "pike", "street"],
             "": [], " - , ": [], None: None, "1999999999999999999999 x": ["1999999999999999999999", "x"]}
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", address_words(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == texts


def typo(a, b):
    """One letter missing, added, changed or moved, by trying all."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [a[:i] + a[i + 1:] for i in range(len(a))]
    near = {a, *cuts, *(a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters),
            *(a[:i] + c + a[i + 1:] for i in range(len(a)) for c in letters),
            *(cut[:j] + a[i] + cut[j:] for i, cut in enumerate(cuts) for j in range(len(cut) + 1))}
    return b in near


def find(words, entries):
    """The best entry by looking at each."""
    best = []
    for g, hits, name in entries:
        p, q = sorted(set(words) - set(g)), sorted(set(g) - set(words))
        one = len(p) == len(q) == 1 and all(len(w[0]) > 2 and w[0].isalpha() for w in (p, q)) and typo(p[0], q[0])
        if words and g and (p == q == [] or one):
            best.append((len(p), -hits, name))
    return min(best)[::2] if best else (None, None)


def test_lookup_equals_all_pairs(spark, gazetteer):
    r = random.Random(11)
    texts = ["400 Broad St Seattle", "Madison avenue 1201", "412 broda st", "3rd ave & PIKE street, seattle", "412 nowhere st", None, "", "xx", "412 brd st", "413 boad st"]
    for _ in range(500):
        words = f"{r.choice([3, 104, 455, 1299, 900])} {r.choice(STREETS).lower()}".split()
        k = r.randrange(len(words))
        w, at = list(words[k]), r.randrange(len(words[k]))
        edit = r.randrange(5)
        if edit == 0:
            del w[at]
        elif edit == 1:
            w.insert(at, r.choice("abkz"))
        elif edit == 2:
            w[at] = r.choice("abkz")
        elif edit == 3:
            w.insert(r.randrange(len(w)), w.pop(at))
        words[k] = "".join(w)
        r.shuffle(words)
        texts.append(" ".join(words))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, address STRING").repartition(5)
    got = {x["id"]: (x["typos"], x["display_name"]) for x in geocode.geocode_text(asked, gazetteer).collect()}
    assert len(got) == len(texts)
    entries = [(x["w"], x["hits"], x["display_name"]) for x in
               gazetteer.select(address_words(F.col("address")).alias("w"), "hits", "display_name").collect() if x["w"]]
    words = {x["id"]: x["w"] for x in asked.select("id", address_words(F.col("address")).alias("w")).collect()}
    assert got == {i: find(words[i] or [], entries) for i in got}
    assert got[0] == (0, "more hits") and got[1] == (0, "12 MADISON AVE") and got[3] == (0, "corner") and got[5] == (None, None)
    assert sum(t == 1 for t, _ in got.values()) > 60


def test_repeated_long_and_empty(spark, gazetteer):
    long = "400 " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)) + " broad st"
    asked = spark.createDataFrame([("400 broad st",)] * 40 + [(long,)], "address STRING")
    got = geocode.geocode_text(asked, gazetteer).groupBy("typos").count().collect()
    assert {r["typos"]: r["count"] for r in got} == {0: 40, None: 1}
    assert geocode.geocode_text(asked.limit(0), gazetteer).count() == 0
    assert geocode.geocode_text(asked, gazetteer.limit(0)).where("typos IS NOT NULL").count() == 0
