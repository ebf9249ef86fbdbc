"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Generators propose overlapping spans of high recall: the four base kinds with
and without their checks, keyed secrets, access keys, numbers with separators,
long codes. Gradient-boosted trees score a candidate by its format (digits,
letters, separators, lengths, entropy) and its context (the word before, the
characters around). They learn from weak labels of the corpus itself, on all its
distinct candidates, of which half the spans calibrate. A base kind is labelled by its check (octets, Luhn, digit counts). A number is personal if
grouped as a national phone or an identity number or after a cue word, and not
if it is a date, version, amount or dotted number; a code is a secret after a
secret's key or with the prefix of an access key, and not after any other key,
as digits alone or as an unkeyed hash. The rest is not learnt from. Each kind's
threshold is the least multiple of ``1 / GRID`` that keeps ``PRECISION`` on the
calibration half; a kind without both labels there has ``UNCALIBRATED``.

Scale: candidates become their features' quantile bins, equal ones a row with
its number, and stay distributed. A level of a tree is one job over those rows
that sums gradients by node, feature and bin, a threshold one that counts by
score; the driver gets these sums, whose number does not grow with the rows.
Sums are of integers, so the trees do not depend on how rows are spread.

Base spans (e-mail, ip, card, phone) always stay; the trees add spans that do
not overlap one. Defined results: null and empty texts have no span; rows with
equal ids are searched each on its own; without any candidate the model adds
nothing; an empty table gives an empty result. All matching is linear in the
text: runs are matched possessively and e-mails from their ``@``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import sigmoid
from ._io import id_and_text, table, written
from ._ship import ship
from ._text import slices

PRECISION = 0.99
UNCALIBRATED = 0.99
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "number"]
ROUNDS, DEPTH, RATE, MIN_LEAF, BINS = 40, 3, 0.3, 10, 32
GRID = 1 << 13
SCALE = 2.0**24  # gradients and leaves are multiples of 1 / SCALE, so their sums are exact in any order
RUN = 1 << 14
SLICE_BYTES = 2 << 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CODE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{12,}+")
_KEY = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]*+)[\"']?+\s*+[=:]\s*+[\"']?+")
_KEY_PARTS = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]++")
_VALUE = re.compile(r"[^\s\"']*+")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)\x20++")
_SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "key", "auth", "authorization"}
_KEY_KINDS = {"api", "access", "secret", "private", "signing", "encryption", "auth", "account", "master", "license"}
_ACCESS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_HASH = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})")
_NATIONAL = re.compile(r"\(?[2-9][0-9]{2}(?:\)\x20?|[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}")
_IDENTITY = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
_CUES = {"phone", "telephone", "tel", "call", "mobile", "cell", "fax", "ssn", "contact", "whatsapp"}
_PLAIN = {"version", "v", "page", "section", "chapter", "nc", "sa", "release", "isbn", "invoice", "order", "usd", "eur"}
_NUMBER = re.compile(r"(?<![0-9+])\(?[0-9]++\)?(?:[\x20./-][0-9]++)+(?![0-9])")


def emails(text: str):
    """Leftmost non-overlapping e-mails, found from their at signs."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = at = found.end()
        else:
            done = at = at + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_candidates(text: str):
    """(kind, start, end, passes) of the base shapes."""
    if "@" in text:
        yield from (("email", a, b, True) for a, b in emails(text))
    if not any(c in text for c in "0123456789"):
        return
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), _octets(m[0])
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if len(d) > 8:
            yield "card", m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 10 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind as listed."""
    found = [(k, a, b) for k, a, b, ok in base_candidates(text) if ok]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _word_before(text: str, start: int) -> str:
    return (re.findall(r"[A-Za-z]+", text[max(0, start - 24):start])[-1:] or [""])[0].lower()


def _is_date(groups: list[str]) -> bool:
    if len(groups) != 3 or max(map(len, groups)) > 4:
        return False
    a, b, c = map(int, groups)
    year = [len(g) == 4 and 1000 <= int(g) <= 2999 for g in groups]
    return (year[0] and 1 <= b <= 12 and 1 <= c <= 31) or (
        (year[2] or len(groups[2]) == 2) and max(len(groups[0]), len(groups[1])) <= 2 and min(a, b) >= 1
        and min(a, b) <= 12 and max(a, b) <= 31)


def number_label(text: str, start: int, end: int) -> bool | None:
    """Personal (True), a date, version, amount or the like (False), or not known."""
    s, word = text[start:end], _word_before(text, start)
    groups = re.findall(r"[0-9]+", s)
    digits = sum(map(len, groups))
    if word in _PLAIN or text[max(0, start - 1):start] in ("$", "\u20ac", "\u00a3") or text[end:end + 1] in ("%", "\u20ac"):
        return False
    if _is_date(groups):
        return False
    if _NATIONAL.fullmatch(s) or _IDENTITY.fullmatch(s):
        return True
    if word in _CUES and 7 <= digits <= 15:
        return True
    if digits < 7 or (digits > 12 and not luhn(_digits(s))) or set(re.sub(r"[0-9]", "", s)) == {"."}:
        return False
    return None


def code_label(code: str) -> bool | None:
    """For a code without a key in front: access key (True), digits or a hash (False), or not known."""
    if _ACCESS.fullmatch(code):
        return True
    if code.isdigit():
        return None if luhn(code) else False
    return False if _HASH.fullmatch(code) else None


def key_label(key: str) -> bool | None:
    """Whether a key names a secret by its last word (``db_password``,
    ``AWS_SECRET_ACCESS_KEY``, ``clientSecret``); not known for other keys that
    end in ``key`` (``primary_key``)."""
    parts = [p.lower() for p in _KEY_PARTS.findall(key)]
    if not parts or parts[-1] not in _SECRET_WORDS:
        return False
    return True if parts[-1] != "key" or len(parts) == 1 or parts[-2] in _KEY_KINDS else None


def keyed_values(text: str):
    """(start, end, label) of values of six characters or more behind a key and
    ``=`` or ``:``; behind a scheme word (``Bearer``) the value is what follows
    it. A key inside a secret's value, or a plain key inside any value, has none
    of its own, so values are read at most twice."""
    secret_end = plain_end = 0
    for m in _KEY.finditer(text):
        label = key_label(m[1])
        if m.start() < (plain_end if label is False else secret_end):
            continue
        start = m.end()
        scheme = _SCHEME.match(text, start) if label else None
        start = scheme.end() if scheme else start
        end = _VALUE.match(text, start).end()
        if end - start >= 6:
            yield start, end, label
            plain_end = max(plain_end, end)
            if label is not False:
                secret_end = end


def candidates(text: str):
    """(kind, start, end, weak label) of all generators; a label of None is not learnt from."""
    yield from base_candidates(text)
    keyed = {}
    if "=" in text or ":" in text:
        for a, b, label in keyed_values(text):
            keyed[a, b] = label
        yield from (("secret", a, b, y) for (a, b), y in keyed.items())
    if any(c in text for c in "0123456789"):
        for m in _CODE.finditer(text):
            if m.span() not in keyed:
                inside = [y for (a, b), y in keyed.items() if a <= m.start() and m.end() <= b]
                yield "secret", m.start(), m.end(), (False if inside and not any(y is not False for y in inside)
                                                     else None if inside else code_label(m[0]))
        for m in _NUMBER.finditer(text):
            yield "number", m.start(), m.end(), number_label(text, m.start(), m.end())


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate (shares and entropy to three
    digits, so a feature has few values however many candidates there are)."""
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper = sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    before = text[max(0, start - 24):start]
    word = _word_before(text, start)
    groups = [len(p) for p in re.split(r"[^0-9]+", s) if p]
    changes = sum((a.isdigit() != b.isdigit()) for a, b in zip(s, s[1:], strict=False))
    return [KINDS.index(kind), n, digits, upper, lower, round(digits / n, 3), round(upper / n, 3), round(entropy, 3), changes,
            s.count("."), s.count("-"), s.count(" "), s.count("@"), s.count("("),
            float(before[-1:] == "+"), float(before[-1:] in ("=", '"', "'", ":")), float("=" in before[-4:]),
            float(word in _SECRET_WORDS or word in ("bearer", "basic")), float(word in _PLAIN),
            float(word in _CUES), float(before[-1:] in ("$", "\u20ac", "\u00a3")), s.count("/"), len(groups),
            *(groups + [0, 0, 0])[:3], groups[-1] if groups else 0, float(_is_date(re.findall(r"[0-9]+", s))),
            float(text[end:end + 1].isalnum()), float(before[-1:].isalnum()),
            max(groups, default=0)]


def _on_scale(x):
    return np.rint(x * SCALE) / SCALE


class BoostedTrees:
    """Small gradient boosting on the logistic loss: exact splits over quantile bins.

    Trees are complete, a row each of ``feature``, ``cut`` (by node, a level
    after the other; a node without a split sends all to its first child) and
    ``value`` (by leaf)."""

    def __init__(self, bias: float = 0.0):
        self.bias, nodes = bias, 2**DEPTH - 1
        self.feature, self.cut, self.value = np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, k], QUANTILES)) for k in range(x.shape[1])]
        bins, once = to_bins(x, edges), np.ones(len(y))
        return cls.boost(y.mean(), lambda model, tree, level: gradient_sums(model, tree, level, bins, y, once)).on_values(edges)

    @classmethod
    def boost(cls, share: float, sums) -> BoostedTrees:
        """Trees over bins; sums(model, tree, level): ``gradient_sums`` of all rows."""
        share = np.clip(share, 1e-3, 1 - 1e-3)
        model = cls(bias=float(_on_scale(np.log(share / (1 - share)))))
        for _ in range(ROUNDS):
            tree = _grow(lambda tree, level: sums(model, tree, level))  # noqa: B023
            model.feature, model.cut, model.value = (
                np.vstack([old, new]) for old, new in zip((model.feature, model.cut, model.value), tree, strict=True))
        return model

    def on_values(self, edges: list[np.ndarray]) -> BoostedTrees:
        """The same trees over the features' values."""
        model = BoostedTrees(self.bias)
        model.feature, model.cut, model.value = self.feature, self.cut.copy(), self.value
        for at in zip(*np.nonzero(np.isfinite(model.cut)), strict=True):
            model.cut[at] = edges[model.feature[at]][int(model.cut[at])]
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        tree, leaves = np.arange(len(self.value)), 2**DEPTH - 1
        total = np.full(len(x), self.bias)
        for lo in range(0, len(x), RUN):  # bounds the places of rows in all trees
            part = x[lo:lo + RUN]
            at = np.zeros((len(part), len(tree)), int)
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (part[row, self.feature[tree, at]] > self.cut[tree, at])
            total[lo:lo + RUN] += self.value[tree, at - leaves].sum(axis=1)
        return sigmoid(total)


QUANTILES = np.linspace(0, 1, BINS + 1)[1:-1]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(cuts, x[:, k], side="left") for k, cuts in enumerate(edges)], axis=1).astype(np.uint8)


def gradient_sums(model: BoostedTrees, tree: tuple, level: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of gradients, Hessians (on SCALE) and weights by node of the tree's level, feature and bin."""
    features, (feature, cut, _) = bins.shape[1], tree
    out = np.zeros((2**level * features * BINS, 3), dtype=np.int64)
    for lo in range(0, len(y), RUN):
        x, t, w = bins[lo:lo + RUN], y[lo:lo + RUN], weight[lo:lo + RUN]
        p, node = model.predict(x), np.zeros(len(x), int)
        for _ in range(level):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        cell = (((node - 2**level + 1)[:, None] * features + np.arange(features)) * BINS + x).ravel()
        each = np.rint((p - t) * SCALE) * w, np.rint(np.maximum(p * (1 - p), 1e-6) * SCALE) * w, w
        for k, v in enumerate(each):
            out[:, k] += np.bincount(cell, weights=np.repeat(v, features), minlength=len(out)).astype(np.int64)
    return out


def _grow(sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree (feature, cut as a bin, value) from sums(tree, level)."""
    feature, cut, value = tree = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
    leaf = lambda g, h: _on_scale(-RATE * g / (h + 1.0))
    for level in range(DEPTH):
        split, span = False, 2**(DEPTH - level)
        for j, node in enumerate(sums(tree, level).reshape(2**level, -1, BINS, 3)):
            gs, hs = (np.cumsum(node[:, :, c], axis=1) / SCALE for c in (0, 1))
            ns = np.cumsum(node[:, :, 2], axis=1)
            value[j * span:(j + 1) * span] = leaf(gs[0, -1], hs[0, -1])
            gain = (gs**2 / (hs + 1.0) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1.0)
                    - gs[:, -1:] ** 2 / (hs[:, -1:] + 1.0))
            gain[(ns < MIN_LEAF) | (ns[:, -1:] - ns < MIN_LEAF)] = 0.0
            k, c = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[k, c] > 1e-6:
                at, half, split = 2**level - 1 + j, j * span + span // 2, True
                feature[at], cut[at] = k, c
                value[j * span:half] = leaf(gs[k, c], hs[k, c])
                value[half:(j + 1) * span] = leaf(gs[k, -1] - gs[k, c], hs[k, -1] - hs[k, c])
        if not split:
            break
    return tree


def _cuts(counts: np.ndarray) -> dict:
    """Thresholds from the numbers of candidates and of true ones by kind and score on GRID."""
    cuts = {}
    for k, (n, hits) in enumerate(np.cumsum(counts[:, ::-1], axis=1).transpose(0, 2, 1)):
        good = np.flatnonzero((n > 0) & (hits >= PRECISION * n)) if 0 < hits[-1] < n[-1] else []
        cuts[k] = max(0.5, float((GRID - good[-1]) / GRID)) if len(good) else UNCALIBRATED
    return cuts


def _score_counts(model: BoostedTrees, kind: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of all and of true candidates by kind and score on GRID."""
    out = np.zeros((len(KINDS) * (GRID + 1), 2), dtype=np.int64)
    for lo in range(0, len(y), RUN):
        part = slice(lo, lo + RUN)
        cell = kind[part] * (GRID + 1) + (model.predict(x[part]) * GRID).astype(np.int64)
        for c, w in enumerate((weight[part], weight[part] * y[part])):
            out[:, c] += np.bincount(cell, weights=w, minlength=len(out)).astype(np.int64)
    return out


def _added(rows: DataFrame, size: int, width: int, made) -> np.ndarray:
    """The sum over all rows of made(kind, bins, y, weight), an integer array of this size and width."""
    names = [f"v{c}" for c in range(width)]

    def run(batches):
        total = np.zeros((size, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                kind, y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "y", "n"))
                total += made(kind.astype(np.int64), bins, y.astype(float), n.astype(float))
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, c]) for c in range(width)]],
                                         names=["cell", *names])

    cells = rows.mapInArrow(run, "cell INT, " + ", ".join(f"{c} LONG" for c in names)).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((size, width), dtype=np.int64)
    out[cells.column("cell").to_numpy()] = np.stack([cells.column(c).to_numpy() for c in names], axis=1)
    return out


def _binned(pool: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(kind, y, learn, bins, n): equal candidates once, with their number."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                bins = pa.array([row.tobytes() for row in to_bins(x, edges)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "y", "learn")], bins],
                                                 names=["kind", "y", "learn", "bins"])
    made = pool.select("kind", "y", "learn", "x").mapInArrow(run, "kind INT, y BOOLEAN, learn BOOLEAN, bins BINARY")
    return made.groupBy("kind", "y", "learn", "bins").agg(F.count(F.lit(1)).alias("n"))


def _train_all(pool: DataFrame) -> dict | None:
    pool = written(pool, "pii-candidates")
    learn = F.col("learn")
    size = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if(learn).alias("learn"), F.count_if(learn & F.col("y")).alias("true"),
                    F.max(F.size("x")).alias("features")).first()
    if size["n"] < 4 * MIN_LEAF or size["learn"] < 2 * MIN_LEAF or size["learn"] == size["n"]:
        return None
    features = size["features"]
    got = pool.where(learn).agg(*[F.percentile(F.col("x")[k], QUANTILES.tolist()).alias(f"q{k}") for k in range(features)]).first()
    edges = [np.unique(got[k]) for k in range(features)]
    rows = written(_binned(pool, edges), "pii-bins", drop=[pool])

    def sums(model, tree, level):
        return _added(rows.where(learn), 2**level * features * BINS, 3,
                      lambda kind, bins, y, n: gradient_sums(model, tree, level, bins, y, n))

    model = BoostedTrees.boost(size["true"] / size["learn"], sums)
    counts = _added(rows.where(~learn), len(KINDS) * (GRID + 1), 2,
                    lambda kind, bins, y, n: _score_counts(model, kind, bins, y, n))
    return {"trees": model.on_values(edges), "cuts": _cuts(counts.reshape(len(KINDS), GRID + 1, 2))}


def train(docs: DataFrame, sample: int | None = None, seed: int = 3) -> dict | None:
    """Trees and per-kind thresholds from the corpus's own weak labels. Only a
    trial run names a sample: that many candidates, drawn in seeded hash order."""
    ship(docs.sparkSession)

    def run(batches):
        for part in _parts(batches, "text"):
            for text in part.column("text"):
                text = text.as_py()
                rows = [(KINDS.index(k), bool(y), describe(text, k, a, b), text[a:b]) for k, a, b, y in candidates(text)
                        if y is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                         pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.string())],
                        names=["kind", "y", "x", "span"])

    # copies of a candidate count once; all candidates of one span are on one side
    pool = docs.mapInArrow(run, "kind INT, y BOOLEAN, x ARRAY<DOUBLE>, span STRING").distinct().withColumn(
        "learn", F.xxhash64(F.lit(seed + 1), "span") % 2 == 0)
    if sample is None:
        return _train_all(pool.select("kind", "y", "x", "learn"))
    draw = F.xxhash64(F.lit(seed), "span", "x")
    got = pool.orderBy(draw, "kind", "y", "x").limit(sample).select("kind", "y", "x", "learn").toArrow()
    if got.num_rows < 4 * MIN_LEAF:
        return None
    x, y = np.array(got.column("x").to_pylist()), got.column("y").to_numpy(zero_copy_only=False).astype(float)
    kind = got.column("kind").to_numpy().astype(np.int64)
    learn = got.column("learn").to_numpy(zero_copy_only=False)
    if learn.sum() < 2 * MIN_LEAF or learn.all():
        return None
    model = BoostedTrees.fit(x[learn], y[learn])
    counts = _score_counts(model, kind[~learn], x[~learn], y[~learn], np.ones((~learn).sum()))
    return {"trees": model, "cuts": _cuts(counts.reshape(len(KINDS), GRID + 1, 2))}


def find(text: str, model: dict | None) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and those the trees add, by start, then kind."""
    base = base_spans(text)
    extra = []
    if model:
        proposed = sorted({(k, a, b) for k, a, b, _ in candidates(text)}.difference(base), key=lambda s: (s[1], s[2], s[0]))
        if proposed:
            p = model["trees"].predict(np.array([describe(text, *c) for c in proposed]))
            taken = [(a, b) for _, a, b in base]
            for i in np.argsort(-p, kind="stable"):
                k, a, b = proposed[i]
                # the base shapes have exact checks, which the trees do not overrule
                if k not in BASE_KINDS and p[i] >= model["cuts"][KINDS.index(k)] and all(b <= x or y <= a for x, y in taken):
                    # a part of a value must not keep the whole value out
                    a, b = max(((x, y) for j, (o, x, y) in enumerate(proposed)
                                if o == k and x <= a and b <= y and p[j] >= model["cuts"][KINDS.index(k)]
                                and all(y <= u or v <= x for u, v in taken)), key=lambda s: s[1] - s[0])
                    extra.append((k, a, b))
                    taken.append((a, b))
    return base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def _parts(batches, text: str):
    """Slices of the batches; at the end an idle worker gives unused memory back."""
    for batch in batches:
        yield from slices(batch, text, SLICE_BYTES)
    pa.default_memory_pool().release_unused()


def find_spans(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, base, spans): spans as arrays of (kind, start, end), in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for part in _parts(batches, "text"):
            found = [find(t.as_py(), model) for t in part.column("text")]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in both] for both in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)],
                names=["doc_id", "base", "spans"])

    span = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>"
    return docs.mapInArrow(run, f"doc_id LONG, base {span}, spans {span}")


def redact(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; null
    texts stay null, and texts without a span are unchanged."""
    ship(docs.sparkSession)
    schema = docs.schema
    where = docs.columns.index(text)

    def run(batches):
        for part in _parts(batches, text):
            out = []
            for t in part.column(where):
                t, at, parts = t.as_py(), 0, []
                for k, a, b in find(t, model)[1] if t else []:
                    if a >= at:
                        parts += [t[at:a], f"[{k}]"]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield part.set_column(where, part.schema.field(where), pa.array(out, part.schema.field(where).type))
    return docs.mapInArrow(run, schema)


def _digest(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    found = find_spans(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_digest("base"), 256).alias("base_sha256"),
                        _digest("spans").alias("spans"))
