"""Filter audit, hard negatives and SimHash against brute force: nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import audit, negatives, simhash, topk, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, part string, mask int, n int, at long, cut int, hi long, ghost string"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with columns that are named like the operators' own."""
    return spark.createDataFrame([(*r, "p", 7, 7, 7, 7, 7, "g") for r in rows], DOC)


def odd_rows():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n, extra="": " ".join(r.choices(words, k=n)) + extra
    rows = [(i, text(r.choice([3, 120, 150]), r.choice(["", " #", " ABCDEF" * 20])), r.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1], "en") for i in range(30)]
    rows += [rows[3]] * 3 + [(None, rows[3][1], "de"), (None, None, None), (None, "no id", "en")]
    return rows + [(200, None, "en"), (201, "", "fr"), (202, "\x00\x1c one\x0btwo é\U0001f600", "fr"), (-5, "word " * 30_000, "en"), (203, text(1_000), "en")]


def brute_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    found = Counter()
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        bits = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        found[i, lang or "", sum(b << k for k, b in enumerate(bits))] += 1
    return found


@pytest.mark.parametrize("held", [audit.HELD, 1])
def test_masks_equal_brute_force(spark, held, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(audit, "HELD", held)
    got = Counter()
    for r in audit.failures(documents(spark, rows).repartition(5)).collect():
        got[r.doc_id, r.part, r["mask"]] += r.n
    want = brute_masks(rows)
    assert got == want
    assert {r.doc_id for r in audit.repeats(documents(spark, rows)).collect()} == {i for i, _, m in want if m & 16}


def test_texts_of_one_fingerprint_are_told_apart():
    rows = [(7, 3, "a b", "en"), (7, 2, "c d", "en"), (7, 1, "a b", "de"), (7, 2, "c d", "fr"), (7, 9, "c d", "fr"), (7, None, "c d", "x")]
    routed = sorted(audit._local(rows), key=lambda x: x[0])
    got = {(i, p): m & audit.REPEAT for i, p, m, _ in audit._chained(routed)}
    assert got == {(3, "en"): 16, (1, "de"): 0, (2, "en"): 0, (2, "fr"): 0, (9, "fr"): 16, (None, "x"): 0}


def test_orders_equal_brute_force(spark):
    rows = odd_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 220, 2)] + [(4, 1, True), (None, 1, True)]
    marks = spark.createDataFrame([(i, q, int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, mask string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(documents(spark, rows), marks).collect()}
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t))
    masks, want, shapley = brute_masks(rows), {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in masks}:
            own = [(i, m, n) for (i, p, m), n in masks.items() if p == part]
            bits = [1 << "ABCDE".index(c) for c in order]
            for step, bit in enumerate(bits):
                gone = sum(bits[:step])
                here = [(i, n) for i, m, n in own if m & bit and not m & gone]
                shapley[part, order[step]] += sum(n for _, n in here)
                want[part, order, step + 1] = (
                    sum(n for _, m, n in own if not m & (gone | bit)), sum(n for _, n in here), sum(n for _, m, n in own if m & bit and m & gone),
                    sum(n for _, m, n in own if m == bit), sum(n for i, n in here if i in good), sum(n for i, n in here if i in toxic),
                )
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


VECTORS = "vec_id long, embedding array<float>, label int, rank string, norm string, score string"


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "r", "n", "s") for r in rows], VECTORS)


def brute_negatives(rows, low=30, high=90, k=5, most=10):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in whole:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    found = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m) for i, w, m in whole if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            in_ = [(i, -t) for t, i, m in scored if m != label and low * -s <= 100 * -t <= high * -s]
            found += [(a, p, n, i, -s, t) for n, (i, t) in enumerate(in_[:most], 1)]
    return sorted(found)


@pytest.mark.parametrize("case", ["plain", "norms differ", "repeated rows", "ties", "large", "lengths", "one label", "chunks", "unusable"])
def test_negatives_equal_brute_force(spark, case, monkeypatch):
    r = random.Random(6)
    vector = lambda n=6, m=1.0: [r.uniform(-m, m) for _ in range(n)]
    label = lambda: r.choice([0, 0, 0, 1, 2])
    rows = [(i, vector(), label()) for i in range(700)]
    if case == "norms differ":
        rows = [(i, vector(m=2.0 ** (i % 9)), label()) for i in range(700)]
        monkeypatch.setattr(vectors, "BLOCK", 16)
        monkeypatch.setattr(negatives, "BLOCK", 16)
    elif case == "repeated rows":
        rows += rows[:150] + [(100, vector(), 1), (200, vector(), None)]
    elif case == "ties":
        rows = [(i, [0.5] * (1 + i % 3), label()) for i in range(400)]
    elif case == "large":
        rows = [(i, vector(m=2e6), label()) for i in range(300)]
    elif case == "lengths":
        rows = [(i, vector(r.randint(0, 7)), label()) for i in range(400)]
    elif case == "one label":
        rows = [(i, vector(), 3) for i in range(300)]
    elif case == "chunks":
        monkeypatch.setattr(vectors, "CHUNK", 1)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    elif case == "unusable":
        rows += [(None, vector(), 1), (300, None, 1), (400, [None, 1.0], 1), (500, [math.nan], 1), (600, [math.inf], 1), (800, vector(), None), (900, vector(), 5)]
    got = negatives.hard_negatives(embeddings(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_scores_beyond_long_stand_at_its_limits(spark):
    rows = [(i, [3e38 * (-1) ** (i // 50), 3e38], i % 2) for i in range(0, 400, 50)]
    most = (1 << 63) - 1
    found = topk.top_k(embeddings(spark, rows), F.col("vec_id") % 50 == 0, 3).collect()
    assert len(found) == 24 and {r.score for r in found if r["rank"] == 1} == {most}
    mined = negatives.hard_negatives(embeddings(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert all(abs(r.positive_score) <= most + 1 and abs(r.negative_score) <= most + 1 for r in mined)


def test_short_blocks_are_left_out():
    """Blocks too short for the lower limits, or for the k-th score held, are not scored."""
    r = np.random.default_rng(1)
    block = lambda n, size: {"ids": np.arange(n, n + 20).tobytes(), "data": (r.random((20, 4)).round(2) * size // 1).tobytes(), "dim": 4, "cuts": np.ones(20).tobytes()}

    class Batch(list):
        to_pylist = list.copy

    anchors = [(np.array([900]), np.full((1, 4), 1000.0), np.array([[0.0, 0, 1_000_000]]))]
    scored = []

    def counting(q, x, real=vectors.products):
        scored.append(len(q) * len(x))
        return real(q, x)

    blocks = [Batch([block(0, 1000)]), Batch([block(20, 1000)]), Batch([block(40, 10)])]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(negatives, "products", counting)
        list(negatives._negatives(iter(blocks), anchors, 4, 10, 30, 90))
        assert scored == [20, 20, 0]  # the greatest score of the last is 40,000, the limit 300,000
        scored.clear()
        list(negatives._positives(iter(blocks), [(anchors[0][0], anchors[0][1], np.array([[1.0]]))], 4, 5))
        assert scored == [20, 20, 0]


def brute_print(text):
    votes, total = [0] * 128, 0
    for w in set(WORD.findall(text)):
        bits, weight = int(hashlib.md5(w.encode()).hexdigest(), 16), len(w).bit_length()
        total += weight
        for j in range(128):
            votes[j] += weight * (bits >> (127 - j) & 1)
    return "".join(str(int(2 * v > total)) for v in votes)


def brute_simhash(rows, radius):
    import xxhash

    mark = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64
    texts = sorted(((i is None, -(i or 0), mark(t or ""), t or "", i) for i, t, _ in rows), key=lambda x: x[:4])
    prints = [brute_print(x[3]) for x in texts]
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    found = []
    for k, (*_, t, i) in enumerate(texts):
        follow = (k + 1) % len(texts)
        half = len(t) // 2
        changed = t[: len(t) - half] + texts[follow][3][:half]
        near = [texts[m][4] for m in range(len(texts)) if apart(prints[k], prints[m]) <= radius]
        found.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f"{int(prints[k], 2):032x}", f"{int(brute_print(changed), 2):032x}", 1 - apart(prints[k], brute_print(changed)) / 128, 1 - apart(prints[k], prints[follow]) / 128, len(near) - 1, min((x for x in near if x is not None), default=None)))
    return found


def near_copies():
    """Long texts with a word or two changed, so that fingerprints differ by few bits."""
    r = random.Random(9)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(300)] = f"other{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words), "en"))
    return rows


@pytest.mark.parametrize("case", ["odd", "near", "salted", "hot ids", "no ids", "one row", "one text"])
def test_simhash_equals_brute_force(spark, case, monkeypatch):
    rows = {
        "odd": odd_rows(),
        "near": near_copies() + odd_rows()[:30],
        "salted": near_copies(),
        "hot ids": [(7, f"text {i} of one id", "en") for i in range(120)] + [(i, f"own {i}", "en") for i in range(40)],
        "no ids": [(None, f"text {i}", "en") for i in range(50)],
        "one row": [(3, "one row alone", "en")],
        "one text": [(i, "the same text", "en") for i in range(60)],
    }[case]
    if case == "salted":
        monkeypatch.setattr(simhash, "SHARED", 3)
    got = simhash.document_fingerprints(documents(spark, rows).repartition(3), 6)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_simhash(rows, 6), key=repr)


@pytest.mark.parametrize("radius", [4, 5, 7])
def test_every_pair_within_the_radius_is_found_once(spark, radius):
    r = random.Random(radius)
    centre = r.getrandbits(128)
    prints = {centre ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 8))) for _ in range(150)} | {r.getrandbits(128) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), 1, 1) for x in prints]
    got = simhash.within(spark.createDataFrame(rows, "hi long, lo long, n long, least long"), radius).collect()
    pairs = Counter(frozenset([(g.hi, g.lo), (g.other_hi, g.other_lo)]) for g in got)
    want = {frozenset([a[:2], b[:2]]) for a, b in itertools.combinations(rows, 2) if sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(a[:2], b[:2], strict=True)) <= radius}
    assert set(pairs) == want and set(pairs.values()) <= {1} and len(want) > 5


def test_a_radius_beyond_the_tables_is_an_error(spark):
    none = spark.createDataFrame([], "hi long, lo long, n long, least long")
    for radius in (-1, 3, 8):
        with pytest.raises(ValueError):
            simhash.within(none, radius)


def test_empty_tables(spark):
    none = documents(spark, odd_rows()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(none, labels).count() == 0
    assert simhash.document_fingerprints(none).count() == 0
    for rows in ([], [(1, [1.0], 1)]):
        assert negatives.hard_negatives(embeddings(spark, rows), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(embeddings(spark, [(100, [1.0], 1)]), F.col("vec_id") % 100 == 0).count() == 0
