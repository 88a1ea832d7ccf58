"""Clashing names, repeated rows, distances and cut points that a text's start must not move."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import bpe, common, minhash, quality, secrets, topk, toxicity, vectors
from tests.llm.test_operators import components

NAMES = "kept n_words assign access hex login key40 endpoint _text _low _hidden _m _group row bucket size tie position c0 node cluster".split()


def test_stages_keep_columns_of_any_name(spark):
    """Each stage on a table with nulls, an empty text, repeated rows and names that operators use themselves."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words + " password=hunter2hunter2", "a", "en"), (1, words + " password=hunter2hunter2", "a", "en"), (2, "", None, None), (None, None, "b", "de"), (None, words + " other", "b", "de"), (3, None, None, "en")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"{n}-{r[0]}" for n in NAMES]) for r in rows], "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{n} string" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stage(spark, docs, ""), docs.columns
        assert docs.columns == before, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    found = docs.collect()
    assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in NAMES)
    assert all("hunter2" not in r.text and "[SECRET]" in r.text for r in found if r.doc_id == 1)
    assert {r.doc_id for r in found} == {1, None}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_scopes_do_not_depend_on_the_start(spark):
    key = "A1b2" * 10
    rows = [(i, "." * i + "user: someone" + " " * (gap - 13) + key) for i in range(0, 1200, 97) for gap in (1024, 1025)]
    found = secrets.secrets(spark.createDataFrame([(j, t) for j, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id % 2: len(r.key40) for r in found} == {0: 1, 1: 0}
    assert len({(r.doc_id % 2, len(r.key40)) for r in found}) == 2


def brute_top(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    queries = {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    return sorted((q, n + 1, i, -s) for q, v in queries.items() for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]))


@pytest.mark.parametrize("case", ["every row twice", "some rows twice", "equal scores", "large", "several lengths", "chunks"])
def test_top_k_with_repeated_rows(spark, case, monkeypatch):
    r = random.Random(3)
    vector = lambda n=8, m=1.0: [r.uniform(-m, m) for _ in range(n)]
    rows = {
        "every row twice": [x for i in range(200) for x in [(i, vector())] * 2],
        "some rows twice": [(i, vector()) for i in range(200)] + [(i, vector()) for i in range(40)],
        "equal scores": [(i, [0.5] * 4) for i in range(120)],
        "large": [(i, vector(4, 2e6)) for i in range(120)],
        "several lengths": [(i, vector(r.randint(0, 9))) for i in range(150)],
        "chunks": [(i, vector()) for i in range(400)],
    }[case]
    if case == "chunks":
        monkeypatch.setattr(vectors, "CHUNK", 1)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_edits_change_what_they_touch():
    own = bpe.encoder(*bpe.public_vocabulary())
    r = random.Random(5)
    held = bpe.EncodedText(own, "ab" * 400 + " one two 123\n\né漢 ")
    for _ in range(200):
        at = r.randint(0, len(held.text))
        held.edit(at, min(len(held.text), at + r.randint(0, 5)), r.choice(["", "a", "xyz", " 1\n", "é"]))
        assert held.tokens() == own.encode(held.text)
    table = bpe.PrefixTable(own.vocabulary, b"ab" * 20_000)
    table.edit(7, 8, b"q")
    assert table.filled < 4 * own.vocabulary.longest
    assert table.tokens() == bpe.PrefixTable(own.vocabulary, table.piece).tokens()


def test_worker_caches_are_freed():
    bpe._encoded({"text": ["some words"]}, *bpe.public_vocabulary())
    quality._measured({"text": ["some words"]}, quality._path(None), quality.BANDS)
    assert bpe._encoders and quality._models
    bpe._release()
    quality._release()
    assert not bpe._encoders and not quality._models


def test_near_copies_by_difference_equal_brute_force(spark):
    """Copies of an absent text with one to four words changed: only some are near enough to each other."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(1 + i % 4):
            words[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base[: 75 + i] + [f"y{j}" for j in range(75 - i)])) for i in range(0, 20, 4)]
    want = {i: root for i, (_, root) in components(rows, 85).items()}
    for rounds in (0, 2):
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hub_rounds=rounds).collect()
        assert {x.doc_id: x.component_id for x in found} == want


def test_components_of_several_tasks(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60, 2)] + [tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(50)] + [(200, 200 + i) for i in range(1, 40)]
    up = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    for per_task in (40, 500_000):
        assert {x.node: x.component for x in minhash.components(spark.createDataFrame(links, "a long, b long"), per_task).collect()} == up


def test_calibration_moves_scores_to_where_labels_part():
    weights = np.zeros(toxicity.SLOTS + 1)
    weights[7], weights[-1] = 2.0, -6.0  # at its own scale no document passes 0.5
    bags = [[np.array([7])]] * 20 + [[np.array([8])]] * 60
    scale, shift = toxicity.calibrated(bags, np.array([1] * 20 + [0] * 60), weights)
    assert 1 / (1 + np.exp(-(scale * -4 + shift))) > 0.5 > 1 / (1 + np.exp(-(scale * -6 + shift)))


def test_scratch_leaves_the_result_alone(spark, tmp_path):
    import os

    top = common.shared_dir(spark)
    before = set(os.listdir(top))
    with common.scratch():
        common.written(spark.range(3), "inner")
        out = common.handed_on(spark.range(4), "outer")
    assert out.count() == 4
    assert len(set(os.listdir(top)) - before) == 1
    common.forget(out)
    assert set(os.listdir(top)) == before


def test_measures_equal_brute_force(spark):
    """Characters per token, byte share and entropy against the public model used text by text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=quality._path(None))
    texts = ["plain words of a text " * 15, "漢字テスト \U0001f600 mixed" * 12, "x9#q&&z! " * 60]
    rows = quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        ids = [i for w in texts[row.doc_id].split() for i in model.encode(w)]
        n = np.unique(ids, return_counts=True)[1]
        entropy = -(n / n.sum() * np.log2(n / n.sum())).sum() / np.log2(len(ids))
        assert row.n_tokens == len(ids) and math.isclose(row.token_entropy, entropy, abs_tol=1e-9)
        assert math.isclose(row.byte_share, sum(map(model.is_byte, ids)) / len(ids)) and math.isclose(row.chars_per_token, row.word_chars / len(ids))
