import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import crf, toxicity
from tracelode.llm.queries import op5_toxicity


def enumerate_chain(delta, model):
    """Exact marginals, the best labels and the partition function by enumeration."""
    n = len(delta)
    scores = {}
    for y in itertools.product((0, 1), repeat=n):
        s = model.bias * y[0] + sum(d for d, l in zip(delta, y, strict=True) if l) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False))
        scores[y] = s
    z = sum(np.exp(s) for s in scores.values())
    return [sum(np.exp(s) for y, s in scores.items() if y[t]) / z for t in range(n)], max(scores, key=scores.get)


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    model = crf.Model(np.zeros(1), rng.normal(size=(2, 2)), 0.3)
    lengths = np.array([3, 0, 1, 7, 5])
    chains = crf.Chains(np.cumsum(lengths) - lengths, lengths)
    delta = rng.normal(size=16) * 2
    p, y = model.marginals(delta, chains), model.viterbi(delta, chains)
    for s, n in zip(chains.starts, lengths, strict=True):
        if n:
            want, best = enumerate_chain(delta[s : s + n], model)
            assert p[s : s + n] == pytest.approx(want)
            assert tuple(y[s : s + n]) == best


def test_fit_raises_the_likelihood_and_learns_transitions():
    rng = np.random.default_rng(1)
    labels = np.repeat(rng.integers(0, 2, 300), 4)  # long runs
    features = np.where(rng.random(1200) < 0.8, labels, 1 - labels)[:, None]
    lengths = np.full(100, 12)
    chains = crf.Chains(np.cumsum(lengths) - lengths, lengths)
    model = crf.fit(features, labels, chains, 2)
    assert model.moves[0, 0] + model.moves[1, 1] > model.moves[0, 1] + model.moves[1, 0]
    # neighbours help: better than what each position tells by itself
    right = ((model.marginals(model.weights[features].sum(axis=1), chains) > 0.5) == labels).mean()
    assert right > (features[:, 0] == labels).mean() + 0.02


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).toPandas()
    assert list(got.columns[:4]) == ["doc_id", "held_out", "score", "predicted"]
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    test = labels[labels["held_out"]]
    caught = test[(test["toxic"] == 1)]["predicted"].mean()
    wrong = test[(test["toxic"] == 0)]["predicted"].mean()
    assert caught >= 0.85 and wrong <= 0.02


def test_labels_of_held_out_rows_are_never_learnt(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(documents, labels), toxicity.learn(documents, turned)
    assert np.array_equal(a.field.weights, b.field.weights)


def test_spans_and_odd_rows(spark, odd, none):
    texts = ["a fine day in town. all is well here"] * 30 + ["you are a complete blockhead. go away blockhead"] * 10
    model = toxicity.train(texts, [0] * 30 + [1] * 10)
    score, spans = model.apply(["what a blockhead", "a fine town", ""], {})
    assert score[0] > 0.3 > score[1] and score[2] < 0.3 and (7, 16) in spans[0] and spans[1] == []
    out = toxicity.scores(odd, model)
    assert out.count() == odd.count() and out.filter("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.scores(none, model).count() == 0
    kept = toxicity.reject(odd, model)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    assert toxicity.reject(none, model).count() == 0


def test_without_labels_nothing_is_toxic(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert toxicity.scores(odd, model).filter("score > 0").count() == 0
    assert toxicity.learn(odd, spark.createDataFrame([(1, 1), (1, 0), (7, 1)], "doc_id long, toxic int")).head is None


def test_offsets_where_lowering_adds_letters():
    texts = ["a fine day in town. all is well here"] * 30 + ["you are a complete blockhead. go away blockhead"] * 10
    model = toxicity.train(texts, [0] * 30 + [1] * 10)
    for text in ("İİ what a blockhead", "x İ. İstanbul blockhead İ blockhead!", "BLOCKHEAD İ"):
        _, spans = model.apply([text], {})
        want = [(m.start(), m.end()) for m in re.finditer("(?i)blockhead", text)]
        assert set(want) <= set(spans[0]) and all(0 <= a < b <= len(text) for a, b in spans[0])


def plain_score(model, text):
    """The score of a text step by step: tokens, sums of weights, forward and backward in probabilities, summary, logistic function."""
    marginals = []
    for sentence in re.split(r"[.!?\n]", text.lower()):
        words = re.findall(r"[^\W_]+", sentence)
        delta = [sum(float(model.field.weights[f]) for f in toxicity.feature_numbers(w)) for w in words]
        if not words:
            continue
        m, n = np.exp(model.field.moves), len(words)
        ahead = [np.array([1.0, np.exp(model.field.bias + delta[0])])]
        for d in delta[1:]:
            step = (ahead[-1] @ m) * np.array([1.0, np.exp(d)])
            ahead.append(step / step.sum())
        behind = [np.ones(2)]
        for d in reversed(delta[1:]):
            step = m @ (behind[0] * np.array([1.0, np.exp(d)]))
            behind.insert(0, step / step.sum())
        marginals += [float((a * b)[1] / (a * b).sum()) for a, b in zip(ahead, behind, strict=True)]
    sure = sum(p for p in marginals if p >= toxicity.SPAN_AT)
    x = [1, math.log1p(sure), max(marginals, default=0), math.sqrt(sure / max(1, len(marginals))), math.log1p(min(sum(marginals), 1))]
    return 1 / (1 + math.exp(-float(np.dot(x, model.head))))


def test_query_scores_step_by_step(spark, sf, documents):
    model = toxicity.learn(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = op5_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    assert [r["score"] for r in rows] == pytest.approx([plain_score(model, texts[r["doc_id"]]) for r in rows], abs=1e-6)
