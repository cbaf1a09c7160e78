import itertools
import random

import numpy as np
import pytest

from plantpulse.llm import language, quality, toxicity
from plantpulse.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    good, bad = score[label == 1], score[label == 0]
    return float((good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean())


@pytest.mark.parametrize("query, label, least", [(quality.query, "quality", 0.97), (toxicity.query, "toxic", 0.85)])
def test_held_out_labels(spark, query, label, least):
    scored = query(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50
    assert auc(scored["score"], scored[label]) > least
    assert scored["score"].between(0, 1).all()


def test_held_out_languages(spark):
    out = language.query(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_network_gradients():
    network = language.ByteNetwork(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 123, (4, language.WINDOW)).astype(np.uint8)
    target = np.array([0, 1, 2, 1])
    loss = lambda: -network.log_probabilities(codes)[np.arange(4), target].mean()
    for p, g in zip(network._parameters()[1:], network._gradients(codes, target)[1:], strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 5e-3


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(rounds=30).fit(x[:2000], y[:2000])
    assert auc(model.score(x[2000:]), y[2000:]) > 0.95


def test_restoration():
    words = ("stupid idiot people say such things and then they go away with this thing " * 50).encode()
    codes = toxicity._CODES[np.frombuffer(words, dtype=np.uint8)]
    codes = np.concatenate([[0, 0], codes])
    cells, counts = np.unique((codes[:-2] * 28 + codes[1:-1]) * 28 + codes[2:], return_counts=True)
    restorer = toxicity.Restorer(toxicity.language_model(zip(cells, counts, strict=True)))
    for disguised, plain in (("$tup1d", "stupid"), ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("idiot###", "idiot"),
                             ("people", "people"), ("12.5", ""), ("...", "")):
        assert restorer.restore(disguised) == plain
    assert "idiot" in toxicity._tokens("you i d i o t there")


@pytest.mark.parametrize("text, found", [
    ("you are a m o r o n", {"moron"}), ("i m o r o n", {"moron"}), ("y m o r o n then", {"moron"}), ("m o r o n i d i o t", {"moron", "idiot"}),
    ("mo ron", {"moron"}), ("such an id iot", {"idiot"}), ("moroon", {"moron"}), ("iddiot", {"idiot"}), ("455", {"ass"}), ("@$$!", {"ass"}),
    ("m 0 r 0 n", {"moron"}), ("of the", {"of", "the"})])
def test_spaced_split_and_doubled_words(text, found):
    words = ("the people say such things of the moron and an idiot then they go on to be in it or i am at home and a man is not you are as y " * 50).encode()
    codes = toxicity._CODES[np.frombuffer(words, dtype=np.uint8)]
    codes = np.concatenate([[0, 0], codes])
    cells, counts = np.unique((codes[:-2] * 28 + codes[1:-1]) * 28 + codes[2:], return_counts=True)
    restorer = toxicity.Restorer(toxicity.language_model(zip(cells, counts, strict=True)))
    assert found <= {word for token in toxicity._tokens(text) for word in restorer.words(token)}


def test_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality.score_quality(odd, labels), toxicity.score_toxicity(odd, labels)):
        rows = out.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}
    assert quality.score_quality(docs([]), labels).count() == toxicity.score_toxicity(docs([]), labels).count() == 0
    spoken = {r.doc_id: r for r in language.predict_languages(odd).collect()}
    assert spoken[1].lang_pred == spoken[3].lang_pred == "und" and spoken[7].lang_pred in ("en", "de")
    assert {r.lang_pred for r in language.predict_languages(docs([(1, "abc"), (2, None)])).collect()} == {"und"}
    assert language.predict_languages(docs([])).count() == 0


def test_other_columns_play_no_part(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    first = quality.score_quality(odd, labels).select("doc_id", "score")
    second = quality.score_quality(odd.drop("lang", "source", "score"), labels).select("doc_id", "score")
    assert first.exceptAll(second).isEmpty()


def costs_of(words):
    codes = np.concatenate([[0, 0], toxicity._CODES[np.frombuffer(words.encode(), dtype=np.uint8)]])
    cells, counts = np.unique((codes[:-2] * 28 + codes[1:-1]) * 28 + codes[2:], return_counts=True)
    return toxicity.language_model(zip(cells, counts, strict=True))


def cheapest(costs, word):
    """Cheapest reading of a lattice by trying all of them: (cost, readings that reach it)."""
    best, found = np.inf, set()
    for path in itertools.product(*(toxicity.Restorer._readings(word, i) for i in range(len(word)))):
        a = b = total = 0
        letters = ""
        for letter, price in path:
            total += price
            if letter and (letter != " " or b):
                code = 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27
                total += costs[a][b][code]
                a, b, letters = b, code, letters + letter
        total += costs[a][b][0] if b else 0.0
        if total < best - 1e-9:
            best, found = total, set()
        if total < best + 1e-9:
            found.add(letters)
    return best, found


def test_lattice_equals_trying_all_readings():
    costs = costs_of("the people say such things of the moron and an idiot then they all go on too to be in it or i am at home ass bitter " * 50)
    restorer = toxicity.Restorer(costs)
    rng = random.Random(2)
    for _ in range(600):
        word = "".join(rng.choices("tthheenmoorr0134$|!sé", k=rng.randrange(1, 7)))
        assert restorer.decode(word) in cheapest(costs, word)[1]
    for _ in range(600):
        word = "".join(rng.choices("theenmoorrssaé", k=rng.randrange(2, 9)))
        if word.isalpha() and len(toxicity._DOUBLE.findall(word)) < 5:
            assert restorer.single(word) in cheapest(costs, word)[1]
    for _ in range(600):
        parts = ["".join(rng.choices("thenmorisaé0", k=rng.randrange(1, 4))) for _ in range(rng.randrange(2, 5))]
        readings = {" ".join(r.split(" ")) for r in cheapest(costs, " ".join(parts))[1]}
        assert " ".join(restorer.parted(parts)) in readings
