import random
import zlib

import numpy as np

from terrastrata.llm import toxicity

from .cases import TEXTS, documents, no_documents, odd_documents


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def corpus(seed=1, count=700, veiled=0.0):
    """Toxic texts hold an insult; most of them also mention a group, which by itself is harmless."""
    r = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(count):
        toxic = k % 4 == 0
        w = r.choices(plain, k=r.randint(10, 60))
        if toxic and r.random() >= veiled:
            w.insert(r.randrange(len(w)), r.choice(["Idiots!", "scum", "moron,"]))
        if r.random() < (0.8 if toxic else 0.05):
            w.insert(r.randrange(len(w)), r.choice(["women", "muslims", "jews", "gays"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = toxicity.toxicity(documents(spark, rows), labelled(spark, labels)).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    wrong = [r for r in got if r["held_out"] and r["predicted"] != (r["doc_id"] % 4 == 0)]
    assert len(wrong) <= 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_neutral_mentions_are_no_false_positives():
    rows, labels = corpus(veiled=0.4)
    array = lambda t: np.array(sorted(toxicity.features(t)))
    own = [array(t) for _, t in rows]
    toxic = [y for *_, y in labels]
    others = [(k, *c) for k, (_, t) in enumerate(rows) for c in toxicity.changes(t)]
    fair, plain = toxicity.fit(own, toxic, others), toxicity.fit(own, toxic, [])
    score = lambda m, t: m.score(toxicity.features(t), dict(zip(m.hashes.tolist(), m.weights.tolist())))
    mention = "muslims and women met word1 word2"
    assert score(fair, mention) < 0.2 and score(plain, mention) > 0.5
    assert score(fair, mention + " scum") > 0.5


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    turned = [(d, q, 1 - y if held(d) else y) for d, q, y in labels]
    a, b = (toxicity.train(documents(spark, rows), labelled(spark, some)) for some in (labels, turned))
    assert a.bias == b.bias and a.weights.tolist() == b.weights.tolist()


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    for labels in ([], [(1, None, None), (None, 1, 1)], [(1, 1, 1)], [(1, 1, 0), (1, 1, 1), (7, 0, 0), (6, 1, 0), (4, 1, None)]):
        got = toxicity.toxicity(docs, labelled(spark, labels)).collect()
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(no_documents(spark), labelled(spark, [(1, 1, 1)])).collect() == []


def test_sample_is_bounded(spark):
    rows, labels = corpus(count=300)
    model = toxicity.train(documents(spark, rows), labelled(spark, labels), sample_rows=40)
    assert len(model.weights) < 200


def test_swaps_keep_everything_else():
    got = toxicity.swapped("Women, and word!")
    assert got == [f"{w}, and word!" for w in toxicity.IDENTITY_TERMS[0][1:]] and got[-1] == "people, and word!"
    assert len(toxicity.swapped("women and a boy")) == 11
    assert toxicity.swapped("nothing here") == [] and toxicity.swapped(None) == []


def test_fewer_false_positives_on_held_out_mentions(spark):
    """Planted neutral mentions, none of them labelled: the penalty takes most of the false alarms away and still finds toxic texts."""
    rows, labels = corpus(veiled=0.4)
    r = random.Random(5)
    neutral = [(10_000 + k, " ".join(r.choices([f"word{k}" for k in range(300)], k=30) + [r.choice(["women", "muslims", "jews", "gays"])])) for k in range(150)]
    docs, toxic = documents(spark, rows + neutral), {d for d, _, y in labels if y and held(d)}
    alarms, caught = {}, {}
    for name, groups in (("with", toxicity.IDENTITY_TERMS), ("without", ())):
        got = {x["doc_id"] for x in toxicity.toxicity(docs, labelled(spark, labels), groups=groups).collect() if x["predicted"]}
        alarms[name], caught[name] = len(got & {d for d, _ in neutral}), len(got & toxic)
    assert alarms["with"] < 0.2 * alarms["without"] and alarms["without"] > 75
    assert caught["with"] > 0.5 * len(toxic)
    assert toxicity.train(docs, labelled(spark, labels)).pairs > 1000 and toxicity.train(docs, labelled(spark, labels), groups=()).pairs == 0


def test_rows_that_repeat_an_id_do_not_count_again(spark):
    rows, labels = corpus(count=120)
    again = rows + [rows[4]] * 500 + [(rows[4][0], "another text")] * 3
    a, b = (toxicity.train(documents(spark, some), labelled(spark, labels)) for some in (rows + [(rows[4][0], "another text")], again))
    assert a.bias == b.bias and a.weights.tolist() == b.weights.tolist()


def test_scores_are_those_of_the_model_row_by_row(spark):
    rows, labels = corpus(count=200)
    model = toxicity.train(documents(spark, rows), labelled(spark, labels))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity(documents(spark, rows), labelled(spark, labels)).collect()}
    for doc, text in rows:
        seen = {h for w in text.split(" ") for h in toxicity._features(w)}
        assert abs(got[doc] - 1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in seen))))) < 1e-9
