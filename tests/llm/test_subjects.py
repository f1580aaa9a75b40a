import random

import numpy as np

from simlode.llm import subjects as S

TOPICS = {"music": "sonata fugue violin oboe tempo chord melody aria".split(), "farming": "plough barley harvest tractor silage orchard cattle hay".split(), "law": "clause verdict tribunal appeal liability warranty statute court".split()}
NEUTRAL = "index value total window list key output input record state".split()


def corpus(n=900, seed=0):
    r = random.Random(seed)
    docs, truth, labels = [], {}, []
    names = list(TOPICS)
    for i in range(n):
        kind = r.choice(["one", "one", "two", "none"])
        subjects = {"one": [r.choice(names)], "two": r.sample(names, 2), "none": []}[kind]
        lines = ["# SOME LICENCE", "# warranty liability clause appeal statute court tribunal verdict " * 3] if r.random() < 0.3 else []
        for s in subjects:
            for _ in range(8):
                lines.append(f"def {r.choice(NEUTRAL)}_{r.choice(TOPICS[s])}({r.choice(TOPICS[s])}{r.choice(NEUTRAL).title()}): return {r.choice(NEUTRAL)}")
        for _ in range(10):
            lines.append(f"{r.choice(NEUTRAL)} = {r.choice(NEUTRAL)}_{r.choice(NEUTRAL)}")
        if r.random() < 0.2:
            lines.append("# like a " + r.choice(TOPICS[r.choice(names)]))
        r.shuffle(lines[2:])
        docs.append((i, "\n".join(lines), "t", 0))
        truth[i] = set(subjects)
        if r.random() < 0.4:
            said = subjects or ["none"]
            if r.random() < 0.04:
                said = [r.choice(names)]
            labels += [(i, r.choice([s, s.upper(), f" {s} "]), 1) for s in said]
    labels += [(10**9, "music", 1), (3, None, 1), (4, "gibberish", 2), labels[0]]
    return docs, truth, labels


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, d string, counts int")
    y = spark.createDataFrame(labels, "doc_id long, subject string, c int")
    return d, y, spark.createDataFrame([(s, "x") for s in TOPICS], "subject string, about string")


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus()
    seen = {x[0] for x in labels}
    d, y, s = tables(spark, docs + [(5000, None, "", 0), (5001, "", "", 0), (5002, "  \n", "", 0), (5003, "x = 1 " * 100_000, "", 0)], labels)
    got = {(r.doc_id, r.subject) for r in S.subject_areas(d, y, s).collect()}
    assert not {i for i, _ in got} & {5000, 5001, 5002, 5003}
    held = {(i, x) for i, xs in truth.items() if i not in seen for x in xs}
    found = {(i, x) for i, x in got if i not in seen}
    assert len(found & held) / len(found) > 0.95 and len(found & held) / len(held) > 0.95


def test_without_labels_or_documents(spark):
    docs, _, labels = corpus(30)
    d, y, s = tables(spark, docs, labels)
    assert S.subject_areas(d, y.limit(0), s).collect() == []
    assert S.subject_areas(d.limit(0), y, s).collect() == []
    assert S.subject_areas(d, y, s.limit(0)).collect() == []


def test_the_leading_comment_is_told_from_the_rest():
    for text, lead in [("﻿// A LICENCE\n// more\n\nint x;", "﻿// A LICENCE\n// more\n\n"), ("# only\n# comments\n", ""), ("a\n# b", ""), ('#include "a.h"\nint x;', '#include "a.h"\n'), ("", "")]:
        assert text[: S.lead_end(text)] == lead


def test_every_word_of_the_text_counts(spark):
    text = "#!/bin/sh\n# A window holds granary rows.\nexport granary=1 # GRANARY\n"
    got = S.word_counts(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t").first()
    words = S.PART.findall(text)
    assert sum(got.counts) == len(words) and len(got["words"]) == len({w.lower() for w in words}) + 1  # granary is two features


def test_headers_that_stand_before_everything_speak_for_nothing(spark):
    docs, truth, labels = corpus(600, 3)
    header = docs[[d[1].startswith("# SOME") for d in docs].index(True)][1].split("\n")[:2]
    docs += [(7000, "\n".join([*header, "value = index"]), "t", 0), (7001, "\n".join(x.removeprefix("# ") for x in header * 4), "t", 0), (7002, "# The sonata and the fugue\n# for violin and oboe, a tempo and a chord\n// melody aria sonata\nvalue = index", "t", 0)]
    d, y, s = tables(spark, docs, labels)
    got = {(r.doc_id, r.subject) for r in S.subject_areas(d, y, s).collect() if r.doc_id >= 7000}
    assert (7001, "law") in got and 7000 not in {i for i, _ in got}


def test_calibration_sees_through_wrong_labels():
    r = np.random.default_rng(0)
    x = np.stack([r.uniform(-5, 5, (4000, 1)), np.full((4000, 1), 3.0)], axis=2)
    y = (x[:, :, 0] > -1).astype(float)
    y = np.where(r.random(y.shape) < 0.05, 1 - y, y)
    c = S.Calibration(1)
    c.fit(x, y, np.ones(y.shape, bool))
    p = c.posterior(np.array([[[-2.0, 3.0]], [[0.0, 3.0]]]))
    assert p[0, 0] < 0.2 and p[1, 0] > 0.8


def test_model_travels_sparse():
    import pickle

    m = S.Model(["a", "b"])
    m.topical[[3, 70]] = True
    m.weights[:, [3, 70]] = 0.25
    back = pickle.loads(pickle.dumps(m))
    assert (back.topical == m.topical).all() and (back.weights == m.weights).all() and len(pickle.dumps(m)) < 2000


def test_an_even_mixture_of_many_subjects_keeps_them(spark):
    r = random.Random(2)
    topics = {f"area{a}": [f"{a * 5}{x}word" for x in "bcdfgh"] for a in "klmnprst"}
    line = lambda s: " ".join(r.choices(topics[s], k=6))
    docs = [(i, " ".join([*(line(s) for _ in range(4)), *r.choices(NEUTRAL, k=30)]), "t", 0) for i, s in enumerate([*topics] * 30)]
    labels = [(i, s, 1) for i, s in enumerate([*topics] * 30) if i % 2]
    labels += [(i, s, 1) for i, s in enumerate([*topics] * 4)]
    docs.append((9999, " ".join(line(s) for s in topics for _ in range(8)), "t", 0))
    docs.append((9998, " ".join([*(line("areak") for _ in range(20)), *topics["areal"][:2]]), "t", 0))
    d, y, _ = tables(spark, docs, labels)
    got = S.subject_areas(d, y, spark.createDataFrame([(s,) for s in topics], "subject string")).collect()
    assert {x.subject for x in got if x.doc_id == 9999} == set(topics)
    assert {x.subject for x in got if x.doc_id == 9998} == {"areak"}
