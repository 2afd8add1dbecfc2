import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.llm import language, language_model, licence
from procweave.llm.common import identified

SOUNDS = {"aa": "bako rumi tela nosa", "bb": "schtz ungre pfeil kraft", "cc": "éla ouvre çade tion"}


def texts_in(lang, rng, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split())[: rng.randrange(2, 6)] for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(write):
    rng = random.Random(1)
    rows = [(i, texts_in(lang, rng, rng.randrange(5, 300)), lang, "s") for i, lang in enumerate(rng.choices(list(SOUNDS), k=300))]
    return write(rows + [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !?", "bb", "s"), (1003, "a", None, "s"), (1004, texts_in("bb", rng, 40_000), None, "s")])


def test_held_out_accuracy(spoken):
    model = language.train(spoken.filter(~language.held_out("doc_id")))
    assert model.languages == list(SOUNDS)
    told = language.identify(spoken, model)
    assert set(told.columns) == set(spoken.columns) | {"lang_pred", "score"}
    rows = told.filter(language.held_out("doc_id") & F.col("lang").isNotNull() & (F.col("doc_id") < 1000)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in told.filter("doc_id >= 1000").collect()}
    assert odd[1000] == odd[1001] == odd[1002] == ("und", 0.0) and odd[1003][0] in SOUNDS and odd[1004][0] == "bb" and 0 < odd[1004][1] <= 1


def test_windows_cover_whole_texts_and_filters_match_plain_convolution():
    texts = [b"x" * 128, b"", b"abc", b"y" * 300]
    symbols, letters, counts = language.windows(texts)
    assert counts.tolist() == [1, 0, 1, 3] and letters.tolist() == [128, 3, 128, 128, 44]
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], [rng.standard_normal((w, 64, 4)).astype(np.float32) for w in language.WIDTHS], np.zeros(12, np.float32), np.zeros((12, 2)), np.zeros(2))
    plain = [[max(0, max(sum(f[j][s[i + j], c] for j in range(w)) for i in range(len(s) - w + 1))) for w, f in zip(language.WIDTHS, model.filters) for c in range(4)] for s in symbols]
    assert np.allclose(model.pooled(symbols), plain, atol=1e-4)


def test_no_training_rows(spoken, empty):
    model = language.train(empty)
    assert model is None and {r["lang_pred"] for r in language.identify(spoken, model).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def check_base(docs, held, got):
    rows = {r["__r"]: r for r in identified(docs, "__r").select("__r", "doc_id", "text").collect()}
    words = {i: (r["text"] or "").encode().lower().split() + [None] for i, r in rows.items()}
    count = collections.Counter(w for i, t in words.items() if not held(rows[i]["doc_id"]) for w in t)
    total, distinct = sum(count.values()), len(count)
    assert set(got) == set(rows)
    for i, t in words.items():
        r, base = got[i], sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in count for w in t), total, held(rows[i]["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])


@pytest.mark.parametrize("vocabulary", [language_model.VOCABULARY, 20])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_base_scores_equal_brute_force(request, monkeypatch, table, vocabulary):
    monkeypatch.setattr(language_model, "VOCABULARY", vocabulary)
    docs = request.getfixturevalue(table)
    got = {r["rid"]: r for r in language_model.fit_and_score(docs, F.col("doc_id") % 4 == 1).collect()}
    check_base(docs, lambda i: i is not None and i % 4 == 1, got)


def test_model_beats_word_frequencies_on_held_out_texts(spoken):
    got = language_model.fit_and_score(spoken.filter("doc_id < 1000"), F.col("doc_id") % 5 == 0).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_factors_are_distributions():
    """Chances of the classes sum to one, and so do the words inside each class."""
    values, bounds = language_model.tokens([b"a b a c", b"b b"])
    words, counts = np.unique(values, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:3]
    model = language_model.Model(words[order], counts[order], int(counts.sum()), len(words), np.array([0, 1, language_model.END], np.int16))
    model.weights = np.random.default_rng(0).standard_normal((language_model.ROWS, language_model.CLASSES)).astype(np.float32)
    ids = model.ids(values)
    assert [words[order][i] == v if i >= 0 else v not in words[order] for i, v in zip(ids, values)] == [True] * len(values)
    _, rows = model.features(values, ids, bounds)
    assert np.allclose(model.chances(rows).sum(axis=1), 1, atol=1e-5)


def test_updates_follow_the_gradient():
    rng = np.random.default_rng(0)
    rows = np.stack((rng.integers(0, 50, 3000), language_model.BEFORE + rng.integers(0, 50, 3000), language_model.BEFORE + language_model.SKIP + rng.integers(0, 50, 3000)))
    kinds = rows[0] % 7
    model = language_model.Model(np.zeros(0, np.uint64), np.zeros(0, int), 0, 0, np.zeros(0, np.int16), np.zeros((language_model.ROWS, language_model.CLASSES), np.float32))
    squares, likely = np.zeros(language_model.ROWS, np.float32), []
    for _ in range(30):
        p = model.chances(rows)
        likely.append(np.log(p[np.arange(3000), kinds]).mean())
        language_model.descend(model.weights, squares, rows, kinds, p, 0.3)
    assert likely[-1] > -0.3 > likely[0]


def test_empty_language_model(empty, write):
    assert language_model.fit_and_score(empty, F.lit(False)).count() == 0
    alone = language_model.fit_and_score(write([(1, "a b", "en", "s")], 1), F.lit(True)).collect()
    assert len(alone) == 1 and (alone[0]["n_tokens"], alone[0]["n_known"], alone[0]["train_tokens"], alone[0]["base_score"]) == (3, 0, 0, 0.0)


LINES = {
    1: ("Some words here. This work is licensed under the GNU General Public License, version 3. More words.", "GPL-3.0", 1, 0),
    2: ("intro\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT", 2, 0),
    3: ("Licensed under the Apache License, Version 2.0\n" * 3, "Apache-2.0", 3, 0),
    4: ("He has a driving license since 1990.", "", 0, 1), 5: ("No words of that kind.", "", 0, 0), 6: (None, "", 0, 0), 7: ("", "", 0, 0),
    8: ("filler words " * 4000 + "released under the mit license " + "filler words " * 4000, "MIT", 1, 0),
    9: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including", "MIT", 1, 0),
}


def test_licences_are_found_and_confirmed(write):
    rng = random.Random(2)
    docs = write([(i, t, None, None) for i, (t, *_) in LINES.items()] * 2 + [(100 + i, texts_in("aa", rng, 40), "aa", "s") for i in range(200)])
    rows = licence.scan(docs).collect()
    assert len(rows) == 2 * len(LINES) + 200
    for r in rows:
        want = LINES[r["doc_id"]][1:] if r["doc_id"] < 100 else ("", 0, 0)
        assert (r["families"], r["n_confirmed"], r["n_unknown"]) == want, r
    plan = licence.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_all_licences_of_a_line(write):
    lines = {
        "Licensed under the MIT License or the Apache License, Version 2.0": "Apache-2.0,MIT",
        "Licensed under either of Apache License, Version 2.0 or MIT License": "Apache-2.0,MIT",
        "Licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "Licensed under the CC BY-SA 4.0": "CC-BY-SA-4.0",
        "Licensed under the GNU General Public License, version 2": "GPL-2.0",
    }
    rng = random.Random(3)
    fees = [(50 + i, f"The license fee of {texts_in('bb', rng, 3)} is due under the contract", None, None) for i in range(40)]
    docs = write([(i, t, None, None) for i, t in enumerate(lines)] + fees + [(100 + i, texts_in("aa", rng, 40), "aa", "s") for i in range(200)])
    got = {r["doc_id"]: (r["families"], r["n_confirmed"], r["n_unknown"]) for r in licence.scan(docs).collect()}
    assert {t: got[i][0] for i, t in enumerate(lines)} == lines
    assert {got[i] for i in range(50, 90)} == {("", 0, 1)}


def test_all_passages_with_a_cue_are_learnt_from(write, monkeypatch):
    """Two thirds of the distinct passages with a cue are examples, the others give the threshold; repeats count once."""
    seen, put = {}, licence.settle

    def kept(df):
        out = put(df)
        seen[tuple(out.columns)] = out
        return out

    monkeypatch.setattr(licence, "settle", kept)
    docs = write([(i, f"The license fee number w{i % 2100} is due in w{i % 2100 * 7}", None, None) for i in range(2400)])
    licence.train(docs.select(F.col("doc_id").alias("rid"), "text"))
    assert seen["passage", "h"].count() == 2100
    unknown = seen["label", "grams"].filter("label = 0").count() - len(licence.NO_FAMILY)
    assert unknown == seen["passage", "h"].filter("pmod(h, 3) > 0").count() > 1300


def test_every_template_has_a_cue_and_its_own_family(spark, write):
    import re

    assert all(re.search(licence.CUES, t) for _, t in licence.templates())


def test_empty_licences(empty):
    assert licence.scan(empty).count() == 0
