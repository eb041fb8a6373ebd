"""op3, op5 and op6: gradients, held-out accuracy, recall against brute force; the pipeline on a small fixture."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterank.llm import common, components, forest, langid, toxicity
from tests.llm.data import DOCUMENTS, documents, prose

BAD = ["idiot", "scum", "loser", "trash"]


def toxic_rows(n):
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        words = prose(1000 + i, r.randrange(20, 150)).split()
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_gradients():
    net = toxicity.Network.start({"foo": 1, "bar": 2}, 1)
    windows, labels = [["foo", "baz", "qux", "bar"], ["bar", "foo"], ["zed"]], np.array([1, 0, 1])
    _, grads = net.gradients(windows, labels)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        at = tuple(rng.integers(s) for s in w.shape)
        at = (ord("o"), 2) if name == "char" else (1, 3) if name == "embed" else at
        old, sides = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            sides.append(net.gradients(windows, labels)[0])
        w[at] = old
        slope = (sides[0] - sides[1]) / 2e-2
        assert abs(slope - grads[name][at]) <= 5e-4 + 0.03 * abs(slope), name


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(300)
    marked = spark.createDataFrame([*labels, (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    table = documents(spark, [*rows, (900, None), (901, ""), (None, "idiot " * 500), (902, "x" * 300_000)])
    net = toxicity.train(table, marked, steps=150)
    got = {r["doc_id"]: r for r in toxicity.score_documents(table, net).collect()}
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held)
    right = np.mean([(got[i]["score"] >= 0.7) == bool(t) for i, t in held])
    assert right > 0.9
    assert got[900]["score"] == got[901]["score"] < 0.7 and got[None]["score"] > 0.7


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = toxicity.train(documents(spark), none)
    assert {r["score"] for r in toxicity.score_documents(documents(spark), net).collect()} == {0.0}


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        starts = toxicity.window_starts(n)
        covered = {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(starts) == len(set(starts))


def test_a_passage_of_half_a_window_lies_whole_in_a_window():
    half = toxicity.WINDOW // 2
    for n in (64, 65, 112, 113, 500):
        starts = toxicity.window_starts(n)
        assert all(any(s <= at and at + half <= s + toxicity.WINDOW for s in starts) for at in range(n - half + 1))


def test_every_character_of_a_long_run_is_read(spark):
    assert toxicity.split_words("x" * 40 + " Ab_c") == ["x" * 16, "x" * 16, "x" * 8, "ab_c"]
    rows, labels = toxic_rows(300)
    net = toxicity.train(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=5)
    runs = ["a" * 100, "a" * 60 + "scumloser" + "a" * 31, "a" * 99 + "z"]
    assert len({r["score"] for r in toxicity.score_documents(documents(spark, list(enumerate(runs))), net).collect()}) == 3


LANGUAGES = {"aa": "kata moro sulu teke".split(), "bb": "xyzz quorl blip snarg".split()}


def spoken(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(LANGUAGES[lang]) for _ in range(n))


def test_languages(spark):
    rows = [(i, spoken(lang, i, 30), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    extra = [(500, None, "aa"), (501, "", None), (502, "12 !?", "bb"), (None, spoken("aa", 1, 9), None), (503, spoken("aa", 2, 40) + spoken("bb", 3, 40), None)]
    table = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model.languages == ["aa", "bb"]
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert got[None]["lang_pred"] == "aa" and got[None]["held_out"]
    assert set(got[503]["languages"]) == {"aa", "bb"} and 0.3 < got[503]["score"] < 0.7
    assert got[0]["languages"] == ["aa"]
    kept = langid.keep_identified(table, model)
    assert kept.count() == 122 and kept.where("lang IS NULL").count() == 0
    empty = langid.train(table.limit(0))
    assert {r["lang_pred"] for r in langid.identify(table, empty).collect()} == {"und"}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vecs = [(i, (centres[i % 6] + 0.4 * rng.normal(size=8)).astype("f4").tolist()) for i in range(900)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0, None]), (1200, [1.0, 2.0]), (1201, [2.0, 4.0]), (None, [1.0] * 8)]
    copies = [(2000 + i, vecs[0][1]) for i in range(7)]
    table = spark.createDataFrame([*vecs, *odd, *copies], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in forest.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert [got[0][k][0] for k in range(1, 6)] == [2000, 2001, 2002, 2003, 2004]
    assert got[1200] == {1: (1201, pytest.approx(1.0))}
    assert not {1000, 1050, 1100, 1150} & set(got)
    every = [(i, np.array(v, float)) for i, v in [*vecs, *copies]]
    unit = np.array([v / np.linalg.norm(v) for _, v in every])
    hit = 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = sorted(range(len(every)), key=lambda k: (-round(score[k], 12), every[k][0]))[:5]
        hit += len({every[k][0] for k in best} & {v for v, _ in got[q].values()})
    assert hit >= 0.9 * 18 * 5
    assert forest.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_through_many_cells(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL", 64)
    monkeypatch.setattr(forest, "CELL_MOST", 128)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1500, 16))
    data[500:1000] = data[499] + 0.01 * rng.normal(size=(500, 16))  # a dense group of a third
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = forest.nearest(table, F.col("vec_id") % 50 == 0, enough=64).collect()
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    want = {(q, int(v)) for q in range(0, 1500, 50) for v in np.argsort(-(unit @ unit[q]))[1:6]}
    assert len(rows) == 150
    assert len(want & {(r["query_id"], r["vec_id"]) for r in rows}) >= 0.9 * len(want)


def test_a_small_share_of_a_long_text_is_a_language(spark):
    rows = [(i, lang, spoken(lang, i, 30)) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    text = spoken("aa", 1, 9900) + " " + spoken("bb", 2, 100)
    row = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row["languages"] == ["aa", "bb"] and 0.005 < row["shares"][1] < 0.02


def test_languages_are_learned_from_whole_texts(spark):
    rows = [(i, lang, spoken(lang, i, 30)) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    late = "0 " * 12_000 + "zuvwq " * 20  # words that stand behind 20,000 characters only
    rows += [(100 + i, "bb", spoken("bb", i, 30) + late) for i in range(9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    asked = spark.createDataFrame([(1, "zuvwq zuvwq")], "doc_id long, text string")
    row = langid.identify(asked, model).first()
    assert row["lang_pred"] == "bb" and row["score"] > 0.9


@pytest.mark.parametrize("count", [300, 900])  # in one cell, and in many
def test_neighbours_are_exact_at_the_top(spark, monkeypatch, count):
    monkeypatch.setattr(forest, "CELL", 400)
    monkeypatch.setattr(forest, "CELL_MOST", 90)
    rng = np.random.default_rng(6)
    data = rng.normal(size=(count, 24))
    data[: count // 3] = data[0] + 0.3 * rng.normal(size=(count // 3, 24))  # a dense group in cells of several blocks
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = forest.nearest(table, F.col("vec_id") % 10 == 0, enough=6, target=2.0).collect()  # never content before the top
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    want = {(q, k + 1, int(v)) for q in range(0, count, 10) for k, v in enumerate(np.argsort(-(unit @ unit[q]))[1:6])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == want


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    """A chain numbered 0, n, ..., 1, one numbered at random, and stars; all in one graph, some keys hot."""
    monkeypatch.setattr(common, "HOT_LEAST", 500)
    n = 5000
    falling = [0, *range(n - 1, 0, -1)]
    mixed = (np.random.default_rng(4).permutation(n) + 10_000).tolist()
    links = [*zip(falling, falling[1:]), *zip(mixed, mixed[1:])]  # noqa: B905
    links += [(25_000, 20_000 + i) for i in range(4000)] + [(30_000 + i, 30_000) for i in range(1, 3000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.components(df).collect())
    want = {**dict.fromkeys(falling, 0), **dict.fromkeys(mixed, 10_000), **dict.fromkeys([25_000, *range(20_000, 24_000)], 20_000)}
    assert got == {**want, **dict.fromkeys(range(30_000, 33_000), 30_000)}
    rounds = components.contractions(df)
    sizes = [r.count() for r in rounds]
    assert len(rounds) <= 2.5 * np.log2(n) and all(b < a for a, b in zip(sizes, sizes[1:]))  # noqa: B905


def test_components_of_random_links(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    label = list(range(400))
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: label[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_sample_bars_of_any_size():
    top = 1 << langid.SAMPLE_BITS
    assert langid.sample_bar(1500, 10) == top and langid.sample_bar(1500, 1500) == top
    for size in (3000, 10**6, 2 * 10**9, 10**12, 10**15):
        share = langid.sample_bar(1500, size) / top
        assert abs(share * size - 1500) < 1


def test_languages_are_bounded(spark):
    rows = [(3 * i, prose(i, 30), "abc"[min(i % 4, 2)]) for i in range(60)] + [(1000 + i, "zz", f"stray{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, languages=3).languages == ["a", "b", "c"]
    assert len(langid.train(docs).languages) > 20


def plain_mixture(chance, grams, among, rounds=20):
    """Expectation-maximisation word for word: (shares, log-likelihood)."""
    shares = [1 / len(among)] * len(among)
    for _ in range(rounds if len(among) > 1 else 0):
        new = [0.0] * len(among)
        for g in grams:
            each = [shares[k] * chance[g][lang] for k, lang in enumerate(among)]
            for k, e in enumerate(each):
                new[k] += e / sum(each) / len(grams)
        done = max(abs(a - b) for a, b in zip(new, shares, strict=True)) < 1e-4
        shares = new
        if done:
            break
    return shares, sum(math.log(sum(shares[k] * chance[g][lang] for k, lang in enumerate(among))) for g in grams)


def test_mixtures_against_plain_expectation_maximisation():
    rng = np.random.default_rng(12)
    chance = rng.dirichlet(np.full(300, 0.05), 4).T + 1e-6
    chance /= chance.sum(0)
    model = langid.Model(list("wxyz"), chance)
    for parts in ((200, 0, 0, 0), (150, 60, 0, 0), (0, 90, 0, 110), (80, 0, 70, 90), (300, 0, 9, 0), (0, 0, 4, 0)):
        grams = np.concatenate([rng.choice(300, n, p=chance[:, k]) for k, n in enumerate(parts)])
        unique, times = np.unique(grams, return_counts=True)
        best = None
        for size in range(1, 5):
            for among in itertools.combinations(range(4), size):
                shares, likely = plain_mixture(chance, grams.tolist(), among)
                got, value = model.shares(unique, times.astype(float), np.array(among))
                assert np.allclose(got, shares, atol=1e-9) and abs(value - likely) < 1e-6
                gain = likely - (size - 1) * 3.0 * math.log(len(grams) + 1)
                if best is None or gain > best[0]:
                    best = gain, among, shares
        lang, score, names, _ = model.predict(grams.astype(np.uint32), 3.0)
        assert set(names) == {"wxyz"[k] for k in best[1]}  # of all sets the one of the largest penalised likelihood
        assert lang == names[0] == "wxyz"[best[1][int(np.argmax(best[2]))]]
        assert 0 < score <= 1


def test_repeated_ids_do_not_take_places(spark):
    """One id on a dozen near vectors: it is one neighbour, and the others follow."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    near = [(7, (base + 0.001 * rng.standard_normal(16)).tolist()) for _ in range(12)]
    rows = [(0, base.tolist()), *near, *[(100 + i, rng.standard_normal(16).tolist()) for i in range(40)]]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in forest.nearest(table, F.col("vec_id") == 0).collect())
    cosine = lambda v: float(np.dot(v, base) / np.linalg.norm(v) / np.linalg.norm(base))
    best: dict = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2.0), cosine(np.array(v)))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    assert [v for _, v, _ in got] == want and want[0] == 7
    assert np.allclose([s for *_, s in got], [best[i] for i in want])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_repeats import brute_components
    from tests.llm.test_texts import ITEMS, brute_secrets

    rows = [*DOCUMENTS, *[(200 + i, prose(i, 80)) for i in range(6)]]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    told = stages[0](spark, docs, str(tmp_path))
    has_letter = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert sorted(r["text"] for r in told.collect()) == sorted(t for _, t in has_letter) and told.columns == names
    single = stages[1](spark, told, str(tmp_path))
    assert single.count() == len(set(brute_components(has_letter)[1])) and single.columns == names
    clean = stages[2](spark, single, str(tmp_path))
    assert clean.columns == names and clean.where("doc_id IN (6, 7, 11, 19)").count() == 0
    assert clean.where("doc_id IN (0, 5, 15, 20)").count() == 4
    safe = stages[3](spark, clean, str(tmp_path))
    assert safe.columns == names and safe.count() == clean.count()
    assert not any(brute_secrets(r["text"]) for r in safe.collect())
    packed = stages[4](spark, safe, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in safe.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_keeps_the_tokens(spark, tmp_path):
    import corpus_pipeline

    packed = corpus_pipeline.packed(spark, documents(spark), str(tmp_path)).collect()
    assert packed and all(len(r["ids"]) == r["length"] for r in packed)
    assert all(zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in packed)
