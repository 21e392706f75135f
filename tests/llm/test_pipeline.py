"""The pipeline's stages on cases planted in a small corpus, and the registry."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def planted():
    r = random.Random(8)
    vocabulary = {"aa": [f"ka{k}lo" for k in range(500)], "ab": [f"öß{k}ch" for k in range(500)]}
    rows = []
    for d in range(120):
        lang = ["aa", "ab"][d % 2]
        rows.append((d, " ".join(r.choices(vocabulary[lang], k=r.randint(60, 200))), lang))
    shared = " ".join(r.choices(vocabulary["aa"], k=70))
    rows[40] = (40, f"{rows[40][1]} {shared}", "aa")
    rows[90] = (90, f"{rows[90][1]} {shared}", "aa")
    rows += [(200, rows[10][1], "aa"), (201, rows[10][1], None), (202, None, "aa"), (203, "12 34 !!", None), (204, shared, None)]
    return rows


def frame(spark):
    rows = [(d, t, lang, "s", len(t or ""), f"extra{d}") for d, t, lang in planted()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs, seen = frame(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    clean = set(range(120))
    assert ids["language_id"] == clean | {200, 201, 204}
    assert ids["simhash_near_dedup"] == clean | {204}
    assert ids["substring_dedup"] == clean
    before = {r["doc_id"]: r for r in seen["simhash_near_dedup"]}
    for r in seen["substring_dedup"]:
        if r["doc_id"] != 90:
            assert r == before[r["doc_id"]]
        else:
            assert len(r["text"].split()) == len(before[90]["text"].split()) - 70
            assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in seen["best_fit_packing"]} == clean


def near_copies():
    """Texts with edits that leave a five-word Jaccard similarity on both sides of 0.8, and chains of them."""
    r = random.Random(3)
    words = [f"ka{k}lo" for k in range(600)]
    common = r.choices(words, k=40)
    rows = []
    for _ in range(60):
        text = r.choices(words, k=r.choice([3, 5, 9, 60, 150, 400])) + r.choice([[], common])
        rows.append(text)
        for _ in range(r.choice([0, 1, 3])):
            text = list(text)
            for _ in range(max(1, len(text) * r.choice([1, 2, 3, 4]) // 100)):
                text[r.randrange(len(text))] = f"neu{r.randrange(10**6)}"
            rows.append(text)
    return [(d, " ".join(t)) for d, t in enumerate(rows)]


def kept_by_brute_force(rows):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {d: d for d in sets}
    similar = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in similar:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return {d for d in sets if parent[d] == d}


@pytest.mark.parametrize("sample", [8192, 0])
def test_near_dedup_equals_brute_force(spark, monkeypatch, sample):
    from tessel.llm import shinglesets

    monkeypatch.setattr(shinglesets.near_copies, "__defaults__", (*shinglesets.near_copies.__defaults__[:-1], sample))
    rows = near_copies()
    want = kept_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == want
    assert 60 <= len(want) < len(rows) - 20


def near_misses(long_words: bool = False):
    """Families of texts whose five-word Jaccard similarity is about 0.6 to the first, and two true copies among them."""
    r = random.Random(11)
    rows = []
    for f in range(20):
        first = [f"{'langes' * 6 if long_words else ''}wort{r.randrange(10**6)}" for _ in range(200)]
        rows.append(first)
        for _ in range(4):
            text = list(first)
            for at in r.sample(range(3, 200, 7), 10):
                text[at] = f"neu{r.randrange(10**6)}"
            rows.append(text)
    rows.append(rows[7][:-1] + ["anders"])
    rows.append([*rows[31], "mehr"])
    return [(d, " ".join(t)) for d, t in enumerate(rows)]


def test_near_misses_are_refuted_before_their_sets_move(spark, monkeypatch):
    from tessel.llm import shinglesets

    moved = []
    plain = shinglesets.joined_sets
    monkeypatch.setattr(shinglesets, "joined_sets", lambda *a: (moved.append(a[1].select("rep").distinct().count()), plain(*a))[1])
    rows = near_misses()
    found = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r["doc_id"] for r in found.collect()} == kept_by_brute_force(rows) == set(range(100))
    assert moved == [0]


def test_parities_bound_what_sets_have_alone():
    import numpy as np
    from tessel.llm import shinglesets

    r = np.random.default_rng(5)
    refuted = 0
    for _ in range(300):
        both, alone = r.integers(0, 400), r.integers(0, 120, 2)
        x = r.integers(0, 1 << 63, both + alone.sum(), dtype=np.uint64)
        a, b = x[: both + alone[0]], np.concatenate((x[:both], x[both + alone[0] :]))
        held = shinglesets.Parities([shinglesets.parity(a), shinglesets.parity(b), shinglesets.parity(a)])
        apart = held.apart(0, np.array([1, 2])).tolist()
        assert apart[0] <= alone.sum() and apart[1] == 0
        assert held.apart(1, np.array([0])).tolist() == apart[:1]
        allowed = apart[0] <= shinglesets.most_apart(len(a), len(b), 0.8)
        assert allowed or both < 0.8 * len(x)
        refuted += not allowed
    assert refuted > 100
    assert shinglesets.parity(np.zeros(0, np.uint64)) == bytes(8)


def test_near_dedup_shuffles_no_texts(spark):
    def shuffled():
        jvm = spark._jvm
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    rows = near_misses(long_words=True)
    rows = [(d + len(rows) * k, t.replace("wort", f"{chr(97 + k) * 3}")) for k in range(10) for d, t in rows]
    docs = spark.createDataFrame([(d, t, random.Random(d).randbytes(20_000)) for d, t in rows], "doc_id long, text string, other binary").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs.localCheckpoint()
        start = shuffled()
        out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
        out.write.format("noop").mode("overwrite").save()
        moved = shuffled() - start
        assert out.count() == 1000
        assert moved < 0.5 * 20_000 * len(rows), moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark).limit(0), "").count() == 0


def test_stages_with_names_that_clash(spark):
    docs = frame(spark).selectExpr("doc_id", "text", "lang", "n_chars", "source as gone_id", "lang_pred as fp", "1 as other_0", "2 as component_id", "3 as form", "4 as kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.count() > 100


def test_run_on_the_small_tables(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0


def test_registry_has_one_query_per_operator():
    from tessel.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
