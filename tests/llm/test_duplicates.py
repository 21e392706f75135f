"""SimHash, substring dedup, components and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessel.llm import multiindex, rabitq, simhash, substrings
from tessel.llm.common import settings
from tessel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def groups(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 200), (250, 300), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert found == want
    assert components(df.limit(0)).count() == 0


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(n=160, seed=5):
    r = random.Random(seed)
    words = [f"w{k}É" for k in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(1, 400))) for _ in range(n)]
    out = []
    for text in base:
        out += [text] * r.choice([1, 1, 1, 2, 5])
        if r.random() < 0.5:
            near = text.split(" ")
            near[r.randrange(len(near))] = "CHANGED"
            out.append(" ".join(near))
    out += ["", None, " \t\n", "A\x1fb  c", "one two", "x y z", "long " * 30_000]
    return list(enumerate(out))


SCHEMA = "doc_id long, text string, fp string, component_id int, `Doc_Id` string"


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", 1, "c") for d, t in rows] + [(None, "no id", None, None, None), (0, rows[0][1], None, None, None)], SCHEMA)
    found = simhash.near_duplicates(df.repartition(5)).collect()
    assert len(found) == len(rows) + 2
    fp = {d: slow_fingerprint(t) for d, t in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = groups(fp, pairs)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
            assert r["component_id"] == want[r["doc_id"]]
    assert any(want[d] != d and fp[want[d]] != fp[d] for d in fp)


@pytest.mark.parametrize("sample", [32_768, 20])
@pytest.mark.parametrize("kind", ["random", "dense", "half"])
def test_tree_links_equal_brute_force(spark, kind, sample):
    rng = np.random.default_rng(4)
    if kind == "random":
        base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    else:  # near one another; for "half" with one half in common
        base = np.full(300, 0x0F0F0F0F12345678, np.uint64)
    flips = [[1 << int(b) for b in rng.choice(32 if kind == "half" else 64, rng.integers(0, 6), replace=False)] for _ in range(600)]
    values = sorted({int(v) ^ sum(f) for v, f in zip(np.repeat(base, 2).tolist(), flips)})
    df = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)), k) for k, v in enumerate(values)], "fp long, rep long")
    got = groups(range(len(values)), [(r["a"], r["b"]) for r in simhash.near_links(df, shard=16, sample=sample).collect()])
    want = groups(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3])
    assert got == want


def slow_substrings(rows, window=50):
    first = {}
    split = [(d, t, WORD.findall(t or "")) for d, t in rows]
    for d, _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages(seed=1, n=80):
    r = random.Random(seed)
    words = [f"é{k}" for k in range(3000)]
    shared = [r.choices(words, k=k) for k in (49, 50, 51, 75, 76, 130, 400)] + [["same"] * 120, ["a", "b"] * 60]
    rows = []
    for d in range(n):
        text = []
        for _ in range(r.randint(0, 4)):
            text += r.choice([r.choices(words, k=r.randint(0, 90)), r.choice(shared), r.choice(shared)[r.randint(0, 20) :]])
        rows.append((d, r.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(1000 + k, rows[3][1]) for k in range(5)] + [(2000, None), (2001, ""), (2002, " \x0b "), (2003, "A" * 200_000), (5, "tie " * 70), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_substrings_equal_brute_force(spark, batches):
    rows = passages()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows] + [(None, " ".join(rows[3][1].split()), None, None)], "doc_id long, text string, kept string, spans int").repartition(4)
    found = substrings.remove_duplicates(df, batches=batches).collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] is not None) == slow_substrings(rows)
    assert [r["n_removed"] for r in found if r["doc_id"] is None] == [0]


def test_a_passage_that_a_text_repeats_goes_at_every_place(spark):
    r = random.Random(6)
    more = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    rows = []
    for d in range(0, 60, 3):
        shared, around = more(r.randint(50, 62)), (more(60), more(60))
        rows += [(d, " ".join(more(40) + shared + more(40))), (d + 1, " ".join((around[0] + shared + around[1]) * 3)), (d + 2, " ".join(around[0][30:] + shared))]
    found = substrings.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(x) for x in found) == slow_substrings(rows)


def test_kept_texts_stay_as_they_are(spark):
    rows = passages(2, 20)
    df = spark.createDataFrame([(d, t, f"s{d}") for d, t in rows], "doc_id long, text string, source string")
    for r in substrings.remove_duplicates(df, texts=True).collect():
        if not r["n_removed"]:
            assert (r["doc_id"], r["kept"]) in rows
        else:
            assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_runs_are_compacted(spark):
    index = substrings.FingerprintIndex(fan_out=2)
    text = " ".join(map(str, range(80)))
    seen = None
    for k in range(5):
        batch = spark.createDataFrame([(k, text, 1)], "doc_id long, text string, form long")
        seen = batch if seen is None else seen.unionByName(batch)
        spans = index.add(batch, seen).collect()
        assert bool(spans) == (k > 0)
    assert len(index.runs) <= 2 and index.compactions == 2


def test_runs_are_merged_as_they_lie(spark):
    """Neither a shuffle nor a sort of the runs, old or new, and none of what the query's batches add to is left out."""
    index = substrings.FingerprintIndex()
    texts = [" ".join(map(str, range(k, k + 90))) for k in (0, 30, 60)]
    frames = [spark.createDataFrame([(k, t, 1)], "doc_id long, text string, form long") for k, t in enumerate(texts)]
    index.add(frames[0])
    index.add(frames[1], frames[0].unionByName(frames[1]))
    new = index.runs[-1].df
    index.runs = index.runs[:-1]
    with settings(spark, **substrings.AS_THEY_LIE):
        plan = index.shared(new)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and not re.search(r"(?<!\w)Sort \[", plan)


def test_an_index_is_opened_again(spark, tmp_path):
    text = " ".join(map(str, range(90)))
    docs = [spark.createDataFrame([(k, text if k != 1 else text[3:], 5 + k)], "doc_id long, text string, form long") for k in range(3)]
    first = substrings.FingerprintIndex(folder=str(tmp_path))
    assert first.add(docs[0]).count() == 0
    again = substrings.FingerprintIndex.open(spark, first.paths, str(tmp_path))
    spans = again.add(docs[1], docs[0].unionByName(docs[1])).collect()
    covered = {p for r in spans for k in range(r["n"]) for p in range(r["begin"] + k, r["begin"] + k + 50)}
    assert {r["doc_id"] for r in spans} == {1} and covered == set(range(len(text[3:].split())))


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert simhash.near_duplicates(docs).count() == 0
    assert substrings.remove_duplicates(docs).count() == 0
    assert rabitq.near_vectors(vectors).count() == 0
    assert multiindex.nearest(vectors).count() == 0


def vectors(seed=3, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.standard_normal(dim)
        for c in range(rng.choice([1, 1, 2, 6])):
            w = v if rng.random() < 0.3 else v + rng.standard_normal(dim) * 0.03 * rng.random()
            rows.append((w * rng.choice([1.0, 3.0])).astype(np.float32).astype(float).tolist())
    out = [(k, v, int(k % 5 == 0), "clash", 1) for k, v in enumerate(rows)]
    m = len(out)
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1)]
    out += [(m + k, v, 1, None, None) for k, v in enumerate(bad)]
    out += [(m + 10, rows[0], None, None, None), (m + 11, [1.0, 2.0], 1, None, None), (m + 12, [1.0, 2.0], 1, None, None), (None, rows[1], 1, None, None), (m + 50, [1e38] * dim, 1, None, None)]
    return out


VECTORS = "vec_id long, embedding array<double>, label int, copies string, dim int"


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosines(rows):
    rows = [r for r in rows if r[0] is not None and good(r[1])]
    unit = [np.array(r[1]) / np.abs(r[1]).max() for r in rows]
    unit = [u / np.sqrt(u @ u) for u in unit]
    return rows, lambda a, b: float(unit[a] @ unit[b]) if len(unit[a]) == len(unit[b]) else None


@pytest.mark.parametrize("dim", [24, 64, 100])
def test_near_vectors_equal_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(rabitq, "BLOCK", 40)
    rows = vectors(dim=dim)
    found = {r["vec_id"]: r for r in rabitq.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert len(found) == len(rows)
    usable, cos = cosines(rows)
    links = [(a, b) for a in range(len(usable)) for b in range(a) if usable[a][2] is not None and usable[a][2] == usable[b][2] and (cos(a, b) or 0) >= 0.98]
    ids = [r[0] for r in usable]
    want = groups([r[0] for r in rows if r[0] is not None], [(ids[a], ids[b]) for a, b in links])
    count = {i: 0 for i in want}
    for a, b in links:
        count[ids[a]] += 1
        count[ids[b]] += 1
    for i, r in found.items():
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], want[i], want[i] == i)
    assert links


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.001], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None)]
    found = rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * 0.2 * rng.random((400, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    turned, codes, factors = rabitq.encode(x)
    estimate = (rabitq.signs_of(codes, 64) * (y @ rabitq.rotation(64, rabitq.SEED).T)).sum(axis=1) / factors
    linked = (x * y).sum(axis=1) >= 0.98
    assert linked.any()
    assert (estimate[linked] >= rabitq.lowest_estimate(factors, 0.98)[linked]).all()
    assert abs((estimate - (x * y).sum(axis=1)).mean()) < 0.02


@pytest.mark.parametrize("dim", [40, 64, 200])
def test_codes_keep_pairs_at_the_threshold_and_refute_others(dim):
    """Planted pairs at 0.98 to 0.981 among 8,000 vectors around one direction; and vectors of any direction, of which none are near."""
    rng = np.random.default_rng(9)
    x = np.full(dim, 3 / np.sqrt(dim)) + rng.standard_normal((4000, dim)) / np.sqrt(dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.98, 0.981, (4000, 1))
    y = cos * x + np.sqrt(1 - cos * cos) * side

    def codes(v):
        turned, code, factor = rabitq.encode(v)
        small, scale = rabitq.Codes.shrink(turned)
        return rabitq.Codes(dim, code.tobytes(), factor.tobytes(), small.tobytes(), scale.tobytes())

    hit_x, hit_y = rabitq.undecided(codes(x), codes(y), False, dim, 0.98)
    assert hit_x.all() and hit_y.all()
    z = rng.standard_normal((4000, dim))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    alone, _ = rabitq.undecided(codes(z[:2000]), codes(z[2000:]), False, dim, 0.98)
    assert alone.mean() < (0.5 if dim < 64 else 0.01)


def test_flips_of_a_pair_at_the_threshold_are_rarely_more():
    p = np.arccos(0.98) / np.pi
    flips = np.random.default_rng(0).binomial(64, p, 1_000_000)
    assert (flips > rabitq.most_flips(64)).sum() == 0 and rabitq.most_flips(64) < 24
    assert rabitq.most_flips(8) == 8


def test_nearest_equals_brute_force_when_all_is_visited(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SHARD", 30)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    usable, cos = cosines(rows)
    want = []
    for a, r in enumerate(usable):
        if r[0] % 50 == 0:
            near = sorted((-c, usable[b][0]) for b in range(len(usable)) if usable[b][0] != r[0] and (c := cos(a, b)) is not None)[:5]
            want += [(r[0], k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(near)]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multiindex.nearest(df, visit=1.0).collect())
    exact = {(q, k): s for q, k, _, s in want}
    assert len(found) == len(want)
    assert all(abs(s - exact[q, k]) < 1e-9 for q, k, _, s in found)
    part = multiindex.nearest(df).collect()
    hits = {(q, i) for q, _, i, _ in want} & {(r["query_id"], r["vec_id"]) for r in part}
    assert len(hits) >= 0.9 * len(want)


def test_walk_is_in_order_and_whole():
    rng = np.random.default_rng(2)
    index = multiindex.MultiIndex(rng.standard_normal((200, 8)), codes=6)
    a, b = rng.random(6), rng.random(6)
    cells = list(index.walk(a, b))
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sorted(cells) == list(range(36))
    assert sums == sorted(sums)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8])
def test_few_vectors_have_all_their_neighbours(spark, n):
    rng = np.random.default_rng(n)
    rows = [(50 * k, rng.standard_normal(8).tolist()) for k in range(n)]
    found = multiindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == n * min(5, n - 1)


@pytest.mark.parametrize("n", [1000, 4000])
@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_fitted_walks_find_nine_of_ten(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    if kind == "clustered":
        x = x * 0.2 + rng.standard_normal((20, 32))[rng.integers(0, 20, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = {}
    for q in range(0, n, 50):
        c = x @ x[q]
        c[q] = -2
        near[q] = set(np.argsort(-c)[:5].tolist())
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    found = multiindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = sum(r["vec_id"] in near[r["query_id"]] for r in found)
    assert hits >= 0.9 * 5 * len(near)
    points = x[:2000]
    share = multiindex.fit_visit(multiindex.MultiIndex(points, multiindex.codes_for(n)), points, 5)
    assert share < (0.3 if kind == "clustered" else 1.01)
