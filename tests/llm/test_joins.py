"""The two similarity joins against brute force."""

import numpy as np
import pytest

from ledgerlens.llm.components import connected_components
from ledgerlens.llm.jaccard_join import SLOTS, jaccard_components, similar, slot_counts, suffix_bound
from ledgerlens.llm.shingles import Shingler
from ledgerlens.llm.vector_join import near_duplicate_vectors, spanning_forest

from ..conftest import SF_SMALL
from .data import DOCS, clashing, near_copies


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def word_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute_jaccard(rows):
    sets = {i: word_set(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y:
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    links.append((a, b))
    comp = union_find(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}, links


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_matches_brute_force(spark, seed):
    rows = near_copies(seed)
    want, links = brute_jaccard([(r[0], r[1]) for r in rows])
    assert len(links) > 30
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = jaccard_components(spark, df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_jaccard_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, _ = brute_jaccard(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard_components(spark, docs).collect()} == want


def test_jaccard_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, None), (None, None), (9, text + " w30"),
                                (None, "x " + text), (None, "far " * 9), (None, "far " * 8 + "away")], "doc_id bigint, text string")
    rows = list(map(tuple, jaccard_components(spark, df).collect()))
    far = [r for r in rows if r[0] is None and r[1] in (1, 2)]
    assert sorted(far, key=str) == [(None, 1, None), (None, 2, None)]  # an id names a component, these have none
    got = sorted((r for r in rows if r not in far), key=str)
    assert got == sorted([(5, 26, 5), (5, 26, 5), (None, 26, 5), (7, 0, 7), (None, 0, None), (9, 27, 5), (None, 27, 5)], key=str)
    assert jaccard_components(spark, df.limit(0)).count() == 0


def test_filters_never_reject_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.r_[rng.choice(x, max(1, int(len(x) * rng.uniform(0.6, 1)))), rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        slots = np.frombuffer(slot_counts(x) + slot_counts(y), dtype=np.uint8).reshape(2, SLOTS)
        assert suffix_bound(slots[0], slots[1]) <= len(x) + len(y) - 2 * both
        assert similar(x, y, 75, 100) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_shingler_counts_words_as_the_rule_says():
    s = Shingler(5)
    for text in ("a b c d e f", "A  b\tc\nd e", "é É a b c", "one", "", None, "a\xa0b c d e f"):
        assert len(s.shingles(text)) == len(word_set(text))
    assert list(s.shingles("A b")) == list(s.shingles("a  B\n"))
    assert list(s.shingles("É")) != list(s.shingles("é"))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 250), (250, 270)]
    got = dict(map(tuple, connected_components(spark, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()))
    want = union_find({x for e in edges for x in e if e != (200, 200)}, [e for e in edges if e[0] != e[1]])
    assert got == want


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    rows = []
    for v in base:
        rows.append(v)
        for _ in range(rng.integers(0, 4)):
            rows.append(v * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.uniform(0, 0.09))
    rows += [base[0]] * 5 + [-base[1]]
    out = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0] * 15 + [None], 0), (n + 3, [float("nan")] * 16, 0),
                  (n + 4, [float("inf")] * 16, 0), (n + 5, out[0][1], None), (n + 6, [], 1), (n + 7, [3.0, 4.0], 1), (n + 8, [6.0, 8.0], 1)]


def brute_vectors(rows, t=0.98):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, dtype=np.float64), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
             and ok[a][0] @ ok[b][0] / (np.linalg.norm(ok[a][0]) * np.linalg.norm(ok[b][0])) >= t]
    comp = union_find([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}, links


def test_vectors_match_brute_force(spark, monkeypatch):
    import ledgerlens.llm.vector_join as V
    monkeypatch.setattr(V, "CELL_ROWS", 10)  # many pivots and blocks on little data
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = vectors()
    want, links = brute_vectors(rows)
    assert len(links) > 40
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).withColumnRenamed("n", "rep")
    got = near_duplicate_vectors(spark, df)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert near_duplicate_vectors(spark, df.limit(0)).count() == 0


def test_one_label_with_most_vectors_among_many_small_ones(spark, monkeypatch):
    import ledgerlens.llm.vector_join as V
    monkeypatch.setattr(V, "CELL_ROWS", 20)
    monkeypatch.setattr(V, "MAX_PIVOTS", 12)
    monkeypatch.setattr(V, "BLOCK", 32)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 60] + 0.08 * rng.normal(size=8)], 0 if i < 400 else i % 40) for i in range(520)]
    want, links = brute_vectors(rows)
    assert len(links) > 400
    got = near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_labels_are_compared_in_their_own_type(spark):
    v = [1.0, 2.0]
    for kind, labels in (("double", [1.2, 1.7, 0.0, -0.0, 1.2]), ("string", ["a", "b", "c", "c", "a"])):
        df = spark.createDataFrame([(i, v, x) for i, x in enumerate(labels)], f"vec_id bigint, embedding array<double>, label {kind}")
        assert {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(spark, df).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 0}


def test_vectors_without_an_id_or_repeated(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (2, v, 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, near_duplicate_vectors(spark, df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True)], key=str)


def test_forest_spans_the_links():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.random((12, 15)) < 0.1
        r, c = spanning_forest(a)
        assert a[r, c].all()
        ids = [("r", i) for i in range(12)] + [("c", i) for i in range(15)]
        full = union_find(range(27), [(i, 12 + j) for i, j in zip(*np.nonzero(a))])
        assert union_find(range(27), [(i, 12 + j) for i, j in zip(r, c)]) == full
        assert len(r) == len(ids) - len(set(full.values()))
