"""The join of shingle sets against brute force, its bounds, tiles and border cases."""

import random

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import oracle
from conftest import SMALL
from test_dedup import docs
from test_near_copies import copies
from vigilake.llm import linking, set_join


def plain_set(text, width=3):
    words = (text or "").lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(texts, percent=90, width=3):
    sets = [plain_set(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def edited(words, rng, n):
    other = list(words)
    for _ in range(n):
        at = rng.randrange(len(other))
        step = rng.random()
        if step < 0.4:
            other[at] = f"new{rng.randrange(9)}"
        elif step < 0.7 and len(other) > 1:
            del other[at]
        else:
            other.insert(at, "extra")
    return other


def texts_near_the_threshold(seed=1):
    rng = random.Random(seed)
    out = copies(seed)
    for n in (5, 9, 12, 14, 20, 21, 33, 60, 150, 400):
        for _ in range(4):
            words = [f"v{rng.randrange(300)}" for _ in range(n)]
            out += [" ".join(edited(words, rng, e)) for e in range(1 + max(1, n // 25) + 1)]
    out.append("x " * 50_000 + "end")  # a long text of few different shingles
    out += ["wort " * 3, "wort", "wort wort", "WORT  wort"]
    return out


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_components_match_brute_force(spark, block_rows):
    texts = texts_near_the_threshold()
    want, sizes = plain_components(texts)
    assert len(set(want)) < len(texts) - 100
    rows = docs(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r for r in set_join.join_sets(rows, block_rows=block_rows).collect()}
    assert [found[i]["component_id"] for i in range(len(texts))] == want
    assert [found[i]["size"] for i in range(len(texts))] == sizes


@pytest.mark.parametrize("percent,width", [(80, 5), (95, 1)])
def test_other_thresholds(spark, percent, width):
    texts = texts_near_the_threshold(7)[:250]
    want, _ = plain_components(texts, percent, width)
    found = set_join.join_sets(docs(spark, list(enumerate(texts))), width=width, percent=percent).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert [got[i] for i in range(len(texts))] == want


def test_large_tiles_of_near_copies(spark, monkeypatch):
    """Groups far larger than a leaf, chained copies, and a look-alike group that is not linked."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    far = base[:100] + [f"c{i}" for i in range(20)]
    texts = [" ".join(edited(words, rng, rng.randint(0, 3))) for words in (base, far) for _ in range(150)]
    want, _ = plain_components(texts)
    for block_rows in (2048, 40):
        found = set_join.join_sets(docs(spark, list(enumerate(texts))), block_rows=block_rows).collect()
        got = {r["doc_id"]: r["component_id"] for r in found}
        assert [got[i] for i in range(len(texts))] == want


def test_border_cases(spark):
    a = "one two three four five"
    rows = [(5, None), (6, ""), (7, " \n"), (8, a), (3, a.upper()), (8, a), (8, "another text of this id"), (None, a),
            (None, None), (None, "lonely words here"), (9, "one two three four five six")]
    found = sorted(((r["doc_id"], r["size"], r["component_id"]) for r in set_join.join_sets(docs(spark, rows)).collect()), key=str)
    assert found == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 3, 3), (3, 3, 3), (8, 3, 3), (8, 3, 8), (None, 3, 3),
                            (None, 0, None), (None, 1, None), (9, 4, 9)], key=str)
    assert set_join.join_sets(docs(spark, [])).count() == 0


def test_query_matches_sql(spark):
    found = entry.queries()["op11_jaccard_join"](spark, SMALL)
    assert oracle.compare(found, oracle.connect(SMALL), entry.oracle_sql()["op11_jaccard_join"]) is None


def test_linked_sets_share_a_segment():
    rng = random.Random(3)
    for n in (9, 10, 13, 14, 17, 40, 41, 200, 333, 1000):
        for _ in range(30):
            tokens = sorted(rng.sample(range(1 << 40), n + 40))
            rng.shuffle(tokens)
            apart = set_join.most_apart(n, 90)
            less = rng.randint(0, apart)
            a, b = tokens[:n], tokens[less:n] + tokens[n:n + apart - less]
            a, b = (np.unique(set_join.mixed(np.array(t, dtype=np.uint64))) for t in (a, b))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert set(set_join.segment_keys(a, 90)) & set(set_join.segment_keys(b, 90))


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(6)
    points = rng.poisson(rng.choice([0.5, 4, 5], (300, 1)), (300, set_join.GROUPS)).astype(set_join.COUNT)
    points[150:] = points[:150]
    points[150:, 0] += 1
    size = points.sum(axis=1).astype(np.int64)
    comp = np.arange(300)
    met = set()
    for i, j in set_join.tree_join(90, 8)(points, size, comp, np.zeros(300)):
        met |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    i, j = np.triu_indices(300, 1)
    good = (set_join.score(90)(points[i], points[j], size[i], size[j]) >= 0) & linking.sizes_match(size[i], size[j], 90)
    wanted = set(zip(i[good].tolist(), j[good].tolist()))
    assert wanted and wanted <= met < set(zip(i.tolist(), j.tolist()))
    assert len(met) < len(i) / 2


def test_few_and_many_links_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(1000, 1060)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    found = lambda: {r.node: r.root for r in linking.grouped(links).collect()}
    few = found()
    monkeypatch.setattr(linking, "FEW_LINKS", 0)
    assert found() == few and len(set(few.values())) > 5
    assert linking.grouped(links.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_a_family_about_the_threshold_is_not_given_out_pair_by_pair(spark, monkeypatch, block_rows):
    """Copies whose differences are about the threshold: bounds allow most pairs, few are links."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(edited(base, rng, rng.choice([3, 5, 5, 6, 6, 7]))) for _ in range(160)]
    want, _ = plain_components(texts)
    assert 20 < len(set(want)) < 150
    whole, real = [], linking._whole
    monkeypatch.setattr(linking, "_whole", lambda percent: whole.append(percent) or real(percent))
    rows = docs(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r["component_id"] for r in set_join.join_sets(rows, block_rows=block_rows).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert whole or block_rows < len(texts)


def test_links_of_a_unit_on_whole_sets():
    """More shared tokens than a strip; known components are left out; copies across strips are linked."""
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 2**40, 3000) for _ in range(4)]
    grams = [np.unique(np.append(x[n * 40:], rng.integers(0, 2**40, n * 10))) for x in sets for n in range(5)]
    unit = pd.DataFrame({"key": 1, "lo": 0, "hi": 0, "node": range(20), "comp": [0, 0, *range(2, 20)], "grams": grams})
    links = {tuple(x) for x in pd.concat(linking._whole(90)(iter([unit[:7], unit[7:]]))).to_numpy().tolist()}
    near = {(i, j) for j in range(20) for i in range(j) if (i, j) != (0, 1) and 100 * len(np.intersect1d(grams[i], grams[j]))
            >= 90 * len(np.union1d(grams[i], grams[j]))}
    assert links <= near and len(links) < len(near)

    def groups(edges):
        label = list(range(20))
        for _ in range(20):
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert groups(links | {(0, 1)}) == groups(near | {(0, 1)})


def test_rows_of_the_pair_search_grow_with_a_units_rows():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    compare = linking._compare("all", 90, set_join.COUNT, set_join.score(90), set_join.tree_join(90))

    def given_out(n):
        tokens = [set_join.token_set(" ".join(edited(base, rng, 4)), 3) for _ in range(n)]
        size = [len(t) for t in tokens]
        unit = pd.DataFrame({"node": range(n), "key": 7, "lo": 0, "hi": 0, "block": 0, "comp": range(n), "size": size,
                             "sig": [set_join.point(t) for t in tokens]}).sort_values("size")
        return pd.concat(compare(iter([unit])))

    for n in (100, 400):
        out = given_out(n)
        assert 0 < len(out) <= linking.DENSE_PAIRS * n
        assert out["a"].notna().any() or out[linking.UNIT].to_numpy().tolist() == [[7, 0, 0]]
