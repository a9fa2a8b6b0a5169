"""Line, substring and near-duplicate removal against brute force, and their border cases."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from vigilake.llm import line_dedup, simhash, substrings
from vigilake.llm.suffix_sort import common_prefix, deep_shallow_sort

DOCS = "doc_id long, text string, dropped string, fp string, parts string, row_key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k") for i, t in rows], DOCS)


# ---- lines

def test_lines_stay_in_the_largest_document(spark):
    line = "A line of twenty characters"
    rows = [(1, f"{line}\nshort"), (2, f" {line.upper()} \n"), (3, f"x\n{line}\n{line}"), (4, None), (5, ""),
            (None, line)]
    found = line_dedup.dedup_lines(docs(spark, rows)).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found}
    assert got[1] == ("short", 2, 1)
    assert got[2] == ("", 2, 1)
    assert got[3] == (f"x\n{line}\n{line}", 3, 0)
    assert got[4] == ("", 1, 0) and got[5] == ("", 1, 0)
    assert got[None] == ("", 1, 1)


def test_lines_of_repeated_rows_count_once(spark):
    line = "a line of twenty characters"
    found = line_dedup.dedup_lines(docs(spark, [(1, line), (1, line), (2, line)])).collect()
    assert [r["n_dropped"] for r in found] == [0, 0, 0]


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# ---- substrings

def brute_substrings(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def planted_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = [None, "", "a", "ab" * 150, "x" * 90, "x" * 41]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 8)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a:len(p) - rng.randint(0, len(p) // 3)], word()]
        texts.append("".join(parts))
    return texts + texts[10:14]


def check_substrings(spark, texts, **options):
    frame = docs(spark, list(enumerate(texts)))
    found = substrings.dedup_substrings(frame, length=40, piece=16, **options).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == dict(enumerate(brute_substrings(texts, 40)))


def test_substrings_match_brute_force(spark):
    check_substrings(spark, planted_texts(1))


def test_substrings_of_split_buckets_match_brute_force(spark):
    check_substrings(spark, planted_texts(2), bucket_rows=3)


def test_substrings_query_matches_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = entry.queries()["op5_suffix_dedup"](spark, SMALL).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == dict(zip(rows, brute_substrings(rows.values(), 200)))


def test_substrings_of_repeated_and_no_rows(spark):
    text = "some words that are repeated by a whole row of the table"
    found = substrings.dedup_substrings(docs(spark, [(1, text), (1, text)]), length=40, piece=16).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in found] == [(len(text), 1)] * 2
    assert substrings.dedup_substrings(docs(spark, []), length=40, piece=16).count() == 0


def test_deep_shallow_sort_orders_and_measures():
    rng = random.Random(3)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(20))
        strings = [base[:rng.randint(0, 20)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6)))
                   for _ in range(rng.randint(1, 30))]
        order, shared = deep_shallow_sort(strings)
        assert [strings[i] for i in order] == sorted(strings)
        assert shared[0] == -1
        assert all(shared[i] == common_prefix(strings[order[i - 1]], strings[order[i]]) for i in range(1, len(order)))


def test_windows_of_large_and_small_buckets_agree(monkeypatch):
    rng = random.Random(5)
    piece = b"0123456789abcdef"
    for _ in range(30):
        n = rng.randint(2, 9)
        left = [bytes(rng.choice(b"xy") for _ in range(24)) for _ in range(2)]
        right = [bytes(rng.choice(b"xy") for _ in range(24)) for _ in range(2)]
        offsets = [rng.randint(0, 24) for _ in range(n)]
        spans = []
        for o in offsets:
            least = rng.randint(0, o)
            spans.append(rng.choice(left)[24 - o:] + piece + rng.choice(right)[:24 - least])
        few = substrings.repeated_windows(spans, offsets, [1] * n, 40, 16)
        monkeypatch.setattr(substrings, "FEW", 1)
        assert substrings.repeated_windows(spans, offsets, [1] * n, 40, 16) == few
        monkeypatch.undo()


# ---- near duplicates

def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_duplicate_query_matches_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, brute_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in entry.queries()["op3_simhash_dedup"](spark, SMALL).collect()}
    assert got == want


def test_near_duplicate_border_cases(spark):
    rows = [(3, None), (2, " \t"), (None, ""), (7, "One TWO"), (6, "one\x0btwo"), (6, "one\x0btwo"), (None, "lone words here now")]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in found), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, 2), (7, 6), (6, 6), (6, 6), (None, None)], key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def linked_components(spark, fps, **options):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(nodes, **options)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = defaultdict(set)
    for f in signed:
        groups[root.get(f, f)].add(f)
    return {frozenset(g) for g in groups.values()}


def test_hot_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})
    want = defaultdict(set)
    for f, c in zip(fps, brute_components(fps)):
        want[c].add(f - (1 << 64) if f >> 63 else f)
    expected = {frozenset(g) for g in want.values()}
    assert linked_components(spark, fps) == expected
    assert linked_components(spark, fps, bucket_rows=4) == expected


def test_thresholds_are_allocated_at_least_cost():
    rng = np.random.default_rng(2)
    for _ in range(20):
        costs = [[0.0, *np.cumsum(rng.integers(1, 50, 3)).tolist()] for _ in range(3)]
        cost, chosen = simhash.allocate(costs, 3)
        every = [c for c in itertools.product(range(-1, 3), repeat=3) if sum(t + 1 for t in c) == 3]
        assert sum(t + 1 for t in chosen) == 3
        assert cost == min(sum(costs[i][t + 1] for i, t in enumerate(c)) for c in every)


def test_partitions_cover_all_bits():
    together = np.eye(64) * 50 + 25
    for parts in (2, 3):
        groups = simhash.correlated_partitions(100, together, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    roots = simhash.components(edges)
    assert roots.agg(F.max("root")).first()[0] == 0 and roots.count() == 61
