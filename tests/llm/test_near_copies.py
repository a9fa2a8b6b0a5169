"""Near copies against brute force over exact shingle sets."""

import random

import corpus_pipeline
from conftest import SMALL
from test_dedup import docs
from vigilake.llm import linking, near_copies


def plain_shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(texts, least=0.8):
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x | sets[j] and len(x & sets[j]) >= least * len(x | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def copies(seed=3):
    """Texts with copies at five-word similarities from 0.6 to 1, and a group of near copies."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \n", "two words", "Two  WORDS", "four words are here"]
    for _ in range(60):
        words = text(rng.randint(60, 400))
        out.append(" ".join(words))
        for share in (0.005, 0.015, 0.02, 0.03, 0.05):
            other = list(words)
            for i in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                other[i] = "changed"
            out.append(" ".join(other))
    words = text(150)
    for _ in range(60):
        other = list(words)
        for i in rng.sample(range(150), rng.randint(1, 6)):
            other[i] = "changed"
        out.append(" ".join(other))
    return out


def test_components_match_exact_similarity(spark):
    texts = copies()
    want = plain_components(texts)
    assert len(set(want)) < len(texts)
    for block_rows in (2048, 16):
        found = near_copies.near_copies(docs(spark, list(enumerate(texts))), block_rows=block_rows)
        got = {r["doc_id"]: r["component_id"] for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_near_copies_of_few_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "lone")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_pipeline_stage_keeps_one_of_each_near_copy(spark):
    texts = copies()
    want = set(plain_components(texts))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, list(enumerate(texts))), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)


def test_pipeline_stage_with_repeated_ids(spark):
    copy = "a text that is here twice under two ids"
    rows = [(1, copy), (2, copy), (2, "another text of the second id that resembles nothing"), (2, copy), (3, "c"), (3, "c"), (None, copy)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, copy), rows[2], (3, "c"), (None, copy)], key=str)


def test_look_alike_groups_are_not_paired(spark, monkeypatch):
    """Two groups of near copies at a similarity of 0.72 of each other: candidates grow with the rows."""
    asked = []
    real = linking.confirmed

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(linking, "confirmed", counted)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    other = base[:335] + [f"v{i}" for i in range(65)]
    texts = []
    for words in (base, other):
        for k in range(60):
            copy = list(words)
            copy[rng.randrange(400)] = f"x{k}"
            texts.append(" ".join(copy))
    assert 0.68 < len(plain_shingles(" ".join(base)) & plain_shingles(" ".join(other))) / len(
        plain_shingles(" ".join(base)) | plain_shingles(" ".join(other))) < 0.76
    found = near_copies.near_copies(docs(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: 0 if i < 60 else 60 for i in range(120)}
    assert sum(asked) <= 12 * len(texts)


def test_recall_on_the_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(rows)
    want = plain_components([rows[i] for i in ids])
    found = near_copies.near_copies(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert [got[i] for i in ids] == [ids[c] for c in want] and len(set(want)) < len(ids)
