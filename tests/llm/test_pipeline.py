"""Every stage of the pipeline against brute force on the rows it was given."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from test_near_copies import plain_components
from test_operators import plain_targets
from vigilake.llm.common import stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_lines(rows):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, r in rows.items():
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(holders.get(key(line), ())) >= 3 and i != max(holders[key(line)])
    return {i: "\n".join(x for x in r["text"].split("\n") if not gone(i, x)) for i, r in rows.items()}


def plain_contaminated(rows, items):
    windows = set()
    for text in items:
        words = WORD.findall(ascii_lower(text))
        windows |= {tuple(words[s:s + 10]) for s in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        words = WORD.findall(ascii_lower(text))
        return any(tuple(words[s:s + n]) in windows for n in sizes for s in range(len(words) - n + 1))

    return {i for i, r in rows.items() if hit(r["text"])}


@pytest.fixture(scope="module")
def steps(spark):
    """(input, output) rows by id of every stage; the input of the first has a few odd rows more."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("row", F.lit("clash"))
    odd = [(10_001, None, None, None, 0, "x"), (10_002, "", "en", "src0", 0, "x"), (10_003, "123 !", "en", None, 5, "x"),
           (10_004, "one short clean text", "en", None, 20, "x")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out, by_id = [], lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, rows, SMALL))
        out.append((by_id(rows), by_id(done), rows.columns, done.columns))
        rows = done
    return out


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "decontaminate", "source_mixing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_keep_the_columns(steps):
    for _, _, before, after in steps[:-1]:
        assert before == after


def test_language_stage_drops_texts_without_letters(steps):
    given, kept, _, _ = steps[0]
    assert kept == {i: r for i, r in given.items() if any(c.isalpha() for c in r["text"] or "")}


def test_line_stage(steps):
    given, kept, _, _ = steps[1]
    want = plain_lines(given)
    assert {i: r["text"] for i, r in kept.items()} == want
    assert all(r["n_chars"] == (len(want[i]) if want[i] != given[i]["text"] else given[i]["n_chars"]) for i, r in kept.items())
    assert any(want[i] != given[i]["text"] for i in want)


def test_near_duplicate_stage(steps):
    given, kept, _, _ = steps[2]
    ids = sorted(given)
    groups = plain_components([given[i]["text"] for i in ids])
    assert set(kept) == {ids[c] for c in groups} and len(kept) < len(given)
    assert all(kept[i] == given[i] for i in kept)


def test_decontamination_stage(spark, steps):
    given, kept, _, _ = steps[3]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = plain_contaminated(given, items)
    assert dirty and set(kept) == set(given) - dirty


def test_mixing_stage(steps):
    given, mixed, _, _ = steps[4]
    sizes, taken, largest = {}, {}, {}
    for i, r in given.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert mixed[i]["size"] == n and mixed[i]["taken"] == mixed[i]["copies"] * n <= 2 * n
        for table, value in ((sizes, n), (taken, mixed[i]["taken"])):
            table[r["source"]] = table.get(r["source"], 0) + value
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    assert set(mixed) == set(given)
    assert all(abs(taken[s] - t) <= largest[s] for s, t in plain_targets(sizes).items())


def test_empty_documents_pass_through(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, SMALL))
        assert rows.count() == 0
