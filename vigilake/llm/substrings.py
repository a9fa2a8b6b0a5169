"""Substring deduplication: bytes covered by a string of `length` bytes that starts elsewhere too.

Every window of `length` bytes has an anchor: its piece of `PIECE` bytes with the
least hash, leftmost among equals. Equal windows have equal anchors at equal offsets,
so windows need comparing inside buckets of one anchor only, and windows that
share an anchor occurrence form one span. The steps:

1. anchors of all documents; those whose piece occurs once cannot repeat and go;
2. spans of the rest, equal spans counted as one class (a class of two is repeated whole);
3. per anchor, the classes' suffixes from the anchor on, and their prefixes up to it
   read backwards, are put in order by deep-shallow sorting; common prefixes with
   neighbours give, for every offset, the classes whose windows are equal;
4. covered ranges meet the documents, are merged, and the bytes outside are kept.

A bucket of more than `bucket_rows` different classes is split by the content of its
windows instead, counted by hash with map-side combination, so no task gets more.

Defined cases. Null and empty texts have no bytes and lose none. Texts shorter than
`length` bytes lose nothing. Repeated rows are copies of each other and lose all
windows. Overlapping occurrences count, inside one document as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stored
from vigilake.llm.suffix_sort import deep_shallow_sort

LENGTH = 200
PIECE = 64
FEW = 12
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def piece_hashes(data: bytes, piece: int) -> np.ndarray:
    """Hash of the `piece` (8 or more) bytes from each position on, by doubling."""
    n = len(data)
    h = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,)) * _A
    h ^= h >> _S
    size = 8
    while size < piece:
        step = min(size, piece - size)
        h = (h[:-step] * _B) ^ (h[step:] * _A)
        h ^= h >> _S
        size += step
    h *= _B
    return h ^ (h >> _S)


def anchor_spans(data: bytes, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor and anchor hash of every span of a text."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    h = piece_hashes(data, piece)
    window = length - piece + 1
    best = np.arange(len(h), dtype=np.int32)
    size = 1
    while size < window:
        step = min(size, window - size)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        size += step
    cuts = np.flatnonzero(best[1:] != best[:-1])
    first = np.concatenate(([0], cuts + 1))
    last = np.concatenate((cuts, [len(best) - 1]))
    anchor = best[first].astype(np.int64)
    return first, last, anchor, h[anchor].view(np.int64)


def repeated_windows(
    spans: list[bytes], offsets: list[int], weights: list[int], length: int, piece: int
) -> list[tuple[int, int] | None]:
    """First and last repeated window of each span of one anchor, from the span's start on.

    A window is named by `d`, its bytes before the anchor: it is repeated if another
    span has the same `d` bytes before and `length - d` bytes from the anchor on.
    """
    n = len(spans)
    most = np.array(offsets)
    least = most - np.array([len(s) for s in spans]) + length
    right = [s[o:] for s, o in zip(spans, offsets)]
    left = [s[:o][::-1] for s, o in zip(spans, offsets)]
    known = piece if len({r[:piece] for r in right}) == 1 else 0
    right_order, right_shared = deep_shallow_sort(right, known)
    left_order, left_shared = deep_shallow_sort(left)
    low, high = np.full(n, 1 << 30), np.full(n, -1)
    whole = np.array(weights) > 1
    low[whole], high[whole] = least[whole], most[whole]

    if n <= FEW:
        def between(order, shared):
            prefix = [[0] * n for _ in range(n)]
            for i in range(n):
                depth = 1 << 30
                for j in range(i + 1, n):
                    depth = min(depth, shared[j])
                    prefix[order[i]][order[j]] = prefix[order[j]][order[i]] = depth
            return prefix

        right_prefix, left_prefix = between(right_order, right_shared), between(left_order, left_shared)
        for i in range(n):
            for j in range(i + 1, n):
                a = max(least[i], least[j], length - right_prefix[i][j])
                b = min(most[i], most[j], left_prefix[i][j])
                if a <= b:
                    for k in (i, j):
                        low[k], high[k] = min(low[k], a), max(high[k], b)
    else:
        right_order, left_order = np.array(right_order), np.array(left_order)
        right_shared, left_shared = np.array(right_shared), np.array(left_shared)
        right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for d in range(int(least.min()), int(most.max()) + 1):
            right_class[right_order] = np.cumsum(right_shared < length - d)
            left_class[left_order] = np.cumsum(left_shared < d)
            here = np.flatnonzero((least <= d) & (d <= most))
            if len(here) < 2:
                continue
            _, group, count = np.unique(
                right_class[here] * (n + 1) + left_class[here], return_inverse=True, return_counts=True
            )
            again = here[count[group] > 1]
            low[again] = np.minimum(low[again], d)
            high[again] = np.maximum(high[again], d)
    return [
        None if high[i] < 0 else (int(most[i] - high[i]), int(most[i] - low[i])) for i in range(n)
    ]


def _ref(row_text: str = "text"):
    return F.xxhash64("doc_id", row_text)


def _digest(data: bytes, seed: int) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(data, seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, piece: int = PIECE, bucket_rows: int = 4096,
) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept` with `kept` the bytes that stay.

    `kept` is null where nothing was removed: the text is whole.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    ).withColumn("ref", _ref())

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, refs, counts = [], [], []
            for ref, text in zip(batch["ref"], batch["text"]):
                found, count = np.unique(anchor_spans(text, length, piece)[3], return_counts=True)
                hashes.append(found)
                counts.append(count)
                refs.append(np.full(len(found), ref))
            yield pd.DataFrame({
                "anchor": np.concatenate(hashes), "ref": np.concatenate(refs), "n": np.concatenate(counts),
            }) if hashes else pd.DataFrame({"anchor": [], "ref": [], "n": []})

    placed = stored(base.select("ref", "text").mapInPandas(anchors, "anchor long, ref long, n int"))
    shared = stored(placed.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("anchor"))
    wanted = stored(
        placed.join(shared, "anchor").groupBy("ref").agg(F.collect_set("anchor").alias("anchors"))
        .withColumnRenamed("ref", "of")
    )
    met = base.join(wanted, F.col("ref") == F.col("of"), "left").select(
        "doc_id", "ref", F.octet_length("text").cast("long").alias("n_bytes"), "anchors",
        F.when(F.col("anchors").isNull(), F.sha2("text", 256)).alias("whole"),
        F.when(F.col("anchors").isNotNull(), F.col("text")).alias("text"),
    )
    met = stored(met)
    repeating = met.where(F.col("text").isNotNull())

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ref, text, known in zip(batch["ref"], batch["text"], batch["anchors"]):
                first, last, anchor, hashed = anchor_spans(text, length, piece)
                for i in np.flatnonzero(np.isin(hashed, known)).tolist():
                    a, b, offset = int(first[i]), int(last[i]), int(anchor[i] - first[i])
                    rows.append((ref, int(hashed[i]), a, b - a, offset, *_digest(text[a:b + length], offset)))
            yield pd.DataFrame(rows, columns=["ref", "anchor", "start", "more", "offset", "c0", "c1"])

    members = stored(repeating.select("ref", "text", "anchors").mapInPandas(
        spans, "ref long, anchor long, start int, more int, offset int, c0 long, c1 long"
    ))
    classes = stored(
        members.groupBy("anchor", "c0", "c1", "more", "offset")
        .agg(F.count("*").alias("n"), F.min(F.struct("ref", "start")).alias("first"))
    )
    buckets = stored(
        classes.groupBy("anchor").agg(F.count("*").alias("n_classes"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
        .where((F.col("n_classes") > 1) & (F.col("single") > 0)).select("anchor", "n_classes")
    )
    needed = (
        classes.join(buckets, "anchor")
        .select("first.ref", F.struct("anchor", "c0", "c1", "more", "offset", "n", "n_classes", "first.start").alias("s"))
        .groupBy("ref").agg(F.collect_list("s").alias("wanted")).withColumnRenamed("ref", "of")
    )
    pick = lambda s: F.struct(
        *[s[c].alias(c) for c in ("anchor", "c0", "c1", "offset", "n", "n_classes")],
        F.substring(F.col("text"), s["start"] + 1, s["more"] + length).alias("span"),
    )
    contents = stored(
        repeating.dropDuplicates(["ref"]).join(needed, F.col("ref") == F.col("of"))
        .select(F.explode(F.transform("wanted", pick)).alias("s")).select("s.*")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("anchor", sort=False):
            found = repeated_windows(
                group["span"].tolist(), group["offset"].tolist(), group["n"].tolist(), length, piece
            )
            for c0, c1, n, window in zip(group["c0"], group["c1"], group["n"], found):
                if n == 1 and window is not None:
                    out.append((c0, c1, *window))
        return pd.DataFrame(out, columns=["c0", "c1", "low", "high"])

    def buckets_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = rows["anchor"] == rows["anchor"].iloc[-1]
            waiting = rows[last]
            if not last.all():
                yield compare(rows[~last])
        if waiting is not None:
            yield compare(waiting)

    ordered = (
        contents.where(F.col("n_classes") <= bucket_rows).repartition("anchor").sortWithinPartitions("anchor")
        .mapInPandas(buckets_in_order, "c0 long, c1 long, low int, high int")
    )

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*_digest(span[at:at + length], offset - at), c0, c1, n, at)
                for c0, c1, offset, n, span in zip(
                    batch["c0"], batch["c1"], batch["offset"], batch["n"], batch["span"])
                for at in range(len(span) - length + 1)
            ]
            yield pd.DataFrame(rows, columns=["w0", "w1", "c0", "c1", "n", "at"])

    hot = contents.where(F.col("n_classes") > bucket_rows)
    split = None
    if not hot.isEmpty():
        by_window = stored(hot.mapInPandas(windows, "w0 long, w1 long, c0 long, c1 long, n long, at int"))
        again = stored(
            by_window.groupBy("w0", "w1").agg(F.sum("n").alias("total")).where(F.col("total") > 1).select("w0", "w1")
        )
        split = (
            by_window.where(F.col("n") == 1).join(again, ["w0", "w1"])
            .groupBy("c0", "c1").agg(F.min("at").alias("low"), F.max("at").alias("high"))
        )
    whole = classes.where(F.col("n") > 1).select("c0", "c1", F.lit(0).alias("low"), F.col("more").alias("high"))
    covered = whole.unionByName(ordered)
    if split is not None:
        covered = covered.unionByName(split)
    covered = stored(covered)
    ranges = (
        members.join(covered, ["c0", "c1"])
        .select(F.col("ref").alias("of"), (F.col("start") + F.col("low")).alias("low"),
                (F.col("start") + F.col("high") + length).alias("high"))
        .groupBy("of").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"))
        .select("of", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"))
    )

    @F.pandas_udf("n_removed long, n_spans long, kept binary, sha string")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lows, highs in batches:
            rows = []
            for text, low, high in zip(texts, lows, highs):
                kept, end, runs = [], 0, 0
                for a, b in zip([] if low is None else low, [] if high is None else high):
                    if a > end or runs == 0:
                        kept.append(text[end:a])
                        runs += 1
                    end = max(end, b)
                kept.append(text[end:])
                left = b"".join(kept)
                rows.append((len(text) - len(left), runs, left, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept", "sha"])

    changed = (
        repeating.join(ranges, F.col("ref") == F.col("of"), "left")
        .select("doc_id", "n_bytes", remove("text", "low", "high").alias("r"))
        .select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", F.col("r.sha").alias("kept_sha256"), "r.kept")
    )
    same = met.where(F.col("text").isNull()).select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("whole").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"),
    )
    return changed.unionByName(same)
