"""Evaluation passages inside a training corpus, by greedy string tiling.

Seeds are shared runs of words, found by running Karp-Rabin hashes; they grow to maximal matches, and the
longest match that overlaps no earlier one is marked first, again and again, so that reordered passages are
covered tile by tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.rolling import rolling_hashes
from leafmill.functions.words import WordHash, word_array, words
from leafmill.session import materialise, spread


def tiles(text: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(place in text, place in item, length) of greedy string tiling with tiles of ``size`` words or more."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(rolling_hashes(item, size).tolist()):
        places.setdefault(h, []).append(j)
    a, b = text.tolist(), item.tolist()
    heap: list[tuple[int, int, int]] = []
    for i, h in enumerate(rolling_hashes(text, size).tolist()):
        for j in places.get(h, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= size:
                heap.append((-n, i, j))
    heapq.heapify(heap)
    in_text, in_item, out = bytearray(len(a)), bytearray(len(b)), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [not (in_text[i + k] or in_item[j + k]) for k in range(n)]
        if all(free):
            in_text[i : i + n] = in_item[j : j + n] = b"\1" * n
            out.append((i, j, n))
            continue
        k = 0
        while k < n:  # what is left of the match between marked words
            if free[k]:
                end = k
                while end < n and free[end]:
                    end += 1
                if end - k >= size:
                    heapq.heappush(heap, (k - end, i + k, j + k))
                k = end
            k += 1
    return out


_OUT = "doc long, item long, longest int, covered int, item_words int, tiles int"


def _row(doc: int, item: int, found: list[tuple[int, int, int]], n: int) -> tuple:
    return doc, item, max(x[2] for x in found), sum(x[2] for x in found), n, len(found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=["doc", "item", "longest", "covered", "item_words", "tiles"])


def _seeds(size: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            h, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, text in zip(batch[key].to_pylist(), batch["text"].to_pylist()):
                s = np.unique(rolling_hashes(hashes.of(words(text)), size)).view(np.int64)
                h.append(s), ids.append(np.full(len(s), i, dtype=np.int64))
            yield pa.record_batch({"h": pa.array(np.concatenate(h)), key: pa.array(np.concatenate(ids))})

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", doc_text: str = "text", item_text: str = "text", min_tile: int = 12, broadcast_seeds: int = 2_000_000, split: int = 10_000) -> DataFrame:
    """``doc, item, longest, covered, item_words, tiles, coverage``: every pair with a common run of at least
    ``min_tile`` words, however reordered the rest: longest tile, words of the item under tiles, their share.

    Null texts and items under ``min_tile`` words have no rows; rows repeated with the same ids count once. The
    items go to every executor if they have at most ``broadcast_seeds`` words, so that there are no more seeds;
    otherwise seeds of both sides are joined, those that more than ``split`` documents have in several tasks. The corpus
    is scanned once and not shuffled in the first case.
    """
    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.col(doc_text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    tests = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    seeds = tests.mapInArrow(_seeds(min_tile, "item"), "h long, item long")
    size = tests.agg(F.sum(F.size(word_array(F.col("text")))).alias("n")).first()["n"] or 0
    if size <= broadcast_seeds:
        spark = docs.sparkSession
        held = tests.collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in held])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            known = {}
            index: dict[int, list[int]] = {}
            for i, text in sent.value:
                known[i] = hashes.of(words(text))
                for h in np.unique(rolling_hashes(known[i], min_tile)).tolist():
                    index.setdefault(h, []).append(i)
            every = np.array(sorted(index), dtype=np.uint64)
            for batch in batches:
                rows = []
                for d, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                    own = hashes.of(words(text))
                    h = rolling_hashes(own, min_tile)
                    if not len(h) or not len(every):
                        continue
                    at = np.searchsorted(every, h)
                    hit = h[every[np.minimum(at, len(every) - 1)] == h]
                    for i in sorted({i for x in hit.tolist() for i in index[x]}):
                        if found := tiles(own, known[i], min_tile):
                            rows.append(_row(d, i, found, len(known[i])))
                yield _batch(rows)

        out = spread(texts).mapInArrow(scan, _OUT)
    else:
        seeds = materialise(seeds)
        mine = materialise(texts.mapInArrow(_seeds(min_tile, "doc"), "h long, doc long").join(seeds.select("h").distinct(), "h", "left_semi"))
        parts = F.ceil(F.col("df") / F.lit(split)).cast("int")
        df = mine.groupBy("h").agg(F.count("*").alias("df"))
        left = mine.join(df, "h").withColumn("salt", F.pmod(F.xxhash64("doc"), parts).cast("int"))
        right = seeds.join(df, "h").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        pairs = left.join(right, ["h", "salt"]).select("doc", "item").distinct()

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for batch in batches:
                rows = []
                for d, i, x, y in zip(*(batch[c].to_pylist() for c in ("doc", "item", "text", "test"))):
                    test = hashes.of(words(y))
                    if found := tiles(hashes.of(words(x)), test, min_tile):
                        rows.append(_row(d, i, found, len(test)))
                yield _batch(rows)

        both = pairs.join(texts, "doc").join(tests.withColumnRenamed("text", "test"), "item").select("doc", "item", "text", "test")
        out = both.mapInArrow(check, _OUT)
    best = F.max(F.struct("longest", "covered", "item_words", "tiles")).alias("m")
    return out.groupBy("doc", "item").agg(best).select("doc", "item", "m.*").withColumn("coverage", F.col("covered") / F.col("item_words"))
