"""Near-duplicate records with small edits, by circulant MinHash.

Signature: one permutation ``sigma`` scatters the shingle buckets, a second one ``pi`` is shifted
circularly by 0, 1, 2, ... and gives every coordinate as the least shifted rank of the set. Bands of
``rows`` coordinates are hashed, one shuffle brings equal bands together, and each candidate pair is
verified by the exact Jaccard similarity of its word shingles.

Groups don't need every pair: each text of a bucket is verified against the bucket's first one, and only texts of
one bucket that are still in different components are paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.memo import Memo
from leafmill.functions.rolling import rolling_hashes
from leafmill.functions.words import WordHash, mix64, window_hashes, words
from leafmill.session import materialise, spread

def mix32(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that spreads every input bit, in place."""
    t = h >> np.uint32(16)
    for factor, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        h ^= t
        h *= np.uint32(factor)
        np.right_shift(h, np.uint32(shift), out=t)
    h ^= t
    return h


def _keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, 2, dtype=np.uint32)


KEYS = Memo(_keys, 16)


def signature(shingles: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """``size`` coordinates of a set of 64-bit shingle hashes.

    Both permutations are keyed bijections of the 2^32 buckets, computed and not stored: ``sigma`` of a bucket is
    shifted circularly (modulo 2^32) by the coordinate's number before ``pi`` ranks it.
    """
    keys = KEYS[seed]
    at = mix32(np.unique((shingles >> np.uint64(32)).astype(np.uint32)) ^ keys[0]) ^ keys[1]
    shifts = np.arange(size, dtype=np.uint32)
    best = np.full(size, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(at), 256):
        np.minimum(best, mix32(at[i : i + 256, None] + shifts).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates, of one signature or of each row of signatures."""
    parts = sig.reshape(*sig.shape[:-1], -1, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:-1], dtype=np.uint64)
    for i in range(rows):
        key = mix64(key + parts[..., i] + np.uint64(1))
    return mix64(key + np.arange(key.shape[-1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bands(shingle: int, bands: int, rows: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), {}
        for batch in batches:
            sigs, ids = [], []
            for cid, text in zip(batch["cid"].to_pylist(), batch["text"].to_pylist()):
                # a text met twice in a task is known to have copies; more rows of it add nothing
                n = seen.get(cid, 0)
                if n >= 2:
                    continue
                w = words(text)
                if len(w) < max(min_words, shingle):
                    continue
                seen[cid] = n + 1
                sigs.append(signature(rolling_hashes(hashes.of(w), shingle), bands * rows))
                ids.append(cid)
            if sigs:
                keys = band_keys(np.stack(sigs), rows)
                yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)), "cid": pa.array(np.repeat(np.array(ids, dtype=np.int64), bands))})

    return run


def _runs(limit: int):
    """Pairs within each run of equal keys, of different components where there is a column ``comp``; runs longer than
    ``limit`` come out as (key, cid) rows."""

    def pairs(key: np.ndarray, cid: np.ndarray, comp: np.ndarray | None) -> list[tuple]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        out = []
        for m in np.unique(length):
            if m == 1:
                continue
            at = start[length == m]
            if m > limit:
                rows = (at[:, None] + np.arange(m)).ravel()
                out.append((key[rows], cid[rows], np.ones(len(rows), dtype=bool)))
                continue
            i, j = np.triu_indices(m, 1)
            a, b = cid[at[:, None] + i].ravel(), cid[at[:, None] + j].ravel()
            if comp is not None:
                apart = comp[at[:, None] + i].ravel() != comp[at[:, None] + j].ravel()
                a, b = a[apart], b[apart]
            out.append((a, b, np.zeros(len(a), dtype=bool)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                a, b, hot = (np.concatenate(x) for x in zip(*parts))
                table = pa.table({"a": a, "b": b, "hot": hot}).group_by(["a", "b", "hot"]).aggregate([])
                yield from table.select(["a", "b", "hot"]).combine_chunks().to_batches()

        key = cid = comp = np.empty(0, dtype=np.int64)
        parted, spilled = None, False  # the pending run has outgrown the limit and its head is out already
        for batch in batches:
            k, c = np.asarray(batch["key"]), np.asarray(batch["cid"])
            m = np.asarray(batch["comp"]) if "comp" in batch.schema.names else c
            if not len(k):
                continue
            if spilled:
                n = int(np.argmax(k != key[-1])) if (k != key[-1]).any() else len(k)
                yield from emit([(k[:n], c[:n], np.ones(n, dtype=bool))] if n else [])
                k, c, m = k[n:], c[n:], m[n:]
                if not len(k):
                    continue
                key, cid, comp, spilled = k[:0], c[:0], m[:0], False
            key, cid, comp = np.r_[key, k], np.r_[cid, c], np.r_[comp, m]
            parted = comp if "comp" in batch.schema.names else None
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            yield from emit(pairs(key[:last], cid[:last], parted if parted is None else comp[:last]) if last else [])
            key, cid, comp = key[last:], cid[last:], comp[last:]
            if len(key) > limit:
                yield from emit([(key, cid, np.ones(len(key), dtype=bool))])
                key, cid, comp, spilled = key[:1], cid[:1], comp[:1], True
        if len(key) and not spilled:
            yield from emit(pairs(key, cid, None if parted is None else comp))

    return run


def _prefix_candidates(ids: DataFrame, base: DataFrame, shingle: int, threshold: float, split: int = 512) -> DataFrame:
    """Candidates among texts of overfull buckets (``cid``, and ``comp`` if only pairs of different components are
    wanted), exactly: two sets of similarity ``threshold`` share one of the rarest n - ceil(threshold * n) + 1
    shingles of each. The texts of a shingle that more than ``split`` of them hold are spread over several tasks; with
    components the texts of its most frequent one stand on one side of the join only."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for cid, text in zip(batch["cid"].to_pylist(), batch["text"].to_pylist()):
                s = np.unique(window_hashes(hashes.of(words(text)), shingle)).view(np.int64)
                yield pa.record_batch({"cid": pa.array(np.full(len(s), cid)), "s": pa.array(s), "n": pa.array(np.full(len(s), len(s)))})

    texts = base.join(ids.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    rows = materialise(texts.mapInArrow(shingles, "cid long, s long, n long"))
    df = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(df, "s", "left").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("all"))
    prefix = ranked.select("cid", "n", F.explode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("p")).select("cid", "n", "p.s", "p.df").where("df > 1")
    near = (F.col("x.cid") != F.col("y.cid")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
    if "comp" in ids.columns:
        prefix = materialise(prefix.join(ids.distinct(), "cid"))
        most = prefix.groupBy("s", "comp").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("s", "top")
        prefix = prefix.join(most, "s")
        left, near = prefix.where("comp <> top"), near & (F.col("x.comp") != F.col("y.comp"))
    else:
        left, near = prefix, near & (F.col("x.cid") < F.col("y.cid"))
    parts = F.ceil(F.col("df") / F.lit(split)).cast("int")
    x = left.withColumn("salt", F.pmod(F.xxhash64("cid"), parts).cast("int")).alias("x")
    y = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    return x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.salt") == F.col("y.salt")) & near).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))


def _verify(shingle: int, threshold: float):
    def grams(text: str) -> frozenset:
        w = words(text)
        return frozenset(zip(*(w[i:] for i in range(shingle))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = Memo(grams, 256)
        for batch in batches:
            a, b, sim = [], [], []
            cols = (batch[c].to_pylist() for c in ("ma", "mb", "ta", "tb"))
            for ma, mb, ta, tb in zip(*cols):
                x, y = cached[ta], cached[tb]
                both = len(x & y)
                j = both / max(1, len(x) + len(y) - both)
                if j >= threshold:
                    a.append(ma), b.append(mb), sim.append(j)
            yield pa.record_batch({"ma": pa.array(a, pa.string()), "mb": pa.array(b, pa.string()), "jaccard": pa.array(sim, pa.float64())})

    return run


def _checked(pairs: DataFrame, base: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``ma, mb, jaccard`` (ma <= mb) of those pairs of texts (``a, b``) whose similarity reaches the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = base.join(ids, "cid", "left_semi").withColumn("md5", F.md5("text")).dropDuplicates(["cid", "md5"])
    left = texts.select(F.col("cid").alias("a"), F.col("md5").alias("ma"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("md5").alias("mb"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("ma", "mb", "ta", "tb")
    checked = both.mapInArrow(_verify(shingle, threshold), "ma string, mb string, jaccard double")
    return checked.groupBy(F.least("ma", "mb").alias("ma"), F.greatest("ma", "mb").alias("mb")).agg(F.max("jaccard").alias("jaccard"))


def _keyed(records: DataFrame, text: str, shingle: int, min_words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    base = records.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("cid"), F.col(text).alias("text"))
    return base, spread(base).mapInArrow(_bands(shingle, bands, rows, min_words), "key long, cid long")


def similar_classes(records: DataFrame, text: str = "text", shingle: int = 5, threshold: float = 0.8, min_words: int = 0, bands: int = 48, rows: int = 4, bucket_limit: int = 512) -> DataFrame:
    """Pairs of different texts (by their md5) whose shingle sets have at least ``threshold``, with the
    similarity; a text that occurs in several rows comes as a pair with itself.

    Null texts and texts under ``min_words`` (or ``shingle``) words have no pairs. Repeated rows are one
    text. 48 bands of 4 find a pair of similarity 0.6 with probability 0.9987, of 0.7 with 0.999998.
    """
    base, keyed = _keyed(records, text, shingle, min_words, bands, rows)
    found = keyed.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_runs(bucket_limit), "a long, b long, hot boolean")
    found = materialise(found)
    pairs = found.where("not hot").select("a", "b").distinct()
    hot = found.where("hot")
    if not hot.isEmpty():
        pairs = pairs.union(_prefix_candidates(hot.select(F.col("b").alias("cid")), base, shingle, threshold)).union(hot.select(F.col("b").alias("a"), "b")).distinct()
    return _checked(pairs, base, shingle, threshold)


def members(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct (key, md5 of the text): rows delivered again count once."""
    return records.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.md5(text).alias("md5")).distinct()


def expand(checked: DataFrame, of: DataFrame, expand_copies: int = 64) -> DataFrame:
    """``a, b`` (a < b): pairs of keys from pairs of texts (``ma, mb``; a text paired with itself has copies that
    count) and the texts' keys (``id, md5``).

    Where one text has more than ``expand_copies`` keys, its first key stands for it in pairs with other texts
    and is paired with each copy; nothing is lost, as copies are equal, and the output stays linear in them.
    """
    checked = materialise(checked)
    wanted = checked.select(F.explode(F.array("ma", "mb")).alias("md5")).distinct()
    of = materialise(of.join(wanted, "md5", "left_semi").select("id", "md5"))
    stats = of.groupBy("md5").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    of = of.join(stats, "md5")
    shown = of.where((F.col("n") <= expand_copies) | (F.col("id") == F.col("first"))).select("md5", "id")
    cross = checked.where("ma <> mb").join(shown.select(F.col("md5").alias("ma"), F.col("id").alias("x")), "ma").join(shown.select(F.col("md5").alias("mb"), F.col("id").alias("y")), "mb").where("x <> y")
    copies = of.where("n > 1").join(checked.where("ma = mb").select(F.col("ma").alias("md5")), "md5", "left_semi")
    star = copies.where((F.col("n") > expand_copies) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    few = copies.where(F.col("n") <= expand_copies).select("md5", "id")
    inner = few.alias("l").join(few.alias("r"), (F.col("l.md5") == F.col("r.md5")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    return cross.select("x", "y").union(star).union(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_pairs(records: DataFrame, key: str = "chunk_id", text: str = "text", expand_copies: int = 64, **how) -> DataFrame:
    """``a, b`` (a < b): every pair of keys whose texts are similar; exact copies of one text are paired with
    each other too (see ``expand`` for texts with very many keys)."""
    return expand(similar_classes(records, text, **how), members(records, key, text), expand_copies)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, root``: the least id connected with each id of ``a, b`` edges, by alternating large-star and
    small-star rounds; each round is written to the shared folder. Ids without an edge aren't listed."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where("b > a").select("b", "m").where("b <> m").distinct().toDF("a", "b")

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(least, "a").select("b", "m").union(least.select("a", "m")).where("b <> m").distinct().toDF("a", "b")

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        now = materialise(small_star(large_star(now)))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def near_duplicate_groups(records: DataFrame, key: str = "chunk_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, min_words: int = 0, bands: int = 48, rows: int = 4, bucket_limit: int = 512) -> DataFrame:
    """``id, group_id, group_size``: one row for each key. Group = keys connected by similar texts, named by its
    least key. A null text stands alone.

    The work is linear in the texts of a bucket: all are verified against its first text, and only buckets whose
    texts are then in different components have these paired, across components only.
    """
    base, keyed = _keyed(records, text, shingle, min_words, bands, rows)
    keyed = materialise(keyed)
    first = keyed.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("key", "a")
    star = materialise(keyed.join(first, "key").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    linked = materialise(_checked(star, base, shingle, threshold).select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b"))
    roots = materialise(components(linked))
    named = base.select("cid", F.md5("text").alias("md5")).distinct()
    comp = named.join(roots, F.col("md5") == F.col("id")).select("cid", F.xxhash64("root").alias("comp"))
    label = star.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(comp.groupBy("cid").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")), "cid", "left")
    # a hash that stands for several texts of different components has none
    label = label.select("cid", F.when(F.col("comp") == F.col("other"), F.col("comp")).otherwise(F.xxhash64("cid", F.lit(1))).alias("comp"))
    buckets = keyed.join(label, "cid")
    mixed = buckets.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = buckets.join(mixed, "key").select("key", "cid", "comp")
    found = materialise(open_.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_runs(bucket_limit), "a long, b long, hot boolean"))
    pairs, hot = found.where("not hot").select("a", "b").distinct(), found.where("hot")
    if not hot.isEmpty():
        apart = hot.select(F.col("b").alias("cid")).distinct().join(label, "cid")
        pairs = pairs.union(_prefix_candidates(apart, base, shingle, threshold)).distinct()
    pairs = materialise(pairs.join(star, ["a", "b"], "left_anti"))
    # classes of texts: what is left are edges between the components found so far, and keys with several texts
    to_root = lambda df, c: df.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    cross = _checked(pairs, base, shingle, threshold).select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    long = named.join(keyed.select("cid").distinct(), "cid", "left_semi").select("md5").distinct()
    of = materialise(members(records, key, text).join(long, "md5", "left_semi").join(roots.select(F.col("id").alias("md5"), "root"), "md5", "left").select("id", F.coalesce("root", "md5").alias("root")).distinct())
    several = of.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").join(of, "id").select("a", F.col("root").alias("b"))
    again = components(to_root(to_root(cross, "a"), "b").union(several))
    placed = of.join(again.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")).distinct()
    groups = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    every = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    out = every.join(placed.join(groups, "root").select("id", "group_id", "group_size"), "id", "left")
    return out.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
