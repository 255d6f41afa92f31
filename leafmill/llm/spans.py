"""Long exact spans shared between records, by FM-indexes of shards.

A shard of texts becomes a Burrows-Wheeler transform in a wavelet matrix of packed bits, with sampled suffix
positions and common-prefix lengths. Texts stream through it: backward search prepends character after character
and, where the interval of suffixes would become empty, shrinks the match from its right end to the parent interval;
so the matching statistics, the longest match that begins at each place, come out up to the wanted length, and places
that reach it give the intervals to report. In its own shard a text's match must lie in two texts.

A text is streamed through those shards only that hold a text with a winnowed fingerprint of its own (any two texts
with a common run of the wanted length share one), and only in the stretches that this fingerprint speaks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.rolling import rolling_hashes
from leafmill.functions.words import mix64
from leafmill.llm.neardup import expand, members
from leafmill.session import materialise

SAMPLE = 8  # every SAMPLE-th text position keeps its suffix position


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of ``codes`` (positive; a suffix ends before anything longer) in order, by prefix doubling
    that sorts only what is still tied."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    step = max(1, 62 // bits)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(step, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while not new.all():
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, n])
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        who = order[at]
        nxt = who + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[who]))
        order[at] = who[by]
        a, b = rank[who][by], second[by]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        new[at] = fresh
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[order[at]] = start
        step *= 2
    return order


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray | None = None, words: np.ndarray | None = None) -> None:
        if words is None:
            padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


def prefix_lengths(codes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``most``; -1 for the first."""
    bits = max(1, int(codes.max()).bit_length())
    step = max(1, 62 // bits)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(step + 1, dtype=np.int64)])
    n, key = len(codes), np.zeros(len(codes) + 1, dtype=np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n + 1]
    out = np.full(n, most, dtype=np.int64)
    todo, at = np.arange(1, n), 0
    while len(todo) and at < most:
        x, y = key[np.minimum(order[todo - 1] + at, n)], key[np.minimum(order[todo] + at, n)]
        off = np.flatnonzero(x != y)
        # the highest bit that differs names the first character that does
        high = np.frexp((x[off] ^ y[off]).astype(np.float64))[1] - 1
        high = np.where(((x[off] ^ y[off]) >> np.minimum(high, 62)) == 0, high - 1, high)
        out[todo[off]] = np.minimum(most, at + step - 1 - high // bits)
        todo, at = todo[x == y], at + step
    out[0] = -1
    return out


class FMIndex:
    """Backward search, parent intervals and location of suffixes, over one text of codes from 1 upwards.

    ``most``: common prefixes are known up to this length. ``owner``: number of the text to which each place
    belongs, so that intervals tell whether they lie in more than one.
    """

    def __init__(self, codes: np.ndarray, most: int = 1, owner: np.ndarray | None = None) -> None:
        codes = np.concatenate([codes, [0]]).astype(np.int64) + 1  # the end sorts first
        order = suffix_array(codes)
        self.n, self.sigma, self.most = len(codes), int(codes.max()) + 1, most
        bwt = codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.sigma))]).astype(np.int64)
        self.depth = max(1, int(self.sigma - 1).bit_length())
        self.levels, self.zeros, now = [], [], bwt
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        kept = order % SAMPLE == 0
        self.kept, self.samples = Bits(kept), order[kept].astype(np.int32)
        owner = np.zeros(self.n, dtype=np.int64) if owner is None else np.concatenate([owner, [-1]])[order]
        self.change = Bits(np.r_[False, owner[1:] != owner[:-1]])
        self._prefixes(prefix_lengths(codes, order, most))

    def _prefixes(self, lcp: np.ndarray) -> None:
        """Least common prefix of every run of 1, 2, 4, ... neighbouring suffixes, for parent intervals; one entry
        beyond the last suffix ends every interval."""
        now = np.r_[lcp, -1].astype(np.int16 if self.most < 2**15 else np.int32)
        self.least = [now]
        while (1 << len(self.least)) <= len(now):
            half = 1 << (len(self.least) - 1)
            low = self.least[-1].copy()
            np.minimum(low[:-half], self.least[-1][half:], out=low[:-half])
            low[len(low) - 2 * half + 1 :] = -1
            self.least.append(low)

    def dump(self) -> bytes:
        lcp = self.least[0][:-1]
        head = np.array([self.n, self.sigma, self.depth, self.most, *self.zeros], dtype=np.int64).tobytes()
        parts = [head, self.first.tobytes(), *(x.words.tobytes() for x in self.levels), self.kept.words.tobytes(), self.samples.tobytes(), self.change.words.tobytes(), lcp.tobytes()]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        parts, at = [], 0
        while at < len(data):
            k = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + k])
            at += 8 + k
        self = cls.__new__(cls)
        head = np.frombuffer(parts[0], dtype=np.int64)
        self.n, self.sigma, self.depth, self.most = (int(x) for x in head[:4])
        self.zeros = [int(x) for x in head[4:]]
        self.first = np.frombuffer(parts[1], dtype=np.int64)
        bits = lambda p: Bits(words=np.frombuffer(p, dtype=np.uint64))
        self.levels = [bits(p) for p in parts[2 : 2 + self.depth]]
        kept, samples, change, lcp = parts[2 + self.depth :]
        self.kept, self.samples, self.change = bits(kept), np.frombuffer(samples, dtype=np.int32), bits(change)
        self._prefixes(np.frombuffer(lcp, dtype=np.int16 if self.most < 2**15 else np.int32))
        return self

    def widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that have ``length`` characters in common with those of [lo, hi)."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, low = 1 << k, self.least[k]
            at = lo - step + 1
            lo -= np.where((at >= 0) & (low[np.maximum(at, 0)] >= length), step, 0)
            hi += np.where(low[hi] >= length, step, 0)
        return lo, hi

    def bounds(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix the first and the end of the interval of those that have ``length`` characters in common with
        it: ``widen`` for one length, by a look-up."""
        at, low = np.arange(len(self.least[0])), self.least[0] < length
        return np.maximum.accumulate(np.where(low, at, 0)), np.minimum.accumulate(np.where(low, at, self.n)[::-1])[::-1]

    def statistics(self, text: np.ndarray, ends: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Matching statistics of pieces (codes one after another, a piece ends before each of ``ends``; 0 for
        characters that the index lacks), place by place from the right: (piece, place in ``text``, lo, hi, length)
        of the longest match that begins there, up to ``most`` exactly. ``two``: whether a piece's matches
        must lie in two texts."""
        starts = np.r_[0, ends[:-1]]
        piece = np.flatnonzero(ends > starts)
        at, lo, hi, depth = ends[piece] - 1, np.zeros(len(piece), np.int64), np.full(len(piece), self.n, np.int64), np.zeros(len(piece), np.int64)
        while len(piece):
            code = text[at]
            a, b = self.extend(np.minimum(code, self.sigma - 2), lo, hi)
            ok = (code > 0) & (code < self.sigma - 1) & (a < b)
            wary = np.flatnonzero(ok & two[piece])
            if len(wary):
                ok[wary] = self.change.rank(b[wary]) > self.change.rank(a[wary] + 1)
            lo, hi, depth = np.where(ok, a, lo), np.where(ok, b, hi), depth + ok
            yield piece[ok], at[ok], lo[ok], hi[ok], depth[ok]
            bad = np.flatnonzero(~ok)
            lost = (depth[bad] == 0) | (code[bad] == 0) | (code[bad] >= self.sigma - 1)
            lo[bad[lost]], hi[bad[lost]], depth[bad[lost]] = 0, self.n, 0
            at = at - ok
            at[bad[lost]] -= 1
            up = bad[~lost]
            if len(up):
                shorter = np.maximum(0, np.maximum(self.least[0][lo[up]], self.least[0][hi[up]])).astype(np.int64)
                lo[up], hi[up] = self.widen(lo[up], hi[up], shorter)
                depth[up] = shorter
            left = at >= starts[piece]
            if not left.all():
                piece, at, lo, hi, depth = piece[left], at[left], lo[left], hi[left], depth[left]

    def _occ(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each code among the first i characters of the transform."""
        lo = np.zeros(len(i), dtype=np.int64)
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            one = ((code >> level) & 1).astype(bool)
            ri, rl = bits.rank(i), bits.rank(lo)
            i = np.where(one, zeros + ri, i - ri)
            lo = np.where(one, zeros + rl, lo - rl)
        return i - lo

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more character (a code of the text) to the left."""
        code = code + 1
        k = len(code)
        both = self._occ(np.concatenate([code, code]), np.concatenate([lo, hi]))
        return self.first[code] + both[:k], self.first[code] + both[k:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of codes (0: not in the text) -> row, and interval of suffixes, of those that occur."""
        row = np.arange(len(patterns))
        lo, hi = np.zeros(len(row), dtype=np.int64), np.full(len(row), self.n, dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            code = patterns[row, j]
            ok = (code > 0) & (code + 1 < self.sigma)
            row, lo, hi, code = row[ok], lo[ok], hi[ok], code[ok]
            if not len(row):
                break
            lo, hi = self.extend(code, lo, hi)
            ok = lo < hi
            row, lo, hi = row[ok], lo[ok], hi[ok]
        return row, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text position of each suffix."""
        out, steps, todo = np.empty(len(i), dtype=np.int64), 0, np.arange(len(i))
        while len(todo):
            done = self.kept.get(i)
            out[todo[done]] = self.samples[self.kept.rank(i[done])] + steps
            todo, i = todo[~done], i[~done]
            if not len(todo):
                break
            code, at = np.zeros(len(i), dtype=np.int64), i
            for bits, zeros in zip(self.levels, self.zeros):
                one = bits.get(at)
                code = (code << 1) | one
                r = bits.rank(at)
                at = np.where(one, zeros + r, at - r)
            i = self.first[code] + self._occ(code, i)
            steps += 1
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def winnow(text: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last place of the windows of ``length`` characters for which each fingerprint speaks. Two
    equal windows have equal fingerprints."""
    k = max(1, length // 3)
    h = rolling_hashes(mix64(_points(text).astype(np.uint64) + np.uint64(1)), k)
    span = length - k + 1
    found = []
    for i in range(0, len(h) - span + 1, 1 << 22):
        part = h[i : i + (1 << 22) + span - 1]
        m, blocks = len(part), -(-len(part) // span)
        key = np.full(blocks * span, np.uint64(2**64 - 1))
        key[:m] = (part & ~np.uint64(2**23 - 1)) | np.arange(m, dtype=np.uint64)  # the first of equal hashes
        head = np.minimum.accumulate(key.reshape(-1, span), axis=1).ravel()
        tail = np.minimum.accumulate(key.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[: m - span + 1], head[span - 1 : m])
        found.append((least & np.uint64(2**23 - 1)).astype(np.int64) + i)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.concatenate(found)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[first]], first, np.r_[first[1:], len(place)] - 1


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, ids = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))], []
            for i, text in zip(batch["md5"].to_pylist(), batch["text"].to_pylist()):
                own = winnow(text, length)
                cols.append(own), ids.extend([i] * len(own[0]))
            h, first, last = (np.concatenate(c) for c in zip(*cols))
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "md5": pa.array(ids, pa.string()), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})

    return run


def _build(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, held in zip(batch["shard"].to_pylist(), batch["held"].to_pylist()):
                held = sorted(held, key=lambda x: x["md5"])
                texts = [_points(x["text"]) for x in held]
                alphabet = np.unique(np.concatenate(texts))
                parts, starts, at = [], [], 0
                for t in texts:
                    parts += [np.ones(1, dtype=np.int64), np.searchsorted(alphabet, t).astype(np.int64) + 2]
                    starts.append(at + 1)
                    at += len(t) + 1
                owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
                index = FMIndex(np.concatenate(parts), length + 1, owner)
                row = {
                    "shard": pa.array([shard], pa.int32()), "ids": pa.array([[x["md5"] for x in held]], pa.list_(pa.string())), "starts": pa.array([starts], pa.list_(pa.int64())),
                    "alphabet": pa.array([alphabet.tolist()], pa.list_(pa.int64())), "index": pa.array([index.dump()], pa.binary()),
                }
                yield pa.record_batch(row)

    return run


LANE = 384  # window starts that one lane of a search goes over


def _lanes(md5: str, text: np.ndarray, firsts: list[int], lasts: list[int], length: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """(md5, place, codes) of the stretches whose windows begin from each first to each last place, merged and cut."""
    a, b = -1, -2
    for x, y in [*sorted(zip(firsts, lasts)), (1 << 60, 1 << 60)]:
        if x <= b + 1:
            b = max(b, y)
            continue
        for i in range(a, b + 1, LANE):
            yield md5, i, text[i : min(i + LANE, b + 1) + length - 1]
        a, b = x, y


def _stream(length: int, pairs: bool):
    def search(row: dict):
        index, ids, starts = FMIndex.load(row["index"]), row["ids"], np.array(row["starts"], dtype=np.int64)
        alphabet = np.array(row["alphabet"], dtype=np.int64)
        lanes = [x for q in row["queries"] for x in _lanes(q["md5"], _points(q["text"]), q["firsts"], q["lasts"], length)]
        whole, ends = np.concatenate([x[2] for x in lanes]), np.cumsum([len(x[2]) for x in lanes])
        at = np.minimum(np.searchsorted(alphabet, whole), len(alphabet) - 1)
        codes = np.where(alphabet[at] == whole, at + 2, 0).astype(np.int64)
        number = {m: i for i, m in enumerate(ids)}
        own = np.array([number.get(x[0], -1) for x in lanes])
        begins = np.r_[0, ends[:-1]]
        hits: list[tuple] = []
        if pairs:
            (first, end), (first_more, end_more) = index.bounds(length), index.bounds(length + 1)
        for piece, place, lo, hi, depth in index.statistics(codes, ends, own >= 0):
            far = depth >= length
            if not far.any():
                continue
            piece, place = piece[far], place[far]
            if not pairs:
                hits.append((piece, place))
                continue
            # all suffixes with ``length`` characters in common, but for those that have the next one, too
            lo, hi, depth = lo[far], hi[far], depth[far]
            a, b = first[lo], end[hi]
            more = (depth > length) & (place + length < ends[piece])
            x, y = np.where(more, first_more[lo], b), np.where(more, end_more[hi], b)
            n = (x - a) + (b - y)
            if not n.any():
                continue
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            from_a, left = np.repeat(a, n), np.repeat(x - a, n)
            at_ = np.where(k < left, from_a + k, np.repeat(y, n) + k - left)
            other = np.searchsorted(starts, index.locate(at_), side="right") - 1
            who = np.repeat(piece, n)
            keep = other != own[who]
            hits.append((who[keep], other[keep]))
        if not hits:
            return
        piece, second = (np.concatenate(x) for x in zip(*hits))
        if pairs:
            texts = {m: i for i, m in enumerate(dict.fromkeys(x[0] for x in lanes))}
            names, of = list(texts), np.array([texts[x[0]] for x in lanes])
            key = np.unique(of[piece] * len(ids) + second)
            yield [names[i] for i in (key // len(ids)).tolist()], [ids[i] for i in (key % len(ids)).tolist()]
            return
        order = np.lexsort((second, piece))
        piece, place = piece[order], second[order]
        new = np.r_[True, (piece[1:] != piece[:-1]) | (place[1:] > place[:-1] + length)]
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(place)] - 1
        shift = np.array([x[1] for x in lanes])[piece[head]] - begins[piece[head]]
        yield [lanes[i][0] for i in piece[head].tolist()], (place[head] + shift).tolist(), (place[last] + length + shift).tolist()

    kinds = {"ma": pa.string(), "mb": pa.string()} if pairs else {"md5": pa.string(), "start": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for cols in search(row):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    return run


def _windows(length: int):
    """Hashes of the windows that begin from each first to each last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for md5, text, firsts, lasts in zip(*(batch[c].to_pylist() for c in ("md5", "text", "firsts", "lasts"))):
                h = rolling_hashes(mix64(_points(text).astype(np.uint64) + np.uint64(1)), length)
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(firsts, lasts)]))
                yield pa.record_batch({"w": pa.array(h[at].view(np.int64)), "start": pa.array(at.astype(np.int32)), "md5": pa.array([md5] * len(at), pa.string())})

    return run


def _routed(records: DataFrame, text: str, length: int, shard_chars: int, pairs: bool, hot: int):
    """Rows that ``_stream`` searches, and (if hot fingerprints aren't routed) the texts with their stretches."""
    if length < 2:
        raise ValueError("length: at least 2")
    texts = materialise(records.where(F.length(text) >= length).select(F.md5(text).alias("md5"), F.col(text).alias("text")).dropDuplicates(["md5"]))
    anchors = materialise(texts.mapInArrow(_anchors(length), "h long, md5 string, first int, last int"))
    shared = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("md5").alias("x"), F.max("md5").alias("y")).where("x < y").select("h", "n")
    anchors = materialise(anchors.join(shared, "h"))
    rest = None
    if not pairs:
        often = anchors.where(F.col("n") > hot)
        if not often.isEmpty():
            rest = often.groupBy("md5").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")).join(texts, "md5")
        anchors = anchors.where(F.col("n") <= hot)
    held = texts.join(anchors.select("md5").distinct(), "md5", "left_semi")
    total = held.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_chars))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    index = held.withColumn("shard", of("md5")).groupBy("shard").agg(F.collect_list(F.struct("md5", "text")).alias("held"))
    built = materialise(index.mapInArrow(_build(length), "shard int, ids array<string>, starts array<long>, alphabet array<long>, index binary"))
    # a text searches the shards that hold another text with a fingerprint of its own; for pairs, a later one by md5
    per = anchors.groupBy("h", of("md5").alias("shard")).agg(F.min("md5").alias("x"), F.max("md5").alias("y"))
    other = F.col("y") > F.col("md5") if pairs else (F.col("x") != F.col("md5")) | (F.col("y") != F.col("md5"))
    routed = anchors.join(per, "h").where(other).groupBy("md5", "shard").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    queries = routed.join(held, "md5").withColumn("block", F.pmod(F.xxhash64("md5", F.lit(7)), F.lit(4096)))
    load = queries.groupBy("shard").agg(F.sum(F.length("text")).alias("chars")).withColumn("blocks", F.least(F.lit(4096), F.greatest(F.lit(1), F.ceil(F.col("chars") / (2 * shard_chars)))))
    blocks = queries.join(load.select("shard", "blocks"), "shard").groupBy("shard", F.pmod("block", "blocks").alias("block")).agg(F.collect_list(F.struct("md5", "text", "firsts", "lasts")).alias("queries"))
    return blocks.join(built, "shard").select("ids", "starts", "alphabet", "index", "queries"), rest


def shared_intervals(records: DataFrame, text: str, length: int = 150, shard_chars: int = 400_000, hot: int = 1000) -> DataFrame:
    """``md5, start, end``: stretches of each text in which every place lies in a run of at least ``length``
    characters that another text has, too (they may overlap). Null, empty and shorter texts have none.

    The windows of a fingerprint that more than ``hot`` places share aren't searched in every shard, which
    would multiply the work, but counted by their own hashes, pre-aggregated in each task; the result is the same.
    """
    routed, rest = _routed(records, text, length, shard_chars, False, hot)
    out = routed.mapInArrow(_stream(length, False), "md5 string, start int, end int")
    if rest is None:
        return out
    windows = materialise(rest.mapInArrow(_windows(length), "w long, start int, md5 string"))
    common = windows.groupBy("w").agg(F.min("md5").alias("x"), F.max("md5").alias("y")).where("x < y").select("w")
    return out.union(windows.join(common, "w").select("md5", "start", (F.col("start") + length).alias("end")))


def shared_classes(records: DataFrame, text: str, length: int = 150, shard_chars: int = 400_000) -> DataFrame:
    """``ma, mb`` (ma < mb): pairs of different texts, by md5, with a common run of at least ``length`` characters."""
    routed, _ = _routed(records, text, length, shard_chars, True, 0)
    found = routed.mapInArrow(_stream(length, True), "ma string, mb string")
    return found.where("ma < mb").distinct()


def shared_share(records: DataFrame, key: str, text: str, length: int = 150, **how) -> DataFrame:
    """``id, chars, spans, shared_chars, shared``: for each record the stretches (start, end) of its text that
    recur in other records, and the share of its text under them. A text that another record repeats whole
    recurs whole if it has ``length`` characters. Null and empty texts have share 0; of rows with one key and
    different texts the longest stands."""
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.md5(text).alias("md5"), F.coalesce(F.length(text), F.lit(0)).alias("chars")).distinct()
    rows = rows.groupBy("id").agg(F.max(F.struct("chars", "md5")).alias("r")).select("id", "r.*")
    own = shared_intervals(records, text, length, **how)
    copies = rows.where(F.col("chars") >= length).groupBy("md5", "chars").agg(F.count("*").alias("n")).where("n > 1").select("md5", F.lit(0).alias("start"), F.col("chars").cast("int").alias("end"))
    # union of intervals: a new stretch begins where no earlier interval reaches
    w = Window.partitionBy("md5").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    joined = own.union(copies).groupBy("md5", "start").agg(F.max("end").alias("end")).withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(w), F.lit(-1))).cast("int"))
    joined = joined.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("md5", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = joined.groupBy("md5").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).cast("int").alias("shared_chars"))
    out = rows.join(merged, "md5", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    return out.select("id", "chars", F.coalesce("spans", empty).alias("spans"), shared.alias("shared_chars"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(0.0).alias("shared"))


def text_classes(records: DataFrame, key: str, text: str, length: int = 150) -> DataFrame:
    """``id, class_id, copies``: for each key with a text of ``length`` characters the least key that has the same text, and
    how many have it: the membership behind pairs of classes. Null keys and shorter texts have none."""
    of = members(records.where(F.length(text) >= length), key, text)
    per = of.groupBy("md5").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return of.join(per, "md5").select("id", "class_id", "copies").groupBy("id").agg(F.min(F.struct("class_id", "copies")).alias("c")).select("id", "c.*")


def shared_pairs(records: DataFrame, key: str, text: str, length: int = 150, expand_copies: int = 64, **how) -> DataFrame:
    """``a, b`` (a < b): pairs of records whose texts have a common run of ``length`` characters, copies of one
    text of that length included (see ``expand`` for texts with very many keys)."""
    found = shared_classes(records, text, length, **how)
    of = materialise(members(records, key, text))
    long = records.where(F.length(text) >= length).select(F.md5(text).alias("md5")).distinct()
    same = of.groupBy("md5").agg(F.count("*").alias("n")).where("n > 1").join(long, "md5", "left_semi").select(F.col("md5").alias("ma"), F.col("md5").alias("mb"))
    return expand(found.union(same), of, expand_copies)
