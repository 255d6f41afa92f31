"""Ranked retrieval: lexical (BM25), exact inner product, hierarchical beam over section trees, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import bm25_tokens
from leafmill.operators.blocks import best_k
from leafmill.session import materialise


def canonical(chunks: DataFrame) -> DataFrame:
    """Chunks that no earlier run marked as duplicates (null counts as not marked)."""
    return chunks.where(~F.coalesce(F.col("is_duplicate_chunk"), F.lit(False)))


# -------------------------------------------------------------------------------------------- lexical
def bm25_statistics(tokens: DataFrame) -> tuple[DataFrame, int, float, float]:
    """``term, df, idf`` of ``id, tokens`` rows, number of documents, mean length and mean idf. A negative idf becomes
    a quarter of the mean idf of the vocabulary."""
    n, mean = tokens.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = materialise(terms.withColumn("raw", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    mean_idf = raw.agg(F.avg("raw").alias("mean_idf")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, 0.25 * mean_idf).otherwise(F.col("raw")).alias("idf")), n or 0, mean or 0.0, mean_idf


def _first_k(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, of equals at the edge the first."""
    if k >= len(s):
        return np.arange(len(s))
    edge = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > edge)
    return np.concatenate([above, np.flatnonzero(s == edge)[: k - len(above)]])


def _bm25_sent(rows: DataFrame, asked: DataFrame, idf: DataFrame, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """Scores with the queries' terms and their idf at every executor: documents are read once and not moved."""
    spark = rows.sparkSession
    known = {r["term"]: r["idf"] for r in idf.join(asked.select(F.explode("tokens").alias("term")).distinct(), "term").collect()}
    terms = {t: i for i, t in enumerate(known)}
    queries = [(r["query_id"], [terms[t] for t in r["tokens"] if t in terms]) for r in asked.collect()]
    sent = spark.sparkContext.broadcast((terms, np.array(list(known.values()) or [0.0]), queries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, queries = sent.value
        for batch in batches:
            ids, lists = batch["id"].to_pylist(), batch["tokens"].to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            ids, lists = [ids[i] for i in order], [lists[i] for i in order]
            at = [(i, terms[t]) for i, w in enumerate(lists) for t in w if t in terms]
            length = np.array([len(w) for w in lists], dtype=float)
            norm = k1 * (1 - b + b * length / max(mean, 1e-9))
            pairs, tf = np.unique(np.array([t * len(ids) + i for i, t in at], dtype=np.int64), return_counts=True)
            term, doc = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            w = weight[term] * tf * (k1 + 1) / (tf + norm[doc])
            cut = np.searchsorted(term, np.arange(len(terms) + 1))
            q_out, id_out, s_out = [], [], []
            for q, own in queries:
                s = np.zeros(len(ids))
                for t in own:
                    s[doc[cut[t] : cut[t + 1]]] += w[cut[t] : cut[t + 1]]
                s = np.round(s, 9)
                top = _first_k(s, k)
                q_out.extend([q] * len(top)), id_out.extend(ids[i] for i in top.tolist()), s_out.append(s[top])
            yield pa.record_batch({"query_id": pa.array(q_out, pa.string()), "id": pa.array(id_out, pa.string()), "score": pa.array(np.concatenate(s_out) if s_out else np.empty(0))})

    return rows.mapInArrow(score, "query_id string, id string, score double")


def _bm25_joined(rows: DataFrame, asked: DataFrame, idf: DataFrame, mean: float, k: int, k1: float, b: float, split: int) -> DataFrame:
    """Scores by a join of postings and query terms on the term; the postings of a term that more than ``split``
    documents have are spread over several tasks. Queries with fewer hits get the least ids at score 0."""
    wanted = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).join(idf, "term")
    parts = F.ceil(F.col("df") / F.lit(split)).cast("int")
    postings = rows.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    left = postings.join(wanted.select("term", "df").distinct(), "term").withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int"))
    right = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("df")
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(max(mean, 1e-9)))
    scored = left.join(right, ["term", "salt"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)), 9).alias("score"))
    hits = best_k(scored, "query_id", F.col("score"), k, F.col("id")).select("query_id", "id", "score")
    least = F.array(*(F.lit(r["id"]) for r in rows.select("id").orderBy("id").limit(k).collect())).cast("array<string>")
    rest = asked.select("query_id", F.explode(least).alias("id")).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"))
    return hits.union(rest)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, sent_terms: int = 2_000_000, query_block: int = 200_000, split: int = 10_000) -> DataFrame:
    """``query_id, rank, id, score``: the k best chunks (``id, text``) for each query (``query_id, query``).

    Exactly min(k, chunks) rows for each query, also at score 0; ties by id. Repeated query terms add again. Null
    texts are documents without terms, null queries match nothing; ids must be distinct. Scores are compared
    to nine decimals.

    Queries with at most ``sent_terms`` terms in all go to every executor and the documents are read once; more meet
    the postings in a join on the term. Where the mean idf is below 0 (most terms in most documents), which a join can't
    rank, they go in blocks of ``query_block``.
    """
    rows = materialise(chunks.select("id", bm25_tokens(F.col("text")).alias("tokens")))
    idf, n, mean, mean_idf = bm25_statistics(rows)
    asked = materialise(queries.select("query_id", bm25_tokens(F.col("query")).alias("tokens")))
    asked_rows, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens") + 1), F.lit(0))).first()
    if terms <= sent_terms:
        scored = _bm25_sent(rows, asked, idf, mean, k, k1, b)
    elif mean_idf >= 0:
        scored = _bm25_joined(rows, asked, idf, mean, k, k1, b, split)
    else:
        blocks = -(-asked_rows // query_block)
        part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        scored = None
        for i in range(blocks):
            own = _bm25_sent(rows, asked.where(part == i), idf, mean, k, k1, b)
            scored = own if scored is None else scored.union(own)
    return best_k(scored, "query_id", F.col("score"), k, F.col("id")).select("query_id", "rank", "id", "score")


# ------------------------------------------------------------------------------------- inner product
def unit(vector: Column) -> Column:
    """A vector at length 1; null if its length is 0."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def _matrix(vectors: pa.Array, normalise: bool, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors."""
    at = np.flatnonzero(np.asarray(vectors.is_valid()))
    x = np.asarray(vectors.take(pa.array(at)).flatten(), dtype=np.float64)
    if len(at) and len(x) % len(at):
        raise ValueError("vectors of different dimensions")
    x = x.reshape(len(at), -1) if len(at) else np.empty((0, 0))
    if normalise and len(at):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        if strict and not norm.all():
            raise ValueError("a vector of length 0 has no direction")
        at, x = at[norm > 0], x[norm > 0] / norm[norm > 0, None]
    return at, x


def dense_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, normalise: bool = True, query_block: int = 20_000, exclude_self: bool = False, strict: bool = False) -> DataFrame:
    """``query_id, rank, id, score``: the k rows (``id, vector``) of greatest inner product with each query
    (``query_id, vector``), exactly; ties by id. Null vectors take no part, nor do vectors of length 0 (which raise if
    ``strict``); a dimension that differs raises.

    Queries go to every executor in blocks of ``query_block``; each block reads the rows once, and a batch of rows
    sends on its best k for each query.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    asked = materialise(queries.select("query_id", "vector").where("vector IS NOT NULL"))
    blocks = max(1, -(-asked.count() // query_block))

    def block(part: DataFrame) -> DataFrame:
        held = part.toArrow()
        names = held.column("query_id").combine_chunks()
        at, a = _matrix(held.column("vector").combine_chunks(), normalise, strict)
        sent = rows.sparkSession.sparkContext.broadcast((names.take(pa.array(at)), a))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, a = sent.value
            mine = np.array(names.to_pylist(), dtype=object)
            for batch in batches:
                at, b = _matrix(batch["vector"], normalise, strict)
                if not len(at) or not len(a):
                    continue
                if a.shape[1] != b.shape[1]:
                    raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} dimensions")
                s = np.round(a @ b.T, 9)
                if exclude_self:
                    s[mine[:, None] == np.array(batch["id"].take(pa.array(at)).to_pylist(), dtype=object)[None, :]] = -np.inf
                m = min(k, len(at))
                edge = np.partition(s, len(at) - m, axis=1)[:, len(at) - m]
                q, r = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                yield pa.record_batch({"query_id": names.take(pa.array(q)), "id": batch["id"].take(pa.array(at[r])), "score": pa.array(s[q, r])})

        return rows.select("id", "vector").mapInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, score double")

    scored = None
    for i in range(blocks):
        own = block(asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
        scored = own if scored is None else scored.union(own)
    return best_k(scored, "query_id", F.col("score"), k, F.col("id")).select("query_id", "rank", "id", "score")


def pair_scores(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` without its two vector columns, with ``score``: their inner product to nine decimals, -1 where one is
    null. Batches of pairs are multiplied as matrices."""
    kept = [f for f in pairs.schema if f.name not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch[left], batch[right]
            both = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
            s = np.full(batch.num_rows, -1.0)
            if both.any():
                x, y = (np.asarray(c.filter(pa.array(both)).flatten(), dtype=np.float64).reshape(int(both.sum()), -1) for c in (a, b))
                s[both] = np.round(np.einsum("ij,ij->i", x, y), 9)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(s)], names=[*(f.name for f in kept), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pairs.mapInArrow(run, f"{schema}, score double")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# -------------------------------------------------------------------------------- hierarchical beam
INDEX = "doc_id string, root array<double>, node_id array<string>, up array<int>, chunk_id array<string>, vectors array<double>, dimensions int"


def beam_index(nodes: DataFrame) -> DataFrame:
    """One row for each document, to be written once and searched often: its own vector, and its other nodes with the
    place of their parent among them (-1: the document itself) and their vectors one after another (null vectors as
    NaN).

    ``nodes``: ``doc_id, node_id, parent_id, ord, chunk_id, vector`` (the document's own node has a null parent). Nodes
    that no path joins with the document's own aren't found and left out.
    """
    tops = nodes.where("parent_id IS NULL").groupBy("doc_id").agg(F.min_by(F.struct("node_id", "vector"), "node_id").alias("top"))
    below = nodes.where("parent_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "parent_id", "chunk_id", "vector"))).alias("n"))
    both = tops.join(below, "doc_id", "left").select("doc_id", "top", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, top, held in zip(*(batch[c].to_pylist() for c in ("doc_id", "top", "n"))):
                held = held or []
                place = {x["node_id"]: i for i, x in enumerate(held)}
                place[top["node_id"]] = -1
                up = [place.get(x["parent_id"], -2) for x in held]
                size = max((len(x["vector"]) for x in held if x["vector"] is not None), default=0)
                flat = [v for x in held for v in (x["vector"] if x["vector"] is not None else [float("nan")] * size)]
                cols = [[doc], [top["vector"]], [[x["node_id"] for x in held]], [up], [[x["chunk_id"] for x in held]], [flat], [size]]
                kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split(" ")[0] for f in INDEX.split(", ")])

    return both.mapInArrow(run, INDEX)


def _descend(v: np.ndarray, known: np.ndarray, below: dict[int, np.ndarray], q: np.ndarray, m: int) -> list[tuple[float, int, int, int]]:
    """(-score, level, place, node) of the leaves that a beam of width m meets."""
    found, level = [], 0
    pool = below.get(-1, np.empty(0, np.int64))
    while len(pool):
        s = np.where(known[pool], np.round(v[pool] @ q, 9), -1.0)
        order = np.argsort(-s, kind="stable")[:m]
        inner = []
        for r, (node, score) in enumerate(zip(pool[order].tolist(), s[order].tolist())):
            if node in below:
                inner.append(below[node])
            else:
                found.append((-score, level, r, node))
        pool = np.concatenate(inner) if inner else pool[:0]
        level += 1
    return sorted(found)


def beam_search(index: DataFrame, queries: DataFrame, k: int | None = 5, m: int = 10, block: int = 2000) -> DataFrame:
    """``query_id, doc_id, rank, node_id, chunk_id, score``: from each query's best document (by ``dense_top_k`` over
    the documents' own vectors) down its tree, all candidates if ``k`` is null.

    At each level the children of the frontier are pooled in order, the m best of the pool stay, leaves among them
    become candidates, the others the next frontier; candidates rank by their own score, best first, the
    earlier found before the later; a chunk reached twice keeps its best place. Null vectors score as -1; a
    query or document without one takes no part in the choice of the document. A task goes down one document's tree with
    up to ``block`` of its queries.
    """
    roots = index.select(F.col("doc_id").alias("id"), F.col("root").alias("vector"))
    best = dense_top_k(roots, queries.select("query_id", "vector"), 1, normalise=False)
    chosen = best.select("query_id", F.col("id").alias("doc_id")).join(queries.select("query_id", "vector"), "query_id")
    sizes = chosen.groupBy("doc_id").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / F.lit(block))).cast("int")
    packs = chosen.join(sizes, "doc_id").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    both = packs.join(index.drop("root"), "doc_id").select("doc_id", "node_id", "up", "chunk_id", "vectors", "dimensions", "asked")
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                size = batch["dimensions"][i].as_py()
                if not size:
                    continue
                doc, nodes, chunks = batch["doc_id"][i].as_py(), batch["node_id"][i].as_py(), batch["chunk_id"][i].as_py()
                v = np.asarray(batch["vectors"][i].values, dtype=np.float64).reshape(len(nodes), size)
                known = ~np.isnan(v).any(axis=1)
                up = np.asarray(batch["up"][i].values)
                below = {int(u): np.flatnonzero(up == u) for u in np.unique(up)}
                asked = batch["asked"][i].values
                for query, q in zip(asked.field("query_id").to_pylist(), asked.field("vector").to_pylist()):
                    seen, rank = set(), 0
                    for score, _level, _place, node in _descend(v, known, below, np.array(q), m):
                        name = chunks[node] if chunks[node] is not None else ("node", nodes[node])
                        if name not in seen and (k is None or rank < k):
                            seen.add(name)
                            rank += 1
                            rows.append((query, doc, rank, nodes[node], chunks[node], -score))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [batch["asked"].type.value_type.field("query_id").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "doc_id", "rank", "node_id", "chunk_id", "score"])

    return both.mapInArrow(run, f"query_id {kind}, doc_id string, rank int, node_id string, chunk_id string, score double")


def beam(nodes: DataFrame, queries: DataFrame, k: int | None = 5, m: int = 10) -> DataFrame:
    """``beam_search`` over nodes that aren't indexed yet."""
    return beam_search(materialise(beam_index(nodes)), queries, k, m)


def rerank(candidates: DataFrame, queries: DataFrame, chunk_vectors: DataFrame, k: int = 5) -> DataFrame:
    """Candidates of a beam ordered by query and chunk text (``chunk_id, vector``); the node's score stands where
    the chunk has no vector, and ``scored_by`` says which."""
    both = candidates.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").join(chunk_vectors.select("chunk_id", F.col("vector").alias("cv")), "chunk_id", "left")
    pairs = both.select("query_id", "doc_id", "node_id", "chunk_id", F.col("score").alias("node_score"), F.col("rank").alias("node_rank"), F.col("cv").isNotNull().alias("_has"), "qv", "cv")
    scored = pair_scores(pairs, "qv", "cv")
    out = scored.withColumns({"score": F.when(F.col("_has"), F.col("score")).otherwise(F.col("node_score")), "scored_by": F.when(F.col("_has"), "chunk").otherwise("node")}).drop("_has")
    return best_k(out, "query_id", F.col("score"), k, F.col("node_rank")).drop("node_rank")


def document_scores(hits: DataFrame) -> DataFrame:
    """``query_id, doc_id, doc_score``: sum of chunk scores over the root of their number plus one."""
    return hits.groupBy("query_id", "doc_id").agg((F.sum("score") / F.sqrt(F.count("*") + 1)).alias("doc_score"))
