"""Choosing documents for a question, adding what experts know to it, and answering it with the read tools of a workspace."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.providers import Provider
from leafmill.functions.words import word_array
from leafmill.operators.blocks import best_k
from leafmill.session import materialise, spread
from leafmill.sources.workspace import Workspace


def _greatest_places(s: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, int]:
    """Places of the k greatest counts above ``floor``, of equals the first; and the least of them if there are k."""
    edge = max(floor, int(np.partition(s, len(s) - k)[len(s) - k]) if k < len(s) else 0)
    above = np.flatnonzero(s > edge)
    if edge > floor and len(above) < k:
        above = np.concatenate([above, np.flatnonzero(s == edge)[: k - len(above)]])
    return above, int(s[above].min()) if len(above) == k else floor


def _sent(asked: DataFrame) -> tuple[dict[str, int], list[tuple[int, ...]], np.ndarray, pa.Array]:
    """Questions for every executor: the place of each word, the most frequent first; the distinct lists of places in
    order, so that neighbours begin alike; where the questions of each list begin; and their ids."""
    held = asked.select("query_id", "words").toArrow()
    lists = held.column("words").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    code, n = flat.indices.to_numpy(), len(flat.dictionary)
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(-np.bincount(code, minlength=n), kind="stable")] = np.arange(n)
    sizes = pc.list_value_length(lists).to_numpy()
    owner = np.repeat(np.arange(len(lists)), sizes)
    places = place[code]
    places, ends = places[np.lexsort((places, owner))].tolist(), np.cumsum(sizes).tolist()
    own = [tuple(places[a:b]) for a, b in zip([0, *ends], ends)]
    order = sorted(range(len(own)), key=own.__getitem__)
    first = [j for j, i in enumerate(order) if j == 0 or own[i] != own[order[j - 1]]]
    names = held.column("query_id").combine_chunks().take(pa.array(order, pa.int64()))
    return dict(zip(flat.dictionary.to_pylist(), place.tolist())), [own[order[j]] for j in first], np.array([*first, len(order)]), names


def _count_shared(code: np.ndarray, doc: np.ndarray, n: int, lists: list[tuple[int, ...]], terms: int, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each list of words that some of n documents share: its number, the places of the best k documents and their
    counts. ``code, doc``: the word and the document of each entry. ``floors`` (counts that k earlier documents reach)
    is carried on.

    The counts of a list are those of the words that it begins with, plus one row for each further word.
    """
    pairs, times = np.unique(code * n + doc, return_counts=True)
    doc, cut = pairs % n, np.searchsorted(pairs, np.arange(terms + 1) * n)
    kind = np.min_scalar_type(int(times.max(initial=1)) * max(map(len, lists), default=1))
    times, rows, room = times.astype(kind), {}, 64_000_000 // (n * kind.itemsize)
    # at each depth: counts; once sought, the greatest, and a floor with the best above it
    stack: list[list] = [[np.zeros(n, dtype=kind), 0, None, None]]
    before: tuple[int, ...] = ()
    for i, own in enumerate(lists):
        same = next((j for j, (a, b) in enumerate(zip(before, own)) if a != b), min(len(before), len(own)))
        del stack[same + 1 :]
        before = own
        for w in own[same:]:
            a, b = cut[w], cut[w + 1]
            if a == b:
                stack.append(stack[-1])
                continue
            last = stack[-1][0]
            if w not in rows and (b - a) * 16 > n and len(rows) < room:
                rows[w] = np.zeros(n, dtype=kind)
                rows[w][doc[a:b]] = times[a:b]
            if w in rows:
                s = last + rows[w]
            else:
                s = last.copy()
                s[doc[a:b]] += times[a:b]
            stack.append([s, None, None, None])
        top = stack[-1]
        if top[1] is None:
            top[1] = int(top[0].max())
        if top[1] > floors[i]:
            floor = int(floors[i])
            if top[2] != floor:
                top[2:] = floor, _greatest_places(top[0], k, floor)
            at, floors[i] = top[3]
            yield i, at, top[0][at]


def documents_by_description(queries: DataFrame, documents: DataFrame, k: int = 5, split: int = 10_000, sent_words: int = 2_000_000) -> DataFrame:
    """``query_id, rank, doc_id, shared``: for each question (``query_id, query``) the k documents whose description
    (``doc_id, description``) has most of its distinct words, ties by id (a null id last); documents without any aren't
    named. Several rows of a question or a document add up.

    Questions go to every executor in blocks of about ``sent_words`` words; each block reads the documents once. A task
    counts for ``split`` documents at a time, and only those that can be among the best of its documents leave it: pairs of
    a question and a document aren't rows at any time.
    """
    words = lambda c: F.flatten(F.collect_list(F.array_distinct(word_array(F.coalesce(c, F.lit("")))))).alias("words")
    kinds = queries.schema["query_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    asked = materialise(queries.groupBy("query_id").agg(words("query")).where(F.size("words") > 0))
    held = materialise(documents.groupBy("doc_id").agg(words("description")).where(F.size("words") > 0))
    ordered = spread(held).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    blocks = max(1, -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // sent_words))

    def block(part: DataFrame) -> DataFrame:
        sent = asked.sparkSession.sparkContext.broadcast(_sent(part))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, lists, first, names = sent.value
            floors = np.zeros(len(lists), dtype=np.int64)  # documents come by id: a later one must share more
            most = max(1, min(split, 50_000_000 // max(map(len, lists), default=1)))
            ids, codes, docs, n = [], [], [], 0

            def best() -> pa.RecordBatch:
                q, d, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, at, shared in _count_shared(np.concatenate(codes), np.concatenate(docs), n, lists, len(terms), k, floors):
                    own = np.arange(first[i], first[i + 1])
                    q.append(np.repeat(own, len(at))), d.append(np.tile(at, len(own))), s.append(np.tile(shared, len(own)))
                q, d, s = (pa.array(np.concatenate(x).astype(np.int64)) for x in (q, d, s))
                return pa.record_batch({"query_id": names.take(q), "doc_id": pa.concat_arrays(ids).take(d), "shared": s})

            for whole in batches:
                for a in range(0, whole.num_rows, most):
                    batch = whole.slice(a, most)
                    flat = batch["words"].flatten().dictionary_encode()
                    known = np.array([terms.get(w, -1) for w in flat.dictionary.to_pylist()], dtype=np.int64)
                    code = known[flat.indices.to_numpy()]
                    doc = np.repeat(np.arange(n, n + batch.num_rows), pc.list_value_length(batch["words"]).to_numpy())
                    ids.append(batch["doc_id"]), codes.append(code[code >= 0]), docs.append(doc[code >= 0])
                    n += batch.num_rows
                    if n >= most:
                        yield best()
                        ids, codes, docs, n = [], [], [], 0
            if n:
                yield best()

        return ordered.mapInArrow(count, f"query_id {kinds[0]}, doc_id {kinds[1]}, shared bigint")

    shared = None
    for i in range(blocks):
        own = block(asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
        shared = own if shared is None else shared.union(own)
    return best_k(shared, "query_id", F.col("shared"), k, F.col("doc_id").asc_nulls_last()).select("query_id", "rank", "doc_id", "shared")


def with_preferences(queries: DataFrame, preferences: DataFrame, most: int = 10_000) -> DataFrame:
    """Questions (``query_id, query``) with the advice (``topic, advice``) of every topic that they name as a word, by topic,
    on lines of their own: what the navigator reads besides the question."""
    advice = preferences.where("topic IS NOT NULL AND advice IS NOT NULL").select(F.lower("topic").alias("w"), "advice").groupBy("w").agg(F.array_join(F.array_sort(F.collect_set("advice")), "\n").alias("a"))
    named = queries.select("query_id", F.explode(F.array_distinct(word_array(F.coalesce("query", F.lit(""))))).alias("w")).join(advice, "w")
    per = named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "a"))), lambda x: x["a"]), "\n").alias("a"))
    return queries.join(per, "query_id", "left").withColumn("query", F.concat_ws("\n", "query", "a")).drop("a")


def converse(workspace: Workspace, provider: Provider, doc_id: str, question: str, most: int = 8) -> dict:
    """Answers a question on one document by tools: the provider sees what was said so far and replies with JSON, either
    ``{"tool": "document" | "structure" | "pages", "pages": "5-7"}`` or ``{"answer": ...}``. Anything else, and an unknown
    tool, is told back to it; without an answer after ``most`` replies the answer is null."""
    said = [f"question: {question}"]
    tools = {"document": lambda _: workspace.document(doc_id), "structure": lambda _: workspace.structure(doc_id), "pages": lambda p: workspace.pages(doc_id, str(p))}
    used: list[str] = []
    for _ in range(most):
        try:
            reply = json.loads(provider.complete("\n".join(said)))
            if not isinstance(reply, dict):
                raise ValueError("not an object")
        except ValueError as e:
            said.append(f"error: {e}")
            continue
        if "answer" in reply:
            return {"answer": reply["answer"], "tools": used}
        tool = reply.get("tool")
        if tool not in tools:
            said.append(f"error: no tool {tool}")
            continue
        used.append(tool)
        said.append(f"{tool}: {tools[tool](reply.get('pages', ''))}")
    return {"answer": None, "tools": used}
