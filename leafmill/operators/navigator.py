"""Walking a section tree step by step for one question, with a pluggable navigator.

Each question is a state machine over its document's tree; trees travel with the questions of a document, so that
the number of documents doesn't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Navigator(Protocol):
    def choose(self, query: str, node: dict, children: list[dict]) -> str:
        """Id of the child to descend to, or ``backtrack``."""

    def sufficient(self, query: str, chunk: dict) -> bool: ...

    def rank(self, query: str, chunks: list[dict]) -> list[str]: ...


def _overlap(query: str, text: str) -> float:
    from leafmill.functions.words import words

    a = set(words(query))
    return len(a & set(words(text))) / len(a) if a else 0.0


class OverlapNavigator:
    """Rule-based: goes where more of the question's words stand, backs out where none do."""

    def __init__(self, enough: float = 0.8) -> None:
        self.enough = enough

    def choose(self, query: str, node: dict, children: list[dict]) -> str:
        best = max(children, key=lambda c: (_overlap(query, c["text"]), -c["ord"]))
        return best["node_id"] if _overlap(query, best["text"]) > 0 else "backtrack"

    def sufficient(self, query: str, chunk: dict) -> bool:
        return _overlap(query, chunk["text"]) >= self.enough

    def rank(self, query: str, chunks: list[dict]) -> list[str]:
        return [c["chunk_id"] for c in sorted(chunks, key=lambda c: -_overlap(query, c["text"]))]


def strict_bool(value) -> bool:
    """True only for true; the string ``false`` is false."""
    return value is True or (isinstance(value, str) and value.strip().lower() in ("true", "yes"))


class Walk:
    """The state of one question in one tree."""

    def __init__(self, nodes: list[dict], navigator: Navigator) -> None:
        self.navigator = navigator
        self.nodes = {n["node_id"]: n for n in nodes}
        self.below: dict[str | None, list[dict]] = {}
        for n in sorted(nodes, key=lambda n: n["ord"]):
            up = n["parent_id"] if n["parent_id"] in self.nodes else None
            self.below.setdefault(up, []).append(n)
        self.path: list[str | None] = [None]
        self.rejected: set[tuple[str | None, str]] = set()
        self.seen: set[str] = set()

    def _open(self, node: str) -> bool:
        """Whether an unseen chunk is left at or under a node."""
        todo = [node]
        while todo:
            n = todo.pop()
            kids = self.below.get(n, [])
            if not kids and (c := self.nodes[n]["chunk_id"]) and c not in self.seen:
                return True
            todo.extend(k["node_id"] for k in kids)
        return False

    def next_chunk(self, query: str, steps: int = 20) -> dict | None:
        """The next unseen chunk; None once the tree is exhausted or after ``steps`` decisions."""
        for _ in range(steps):
            here = self.path[-1]
            kids = self.below.get(here, [])
            if here is not None and not kids:
                self.path.pop()
                self.rejected.add((self.path[-1], here))
                chunk = self.nodes[here]
                if chunk["chunk_id"] and chunk["chunk_id"] not in self.seen:
                    self.seen.add(chunk["chunk_id"])
                    return chunk
                continue
            left = [k for k in kids if (here, k["node_id"]) not in self.rejected and self._open(k["node_id"])]
            if not left:
                if here is None:
                    return None
                self.path.pop()
                self.rejected.add((self.path[-1], here))
                continue
            choice = left[0]["node_id"] if len(left) == 1 and here is None else self.navigator.choose(query, self.nodes.get(here, {}), left)
            if choice == "backtrack":
                if here is None:
                    return None
                self.path.pop()
                self.rejected.add((self.path[-1], here))
                continue
            self.path.append(choice if choice in {k["node_id"] for k in left} else left[0]["node_id"])
        return None

    def retrieve(self, query: str, mode: str = "combined", enough: int = 5, most: int = 10) -> dict:
        """Reads chunks until one is sufficient (``top1``), ``enough`` are read (``top5``) or both (``combined``), up to
        ``most``. Top result and ranked list are answers of their own: the first sufficient chunk, else the first of
        the list; and the ranking of the first ``enough`` read."""
        read: list[dict] = []
        first = None
        while len(read) < most:
            if mode == "top1" and first or mode == "top5" and len(read) >= enough or mode == "combined" and first and len(read) >= enough:
                break
            chunk = self.next_chunk(query)
            if chunk is None:
                break
            read.append(chunk)
            if mode != "top5" and first is None and strict_bool(self.navigator.sufficient(query, chunk)):
                first = chunk["chunk_id"]
        ranked = self.navigator.rank(query, read[:enough]) if read and mode != "top1" else [c["chunk_id"] for c in read[:enough]]
        return {"top1": first or (ranked[0] if ranked else None), "top5": ranked, "read": len(read), "sufficient": first is not None}


def walk_trees(queries: DataFrame, nodes: DataFrame, navigator: Navigator | None = None, mode: str = "combined", enough: int = 5, most: int = 10, block: int = 500) -> DataFrame:
    """``query_id, doc_id, top1, top5, read, sufficient`` for questions (``query_id, doc_id, query``) on trees (``doc_id,
    node_id, parent_id, ord, chunk_id, text``). A question without a tree has null and empty results. A task takes one
    tree with up to ``block`` of its questions: the tree isn't repeated for each of them."""
    navigator = navigator or OverlapNavigator()
    tree = nodes.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("node_id", "parent_id", "ord", "chunk_id", F.coalesce("text", F.lit("")).alias("text")))).alias("tree"))
    sizes = queries.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"))
    asked = queries.join(sizes, F.col("doc_id").eqNullSafe(F.col("_d"))).select("query_id", "doc_id", F.coalesce("query", F.lit("")).alias("query"), F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / F.lit(block))).alias("_part"))
    packs = asked.groupBy("doc_id", "_part").agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
    both = packs.join(tree, "doc_id", "left").select("doc_id", "asked", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, out = [], [], []
            for doc, asked, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "asked", "tree"))):
                rows = [{"chunk_id": None, "parent_id": None, "text": "", **r} for r in (json.loads(t) if t else [])]
                for q in asked:
                    ids.append(q["query_id"]), docs.append(doc)
                    out.append(Walk(rows, navigator).retrieve(q["query"], mode, enough, most))
            yield pa.record_batch({"query_id": pa.array(ids, pa.string()), "doc_id": pa.array(docs, pa.string()), "top1": pa.array([o["top1"] for o in out], pa.string()), "top5": pa.array([o["top5"] for o in out], pa.list_(pa.string())), "read": pa.array([o["read"] for o in out], pa.int32()), "sufficient": pa.array([o["sufficient"] for o in out], pa.bool_())})

    return both.mapInArrow(run, "query_id string, doc_id string, top1 string, top5 array<string>, read int, sufficient boolean")


def single_shot(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``query_id, text``: texts of the nodes a one-shot search named (``query_id, doc_id, node_ids``), in its order."""
    picked = chosen.select("query_id", "doc_id", F.posexplode("node_ids").alias("i", "node_id")).join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    return picked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
