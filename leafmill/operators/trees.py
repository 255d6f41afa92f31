"""Section trees as rows: ``doc_id, node_id, parent_id, ord`` (ord = preorder place), and what is read from,
checked in and changed about them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import match_key
from leafmill.session import materialise


# ------------------------------------------------------------------------------------------ reading
def with_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """Adds ``depth`` (1 for roots) and ``path`` (node ids from the root), a level at a time. A node whose parent
    isn't in its document is a root; nodes on a cycle have no root and raise."""
    own = nodes.select("doc_id", F.col("node_id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    base = materialise(nodes.join(own, ["doc_id", "parent_id"], "left"))
    level = base.where("_known IS NULL").withColumns({"depth": F.lit(1), "path": F.array("node_id")})
    out, rest = level, base.where("_known IS NOT NULL")
    for _ in range(max_depth):
        up = level.select("doc_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        level = materialise(rest.join(up, ["doc_id", "parent_id"]).withColumns({"depth": F.col("_d") + 1, "path": F.concat("_p", F.array("node_id"))}).drop("_d", "_p"))
        if level.isEmpty():
            if out.count() < base.count():
                raise RuntimeError("trees: some nodes hang on a cycle")
            return out.drop("_known")
        out = out.unionByName(level)
    raise RuntimeError(f"trees deeper than {max_depth} levels, or a cycle")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct(), ["doc_id", "node_id"], "left_anti")


def numbered(nodes: DataFrame, width: int = 4) -> DataFrame:
    """``node_id`` as zero-padded place in preorder, parents renamed with it."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    names = nodes.select("doc_id", F.col("node_id").alias("_old"), F.lpad((F.row_number().over(w) - 1).cast("string"), width, "0").alias("_new"), "ord")
    own = names.select("doc_id", F.col("_old").alias("node_id"), F.col("_new"), "ord")
    up = names.select("doc_id", F.col("_old").alias("parent_id"), F.col("_new").alias("_up"))
    return nodes.join(own, ["doc_id", "node_id", "ord"]).join(up, ["doc_id", "parent_id"], "left").drop("node_id", "parent_id").withColumnsRenamed({"_new": "node_id", "_up": "parent_id"})


def one_per_id(nodes: DataFrame) -> DataFrame:
    """The last of nodes that share an id."""
    w = Window.partitionBy("doc_id", "node_id").orderBy(F.col("ord").desc())
    return nodes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ancestors(paths: DataFrame) -> DataFrame:
    """``doc_id, ancestor, node_id``: each node with itself and everything above it."""
    return paths.select("doc_id", F.explode("path").alias("ancestor"), "node_id")


def descendant_chunks(nodes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``doc_id, node_id, chunks, unseen``: chunks of the leaves under each node, and those not in ``seen``
    (``chunk_id``)."""
    paths = with_paths(nodes)
    low = ancestors(leaves(paths)).join(nodes.select("doc_id", "node_id", "chunk_id", "ord"), ["doc_id", "node_id"]).where("chunk_id IS NOT NULL")
    if seen is not None:
        low = low.join(seen.select("chunk_id").distinct().withColumn("_s", F.lit(1)), "chunk_id", "left")
    else:
        low = low.withColumn("_s", F.lit(None).cast("int"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"])
    return low.groupBy("doc_id", F.col("ancestor").alias("node_id")).agg(ids.alias("chunks"), F.count_if(F.col("_s").isNull()).alias("unseen"))


def inherit_flag(paths: DataFrame, flag: Column) -> DataFrame:
    """``doc_id, node_id, inherited``: whether the flag holds for a node or anything above it."""
    marked = paths.select("doc_id", F.col("node_id").alias("ancestor"), F.coalesce(flag, F.lit(False)).alias("_f"))
    return ancestors(paths).join(marked, ["doc_id", "ancestor"]).groupBy("doc_id", "node_id").agg(F.bool_or("_f").alias("inherited"))


def node_text(nodes: DataFrame, pages: DataFrame, labels: bool = False) -> DataFrame:
    """``doc_id, node_id, text``: the pages (``doc_id, page, text``) of each node's span in order. Spans that run
    backwards or lack an end have no text."""
    spans = nodes.where("start_index <= end_index").select("doc_id", "node_id", F.explode(F.sequence("start_index", "end_index")).alias("page"))
    text = F.concat(F.lit("<page_"), F.col("page").cast("string"), F.lit(">\n"), "text", F.lit("\n</page_"), F.col("page").cast("string"), F.lit(">")) if labels else F.col("text")
    rows = spans.join(pages, ["doc_id", "page"]).select("doc_id", "node_id", "page", text.alias("text"))
    return rows.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_images(nodes: DataFrame, node_ids: list[str]) -> DataFrame:
    """Pages that the given nodes span, each once."""
    return nodes.where(F.col("node_id").isin(node_ids) & (F.col("start_index") <= F.col("end_index"))).select("doc_id", F.explode(F.sequence("start_index", "end_index")).alias("page")).distinct()


def collection(nodes: DataFrame, name: str = "collection", sep: str = "_") -> DataFrame:
    """One tree over all documents: ids prefixed by their document, a node for each document, one root."""
    pre = lambda c: F.concat_ws(sep, "doc_id", c)
    own = nodes.select(F.col("doc_id"), F.col("node_id").alias("local_id"), pre("node_id").alias("node_id"), F.coalesce(F.when(F.col("parent_id").isNotNull(), pre("parent_id")), F.col("doc_id")).alias("parent_id"), "title", F.lit("section").alias("node_type"), (F.col("ord") + 1).alias("ord"))
    docs = nodes.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("local_id"), F.col("doc_id").alias("node_id"), F.lit(name).alias("parent_id"), F.translate("doc_id", "_", " ").alias("title"), F.lit("document_node").alias("node_type"), F.lit(0).alias("ord"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    root = nodes.sparkSession.createDataFrame([(None, None, name, None, name, "collection_root", 0)], kinds)
    return own.unionByName(docs).unionByName(root)


def outline(paths: DataFrame, width: int = 40) -> DataFrame:
    """A line for each node, indented by depth."""
    return paths.select("doc_id", "ord", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.left(F.coalesce("title", F.lit("")), F.lit(width))).alias("line"))


def tree_statistics(nodes: DataFrame, widths: tuple[int, ...] = (5, 7, 10)) -> DataFrame:
    """For each document: nodes, leaves, depth, widest level, and the share of nodes that a beam of each width keeps
    (mean over levels of min(m, width) / width)."""
    paths = with_paths(nodes)
    low = leaves(nodes).groupBy("doc_id").agg(F.count("*").alias("leaves"))
    level = paths.groupBy("doc_id", "depth").agg(F.count("*").alias("width"))
    kept = [F.avg(F.least(F.lit(m), F.col("width")) / F.col("width")).alias(f"retained_{m}") for m in widths]
    return level.groupBy("doc_id").agg(F.sum("width").alias("nodes"), F.max("depth").alias("max_depth"), F.max("width").alias("max_width"), *kept).join(low, "doc_id", "left")


def tree_levels(nodes: DataFrame, widths: tuple[int, ...] = (5, 7, 10)) -> DataFrame:
    """For each document and level its width and the share of it that a beam of each width keeps."""
    level = with_paths(nodes).groupBy("doc_id", "depth").agg(F.count("*").alias("width"))
    return level.withColumns({f"retained_{m}": F.least(F.lit(m), F.col("width")) / F.col("width") for m in widths})


def with_children_flag(paths: DataFrame) -> DataFrame:
    """Adds ``has_children``."""
    inner = paths.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct().withColumn("_c", F.lit(True))
    return paths.join(inner, ["doc_id", "node_id"], "left").withColumn("has_children", F.coalesce("_c", F.lit(False))).drop("_c")


def clean_outline(nodes: DataFrame) -> DataFrame:
    """What a description of a tree is made from: title, id and summary of each node, in order."""
    return nodes.select("doc_id", "ord", "node_id", "parent_id", *(F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in ("title", "summary")))


def without_fields(df: DataFrame, column: str, fields: tuple[str, ...]) -> DataFrame:
    """A JSON column without the given fields at any depth; text that isn't JSON stays as it is. (Of flat rows these are
    columns: drop them.)"""
    gone = frozenset(fields)

    def strip(value):
        if isinstance(value, dict):
            return {k: strip(v) for k, v in value.items() if k not in gone}
        return [strip(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(strip(json.loads(text)), ensure_ascii=False)
            except (TypeError, ValueError, RecursionError):
                return text

        return texts.map(one)

    return df.withColumn(column, run(F.col(column)))


# ----------------------------------------------------------------------------------------- checking
def _issues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order issues along ``ord`` within the keys; a row without indexes isn't anybody's predecessor."""
    good = F.col("start_index").isNotNull() & F.col("end_index").isNotNull()
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.last(F.when(good, F.col(c)), ignorenulls=True).over(w)
    out = rows.withColumns({"previous_start": before("start_index"), "previous_end": before("end_index"), "previous_node": before("node_id")})
    found = F.array_compact(
        F.array(
            F.when(~good, "missing_index"),
            F.when(good & (F.col("start_index") > F.col("end_index")), "start_after_end"),
            F.when(good & (F.col("start_index") < F.col("previous_start")), "start_index_goes_backwards"),
            F.when(good & (F.col("start_index") < F.col("previous_end")), "start_before_previous_end"),
        )
    )
    return out.withColumn("issue", F.explode(found)).select("doc_id", *(k for k in keys if k != "doc_id"), "node_id", "ord", "issue", "start_index", "end_index", "previous_node", "previous_start", "previous_end")


def order_issues(rows: DataFrame) -> DataFrame:
    """Issues along the leaves of each document."""
    return _issues(rows, ["doc_id"])


def sibling_issues(nodes: DataFrame) -> DataFrame:
    """Issues along the children of each node."""
    return _issues(nodes, ["doc_id", "parent_id"])


def point_duplicates(chunks: DataFrame, doc: str = "doc_name", order: tuple[str, ...] = ("start_index", "chunk_id"), prefix: int | None = None) -> DataFrame:
    """Adds ``canonical_id, is_copy``: within a document, chunks of one key point at the first of them.

    The key is structure, title and start phrase; without a phrase structure and title; without these the
    text, or its first ``prefix`` characters if given. A chunk without any of them is its own.
    """
    key = lambda c: F.nullif(match_key(F.col(c)), F.lit(""))
    s, t, p = key("structure"), key("title"), key("start_phrase")
    text = F.nullif(match_key(F.col("text") if prefix is None else F.left("text", F.lit(prefix))), F.lit(""))
    k = F.when(s.isNotNull() & t.isNotNull() & p.isNotNull(), F.concat_ws("|", F.lit("stp"), s, t, p)).when(s.isNotNull() & t.isNotNull(), F.concat_ws("|", F.lit("st"), s, t)).when(text.isNotNull(), F.concat_ws("|", F.lit("x"), F.sha2(text, 256)))
    keyed = chunks.withColumn("_k", F.coalesce(k, F.concat(F.lit("id|"), "chunk_id")))
    w = Window.partitionBy(doc, "_k").orderBy(*order)
    first = F.first("chunk_id").over(w)
    return keyed.withColumn("canonical_id", first).withColumn("is_copy", F.col("canonical_id") != F.col("chunk_id")).drop("_k")


# ----------------------------------------------------------------------------------------- building
def page_spans(items: DataFrame) -> DataFrame:
    """Adds ``start_index, end_index`` to table-of-contents items (``doc_id, ord, physical_index, appear_start,
    pages``): each ends on the page before the next one if that starts its page, else on the next one's page; the
    last ends with the document. May give an end before the start on a shared page."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    nxt, starts = F.lead("physical_index").over(w), F.lead("appear_start").over(w)
    return items.withColumns({"start_index": F.col("physical_index"), "end_index": F.when(nxt.isNull(), F.col("pages")).when(starts == "yes", nxt - 1).otherwise(nxt)})


def code_parents(items: DataFrame, doc: str = "doc_id", code: str = "structure") -> DataFrame:
    """Adds ``parent_ord``: the latest earlier item whose dotted code is this one's without its last part; null for
    roots and where no such item came before."""
    up = F.nullif(F.regexp_extract(code, r"^(.*)\.[^.]*$", 1), F.lit(""))
    rows = items.select(doc, "ord", F.col(code).alias("_c"), up.alias("_up"))
    # own codes and asked codes in one sorted stream: the last own code before an asking row is its parent
    tell = rows.where("_c IS NOT NULL").select(doc, F.col("_c").alias("_key"), "ord", F.lit(1).alias("_own"))
    ask = rows.where("_up IS NOT NULL").select(doc, F.col("_up").alias("_key"), "ord", F.lit(0).alias("_own"))
    w = Window.partitionBy(doc, "_key").orderBy("ord", "_own").rowsBetween(Window.unboundedPreceding, -1)
    found = tell.union(ask).withColumn("parent_ord", F.last(F.when(F.col("_own") == 1, F.col("ord")), ignorenulls=True).over(w)).where("_own = 0").select(doc, "ord", "parent_ord")
    return items.join(found, [doc, "ord"], "left")


def with_preface(items: DataFrame) -> DataFrame:
    """A ``Preface`` item for documents whose first item starts after page 1."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("p"), F.min("ord").alias("o")).where("p > 1")
    extra = first.select("doc_id", (F.col("o") - 1).alias("ord"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"), F.lit("0").alias("structure"))
    return items.unionByName(extra, allowMissingColumns=True)


def within_pages(items: DataFrame) -> DataFrame:
    """Indexes beyond the document's last page become null."""
    return items.withColumn("physical_index", F.when(F.col("physical_index") <= F.col("pages"), F.col("physical_index")))


def heading_parents(rows: DataFrame) -> DataFrame:
    """Adds ``parent_ord`` to headings (``doc_id, ord, level``): the nearest earlier one of a lower level.

    The last place of every level so far is kept in a map by one window, so that the work is linear in a document's
    headings; levels are those of Markdown, 1 to 6.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col("level") == n, F.col("ord"))).over(w) for n in range(1, 7)}
    out = rows.withColumns({f"_l{n}": c for n, c in last.items()})
    nearest = F.array_max(F.array_compact(F.array(*(F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 7)))))
    return out.withColumn("parent_ord", nearest).drop(*(f"_l{n}" for n in range(1, 7)))


def markdown_headings(texts: DataFrame) -> DataFrame:
    """``doc_id, ord, level, title, line_num, text``: headings outside code fences, each with the lines from it up to
    the next heading."""
    lines = texts.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    fence = F.col("line").rlike(r"^\s*```")
    rows = lines.withColumn("_f", F.sum(fence.cast("int")).over(w))
    head = ~fence & (F.col("_f") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s+\S")
    rows = rows.withColumns({"level": F.when(head, F.length(F.regexp_extract("line", r"^(#{1,6})", 1))), "ord": F.sum(head.cast("int")).over(w)}).where("ord > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("doc_id", "ord").agg(F.max("level").alias("level"), F.min("i").alias("_i"), F.min_by("line", "i").alias("_h"), body.alias("text"))
    return out.select("doc_id", "ord", "level", F.trim(F.regexp_replace("_h", r"^#{1,6}\s+", "")).alias("title"), (F.col("_i") + 1).alias("line_num"), "text")


def subtree_end(rows: DataFrame) -> DataFrame:
    """Adds ``end_ord`` to headings: place of the next row of the same or a lower level; null for none."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    nearest = {n: F.min(F.when(F.col("level") == n, F.col("ord"))).over(w) for n in range(1, 7)}
    out = rows.withColumns({f"_l{n}": c for n, c in nearest.items()})
    return out.withColumn("end_ord", F.array_min(F.array_compact(F.array(*(F.when(F.col("level") >= n, F.col(f"_l{n}")) for n in range(1, 7)))))).drop(*(f"_l{n}" for n in range(1, 7)))


def subtree_tokens(rows: DataFrame, tokens: Column) -> DataFrame:
    """``doc_id, ord, subtree_tokens``: tokens of a heading and everything below it, by one running sum."""
    ends = subtree_end(rows.withColumn("_t", tokens))
    w = Window.partitionBy("doc_id").orderBy("ord")
    run = ends.withColumn("_run", F.sum("_t").over(w))
    at = run.select("doc_id", F.col("ord").alias("end_ord"), (F.col("_run") - F.col("_t")).alias("_before_end"))
    whole = run.groupBy("doc_id").agg(F.sum("_t").alias("_all"))
    return run.join(at, ["doc_id", "end_ord"], "left").join(whole, "doc_id").select("doc_id", "ord", (F.coalesce("_before_end", "_all") - F.col("_run") + F.col("_t")).alias("subtree_tokens"))


def thinned(rows: DataFrame, tokens: Column, least: int) -> DataFrame:
    """Headings whose subtree has fewer than ``least`` tokens take in the text of everything below them, which goes."""
    sized = rows.join(subtree_tokens(rows, tokens), ["doc_id", "ord"])
    ends = materialise(subtree_end(sized))
    # the outermost small heading covers a stretch; what starts inside the stretch of an earlier small one goes
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    far = F.coalesce("end_ord", F.lit(2147483647))
    covered = F.max(F.when(F.col("subtree_tokens") < least, far)).over(w)
    marked = ends.withColumn("_under", F.coalesce(covered > F.col("ord"), F.lit(False)))
    group = F.max(F.when(~F.col("_under"), F.col("ord"))).over(Window.partitionBy("doc_id").orderBy("ord"))
    grouped = marked.withColumn("_g", group)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    merged = grouped.groupBy("doc_id", "_g").agg(text.alias("text"))
    return marked.where("NOT _under").drop("text", "_under", "end_ord").join(merged.withColumnRenamed("_g", "ord"), ["doc_id", "ord"])


# ------------------------------------------------------------------------------------------ editing
def with_intro_leaves(nodes: DataFrame) -> DataFrame:
    """A leaf ``<id>_intro`` before the first child of every parent, if both know their start page."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    first = nodes.where("parent_id IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", F.col("parent_id").alias("node_id"), F.col("start_index").alias("_end"), F.col("ord").alias("_ord"))
    intro = nodes.select("doc_id", "node_id", "title", "start_index").join(first, ["doc_id", "node_id"]).where("start_index IS NOT NULL AND _end IS NOT NULL")
    extra = intro.select("doc_id", F.concat("node_id", F.lit("_intro")).alias("node_id"), F.col("node_id").alias("parent_id"), (F.col("_ord") - 0.5).alias("ord"), F.concat(F.lit("Introduction to "), "title").alias("title"), "start_index", F.col("_end").alias("end_index"), F.lit(True).alias("is_intro_node"))
    return nodes.withColumn("ord", F.col("ord").cast("double")).unionByName(extra, allowMissingColumns=True)


def without(nodes: DataFrame, rejected: DataFrame) -> DataFrame:
    """Nodes but for rejected ones (``doc_id, node_id``)."""
    return nodes.join(rejected, ["doc_id", "node_id"], "left_anti")


def merge_coded_siblings(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Siblings with one section code become the first of them: missing fields filled from the later, children joined."""
    w = Window.partitionBy("doc_id", "parent_id", "structure").orderBy("ord")
    coded = nodes.where("structure IS NOT NULL")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept_id = F.first("node_id").over(whole)
    filled = coded.withColumns({"_keep": kept_id, **{f: F.first(f, ignorenulls=True).over(whole) for f in fields}})
    moved = filled.where("node_id <> _keep").select("doc_id", F.col("node_id").alias("parent_id"), F.col("_keep").alias("_to"))
    out = filled.where("node_id = _keep").drop("_keep").unionByName(nodes.where("structure IS NULL"))
    return out.join(moved, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("_to", "parent_id")).drop("_to")


def lift_wrappers(nodes: DataFrame) -> DataFrame:
    """Uncoded nodes that repeat the title and phrase of an uncoded ancestor go, and their children move to the nearest
    ancestor that stays; a coded node on the way starts afresh. Uncoded siblings with one key: the first stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        alias: dict[str, str | None] = {}
        keys: dict[str | None, set] = {None: set()}
        placed: set[tuple] = set()
        keep, parents = [], []
        for i, r in zip(pdf.index, pdf.to_dict("records")):
            up = alias.get(r["parent_id"], r["parent_id"]) if isinstance(r["parent_id"], str) else None
            above = keys.get(up, set())
            coded = isinstance(r["structure"], str) and r["structure"] != ""
            key = None if coded else tuple(" ".join(str(r[c] or "").lower().split()) for c in ("title", "start_phrase"))
            if key and key != ("", "") and (key in above or (up, key) in placed):
                alias[r["node_id"]] = up
                continue
            if key:
                placed.add((up, key))
            keys[r["node_id"]] = set() if coded else above | {key}
            alias[r["node_id"]] = r["node_id"]
            keep.append(i), parents.append(up)
        out = pdf.loc[keep].copy()
        out["parent_id"] = parents
        return out

    return nodes.groupBy("doc_id").applyInPandas(run, nodes.schema)


def apply_corrections(nodes: DataFrame, operations: DataFrame) -> DataFrame:
    """Replays ``operations`` (``doc_id, op_no, action, node_id, target_parent_id, position, reference_id, start_index,
    end_index``) in order on each tree: ``remove`` (with everything below), ``move`` (``first``, ``last``,
    ``before`` / ``after`` a reference; ``__root__`` is the top) and ``update_indexes``. An unknown action or node
    raises. ``ord`` is preorder afterwards. Trees without operations stay as they are."""

    def run(tree: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        if not len(ops) or not len(tree):
            if len(ops) and not len(tree):
                raise ValueError(f"corrections for {ops.iloc[0]['doc_id']}, which has no nodes")
            return tree
        tree = tree.sort_values("ord").set_index("node_id", drop=False)
        below: dict[str | None, list[str]] = {}
        parent: dict[str, str | None] = {}
        for n, p in zip(tree["node_id"], tree["parent_id"]):
            p = p if isinstance(p, str) else None
            parent[n] = p
            below.setdefault(p, []).append(n)

        def known(n) -> str:
            if n not in parent:
                raise ValueError(f"{ops.iloc[0]['doc_id']}: no node {n}")
            return n

        def under(n: str) -> Iterator[str]:
            yield n
            for c in below.get(n, []):
                yield from under(c)

        for op in ops.sort_values("op_no").to_dict("records"):
            n, action = known(op["node_id"]), op["action"]
            if action == "remove":
                below[parent[n]].remove(n)
                for x in list(under(n)):
                    parent.pop(x)
            elif action == "move":
                target = None if op["target_parent_id"] in ("__root__", None) else known(op["target_parent_id"])
                if target in set(under(n)):
                    raise ValueError(f"{op['doc_id']}: {n} can't move below itself")
                below[parent[n]].remove(n)
                row = below.setdefault(target, [])
                where = op["position"] or "last"
                if where in ("before", "after"):
                    if op["reference_id"] not in row:
                        raise ValueError(f"{op['doc_id']}: {op['reference_id']} isn't below {target}")
                    row.insert(row.index(op["reference_id"]) + (where == "after"), n)
                elif where in ("first", "last"):
                    row.insert(0 if where == "first" else len(row), n)
                else:
                    raise ValueError(f"unknown position {where}")
                parent[n] = target
            elif action == "update_indexes":
                for c in ("start_index", "end_index"):
                    if op[c] == op[c] and op[c] is not None:
                        tree.loc[n, c] = op[c]
            else:
                raise ValueError(f"unknown action {action}")
        order = [x for top in below.get(None, []) for x in under(top)]
        out = tree.loc[order].copy()
        out["parent_id"] = [parent[x] for x in order]
        out["ord"] = range(len(order))
        return out.reset_index(drop=True)

    # names of their own: both sides may come from one frame, whose columns Spark would take for the same
    names = operations.columns
    renamed = operations.toDF(*(f"op_{c}" for c in names))

    def both(tree: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        return run(tree, ops.set_axis(names, axis=1))

    return nodes.groupBy("doc_id").cogroup(renamed.groupBy("op_doc_id")).applyInPandas(both, nodes.schema)
