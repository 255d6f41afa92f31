"""From pages to table-of-contents items: finding, reading, placing and checking them.

Pages are ``doc_id, page, text``; items ``doc_id, ord, structure, title, page, physical_index``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import heading_key, is_nearly_blank, match_key
from leafmill.operators import trees
from leafmill.session import materialise

#: A line of a contents page: title, leader dots or a gap, page number.
TOC_LINE = r"(?m)^\s*(?:\d+(?:\.\d+)*\.?\s+)?\S.*?(?:\.{3,}|…+| {3,}|\t+)\s*\d{1,4}\s*$"


def looks_like_toc(text: Column, least: int = 3) -> Column:
    """At least ``least`` lines that end in a page number after a leader."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOC_LINE)) >= least


def toc_pages(pages: DataFrame, is_toc: Column, look: int = 20) -> DataFrame:
    """Pages of the first run of consecutive contents pages that begins within the first ``look`` pages; the run
    goes on past them."""
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("_t", F.coalesce(is_toc, F.lit(False)))
    rows = rows.withColumn("_run", F.col("page") - F.sum(F.col("_t").cast("int")).over(w))
    runs = rows.where("_t").groupBy("doc_id", "_run").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    first = runs.where(F.col("first") <= look).groupBy("doc_id").agg(F.min(F.struct("first", "last")).alias("r")).select("doc_id", "r.*")
    return pages.join(first, "doc_id").where(F.col("page").between(F.col("first"), F.col("last"))).drop("first", "last")


def toc_text(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: contents pages in order, leaders of five dots or more as a colon."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return pages.groupBy("doc_id").agg(F.regexp_replace(F.regexp_replace(whole, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ").alias("text"))


def toc_items(texts: DataFrame) -> DataFrame:
    """Items of contents texts by rule: code, title and printed page of each line that has one."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    pattern = r"^\s*((?:\d+(?:\.\d+)*)(?=\.?\s))?\.?\s*(\S.*?)\s*(?::|\.{2,}|…+|\s{2,}|\t)\s*(\d{1,4})\s*$"
    got = lambda i: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", "ord", got(1).alias("structure"), got(2).alias("title"), got(3).cast("int").alias("page"))


def page_groups(pages: DataFrame, tokens: Column, most: int = 20_000, overlap: int = 1) -> DataFrame:
    """Adds ``group`` (array of the groups a page is in): pages packed in order up to a target of
    ceil((total / parts + most) / 2) tokens, parts = ceil(total / most); each group repeats the last ``overlap`` pages
    of the one before. A fold over each document's page sizes, in the JVM."""
    sized = pages.withColumn("_n", tokens)
    lists = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("_n").alias("n")))).alias("p"), F.sum("_n").alias("total"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / most))
    target = F.when(F.col("total") <= most, F.col("total")).otherwise(F.ceil((F.col("total") / parts + most) / 2))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("i"), F.expr("CAST(array() AS array<struct<page:int,group:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["size"] + x["n"] > F.col("target")) & (acc["i"] > 0)
        back = F.filter(F.col("p"), lambda y: (y["page"] < x["page"]) & (y["page"] >= x["page"] - overlap))
        group = acc["group"] + full.cast("int")
        again = F.when(full, F.transform(back, lambda y: F.struct(y["page"].cast("int").alias("page"), group.alias("group")))).otherwise(F.expr("CAST(array() AS array<struct<page:int,group:int>>)"))
        held = F.aggregate(back, F.lit(0).cast("long"), lambda s, y: s + y["n"].cast("long"))
        size = F.when(full, held + x["n"]).otherwise(acc["size"] + x["n"]).cast("long")
        return F.struct(group.alias("group"), size.alias("size"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], again, F.array(F.struct(x["page"].cast("int").alias("page"), group.alias("group")))).alias("out"))

    folded = lists.withColumn("target", target.cast("long")).select("doc_id", F.explode(F.aggregate("p", start, step)["out"]).alias("o")).select("doc_id", "o.page", "o.group")
    per = folded.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("group")).alias("group"))
    return pages.join(per, ["doc_id", "page"])


def page_offset(items: DataFrame, placed: DataFrame, first_page: int = 1) -> DataFrame:
    """``doc_id, offset``: the commonest difference of physical and printed page over equal titles; of equals the
    first seen."""
    pairs = items.where("page IS NOT NULL").select("doc_id", "ord", "title", "page").join(placed.where(F.col("physical_index") >= first_page).select("doc_id", "title", "physical_index"), ["doc_id", "title"])
    n = pairs.groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    return n.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("o"), -F.col("offset"))).alias("offset"))


def with_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """``physical_index`` = printed page plus the document's offset (0 where unknown)."""
    return items.drop("physical_index").join(offsets, "doc_id", "left").withColumn("physical_index", F.col("page") + F.coalesce("offset", F.lit(0))).drop("offset")


def title_on_page(title: Column, text: Column) -> Column:
    """Whether the heading key of a title (two characters or more) occurs on a page."""
    k = heading_key(title)
    return (F.length(k) >= 2) & F.contains(match_key(F.coalesce(text, F.lit(""))), k)


def with_moving_offset(items: DataFrame, pages: DataFrame, offsets: DataFrame, reach: int = 6, strong: int = 20) -> DataFrame:
    """Places items at page + offset, else up to ``reach`` pages after, else before; a title of ``strong`` key characters
    found elsewhere moves the offset for the items after it. Items found nowhere keep page + offset.

    Which pages hold which titles is one range join; the running offset is a fold over each document's items.
    """
    base = items.where("page IS NOT NULL").drop("physical_index").join(offsets, "doc_id", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    slack = 4 * reach
    asked = base.select("doc_id", "ord", "title", F.explode(F.sequence(F.col("page") + F.col("offset") - slack, F.col("page") + F.col("offset") + slack)).alias("_at"))
    on = asked.join(pages.where(~is_nearly_blank(F.col("text"))).select("doc_id", F.col("page").alias("_at"), "text"), ["doc_id", "_at"]).where(title_on_page(F.col("title"), F.col("text")))
    seen = on.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set("_at")).alias("seen"))
    rows = base.join(seen, ["doc_id", "ord"], "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "page", F.length(heading_key(F.col("title"))).alias("k"), "seen"))).alias("p"), F.first("offset").alias("offset"))
    order = [0, *range(1, reach + 1), *(-d for d in range(1, reach + 1))]

    def step(acc: Column, x: Column) -> Column:
        want = x["page"] + acc["offset"]
        hits = F.filter(F.transform(F.array(*(F.lit(d) for d in order)), lambda d: want + d), lambda p: F.array_contains(x["seen"], p))
        found = F.get(hits, 0)
        at = F.coalesce(found, want)
        offset = F.when(found.isNotNull() & (x["k"] >= strong), at - x["page"]).otherwise(acc["offset"])
        return F.struct(offset.alias("offset"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), at.alias("at"), found.isNotNull().alias("hit")))).alias("out"))

    ord_type = items.schema["ord"].dataType.simpleString()
    start = F.struct(F.col("offset").alias("offset"), F.expr(f"CAST(array() AS array<struct<ord:{ord_type},at:int,hit:boolean>>)").alias("out"))
    placed = lists.select("doc_id", F.explode(F.aggregate("p", start, step)["out"]).alias("o")).select("doc_id", "o.ord", F.col("o.at").alias("physical_index"), F.col("o.hit").alias("found"))
    return items.drop("physical_index").join(placed, ["doc_id", "ord"], "left")


def fill_between(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items without an index take the first page between their placed neighbours on which their title stands; none
    after the last placed item, as no page bounds them."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    rows = items.withColumns({"_a": F.coalesce(F.last("physical_index", ignorenulls=True).over(before), F.lit(1)), "_b": F.first("physical_index", ignorenulls=True).over(after)})
    open_ = rows.where("physical_index IS NULL AND _b >= _a").select("doc_id", "ord", "title", F.explode(F.sequence("_a", "_b")).alias("_p"))
    hit = open_.join(pages.select("doc_id", F.col("page").alias("_p"), "text"), ["doc_id", "_p"]).where(title_on_page(F.col("title"), F.col("text"))).groupBy("doc_id", "ord").agg(F.min("_p").alias("_found"))
    return rows.join(hit, ["doc_id", "ord"], "left").withColumn("physical_index", F.coalesce("physical_index", "_found")).drop("_a", "_b", "_found")


def verified(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``ok``: the title stands on the item's page. Items without an index aren't ok."""
    text = pages.select("doc_id", F.col("page").alias("physical_index"), F.col("text").alias("_t"))
    return items.join(text, ["doc_id", "physical_index"], "left").withColumn("ok", F.coalesce(title_on_page(F.col("title"), F.col("_t")), F.lit(False))).drop("_t")


def accuracy(checked: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, accuracy``: share of items that are ok; 0 where the last index lies in the first half of the pages."""
    n = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    per = checked.groupBy("doc_id").agg(F.avg(F.col("ok").cast("int")).alias("a"), F.max("physical_index").alias("last"))
    return per.join(n, "doc_id").select("doc_id", F.when(F.coalesce("last", F.lit(0)) < F.col("n") / 2, 0.0).otherwise(F.col("a")).alias("accuracy"))


def repaired(items: DataFrame, pages: DataFrame, rounds: int = 3) -> DataFrame:
    """Wrong items are sought between the nearest right ones, up to ``rounds`` times while any improves."""
    now = materialise(verified(items, pages))
    wrong = now.where("NOT ok").count()
    for _ in range(rounds):
        if not wrong:
            break
        tried = fill_between(now.withColumns({"_old": F.col("physical_index"), "physical_index": F.when(F.col("ok"), F.col("physical_index"))}).drop("ok"), pages)
        now = materialise(verified(tried.withColumn("physical_index", F.coalesce("physical_index", "_old")).drop("_old"), pages))
        left = now.where("NOT ok").count()
        if left == wrong:
            break
        wrong = left
    return now


def starts_page(items: DataFrame, pages: DataFrame, within: int = 100) -> DataFrame:
    """Adds ``appear_start`` (yes / no): the title's key begins the page's, give or take ``within`` characters."""
    text = pages.select("doc_id", F.col("page").alias("physical_index"), F.left(match_key(F.col("text")), F.lit(within)).alias("_t"))
    k = match_key(F.col("title"))
    return items.join(text, ["doc_id", "physical_index"], "left").withColumn("appear_start", F.when((F.length(k) >= 2) & F.startswith("_t", k), "yes").otherwise("no")).drop("_t")


def start_phrases(items: DataFrame, pages: DataFrame, length: int = 8) -> DataFrame:
    """Adds ``start_phrase``: the first ``length`` words after the title on its page and the next."""
    nearby = items.where("physical_index IS NOT NULL").select("doc_id", "ord", "title", F.explode(F.array(F.col("physical_index"), F.col("physical_index") + 1)).alias("page"))
    text = nearby.join(pages, ["doc_id", "page"]).groupBy("doc_id", "ord", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    rest = F.when(F.expr("locate(lower(title), lower(_t)) > 0"), F.expr("substring(_t, locate(lower(title), lower(_t)) + length(title))")).otherwise(F.col("_t"))
    words = F.filter(F.split(F.trim(F.regexp_replace(rest, r"\s+", " ")), " "), lambda w: w != "")
    return items.join(text.select("doc_id", "ord", F.nullif(F.array_join(F.slice(words, 1, length), " "), F.lit("")).alias("start_phrase")), ["doc_id", "ord"], "left")


def heading_items(pages: DataFrame) -> DataFrame:
    """Items of documents without contents pages, by rule: lines that begin with a dotted code and a capital."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    pattern = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-ZÀ-Ý].{1,118})$"
    rows = lines.where(F.col("line").rlike(pattern) & ~F.col("line").rlike(r"[.;,]\s*$") & ~F.col("line").rlike(r"(?:\.{3,}| {3,}|\t)\s*\d+\s*$"))
    w = Window.partitionBy("doc_id").orderBy("page", "i")
    return rows.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), F.regexp_extract("line", pattern, 1).alias("structure"), F.trim(F.regexp_extract("line", pattern, 2)).alias("title"), F.lit(None).cast("int").alias("page"), F.col("page").alias("physical_index"))


def oversized(nodes: DataFrame, pages: DataFrame, tokens: Column, most_pages: int = 10, most_tokens: int = 20_000) -> DataFrame:
    """Nodes whose span exceeds both limits: those to be divided further."""
    sums = nodes.where("start_index <= end_index").select("doc_id", "node_id", F.explode(F.sequence("start_index", "end_index")).alias("page")).join(pages.withColumn("_n", tokens), ["doc_id", "page"]).groupBy("doc_id", "node_id").agg(F.sum("_n").alias("tokens"), F.count("*").alias("n"))
    return nodes.join(sums.where((F.col("n") > most_pages) & (F.col("tokens") >= most_tokens)).select("doc_id", "node_id", "tokens"), ["doc_id", "node_id"])


def divided(nodes: DataFrame, pages: DataFrame, tokens: Column, most_pages: int = 10, most_tokens: int = 20_000, rounds: int = 10) -> DataFrame:
    """``nodes`` with the leaves over both limits divided by the headings on their pages, and these again.

    The new children are named after their parent; one that repeats its parent's title and comes first goes; the parent
    then ends where its first child starts. A leaf without headings stays as it is, and so does what is still over
    the limits after ``rounds``.
    """
    kept = ["doc_id", "node_id", "parent_id", "ord", "structure", "title", "start_index", "end_index"]
    rest = [c for c in nodes.columns if c not in kept]
    now = materialise(nodes.withColumn("ord", F.col("ord").cast("double")))
    tried = None
    for _ in range(rounds):
        big = oversized(trees.leaves(now), pages, tokens, most_pages, most_tokens)
        big = materialise(big if tried is None else big.join(tried, ["doc_id", "node_id"], "left_anti"))
        if big.isEmpty():
            break
        tried = big.select("doc_id", "node_id") if tried is None else tried.union(big.select("doc_id", "node_id"))
        spans = big.select(F.col("doc_id").alias("_doc"), "node_id", F.explode(F.sequence("start_index", "end_index")).alias("page"))
        own = spans.join(pages, (spans["_doc"] == pages["doc_id"]) & (spans["page"] == pages["page"])).select(F.concat_ws("\x01", "_doc", "node_id").alias("doc_id"), pages["page"], "text")
        heads = heading_items(own).select(F.split("doc_id", "\x01").alias("_k"), F.col("ord").alias("i"), F.col("structure").alias("s"), F.col("title").alias("t"), "physical_index").select(F.col("_k")[0].alias("doc_id"), F.col("_k")[1].alias("node_id"), "i", "s", "t", "physical_index")
        items = heads.join(big.select("doc_id", "node_id", F.col("ord").alias("p_ord"), F.col("title").alias("p_title"), F.col("end_index").alias("p_end")), ["doc_id", "node_id"])
        items = items.where(~((F.col("i") == 0) & (F.trim("t") == F.trim("p_title"))))
        w = Window.partitionBy("doc_id", "node_id").orderBy("i")
        new = items.withColumns({"n": F.row_number().over(w), "to": F.greatest("physical_index", F.coalesce(F.lead("physical_index").over(w), "p_end"))})
        new = materialise(new.select("doc_id", F.concat("node_id", F.lit("."), F.col("n").cast("string")).alias("new_id"), F.col("node_id").alias("parent_id"), (F.col("p_ord") + F.col("n") / F.lit(1e6)).alias("ord"), F.col("s").alias("structure"), F.col("t").alias("title"), F.col("physical_index").alias("start_index"), F.col("to").alias("end_index")))
        first = new.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min("start_index").alias("_first"))
        now = now.join(first, ["doc_id", "node_id"], "left").withColumn("end_index", F.coalesce("_first", "end_index")).drop("_first")
        added = new.withColumnRenamed("new_id", "node_id")
        now = materialise(now.unionByName(added, allowMissingColumns=True))
    w = Window.partitionBy("doc_id").orderBy("ord", "node_id")
    return now.withColumn("ord", (F.row_number().over(w) - 1).cast(nodes.schema["ord"].dataType)).select(*kept, *rest)


def title_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, ord, seen``: the pages on which each item's title stands. A document's titles go to each of its pages as
    one array: the pages' texts aren't repeated."""
    key = heading_key(F.col("title"))
    titles = items.where(F.length(key) >= 2).groupBy("doc_id").agg(F.collect_list(F.struct("ord", key.alias("k"))).alias("titles"))
    on = pages.select("doc_id", "page", match_key(F.coalesce("text", F.lit(""))).alias("_t")).join(titles, "doc_id")
    hits = on.select("doc_id", "page", F.explode(F.filter("titles", lambda x: F.contains(F.col("_t"), x["k"]))).alias("x"))
    return hits.groupBy("doc_id", F.col("x.ord").alias("ord")).agg(F.array_sort(F.collect_set("page")).alias("seen"))


def placed_by_title(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``physical_index`` of items without printed pages: the first page with the title that isn't before the page of
    the item before; null where there is none."""
    rows = items.drop("physical_index").join(title_pages(items, pages), ["doc_id", "ord"], "left")
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("seen", F.array().cast("array<int>")).alias("seen")))).alias("p"))
    ord_type = items.schema["ord"].dataType.simpleString()
    start = F.struct(F.lit(1).alias("last"), F.expr(f"CAST(array() AS array<struct<ord:{ord_type},at:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.get(F.filter(x["seen"], lambda p: p >= acc["last"]), 0).cast("int")
        return F.struct(F.coalesce(at, acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), at.alias("at")))).alias("out"))

    placed = lists.select("doc_id", F.explode(F.aggregate("p", start, step)["out"]).alias("o")).select("doc_id", "o.ord", F.col("o.at").alias("physical_index"))
    return items.drop("physical_index").join(placed, ["doc_id", "ord"], "left")


def _accepted(placed: DataFrame, body: DataFrame, pages: DataFrame, accept: float, repair_above: float) -> DataFrame:
    """Items of the documents of which a share of ``accept`` checks out, and, mended, of those over ``repair_above``."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    inside = placed.join(last, "doc_id").withColumn("physical_index", F.when(F.col("physical_index").between(1, F.col("pages")), F.col("physical_index"))).drop("pages")
    checked = materialise(verified(inside.where("physical_index IS NOT NULL"), body))
    share = materialise(accuracy(checked, pages))
    right = checked.join(share.where(F.col("accuracy") >= accept).select("doc_id"), "doc_id", "left_semi")
    wrong = share.where((F.col("accuracy") < accept) & (F.col("accuracy") > repair_above)).select("doc_id")
    mended = repaired(checked.drop("ok").join(wrong, "doc_id", "left_semi"), body)
    return materialise(right.unionByName(mended.select(*right.columns)))


def build_index(pages: DataFrame, accept: float = 1.0, repair_above: float = 0.6, tokens: Column | None = None, most_pages: int = 10, most_tokens: int = 20_000) -> DataFrame:
    """Pages to tree rows: ``doc_id, node_id, parent_id, ord, structure, title, start_index, end_index, mode``.

    A ladder: contents with printed pages; the same titles sought without their pages; headings in the text. A step
    stands if a share of ``accept`` of its items checks out, or, after mending, if more than ``repair_above`` did;
    otherwise the document goes on to the next. A document that no step serves has one node over all its pages. With
    ``tokens`` (of a page's text) large leaves are divided further (see ``divided``).
    """
    pages = materialise(pages)
    last = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    contents = toc_pages(pages, looks_like_toc(F.col("text")))
    body = pages.join(contents.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    items = materialise(toc_items(toc_text(contents)))
    on = items.join(title_pages(items, body), ["doc_id", "ord"]).select("doc_id", "title", F.array_min("seen").alias("physical_index"))
    fields = ["doc_id", "ord", "structure", "title", "physical_index"]
    by_page = _accepted(with_moving_offset(items, body, page_offset(items, on)).select(*fields), body, pages, accept, repair_above)
    open_ = items.join(by_page.select("doc_id").distinct(), "doc_id", "left_anti")
    by_title = _accepted(placed_by_title(open_, body).select(*fields), body, pages, accept, repair_above)
    served = by_page.withColumn("mode", F.lit("contents")).unionByName(by_title.withColumn("mode", F.lit("titles")))
    by_heading = heading_items(pages.join(served.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("mode", F.lit("headings"))
    both = served.select(*fields, "mode").unionByName(by_heading.select(*fields, "mode"))
    bare = last.join(both.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("ord"), F.lit("1").alias("structure"), F.col("doc_id").alias("title"), F.lit(1).alias("physical_index"), F.lit("whole").alias("mode"))
    every = trees.with_preface(both.unionByName(bare)).withColumn("mode", F.coalesce("mode", F.lit("preface")))
    flagged = starts_page(every, pages).join(last, "doc_id")
    spans = trees.code_parents(materialise(trees.page_spans(flagged)))
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    rows = spans.select("doc_id", name("ord").alias("node_id"), name("parent_ord").alias("parent_id"), "ord", "structure", "title", "start_index", "end_index", "mode")
    return trees.numbered(rows if tokens is None else divided(rows, pages, tokens, most_pages, most_tokens))


def build_markdown_index(texts: DataFrame, thin_below: int | None = None) -> DataFrame:
    """Markdown to tree rows: ``doc_id, node_id, parent_id, ord, title, line_num, level, text``; headings under
    ``thin_below`` tokens take in what is below them."""
    heads = materialise(trees.markdown_headings(texts))
    if thin_below is not None:
        tokens = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
        heads = materialise(trees.thinned(heads, tokens, thin_below))
    up = trees.heading_parents(heads)
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return trees.numbered(up.select("doc_id", name("ord").alias("node_id"), name("parent_ord").alias("parent_id"), "ord", "title", "line_num", "level", "text"))


def page_range(spec: str) -> list[int]:
    """``5-7,12`` as sorted distinct pages; raises on anything else."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m or (m[2] and int(m[1]) > int(m[2])):
            raise ValueError(f"page range {spec!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def group_target(total: int, most: int) -> int:
    """Tokens that a page group aims at."""
    return total if total <= most else math.ceil((total / math.ceil(total / most) + most) / 2)
