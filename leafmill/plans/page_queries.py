"""Queries of page contents, section trees by dotted codes, and sections.

The chunks of a document, by their ids, serve as its pages; their titles as items of its contents, printed two pages
(three on every seventh) before where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import text
from leafmill.functions.words import token_count
from leafmill.operators import sections, toc, trees
from leafmill.plans.core_queries import CURRENT_SQL, MATCH_KEY_SQL, WORDS_SQL, current_chunks
from leafmill.plans.queries import Registry
from leafmill.session import materialise

REGISTRY = Registry()
query = REGISTRY.query

KEY_SQL = MATCH_KEY_SQL.format
HEADING_KEY_SQL = MATCH_KEY_SQL.format(r"regexp_replace({0}, '^\s*\d+\s*', '')").format
PAGES_SQL = f"""WITH RECURSIVE {CURRENT_SQL}, pg AS (SELECT doc_name AS doc_id, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) AS page, chunk_id, title, structure, start_phrase, coalesce(text, '') AS text FROM cur),
it AS (SELECT doc_id, page AS ord, title, structure, page - 2 - CASE WHEN page % 7 = 0 THEN 1 ELSE 0 END AS printed FROM pg)"""


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_name").orderBy("chunk_id")
    return current_chunks(spark, d).select(F.col("doc_name").alias("doc_id"), F.row_number().over(w).alias("page"), "chunk_id", "title", "structure", "start_phrase", F.coalesce("text", F.lit("")).alias("text"))


def _items(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.col("page").alias("ord"), "title", "structure", (F.col("page") - 2 - (F.col("page") % 7 == 0).cast("int")).alias("page"))


# ------------------------------------------------------------------------------------ contents of pages
@query(
    "tc_contents",
    r"""SELECT chunk_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*(?:\d+(?:\.\d+)*\.?\s+)?\S.*?(?:\.{3,}|…+| {3,}|\t+)\s*\d{1,4}\s*$')) >= 3 AS is_contents
FROM (SELECT DISTINCT chunk_id, text FROM chunks)""",
)
def tc_contents(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/chunks.parquet").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", toc.looks_like_toc(F.col("text")).alias("is_contents"))


@query(
    "tc_runs",
    PAGES_SQL
    + """, t AS (SELECT *, page % 5 IN (3, 4) AS is_toc FROM pg), r AS (SELECT *, page - sum(is_toc::INT) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM t),
f AS (SELECT doc_id, run, min(page) AS a, max(page) AS b FROM r WHERE is_toc GROUP BY ALL), g AS (SELECT doc_id, min(a) AS a FROM f WHERE a <= 20 GROUP BY doc_id)
SELECT pg.doc_id, pg.page FROM g JOIN f USING (doc_id, a) JOIN pg ON pg.doc_id = g.doc_id AND pg.page BETWEEN f.a AND f.b""",
)
def tc_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first run of contents pages, where every third and fourth page of five counts as one."""
    return toc.toc_pages(chunk_pages(spark, d), (F.col("page") % 5).isin(3, 4)).select("doc_id", F.col("page").cast("long").alias("page"))


@query(
    "tc_groups",
    PAGES_SQL
    + f""", z AS (SELECT doc_id, page, {WORDS_SQL.format('text')} AS n FROM pg), tot AS (SELECT doc_id, sum(n) AS total FROM z GROUP BY doc_id),
tg AS (SELECT doc_id, CASE WHEN total <= 2000 THEN total ELSE ceil((total / greatest(1, ceil(total / 2000)) + 2000) / 2) END AS target FROM tot),
r AS (SELECT doc_id, page, n, 0 AS grp, n::DOUBLE AS size, false AS began FROM z WHERE page = 1
  UNION ALL SELECT z.doc_id, z.page, z.n, r.grp + (r.size + z.n > tg.target)::INT, CASE WHEN r.size + z.n > tg.target THEN r.n + z.n ELSE r.size + z.n END, r.size + z.n > tg.target FROM r JOIN tg USING (doc_id) JOIN z ON z.doc_id = r.doc_id AND z.page = r.page + 1),
e AS (SELECT doc_id, page, grp FROM r UNION SELECT doc_id, page - 1, grp FROM r WHERE began)
SELECT doc_id, page, string_agg(grp::VARCHAR, ',' ORDER BY grp) AS groups FROM e GROUP BY ALL""",
)
def tc_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages packed into groups of up to 2000 words, each with the last page of the group before."""
    out = toc.page_groups(chunk_pages(spark, d).select("doc_id", "page", "text"), token_count(F.col("text")), 2000)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join(F.col("group").cast("array<string>"), ",").alias("groups"))


@query(
    "tc_offsets",
    PAGES_SQL
    + """, j AS (SELECT it.doc_id, p.page - it.printed AS gap, count(*) AS n, min(it.ord) AS o FROM it JOIN pg p ON p.doc_id = it.doc_id AND p.title = it.title GROUP BY ALL)
SELECT doc_id, gap AS "offset" FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o, gap) = 1""",
)
def tc_offsets(spark: SparkSession, d: str) -> DataFrame:
    pages = materialise(chunk_pages(spark, d))
    placed = pages.select("doc_id", "title", F.col("page").alias("physical_index"))
    return toc.page_offset(_items(pages), placed).select("doc_id", F.col("offset").cast("long").alias("offset"))


VERIFIED_SQL = (
    PAGES_SQL
    + f""", pl AS (SELECT it.*, printed + 2 AS pi FROM it), v AS (SELECT a.doc_id, a.ord, a.pi, coalesce(length({HEADING_KEY_SQL('a.title')}) >= 2 AND contains({KEY_SQL('p.text')}, {HEADING_KEY_SQL('a.title')}), false) AS ok FROM pl a LEFT JOIN pg p ON p.doc_id = a.doc_id AND p.page = a.pi)"""
)


@query("tc_verified", VERIFIED_SQL + " SELECT doc_id, ord, pi AS physical_index, ok FROM v")
def tc_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each title stands on the page that its printed page and an offset of two give."""
    pages = materialise(chunk_pages(spark, d))
    out = toc.verified(_items(pages).withColumn("physical_index", F.col("page") + 2), pages.select("doc_id", "page", "text"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("physical_index").cast("long").alias("physical_index"), "ok")


@query(
    "tc_accuracy",
    VERIFIED_SQL + ", n AS (SELECT doc_id, max(page) AS n FROM pg GROUP BY doc_id) SELECT doc_id, round(CASE WHEN max(pi) < max(n) / 2 THEN 0.0 ELSE avg(ok::INT) END, 9) AS accuracy FROM v JOIN n USING (doc_id) GROUP BY doc_id",
)
def tc_accuracy(spark: SparkSession, d: str) -> DataFrame:
    pages = materialise(chunk_pages(spark, d))
    checked = toc.verified(_items(pages).withColumn("physical_index", F.col("page") + 2), pages.select("doc_id", "page", "text"))
    return toc.accuracy(checked, pages).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "tc_filled",
    PAGES_SQL
    + f""", h AS (SELECT doc_id, ord, title, CASE WHEN ord % 3 = 0 THEN NULL ELSE ord END AS pi FROM it),
b AS (SELECT *, coalesce(last_value(pi IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS a, first_value(pi IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM h),
f AS (SELECT b.doc_id, b.ord, min(p.page) AS got FROM b JOIN pg p ON p.doc_id = b.doc_id AND p.page BETWEEN b.a AND b.z WHERE b.pi IS NULL AND length({HEADING_KEY_SQL('b.title')}) >= 2 AND contains({KEY_SQL('p.text')}, {HEADING_KEY_SQL('b.title')}) GROUP BY ALL)
SELECT doc_id, ord, coalesce(pi, got) AS physical_index FROM b LEFT JOIN f USING (doc_id, ord)""",
)
def tc_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every third item's page is sought between those of its neighbours."""
    pages = materialise(chunk_pages(spark, d))
    items = _items(pages).withColumn("physical_index", F.when(F.col("ord") % 3 != 0, F.col("ord")))
    out = toc.fill_between(items, pages.select("doc_id", "page", "text"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("physical_index").cast("long").alias("physical_index"))


@query(
    "tc_by_title",
    PAGES_SQL
    + f""", ok AS (SELECT it.doc_id, it.ord, p.page FROM it JOIN pg p USING (doc_id) WHERE length({HEADING_KEY_SQL('it.title')}) >= 2 AND contains({KEY_SQL('p.text')}, {HEADING_KEY_SQL('it.title')})),
s AS (SELECT it.doc_id, it.ord, coalesce(list(ok.page ORDER BY ok.page) FILTER (ok.page IS NOT NULL), []) AS seen FROM it LEFT JOIN ok USING (doc_id, ord) GROUP BY ALL),
r AS (SELECT doc_id, ord, list_filter(seen, lambda p: p >= 1)[1] AS hit, coalesce(list_filter(seen, lambda p: p >= 1)[1], 1) AS last FROM s WHERE ord = 1
  UNION ALL SELECT s.doc_id, s.ord, list_min(list_filter(s.seen, lambda p: p >= r.last)), coalesce(list_min(list_filter(s.seen, lambda p: p >= r.last)), r.last) FROM r JOIN s ON s.doc_id = r.doc_id AND s.ord = r.ord + 1)
SELECT doc_id, ord, hit AS physical_index FROM r""",
)
def tc_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles without printed pages, placed in order on the first page that has them."""
    pages = materialise(chunk_pages(spark, d))
    out = toc.placed_by_title(_items(pages), pages.select("doc_id", "page", "text"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("physical_index").cast("long").alias("physical_index"))


@query(
    "tc_starts",
    PAGES_SQL + f" SELECT doc_id, page AS ord, CASE WHEN coalesce(length({KEY_SQL('title')}) >= 2 AND starts_with(left({KEY_SQL('text')}, 100), {KEY_SQL('title')}), false) THEN 'yes' ELSE 'no' END AS appear_start FROM pg",
)
def tc_starts(spark: SparkSession, d: str) -> DataFrame:
    pages = materialise(chunk_pages(spark, d))
    items = _items(pages).withColumn("physical_index", F.col("ord"))
    return toc.starts_page(items, pages.select("doc_id", "page", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), "appear_start")


@query(
    "tc_large",
    PAGES_SQL
    + f""", n AS (SELECT doc_id, (page - 1) // 12 AS part, min(page) AS a, max(page) AS b, sum({WORDS_SQL.format('text')}) AS tokens, count(*) AS pages FROM pg GROUP BY ALL)
SELECT doc_id, part::VARCHAR AS node_id, tokens::BIGINT AS tokens FROM n WHERE pages > 10 AND tokens >= 2000""",
)
def tc_large(spark: SparkSession, d: str) -> DataFrame:
    """Twelve pages each as a node: those of more than ten pages and 2000 words or more."""
    pages = materialise(chunk_pages(spark, d).select("doc_id", "page", "text"))
    nodes = pages.groupBy("doc_id", F.expr("(page - 1) div 12").cast("string").alias("node_id")).agg(F.min("page").alias("start_index"), F.max("page").alias("end_index"))
    return toc.oversized(nodes, pages, token_count(F.col("text")), 10, 2000).select("doc_id", "node_id", "tokens")


@query("tc_index")
def tc_index(spark: SparkSession, d: str) -> DataFrame:
    """The whole ladder from pages to a section tree, large nodes divided."""
    pages = chunk_pages(spark, d).select("doc_id", "page", "text")
    return toc.build_index(pages, tokens=token_count(F.col("text")), most_tokens=2000)


# ----------------------------------------------------------------------------- headings of Markdown
def _levels(pages: DataFrame) -> DataFrame:
    """Headings of documents: the level is the number of parts of the dotted code, 1 to 6."""
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.size(F.split(F.coalesce("structure", F.lit("1")), r"\."))))
    return pages.select("doc_id", F.col("page").alias("ord"), level.alias("level"), "title", "text")


LEVEL_SQL = PAGES_SQL + f", hd AS (SELECT doc_id, page AS ord, least(6, greatest(1, len(string_split(coalesce(structure, '1'), '.')))) AS level, {WORDS_SQL.format('text')} AS n FROM pg)"


@query("tc_heading_parents", LEVEL_SQL + " SELECT h.doc_id, h.ord, max(p.ord) AS parent_ord FROM hd h LEFT JOIN hd p ON p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level GROUP BY ALL")
def tc_heading_parents(spark: SparkSession, d: str) -> DataFrame:
    out = trees.heading_parents(_levels(chunk_pages(spark, d)))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("parent_ord").cast("long").alias("parent_ord"))


@query(
    "tc_subtree_tokens",
    LEVEL_SQL
    + """, e AS (SELECT h.doc_id, h.ord, min(p.ord) AS stop FROM hd h LEFT JOIN hd p ON p.doc_id = h.doc_id AND p.ord > h.ord AND p.level <= h.level GROUP BY ALL)
SELECT e.doc_id, e.ord, sum(p.n)::BIGINT AS subtree_tokens FROM e JOIN hd p ON p.doc_id = e.doc_id AND p.ord >= e.ord AND (e.stop IS NULL OR p.ord < e.stop) GROUP BY ALL""",
)
def tc_subtree_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = trees.subtree_tokens(materialise(_levels(chunk_pages(spark, d))), token_count(F.col("text")))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "subtree_tokens")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each document written as Markdown."""
    heads = _levels(chunk_pages(spark, d))
    line = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.coalesce("title", F.lit("untitled")), F.lit("\n"), F.regexp_replace("text", r"(?m)^#", " #"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n")
    return heads.groupBy("doc_id").agg(whole.alias("text"))


@query(
    "tc_markdown",
    LEVEL_SQL
    + r""", ln AS (SELECT doc_id, page AS ord, coalesce(title, 'untitled') AS title, 2 + len(regexp_extract_all(text, '\n')) AS lines FROM pg),
ps AS (SELECT *, 1 + coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_num FROM ln),
up AS (SELECT h.doc_id, h.ord, h.level, max(p.ord) AS parent FROM hd h LEFT JOIN hd p ON p.doc_id = h.doc_id AND p.ord < h.ord AND p.level < h.level GROUP BY ALL)
SELECT doc_id, lpad((ord - 1)::VARCHAR, 4, '0') AS node_id, lpad((parent - 1)::VARCHAR, 4, '0') AS parent_id, trim(title) AS title, line_num::INT AS line_num, level::INT AS level FROM ps JOIN up USING (doc_id, ord)""",
)
def tc_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each document written as Markdown and read back as a tree."""
    return toc.build_markdown_index(_markdown(spark, d)).select("doc_id", "node_id", "parent_id", "title", "line_num", "level")


@query("tc_thinned")
def tc_thinned(spark: SparkSession, d: str) -> DataFrame:
    """The same, headings under fifty words taken together."""
    return toc.build_markdown_index(_markdown(spark, d), 50).drop("text")


# ------------------------------------------------------------------------------- trees over the chunks
CODED_SQL = f"""WITH RECURSIVE {CURRENT_SQL}, lf AS (SELECT doc_name AS doc_id, chunk_id AS node_id, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) AS ord, structure, title, start_phrase, start_index, end_index, is_duplicate_chunk FROM cur),
pa AS (SELECT *, CASE WHEN (ord - 1) % 20 > 0 THEN ord - (ord - 1) % 20 - 1 + ((ord - 1) % 20 + 2) // 3 END AS parent_ord FROM lf),
nd AS (SELECT pa.* EXCLUDE (parent_ord), p.node_id AS parent_id FROM pa LEFT JOIN lf p ON p.doc_id = pa.doc_id AND p.ord = pa.parent_ord),
pt AS (SELECT *, 1 AS depth, [node_id] AS path FROM nd WHERE parent_id IS NULL UNION ALL SELECT nd.*, pt.depth + 1, list_append(pt.path, nd.node_id) FROM pt JOIN nd ON nd.doc_id = pt.doc_id AND nd.parent_id = pt.node_id)"""


def chunk_trees(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document as trees: twenty in order make a tree, in which the first is the root and each has up to
    three children."""
    w = Window.partitionBy("doc_name").orderBy("chunk_id")
    rows = materialise(current_chunks(spark, d).select(F.col("doc_name").alias("doc_id"), F.col("chunk_id").alias("node_id"), F.row_number().over(w).alias("ord"), "structure", "title", "start_phrase", "start_index", "end_index", "is_duplicate_chunk", "chunk_id"))
    parent = F.when((F.col("ord") - 1) % 20 > 0, F.expr("ord - (ord - 1) % 20 - 1 + ((ord - 1) % 20 + 2) div 3"))
    up = rows.select("doc_id", F.col("ord").alias("parent_ord"), F.col("node_id").alias("parent_id"))
    return materialise(rows.withColumn("parent_ord", parent).join(up, ["doc_id", "parent_ord"], "left").drop("parent_ord"))


@query("tr_paths", CODED_SQL + " SELECT doc_id, node_id, depth, array_to_string(path, '>') AS path, node_id IN (SELECT parent_id FROM nd WHERE parent_id IS NOT NULL) AS has_children FROM pt")
def tr_paths(spark: SparkSession, d: str) -> DataFrame:
    out = trees.with_children_flag(trees.with_paths(chunk_trees(spark, d)))
    return out.select("doc_id", "node_id", "depth", F.array_join("path", ">").alias("path"), "has_children")


LEVELS_SQL = CODED_SQL + ", lv AS (SELECT doc_id, depth, count(*) AS width FROM pt GROUP BY ALL)"


@query("tr_levels", LEVELS_SQL + " SELECT doc_id, depth, width, " + ", ".join(f"least({m}, width) / width AS retained_{m}" for m in (5, 7, 10)) + " FROM lv")
def tr_levels(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_levels(chunk_trees(spark, d))


@query(
    "tr_shapes",
    LEVELS_SQL
    + """, lo AS (SELECT doc_id, count(*) AS leaves FROM nd WHERE node_id NOT IN (SELECT parent_id FROM nd WHERE parent_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, sum(width)::BIGINT AS nodes, max(depth) AS max_depth, max(width) AS max_width, """
    + ", ".join(f"round(avg(least({m}, width) / width), 9) AS retained_{m}" for m in (5, 7, 10))
    + ", max(leaves) AS leaves FROM lv LEFT JOIN lo USING (doc_id) GROUP BY doc_id",
)
def tr_shapes(spark: SparkSession, d: str) -> DataFrame:
    out = trees.tree_statistics(chunk_trees(spark, d))
    return out.withColumns({f"retained_{m}": F.round(f"retained_{m}", 9) for m in (5, 7, 10)})


@query(
    "tr_chunks_below",
    CODED_SQL
    + """, lo AS (SELECT doc_id, unnest(path) AS a, node_id, ord FROM pt WHERE node_id NOT IN (SELECT parent_id FROM nd WHERE parent_id IS NOT NULL))
SELECT doc_id, a AS node_id, count(*) AS chunks, md5(string_agg(node_id, ',' ORDER BY ord, node_id)) AS ids, count(*) FILTER (ord % 4 <> 0) AS unseen FROM lo GROUP BY ALL""",
)
def tr_chunks_below(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the leaves under each node; every fourth chunk of a document counts as seen."""
    nodes = chunk_trees(spark, d)
    out = trees.descendant_chunks(nodes, nodes.where("ord % 4 = 0").select("chunk_id"))
    return out.select("doc_id", "node_id", F.size("chunks").cast("long").alias("chunks"), F.md5(F.array_join("chunks", ",")).alias("ids"), "unseen")


@query("tr_numbered", CODED_SQL + ", nm AS (SELECT *, lpad((ord - 1)::VARCHAR, 4, '0') AS new FROM nd) SELECT n.doc_id, n.ord, n.new AS node_id, p.new AS parent_id FROM nm n LEFT JOIN nm p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id")
def tr_numbered(spark: SparkSession, d: str) -> DataFrame:
    return trees.numbered(chunk_trees(spark, d)).select("doc_id", F.col("ord").cast("long").alias("ord"), "node_id", "parent_id")


@query("tr_inherited", CODED_SQL + ", an AS (SELECT doc_id, unnest(path) AS a, node_id FROM pt) SELECT an.doc_id, an.node_id, bool_or(coalesce(n.is_duplicate_chunk, false)) AS inherited FROM an JOIN nd n ON n.doc_id = an.doc_id AND n.node_id = an.a GROUP BY ALL")
def tr_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node or one above it is marked as a copy."""
    return trees.inherit_flag(trees.with_paths(chunk_trees(spark, d)), F.col("is_duplicate_chunk"))


@query("tr_outline", CODED_SQL + " SELECT doc_id, ord, repeat('  ', depth - 1) || left(coalesce(title, ''), 40) AS line FROM pt")
def tr_outline(spark: SparkSession, d: str) -> DataFrame:
    return trees.outline(trees.with_paths(chunk_trees(spark, d))).select("doc_id", F.col("ord").cast("long").alias("ord"), "line")


@query(
    "tr_joined",
    CODED_SQL
    + """ SELECT doc_id, node_id AS local_id, doc_id || '_' || node_id AS node_id, coalesce(doc_id || '_' || parent_id, doc_id) AS parent_id, title, 'section' AS node_type, ord + 1 AS ord FROM nd
UNION ALL SELECT DISTINCT doc_id, NULL, doc_id, 'collection', replace(doc_id, '_', ' '), 'document_node', 0 FROM nd UNION ALL SELECT NULL, NULL, 'collection', NULL, 'collection', 'collection_root', 0""",
)
def tr_joined(spark: SparkSession, d: str) -> DataFrame:
    """One tree over all documents."""
    return trees.collection(chunk_trees(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query(
    "tr_page_texts",
    CODED_SQL
    + """, pg AS (SELECT doc_name AS doc_id, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) AS page, coalesce(text, '') AS text FROM cur)
SELECT nd.doc_id, node_id, md5(string_agg(pg.text, chr(10) ORDER BY page)) AS text, count(*) AS pages FROM nd JOIN pg ON pg.doc_id = nd.doc_id AND pg.page BETWEEN nd.start_index AND nd.end_index GROUP BY ALL""",
)
def tr_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each node's span, in order (as a hash), and how many there are."""
    nodes, pages = chunk_trees(spark, d), materialise(chunk_pages(spark, d).select("doc_id", "page", "text"))
    count = nodes.where("start_index <= end_index").select("doc_id", "node_id", F.explode(F.sequence("start_index", "end_index")).alias("page")).join(pages.select("doc_id", "page"), ["doc_id", "page"]).groupBy("doc_id", "node_id").agg(F.count("*").alias("pages"))
    return trees.node_text(nodes, pages).withColumn("text", F.md5("text")).join(count, ["doc_id", "node_id"])


@query(
    "te_children_order",
    CODED_SQL
    + """, mv AS (SELECT doc_id, node_id, parent_id, ord, CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 7 = 0 THEN start_index - 9 ELSE start_index END AS start_index, CASE WHEN ord % 13 = 0 THEN end_index - 5 ELSE end_index END AS end_index FROM nd),
g AS (SELECT *, start_index IS NOT NULL AND end_index IS NOT NULL AS good FROM mv),
p AS (SELECT *, last_value(CASE WHEN good THEN start_index END IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN good THEN end_index END IGNORE NULLS) OVER w AS pe FROM g WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, node_id, 'missing_index' AS issue FROM p WHERE NOT good UNION ALL SELECT doc_id, node_id, 'start_after_end' FROM p WHERE good AND start_index > end_index
UNION ALL SELECT doc_id, node_id, 'start_index_goes_backwards' FROM p WHERE good AND start_index < ps UNION ALL SELECT doc_id, node_id, 'start_before_previous_end' FROM p WHERE good AND start_index < pe""",
)
def te_children_order(spark: SparkSession, d: str) -> DataFrame:
    """Order issues along the children of each node, some of whose places are moved or taken away."""
    start = F.when(F.col("ord") % 11 != 0, F.when(F.col("ord") % 7 == 0, F.col("start_index") - 9).otherwise(F.col("start_index")))
    moved = chunk_trees(spark, d).withColumns({"start_index": start, "end_index": F.when(F.col("ord") % 13 == 0, F.col("end_index") - 5).otherwise(F.col("end_index"))})
    return trees.sibling_issues(moved).select("doc_id", "node_id", "issue")


@query(
    "te_intro_leaves",
    CODED_SQL
    + """, k AS (SELECT doc_id, parent_id AS node_id, start_index AS stop, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord) AS r FROM nd WHERE parent_id IS NOT NULL)
SELECT doc_id, n.node_id || '_intro' AS node_id, n.node_id AS parent_id, 'Introduction to ' || n.title AS title, n.start_index, k.stop AS end_index FROM nd n JOIN k USING (doc_id, node_id) WHERE k.r = 1 AND n.start_index IS NOT NULL AND k.stop IS NOT NULL""",
)
def te_intro_leaves(spark: SparkSession, d: str) -> DataFrame:
    out = trees.with_intro_leaves(chunk_trees(spark, d).withColumn("is_intro_node", F.lit(False)))
    return out.where("is_intro_node").select("doc_id", "node_id", "parent_id", "title", "start_index", "end_index")


@query(
    "te_without",
    CODED_SQL + " SELECT doc_id, node_id FROM nd WHERE NOT coalesce(is_duplicate_chunk, false)",
)
def te_without(spark: SparkSession, d: str) -> DataFrame:
    nodes = chunk_trees(spark, d)
    return trees.without(nodes, nodes.where("is_duplicate_chunk").select("doc_id", "node_id")).select("doc_id", "node_id")


@query(
    "te_merged",
    CODED_SQL
    + """, f AS (SELECT *, first_value(node_id) OVER w AS keep, first_value(title IGNORE NULLS) OVER w AS t, first_value(start_index IGNORE NULLS) OVER w AS s FROM nd WHERE structure IS NOT NULL WINDOW w AS (PARTITION BY doc_id, parent_id, structure ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT doc_id, node_id, parent_id, t AS title, s AS start_index FROM f WHERE node_id = keep UNION ALL SELECT doc_id, node_id, parent_id, title, start_index FROM nd WHERE structure IS NULL)
SELECT k.doc_id, k.node_id, coalesce(f.keep, k.parent_id) AS parent_id, k.title, k.start_index FROM k LEFT JOIN f ON f.doc_id = k.doc_id AND f.node_id = k.parent_id AND f.keep <> f.node_id""",
)
def te_merged(spark: SparkSession, d: str) -> DataFrame:
    """Siblings with one code as one node."""
    return trees.merge_coded_siblings(chunk_trees(spark, d), ["title", "start_index"]).select("doc_id", "node_id", "parent_id", "title", "start_index")


@query("te_lifted")
def te_lifted(spark: SparkSession, d: str) -> DataFrame:
    return trees.lift_wrappers(chunk_trees(spark, d)).select("doc_id", "node_id", "parent_id")


@query(
    "te_corrected",
    CODED_SQL
    + """, gone AS (SELECT doc_id, node_id FROM nd WHERE parent_id IS NULL AND ord % 40 = 21), out_ AS (SELECT DISTINCT pt.doc_id, pt.node_id FROM pt JOIN gone g ON g.doc_id = pt.doc_id AND list_contains(pt.path, g.node_id))
SELECT nd.doc_id, nd.node_id, nd.parent_id, CASE WHEN nd.parent_id IS NULL AND ord % 40 = 1 THEN 1 ELSE start_index END AS start_index FROM nd ANTI JOIN out_ USING (doc_id, node_id)""",
)
def te_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Every second tree removed, the roots of the others given page 1."""
    nodes = chunk_trees(spark, d).select("doc_id", "node_id", "parent_id", "ord", "title", F.col("start_index").cast("double").alias("start_index"), F.col("end_index").cast("double").alias("end_index"))
    tops = nodes.where("parent_id IS NULL")
    ops = tops.select("doc_id", F.col("ord").alias("op_no"), F.when(F.col("ord") % 40 == 21, "remove").otherwise("update_indexes").alias("action"), "node_id", F.lit(None).cast("string").alias("target_parent_id"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("reference_id"), F.lit(1.0).alias("start_index"), F.lit(None).cast("double").alias("end_index"))
    return trees.apply_corrections(nodes, ops).select("doc_id", "node_id", "parent_id", F.col("start_index").cast("int").alias("start_index"))


# ------------------------------------------------------------------------------------------- sections
@query("cx_audit", PAGES_SQL + f" SELECT chunk_id FROM pg WHERE length({HEADING_KEY_SQL('title')}) > 0 AND NOT contains({KEY_SQL('left(text, 250)')}, {HEADING_KEY_SQL('title')})")
def cx_audit(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose title isn't among their first 250 characters."""
    return sections.start_audit(chunk_pages(spark, d)).select("chunk_id")


@query(
    "cx_intro_words",
    PAGES_SQL
    + rf""", l AS (SELECT chunk_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: {KEY_SQL('x')} <> {KEY_SQL('title')} AND NOT regexp_matches(x, '^\s*(?:[Pp]age\s+)?[\d\s.|–-]*$')) AS ls FROM pg WHERE title IS NOT NULL)
SELECT chunk_id, {WORDS_SQL.format("array_to_string(ls, ' ')")} >= 6 AS has_text FROM l""",
)
def cx_intro_words(spark: SparkSession, d: str) -> DataFrame:
    """Whether six words are left of a text without headings, page numbers and empty lines."""
    return chunk_pages(spark, d).where("title IS NOT NULL").select("chunk_id", sections.has_intro_text(F.col("text"), F.array("title")).alias("has_text"))


@query(
    "cx_parts",
    PAGES_SQL
    + f""" SELECT chunk_id, {WORDS_SQL.format('text')} AS words, true AS within FROM pg WHERE {WORDS_SQL.format('text')} > 300""",
)
def cx_parts(spark: SparkSession, d: str) -> DataFrame:
    """Texts over 300 words in parts: the words of all parts together, and whether none is over the limit."""
    rows = chunk_pages(spark, d).select("chunk_id", "text").where(token_count(F.col("text")) > 300)
    parts = rows.select("chunk_id", F.explode(sections.packed_paragraphs(F.col("text"), 300)).alias("p")).select("chunk_id", token_count(F.col("p")).alias("n"))
    return parts.groupBy("chunk_id").agg(F.sum("n").alias("words"), (F.max("n") <= 300).alias("within"))


@query("cx_chunks")
def cx_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages to tree to chunks, for every document."""
    pages = materialise(chunk_pages(spark, d).select("doc_id", "page", "text"))
    return sections.build_chunks(materialise(toc.build_index(pages)), pages).drop("text")


@query("cx_intros")
def cx_intros(spark: SparkSession, d: str) -> DataFrame:
    """What stands between each section's start and its first child's."""
    nodes, pages = chunk_trees(spark, d), materialise(chunk_pages(spark, d).select("doc_id", "page", "text"))
    placed = nodes.withColumn("start_index", F.col("ord").cast("int"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    first = placed.where("parent_id IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r = 1")
    return sections.intro_texts(placed, first, pages)


@query("cx_keys", PAGES_SQL + f" SELECT chunk_id, {KEY_SQL('title')} AS title_key, {HEADING_KEY_SQL('title')} AS heading_key, length({KEY_SQL('text')}) AS text_key_length FROM pg")
def cx_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunk_pages(spark, d).select("chunk_id", text.match_key(F.col("title")).alias("title_key"), text.heading_key(F.col("title")).alias("heading_key"), F.length(text.match_key(F.col("text"))).cast("long").alias("text_key_length"))
