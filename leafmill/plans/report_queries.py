"""Queries of results, runs, plans and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import providers, text
from leafmill.operators import answers, assistant, evaluation, retrieval, trees
from leafmill.plans.core_queries import BM25_SQL, CLEAN_ID_SQL, CURRENT_SQL, EVIDENCE_SQL, MATCH_KEY_SQL, RUN_TIME_SQL, RUNS_SQL, _bm25, current_chunks, current_evidence, latest_runs
from leafmill.plans.queries import Registry
from leafmill.session import materialise, scratch, table
from leafmill.streaming import results as streams

REGISTRY = Registry()
query = REGISTRY.query

# ------------------------------------------------------------------------------------ results of retrieval
RESULTS_SQL = (
    BM25_SQL
    + f""", ids AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM hits GROUP BY query_id),
docs AS (SELECT DISTINCT regexp_replace({CLEAN_ID_SQL.format('doc_name')}, '^_+|_+$', '', 'g') AS doc FROM chunks),
qs AS (SELECT DISTINCT query_id, bank_name, regexp_replace({CLEAN_ID_SQL.format('doc_name')}, '^_+|_+$', '', 'g') AS doc_name, ground_truth_chunk_id AS gold, query_generation_input_tokens AS input_tokens, query_generation_output_tokens AS output_tokens, query_generation_total_tokens AS total_tokens FROM queries),
top AS (SELECT query_id, ids[1] AS top1, nullif(list_position(ids, gold), 0) AS r, qs.* EXCLUDE (query_id) FROM qs LEFT JOIN ids USING (query_id)),
rd AS (SELECT top1, max_by(doc, length(doc)) AS doc FROM (SELECT DISTINCT top1 FROM top) JOIN docs ON top1 = doc OR starts_with(top1, doc || '_') GROUP BY top1),
res AS (SELECT top.*, rd.doc AS retrieved_doc, CASE WHEN r = 1 THEN 1 ELSE 0 END AS c1, CASE WHEN r IS NULL THEN 0 ELSE 1 END AS h5, coalesce(1.0 / r, 0) AS rr, CASE WHEN rd.doc = top.doc_name THEN 1 ELSE 0 END AS dc FROM top LEFT JOIN rd USING (top1))"""
)


def results(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question with the metrics of lexical retrieval, the document retrieved and its tokens."""
    doc = text.clean_doc_id(F.col("doc_name"))
    q = table(spark, d, "queries").select("query_id", "bank_name", doc.alias("doc_name"), F.col("ground_truth_chunk_id").alias("gold"), *(F.col(f"query_generation_{c}_tokens").alias(f"{c}_tokens") for c in ("input", "output", "total"))).distinct()
    docs = table(spark, d, "chunks").select(doc.alias("doc")).distinct()
    rows = q.join(evaluation.ranked_ids(_bm25(spark, d)), "query_id", "left")
    m = evaluation.retrieval_metrics(rows).withColumns({"top1_chunk_id": F.get("ids", 0), "top1_doc": F.lit(""), "run_success": F.col("ids").isNotNull()})
    named = m.withColumnsRenamed({"hit_at_k": "hit_at_5", "reciprocal_rank": "reciprocal_rank_at_5"})
    config = {"dataset": F.lit("questions"), "result_file": F.lit("bm25.jsonl"), "method": F.lit("bm25"), "model": F.lit(None).cast("string"), "variant": F.lit("standard"), "top_m": F.lit(None).cast("int")}
    return evaluation.document_correct(named, docs, "doc").withColumns(config)


@query("ev_documents", RESULTS_SQL + " SELECT query_id, retrieved_doc, dc AS document_correct_at_1 FROM res")
def ev_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of each question's top result, and whether it is the right one."""
    return results(spark, d).select("query_id", "retrieved_doc", "document_correct_at_1")


@query(
    "ag_configs",
    RESULTS_SQL
    + """ SELECT 'questions' AS dataset, 'bm25.jsonl' AS result_file, 'bm25' AS method, NULL::VARCHAR AS model, 'standard' AS variant, NULL::INT AS top_m, bank_name, count(DISTINCT query_id) AS n_queries,
round(avg(c1), 9) AS accuracy_at_1, round(avg(h5), 9) AS hit_at_5, round(avg(rr), 9) AS mrr_at_5, round(avg(dc), 9) AS document_accuracy_at_1, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens, round(avg(total_tokens), 6) AS avg_total_tokens,
sum((top1 IS NOT NULL)::INT)::BIGINT AS successful_rows, round(avg(c1) * 100, 6) AS accuracy_at_1_pct FROM res GROUP BY bank_name""",
)
def ag_configs(spark: SparkSession, d: str) -> DataFrame:
    """The report of a configuration, for each bank."""
    out = evaluation.config_aggregate(results(spark, d), extra=["bank_name"])
    r = {c: F.round(c, 9) for c in ("accuracy_at_1", "hit_at_5", "mrr_at_5", "document_accuracy_at_1")} | {c: F.round(c, 6) for c in ("avg_input_tokens", "avg_output_tokens", "avg_total_tokens", "accuracy_at_1_pct")}
    return out.withColumns(r).select(*evaluation.CONFIG, "bank_name", "n_queries", *r, "successful_rows")


@query(
    "ag_methods",
    RESULTS_SQL
    + """, two AS (SELECT 'bm25' AS method, query_id, c1, rr FROM res UNION ALL SELECT 'first', query_id, c1, c1 FROM res WHERE bank_name IS NOT NULL), n AS (SELECT query_id FROM two GROUP BY query_id HAVING count(DISTINCT method) = 2)
SELECT method, count(DISTINCT query_id) AS n_queries, round(avg(c1), 9) AS accuracy_at_1, round(avg(rr), 9) AS mrr_at_5 FROM two WHERE query_id IN (SELECT query_id FROM n) GROUP BY method""",
)
def ag_methods(spark: SparkSession, d: str) -> DataFrame:
    """Two methods over the questions that both have."""
    rows = materialise(results(spark, d).select("query_id", "bank_name", "method", "correct_at_1", "reciprocal_rank_at_5"))
    other = rows.where("bank_name IS NOT NULL").withColumns({"method": F.lit("first"), "reciprocal_rank_at_5": F.col("correct_at_1").cast("double")})
    out = evaluation.config_aggregate(evaluation.common_queries(rows.unionByName(other), "method"), ["method"])
    return out.select("method", "n_queries", F.round("accuracy_at_1", 9).alias("accuracy_at_1"), F.round("mrr_at_5", 9).alias("mrr_at_5"))


# ------------------------------------------------------------------------------------------ joins of runs
@query("jn_question_runs", f"WITH {RUNS_SQL}, q AS (SELECT DISTINCT query_id, doc_name FROM queries) SELECT q.query_id, q.doc_name, r.dataset, r.num_chunks, r.total_tokens FROM q LEFT JOIN runs r ON q.doc_name = r.pdf_name")
def jn_question_runs(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the latest runs of their documents, which name them otherwise."""
    q = table(spark, d, "queries").select("query_id", "doc_name").distinct()
    runs = latest_runs(spark, d).select("pdf_name", "dataset", "num_chunks", "total_tokens")
    return evaluation.join_named(q, runs, {"doc_name": "pdf_name"})


@query(
    "jn_run_stages",
    f"""WITH t AS (SELECT *, {RUN_TIME_SQL} AS t FROM chunk_runs), a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dataset, pdf_name ORDER BY t NULLS LAST, run_id) = 1), b AS (SELECT * FROM t WHERE num_chunks >= 20 QUALIFY row_number() OVER (PARTITION BY dataset, pdf_name ORDER BY t DESC NULLS LAST, run_id DESC) = 1)
SELECT a.dataset, a.pdf_name, a.run_id, a.total_tokens, b.run_id AS run_id_chunk, b.total_tokens AS total_tokens_chunk FROM a LEFT JOIN b ON a.dataset = b.dataset AND a.pdf_name = b.pdf_name""",
)
def jn_run_stages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first run beside its last of twenty chunks or more."""
    rows = table(spark, d, "chunk_runs").withColumn("t", text.run_time(F.col("run_timestamp")))
    first = rows.groupBy("dataset", "pdf_name").agg(F.min_by(F.struct("run_id", "total_tokens"), F.struct(F.col("t").isNull(), "t", "run_id")).alias("r")).select("dataset", "pdf_name", "r.*")
    last = rows.where("num_chunks >= 20").groupBy("dataset", "pdf_name").agg(F.max_by(F.struct("run_id", "total_tokens"), F.struct(F.col("t").isNotNull(), "t", "run_id")).alias("r")).select("dataset", "pdf_name", "r.*")
    return evaluation.join_named(first, last, {"dataset": "dataset", "pdf_name": "pdf_name"}, "_chunk")


@query(
    "jn_nullable",
    f"WITH {EVIDENCE_SQL}, c AS (SELECT company, match_type, count(*) AS n FROM ev GROUP BY ALL) SELECT ev.evidence_id, c.n FROM ev LEFT JOIN c ON ev.company IS NOT DISTINCT FROM c.company AND ev.match_type IS NOT DISTINCT FROM c.match_type",
)
def jn_nullable(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes back at their rows, by keys in which null meets null."""
    ev = materialise(current_evidence(spark, d).select("evidence_id", "company", "match_type"))
    n = ev.groupBy("company", "match_type").agg(F.count("*").alias("n"))
    return evaluation.join_on_nullable(ev, n, ["company", "match_type"]).select("evidence_id", "n")


# -------------------------------------------------------------------------------------- pages and plans
@query(
    "ag_pages",
    f"WITH {CURRENT_SQL}, p AS (SELECT bank_name, doc_name, max(CASE WHEN end_index > 0 THEN end_index END) AS page_count FROM cur GROUP BY ALL) SELECT bank_name, count(*) AS documents, count(page_count) AS counted, count(*) FILTER (page_count IS NULL) AS failed, coalesce(sum(page_count), 0)::BIGINT AS pages, round(avg(page_count), 9) AS mean_pages FROM p GROUP BY bank_name",
)
def ag_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = current_chunks(spark, d).groupBy("bank_name", "doc_name").agg(F.max(F.when(F.col("end_index") > 0, F.col("end_index"))).alias("page_count"))
    return evaluation.page_totals(docs, ["bank_name"]).withColumn("mean_pages", F.round("mean_pages", 9))


@query(
    "ev_funnel",
    f"""WITH {CURRENT_SQL}, f AS (SELECT *, coalesce(generate_queries, false) AS sel, NOT coalesce(is_duplicate_chunk, false) AS own FROM cur)
SELECT doc_name, count(*) AS chunks, count(*) FILTER (own) AS own, count(*) FILTER (own AND (sel OR coalesce(skip_query_reason, '') IN ('', 'not_selected'))) AS eligible, count(*) FILTER (sel) AS selected, coalesce(sum(CASE WHEN sel THEN coalesce(num_queries, 0) END), 0)::BIGINT AS questions FROM f GROUP BY doc_name""",
)
def ev_funnel(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.funnel(current_chunks(spark, d), ["doc_name"])


@query(
    "sc_filings",
    """SELECT doc_name, CASE WHEN contains(upper(doc_name), '_10K') THEN '10-K' WHEN contains(upper(doc_name), '_10Q') THEN '10-Q' WHEN contains(upper(doc_name), '_8K') THEN '8-K' WHEN contains(upper(doc_name), 'EARNINGS') THEN 'Earnings Report' ELSE 'Other' END AS filing_type FROM (SELECT DISTINCT doc_name FROM chunks)""",
)
def sc_filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("doc_name").distinct().select("doc_name", text.filing_type(F.col("doc_name")).alias("filing_type"))


@query(
    "sc_yes_no",
    f"""WITH {EVIDENCE_SQL}, v AS (SELECT evidence_id, lower(trim(coalesce(CASE WHEN evidence_id % 3 = 0 THEN kept::VARCHAR WHEN evidence_id % 3 = 1 THEN ' Present ' ELSE match_type END, ''))) AS v FROM ev)
SELECT evidence_id, CASE WHEN v IN ('yes', 'y', 'true', '1', 'present') THEN 'Present' WHEN v IN ('no', 'n', 'false', '0', 'absent') THEN 'No TOC' ELSE v END AS label FROM v""",
)
def sc_yes_no(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("evidence_id") % 3 == 0, F.col("kept").cast("string")).when(F.col("evidence_id") % 3 == 1, " Present ").otherwise(F.col("match_type"))
    return current_evidence(spark, d).select("evidence_id", text.yes_no(v).alias("label"))


@query(
    "sc_pages",
    f"WITH {CURRENT_SQL} SELECT chunk_id, start_index AS from_tag, end_index AS from_number, NULL::INT AS from_words FROM cur",
)
def sc_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers out of tags, out of plain numbers, and out of neither."""
    c = current_chunks(spark, d)
    tag = F.concat(F.lit("see <physical_index_"), F.col("start_index").cast("string"), F.lit(">"))
    return c.select("chunk_id", text.physical_index(tag).alias("from_tag"), text.physical_index(F.concat(F.lit(" "), F.col("end_index").cast("string"))).alias("from_number"), text.physical_index(F.concat(F.lit("p. x"), F.col("title"))).alias("from_words"))


@query(
    "sc_contexts",
    f"WITH {CURRENT_SQL} SELECT doc_name, md5(string_agg('[Retrieved chunk ' || r || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY r)) AS context FROM (SELECT doc_name, text, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) AS r FROM cur) WHERE r <= 5 AND trim(coalesce(text, '')) <> '' GROUP BY doc_name",
)
def sc_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context block of each document's first five chunks (as a hash)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_name").orderBy("chunk_id")
    rows = current_chunks(spark, d).select("doc_name", "text", F.row_number().over(w).alias("r")).where("r <= 5")
    lists = rows.groupBy("doc_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("t"))
    return lists.select("doc_name", F.md5(text.context_text(F.col("t"))).alias("context")).where(F.col("context") != F.md5(F.lit("")))


@query(
    "so_runs",
    """SELECT 'chunks' AS of, doc_name, count(*) AS n FROM chunks GROUP BY ALL UNION ALL SELECT 'queries', doc_name, count(*) FROM queries GROUP BY ALL""",
)
def so_runs(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one form put together."""
    n = lambda name: table(spark, d, name).groupBy("doc_name").agg(F.count("*").alias("n")).select(F.lit(name).alias("of"), "doc_name", "n")
    return n("chunks").unionByName(n("queries"))


@query(
    "so_distinct_order",
    f"""WITH {EVIDENCE_SQL}, l AS (SELECT evidence_id, list_filter([matched_chunk_id, source_chunk_id, doc_name, matched_chunk_id, matched_doc_name], lambda x: x IS NOT NULL AND x <> '') AS v FROM ev)
SELECT evidence_id, array_to_string(list_transform(list_filter(list_zip(v, range(1, len(v) + 1)), lambda p: list_position(v, p[1]) = p[2]), lambda p: p[1]), '|') AS names FROM l""",
)
def so_distinct_order(spark: SparkSession, d: str) -> DataFrame:
    """The names of an evidence, each once, in order."""
    names = F.array("matched_chunk_id", "source_chunk_id", "doc_name", "matched_chunk_id", "matched_doc_name")
    return current_evidence(spark, d).select("evidence_id", F.array_join(text.distinct_in_order(names), "|").alias("names"))


@query("so_first_delivery", "SELECT evidence_id, matched_at FROM evidence_report QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY matched_at DESC NULLS FIRST) = 1")
def so_first_delivery(spark: SparkSession, d: str) -> DataFrame:
    return current_evidence(spark, d).select("evidence_id", "matched_at")


@query("tk_first_questions", "SELECT query_id, place FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS place FROM (SELECT DISTINCT query_id FROM queries)) WHERE place < 100")
def tk_first_questions(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred questions by id (a limit asked for: a trial run)."""
    return evaluation.first_rows(table(spark, d, "queries").select("query_id").distinct(), "query_id", 100)


@query(
    "tk_issue_preview",
    f"WITH {CURRENT_SQL} SELECT doc_name, chunk_id FROM cur WHERE start_index > end_index OR start_index IS NULL OR end_index IS NULL OR title IS NULL OR structure IS NULL ORDER BY doc_name, chunk_id LIMIT 10",
)
def tk_issue_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first ten chunks with an incomplete place or name."""
    bad = current_chunks(spark, d).where("start_index > end_index OR start_index IS NULL OR end_index IS NULL OR title IS NULL OR structure IS NULL").select("doc_name", "chunk_id")
    return evaluation.preview(bad, 10, "doc_name", "chunk_id")


# -------------------------------------------------------------------------- questions, answers, judgement
REQUESTS_SQL = f"""WITH {CURRENT_SQL}, req AS (SELECT 'row-' || chunk_id AS custom_id, coalesce(nullif(retrieval_chunk_id, ''), nullif(canonical_chunk_id, ''), chunk_id) AS chunk_id, chunk_id AS source_chunk_id, coalesce(nullif(doc_name, ''), nullif(bank_name, ''), 'unknown') AS doc_name, coalesce(nullif(bank_name, ''), nullif(doc_name, ''), 'unknown') AS bank_name, coalesce(title, '') AS title, num_queries FROM cur WHERE coalesce(generate_queries, false) AND coalesce(num_queries, 0) > 0)"""


@query("ev_requests", REQUESTS_SQL + " SELECT custom_id, chunk_id, source_chunk_id, doc_name, bank_name, title, num_queries FROM req")
def ev_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for questions on the chunks that are to get some."""
    return answers.question_requests(current_chunks(spark, d)).select("custom_id", "chunk_id", "source_chunk_id", "doc_name", "bank_name", "title", "num_queries")


@query(
    "ev_replies",
    REQUESTS_SQL
    + " SELECT chunk_id || '_q' || i AS query_id, doc_name, 'What about ' || title || ' (' || i || ')?' AS query, title AS answer, chunk_id AS ground_truth_chunk_id, source_chunk_id, (num_queries * 10)::INT AS query_generation_total_tokens FROM (SELECT *, unnest(range(1, num_queries + 1)) AS i FROM req WHERE length(source_chunk_id) % 5 <> 0)",
)
def ev_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with as many questions as were asked for, flattened; every fifth reply is cut off and has none."""
    req = materialise(answers.question_requests(current_chunks(spark, d)))
    each = F.transform(F.sequence(F.lit(1), "num_queries"), lambda i: F.struct(F.concat(F.lit("What about "), "title", F.lit(" ("), i.cast("string"), F.lit(")?")).alias("question"), F.col("title").alias("answer")))
    whole = F.to_json(F.struct(each.alias("questions")))
    content = F.when(F.length("source_chunk_id") % 5 == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole)
    replies = req.select("custom_id", content.alias("content"), F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"), (F.col("num_queries") * 10).cast("int").alias("total_tokens"))
    return answers.questions_of(replies, req).select("query_id", "doc_name", "query", "answer", "ground_truth_chunk_id", "source_chunk_id", "query_generation_total_tokens")


@query(
    "ev_judged",
    f"""WITH {EVIDENCE_SQL}, a AS (SELECT evidence_id, query, answer AS expected, CASE WHEN evidence_id % 4 = 0 THEN ' INSUFFICIENT information to answer the question. ' WHEN evidence_id % 4 = 1 THEN 'The answer is ' || answer WHEN evidence_id % 4 = 2 THEN evidence_text ELSE matched_chunk_title END AS given FROM ev),
k AS (SELECT *, {MATCH_KEY_SQL.format('expected')} AS x, {MATCH_KEY_SQL.format('given')} AS y FROM a WHERE trim(coalesce(query, '')) <> '' AND trim(coalesce(expected, '')) <> '' AND trim(coalesce(given, '')) <> '')
SELECT evidence_id::VARCHAR AS answer_id, CASE WHEN lower(trim(given)) = 'insufficient information to answer the question.' THEN 'no_answer' WHEN x = y OR (length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x))) THEN 'correct' ELSE 'incorrect' END AS category FROM k WHERE evidence_id % 7 <> 3""",
)
def ev_judged(spark: SparkSession, d: str) -> DataFrame:
    """Answers judged by rule; every seventh was judged by an earlier run."""
    e = current_evidence(spark, d)
    part = F.col("evidence_id") % 4
    given = F.when(part == 0, " INSUFFICIENT information to answer the question. ").when(part == 1, F.concat(F.lit("The answer is "), "answer")).when(part == 2, F.col("evidence_text")).otherwise(F.col("matched_chunk_title"))
    rows = e.select(F.col("evidence_id").cast("string").alias("answer_id"), "query", F.col("answer").alias("expected"), given.alias("generated_answer"))
    done = e.where("evidence_id % 7 = 3").select(F.col("evidence_id").cast("string").alias("answer_id"), F.lit("").alias("error"))
    return answers.judged(rows, done=done).select("answer_id", "category")


@query(
    "ev_answers",
    BM25_SQL
    + r""", ct AS (SELECT chunk_id, text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS FIRST) = 1),
cx AS (SELECT query_id, string_agg('[Retrieved chunk ' || rank || ']' || chr(10) || trim(ct.text), chr(10) || chr(10) ORDER BY rank) FILTER (trim(coalesce(ct.text, '')) <> '') AS x FROM hits JOIN ct ON ct.chunk_id = hits.id GROUP BY query_id),
cut AS (SELECT query_id, CASE WHEN length(x) > 4000 THEN left(x, 4000) || chr(10) || '[Context truncated]' ELSE x END AS x FROM cx)
SELECT 'bm25__' || query_id || '__top5' AS answer_id, md5(CASE WHEN coalesce(x, '') = '' THEN 'Insufficient information to answer the question.' ELSE regexp_replace(coalesce(query, '') || chr(10) || chr(10) || x, '^\s+|\s+$', '', 'g') END) AS answer, NULL::VARCHAR AS error
FROM (SELECT DISTINCT query_id, query FROM queries) LEFT JOIN cut USING (query_id)""",
)
def ev_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the offline provider from the texts of the chunks that lexical retrieval found."""
    texts = current_chunks(spark, d).select(F.col("chunk_id").alias("id"), "text")
    hits = _bm25(spark, d).join(texts, "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("top5_chunks"))
    q = table(spark, d, "queries").select("query_id", "query").distinct()
    rows = q.join(hits, "query_id", "left").withColumn("config", F.lit("bm25"))
    out = answers.generated_answers(answers.answer_requests(rows, 5, 4000))
    return out.select("answer_id", F.md5("generated_answer").alias("answer"), "error")


@query(
    "tr_descriptions",
    f"WITH {CURRENT_SQL} SELECT doc_name AS doc_id, chunk_id AS node_id, title, summary FROM cur",
)
def tr_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """What descriptions of documents are made from: title, id and summary of each section."""
    nodes = current_chunks(spark, d).select(F.col("doc_name").alias("doc_id"), F.col("chunk_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), "title", "summary", "text")
    return trees.clean_outline(nodes).select("doc_id", "node_id", "title", "summary")


# ------------------------------------------------------------------------------- documents for questions
@query(
    "rt_documents",
    r"""WITH q AS (SELECT DISTINCT query_id, query FROM queries), d AS (SELECT doc_name AS doc_id, concat_ws(' ', doc_name, doc_description) AS t FROM trees QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY built_at DESC NULLS FIRST, tree_id DESC) = 1),
a AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{N}]+'))) AS w FROM q), b AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(t, '')), '[\p{L}\p{N}]+'))) AS w FROM d),
n AS (SELECT query_id, doc_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank, doc_id, shared FROM n QUALIFY rank <= 5""",
)
def rt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the words that their names and descriptions share with a question."""
    latest = evaluation.keep_latest(table(spark, d, "trees"), ["doc_name"], F.col("built_at"), F.col("tree_id").desc_nulls_last())
    docs = latest.select(F.col("doc_name").alias("doc_id"), F.concat_ws(" ", "doc_name", "doc_description").alias("description"))
    out = assistant.documents_by_description(table(spark, d, "queries").select("query_id", "query").distinct(), docs)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "rt_preferences",
    r"""WITH q AS (SELECT DISTINCT query_id, query FROM queries), w AS (SELECT query_id, list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{N}]+')) AS w FROM q)
SELECT q.query_id, concat_ws(chr(10), query, nullif(concat_ws(chr(10), CASE WHEN list_contains(w, 'credit') THEN 'Read the notes on credit risk first.' END, CASE WHEN list_contains(w, 'million') THEN 'Amounts stand in the tables.' END), '')) AS query FROM q JOIN w USING (query_id)""",
)
def rt_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the advice of the topics that they name."""
    known = spark.createDataFrame([("Credit", "Read the notes on credit risk first."), ("million", "Amounts stand in the tables."), ("unheard", None)], "topic string, advice string")
    return assistant.with_preferences(table(spark, d, "queries").select("query_id", "query").distinct(), known)


# ------------------------------------------------------------------------------- labels, replies, members
@query(
    "sc_top_m",
    r"""SELECT run_id, coalesce(CASE WHEN run_id % 4 = 0 THEN num_chunks END, TRY_CAST(nullif(regexp_extract('beam_top_m_' || run_id || '.jsonl', '_top_m_(\d+)', 1), '') AS INT)) AS top_m FROM (SELECT DISTINCT run_id, num_chunks FROM chunk_runs)""",
)
def sc_top_m(spark: SparkSession, d: str) -> DataFrame:
    """The width of a beam by its field, else by the name of its result file."""
    runs = table(spark, d, "chunk_runs").select("run_id", "num_chunks").distinct()
    name = F.concat(F.lit("beam_top_m_"), F.col("run_id").cast("string"), F.lit(".jsonl"))
    return runs.select("run_id", text.top_m(F.when(F.col("run_id") % 4 == 0, F.col("num_chunks")), name).alias("top_m"))


@query(
    "sc_fenced",
    f"WITH {CURRENT_SQL} SELECT chunk_id, start_index, end_index FROM cur",
)
def sc_fenced(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of replies with fences, ``None``, broken lines and trailing commas."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    body = F.concat(F.lit('{\n  "a": '), n("start_index"), F.lit(',\n  "b": '), n("end_index"), F.lit(",\n}"))
    reply = F.when(F.length("chunk_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(body)
    got = current_chunks(spark, d).select("chunk_id", F.from_json(text.fenced_json(reply), "a int, b int").alias("x"))
    return got.select("chunk_id", F.col("x.a").alias("start_index"), F.col("x.b").alias("end_index"))


@query(
    "sc_titles",
    f"SELECT doc_name, trim(regexp_replace(regexp_replace({CLEAN_ID_SQL.format('doc_name')}, '^_+|_+$', '', 'g'), '_+', ' ', 'g')) AS title FROM (SELECT DISTINCT doc_name FROM chunks)",
)
def sc_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("doc_name").distinct().select("doc_name", text.clean_title(F.col("doc_name")).alias("title"))


@query(
    "jn_open",
    f"WITH {EVIDENCE_SQL}, done AS (SELECT DISTINCT evidence_id FROM ev WHERE evidence_id % 5 = 0 AND kept) SELECT evidence_id FROM ev WHERE evidence_id NOT IN (SELECT evidence_id FROM done)",
)
def jn_open(spark: SparkSession, d: str) -> DataFrame:
    """Evidences without a finished result: every fifth has one, which counts where it is kept."""
    ev = current_evidence(spark, d).select("evidence_id", "kept")
    done = ev.where("evidence_id % 5 = 0").select("evidence_id", F.when(~F.coalesce("kept", F.lit(False)), "failed").alias("error"))
    return streams.still_open(ev.select("evidence_id"), done, "evidence_id")


@query(
    "so_answers",
    """SELECT financebench_id, company, evidence_id FROM evidence_report WHERE financebench_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY financebench_id, company ORDER BY coalesce(same_doc, false) DESC, matched_at DESC NULLS LAST, evidence_id DESC) = 1""",
)
def so_answers(spark: SparkSession, d: str) -> DataFrame:
    """For each question and company the latest success, else the latest."""
    rows = table(spark, d, "evidence_report").where("financebench_id IS NOT NULL")
    return evaluation.keep_best(rows, ["financebench_id", "company"], F.col("same_doc"), F.struct("matched_at", "evidence_id")).select("financebench_id", "company", "evidence_id")


@query(
    "tk_best_document",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(q.v, r.v), 9) AS score FROM v q CROSS JOIN v r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""",
)
def tk_best_document(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other row of every row whose id is divisible by 50."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = retrieval.dense_top_k(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 1, exclude_self=True)
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


@query("rt_cached")
def rt_cached(spark: SparkSession, d: str) -> DataFrame:
    """Questions' vectors through the cache, every second one known from an earlier run."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ") + 1)] for t in texts]

    path = scratch(spark, "vectors")
    q = table(spark, d, "queries").select("query_id", "query").distinct()
    providers.cached_vectors(q.where("length(query) % 2 = 0"), "query_id", "query", path, "lengths", encode)
    return providers.cached_vectors(q, "query_id", "query", path, "lengths", encode).select("query_id", F.get("vector", 0).alias("chars"))


REGISTRY.sql["rt_cached"] = "SELECT DISTINCT query_id, CASE WHEN trim(coalesce(query, '')) <> '' THEN length(query)::DOUBLE END AS chars FROM queries"
