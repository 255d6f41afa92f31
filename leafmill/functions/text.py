"""Scalar functions on text columns, all of them plain SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
#: Words that the lexical index leaves out: the public English list, contractions and their fragments included.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
#: Terms whose presence in title, heading or the text's beginning marks back matter.
APPENDIX_TERMS = ["appendix", "annex", "glossary", "assurance report", "limited assurance", "independent auditor", "table of contents", "contents", "index"]
#: Numbers as written: an amount with its brackets, sign, currency and percent sign.
NUMBER = r"\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?"
#: (part of a document's name, kind of filing), the first that applies.
FILING_TYPES = [("_10k", "10-K"), ("_10q", "10-Q"), ("_8k", "8-K"), ("earnings", "Earnings Report")]
# -----------------------------------------------------------------------------


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def match_key(text: Column) -> Column:
    """Lower-cased, ligatures opened, everything but a-z and 0-9 dropped."""
    return F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), "[^a-z0-9]", "")


def heading_key(text: Column) -> Column:
    """Match key after leading numbers are dropped."""
    return match_key(F.regexp_replace(text, r"^\s*\d+\s*", ""))


def word_key(text: Column) -> Column:
    """Lower-cased words of a-z and 0-9, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def clean_doc_id(name: Column) -> Column:
    """Base name without extension and artefact suffix, runs of other characters as ``_``."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.(?:pdf|json|jsonl|md|csv)$", "")
    base = F.regexp_replace(base, r"(?:_structure_new|_structure|_chunks)$", "")
    return F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def clean_title(name: Column) -> Column:
    """A document id as a title: blanks for underscores."""
    return F.trim(F.regexp_replace(clean_doc_id(name), "_+", " "))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased, ASCII punctuation deleted (``a-b`` becomes ``ab``), split at white space, no stop words;
    repeats stay."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ASCII_PUNCTUATION, ""), r"\s+", " "))
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.split(plain, " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def yes_no(value: Column) -> Column:
    """``Present`` / ``No TOC`` for the usual ways of writing yes and no; null is empty, other values stay, trimmed and
    lower-cased."""
    v = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(v.isin("yes", "y", "true", "1", "present"), "Present").when(v.isin("no", "n", "false", "0", "absent"), "No TOC").when(v == "nan", "").otherwise(v)


def filing_type(doc_name: Column) -> Column:
    """Kind of filing by the document's name; ``Other`` where no part tells it."""
    return F.coalesce(category(F.coalesce(doc_name, F.lit("")), FILING_TYPES), F.lit("Other"))


def category(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose text occurs in the value, letter case aside."""
    out = None
    low = F.lower(value)
    for part, label in rules:
        out = F.when(low.contains(part), label) if out is None else out.when(low.contains(part), label)
    return out.otherwise(F.lit(default))


def top_m(field: Column, file_name: Column) -> Column:
    """The field, else the number after ``_top_m_`` in a file name."""
    return F.coalesce(field.try_cast("int"), F.nullif(F.regexp_extract(file_name, r"_top_m_(\d+)", 1), F.lit("")).try_cast("int"))


def numbers(text: Column) -> Column:
    """Numbers as written, with brackets and signs, without ``$`` and ``,``; repeats stay."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, "[$,]", ""))


def multiset_coverage(need: Column, have: Column) -> Column:
    """Share of an array's values, with repeats, that another array holds; 1 if nothing is needed."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(F.transform(F.array_distinct(need), lambda x: F.least(times(need, x), times(have, x))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(need) > 0, shared / F.size(need)).otherwise(1.0)


def evidence_lines(text: Column) -> Column:
    """Match keys of the lines that have five characters or more."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), match_key), lambda k: F.length(k) >= 5)


def held_share(lines: Column, key: Column) -> Column:
    """Share of line keys, weighted by length, that a match key contains; 0 without lines."""
    total = F.aggregate(lines, F.lit(0), lambda n, k: n + F.length(k))
    held = F.aggregate(lines, F.lit(0), lambda n, k: n + F.when(F.contains(key, k), F.length(k)).otherwise(0))
    return F.when(total > 0, held / total).otherwise(0.0)


def line_coverage(evidence: Column, chunk: Column) -> Column:
    """Share of the evidence's lines, weighted by length, that the chunk contains; 0 without lines."""
    return held_share(evidence_lines(evidence), match_key(F.coalesce(chunk, F.lit(""))))


def physical_index(value: Column) -> Column:
    """Number in ``<physical_index_N>``, or of a plain number; null otherwise."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"physical_index_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^\s*(\d+)\s*$", 1), F.lit(""))).try_cast("int")


def fenced_json(reply: Column) -> Column:
    """JSON text inside a reply: fences off, ``None`` as ``null``, white space squeezed, trailing commas dropped."""
    body = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), reply)
    return F.regexp_replace(F.trim(F.regexp_replace(F.replace(body, F.lit("None"), F.lit("null")), r"\s+", " ")), r",\s*([\]}])", "$1")


def parse_pages(pages: Column) -> Column:
    """``5-7,12`` as a sorted array of distinct page numbers; null if a part isn't one or runs backwards."""
    parts = F.transform(F.split(F.regexp_replace(pages, r"\s", ""), ","), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")), F.regexp_extract(p, r"^(\d+)", 1)).try_cast("int").alias("b"), p.rlike(r"^\d+(?:-\d+)?$").alias("ok")))
    good = F.forall(parts, lambda p: p["ok"] & F.coalesce(p["a"] <= p["b"], F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["a"], p["b"]))))))


def is_intro(title: Column, chunk_id: Column, node_id: Column, flag: Column) -> Column:
    """Marked as introduction, or an id with ``intro`` in it, or a title with ``introduction`` as a later word."""
    holds = lambda c, part: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part))
    return F.coalesce(flag, F.lit(False)) | holds(chunk_id, "intro") | holds(node_id, "intro") | holds(title, " introduction")


def is_appendix(title: Column, heading: Column, text: Column) -> Column:
    """A back-matter term anywhere in the words of title, heading and the first 500 characters of the text."""
    key = lambda c: word_key(F.coalesce(c, F.lit("")))
    return F.concat_ws(" ", key(title), key(heading), key(F.left(text, F.lit(500)))).rlike("|".join(APPENDIX_TERMS))


def filled_lines(text: Column) -> Column:
    """Lines without outer blanks, empty ones left out."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def table_ratio(text: Column) -> Column:
    """Of the first 80 lines that aren't blank: shares with a digit, with a gap of three blanks, with a percent sign."""
    lines = F.slice(filled_lines(text), 1, 80)
    share = lambda pattern: F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.size(lines)).otherwise(0.0)
    return F.struct(share(r"\d").alias("numeric"), share(r"\s{3,}").alias("wide"), share("%").alias("percent"))


def named_table(title: Column, heading: Column) -> Column:
    """``table`` or ``template`` as a word of title or heading."""
    found = F.array(F.lit("table"), F.lit("template"))
    return F.arrays_overlap(F.split(F.concat_ws(" ", word_key(F.coalesce(title, F.lit(""))), word_key(F.coalesce(heading, F.lit("")))), " "), found)


def is_table_like(title: Column, heading: Column, text: Column) -> Column:
    """Named a table or template, or mostly lines with digits, and wide gaps or percent signs in many."""
    r = table_ratio(text)
    return named_table(title, heading) | (r["numeric"] > 0.65) & ((r["wide"] > 0.25) | (r["percent"] > 0.20))


def table_score(text: Column) -> Column:
    """Share of the lines that aren't blank with a sign of a table: a header of single letters, four dashes or more that
    stand alone, eight digits, three percent signs, a wide gap beside two digits or a percent sign, or a row
    number before three digits in 25 words or fewer; 0 without lines."""

    def sign(x: Column) -> Column:
        digits, percents = F.regexp_count(x, F.lit(r"\d")), F.regexp_count(x, F.lit("%"))
        header = x.rlike(r"(?i)^(?:[a-z]{1,2}\s+){5,}[a-z]{1,2}$")
        dashes = F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}_])-(?![\p{L}\p{N}_])")) >= 4
        gap = x.rlike(r"\S\s{3,}\S") & ((digits >= 2) | (percents >= 1))
        row = x.rlike(r"^\d{1,3}\s") & (digits >= 3) & (F.regexp_count(x, F.lit(r"\S+")) <= 25)
        return header | dashes | (digits >= 8) | (percents >= 3) | gap | row

    lines = filled_lines(text)
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, sign)) / F.size(lines)).otherwise(0.0)


def is_large_table(title: Column, heading: Column, text: Column, tokens: Column) -> Column:
    """Named a table, or long with many table lines: over 1500 tokens and a score over .18, over 3000 and .12."""
    score = table_score(text)
    return named_table(title, heading) | F.coalesce((tokens > 1500) & (score > 0.18) | (tokens > 3000) & (score > 0.12), F.lit(False))


def distinct_in_order(values: Column) -> Column:
    """Distinct entries of an array in order of first appearance, without nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def is_nearly_blank(text: Column, least: int = 30) -> Column:
    """Fewer than ``least`` characters besides digits, blanks and dashes."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\d\s.\-–—]", ""))) < least


def context_text(chunks: Column, most: int | None = None) -> Column:
    """``[Retrieved chunk i]`` blocks of an array of texts; blank texts are left out, ranks stay."""
    blocks = F.filter(F.transform(chunks, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit("[Retrieved chunk "), (i + 1).cast("string"), F.lit("]\n"), F.trim(x)))), lambda x: x.isNotNull())
    whole = F.array_join(blocks, "\n\n")
    return whole if most is None else F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("\n[Context truncated]"))).otherwise(whole)


def joined_text(*parts: Column) -> Column:
    """Parts that aren't blank, one to a line: the text that stands for a node or chunk."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def run_time(text: Column) -> Column:
    """A timestamp in any of the usual notations, else null."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd_HHmmss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"]
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def query_id(given: Column, doc: Column, gold: Column, query: Column) -> Column:
    """The data set's own id, else document, gold chunk and query, else a hash of the query."""
    built = F.concat_ws("__", F.nullif(doc, F.lit("")), F.nullif(gold, F.lit("")), F.nullif(query, F.lit("")))
    return first_nonempty(given, F.when(F.coalesce(gold, F.lit("")) != "", built), F.left(F.sha1(query), F.lit(16)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
