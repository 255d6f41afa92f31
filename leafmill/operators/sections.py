"""From section spans and pages to chunks: where each section starts, its text, its size, its duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import heading_key, match_key
from leafmill.functions.words import token_count
from leafmill.operators import trees
from leafmill.session import materialise

# ---------------------------------------------------------------- fixed values
#: Score of a line that is the title, begins with it, holds it; of a title glued to other text.
EXACT, PREFIX, INSIDE, GLUED = 100, 75, 20, 35
#: What a line loses for more than 8 words after the title, for a long rest, for its length, for a sentence's end.
MANY_WORDS, LONG_REST, LONG_LINE, SENTENCE_END = 50, 50, 40, 15
#: Title before its phrase, within the window: 90 less a twentieth of the distance, 20 at least; beyond it 50 less.
#: After it, within 250 characters: 30 less a twentieth, 5 at least; beyond them 40 less.
BEFORE_PHRASE, AFTER_PHRASE = 1500, 250
NEAR_BEFORE, FADE_BEFORE, FAR_BEFORE, NEAR_AFTER, FADE_AFTER, FAR_AFTER = 90, 70, 50, 30, 25, 40
LEAST_HEADING, LEAST_TITLE = 75, 45
# -----------------------------------------------------------------------------

_NUMBERING = re.compile(r"^\s*\d+(?:\.\d+)*\.?\s*")
_WORD = re.compile(r"[A-Za-z0-9]+")


def keyed(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a text, lower-cased, and the place of each in it."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in {"ﬁ": "fi", "ﬂ": "fl"}.get(c, c.lower()):
            if x.isalnum():
                out.append(x)
                at.append(i)
    return "".join(out), at


def _key(text: str) -> str:
    return "".join(_WORD.findall(text.lower().replace("ﬁ", "fi").replace("ﬂ", "fl")))


def _held_as_words(line: str, title: str) -> bool:
    """Whether the words of the title follow each other in the line, between blanks and light punctuation; of titles of
    more than 18 words or 180 characters one key must begin the other."""
    w = _WORD.findall(title)
    if len(w) > 18 or len(title) > 180:
        a, b = _key(line), _key(title)
        return bool(a and b) and (a.startswith(b) or b.startswith(a))
    return bool(w) and re.search(r"\b" + r"\s*[-–—:./]?\s*".join(map(re.escape, w)) + r"\b", line, re.I) is not None


def line_score(line: str, title: str) -> int:
    """How much a line, its numbering aside, looks like the heading ``title``: 100 the same, 75 begins with it, 20 holds it
    as words; less for a rest that goes on, for long lines and for sentence ends; never below 0."""
    plain = _NUMBERING.sub("", line or "").strip()
    a, b = _key(plain), _key(title or "")
    if not a or not b or not _held_as_words(plain, title):
        return 0
    score = EXACT if a == b else PREFIX if a.startswith(b) else INSIDE
    if score == PREFIX:
        score -= MANY_WORDS * (len(_WORD.findall(plain[len(title) :])) > 8)
        score -= LONG_REST * (len(plain) > max(4 * len(title), len(title) + 160))
    score -= LONG_LINE * (len(plain) > max(5 * len(title), len(title) + 220))
    score -= SENTENCE_END * plain.endswith((".", ",", ";"))
    return max(0, score)


def proximity_score(text: str, at: int, title: str, phrase_at: int | None = None, window: int = BEFORE_PHRASE) -> float:
    """Score of a title at a place of a text: that of its line, or 35 if the title stands there glued to other text; more
    if its phrase follows within ``window`` characters or ends just before, less if the phrase is far."""
    end = text.find("\n", at)
    score: float = line_score(text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)], title)
    if not score:
        if not _key(title) or not _key(text[at : at + 2 * len(title) + 20]).startswith(_key(title)):
            return 0
        score = GLUED
    if phrase_at is not None:
        far = abs(phrase_at - at)
        if at <= phrase_at:
            score += NEAR_BEFORE - min(FADE_BEFORE, far / 20) if far <= window else -FAR_BEFORE
        else:
            score += NEAR_AFTER - min(FADE_AFTER, far / 20) if far <= AFTER_PHRASE else -FAR_AFTER
    return max(score, 0)


def heading_candidates(text: str, title: str) -> list[tuple[int, int]]:
    """(place, score) of one to four joined lines that look like the title."""
    lines, at = text.split("\n"), 0
    starts = []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    title = _NUMBERING.sub("", title).strip() or title
    first = _key(title)[:4]
    out = []
    for i, x in enumerate(lines):
        if not x.strip() or first and first not in _key(x):
            continue
        best = max(line_score(" ".join(lines[i : i + n]), title) for n in range(1, 5))
        if best >= LEAST_HEADING:
            out.append((starts[i] + len(x) - len(x.lstrip()), best))
    return out


def find_phrase(text: str, phrase: str | None, least: int = 8) -> int | None:
    """Place of a phrase, letters and digits only; None if too short or absent."""
    key, at = keyed(text)
    want = keyed(phrase or "")[0]
    if len(want) < least:
        return None
    i = key.find(want)
    return at[i] if i >= 0 else None


def section_start(text: str, title: str | None, phrase: str | None) -> tuple[int, int] | None:
    """(place, confidence) of a section in a page: the nearest heading up to 1500 characters before its phrase, else
    the first up to 250 after it, else the best heading, else the phrase."""
    heads = heading_candidates(text, title) if title else []
    p = find_phrase(text, phrase)
    if p is not None:
        before = [(p - a, a, s) for a, s in heads if a <= p and p - a <= BEFORE_PHRASE]
        if before:
            _, a, s = min(before)
            return a, 100 + s
        after = [(a, s) for a, s in heads if 0 < a - p <= AFTER_PHRASE]
        if after:
            return after[0][0], 50 + after[0][1]
        return p, 60
    if heads and max(s for _, s in heads) >= LEAST_TITLE:
        a, s = max(heads, key=lambda x: (x[1], -x[0]))
        return a, s
    return None


def section_starts(leaves: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, ord, page, pos, confidence``: where each leaf (``doc_id, ord, title, start_phrase, start_index``) starts:
    on its page, else the one before, else the one after; where nothing is found at the top of its page."""
    near = leaves.where("start_index IS NOT NULL").select("doc_id", "ord", "title", "start_phrase", F.posexplode(F.array("start_index", F.col("start_index") - 1, F.col("start_index") + 1)).alias("try", "page"))
    both = near.join(pages, ["doc_id", "page"]).select("doc_id", "ord", "try", "page", "title", "start_phrase", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [section_start(x or "", t, p) for x, t, p in zip(*(batch[c].to_pylist() for c in ("text", "title", "start_phrase")))]
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.string()), "ord": batch["ord"].cast(pa.int64()), "try": batch["try"].cast(pa.int32()), "page": batch["page"].cast(pa.int32()), "pos": pa.array([g and g[0] for g in got], pa.int32()), "confidence": pa.array([g and g[1] for g in got], pa.int32())})

    tried = both.mapInArrow(run, "doc_id string, ord long, try int, page int, pos int, confidence int")
    best = F.min_by(F.struct("page", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("confidence", F.lit(0)).alias("confidence")), F.when(F.col("pos").isNotNull(), F.col("try")).otherwise(F.when(F.col("try") == 0, 10).otherwise(20)))
    return tried.groupBy("doc_id", "ord").agg(best.alias("b")).select("doc_id", "ord", "b.*")


def section_texts(leaves: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, ord, start_page, end_page, text``: each leaf from its start to the next one's, across pages; starts that
    would run backwards wait for the place of the leaf before."""
    starts = section_starts(leaves, pages)
    w = Window.partitionBy("doc_id").orderBy("ord")
    placed = starts.withColumn("_at", F.max(F.struct("page", "pos")).over(w)).select("doc_id", "ord", F.col("_at.page").alias("page"), F.col("_at.pos").alias("pos"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    spans = placed.join(last, "doc_id").withColumns({"to_page": F.coalesce(F.lead("page").over(w), F.col("last")), "to_pos": F.lead("pos").over(w)})
    cut = spans.select("doc_id", "ord", F.col("page").alias("from_page"), "pos", "to_page", "to_pos", F.explode(F.sequence("page", F.greatest("page", "to_page"))).alias("page")).join(pages, ["doc_id", "page"])
    a = F.when(F.col("page") == F.col("from_page"), F.col("pos")).otherwise(0)
    b = F.when((F.col("page") == F.col("to_page")) & F.col("to_pos").isNotNull(), F.col("to_pos")).otherwise(F.length("text"))
    part = F.when(b > a, F.substr("text", a + 1, b - a)).otherwise("")
    rows = cut.select("doc_id", "ord", "page", part.alias("part")).where("part <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "\n")
    return rows.groupBy("doc_id", "ord").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.trim(whole).alias("text"))


def has_intro_text(text: Column, titles: Column, least: int = 6) -> Column:
    """Whether ``least`` words are left of an introduction once lines that are headings (array ``titles``), page
    numbers or empty are taken out."""
    keys = F.transform(titles, match_key)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~F.array_contains(keys, match_key(x)) & ~x.rlike(r"^\s*(?:[Pp]age\s+)?[\d\s.|–-]*$"))
    return token_count(F.array_join(lines, " ")) >= least


def drop_next_heading(chunks: DataFrame, tail: int = 1200, rest: int = 40, least: int = 8) -> DataFrame:
    """Texts that end with the heading of the next chunk (key of ``least`` characters or more, in the last ``tail``
    characters, with at most ``rest`` key characters after it) lose it."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = chunks.withColumn("_next", F.lead("title").over(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, nxt in zip(batch["text"].to_pylist(), batch["_next"].to_pylist()):
                want = keyed(re.sub(r"^\s*[\d.]+\s*", "", nxt or ""))[0]
                if text and len(want) >= least:
                    base = max(0, len(text) - tail)
                    key, at = keyed(text[base:])
                    i = key.rfind(want)
                    if i >= 0 and len(key) - i - len(want) <= rest:
                        text = text[: base + at[i]].rstrip()
                out.append(text)
            yield pa.record_batch({"doc_id": batch["doc_id"], "ord": batch["ord"], "text": pa.array(out, pa.string())})

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    fixed = rows.select("doc_id", "ord", "text", "_next").mapInArrow(run, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, text string")
    return chunks.drop("text").join(fixed, ["doc_id", "ord"])


def start_audit(chunks: DataFrame, within: int = 250) -> DataFrame:
    """Chunks whose title isn't among their first ``within`` characters."""
    k = heading_key(F.col("title"))
    return chunks.where((F.length(k) > 0) & ~F.contains(match_key(F.left(F.coalesce("text", F.lit("")), F.lit(within))), k))


def _packed(units: Column, separator: str, most: int) -> Column:
    """Texts packed in order into parts of up to ``most`` tokens each; a longer one is a part of its own."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit(separator), x)
        return F.when((F.size(acc) > 0) & (token_count(joined) <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(units, F.expr("CAST(array() AS array<string>)"), step)


def packed_paragraphs(text: Column, most: int) -> Column:
    """Paragraphs packed in order into parts of up to ``most`` tokens each. A longer paragraph is divided at its lines, a
    longer line at its sentences, a longer sentence between words, so that no part is over the limit."""
    filled = lambda parts: F.filter(parts, lambda x: F.trim(x) != "")
    small = lambda x: token_count(x) <= most

    def by_words(x: Column) -> Column:
        w = F.regexp_extract_all(x, F.lit(r"[^ \t\r\n]+"), F.lit(0))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w)), F.lit(most))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(most)), " "))

    def divided(x: Column, pattern: str, separator: str, deeper) -> Column:
        parts = F.flatten(F.transform(filled(F.split(x, pattern)), lambda y: F.when(small(y), F.array(y)).otherwise(deeper(y))))
        return _packed(parts, separator, most)

    by_sentences = lambda x: divided(x, r"(?<=[.!?])\s+", " ", by_words)
    by_lines = lambda x: divided(x, r"\r?\n", "\n", by_sentences)
    return divided(text, r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", "\n\n", by_lines)


def intro_texts(parents: DataFrame, children: DataFrame, pages: DataFrame, around: int = 3) -> DataFrame:
    """``doc_id, node_id, start_page, end_page, text``: what stands between a section's own start and its first child's.

    ``parents``: ``doc_id, node_id, title, start_phrase, start_index``; ``children``: the first child of each, with
    ``parent_id`` and the same fields. The section starts as ``section_start`` finds it on its page. The child's start is
    the best of its candidates up to ``around`` pages from the page it is said to start on: on that page before
    others, with its phrase found before without, by score, then the earliest. Without a candidate the introduction ends
    with the page before the child's. A start after that end gives an empty text.
    """
    kid = children.select("doc_id", F.col("parent_id").alias("node_id"), F.col("title").alias("c_title"), F.col("start_phrase").alias("c_phrase"), F.col("start_index").alias("c_page"))
    both = parents.where("start_index IS NOT NULL").select("doc_id", "node_id", "title", "start_phrase", F.col("start_index").alias("p_page")).join(kid.where("c_page IS NOT NULL"), ["doc_id", "node_id"])
    near = both.withColumn("page", F.explode(F.sequence(F.least("p_page", F.col("c_page") - around), F.greatest("p_page", F.col("c_page") + around))))
    tried = near.join(pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found, phrased, score = [], [], [], []
            for page, p_page, c_page, text, title, phrase, c_title, c_phrase in zip(*(batch[c].to_pylist() for c in ("page", "p_page", "c_page", "text", "title", "start_phrase", "c_title", "c_phrase"))):
                own = section_start(text, title, phrase) if page == p_page else None
                start.append(own[0] if own else 0 if page == p_page else None)
                best = None
                if abs(page - c_page) <= around:
                    at = find_phrase(text, c_phrase)
                    heads = {a for a, _ in heading_candidates(text, c_title)} if c_title else set()
                    ranked = [(at is not None, proximity_score(text, a, c_title, at), -a) for a in heads] + ([(True, 0.0, -at)] if at is not None else [])
                    ranked = [x for x in ranked if page > p_page or own is None or -x[2] > own[0]]
                    best = max(ranked, default=None)
                found.append(-best[2] if best else None), phrased.append(best[0] if best else None), score.append(best[1] if best else None)
            names = [c for c in batch.schema.names if c not in ("title", "start_phrase", "c_title", "c_phrase")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(start, pa.int32()), pa.array(found, pa.int32()), pa.array(phrased, pa.bool_()), pa.array(score, pa.float64())], names=[*names, "start", "found", "phrased", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in tried.schema}
    kept = [c for c in tried.columns if c not in ("title", "start_phrase", "c_title", "c_phrase")]
    scored = materialise(tried.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", start int, found int, phrased boolean, score double"))
    best = F.max_by(F.struct("page", "found"), F.struct(F.col("page") == F.col("c_page"), "phrased", "score", -F.col("page"), -F.col("found")))
    ends = scored.where("found IS NOT NULL").groupBy("doc_id", "node_id").agg(best.alias("e"))
    spans = scored.groupBy("doc_id", "node_id").agg(F.max("p_page").alias("a"), F.max("c_page").alias("c"), F.max("start").alias("at")).join(ends, ["doc_id", "node_id"], "left")
    spans = spans.select("doc_id", "node_id", "a", "at", F.coalesce("e.page", F.col("c") - 1).alias("b"), F.col("e.found").alias("to"))
    rows = scored.select("doc_id", "node_id", "page", "text").join(spans, ["doc_id", "node_id"]).where(F.col("page").between(F.col("a"), F.col("b")))
    first = F.when(F.col("page") == F.col("a"), F.col("at")).otherwise(0)
    last = F.when((F.col("page") == F.col("b")) & F.col("to").isNotNull(), F.col("to")).otherwise(F.length("text"))
    part = F.when(last > first, F.substr("text", first + 1, last - first)).otherwise("")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("t")))), lambda x: x["t"]), "\n")
    out = rows.groupBy("doc_id", "node_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.regexp_replace(whole, r"^\s+|\s+$", "").alias("text"))
    return spans.select("doc_id", "node_id", "a").join(out, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("start_page", "a").alias("start_page"), F.coalesce("end_page", "a").alias("end_page"), F.coalesce("text", F.lit("")).alias("text"))


def build_chunks(nodes: DataFrame, pages: DataFrame, most_tokens: int = 1000) -> DataFrame:
    """Tree rows and pages to chunks: ``doc_id, ord, chunk_id, node_id, parent_node_id, structure, title, text, token_count,
    start_index, end_index, is_intro_node, canonical_id, is_copy``. Introductions without text of their own are left
    out, leaves over ``most_tokens`` are divided at paragraphs, trailing headings of the next chunk go, and
    repeats point at the first."""
    tree = materialise(trees.with_intro_leaves(nodes.withColumn("is_intro_node", F.lit(False))))
    low = trees.leaves(tree)
    w = Window.partitionBy("doc_id").orderBy("ord")
    low = materialise(low.withColumn("ord", F.row_number().over(w).cast("long")).withColumn("start_phrase", F.lit(None).cast("string") if "start_phrase" not in low.columns else F.col("start_phrase")))
    texts = section_texts(low, pages)
    rows = low.join(texts, ["doc_id", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.where(~F.col("is_intro_node") | has_intro_text(F.col("text"), F.array("title")))
    rows = drop_next_heading(rows)
    parts = F.when(token_count(F.col("text")) > most_tokens, packed_paragraphs(F.col("text"), most_tokens)).otherwise(F.array("text"))
    split = rows.select("*", F.posexplode(parts).alias("_i", "_part"), F.size(parts).alias("_n"))
    node = F.when(F.col("_n") > 1, F.concat("node_id", F.lit("_"), F.lpad((F.col("_i") + 1).cast("string"), 3, "0"))).otherwise(F.col("node_id"))
    out = split.select("doc_id", F.col("ord").cast("double").alias("_o"), "_i", node.alias("node_id"), F.col("parent_id").alias("parent_node_id"), "structure", "title", "start_phrase", F.col("_part").alias("text"), F.col("start_page").alias("start_index"), F.col("end_page").alias("end_index"), "is_intro_node")
    out = out.withColumns({"chunk_id": F.concat_ws("_", "doc_id", "node_id"), "token_count": token_count(F.col("text")), "ord": F.row_number().over(Window.partitionBy("doc_id").orderBy("_o", "_i"))}).drop("_o", "_i")
    return trees.point_duplicates(out, "doc_id", ("ord",))
