"""Repair of text extracted from scanned pages.

1. Counts: words, neighbouring word pairs and hyphenated compounds of the whole corpus, pre-aggregated
   in each task (numbers count as ``#``).
2. Symmetric-delete index: the delete variants of every word are joined with those of the lexicon's
   words, and all that its look-alikes may stand for with these words themselves; a weighted edit distance, in
   which only look-alike confusions are cheap, scores the pairs, and the share of a word's contexts in which the
   candidate is known too (word pairs) decides.
3. Torn words: neighbouring fragments that the corpus writes as one word; words that are common by themselves
   only where the whole word fits its neighbours.
4. Running titles: lines in title case that recur beside printed page numbers, and mostly there.
5. Each text: running headers and page numbers are taken out, words cut at line ends are joined unless
   the hyphen belongs to the spelling, misread and torn words are replaced, lines become paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.memo import Memo
from leafmill.functions.words import words
from leafmill.session import materialise, spread

# ---------------------------------------------------------------- fixed values
#: Look-alikes of print and scan: (what was read, what was printed, cost).
CONFUSIONS = [
    ("1", "l", 0.2), ("1", "i", 0.3), ("0", "o", 0.2), ("5", "s", 0.3), ("8", "b", 0.4), ("9", "g", 0.4), ("6", "b", 0.4), ("|", "l", 0.2),
    ("rn", "m", 0.3), ("m", "rn", 0.3), ("ri", "n", 0.3), ("n", "ri", 0.4), ("cl", "d", 0.3), ("d", "cl", 0.4), ("vv", "w", 0.3), ("w", "vv", 0.4),
    ("ii", "u", 0.3), ("u", "ii", 0.4), ("li", "h", 0.4), ("h", "li", 0.4), ("in", "m", 0.4), ("m", "in", 0.4), ("nn", "m", 0.4), ("rri", "m", 0.4),
    ("l", "i", 0.3), ("i", "l", 0.3), ("c", "e", 0.3), ("e", "c", 0.3), ("b", "h", 0.3), ("h", "b", 0.3), ("f", "t", 0.3), ("t", "f", 0.3),
    ("u", "n", 0.4), ("n", "u", 0.4), ("o", "c", 0.4), ("c", "o", 0.4), ("o", "e", 0.4), ("e", "o", 0.4), ("a", "o", 0.4), ("o", "a", 0.4), ("s", "5", 0.4),
    ("q", "g", 0.4), ("g", "q", 0.4), ("y", "v", 0.4), ("v", "y", 0.4), ("j", "i", 0.4), ("i", "j", 0.4), ("t", "l", 0.4), ("l", "t", 0.4), ("r", "n", 0.5),
    ("ﬁ", "fi", 0.1), ("ﬂ", "fl", 0.1), ("ﬀ", "ff", 0.1), ("ﬃ", "ffi", 0.1), ("ﬄ", "ffl", 0.1), ("ﬀi", "ffi", 0.1), ("ﬀl", "ffl", 0.1),
    ("ä", "a", 0.3), ("ö", "o", 0.3), ("ü", "u", 0.3), ("é", "e", 0.3), ("è", "e", 0.3), ("í", "i", 0.3), ("ı", "i", 0.2), ("á", "a", 0.3), ("à", "a", 0.3), ("ó", "o", 0.3), ("ò", "o", 0.3), ("ñ", "n", 0.3), ("ç", "c", 0.3),
]
#: What a scan makes of the hyphen at a line's end.
HYPHENS = "-¬­‐‑=~"
#: Words before which a hyphen stands for a part named later (``short- and long-term``).
SUSPENDING = {"and", "or", "to", "nor", "und", "oder", "bis", "et", "ou", "y", "o", "e"}
#: Words with which neither a sentence nor a heading ends.
LEADING = set("a an the of in on at by for from to with without under over between among per than as and or nor but that which whose its their our this these those is are was were be been has have had will would shall may must can der die das des dem den ein eine und oder von mit für bei aus zu le la les du de et ou pour par dans sur avec el los las en con para".split())
#: Abbreviations after which a sentence goes on if a small letter or a digit follows, or whatever follows.
SHORT, TITLES = {"no", "nos", "art", "sec", "fig", "para", "nr", "inc", "ltd", "co", "corp", "vs", "approx", "cf", "e.g", "i.e", "incl", "excl", "u.s", "z.b", "bzw", "ca"}, {"mr", "mrs", "ms", "dr", "prof"}
# -----------------------------------------------------------------------------

_COST: dict[str, list[tuple[str, float]]] = {}
for _read, _printed, _c in CONFUSIONS:
    _COST.setdefault(_read, []).append((_printed, _c))


def misread_cost(read: str, printed: str, bound: float = 1.0) -> float:
    """Weighted edit distance from what was read to a printed word; look-alikes are cheap, every other
    insertion, deletion or substitution costs 1. Costs of ``bound`` and more come as infinity."""
    n, m = len(read), len(printed)
    at = 0
    while at < n and at < m and read[at] == printed[at]:
        at += 1
    start = max(0, at - 2)
    best = {(start, start): 0.0}
    done = float("inf")
    todo = [(start, start)]
    while todo:
        here = todo.pop()
        i, j = here
        c = best[here]
        if i == n and j == m:
            done = min(done, c)
            continue
        steps = [(i + 1, j + 1, c)] if i < n and j < m and read[i] == printed[j] else []
        for k in (1, 2, 3):
            for to, price in _COST.get(read[i : i + k], ()) if i + k <= n else ():
                if printed.startswith(to, j):
                    steps.append((i + k, j + len(to), c + price))
        if c + 1 < bound:
            steps += [(i + 1, j + 1, c + 1)] * (i < n and j < m) + [(i + 1, j, c + 1)] * (i < n) + [(i, j + 1, c + 1)] * (j < m)
        for a, b, price in steps:
            if price < bound and price < best.get((a, b), float("inf")) and price < done:
                best[a, b] = price
                todo.append((a, b))
    return done


def delete_variants(word: str) -> set[str]:
    """The word and what is left of it after one deletion, or two where five letters or more remain apart."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out = {word} | one
    if len(word) >= 5:
        out |= {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}
    return {w for w in out if w}


def printed_forms(read: str, bound: float = 1.0) -> set[str]:
    """Every word of letters, the same one left out, that look-alikes make of ``read`` at a cost under ``bound``
    (at most 1: no other edit fits under it then). A digit must be replaced, so that few-digit words alone have any."""
    out: set[str] = set()
    best: dict[tuple[int, str], float] = {}
    todo = [(0, "", 0.0)]
    while todo:
        i, made, c = todo.pop()
        if i == len(read):
            out.add(made)
            continue
        steps = [(i + 1, made + read[i], c)] if read[i].isalpha() else []
        for k in (1, 2, 3):
            for to, price in _COST.get(read[i : i + k], ()) if i + k <= len(read) else ():
                if c + price < bound and to.isalpha():
                    steps.append((i + k, made + to, c + price))
        for step in steps:
            if step[2] < best.get(step[:2], float("inf")):
                best[step[:2]] = step[2]
                todo.append(step)
    return out - {read}


# ---------------------------------------------------------------------- counts
class _Kind(dict):
    """Word -> word, number -> ``#``; remembers words only."""

    def __missing__(self, w: str) -> str:
        if w.isdigit():
            return "#"
        if len(self) > 500_000:
            self.clear()
        self[w] = w
        return w


_TAIL, _HEAD = re.compile(r"[A-Za-z]+$"), re.compile(r"[A-Za-z]+")


def _compounds(text: str) -> list[str]:
    parts = text.split("-")
    out = []
    for x, y in zip(parts, parts[1:]):
        if x[-1:].isalpha() and y[:1].isalpha() and (a := _TAIL.search(x[-40:])) and (b := _HEAD.match(y[:40])):
            out.append(f"{a[0]}-{b[0]}".lower())
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two, kind = Counter(), Counter(), _Kind()

    def rows() -> pa.RecordBatch:
        a, b, n = [], [], []
        for w, k in one.items():
            a.append(w), b.append(None), n.append(k)
        for (x, y), k in two.items():
            a.append(x), b.append(y), n.append(k)
        one.clear(), two.clear()
        return pa.record_batch({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64())})

    for batch in batches:
        for column in batch.columns:
            for text in column.to_pylist():
                if text:
                    w = list(map(kind.__getitem__, words(text)))
                    one.update(w)
                    two.update(zip(w, w[1:]))
                    if "-" in text:
                        one.update(_compounds(text))
        if len(two) > 400_000:
            yield rows()
    yield rows()


def corpus_counts(records: DataFrame, fields: list[str]) -> DataFrame:
    """``a, b, n``: counts of words and compounds (b null) and of neighbouring words."""
    return records.select(*fields).mapInArrow(_count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# ----------------------------------------------------------------------- model
def _variants(bound: float | None = None):
    """Delete variants and, marked ``=``, the word itself or (if ``bound`` is given) what it may stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, n = [], [], []

        def rows() -> pa.RecordBatch:
            out = pa.record_batch({"v": pa.array(v, pa.string()), "w": pa.array(w, pa.string()), "n": pa.array(n, pa.int64())})
            v.clear(), w.clear(), n.clear()
            return out

        for batch in batches:
            for word, count in zip(batch["w"].to_pylist(), batch["n"].to_pylist()):
                own = [*delete_variants(word), *("=" + x for x in ([word] if bound is None else printed_forms(word, bound)))]
                v.extend(own), w.extend([word] * len(own)), n.extend([count] * len(own))
                if len(v) > 200_000:
                    yield rows()
        yield rows()

    return run


def _score(bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, w = batch["t"].to_pylist(), batch["w"].to_pylist()
            cost = [misread_cost(x, y, bound) for x, y in zip(t, w)]
            keep = [i for i, c in enumerate(cost) if c < bound]
            ratio = batch["ratio"].to_pylist()
            yield pa.record_batch({"t": pa.array([t[i] for i in keep], pa.string()), "w": pa.array([w[i] for i in keep], pa.string()), "ratio": pa.array([ratio[i] for i in keep], pa.float64()), "cost": pa.array([cost[i] for i in keep], pa.float64())})

    return run


def fragments(counts: DataFrame, min_count: int = 5, dominance: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Neighbouring words that together are a word of the lexicon, which occurs ``dominance`` times as often,
    with both counts and the share of each one's occurrences that stand in such pairs; and every word's greatest share."""
    uni = counts.where("b IS NULL").select("a", "n")
    bi = counts.where("b IS NOT NULL AND a <> '#' AND b <> '#'")
    whole = uni.where(F.col("n") >= min_count).select(F.col("a").alias("ab"), F.col("n").alias("nab"))
    pair = bi.withColumn("ab", F.concat("a", "b")).join(whole, "ab").where((F.col("nab") >= dominance * F.col("n")) & F.col("ab").rlike(r"^\p{L}{3,}$"))
    first = pair.groupBy("a").agg(F.sum("n").alias("m")).join(uni, "a").select("a", (F.col("m") / F.col("n")).alias("fa"))
    second = pair.groupBy("b").agg(F.sum("n").alias("m")).join(uni.withColumnRenamed("a", "b"), "b").select("b", (F.col("m") / F.col("n")).alias("fb"))
    share = first.select(F.col("a").alias("w"), F.col("fa").alias("f")).union(second.select("b", "fb")).groupBy("w").agg(F.max("f").alias("f"))
    return pair.join(first, "a").join(second, "b").select("a", "b", "ab", "n", "nab", "fa", "fb"), share


def repairs(counts: DataFrame, parts: DataFrame, min_count: int = 5, bound: float = 0.9) -> DataFrame:
    """``t, w``: misread words and what they stand for.

    ``w`` occurs at least ``min_count`` times, differs from ``t`` by look-alikes only, and neither is mostly a
    fragment of other words. A word with digits or ligatures among its letters needs no more than a rarer
    spelling, or half of its contexts where it may be a number (``l5``); any other must be 10 times rarer and fit half of its contexts (known neighbour pairs of ``w``),
    or 200 times rarer and fit three tenths; words of up to three letters must be 300 times rarer.
    """
    uni = counts.where("b IS NULL AND a <> '#' AND NOT contains(a, '-') AND length(a) BETWEEN 2 AND 40").select(F.col("a").alias("w"), "n")
    uni = materialise(uni.join(parts.where("f >= 0.5"), "w", "left_anti"))
    index = uni.where((F.col("n") >= min_count) & F.col("w").rlike(r"^\p{L}{2,}$")).mapInArrow(_variants(), "v string, w string, n long")
    query = uni.mapInArrow(_variants(bound), "v string, w string, n long").toDF("v", "t", "nt")
    marked = F.col("t").rlike(r"[0-9\x{FB00}-\x{FB06}]")
    near = query.join(index, "v").where((F.col("n") >= F.when(marked, 2.0).otherwise(10.0) * F.col("nt")) & (F.col("t") != F.col("w"))).select("t", "w", (F.col("n") / F.col("nt")).alias("ratio")).distinct()
    scored = near.mapInArrow(_score(bound), "t string, w string, ratio double, cost double")
    bi = counts.where("b IS NOT NULL")
    known = bi.select(F.col("a").alias("ka"), F.col("b").alias("kb")).withColumn("known", F.lit(1))
    before = scored.join(bi, F.col("t") == F.col("b")).select("t", "w", F.col("a").alias("ka"), F.col("w").alias("kb"), "n")
    after = scored.join(bi, F.col("t") == F.col("a")).select("t", "w", F.col("w").alias("ka"), F.col("b").alias("kb"), "n")
    seen = before.union(after).join(known, ["ka", "kb"], "left").groupBy("t", "w").agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("share"))
    cand = scored.join(seen, ["t", "w"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    rare, short = F.col("ratio") >= 200, F.length("t") <= 3
    number = F.col("t").rlike("^[0-9lio]+$") | (2 * F.length(F.regexp_replace("t", "[^0-9]", "")) > F.length("t"))
    ok = cand.where(marked & (~number | (F.col("share") >= 0.5)) | F.when(short, (F.col("ratio") >= 300) & (F.col("share") >= 0.3)).otherwise((F.col("share") >= 0.5) | rare & (F.col("share") >= 0.3)))
    best = F.max_by("w", F.struct(F.round(F.col("share") - F.col("cost"), 6), "w"))
    return ok.groupBy("t").agg(best.alias("w"))


_SEPARATED = re.compile(r"\s*[|·]\s*")
_YEARS = re.compile(r"(?: \d{4})+$")


def _title_lines(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Lines (their first two parts between bars) that look like titles: in title case, capitals or spaced letters,
    two words or more and no sentence; as words without a last year, with whether a printed page number (of a form
    that no table has, of any form) stands on the line above or below."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    for i, line in enumerate(lines):
        if not (line[:1].isupper() and len(line) <= 250 and _heading(line.partition("|")[0])):
            continue
        beside = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        any_ = any(_ONLY_NUMBER.fullmatch(x) for x in beside)
        styled = any_ and any(_ONLY_STYLED.fullmatch(x) for x in beside)
        closed = close_letters(line)
        parts = _SEPARATED.split(closed if closed != line else re.sub(r"[ \t]{2,}", "|", line))
        for part in parts[:2]:
            if _heading(part) and part[-1:] not in (".", ";", ":", ","):
                title = _YEARS.sub("", " ".join(words(part)))
                if title.count(" ") and any(w.isalpha() and len(w) > 2 for w in title.split(" ")):
                    yield title, styled, any_


def running_titles(records: DataFrame, field: str, places: int = 3, share: float = 0.5) -> DataFrame:
    """``title, n``: titles that stand beside printed page numbers in ``places`` places or more, and in at least
    ``share`` of all lines that they begin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text in batch[field].to_pylist():
                for title, styled, any_ in _title_lines(text) if text and "\n" in text else ():
                    n = seen.setdefault(title, [0, 0, 0])
                    n[0] += 1
                    n[1] += styled
                    n[2] += any_
            cols = list(zip(*seen.values())) or [(), (), ()]
            yield pa.record_batch([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["title", "n", "styled", "beside"])

    per = records.select(field).mapInArrow(count, "title string, n long, styled long, beside long").groupBy("title").agg(*(F.sum(c).alias(c) for c in ("n", "styled", "beside")))
    return per.where((F.col("styled") >= places) & (F.col("beside") >= share * F.col("n"))).select("title", "n")


#: So that running titles are sent to every executor before anything else.
_FIRST = 1 << 40


def page_model(records: DataFrame, fields: list[str], min_count: int = 5) -> DataFrame:
    """``key, value, n``: everything that the repair of a text looks up, and how often the corpus has it. Keys:

    ``v:`` word: its count if it is known, what it stands for if it is misread, and its marks, between bars. Marks:
    ``n`` / ``m`` numbers are usual after / before it, ``f`` it is mostly a fragment, ``a`` / ``b`` it is the first /
    second word of an ``x:`` pair, ``T`` it begins a running title. ``c:`` compound and its count; ``t:`` torn pair, one
    word of which is mostly a fragment; ``x:`` pair of words that is 50 times rarer than the whole, and torn where ``k:`` holds the whole with the word before and
    the one after; ``h:`` running title. Every word with ``min_count`` occurrences has a row.
    """
    counts = materialise(corpus_counts(records, fields))
    pairs, parts = fragments(counts, min_count)
    pairs = materialise(pairs)
    torn, loose = pairs.where("fa >= 0.5 OR fb >= 0.5"), pairs.where("fa < 0.5 AND fb < 0.5 AND nab >= 50 * n")
    wholes, twice = loose.select("ab").distinct(), counts.where("b IS NOT NULL AND n >= 2")
    beside = [twice.join(wholes, F.col(side) == F.col("ab")).select("a", "b", "n") for side in ("a", "b")]
    parts = materialise(parts)
    fixes = materialise(repairs(counts, parts, min_count))
    titles = materialise(running_titles(records, fields[0]))
    uni = counts.where("b IS NULL AND a <> '#'")
    single = uni.where(~F.contains("a", F.lit("-"))).select(F.col("a").alias("w"), "n")
    known = single.where(F.col("n") >= min_count).join(fixes.select(F.col("t").alias("w")), "w", "left_anti").join(parts.where("f >= 0.5"), "w", "left_anti")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    mark = lambda df, word, flag: df.select(F.col(word).alias("w"), zero.alias("n"), none.alias("fix"), F.lit(flag).alias("mark"))
    facts = [
        known.select("w", "n", none, F.lit("")),
        fixes.select(F.col("t"), zero, F.col("w"), F.lit("")),
        mark(counts.where("b = '#' AND a <> '#'").join(uni.select("a", F.col("n").alias("all")), "a").where("n >= 0.02 * all"), "a", "n"),
        mark(counts.where("a = '#' AND b <> '#'").join(uni.select(F.col("a").alias("b"), F.col("n").alias("all")), "b").where("n >= 0.02 * all"), "b", "m"),
        mark(torn.where("fa >= 0.5"), "a", "f"),
        mark(torn.where("fb >= 0.5"), "b", "f"),
        mark(loose, "a", "a"),
        mark(loose, "b", "b"),
        mark(titles.select(F.substring_index("title", " ", 1).alias("w")), "w", "T"),
    ]
    word = facts[0].toDF("w", "n", "fix", "mark")
    for f in facts[1:]:
        word = word.union(f.toDF("w", "n", "fix", "mark"))
    word = word.groupBy("w").agg(F.max("n").alias("known"), F.max("fix").alias("fix"), F.array_join(F.array_sort(F.collect_set("mark")), "").alias("marks")).join(single, "w", "left")
    pair = lambda df, kind: df.select(F.concat(F.lit(kind), "a", F.lit(" "), "b"), F.lit(""), "n")
    rows = [
        word.select(F.concat(F.lit("v:"), "w"), F.concat_ws("|", F.col("known").cast("string"), F.coalesce("fix", F.lit("")), "marks"), F.coalesce("n", F.lit(0))),
        uni.where(F.contains("a", F.lit("-"))).select(F.concat(F.lit("c:"), "a"), F.col("n").cast("string"), "n"),
        pair(torn, "t:"),
        pair(loose, "x:"),
        pair(beside[0].union(beside[1]).groupBy("a", "b").agg(F.max("n").alias("n")), "k:"),
        titles.select(F.concat(F.lit("h:"), "title"), F.lit(""), F.lit(_FIRST).cast("long")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return materialise(out.toDF("key", "value", "n"))


# ------------------------------------------------------------------- one text
_NUMBER = r"(?:\[ ?\d{1,4} ?\]|[A-Z]-\d{1,4}|[-–—] ?\d{1,4} ?[-–—]|[Pp]age \d{1,4}(?: of \d{1,4})?|\d{1,4}|[ivxlc]{1,8})"
_STYLED = r"(?:\[ ?\d{1,4} ?\]|[A-Z]-\d{1,4}|[-–—] ?\d{1,4} ?[-–—]|[Pp]age \d{1,4}(?: of \d{1,4})?|[ivxlc]{1,8})"
_BEFORE, _AFTER = re.compile(rf"(?:(?<=\s)|^){_NUMBER}[ \t]*(?:\n[ \t]*\n?[ \t]*|[ \t]+)?$"), re.compile(rf"[ \t]*(?:\n[ \t]*\n?[ \t]*|[ \t]+){_NUMBER}(?=\s|$)")
_STYLED_LINE = re.compile(rf"^[ \t]*{_STYLED}[ \t]*$", re.M)
_BARE_LINE = re.compile(r"^[ \t]*\d{1,4}[ \t]*$", re.M)
_PAGE_OF = re.compile(r"(?:^|(?<=\s))(?:[Pp]age \d{1,4} of \d{1,4}|\[\d{1,4}\]|F-\d{1,4}|- \d{1,4} -)(?=\s|$)")
_BROKEN = re.compile(rf"([A-Za-z][\w'’]*)([{re.escape(HYPHENS)}])[ \t]*(?:\n\s*|[ \t]+)([A-Za-z]\w*)")
_BREAK = re.compile(rf"[{re.escape(HYPHENS)}](?<=[A-Za-z].)[ \t\n](?=\s*[A-Za-z])")
_INLINE = re.compile(r"(?<![\w-])([A-Za-z]{2,}) +(?=(\d{1,3}) +([A-Za-z]{2,})(?![\w-]))")
_LIGATURE = re.compile("[ﬀ-ﬆ]")
_NUMERIC = re.compile(r"(?<![A-Za-z0-9-])(?=[\dlIO|.,]*\d)(?=[\d.,]*[lIO|])[\dlIO|]+(?:[.,][\dlIO|]+)*(?![A-Za-z0-9-])")
_DIGITS = str.maketrans("lI|O", "1110")
_PLAIN = re.compile(r"\S")


_ONLY_NUMBER, _ONLY_STYLED = re.compile(_NUMBER), re.compile(_STYLED.replace("|[ivxlc]{1,8}", ""))
_APART = re.compile(r"(?<!\S)[^\W_](?: [^\W_]| [-·|&] ?(?=[^\W_] ))+(?: {2,8}\S(?: \S)+)*(?!\S)")


def close_letters(text: str) -> str:
    """Letters that stand apart (``R I S K  R E P O R T``) closed to words."""
    return _APART.sub(lambda m: " ".join(w.replace(" ", "") for w in re.split(r" {2,}", m[0])), text)


def _plain_form(title: str) -> str:
    return r"(?:\s*[-–/&.,]\s*|\s+)".join(map(re.escape, title.split()))


def _spaced_form(title: str) -> str:
    return r"[ ]{1,6}(?:[-–/&.,][ ]{1,6})?".join(r"[ ]".join(re.escape(c) for c in w) for w in title.split())


def _name_form(name: str) -> re.Pattern:
    """A company's name in plain or spaced letters."""
    spaced = rf"{_spaced_form(name)}(?:[ ]{{2,6}}{_spaced_form('and Subsidiaries')})?"
    return re.compile(rf"(?<!\w)(?:{spaced}|{_plain_form(name)}(?:\s+and\s+Subsidiaries)?)(?!\w)", re.I)


def _title_form(titles: tuple[str, ...]) -> re.Pattern:
    """Any of the titles in plain or spaced letters, with a year."""
    plain, spaced = "|".join(map(_plain_form, titles)), "|".join(map(_spaced_form, titles))
    return re.compile(rf"(?<!\w)(?:(?:{spaced})(?:[ ]{{2,6}}\d[ ]\d[ ]\d[ ]\d)?|(?:{plain})(?:\s+\d{{4}})?)(?!\w)", re.I)


def _name_line(name: str) -> re.Pattern:
    """A line of the company's name and further words in title case."""
    return re.compile(rf"^[ \t]*{_plain_form(name)}(?:[ \t]+(?:[A-Z][\w&-]*|\d{{4}}|on|of|and|the|for|to|in))+[ \t]*$", re.M)


_NAMES, _TITLES, _NAMED = Memo(_name_form), Memo(_title_form), Memo(_name_line)
_BETWEEN, _REST = re.compile(r"[ \t]{0,8}(?:[·|][ \t]{0,8})?"), re.compile(r"[ \t]*\|[^\n]{1,120}$", re.M)


def running_lines(text: str, name: str, titles: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the company's name and the titles stand, alone or together, with what follows them after a bar."""
    at = [m.span() for m in _NAMES[name].finditer(text) if not m[0].islower()] if name else []
    if titles:
        at += [m.span() for m in _TITLES[titles].finditer(text) if not m[0].islower()]
    out: list[tuple[int, int]] = []
    for a, b in sorted(at):
        if out and (a <= out[-1][1] or _BETWEEN.fullmatch(text, out[-1][1], a)):
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return [(a, m.end() if (m := _REST.match(text, b)) else b) for a, b in out]
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_LONGEST_TITLE = 12  # words of a running title that are looked for


def _company(doc_name: str) -> str:
    """The words of a document name before its year."""
    out = []
    for w in re.split(r"[_ ]+", doc_name or ""):
        if re.fullmatch(r"\d{4}", w):
            break
        out.append(w)
    return " ".join(out)


_COMPANY = Memo(_company)


def _prose(line: str) -> bool:
    """Running text or a whole table row, as against a table cell that stands on a line of its own."""
    s = line.strip()
    return len(s) >= 45 or s[-1:] in ".;:," and len(s.split()) > 1 or "   " in s


_NOTHING = (0, "", "")


def _entry(value: str) -> tuple[int, str, str]:
    known, fix, marks = value.split("|")
    return int(known), fix, marks


def _mixed(word: str) -> bool:
    return not (word.isalpha() or word.isdigit())


class Repair:
    """Repairs texts by a model (mapping of keys to values; see ``page_model``).

    A model that isn't ``complete`` holds the most frequent rows; a text's other rows come by ``answer``, and what
    its repair asked for in vain stands in ``missing`` afterwards.
    """

    def __init__(self, model: dict[str, str], complete: bool = True) -> None:
        self.complete = complete
        self.rest = {k: v for k, v in model.items() if k[:2] != "v:"}
        self.words = {k[2:]: _entry(v) for k, v in model.items() if k[:2] == "v:"}
        self.vocabulary = frozenset(self.words)
        self.wrong = frozenset(w for w, e in self.words.items() if e[1])
        self.marked = {x: frozenset(w for w, e in self.words.items() if x in e[2]) for x in "fabT"}
        self.loose: dict[str, set[str]] = {}
        for a, b in (k[2:].split(" ") for k in self.rest if k[:2] == "x:"):
            self.loose.setdefault(a, set()).add(b)
        self.mixed = frozenset(filter(_mixed, self.words))
        self.known: tuple[str, list[str], set[str]] = ("", [], set())
        self.answer({})

    def words_of(self, text: str) -> tuple[list[str], set[str]]:
        """Words of a text in order, and as a set; those of the last text are kept."""
        if self.known[0] is not text:
            w = words(text)
            self.known = text, w, set(w)
        return self.known[1:]

    def answer(self, given: dict[str, str | None]) -> None:
        """Rows of the model for the next text; null where the model has none."""
        self.given, self.missing = given, set()

    # ---- the model
    def value(self, key: str) -> str | None:
        out = self.rest.get(key)
        if out is None and not self.complete:
            if key in self.given:
                return self.given[key]
            self.missing.add(key)
        return out

    def entry(self, word: str) -> tuple[int, str, str]:
        out = self.words.get(word)
        if out is None:
            value = None if self.complete else self.value("v:" + word)
            return _NOTHING if value is None else _entry(value)
        return out

    def count(self, word: str) -> int:
        return self.entry(word)[0]

    def fixed(self, word: str) -> str:
        """What a misread word stands for, else the word."""
        return self.entry(word)[1] or word

    def with_mark(self, mark: str, here: set[str]) -> set[str]:
        out = here & self.marked[mark]
        return out if self.complete else out | {w for w in here - self.vocabulary if mark in self.entry(w)[2]}

    # ---- page breaks
    def titles(self, text: str) -> tuple[str, ...]:
        """Running titles of the corpus that the text holds, longest first."""
        w, here = self.words_of(text)
        if sum(map(_LETTERS.__contains__, here)) >= 4 and (closed := close_letters(text)) != text:
            w, here = self.words_of(closed)
        firsts = self.with_mark("T", here)
        found = set()
        if firsts:
            for i, x in enumerate(w):
                if x in firsts:
                    for n in range(2, min(_LONGEST_TITLE, len(w) - i) + 1):
                        title = " ".join(w[i : i + n])
                        if self.value("h:" + title) is not None:
                            found.add(title)
        return tuple(sorted(found, key=lambda t: (-len(t), t)))

    def page_breaks(self, text: str, doc_name: str | None) -> tuple[str, set[str]]:
        """The text without running headers and page numbers, and which of them it held."""
        kinds, cuts = set(), []
        name, low = _COMPANY[doc_name or ""], text.lower()
        own = " ".join(words(name))
        titles = tuple(t for t in self.titles(text) if t not in (own, own + " and subsidiaries"))
        named = bool(name) and (name.lower() in low or " ".join(name.lower().split(" ")[0]) in low)
        if named or titles:
            at = running_lines(text, name if named else "", titles)
            if named and "\n" in text:
                at += [m.span() for m in _NAMED[name].finditer(text) if _AFTER.match(text, m.end()) or _BEFORE.search(text, max(0, m.start() - 24), m.start())]
            for a, b in sorted(at):
                kinds.add("header")
                if x := _AFTER.match(text, b):
                    kinds.add("page_number")
                    b = x.end()
                elif x := _BEFORE.search(text, max(0, a - 24), a):
                    kinds.add("page_number")
                    a = x.start()
                cuts.append((a, b))
        for m in _STYLED_LINE.finditer(text) if "\n" in text else _PAGE_OF.finditer(text):
            kinds.add("page_number")
            cuts.append(m.span())
        if "\n" in text:
            for m in _BARE_LINE.finditer(text):
                if not any(a <= m.start() < b for a, b in cuts) and self.is_page_number(text, m):
                    kinds.add("page_number")
                    cuts.append(m.span())
        else:
            for m in _INLINE.finditer(text):
                if not any(a <= m.start(2) < b for a, b in cuts) and not self.takes_number(m[1], m[3]) and self.count(m[1].lower()) and self.count(m[3].lower()):
                    kinds.add("page_number")
                    cuts.append(m.span(2))
        if not cuts:
            return text, kinds
        stretches, at = [], 0
        for a, b in sorted(cuts):
            if a >= at:
                stretches.append(text[at:a])
            at = max(at, b)
        width, out = wrap_width(text), ""
        for part in [*stretches, text[at:]]:
            if out and part.strip():  # between text and its continuation, one blank takes the break's place
                above, below = out.rstrip(), part.lstrip()
                gap = out[len(above) :] + part[: len(part) - len(below)]
                if above and gap and ("\n" not in gap or goes_on(above.rpartition("\n")[2], below.partition("\n")[0], width, True)):
                    out, part = above + " ", below
            out += part
        return out, kinds

    def takes_number(self, before: str, after: str) -> bool:
        """Whether a number is usual after the one word or before the other."""
        return "n" in self.entry(before.lower())[2] or "m" in self.entry(after.lower())[2]

    def is_page_number(self, text: str, m: re.Match) -> bool:
        """Whether a number alone on its line is a page's: it stands between lines of running text or whole
        table rows (cells on lines of their own have short neighbours) and isn't the sentence's own number."""
        end, start = m.start(), _PLAIN.search(text, m.end())
        while end and text[end - 1].isspace():
            end -= 1
        above = text[text.rfind("\n", 0, end) + 1 : end]
        below = text[start.start() :].partition("\n")[0] if start else ""
        if not (above or below):
            return False
        ends = not above or above[-1:] in ".;:" or "   " in above
        if not ends:
            a, b = words(above)[-1:], words(below)[:1]
            if self.takes_number("".join(a), "".join(b)):
                return False
        flowing = bool(above) and _prose(above) and not ends and below[:1].islower()
        return (not above or _prose(above)) and (not below or _prose(below) or flowing)

    # ---- words
    def is_broken(self, a: str, mark: str, b: str) -> bool:
        """Whether a mark between two word parts cuts one word (and isn't the hyphen of its spelling)."""
        a, b = a.lower(), b.lower()
        whole = a + b
        if b in SUSPENDING and mark == "-" and not self.count(whole):
            return False
        joined, compound = self.count(self.fixed(whole)), int(self.value(f"c:{a}-{b}") or 0)
        if joined or compound:
            return joined > compound
        if mark != "-":
            return True
        return not (self.count(self.fixed(a)) and self.count(self.fixed(b)))

    def is_torn(self, m: re.Match) -> bool:
        """Whether two words of a pair that the model knows are one: mostly fragments, or the whole fits the words on
        both sides."""
        a, b = m[1].lower(), m[2].lower()
        if self.value(f"t:{a} {b}") is not None:
            return True
        before, after = _kinds(m.string[max(0, m.start() - 80) : m.start()])[-1:], _kinds(m.string[m.end(2) : m.end(2) + 80])[:1]
        beside = [f"k:{x} {a}{b}" for x in before] + [f"k:{a}{b} {x}" for x in after]
        return bool(beside) and all([self.value(x) is not None for x in beside])

    def mend(self, text: str) -> tuple[str, set[str]]:
        """Words cut at line ends, misread and torn."""
        kinds: set[str] = set()

        def join(m: re.Match) -> str:
            if self.is_broken(m[1], m[2], m[3]):
                kinds.add("hyphen")
                return m[1] + m[3]
            return m[0] if m[2] in "=~" else f"{m[1]}-{m[3]}" if self.value(f"c:{m[1]}-{m[3]}".lower()) else m[0]

        if _BREAK.search(text):
            text = _BROKEN.sub(join, text)
        if not text.isascii() and _LIGATURE.search(text):
            kinds.add("misread")
            text = _LIGATURE.sub(lambda m: {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}[m[0]], text)
        in_order, here = self.words_of(text)
        wrong = here & self.wrong
        if not self.complete:
            wrong |= {w for w in here - self.vocabulary if self.entry(w)[1]}
        if wrong:
            kinds.add("misread")
            text = re.sub(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(wrong, key=len, reverse=True))) + r")(?![^\W_])", lambda m: _cased(self.fixed(m[0].lower()), m[0]), text, flags=re.I)
        if (any(x in here for x in "lio|") or here & self.mixed or any(map(_mixed, here - self.vocabulary))) and _NUMERIC.search(text):
            kinds.add("misread")
            text = _NUMERIC.sub(lambda m: m[0].translate(_DIGITS), text)
        if wrong:
            in_order, here = self.words_of(text)
        pairs: set[tuple[str, str]] = set()
        if parts := self.with_mark("f", here):
            for i in [i for i, x in enumerate(in_order) if x in parts]:
                near = in_order[max(0, i - 1) : i + 2]
                pairs.update(zip(near, near[1:]))
        if (firsts := self.with_mark("a", here)) and (seconds := self.with_mark("b", here)):
            if self.complete:
                low = text.lower()
                pairs.update((x, y) for x in firsts for y in self.loose[x] & seconds if f"{x} {y}" in low)
            else:
                pairs.update((x, y) for x, y in zip(in_order, in_order[1:]) if x in firsts and y in seconds)
        pairs = {(a, b) for a, b in pairs if self.value(f"t:{a} {b}") is not None or self.value(f"x:{a} {b}") is not None}
        if pairs:

            def glue(m: re.Match) -> str:
                if (m[1].lower(), m[2].lower()) in pairs and self.is_torn(m):
                    kinds.add("misread")
                    return m[1]
                return m[0]

            some = "|".join(sorted({re.escape(a) for a, _ in pairs}))
            text = re.sub(rf"(?<![\w-])({some}) (?=([^\W\d_]+)(?!\w))", glue, text, flags=re.I)
        return text, kinds

    def text(self, text: str, doc_name: str | None) -> tuple[str, set[str]]:
        bare, kinds = self.page_breaks(text, doc_name)
        mended, more = self.mend(bare)
        return paragraphs(mended, wrap_width(text)) if kinds | more else text, kinds | more


def _kinds(text: str) -> list[str]:
    """Words as they are counted: a number is ``#``."""
    return ["#" if w.isdigit() else w for w in words(text)]


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


_ITEM = re.compile(r"(?:[-–—•*·▪●■]|\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)])\s")
_ENDED = re.compile(r"[.!?:][\"'”’»)\]]*$")
_LAST = re.compile(r"[^\s(]+$")


def wrap_width(text: str) -> int:
    """Length of the longest line that runs on to a small letter, to which the text is wrapped; 0 if none does."""
    lines = [x.strip() for x in text.split("\n")]
    return max((len(x) for x, y in zip(lines, lines[1:]) if y[:1].islower() and len(x) <= 160 and "   " not in x), default=0)


def _heading(line: str) -> bool:
    """Every longer word begins with a capital."""
    return all(not w[:1].islower() for w in line.split() if len(w) > 3)


def goes_on(above: str, below: str, width: int, cut: bool = False) -> bool:
    """Whether a line's sentence hasn't ended and the next line continues it.

    Before a small letter it does. Before anything else it does after a comma or a word that nothing ends with,
    and if the line is prose that the next word would have made longer than ``width``; at a page break
    (``cut``) prose of 45 characters will do. Table rows, list items and headings keep to themselves.
    """
    a, b = above.strip(), below.strip()
    if not a or not b or "   " in a or "   " in b or _ITEM.match(b) and not (b[0] == "(" and a[-1] not in ".;:"):
        return False
    last = _LAST.search(a)[0] if a[-1] != "(" else ""
    if _ENDED.search(a):
        word = last.rstrip(".").lower()
        return a[-1] == "." and (word in TITLES or word in SHORT and (b[0].islower() or b[0].isdigit()))
    if b[0].islower() or b[0] == "(":
        return True
    if a[-1] == ";" or len(a.split()) < 2:
        return False
    if a[-1] == "," or last.lower() in LEADING:
        return True
    if _heading(a):
        return False
    if b[0].isdigit() and (last in "$€£" or len(last) == 3 and last.isupper()):  # a currency or a standard's name
        return True
    return cut and len(a) >= 45 or 0 < width < len(a) + 1 + len(b.split()[0])


def paragraphs(text: str, width: int | None = None) -> str:
    """Lines of a paragraph become one; blank lines, list items and table rows keep their breaks. ``width``: to
    which the lines are wrapped (measured if not given)."""
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    width = wrap_width(text) if width is None else width
    out: list[str] = []
    above = ""
    for line in text.split("\n"):
        if out and goes_on(above, line, width):
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
        else:
            out.append(line)
        above = line
    return "\n".join(out).strip()


# ----------------------------------------------------------------- all records
_OUT = "key string, field string, kinds array<string>, text string"


def _rows(key, field, kinds, text) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array(key, pa.string()), "field": pa.array(field, pa.string()), "kinds": pa.array(kinds, pa.list_(pa.string())), "text": pa.array(text, pa.string())})


def _frequent(model: DataFrame, most: int) -> int | None:
    """Least count such that at most ``most`` rows of the model have it or a greater one; null if all rows may."""
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))))
    held = sorted(((r["l"], r["k"]) for r in model.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total = 0
    for l, k in held:
        if total + k > most:
            return 2 ** (l + 1)
        total += k
    return None


def repair_pages(records: DataFrame, key: str, doc_name: str, fields: list[str], model: DataFrame | None = None, broadcast_rows: int = 500_000, only_found: bool = False) -> DataFrame:
    """``key, field, kinds, text``: one row for each record and field with the debris that it held (sorted
    kinds; empty if none) and the repaired text; a null text stays null with no kinds. Rows delivered again
    come again; ``only_found`` leaves out fields without debris.

    ``page_number`` and ``header`` are looked for in the first of ``fields`` (the running text) only. The most
    frequent rows of the model, at most ``broadcast_rows``, are sent to the executors. What a text looks up beyond
    them comes by joins: its repair is run with what is known and asks for what it misses, until it misses nothing,
    so that its result is that of the whole model.
    """
    records = spread(records.select(*dict.fromkeys([key, doc_name, *fields])))
    model = page_model(records, fields) if model is None else model
    rows = records.select(F.col(key).cast("string").alias("key"), F.col(doc_name).alias("doc"), *fields)
    body = fields[0]
    least = _frequent(model, broadcast_rows)
    complete = least is None
    hot = model if complete else model.where(F.col("n") >= least)
    sent = records.sparkSession.sparkContext.broadcast({r["key"]: r["value"] for r in hot.select("key", "value").collect()})

    def one(r: Repair, field: str, text: str | None, doc: str | None) -> tuple[str | None, set[str]]:
        if text is None:
            return None, set()
        if field == body:
            return r.text(text, doc)
        fixed, kinds = r.mend(text)
        return (re.sub(r"\s+", " ", fixed) if kinds else text), kinds

    if complete:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repair = Repair(sent.value)
            for batch in batches:
                out = [], [], [], []
                docs, keys = batch["doc"].to_pylist(), batch["key"].to_pylist()
                for field in fields:
                    for k, doc, text in zip(keys, docs, batch[field].to_pylist()):
                        fixed, kinds = one(repair, field, text, doc)
                        if kinds or not only_found:
                            for column, x in zip(out, (k, field, sorted(kinds), fixed)):
                                column.append(x)
                yield _rows(*out)

        return rows.mapInArrow(run, _OUT)

    long = rows.select("key", "doc", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "text"))
    long = long.withColumn("md5", F.md5(F.to_json(F.struct(F.col("field") == body, "doc", "text"))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(sent.value, False)
        for batch in batches:
            ids, asked = [], []
            for md5, doc, field, text, part in zip(*(batch[c].to_pylist() for c in ("md5", "doc", "field", "text", "part"))):
                repair.answer(dict(part or []))
                one(repair, field, text, doc)
                asked.extend(sorted(repair.missing)), ids.extend([md5] * len(repair.missing))
            yield pa.record_batch({"md5": pa.array(ids, pa.string()), "key": pa.array(asked, pa.string())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(sent.value, False)
        for batch in batches:
            out = [], [], [], []
            for k, doc, field, text, part in zip(*(batch[c].to_pylist() for c in ("key", "doc", "field", "text", "part"))):
                repair.answer(dict(part or []))
                fixed, kinds = one(repair, field, text, doc)
                if kinds or not only_found:
                    for column, x in zip(out, (k, field, sorted(kinds), fixed)):
                        column.append(x)
            yield _rows(*out)

    cold = model.where(F.col("n") < least).select("key", "value")
    texts = materialise(long.where("text IS NOT NULL").select("md5", "doc", "field", "text").dropDuplicates(["md5"]))
    none = F.lit(None).cast("map<string,string>")
    asked = materialise(texts.withColumn("part", none).mapInArrow(ask, "md5 string, key string").join(cold, "key", "left").select("md5", "key", "value"))
    while True:  # the answers lead to further keys: ask until there are none
        parts = materialise(asked.groupBy("md5").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("part")))
        more = texts.join(parts, "md5").select("md5", "doc", "field", "text", "part").mapInArrow(ask, "md5 string, key string")
        more = materialise(more.join(cold, "key", "left").select("md5", "key", "value"))
        if more.isEmpty():
            break
        asked = asked.union(more)
    return long.join(parts, "md5", "left").select("key", "doc", "field", "text", "part").mapInArrow(answer, _OUT)


def found_debris(records: DataFrame, key: str = "chunk_id", doc_name: str = "doc_name", fields: tuple[str, ...] = ("text", "start_phrase"), **how) -> DataFrame:
    """``key, field, kind``: one row for each kind of debris that a field of a record holds."""
    out = repair_pages(records, key, doc_name, list(fields), only_found=True, **how)
    return out.select("key", "field", F.explode("kinds").alias("kind")).distinct()
