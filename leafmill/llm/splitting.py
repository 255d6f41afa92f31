"""Splitting oversized items at natural boundaries, by bounded-quantifier regular expressions.

A text is read as words with the blanks behind them, and written down as one letter for each word that says
how strong the boundary behind it is. One pattern reads a piece from these letters: alternatives in order of
boundary strength (blank line, line, sentence, word) each take up to the limit of letters and end at their
boundary; a run of characters is the last resort. Its quantifiers count single letters, which the JVM's engine
does in a loop: no limit and no length of text deepens its stack. The pieces of a text are all matches; the
overlap is what a look-back at the end of the piece before gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.words import token_count

#: Spaces, tabs and line breaks; everything else is part of a word.
_B, _W = r"[ \t\r\n]", r"[^ \t\r\n]"
#: Blank lines: empty or of spaces and tabs only.
BLANK_LINE = r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"
LINE = r"\r?\n"


def piece_pattern(limit: int, least: int) -> str:
    """Pattern of one piece of at most ``limit`` words over the letters of ``shape``: to the last blank line (or
    the end) within the limit, else to the last line end, the last sentence end (both leaving pieces of ``least``
    words or more), the last word; a cut word ends its piece."""
    few, any_ = f"[plsw]{{{min(limit, max(1, least)) - 1},{limit - 1}}}", f"[plsw]{{0,{limit - 1}}}"
    return f"{any_}[pe]|{few}l|{few}s|{any_}[plswx]"


def spaced_words(text: Column, max_word: int) -> Column:
    """Words, each with the blanks behind it; words longer than ``max_word`` characters in several parts."""
    return F.regexp_extract_all(text, F.lit(rf"{_W}{{1,{max_word}}}+{_B}*+"), F.lit(0))


def shape(tokens: Column) -> Column:
    """One letter for each word: ``p`` before a blank line, ``l`` before a line break, ``s`` at a sentence's end,
    ``x`` where a long word was cut, ``w`` before a plain blank; ``e`` for the last word."""
    letter = lambda t: F.when(t.rlike(BLANK_LINE), "p").when(t.rlike(LINE), "l").when(t.rlike(rf"[.!?:;]{_B}+\z"), "s").when(t.rlike(rf"{_B}\z"), "w").otherwise("x")
    each = F.transform(tokens, lambda t, i: F.when(i == F.size(tokens) - 1, "e").otherwise(letter(t)))
    return F.array_join(each, "")


def most_words(text: Column, boundary: str) -> Column:
    """Words of the longest stretch between boundaries."""
    return F.array_max(F.transform(F.split(text, boundary), token_count))


def boundary_class(text: Column, limit: int) -> Column:
    """Null within the limit; else ``paragraph`` / ``line`` if every stretch between blank lines / line breaks
    is within it, and ``word`` if some line isn't."""
    # a text of more words than the limit has at least twice as many characters: the cheap test comes first
    over = (F.length(text) > 2 * limit) & (token_count(text) > limit)
    kind = F.when(most_words(text, BLANK_LINE) <= limit, "paragraph").when(most_words(text, LINE) <= limit, "line").otherwise("word")
    return F.when(over, kind)


def pieces(tokens: Column, shapes: Column, limit: int, least: int) -> Column:
    """The pieces of a text in order, without the blanks between them; ``shapes``: its letters (see ``shape``)."""
    sizes = F.transform(F.regexp_extract_all(shapes, F.lit(piece_pattern(limit, least)), F.lit(0)), F.length)
    none = F.expr("CAST(array() AS array<struct<start:int,n:int>>)")
    end = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["start"] + F.element_at(acc, -1)["n"]).otherwise(1)
    cuts = F.aggregate(sizes, none, lambda acc, n: F.concat(acc, F.array(F.struct(end(acc).cast("int").alias("start"), n.cast("int").alias("n")))))
    return F.transform(cuts, lambda c: F.regexp_replace(F.array_join(F.slice(tokens, c["start"], c["n"]), ""), rf"{_B}+\z", ""))


def split_oversized(records: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 800, overlap: int = 80, least: int | None = None, max_word: int = 10_000, only_oversized: bool = True) -> DataFrame:
    """``id, boundary, piece, pieces, word_count, overlap_words, text``: pieces of every record over ``limit``
    words (runs of characters between spaces, tabs and line breaks), numbered from 0.

    Every piece has at most ``limit`` words with its overlap: up to ``overlap`` words of the piece before (as
    many as fit), joined by a blank. Cut at blank lines where one lies within the limit, else at lines, sentence
    ends, words. The words of the pieces without overlap are the words of the text. Records within the limit
    come whole if ``only_oversized`` is off (boundary null); null, empty and blank texts have no pieces. Rows
    delivered again with the same key and text count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap: from 0 to under the limit")
    own = limit - overlap
    least = own // 2 if least is None else least
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"), boundary_class(F.col(text), limit).alias("boundary"))
    big = rows.where("boundary IS NOT NULL").distinct().withColumn("tokens", spaced_words(F.col("t"), max_word)).withColumn("shape", shape(F.col("tokens")))
    big = big.withColumn("p", pieces(F.col("tokens"), F.col("shape"), own, least)).drop("tokens", "shape")
    if not only_oversized:
        small = rows.where(F.col("boundary").isNull() & (token_count(F.col("t")) > 0)).distinct().withColumn("p", F.array("t"))
        big = big.unionByName(small)
    # the look-back: the last words of the piece before, by SQL arrays
    taken = F.greatest(F.lit(1), F.least(F.lit(overlap), token_count(F.col("before"))))
    last = F.array_join(F.slice(F.regexp_extract_all("before", F.lit(rf"{_W}+"), F.lit(0)), -taken, taken), " ")
    out = big.select("id", "boundary", F.posexplode(F.transform("p", lambda x, i: F.struct(x.alias("text"), F.when(i > 0, F.get(F.col("p"), i - 1)).alias("before")))).alias("piece", "x"), F.size("p").alias("pieces"))
    out = out.select("id", "boundary", "piece", "pieces", F.col("x.text").alias("body"), F.col("x.before").alias("before"))
    shown = F.when(F.col("before").isNull() | F.lit(not overlap), F.lit(None).cast("string")).otherwise(last)
    out = out.withColumn("lead", shown).withColumn("text", F.concat_ws(" ", "lead", "body"))
    return out.select("id", "boundary", "piece", "pieces", token_count(F.col("text")).alias("word_count"), token_count(F.col("lead")).alias("overlap_words"), "text")
