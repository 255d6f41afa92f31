"""Text decoded with the wrong character encoding.

The corpus tells which words it writes cleanly. Every distinct clean word is garbled under all encoding
chains, and the tokens of the documents are hash-joined with that table; a verified original takes the
garbled token's place. Characters are garbled too, for words that the corpus nowhere writes cleanly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.memo import Memo
from leafmill.session import materialise, spread

# ---------------------------------------------------------------- fixed values
#: Encodings in which UTF-8 bytes are read by mistake.
READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp1253", "cp1254", "cp1257", "cp866", "koi8-r"]
#: Single-byte encodings of the texts themselves that are taken for one another.
WRITTEN_AS = ["cp1252", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257"]
# -----------------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
LOST = "�"
#: Control characters that no clean text holds, but U+0085, which is a line break in some.
C1 = "".join(map(chr, [*range(0x80, 0x85), *range(0x86, 0xA0)]))
HAS_C1 = re.compile(f"[{C1}]")


def _table(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Character of each byte (a byte without one stands for itself) and byte of each character."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


TABLE = Memo(_table, 64)


def misread(word: str, encoding: str) -> str:
    """UTF-8 bytes of a word, read as ``encoding``."""
    chars = TABLE[encoding][0]
    return "".join(chars[b] for b in word.encode("utf-8", "replace"))


def swapped(word: str, written: str, read: str) -> str | None:
    """Bytes of a word in one single-byte encoding, read as another; None if it can't be written so."""
    back, chars = TABLE[written][1], TABLE[read][0]
    if any(c not in back for c in word):
        return None
    return "".join(chars[back[c]] for c in word)


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """Garbled forms of a word -> (chain, whether its form alone proves it: UTF-8 sequences
    and control characters do). cp1252 taken for latin-1 or iso8859-15 shows by control characters only."""
    out: dict[str, tuple[str, bool]] = {}

    def add(form: str | None, chain: str, sure: bool) -> None:
        if form and form != word and not form.isascii() and (form not in out or sure > out[form][1]):
            out[form] = (chain, sure)

    for e in READ_AS:
        once = misread(word, e)
        add(once, f"utf-8>{e}", True)
        add(once.replace("\xa0", ""), f"utf-8>{e}, blank lost", False)
        if e in ("cp1252", "latin-1"):
            for f in ("cp1252", "latin-1"):
                twice = misread(once, f)
                add(twice, f"utf-8>{e}>utf-8>{f}", True)
                add(misread(twice, f), f"utf-8>{e}>utf-8>{f}>utf-8>{f}", True)
    for a in WRITTEN_AS:
        for b in [*READ_AS, "utf-8"]:
            if a == b:
                continue
            if b == "utf-8":
                add(re.sub(r"[^\x00-\x7f]", LOST, word), "bytes lost", True)
            else:
                form = swapped(word, a, b)
                proved = bool(form and HAS_C1.search(form) and not HAS_C1.search(word))
                if proved or {a, b} not in ({"cp1252", "latin-1"}, {"cp1252", "iso8859-15"}):
                    add(form, f"{a}>{b}", proved)
    add("".join(c if c.isascii() else LOST * len(c.encode("utf-8", "replace")) for c in word), "bytes lost", True)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text and not text.isascii():
                seen.update(t for t in TOKEN.findall(text) if not t.isascii())
        if len(seen) > 500_000:
            yield pa.record_batch({"token": pa.array(list(seen)), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
    yield pa.record_batch({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _doc_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tokens = [], []
        for d, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
            if text and not text.isascii():
                own = {t for t in TOKEN.findall(text) if not t.isascii()}
                ids.extend([d] * len(own)), tokens.extend(own)
        yield pa.record_batch({"doc": pa.array(ids, pa.int64()), "token": pa.array(tokens, pa.string())})


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, word, n, chain, sure = [], [], [], [], []
        for w, k in zip(batch["token"].to_pylist(), batch["n"].to_pylist()):
            if LOST in w or len(w) > 80:
                continue
            for f, (c, s) in garbled_forms(w).items():
                form.append(f), word.append(w), n.append(k), chain.append(c), sure.append(s)
        yield pa.record_batch({"token": pa.array(form, pa.string()), "word": pa.array(word, pa.string()), "m": pa.array(n, pa.int64()), "chain": pa.array(chain, pa.string()), "sure": pa.array(sure, pa.bool_())})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of two to eight characters that begin with a non-ASCII one, of each token."""
    for batch in batches:
        token, piece = [], []
        for t in batch["token"].to_pylist():
            own = {t[i : i + k] for i in range(len(t)) if not t[i].isascii() for k in range(2, 9) if i + k <= len(t)}
            token.extend([t] * len(own)), piece.extend(own)
        yield pa.record_batch({"token": pa.array(token, pa.string()), "piece": pa.array(piece, pa.string())})


def garbled_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, word, chain, sure``: tokens of the corpus that are garbled forms, and their originals.

    A form proved by its UTF-8 sequences needs no more. A swap of single-byte encodings must be rarer than
    its original and leave at least two ASCII letters as evidence, or be four or more letters of another script; 20 times rarer, it is as good as proved (a single
    Cyrillic letter in place of a sign: 100 times). An original that is itself garbled is
    replaced by its own original. A token that no word explains is mended by the garbled characters in it, and if
    it holds control characters, by what their bytes are in cp1252.
    """
    tokens = materialise(spread(docs.select(F.col(text).alias("text"))).mapInArrow(_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    forms = tokens.mapInArrow(_forms, "token string, word string, m long, chain string, sure boolean")
    letters = F.length(F.regexp_replace("token", r"[^A-Za-z]", ""))
    foreign = F.col("token").rlike(r"^[^\x00-\x{BF}]{4,}$") & F.col("word").rlike(r"^[\p{L}]{4,}$")
    swap_alone = F.col("token").rlike(r"^\p{IsCyrillic}$")
    good = F.col("sure") | (F.col("m") > F.col("n")) & ((letters >= 2) | foreign) | swap_alone & (F.col("m") > F.col("n")) | F.col("chain").endswith("blank lost")
    hit = forms.join(tokens, "token").where(good & (F.col("token") != F.col("word")))
    # a swap far rarer than its original needs no second one: with letters around, or a Cyrillic letter for a sign
    swap, alone = ~F.endswith("chain", F.lit("blank lost")), F.col("token").rlike(r"^\p{IsCyrillic}$")
    clear = swap & (((letters >= 2) | foreign) & (F.col("m") >= 20 * F.col("n")) | alone & (F.col("m") >= 100 * F.col("n")))
    hit = hit.withColumn("sure", F.col("sure") | clear)
    best = hit.groupBy("token").agg(F.max_by(F.struct("word", "chain", "sure"), F.struct("sure", "m", "word")).alias("b")).select("token", "b.*")
    whole = materialise(best)
    # characters: forms of every non-ASCII character that clean tokens hold
    chars = tokens.join(whole.select("token"), "token", "left_anti").select(F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(r"[^\x00-\x7F]"), F.lit(0)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    marks = chars.mapInArrow(_forms, "token string, word string, m long, chain string, sure boolean").where("sure AND length(token) BETWEEN 2 AND 8").groupBy(F.col("token").alias("piece")).agg(F.max_by(F.struct("word", "chain"), F.struct("m", "word")).alias("c"))
    rest = tokens.where(~F.contains("token", F.lit(LOST))).join(whole.select("token"), "token", "left_anti").select("token")
    found = rest.mapInArrow(_pieces, "token string, piece string").join(marks, "piece").groupBy("token").agg(F.collect_list(F.struct(F.length("piece").alias("k"), "piece", F.col("c.word").alias("word"))).alias("p"), F.max("c.chain").alias("chain"))
    longest = F.array_sort("p", lambda x, y: F.when(x["k"] != y["k"], y["k"] - x["k"]).when(x["piece"] < y["piece"], -1).when(x["piece"] > y["piece"], 1).otherwise(0))
    mended = F.aggregate(longest, F.col("token"), lambda t, x: F.replace(t, x["piece"], x["word"]))
    pieces = found.select("token", mended.alias("word"), F.concat(F.lit("characters, "), "chain").alias("chain"), F.lit(True).alias("sure"))
    left = rest.where(F.col("token").rlike(f"[{C1}]")).join(found.select("token"), "token", "left_anti")
    controls = left.select("token", F.translate("token", C1, "".join(TABLE["cp1252"][0][ord(c)] for c in C1)).alias("word"), F.lit("cp1252>latin-1").alias("chain"), F.lit(True).alias("sure"))
    out = materialise(whole.union(pieces).union(controls))
    again = out.select(F.col("token").alias("word"), F.col("word").alias("word2"))
    for _ in range(2):  # an original may be a garbled form of another word
        out = out.join(again, "word", "left").select("token", F.coalesce("word2", "word").alias("word"), "chain", "sure")
    return materialise(out.where("token <> word"))


def garbled_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, swaps``: documents with garbled tokens, and the (token, word) pairs to substitute.

    Documents with replacement characters are listed even where no original is known (then without pairs). A
    swap that its form doesn't prove counts only if the same document holds a proved one or another swap of the
    same chain. Null texts have no rows.
    """
    own = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    words = garbled_words(docs, text)
    hits = spread(own).mapInArrow(_doc_tokens, "doc long, token string").join(words, "token")
    per = hits.groupBy("doc", "chain").agg(F.collect_set(F.struct("token", "word")).alias("s"), F.max("sure").alias("sure"))
    sums = per.groupBy("doc").agg(F.flatten(F.collect_list("s")).alias("swaps"), F.max("sure").alias("sure"), F.max(F.size("s")).alias("most"))
    found = sums.where("sure OR most >= 2").select("doc", "swaps")
    lost = own.where(F.contains("text", F.lit(LOST))).select("doc", F.expr("CAST(array() AS array<struct<token:string,word:string>>)").alias("swaps"))
    return found.union(lost).groupBy("doc").agg(F.flatten(F.collect_list("swaps")).alias("swaps"))


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, swaps in zip(batch["text"].to_pylist(), batch["swaps"].to_pylist()):
            to = {s["token"]: s["word"] for s in swaps or ()}
            out.append(TOKEN.sub(lambda m, to=to: to.get(m[0], m[0]), text) if to and text else text)
        yield pa.record_batch({"doc": batch["doc"], "restored": pa.array(out, pa.string()), "swaps": pa.array([len(s or ()) for s in batch["swaps"].to_pylist()], pa.int32())})


def restore(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, restored, swaps``: the affected documents with their original text where it can be regained
    (replacement characters without a known word stay)."""
    found = garbled_documents(docs, doc, text)
    own = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return own.join(found, "doc").mapInArrow(_swap, "doc long, restored string, swaps int")
