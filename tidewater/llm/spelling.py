"""Spelling variants: words one edit apart, found in forward and reversed dictionaries.

One inserted, deleted or replaced code point leaves one half of a word intact: the first, which
words that share it have in a range of the sorted dictionary, or the last, a range of the sorted
dictionary of reversed words. Such a block holds the pairs whose edit lies between two places, lo
and hi; all before and behind is shared. A block of more than ``most`` words is subdivided at the
middle of that span: pairs with a later edit share more of the front, pairs with an earlier one
more of the end. Halving ends at a single place, where a block holds at most one shorter word, and
as many others as the alphabet has letters (90), so that no block stays large whatever the words
are. Every pair belongs to the one block that its edit, taken as far right as it goes, lies in: no
pair is met twice, and each is verified on both words whole.

Words are counted over all texts in the JVM, with partial sums before the shuffle. Null texts have
no words; null ids count as the empty string in the checksum of ``damage``; repeated rows count as
often as they are there; an empty table gives an empty dictionary. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Code points compared at a time.
PORTION = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5, damage: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` code points that occur ``least`` times.

    ``damage``: where that number divides the checksum of ``<doc_id>:<run>``, the run loses the code point that the checksum names.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    words = runs.select("id", low.alias("run"))
    if damage:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.pmod("h", F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        words = words.withColumn("run", F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")))
    return words.where(F.char_length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _blocks(rows: DataFrame) -> DataFrame:
    """``key`` of the block of ``(kind, m, lo, hi)`` that a word belongs to: what all its words share.

    ``kind`` 0: both of ``m`` code points, one replaced; 1: one of m, the other with one more.
    """
    end = F.col("m") - F.col("hi") + F.col("kind")  # of code points behind the edit
    front = F.substring("word", F.lit(1), F.col("lo"))
    back = F.when(end > 0, F.substring("word", F.char_length("word") - end + 1, end)).otherwise("")
    return rows.withColumn("key", F.struct("kind", "m", "lo", "hi", front.alias("front"), back.alias("back")))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of each row's span of places."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    span = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    return rows.withColumn("_s", F.explode(F.array(span(F.col("lo"), middle), span(middle, F.col("hi"))))).select("word", "n", "kind", "m", F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"))


def subdivided(words: DataFrame, most: int) -> DataFrame:
    """``(key, word, n, kind, m, lo, hi)``: words in blocks of at most ``most`` words, or of one place of edit."""
    length = F.char_length("word")
    kind = lambda k, m: F.struct(F.lit(k).alias("kind"), m.alias("m"), F.lit(0).alias("lo"), (m + k).alias("hi"))
    whole = words.withColumn("_k", F.explode(F.array(kind(0, length), kind(1, length), kind(1, length - 1)))).select("word", "n", "_k.*")
    rows, done = _halved(whole), None  # the forward and the reversed dictionary
    while True:
        rows = settle(_blocks(rows))
        sizes = settle(rows.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1"))
        held = rows.join(sizes, "key")
        split = (F.col("_size") > most) & (F.col("hi") - F.col("lo") > 1)
        small = held.where(~split).drop("_size")
        done = small if done is None else done.unionByName(small)
        if not sizes.where((F.col("_size") > most) & (F.col("key.hi") - F.col("key.lo") > 1)).head(1):
            return done
        rows = _halved(held.where(split).drop("_size", "key"))


def _array(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)


def verified(a: np.ndarray, b: np.ndarray, m: int, kind: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart, at a place from ``lo`` to ``hi``; ``a`` have ``m`` code points, ``b`` m + ``kind``."""
    same = a[:, :m] == b[:, :m]
    place = np.where(same.all(1), m, same.argmin(1))
    if kind:
        behind = np.cumprod((a[:, :m] == b[:, 1 : m + 1])[:, ::-1], axis=1, dtype=np.int64).sum(1) if m else np.zeros(len(a), np.int64)
        near = place + behind >= m
    else:
        near = same.sum(1) == m - 1
    return near & (place >= lo) & (place < hi)


def _compare(t: pa.Table) -> pa.Table:
    """All pairs of each block, verified: ``(word, n, other, other_n)``, both ways."""
    t = t.sort_by([("kind", "ascending"), ("m", "ascending"), ("b", "ascending"), ("word", "ascending")])
    kind, m, block, n, lo, hi = (t.column(c).to_numpy() for c in ("kind", "m", "b", "n", "lo", "hi"))
    words = t.column("word").to_pylist()
    plain = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in plain])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(m) != 0)) + 1, [len(words)]])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if s == e:
            continue
        k, length = int(kind[s]), int(m[s])
        x = _array(plain[s:e], length + k)
        own = np.arange(e - s)
        ends = np.searchsorted(block[s:e], block[s:e], "right")
        if k:  # each shorter word with all longer ones of its block
            begin = np.searchsorted(block[s:e], block[s:e], "left")
            left = np.flatnonzero(size[s:e] == length)
        else:
            begin, left = own + 1, own
        many = (ends - begin)[left]
        total = np.concatenate([[0], np.cumsum(many)])
        at, most = 0, max(1, PORTION // (length + 1))
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            i = np.repeat(left[at:end], many[at:end])
            j = begin[i] + np.arange(len(i)) - np.repeat(total[at:end] - total[at], many[at:end])
            if k:
                longer = size[s:e][j] == length + 1
                i, j = i[longer], j[longer]
            ok = verified(x[i], x[j], length, k, lo[s:e][i], hi[s:e][i])
            out.append((i[ok] + s, j[ok] + s))
            at = end
    i, j = (np.concatenate([p[side] for p in out]) if out else np.empty(0, np.int64) for side in (0, 1))
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    word = pa.array(words, pa.string())
    return pa.table({"word": word.take(pa.array(a)), "n": n[a], "other": word.take(pa.array(b)), "other_n": n[b]})


def near_words(words: DataFrame, most: int = 256, task_rows: int = 50_000) -> DataFrame:
    """``(word, n, other, other_n)``: every pair of words one edit apart, both ways."""
    rows = settle(subdivided(words, most).withColumn("b", F.xxhash64("key")).select("b", "word", "n", "kind", "m", "lo", "hi"))
    tasks = max(1, -(-rows.count() // task_rows))
    return rows.withColumn("_g", F.pmod("b", F.lit(tasks))).groupBy("_g").applyInArrow(_compare, "word string, n long, other string, other_n long")


def group_variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, damage: int | None = 199, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every word of the dictionary.

    A word's form is its near word of largest n, the smallest word among equals, if that is ``times`` its own; its
    root is the last of the forms that follow from it.
    """
    words = settle(count_words(docs, shortest, least, damage, id_col, text_col))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    marks = settle(near_words(words, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("_b")))
    strong = -F.col("_b.n") >= times * F.col("n")
    marks = marks.select("word", "n_near", F.when(strong, F.col("_b.word")).alias("form"), F.when(strong, -F.col("_b.n")).alias("form_n"))
    roots = _followed(settle(marks.where("form is not null").select("word", F.col("form").alias("root"))))
    out = words.join(marks, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _followed(steps: DataFrame) -> DataFrame:
    """``(word, root)`` with every root followed to the last one; each round doubles the distance, and forms grow five-fold, so rounds are few."""
    while True:
        nxt = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = settle(steps.join(nxt, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not steps.where("_moved").head(1):
            return steps.select("word", "root")
        steps = steps.drop("_moved")
