"""Secret scan: fixed patterns plus sliding-window entropy, in DataFrame functions only.

Three patterns give the base spans. Further candidates are long unbroken strings of one
character class; each is measured by the Shannon entropy of its most uneven-looking
window. The counts of the window's characters and its sum of ``n log2 n`` are carried along
the string: one character's count goes up, another's down, and only these two terms change.
Candidates on the allow-list (identifiers, paths, plain words, stated examples) stay out.

A null or empty text has no spans, an empty table gives an empty result. Texts are scanned
whole, in time in proportion to their length; positions are code points, end exclusive. Of
spans that start together the kinds come in the order of ``kinds``, entropy last. Repeated
rows are scanned one by one. Columns of the table keep their names and values, whatever they
are called, but for those named as results.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: Fixed by the contract: kind -> (pattern, group, least length of the group).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32))
#: Candidate strings of the entropy scan. The greedy run is taken whole.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: kind of class -> (what the whole candidate looks like, least entropy in bits of a 20-character window).
CLASSES = ((r"^[0-9A-Fa-f-]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.7), (r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Candidates that match one of these are no secrets: no digit at all, digits alone, UUIDs, paths and slugs of words, examples.
ALLOW = (
    r"^[0-9_=+/-]+$",  # digits alone
    (r"^[^0-9]*$", r"![a-z][A-Z][a-z][A-Z]"),  # words, but not letters of changing case
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    # paths and slugs: words or numbers, one separator between two of them
    (r"^[/A-Za-z0-9][A-Za-z0-9/_=-]*[/A-Za-z0-9]$", r"[A-Za-z0-9][/_=-][A-Za-z0-9]", r"![/_=-][/_=-]", r"![A-Za-z][0-9]", r"![0-9][A-Za-z]"),
    r"(?i)^(example|sample|dummy|test)[_=/-]|example(key)?=*$|x{8}",
)
#: Characters that are counted apart; all others count as one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """The array cut into about as many blocks as a block has items; none of an empty one."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / n).cast("int")), lambda k: F.slice(items, k * n + 1, n))
    return F.filter(_let(size, cut), lambda b: F.size(b) > 0)


def _located(text: Column, pattern: str, whole: Column) -> Column:
    """Array of ``struct(start, whole)`` for the matches ``whole``: the text between them gives the places.

    Places are summed up inside blocks of matches and from block to block, as an array that grows by
    one is copied each time.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    none = F.array().cast("array<struct<start:int,whole:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    rows = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,whole:string>>>").alias("found"))

    def step(acc, x):
        start = acc["at"] + x["b"]
        return F.struct((start + F.char_length(x["w"])).alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), x["w"].alias("whole")))).alias("found"))

    def shift(acc, block):
        moved = F.transform(block["found"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), m["whole"].alias("whole")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"))
    summed = _let(pairs, lambda p: F.transform(_blocks(p), lambda block: F.aggregate(block, zero, step)))
    return F.when(F.size(whole) > 0, F.flatten(F.aggregate(summed, rows, shift)["found"])).otherwise(none)


def window_entropy(word: Column, width: int = 20) -> Column:
    """Largest entropy in bits of any ``width`` characters of ``word`` (of the whole, if shorter).

    The state is the count of every character in the window and the window's sum of n log2 n. A
    character that enters a window holding n of it adds (n+1) log2 (n+1) - n log2 n; one that leaves
    takes the like off. Counts are kept as a string of one character each, of code point 48 + n.
    """
    gains = F.array(*(F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(width + 1)))
    place = lambda c: F.instr(F.lit(ALPHABET), c) + 1
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 48
    put = lambda counts, at, n: F.overlay(counts, F.char(n + 48), at)

    def fold(chars):
        size = F.least(F.size(chars), F.lit(width))
        start = F.struct(F.lit(0).alias("i"), F.lit("0" * (len(ALPHABET) + 1)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"))

        def step(acc, c):
            i = acc["i"] + 1
            leaves = place(F.get(chars, i - 1 - width))

            def enter(left):  # struct(counts, total) without the character that leaves
                at = place(c)
                total = left["total"] + F.get(gains, count(left["counts"], at))
                bits = F.log2(size.cast("double")) - total / size
                return F.struct(i.alias("i"), put(left["counts"], at, count(left["counts"], at) + 1).alias("counts"), total.alias("total"), F.when(i >= size, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

            n = count(acc["counts"], leaves)
            less = F.struct(put(acc["counts"], leaves, n - 1).alias("counts"), (acc["total"] - F.get(gains, n - 1)).alias("total"))
            same = F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"))
            return _let(F.when(i > width, less).otherwise(same), enter)

        return F.aggregate(chars, start, step)["best"]

    return _let(F.split(word, ""), fold)


def _matches(word: Column, pattern) -> Column:
    """Whether a pattern is found, or of several all, and none of those that begin with ``!``."""
    if isinstance(pattern, str):
        return ~word.rlike(pattern[1:]) if pattern.startswith("!") else word.rlike(pattern)
    return functools.reduce(lambda a, b: a & b, (_matches(word, p) for p in pattern))


def _suspect(word: Column, classes, allow, width: int) -> Column:
    listed = functools.reduce(lambda a, b: a | b, (_matches(word, a) for a in allow), F.lit(False))
    least = None
    for pattern, bits in classes:
        least = F.when(word.rlike(pattern), F.lit(bits)) if least is None else least.when(word.rlike(pattern), F.lit(bits))
    return F.when(listed, F.lit(False)).otherwise(window_entropy(word, width) >= least)


def _spans(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["whole"])).alias("end")))


def _long_enough(hits: Column, pattern: str, group: int, least: int) -> Column:
    return F.filter(hits, lambda m: F.char_length(F.regexp_extract(m["whole"], pattern, group)) >= least)


def _found(text: Column, kinds, classes, allow, width: int) -> Column:
    """``struct(base, every)`` of a text that is not null: the spans of the fixed patterns, and all."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def hits(rank, kind, pattern, group, least):
        def spans(whole):
            located = _located(text, pattern, whole)
            return _spans(_long_enough(located, pattern, group, least) if group else located, rank, kind)

        return _let(every(pattern), spans)

    base = F.array_sort(F.concat(*(hits(rank, *k) for rank, k in enumerate(kinds))))
    strange = _let(every(CANDIDATE), lambda whole: F.filter(_located(text, CANDIDATE, whole), lambda m: _suspect(m["whole"], classes, allow, width)))

    def both(own):
        # spans come by start, so that few blocks can hold one that covers another
        ends = lambda block: F.array_max(F.transform(block, lambda b: b["end"]))
        blocks = F.transform(_blocks(own), lambda b: F.struct(b[0]["start"].alias("start"), ends(b).alias("end"), b.alias("spans")))
        inside = lambda s, b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])

        def more(cut):
            covered = lambda s: F.exists(cut, lambda b: inside(s, b) & F.exists(b["spans"], lambda x: inside(s, x)))
            new = F.filter(_spans(strange, len(kinds), "entropy"), lambda s: ~covered(s))
            return F.struct(own.alias("base"), F.when(F.size(new) > 0, F.array_sort(F.concat(own, new))).otherwise(own).alias("every"))

        return _let(blocks, more)

    return _let(base, both)


def scan_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", kinds=BASE, classes=CLASSES, allow=ALLOW, width: int = 20) -> DataFrame:
    """Adds ``into``, the sorted spans of every document, and ``<into>_base``, those of the fixed patterns.

    A span is ``struct(start, rank, kind, end)``; ``rank`` orders kinds that start together. Entropy
    spans that lie inside a base span are left out.
    """
    found = free_name(docs, "_found")
    out = docs.withColumn(found, _found(F.coalesce(F.col(text_col), F.lit("")), kinds, classes, allow, width))
    return out.withColumns({f"{into}_base": F.col(f"{found}.base"), into: F.col(f"{found}.every")}).drop(found)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column, mask: str, size: int = 4096) -> Column:
    """``text`` with its sorted ``spans`` replaced, in blocks of ``size`` code points, each with the spans that reach into it.

    A span is told where it begins; where it goes on in the next block, that block begins without it.
    """

    def block(part, k):
        first = k * size

        def cut(own):
            start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

            def step(acc, s):
                begins = s["start"] - first
                gap = F.substring(part, acc["at"] + 1, F.greatest(begins - acc["at"], F.lit(0)))
                # one mask for spans that overlap, and none for one that was told in an earlier block
                new = F.when((begins >= 0) & (begins >= acc["at"]), F.lit(mask)).otherwise(F.lit(""))
                return F.struct(F.greatest(acc["at"], s["end"] - first).alias("at"), F.concat(acc["out"], gap, new).alias("out"))

            return _let(F.aggregate(own, start, step), lambda done: F.concat(done["out"], F.substring(part, done["at"] + 1, F.lit(size))))

        return cut(F.filter(spans, lambda s: (s["start"] < first + size) & (s["end"] > first)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.array_join(F.transform(parts, block), "")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows with every span replaced by ``mask``; overlapping spans share one. Null texts stay null."""
    spans = free_name(docs, "_spans")
    scanned = docs.withColumn(spans, _found(F.coalesce(F.col(text_col), F.lit("")), BASE, CLASSES, ALLOW, 20)["every"])
    text = F.when(F.size(spans) > 0, _masked(F.col(text_col), F.col(spans), mask)).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, text).select(*docs.columns)
