"""Benchmark decontamination: seeds that no leak can lack, then Smith-Waterman alignment.

A score is the alignment's share of the best possible one, and the alignment alone decides.
Seeds are pairs of words that follow each other with at most one word between, in item and
document alike. An alignment of m matches and e errors leaves m - 1 - e / 2 or more pairs of
neighbouring matches with at most one error between, so that a score of ``threshold`` in an
item of w words takes p = threshold * w - 1 seeds from different places of the item at least.
Of its w - 1 places all but p - 1 are thus enough to meet every leak, and those whose pairs
the fewest items of the whole test set hold are taken. The passage around a seed is as wide
as a leak can reach, and is aligned with the whole item if it holds enough of its words.

The test set is taken in blocks of bounded text, one pass over the documents each; seeds,
which bear on every word, are broadcast a block at a time and meet documents where these are,
as to shuffle all pairs of words of a corpus would cost a multiple of reading it. Items of one
frame are a class that pairs of its common words point to as one, and places that seeds point
to are gone through in portions, so that what a task holds depends on neither the number of
items that share a pair nor the length of a text. Blocks do not bear on what is found. Words are runs of letters and digits in lower case. Null and empty
documents and items without words have no leaks. Items of one or two words are one seed.
Repeated rows are reported each; of places in a document with one score the first is told. An
empty table gives no rows. Columns of the tables keep their names and values, whatever they
are called.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import append, free_name, join_hot, new_table, settle
from .sharding import number_rows

WORDS = re.compile(r"\w+")
LEAKS = "doc_id long, item_id long, score double, start long, end long, row string"
MATCH, MISMATCH, GAP = 2, -1, -1
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def gram_keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the n-grams of word numbers that begin at ``at``."""
    key = np.full(len(at), n, np.uint64)
    for k in range(n):
        key = _mix(key + ids[at + k].astype(np.uint64) + np.uint64(1))
    return key


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return gram_keys(np.stack([left, right], 1).ravel(), np.arange(0, 2 * len(left), 2), 2)


def _places(items: DataFrame) -> DataFrame:
    """``(row_no, place, words, key)``: the pairs of words that begin at each place of each item, keyed alike over all items."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                h = np.array([xxh64_intdigest(w) for w in words], np.uint64)
                if len(h) < 3:  # such items keep all places
                    continue
                at = np.concatenate([np.arange(len(h) - gap) for gap in (1, 2)])
                key = np.concatenate([_pair_keys(h[:-gap], h[gap:]) for gap in (1, 2)]).view(np.int64)
                for k in range(0, len(at), 100_000):
                    n = len(at[k : k + 100_000])
                    yield pa.record_batch([pa.array(np.full(n, row)), pa.array(at[k : k + n]), pa.array(np.full(n, len(h))), pa.array(key[k : k + n])], names=["row_no", "place", "words", "key"])

    return items.select("row_no", "text").mapInArrow(run, "row_no long, place long, words long, key long")


def _rare_places(items: DataFrame, threshold: float) -> DataFrame:
    """``(row_no, places array<long>)``: as many places of each item as no leak can lack, those of the rarest pairs."""
    places = settle(_places(items))
    spread = places.groupBy("key").agg(F.count_distinct("row_no").alias("spread"), F.count("*").alias("_c"))
    cost = join_hot(places, spread, "key", "_c", places.count()).groupBy("row_no", "place", "words").agg(F.sum("spread").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("row_no").orderBy("cost", "place"))
    needed = F.greatest(F.lit(1.0), F.ceil(F.lit(threshold) * F.col("words") - 1 - 1e-9))
    return cost.withColumn("_r", rank).where(F.col("_r") <= F.col("words") - needed).groupBy("row_no").agg(F.collect_list("place").alias("places"))


#: A word of so many items of a block is common; so many items that have the same common words at the same places are a class.
COMMON, CLASS = 32, 8
#: Places of items that seeds point to, and passages that are aligned, at a time.
HITS, PASSAGES = 1_000_000, 4096


class Seeds:
    """A block of test items: word numbers, sorted seed keys and where each seed occurs.

    Items written in one frame, that have the same common words at the same places, are a class. A pair of common words
    points to the class and not to each of its items; which of them a passage may hold is told by their other words.
    """

    def __init__(self, items: list[tuple[int, str, list[int] | None]], common: int = COMMON, least: int = CLASS):
        self.item_ids = np.array([i for i, _, _ in items], np.int64)
        texts = [words_of(t) for _, t, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], np.int32) for t in texts]
        self.single = any(len(w) == 1 for w in self.words)
        n = len(items)
        spread = np.bincount(np.concatenate([np.empty(0, np.int32), *(np.unique(w) for w in self.words)]), minlength=len(self.vocabulary))
        self.frames, self.members = self._classes(spread >= common, least)
        of = np.full(n, -1)
        for c, own in enumerate(self.members):
            of[own] = c
        none = np.empty(0, np.int64)
        keys, target, offset = [none.astype(np.uint64)], [none], [none]
        for i, (w, (_, _, places)) in enumerate(zip(self.words, items)):
            if len(w) == 1:
                parts = [(gram_keys(w, np.arange(1), 1), np.zeros(1, np.int64), 0)]
            else:
                parts = [(_pair_keys(w[:-gap], w[gap:]), np.arange(len(w) - gap), gap) for gap in (1, 2) if gap < len(w)]
            for k, at, gap in parts:
                if places is not None and len(w) > 2:
                    used = np.isin(at, places)
                    k, at = k[used], at[used]
                to = np.full(len(at), i)
                if of[i] >= 0:
                    frame = self.frames[of[i]]
                    to[(frame[at] >= 0) & (frame[at + gap] >= 0)] = n + of[i]
                keys.append(k)
                target.append(to)
                offset.append(at)
        keys, target, offset = map(np.concatenate, (keys, target, offset))
        order = np.lexsort((offset, target, keys))
        keys, target, offset = keys[order], target[order], offset[order]
        fresh = np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(target) != 0) | (np.diff(offset) != 0)]) if len(keys) else np.empty(0, bool)
        self.keys, self.target, self.offset = keys[fresh], target[fresh], offset[fresh]
        self.sizes = np.array([len(w) for w in [*self.words, *self.frames]], np.int64)
        # the other words of the items of classes: by word, the item and its class
        inside = [(self.words[i][self.frames[c] < 0], i, c) for c, own in enumerate(self.members) for i in own]
        word, item, cls = (np.concatenate([none, *x]) for x in (([w for w, _, _ in inside], [np.full(len(w), i) for w, i, _ in inside], [np.full(len(w), c) for w, _, c in inside])))
        order = np.lexsort((word, cls))
        self.rest_word, self.rest_item, self.rest_class = word[order], item[order], cls[order]
        self.rest_from = np.searchsorted(self.rest_class, np.arange(len(self.frames) + 1))

    def _classes(self, common: np.ndarray, least: int) -> tuple[list[np.ndarray], list[list[int]]]:
        """Frames (words at their places, -1 where items differ) and the items of each."""
        found: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.words):
            frame = np.where(common[w], w, -1).astype(np.int32) if len(w) > 1 else np.empty(0, np.int32)
            if (frame >= 0).sum() > 1:
                found.setdefault(frame.tobytes(), []).append(i)
        kept = {f: own for f, own in found.items() if len(own) >= least}
        return [np.frombuffer(f, np.int32) for f in kept], list(kept.values())

    def of_class(self, c: int, seen: np.ndarray, passage: np.ndarray, threshold: float) -> list[int]:
        """The items of a class of which a passage, whose words are marked in ``seen``, holds enough words.

        Where the frame's words alone are enough, items none of whose other words are there have one score, that of
        the frame: they count all together or not at all.
        """
        frame = self.frames[c]
        missing = threshold * len(frame) - 1e-9 - np.count_nonzero(seen[frame[frame >= 0]])
        if missing <= 0 and align([np.where(frame < 0, -2, frame)], [passage])[0] >= threshold * MATCH * len(frame) - 1e-9:
            return self.members[c]
        words = np.unique(passage[passage >= 0])
        at, end = self.rest_from[c], self.rest_from[c + 1]
        own = self.rest_word[at:end]
        lo, hi = np.searchsorted(own, words, "left"), np.searchsorted(own, words, "right")
        held = [self.rest_item[at + a : at + b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a]
        if not held:
            return []
        item, many = np.unique(np.concatenate(held), return_counts=True)
        return item[many >= missing].tolist()


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage, all pairs side by side."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(passages[i])))
    at = 0
    while at < len(order):
        part = order[at : at + 256]
        while len(part) > 1 and len(part) * max(len(passages[i]) for i in part) > 400_000:
            part = part[: len(part) // 2]
        at += len(part)
        wide, deep = max(len(passages[i]) for i in part), max(len(items[i]) for i in part)
        a, b = np.full((len(part), deep), -2, np.int32), np.full((len(part), wide), -3, np.int32)
        for r, i in enumerate(part):
            a[r, : len(items[i])], b[r, : len(passages[i])] = items[i], passages[i]
        slope = np.arange(wide + 1, dtype=np.int32) * -GAP
        h = np.zeros((len(part), wide + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        for j in range(deep):
            diagonal = h[:, :-1] + np.where(b == a[:, j : j + 1], MATCH, MISMATCH)
            new = np.zeros_like(h)
            np.maximum(diagonal, h[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            # a gap in the item: the best value further left, less one for each step
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(best, h.max(1), out=best)
        out[part] = best
    return out


def extent(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Where the first best alignment of ``item`` begins and ends in ``passage``."""

    def end(a: np.ndarray, b: np.ndarray) -> int:
        slope, h, best, at = np.arange(len(b) + 1) * -GAP, np.zeros(len(b) + 1, np.int64), 0, 0
        for word in a:
            new = np.zeros_like(h)
            np.maximum(h[:-1] + np.where(b == word, MATCH, MISMATCH), h[1:] + GAP, out=new[1:])
            h = np.maximum.accumulate(np.maximum(new, 0) + slope) - slope
            top = int(h.argmax())
            if h[top] > best or (h[top] == best and top < at):
                best, at = h[top], top
        return at

    last = end(item, passage)
    return last - end(item[::-1], passage[:last][::-1]), last


def _near(seeds: Seeds, texts: list[list[str]], threshold: float):
    """``(document, item, first word of the passage, passage)`` for every place that a seed points to."""
    get = seeds.vocabulary.get
    lengths = np.array([len(t) for t in texts])
    ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(lengths.sum()))
    ends = np.cumsum(lengths)
    known = np.flatnonzero(ids >= 0)
    places, docs_, los, counts = [], [], [], []
    for gap in (0, 1, 2) if seeds.single else (1, 2):
        at = known[known < len(ids) - gap]
        doc = np.searchsorted(ends, at, side="right")
        ok = (at + gap < ends[doc]) & (ids[at + gap] >= 0)
        at, doc = at[ok], doc[ok]
        key = _pair_keys(ids[at], ids[at + gap]) if gap else gram_keys(ids, at, 1)
        lo, hi = np.searchsorted(seeds.keys, key, "left"), np.searchsorted(seeds.keys, key, "right")
        found = hi > lo
        for held, x in zip((places, docs_, los, counts), (at, doc, lo, hi - lo)):
            held.append(x[found])
    at, doc, lo, many = (np.concatenate(x) for x in (places, docs_, los, counts))
    order = np.argsort(at, kind="stable")
    at, doc, lo, many = at[order], doc[order], lo[order], many[order]
    total = np.concatenate([[0], np.cumsum(many)])
    begin = 0
    seen = np.zeros(len(seeds.vocabulary) + 1, bool)
    while begin < len(at):
        # a chain of places that is cut here is two passages, each wide enough by itself
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS, "right")) - 1)
        own, m = slice(begin, end), many[begin:end]
        post = np.repeat(lo[own] - (total[begin:end] - total[begin]), m) + np.arange(int(m.sum()))
        yield from _passages(seeds, ids, ends, lengths, threshold, seen, np.repeat(doc[own], m), seeds.target[post], np.repeat(at[own], m) - seeds.offset[post])
        begin = end


def _passages(seeds: Seeds, ids, ends, lengths, threshold: float, seen, doc, target, origin):
    order = np.lexsort((origin, target, doc))
    doc, target, origin = doc[order], target[order], origin[order]
    sizes, n = seeds.sizes, len(seeds.words)
    # long chains of places are taken apart, so that a passage is never much longer than its item
    fresh = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(target) != 0) | (np.diff(origin) > sizes[target[1:]])])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    part = (origin - origin[head]) // np.maximum(8, sizes[target])
    starts = np.flatnonzero(fresh | np.concatenate([[True], np.diff(part) != 0]))
    stops = np.append(starts[1:], len(doc))
    doc, target, low, high = doc[starts], target[starts], origin[starts], origin[stops - 1]
    # a leak of ``threshold`` has no more errors than this
    pad = np.ceil(2 * (1 - threshold) * sizes[target]).astype(np.int64) + 1
    low = np.maximum(ends[doc] - lengths[doc], low - pad)
    high = np.minimum(ends[doc], high + sizes[target] + pad)
    for d, t, lo, hi in zip(doc.tolist(), target.tolist(), low.tolist(), high.tolist()):
        passage = ids[lo:hi]
        seen[passage] = True
        seen[-1] = False
        if t >= n:
            items = seeds.of_class(t - n, seen, passage, threshold)
        else:
            items = [t] if np.count_nonzero(seen[seeds.words[t]]) >= threshold * len(seeds.words[t]) - 1e-9 else ()
        seen[passage] = False
        for i in items:
            yield d, i, lo - int(ends[d] - lengths[d]), passage


def _block_leaks(docs: DataFrame, seeds, threshold: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("row", pa.string())])

    def run(batches):
        s = seeds.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.as_py() or "" for t in part.column(1)]
                found = _near(s, [words_of(t) for t in raw], threshold)
                best: dict = {}
                while places := list(itertools.islice(found, PASSAGES)):
                    scores = align([s.words[p[1]] for p in places], [p[3] for p in places])
                    for (d, i, first, passage), score in zip(places, scores):
                        share = float(score) / (MATCH * len(s.words[i]))
                        if share >= threshold and share > best.get((d, i), (0,))[0]:
                            best[d, i] = share, first, passage
                spans: dict = {}
                rows = []
                for (d, i), (share, at_word, passage) in sorted(best.items(), key=lambda x: x[0]):
                    if d not in spans:
                        spans = {d: [m.span() for m in WORDS.finditer(raw[d].lower())]}
                    first, last = (at_word + x for x in extent(s.words[i], passage))
                    rows.append((part.column(0)[d].as_py(), int(s.item_ids[i]), round(share, 6), spans[d][first][0], spans[d][last - 1][1], part.column(2)[d].as_py()))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row_col=None) -> DataFrame:
    """``(doc_id, item_id, score, start, end, row)``: documents that hold a copy of a test item.

    ``start`` and ``end`` are the code points, in the lower-cased text, that the best alignment spans; ``row`` repeats ``row_col``.
    ``block_chars``: characters of test items that are broadcast at a time (and one item, if that is longer).
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (row_col if row_col is not None else F.lit(None)).cast("string").alias("row"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and item_id is not null")
    numbered = settle(number_rows(items, ["item_id", "text"]))
    chosen = settle(numbered.join(_rare_places(numbered, threshold), "row_no", "left").orderBy("row_no"))
    path = new_table(spark)

    def search(block):
        seeds = spark.sparkContext.broadcast(Seeds(block))
        append(_block_leaks(slim, seeds, threshold), path)
        seeds.destroy()

    held, chars = [], 0
    for r in chosen.select("item_id", "text", "places").toLocalIterator():
        if held and chars + len(r["text"]) > block_chars:
            search(held)
            held, chars = [], 0
        held.append((r["item_id"], r["text"], r["places"]))
        chars += len(r["text"])
    if held:
        search(held)
    return spark.read.schema(LEAKS).parquet(path) if held else spark.createDataFrame([], LEAKS)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 500_000, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with their own columns. Rows are told apart by id and text.

    Keys of up to ``most_broadcast`` leaking rows are broadcast; more of them meet the rows in a shuffle.
    """
    row = free_name(docs, "_row")
    key = lambda: F.concat_ws(":", F.xxhash64(F.col(id_col), F.col(text_col)), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    leaks = settle(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, row_col=key(), **options).select(F.col("row").alias(row)).distinct())
    leaks = F.broadcast(leaks) if leaks.count() <= most_broadcast else leaks
    return docs.withColumn(row, key()).join(leaks, row, "left_anti").select(*docs.columns)
