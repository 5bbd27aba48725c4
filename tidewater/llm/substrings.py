"""Removal of repeated byte strings by suffix arrays.

Every byte goes that a string of ``length`` bytes covers which starts anywhere else, too.

Sharding. Each window of ``length`` bytes has an anchor: its k-gram of the smallest hash,
the rightmost of several. Equal windows have equal anchors, so a run of windows with one
anchor (a segment) travels as a whole to the shard of the anchor's hash, and equal windows
meet there. Anchors that occur once in all documents send nothing. A Bloom filter of bounded
size tells them apart; what it lets through by mistake costs work, not correctness. Where anchors
that repeat are more than such a filter can tell, texts are gone through several times, each
time for a part of the anchors.

Suffix arrays. A shard sorts the suffixes of its segments by Larsson-Sadakane refinement:
by 8 bytes, then by pairs of ranks of twice the depth, only what is still tied. Common
prefixes of neighbours follow as in Kasai's scan, which carries a prefix on to the next
suffix as long as the neighbour moves along. Prefixes of ``length`` or more are repeats.

Merging. Segments of a very frequent anchor are dealt to several shards, whose sorted
distinct windows are merged by key afterwards: each is looked up among those of the other
shards by binary search, in ranges of keys.

Texts are UTF-8 bytes, null texts empty; matches never cross documents. Repeated rows are
places of their own. Shorter texts stay as they are. An empty table gives no rows. Columns other
than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import append, new_table, settle

K = 32
_PLACE = np.uint64((1 << 28) - 1)
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xD6E8FEB86659FD93)
#: One pseudo-random word for each byte.
_BYTES = np.random.default_rng(2024).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings of ``x`` (uint8): polynomials by doubling, then mixed."""
    h, k, power = _BYTES[x], 1, _N
    while k < K:
        left = h[:-k] * power
        left += h[k:]
        h, k, power = left, 2 * k, np.uint64(int(power) ** 2 % 2**64)
    h ^= h >> np.uint64(31)
    h *= _M
    h ^= h >> np.uint64(29)
    return h


def segments(x: np.ndarray, ends: np.ndarray, length: int, most: int = 1 << 27):
    """Segments of concatenated texts: ``(text number, first window, windows, anchor hash, kind)`` arrays, windows counted in ``x``.

    Segments of one kind have the same anchor, size and K bytes at either end. Windows are taken in stretches
    of about ``most`` bytes, which overlap by ``length - 1``; places in one are packed in 28 bits.
    """
    parts = []
    for at in range(0, max(1, len(x) - length + 1), most):
        part = x[at : at + most + length - 1]
        if len(part) > int(_PLACE):
            raise ValueError(f"a stretch of {len(part)} bytes is longer than places can tell")
        text, first, *rest = _stretch(part, np.clip(ends - at, 0, len(part)), length)
        parts.append((text, first + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]


def _stretch(x: np.ndarray, ends: np.ndarray, length: int):
    if len(x) < length:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = gram_hashes(x)
    low = h & ~_PLACE
    low |= _PLACE - np.arange(len(h), dtype=np.uint64)
    width, span = length - K + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    # a segment begins where the anchor changes and where a text does, and ends with the text's last window
    begins = ends[:-1][ends[:-1] < len(low)]
    first = np.union1d(np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1]), begins)
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.append(first[1:], len(low)), ends[np.minimum(text, len(ends) - 1)] - (length - 1))
    kept = np.flatnonzero(last > first)
    text, first, many = text[kept], first[kept], (last - first)[kept]
    anchor = h[(_PLACE - (low[first] & _PLACE)).astype(np.int64)]
    kind = ((anchor * _N) ^ h[first]) * _M ^ (h[first + many - 1 + length - K] * _N) ^ many.astype(np.uint64)
    return text, first, many, anchor, kind


def _portions(batches, at_once: int = 1 << 18):
    """Distinct texts of a batch with their rows, some bytes at a time: ``(keys, counts, raw)``."""
    for batch in batches:
        many = Counter(batch.column(0).to_pylist())
        keys, counts, raw, held = [], [], [], 0
        seen = set()
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k in seen:
                continue
            seen.add(k)
            b = (t.as_py() or "").encode("utf-8", "surrogatepass")
            keys.append(k)
            counts.append(many[k])
            raw.append(b)
            held += len(b)
            if held > at_once:
                yield keys, counts, raw
                keys, counts, raw, held = [], [], [], 0
        if keys:
            yield keys, counts, raw


def _cut(raw: list[bytes], length: int):
    blob = b"".join(raw)
    ends = np.cumsum([len(b) for b in raw])
    return blob, ends, segments(np.frombuffer(blob, np.uint8), ends, length)


class Bloom:
    """Bits for 64-bit keys, two places a key; the size is bounded whatever the number of keys."""

    def __init__(self, keys: int, most_bits: int = 1 << 29):
        self.bits = 1 << 13
        while self.bits < min(16 * keys, most_bits):
            self.bits *= 2

    def places(self, keys: np.ndarray):
        h = keys.astype(np.uint64) * _N
        h ^= h >> np.uint64(32)
        mask = np.uint64(self.bits - 1)
        return h & mask, ((h * _M) >> np.uint64(20)) & mask

    def build(self, df: DataFrame, column: str, tasks: int = 4) -> bytes:
        """The filter of a column of longs; ``tasks`` bitmaps at most come to the driver."""

        def run(batches):
            bitmap = np.zeros(self.bits, bool)
            for b in batches:
                for p in self.places(b.column(0).to_numpy().view(np.uint64)):
                    bitmap[p] = True
            yield pa.record_batch([pa.array([np.packbits(bitmap).tobytes()])], names=["m"])

        out = np.zeros(self.bits // 8, np.uint8)
        for r in df.select(column).coalesce(tasks).mapInArrow(run, "m binary").toLocalIterator():
            out |= np.frombuffer(r["m"], np.uint8)
        return out.tobytes()

    def holds(self, bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for p in self.places(keys):
            ok &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return ok


def sort_suffixes(x: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``x`` tied to ``depth`` bytes, in order, and their ranks: Larsson-Sadakane refinement.

    ``ends``: for every position the end of its segment; suffixes that end before a depth stay
    behind at it. Returned are the positions whose first ``depth`` bytes occur more than once.
    """
    n = len(x)
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed[: n - k] |= x[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    at = np.flatnonzero(np.arange(n) + 8 <= ends)
    rank = np.zeros(n, np.int64)
    at = at[np.argsort(packed[at], kind="stable")]
    key, reached, base = packed[at], 8, np.zeros(len(at), np.int64)
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.empty(0, bool)
        # a rank is the group's place in the order; groups keep inside the place of the group they came from
        heads = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        rank[at] = base + heads[group] if reached == 8 else base + heads[group] - _heads_of(base, heads, group)
        tied = np.diff(np.append(heads, len(at)))[group] > 1
        at = at[tied]
        if reached == depth or not at.size:
            return at, rank[at]
        deeper = min(2 * reached, depth)
        at = at[at + deeper <= ends[at]]
        base, next_ = rank[at], rank[at + (deeper - reached)]
        key = (base << np.int64(32)) | next_
        order = np.argsort(key, kind="stable")
        at, key, base, reached = at[order], key[order], base[order], deeper


def _heads_of(base: np.ndarray, heads: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every suffix in the order, where the group of its ``base`` begins."""
    first = np.concatenate([[True], base[1:] != base[:-1]])
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def common_prefixes(x: np.ndarray, at: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of the suffixes ``at`` (ascending) with their neighbours ``before``.

    Kasai's carry: where both suffixes are one byte further than the pair before, its prefix
    less one is shared. Pairs along such a diagonal form a chain; the heads of all chains are
    compared first, then their followers, side by side.
    """
    out = np.zeros(len(at), np.int64)
    if not len(at):
        return out
    chained = np.concatenate([[False], (np.diff(at) == 1) & (np.diff(before) == 1)])
    head = np.flatnonzero(~chained)
    size = np.diff(np.append(head, len(at)))
    carried = np.zeros(len(head), np.int64)
    limit = len(x)
    for step in range(int(size.max())):
        live = np.flatnonzero(size > step)
        i = head[live] + step
        got = np.maximum(carried[live] - 1, 0)
        more = np.arange(len(live))
        while more.size:
            a, b = at[i[more]] + got[more], before[i[more]] + got[more]
            ok = (got[more] < most) & (a < limit) & (b < limit)
            ok[ok] = x[a[ok]] == x[b[ok]]
            more = more[ok]
            got[more] += 1
        out[i] = got
        carried[live] = got
    return out


def repeated_windows(parts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of distinct segments occur in several places: bool per window, with each segment's first place in ``x`` and ``x`` itself."""
    x = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    stop = np.cumsum(sizes)
    at, rank = sort_suffixes(x, np.repeat(stop, sizes), length)
    order = np.lexsort((at, rank))
    at, rank = at[order], rank[order]
    same = np.flatnonzero(rank[1:] == rank[:-1]) + 1  # neighbours in one group
    pair_at, pair_before = at[same], at[same - 1]
    by_place = np.argsort(pair_at, kind="stable")
    pair_at, pair_before = pair_at[by_place], pair_before[by_place]
    ok = common_prefixes(x, pair_at, pair_before, length) >= length
    hit = np.zeros(len(x), bool)
    hit[pair_at[ok]] = True
    hit[pair_before[ok]] = True
    return hit, stop - sizes, x


_FOUND = "g binary, a array<int>, b array<int>, w binary, o int"


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def _scan_shard(length: int):
    from xxhash import xxh3_128_digest

    def scan(t: pa.Table) -> pa.Table:
        many: dict = {}
        row: dict = {}
        for i, (g, c) in enumerate(zip(t.column("g").to_pylist(), t.column("c").to_pylist())):
            many[g] = many.get(g, 0) + c
            row.setdefault(g, i)
        rows = list(row.values())
        parts = [t.column("bytes")[i].as_py() for i in rows]
        split = [t.column("split")[i].as_py() for i in rows]
        windows = np.array([len(p) - length + 1 for p in parts])
        hit, first, x = repeated_windows(parts, windows, length)
        raw = x.tobytes()
        out: list[list] = [[], [], [], [], []]
        told: set = set()
        for k, g in enumerate(row):
            mask = hit[first[k] : first[k] + windows[k]]
            whole = many[g] > 1
            if whole:
                mask = np.ones(windows[k], bool)
            if mask.any():
                a, b = _runs(mask)
                for c, v in zip(out, (g, a, b, None, None)):
                    c.append(v)
            if split[k]:  # other shards hold segments of this anchor: tell them this one's windows, each once
                for o in range(int(windows[k])):
                    w = xxh3_128_digest(raw[first[k] + o : first[k] + o + length])
                    if w not in told:
                        told.add(w)
                        for c, v in zip(out, (g, None, None, w, -1 if mask[o] else o)):
                            c.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32()))], names=["g", "a", "b", "w", "o"])

    return scan


def _merge_windows(t: pa.Table) -> pa.Table:
    """Windows of one range of keys that only another shard repeats, by binary search in the sorted keys of all."""
    key = np.frombuffer(b"".join(t.column("w").to_pylist()), "S16")
    everyone = np.sort(key)
    open_ = np.flatnonzero(t.column("o").to_numpy() >= 0)  # a shard has such a window once
    many = np.searchsorted(everyone, key[open_], "right") - np.searchsorted(everyone, key[open_], "left")
    hit = open_[many > 1]
    o = t.column("o").take(pa.array(hit)).to_numpy()
    return pa.table({"g": t.column("g").take(pa.array(hit)), "a": pa.array(o, pa.int32()), "b": pa.array(o + 1, pa.int32())})


def _with(work, known, number: int, batches):
    return work(batches, known, number)


def repeated_spans(docs: DataFrame, length: int = 200, shard_rows: int = 8000, most_hot: int = 4_000_000, text_col: str = "text", filter_bits: int = 1 << 29) -> DataFrame:
    """``(t, spans)``: per text with repeats, ``t`` the SHA-256 of its bytes, the spans ``struct(a, b)`` of windows that repeat."""
    from xxhash import xxh3_128_digest

    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length)

    def anchors(batches):
        """Per anchor of a portion: how often it occurs, and in how many kinds of segments."""
        for keys, counts, raw in _portions(batches):
            _, _, (text, _, _, h, kind) = _cut(raw, length)
            order = np.lexsort((kind, h))
            h, kind, c = h[order], kind[order], np.array(counts, np.int64)[text][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            new = np.concatenate([[1], ((kind[1:] != kind[:-1]) | (h[1:] != h[:-1])).astype(np.int64)]) if len(h) else c
            if first.size:
                yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(c, first)), pa.array(np.add.reduceat(new, first))], names=["h", "c", "d"])

    often = settle(texts.mapInArrow(anchors, "h long, c long, d long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).where("c > 1"))
    kinds, total = often.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    passes = max(1, -(-16 * kinds // filter_bits))
    filter_ = Bloom(-(-kinds // passes), filter_bits)
    only = sc.broadcast(filter_.build(often, "h")) if passes == 1 else None
    # anchors of many different segments are dealt to several shards; there are at most total / limit of them, ``most_hot``
    limit = max(shard_rows // 4, total // most_hot)
    wide = often.where(F.col("d") > limit).select("h", F.ceil(F.col("d") / limit).cast("int").alias("n")).orderBy("h").toArrow()
    hot = sc.broadcast((wide.column(0).to_numpy(), wide.column(1).to_numpy()))
    shards = max(1, -(-total // shard_rows))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16))

    def suspects(batches, each, known, number):
        bitmap = np.frombuffer(known.value, np.uint8)
        for keys, counts, raw in _portions(batches):
            blob, ends, (text, first, many, h, _) = _cut(raw, length)
            ok = np.flatnonzero(filter_.holds(bitmap, h) & ((h >> np.uint64(13)) % np.uint64(passes) == number))
            if ok.size:
                begin = ends - np.array([len(b) for b in raw])
                yield from each(keys, counts, blob, begin, text[ok], first[ok], many[ok], h[ok].view(np.int64))

    def send(batches, *which):
        def each(keys, counts, blob, begin, text, first, many, h):
            held: dict = {}
            for t, s, n, a in zip(text.tolist(), first.tolist(), many.tolist(), h.tolist()):
                part = blob[s : s + n + length - 1]
                g = xxh3_128_digest(part)
                if g in held:
                    held[g][1] += counts[t]
                else:
                    held[g] = [a, counts[t], part]
            names, salts = hot.value
            own = np.array([a for a, _, _ in held.values()], np.int64)
            at = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
            split = names[at] == own if len(names) else np.zeros(len(own), bool)
            dealt = np.where(split, salts[at], 1) if len(names) else np.ones(len(own), np.int64)
            rows = [(a, int.from_bytes(g[:4], "big") % n, s, g, c, p) for (g, (a, c, p)), n, s in zip(held.items(), dealt.tolist(), split.tolist())]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()))], names=["h", "salt", "split", "g", "c", "bytes"])

        return suspects(batches, each, *which)

    def over_texts(work, schema: str) -> DataFrame:
        """The rows of all passes; those of several are written, a pass after the other."""
        if only:
            return texts.mapInArrow(functools.partial(_with, work, only, 0), schema)
        path = new_table(docs.sparkSession)
        for number in range(passes):
            part = F.pmod(F.shiftrightunsigned("h", 13), F.lit(passes)) == number
            known = sc.broadcast(filter_.build(often.where(part), "h"))
            append(texts.mapInArrow(functools.partial(_with, work, known, number), schema), path)
            known.destroy()
        return docs.sparkSession.read.schema(schema).parquet(path)

    sent = over_texts(send, "h long, salt long, split boolean, g binary, c long, bytes binary").withColumn("shard", F.pmod(F.xxhash64("h", "salt"), F.lit(shards)))
    found = settle(sent.repartition(tasks, "shard").groupBy("shard").applyInArrow(_scan_shard(length), _FOUND))
    local = found.where("a is not null").select("g", F.explode(F.arrays_zip("a", "b")).alias("s")).select("g", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    # windows of frequent anchors: those that another shard holds, too
    told = found.where("w is not null").select("w", "g", "o")
    ranges = max(1, -(-told.count() // 200_000))
    prefix = F.conv(F.hex(F.substring("w", 1, 4)), 16, 10).cast("long")
    across = told.withColumn("_r", F.floor(prefix * ranges / 2**32)).groupBy("_r").applyInArrow(_merge_windows, "g binary, a int, b int")

    def refer(batches, *which):
        def each(keys, counts, blob, begin, text, first, many, h):
            gs = [xxh3_128_digest(blob[s : s + n + length - 1]) for s, n in zip(first.tolist(), many.tolist())]
            yield pa.record_batch([pa.array(gs, pa.binary()), pa.array([keys[t] for t in text.tolist()], pa.binary()), pa.array(first - begin[text])], names=["g", "t", "s"])

        return suspects(batches, each, *which)

    places = over_texts(refer, "g binary, t binary, s long")
    spans = places.join(local.unionAll(across), "g").select("t", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") - 1 + length).alias("b")).distinct()
    return spans.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, shard_rows: int = 8000, most_hot: int = 4_000_000, hot_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 29) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row; ``kept`` are the remaining bytes.

    ``most_hot``: the most anchors whose segments are dealt to several shards, 12 bytes of a broadcast each. Spans of texts
    that more than ``hot_rows`` rows hold, and more than one row in 10,000, are broadcast. ``filter_bits``: size of the
    filter of anchors; one with more than a sixteenth as many anchors is dealt out over several passes.
    """
    spans = settle(repeated_spans(docs, length, shard_rows, most_hot, text_col, filter_bits))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("t", F.unhex(F.sha2("text", 256)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            out = []
            for i, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw, kept, at, gone, runs = t.as_py(), [], 0, 0, 0
                reached = -1
                for s in sorted((s["a"], s["b"]) for s in own or ()):
                    if s[0] > reached:
                        kept.append(raw[at : s[0]])
                        runs += 1
                        at = s[0]
                    if s[1] > at:
                        gone += s[1] - at
                        at = s[1]
                    reached = max(reached, s[1])
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((i, len(raw), gone, runs, hashlib.sha256(left).hexdigest(), left))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    total = docs.count()
    limit = max(hot_rows, total // 10_000)
    met = rows.join(spans, "t", "left")
    if total > limit:
        hot = settle(rows.groupBy("t").count().where(F.col("count") > limit).select("t").join(spans, "t", "left"))
        if hot.head(1):
            met = rows.join(F.broadcast(hot.select("t")), "t", "left_anti").join(spans, "t", "left").unionByName(rows.join(F.broadcast(hot), "t"))
    return met.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
