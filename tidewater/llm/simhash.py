"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

A document's fingerprint holds, bit by bit, the majority over the hashes of its word
shingles. Two fingerprints link when at most ``radius`` bits differ; a group is what links
reach. Exact copies share a fingerprint, so that all work below is on distinct ones.

Search. A single vantage point tells little about scattered fingerprints, whose distances
all lie near half the width. So the outermost level deals fingerprints by bands of bits: of
``radius + m`` bands a linked pair agrees on m at least (distance 0 there, hence no
boundary), and the cells of every choice of m bands are the shards of that level; m and the
bits that count of a band grow with the number of fingerprints, so that cells do not: they
hold about a thousand scattered fingerprints, of whose pairs a tree prunes half. Shards above ``most_rows`` are
split by Spark around a vantage point: fingerprints within the median distance go inside,
the others outside, and those of the inside that the triangle inequality cannot part from
the outside go to both. What no vantage point parts any more is dealt in pairs of blocks.
Inside a shard, a vantage-point tree orders fingerprints by distance and compares, across
each boundary, only pairs that the triangle inequality leaves; only a spanning forest of
the links leaves the task. Components are joined by alternating large and small stars, each
round written to the shared folder.

A text that is null or has no words has fingerprint zero and links like any other. Null ids
are passed through; a group of null ids alone has a null component. Repeated rows are in one
group. An empty table gives an empty result. Columns of the table keep their names and values,
whatever they are called.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, join_hot, settle
from .stars import connected

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = 4, lanes: int = 1, seed: int = 42) -> bytes:
    """Majority bits over the hashes of ``words``-word shingles; 8 bytes a lane, the lanes after the first by mixing its hashes."""
    from xxhash import xxh64_intdigest

    shingles = _shingles(text, words)
    if not shingles:
        return bytes(8 * lanes)
    h, out = np.array([xxh64_intdigest(s, seed) for s in shingles], np.uint64), b""
    for lane in range(lanes):
        if lane:
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones = sum(np.unpackbits(raw[at : at + 65536], axis=1).sum(0, dtype=np.int64) for at in range(0, len(raw), 65536))
        out += np.packbits(2 * ones > len(shingles)).tobytes()
    return out


def _shingles(text: str | None, words: int) -> list[bytes]:
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def with_fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp binary)`` for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words, lanes) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp binary")


def _lanes(fps: list[bytes] | pa.Array, width: int) -> np.ndarray:
    raw = b"".join(fps.to_pylist() if isinstance(fps, pa.Array | pa.ChunkedArray) else fps)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, width // 8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as rows of 64-bit lanes."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Links:
    """Pairs of rows of which only a spanning forest of the closest is held: never all pairs of a dense group."""

    def __init__(self, rows: int, most: int = 500_000):
        self.rows, self.most, self.held, self.count = rows, max(most, 2 * rows), [], 0
        self.possible = self.compared = 0  # pairs of a shard, and distances that were computed

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b, d))
            self.count += len(a)
            if self.count > self.most:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every component takes its closest pair to another one, until none is left (Boruvka)."""
        if not self.held:
            return (np.empty(0, np.int64),) * 3
        a, b, d = (np.concatenate(c) for c in zip(*self.held))
        order = np.argsort(d, kind="stable")
        a, b, d = a[order], b[order], d[order]
        label, chosen = np.arange(self.rows), []
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, d, la, lb = a[apart], b[apart], d[apart], la[apart], lb[apart]
            if not len(a):
                break
            pick = np.unique(np.unique(np.stack([la, lb], 1).ravel(), return_index=True)[1] // 2)
            chosen.append((a[pick], b[pick], d[pick]))
            label = _forest(self.rows, la[pick], lb[pick])[label]
        self.held = [tuple(np.concatenate(c) for c in zip(*chosen))]
        self.count = len(self.held[0][0])
        return self.held[0]


def _pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, r: int, out: Links) -> None:
    """Links of every a[i] with b[lo[i]:hi[i]], in portions of a bounded number of pairs."""
    many = np.maximum(hi - lo, 0)
    total = np.concatenate([[0], np.cumsum(many)])
    out.compared += int(total[-1])
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, total[at] + 250_000, "right")) - 1)
        left = np.repeat(np.arange(at, end), many[at:end])
        right = lo[left] + np.arange(len(left)) - (total[left] - total[at])
        i, j = a[left], b[right]
        d = distance(x[i], x[j])
        near = d <= r
        out.add(i[near], j[near], d[near])
        at = end


def vp_pairs(x: np.ndarray, rows: np.ndarray, r: int, out: Links, close: int | None = None, leaf: int = 16) -> None:
    """Links of ``rows`` at distance ``r`` or less, by a vantage-point tree.

    A node's rows are ordered by their distance from its vantage point. Those inside the median go one
    way, the others the other way, and only pairs across whose distances differ by ``r`` or less, as the
    triangle inequality asks, are compared. Where many rows lie within ``close`` (or ``r``) of the vantage
    point, they are linked through it and not compared with each other.
    """
    close = r if close is None else close
    out.possible += len(rows) * (len(rows) - 1) // 2
    todo = [rows]
    while todo:
        rows = todo.pop()
        n = len(rows)
        if n <= leaf:
            if n > 1:
                _pairs(x, rows, rows, np.arange(1, n + 1), np.full(n, n), r, out)
            continue
        vantage = rows[n // 2]
        d = distance(x[rows], x[vantage])
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        out.compared += n
        within = int(np.searchsorted(d, close, "right"))
        if 8 * within >= n:
            own = rows[:within]
            keep = own != vantage
            out.add(own[keep], np.full(keep.sum(), vantage), d[:within][keep])
            cut = within
        else:
            cut = int(np.searchsorted(d, np.median(d), "right"))
            if cut == n:
                cut = int(np.searchsorted(d, d[-1], "left"))
            if not 0 < cut < n:  # all as far from the vantage point
                _pairs(x, rows, rows, np.arange(1, n + 1), np.full(n, n), r, out)
                continue
            todo.append(rows[:cut])
        todo.append(rows[cut:])
        near = int(np.searchsorted(d[:cut], d[cut] - r, "left")) if cut < n else cut
        _pairs(x, rows[near:cut], rows[cut:], np.zeros(cut - near, np.int64), np.searchsorted(d[cut:], d[near:cut] + r, "right"), r, out)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
        # hook the roots, too, so that whole trees merge
        np.minimum.at(label, np.maximum(label[a[open_]], label[b[open_]]), np.minimum(label[a[open_]], label[b[open_]]))
        label = label[label]
    return label


def spread_bands(rows: int, bits: int, radius: int, most: int = 1024) -> list[list[tuple[int, int]]]:
    """Sets of bands, on one of which any two fingerprints within ``radius`` agree.

    Of ``radius + m`` bands a linked pair agrees on m at least; the sets are all choices of m. m is the
    least (up to 4) for which ``rows`` scattered fingerprints can leave at most ``most`` in a cell, and of each
    band no more bits count than that takes, so that cells are large enough for trees to prune. Up to
    ``most`` rows are one cell.
    """
    for m in range(1, 5):
        cuts = np.linspace(0, bits, radius + m + 1).astype(int).tolist()
        bands = list(itertools.pairwise(cuts))
        held = min(b - a for a, b in bands) * m
        if m == 4 or rows <= most << held:
            width = math.ceil(math.log2(max(1, rows / max(1, most))) / m)
            if not width:
                return [[(0, 0)]]
            return [[(a, min(b, a + width)) for a, b in c] for c in itertools.combinations(bands, m)]
    raise AssertionError


def _shard_keys(width: int, bands: list[list[tuple[int, int]]]):
    """mapInArrow function: one row per fingerprint and set of bands, ``(key, node, fp)``."""
    columns = [np.concatenate([np.arange(lo, hi) for lo, hi in own]) for own in bands]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fps, nodes = b.column("fp"), b.column("node")
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, width), axis=1)
            for k, own in enumerate(columns):
                value = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))
                yield pa.record_batch([pa.array((value << 10) | k), nodes, fps], names=["key", "node", "fp"])

    return run


def _block_pairs(most: int):
    """Keys of the pairs of blocks that hold a row of a shard of ``_size`` rows."""
    n = F.ceil(F.col("_size") * 2 / most)
    own = F.pmod(F.xxhash64("node", F.lit(77)), n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j), F.lit("block")))


def _refine(members: DataFrame, width: int, r: int, most: int, levels: int = 10) -> DataFrame:
    """Splits shards of more than ``most`` rows around vantage points, with the boundary on both sides."""

    @F.pandas_udf("int")
    def apart(a, b):
        return pd.Series(distance(_lanes(a.tolist(), width), _lanes(b.tolist(), width)), dtype="int32")

    done, last = None, None
    for level in range(levels + 1):
        sizes = members.groupBy("key").agg(F.count("*").alias("_size"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("_v")).where(F.col("_size") > most)
        sizes = settle(sizes)
        worst = sizes.agg(F.max("_size")).first()[0]
        if worst is None:
            return members if done is None else done.unionByName(members)
        small = members.join(sizes.select("key"), "key", "left_anti")
        big = members.join(sizes, "key")
        done = small if done is None else done.unionByName(small)
        if level == levels or (last and worst > 0.9 * last):
            stuck = big.withColumn("key", F.explode(_block_pairs(most))).drop("_size", "_v")
            return done.unionByName(stuck)
        last = worst
        big = settle(big.withColumn("_d", apart("fp", "_v")))
        middle = big.groupBy("key").agg(F.percentile_approx("_d", 0.5).alias("_m"))
        sides = F.array_compact(F.array(F.when(F.col("_d") <= F.col("_m"), F.lit(0)), F.when(F.col("_d") > F.col("_m") - r, F.lit(1))))
        members = settle(big.join(middle, "key").withColumn("_side", F.explode(sides)).select(F.xxhash64("key", "_side", F.lit(level)).alias("key"), "node", "fp"))
    raise AssertionError


def _links(nodes: DataFrame, width: int, r: int, bands: list[list[tuple[int, int]]], most: int, shard_rows: int, close: int | None = None) -> DataFrame:
    """A spanning forest of the closest links found in every shard: ``(a, b)``."""
    members = settle(nodes.mapInArrow(_shard_keys(width, bands), "key long, node long, fp binary"))
    total = members.count()
    members = _refine(members, width, r, most)
    tasks = max(1, -(-total // shard_rows))

    def search(t: pa.Table) -> pa.Table:
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, key))
        key, node, x = key[order], node[order], _lanes(t.column("fp"), width)[order]
        out = Links(len(key))
        for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            if len(rows) > 1:
                vp_pairs(x, rows, r, out, close)
        a, b, _ = out.shrink()
        return pa.table({"a": node[a], "b": node[b]})

    dealt = members.withColumn("_g", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    return dealt.groupBy("_g").applyInArrow(search, "a long, b long")


def group_documents(docs: DataFrame, words: int = 4, radius: int = 4, lanes: int = 1, most_cell: int = 1024, most_rows: int = 8192, shard_rows: int = 16_384, hot_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row. No linked pair is lost, whatever the parameters.

    ``most_cell``: scattered fingerprints that share a cell, which sets the number of bands; ``most_rows``: rows
    of a shard before it is split around vantage points; ``hot_rows``: rows of one fingerprint or group that
    are joined without a shuffle.
    """
    marked = settle(with_fingerprints(docs, words, lanes, id_col, text_col))
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if lanes == 1 else F.xxhash64("fp")
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).withColumn("node", node))
    different, total = nodes.agg(F.count("*"), F.sum("copies")).first()
    bands = spread_bands(different, 64 * lanes, radius, most_cell)
    roots = connected(_links(nodes.select("node", "fp"), 8 * lanes, radius, bands, most_rows, shard_rows))
    placed = settle(nodes.join(roots, "node", "left").select("fp", "first_id", "copies", F.coalesce("root", "node").alias("root")))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_members"))
    known = settle(join_hot(placed, named, "root", "_members", different, least=hot_rows).select("fp", "copies", "component_id"))
    return join_hot(marked, known, "fp", "copies", total or 0, least=hot_rows).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def wide_bands(bits: int, bands: int, width: int) -> list[list[tuple[int, int]]]:
    """``bands`` spans of ``width`` bits each, dealt evenly over a ring of ``bits``."""
    out = []
    for k in range(bands):
        lo = k * bits // bands
        out.append([(lo, min(bits, lo + width)), *([(0, lo + width - bits)] if lo + width > bits else [])])
    return out


def drop_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, lanes: int = 4, radius: int = 54, close: int = 26, bands: int = 32, band_bits: int = 12, most_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group stays, that of the smallest id (and, among rows of one id, the smallest hash).

    Near means a similarity of ``percent`` or more in a hundred on ``words``-word shingles. At 0.8 the angle
    between two texts makes 15 % of 256 bits differ, 38 give or take 6, so links reach to 54; one of 32 bands of
    12 bits is met by such a pair with a chance of 0.99, by closer pairs with more. No link holds by its bits:
    links are candidates, and all texts that they connect are compared by their full sets of shingles
    (:mod:`.setjoin`), so that a candidate that fails loses none of the pairs it stood for.
    """
    from .setjoin import confirm

    key = F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("c"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row"))
    marked = settle(_row_marks(rows, words, lanes))
    nodes = settle(marked.groupBy("fp").agg(F.min("row").alias("row")).withColumn("node", F.monotonically_increasing_id()))
    found = _links(nodes.select("node", "fp"), 8 * lanes, radius, wide_bands(64 * lanes, bands, band_bits), 8192, 16_384, close)
    links = confirm(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), nodes.select("node", "row"), docs, key, text_col, words, percent, most_tokens)
    placed = nodes.select("node", "fp").join(connected(links), "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    grouped = marked.join(placed, "fp")
    h, c = free_name(docs, "_h"), free_name(docs, "_c")
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("m")).select(F.col("m.row.h").alias(h), F.col("m.row.c").alias(c))
    rows = docs.withColumns({h: key["h"], c: key["c"]})
    if marked.groupBy("row").count().where("count > 1").head(1):
        # rows repeated in full are alike: one of each leaves its task, so that no key is hot in the shuffle of texts
        rows = rows.dropDuplicates([h, c])
    return rows.join(best, [h, c], "left_semi").select(*docs.columns)


def _row_marks(rows: DataFrame, words: int, lanes: int) -> DataFrame:
    """``(doc_id, row, fp)`` from ``(doc_id, text, row struct<h, c>)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array([fingerprint(t.as_py(), words, lanes) for t in part.column(1)], pa.binary())], schema=schema)

    flat = rows.select("doc_id", "text", "row.h", "row.c").mapInArrow(run, "doc_id long, h long, c long, fp binary")
    return flat.select("doc_id", F.struct("h", "c").alias("row"), "fp")
