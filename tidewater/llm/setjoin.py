"""Links between texts, confirmed on whole sets of word shingles.

Candidate pairs say which texts may be alike; what they connect is a candidate component, and a
link that any candidate stands for lies inside one. Every component's sets meet in one task, where
rows are compared one after the other with those that no confirmed link has joined to them yet;
only a spanning forest of the confirmed links leaves the task, so a dense group gives as many
links as it has rows and never all its pairs. Components of more than ``most_tokens`` shingles
are not brought together: the candidates themselves are confirmed pair by pair first, and then
pieces of what the largest confirmed part left out meet bounded blocks of the component.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, settle
from .stars import connected

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Minwise values of a signature, one byte each.
COORDINATES = 128
_RNG = np.random.default_rng(20240311)
_XOR, _ODD = _RNG.integers(0, 2**64, (2, COORDINATES), dtype=np.uint64)
_ODD |= np.uint64(1)
_MIX = tuple(np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Words(dict):
    """Hashes of the words of a task, as many as ``most``."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 42)
        return h


def shingle_hashes(text: str | None, words: int, known: _Words | None = None) -> np.ndarray:
    """The different hashes of a text's ``words``-word shingles, sorted; with fewer words, that of the whole sequence."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.empty(0, np.uint64)
    known = _Words() if known is None else known
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out + h[k : len(h) - width + 1 + k]) * _MIX[k % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX[1] ^ (out >> np.uint64(31)))


def minima(tokens: np.ndarray, step: int = 4096) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(tokens), step):
        np.minimum(low, ((tokens[None, at : at + step] ^ _XOR[:, None]) * _ODD[:, None]).min(1), out=low)
    return low


def signature(low: np.ndarray) -> bytes:
    """One byte of each least value: two sets agree on a byte as often as they are alike, or once in 256 by chance."""
    return (low & np.uint64(255)).astype(np.uint8).tobytes()


def lanes(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, COORDINATES // 8)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of two signatures differ, both given as rows of 64-bit lanes."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = a ^ b
    x |= (x & low) + low
    x &= ~low
    return np.bitwise_count(x).sum(-1, dtype=np.int32)


def most_unlike(similarity: float, errors: float = 4.75) -> int:
    """Differing bytes up to which a pair may be as similar as ``similarity``, give or take ``errors`` standard errors."""
    return int(COORDINATES * (1 - similarity) + errors * (COORDINATES * similarity * (1 - similarity)) ** 0.5)


def similar(common, a, b, percent: int):
    """Whether two sets of ``a`` and ``b`` tokens are as similar as ``percent`` in whole numbers."""
    return 100 * common >= percent * (a + b - common)


def confirmed(sets: list[np.ndarray], label: np.ndarray, percent: int, main: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of different labels.

    Each row meets the later ones that have another label by then, might be alike by size and signature, and,
    if ``main`` is given, at least one of the two has another label than ``main`` at the outset.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    far = most_unlike(percent / 100)
    sig = lanes([signature(minima(s)) for s in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [token[e - s : e] for s, e in zip(sizes, ends)]
    mark = np.zeros(int(token.max()) + 1 if len(token) else 0, bool)
    label, first, links = label.copy(), label.copy(), []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)]
        if main is not None and first[i] == main:
            rest = rest[first[rest] != main]
        rest = rest[unlike(sig[rest], sig[i]) <= far]
        if not len(rest):
            continue
        mark[own[i]] = True
        for j in rest.tolist():
            if label[j] != label[i] and similar(np.count_nonzero(mark[own[j]]), sizes[i], sizes[j], percent):
                links.append((i, j))
                label[label == label[j]] = label[i]
        mark[own[i]] = False
    return links


def _in_groups(percent: int):
    """mapInArrow function over rows ``(grp, node, label, main, tokens)`` sorted by ``grp``: links of every group."""

    def decide(held: list[tuple]):
        node, label, main, raw = zip(*held)
        if len(set(node)) < 2 or len(set(label)) < 2:
            return
        number = {v: k for k, v in enumerate(dict.fromkeys(label))}
        sets = [np.frombuffer(t, np.uint64) for t in raw]
        links = confirmed(sets, np.array([number[v] for v in label]), percent, number.get(main[0], -1) if main[0] is not None else None)
        if links:
            a, b = (np.array([node[k] for k in side]) for side in zip(*links))
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held, now = [], None
        for b in batches:
            for grp, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and grp != now:
                    yield from decide(held)
                    held = []
                now = grp
                held.append(row)
        if held:
            yield from decide(held)

    return run


def _token_sets(words: int, piece: int = 64):
    """mapInArrow function: ``(node, root, text)`` to ``(node, root, tokens)``."""

    def run(batches):
        known = _Words()
        for b in batches:
            for at in range(0, b.num_rows, piece):
                part = b.slice(at, piece)
                sets = [shingle_hashes(t.as_py(), words, known).tobytes() for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "root", "tokens"])

    return run


def _grouped(rows: DataFrame, percent: int, most_tokens: int) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 8
    tasks = max(1, -(-total // most_tokens), rows.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.select("grp", "node", "label", "main", "tokens").repartition(tasks, "grp").sortWithinPartitions("grp", "node")
    return ordered.mapInArrow(_in_groups(percent), "a long, b long")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: Column, text_col: str, words: int, percent: int, most_tokens: int = 4_000_000) -> DataFrame:
    """``(a, b)``: confirmed links that connect all that confirmed links between the texts of a candidate component do.

    ``pairs(a, b)`` are candidates; ``nodes(node, row)`` names a row of ``docs`` for each node, whose ``key`` it is.
    """
    pairs = settle(pairs.where("a <> b").distinct())
    placed = settle(connected(pairs))  # every node of a pair but the roots
    roots = placed.select(F.col("root").alias("node"), "root").distinct()
    members = settle(placed.where("node <> root").unionByName(roots).join(nodes.select("node", "row"), "node"))
    wanted = members.select(F.col("row").alias("_row"), "node", "root")
    if members.count() <= 500_000:  # rows of four numbers
        wanted = F.broadcast(wanted)
    texts = docs.select(key.alias("_row"), F.col(text_col).cast("string").alias("_text")).join(wanted, "_row").groupBy("node", "root").agg(F.first("_text").alias("_text"))
    sets = settle(texts.mapInArrow(_token_sets(words), "node long, root long, tokens binary"))
    sizes = settle(sets.groupBy("root").agg(F.sum(F.octet_length("tokens") / 8).cast("long").alias("_tokens"), F.count("*").alias("_rows")).where(F.col("_tokens") > most_tokens))
    plain = lambda c: sets.select(c.alias("grp"), "node", F.col("node").alias("label"), F.lit(None).cast("long").alias("main"), "tokens")
    if not sizes.head(1):
        return settle(_grouped(plain(F.col("root")), percent, most_tokens))
    hot = sets.join(F.broadcast(sizes), "root")
    done = settle(_grouped(sets.join(F.broadcast(sizes.select("root")), "root", "left_anti").select(F.col("root").alias("grp"), "node", F.col("node").alias("label"), F.lit(None).cast("long").alias("main"), "tokens"), percent, most_tokens))
    first = settle(_by_pairs(pairs.join(hot.select(F.col("node").alias("a")), "a", "left_semi"), sets, percent))
    label = connected(first)
    held = settle(hot.join(label.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    largest = held.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = _grouped(_pieces(held.join(F.broadcast(settle(largest)), "root"), most_tokens), percent, most_tokens)
    return settle(done.unionAll(first).unionAll(rest))


def _by_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that hold; the sets of nodes with very many pairs are broadcast."""

    @F.pandas_udf("boolean")
    def hold(x, y):
        def one(p, q):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            return bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))

        return x.combine(y, one).astype(bool)

    counts = pairs.groupBy("a").agg(F.count("*").alias("_many"))
    left = settle(counts.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("_x")), "a"))
    both = join_hot(pairs, left, "a", "_many", pairs.count()).join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("_y")), "b")
    return both.where(hold("_x", "_y")).select("a", "b")


def _pieces(held: DataFrame, most_tokens: int) -> DataFrame:
    """Rows of hot components in groups of bounded size: blocks of all rows, each with every piece of those outside the main part."""
    many = F.ceil(F.col("_tokens") * 2 / most_tokens).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(5)), many)
    apart = held.where("label <> main")
    pieces = settle(apart.withColumn("_p", own).groupBy("root").agg(F.collect_set("_p").alias("_ps")))  # small numbers
    rows = held.join(F.broadcast(pieces), "root").withColumn("_b", own)
    # a row of the rest goes as a piece to all blocks, and every row as part of its block to all pieces
    as_block = rows.withColumn("_k", F.explode("_ps")).withColumn("grp", F.xxhash64("root", "_k", "_b"))
    as_piece = rows.where("label <> main").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).where("_k <> _b").withColumn("grp", F.xxhash64("root", "_b", "_k"))
    out = ["grp", "node", "label", "main", "tokens"]
    return as_block.select(*out).unionAll(as_piece.select(*out))
