"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens.

A document is the set of its word shingles, embedded as one minwise token for each of 128 hash
functions. A tree branches documents: a node selects ``branches`` of the functions, unused on the
path to it, and each document goes to the children named by its tokens there. Two documents of
similarity s share a child with chance s, so that of ``branches`` = 3 at least one is shared with
1 - (1 - s)^3, at every level: a pair at 0.85 is met by a tree with a chance above 0.996, however
deep it grows, and ``trees`` = 3 independent ones miss fewer than one pair in 10^6. A node is
compared exhaustively when it is small, and also where branching would not shrink it. Nodes of
many rows are branched by Spark, level by level; what does not shrink is dealt in pairs of blocks.
Rows close to a node's first row are candidates through it and not compared with each other.

Comparison is by signatures of one byte a token, 4.75 standard errors below the threshold; all
links are then confirmed on full sets (:mod:`.setjoin`), which also finds those that a candidate
stood for. Documents of equal sets are one node from the outset, so exact copies cost nothing.

Null and empty texts, and texts without words, have an empty set and are linked with nothing, not
even with each other. Null ids are passed through: the smallest id of a group is over those that
are not null, and a row is kept if its id is the group's. Repeated rows are in one group and all
kept or all not. An empty table gives an empty result. Other columns of the table play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import COORDINATES, _Words, confirm, lanes, minima, most_unlike, shingle_hashes, signature, unlike
from .shared import join_hot, settle
from .simhash import Links, _block_pairs
from .stars import connected

_GOLD = 0x9E3779B97F4A7C15
_ALL = 2**64 - 1


def _mixed(*parts: int) -> int:
    """A 64-bit hash of numbers."""
    h = 0x243F6A8885A308D3
    for p in parts:
        h = ((h ^ (int(p) & _ALL)) * _GOLD) & _ALL
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _ALL
        h ^= h >> 29
    return h


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def selected(path: int, used: tuple[int, ...], branches: int) -> list[int]:
    """The functions that a node selects, none of them used before on its path."""
    free = sorted(set(range(COORDINATES)) - set(used), key=lambda j: _mixed(path, j))
    return free[:branches]


def roots(trees: int, branches: int) -> list[list[int]]:
    """The functions of every tree's first level, all different."""
    order = sorted(range(COORDINATES), key=lambda j: _mixed(17, j))
    return [order[t * branches : (t + 1) * branches] for t in range(trees)]


def with_sets(docs: DataFrame, words: int, trees: int, branches: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, n_shingles, digest, sig, keys)``: the set's size and 128-bit hash, its signature, and its nodes of the first level."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])
    first = [(t, j) for t, own in enumerate(roots(trees, branches)) for j in own]

    def one(text, known):
        from xxhash import xxh3_128_digest

        tokens = shingle_hashes(text, words, known)
        if not len(tokens):
            return 0, b"", b"", []
        low = minima(tokens)
        return len(tokens), xxh3_128_digest(tokens.tobytes()), signature(low), [_signed(_mixed(t, j, low[j])) for t, j in first]

    def run(batches):
        known = _Words()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                size, digest, sig, keys = zip(*(one(t.as_py(), known) for t in part.column(1)))
                columns = [part.column(0), part.column(2), part.column(3), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, schema=schema)

    key = text_key(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key["h"].alias("h"), key["c"].alias("c"))
    flat = rows.mapInArrow(run, "doc_id long, h long, c long, n_shingles long, digest binary, sig binary, keys array<long>")
    return flat.select("doc_id", F.struct("h", "c").alias("row"), "n_shingles", "digest", "sig", "keys")


def text_key(text_col: str):
    """Tells texts apart by 128 bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("text"), text).alias("c"))


def _all_pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, far: int, out: Links, step: int = 200_000) -> None:
    """Candidates of every row of ``a`` with every one of ``b``, or with the later ones of ``a``."""
    for k in range(0, len(a), most := max(1, step // max(1, len(a if b is None else b)))):
        left = a[k : k + most]
        right = a[k + 1 :] if b is None else b
        d = unlike(x[left][:, None], x[right][None])
        near = d <= far
        if b is None:
            near &= np.arange(len(left))[:, None] <= np.arange(len(right))[None]
        i, j = np.nonzero(near)
        out.add(left[i], right[j], d[i, j])


def search(x: np.ndarray, rows: np.ndarray, path: int, far: int, out: Links, branches: int = 3, used: tuple[int, ...] = (), leaf: int = 48) -> None:
    """Candidates among ``rows``, branched by the bytes of their signatures ``x``."""
    raw = x.view(np.uint8).reshape(len(x), -1)
    todo = [(rows, path, used)]
    while todo:
        rows, path, used = todo.pop()
        n = len(rows)
        if n <= leaf:
            _all_pairs(x, rows, None, far, out)
            continue
        d = unlike(x[rows], x[rows[0]])
        close = d <= far
        if 8 * np.count_nonzero(close) >= n:
            # dense: its rows are candidates through the first; by the triangle bound others further off than twice ``far`` are near none of them
            own, others = rows[close], rows[~close]
            out.add(own[1:], np.full(len(own) - 1, rows[0]), d[close][1:])
            _all_pairs(x, own, others[d[~close] <= 2 * far], far, out)
            if len(others) > 1:
                todo.append((others, _mixed(path, 1), used))
            continue
        chosen = selected(path, used, branches)
        parts = []
        for j in chosen:
            value = raw[rows, j]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            parts += [(p, j, int(value[p0])) for p, p0 in ((rows[s], s[0]) for s in np.split(order, cuts)) if len(p) > 1]
        if len(chosen) < branches or sum(len(p) ** 2 for p, _, _ in parts) >= n * n // 2:
            _all_pairs(x, rows, None, far, out)
        else:
            todo += [(p, _mixed(path, j, v), (*used, j)) for p, j, v in parts]


def _split(members: DataFrame, nodes: DataFrame, most: int, branches: int, used: tuple[int, ...], levels: int = 3) -> DataFrame:
    """Nodes of more than ``most`` rows are branched once more by Spark; those that grow by it are dealt in pairs of blocks."""
    done, before = None, None
    for level in range(levels + 1):
        sizes = settle(members.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1"))
        big = settle(sizes.where(F.col("_size") > most))
        held = big.agg(F.sum("_size")).first()[0]
        if not held:
            small = members.join(sizes.select("key"), "key", "left_semi")
            return small if done is None else done.unionByName(small)
        small = members.join(F.broadcast(big.select("key")), "key", "left_anti").join(sizes.select("key"), "key", "left_semi")
        rows = members.join(F.broadcast(big), "key")
        done = small if done is None else done.unionByName(small)
        if level == levels or (before and held >= before):
            return done.unionByName(rows.withColumn("key", F.explode(_block_pairs(most))).drop("_size"))
        before = held
        deeper = rows.join(nodes.select("node", "sig"), "node")

        @F.pandas_udf("array<long>")
        def children(key, sig):
            return pd.Series([[_signed(_mixed(k, j, s[j])) for j in selected(k & _ALL, used, branches)] for k, s in zip(key, sig)])

        members = settle(deeper.withColumn("key", F.explode(children("key", "sig"))).select("key", "node"))
    raise AssertionError


def candidates(nodes: DataFrame, percent: int, trees: int, branches: int, most: int, shard_rows: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the candidate pairs of every shard of tree nodes; ``nodes(node, sig, keys)``."""
    far, used = most_unlike(percent / 100), tuple(j for own in roots(trees, branches) for j in own)
    members = settle(nodes.select(F.explode("keys").alias("key"), "node"))
    members = settle(_split(members, nodes, most, branches, used))
    tasks = max(1, -(-members.count() // shard_rows))
    dealt = members.join(nodes.select("node", "sig"), "node").withColumn("_g", F.pmod(F.xxhash64("key"), F.lit(tasks)))

    def compare(t: pa.Table) -> pa.Table:
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, key))
        key, node, x = key[order], node[order], lanes(t.column("sig").to_pylist())[order]
        # a document of several tree nodes is one row of the forest
        first, place = np.unique(node, return_inverse=True)
        found = Links(len(key))
        for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            if len(rows) > 1:
                search(x, rows, int(key[rows[0]]) & _ALL, far, found, branches, used)
        a, b, d = found.shrink()
        forest = Links(len(first))
        forest.add(place[a], place[b], d)
        a, b, _ = forest.shrink()
        return pa.table({"a": first[np.minimum(a, b)], "b": first[np.maximum(a, b)]})

    return dealt.groupBy("_g").applyInArrow(compare, "a long, b long")


def group_documents(
    docs: DataFrame, words: int = 3, percent: int = 85, trees: int = 3, branches: int = 3, most_rows: int = 20_000, shard_rows: int = 20_000, most_tokens: int = 4_000_000, hot_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    ``percent``: least similarity of a link; ``most_rows``: rows of a tree node in one task; ``most_tokens``: shingles
    of a group of full sets in one task; ``hot_rows``: rows of one set or group that are joined without a shuffle.
    """
    marked = settle(with_sets(docs, words, trees, branches, id_col, text_col))
    full = marked.where("n_shingles > 0")
    same = full.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = settle(same.withColumn("node", F.monotonically_increasing_id()))
    found = candidates(nodes.select("node", "sig", "keys"), percent, trees, branches, most_rows, shard_rows)
    links = confirm(found, nodes.select("node", "row"), docs, text_key(text_col), text_col, words, percent, most_tokens)
    different, total = nodes.agg(F.count("*"), F.sum("copies")).first()
    placed = settle(nodes.select("digest", "first_id", "copies", "node").join(connected(links), "node", "left").select("digest", "first_id", "copies", F.coalesce("root", "node").alias("root")))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_members"))
    known = settle(join_hot(placed, named, "root", "_members", different, least=hot_rows).select("digest", "copies", "component_id"))
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_hot(full.select("doc_id", "n_shingles", "digest"), known, "digest", "copies", total or 0, least=hot_rows).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
