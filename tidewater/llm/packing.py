"""Packs documents into sequences of bounded length, certified by lower bounds.

Each document is tokenized, closed by one end id and, only if it is longer than a
sequence, cut. Groups of pieces are packed by best-fit decreasing; dual-feasible
functions give a lower bound on each group's sequences. A group whose count meets its
bound is proven best by itself. The others, and every group's poorly filled sequences,
exchange their pieces and are packed again, as long as that saves sequences and the
bound over all pieces is not reached.

A null text is an empty document: one piece holding the end id. Repeated rows are packed
each by itself, null ids included. An empty table gives an empty result. A text of any length
is tokenized whole, in one task. Columns other than id and text are not read, whatever they are called.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pretokens of the vocabulary ``word_bpe_49k.json`` (fixed by that file) in lower-cased text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters in which this file's pretokens and the tokenizer's are the same, whatever version of Unicode either follows:
#: Latin, Greek, Cyrillic and their marks, punctuation, currency, arrows and mathematics, Chinese, kana, Hangul, wide forms.
_OTHER = re.compile("[^\x00-\x1b\x20-\u0557\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff\u3000-\u33ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff60]")


def _usual(t: str) -> bool:
    """Whether all characters are usual ones; those of Latin-1 are, but for four."""
    try:
        if not t.isascii():
            t.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHER.search(t)
    return not any(x in t for x in "\x1c\x1d\x1e\x1f")


class CachedEncoder:
    """Ids as little-endian bytes, by way of a bounded cache from white-space-free strings.

    A pretoken never spans white space, so a text's ids are those of its strings in turn.
    Texts with special strings or other characters than the usual go to the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        # pretokens are in normal form already and are told apart by a space
        self.split = Tokenizer.from_file(path)
        self.split.normalizer = None
        self.split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.find = regex.compile(PRETOKEN).findall

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """Encodes unknown pretokens in one text; the last id of each carries the vocabulary's word end."""
        known, parts, fresh = self.known, [], set()
        for s in new:
            if s.isalpha():
                fresh.add(s)
                continue
            own = (s[:-1], s[-1]) if s[-1] in ".,;:!?" and s[:-1].isalpha() else self.find(s)
            parts.append((s, own))
            fresh.update(own)
        every = list(fresh.difference(known))
        for at in range(0, len(every), 4096):  # an encoding holds far more than its ids
            fresh = every[at : at + 4096]
            ids = np.array(self.split.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(fresh):
                known.update(zip(fresh, map(raw.__getitem__, map(slice, [0, *ends], ends))))
            else:
                known.update(zip(fresh, self.whole(fresh)))
        for s, own in parts:
            known[s] = b"".join([known[w] for w in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {}
        out: list = [None] * len(texts)
        plain, lowered = [], []
        for i, t in enumerate(texts):
            if "<|" in t and any(x in t for x in SPECIAL) or not _usual(t):
                out[i] = self.whole([t])[0]
                continue
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")  # the tokenizer lowers each character alone
            plain.append(i)
            lowered.append(t.lower())
        if not plain:
            return out
        # each different string of the portion is looked up once, all others are gathered by number
        strings = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        different = strings.flatten().dictionary_encode()
        names, number = different.dictionary.to_numpy(zero_copy_only=False).tolist(), different.indices.to_numpy()
        known = self.known
        self.learn({s for s in names if s and s not in known})
        known.setdefault("", b"")
        ids = [known[s] for s in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        many = sizes[number]
        ends = np.cumsum(many)
        found = pool[np.repeat(first[number] - (ends - many), many) + np.arange(int(many.sum()))]
        bounds = np.concatenate([[0], ends])[strings.offsets.to_numpy()].tolist()
        for i, a, b in zip(plain, bounds, bounds[1:]):
            out[i] = found[a:b].tobytes()
        return out


_encoders: dict[tuple[str, int], CachedEncoder] = {}


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", at_once: int = 2_000_000, cache: int = 600_000) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: one row a piece of at most ``capacity`` ids.

    ``at_once``: characters that are encoded together, and ``cache``: strings whose ids are kept, which bound a task's memory.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def portions(batch):
        held, chars = [], 0
        for i, t in zip(batch.column(0), batch.column(1)):
            t = t.as_py() or ""
            held.append((i.as_py(), t))
            chars += len(t)
            if chars > at_once:
                yield held
                held, chars = [], 0
        yield held

    def run(batches):
        encoder = _encoders.get((tokenizer_path, cache))
        if encoder is None:
            encoder = _encoders[tokenizer_path, cache] = CachedEncoder(tokenizer_path, cache)
        for batch in batches:
            for held in portions(batch):
                rows = []
                for (i, _), ids in zip(held, encoder.encode([t for _, t in held])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; ``counts[x]`` pieces have length x.

    Two families of dual-feasible functions: for each e, lengths above capacity - e count whole
    and those below e count nothing; for each k, lengths are rounded down to multiples of 1/k.
    """
    x = np.arange(capacity + 1)
    mass = counts * x
    number, load = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(mass)])
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = load[capacity - e + 1] - load[e]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, ((k + 1) * x // capacity) * capacity)  # times capacity * k
        best = max(best, math.ceil(int((counts * value).sum()) / (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece by best-fit decreasing, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            b, free, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - free
        if free > n:
            room[free - n].append(b)
            mask |= 1 << (free - n)
    return bins, offsets, made


def _packed(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Deals pieces into groups and packs each. Adds sequence_id, offset, free, made (1 on one row a sequence), gap (of the group)."""
    out = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long, made long, gap long"

    def pack(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        group = t.column("_g")[0].as_py()
        ids = (salt << 56) + (group << 28) + bins
        new = {"sequence_id": ids, "offset": offsets, "free": capacity - fill[bins], "made": (offsets == 0).astype(np.int64), "gap": np.full(len(ids), gap, np.int64)}
        t = t.drop_columns(["_g"])
        for k, v in new.items():
            t = t.append_column(k, pa.array(v))
        return t

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(groups)).cast("long"))
    return dealt.groupBy("_g").applyInArrow(pack, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = 16_384, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text", **encoding) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: one row a piece.

    ``group_pieces`` pieces are packed in one task on average, whatever the number of rows; ``encoding`` goes to :func:`tokenize_pieces`.
    """
    pieces = settle(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, **encoding).withColumn("rid", F.monotonically_increasing_id()))
    columns = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row a length, capacity at most
        histogram[r["length"]] = r["count"]
    needed, total = lower_bound(histogram, capacity), int(histogram.sum())
    best = settle(_packed(pieces.select(*columns), max(1, -(-total // group_pieces)), 0, capacity))
    for k in range(1, rounds + 1):
        # certified groups keep their well-filled sequences, groups with a gap all their full ones
        loose = (F.col("free") > capacity // 32) | ((F.col("gap") > 0) & (F.col("free") > 0))
        have, count, made = best.agg(F.sum("made"), F.count(F.when(loose, 1)), F.sum(F.when(loose, F.col("made")))).first()
        if not count or have <= needed:
            break
        again = settle(_packed(best.where(loose).select(*columns), max(1, -(-count // group_pieces)), k, capacity))
        if again.agg(F.sum("made")).first()[0] >= made:
            break
        best = settle(best.where(~loose).unionByName(again))
    return best.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
