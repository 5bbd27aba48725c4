"""Runs of repeated words: maximal periodic stretches, found by bit-parallel lags.

Words are numbered, and bit k of every word's number is one big integer, a plane, with a bit for
each place. For a lag q, XOR of a plane with itself shifted by q marks where words q apart differ
in that bit, and OR over the planes where they differ at all. A run of period q and length L is a
stretch of L - q zeros there; AND of the complement with its own shifts, the shift doubling each
time, leaves only the starts of stretches that are long enough. Planes are taken one after the
other, and a lag ends as soon as no stretch is left, after four or five planes as a rule.

Texts above ``direct`` words look at a lag's planes only if it has a chance: a run is three periods
long or longer, so it holds three neighbouring multiples of q with one word, none of them in a
longer run already known whose period divides q. That takes n / q steps a lag, n log n in all.

A null text or one without words has no run and nothing to collapse. Repeated rows give repeated
rows; a null id is passed through, and its words stand as they are. An empty table gives an
empty result; other columns play no part. A text is one row's work, whatever its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
Run = tuple[int, int, int]


def planes(codes: np.ndarray) -> list[int]:
    """The bits of ``codes`` as big integers, place i at bit i."""
    many = max(1, int(codes.max()).bit_length()) if len(codes) else 0
    return [int.from_bytes(np.packbits(((codes >> k) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(many)]


def long_stretches(ones: int, length: int) -> int:
    """Starts of ``length`` ones in a row."""
    have = 1
    while ones and have < length:
        step = min(have, length - have)
        ones &= ones >> step
        have += step
    return ones


def stretches(starts: int) -> list[tuple[int, int]]:
    """First and last place of each stretch of ones."""
    bits = np.unpackbits(np.frombuffer(starts.to_bytes((starts.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little").astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _may_repeat(codes: np.ndarray, q: int, runs: list[Run]) -> bool:
    """Whether three neighbouring multiples of ``q`` hold one word outside the known runs whose period divides q."""
    at = codes[::q]
    same = at[1:] == at[:-1]
    three = same[1:] & same[:-1]
    for s, length, p in runs:
        if q % p == 0:
            three[-(-s // q) : max(0, (s + length - 1) // q - 1)] = False
    return bool(three.any())


def find_runs(codes: np.ndarray, least: int = 24, times: int = 3, direct: int = 16_384) -> list[Run]:
    """``(start, length, period)`` of all runs of at least ``least`` words and ``times`` periods, by start, then period.

    A run's period is its smallest; it is maximal: one word more at either side would break it.
    """
    n = len(codes)
    bits = planes(codes)
    found: dict[tuple[int, int], int] = {}
    active: list[Run] = []
    for q in range(1, n // times + 1):
        if n > direct:
            active = [r for r in active if r[1] >= times * q]
            if not _may_repeat(codes, q, active):
                continue
        length = max(least, times * q) - q  # of zeros
        if length > n - q:
            continue
        differ, mask = 0, (1 << (n - q)) - 1
        starts = mask
        for k, plane in enumerate(bits):
            differ |= (plane ^ (plane >> q)) & mask
            if k >= 3 or k == len(bits) - 1:
                starts = long_stretches(differ ^ mask, length)
                if not starts:
                    break
        if not starts:
            continue
        for a, b in stretches(starts):
            run = (a, b - a + length + q)
            # a stretch with a smaller period has been met at that one, with the same ends
            if run not in found:
                found[run] = q
                active.append((*run, q))
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words that count: a tenth of the documents repeats a part of itself to its end, as the id's checksum says."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


def collapsed(words: list[str], runs: Iterable[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words), bool)
    for s, length, q in runs:
        gone[s + q : s + length] = True
    return [w for w, g in zip(words, gone) if not g] if gone.any() else words


def _codes(words: list[str]) -> np.ndarray:
    number: dict[str, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def find_periodic(docs: DataFrame, least: int = 24, times: int = 3, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, runs array<struct<start, length, period>>, n_words, collapsed)`` for every row.

    ``collapsed`` is the text's words, joined by one space, each run cut to its first period. ``plant``: see :func:`planted`.
    """
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", run_type), ("n_words", pa.int64()), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = _WORD.findall(text.as_py() or "")
                    words = planted(words, doc_id) if plant else words
                    runs = find_runs(_codes(words), least, times) if len(words) >= least else []
                    out.append(([dict(zip(("start", "length", "period"), r)) for r in runs], len(words), " ".join(collapsed(words, runs))))
                runs, many, texts = zip(*out) if out else ((), (), ())
                yield pa.record_batch([part.column(0), pa.array(runs, run_type), pa.array(many, pa.int64()), pa.array(texts, pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row a document: the number of runs, the strongest one, and checksums of all runs and of the collapsed text."""
    # both fractions times both periods; ties go to the run that comes first
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = "struct<start: long, length: long, period: long>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
