"""Operators over words and shingles against brute force, with nulls, ties, repeats, long texts and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import chosen_path, periodic, setjoin, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    """Documents with columns that operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(("node", "root", "key", "word", "n", "row", "_text", "runs", "h", "sig", "kept", "run"))})


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- chosen-path join


def shingles(text, k=3):
    w = WORD.findall(low(text))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            label[find(j)] = find(i)
    members = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in members.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d is not None and d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def edits(rng, words, share):
    return " ".join(w if rng.random() >= share else f"e{rng.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(17)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for size in (8, 20, 60, 200, 600):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            rows += [edits(rng, base, share) for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1)]
    # one group of a third of all rows, all close to the threshold; a passage that many share
    centre = [rng.choice(vocabulary) for _ in range(120)]
    rows += [edits(rng, centre, 0.025) for _ in range(100)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    rows += [None, "", " \n\t", "one", "ONE", "one two", "One  Two", "one two three", "a b c d", "a b c d", "É x y", "é x y", " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    out = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(out)
    return [*out, (None, rows[5]), (None, "alone without id"), (3, rows[3]), (3, rows[3])]


@pytest.mark.parametrize("limits", [{}, {"most_rows": 40, "shard_rows": 100, "most_tokens": 3000, "hot_rows": 10}, {"most_rows": 5, "most_tokens": 500}])
def test_groups_equal_brute_force(spark, copies, limits):
    got = chosen_path.group_documents(table(spark, copies), **limits)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_groups(copies)


def test_groups_of_an_empty_table(spark):
    assert chosen_path.group_documents(table(spark, [(1, "x")]).where("false")).count() == 0
    only_empty = chosen_path.group_documents(table(spark, [(1, None), (2, ""), (1, None)])).collect()
    assert sorted(map(tuple, only_empty)) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_recall_of_the_trees():
    """Pairs just at the threshold among scattered rows and in a dense node: all but a few are candidates of three trees."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(400):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[:276], rng.integers(0, 2**63, 24, dtype=np.uint64)])  # 276 of 324 tokens
        sets += [np.unique(a), np.unique(b)]
    minima = [setjoin.minima(s) for s in sets]
    x = setjoin.lanes([setjoin.signature(m) for m in minima])
    far = setjoin.most_unlike(0.85)
    used = tuple(j for own in chosen_path.roots(3, 3) for j in own)
    near = setjoin.unlike(x[::2], x[1::2]) <= far
    assert near.mean() > 0.99
    out = chosen_path.Links(len(sets))
    # all rows in one node, so that what follows branches three at a time
    chosen_path.search(x, np.arange(len(sets)), 99, far, out, 3, used)
    a, b, _ = out.shrink()
    met = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert sum((2 * k, 2 * k + 1) in met for k in range(400) if near[k]) >= 0.985 * near.sum()
    assert out.count < 800  # and next to nothing else


def test_signatures():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (50, 128), dtype=np.uint8)
    b = np.where(rng.random((50, 128)) < 0.3, rng.integers(0, 256, (50, 128), dtype=np.uint8), a)
    assert (setjoin.unlike(a.view(np.uint64), b.view(np.uint64)) == (a != b).sum(1)).all()
    known = setjoin._Words(most=10)
    assert (setjoin.shingle_hashes("a b c d " * 9, 3, known) == setjoin.shingle_hashes("A b C d " * 9, 3)).all()
    assert len(setjoin.shingle_hashes("a b c d " * 9, 3)) == 4 and len(setjoin.shingle_hashes("a b", 3)) == 1 and not len(setjoin.shingle_hashes(" ", 3))
    assert setjoin.shingle_hashes("a b", 3) != setjoin.shingle_hashes("b a", 3)


# ---- periodic runs


def brute_runs(w, least=24, times=3):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
    return (*row, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(v for i, v in enumerate(w) if i not in gone)))


def repetitive(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        else:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            out += (unit * rng.randint(2, 30))[: rng.randint(1, 90)]
    return out[:n]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 220), st.booleans())
def test_runs_equal_brute_force(seed, n, sparse):
    w = repetitive(random.Random(seed), n)
    assert periodic.find_runs(periodic._codes(w), direct=0 if sparse else 10**6) == brute_runs(w)


def test_runs_of_runs():
    """Runs inside runs, multiples of a period, runs that overlap by less than a period, one word all along."""
    rng = random.Random(3)
    inner = list("ab" * 14) + list("cde")
    for w in (list("a" * 500), inner * 4, list("abc" * 20) + list("bca" * 20), list("x" * 30) + ["y"] + list("x" * 30), [*"ab" * 12], [*"ab" * 11, "a"], list(range(60)) * 3, list(range(60)) * 2):
        w = list(map(str, w))
        for direct in (0, 10**6):
            assert periodic.find_runs(periodic._codes(w), direct=direct) == brute_runs(w)
    long = [str(rng.randrange(50)) for _ in range(4000)] + [str(k) for k in range(700)] * 4 + ["z"] * 3000
    assert periodic.find_runs(periodic._codes(long), direct=0) == periodic.find_runs(periodic._codes(long), direct=10**6) == brute_runs(long)


def test_long_texts_take_seconds():
    import time

    rng = random.Random(1)
    began = time.process_time()
    words = [f"w{int(rng.paretovariate(1))}" for _ in range(200_000)]
    assert periodic.find_runs(periodic._codes([*words, *words[:50_000] * 3]))
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert time.process_time() - began < 120


def test_periodic_documents(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(repetitive(rng, rng.choice([0, 1, 5, 23, 24, 100, 300])))) for i in range(300)]
    rows += [(None, "a b " * 40), (7, None), (8, ""), (9, "\t \n"), (10, "é " * 30), (11, "A a " * 30), (12, rows[12][1]), (12, rows[12][1])]
    docs = table(spark, rows)
    got = periodic.digest(periodic.find_periodic(docs, plant=True)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert periodic.digest(periodic.find_periodic(docs.where("false"))).count() == 0
    # without planting, texts stand as they are
    plain = {r["doc_id"]: r for r in periodic.find_periodic(docs.where("doc_id is null")).collect()}[None]
    assert [tuple(r) for r in plain["runs"]] == [(0, 80, 2)] and plain["collapsed"] == "a b" and plain["n_words"] == 80


# ---- spelling variants


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    form, near = {}, {}
    for w in words:
        others = [v for v in words if v != w and is_near(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items())


@pytest.fixture(scope="module")
def dictionary():
    """Words with edits at all places, blocks of shared fronts and ends far above the limit, all letters at one place, and long words."""
    rng = random.Random(6)
    letters = "abcdeéÿ÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words += ["commonfront" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(150)]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) + "commonend" for _ in range(150)]
    words += [f"place{c}place" for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"] + ["x" * 300 + "y", "x" * 301, "x" * 302]
    for w in list(words[:40]):
        at = rng.randrange(len(w) + 1)
        words += [w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + "z" + w[at + 1 :]]
    texts = []
    for w in dict.fromkeys(words):
        texts += [w] * rng.choice([1, 4, 5, 6, 30, 200])
    rng.shuffle(texts)
    rows = [(i, " 12 ".join(texts[i * 40 : i * 40 + 40]).replace("commonf", "CommonF")) for i in range(-(-len(texts) // 40))]
    return [*rows, (None, "Aaaaaa " * 6), (5, None), (6, ""), rows[3], rows[3]]


@pytest.mark.parametrize("most", [256, 4])
def test_variants_equal_brute_force(spark, dictionary, most):
    words = brute_words(dictionary)
    assert len(words) > 200
    got = spelling.group_variants(table(spark, dictionary), most=most).collect()
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got) == brute_variants(words)


def test_pairs_are_met_once_and_blocks_are_bounded(spark, dictionary):
    words = spark.createDataFrame(sorted(brute_words(dictionary).items()), "word string, n long")
    for most in (256, 90, 4):
        blocks = spelling.subdivided(words, most).groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        assert blocks.where((F.col("c") > max(most, 91)) | ((F.col("c") > most) & (F.col("width") > 1))).count() == 0
        pairs = spelling.near_words(words, most)
        assert pairs.count() == pairs.select("word", "other").distinct().count()


def test_variants_of_an_empty_table(spark):
    empty = table(spark, [(1, "x")])
    assert spelling.group_variants(empty).count() == 0 and spelling.group_variants(empty.where("false")).count() == 0


def test_forms_are_followed(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625}
    text = " ".join(w + " " + " ".join([w] * (c - 1)) for w, c in n.items())
    rows = spelling.group_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=None).collect()
    assert {r["word"]: (r["root"], r["n_near"]) for r in rows} == {w: ("abbbbb", 1 if w in ("aaaaaa", "abbbbb") else 2) for w in n}


def test_queries_equal_sql(spark, duck):
    from conftest import rows_of

    from tidewater.llm import word_queries

    for name, sql in word_queries.SQL.items():
        assert rows_of(word_queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == rows_of(duck.execute(sql).df()), name
