"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from helixframe.llm import queries
from helixframe.llm.periodic import least_overlap, periodic_runs, runs_of

SCHEMA = "doc_id long, text string"


def brute(words, least=6, times=4):
    """(start, length, period) of each run, by every period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rnd):
    words = []
    for _ in range(rnd.randint(0, 5)):
        unit = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randint(1, 7))]
        words += (unit * rnd.randint(1, 8))[: rnd.randint(1, 60)]
    return " ".join(words)


@pytest.mark.parametrize("least,times,seed", [(6, 4, 1), (6, 4, 2), (2, 2, 3), (5, 3, 4), (8, 2, 5), (3, 5, 6)])
def test_runs_equal_brute_force(least, times, seed):
    rnd = random.Random(seed)
    for _ in range(200):
        texts = [random_text(rnd) for _ in range(rnd.randint(1, 4))]
        runs, kept, n = runs_of(pa.array(texts), least, times)
        for text, got, left, size in zip(texts, runs.to_pylist(), kept.to_pylist(), n):
            words = text.split()
            want = brute(words, least, times)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            assert left == collapsed(words, want) and size == len(words)


def test_shortest_overlap():
    assert least_overlap(6, 4) == 5 and least_overlap(2, 2) == 1 and least_overlap(3, 5) == 4


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "b c " * 4), (5, "a " * 5), (6, "x\x1cy x\x1cy\x0bx\x1cy x\x1cy x\x1cy x\x1cy z")]
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], SCHEMA + ", runs string, n_words long")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text_kept) for r in periodic_runs(docs).collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (None, 8, [(0, 8, 2)], "b c"), (5, 5, [], "a a a a a"), (6, 7, [(0, 6, 1)], "x\x1cy z")]
    assert got == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=1)


def test_a_long_text(spark):
    words = [f"u{i}" for i in range(3000)] * 40 + ["end"]
    (row,) = periodic_runs(spark.createDataFrame([(1, " ".join(words))], SCHEMA)).collect()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 3000)] and row.text_kept == " ".join(words[:3000] + ["end"])


def test_the_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        words, h = [], zlib.crc32(str(doc_id).encode())
        for word in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" "):
            words += [word] if word else []
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, row = brute(words), got[doc_id]
        assert row.n_runs == len(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 3
