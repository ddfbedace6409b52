"""Rows without a doc_id, rows that repeat, clashing column names; and each stage of the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from helixframe.llm import bpe, common, langid, linededup, media, mixing, neardup, perplexity, secretscan, tokenfile

tokenizers = pytest.importorskip("public_tokenizers")

CLASHING = ["row", "n", "id", "of", "key", "half", "block", "copies", "gone", "size", "h1", "last", "media", "lang_pred", "score", "place", "before"]
WORDS = ["ka", "lo", "mi", "te", "ru", "san", "the", "and"]


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with a column of each clashing name."""
    df = spark.createDataFrame([(d, t, la, s, len(t) if t is not None else None) for d, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(31)
    long = prose(rng, 3000)
    rows = [(None, None, None, None), (None, "one two", "en", None), (None, "one two", "en", None), (5, "", None, "a"), (5, "", None, "a"), (5, "other text", "fr", "b"), (6, long, "en", "a"), (6, long, "en", "a"), (7, None, "en", "a"), (8, " \n\t", None, "a")]
    return rows + [(10 + k, prose(rng, 30), rng.choice(["en", "fr"]), rng.choice(["a", "b"])) for k in range(20)]


OPERATORS = {
    "op2": lambda df: bpe.digests(df, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op5": lambda df: perplexity.quality(df),
    "op6": lambda df: langid.identify(df),
    "op7": lambda df: neardup.near_duplicates(df).select("doc_id", "n_shingles"),
    "op8": lambda df: media.media_digests(media.store_avi(df)),
    "op10": lambda df: secretscan.scan_secrets(df),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_without_or_with_one_doc_id(spark, odd_rows, name):
    """A row comes out for each that goes in, and what is told of a row depends on its doc_id, text and language only."""
    df = table(spark, odd_rows).repartition(3)
    got = OPERATORS[name](df).collect()
    assert sorted(r.doc_id is None or r.doc_id for r in got) == sorted(d is None or d for d, *_ in odd_rows)
    kinds = len({tuple(r) for r in got})
    assert kinds <= len({(d, t, la) for d, t, la, _ in odd_rows})
    assert OPERATORS[name](df.where("n_chars < 0")).count() == 0


def test_mixing_of_repeated_rows(spark):
    rows = [(3, "w w w", "en", "a")] * 300 + [(None, "w w", "en", None)] * 200 + [(k, "w " * (k % 7), "en", "b") for k in range(400)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 14
    again = mixing.mix_sources(table(spark, rows).repartition(7)).collect()
    key = lambda r: (r.source or "", r.doc_id or -1, r.size, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_token_files_of_repeated_rows(spark, odd_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    with common.Scratch(spark) as scratch:
        got = tokenfile.read_shards(tokenfile.write_shards(table(spark, odd_rows), tokenizers.path("byte_bpe_50k.json"), scratch)).collect()
    want = sorted((-1 if d is None else d, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in odd_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_ties_go_to_the_first_language(spark):
    df = table(spark, [(1, "ab", "b", "x"), (2, "ab", "a", "x"), (3, "ab", "c", "x")])
    names, vectors = langid.prototypes(df)
    assert names == ["a", "b", "c"] and {r.lang_pred for r in langid.predict(df, names, vectors).collect()} == {"a"}


# The pipeline.


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(32)
    shared = "this line of more than forty characters is in very many texts"
    rows = []
    for k in range(40):
        lang = rng.choice(["en", "fr"])
        extra = "éèàù" if lang == "fr" else "wxyz"
        text = " ".join("".join(rng.choice([*WORDS[:4], *extra]) for _ in range(3)) for _ in range(rng.randrange(20, 60)))
        rows.append((k, text + (f"\n{shared.upper() if k % 3 else shared} \n" if k % 2 else ""), lang, rng.choice(["a", "b", None])))
    for k in range(12):  # near copies
        words = rows[k % 3][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), "en", "c"))
    rows += [(200, None, "en", "a"), (201, "", None, "a"), (202, "123 456 !!", "en", "b"), (203, "日" * 50, None, "b"), (None, "no name here", "en", "a"), (204, rows[0][1], "en", "a"), (204, rows[0][1], "en", "a")]
    return rows


def same_rows(df, rows):
    order = lambda r: tuple((x is None, x) for x in r)
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=order) == sorted(rows, key=order)


def brute_vector(text):
    import re

    total = np.zeros(langid.DIM)
    n = 0
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        x = "\0" + run + "\0"
        for k in range(len(run)):
            a, b, c = (langid.letter_vector(ord(p)).astype(int) for p in x[k : k + 3])
            total += np.roll(a, 2) * np.roll(b, 1) * c
            n += 1
    return total, n


def test_stage_language_id(spark, corpus):
    df = table(spark, corpus)
    prototypes = {}
    for _, text, lang, _ in corpus:
        total, n = brute_vector(text)
        if lang and n:
            prototypes[lang] = prototypes.get(lang, 0) + total / n
    kept = []
    for row in corpus:
        total, n = brute_vector(row[1])
        if n and max(total @ p / np.linalg.norm(p) for p in prototypes.values()) / np.linalg.norm(total) >= pipeline.LEAST_SCORE:
            kept.append(row)
    out = pipeline.language_id(spark, df, "")
    assert out.columns == df.columns and same_rows(out, kept) and len(kept) < len(corpus) - 2


def test_stage_line_dedup(spark, corpus):
    df = table(spark, corpus)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t, *_ in corpus:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(d)
    last = {k: max(ids, key=lambda d: -1 if d is None else d) for k, ids in held.items() if len(ids - {None}) >= 5}
    want = [(d, t if t is None else "\n".join(x for x in t.split("\n") if last.get(key(x), d) == d), la, s) for d, t, la, s in corpus]
    out = pipeline.line_dedup(spark, df, "")
    assert out.columns == df.columns and same_rows(out, want) and want != corpus
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_stage_near_dedup(spark, corpus):
    df = table(spark, corpus)
    shingles = []
    for _, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            d, e = corpus[i][0], corpus[j][0]
            linked = shingles[i] and shingles[j] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])
            if d is not None and e is not None and (linked or d == e):
                a, b = sorted((find(i), find(j)), key=lambda k: (corpus[k][0], k))
                root[b] = a
    want = [row for k, row in enumerate(corpus) if find(k) == k or row[0] is None]
    out = pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns and same_rows(out, want) and len(want) < len(corpus) - 10


def test_stage_mix(spark, corpus):
    df = table(spark, corpus)
    out = pipeline.mix(spark, df, "")
    assert out.columns == df.columns
    plan = {(r.doc_id, r.source): r for r in mixing.mix_sources(df).collect()}
    copies = {}
    for r in mixing.mix_sources(df).collect():
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    assert same_rows(out, [row for row in corpus for _ in range(copies[row[0]])])
    assert len(plan) == len({(d, s) for d, _, _, s in corpus})


def test_stage_encode(spark, corpus):
    import tiktoken

    vocabulary = bpe.remembered(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)[0]
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = []
    for d, t, *_ in corpus:
        ids = plain.encode_ordinary(t or "")
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.encode(spark, table(spark, corpus), "").collect()]
    assert sorted(got) == sorted(want)


def test_lines_of_clashing_columns(spark, odd_rows):
    out = linededup.dedup_lines(table(spark, odd_rows))
    assert out.count() == len(odd_rows)
