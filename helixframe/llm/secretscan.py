"""Secret scans: fixed patterns, and character Markov models of random strings and of identifiers.

Two order-2 Markov models over the characters that keys are written in are
trained: one on strings labelled random (the values that the fixed patterns find, and
seeded random strings over the alphabets of keys), one on strings labelled
ordinary (words and identifiers of the sampled texts outside those values, but for
those as long as candidates, which may be secrets; names and words of the documentation of Python's standard
library; and long identifiers, paths, addresses and chains put together from these by a seed, and runs of one sign).  A candidate, a run of ``LEAST_LENGTH`` key characters or more with single dots inside, is a span
of kind ``random`` if its log-likelihood ratio per character passes the
threshold, whatever characters it has.  Candidates that overlap a span of the
fixed patterns are left to it, so fixed spans always stay.

The training sample is the texts whose seeded hash is below a bound, about
``sample_docs`` of them; Spark adds up their counts, which are at most ``N_CODES``
to the third power for each label.  The scan covers every text.

Null and empty texts have no spans; texts of any length are scanned whole;
equal texts get equal spans, and rows that repeat are rows of their own; of spans
that begin together the kind listed first comes first; an empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import hashlib
import importlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The patterns, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

LEAST_LENGTH, THRESHOLD = 20, 1.0
KEY = "A-Za-z0-9+/_="
CANDIDATE = re.compile(rf"(?=[{KEY}.-]{{{LEAST_LENGTH}}})[{KEY}-]+(?:\.[{KEY}-]+)*")
WORD = re.compile(rf"[{KEY}-]{{4,}}")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
MADE = 2000  # seeded random strings of each alphabet, and ordinary ones of each kind
#: Modules whose names and documentation are samples of ordinary identifiers and words.
SAMPLED = ("argparse", "asyncio", "calendar", "collections", "concurrent.futures", "configparser", "csv", "datetime", "decimal", "difflib", "email.message", "functools", "http.client", "http.server", "inspect", "ipaddress", "json", "locale", "logging.handlers", "mailbox", "os", "pathlib", "random", "shutil", "smtplib", "socket", "statistics", "string", "subprocess", "tarfile", "tempfile", "threading", "types", "unittest.mock", "urllib.parse", "urllib.request", "uuid", "xml.dom.minidom", "zipfile")
#: Characters of the models: those of a candidate, and one mark for the start.
CODES = {c: k + 1 for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")}
N_CODES = len(CODES) + 1
CODE_OF_BYTE = np.zeros(256, np.int64)
CODE_OF_BYTE[[ord(c) for c in CODES]] = list(CODES.values())


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, each kind leftmost and without overlap."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


class MarkovPair:
    """Log probabilities of the next character after two, for random strings and for ordinary ones."""

    def __init__(self, random_counts: np.ndarray, plain_counts: np.ndarray):
        self.ratio = np.log(self.probabilities(random_counts)) - np.log(self.probabilities(plain_counts))

    @staticmethod
    def probabilities(counts: np.ndarray, prior: float = 0.5) -> np.ndarray:
        """Witten-Bell: a context backs off to the shorter one as far as it has shown new characters."""
        one = counts.sum((0, 1)) + prior
        p = one / one.sum()
        for n in (counts.sum(0), counts):
            kinds = np.maximum((n > 0).sum(-1, keepdims=True), 1)
            p = (n + kinds * p) / (n.sum(-1, keepdims=True) + kinds)
        return p

    @staticmethod
    def codes(token: str) -> np.ndarray:
        return np.concatenate([[0, 0], CODE_OF_BYTE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]])

    @classmethod
    def numbers(cls, tokens: list[str]) -> np.ndarray:
        """The trigrams of all tokens, as numbers below ``N_CODES`` cubed."""
        raw = np.frombuffer("".join(f"\0\0{t}" for t in tokens).encode("latin-1", "replace"), np.uint8)
        c = CODE_OF_BYTE[raw]
        inside = np.ones(len(c), bool)
        starts = np.cumsum([0, *(len(t) + 2 for t in tokens)])[:-1]
        inside[np.concatenate([starts, starts + 1])] = False
        at = np.flatnonzero(inside)
        return (c[at - 2] * N_CODES + c[at - 1]) * N_CODES + c[at]

    @classmethod
    def counts(cls, tokens: list[str]) -> np.ndarray:
        return np.bincount(cls.numbers(tokens), minlength=N_CODES**3).reshape((N_CODES,) * 3)

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character; above 0 the token looks random."""
        c = self.codes(token)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())


def labelled(text: str) -> tuple[list[str], list[str]]:
    """The strings of a text that are taken as random, and those taken as ordinary."""
    spans = sorted((a, b) for _, a, b in fixed_spans(text))
    secret = [x for a, b in spans for x in CANDIDATE.findall(text[a:b]) if len(x) >= LEAST_LENGTH]
    plain, k = [], 0
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if m.end() - m.start() < LEAST_LENGTH and (k == len(spans) or spans[k][0] >= m.end()):
            plain.append(m[0])
    return secret, plain


def made_strings(seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), int(rng.integers(20, 64)))) for alphabet in ALPHABETS for _ in range(MADE)]


def library_words() -> tuple[list[str], list[str]]:
    """Names in the sampled modules and their classes, and the words of their documentation."""
    names, texts = set(), []
    for module in SAMPLED:
        for name, value in sorted(vars(importlib.import_module(module)).items()):
            names.add(name)
            inner = vars(value) if isinstance(value, type) else {}
            names.update(inner)
            texts += [x.__doc__ for x in (value, *inner.values()) if isinstance(getattr(x, "__doc__", None), str)]
    words = sorted({w for text in texts for w in re.findall("[A-Za-z]{2,}", text)})
    return sorted(n for n in names if len(n) > 3), words


def ordinary_strings(seed: int) -> list[str]:
    """Names and words of the library, and strings put together of them as identifiers, paths, addresses and chains are; runs of one sign."""
    rng = np.random.default_rng(seed)
    names, words = library_words()
    lower = [w.lower() for w in words]
    pick = lambda pool, least=2, most=8: [pool[i] for i in rng.integers(0, len(pool), int(rng.integers(least, most)))]
    number = lambda: str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
    capital = lambda found: "".join(w.capitalize() for w in found)
    ends = ("", "", ".py", ".html", ".txt", ".json", ".md", ".png", ".com", ".org")
    kinds = [
        lambda: (w := pick(lower))[0] + capital(w[1:]),
        lambda: capital(pick(lower)),
        lambda: "_".join(pick(lower)),
        lambda: "_".join(pick(lower)).upper(),
        lambda: "-".join(pick(lower)),
        lambda: "/" * int(rng.integers(0, 3)) + "/".join(pick(lower)) + ends[rng.integers(0, len(ends))],
        lambda: "/".join(x for pair in zip(pick(lower, 3, 4), pick(names, 3, 4)) for x in pair) + ends[rng.integers(0, len(ends))],
        lambda: ".".join(pick(lower)),
        lambda: "//www." + ".".join(pick(lower, 1, 3)) + ".com/" + "/".join("-".join(pick(lower, 1, 4)) for _ in range(2)),
        lambda: "-".join([*pick(lower, 1, 4), number(), number()]),
        lambda: f"{'/'.join(pick(lower, 2, 5))}{number()}.{number()}/{'_'.join(pick(lower, 1, 4))}",
        lambda: "_".join(pick(names, 2, 4)),
        lambda: "=".join(["_".join(pick(lower, 1, 4)), "-".join(pick(lower, 1, 3))]),
    ]
    made = [kind() for kind in kinds for _ in range(MADE)]
    runs = [sign * int(n) for sign in "=-_/+" for n in rng.integers(20, 80, MADE // 10)]
    return names + words + made + runs


def train(docs: DataFrame, sample_docs: int = 4000, seed: int = 11) -> MarkovPair:
    """Fits both models on about ``sample_docs`` texts; the driver receives summed counts of trigrams."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    rank = F.xxhash64(F.lit(seed), "doc_id", F.length("text"))
    near = docs.where(rank <= F.lit(int((share * 2 - 1) * (2**63 - 1)))) if share < 1 else docs

    def count(batches):
        sums = np.zeros((2, N_CODES**3), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for k, tokens in enumerate(labelled(text)):
                    if tokens:
                        np.add.at(sums[k], MarkovPair.numbers(tokens), 1)
        for k in (0, 1):
            found = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), not k)), pa.array(found), pa.array(sums[k][found])], ["secret", "gram", "n"])

    parts = near.select("text").where(F.col("text").isNotNull()).mapInArrow(count, "secret boolean, gram long, n long")
    table = parts.groupBy("secret", "gram").agg(F.sum("n").alias("n")).toPandas()
    both = []
    for secret in (True, False):
        mine = table[table.secret == secret]
        both.append(np.bincount(mine.gram.to_numpy(np.int64), mine.n.to_numpy(np.float64), N_CODES**3).reshape((N_CODES,) * 3))
    return MarkovPair(both[0] + MarkovPair.counts(made_strings(seed)), both[1] + MarkovPair.counts(ordinary_strings(seed)))


def scan_text(text: str, model: MarkovPair, threshold: float) -> tuple[list, list]:
    """The fixed spans, and those that the models add."""
    base = fixed_spans(text)
    starts = sorted(a for _, a, _ in base)
    ends = sorted(b for _, _, b in base)
    more = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < LEAST_LENGTH:
            continue
        if bisect.bisect_left(starts, m.end()) > bisect.bisect_right(ends, m.start()):
            continue  # some fixed span began before its end and hasn't ended at its start
        if model.score(m[0]) > threshold:
            more.append(("random", m.start(), m.end()))
    return base, more


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document's whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), **training))

    def run(batches):
        model = held.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = scan_text(text or "", model, threshold)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
