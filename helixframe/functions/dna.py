"""Column functions on DNA strings, 2-bit codes and grammar symbols.

A symbol is a BIGINT: 0 to 3 for A, C, G, T; 4 + r for rule r; and -1 - s for the
reverse complement of rule symbol s.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES, COMPLEMENTS, CODES = "ACGT", "TGCA", "0123"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x, policy: str = "skip") -> Column:
    """Upper-case DNA. Other characters are dropped (skip), fail the query (error), or become A with case kept (replace_a)."""
    x = _col(x)
    if policy == "skip":
        return F.upper(F.regexp_replace(x, "[^ACGTacgt]", ""))
    if policy == "error":
        return F.when(x.rlike("[^ACGTacgt]"), F.raise_error(F.concat(F.lit("not DNA: "), F.substring(x, 1, 40)))).otherwise(F.upper(x))
    if policy == "replace_a":
        return F.regexp_replace(x, "[^ACGTacgt]", "A")
    raise ValueError(f"unknown policy {policy!r}")


def drop_n(x) -> Column:
    return F.regexp_replace(_col(x), "[Nn]", "")


def is_strict(x) -> Column:
    return ~_col(x).rlike("[^ACGTacgt]")


def encode_codes(x, cap: int | None = None) -> Column:
    """One digit of 0 to 3 for each base of clean DNA; at most ``cap`` of them."""
    out = F.translate(_col(x), BASES, CODES)
    return out if cap is None else F.substring(out, 1, cap)


def decode_codes(x) -> Column:
    """Codes to bases; digits above 3 are dropped."""
    return F.translate(F.regexp_replace(_col(x), "[^0-3]", ""), CODES, BASES)


def count_valid(x) -> Column:
    return F.length(F.regexp_replace(_col(x), "[^ACGTacgt]", ""))


def base_code(x) -> Column:
    """0 to 3; null for another character."""
    at = F.instr(F.lit(BASES), F.upper(_col(x)))
    return F.when((F.length(_col(x)) == 1) & (at > 0), at - 1)


def code_base(x) -> Column:
    return F.when(_col(x).between(0, 3), F.substr(F.lit(BASES), _col(x).cast("int") + 1, F.lit(1)))


def complement(x) -> Column:
    return F.translate(_col(x), BASES, COMPLEMENTS)


def reverse_complement(x) -> Column:
    return F.reverse(F.translate(normalize(x), BASES, COMPLEMENTS))


def canonical(x) -> Column:
    """The lesser of clean DNA and its reverse complement."""
    return F.least(_col(x), F.reverse(complement(x)))


def is_canonical(x) -> Column:
    return _col(x) <= F.reverse(complement(x))


def is_palindrome(x) -> Column:
    return _col(x) == F.reverse(complement(x))


def base_range(x, start, length) -> Column:
    """Bases from a 0-based start."""
    return F.substring(_col(x), F.lit(start) + 1 if isinstance(start, int) else start + 1, F.lit(length) if isinstance(length, int) else length)


def memory_saving_label(percent) -> Column:
    p = _col(percent)
    return F.when(p >= 70, "Excellent").when(p >= 50, "Good").when(p >= 30, "Moderate").otherwise("Low")


def memory_saving(n_bases) -> Column:
    """Per cent saved by 2 bits for each base against a byte."""
    n = _col(n_bases)
    return F.when(n > 0, F.round(100.0 * (n - F.ceil(n / 4)) / n, 6)).otherwise(0.0)


# Symbols.


def is_rule(sym) -> Column:
    return (_col(sym) >= 4) | (_col(sym) < 0)


def rule_of(sym) -> Column:
    """The rule id of a nonterminal."""
    s = _col(sym)
    return F.when(s >= 4, s - 4).when(s < 0, -5 - s)


def strand_of(sym) -> Column:
    return F.when(_col(sym) < 0, "-").otherwise("+")


def flip_strand(strand) -> Column:
    return F.when(_col(strand) == "+", "-").when(_col(strand) == "-", "+")


def symbol_complement(sym) -> Column:
    s = _col(sym)
    return F.when(s.between(0, 3), 3 - s).otherwise(-1 - s)


def format_symbol(sym) -> Column:
    """A+, R3-."""
    s = _col(sym)
    return F.concat(F.when(s.between(0, 3), code_base(s)).otherwise(F.concat(F.lit("R"), rule_of(s).cast("string"))), strand_of(s))


def polynomial_hash(kmer, k: int, base: int = 101, modulus: int = 1_000_000_007) -> Column:
    """Rabin-Karp hash of a k-mer's characters; k is at most 31 so that no term overflows."""
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    terms = [F.ascii(F.substring(_col(kmer), j + 1, 1)).cast("long") * F.lit(pow(base, k - 1 - j, modulus)) for j in range(k)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total % modulus


# Codecs, in numpy over Arrow batches.


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return ((raw >> 1) ^ (raw >> 2)).astype(np.uint8) & 3


def pack_text(text: str) -> bytes:
    """Four bases a byte, the first in the high bits."""
    codes = _codes(text)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    quads = padded.reshape(-1, 4)
    return (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes()


def unpack_text(packed: bytes, start: int, length: int) -> str:
    raw = np.frombuffer(packed, np.uint8)
    at = np.arange(start, start + length)
    return np.frombuffer(b"ACGT", np.uint8)[raw[at >> 2] >> (6 - 2 * (at & 3)) & 3].tobytes().decode()


@F.pandas_udf(T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("n", T.LongType())]))
def pack_2bit(dna: pd.Series) -> pd.DataFrame:
    """Packs clean DNA; null gives null fields, other characters are an error."""
    if any(set(x) - set(BASES) for x in dna.dropna()):
        raise ValueError("only A, C, G and T can be packed")
    return pd.DataFrame({"packed": [None if x is None else pack_text(x) for x in dna], "n": pd.array([None if x is None else len(x) for x in dna], "Int64")})


@F.pandas_udf(T.StringType())
def unpack_2bit(packed: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    """A segment of packed DNA."""
    return pd.Series([None if p is None else unpack_text(p, int(a), int(n)) for p, a, n in zip(packed, start, length)], dtype=object)


#: Fixed value of the word hash.
FX_SEED = 0x517CC1B727220A95
_MASK = (1 << 64) - 1


def fx_hash(words) -> int:
    """For each 64-bit word: rotate by 5, exclusive or, multiply; the result is unsigned."""
    h = 0
    for w in words:
        h = ((((h << 5) | (h >> 59)) & _MASK) ^ (w & _MASK)) * FX_SEED & _MASK
    return h


def symbol_words(sym: int) -> tuple[int, int, int]:
    """What a symbol adds to a fingerprint: tag, value, strand."""
    if 0 <= sym <= 3:
        return 0, sym, 0
    return (1, sym - 4, 0) if sym >= 4 else (1, -5 - sym, 1)


def fx_hashes(words: list[np.ndarray]) -> np.ndarray:
    """The word hash of each array, as signed numbers; all arrays take a step at a time, the longest first."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in order])
    flat = np.concatenate([words[k] for k in order]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    h = np.zeros(len(words), np.uint64)
    for j in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -j))  # those longer than j
        x = h[:n]
        h[:n] = (((x << np.uint64(5)) | (x >> np.uint64(59))) ^ flat[starts[:n] + j]) * np.uint64(FX_SEED)
    out = np.empty(len(words), np.int64)
    out[order] = h.view(np.int64)
    return out


def _hashed(column: pd.Series, words) -> pd.Series:
    known = column.notna().to_numpy()
    out = pd.array([pd.NA] * len(column), "Int64")
    out[known] = fx_hashes([words(x) for x in column[known]])
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def fingerprint_bases(dna: pd.Series) -> pd.Series:
    """Word hash of clean DNA's codes, as a signed 64-bit number."""
    return _hashed(dna, _codes)


def words_of_symbols(symbols) -> np.ndarray:
    """Tag, value and strand of each symbol."""
    x = np.asarray(symbols, np.int64)
    value = np.where((x >= 0) & (x <= 3), x, np.where(x >= 4, x - 4, -5 - x))
    return np.stack([(x < 0) | (x > 3), value, x < 0], 1).astype(np.int64).ravel()


@F.pandas_udf(T.LongType())
def fingerprint_symbols(symbols: pd.Series) -> pd.Series:
    return _hashed(symbols, words_of_symbols)


def identity_hash(*cols) -> Column:
    """64-bit hash of any values, for identity within this engine only."""
    return F.xxhash64(*cols)


def format_duration(seconds: float) -> str:
    hours, rest = divmod(int(seconds), 3600)
    minutes, whole = divmod(rest, 60)
    if hours:
        return f"{hours}h {minutes}m {whole}s"
    if minutes:
        return f"{minutes}m {whole}s"
    return f"{seconds:.2f}s"
