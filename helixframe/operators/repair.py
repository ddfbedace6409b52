"""Grammars by replacement of frequent pairs or k-mers.

Selection is the same everywhere: the most frequent pair, ties to the smaller first
symbol, then to the smaller second.  Frequencies count overlapping pairs; replacement
goes left to right without overlap.  Rules are numbered as they are made, so a
rule's symbols have smaller numbers than the rule.

``build`` handles each sequence inside a task, with counts kept up to date as it
replaces, so the time is near linear; sequences are rows, and no shuffle is
needed.  ``pair_rounds`` does the same rounds over pieces of sequences, which are
spread over tasks, for those too long for one.  ``build_chunked`` builds chunks and leaves it to the merge by
content to make one grammar of them.

A grammar row is (seq_id, symbols, rules): the final symbols, and rules as structs
(rule_id, symbols, usage_count, pair_count): replacements made, and the overlapping count by
which the rule was chosen.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes
from .rounds import SYMBOLS_A_PIECE, build_spread, placed_symbols

GRAMMAR = "seq_id long, symbols array<long>, rules array<struct<rule_id:long,symbols:array<long>,usage_count:long,pair_count:long>>"
RULES = pa.list_(pa.struct([("rule_id", pa.int64()), ("symbols", pa.list_(pa.int64())), ("usage_count", pa.int64()), ("pair_count", pa.int64())]))


def back(sym: int) -> int:
    """The reverse complement of a symbol."""
    return 3 - sym if 0 <= sym <= 3 else -1 - sym


def repair(symbols: list[int], least: int = 2, most_rules: int | None = None, either_strand: bool = False, first: int = 0):
    """(final symbols, rules as (left, right, usage, count)) of one sequence; rules are numbered from ``first``.

    With ``either_strand`` a pair and its reverse complement count as one, and an
    occurrence of the latter becomes the reverse of the rule's symbol.
    """
    n = len(symbols)
    syms, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    if either_strand:
        key = lambda a, b: min((a, b), (back(b), back(a)))
    else:
        key = lambda a, b: (a, b)
    count: dict = {}
    places: dict = {}
    for i in range(n - 1):
        k = key(syms[i], syms[i + 1])
        count[k] = count.get(k, 0) + 1
        places.setdefault(k, []).append(i)
    heap = [(-c, k) for k, c in count.items() if c >= least]
    heapq.heapify(heap)
    alive, rules = [True] * n, []
    while heap and (most_rules is None or len(rules) < most_rules):
        c, pair = heapq.heappop(heap)
        if count.get(pair, 0) != -c:
            continue
        rule, used, touched = 4 + first + len(rules), 0, set()
        at = sorted(set(places.pop(pair)))
        for i in at:
            if not alive[i]:
                continue
            j = nxt[i]
            if j >= n or key(syms[i], syms[j]) != pair:
                continue
            left, right = prv[i], nxt[j]
            new = rule if (syms[i], syms[j]) == pair else -1 - rule
            gone = [key(syms[i], syms[j])]
            if left >= 0:
                gone.append(key(syms[left], syms[i]))
            if right < n:
                gone.append(key(syms[j], syms[right]))
            for k in gone:
                count[k] -= 1
                touched.add(k)
            syms[i], alive[j], nxt[i] = new, False, right
            if right < n:
                prv[right] = i
            used += 1
            for a, b in ((left, i), (i, right)):
                if a >= 0 and b < n:
                    k = key(syms[a], syms[b])
                    count[k] = count.get(k, 0) + 1
                    places.setdefault(k, []).append(a)
                    touched.add(k)
        rules.append((*pair, used, -c))
        for k in touched:
            if count[k] >= least:
                heapq.heappush(heap, (-count[k], k))
    return [s for s, ok in zip(syms, alive) if ok], rules


def replace_kmers(symbols: list[int], k: int, least: int = 2, most_rules: int | None = None, either_strand: bool = False):
    """(final symbols, rules as (symbols, usage, count)): the most frequent window of k that can be replaced twice is, until there is none.

    With ``either_strand`` a window and its reverse complement count as one, and an
    occurrence of the latter becomes the reverse of the rule's symbol.
    """
    n = len(symbols)
    syms, nxt, prv, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def nodes(i: int) -> list[int]:
        out: list[int] = []
        while len(out) < k and i < n:
            out.append(i)
            i = nxt[i]
        return out

    def window(i: int) -> tuple | None:
        found = nodes(i)
        return tuple(syms[x] for x in found) if len(found) == k else None

    def key(i: int) -> tuple | None:
        w = window(i)
        return min(w, tuple(back(x) for x in reversed(w))) if w and either_strand else w

    count: dict = {}
    places: dict = {}

    def add(i: int) -> tuple | None:
        w = key(i)
        if w:
            count[w] = count.get(w, 0) + 1
            places.setdefault(w, []).append(i)
        return w

    for i in range(n):
        add(i)
    heap = [(-c, w) for w, c in count.items() if c >= least]
    heapq.heapify(heap)
    rules: list = []
    while heap and (most_rules is None or len(rules) < most_rules):
        c, body = heapq.heappop(heap)
        if count.get(body, 0) != -c:
            continue
        chosen, after = [], 0
        places[body] = sorted(set(places[body]))
        for i in places[body]:
            if i >= after and alive[i] and key(i) == body:
                chosen.append(i)
                after = nodes(i)[-1] + 1
        if len(chosen) < 2:  # its places overlap; it comes up again if its count changes
            continue
        touched = set()
        for i in chosen:
            inner, before, left = nodes(i), [], prv[i]
            while left >= 0 and len(before) < k - 1:
                before.append(left)
                left = prv[left]
            for x in before + inner:
                w = key(x)
                if w:
                    count[w] -= 1
                    touched.add(w)
            syms[i], nxt[i] = (4 + len(rules) if window(i) == body else -5 - len(rules)), nxt[inner[-1]]
            for x in inner[1:]:
                alive[x] = False
            if nxt[i] < n:
                prv[nxt[i]] = i
            touched.update(w for x in [*before, i] if (w := add(x)))
        rules.append((list(body), len(chosen), -c))
        for w in touched:
            if count[w] >= least:
                heapq.heappush(heap, (-count[w], w))
    return [x for x, ok in zip(syms, alive) if ok], rules


SIDE_BY_SIDE = 4096  # sequences of up to so many symbols are built in one numpy batch


def repair_many(sequences: list[np.ndarray], least: np.ndarray, most_rules: int | None = None):
    """For each sequence what ``repair`` gives: (final symbols, rules as rows of left, right, usage, count).

    All sequences take a round at a time, in one array; each makes its rule of that
    number, or is done.  Symbols must be below 2**17.
    """
    out: list = [(x, np.zeros((0, 4), np.int64)) for x in sequences]
    sid = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
    x = np.concatenate([np.zeros(0, np.int64), *sequences])
    made: list[np.ndarray] = []
    while len(x) and (most_rules is None or len(made) < most_rules):
        keys = np.where(sid[1:] == sid[:-1], sid[:-1] << 34 | x[:-1] << 17 | x[1:], -1)
        ordered = np.sort(keys[keys >= 0])
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(first, append=len(ordered))
        pair = ordered[first]
        begins = np.flatnonzero(np.concatenate([[True], pair[1:] >> 34 != pair[:-1] >> 34]))
        most = np.maximum.reduceat(count, begins)
        top = np.flatnonzero(count == np.repeat(most, np.diff(begins, append=len(pair))))
        top = top[np.concatenate([[True], pair[top][1:] >> 34 != pair[top][:-1] >> 34])]  # the least of a sequence's
        owner = pair[top] >> 34
        enough = most >= least[owner]
        best = np.full(len(sequences), -2)
        best[owner[enough]] = pair[top][enough]
        hit = np.flatnonzero(keys == best[sid[:-1]])
        starts = np.ones(len(hit), bool)
        starts[1:] = hit[1:] != hit[:-1] + 1
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]  # a run of one symbol: every other
        used = np.bincount(sid[hit], minlength=len(sequences))
        go = best[sid] >= 0
        x[hit] = 4 + len(made)
        go[hit + 1] = False
        made.append(np.stack([owner[enough], pair[top][enough] >> 17 & 131071, pair[top][enough] & 131071, used[owner[enough]], most[enough]], 1))
        done = best[sid] < 0
        for k, part in zip(*_split(sid[done], x[done])):
            out[k] = (part, out[k][1])
        sid, x = sid[go], x[go]
    for k, part in zip(*_split(sid, x)):
        out[k] = (part, out[k][1])
    if made:
        rules = np.concatenate(made)
        rules = rules[np.argsort(rules[:, 0], kind="stable")]
        for k, part in zip(*_split(rules[:, 0], rules[:, 1:])):
            out[k] = (out[k][0], part)
    return out


def fits_many(sequences: int, longest: int, k: int) -> bool:
    """Whether ``replace_many`` can write a window of k symbols, with its sequence's number, in one."""
    return k * _symbol_bits(longest, k) + max(sequences - 1, 1).bit_length() <= 62


def _symbol_bits(longest: int, k: int) -> int:
    return (2 * (longest // (k - 1) + 6)).bit_length()  # a replacement takes k - 1 symbols away


def replace_many(sequences: list[np.ndarray], k: int, least: np.ndarray, most_rules: int | None = None, either_strand: bool = False, twice: bool = True):
    """For each sequence what ``replace_kmers`` gives: (final symbols, rules as rows of k symbols, usage, count).

    All sequences take a round at a time, in one array; each makes its rule of that number, or is done.
    Without ``twice`` a window whose places all overlap is replaced too, as ``repair`` does with pairs.
    """
    out: list = [(x, np.zeros((0, k + 2), np.int64)) for x in sequences]
    sid = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
    x = np.concatenate([np.zeros(0, np.int64), *sequences])
    bits = _symbol_bits(max(map(len, sequences), default=0), k)
    zero, mask = 1 << bits - 1, (1 << bits) - 1
    made: list[np.ndarray] = []
    while len(x) >= k and (most_rules is None or len(made) < most_rules):
        n = len(x) - k + 1
        at = np.flatnonzero(sid[k - 1 :] == sid[:n])
        keys = np.zeros(n, np.int64)
        for j in range(k):
            keys = keys << bits | x[j : j + n] + zero
        ahead = keys
        if either_strand:
            turned, behind = np.where((x >= 0) & (x <= 3), 3 - x, -1 - x) + zero, np.zeros(n, np.int64)
            for j in reversed(range(k)):
                behind = behind << bits | turned[j : j + n]
            keys = np.minimum(ahead, behind)
        keys = keys | sid[:n] << k * bits
        order = at[np.argsort(keys[at])]
        if not len(order):
            break
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count, owner = np.diff(first, append=len(ordered)), ordered[first] >> k * bits
        can = count >= least[owner]
        if twice:
            can &= np.maximum.reduceat(order, first) - np.minimum.reduceat(order, first) >= k
        first, count, owner = first[can], count[can], owner[can]
        best = np.full(len(sequences), -1)
        if len(first):
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            top = np.flatnonzero(count == np.repeat(np.maximum.reduceat(count, begins), np.diff(begins, append=len(owner))))
            top = top[np.concatenate([[True], owner[top][1:] != owner[top][:-1]])]  # the least of a sequence's
            best[owner[top]] = ordered[first[top]]
            hit = apart(at[keys[at] == best[sid[at]]], k)
            used = np.bincount(sid[hit], minlength=len(sequences))
            forward = ahead[hit] == keys[hit] & (1 << k * bits) - 1
            stay = best[sid] >= 0
            x[hit] = np.where(forward, 4 + len(made), -5 - len(made))
            for j in range(1, k):
                stay[hit + j] = False
            body = [(ordered[first[top]] >> bits * (k - 1 - j) & mask) - zero for j in range(k)]
            made.append(np.stack([owner[top], *body, used[owner[top]], count[top]], 1))
        else:
            stay = np.zeros(len(x), bool)
        done = best[sid] < 0
        for i, part in zip(*_split(sid[done], x[done])):
            out[i] = (part, out[i][1])
        sid, x = sid[stay], x[stay]
    for i, part in zip(*_split(sid, x)):
        out[i] = (part, out[i][1])
    if made:
        rules = np.concatenate(made)
        rules = rules[np.argsort(rules[:, 0], kind="stable")]
        for i, part in zip(*_split(rules[:, 0], rules[:, 1:])):
            out[i] = (out[i][0], part)
    return out


def apart(hit: np.ndarray, k: int) -> np.ndarray:
    """Of places in order, from left to right those that are k or more after the one before that is taken."""
    if not len(hit):
        return hit
    new = np.concatenate([[True], np.diff(hit) >= k])
    stretch, following = np.cumsum(new), np.searchsorted(hit, hit + k)
    taken, now = np.zeros(len(hit), bool), np.flatnonzero(new)
    while len(now):
        taken[now] = True
        after = following[now]
        inside = after < len(hit)
        now, after = now[inside], after[inside]
        now = after[stretch[after] == stretch[now]]
    return hit[taken]


def _split(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Owners, which are in order, and their values."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[begins].tolist(), np.split(values, begins[1:]) if len(begins) else []


def lists_of(parts: list, kind=None) -> pa.ListArray:
    """An Arrow list of numbers for each array or list."""
    edges = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in parts)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))


def _grammar_batch(ids, found) -> pa.RecordBatch:
    """Grammar rows of (symbols, rules); rules are (body, usage, count), or rows of symbols, usage and count."""
    bodies, used, counts = [], [], []
    for _, rules in found:
        if isinstance(rules, np.ndarray):
            bodies.append(rules[:, :-2])
            used.append(rules[:, -2])
            counts.append(rules[:, -1])
        else:
            bodies += [np.asarray(body, np.int64)[None] for body, _, _ in rules]
            used.append([u for _, u, _ in rules])
            counts.append([n for _, _, n in rules])
    size = np.concatenate([np.zeros(0, np.int64), *(np.full(len(b), b.shape[1]) for b in bodies)])
    flat = np.concatenate([np.zeros(0, np.int64), *(b.ravel() for b in bodies)])
    joined = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in parts)]))
    n = [len(rules) for _, rules in found]
    body = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
    each = pa.StructArray.from_arrays([joined(map(np.arange, n)), body, joined(used), joined(counts)], names=["rule_id", "symbols", "usage_count", "pair_count"])
    rules = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), each)
    return pa.RecordBatch.from_arrays([ids, lists_of([s for s, _ in found]), rules], ["seq_id", "symbols", "rules"])


def build(seqs: DataFrame, least: int = 2, length_factor: int | None = None, most_rules: int | None = None, either_strand: bool = False, kmer: int = 2) -> DataFrame:
    """Grammar rows of (seq_id, dna).

    ``least`` is the smallest frequency that makes a rule, at least 2; with
    ``length_factor`` it is the greater of that and the length divided by the factor.
    Building stops at ``most_rules``.  Null and empty sequences give empty grammars.
    """
    if least < 2:
        raise ValueError("a rule must be used twice at least")

    def run(batches):
        for batch in bounded(batches):
            found = [_codes(dna or "").astype(np.int64) for dna in batch.column("dna").to_pylist()]
            enough = np.array([max(least, -(-len(x) // length_factor)) if length_factor else least for x in found], np.int64)
            out: list = [None] * len(found)
            together = [k for k, x in enumerate(found) if len(x) <= SIDE_BY_SIDE]
            short = [found[k] for k in together]
            if kmer == 2 and not either_strand:
                many = repair_many(short, enough[together], most_rules)
            elif fits_many(len(short), SIDE_BY_SIDE, kmer):
                many = replace_many(short, kmer, enough[together], most_rules, either_strand, kmer > 2)
            else:
                many = []
            for k, grammar in zip(together, many):
                out[k] = grammar
            for k, x in enumerate(found):
                if out[k] is None and kmer == 2:
                    final, rules = repair(x.tolist(), int(enough[k]), most_rules, either_strand)
                    out[k] = (final, np.array(rules, np.int64).reshape(-1, 4))
                elif out[k] is None:
                    out[k] = replace_kmers(x.tolist(), kmer, int(enough[k]), most_rules, either_strand)
            yield _grammar_batch(batch.column("seq_id"), out)

    return seqs.select("seq_id", "dna").mapInArrow(run, GRAMMAR)


def build_chunked(seqs: DataFrame, size, **options) -> DataFrame:
    """Grammar rows (seq_id, idx, symbols, rules) of chunks of each sequence; ``grammar.merge_chunks`` makes them one."""
    from .chunks import split_chunks

    chunks = split_chunks(seqs, size)
    named = chunks.select("seq_id", "idx", F.struct("seq_id", "idx").alias("of"), "dna").withColumn("key", F.xxhash64("seq_id", "idx"))
    built = build(named.select(F.col("key").alias("seq_id"), "dna"), **options).withColumnRenamed("seq_id", "key")
    return named.select("key", "seq_id", "idx").join(built, "key").drop("key")


def in_numpy(column) -> list[np.ndarray]:
    """The arrays of a list column."""
    flat, edges = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def pair_rounds(seqs: DataFrame, rounds: int | None = None, least: int = 2, size: int = SYMBOLS_A_PIECE) -> tuple[DataFrame, DataFrame]:
    """Symbols (seq_id, pos, sym) after some rounds, or when no pair is left ``least`` times, and the rules (seq_id, rule_id, a, b, n).

    The same rules as ``build`` makes, one of each sequence in a round; ``rounds.build_spread`` makes many.
    """
    held, rules = build_spread(seqs, least, None, rounds, size)
    return placed_symbols(held), rules.drop("used")
