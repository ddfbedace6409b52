"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of ``width`` words, as 64-bit hashes.  A
shingle draws one value in each of ``REGISTERS`` intervals of equal probability under
an exponential law and deals them to the registers in an order of its own;
a register keeps the least value it gets, in steps of a logarithm.  Registers of a
union are the greater ones of both, and sets agree in a register about as often
as their Jaccard similarity.

1. Documents with equal sets form a class; its least doc_id stands for it.
2. Bands of ``ROWS`` registers are hashed to buckets.  Each member of a bucket is
   paired with the bucket's least member.
3. The similarity of a pair is estimated by maximum likelihood from how many
   registers are greater, less and equal; pairs far below the threshold go.
   The others are verified on the full sets.
4. Verified links are contracted to components.  Members of buckets that still
   hold several components are compared by an exact filter: a set's shingles are
   ordered from the rarest among these members to the commonest, and two sets whose
   first common shingle leaves too few after it can't be linked, nor those whose
   bitmaps show too many that aren't shared.  So sets meet only on their rare shingles,
   and the pairs that pass are verified on the full sets.

A pair at the threshold shares no bucket with a probability of
(1 - threshold**ROWS)**BANDS: 4e-7 at 0.85 and 5e-5 at 0.8; components usually
have many links.  Nothing else is lost: buckets have no cap, and no bucket or
component is ever gathered in one task.

Texts with fewer than ``width`` words have the whole sequence as one shingle.
Null texts and texts without words have the empty set and are linked with
nothing, nor are rows without a doc_id.  Rows that repeat a doc_id with other
texts are one node of the graph, with the links of any of them.  Ties go to the
least doc_id; long texts are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, BYTE_MASKS, Scratch, slices

REGISTERS, ROWS = 128, 5
BANDS = REGISTERS // ROWS
BASE = 1.02
OFFSET = 1024  # keeps registers of sets of any size above 0
SLACK = 0.2  # of the estimate: more than five of its deviations
WORDS = 16  # of 64 bits, of the bitmaps that tell sets apart
PAIRS_A_PART = 1024  # pairs that share a pivot and are verified together
IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M3
    x = (x ^ (x >> np.uint64(27))) * M1
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, A-Z as a-z, and where each text's words begin and the last one's end.

    Words of up to 15 bytes are hashed from those bytes and their number all at once.
    """
    held = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(["".encode(), *held, bytes(16)]).lower()
    raw = np.frombuffer(whole, np.uint8)
    blank = IS_BLANK[raw]
    blank[-17:] = True
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, n = edges[::2], edges[1::2] - edges[::2]
    words = np.ndarray(len(raw) - 7, "<u8", whole, strides=(1,))
    low, high = words[starts] & BYTE_MASKS[np.minimum(n, 8)], words[np.minimum(starts + 8, len(words) - 1)] & BYTE_MASKS[np.clip(n - 8, 0, 7)]
    out = mix(mix(low + M2) ^ (high | n.astype(np.uint64) << np.uint64(56)) * M1)
    long = np.flatnonzero(n > 15)
    if len(long):
        import xxhash

        out[long] = [xxhash.xxh3_64_intdigest(whole[a : a + k]) for a, k in zip(starts[long].tolist(), n[long].tolist())]
    return out, np.searchsorted(starts, np.cumsum([1, *(len(h) + 1 for h in held)]))


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    x, cuts = word_hashes(texts)
    h = np.full(max(len(x) - width + 1, 0), width, np.uint64)
    for k in range(width):
        h = mix(h * M2 + x[k : k + len(h)])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        else:  # the whole sequence, if there is any
            one = np.full(min(b - a, 1), b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * M2 + x[k])
            out.append(one)
    return out


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; 0 throughout for the empty set."""
    n = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), REGISTERS), np.inf)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    start, step = mix(items ^ M2), mix(items ^ M3) | np.uint64(1)
    for level in range(REGISTERS):
        if not len(items):
            break
        u = (mix(items + np.uint64(level * int(M1) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        value = -np.log1p(-(level + u) / REGISTERS)
        place = ((start + np.uint64(level) * step) & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(least.reshape(-1), owner * REGISTERS + place, value)
        if level + 1 < REGISTERS:
            open_ = least.max(1) > -np.log1p(-(level + 1) / REGISTERS)
            stay = open_[owner]
            if not stay.all():
                items, owner, start, step = items[stay], owner[stay], start[stay], step[stay]
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = n > 0
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(least[full], 1e-300)) / np.log(BASE)) + OFFSET, 1, 65_535).astype(np.uint16)
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Rows of ``BANDS`` bucket keys."""
    x = registers[:, : BANDS * ROWS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * M2 + x[:, :, k])
    return h.view(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 201) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from their registers and the sizes of their sets."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, out = np.full(len(a), -np.inf), np.zeros(len(a))
    most = np.minimum(u / v, v / u)
    for t in np.linspace(0, 1, steps):
        j = t * most
        up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))
        better = score > best
        best[better], out[better] = score[better], j[better]
    return out


def linked(common: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na + nb - common)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), set_key (a 128-bit hash of the set), registers."""

    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 2_000_000):
                sets = shingle_sets(texts[a:b], width)
                rows = registers_of(sets)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "n", "set_key", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, registers binary")


def registers_in(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def buckets(classes: DataFrame) -> DataFrame:
    """id, key: the buckets of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(registers_in(batch.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(keys.ravel())], ["id", "key"])

    return classes.select("id", "registers").mapInArrow(run, "id long, key long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose estimated similarity isn't far below the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    chosen = scratch.keep(classes.select("id", "n", "registers").join(ids.hint("merge"), "id", "left_semi"))
    side = lambda c: chosen.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                likely = likely_similarity(*(registers_in(batch.column(c)) for c in ("ra", "rb")), *(batch.column(c).to_numpy() for c in ("na", "nb")))
                keep = pa.array(likely >= percent / 100 - SLACK)
                yield batch.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, which (a hash of the set), shingles (sorted 64-bit hashes) of the documents of some ids."""
    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 2_000_000):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
                which = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(which), pa.array(sets, pa.binary())], ["id", "which", "shingles"])

    return chosen.mapInArrow(run, "id long, which long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets pass the threshold; the set of a ``b`` of many pairs is copied for each ``PAIRS_A_PART`` of them."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_PART).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(parts, "b")
    right = right.select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "part"])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(bool(linked(common, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (the least id reachable) of every id in the edges (a, b).

    Each round takes the least label among neighbours and then the label's own
    label, so the rounds are about the logarithm of the longest chain.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = scratch.keep(labels.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        root = step.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        jumped = scratch.keep(step.join(root, "comp", "left").select("id", "old", F.least(F.col("comp"), F.col("root")).alias("comp")))
        labels = jumped.select("id", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """id, comp of the members (key, id) of buckets that hold several components."""
    own = members.groupBy("id").agg(F.collect_list("key").alias("keys"))  # of an id, ``BANDS`` at most
    named = own.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.explode("keys").alias("key"))
    several = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return named.join(several, "key", "left_semi").select("id", "comp").distinct()


def shingle_rows(sets: DataFrame) -> DataFrame:
    """which, shingle: a row for each shingle of each set."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("which").to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["which", "shingle"])

    return sets.select("which", "shingles").mapInArrow(run, "which long, shingle long")


def bitmaps(sets: DataFrame) -> DataFrame:
    """id, which, b0 and so on: the bits that a set's shingles hash to, as ``WORDS`` numbers of 64."""
    names = ["id", "which", *(f"b{k}" for k in range(WORDS))]

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            bits = np.zeros((len(sets), WORDS), np.uint64)
            if sets:
                h = mix(np.concatenate(sets))
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                np.bitwise_or.at(bits, (owner, (h >> np.uint64(32)).astype(np.int64) % WORDS), np.uint64(1) << (h & np.uint64(63)))
            columns = bits.view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("which"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names)

    return sets.select("id", "which", "shingles").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def reachable(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members of different components that may be linked; every link between them is among these.

    A set's shingles are counted down, from the rarest: ``left`` is how many there
    are from one to the commonest.  Two linked sets share as many as their
    first common shingle has ``left`` in both.  Shingles of a single member take no part but as ones before.
    A bit that one set's shingles hash to and the other's don't is a shingle
    that isn't shared, so what is shared is at most a set's size without such bits.
    """
    sets = sets.join(members.select("id").hint("merge"), "id", "left_semi")
    own = scratch.keep(sets.select("id", "which", (F.octet_length("shingles") / 8).cast("long").alias("n")).join(members.hint("merge"), "id"))
    rows = shingle_rows(sets)
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    down = Window.partitionBy("which").orderBy(F.col("often").desc(), F.col("shingle").desc())
    placed = rows.join(often.hint("merge"), "shingle").withColumn("left", F.row_number().over(down).cast("long"))
    first = placed.select("which", "shingle", "left").join(own.hint("merge"), "which").where(F.lit(100) * F.col("left") >= F.lit(percent) * F.col("n"))
    first = scratch.keep(first.select("shingle", "id", "which", "comp", "n", "left"))
    several = first.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle")
    met = scratch.keep(first.join(several, "shingle", "left_semi"))
    marks = bitmaps(sets.join(met.select("id").distinct(), "id", "left_semi"))
    mine = scratch.keep(met.join(marks, ["id", "which"]).drop("which"))
    other = mine.withColumnsRenamed({c: f"of_{c}" for c in mine.columns})
    need = F.lit(percent) * (F.col("n") + F.col("of_n"))
    enough = lambda shared: F.lit(100 + percent) * shared >= need
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(WORDS)), F.lit(0))
    match = (F.col("shingle") == F.col("of_shingle")) & (F.col("id") < F.col("of_id")) & (F.col("comp") != F.col("of_comp")) & enough(F.least("left", "of_left"))
    match = match & enough(F.col("n") - alone("b", "of_b")) & enough(F.col("of_n") - alone("of_b", "b"))
    return mine.join(other, match).select(F.col("of_id").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is the doc_id), for each row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    with Scratch(spark) as scratch:
        narrow = docs.select("doc_id", "text")
        held = scratch.keep(sketches(narrow, width))
        real = held.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        classes = scratch.keep(real.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")))
        placed = scratch.keep(buckets(classes))
        # Joins whose sides grow with the documents are merge joins at every size; only ids of texts are left to Spark to choose.
        full = scratch.keep(placed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("rows")).where("rows > 1"))
        crowd = scratch.keep(placed.join(full.hint("merge"), "key").distinct())
        star = scratch.keep(crowd.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
        pairs = scratch.keep(plausible(star, classes, percent, scratch).distinct())
        members = scratch.keep(crowd.where("rows > 2").select("key", "id"))
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct()
        sets = scratch.keep(sets_of(narrow, scratch.keep(wanted), width))
        if not sets.groupBy("id", "which").count().where("count > 1").isEmpty():  # rows that repeat a doc_id and its text
            sets = scratch.keep(sets.dropDuplicates(["id", "which"]))
        links = scratch.keep(verified(pairs, sets, percent))
        labels = components(links, scratch)
        far = scratch.keep(reachable(scratch.keep(open_members(members, labels)), sets, percent, scratch))
        more = scratch.keep(verified(far, sets, percent))
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
        named = classes.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("comp", "id").alias("comp"))
        linked_rows = real.select("doc_id", "n", "set_key").join(named, "set_key").select("doc_id", "n", "comp")
        alone = held.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("comp"))
        out = linked_rows.unionByName(alone)
        return scratch.result(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept")))
