"""N-gram Jaccard join of documents, exact, by prefix filtering.

A document is its set of distinct word n-grams (64-bit hashes); sets are known
by a 64-bit fingerprint, so copies, and ids that many rows repeat, cost nothing
more. All sets are ordered by one global order, rare n-grams first: by the count
of the n-gram in a fixed table of counters over the whole corpus, then by hash.
Any total order gives exact results; the counters only decide how well it
prunes. Two sets with Jaccard similarity of at least t share an n-gram among the
first n - ceil(t n) + 1 of each; sets meet on those prefix n-grams.

1. One pass over the texts: size and fingerprint of each document's set, and the
   counters (packed: fewer bytes than a task has n-grams; summed by Spark, then
   broadcast). At 30 GB a counter has some 3,300 n-grams, give or take 60, so one of
   a few hundred sets still stands out, and stays out of prefixes.
2. A second pass emits prefix n-grams, once per task and set, which are shuffled by
   n-gram once. N-grams that only one set has go there.
3. Every set is compared with one hub of each of its n-grams. An n-gram of few
   sets has one hub, which meets those that pass the length and positional
   filters. One of many sets has a hub for each size band, of the sets in it and
   in the band below, so that two similar sets always share a hub.
4. Components of these links bring groups of near copies together. Few sets on
   an n-gram that are still in several components are paired there.
5. Many sets on an n-gram are compared by what they differ in from the hub they
   share: |A - B| + |B - A| is |Da| + |Db| - 2 |Da and Db| for their symmetric
   differences D with the hub. Sets whose differences are small enough together
   are similar without a look. All others need a common part of Da and Db, which
   is found by prefix and positional filtering once more, on the differences:
   first with the set nearest to the hub only, then, across the components that
   are left, with all.
   Near copies of one text share the text, but not their edits: this is what
   keeps a dense group from pairing everything with everything.
6. Pairs must also pass a parity filter: two sets differ in at least as many
   n-grams as the XOR of their 256 parity bits has ones.

Verification joins the two whole sets of a pair, bounds their overlap by the
sizes of their parts between fixed pivots (suffix filter) and then intersects;
each pair is verified once. A pair within a component can't change any
component, and is left out.

Defined results: null text, or text without words: set of size 0, linked with
nothing. Null ids: the row has its set size, a null component, and links
nothing. Rows that repeat an id are one document: linked. An empty table gives
an empty table. Only id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.llm.components import components
from larkspur.runtime import dropped, ensure_importable, written

#: Counters of the table that orders n-grams; fixed, so its size is too.
COUNTERS, BLOCK = 1 << 21, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: An n-gram of more sets has hubs that its sets are compared with by differences.
FEW = 64
#: Sets that a task remembers, so as to emit each once.
REMEMBERED = 1 << 18
#: Rows of a batch of differences, about.
ROWS = 100_000
#: Bytes of a text that are hashed at once, about.
SEGMENT = 1 << 18
#: Bytes of a word that is hashed by running sums.
SHORT = 32
PIVOTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


class Words:
    """64-bit hashes of the words of a text, all at once in numpy.

    The hash of a word of up to SHORT bytes is the sum of a random number for each
    byte times the power of an odd number for its place, modulo 2^64; running
    sums over the text give it for every word. Sums of longer words can be equal
    whatever the numbers are (from 1,024 bytes on), so longer words, few in any
    language, are hashed one by one by XXH3. A-Z have the numbers of a-z.
    """

    def __init__(self, seed: int = 17):
        r, self.seed = np.random.default_rng(seed), seed
        self.letters = r.integers(0, 1 << 64, 256, np.uint64)
        self.letters[65:91] = self.letters[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(r.integers(1 << 62, 1 << 63)) | 1
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 14)
            down = pow(self.base, -1, 1 << 64)
            # cumprod wraps around, as the sums do
            self.powers, self.inverses = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (self.base, down))

    def segments(self, data: bytes) -> Iterator[np.ndarray]:
        """The bytes in parts that end with a word."""
        at = 0
        while at < len(data):
            end = at + SEGMENT
            while end < len(data) and not self.space[data[end]]:
                end += 1
            yield np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
            at = end

    def hashes(self, data: bytes) -> np.ndarray:
        out = [self.of_words(b, *self.places(b)) for b in self.segments(data)]
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)

    def of_words(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words from starts to ends."""
        out = self.sums(self.letters[b], starts, ends)
        long = np.flatnonzero(ends - starts > SHORT)
        if len(long):
            out[long] = [xxhash.xxh3_64_intdigest(b[i:j].tobytes().lower(), self.seed) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return out

    def places(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        inside = np.empty(len(b) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~self.space[b]
        edges = np.flatnonzero(np.diff(inside))
        return edges[::2], edges[1::2]

    def sums(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the parts from starts to ends."""
        self._grow(len(numbers))
        sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * self.powers[: len(numbers)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def shingles(data: bytes, n: int, words: Words) -> np.ndarray:
    """Distinct hashes of the word n-grams, sorted; A-Z count as a-z."""
    h = words.hashes(data)
    if not len(h):
        return h
    out = np.sort(combine(h, min(n, len(h))))
    return out[np.append(True, out[1:] != out[:-1])]


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n word hashes."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    out = h[: len(h) - n + 1] ^ np.uint64(n)
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two longs."""
    data = s.tobytes()
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(id, text) of all rows."""
    texts = batch.column(1).cast(pa.large_binary())
    for i, data in zip(batch.column(0).to_pylist(), texts, strict=True):
        yield i, data.as_py() or b""


def _counter(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(COUNTERS - 1)).astype(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """256 parity bits, as four longs: each n-gram flips one of them."""
    bits = np.bincount(((s * MIX) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


PARITY = ["s0", "s1", "s2", "s3"]
PROFILE = "doc_id bigint, n int, f1 bigint, f2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, block int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """A block of counters, in as few bytes each as its largest needs, compressed."""
    least = counts.astype(np.min_scalar_type(counts.max()))
    return bytes([least.itemsize]) + pa.compress(least.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], BLOCK * data[0], codec="zstd", asbytes=True), f"u{data[0]}")


def _profile(n: int):
    names = ["doc_id", "n", "f1", "f2", *PARITY, "block", "counts"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            rows = []
            for i, data in _rows(batch):
                s = shingles(data, n, words)
                rows.append((i, len(s), *fingerprint(s), *map(int, parity(s)), None, None))
                if i is not None:
                    np.add.at(counts, _counter(s), np.uint32(1))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        blocks = {k: _packed(own) for k in range(COUNTERS // BLOCK) if (own := counts[k * BLOCK : (k + 1) * BLOCK]).any()}
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(blocks), t) for t in kinds[:-2]), pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary())], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of a task's rows, block by block: COUNTERS of four bytes at most, which stop at the largest number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = _unpacked(counts).astype(np.uint32)
            sums[block] = sums[block] + np.minimum(own, ~sums[block]) if block in sums else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], names=["block", "counts"]
    )


def _order(profile: DataFrame) -> np.ndarray:
    """The counters summed over the corpus: 4 MiB, whatever the corpus."""
    blocks = profile.where("block is not null").select("block", "counts")
    blocks = blocks.mapInArrow(_summed, "block int, counts binary").repartition(16, "block").mapInArrow(_summed, "block int, counts binary")
    total = np.zeros(COUNTERS, np.uint16)
    for row in blocks.collect():
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.minimum(_unpacked(row.counts).astype(np.uint32), (1 << 16) - 1)
    return total


PREFIX = "gram bigint, doc_id bigint, key bigint, n int, at int"


class _Seen(set):
    """Fingerprints that were met before; it forgets all when it is full."""

    def met(self, f) -> bool:
        if f in self:
            return True
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(f)
        return False


def _prefixes(n: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, seen = Words(), order.value, _Seen()
        for batch in batches:
            grams, ids, keys, sizes, places = [], [], [], [], []
            for i, data in _rows(batch):
                s = shingles(data, n, words)
                size = len(s)
                if i is None or not size or seen.met(f := fingerprint(s)[0]):
                    continue
                k = size - (percent * size + 99) // 100 + 1
                rare = (counts[_counter(s)].astype(np.int64) << 32) | np.arange(size)
                rare = np.sort(np.partition(rare, k - 1)[:k]) & 0xFFFFFFFF
                grams.append(s[rare].view(np.int64))
                ids.append(np.full(k, i)), keys.append(np.full(k, f)), sizes.append(np.full(k, size, np.int32)), places.append(np.arange(k, dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, ids, keys, sizes, places)], names=["gram", "doc_id", "key", "n", "at"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), _Seen()
        for batch in batches:
            keys, sets = [], []
            for _, data in _rows(batch):
                s = shingles(data, n, words)
                if not seen.met(f := fingerprint(s)[0]):
                    keys.append(f), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "grams"])

    return run


COMPARED = "struct<linked:boolean,n:int,d:int,tokens:binary,s0:bigint,s1:bigint,s2:bigint,s3:bigint>"


def _compared(percent: int, order):
    """Are two sets similar? If asked, also what the second differs in from the
    first, in an order that depends on the first and the n-gram alone: rarely
    different ones first, as far as the counters tell."""

    def run(a: pa.Array, b: pa.Array, many: pa.Array) -> pa.Array:
        rows = []
        for x, y, full in zip(a, b, many.to_pylist(), strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            total = len(s) + len(t)
            need = -(-percent * total // (100 + percent))
            if not full:
                parts = [np.diff(np.searchsorted(u, PIVOTS), prepend=0, append=len(u)) for u in (s, t)]
                if np.minimum(*parts).sum() < need:
                    rows.append((False, len(t), None, None, None, None, None, None))
                    continue
            both = np.sort(np.concatenate([s, t]))
            same = both[1:] == both[:-1]
            linked = int(same.sum()) >= need
            if not full:
                rows.append((linked, len(t), None, None, None, None, None, None))
                continue
            own = both[~(np.append(same, False) | np.append(False, same))]
            counts = order.value
            rare = counts[_counter(own)]
            in_hub = s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own
            rare[in_hub] = counts[_counter(s)].max() - rare[in_hub]
            rows.append((linked, len(t), len(own), own[np.lexsort((own, rare))].tobytes(), *map(int, parity(t))))
        kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["linked", "n", "d", "tokens", "s0", "s1", "s2", "s3"])

    return run


def _sum(n: str, m: str):
    return F.col(n).cast("long") + F.col(m)


def _of_like_size(percent: int, n: str, m: str):
    return 100 * F.least(F.col(n).cast("long"), F.col(m).cast("long")) >= percent * F.greatest(F.col(n).cast("long"), F.col(m).cast("long"))


def _may_link(percent: int, a: str, b: str):
    """Length and positional filters on columns n and at of both sides."""
    na, nb, pa_, pb = (F.col(k).cast("long") for k in (f"{a}_n", f"{b}_n", f"{a}_at", f"{b}_at"))
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return _of_like_size(percent, f"{a}_n", f"{b}_n") & ((100 + percent) * most >= percent * (na + nb))


def _shared(percent: int, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix n-grams, each once.

    Beyond the prefixes a pair can share no more n-grams than the larger of
    the rests has; the prefixes must share what else it needs.
    """
    rest = lambda n: F.floor((percent * F.col(n).cast("long") + 99) / 100) - 1
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"))
    most = F.col("shared") + F.greatest(rest("a_n"), rest("b_n"))
    return pairs.where((100 + percent) * most >= percent * _sum("a_n", "b_n")).select("a", "b")


MARKS = 1 << 23


def _marks(ids: np.ndarray) -> np.ndarray:
    """Two places of each id in the table of marks."""
    h = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * MIX
    return np.stack([h >> np.uint64(41), (h >> np.uint64(18)) & np.uint64(MARKS - 1)]).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(MARKS, bool)
    for batch in batches:
        table[_marks(batch.column(0).to_numpy()).ravel()] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], names=["marks"])


def _joined_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(MARKS // 8, np.uint8)
    for batch in batches:
        for marks in batch.column(0):
            table |= np.frombuffer(marks.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["marks"])


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be in ids: a Bloom filter of a fixed 1 MiB
    spares the shuffle of most other texts; a join afterwards is exact."""
    marks = ids.select("doc_id").mapInArrow(_marked, "marks binary").repartition(8).mapInArrow(_joined_marks, "marks binary")
    table = np.zeros(MARKS // 8, np.uint8)
    for row in marks.collect():
        table |= np.frombuffer(row.marks, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def hit(own: pa.Array) -> pa.Array:
        x, y = _marks(own.fill_null(-1).to_numpy(zero_copy_only=False))
        bits = lambda k: (held.value[k >> 3] >> (7 - (k & 7))) & 1
        return pa.array((bits(x) & bits(y)).astype(bool))

    return docs.where(F.arrow_udf(hit, "boolean")("doc_id"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, order) -> DataFrame:
    """The pairs (a, b, many) of set keys, each given once, with what comparing them found."""
    pairs = written(pairs.select("a", "b", "many"), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(wanted, classes.f1 == wanted.key).select("key", F.col("least").alias("doc_id")), "wanted")
    texts = _maybe(docs, wanted).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(n), "key bigint, grams binary").join(wanted.select("key").distinct(), "key", "left_semi")
    sets = written(sets.groupBy("key").agg(F.first("grams").alias("grams")), "sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("a_grams")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("b_grams")), "b")
    found = both.withColumn("found", F.arrow_udf(_compared(percent, order), COMPARED)("a_grams", "b_grams", "many"))
    compared = written(found.select("a", "b", "many", "found.*"), "compared")
    dropped(pairs, wanted, sets)
    return compared


def _meetings(docs: DataFrame, n: int, percent: int, order) -> DataFrame:
    """Sets on their prefix n-grams, without n-grams of a single set; ``together`` counts the sets of the n-gram."""
    # dealt out by n-gram once: what follows needs no other shuffle
    rows = docs.mapInArrow(_prefixes(n, percent, order), PREFIX).repartition("gram")
    rows = rows.groupBy("gram", "key", "n").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"))
    rows = rows.withColumn("together", F.count("*").over(Window.partitionBy("gram"))).where("together > 1")
    # sizes of similar sets differ by one band at most; a little more than 100 / percent a band is safe from rounding
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int")
    return written(rows.withColumn("band", band), "meetings")


def _hub_pairs(meet: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, many): every set b with hubs a of its n-grams, each pair once."""
    first = F.min(F.struct("doc_id", "key", "n", "at")).alias("hub")
    few = meet.where(f"together <= {FEW}")
    few = few.join(few.groupBy("gram").agg(first), "gram").select(
        F.col("key").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("hub.key").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.at").alias("a_at")
    )
    few = _worth_comparing(_shared(percent, few.where("a <> b").where(_may_link(percent, "a", "b"))), classes, percent)
    many = meet.where(f"together > {FEW}").withColumn("cell", F.explode(F.array("band", F.col("band") + 1)))
    many = many.join(many.groupBy("gram", "cell").agg(first), ["gram", "cell"]).select(F.col("hub.key").alias("a"), F.col("key").alias("b")).where("a <> b")
    both = few.withColumn("many", F.lit(False)).unionByName(many.distinct().withColumn("many", F.lit(True)))
    return both.groupBy("a", "b").agg(F.max("many").alias("many"))


def _excess(percent: int):
    """x of a set: two sets that share a hub are surely similar if their x sum to
    0 or less, and else need (xa + xb) / (2 (100 + percent)) common differences."""
    return (100 + percent) * F.col("d").cast("long") - (100 - percent) * F.col("n").cast("long")


def _around_hubs(compared: DataFrame, percent: int) -> DataFrame:
    """Sets with many others on an n-gram: (hub, key, x, star, bound, ...).

    ``star``: surely similar to the set ``centre`` of least x. ``bound``: the
    least x of a set that such a one may still have to be compared with.
    """
    own = compared.where("many").select(F.col("a").alias("hub"), F.col("b").alias("key"), _excess(percent).alias("x"), "n", "d", *PARITY)
    least = own.groupBy("hub").agg(F.min(F.struct("x", "key")).alias("least"))
    own = own.join(least, "hub").withColumn("star", F.col("x") + F.col("least.x") <= 0)
    outside = own.where("not star").groupBy("hub").agg(F.min("x").alias("outside"))
    own = own.join(outside, "hub", "left").withColumn("bound", F.when(F.col("star"), F.col("outside")).otherwise(F.col("least.x")))
    return written(own.withColumn("centre", F.col("least.key")).drop("least", "outside"), "around")


DIFFERENCES = "hub bigint, gram bigint, key bigint, n int, d int, x bigint, at int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _differences(percent: int):
    """Prefixes of the differences with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, x, bound = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            length = np.maximum(0, d - np.maximum(1, -(-(x + bound) // (2 * (100 + percent)))) + 1)
            part = np.cumsum(length) // ROWS
            for k in np.unique(part):
                rows = np.flatnonzero(part == k)
                tokens = [np.frombuffer(batch.column(6)[int(r)].as_py(), np.int64)[: length[r]] for r in rows]
                again = pa.array(np.repeat(rows, length[rows]))
                own = [batch.column(c).take(again) if c not in (5, 6) else None for c in range(11)]
                at = np.concatenate([np.arange(length[r], dtype=np.int32) for r in rows])
                columns = [own[0], pa.array(np.concatenate(tokens)), *own[1:5], pa.array(at), *own[7:11]]
                yield pa.RecordBatch.from_arrays(columns, names=["hub", "gram", "key", "n", "d", "x", "at", *PARITY])

    return run


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _spread(rows: DataFrame, *on: str) -> DataFrame:
    """Rows whose n-gram is in several components."""
    several = rows.groupBy(*on).agg(F.min("label").alias("x0"), F.max("label").alias("x1")).where("x0 < x1")
    return rows.join(several.select(*on), [*on], "left_semi")


def _other(rows: DataFrame, *on: str) -> DataFrame:
    return rows.select(*on, *(F.col(c).alias(f"b_{c}") for c in rows.columns if c not in on))


def _near(percent: int, a: str = "a_", b: str = "b_"):
    """The parity filter on n and the parity bits of both sides."""
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in PARITY), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * _sum(f"{a}n", f"{b}n")


def _worth_comparing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys that pass the parity filter."""
    bits = classes.select("f1", "n", *PARITY).dropDuplicates(["f1"])
    side = lambda k: bits.select(F.col("f1").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("n", *PARITY)))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near(percent)).select("a", "b")


def _few(meet: DataFrame, labels: DataFrame) -> DataFrame:
    """Few sets on an n-gram that are still in several components."""
    return written(_spread(_labelled(meet.where(f"together <= {FEW}"), labels), "gram").select("gram", "key", "label", "n", "at"), "few")


def _few_pairs(few: DataFrame, percent: int) -> DataFrame:
    one = few.select("gram", *(F.col(c).alias(f"a_{c}") for c in ("key", "label", "n", "at")))
    met = one.join(_other(few, "gram"), "gram").where("a_label < b_label").where(_may_link(percent, "a", "b"))
    return _shared(percent, met.withColumn("a", F.col("a_key")).withColumn("b", F.col("b_key")))


def _difference_rows(around: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    tokens = compared.where("many").select(F.col("a").alias("hub"), F.col("b").alias("key"), "tokens")
    rows = around.where("bound is not null").join(tokens, ["hub", "key"]).select("hub", "key", "n", "d", "x", "bound", "tokens", *PARITY)
    return written(rows.mapInArrow(_differences(percent), DIFFERENCES), "differences")


def _may_pair(percent: int):
    """Length, positional and parity filters on two sets of different components that share a hub."""
    rest = F.least(F.col("a_d") - F.col("a_at"), F.col("b_d") - F.col("b_at")) - 1
    enough = 2 * (100 + percent) * (F.least("a_at", "b_at") + 1 + rest).cast("long") >= F.col("a_x") + F.col("b_x")
    return (F.col("a_label") != F.col("b_label")) & _of_like_size(percent, "a_n", "b_n") & enough & _near(percent)


def _central_pairs(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Every set with the one nearest to the hub on each of its differences: one
    partner for each, after which most of a group is in one component."""
    rows = _labelled(rows, labels)
    own = ["x", "key", "label", "n", "d", "at", *PARITY]
    # differences within one component have no partner to find
    best = rows.groupBy("hub", "gram").agg(F.min(F.struct(*own)).alias("best"), F.min("label").alias("x0"), F.max("label").alias("x1")).where("x0 < x1").select("hub", "gram", *(F.col(f"best.{c}").alias(f"a_{c}") for c in own))
    met = best.join(_other(rows, "hub", "gram"), ["hub", "gram"]).where(_may_pair(percent))
    return met.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def _many_pairs(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a hub, by their differences with it."""
    rows = _spread(_labelled(rows, labels), "hub", "gram")
    one = rows.select("hub", "gram", *(F.col(c).alias(f"a_{c}") for c in rows.columns if c not in ("hub", "gram")))
    met = one.join(_other(rows, "hub", "gram"), ["hub", "gram"]).where("a_label < b_label").where(_may_pair(percent))
    return met.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = picked(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    profile = written(docs.mapInArrow(_profile(n), PROFILE), "profile")
    order = spark.sparkContext.broadcast(_order(profile))
    key = ["n", "f1", "f2"]
    known = profile.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy(*key).agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in PARITY)), "classes")
    sets = written(profile.where("block is null").select("doc_id", *key), "documents")
    dropped(profile)

    meet = _meetings(docs, n, percent, order)
    compared = _verified(_hub_pairs(meet, classes, percent), docs, classes, n, percent, order)
    around = _around_hubs(compared, percent)
    sure = around.where("star and key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    # an id of several sets is one document
    known = sets.where("n > 0 and doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("top")).where("a < top")
    ids = known.join(ids, "doc_id").select("a", F.col("f1").alias("b")).where("a <> b").distinct()
    links = written(compared.where("linked").select("a", "b").unionByName(sure).unionByName(ids), "links")
    rows = _difference_rows(around, compared, percent)
    dropped(compared, around)
    labels = written(components(links), "labels")
    dropped(links)

    def grown(labels: DataFrame, pairs: DataFrame, *read: DataFrame) -> DataFrame:
        """Labels with the links among the pairs; ``read`` are the tables that the pairs are made of."""
        compared = _verified(pairs.withColumn("many", F.lit(False)), docs, classes, n, percent, order)
        dropped(*read)
        known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        more = written(components(known.unionByName(compared.where("linked").select("a", "b"))), "labels")
        dropped(compared, labels)
        return more

    labels = grown(labels, _central_pairs(rows, labels, percent))
    few = _few(meet, labels)
    dropped(meet)
    pairs = _worth_comparing(_few_pairs(few, percent), classes, percent)
    labels = grown(labels, pairs.unionByName(_many_pairs(rows, labels, percent)).distinct(), rows, few)
    found = _least(classes, labels)
    dropped(classes, labels)

    out = sets.join(found, key, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def _least(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest id of the component of each class of equal sets."""
    labelled = classes.join(labels, classes.f1 == labels.node, "left").withColumn("label", F.coalesce("label", "f1"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return written(labelled.join(least, "label").select("n", "f1", "f2", "component_id"), "components")
