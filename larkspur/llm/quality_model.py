"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every document. Spark
counts the vote patterns over all documents (at most 3^8 of them), and
expectation-maximisation over the counts estimates how often each labeller
votes what on good documents and on each kind of bad ones. The posteriors label
a hash sample of about SAMPLE documents, 2 SAMPLE at most, on which a logistic
scorer over hashed words and word shapes and over how much a text repeats itself
is trained. The scorer then reads every whole text; words are hashed in numpy.

Defined results: null and empty texts have no words; their score is that of the
bias alone and they are rejected. Rows are judged one by one; repeated rows get
equal results. An empty table gives an empty table. All input columns pass on.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, picked, place, with_results
from larkspur.llm.ngram_join import Words
from larkspur.runtime import ensure_importable, written

BUCKETS = 1 << 16
#: Documents that the scorer is trained on, about.
SAMPLE = 4000
EPOCHS = 60
#: Words of no weight that every text has besides its own; few words decide little.
SMOOTH = 10
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = 8
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for it was on are as with by at from this be have or an not "
        "le la les de des et en un une du que qui dans pour au est sur pas "
        "der die das und in zu den von mit ist des auf für ein eine nicht sich dem "
        "el los las y que en un una por con para es del se no al"
    ).split()
)
MARKS = (b"|", b"-", b">")


class Read:
    """The words of a text as arrays: hash (A-Z count as a-z), hash of the shape, bytes."""

    def __init__(self, data: bytes, reader: "Reader"):
        parts = [reader.segment(part) for part in reader.words.segments(data)]
        self.hashes, self.shapes, self.sizes = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, t) for t in (np.uint64, np.uint64, np.int64))


class Reader:
    """Hashes of words and of their shapes, whole texts at a time in numpy.

    A shape has one sign for a run of small letters (and of all bytes beyond
    ASCII), of capitals and of digits; of other characters' runs two stay.
    """

    SMALL, CAPITAL, DIGIT = 1, 2, 3

    def __init__(self):
        self.words, self.signs = Words(), Words(seed=18)
        self.classes = np.arange(256, dtype=np.int64) + 256
        for class_, own in ((self.SMALL, [*range(97, 123), *range(128, 256)]), (self.CAPITAL, range(65, 91)), (self.DIGIT, range(48, 58))):
            self.classes[own] = class_
        self.numbers = np.random.default_rng(19).integers(0, 1 << 64, 512, np.uint64)
        self.stop, self.marks = (np.sort(np.concatenate([self.words.hashes(w) for w in own])) for own in (sorted(STOP_WORDS), MARKS))

    def segment(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = self.words.places(b)
        kind = self.classes[b]
        same = kind[1:] == kind[:-1]
        again = np.append(False, same)
        # the third and later of a run of other characters go, and all but the first of a run of a class
        drop = again & ((kind <= self.DIGIT) | np.append(False, again[:-1]))
        drop[starts] = False
        kept = ~drop
        place = np.append(0, np.cumsum(kept))
        shapes = self.signs.sums(self.numbers[kind[kept]], place[starts], place[ends])
        return self.words.of_words(b, starts, ends), shapes, ends - starts


def _part_of(hashes: np.ndarray, known: np.ndarray) -> int:
    """How many of the hashes are known ones (sorted)."""
    return int((known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes).sum())


def _runs(hashes: np.ndarray) -> np.ndarray:
    """How often each distinct word comes."""
    h = np.sort(hashes)
    edges = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return np.diff(np.append(edges, len(h)))


def votes(data: bytes, words: Read, reader: Reader) -> int:
    """The labellers' votes as one number in base 3."""
    n = len(words.hashes)
    if not n:
        return sum(BAD * 3**k for k in range(LABELLERS))
    symbols = (len(data) - len(data.translate(None, b"#*$%&|<>"))) / n
    letters = max(1, len(data) - len(data.translate(None, LETTERS)))
    upper = (len(data) - len(data.translate(None, UPPER))) / letters
    shouts = data.count(b"!") / n
    ends = data.count(b".") + data.count(b"!") + data.count(b"?")
    stop = _part_of(words.hashes, reader.stop) / n
    marks = _part_of(words.hashes, reader.marks) / n
    distinct = len(_runs(words.hashes)) / n
    mean = int(words.sizes.sum()) / n
    out = (
        BAD if symbols > 0.3 else GOOD if symbols < 0.05 else NONE,
        BAD if upper > 0.4 else GOOD if upper < 0.2 else NONE,
        BAD if shouts > 0.3 else GOOD if shouts < 0.05 and n >= 5 else NONE,
        GOOD if stop >= 0.1 else BAD if stop < 0.02 and n >= 20 else NONE,
        GOOD if ends and 2 <= n / ends <= 60 else BAD if n >= 30 and not ends else NONE,
        BAD if marks > 0.1 else GOOD if marks < 0.01 else NONE,
        BAD if n >= 50 and distinct < 0.2 else GOOD if distinct > 0.3 else NONE,
        GOOD if 2.5 <= mean <= 14 else BAD,
    )
    return sum(v * 3**k for k, v in enumerate(out))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior probability of good for each vote pattern (rows of votes).

    Documents are good, or bad in one of LABELLERS kinds, for what makes them
    bad mostly excludes the rest. Each class has its own vote rates for each
    labeller; a labeller that doesn't vote says nothing.
    """
    bad = patterns == BAD
    # bad votes are rare and specific: to begin with, they are believed
    p = np.hstack([np.where(bad.any(1), 0.1, 0.95)[:, None], bad + 0.01])
    p[:, 1:] *= (1 - p[:, :1]) / p[:, 1:].sum(1, keepdims=True)
    onehot = np.eye(3)[patterns][:, :, :NONE]
    for _ in range(rounds):
        weight = p * counts[:, None]
        rate = np.einsum("pc,plv->clv", weight, onehot) + 0.5
        rate /= rate.sum(2, keepdims=True)
        share = (weight.sum(0) + 0.5) / (counts.sum() + 0.5 * p.shape[1])
        logit = np.log(share) + np.einsum("plv,clv->pc", onehot, np.log(rate))
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return p[:, 0]


def buckets(words: Read) -> np.ndarray:
    """Buckets of all words, then of all shapes."""
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([words.hashes >> top, (words.shapes >> top) + np.uint64(BUCKETS)]).astype(np.int64)


def whole_text(words: Read) -> np.ndarray:
    """Buckets of what the words of a text share: its length class with how
    often words, and the most frequent word, come again."""
    n, counts = len(words.hashes), _runs(words.hashes)
    length = sum(n >= k for k in (1, 5, 20, 50, 200, 1000))
    distinct, top = 10 * len(counts) // max(1, n), 10 * int(counts.max(initial=0)) // max(1, n)
    return 2 * BUCKETS + np.array([11 * length + distinct, 100 + 11 * length + top])


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; docs are (buckets, shares)."""
    w, b = np.zeros(2 * BUCKETS + 200), 0.0
    if not docs:
        return w, b
    place = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    index, share = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, EPOCHS + 1):
        z = b + np.bincount(place, w[index] * share, len(docs))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(docs)
        grad = np.bincount(index, g[place] * share, len(w)) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= 0.5 * g.sum()
    return w, b


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (data.as_py() or b"" for data in column.cast(pa.large_binary()))


def _votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    reader = Reader()
    for texts in batches:
        yield pa.array([votes(data, Read(data, reader), reader) for data in _texts(texts)], pa.int32())


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        own, index, share = [], [], []
        for data in _texts(batch.column(0)):
            words = Read(data, reader)
            i, c = np.unique(buckets(words), return_counts=True)
            own.append(votes(data, words, reader))
            index.append(np.append(i, whole_text(words)).astype(np.int32).tobytes())
            share.append(np.append(c / (len(words.hashes) + SMOOTH), [1, 1]).astype(np.float32).tobytes())
        columns = [pa.array(own, pa.int32()), pa.array(index, pa.binary()), pa.array(share, pa.binary()), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["votes", "index", "share", "drawn"])


def _scores(model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, (w, b) = Reader(), model.value
        for texts in batches:
            out = []
            for data in _texts(texts):
                words = Read(data, reader)
                z = b + w[buckets(words)].sum() / (len(words.hashes) + SMOOTH) + w[whole_text(words)].sum()
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.array(out, pa.float64())

    return run


def posteriors(patterns: dict[int, int]) -> dict[int, float]:
    """Probability of good for each vote pattern, given how often each comes."""
    rows = sorted(patterns)
    votes_of = np.array([[v // 3**k % 3 for k in range(LABELLERS)] for v in rows]).reshape(-1, LABELLERS)
    return dict(zip(rows, expectation_maximisation(votes_of, np.array([patterns[v] for v in rows], float)).tolist(), strict=True))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer for a table of documents."""
    ensure_importable(docs.sparkSession)
    voted = written(docs.select(F.arrow_udf(_votes, "int")(F.col(text)).alias("votes")), "votes")
    counted = voted.groupBy("votes").count().collect()  # 3^LABELLERS rows at most
    total = sum(r["count"] for r in counted)
    if not total:
        return fit([], np.empty(0))
    posterior = posteriors({r["votes"]: r["count"] for r in counted})

    # by id and text, so that rows of one id are drawn one by one; the smallest hashes hold the bound
    by = F.xxhash64(F.col(doc_id), F.col(text), F.lit("sample"))
    part = min(1.0, SAMPLE / total)
    drawn = docs.select(F.col(text).alias("text"), by.alias("drawn")).where(F.pmod("drawn", F.lit(1 << 30)) < int(part * (1 << 30)))
    drawn = drawn.select("text", "drawn").mapInArrow(_drawn, "votes int, index binary, share binary, drawn bigint")
    rows = drawn.orderBy("drawn", "votes", "index").limit(2 * SAMPLE).collect()
    labels = np.array([posterior[r["votes"]] for r in rows])
    return fit([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows], labels)


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with quality_score in [0, 1] and quality_kept."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(picked(docs, doc_id=doc_id, text=text)))
    own, body = by_place(docs), F.col(f"c{place(docs.columns, text)}")
    scored = own.withColumn("score", F.arrow_udf(_scores(model), "double")(body))
    has_words = F.coalesce(body, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return with_results(scored, docs.columns, {"quality_score": F.col("score"), "quality_kept": (F.col("score") >= 0.5) & has_words})
