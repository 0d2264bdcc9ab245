"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Tasks turn whole texts into ids (byte-level BPE, then id 0) and cut only longer
documents; the first piece takes the odd length, the others are full. Pieces
are dealt by hash into groups of about GROUP pieces, which are packed by
best-fit decreasing: a segment tree over remaining capacities finds the
tightest open sequence in logarithmic time. Sequences of a group that stay
clearly open are dissolved and packed again together with those of other
groups, in groups of the same size, once.

The ids are those of the tokenizers library for the vocabulary file; tiktoken
computes them, for it takes a tenth of the time with the same vocabulary.
Texts that hold the special token's string go to the tokenizers library.

Defined results: null text is the empty text: one piece, id 0. Repeated rows
are packed as often as they come. An empty table gives an empty table. Only id
and text are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.columns import picked
from larkspur.runtime import ensure_importable, written

CAPACITY = 2048
GROUP = 2048
#: A sequence with more room than this is packed again.
OPEN = 64
ROUNDS = 2
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """text -> numpy array of ids."""
    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint"


def _pieces(paths: tuple[str, str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, row = encoder(*paths), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(0)).astype("<u4")
                start, end = 0, (len(ids) - 1) % CAPACITY + 1
                piece = 0
                while start < len(ids):
                    own = ids[start:end]
                    out.append((doc_id, piece, start, end - start, zlib.crc32(own.tobytes()), row, own.tolist() if with_ids else None))
                    start, end, piece, row = end, end + CAPACITY, piece + 1, row + 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"][: 7 if with_ids else 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)], names=names)

    return run


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length; lengths come in falling order.

    Leaf r of the tree says whether a bin with room r is open; a node holds
    whether any leaf below it does. The search climbs from leaf ``length`` to
    the first open leaf at or right of it.
    """
    size = 1 << capacity.bit_length()
    tree = bytearray(2 * size)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = [], 0
    for length in lengths:
        at = size + length
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            at = at + 1 if at > 1 else 0
            while at and at < size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        if at:
            room = at - size
            own = bins[room].pop()
            if not bins[room]:
                while at and not (tree[2 * at] or tree[2 * at + 1] if at < size else bins[room]):
                    tree[at] = 0
                    at >>= 1
        else:
            room, own, n = capacity, n, n + 1
        out.append((own, capacity - room))
        room -= length
        if room:
            bins[room].append(own)
            at = size + room
            while at and not tree[at]:
                tree[at] = 1
                at >>= 1
    return out


PLACED = "row bigint, bin bigint, offset bigint, room bigint, length bigint"


def _packed(group: pa.Table) -> pa.Table:
    length = group["length"].to_numpy()
    order = np.lexsort((group["row"].to_numpy(), -length))
    length = length[order]
    found = np.array(best_fit(length.tolist()), np.int64).reshape(-1, 2)
    used = np.bincount(found[:, 0], weights=length).astype(np.int64)
    return pa.table({
        "row": group["row"].to_numpy()[order], "bin": found[:, 0] + (group["group"][0].as_py() << 32), "offset": found[:, 1],
        "room": CAPACITY - used[found[:, 0]], "length": length,
    })


def _dealt(pieces: DataFrame, salt: int) -> DataFrame:
    """(row, length) packed, group by group."""
    groups = max(1, -(-pieces.count() // GROUP))
    group = F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.lit(groups))
    return written(pieces.select("row", "length", group.alias("group")).groupBy("group").applyInArrow(_packed, PLACED), "packed")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the ids themselves."""
    ensure_importable(docs.sparkSession)
    paths = public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken")
    docs = picked(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = written(docs.mapInArrow(_pieces(paths, with_ids), PIECES + ", ids array<int>" * with_ids), "pieces")
    todo, done = pieces, []
    for salt in range(ROUNDS):
        placed = _dealt(todo, salt).withColumn("sequence_id", F.col("bin") * ROUNDS + salt)
        last = salt == ROUNDS - 1
        done.append(placed if last else placed.where(f"room <= {OPEN}"))
        todo = placed.where(f"room > {OPEN}")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    out = pieces.join(placed.select("row", "sequence_id", "offset"), "row")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*names, *["ids"] * with_ids)
