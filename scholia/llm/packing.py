"""Best-fit decreasing packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces and one shorter first piece. Full pieces fill sequences by themselves. Where best-fit decreasing puts the
others depends on nothing but how many pieces each length has, so the plan is made once for all of them, exactly, from a histogram of at most ``length`` rows: lengths from the
longest, each run of equal pieces into the tightest open bins, which a segment tree over remaining capacities finds in logarithmic time. Equal bins are one
interval, so the plan is bounded by the lengths and not by the documents. Spark then ranks the pieces of each length and reads their places off the plan.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, trimmed

#: Pieces in one bucket, on average: what one window ranks.
BUCKET = 1 << 16


@cache
def _encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """Byte-level BPE from a vocabulary file of ranks, with tokens that whole strings stand for; read once in each worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@trimmed
def _pieces(batches, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...], length: int, end: int, with_ids: bool):
    encode = partial(_encoder(ranks_path, pattern, special).encode, allowed_special="all")
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids = np.array([*encode(text or ""), end], "<u4")
            cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
            for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                part = ids[start:stop]
                rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        yield out if with_ids else out.drop(columns="ids")


class _Rooms:
    """Open bins by remaining capacity, as intervals of bin numbers, under a segment tree whose nodes say whether any bin below them is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity from ``need`` on that an open bin has: climb until a right sibling holds one, then go down leftmost."""
        at = self.leaves + need
        while not self.tree[at]:
            while at > 1 and (at % 2 or not self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def push(self, room: int, first: int, count: int) -> None:
        self.bins[room].append((first, count))
        at = self.leaves + room
        while at and not self.tree[at]:
            self.tree[at] = 1
            at //= 2

    def pop(self, room: int) -> tuple[int, int]:
        interval = self.bins[room].pop()
        at = self.leaves + room
        if not self.bins[room]:
            self.tree[at] = 0
            while at > 1 and not self.tree[at ^ 1]:
                at //= 2
                self.tree[at] = 0
        return interval


#: A row says: the pieces of this length from this rank on are placed, ``each`` to a bin, from bin ``first`` on, at this offset.
_PLAN = np.dtype([("length", np.int64), ("rank", np.int64), ("first", np.int64), ("each", np.int64), ("offset", np.int64)])


def best_fit_plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing of ``counts[n]`` pieces of every length n (1..capacity), as intervals of equal placements in order of length and rank.

    Piece by piece the rule puts a length into the tightest bin that holds it and, while more of it fits there, keeps to that bin, which has become tighter. So a
    bin takes as many equal pieces as fit before the next bin is touched, and equal bins are filled alike.
    """
    rooms, plan, used = _Rooms(capacity), [], 0
    for need in range(capacity, 0, -1):
        rank, left = 0, int(counts[need])
        while left:
            room = rooms.tightest(need)
            if room is None:  # new bins: as many as this length fills, or one
                room, first, count = capacity, used, max(1, left // (capacity // need))
                used += count
            else:
                first, count = rooms.pop(room)
            each = min(room // need, left)
            filled = min(count, left // each)
            plan.append((need, rank, first, each, capacity - room))
            if filled < count:
                rooms.push(room, first + filled, count - filled)
            if room - each * need:
                rooms.push(room - each * need, first, filled)
            rank, left = rank + filled * each, left - filled * each
    return np.sort(np.array(plan, _PLAN), order=("length", "rank"))


@trimmed
def _placed(batches, plan: np.ndarray):
    key = plan["length"] * (1 << 44) + plan["rank"]
    for batch in batches:
        length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
        found = plan[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
        inside = rank - found["rank"]
        yield batch.drop(columns="rank").assign(sequence_id=found["first"] + inside // found["each"], offset=found["offset"] + inside % found["each"] * length)


def pack_documents(documents: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, length: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all rows of ``documents`` (doc_id, text) into as few sequences of at most ``length`` tokens as best-fit decreasing over all of them finds.

    ``ranks_path`` is a vocabulary file of ranks (it must exist at that path on every worker), ``pattern`` its pre-tokeniser and ``special`` the strings that it has ids
    of their own for, wherever they stand in a text. A document is its ids and then ``end``. Returns one row per piece: doc_id, piece, start (its document's ids before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), sequence_id, offset (gapless from 0 in its sequence); and ids if asked for.

    Null or empty texts are the end token alone. Repeated rows and null ids are packed like any other row; no token is dropped. Extra columns are ignored.
    An empty table gives no rows.
    """
    kind = dict(documents.dtypes)["doc_id"]
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    read = partial(_pieces, ranks_path=ranks_path, pattern=pattern, special=tuple((special or {}).items()), length=length, end=end, with_ids=with_ids)
    pieces = cut(documents.select("doc_id", "text").mapInPandas(read, columns))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())  # stable: it numbers materialised rows
    full = numbered.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    shorter = numbered.where(F.col("length") < length)
    counts = np.zeros(length + 1, np.int64)
    for r in shorter.groupBy("length").count().collect():  # a row for each length
        counts[r["length"]] = r["count"]
    plan = best_fit_plan(counts, length)
    # ranks among pieces of one length: those in the buckets before, then those before it in its own bucket
    dealt = shorter.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-int(counts.sum()) // BUCKET)))).cast("int"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = dealt.withColumn("inside", inside).join(small_side(before, 64), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    packed = ranked.select(*pieces.columns, "rank").mapInPandas(partial(_placed, plan=plan), f"{columns}, sequence_id long, offset long")
    return packed.unionByName(full)
