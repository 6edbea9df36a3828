"""Variable-capacity best-fit packing of documents into training sequences.

A document has its words plus one separator; one longer than the largest size is cut into pieces. Only the histogram of
piece lengths, at most as long as the largest size, reaches the driver. There every length, longest first, goes to the
open bin that it fits tightest, of equally tight ones the one filled last; where none fits, the size of least expected
cost a token is opened, its filling looked ahead in what the histogram still holds; bins of like contents are one
pattern with a multiplicity, so the work doesn't grow with the corpus. Last, each bin shrinks to the smallest size that holds its contents. Pieces find their bins by
their rank among the pieces of their length, which is counted in salted buckets.

Cases: a very long text is cut into pieces of the largest size; null or wordless text is a piece of length 1 (the separator); rows that repeat are packed each for itself; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._spark import only, stored

SIZES = (512, 1024, 2048, 4096)
BUCKET_ROWS = 20_000


def _fill(size: int, first: int, left: np.ndarray, below: np.ndarray) -> int:
    """Tokens that a bin of this size would hold: first, then always the longest left that fits."""
    room, used = size - first, first
    spent: dict[int, int] = {first: 1}
    reach = min(room, first)
    while reach > 0:
        item = int(below[reach])
        if not item:
            break
        free = int(left[item]) - spent.get(item, 0)
        take = min(free, room // item)
        if take > 0:
            spent[item] = spent.get(item, 0) + take
            room -= take * item
            used += take * item
        reach = min(room, item - 1)
    return used


def plan(counts: dict[int, int], sizes=SIZES, overhead: int = 32) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(size, number of bins, [(length, how many in each)]) for a histogram of lengths up to the largest size."""
    sizes = sorted(sizes)
    left = np.zeros(sizes[-1] + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    rooms: list[int] = []
    held: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, many: int, items: list[tuple[int, int]]) -> None:
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append((many, items))

    def pop(room: int) -> tuple[int, list[tuple[int, int]]]:
        out = held[room].pop()
        if not held[room]:
            del held[room]
            rooms.remove(room)
        return out

    for length in range(sizes[-1], 0, -1):
        while left[length] > 0:
            n = int(left[length])
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
                size = min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / _fill(s, length, left, below), s))
                each = size // length
                put(size, -(-n // each) if n < 4 * each else max(1, n // each // 4), [])
                continue
            room = rooms[at]
            many, items = pop(room)
            each = room // length
            full = min(many, n // each)
            if full:
                if many > full:
                    put(room, many - full, items)
                put(room - each * length, full, [*items, (length, each)])
                left[length] -= full * each
            else:
                if many > 1:
                    put(room, many - 1, items)
                put(room - n * length, 1, [*items, (length, n)])
                left[length] = 0
    out = []
    for room in rooms:
        for many, items in held[room]:
            used = sum(length * n for length, n in items)
            if used:
                out.append((next(s for s in sizes if s >= used), many, items))
    return out


def slots(patterns) -> dict[str, np.ndarray]:
    """Rank ranges of each length: sorted rows (length, first rank, how many in a bin, first bin, offset, size)."""
    rows, rank, first = [], {}, 0
    for size, many, items in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, rank.get(length, 0), each, first, offset, size))
            rank[length] = rank.get(length, 0) + each * many
            offset += length * each
        first += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(len(rows), 6)
    return dict(zip(("length", "rank", "each", "bin", "offset", "size"), table.T, strict=True))


def _assign(held):
    def run(batches):
        s = held.value
        key = s["length"] * (1 << 48) + s["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            q = rank - s["rank"][at]
            cols = [batch.column(i) for i in range(3)] + [pa.array(length), pa.array(s["bin"][at] + q // s["each"][at]), pa.array(s["size"][at]), pa.array(s["offset"][at] + q % s["each"][at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_offset"])

    return run


def pack(docs: DataFrame, sizes=SIZES, overhead: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start (words before it), length, bin_id, bin_size, bin_offset of each piece."""
    top = max(sizes)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string").select("doc_id", words.alias("n"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece")
    pieces = base.select("doc_id", "n", piece).select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length"))
    pieces = stored(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    held = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, sizes, overhead)))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("r", within - 1).join(offsets, ["length", "bucket"]).select("doc_id", "piece", "start", "length", (F.col("r") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_assign(held), "doc_id long, piece long, start long, length long, bin_id long, bin_size long, bin_offset long")


def op4(docs: DataFrame) -> DataFrame:
    return pack(docs)
