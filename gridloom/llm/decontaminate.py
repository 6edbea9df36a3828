"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

A window is ``n`` consecutive item words; an item of fewer words, but not none, is one window. Words are
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Hash hits are verified on the words themselves.

Cases: null or wordless texts have no words and no hits; windows shared by several items count for each of them; a
null item_id or item text is no item; rows that repeat an item_id are one item with the windows of all; an empty
benchmark hits nothing; a very long text is scanned whole, alone in its piece; other columns pass by (``clean_documents`` keeps all columns of docs).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as T
from gridloom.llm._spark import dropped, only, stored

#: Words of the benchmark that may be broadcast (about 60 bytes each with their window); a larger set goes in parts.
PART_WORDS = 1_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_AZ))


class Windows:
    """Hash set of the windows of items: sorted hashes by window length, and for each its words and items."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        by_length: dict[int, dict[int, list[tuple[str, set[str]]]]] = {}
        for item, text in items:
            data, bounds = T.utf8(pa.array([text], pa.string()))
            w = T.Words(data, bounds, T.ALNUM_WORD)
            own = words_of(text)
            assert len(own) == len(w.hash)
            if not own:
                continue
            size = min(n, len(own))
            hashes = w.window(np.arange(len(own) - size + 1), size)
            for i, h in enumerate(hashes.tolist()):
                said = "\x00".join(own[i : i + size])
                spot = by_length.setdefault(size, {}).setdefault(h, [])
                for known, who in spot:
                    if known == said:
                        who.add(item)
                        break
                else:
                    spot.append((said, {item}))
        self.by_length = {size: (np.array(sorted(found), dtype=T.U64), found) for size, found in by_length.items()}

    def scan(self, words: T.Words):
        """(row, start word, length, items) of each verified hit."""
        for size, (hashes, found) in self.by_length.items():
            starts, first = words.windows(size)
            if not len(starts):
                continue
            h = words.window(starts, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for j in np.flatnonzero(hashes[at] == h).tolist():
                s = int(starts[j])
                said = "\x00".join(bytes(T.LOWER[words.bytes[words.starts[x] : words.ends[x]]]).decode("utf-8", "replace") for x in range(s, s + size))
                for known, who in found[int(h[j])]:
                    if known == said:
                        yield int(np.searchsorted(first, j, side="right")) - 1, s, size, who


def _hits(windows):
    """Adds the hits of one hash set to the columns items and marks (merged word ranges) that earlier sets left."""

    def run(batches):
        known = windows.value
        for batch in batches:
            data, bounds = T.utf8(batch.column(1))
            earlier = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("items", "marks")]
            for lo, hi in T.pieces(bounds):
                words = T.Words(data, bounds[lo : hi + 1], T.ALNUM_WORD)
                rows = hi - lo
                items: list[set[str]] = [set(x or ()) for x in earlier[0][lo:hi]]
                marks = [[(m["start"], m["stop"]) for m in x or ()] for x in earlier[1][lo:hi]]
                for row, start, size, who in known.scan(words):
                    start -= int(words.first[row])
                    marks[row].append((start, start + size))
                    items[row] |= who
                points = None
                merged, chars, n_hit = [], [], []
                for row in range(rows):
                    spans: list[list[int]] = []
                    for a, b in sorted(marks[row]):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    n_hit.append(sum(b - a for a, b in spans))
                    merged.append([{"start": a, "stop": b} for a, b in spans])
                    if spans:
                        points = T.code_points(words.bytes) if points is None else points
                        zero, w = points[words.row_bytes[row]], int(words.first[row])
                        chars.append([{"start": int(points[words.starts[w + a]] - zero), "stop": int(points[words.ends[w + b - 1]] - zero)} for a, b in spans])
                    else:
                        chars.append([])
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(np.diff(words.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(chars, span), pa.array(merged, span)],
                    names=["doc_id", "text", "n_words", "n_hit", "items", "spans", "marks"],
                )

    return run


#: Columns that hold the hits of a document while it is cleaned.
ITEMS, SPANS, MARKS = "__items", "__spans", "__marks"
_SPANS = "array<struct<start:long,stop:long>>"
HITS = f"doc_id long, text string, n_words long, n_hit long, items array<string>, spans {_SPANS}, marks {_SPANS}"


def _windows(benchmark: DataFrame, item: str, text: str, n: int):
    """Hash sets of the benchmark, each of a bounded number of words; items stream to the driver one part at a time."""
    own = only(benchmark, item=f"{item}:string", text=f"{text}:string").filter("item is not null and text is not null")
    part, size = [], 0
    for row in own.orderBy("item", "text").toLocalIterator():
        part.append((row[0], row[1]))
        size += len(words_of(row[1]))
        if size >= PART_WORDS:
            yield Windows(part, n)
            part, size = [], 0
    if part:
        yield Windows(part, n)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text, n_words, n_hit, items (sorted ids of items with a window in the text), spans (code points of the
    merged hits), marks (the same in words) for each row of docs. A benchmark beyond PART_WORDS words is scanned part
    by part, each part's hits merged with those before, so a broadcast never grows with it."""
    spark = docs.sparkSession
    now = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string").withColumns({"items": F.array().cast("array<string>"), "marks": F.array().cast(_SPANS)})
    last = None
    for part in _windows(benchmark, item, item_text, n):
        if last is not None:
            # The driver and the workers hold one part at a time: its hits are settled before the next is built.
            fresh = stored(now, "hits")
            last.unpersist()
            dropped(now)
            now = fresh
        last = spark.sparkContext.broadcast(part)
        now = now.mapInArrow(_hits(last), HITS)
    return now if last is not None else now.mapInArrow(_hits(spark.sparkContext.broadcast(Windows([], n))), HITS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 1, span_only: bool = False, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs, same columns, without contaminated documents (hits of at least least_items items), or with ``span_only``
    without the hit spans of their texts, whose length column, if there, is brought up to date. The hits of all parts of
    a benchmark beyond PART_WORDS words count together."""
    spark, names = docs.sparkSession, docs.columns
    now = docs.withColumns({ITEMS: F.array().cast("array<string>"), SPANS: F.array().cast(_SPANS), MARKS: F.array().cast(_SPANS)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)
    at, last = names.index(text), None
    for part in _windows(benchmark, item, item_text, n):
        if last is not None:
            fresh = stored(now, "clean")
            last.unpersist()
            dropped(now)
            now = fresh
        last = spark.sparkContext.broadcast(part)
        now = now.mapInArrow(_scanned(last, at), schema)
    if not span_only:
        return now.filter(F.size(ITEMS) < least_items).select(*[F.col(f"`{c}`") for c in names])
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return now.mapInArrow(_cut(at, names.index(length) if length in names else None, least_items), plain)


def _scanned(windows, at: int):
    """Rows of any columns, the text's place among them given, with the last three brought up to date by _hits."""
    find = _hits(windows)

    def run(batches):
        for batch in batches:
            k, rows = batch.num_columns, batch.num_rows
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), batch.column(at), batch.column(k - 3), batch.column(k - 1)], names=["row", "text", "items", "marks"])
            for out in find([pair]):
                if out.num_rows:
                    own = batch.slice(out.column(0)[0].as_py(), out.num_rows)
                    yield pa.RecordBatch.from_arrays([*own.columns[: k - 3], *out.columns[4:7]], names=batch.schema.names)

    return run


def _cut(at: int, n_at: int | None, least_items: int):
    def run(batches):
        for batch in batches:
            k = batch.num_columns
            texts = batch.column(at).to_pylist()
            sizes = batch.column(n_at).to_pylist() if n_at is not None else None
            for i, (items, spans) in enumerate(zip(batch.column(k - 3).to_pylist(), batch.column(k - 2).to_pylist(), strict=True)):
                if items and len(items) >= least_items:
                    for span in reversed(spans):
                        texts[i] = texts[i][: span["start"]] + texts[i][span["stop"] :]
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            own = pa.RecordBatch.from_arrays(batch.columns[: k - 3], names=batch.schema.names[: k - 3])
            own = own.set_column(at, own.schema.field(at), pa.array(texts, own.schema.field(at).type))
            if sizes is not None:
                own = own.set_column(n_at, own.schema.field(n_at), pa.array(sizes, own.schema.field(n_at).type))
            yield own

    return run


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op9(docs: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    h = benchmark_hits(docs, benchmark, n)
    return h.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )
