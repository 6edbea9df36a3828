"""Repeated passages across documents by sparse suffix arrays.

A passage is a run of ``least`` words (default 50) or more that another document has too. Of all suffixes only those at
minimiser positions are kept: where the hash of ``k`` words is least among ``reach`` positions in a row. Any window of
``least`` words has such a position among its first ``reach``, the same in every document, from which at least
``least - reach + 1`` equal words follow. Three rounds of sorting and comparing neighbours:

1. the suffixes, by the hash of that many words; those without a like neighbour in another document are gone;
2. each match, extended as far left and right as a window around it can reach, by the hash of the whole range: equal
   ranges settle all their windows at once;
3. what is left (ends of passages, short ones, places of edits): the single windows around the match. Where a suffix has
   more than one range, two documents of each settled range join in, as others may be like a part of it: the smallest at
   all its places, and the largest at one, since the smallest may be the only other one that has such a part.

A round first sorts what a task holds; rows that have a like neighbour there are settled, and those of the smallest
document alone go into the shuffle for their key, so a passage in a third of all documents sends few rows a task.
``later_spans`` are all windows that a document of smaller id has too; the smallest document with a window never counts
it as later, so removing later spans loses no passage.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, hashed to 64 bits.

Cases: null, empty or shorter texts have no windows; rows that repeat a doc_id are one document to each other; a null
doc_id takes no part; a very long text is one piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as T
from gridloom.llm._spark import dropped, only, stored

#: Rows that a task sorts at once before the shuffle.
HELD_ROWS = 400_000
#: Up to so many (document, position) pairs a Bloom filter of FILTER_BITS (32 MB, whatever the input) tells the texts
#: which matches to look at again; a false hit only adds windows that the comparison then leaves out. Beyond them, texts
#: are joined with their positions by a shuffle.
SPOTS_MOST = 1 << 25
FILTER_BITS = 1 << 28

#: Suffixes at most that are told to every task, as each has more than one in so many of all ranges.
HOT_MOST = 4096

_RANGE = "doc_id long, a int, b int, ca int, cb int"
_FOUND = f"key long, {_RANGE}, pos int, wide long, matched boolean, later boolean"


def minimisers(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose hash is the first least one of some reach consecutive positions; all in one text."""
    n = len(hashes)
    if n < reach:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, reach)
    return np.unique(view.argmin(axis=1) + np.arange(n - reach + 1))


def _rows(words: T.Words, points: np.ndarray, ids: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, key: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    """Ranges lo..hi (words of the whole buffer) with their code points, relative to their texts."""
    first = words.first[row]
    zero = points[words.row_bytes[row]]
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(T.signed(key)), pa.array(ids[row]), i32(lo - first), i32(hi - first), i32(points[words.starts[lo]] - zero), i32(points[words.ends[hi - 1]] - zero), i32(pos - first), pa.array(T.signed(wide))],
        names=["key", "doc_id", "a", "b", "ca", "cb", "pos", "wide"],
    )


def _anchors(words: T.Words, least: int, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the buffer at which kept suffixes start, and their rows."""
    right = least - reach + 1
    starts, first = words.windows(k)
    h = words.window(starts, k)
    out, own = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(len(words.first) - 1):
        n = words.first[i + 1] - words.first[i]
        if n >= least:
            at = minimisers(h[first[i] : first[i + 1]], reach)
            at = at[at + right <= n]
            out.append(at + words.first[i])
            own.append(np.full(len(at), i))
    return np.concatenate(out), np.concatenate(own)


def _suffixes(least: int, k: int, reach: int):
    right = least - reach + 1

    def run(batches):
        for batch in batches:
            data, bounds = T.utf8(batch.column(1))
            ids = np.asarray(batch.column(0))
            for lo, hi in T.pieces(bounds):
                words = T.Words(data, bounds[lo : hi + 1], T.BLANK_WORD)
                at, row = _anchors(words, least, k, reach)
                if len(at):
                    a, b = np.maximum(at - reach + 1, words.first[row]), np.minimum(at + least, words.first[row + 1])
                    yield _rows(words, T.code_points(words.bytes), ids[lo:hi], row, a, b, at, words.window(at, right), words.window(a, b - a))

    return run


def _bits(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Three filter positions of each (document, position)."""
    x = T.mix(doc.astype(np.int64).view(T.U64) * T.U64(0x9E3779B97F4A7C15) + pos.astype(np.int64).view(T.U64) * T.U64(0xC2B2AE3D27D4EB4F))
    m = T.U64(FILTER_BITS - 1)
    return np.stack([x & m, (x >> T.U64(32)) & m, T.mix(x) & m], axis=1)


def _filter_words(batches):
    """(word, mask) of the filter's 64-bit words that the spots set, each word once a batch."""
    for batch in batches:
        if batch.num_rows:
            bits = np.unique(_bits(np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            word, start = np.unique(bits >> T.U64(6), return_index=True)
            mask = np.bitwise_or.reduceat(T.U64(1) << (bits & T.U64(63)), start)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(T.signed(mask))], names=["word", "mask"])


def _filter(spots: DataFrame) -> np.ndarray:
    rows = spots.mapInArrow(_filter_words, "word int, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("mask"))
    return out.view(T.U64)


def _around(words: T.Words, ids: np.ndarray, spots: list[np.ndarray], least: int, reach: int) -> pa.RecordBatch | None:
    """The windows that start up to reach - 1 words before the spots of each text, each once."""
    out, own = [], []
    for i, at in enumerate(spots):
        n = int(words.first[i + 1] - words.first[i])
        at = (at.astype(np.int64)[:, None] - np.arange(reach)[None, :]).ravel()
        at = np.unique(at[(at >= 0) & (at + least <= n)])
        out.append(at + words.first[i])
        own.append(np.full(len(at), i))
    at, row = np.concatenate(out), np.concatenate(own)
    if not len(at):
        return None
    h = words.window(at, least)
    return _rows(words, T.code_points(words.bytes), ids, row, at, at + least, at, h, h)


def _windows(least: int, k: int, reach: int, bitmap=None):
    """Windows around the spots of a text: those of its third column, or without one those that the filter knows."""

    def run(batches):
        for batch in batches:
            data, bounds = T.utf8(batch.column(1))
            ids = np.asarray(batch.column(0))
            for lo, hi in T.pieces(bounds):
                words = T.Words(data, bounds[lo : hi + 1], T.BLANK_WORD)
                if bitmap is None:
                    spots = [np.asarray(batch.column(2)[i].values) for i in range(lo, hi)]
                else:
                    at, row = _anchors(words, least, k, reach)
                    pos = at - words.first[row]
                    bits = _bits(ids[lo + row], pos)
                    hit = ((bitmap.value[(bits >> T.U64(6)).astype(np.int64)] >> (bits & T.U64(63))) & T.U64(1)).all(axis=1)
                    edge = np.searchsorted(row[hit], np.arange(hi - lo + 1))
                    spots = [pos[hit][edge[i] : edge[i + 1]] for i in range(hi - lo)]
                found = _around(words, ids[lo:hi], spots, least, reach)
                if found is not None:
                    yield found

    return run


def _plain(batches):
    yield from batches


def _sorted_here(make):
    """The rows of make() with a state: 0 no like neighbour in another document here, 1 settled here, 2 settled here and
    of the smallest document, whose rows tell the others and may be later than those of another task."""

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        key, doc = np.asarray(t.column("key")), np.asarray(t.column("doc_id"))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        last = np.concatenate([start[1:], [len(key)]]) - 1
        across = (doc[start] != doc[last])[group]
        state = np.where(across, np.where(doc == doc[start][group], 2, 1), 0).astype(np.int8)
        t = t.take(pa.array(order)).append_column("state", pa.array(state)).append_column("later", pa.array(across & (doc > doc[start][group])))
        yield from t.to_batches(max_chunksize=20_000)

    def run(batches):
        held, n = [], 0
        for b in make(batches):
            held.append(b)
            n += b.num_rows
            if n >= HELD_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _neighbours(batches):
    """Rows sorted by key and document: a run of one key is matched if it spans documents or has a row of state 2. Only
    the rows of a run's first document wait for the next; a run's length doesn't matter."""
    held: list[pa.RecordBatch] = []
    last, first, known = None, None, False

    def out(b: pa.RecordBatch, matched: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
        keep = [b.column(b.schema.get_field_index(c)) for c in ("key", "doc_id", "a", "b", "ca", "cb", "pos", "wide")]
        return pa.RecordBatch.from_arrays([*keep, pa.array(matched), pa.array(later)], names=["key", "doc_id", "a", "b", "ca", "cb", "pos", "wide", "matched", "later"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, state = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("key", "doc_id", "state"))
        new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        start = np.flatnonzero(np.concatenate([[True], new[1:]]))
        group = np.cumsum(np.concatenate([[True], new[1:]])) - 1
        lead = doc[start].copy()
        told = np.bitwise_or.reduceat(state == 2, start)
        same = np.bitwise_and.reduceat(doc == lead[group], start)
        if not new[0]:
            lead[0] = first
            same[0] = bool((doc[group == 0] == first).all())
            told[0] = told[0] or known
        matched = (told | ~same)[group]
        later = doc > lead[group]
        if new[0] or matched[0] or len(start) > 1:
            for h in held:
                m = np.full(h.num_rows, not new[0] and bool(matched[0]))
                yield out(h, m | (np.asarray(h.column(h.schema.get_field_index("state"))) == 2), np.zeros(h.num_rows, bool))
            held = []
        # The last run waits while it is not yet matched.
        wait = start[-1] if not matched[-1] else batch.num_rows
        if wait:
            yield out(batch.slice(0, wait), matched[:wait], later[:wait])
        if wait < batch.num_rows:
            held.append(batch.slice(wait))
        last, first, known = key[-1], lead[-1], bool(told[-1] or not same[-1])
    for h in held:
        yield out(h, np.asarray(h.column(h.schema.get_field_index("state"))) == 2, np.zeros(h.num_rows, bool))


def _matched(rows: DataFrame, make, tag: str) -> DataFrame:
    """(key, range, pos, wide, matched, later) of the rows that make() builds: what settled in its task, and after a shuffle
    by key the rest."""
    here = stored(rows.mapInArrow(_sorted_here(make), f"key long, {_RANGE}, pos int, wide long, state byte, later boolean"), tag)
    settled = here.filter("state >= 1").select("key", "doc_id", "a", "b", "ca", "cb", "pos", "wide", F.lit(True).alias("matched"), "later")
    return settled.unionByName(here.filter("state <> 1").repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_neighbours, _FOUND))


def _merge(batches):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        out = []
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = []
            for later in (False, True):
                spans: list[list[int]] = []
                for r in sorted((f["a"], f["b"], f["ca"], f["cb"]) for f in found if f["later"] or not later):
                    if spans and r[0] <= spans[-1][1]:
                        if r[1] > spans[-1][1]:
                            spans[-1][1], spans[-1][3] = r[1], r[3]
                    else:
                        spans.append(list(r))
                row.append((sum(s[1] - s[0] for s in spans), [{"start": s[2], "stop": s[3]} for s in spans]))
            out.append((doc, row[0][0], row[1][0], row[0][1], row[1][1]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], span), pa.array(cols[4], span)], names=["doc_id", "n_repeated", "n_later", "spans", "later_spans"])


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 4, reach: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with a repeated passage: doc_id, n_repeated (words in repeated windows), n_later (those in later
    spans), spans and later_spans in code points."""
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string").filter("doc_id is not null and text is not null")
    one = stored(_matched(base, _suffixes(least, k, reach), "suffixes").filter("matched").select(F.col("wide").alias("key"), "doc_id", "a", "b", "ca", "cb", "pos", F.col("key").alias("wide")).distinct(), "matches")
    two = stored(_matched(one, _plain, "ranges"), "extended")
    dropped(one)
    # A range that settled both in its task and after the shuffle has two rows; one that is matched anywhere is.
    places = two.groupBy("wide", "key", "doc_id").agg(F.max("matched").alias("m"), F.collect_set("pos").alias("at"))
    left = places.filter("not m").select("doc_id", F.explode("at").alias("pos"))
    ranges = places.groupBy("wide", "key").agg(F.max("m").alias("m"), F.min(F.struct("doc_id", "at")).alias("least"), F.max(F.struct("doc_id", F.array_min("at").alias("pos"))).alias("most"))
    ranges = stored(ranges, "settled")
    several = ranges.groupBy("wide").agg(F.count("*").alias("n")).filter("n > 1")
    # A suffix with a large share of all ranges, of which there are few, is told to every task instead of sending its
    # ranges to one.
    large = max(1000, ranges.count() // HOT_MOST)
    hot = F.broadcast(several.filter(F.col("n") > large).select("wide"))
    settled = ranges.filter("m")
    beside = settled.join(hot, "wide", "left_semi").unionByName(settled.join(hot, "wide", "left_anti").join(several.filter(F.col("n") <= large), "wide", "left_semi"))
    beside = beside.select("least.doc_id", F.explode("least.at").alias("pos")).unionByName(beside.select("most.doc_id", "most.pos"))
    spots = stored(left.unionByName(beside).distinct(), "spots")
    if spots.count() <= SPOTS_MOST:
        three = _matched(base, _windows(least, k, reach, docs.sparkSession.sparkContext.broadcast(_filter(spots))), "windows")
    else:
        side = spots.groupBy("doc_id").agg(F.collect_set("pos").alias("spots"))
        three = _matched(base.join(side, "doc_id").select("doc_id", "text", "spots"), _windows(least, k, reach), "windows")
    cols = ["doc_id", "a", "b", "ca", "cb", "later"]
    spans = two.filter("matched").select(*cols).unionByName(three.filter("matched").select(*cols))
    found = spans.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "ca", "cb", "later")).alias("found"))
    s = "array<struct<start:long,stop:long>>"
    return found.mapInArrow(_merge, f"doc_id long, n_repeated long, n_later long, spans {s}, later_spans {s}")


def op8(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
