"""Exact n-gram Jaccard join: a size-aware heavy-light join with connected components.

Two documents link when their sets of word shingles have intersection / union >= num / den (integers, so ties are
exact). Every linked pair shares a key of the index:

* light sets (at most ``boundary`` shingles) enumerate fixed-size subsets: for each size m a partner may have, all
  subsets of ceil(num * m / den) shingles, one of which both sets contain;
* heavy sets put the first n - ceil(num * n / den) + 1 shingles of one global order into inverted lists. The order is
  (frequent, hash): shingles in many documents come last, so shared passages stay out of the lists. Sets that may
  have a partner on the other side of the boundary take part in both.

``boundary`` minimises the expected work: subsets of the light sizes, plus list rows times the mean list length of the
heavy ones. The lists are scanned in sorted order and give a chain of candidates, never all pairs. Chains make
candidate families; each family's sets are compared exactly, in blocks of bounded size, where the triangle inequality
spares chunks that can't link, and only a spanning forest of the true links leaves a block. Exact copies are one class and are compared once.

Cases: null, empty or wordless text is an empty set, linked with nothing; fewer than k words are one shingle; rows
that repeat a doc_id are separate rows of the same id; a null doc_id keeps its row and has its own text's class; an
empty table gives an empty result; a very long text is one set; other columns are ignored. Shingles are 64-bit hashes,
equal sets are told by 128 bits and their size.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as T
from gridloom.llm._graph import components, forest
from gridloom.llm._spark import dropped, only, runs, stored

#: Frequent shingles kept for the global order, by the upper half of their hashes: 4 bytes each, so 16 MB at most are
#: broadcast. Any set gives a valid order; a shingle that shares its half with a frequent one only moves back too.
FREQUENT_MOST = 1 << 22
#: Candidate pairs that a task gathers before it thins them to a forest.
GATHER = 1 << 16
#: Bytes of family members and their blocks that are broadcast to prune texts before a shuffle; beyond them the join
#: shuffles.
MEMBERS_BYTES = 1 << 25
LIGHT_MOST = 24
#: A block of sets that one task compares: 16 MB of shingles. A family of more blocks is sent out once for each block it
#: has, so small blocks would fill the disk with copies of its sets.
BLOCK_ROWS = 1 << 14
BLOCK_SHINGLES = 1 << 21
#: Sets of a block that are multiplied at a time.
CHUNK_ROWS = 512


def least_overlap(size: int, num: int, den: int) -> int:
    return -(-num * size // den)


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def subset_work(n: int, num: int, den: int) -> int:
    """Subsets that a light set of n shingles enumerates."""
    return sum(math.comb(n, least_overlap(m, num, den)) for m in range(n, n * den // num + 1))


def choose_boundary(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The largest light size, by least total cost over the counts of sets of each size up to LIGHT_MOST."""
    best, best_cost, cost = 0, 0.0, 0.0
    for n in range(1, LIGHT_MOST + 1):
        cost += sizes.get(n, 0) * (subset_work(n, num, den) - prefix_length(n, num, den) * (1 + mean_list))
        if cost < best_cost:
            best, best_cost = n, cost
    return best


def light_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    n, out = len(s), []
    for m in range(n, n * den // num + 1):
        c = least_overlap(m, num, den)
        take = np.array(list(itertools.combinations(range(n), c)), dtype=np.int64)
        h = np.full(len(take), c, dtype=T.U64)
        for j in range(c):
            h = T.mix(h * T.U64(0x9FB21C651E98DF25) + s[take[:, j]])
        out.append(h)
    return np.unique(np.concatenate(out))


def heavy_keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    p = prefix_length(len(s), num, den)
    if len(frequent):
        half = (s >> T.U64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(frequent, half), len(frequent) - 1)
        often = frequent[at] == half
        if often.any():
            s = np.concatenate([s[~often], s[often]])
    return s[:p]


def _texts(batches):
    for batch in batches:
        data, bounds = T.utf8(batch.column(1))
        for lo, hi in T.pieces(bounds):
            yield batch.slice(lo, hi - lo), T.Words(data, bounds[lo : hi + 1], T.BLANK_WORD)


def _survey(k: int, num: int, den: int):
    """Of each document: size and two hashes of its set, 128 bits in all, and the lowest shingles by hash, among which the frequent ones are sought."""

    def run(batches):
        for batch, words in _texts(batches):
            size, whole, other, low = [], [], [], []
            for s in T.shingle_sets(words, k):
                n = len(s)
                size.append(n)
                whole.append(int(T.signed(T.mix(np.bitwise_xor.reduce(T.mix(s), keepdims=True) + np.add.reduce(s, keepdims=True) * T.U64(3)))[0]) if n else None)
                other.append(int(T.signed(T.mix(np.add.reduce(T.mix(s ^ T.U64(0x5851F42D4C957F2D)), keepdims=True)))[0]) if n else None)
                low.append(T.signed(s[: prefix_length(n, num, den) * 13 // 10 + 4]))
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            flat = pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(whole, pa.int64()), pa.array(other, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), flat)], names=["doc_id", "n", "h", "i", "low"])

    return run


def _index(k: int, num: int, den: int, boundary: int, frequent):
    """Keys of each document, with the key before it in the document's own order (the first has itself)."""

    def run(batches):
        often = frequent.value
        for batch, words in _texts(batches):
            ids = np.asarray(batch.column(0))
            keys, before, owner, size = [], [], [], []
            for i, s in enumerate(T.shingle_sets(words, k)):
                n = len(s)
                if not n:
                    continue
                own = []
                if n <= boundary:
                    own.append(light_keys(s, num, den))
                if n > boundary or n * den // num > boundary:
                    own.append(heavy_keys(s, often, num, den))
                for x in own:
                    keys.append(x)
                    before.append(np.concatenate([x[:1], x[:-1]]))
                    owner.append(np.full(len(x), ids[i]))
                    size.append(np.full(len(x), n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(np.concatenate(keys))), pa.array(np.concatenate(owner).astype(np.int64)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(T.signed(np.concatenate(before)))], names=["key", "doc_id", "n", "before"])

    return run


def _chains(num: int, den: int):
    """Neighbours of like size in each list, which is sorted by size: (a, b) of classes. Two neighbours that have the same
    key before this one stand in that key's list too, with all between them of like size; the lists follow one order, so
    the earlier list already links them and the pair is left out."""

    def thinned(pairs):
        a, b = forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        last, pairs, held = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n, before = (np.asarray(batch.column(i)) for i in range(4))
            if last is not None:
                key, doc, n, before = (np.concatenate([[x], y]) for x, y in zip(last, (key, doc, n, before), strict=True))
            last = key[-1], doc[-1], n[-1], before[-1]
            told = (before[1:] == before[:-1]) & (before[1:] != key[1:])
            near = (key[1:] == key[:-1]) & ~told & (n[1:].astype(np.int64) * num <= n[:-1].astype(np.int64) * den) & (doc[1:] != doc[:-1])
            if near.any():
                pairs.append((doc[:-1][near], doc[1:][near]))
                held += len(pairs[-1][0])
            if held > GATHER:
                yield thinned(pairs)
                pairs, held = [], 0
        if pairs:
            yield thinned(pairs)

    return run


def _tokens(k: int):
    """Sets of family members as bytes, one row for each block that compares them."""

    def run(batches):
        for batch in batches:
            data, bounds = T.utf8(batch.column(1))
            blocks = batch.column(2)
            for lo, hi in T.pieces(bounds):
                words = T.Words(data, bounds[lo : hi + 1], T.BLANK_WORD)
                for i, s in enumerate(T.shingle_sets(words, k)):
                    goal = blocks[lo + i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(goal, pa.string()), pa.array([batch.column(0)[lo + i].as_py()] * len(goal), pa.int64()), pa.array([s.tobytes()] * len(goal), pa.binary())], names=["block", "doc_id", "s"])

    return run


class _Sets:
    """Sets as rows of shared shingles: those of one set alone can't be common to two and only count in its size."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, T.U64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        count = np.diff(np.concatenate([np.flatnonzero(new), [len(flat)]]))
        shared = np.repeat(count > 1, count)
        column = np.empty(len(flat), dtype=np.int32)
        column[order] = np.where(shared, np.repeat(np.cumsum(count > 1) - 1, count), -1)
        often = count[count > 1]
        owner = np.repeat(np.arange(len(sets)), self.size)[column >= 0]
        self.column = column[column >= 0]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        self.owner, self.often = owner, often

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the sets and the place in ``which`` that each belongs to, by column."""
        n = self.start[which + 1] - self.start[which]
        at = np.repeat(np.arange(len(which)), n)
        column = self.column[np.repeat(self.start[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        order = np.argsort(column, kind="stable")
        return column[order], at[order]

    def with_one(self, i: int) -> np.ndarray:
        """Shingles that each set shares with set i."""
        mark = np.zeros(len(self.often), dtype=bool)
        mark[self.column[self.start[i] : self.start[i + 1]]] = True
        out = np.bincount(self.owner, weights=mark[self.column], minlength=len(self.size)).astype(np.int64)
        out[i] = self.size[i]
        return out


def _links(both, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b with ``both`` common shingles link."""
    return both * (den + num) >= num * (a + b)


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], m: int, n: int, step: int = 8192) -> np.ndarray:
    """Shingles that each of m sets shares with each of n, by products of 0/1 matrices over the columns that both sides
    have, ``step`` at a time."""
    here = np.intersect1d(x[0], y[0])
    out = np.zeros((m, n), dtype=np.float64)
    for lo in range(0, len(here), step):
        part, dense = here[lo : lo + step], []
        for (column, at), rows in ((x, m), (y, n)):
            i, j = np.searchsorted(column, [part[0], part[-1] + 1])
            place = np.searchsorted(part, column[i:j])
            kept = part[place] == column[i:j]
            d = np.zeros((rows, len(part)), dtype=np.float32)
            d[at[i:j][kept], place[kept]] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Boolean matrix of the pairs that link."""
    rows = _Sets(sets)
    x = rows.rows(np.arange(len(sets)))
    both = _common(x, x, len(sets), len(sets))
    np.fill_diagonal(both, rows.size)
    return _links(both, rows.size[:, None], rows.size[None, :], num, den)


def link_forest(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row reachable by links) for each row that isn't that row itself.

    Distance 1 - intersection / union is a metric. Rows are sorted by their distance from one central set and cut into
    chunks; two chunks need no comparison if their distances from it, or their sizes, are too far apart for any link, or
    if their rows are one component already. In a family of near copies, most lie within a link of the centre."""
    m = len(sets)
    if m <= CHUNK_ROWS:
        i, j = np.nonzero(np.triu(linked(sets, num, den), 1))
        return forest(i, j) if len(i) else (i, j)
    rows = _Sets(sets)
    size = rows.size
    centre = int(np.argmax(np.bincount(rows.owner, weights=rows.often[rows.column], minlength=m) / np.maximum(size, 1)))
    both = rows.with_one(centre)
    far = 1 - both / np.maximum(size + size[centre] - both, 1)
    label = np.arange(m)
    near = np.flatnonzero(_links(both, size, size[centre], num, den))
    label[near] = near.min()
    order = np.lexsort((size, far))
    chunks = [order[lo : lo + CHUNK_ROWS] for lo in range(0, m, CHUNK_ROWS)]
    reach = 1 - num / den + 1e-9
    for p, a in enumerate(chunks):
        x, found = None, [np.stack([np.arange(m), label])]
        for b in chunks[p:]:
            if far[b[0]] - far[a[-1]] > reach:
                break
            apart = size[a].max() * den < num * size[b].min() or size[b].max() * den < num * size[a].min()
            if apart or (label[a] == label[a[0]]).all() and (label[b] == label[a[0]]).all():
                continue
            x = x or rows.rows(a)
            yes = _links(_common(x, x if b is a else rows.rows(b), len(a), len(b)), size[a][:, None], size[b][None, :], num, den)
            yes &= label[a][:, None] != label[b][None, :]
            i, j = np.nonzero(yes)
            found.append(np.stack([a[i], b[j]]))
        if len(found) > 1:
            low = forest(*np.concatenate(found, axis=1))
            label = np.arange(m)
            label[low[0]] = low[1]
    moved = np.flatnonzero(label != np.arange(m))
    return moved, label[moved]


def _compare(num: int, den: int):
    def run(batches):
        for _, rows in runs(batches, "block"):
            ids = np.asarray(rows.column("doc_id").combine_chunks())
            if len(ids) < 2:
                continue
            i, j = link_forest([np.frombuffer(x.as_py(), dtype=T.U64) for x in rows.column("s")], num, den)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return run


def _blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, blocks) of the members(doc_id, n, family): a small family is one block; a large one is cut by size into
    bands, and a band into blocks, and each block meets the blocks of its own and the next band."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / (num / den - 0.001) if num / den > 0.002 else 500.0)))
    m = members.withColumn("band", band)
    whole = m.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    small = (F.col("c") <= BLOCK_ROWS) & (F.col("w") <= BLOCK_SHINGLES)
    cells = m.groupBy("family", "band").agg(F.count("*").alias("c"), F.max("n").alias("top")).withColumn("parts", F.ceil(F.col("c") / F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS // 2), F.floor(F.lit(BLOCK_SHINGLES / 2) / F.col("top"))))).cast("int"))
    beside = cells.select("family", "band", "parts").unionByName(cells.select("family", (F.col("band") - 1).alias("band"), F.lit(None).cast("int").alias("parts"), F.col("parts").alias("above")), allowMissingColumns=True).unionByName(cells.select("family", (F.col("band") + 1).alias("band"), F.lit(None).cast("int").alias("parts"), F.col("parts").alias("below")), allowMissingColumns=True)
    beside = beside.groupBy("family", "band").agg(F.max("parts").alias("parts"), F.max("above").alias("above"), F.max("below").alias("below")).filter("parts is not null")
    large = m.join(whole.filter(~small).select("family"), "family").join(beside, ["family", "band"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    name = lambda lo, i, hi, j: F.concat_ws("_", F.col("family").cast("string"), lo.cast("string"), i.cast("string"), hi.cast("string"), j.cast("string"))
    none = F.array().cast("array<string>")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    b = F.col("band")
    blocks = F.concat(
        F.transform(upto("parts"), lambda j: name(b, F.least(j, F.col("own")), b, F.greatest(j, F.col("own")))),
        F.when(F.col("above").isNull(), none).otherwise(F.transform(upto("above"), lambda j: name(b, F.col("own"), b + 1, j))),
        F.when(F.col("below").isNull(), none).otherwise(F.transform(upto("below"), lambda j: name(b - 1, j, b, F.col("own")))),
    )
    return m.join(whole.filter(small).select("family"), "family").select("doc_id", F.array(F.col("family").cast("string")).alias("blocks")).unionByName(large.withColumn("own", own).select("doc_id", blocks.alias("blocks")))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", frequent_from: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (see the module's text)."""
    spark = docs.sparkSession
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string")
    survey = stored(base.mapInArrow(_survey(k, num, den), "doc_id long, n long, h long, i long, low array<long>"), "shingles")
    often = stored(survey.select(F.explode("low").alias("key")).groupBy("key").count().filter(F.col("count") >= frequent_from), "frequent")
    steps = [1 << i for i in range(frequent_from.bit_length() - 1, 42)]
    row = often.agg(F.count("*"), F.avg("count"), *[F.count(F.when(F.col("count") >= s, 1)) for s in steps]).first()
    threshold = next(s for s, c in zip([frequent_from, *steps], [row[0], *row[2:]], strict=True) if c <= FREQUENT_MOST)
    values = often.filter(F.col("count") >= threshold).select("key").toArrow().column(0).combine_chunks()
    frequent = spark.sparkContext.broadcast(np.unique((np.asarray(values).astype(np.int64).view(T.U64) >> T.U64(32)).astype(np.uint32)))
    dropped(often)
    classes = stored(survey.filter("n > 0").groupBy("h", "i", "n").agg(F.min("doc_id").alias("class")).filter("class is not null"), "classes")
    sizes = {r[0]: r[1] for r in classes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, float(row[1] or 1.0), num, den)

    index = base.filter("doc_id is not null").mapInArrow(_index(k, num, den, boundary, frequent), "key long, doc_id long, n int, before long")
    near = index.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_chains(num, den), "a long, b long")
    family = stored(components(near), "family")
    sized = classes.select(F.col("class").alias("doc_id"), "n")
    members = sized.join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    blocks = stored(_blocks(members, num, den), "blocks")
    size = blocks.agg(F.sum(F.length(F.array_join("blocks", "")) + 8 * F.size("blocks") + 32)).first()[0]
    rows = F.broadcast(blocks) if (size or 0) <= MEMBERS_BYTES else blocks
    sets = base.join(rows, "doc_id").select("doc_id", "text", "blocks").mapInArrow(_tokens(k), "block string, doc_id long, s binary")
    links = sets.repartition("block").sortWithinPartitions("block").mapInArrow(_compare(num, den), "a long, b long")
    joined = components(links)
    by_class = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").select("h", "i", "n", F.coalesce("component", "class").alias("component"))
    return survey.select("doc_id", "n", "h", "i").join(by_class, ["h", "i", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; columns unchanged. Copies of one doc_id: all rows
    of the kept id stay, as they are the same document. Rows with a null doc_id stay."""
    found = jaccard_classes(docs, **how).select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_component")).filter("_id <> _component").select("_id").distinct()
    return docs.join(found, docs[how.get("key", "doc_id")] == found["_id"], "left_anti")


def op6(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs, 4, 85, 100)
