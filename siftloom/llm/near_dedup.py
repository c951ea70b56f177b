"""MinHash near-dedup with sequential Bayesian verification.

Sets of word shingles are collapsed to classes of equal sets and signed with ``BANDS`` x
``ROWS`` minimum hashes, so a pair at similarity 0.8 misses every band with probability
(1 - 0.8**5)**40 = 1.2e-7.  Classes that share a band bucket are gathered under the
bucket's least id, once however many bands they share, with signatures and full sets.

A task settles such a gathering without spelling out its pairs.  It starts with the
member that agrees most with all others and goes on with the rest; each is compared only
with members that are not linked to it yet.  Signatures are compared ``BATCH`` hashes at a
time, and a pair is dropped as soon as the posterior probability of a similarity of 0.8
falls below ``MISS``; pairs are also dropped by set size, and by the triangle inequality
over exact distances to the first member.  Survivors are verified on the full sets, and
only links that join two parts leave the task.  Large gatherings are dealt as pairs of
blocks.

Links make components; the least id of each is kept.

Shingles are compared by 64-bit hashes of word hashes that mix all bytes; that two sets are
equal is decided on their sizes and on three sums, one of them over a second, independent
hash of every shingle.

Defined results: a null or blank text has an empty set and is linked with nothing; a text
with fewer words than a shingle has its whole word sequence as one shingle; rows with a
null id are linked with nothing and kept; rows that share an id are linked, whatever their
texts; an empty table gives no rows; the query reads no other columns, the filter keeps
them, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged, release, steps, text_buffers
from siftloom.llm.columns import apart
from siftloom.llm.components import components
from siftloom.llm.registry import query, table
from siftloom.llm.words import blanks, gram_hashes, lower_ascii, mix, run_hashes, word_hashes, words_of
from siftloom.session import cut_lineage

ROWS, BANDS = 5, 40
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hashes compared before the posterior is looked at again, and the probability below which a pair is dropped.
BATCH, MISS = 40, 1e-6
#: Bytes of text in one vectorised step.
CHUNK = 512 << 10
#: Key of a set: equal sets make one class.  Seed of the second hash.
SET = ("h1", "h2", "h3", "n")
SECOND = 0x5EED
#: Members of a gathering that one task compares with one another, and member rows per task.
BLOCK = 2000
TASK_ROWS = 4000


@functools.cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct shingle hashes of each text, one text after the other, each text's first, and second hashes."""
    data = lower_ascii(data)
    words = words_of(data, offsets, blanks())
    n = np.diff(words.first)
    row = np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero((n > 0) & (n < width))

    def hashed(seed: int) -> np.ndarray:
        h = word_hashes(data, words, seed)
        grams = gram_hashes(h, width)
        # the length keeps a short sequence apart from every full shingle
        whole = mix(run_hashes(h, words.first[short], words.first[short + 1]) ^ n[short].astype(np.uint64))
        return np.concatenate([grams[row[: len(grams)] == row[width - 1:]] if len(grams) else grams, whole])

    h, again = hashed(0), hashed(SECOND) if second else None
    count = max(0, len(row) - width + 1)
    row = np.concatenate([row[:count][row[:count] == row[width - 1:]] if count else row[:0], short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = again[order] if second else None
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
        again = again[new] if second else None
    return h, np.searchsorted(row, np.arange(len(n) + 1)), again


def _set_hashes(h: np.ndarray, again: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Three sums over each set: of the hashes, of the mixed hashes (by bits) and of the second hashes."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((3, len(first) - 1), np.uint64)
    if len(full):
        cut = first[full]
        out[0, full] = np.add.reduceat(h, cut)
        out[1, full] = np.bitwise_xor.reduceat(mix(h), cut)
        out[2, full] = np.add.reduceat(mix(again), cut)
    return [pa.array(x.view(np.int64)) for x in out]


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: id, n (set size), h1 to h3 (hashes of the set), keys (of the bands) and sig (a byte per hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text, CHUNK):
                h, first, again = shingles(*text_buffers(batch.column(text)), width, True)
                n = np.diff(first)
                full = np.flatnonzero(n)
                cut = first[full]
                sig = np.zeros((ROWS * BANDS, len(full)), np.uint32)
                if len(full):
                    for k, a in enumerate(_multipliers()):
                        sig[k] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), cut)
                keys = np.zeros((len(full), BANDS), np.uint64)
                for b in range(BANDS):
                    acc = np.full(len(full), b + 1, np.uint64)
                    for r in range(ROWS):
                        acc = mix(acc ^ sig[b * ROWS + r].astype(np.uint64))
                    keys[:, b] = acc
                used = np.zeros(len(n), np.int64)
                used[full] = 1
                low = np.ascontiguousarray(sig.T.astype(np.uint8))
                ends = np.concatenate([[0], np.cumsum(used)])
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(key), "n": pa.array(n), **dict(zip(SET, _set_hashes(h, again, first), strict=False)),
                    "keys": pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    "sig": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * ROWS * BANDS).astype(np.int32)), pa.py_buffer(low)])})

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        run, "id long, n long, h1 long, h2 long, h3 long, keys array<long>, sig binary")


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: the key of its set and the set as an array of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text, CHUNK):
                h, first, again = shingles(*text_buffers(batch.column(text)), width, True)
                yield pa.RecordBatch.from_pydict({
                    **dict(zip(SET, [*_set_hashes(h, again, first), pa.array(np.diff(first))], strict=True)),
                    "set": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))})

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "h1 long, h2 long, h3 long, n long, set array<long>")


@functools.cache
def least_matches() -> list[tuple[int, int]]:
    """(hashes compared, matches below which the pair is dropped).

    With a flat prior on the similarity s, of which a byte matches with s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for t in range(BATCH, ROWS * BANDS + 1, BATCH):
        for m in range(t + 1):
            weight = m * np.log(p) + (t - m) * np.log1p(-p)
            weight = np.exp(weight - weight.max())
            if weight[s >= PERCENT / 100].sum() >= MISS * weight.sum():
                out.append((t, m))
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the rows of two signature matrices that may still be 0.8 similar."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    done = 0
    for t, least in least_matches():
        matches = matches + (a[left, done:t] == b[left, done:t]).sum(axis=1)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], t
    return left


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, ROWS * BANDS), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]].reshape(len(column), ROWS * BANDS)


class _Members:
    """Members of a task: ids, set sizes, signatures and sets."""

    def __init__(self, rows: pa.Table):
        self.id, self.n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        self.block = rows.column("block").to_numpy()
        self.sig = _matrix(rows.column("sig"))
        sets_ = rows.column("set").combine_chunks()
        if isinstance(sets_, pa.ChunkedArray):
            sets_ = pa.concat_arrays(sets_.chunks) if sets_.num_chunks else pa.array([], pa.list_(pa.int64()))
        self.first = sets_.offsets.to_numpy().astype(np.int64)
        self.flat = sets_.values.to_numpy().view(np.uint64)

    def similar(self, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact sizes of intersection and union of the set of ``i`` with each of ``j``."""
        own = self.flat[self.first[i]: self.first[i + 1]]
        size = self.first[j + 1] - self.first[j]
        values = self.flat[ragged(self.first[j], size)]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(size) - size)
        return both, len(own) + size - both

    def central(self, a: int, z: int) -> int:
        """The member that agrees most with the commonest byte of each hash."""
        sig = self.sig[a:z]
        width = sig.shape[1]
        votes = np.bincount((sig + 256 * np.arange(width)).ravel(), minlength=256 * width).reshape(width, 256)
        return a + int((sig == votes.argmax(axis=1)).sum(axis=1).argmax())


def _links(rows: pa.Table) -> pa.Table:
    """Links that join the gatherings of a task; pairs of blocks compare across only."""
    rows = rows.sort_by([(c, "ascending") for c in ("leader", "b1", "b2", "id")]).combine_chunks()
    members = _Members(rows)
    leader, b1, b2 = (rows.column(c).to_numpy() for c in ("leader", "b1", "b2"))
    change = (leader[1:] != leader[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows)]])
    slack = 1 - PERCENT / 100 + 1e-9
    x, y = [], []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        order = np.arange(a, z)
        if z - a > 2:
            hub = members.central(a, z)
            order = np.concatenate([[hub], order[order != hub]])
        part = np.arange(z - a)  # of member k at part[k - a]
        far = np.full(z - a, np.nan)  # exact distance to the first member, where it was verified
        far[order[0] - a] = 0
        for at, i in enumerate(order[:-1].tolist()):
            j = order[at + 1:]
            j = j[part[j - a] != part[i - a]]
            if b1[a] != b2[a]:
                j = j[members.block[j] != members.block[i]]
            n = members.n
            j = j[100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i])]
            j = j[~(np.abs(far[j - a] - far[i - a]) > slack)]
            if not len(j):
                continue
            j = j[plausible(np.broadcast_to(members.sig[i], (len(j), members.sig.shape[1])), members.sig[j])]
            if not len(j):
                continue
            both, either = members.similar(i, j)
            if at == 0:
                far[j - a] = 1 - both / either
            for k in j[100 * both >= PERCENT * either].tolist():
                if part[k - a] != part[i - a]:
                    part[part == part[k - a]] = part[i - a]
                    x.append(members.id[i])
                    y.append(members.id[k])
    release()
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id."""
    rows = cut_lineage(signed(docs, key, text, width))
    nodes = rows.where("n > 0 and id is not null")
    # numbered before it is written, so a class keeps its number
    classes = cut_lineage(nodes.groupBy(*SET).agg(
        F.min("id").alias("least"), F.first("keys").alias("keys"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()))
    signatures = classes.select("id", "sig")
    bands = classes.select("id", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = cut_lineage(bands.join(buckets, "key"))
    candidates = classes.select("id", "least", *SET).join(members.select("id").distinct(), "id", "left_semi")
    # the full sets of candidates only, one for each class; every other text is left where it is
    named = docs.join(candidates.select(F.col("least").alias("_least")).distinct(), F.col(key) == F.col("_least"), "left_semi")
    full = cut_lineage(sets(named, key, text, width).groupBy(*SET).agg(F.first("set").alias("set")).join(candidates.drop("least"), list(SET)).select("id", "n", "set"))

    gathered = members.select("leader", "id").distinct()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    crowd = (gathered.join(gathered.groupBy("leader").agg(F.count("*").alias("size")), "leader")
             .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("leader", "id", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    tasks = max(1, -(-gathered.count() // TASK_ROWS))
    links = (crowd.join(signatures, "id").join(full, "id")
             .withColumn("_t", F.pmod(F.xxhash64("leader", "b1", "b2"), F.lit(tasks)))
             .groupBy("_t").applyInArrow(_links, "x long, y long"))
    # rows that share an id link the classes of their texts
    per_class = F.struct(*SET)
    shared = nodes.groupBy("id").agg(F.min(per_class).alias("a"), F.max(per_class).alias("z")).where("a <> z").select("id")
    both = nodes.join(shared, "id", "left_semi").select(F.col("id").alias("doc"), *SET).distinct().join(classes.select("id", *SET), list(SET))
    same = both.join(both.groupBy("doc").agg(F.min("id").alias("y")), "doc").select(F.col("id").alias("x"), "y")
    final = components(links.unionByName(same))

    whole = classes.select("id", "least", *SET).join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = whole.groupBy("component").agg(F.min("least").alias("_c"))
    settled = whole.join(lowest, "component").select(*[F.col(c).alias(f"_{c}") for c in SET], "_c")
    on = [F.col(c) == F.col(f"_{c}") for c in SET]
    placed_rows = rows.select("id", *SET).join(settled, on, "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("_c", "id"))
    return placed_rows.select("id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """One document of each component, with its own columns; rows with a null id all stay."""
    docs, names, back = apart(docs)
    key, text = names[key], names[text]
    found = clusters(docs.select(key, text), key, text, width)
    kept = found.where("id = component_id").select("id").distinct()
    one = docs.join(kept, F.col(key) == F.col("id"), "left_semi").dropDuplicates([key])
    return back(one.unionByName(docs.where(F.col(key).isNull())))


@query("op9_minhash_dedup")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = clusters(docs)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
