"""Byte windows that also start in a document with a smaller id, decided by classes first.

The runs of ``repeats`` (consecutive windows with one minimiser) are sent as hashes, and
only what hashes leave open is sent as text:

1. Each group of documents sends the distinct minimisers of its runs to their buckets,
   which answer with two bits: met in another group, and met in so many groups that it is
   hot.  A hot run is cut into single windows with their own hashes as minimisers, so no
   bucket gathers the contexts of a frequent line.
2. Groups send the classes (minimiser, hash of the run's bytes, least id) of runs met
   twice.  A bucket answers with the class's least id over all groups, and whether the
   minimiser has a single class.  If so, all its runs are equal and the least id settles
   their windows; if not, the runs overlap in part.
3. Only for those, a group sends the bytes of each of its classes once.  ``resolve`` finds
   the least id of each of their windows.
4. Each group applies both kinds of answers to its documents.

All answers are pre-aggregated per group, so a group of copies of any size sends each
class once.  Documents are shuffled once; everything else is small beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged, release, strings
from siftloom.llm.repeats import NULL_ID, Runs, Text, Units, _binary, _codes, chunks, packed, runs_of, unpacked
from siftloom.llm.words import gram_hashes, mix, run_hashes

#: Groups that a minimiser may be met in before its runs are cut into windows.
HOT_GROUPS = 256

_KEYS = "b int, _g int, n int, x binary"
_SIDE = "_g int, kind int, b int, n int, x binary, y binary, m long, sid long, a long, z long, least long"


def _rows(kind: int, group, **columns) -> pa.Table:
    """Rows of the side table of a group; columns that are not given are null."""
    n = len(group)
    kinds = {"b": pa.int32(), "n": pa.int32(), "x": pa.binary(), "y": pa.binary(), "m": pa.int64(), "sid": pa.int64(),
             "a": pa.int64(), "z": pa.int64(), "least": pa.int64()}
    out = {"_g": group if isinstance(group, (pa.Array, pa.ChunkedArray)) else pa.array(group, pa.int32()), "kind": pa.array(np.full(n, kind, np.int32))}
    return pa.table(out | {k: columns.get(k, pa.nulls(n, t)) for k, t in kinds.items()})


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _from_low(raw: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.reshape(-1).view("<u8")


class _Group:
    """The documents of a group and the runs of their windows."""

    def __init__(self, group: pa.Table, key: str, text: str, units: Units, buckets: int):
        self.rows = unpacked(group, key, text)
        self.number = group.column("_g")[0].as_py()
        self.text, self.units, self.buckets = text, units, buckets
        ids = self.rows.column(key).combine_chunks() if isinstance(self.rows.column(key), pa.ChunkedArray) else self.rows.column(key)
        self.ids = pa.compute.fill_null(ids.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)

        self.base = []  # (first row, runs, codes) of each slice
        for at, part in self.slices():
            runs = runs_of(part, units)
            self.base.append((at, runs, _codes(runs.key, buckets)))

    def slices(self):
        return chunks(self.rows, self.text, self.units)

    def windows(self, part: Text, runs: Runs, hot: np.ndarray) -> Runs:
        """The runs with the ``hot`` ones cut into single windows that are their own minimisers."""
        size = runs.size[hot]
        first = ragged(runs.first[hot], size)
        single = Runs(np.repeat(runs.row[hot], size), first, np.ones(len(first), np.int64), gram_hashes(part.values, self.units.window)[first])
        return Runs(*(np.concatenate([a[~hot], b]) for a, b in zip(runs, single, strict=True)))


def _answers(side: pa.Table, kind: int) -> pa.Table:
    return side.filter(pa.compute.equal(side.column("kind"), kind)).sort_by("b").combine_chunks()


def _bits(side: pa.Table, column: str) -> np.ndarray:
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(side.column(column).to_pylist(), side.column("n").to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)


class _Known:
    """What a group knows after the first answers.

    ``classes`` has (first row, runs, codes, class hashes) of each slice, for the runs whose
    minimiser is met in another group or in two documents of this one.
    """

    def __init__(self, group: _Group, side: pa.Table):
        codes = np.concatenate([np.zeros(0, np.uint64), *[c for _, _, c in group.base]])
        docs = np.concatenate([np.zeros(0, np.int64), *[group.ids[at + runs.row] for at, runs, _ in group.base]])
        distinct, inverse = np.unique(codes, return_inverse=True)
        answers = _answers(side, 0)
        low, high = np.full(len(distinct), NULL_ID), np.full(len(distinct), -NULL_ID)
        np.minimum.at(low, inverse, docs)
        np.maximum.at(high, inverse, docs)
        hot = _bits(answers, "y")
        wanted = (_bits(answers, "x") | (low < high)) & ~hot
        self.classes, done, w = [], 0, group.units.window
        for (at, part), (_, runs, codes) in zip(group.slices(), group.base, strict=True):
            of = inverse[done: done + len(codes)]
            done += len(codes)
            take = wanted[of]
            if hot.any() and hot[of].any():
                split = hot[of]
                runs = group.windows(part, Runs(*(v[take | split] for v in runs)), split[take | split])
                codes = _codes(runs.key, group.buckets)
            else:
                runs, codes = Runs(*(v[take] for v in runs)), codes[take]
            if len(codes):
                sid = mix(run_hashes(part.values, runs.first, runs.first + runs.size + w - 1) ^ runs.size.astype(np.uint64))
                self.classes.append((at, runs, codes, sid))


def _class_table(codes: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct (code, class) in sorted order, and the class of each row."""
    order = np.lexsort((sid, codes))
    c, s = codes[order], sid[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(c) else np.zeros(0, bool)
    inverse = np.empty(len(c), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[np.flatnonzero(new)], inverse


def _gathered(known: _Known, group: _Group):
    found = [(at + runs.row, codes, sid) for at, runs, codes, sid in known.classes]
    rows = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
    codes = np.concatenate([np.zeros(0, np.uint64), *[f[1] for f in found]])
    sid = np.concatenate([np.zeros(0, np.uint64), *[f[2] for f in found]])
    first, inverse = _class_table(codes, sid)
    least = np.full(len(first), NULL_ID)
    np.minimum.at(least, inverse, group.ids[rows])
    return codes[first], sid[first], least, inverse


def _cut(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)


def repeated(docs: DataFrame, units: Units, resolve, key: str, text: str, groups: int, columns: list[str],
             schema: str, make, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """``make(rows, parts)`` over the documents, group by group.

    ``parts`` gives (units, removed flags, first row, rows) of slices of the group.
    ``resolve(m, strings, least ids, units)`` gets the different strings of minimisers,
    in order, and yields (string, from, to, id) for runs of windows of a string.
    """
    blobs = packed(docs, groups, columns)
    by_group = blobs.groupBy("_g")

    def load(group: pa.Table) -> _Group:
        release()  # of the group before
        return _Group(group, key, text, units, groups)

    def send_keys(table: pa.Table) -> pa.Table:
        group = load(table)
        codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *[c for _, _, c in group.base]]))
        bucket = (codes >> np.uint64(40)).astype(np.int64)
        first = _cut(bucket)
        ends = np.append(first, len(codes))
        return pa.table({"b": pa.array(bucket[first].astype(np.int32)), "_g": pa.array(np.full(len(first), group.number, np.int32)),
                         "n": pa.array(np.diff(ends).astype(np.int32)), "x": strings(_low_bytes(codes, 5), ends * 5, pa.binary())})

    def answer_keys(bucket: pa.Table) -> pa.Table:
        raw, offsets = _binary(bucket.column("x"))
        _, inverse, count = np.unique(_from_low(raw, 5), return_inverse=True, return_counts=True)
        count, cuts = count[inverse], offsets // 5
        pair = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return _rows(0, bucket.column("_g"), b=bucket.column("b"), n=bucket.column("n"),
                     x=pa.array([np.packbits(count[a:z] > 1).tobytes() for a, z in pair], pa.binary()),
                     y=pa.array([np.packbits(count[a:z] > hot_groups).tobytes() for a, z in pair], pa.binary()))

    def send_classes(table: pa.Table, side: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"b": pa.array([], pa.int32()), "_g": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
        group = load(table)
        codes, sid, least, _ = _gathered(_Known(group, side), group)
        bucket = (codes >> np.uint64(40)).astype(np.int64)
        first = _cut(bucket)
        ends = np.append(first, len(codes))
        wide = np.concatenate([_low_bytes(codes, 5).reshape(-1, 5), _low_bytes(sid, 8).reshape(-1, 8), _low_bytes(least.view(np.uint64), 8).reshape(-1, 8)], axis=1)
        return pa.table({"b": pa.array(bucket[first].astype(np.int32)), "_g": pa.array(np.full(len(first), group.number, np.int32)),
                         "n": pa.array(np.diff(ends).astype(np.int32)), "x": strings(np.ascontiguousarray(wide).reshape(-1), ends * 21, pa.binary())})

    def answer_classes(bucket: pa.Table) -> pa.Table:
        raw, offsets = _binary(bucket.column("x"))
        wide = raw.reshape(-1, 21)
        code = _from_low(np.ascontiguousarray(wide[:, :5]).reshape(-1), 5)
        sid = np.ascontiguousarray(wide[:, 5:13]).reshape(-1).view("<u8")
        low = np.ascontiguousarray(wide[:, 13:]).reshape(-1).view("<i8")
        first, inverse = _class_table(code, sid)
        least = np.full(len(first), NULL_ID)
        np.minimum.at(least, inverse, low)
        _, owner, count = np.unique(code[first], return_inverse=True, return_counts=True)
        several = (count[owner] > 1)[inverse]
        least = least[inverse].astype("<i8")
        cuts = offsets // 21
        pair = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return _rows(1, bucket.column("_g"), b=bucket.column("b"), n=bucket.column("n"),
                     x=pa.array([least[a:z].tobytes() for a, z in pair], pa.binary()),
                     y=pa.array([np.packbits(several[a:z]).tobytes() for a, z in pair], pa.binary()))

    def settled(group: _Group, side: pa.Table):
        """Known minimisers, the classes of the group, their least ids over all groups, and which overlap in part."""
        known = _Known(group, side)
        codes, sid, _, inverse = _gathered(known, group)
        answers = _answers(side, 1)
        least = np.frombuffer(b"".join(answers.column("x").to_pylist()), "<i8")
        return known, codes, sid, least, _bits(answers, "y"), inverse

    def by_slice(known: _Known, inverse: np.ndarray) -> dict[int, tuple[Runs, np.ndarray]]:
        """Runs to look at, with their classes, by the first row of their slice."""
        out, done = {}, 0
        for at, runs, _, _ in known.classes:
            out[at] = (runs, inverse[done: done + len(runs.row)])
            done += len(runs.row)
        return out

    def send_strings(table: pa.Table, side: pa.Table) -> pa.Table:
        out = [pa.table({"_g": pa.array([], pa.int32()), "m": pa.array([], pa.int64()), "sid": pa.array([], pa.int64()), "s": pa.array([], pa.binary()), "first": pa.array([], pa.int64())})]
        if len(table):
            group = load(table)
            known, codes, sid, least, several, inverse = settled(group, side)
            sent = ~several
            slices = by_slice(known, inverse)
            for at, part in group.slices():
                if at not in slices:
                    continue
                runs, of = slices[at]
                new, pick = np.unique(of, return_index=True)
                pick, new = pick[~sent[new]], new[~sent[new]]
                sent[new] = True
                a = part.start[runs.first[pick]]
                z = part.end[runs.first[pick] + runs.size[pick] + units.window - 2]
                out.append(pa.table({
                    "_g": pa.array(np.full(len(pick), group.number, np.int32)), "m": pa.array(codes[new].view(np.int64)), "sid": pa.array(sid[new].view(np.int64)),
                    "s": strings(part.data[ragged(a, z - a)], np.concatenate([[0], np.cumsum(z - a)]), pa.binary()), "first": pa.array(least[new])}))
        return pa.concat_tables(out)

    def settle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("m", "ascending"), ("s", "ascending")]).combine_chunks()
        m, s = bucket.column("m").to_numpy(), bucket.column("s").to_pylist()
        new = [i for i in range(len(s)) if not i or m[i] != m[i - 1] or s[i] != s[i - 1]]
        found = list(resolve(m[new], [s[i] for i in new], bucket.column("first").to_numpy()[new], units))
        at, a, z, least = (np.array(v, np.int64) for v in (zip(*found, strict=True) if found else ([],) * 4))
        # every group that asked for a string gets its windows
        ends = np.append(new[1:], len(s)).astype(np.int64) if new else np.zeros(0, np.int64)
        copies = (ends - np.array(new, np.int64))[at]
        row = ragged(np.array(new, np.int64)[at], copies)
        back = bucket.take(pa.array(row))
        one = [pa.array(np.repeat(v, copies)) for v in (a, z, least)]
        return _rows(2, back.column("_g"), m=back.column("m"), sid=back.column("sid"), a=one[0], z=one[1], least=one[2])

    def apply(table: pa.Table, side: pa.Table) -> pa.Table:
        group = load(table)
        known, codes, sid, least, several, inverse = settled(group, side)
        w = _answers(side, 2)
        wm, ws = (w.column(c).to_numpy().view(np.uint64) for c in ("m", "sid"))
        wa, wz, wl = (w.column(c).to_numpy() for c in ("a", "z", "least"))
        order = np.lexsort((ws, wm))
        wm, ws, wa, wz, wl = (v[order] for v in (wm, ws, wa, wz, wl))
        # window rows of each class that overlaps in part
        start, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (wm[1:] != wm[:-1]) | (ws[1:] != ws[:-1])])) if len(wm) else np.zeros(0, np.int64)
        mine = np.flatnonzero(several)
        start[mine], size[mine] = edge, np.diff(np.append(edge, len(wm)))

        slices = by_slice(known, inverse)

        def parts():
            for at, part in group.slices():
                change = np.zeros(len(part.values) + 1, np.int64)
                if at in slices:
                    runs, of = slices[at]
                    mine = group.ids[at + runs.row]
                    go = np.flatnonzero(~several[of] & (least[of] < mine))
                    np.add.at(change, runs.first[go], 1)
                    np.add.at(change, runs.first[go] + runs.size[go] + units.window - 1, -1)
                    hard = np.flatnonzero(several[of])
                    each = size[of[hard]]
                    row = ragged(start[of[hard]], each)
                    owner = np.repeat(hard, each)
                    ok = wl[row] < mine[owner]
                    row, owner = row[ok], owner[ok]
                    np.add.at(change, runs.first[owner] + wa[row], 1)
                    np.add.at(change, runs.first[owner] + wz[row] + units.window, -1)
                yield part, np.cumsum(change[:-1]) > 0, at, len(part.first) - 1

        return make(group.rows, parts())

    def with_side(side: DataFrame, function, out: str) -> DataFrame:
        return by_group.cogroup(side.groupBy("_g")).applyInArrow(function, out)

    keys = by_group.applyInArrow(send_keys, _KEYS).groupBy("b").applyInArrow(answer_keys, _SIDE)
    classes = with_side(keys, send_classes, _KEYS).groupBy("b").applyInArrow(answer_classes, _SIDE)
    side = keys.unionByName(classes)
    texts = with_side(side, send_strings, "_g int, m long, sid long, s binary, first long")
    windows = texts.groupBy(F.pmod(F.xxhash64("m"), F.lit(groups)).alias("_b")).applyInArrow(settle, _SIDE)
    return with_side(side.unionByName(windows), apply, schema)
