"""Exact substring dedup with a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Strings are told apart by prefix polynomial hashes.

Every string of LENGTH bytes contains a minimizer: the least of its hashed
GRAM-byte pieces. Consecutive strings with the same minimizer (the anchor) form
a segment, so equal passages have equal anchors wherever they stand, and equal
segments but at their edges. The documents are dealt into splits, and buckets of
anchors answer the splits:

1. A split tells each anchor's bucket its segments there, each with the split's
   least document. The bucket answers, for every segment, the least document of
   all; or that the anchor has several different segments.
2. Segments that a smaller document also has go as they are. The rest of an
   anchor with several segments is looked at string by string. A split sorts
   these suffixes with a mergesort whose comparisons find the common extension of
   two suffixes by binary search over prefix hashes; neighbours with LENGTH bytes
   in common are one string (the bytes are compared, to catch collisions). Each
   string goes to its bucket once, with the split's least document, and the
   bucket answers the least of all.
3. With both answers a split marks the bytes.

Nothing is sent once a document but once a split: what every document holds is
gathered where it lies first. Anchors with more than ``MANY`` different segments
in one split skip step 1 there and are looked at string by string at once.
Buckets receive arrays, not rows. All tasks hold a split's or a bucket's share,
whose size does not grow with the input. Across splits a string is known by its
64-bit hash and two of its bytes, a segment by its anchor and 48 bits.

Defined cases: null and empty texts have no bytes; texts under LENGTH bytes lose
none; equal texts under different ids lose all but the first; rows with equal
ids are not smaller than one another; a null id is neither smaller nor greater,
so its row loses nothing and takes nothing; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, load, mix64, row_slices, text_buffers

LENGTH = 50
GRAM = 22
SPREAD = LENGTH - GRAM + 1  #: pieces of a string
HEAD = 16  #: bytes of a string that are sorted as two numbers
MANY = 16
SPLIT_BYTES = 4 << 20  #: text of a split, about
LEAST_SPLITS = 256
BUCKET_BYTES = 6 << 20  #: text for each bucket, about
LEAST_BUCKETS = 64
SLICE = 1 << 20

SEVERAL = -1  #: instead of a least document: the anchor has several segments

PLACE_BITS = 26  #: low bits of an anchor's key that hold its place in a stretch
STRETCH = 1 << 25  #: windows whose anchors are looked for at once
MESSAGE = "bucket int, split int, step int, body binary"
ANSWER = "split int, step int, body binary"


def _anchors(h: np.ndarray, n: int) -> np.ndarray:
    """Of each of the first ``n`` windows of SPREAD pieces, the one of least hash, the first of them: minima over spans of doubling width.

    Places stand in the low bits of the keys, counted from the start of a stretch of windows, so that texts of any length have room.
    """
    out = np.empty(n, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for lo in range(0, n, STRETCH):
        hi = min(n, lo + STRETCH)
        key = h[lo : hi + SPREAD - 1] & ~low
        key |= np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= SPREAD:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = SPREAD - width
        least = np.minimum(key[: hi - lo], key[rest : rest + hi - lo])
        least &= low
        np.add(least.view(np.int64), lo, out=out[lo:hi])
    return out


def segments(ph: PrefixHash, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first string, last string, anchor hash, segment hash) of all segments of texts laid end to end."""
    n = int(ends[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = ph.rolling(GRAM)
    places = n - LENGTH + 1
    anchor = _anchors(h, places)
    new = np.ones(places, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    # a text's strings begin with it and end LENGTH bytes before it does
    edges = np.concatenate([ends[:-1], np.maximum(ends[1:] - LENGTH + 1, ends[:-1])])
    new[edges[edges < places]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], places) - 1
    text = np.searchsorted(ends, first, "right") - 1
    inside = first + LENGTH <= ends[text + 1]
    text, first, last = text[inside], first[inside], last[inside]
    return text, first, last, h[anchor[first]], mix64(ph.at(first, last + LENGTH) + (last - first).astype(np.uint64)) >> np.uint64(16)


# The suffix sort.


def common(ph: PrefixHash, a: np.ndarray, b: np.ndarray, most: int = LENGTH, least: int = 0) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to ``most``, where ``least`` bytes are known to be equal: the whole first, then binary search over prefix hashes."""
    a, b = ph.parts(a), ph.parts(b)
    out = np.where(ph.equal(a, b, most), most, least)
    open_ = np.flatnonzero(out < most)
    a, b = tuple(x[open_] for x in a), tuple(x[open_] for x in b)
    lo, hi = out[open_], np.full(len(open_), most - 1)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = ph.equal(a, b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    out[open_] = lo
    return out


def _before(ph: PrefixHash, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the string at a sorts before the one at b; their first HEAD bytes are equal."""
    n = common(ph, a, b, least=HEAD)
    k = np.minimum(n, LENGTH - 1)
    return (n < LENGTH) & (data[a + k] < data[b + k])


def suffix_sort(ph: PrefixHash, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in order of the strings of LENGTH bytes there (a stable mergesort).

    The first HEAD bytes, as two numbers, part the suffixes into runs; within
    the runs, sorted pieces of doubling size are merged: each suffix finds its rank
    in the other piece by binary search, every comparison finds the common
    extension by binary search over prefix hashes.
    """
    if len(at) < 2:
        return at
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    head, rest = (np.ascontiguousarray(eight[at + j]).view(">u8").reshape(-1).astype(np.uint64) for j in (0, 8))
    order = np.lexsort((rest, head))
    at, head, rest = at[order], head[order], rest[order]
    new = np.ones(len(at), bool)
    new[1:] = (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])
    run_first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    run_end = np.append(run_first[1:], len(at))
    offset = np.arange(len(at)) - run_first[run]
    longest = int((run_end - run_first).max())
    size = 1
    while size < longest:
        # only runs longer than a piece have anything to merge
        live = np.flatnonzero((run_end - run_first)[run] > size)
        pair = offset[live] // (2 * size)
        base = run_first[run[live]] + pair * 2 * size
        middle = np.minimum(base + size, run_end[run[live]])
        stop = np.minimum(base + 2 * size, run_end[run[live]])
        right = live >= middle
        lo, hi = np.where(right, base, middle), np.where(right, middle, stop)
        first = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            mine, other = at[live[open_]], at[mid]
            # a suffix of the right piece goes after equal ones of the left piece
            is_right = right[open_]
            a, b = np.where(is_right, mine, other), np.where(is_right, other, mine)
            less = _before(ph, data, a, b)
            up = np.where(is_right, ~less, less)
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
        place = base + (live - np.where(right, middle, base)) + (lo - first)
        merged = at.copy()
        merged[place] = at[live]
        at = merged
        size *= 2
    return at


def string_classes(ph: PrefixHash, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, whether each begins a new string)."""
    at = suffix_sort(ph, data, at)
    new = np.ones(len(at), bool)
    if len(at) > 1:
        a, b = at[:-1], at[1:]
        new[1:] = ~ph.equal(ph.parts(a), ph.parts(b), LENGTH)
        # equal hashes are no proof: the bytes decide
        same = np.flatnonzero(~new[1:])
        for lo in range(0, len(same), 1 << 16):
            k = same[lo : lo + (1 << 16)]
            windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            new[1:][k] = (windows[a[k]] != windows[b[k]]).any(1)
    return at, new


# Bodies of messages and answers.


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *[len(x) for x in arrays]], np.int64).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _sorted(x: np.ndarray) -> np.ndarray:
    """An ascending array as the byte planes of its steps: the high planes are zeros, which the shuffle's compression removes."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.reshape(-1)


def _ascending(planes: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(steps, dtype=kind)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """For records ordered by bucket: each bucket that has some, and where."""
    at = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(at)).tolist():
        yield b, slice(int(at[b]), int(at[b + 1]))


def _documents(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table of ids, numbers into it of two or four bytes)."""
    table, number = np.unique(doc, return_inverse=True)
    return table, number.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)


def _first_of(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys (ordered), the least document of each, and whether it has several documents."""
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    i = np.flatnonzero(new)
    several = doc[i] != doc[np.append(i[1:], len(doc)) - 1] if len(i) else np.zeros(0, bool)
    return [k[i] for k in keys], doc[i], several


class Job:
    """What all tasks know: the numbers of splits and buckets, and the columns."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.bits = np.uint64(32)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)

    # Splits.

    def _slices(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, ids, bytes, ends) of slices of a split's rows that have an id."""
        for batch in table.to_batches():
            ids = batch.column(batch.schema.get_field_index("id"))
            data, ends = text_buffers(batch.column(batch.schema.get_field_index("text")))
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for lo, hi in row_slices(ends, SLICE):
                yield ids[lo:hi], known[lo:hi], data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]

    def ask_segments(self, key, table: pa.Table) -> pa.Table:
        """Step 1: a split's anchors and segments, for their buckets."""
        parts = []
        for ids, known, data, ends in self._slices(table):
            text, _, _, anchor, segment = segments(PrefixHash(data), ends)
            good = known[text]
            parts.append((anchor[good], segment[good], ids[text[good]]))
        split = key[0].as_py()
        rows = []
        if parts:
            anchor, segment, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = self.bucket(anchor)
            (bucket, anchor, segment), doc, several = _first_of([bucket, anchor & np.uint64(0xFFFFFFFF), segment], doc)
            crowd = self._crowd(bucket, anchor)
            begins = np.ones(len(anchor), bool)
            begins[1:] = (bucket[1:] != bucket[:-1]) | (anchor[1:] != anchor[:-1])
            keep = ~crowd | begins  # a crowded anchor only says so, once
            bucket, anchor, segment, doc, several, crowd = (x[keep] for x in (bucket, anchor, segment, doc, several, crowd))
            for b, s in _by_bucket(bucket, self.buckets):
                table_, number = _documents(doc[s])
                low, high = segment[s].astype(np.uint32), (segment[s] >> np.uint64(32)).astype(np.uint16)
                rows.append((b, split, 1, _pack(_sorted(anchor[s].astype(np.uint32)), low, high, _sorted(table_), number.view(np.uint8), np.packbits(several[s]), np.packbits(crowd[s]))))
        return _table(rows, MESSAGE)

    @staticmethod
    def _crowd(bucket: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Which of the ordered records are of an anchor with more than MANY segments."""
        new = np.ones(len(anchor), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (anchor[1:] != anchor[:-1])
        group = np.cumsum(new) - 1
        return (np.bincount(group) > MANY)[group] if len(anchor) else new

    def _local(self, table: pa.Table, answers: dict) -> Iterator[tuple]:
        """For each slice, what the answers of step 1 say about its segments.

        Gives (ids, known, bytes, ends, prefix hashes, texts, first, last, gone, look): ``gone`` segments a smaller
        document also has, ``look`` segments are to be looked at string by string.
        """
        found, crowds, parts = answers, np.zeros(0, np.uint64), []
        for ids, known, data, ends in self._slices(table):
            ph = PrefixHash(data)
            parts.append((ids, known, data, ends, ph, *segments(ph, ends)))
        if not parts:
            return
        # the same crowds as in step 1; the buckets have called their anchors several
        names = [(self.bucket(p[8]).astype(np.uint64) << self.bits) | (p[8] & np.uint64(0xFFFFFFFF)) for p in parts]
        many = [_member(found["several"], n) for n in names]
        name = np.concatenate([n[m & p[1][p[5]]] for n, m, p in zip(names, many, parts, strict=True)])
        segment = np.concatenate([p[9][m & p[1][p[5]]] for m, p in zip(many, parts, strict=True)])
        if len(name):
            (name, _), _, _ = _first_of([name, segment], np.zeros(len(name), np.int64))
            crowds = np.unique(name[self._crowd(name, name)])
        for (ids, known, data, ends, ph, text, first, last, _, segment), name, several in zip(parts, names, many, strict=True):
            mine = ids[text]
            gone = _lookup(found["single"], name, mine) < mine
            k = np.flatnonzero(several)
            gone[k] |= _lookup2(found["segment"], name[k], segment[k], mine[k]) < mine[k]
            crowd = np.zeros(len(name), bool)
            crowd[k] = _member(crowds, name[k])
            gone &= ~crowd & known[text]
            yield ids, known, data, ends, ph, text, first, last, gone, several & ~gone & known[text]

    def _answers(self, table: pa.Table) -> dict:
        single, several, segs, strings = [], [], [], []
        for step, body in zip(table.column("step").to_pylist(), table.column("body").to_pylist(), strict=True):
            if step == 1:
                b, anchor, least, many, of, segment, doc = _unpack(body, np.uint64, np.uint32, np.int64, np.uint32, np.uint32, np.uint64, np.int64)
                high = b[0] << self.bits
                single.append((high | anchor.astype(np.uint64), least))
                several.append(high | many.astype(np.uint64))
                segs.append((high | of.astype(np.uint64), segment, doc))
            else:
                strings.append(_unpack(body, np.uint64, np.uint16, np.int64))
        return {
            "single": _sorted_pairs(single),
            "several": np.unique(np.concatenate(several)) if several else np.zeros(0, np.uint64),
            "segment": _sorted_triples(segs, np.uint64),
            "string": _sorted_triples([tuple(x) for x in strings], np.uint16),
        }

    def ask_strings(self, key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 2: the strings that segments leave open, for their buckets."""
        names, checks, docs = [], [], []
        if left.num_rows:
            for ids, _, data, _, ph, text, first, last, _, look in self._local(left, self._answers(right)):
                at, of = _strings(text, first, last, look)
                if not len(at):
                    continue
                doc_of = np.zeros(len(data), np.int64)
                doc_of[at] = ids[of]
                order, new = string_classes(ph, data, at)
                starts = np.flatnonzero(new)
                least, most = np.minimum.reduceat(doc_of[order], starts), np.maximum.reduceat(doc_of[order], starts)
                # a string's last document stands beside its first, so that it counts as one of several
                one = order[np.concatenate([starts, starts[most > least]])]
                names.append(ph.at(one, one + LENGTH))
                checks.append(_check(data, one))
                docs.append(np.concatenate([least, most[most > least]]))
        rows = []
        if names:
            name, check, doc = np.concatenate(names), np.concatenate(checks), np.concatenate(docs)
            (bucket, name, check), doc, several = _first_of([self.bucket(name), name, check], doc)
            for b, s in _by_bucket(bucket, self.buckets):
                table_, number = _documents(doc[s])
                rows.append((b, key[0].as_py(), 2, _pack(_sorted(name[s]), check[s], _sorted(table_), number.view(np.uint8), np.packbits(several[s]))))
        return _table(rows, MESSAGE)

    def mark(self, key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 3: what each text of a split loses."""
        rows = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        if left.num_rows:
            answers = self._answers(right)
            todo = self._local(left, answers)
            for ids, known, data, ends, ph, text, first, last, gone, look in todo:
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, first[gone], 1)
                np.add.at(cover, last[gone] + LENGTH, -1)
                at, of = _strings(text, first, last, look)
                if len(at) and len(answers["string"][0]):
                    least = _lookup2(answers["string"], ph.at(at, at + LENGTH), _check(data, at), ids[of])
                    hit = least < ids[of]
                    np.add.at(cover, at[hit], 1)
                    np.add.at(cover, at[hit] + LENGTH, -1)
                mask = np.cumsum(cover[:-1]) > 0
                for k in range(len(ids)):
                    m = mask[ends[k] : ends[k + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], m])))
                    rows["id"].append(int(ids[k]) if known[k] else None)
                    rows["n_bytes"].append(len(m))
                    rows["n_removed"].append(int(m.sum()))
                    rows["n_spans"].append(int(m[edge].sum()))
                    rows["kept"].append(data[ends[k] : ends[k + 1]][~m].tobytes())
        return pa.table({"id": pa.array(rows["id"], pa.int64()), **{c: pa.array(rows[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array(rows["kept"], pa.binary())})

    # Buckets.

    def answer(self, key, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        steps = table.column("step").to_pylist()
        splits = table.column("split").to_pylist()
        bodies = table.column("body").to_pylist()
        return _table(self._answer_segments(bucket, splits, bodies) if steps[0] == 1 else self._answer_strings(splits, bodies), ANSWER)

    def _answer_segments(self, bucket: int, splits: list[int], bodies: list[bytes]) -> list[tuple]:
        anchors, segs, docs, flags, sizes = [], [], [], [], []
        for body in bodies:
            a, low, high, table_, number, many, crowd = _unpack(body, np.uint8, np.uint32, np.uint16, np.uint8, np.uint8, np.uint8, np.uint8)
            a, table_ = _ascending(a, np.uint32), _ascending(table_, np.int64)
            anchors.append(a)
            segs.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
            docs.append(table_[_numbers(number, len(table_))])
            flags.append(np.unpackbits(many, count=len(a)) | (np.unpackbits(crowd, count=len(a)) << 1))
            sizes.append(len(a))
        who = np.repeat(np.arange(len(splits)), sizes)
        anchor, segment, doc, flag = (np.concatenate(x) for x in (anchors, segs, docs, flags))
        order = np.lexsort((doc, segment, anchor))
        anchor, segment, doc, flag, who = (x[order] for x in (anchor, segment, doc, flag, who))
        new_a = np.ones(len(anchor), bool)
        new_a[1:] = anchor[1:] != anchor[:-1]
        new_s = new_a.copy()
        new_s[1:] |= segment[1:] != segment[:-1]
        ga, gs = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
        least = doc[new_s][gs]
        crowd = np.bincount(ga, weights=flag & 2)[ga] > 0
        several = (np.bincount(ga, weights=new_s)[ga] > 1) | crowd
        shared = (np.bincount(gs)[gs] > 1) | (flag & 1 > 0)
        # an anchor with one segment needs an answer where some document is not the least
        single = ~several & shared & ((doc > least) | (flag & 1 > 0))
        segment_known = several & shared & ((doc > least) | (flag & 1 > 0)) & (flag & 2 == 0)
        out = []
        order = np.argsort(who, kind="stable")
        at = np.searchsorted(who[order], np.arange(len(splits) + 1))
        for i, split in enumerate(splits):
            k = order[at[i] : at[i + 1]]
            one, many, seg = k[single[k]], k[several[k]], k[segment_known[k]]
            if len(one) or len(many):
                out.append((split, 1, _pack(np.array([bucket], np.uint64), anchor[one], least[one], np.unique(anchor[many]), anchor[seg], segment[seg], least[seg])))
        return out

    def _answer_strings(self, splits: list[int], bodies: list[bytes]) -> list[tuple]:
        parts = [_unpack(b, np.uint8, np.uint16, np.uint8, np.uint8, np.uint8) for b in bodies]
        parts = [(_ascending(a, np.uint64), c, _ascending(t, np.int64), *rest) for a, c, t, *rest in parts]
        who = np.repeat(np.arange(len(splits)), [len(p[0]) for p in parts])
        name, check = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.concatenate([p[2][_numbers(p[3], len(p[2]))] for p in parts])
        several = np.concatenate([np.unpackbits(p[4], count=len(p[0])) for p in parts])
        order = np.lexsort((doc, check, name))
        name, check, doc, several, who = (x[order] for x in (name, check, doc, several, who))
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        group = np.cumsum(new) - 1
        least = doc[new][group]
        tell = (doc > least) | (several > 0)
        told = np.flatnonzero(tell)
        told = told[np.argsort(who[told], kind="stable")]
        at = np.searchsorted(who[told], np.arange(len(splits) + 1))
        return [(s, 2, _pack(name[k], check[k], least[k])) for i, s in enumerate(splits) if len(k := told[at[i] : at[i + 1]])]


def _check(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two of a string's bytes, which strings with the same hash would have to share as well."""
    return data[at + 13].astype(np.uint16) | (data[at + 37].astype(np.uint16) << np.uint16(8))


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _numbers(raw: np.ndarray, size: int) -> np.ndarray:
    return np.frombuffer(raw.tobytes(), np.uint16 if size <= 1 << 16 else np.uint32)


def _strings(text: np.ndarray, first: np.ndarray, last: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, texts) of the strings of the segments to look at."""
    n = (last - first + 1) * look
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return at, np.repeat(text, n)


def _sorted_pairs(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    name, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(name, kind="stable")
    return name[order], value[order]


def _sorted_triples(parts: list[tuple], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, kind), np.zeros(0, np.int64)
    name, check, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    joint = _joint(name, check)
    order = np.argsort(joint, kind="stable")
    return joint[order], check[order], value[order]


def _joint(name: np.ndarray, check: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(name * np.uint64(0x9E3779B97F4A7C15) ^ mix64(check.astype(np.uint64) + np.uint64(1)))


def _lookup(pairs: tuple, name: np.ndarray, default: np.ndarray) -> np.ndarray:
    keys, values = pairs
    if not len(keys):
        return default
    k = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
    return np.where(keys[k] == name, values[k], default)


def _lookup2(triples: tuple, name: np.ndarray, check: np.ndarray, default: np.ndarray) -> np.ndarray:
    joint, checks, values = triples
    if not len(joint):
        return default
    mine = _joint(name, check)
    k = np.minimum(np.searchsorted(joint, mine), len(joint) - 1)
    return np.where((joint[k] == mine) & (checks[k] == check), values[k], default)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"body": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds.get(n, pa.int32())) for i, n in enumerate(names)})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row; ``kept`` are the remaining bytes. Ids are integers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    splits, job = max(LEAST_SPLITS, total // SPLIT_BYTES), Job(max(LEAST_BUCKETS, total // BUCKET_BYTES))
    dealt = rows.withColumn("split", F.pmod(F.xxhash64("id", "text"), F.lit(splits)).cast("int"))
    split, bucket = lambda x: x.groupBy("split"), lambda x: x.groupBy("bucket")
    answer = lambda key, t: job.answer(key, t)
    # the texts are dealt once: the three steps read the same exchange
    said = split(dealt).applyInArrow(lambda key, t: job.ask_segments(key, t), MESSAGE)
    first = bucket(said).applyInArrow(answer, ANSWER)
    asked = split(dealt).cogroup(split(first)).applyInArrow(lambda key, x, y: job.ask_strings(key, x, y), MESSAGE)
    second = bucket(asked).applyInArrow(answer, ANSWER)
    out = split(dealt).cogroup(split(first.union(second))).applyInArrow(lambda key, x, y: job.mark(key, x, y), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op8_substring(spark, sf_dir: str) -> DataFrame:
    x = remove_repeats(load(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH} + 1)) AS i FROM h WHERE length(x) >= {2 * LENGTH} AND doc_id IS NOT NULL),
s AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, {2 * LENGTH})) AS s FROM w),
m AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i FROM s JOIN m USING (s) WHERE m < doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hit)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
k AS (SELECT doc_id, count(*) AS n, sum(b - a) AS z, max(b) AS e, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM q JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(z, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE coalesce(head, '') || substr(x, 2 * e + 1) END)) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op8_substring": op8_substring}
ORACLES = {"op8_substring": OP8_SQL}
