"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of distinct five-word shingles (64-bit hashes). Two link when their Jaccard
similarity reaches the threshold; a document's component is the smallest id reachable by links.

1. Documents with equal sets (96-bit digests) form a class, represented by its smallest id.
2. A shuffle by shingle counts in how many classes each shingle stands. Shingles of one class only go
   no further. The rest return to their classes with their frequency. Before the shuffle a block
   keeps one row for a class, and of a shingle that is hot in the block it sends a single notice
   to the shingle's partition and the uses straight to their classes, so that no partition collects
   a shingle's uses by all documents; hot anywhere counts as the highest frequency everywhere. The more
   partitions there are, the fewer uses make a shingle hot, so that its share of a partition is bounded.
3. Shingles are ordered by rising frequency. A class of n shingles can only have a partner if they
   share one of its first p = n - ceil(t n) + 1; as shingles of a single class come first, a class with
   p of them has no partner at all.
4. The index. Shingles of the prefix that up to ``FREQUENT`` classes have are indexed singly: partners whose
   first common shingle is such a one meet there. All common shingles of other partners are frequent ones, and
   prefixes extended by g shingles have g + 1 of them in common, two of which fall into the same of g buckets:
   so the frequent shingles of the extended prefix are indexed as combinations of k = 2 within buckets. g is an
   eighth of a size level; a class indexes its own level and the next, partners have one in common. So
   combinations stay about as many as the shingles, and every two linked classes share a key of the index.
5. Candidates are verified by the exact size of the intersection. First the lists of the index are
   verified against leaders (a few rounds, one leader for each class, first the ones with the fewest
   shingles of their own), so that large groups of near copies become one component by a star of
   links; members of one component need no further pair, and lists within one component go no further.
6. In the lists that still span components, every class outside a list's largest component is verified
   against all classes of other components in the list. Pairs are not verified whose sizes and places in the
   order rule a link out, or the parities of their shingles: where these differ, the sets do.

Nothing is capped, sampled or dropped: the leader rounds only save pairs whose link could not change
a component. Hot lists are joined from plain shuffles, which adaptive execution splits.

Defined cases: fewer words than five make one shingle of all; a null text or one without words has an
empty set and links with nothing, its component is its own id; rows without an id get a null
component and link with nothing; rows that repeat an id count once for links and come out each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ragged, release, text_blocks, unvarints, varints
from .common import materialise, partitions, ship
from .components import components

WORDS, THRESHOLD, FREQUENT, LEADER_ROUNDS = 5, (3, 4), 32, 6
#: A class's shared shingles as parities of so many bits (whole words of 64).
PARITY_BITS = 512
BLOCK_BYTES = 2 << 20
_NO_ID = -(1 << 63)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(9)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_RNG.integers(0, 1 << 62)) * 4 + 1)
_SHORT = np.uint64(int(_RNG.integers(1, 1 << 62)))
_PAIR = _RNG.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    parts = [(t or "").encode("utf-8", "replace").translate(_FOLD) for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashed = _mixed(np.add.reduceat(_BYTE[data[at]] * powers[place], np.cumsum(lengths) - lengths))
    bounds = np.cumsum([len(p) + 1 for p in parts])
    cuts = np.concatenate([[0], np.searchsorted(starts, bounds)])
    factors = _factors(words)
    full = _mixed(sum(hashed[j : len(hashed) - words + 1 + j] * factors[j] for j in range(words))) if len(hashed) >= words else none
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            short = hashed[a:b] * factors[: b - a]
            out.append(_mixed(np.array([int(short.sum(dtype=np.uint64)) + int(_SHORT) * (b - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(none)
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 96-bit digest of each set, as 64 and 32 bits."""
    digests = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=12).digest() for x in sets), np.uint32).reshape(-1, 3)
    return np.ascontiguousarray(digests[:, :2]).view(np.uint64).ravel(), digests[:, 2].copy()


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    """Range partition of uniformly distributed 64-bit numbers."""
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
_ROW_SQL = "part int, kind byte, data binary"
#: Frequencies stop at ``_TOP``; a shingle in ``HOT`` classes of one block has it, or in fewer, where that were
#: more than ``HOT_SHARE`` of what the block sends to a partition.
HOT, HOT_SHARE, _TOP = 32, 0.25, 65535
_TOKENS, _MEMBERS, _SHARED, _DOCUMENTS, _NOTICE = 0, 1, 2, 3, 4


def _blob(*arrays: bytes) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a for a in arrays)


def _unblob(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _sliced(parts: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(parts, np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, slice(int(cuts[p]), int(cuts[p + 1]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _shingled(n: int):
    """Documents -> by block: their ids, one row for a class, its shingles by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for nth, table in enumerate(text_blocks(batches, "text", BLOCK_BYTES)):
            ids = np.array([_NO_ID if x is None else x for x in table.column("id").to_pylist()], np.int64)
            sets = []
            for part in text_blocks(table.to_batches(), "text", BLOCK_BYTES // 4):  # the arrays of all bytes' places are large
                sets += shingle_sets(part.column("text").to_pylist())
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            signs, more = _signatures(sets)
            rows = [((partition + nth) % n, _DOCUMENTS, _blob(ids.tobytes(), sizes.tobytes(), signs.tobytes(), more.tobytes()))]
            order = np.lexsort((ids, more, signs))
            order = order[(sizes[order] > 0) & (ids[order] != _NO_ID)]
            if len(order):
                new = _changes(signs[order], more[order])
                first = order[new]
                copies = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
                sign, more = signs[first], more[first]
                for p, s in _sliced(_part(sign, n), n):
                    i = first[s]
                    rows.append((p, _MEMBERS, _blob(ids[i].tobytes(), sizes[i].tobytes(), sign[s].tobytes(), more[s].tobytes(), copies[s].tobytes())))
                token = np.concatenate([sets[i] for i in first.tolist()])
                owner = np.repeat(np.arange(len(first)), sizes[first])
                distinct, of, count = np.unique(token, return_inverse=True, return_counts=True)
                least = max(2, min(HOT, int(len(token) / n * HOT_SHARE)))
                hot = count[of] >= least
                for p, s in _sliced(_part(noticed := distinct[count >= least], n), n):
                    rows.append((p, _NOTICE, noticed[s].tobytes()))
                at = owner[hot]
                rows += _by_class(sign[at], more[at], token[hot], np.full(len(at), _TOP), n)
                token, owner = token[~hot], owner[~hot]
                part = _part(token, n)
                order = np.argsort(part.astype(np.uint16) if n < 1 << 16 else part, kind="stable")
                for p, s in _sliced(part[order], n):
                    i = order[s]
                    counts = np.bincount(owner[i], minlength=len(first))
                    has = np.flatnonzero(counts)
                    rows.append((p, _TOKENS, _blob(token[i].tobytes(), sign[has].tobytes(), more[has].tobytes(), varints(counts[has]))))
            yield _rows(rows)
            del table, sets, rows
        token = owner = distinct = of = None
        release()

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, bool)


def _by_class(sign: np.ndarray, more: np.ndarray, token: np.ndarray, often: np.ndarray, n: int) -> list[tuple]:
    """Rows of shared shingles, sorted by class (``sign`` and ``more`` in ascending order) for the classes' partitions."""
    rows = []
    for p, s in _sliced(_part(sign, n), n):
        first = np.flatnonzero(_changes(sign[s], more[s]))
        counts = np.diff(np.concatenate([first, [s.stop - s.start]]))
        rows.append((p, _SHARED, _blob(sign[s][first].tobytes(), more[s][first].tobytes(), varints(counts), token[s].tobytes(), often[s].astype("<u2").tobytes())))
    return rows


def _counted(n: int):
    """One range of shingles -> those of several classes, with their frequency, by class; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        # A token knows its class by the number of its entry in the tables of signs.
        tokens, owners, signs, mores, notices, entries = [none], [np.zeros(0, np.int32)], [none], [np.zeros(0, np.uint32)], [none], 0
        for batch in batches:
            passing = []
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _TOKENS:
                    t, s, m, c = _unblob(data)
                    times = unvarints(c)
                    tokens.append(np.frombuffer(t, np.uint64))
                    owners.append(np.repeat(np.arange(entries, entries + len(times), dtype=np.int32), times))
                    signs.append(np.frombuffer(s, np.uint64))
                    mores.append(np.frombuffer(m, np.uint32))
                    entries += len(times)
                elif kind == _NOTICE:
                    notices.append(np.unique(np.frombuffer(data, np.uint64)))
                else:
                    passing.append((part, kind, data))
            if passing:
                yield _rows(passing)
        token, noticed = np.concatenate(tokens), np.unique(np.concatenate(notices))
        del tokens, notices
        owner = np.concatenate(owners)
        del owners
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(token) else np.zeros(0, bool)
        keep = several | np.isin(token, noticed)
        token, owner = token[keep], owner[order[keep]]
        sign, more = np.concatenate(signs)[owner], np.concatenate(mores)[owner]
        del order, same, several, keep, owner, signs, mores
        order = np.lexsort((more, sign, token))
        token, sign, more = token[order], sign[order], more[order]
        new = _changes(token, sign, more)
        token, sign, more = token[new], sign[new], more[new]
        _, of, count = np.unique(token, return_inverse=True, return_counts=True)
        often = np.where(np.isin(token, noticed), _TOP, np.minimum(count[of], _TOP)) if len(token) else np.zeros(0, np.int64)
        keep = often > 1
        token, sign, more, often = token[keep], sign[keep], more[keep], often[keep]
        order = np.lexsort((more, sign))
        if rows := _by_class(sign[order], more[order], token[order], often[order], n):
            yield _rows(rows)
        del token, sign, more, often, order, rows
        release()

    return run


def prefix_length(n: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """n - ceil(t n) + 1."""
    return n + 1 + (-(threshold[0] * n) // threshold[1])


@lru_cache(maxsize=16)
def size_levels(threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Lower bounds of size levels, such that two sizes that allow a link are on one level or on neighbours."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, threshold[1] * (bounds[-1] - 1) // threshold[0] + 1))
    return np.array(bounds)


def buckets_of(level: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """g of a size level: an eighth of its smallest size, at least 1, but less than the shingles that partners must share."""
    least = size_levels(threshold)[level]
    return np.minimum(np.maximum(least // 8, 1), -(-threshold[0] * least // threshold[1]) - 1)


def index_keys(token: np.ndarray, often: np.ndarray, counts: np.ndarray, sizes: np.ndarray, frequent: int, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of classes: class, key, place of its (first) shingle in the class's order, whether it is a combination.

    ``token`` and ``often`` hold the classes' shared shingles in their order, ``counts`` how many each class has,
    ``sizes`` the sizes of the whole sets.
    """
    starts = np.cumsum(counts) - counts
    cls = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(token)) - starts[cls]
    left = prefix_length(sizes, threshold) - (sizes - counts)
    level = np.searchsorted(size_levels(threshold), sizes, side="right") - 1
    rare = often <= frequent
    found = []
    for step in (0, 1):
        g = buckets_of(level + step, threshold)
        # Without buckets (sets so small that partners may share one shingle only) every shingle stands singly.
        single = np.flatnonzero((at < left[cls]) & (rare | (g[cls] == 0)))
        found.append((cls[single], token[single], at[single], np.zeros(len(single), bool)))
        i = np.flatnonzero((at < (left + g)[cls]) & ~rare & (g[cls] > 0))
        bucket = _mixed(token[i]) % np.maximum(g[cls[i]], 1).astype(np.uint64)
        order = np.lexsort((at[i], bucket, cls[i]))
        i, bucket = i[order], bucket[order]
        apart = 1
        while True:
            a, b = i[:-apart], i[apart:]
            same = (cls[a] == cls[b]) & (bucket[:-apart] == bucket[apart:])
            if not same.any():
                break
            a, b = a[same], b[same]
            low, high = np.minimum(token[a], token[b]), np.maximum(token[a], token[b])
            found.append((cls[a], _mixed(low * _PAIR[0] + high * _PAIR[1]), at[a], np.ones(len(a), bool)))
            apart += 1
    cls, key, at, pair = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, key, cls))
    order = order[_changes(cls[order], key[order])]
    return cls[order], key[order], at[order], pair[order]


def parities(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each class the parities of its shingles in ``PARITY_BITS`` bins. Where two classes' differ, one has a shingle that the other lacks."""
    of = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(of * PARITY_BITS + (token % np.uint64(PARITY_BITS)).astype(np.int64), minlength=len(counts) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(counts), PARITY_BITS), axis=1).view(np.uint64)


_CLASSES_SQL = "kind int, doc_id long, sign long, more int, n long, tokens array<long>, keys array<long>, at array<int>, bits array<long>"


def _classes(frequent: int, threshold: tuple[int, int]):
    """One range of classes -> the smallest id of those with several documents, and those that can have partners.

    Documents pass as (doc_id, sign, more, n).
    """
    names = ["kind", "doc_id", "sign", "more", "n", "tokens", "keys", "at", "bits"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def made(kind: int, ids: np.ndarray, signs: np.ndarray, mores: np.ndarray, sizes: np.ndarray, *lists: pa.Array) -> pa.RecordBatch:
        lists = lists or [pa.nulls(len(ids), t) for t in types[5:]]
        return pa.record_batch([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(signs.view(np.int64)), pa.array(mores.view(np.int32)), pa.array(sizes), *lists], names=names)

    def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, shared = [[], [], [], [], []], [[], [], [], []]
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == _DOCUMENTS:
                    ids, sizes, signs, mores = (np.frombuffer(x, t) for x, t in zip(_unblob(data), (np.int64, np.int64, np.uint64, np.uint32), strict=True))
                    yield made(_DOCUMENTS, ids, signs, mores, sizes)
                elif kind == _MEMBERS:
                    for to, x, t in zip(members, _unblob(data), (np.int64, np.int64, np.uint64, np.uint32, np.int64), strict=True):
                        to.append(np.frombuffer(x, t))
                else:
                    sign, more, counts, tokens, often = _unblob(data)
                    times = unvarints(counts)
                    shared[0].append(np.repeat(np.frombuffer(sign, np.uint64), times))
                    shared[1].append(np.repeat(np.frombuffer(more, np.uint32), times))
                    shared[2].append(np.frombuffer(tokens, np.uint64))
                    shared[3].append(np.frombuffer(often, "<u2"))
        if not members[0]:
            return
        ids, sizes, signs, mores, copies = map(np.concatenate, members)
        order = np.lexsort((ids, mores, signs))
        ids, sizes, signs, mores, copies = (x[order] for x in (ids, sizes, signs, mores, copies))
        starts = np.flatnonzero(_changes(signs, mores))
        several = np.add.reduceat(copies, starts) > 1
        ids, sizes, signs, mores = (x[starts] for x in (ids, sizes, signs, mores))
        yield made(_MEMBERS, ids[several], signs[several], mores[several], sizes[several])
        if not shared[0]:
            return
        sign, more, token, often = map(np.concatenate, shared)
        del shared
        order = np.lexsort((token, often, more, sign))
        sign, more, token, often = (x[order] for x in (sign, more, token, often))
        new = _changes(sign, more, token)
        sign, more, token, often = (x[new] for x in (sign, more, token, often))
        starts = np.flatnonzero(_changes(sign, more))
        counts = np.diff(np.concatenate([starts, [len(sign)]]))
        # Both sides are sorted by (sign, more); classes with shared shingles are among the members.
        wide = np.dtype([("s", np.uint64), ("m", np.uint32)])
        pack = lambda s, m: np.array(list(zip(s.tolist(), m.tolist(), strict=True)), wide)
        cls = np.searchsorted(pack(signs, mores), pack(sign[starts], more[starts]))
        del sign, more, order, new
        open_ = np.flatnonzero(prefix_length(sizes[cls], threshold) - (sizes[cls] - counts) > 0)
        for i in range(0, len(open_), 500):
            at = open_[i : i + 500]
            inside = ragged(np.arange(len(token)), starts[at], counts[at])
            k = cls[at]
            of, key, place, _ = index_keys(token[inside], often[inside], counts[at], sizes[k], frequent, threshold)
            keys = np.bincount(of, minlength=len(at))
            yield made(_SHARED, ids[k], signs[k], mores[k], sizes[k], listed(token[inside], counts[at], pa.int64()), listed(key, keys, pa.int64()), listed(place, keys, pa.int32()), listed(parities(token[inside], counts[at]).ravel(), np.full(len(at), PARITY_BITS // 64), pa.int64()))
        del token, often, members
        release()

    return run


def _verified(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link: by the exact size of their intersection."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(threshold[1] * common >= threshold[0] * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, c) after links (a, b) between components have joined them."""
    moved = components(links).withColumnsRenamed({"node": "c", "component": "to"})
    return materialise(component.join(materialise(moved), "c", "left").select("rep", F.coalesce("to", "c").alias("c")))


def _fits(threshold: tuple[int, int]):
    """Whether two classes may link that share the shingles at places ``at`` and ``atb`` of s and sb ordered ones.

    Before these places they share no more than the smaller place, behind them no more than the smaller rest.
    """
    most = F.least("at", "atb") + 1 + F.least(F.col("s") - F.col("at"), F.col("sb") - F.col("atb")) - 1
    return (threshold[0] + threshold[1]) * most >= threshold[0] * (F.col("n") + F.col("nb"))


def _parity_fits(threshold: tuple[int, int]):
    """Whether two classes may link whose parities ``bits`` and ``bitsb`` differ as they do."""
    differ = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bitsb")[i])) for i in range(PARITY_BITS // 64))
    return (threshold[0] + threshold[1]) * (F.col("s") + F.col("sb") - differ) >= 2 * threshold[0] * (F.col("n") + F.col("nb"))


def linked_components(classes: DataFrame, threshold: tuple[int, int] = THRESHOLD, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(rep, c): the smallest representative that every class which can have partners reaches.

    ``classes``: rep, n, tokens, and the class's index entries as ``keys`` with their places ``at``.
    """
    # Shingles that no other class has, out of a thousand: the fewer, the better a class leads.
    own = ((F.col("n") - F.size("tokens")) * 1000 / F.col("n")).cast("long")
    entries = classes.select("rep", "n", F.size("tokens").alias("s"), own.alias("alone"), F.explode(F.arrays_zip("keys", "at")).alias("x")).select("rep", "n", "s", "alone", F.col("x.at").alias("at"), F.col("x.keys").alias("key"))
    component = materialise(classes.select("rep", F.col("rep").alias("c")))
    name = lambda x: component.select(F.col("rep").alias(x), F.col("c").alias(f"c{x}"))
    live = entries.withColumn("c", F.col("rep"))
    for r in range(rounds + 1):
        order = F.col("alone") if r == 0 else F.xxhash64("rep", F.lit(r))
        leader = F.min(F.struct(order.alias("o"), "rep", "n", "s", "at", "c")).alias("l")
        lists = live.groupBy("key").agg(leader, F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key", F.col("l.rep").alias("b"), F.col("l.n").alias("nb"), F.col("l.s").alias("sb"), F.col("l.at").alias("atb"), F.col("l.c").alias("cb"))
        # A list within one component stays so: only the others go on.
        met = materialise(live.join(materialise(lists), "key"))
        live = met.select("rep", "n", "s", "alone", "at", "key", "c")
        if r == rounds or met.isEmpty():
            break
        votes = met.where((F.col("c") != F.col("cb")) & _fits(threshold)).groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("v"))
        pairs = materialise(votes.groupBy("a").agg(F.max(F.struct("v", "b")).alias("x")).select("a", F.col("x.b").alias("b")))
        links = _verified(pairs, classes, threshold)
        links = materialise(links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        found = links.count()
        if found:
            component = _merged(component, links)
            live = live.drop("c").join(component, "rep")
        if found * 20 < pairs.count():  # leaders settle little more; the rest is verified pair by pair
            break
    if live.isEmpty():
        return component
    parts = live.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    lists = materialise(parts.groupBy("key").agg(F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("x.c").alias("main")))
    live = materialise(live.join(lists, "key").join(classes.select("rep", "bits"), "rep"))
    other = live.drop("alone", "main").withColumnsRenamed({"rep": "b", "n": "nb", "s": "sb", "at": "atb", "c": "cb", "bits": "bitsb"})
    pairs = live.where("c <> main").join(other, "key").where((F.col("c") != F.col("cb")) & _fits(threshold) & _parity_fits(threshold))
    pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    links = _verified(materialise(pairs), classes, threshold)
    links = materialise(links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return component if links.isEmpty() else _merged(component, links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD, frequent: int = FREQUENT, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, class_id (smallest id with the same set), component_id."""
    spark = docs.sparkSession
    ship(spark)
    only = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    n = partitions(spark, only)
    rows = only.mapInArrow(_shingled(n), _ROW_SQL).repartitionById(n, F.col("part"))
    rows = rows.mapInArrow(_counted(n), _ROW_SQL).repartitionById(n, F.col("part"))
    done = materialise(rows.mapInArrow(_classes(frequent, threshold), _CLASSES_SQL))
    classes = done.where(F.col("kind") == _SHARED).select(F.col("doc_id").alias("rep"), "n", "tokens", "keys", "at", "bits")
    if classes.isEmpty():
        component = spark.createDataFrame([], "rep long, c long")
    else:
        component = linked_components(classes, threshold, rounds).where("rep <> c")
    # A class of one document is known by that document's id; only classes of several need a name.
    names = materialise(done.where(F.col("kind") == _MEMBERS).select("sign", "more", F.col("doc_id").alias("rep")).join(materialise(component), "rep", "left"))
    singles = materialise(component.withColumnsRenamed({"rep": "doc_id", "c": "own"}))
    out = done.where(F.col("kind") == _DOCUMENTS).select("doc_id", "sign", "more", "n").join(names, ["sign", "more"], "left").join(singles, "doc_id", "left")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rep = F.when(linkable, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), rep.alias("class_id"), F.when(linkable, F.coalesce("c", "rep", "own", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""
