"""Removal of every byte that a repeated 200-byte string covers, by sharded suffix arrays.

A string of ``LENGTH`` bytes holds ``WINDOW`` grams of ``GRAM`` bytes; the one with the smallest hash
is its anchor, and equal strings have equal anchors at equal places.  So the strings of a corpus fall
into groups by anchor, and no group needs another one:

1. Each run of neighbouring strings with the same anchor is a context: one row with the anchor's hash
   and the hash of the context's bytes.  Anchors that stand once are done; contexts that stand twice
   or more, as in copies, are repeated as a whole.
2. Different contexts of the same anchor go to shards.  A shard is one text: suffixes are classified,
   leftmost-smaller substrings named and sorted, the other suffixes induced bucket by bucket, and
   common prefixes computed in text order (only the irreducible ones by comparison).  Strings whose
   neighbour in the array shares ``LENGTH`` bytes are repeated.
3. An anchor with more than ``HOT`` different contexts, say the edge of a line that stands in a third
   of all texts, is not sorted in one place: its strings are counted by their hash, in a shuffle that
   sums before it moves rows.

Bytes are those of the text in UTF-8; matches stay within a document and within its text.  Null texts
are empty, null ids are kept, rows that repeat an id and a text are copies of each other like any other
rows, rows that share an id but not a text are separate, other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut, drop_cut
from .common import keyed, same_key

LENGTH, WINDOW = 200, 128
GRAM = LENGTH - WINDOW + 1
HOT = 500
#: Bytes hashed at a time, and bytes of contexts sorted at a time (whole anchors); sorting takes some 300 bytes a byte.
BLOCK, SHARD = 1 << 19, 1 << 18
DOC = ["__id", "__th"]


# -- rolling hashes ---------------------------------------------------------------------------------
class Hasher:
    """Hashes of any substring of a block, from running sums modulo 2**64."""

    _base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self):
        rng = np.random.default_rng(20_240_101)  # the same tables in every task
        self.tables = rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            inverse = np.uint64(pow(int(self._base), -1, 2**64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self._base))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.tables[which][data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, stop) -> np.ndarray:
        x = (sums[stop] - sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def contexts(data: np.ndarray, ends: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Contexts of a block of texts that end at ``ends``: first start, starts, anchor, its hash, the context's hash."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first, second = hasher.sums(data, 0), hasher.sums(data, 1)
    grams = n - GRAM + 1
    at = slice(0, grams)
    least = hasher.of(first, at, slice(GRAM, n + 1))
    whole = least
    where = np.arange(grams, dtype=np.int32)
    step = 1
    while step < WINDOW:  # smallest gram of 2, 4, ... WINDOW neighbours, the leftmost of equal ones
        later = least[step:] < least[:-step]
        where = np.where(later, where[step:], where[:-step])
        least = np.where(later, least[step:], least[:-step])
        step *= 2
    starts = np.arange(len(where), dtype=np.int64)
    owner = np.where(starts + LENGTH <= ends[np.searchsorted(ends, starts, side="right")], where, -1)
    turn = np.flatnonzero(np.diff(owner)) + 1
    lo = np.concatenate([[0], turn])
    hi = np.concatenate([turn, [len(owner)]])
    real = owner[lo] >= 0
    lo, hi = lo[real], hi[real]
    anchor = owner[lo].astype(np.int64)
    mark = hasher.of(second, lo, hi - 1 + LENGTH) ^ ((anchor - lo).astype(np.uint64) << np.uint64(56)) ^ (hi - lo).astype(np.uint64)
    return lo, hi - lo, anchor, whole[anchor], mark


def _blocks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Texts in blocks: bytes, ends, and per part (text, place in the block, place in the text).  Long texts are cut with overlap."""
    parts: list[bytes] = []
    told: list[tuple[int, int, int]] = []
    size = 0
    for i, raw in enumerate(texts):
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, BLOCK):
            piece = raw[at : at + BLOCK + LENGTH - 1]
            told.append((i, size, at))
            parts.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), told
                parts, told, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), told


CONTEXT = "__id {id}, __th bigint, h bigint, ctx bigint, lo bigint, n int, off int"


def find_contexts(docs: DataFrame) -> DataFrame:
    rows = keyed(docs).where(F.octet_length("__text") >= LENGTH)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for data, ends, told in _blocks(x.as_py() for x in batch.column(2).cast(pa.binary())):
                lo, n, anchor, h, ctx = contexts(data, ends, hasher)
                part = np.searchsorted(ends, lo, side="right")
                text, place, at = (np.array(x, dtype=np.int64)[part] for x in zip(*told))
                out = [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), h.view(np.int64), ctx.view(np.int64), lo - place + at, n.astype(np.int32), (anchor - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], ["__id", "__th", "h", "ctx", "lo", "n", "off"])

    return rows.mapInArrow(find, CONTEXT.format(id=rows.schema["__id"].dataType.simpleString()))


# -- suffix arrays ----------------------------------------------------------------------------------
def _named(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ranks of the substrings ``codes[start:stop]``, none of which is a proper prefix of another; equal ones share a rank."""
    padded = np.concatenate([codes, np.zeros(8, np.int64)])
    rank, todo, at = np.zeros(len(starts), np.int64), np.arange(len(starts)), starts.copy()
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for i in range(7):
            here = at[todo] + i
            key = key << 9 | np.where(here < stops[todo], padded[np.minimum(here, len(codes))] + 1, 0)
        order = np.lexsort((key, rank[todo]))
        r, k = rank[todo][order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)[group]  # ranks leave room: a group's rank is its first place
        same = np.concatenate([[True], r[1:] == r[:-1]])
        base = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        rank[todo[order]] = r + (begin - base)
        at[todo] += 7
        sizes = np.bincount(group)
        alive = (sizes[group] > 1) & (at[todo[order]] < stops[todo[order]])
        todo = todo[order][alive]
    return rank


def _ranked_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names``: pairs of neighbours, then of pairs, are named until all names differ."""
    n = len(names)
    _, rank = np.unique(names, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) - 1
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, the last of which is 0 and the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    rise = np.sign(np.diff(text.astype(np.int16)))
    turn = np.where(rise != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.ones(n, bool)  # suffixes smaller than the next one
    small[:-1] = rise[np.minimum(after, n - 2)] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    codes = text.astype(np.int64) * 2 + small
    stops = np.append(lms[1:] + 1, n)
    lms = lms[_ranked_by_doubling(_named(codes, lms, stops))]

    present = np.flatnonzero(np.bincount(text, minlength=256))
    by_char = np.split(lms[np.argsort(text[lms], kind="stable")], np.cumsum(np.bincount(text[lms], minlength=256))[:-1])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(found: np.ndarray) -> None:
        if len(found):
            chars = text[found]
            order = np.argsort(chars, kind="stable")
            found, chars = found[order], chars[order]
            edge = np.flatnonzero(np.diff(chars)) + 1
            for c, part in zip(chars[np.append(0, edge)], np.split(found, edge)):
                waiting[c].append(part)

    def bucket(c: int, smaller: bool) -> np.ndarray:
        """Suffixes of one kind that begin with ``c``, in the order in which they are met."""
        parts, front = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            front = before[(text[before] == c) & (small[before] == smaller)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def before(found: np.ndarray, c: int, smaller: bool) -> np.ndarray:
        prev = found[found > 0] - 1
        return prev[(small[prev] == smaller) & (text[prev] != c)]

    large: dict[int, np.ndarray] = {}
    for c in present:  # left to right: larger suffixes from what stands before them
        large[c] = bucket(c, False)
        deal(before(large[c], c, False))
        deal(before(by_char[c], c, False))
    tails: dict[int, np.ndarray] = {}
    for c in present[::-1]:  # right to left: smaller suffixes; they are met in falling order
        tails[c] = bucket(c, True) if c else np.array([n - 1])
        deal(before(tails[c], c, True))
        deal(before(large[c][::-1], c, True))
    return np.concatenate([x for c in present for x in (large[c], tails[c][::-1])])


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place the suffix before it in the array (-1: none) and the length of their common prefix."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    raw = np.concatenate([text, np.arange(8, dtype=np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for i in range(8):
        words[:n] |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    at = np.arange(n)
    prior = (at > 0) & (phi > 0) & (text[np.maximum(at - 1, 0)] == text[np.maximum(phi - 1, 0)])  # reducible: one less than the place before
    heads = np.flatnonzero(~prior & (phi >= 0))
    length = np.zeros(n, np.int64)
    a, b, who, done = heads.copy(), phi[heads], heads, 0
    while len(who):
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        differs = (x != 0) | (np.maximum(a, b) + 8 > n)
        low = x[differs]
        low &= ~low + np.uint64(1)
        byte = np.where(low > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8, 8).astype(np.int64)
        length[who[differs]] = np.minimum(done + byte, n - np.maximum(who[differs], phi[who[differs]]))
        a, b, who, done = a[~differs] + 8, b[~differs] + 8, who[~differs], done + 8
    head = np.maximum.accumulate(np.where(~prior, at, 0))
    return phi, np.where(phi >= 0, np.maximum(length[head] - (at - head), 0), 0)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per part the starts whose ``length`` bytes also start elsewhere in the parts."""
    # bytes of UTF-8 are at most 0xF4, so there is room for a break of 0xFF and an end of 0
    joined = np.frombuffer(b"\xfe".join(parts) + b"\xfe", np.uint8) + np.uint8(1)
    text = np.append(joined, np.uint8(0))
    order = suffix_array(text)
    phi, common = permuted_prefixes(text, order)
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    hit = np.zeros(len(text), bool)
    long = common >= length
    # a prefix that long without a break lies within one part on both sides
    room = np.zeros(len(text), bool)
    for b, s in zip(begin, sizes):
        room[b : b + max(0, s - length + 1)] = True
    long &= room
    hit[long] = True
    hit[phi[long]] = True
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin, sizes)]


# -- the jobs ---------------------------------------------------------------------------------------
def fetch_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored bytes of contexts, and for hot anchors one hash a string (``w``; ``off``: the anchor's distance)."""
    grouped = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("h", "lo", "n", "off", "unique", "hot")).alias("at"))
    body = keyed(docs)
    if not body.groupBy(*DOC).agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        body = body.dropDuplicates(DOC)
    rows = grouped.join(body, same_key(grouped, body)).select(grouped["__id"], grouped["__th"], "__text", "at")
    id_type = rows.schema["__id"].dataType.simpleString()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            for i, body in enumerate(batch.column(2).cast(pa.binary())):
                raw, asked, out = body.as_py(), batch.column(3)[i].as_py(), []
                for x in asked:
                    lo, n, piece = x["lo"], x["n"], raw[x["lo"] : x["lo"] + x["n"] - 1 + LENGTH]
                    if x["hot"]:
                        sums, s = hasher.sums(np.frombuffer(piece, np.uint8), 1), np.arange(n)
                        marks = hasher.of(sums, s, s + LENGTH).view(np.int64).tolist()
                        out += [(x["h"], lo + j, 1, x["off"] - j, x["unique"], w, None) for j, w in enumerate(marks)]
                    else:
                        out.append((x["h"], lo, n, x["off"], x["unique"], None, piece))
                ids = [pa.array([batch.column(k)[i].as_py()] * len(out), batch.schema.field(k).type) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], ["__id", "__th", "h", "lo", "n", "off", "unique", "w", "piece"])

    return cut(rows.mapInArrow(fetch, f"__id {id_type}, __th bigint, h bigint, lo bigint, n int, off int, unique boolean, w bigint, piece binary"), "pieces")


def sort_shards(pieces: DataFrame) -> DataFrame:
    """``__id, __th, s, e``: bytes covered by strings that stand in two different contexts."""
    cold = pieces.where("piece is not null").select(*DOC, "h", "lo", "unique", "piece")
    id_type = cold.schema["__id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, th, los, parts, last, size, id_kind = [], [], [], [], None, 0, None

        def solve() -> pa.RecordBatch:
            out = []
            for i, hits in enumerate(repeated_starts(parts)):
                if len(hits) and los[i] is not None:
                    edge = np.flatnonzero(np.diff(hits) > 1) + 1
                    for run in np.split(hits, edge):
                        out.append((ids[i], th[i], los[i] + int(run[0]), los[i] + int(run[-1]) + LENGTH))
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_kind, *[pa.int64()] * 3))], ["__id", "__th", "s", "e"])

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for a, b, h, lo, unique, piece in zip(*([x.as_py() for x in c] if c.type != pa.binary() else c for c in batch.columns)):
                piece = piece.as_py()
                if h != last and size >= SHARD:
                    yield solve()
                    ids, th, los, parts, size = [], [], [], [], 0
                last, size = h, size + len(piece)
                ids.append(a)
                th.append(b)
                los.append(lo if unique else None)  # a context that stands twice is known to be repeated
                parts.append(piece)
        if parts:
            yield solve()

    return cold.repartition("h").sortWithinPartitions("h").mapInArrow(find, f"__id {id_type}, __th bigint, s bigint, e bigint")


def covered_ranges(docs: DataFrame) -> DataFrame:
    """Stored ``__id, __th, runs``: merged byte ranges (s, e) that repeated strings cover, for rows that have any."""
    every = cut(find_contexts(docs), "contexts")
    often = every.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("k > 1")
    shared = cut(every.join(often.select("h", (F.col("a") != F.col("b")).alias("mixed")), "h"), "shared")
    drop_cut(every)
    kinds = cut(shared.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("__id", "__th", "lo", "n", "off")).alias("r"), F.first("mixed").alias("mixed")), "kinds")
    copies = kinds.where("k > 1").select("h", "ctx")
    whole = shared.join(copies, ["h", "ctx"], "left_semi").select(*DOC, F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("e"))
    mixed = kinds.where("mixed")
    hot = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = mixed.join(hot, "h", "left").select("h", "r.*", (F.col("k") == 1).alias("unique"), F.coalesce("hot", F.lit(False)).alias("hot"))
    pieces = fetch_bytes(docs, wanted)
    single = pieces.where("piece is null")
    twice = single.groupBy("h", "off", "w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    counted = single.where("unique").join(twice, ["h", "off", "w"], "left_semi").select(*DOC, F.col("lo").alias("s"), (F.col("lo") + LENGTH).alias("e"))
    ranges = whole.unionByName(sort_shards(pieces)).unionByName(counted).distinct()
    # ranges of one document only: as many as it has bytes at most
    runs = ranges.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ranges"))
    found = cut(runs, "ranges")
    for stored in (shared, kinds, pieces):
        drop_cut(stored)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``kept`` bytes."""
    found = covered_ranges(docs)
    body = keyed(docs)
    rows = body.join(found, same_key(body, found), "left").select(body["__id"], "__text", "ranges")
    id_type = rows.schema["__id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for body, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw, ranges = body.as_py(), found.as_py()
                merged: list[list[int]] = []
                for x in ranges or ():
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                edges = [0, *[y for m in merged for y in m], len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(remove, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
