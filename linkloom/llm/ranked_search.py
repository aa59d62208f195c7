"""Ranked lexical search over blocks of documents with range-maximum tables.

Each document becomes one short row: its number of terms and the counts of the terms that the queries ask for
(texts are read once a block of queries and do not travel).  N, L and the document frequencies are counted over all
rows, map-side first.  A task then takes its stored rows in blocks.  The posting lists of a block lie one after the
other, ordered by term and document, and a sparse table over them answers "place of the largest impact between two
postings" in two looks.  An item starts with the interval of all documents of the block; the summed range maxima of
its terms bound every score in an interval.  The interval of the highest bound is opened first: the document that
holds its largest impact is scored, and what lies left and right of it are new intervals.  An interval of few
postings is scored as a whole.  The search of an item ends when no bound reaches its k-th best score; that score is
carried over all blocks of a task.  A task gives at most k rows an item, so the last ranking is small.

Scores are whole numbers of 64 bits; a score that does not fit raises an error.

Rows are documents: repeated rows count each and rank beside each other, also under one id; a null id ranks last
among equal scores.  Null texts, and texts without terms, are no documents (not in N and L) and are never returned.
Equal queries (same id and text) are one query; queries that share an id but not a text are ranked apart; a null
query id is kept.  Empty tables on either side give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .common import byte_words, text_column

#: Text of the queries that one pass over the documents takes, in bytes; more queries make more passes.
QUERY_BYTES = 8 << 20
#: Postings of a block (bounds the tables of a task), and of an interval that is scored as a whole.
BLOCK_POSTINGS, LEAF_POSTINGS = 1 << 18, 1 << 10
#: Parts of the length rule ``BASE - SLOPE + SLOPE * n / average n``, in hundredths of the full weight.
BASE, SLOPE = 100, 90
_LATE = float("inf")


def query_blocks(items: DataFrame) -> list[DataFrame]:
    """Stored distinct ``item_id, text``, split by hash into parts of some ``QUERY_BYTES`` of text."""
    named = cut(items.select(F.col("item_id").alias("item_id"), text_column().alias("text")).distinct(), "queries")
    total = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / QUERY_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [named.where(part == i) for i in range(parts)] if parts > 1 else [named]


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """``doc, n, terms, tfs``: one row per document that has terms, with the counts of those in ``vocabulary``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.__contains__
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc, body in zip(batch.column(0), batch.column(1)):
                found = byte_words(body.as_py())
                if found:
                    own = Counter(filter(known, found))
                    ids.append(doc.as_py())
                    sizes.append(len(found))
                    terms.extend(map(vocabulary.__getitem__, own))
                    tfs.extend(own.values())
                    ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.encode(text_column(), "UTF-8").alias("body"))
    return rows.mapInArrow(count, "doc bigint, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class Block:
    """Posting lists of some documents: ``keys`` are term * size + place, ascending; ``best`` the sparse table."""

    ids: list
    keys: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    best: np.ndarray

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.ids)
        return np.searchsorted(self.keys, terms * size), np.searchsorted(self.keys, (terms + 1) * size)

    def tops(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the leftmost largest impacts of the ranges ``lo .. hi - 1``, none of them empty."""
        level = _log2(hi - lo)
        left, right = self.best[level, lo], self.best[level, hi - (1 << level)]
        return np.where(self.impacts[left] >= self.impacts[right], left, right)


def _log2(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


def build_block(ids: list, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs_total: int, terms_total: int) -> Block:
    """The index of some rows of :func:`term_counts`; ``ends`` are the offsets of their lists."""
    order = sorted(range(len(ids)), key=lambda i: (_LATE if ids[i] is None else ids[i]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    counts = np.diff(ends)
    if SLOPE * int(sizes.max(initial=0)) * docs_total >= 1 << 63:
        raise OverflowError("a document's length times the number of documents is beyond 64 bits")
    m = (BASE - SLOPE) + (SLOPE * sizes * docs_total) // max(terms_total, 1)
    impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts)))
    docs = np.repeat(place, counts)
    keys = terms.astype(np.int64) * len(ids) + docs
    by_key = np.argsort(keys, kind="stable")
    keys, docs, impacts = keys[by_key], docs[by_key], impacts[by_key]
    longest = int(np.bincount(terms).max(initial=1))
    best = np.empty((longest.bit_length(), len(keys)), np.int32)
    if len(keys):
        best[0] = np.arange(len(keys))
    for k in range(1, len(best)):
        half = 1 << (k - 1)
        best[k] = best[k - 1]
        left, right = best[k - 1, :-half], best[k - 1, half:]
        best[k, :-half] = np.where(impacts[left] >= impacts[right], left, right)
    return Block([ids[i] for i in order], keys, docs, impacts, best)


class Top:
    """The best ``k`` (score, id) pairs: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, score: int, doc) -> None:
        if score > 0:
            insort(self.rows, (-score, _LATE if doc is None else doc))
            del self.rows[self.k :]

    def beats(self, bound: int, first_doc) -> bool:
        """Whether nothing of score ``bound`` or less and id ``first_doc`` or more can enter."""
        return bound <= 0 or len(self.rows) == self.k and (-bound, _LATE if first_doc is None else first_doc) >= self.rows[-1]


def search(block: Block, terms: np.ndarray, top: Top, leaf: int = LEAF_POSTINGS) -> None:
    """Put the documents of ``block`` that belong there into ``top``."""
    size = len(block.ids)
    lo, hi = block.lists(terms)
    heap: list = []
    turn = itertools.count()

    def push(terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        open_ = hi > lo
        if not open_.any():
            return
        terms, lo, hi = terms[open_], lo[open_], hi[open_]
        tops = block.tops(lo, hi)
        most = block.impacts[tops]
        bound, first = int(most.sum()), int(block.docs[lo].min())
        if not top.beats(bound, block.ids[first]):
            heapq.heappush(heap, (-bound, first, next(turn), terms, lo, hi, int(tops[most.argmax()])))

    push(terms, lo, hi)
    while heap:
        negative, first, _, terms, lo, hi, summit = heapq.heappop(heap)
        if top.beats(-negative, block.ids[first]):
            break
        lengths = hi - lo
        n = int(lengths.sum())
        if n <= leaf:
            ends = np.cumsum(lengths)
            at = np.arange(n) + np.repeat(lo - (ends - lengths), lengths)
            docs, inverse = np.unique(block.docs[at], return_inverse=True)
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, inverse, block.impacts[at])
            low = -top.rows[-1][0] if len(top.rows) == top.k else 1
            for i in np.flatnonzero(scores >= low).tolist():
                top.add(int(scores[i]), block.ids[int(docs[i])])
            continue
        doc = int(block.docs[summit])
        wanted = terms * size + doc
        middle = np.searchsorted(block.keys, wanted)
        here = (middle < hi) & (block.keys[np.minimum(middle, len(block.keys) - 1)] == wanted)
        top.add(int(block.impacts[middle[here]].sum()), block.ids[doc])
        push(terms, lo, middle)
        push(terms, middle + here, hi)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch in blocks of at most ``BLOCK_POSTINGS`` postings (or one row)."""
    ids, sizes = batch.column(0).to_pylist(), np.asarray(batch.column(1))
    lists, counts = batch.column(2), batch.column(3)
    ends, terms, tfs = np.asarray(lists.offsets), np.asarray(lists.values), np.asarray(counts.values)
    start = 0
    while start < len(ids):
        stop = int(np.searchsorted(ends, ends[start] + BLOCK_POSTINGS, "right")) - 1
        stop = min(max(stop, start + 1), len(ids))
        a, b = int(ends[start]), int(ends[stop])
        yield ids[start:stop], sizes[start:stop], ends[start : stop + 1] - a, terms[a:b], tfs[a:b]
        start = stop


def _search_part(docs: DataFrame, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    rows = queries.collect()  # at most some QUERY_BYTES of text, or one query
    vocabulary: dict[bytes, int] = {}
    asked = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in byte_words(r["text"].encode())}), np.int64) for r in rows]
    counted = cut(term_counts(docs, vocabulary, id_col), "terms")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = dict.fromkeys(range(len(vocabulary)), 0)
    df |= {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    docs_total, terms_total = total["docs"], total["terms"] or 0
    weights = np.array([math.floor(1000 * math.log((2 * docs_total + 2) / (2 * df[t] + 1))) for t in range(len(vocabulary))], np.int64)
    if sum(1_000_000 * int(w) for w in weights) >= 1 << 63:
        raise OverflowError("scores of so many terms may not fit in 64 bits")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in asked]
        for batch in batches:
            for part in _slices(batch):
                block = build_block(*part, weights, docs_total, terms_total)
                for terms, top in zip(asked, tops):
                    search(block, terms, top)
        out = [(q, None if doc == _LATE else doc, -score) for q, top in enumerate(tops) for score, doc in top.rows]
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "score"])

    found = counted.mapInArrow(best, "q int, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    item_type = queries.schema["item_id"].dataType.simpleString()
    names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"q int, item_id {item_type}")
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(names, "q").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0 only."""
    parts = [_search_part(docs, block, k, id_col) for block in query_blocks(items)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
