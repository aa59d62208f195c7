"""Best-fit packing of token pieces by exact-complement hashing.

Texts become ids in Arrow batches; only lengths and checksums travel on.  The plan is made from the
histogram of piece lengths (``max_len`` counters, whatever the corpus size): length sums of single
pieces, pairs and triples are indexed and used up where they fill a gap exactly, the rest goes by
best fit, many equal sequences at a time.  Each piece then finds its place from its rank among the
pieces of its length; ranks are counted within salts, so a length that a third of all pieces share
is never one task.

Null texts are empty (one id, the end mark), null and repeated ids are carried along, an empty table
gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import cut
from .common import text_column

#: Pieces of one length that are ranked together, on average.
RANK_GROUP = 200_000
RANK_BITS = 44


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``ranks`` is the same vocabulary in the form that the faster library reads; both give the same ids.
    A text that spells a special token goes to the tokenizer of ``vocabulary`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        self.vocabulary, self.tokenizer = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", ())]
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.vocabulary)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        raw = array("I", ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()


@cache
def encoder(vocabulary: str, ranks: str) -> TextEncoder:
    """Loaded once a worker."""
    return TextEncoder(vocabulary, ranks)


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str, max_len: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``n_ids`` and per piece its CRC-32 (and ids); the first piece takes the odd rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, end = encoder(vocabulary, ranks), np.array([end_id], "<u4").tobytes()
        step = 4 * max_len
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                size, to, counts, sums, ids = 0, at, [], [], []
                while to < n and size < 1_000_000:
                    text = batch.column(1)[to].as_py()
                    size, to = size + len(text), to + 1
                    body = encode_text(text) + end
                    head = len(body) % step or step
                    cuts = [body[:head], *[body[i : i + step] for i in range(head, len(body), step)]]
                    counts.append(len(body) // 4)
                    sums.append([zlib.crc32(c) for c in cuts])
                    if keep_ids:
                        ids.append([np.frombuffer(c, "<u4").tolist() for c in cuts])
                out = [batch.column(0).slice(at, to - at), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
                if keep_ids:
                    out.append(pa.array(ids, pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_ids", "crcs", "ids"][: len(out)])
                at = to

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_ids bigint, crcs array<bigint>" + ", ids array<array<bigint>>" * keep_ids
    return docs.select("doc_id", text_column().alias("text")).mapInArrow(encode, schema)


def complement_plan(counts: dict[int, int], cap: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many of them), using every counted piece once."""
    left = np.zeros(cap + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[list[int], int]] = []

    def use(lengths: list[int]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= times * k
            made.append((lengths, times))
        return times > 0

    def pairs(total: int) -> np.ndarray:
        """Larger parts of the pairs that sum to ``total`` and are both there, largest first."""
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)]

    for length in range(cap, 0, -1):
        if left[length] and length == cap:
            use([cap])
        gap = cap - length
        if left[length] and gap and left[gap]:
            use([length, gap])
        if left[length] and gap > 1:
            for a in pairs(gap):
                use([length, int(a), int(gap - a)])
                if not left[length]:
                    break
        if left[length] and gap > 2:
            for a in range(min(gap - 2, cap), 0, -1):
                if 3 * a < gap or not left[length]:
                    break
                if left[a]:
                    for b in pairs(gap - a):
                        if b <= a:
                            use([length, a, int(b), int(gap - a - b)])
                        if not left[length] or not left[a]:
                            break

    open_bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(cap + 1)]
    for length in range(cap, 0, -1):
        todo = int(left[length])
        while todo:
            gap = next((g for g in range(length, cap + 1) if open_bins[g]), None)
            if gap is None:
                per = min(cap // length, todo)
                new, todo = todo // per, todo % per
                key = (length,) * per
                room = open_bins[cap - per * length]
                room[key] = room.get(key, 0) + new
                continue
            kind, n = next(iter(open_bins[gap].items()))
            fits = gap // length
            each = min(fits, max(1, todo // n)) if todo >= n else 1
            took = min(n, todo // each)
            del open_bins[gap][kind]
            if n > took:
                open_bins[gap][kind] = n - took
            key, room = (*kind, *(length,) * each), open_bins[gap - each * length]
            room[key] = room.get(key, 0) + took
            todo -= took * each
    made += [(list(k), n) for bins in open_bins for k, n in bins.items()]
    return made


def plan_slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys; sequence of that rank; offset."""
    used: dict[int, int] = {}
    keys, first, offsets, base = [], [], [], 0
    for lengths, times in plan:
        at = 0
        for length in lengths:
            rank = used.get(length, 0)
            keys.append((length << RANK_BITS) | rank)
            first.append(base)
            offsets.append(at)
            used[length] = rank + times
            at += length
        base += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, first, offsets))


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, max_len: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Per piece its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    tokens = cut(token_pieces(docs, vocabulary or default_vocabulary(), ranks or default_ranks(), max_len, end_id, keep_ids), "tokens")
    body = [F.col("ids")] if keep_ids else []
    head = F.col("n_ids") - (F.size("crcs") - 1) * F.lit(max_len)
    pieces = tokens.select("doc_id", head.alias("head"), *body, F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("head") + (F.col("piece") - 1) * max_len).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("head")).otherwise(F.lit(max_len)).cast("long").alias("length"),
        "ids_crc32", *([F.get("ids", F.col("piece")).alias("ids")] if keep_ids else []),
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_len rows at most
    salts = max(1, -(-sum(counts.values()) // RANK_GROUP))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "__salt").count().select(
        "length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ahead")
    )
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__rank", inside - 1).join(ahead, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__ahead")).alias("__rank"))
    keys, first, offsets = plan_slots(complement_plan(counts, max_len))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            want = (batch.column("length").to_numpy() << RANK_BITS) | rank
            slot = np.searchsorted(keys, want, side="right") - 1
            out = {n: batch.column(n) for n in batch.schema.names if n != "__rank"}
            out["sequence_id"] = pa.array(first[slot] + want - keys[slot])
            out["offset"] = pa.array(offsets[slot])
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
