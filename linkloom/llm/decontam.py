"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (document, position) for every corpus token whose term stands in a benchmark
item.  It is partitioned like the documents, so building it moves no text: the terms of the benchmark
are stored first, and Spark broadcasts them only if their stored size allows it.  A window of an item
is looked up from its rarest terms: the posting lists of its ``PROBES`` rarest terms are adjusted by
their offset in the item and intersected, which leaves almost only true places; these are then read
word for word in the text.

Null texts have no words and match nothing.  Rows with the same id and text give equal results, rows
that share an id but not a text are judged apart, null ids are kept.  A null item id counts as one item
named by the empty string.  An empty table on either side gives no hits.  Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import cut
from .common import keyed, let, same_key, sized

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, PROBES = 10, 3
DOC = ["__id", "__th"]


def words(text: Column) -> Column:
    """A-Z lowered, then the runs of digits, letters and characters beyond ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))

    def inner(w: Column) -> Column:  # a break at either end leaves an empty string there
        first, last = (w[0] == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))

    return let(F.split(lowered, BREAK, -1), inner)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Stored ``item, key, terms`` of the items that have words; equal items once."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    return cut(named.where(F.size("terms") > 0).distinct().withColumn("key", F.xxhash64("item", "terms")), "items")


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stored postings ``__id, __th, pos, term`` of all documents for the terms of the items."""
    terms = cut(items.select(F.explode("terms").alias("term")).distinct(), "terms")
    found = keyed(docs).select(*DOC, F.posexplode(words(F.col("__text"))).alias("pos", "term"))
    return cut(found.join(terms, "term", "left_semi").select(*DOC, "pos", "term"), "postings")


def probes(items: DataFrame, index: DataFrame, window: int = WINDOW, n_probes: int = PROBES) -> DataFrame:
    """Stored ``item, key, w, n, terms``'s rarest: one row per window and probe (``p``: place in the item, ``term``, ``rank``)."""
    seen = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = items.select("key", F.size("terms").alias("size"), F.posexplode("terms").alias("p", "term"))
    counted = placed.join(seen, "term", "left")
    first = F.greatest(F.col("p") - (window - 1), F.lit(0))
    last = F.least(F.col("p"), F.greatest(F.col("size") - window, F.lit(0)))
    windows = counted.select("key", "p", "term", "df", F.explode(F.sequence(first, last)).alias("w"))
    by_window = Window.partitionBy("key", "w")
    ranked = windows.select(
        "key", "w", "p", "term", F.min(F.coalesce("df", F.lit(0))).over(by_window).alias("least"), F.count(F.lit(1)).over(by_window).cast("int").alias("n"),
        F.row_number().over(by_window.orderBy("df", "p")).alias("rank"),
    )
    return cut(ranked.where((F.col("least") > 0) & (F.col("rank") <= n_probes)).select("key", "w", "n", "p", "term", "rank"), "probes")


def aligned(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``key, __id, __th, diagonal``: places where all probes of a window stand at their offsets.

    A diagonal is the position in the document of the item's first word.
    """
    places = asked.select("key", "p", "term").distinct()
    lists = index.join(places, "term").select("key", *DOC, (F.col("pos") - F.col("p")).alias("diagonal"), "p")
    met = lists.groupBy("key", *DOC, "diagonal").agg(F.collect_set("p").alias("met"))
    needed = asked.groupBy("key", "w").agg(F.collect_list("p").alias("need")).groupBy("key").agg(F.collect_set("need").alias("windows"))
    whole = met.join(needed, "key").where(F.exists("windows", lambda need: F.size(F.array_except(need, F.col("met"))) == 0))
    return whole.select("key", *DOC, "diagonal")


def phrase_hits(docs: DataFrame, items: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``__id, __th, item, start, length``: runs of document words inside occurrences of windows."""
    sized = places.join(items.select("key", F.size("terms").alias("size")), "key")
    by_doc = cut(sized.groupBy(*DOC).agg(F.collect_list(F.struct("key", "diagonal", "size")).alias("at")), "candidates")
    body = keyed(docs).distinct()
    with_words = body.join(by_doc, same_key(body, by_doc)).select(body["__id"], body["__th"], "at", words(body["__text"]).alias("words"))
    # only the words that an item could cover travel on: from the diagonal, or the start of the text if that lies behind it
    skip = lambda a: F.greatest(-a["diagonal"], F.lit(0))
    own = lambda a: F.slice("words", a["diagonal"] + skip(a) + 1, F.greatest(a["size"] - skip(a), F.lit(0)))
    cuts = F.transform("at", lambda a: F.struct(a["key"].alias("key"), a["diagonal"].alias("diagonal"), skip(a).alias("skip"), own(a).alias("own")))
    near = with_words.select(*DOC, F.explode(cuts).alias("a")).select(*DOC, "a.*").join(items, "key")
    equal = F.transform("terms", lambda t, p: F.coalesce(F.get("own", p - F.col("skip")) == t, F.lit(False)) & (p >= F.col("skip")))
    need = F.least(F.size("terms"), F.lit(window))
    # ends of runs of equal words that are long enough
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, ok: Column) -> Column:
        run = F.when(ok, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.concat(acc["out"], F.array(run)).alias("out"))

    runs = F.aggregate("equal", start, step, lambda acc: acc["out"])
    ends = F.filter(F.transform("runs", lambda n, p: F.struct(p.alias("p"), n.alias("n"), F.coalesce(F.get("runs", p + 1), F.lit(0)).alias("after"))), lambda x: (x["n"] >= F.col("need")) & (x["after"] == 0))
    told = near.select(*DOC, "item", "diagonal", need.alias("need"), equal.alias("equal")).select(*DOC, "item", "diagonal", "need", runs.alias("runs"))
    hits = told.select(*DOC, "item", "diagonal", F.explode(ends).alias("e"))
    return hits.select(*DOC, "item", (F.col("diagonal") + F.col("e.p") - F.col("e.n") + 1).alias("start"), F.col("e.n").alias("length"))


def proximity_hits(asked: DataFrame, items: DataFrame, index: DataFrame, slack: int = 5, n_probes: int = PROBES) -> DataFrame:
    """``__id, __th, item``: all probes of a window stand within ``slack`` words of their offsets from its rarest term."""
    lists = index.join(asked, "term").select("key", "w", *DOC, (F.col("pos") - F.col("p")).alias("diagonal"), "rank", F.least("n", F.lit(n_probes)).alias("want"))
    rarest = lists.where("rank = 1").select("key", "w", *DOC, F.col("diagonal").alias("at"), "want").alias("r")
    others = lists.select("key", "w", F.col("__id").alias("__id2"), F.col("__th").alias("__th2"), "diagonal", "rank").alias("o")
    same = (F.col("r.key") == F.col("o.key")) & (F.col("r.w") == F.col("o.w")) & F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2"))
    near = rarest.join(others, same & (F.abs(F.col("at") - F.col("diagonal")) <= slack))
    full = near.groupBy("r.key", "r.w", *DOC, "at", "want").agg(F.count_distinct("rank").alias("got")).where("got = want")
    return full.select("key", *DOC).distinct().join(items.select("key", "item"), "key").select(*DOC, "item").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored runs of hit words (see :func:`phrase_hits`)."""
    items = benchmark_items(benchmark)
    index = build_index(docs, items)
    asked = probes(items, index, window)
    return cut(phrase_hits(docs, items, aligned(asked, index), window), "hits")


def hit_counts(hits: DataFrame) -> DataFrame:
    """Per document the words hit, and its items."""
    covered = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))

    def step(acc: Column, r: Column) -> Column:
        end = r["start"] + r["length"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(r["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], end).alias("to"))

    total = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])
    return covered.select(*DOC, total.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = cut(hit_counts(find_contamination(docs, benchmark, window)), "hit_counts")
    sizes = keyed(docs).select(*DOC, F.size(words(F.col("__text"))).cast("long").alias("n_words"))
    rows = sizes.join(found, same_key(sizes, found), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        sizes["__id"].alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any hit, columns as they were."""
    bad = sized(cut(find_contamination(docs, benchmark, window).select(*DOC).distinct(), "contaminated"))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (text == bad["__th"]), "left_anti").select(*[docs[c] for c in docs.columns])
