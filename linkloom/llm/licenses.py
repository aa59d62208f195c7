"""License scan with a positional index of rare license words.

The words of some license notices (``TEMPLATES``) make a small inverted index: word to places in templates.  A first
pass over all texts counts in how many rows each of these words stands (summed by Spark, one row a word), which
gives the words' IDF.  The second pass reads each text once.  For every template that the text holds enough words of,
its words with the highest IDF are looked up; their places in the text less their places in the template are diagonals,
and where two of them meet (within ``SLACK`` words to either side, so that words may be put in or left out) is a place
to verify.  There every word of the template is looked for at its place within the same slack; the share of the
template's IDF weight found is the score of the place.  It is a hit if the score reaches ``LEAST`` and all mandatory
phrases of the template stand word for word within the place.  As many rare words are looked up as it takes for no hit
to be missed.  Overlapping places of a template keep the best.

Beside that the base phrases are counted wherever their words stand consecutively.  Labels are those of the base and
of the hits, the score of a row is the best score of its hits (0 without any).

Null and empty texts have no words, no labels and score 0.  Rows are judged one by one, so repeated rows and ids give
equal results and null ids are kept.  The counts of an empty table are zero.  A text is worked through in time and
memory linear in its length.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, text_column

# The phrases of the base scan and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, notice, mandatory phrases; wording of the public license notices.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered"]),
    ("cc0-1.0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["attribution 4 0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Words by which a word may be shifted to either side, and least share of the weight.
SLACK, LEAST = 2, 0.6


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[list[bytes]]

    @property
    def places(self) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.words):
            out.setdefault(w, []).append(i)
        return out


def templates(rows=None) -> list[Template]:
    return [Template(label, byte_words(notice.encode()), [byte_words(p.encode()) for p in phrases]) for label, notice, phrases in rows or TEMPLATES]


def word_rows(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many rows each word of ``vocabulary`` stands, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            total += len(batch)
            for body in batch.column(0).to_pylist():
                for w in vocabulary.intersection(byte_words(body)):
                    seen[w] += 1
        names = [w.decode() for w in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names + [None], pa.string()), pa.array([*seen.values(), total], pa.int64())], ["word", "n"])

    rows = docs.select(F.encode(text_column(), "UTF-8").alias("body")).mapInArrow(count, "word string, n bigint")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w.decode(), 0) for w in vocabulary}, found.get(None, 0)


def idf(seen: dict[bytes, int], total: int) -> dict[bytes, float]:
    """Weight of each word; above 0 also if it stands everywhere."""
    return {w: math.log((total + 2) / (n + 1)) for w, n in seen.items()}


class Scanner:
    """The index of the templates, and the scan of one text."""

    def __init__(self, notices: list[Template], weights: dict[bytes, float], base=None):
        self.notices, self.weights = notices, weights
        self.base = [(byte_words(p.encode()), label) for p, label in base or BASE]
        self.totals = [sum(weights[w] for w in t.words) for t in notices]
        self.places = [t.places for t in notices]
        self.anchors = [self._rarest(k) for k in range(len(notices))]
        self.known = set(weights) | {w for p, _ in self.base for w in p}

    def _rarest(self, k: int) -> tuple[list[bytes], int]:
        """The words of template ``k`` to look up, highest IDF first, and how many of them every hit holds.

        A hit may miss words of a share of up to ``1 - LEAST`` of the weight.  Words are taken until those left after the
        heaviest weigh more than that: then every hit holds two of them.  Where all words do not suffice, one must do.
        """
        heavy = {w: self.weights[w] * len(p) for w, p in self.places[k].items()}
        taken: list[bytes] = []
        for w in sorted(heavy, key=lambda w: (-self.weights[w], w)):
            taken.append(w)
            if sum(heavy[t] for t in taken) - max(heavy[t] for t in taken) > (1 - LEAST) * self.totals[k] + 1e-9:
                return taken, 2
        return taken, 1

    def scan(self, text: bytes) -> dict:
        """``n_words``, ``base`` (starts and labels of the base phrases) and ``hits`` (label, start, end, score; in words)."""
        words = byte_words(text)
        at: dict[bytes, list[int]] = {}
        known = self.known.__contains__
        for i, w in enumerate(words):
            if known(w):
                at.setdefault(w, []).append(i)
        base = [(i, label) for phrase, label in self.base for i in _phrase_places(phrase, at, words)]
        hits = []
        for k, notice in enumerate(self.notices):
            # no place can score more than the template's words that the text has at all
            if sum(self.weights[w] for w in notice.words if w in at) >= LEAST * self.totals[k]:
                hits += self._located(k, at, words)
        return {"n_words": len(words), "base": base, "hits": sorted(hits, key=lambda h: (h[1], h[2], h[0]))}

    def _located(self, k: int, at: dict, words: list[bytes]) -> list[tuple]:
        notice, (anchors, need) = self.notices[k], self.anchors[k]
        votes = sorted((i - p, w) for w in anchors if w in at for p in self.places[k][w] for i in at[w])
        diagonals: set[int] = set()
        for j, (diagonal, anchor) in enumerate(votes):
            met, n = {anchor}, j + 1
            while len(met) < need and n < len(votes) and votes[n][0] <= diagonal + 2 * SLACK:
                met.add(votes[n][1])
                n += 1
            if len(met) >= need:
                diagonals.update(range(diagonal - SLACK, diagonal + SLACK + 1))
        return _best_apart([hit for d in diagonals if (hit := self._score(k, d, at, words)) is not None])

    def _score(self, k: int, diagonal: int, at: dict, words: list[bytes]) -> tuple | None:
        """The hit of template ``k`` with its first word at place ``diagonal`` of the text, if it is one."""
        notice, total = self.notices[k], self.totals[k]
        weight, first, last = 0.0, None, None
        for p, w in enumerate(notice.words):
            i = _nearest(at.get(w, ()), diagonal + p)
            if i is not None:
                weight += self.weights[w]
                first = i if first is None else min(first, i)
                last = i if last is None else max(last, i)
        if first is None or weight < LEAST * total:
            return None
        for phrase in notice.phrases:
            if not any(words[i : i + len(phrase)] == phrase for i in range(first, last + 2 - len(phrase))):
                return None
        return notice.label, first, last + 1, min(weight / total, 1.0)


def _phrase_places(phrase: list[bytes], at: dict, words: list[bytes]) -> list[int]:
    """Starts of ``phrase``, looked up from its rarest word in the text."""
    lists = [at.get(w) for w in phrase]
    if not all(lists):
        return []
    p = min(range(len(phrase)), key=lambda k: len(lists[k]))
    return [i - p for i in lists[p] if i >= p and words[i - p : i - p + len(phrase)] == phrase]


def _nearest(places, wanted: int) -> int | None:
    """The place of least distance, at most ``SLACK``; the earlier one of two."""
    k = bisect_left(places, wanted)
    near = [i for i in places[max(k - 1, 0) : k + 1] if abs(i - wanted) <= SLACK]
    return min(near, key=lambda i: (abs(i - wanted), i)) if near else None


def _best_apart(hits: list[tuple]) -> list[tuple]:
    """Of hits that overlap in a chain, the one of the highest score, the first among equals."""
    out: list[tuple] = []
    reach = -1
    for hit in sorted(hits, key=lambda h: (h[1], h[2])):
        if out and hit[1] < reach:
            out[-1] = max(out[-1], hit, key=lambda h: (h[3], -h[1]))
        else:
            out.append(hit)
        reach = max(reach, hit[2])
    return out


def scan_licenses(docs: DataFrame, rows=None, id_col: str = "doc_id") -> DataFrame:
    """Per row ``doc_id, n_words, base`` (start, label) and ``hits`` (label, start, end, score)."""
    notices = templates(rows)
    seen, total = word_rows(docs, {w for t in notices for w in t.words})
    scanner = Scanner(notices, idf(seen, total))
    id_type = docs.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    hit_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(body) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([[{"start": i, "label": x} for i, x in f["base"]] for f in found], base_type),
                    pa.array([[dict(zip(("label", "start", "end", "score"), h)) for h in f["hits"]] for f in found], hit_type),
                ],
                ["doc_id", "n_words", "base", "hits"],
            )

    rows_ = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_column(), "UTF-8").alias("body"))
    return rows_.mapInArrow(scan, f"doc_id {id_type}, n_words bigint, base array<struct<start:bigint,label:string>>, hits array<struct<label:string,start:bigint,end:bigint,score:double>>")


def license_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits`` of scanned rows."""
    base = F.transform("base", lambda b: b["label"])
    own = F.transform("hits", lambda h: h["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"), "hits",
    )
