"""License scan against all places of all templates in plain Python."""

import re
import string
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, empty

from linkloom.llm import licenses as x

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
words = lambda t: WORD.findall((t or "").translate(LOW))

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."
MORE = [
    "Released under the MIT License.", f"Some text. {APACHE}\nMore, then {GPL} MIT license", GPL.upper(), "Licensed under CC BY-NC 4.0.", "All rights reserved.",
    "the mit of all license and public apache general words with version 2 and 3", "Licensed, as agreed, under our own Apache License (Version 2.0)", "apache-license APACHE\tLICENSE apache  license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files (the 'Software')",
    "Licensed under the Apache License, Version 3", "mit licenses; mit. License!", "Lizenz é mit licenseé", "cc by nc 4 0", f"{APACHE} {APACHE} all rights reserved all rights reserved",
]


def scanner(texts):
    notices = x.templates()
    vocabulary = {w for t in notices for w in t.words}
    seen = {w: sum(w.decode() in words(t) for t in texts) for w in vocabulary}
    return x.Scanner(notices, x.idf(seen, len(texts)))


def everywhere(scan, text):
    """Hits when every diagonal of every template is verified."""
    w = [t.encode() for t in words(text)]
    at = {}
    for i, t in enumerate(w):
        at.setdefault(t, []).append(i)
    hits = []
    for k, notice in enumerate(scan.notices):
        span = range(-len(notice.words) - 3, len(w) + 3)
        hits += x._best_apart([h for d in span if (h := scan._score(k, d, at, w)) is not None])
    return sorted(hits, key=lambda h: (h[1], h[2], h[0]))


def expected(scan, doc_id, text):
    w = words(text)
    base = [(i, label) for phrase, label in x.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    hits = everywhere(scan, text)
    own = {label for _, label in base}
    return (
        doc_id, len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(own)),
        ",".join(sorted(own | {h[0] for h in hits})), max((h[3] for h in hits), default=0.0),
    )


def test_scan(spark):
    docs = awkward(spark, MORE)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    scan = scanner([t for _, t in texts])
    got = sorted(str(tuple(r)) for r in x.license_digest(x.scan_licenses(docs)).drop("hits").collect())
    assert got == sorted(str(expected(scan, i, t)) for i, t in texts)
    labels = {r.doc_id: r.labels for r in x.license_digest(x.scan_licenses(docs)).collect()}
    assert labels[100] == "mit" and labels[101] == "apache,apache-2.0,gpl,gpl-3.0,mit" and labels[102] == "gpl,gpl-3.0" and labels[103] == "cc-by-nc-4.0"
    assert labels[104] == "all-rights-reserved" and labels[105] == "" and labels[108] == "mit" and labels[109] == "apache" and labels[110] == "mit" and labels[0] == ""
    assert x.license_digest(x.scan_licenses(empty(spark))).count() == 0


VOCABULARY = "licensed under the apache license version 2 0 cc by nc 4 gnu general public all rights reserved mit released filler".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=40))
def test_no_place_is_missed(found):
    text = " ".join(found)
    scan = scanner([text, "the license of all", "under 2 0", "filler", "by"])
    assert scan.scan(text.encode())["hits"] == everywhere(scan, text)


def test_linear():
    scan = scanner(MORE)
    start = time.time()
    found = scan.scan(("all rights reserved license the " * 200_000).encode())
    assert len(found["hits"]) == 200_000 and time.time() - start < 60
