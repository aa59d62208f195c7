"""Hits against plain Python over all windows and documents."""

import hashlib
import re
import string

from rows import awkward, empty

from linkloom.llm import decontam as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
words = lambda t: WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item) if item is not None else "")
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append(str((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


LONG_ITEM = " ".join(f"alpha{i % 19} beta{i}" for i in range(20))
ITEMS = [
    (1, LONG_ITEM), (2, "Short Item, five words here"), (3, "one"), (4, None), (5, "...!"), (6, "the the the the the the the the the the the the"),
    (7, "Émile École fait le beau temps dans une ville où il pleut"), (7, "second text of seven stands alone"), (1, LONG_ITEM), (None, "nobody owns this one"), (10, "w5 x5 w6 x6 w7 x7 w8 x8 w9 x9 w10 x10"),
]
MORE = [
    "before " + LONG_ITEM.upper() + " after", " ".join(LONG_ITEM.split()[3:13]) + " and " + " ".join(LONG_ITEM.split()[20:29]),
    "short-item five;words\nhere short item five words her", "THE " * 30, "x émile École fait le beau temps dans une ville où il y pleut", "nobody owns this one nobody owns this one",
    " ".join(LONG_ITEM.split()[:10]) + " filler " + " ".join(LONG_ITEM.split()[30:40]), "second text of seven stands alone!", "beta3 alpha4",
]


def test_hits(spark):
    docs = awkward(spark, MORE)
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    got = sorted(str(tuple(r)) for r in d.contamination(docs, bench).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    clean = [x for x in got if x.endswith("False)")]
    assert left.count() == len(clean) < docs.count()


def test_proximity(spark):
    docs = awkward(spark, ["zeta1 eta2 theta3 iota4 kappa5", "zeta1 and eta2 theta3 or iota4 kappa5", "zeta1 " + "far " * 40 + "eta2 theta3 iota4 kappa5"])
    items = d.benchmark_items(spark.createDataFrame([(1, "zeta1 eta2 theta3 iota4 kappa5")], "item_id int, text string"))
    index = d.build_index(docs, items)
    asked = d.probes(items, index, n_probes=5)
    assert {r["__id"] for r in d.proximity_hits(asked, items, index, slack=3, n_probes=5).collect()} == {100, 101}
    assert {r["__id"] for r in d.aligned(asked, index).collect()} == {100}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert d.contamination(empty(spark), some).count() == 0
    assert d.contamination(awkward(spark), none).where("contaminated").count() == 0
    assert d.drop_contaminated(awkward(spark), none).count() == awkward(spark).count()
