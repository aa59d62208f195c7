"""Counts against plain Python, and rules learned from labelled rows."""

import re
from collections import Counter

from rows import awkward, empty

from linkloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


MORE = ["a a a a", "x y z x y z", "p q r s p q", "l1 a\nl1 a\n l1 a\n\n\n", " word still one", "b\x0bc\x0cd\re", "😀 é #tag", "1 2 3 4 1 2 3 9 2 3 4 " * 30]


def test_counts(spark):
    docs = awkward(spark, MORE)
    got = sorted(map(str, (tuple(r)[:7] for r in q.judge(docs, []).collect())))
    assert got == sorted(str((d.doc_id, *brute(d.text))) for d in docs.collect())


def test_rules_reject_what_labels_reject(spark):
    good = [" ".join(f"word{(i * 7 + j * j) % 501}" for j in range(60 + i % 40)) for i in range(150)]
    bad = [" ".join(f"WORD{(i * 7 + j * j) % 501}!!" for j in range(60 + i % 40)) for i in range(60)]
    bad += [" ".join(f"word{(i * 7 + j * j) % 501}&&&" for j in range(60 + i % 40)) for i in range(60)]
    docs = awkward(spark, good + bad)
    labels = spark.createDataFrame([(100 + i, int(i < 150), 0) for i in range(270)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    rules = q.learn_rules(q.labelled_sample(docs, labels))
    kept = {r.doc_id: r.kept for r in q.judge(docs, rules).where("doc_id >= 100").collect()}
    assert 1 <= len(rules) <= q.MAX_RULES
    assert sum(kept[100 + i] == (i < 150) for i in range(270)) >= 266
    stay = q.keep_good(docs, rules)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect() if (r.doc_id or 0) >= 100} == {k for k, v in kept.items() if v}


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = empty(spark)
    assert q.learn_rules(q.labelled_sample(docs, labels)) == []
    assert q.judge(docs, []).count() == 0 and q.keep_good(docs, []).count() == 0
