"""TF-IDF: items with several rows, terms beyond a broadcast, and no lists gathered for each item."""

import math
import re
from collections import Counter

from paperloom.operators import retrieval

ROWS = [("a", 1, "debt debt cover x"), ("a", 1, "Cover ratio"), ("a", 2, "debt ratio İratio_9"), ("a", 3, None), ("b", 1, "debt"), ("b", 2, "rare debt words rare")]


def plain():
    tf = {}
    for g, i, t in ROWS:
        tf.setdefault((g, i), Counter()).update(re.findall(r"[a-z0-9_]{2,}", (t or "").lower()))
    out = {}
    for (g, i), own in tf.items():
        n = sum(k[0] == g for k in tf)
        w = {t: c * (math.log((1 + n) / (1 + sum(t in x for k, x in tf.items() if k[0] == g))) + 1) for t, c in own.items()}
        out |= {(g, i, t): round(v / math.sqrt(sum(x * x for x in w.values())), 9) for t, v in w.items()}
    return out


def test_weights_with_few_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(ROWS, "source string, doc_id int, text string")
    for most in (10**6, 2):
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", most)
        got = retrieval.tfidf(items, "source", "doc_id")
        assert {(r.source, r.doc_id, r.term): round(r.weight, 9) for r in got.collect()} == plain()
        assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
