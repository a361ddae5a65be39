"""Operators on extracted items against plain Python: matches, audits, comparison, numbers, reports, arrivals."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import columns as C
from paperloom.operators import audit, compare, completion, evaluation, reports
from paperloom.sources import files, sinks
from paperloom.streaming import ingest


def normal(t):
    return " ".join(t.split()).lower()


def gold_rows(seed):
    draw = random.Random(seed)
    words = ["ratio", "debt", "cover", "shall", "exceed", "never"]
    found = [(d, i, " ".join(draw.choices(words, k=6)), draw.choice(["up", "down"]), draw.choice([1.0, 2.0, None]), "m") for d in range(6) for i in range(draw.randrange(9))]
    gold = [(d, i, draw.choice([" ".join(draw.choices(words, k=2)), "", "  ", "RATIO  debt"]), draw.choice(["up", "down", None]), draw.choice([1.0, 2.0000001, None]), draw.choice(["m", None])) for d in range(7) for i in range(draw.randrange(8))]
    return gold, found


@pytest.mark.parametrize("seed", range(4))
def test_gold_matches_by_brute_force(spark, seed):
    gold, found = gold_rows(seed)
    used, expected = set(), {}
    for d, i, anchor, comparison, threshold, kind in gold:
        hit = next((e for e in found if e[0] == d and (d, e[1]) not in used and normal(anchor) and normal(anchor) in normal(e[2])), None)
        if hit:
            used.add((d, hit[1]))
        near = bool(hit) and hit[4] is not None and threshold is not None and abs(hit[4] - threshold) <= 1e-6
        expected[d, i] = (hit[1] if hit else None, bool(hit), near, bool(hit) and hit[3] == comparison, bool(hit) and hit[5] == kind)
    g = spark.createDataFrame(gold, "doc_id int, gold_idx int, anchor string, comparison string, threshold double, covenant_type string")
    e = spark.createDataFrame(found, "doc_id int, ext_idx int, source_text string, comparison string, threshold double, covenant_type string")
    matches, extra = evaluation.match_gold(g, e)
    assert {(r.doc_id, r.gold_idx): (r.ext_idx, r.hit, r.threshold_correct, r.comparison_correct, r.covenant_type_correct) for r in matches.collect()} == expected
    assert {(r.doc_id, r.ext_idx) for r in extra.collect()} == {(x[0], x[1]) for x in found} - used
    (s,) = evaluation.score_gold(matches, extra).collect()
    hits = sum(v[1] for v in expected.values())
    assert (s.num_gold, s.num_hits, s.num_false_positives, s.num_extracted) == (len(gold), hits, len(found) - hits, len(found))
    assert s.precision == pytest.approx(hits / len(found)) and s.recall == pytest.approx(hits / len(gold))
    assert s.threshold_accuracy == pytest.approx(sum(v[2] and v[3] for v in expected.values()) / hits if hits else 1.0)


def test_scores_of_nothing(spark):
    gold, found = gold_rows(0)
    g = spark.createDataFrame(gold, "doc_id int, gold_idx int, anchor string, comparison string, threshold double, covenant_type string").limit(0)
    e = spark.createDataFrame(found, "doc_id int, ext_idx int, source_text string, comparison string, threshold double, covenant_type string").limit(0)
    (s,) = evaluation.score_gold(*evaluation.match_gold(g, e)).collect()
    assert (s.num_gold, s.num_extracted, s.recall, s.precision, s.threshold_accuracy, s.covenant_type_accuracy) == (0, 0, 1.0, 1.0, 1.0, 1.0)


def test_similar_pairs_by_brute_force(spark):
    draw = random.Random(3)
    names = ["Leverage Ratio", " leverage ratio ", "Total Leverage", "", "x", "Cover", "cover!", "a much longer name than the others have"]
    rows = [(i, draw.choice(names), draw.choice(names)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.score for r in audit.similar_pairs(df, "a", "b", 0.6).collect()}
    plain = {i: SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() for i, a, b in rows}
    assert got == {i: s for i, s in plain.items() if s >= 0.6}


def test_audits_by_document(spark):
    texts = {1: "The  Borrower shall keep the Leverage Ratio below 3.50 to 1.00 at all times.", 2: "", 3: None}
    quotes = ["borrower SHALL keep", "", None, "shall keep the Leverage Ration below 3.50 to 1.0O", "wholly invented words zzz", "q" * 300]
    items = [(d, i, q) for d in (1, 2, 3, 4) for i, q in enumerate(quotes)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, full_text string")
    got = {(r.doc_id, r.i): (r.citation_verified, r.citation_similarity) for r in audit.audited(spark.createDataFrame(items, "doc_id int, i int, quote string"), docs, ["i"]).collect()}
    for d, i, q in items:
        q, s = normal(q or ""), normal(texts.get(d) or "")
        ratio = 0.0
        if q and q in s:
            ratio = 1.0
        elif q:
            block = SequenceMatcher(None, s, q).find_longest_match(0, len(s), 0, len(q))
            ratio = SequenceMatcher(None, s[max(0, block.a - 10) : block.a + block.size + 10], q).ratio() if block.size else 0.0
        assert got[d, i] == (ratio >= 0.85, ratio)


def plain_baskets(a, b):
    def close(x, y):
        return x is None and y is None if x is None or y is None else y == 0 if x == 0 else abs(x - y) / abs(x) <= 0.01

    def same(p, q):
        bases = p[2] is None or q[2] is None or SequenceMatcher(None, p[2].lower(), q[2].lower()).ratio() >= 0.6
        return close(p[0], q[0]) and close(p[1], q[1]) and bases

    used, out = set(), []
    for i, p in enumerate(a):
        j = next((j for j, q in enumerate(b) if j not in used and same(p[1], q[1])), None)
        if j is not None:
            used.add(j)
            out.append((i, j))
    raws = {a[i][0] for i, _ in out}
    return out, [x[0] for x in a if x[0] not in raws], [x[0] for j, x in enumerate(b) if j not in used]


@pytest.mark.parametrize("seed", range(3))
def test_exceptions_by_brute_force(spark, seed):
    draw = random.Random(seed)
    shapes = [("up to $5 million", (5e6, None, None)), ("$5,020,000 in all", (5.02e6, None, None)), ("2.5% of Total Assets", (None, 2.5, "Total Assets")), ("2.51% of Totals Asset, once", (None, 2.51, "Totals Asset")),
              ("2.5% of Net Income.", (None, 2.5, "Net Income")), ("none", (None, None, None)), ("greater of $5 million and 2.5%", (5e6, 2.5, None)), ("$0", (0.0, None, None))]
    a, b = draw.choices(shapes, k=9), draw.choices(shapes, k=8)
    frames = [spark.createDataFrame([(1, i, x[0]) for i, x in enumerate(side)], "k int, idx int, raw string") for side in (a, b)]
    matched, only_a, only_b = compare.match_exceptions(*frames, ["k"])
    pairs, left_a, left_b = plain_baskets(a, b)
    assert sorted((r.a, r.b) for r in matched.collect()) == pairs
    assert sorted(r.raw for r in only_a.collect()) == sorted(left_a) and sorted(r.raw for r in only_b.collect()) == sorted(left_b)


def test_restrictions_and_summaries(spark):
    a = spark.createDataFrame([(1, 0, "Liens", "No liens at all", ["$1", "$2"]), (1, 1, "Other", None, None)], "doc_id int, item_idx int, name string, summary string, exceptions array<string>")
    b = spark.createDataFrame([(1, 0, "Lien", "no liens", ["$2", "$9"]), (2, 0, "Far", "x", [])], "doc_id int, item_idx int, name string, summary string, exceptions array<string>")
    (r,) = compare.restrictions(a, b).collect()
    assert (r.a, r.b, r.exception_match_rate, r.exceptions_only_in_a, r.exceptions_only_in_b) == (0, 0, 0.5, ["$1"], ["$9"])
    assert r.summary_similarity == round(SequenceMatcher(None, "no liens at all", "no liens").ratio(), 3)
    got = {r.doc_id: (r.matched_count, r.only_in_a, r.only_in_b, r.jaccard_overlap) for r in compare.overlap(a, b).collect()}
    assert got == {1: (1, ["Other"], [], 0.5), 2: (0, [], ["Far"], 0.0)}
    assert [r.line for r in compare.summary_lines(compare.overlap(a, b)).orderBy("doc_id").collect()][0] == 'Matched: 1  Only in A: ["Other"]  Only in B: []'


def test_numbers_print_like_c(spark):
    draw = random.Random(1)
    values = [0.0, 1.0, -1.0, 3.5, 4.25, 0.5, 1e6, 999999.5, 9999995.0, 12345675.0, 262.1885, 1.005, 2.675, 0.125, 0.375, 1e-4, 1.5e-5, 123456.5, 1234565.0, 1e7, -4750000.0, 1e15, 2.5e22, 1 / 3, 0.1 + 0.2]
    values += [draw.randrange(10**9) / 10 ** draw.randrange(9) for _ in range(3000)] + [draw.uniform(-1, 1) * 10 ** draw.randrange(-8, 12) for _ in range(2000)]
    values += [(draw.randrange(10**6) * 10 + 5) / 10 ** draw.randrange(8) for _ in range(3000)]  # ties in print
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", C.shortest(F.col("v")).alias("g"), C.two_decimals(F.col("v")).alias("f"), C.two_decimals(F.col("v"), grouped=True).alias("c")).collect():
        assert r.g == f"{r.v:g}".replace("-0", "0", 1 if r.v == 0 else 0), r.v
        assert abs(r.v) >= 4.5e13 or (r.f, r.c) == (f"{r.v:.2f}", f"{r.v:,.2f}"), r.v
    assert spark.createDataFrame([(None,)], "v double").select(C.shortest(F.col("v"))).first()[0] is None


RESULT = {
    "financial_covenants": [
        {"name": "A & B", "comparison": "not_to_exceed", "threshold": 3.5, "unit": "ratio", "test_frequency": "quarterly", "covenant_type": "maintenance", "citation": {"source_text": "to exceed <3.50>", "page": 4},
         "audit": {"citation_verified": False, "citation_similarity": 0.4, "calculator_checked": True, "calculator_match": True, "citation_grounded": False}, "definition": "the ratio",
         "resolved_definition": {"term": "A & B", "formula": "x < y", "status": "resolved", "carve_outs": ["excluding z"], "components": {"C": {"term": "C", "formula": "", "status": "requires_human_review", "reason": "unresolved_reference", "components": {}, "carve_outs": []}}}}
    ],
    "ebitda_addbacks": [],
    "negative_covenants": [{"name": "Liens", "summary": "none", "exceptions": ["$5"], "citation": {"source_text": "no liens", "section_label": "Section 7"}, "audit": {"citation_verified": True, "citation_similarity": 1.0}}],
    "loan_terms": {"borrowers": [{"value": f"Borrower number {i}", "citation": {"source_text": "b"}} for i in range(9)], "lenders": [], "loan_type": None, "end_date": {"value": "Final Date", "citation": {"source_text": "e"}, "resolved_value": {"formula": "2030"}}},
}


def test_reports(spark, tmp_path):
    texts = [("first doc", json.dumps(RESULT)), ("second", "{}"), ("third", json.dumps({"loan_terms": {}}))]
    results = sinks.opened(spark.createDataFrame(texts, "doc_id string, json string"))
    pages = {r.doc_id: r.html for r in reports.document_pages(results).collect()}
    first = pages["first doc"]
    for piece in ("A &amp; B", "to exceed &lt;3.50&gt;", "page 4", "x &lt; y", "<strong>C:</strong>", "requires review: unresolved_reference", "excluding z", "threshold NOT found in citation", "Section 7", "<li>$5</li>", "Borrower number 8"):
        assert piece in first, piece
    assert "No EBITDA add-backs extracted." in first and "not stated" in pages["second"]
    sinks.write_pieces(reports.combined_report(results), str(tmp_path / "report"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>")
    assert "3 documents, 1 covenants, 1 unverified" in page
    for piece in ('href="#detail-first-doc-0"', 'id="detail-first-doc-0"', "Borrower: Borrower number 0 +8 more", "Other borrowers: Borrower number 1; Borrower number 2", "<li>second</li>", "threshold not in citation", "not to exceed", "Maturity: 2030"):
        assert piece in page, piece
    assert page.index("For review") < page.index("<table") < page.index("All parties") < page.index("Without loan terms") < page.index("Details")
    scores = spark.createDataFrame([("d", 1.0)], "doc_id string, recall double")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    sinks.write_comparison({"rates": scores}, str(tmp_path / "compared"))
    assert spark.read.json(str(tmp_path / "compared" / "rates")).first().recall == 1.0


def test_json_results_in_order_of_names(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"financial_covenants": [], "loan_terms": None} if name == "b" else RESULT, indent=2))
    got = files.json_results(spark, str(tmp_path), schemas.EXPORTED).collect()
    assert [r.file_name for r in got] == ["a.json", "b.json", "c.json"]
    assert got[1].negative_covenants == [] and got[0].negative_covenants[0].name == "Liens"


def test_arrivals_are_processed_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    page = "<h1>Agreement</h1><p>Section 6.1 Cover. The Leverage Ratio shall not exceed 3.50 to 1.00 at any time whatever.</p>"
    (tmp_path / "in" / "one.html").write_text(page)

    def run():
        ingest.extract_arrivals(spark, folder, out, checkpoint, completion.PatternBackend(), once=True).awaitTermination()
        rows = spark.read.parquet(f"{out}/*").collect()
        return {r.doc_id: (r.arrived, len(json.loads(r.json)["financial_covenants"])) for r in rows}

    assert run() == {"one.html": (0, 1)}
    (tmp_path / "in" / "two.htm").write_text(page)
    assert run() == {"one.html": (0, 1), "two.htm": (1, 1)}
