from pyspark.sql import functions as F

from paperloom.functions import columns as C
from paperloom.operators import audit, definitions, layout, retrieval
from paperloom.sources.files import elements


def test_chunks_equal_a_plain_loop(spark):
    blocks = {1: [3, 50, 5], 2: [10, 10, 10, 10], 3: [40], 4: [39, 1, 60, 1]}
    rows = [(d, i, "x" * n) for d, ns in blocks.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id int, block_idx int, text string")
    expected = []
    for d, ns in blocks.items():
        kept, k = [], 0
        for i, n in enumerate(ns):
            kept.append("x" * n)
            if len("\n".join(kept)) >= 40 or i == len(ns) - 1:
                expected.append((d, k, "\n".join(kept)))
                kept, k = [], k + 1
    assert sorted((r.doc_id, r.chunk_idx, r.text) for r in layout.chunk_blocks(df).collect()) == expected
    assert layout.chunk_blocks(df.limit(0)).count() == 0


def test_elements():
    page = "<h1>ARTICLE 4.</h1><div>lone</div><div><p>one<p>two</div><table><tr><td>a</td><td>&nbsp;</td><td>b</td></tr></table><script>x</script>"
    assert elements(page) == [("heading", "ARTICLE 4."), ("text", "lone"), ("text", "one"), ("text", "two"), ("table", "a | b")]
    assert elements(None) == [] and elements("") == [] and elements(b"<p>\x93x</p>") == [("text", "�x")]


def test_thresholds(spark):
    texts = ["ratio shall not exceed 3.50:1.00", "not less than $10,000,000 at all times", "about $5", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(C.comparison_of("t").alias("c"), C.threshold_of("t").alias("v")).collect()
    assert [(r.c, r.v) for r in got] == [("not_to_exceed", 3.5), ("not_less_than", 1e7), (None, None), (None, None), (None, None)]


def test_definitions_in_both_numbers_and_quotes(spark):
    text = '“Lender” means X. "Guarantor Subsidiaries for any period, means\n the  parents. "Last Thing" shall mean it'
    df = spark.createDataFrame([("Lenders",), ("Guarantor Subsidiary",), ("last things",), ("None",)], "t string")
    got = [r.d for r in df.select(definitions.find_definition(F.col("t"), F.lit(text)).alias("d")).collect()]
    assert got == ["X.", "the parents.", "it", None]


def test_order_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "a", None)], "doc_id int, parent string, child string")
    got = sorted((r.place, r.term, r.on_cycle) for r in definitions.resolution_order(edges).collect())
    assert got == [(0, "c", True), (1, "b", False), (2, "a", False)]


def test_audit(spark):
    source = "The Borrower shall not permit the Leverage Ratio to exceed 3.50 to 1.00 at any time."
    quotes = ["the  borrower SHALL not", "", None, "wholly invented words zzz", "shall not permit the Leverage Ration to exceed 3.50", "The Borrower shall not permit the Leverage Ratio to exceed 3.5O"]
    df = spark.createDataFrame([(i, q, source) for i, q in enumerate(quotes)], "i int, quote string, source string")
    got = {r.i: r.citation_verified for r in audit.audit_citations(df).collect()}
    # By hand: the fourth has 90 of 106 characters in common with its window, the fifth at least 122 of 134.
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_tiers_take_free_chunks_only(spark):
    rows = [(1, 0, "Maturity Date and per annum"), (1, 1, "base rate"), (1, 2, "scheduled maturity"), (2, 0, "nothing")]
    df = spark.createDataFrame(rows, "d int, c int, text string")
    got = sorted((r.attribute, r.tier, r.c) for r in retrieval.tiered_first_match(df, "d", "c").collect())
    assert got == [("interest_rate", 1, 0), ("maturity", 1, 2)]
