"""Line frequencies of op4: long lines, every size of host, copies."""

from paperloom.llm import quality

LICENCE = " ".join(f"clause{i} of the licence" for i in range(20))


def own_text(i, lines=9):
    return "\n".join(f"document {i} has sentence {k} about thing {i * k}" for k in range(lines))


def kept_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    return got


def test_long_lines_are_counted(spark):
    rows = [(i, f"{LICENCE}\n{own_text(i, 20)}", "a") for i in range(20)] + [(50, LICENCE, "a"), (51, f"{LICENCE}\nand some more", "a"), (52, LICENCE, "b")]
    got = kept_of(spark, rows)
    assert [got[i].lost_words for i in (0, 50, 51, 52)] == [80, 80, 80, 0]
    assert {i for i, r in got.items() if not r.kept} == {50, 51}


def test_one_of_a_group_of_near_copies_stays(spark):
    passages = "\n".join(f"{k} " + " ".join(f"passage{k}x{j}" for j in range(40)) for k in range(4))
    rows = [(i, f"{passages}\ncopy number {i}", "a") for i in range(3, 30)] + [(i, own_text(i), "a") for i in range(40, 45)]
    got = kept_of(spark, rows)
    assert {i for i, r in got.items() if r.kept} == {3, *range(40, 45)}


def test_same_lines_same_verdict_in_a_larger_host(spark):
    menu = "\n".join(f"menu entry {k} leads to the other pages" for k in range(6))
    rows = [(i, f"{menu}\n{own_text(i, 2 if i < 5 else 12)}", "a") for i in range(20)]
    more = [(i, own_text(i, 3), "a") for i in range(100, 25_100)]
    few, many = kept_of(spark, rows), kept_of(spark, rows + more)
    assert [i for i, r in few.items() if not r.kept] == [i for i in range(5)]
    assert all(few[i] == many[i] for i in few)
    assert all(many[i].kept for i, _, _ in more)


def test_copies_count_as_documents(spark):
    rows = [(i, f"{own_text(0)}\nline of text {i % 2}", "a") for i in range(4, 24)] + [(1, own_text(1), "a"), (2, own_text(0), "a"), (4, f"{own_text(0)}\nline of text 0", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.docs for r in quality.frequent_lines(quality.document_lines(docs)).collect()} == {21}
    assert {i for i, r in kept_of(spark, rows).items() if r.kept} == {1, 2}


def test_clean_texts_drop_boilerplate_lines(spark):
    rows = [(i, f"{LICENCE}\n{own_text(i)}\n\nlast {i}", "a") for i in range(12)] + [(20, LICENCE, "a"), (21, LICENCE, None), (22, None, "a")]
    got = {r.doc_id: r.clean_text for r in quality.clean_texts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: f"{own_text(i)}\n\nlast {i}" for i in range(12)} | {20: "", 21: LICENCE, 22: None}
