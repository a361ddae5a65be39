"""The whole job over small contracts with a canned backend, and its steps."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import completion, extraction, formulas, layout, retrieval
from paperloom.plans.documents import extract_documents
from paperloom.sources import files, sinks

PAGE = """<html><body><h1>LOAN AGREEMENT</h1><p>This agreement is made on 3 March 2021 between Birch Holdings LLC ("Borrower") and First Hill Bank, N.A., as lender.</p>
<h2>SECTION 1. DEFINITIONS</h2>
<p>"Total Leverage Ratio" means the ratio of Consolidated Debt to Consolidated Earnings, excluding leases of office space.</p>
<p>"Consolidated Debt" means all debt of the Borrower for money.</p>
<p>"Final Date" means 3 March 2026, the last day of the term as agreed.</p>
<h2>SECTION 6. FINANCIAL COVENANTS</h2>
<p>Section 6.1 Leverage Ratio. The Borrower shall not permit the Total Leverage Ratio to exceed 3.50:1.00 at any time.</p>
<p>Section 6.2 Minimum Liquidity. The Borrower shall keep Consolidated Liquidity of not less than $10,000,000 at all times.</p>
<table><tr><td>Grid</td><td>1</td></tr></table>
<p>The loans fall due on the Maturity Date, which is the Final Date, as the parties have agreed among them.</p></body></html>"""


def citation(text):
    return {"source_text": text, "page": 99, "section_label": "made up"}


def covenant(name, comparison, threshold, unit, text, kind="maintenance"):
    return {"name": name, "comparison": comparison, "threshold": threshold, "unit": unit, "test_frequency": None, "covenant_type": kind, "citation": citation(text)}


LEVERAGE = covenant("Total Leverage Ratio", "not_to_exceed", 3.5, "ratio", "shall not permit the Total Leverage Ratio to exceed 3.50:1.00")
LIQUIDITY = covenant("Minimum Liquidity", "not_less_than", 12000000, "USD", "Consolidated Liquidity of not less than $10,000,000")
RULES = [
    ("to exceed 3.50", "result", json.dumps({"financial_covenants": [LEVERAGE, {**LEVERAGE, "name": "Again"}]})),
    ("Consolidated Liquidity", "result", json.dumps({"financial_covenants": [LIQUIDITY], "negative_covenants": [{"name": "Liens", "summary": "none", "citation": citation("words that nobody wrote here")}]})),
    ("Birch Holdings", "loan_terms", json.dumps({"borrowers": [{"value": "Birch Holdings LLC", "citation": citation("between Birch Holdings LLC")}, {"value": "BIRCH  Holdings LLC", "citation": citation("Birch")}]})),
    ("Maturity Date", "loan_terms", json.dumps({"end_date": {"value": "the Final Date", "citation": citation("which is the Final Date")}})),
    ("all debt of the Borrower", "fragment", '{"formula": "Debt for Money"}'),
    ("Components:", "fragment", '{"formula": "(Debt for Money) / Earnings"}'),
    ("3 March 2026", "fragment", '{"formula": "2026-03-03"}'),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("contracts")
    (path / "birch.html").write_text(PAGE, encoding="utf-8")
    (path / "empty.HTM").write_text("<p>Nothing of interest in this short paper, none.</p>", encoding="utf-8")
    (path / "scan.pdf").write_bytes(make_pdf(["First page about the Leverage Ratio \\(see\\) below", "", "Third (last) page"]))
    return path


def make_pdf(pages, deflate=False):
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, text in enumerate(pages):
        body = b"BT /F1 12 Tf 72 720 Td (%s) Tj ET" % text.encode("latin-1") if text else b""
        if deflate:
            body = zlib.compress(body)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << >> /Contents %d 0 R >>" % (4 + 2 * i))
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if deflate else b"", body))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_blocks_of_files(spark, folder):
    rows = sorted(files.load_documents(spark, str(folder)).collect(), key=lambda r: (r.doc_id, r.block_idx))
    birch = [r for r in rows if r.doc_id == "birch.html"]
    assert [r.section_label for r in birch] == ["LOAN AGREEMENT"] * 2 + ["SECTION 1. DEFINITIONS"] * 4 + ["SECTION 6. FINANCIAL COVENANTS", "Section 6.1", "Section 6.2", "Section 6.2"]
    assert birch[8].text.endswith("at all times.\nGrid | 1")
    full = "\n".join(r.text for r in birch)
    assert all(full[r.start_char : r.end_char] == r.text for r in birch)
    assert [(r.page, r.text) for r in rows if r.doc_id == "scan.pdf"] == [(1, "First page about the Leverage Ratio (see) below"), (3, "Third (last) page")]
    assert {r.doc_id: r.full_text for r in layout.full_texts(files.load_documents(spark, str(folder))).collect()}["birch.html"] == full


def test_deflated_pdf():
    from paperloom.sources import pdf

    assert pdf._plain(make_pdf(["one", "two"], deflate=True)) == ["one", "two"]
    with pytest.raises(ValueError, match="not a PDF"):
        pdf._plain(b"text")


def test_unknown_suffix(spark, folder, tmp_path):
    (tmp_path / "contract.txt").write_text("x")
    with pytest.raises(Exception, match="unsupported file type: .txt"):
        files.load_documents(spark, str(tmp_path)).collect()


def test_whole_job(spark, folder, tmp_path):
    backend = completion.CannedBackend(RULES)
    cache = str(tmp_path / "cache")
    results = extract_documents(files.load_documents(spark, str(folder)), backend, cache=cache)
    got = {r.doc_id: json.loads(r.json) for r in results.collect()}
    assert sorted(got) == ["birch.html", "empty.HTM", "scan.pdf"]
    assert got["empty.HTM"] == {"financial_covenants": [], "ebitda_addbacks": [], "negative_covenants": [], "loan_terms": {"borrowers": [], "lenders": [], **dict.fromkeys(["loan_type", "loan_amount", "interest_rate", "start_date", "end_date", "principal_repayment_terms"])}}
    birch = got["birch.html"]
    leverage = next(c for c in birch["financial_covenants"] if c["name"] == "Total Leverage Ratio")
    liquidity = next(c for c in birch["financial_covenants"] if c["name"] == "Minimum Liquidity")
    assert len(birch["financial_covenants"]) == 2
    assert leverage["citation"] == {"source_text": LEVERAGE["citation"]["source_text"], "page": None, "section_label": "SECTION 6. FINANCIAL COVENANTS"}  # the short heading joins the clause
    assert leverage["audit"] == {"citation_verified": True, "citation_similarity": 1.0, "calculator_checked": True, "calculator_match": True, "citation_grounded": True, "recomputed_threshold": 3.5, "recomputed_comparison": "not_to_exceed"}
    assert leverage["definition"] == "the ratio of Consolidated Debt to Consolidated Earnings, excluding leases of office space."
    tree = leverage["resolved_definition"]
    assert (tree["formula"], tree["status"], tree["carve_outs"]) == ("(Debt for Money) / Earnings", "resolved", ["excluding leases of office space."])
    assert tree["components"]["Consolidated Debt"]["formula"] == "Debt for Money"
    assert tree["components"]["Consolidated Earnings"]["reason"] == "term_not_found_in_definitions_section"
    assert (liquidity["audit"]["calculator_match"], liquidity["audit"]["citation_grounded"], liquidity["audit"]["recomputed_threshold"]) == (False, False, 1e7)
    assert liquidity["definition"] is None and "resolved_definition" not in liquidity
    assert birch["negative_covenants"][0]["audit"]["citation_verified"] is False and "calculator_checked" not in birch["negative_covenants"][0]["audit"]
    terms = birch["loan_terms"]
    assert [b["value"] for b in terms["borrowers"]] == ["Birch Holdings LLC"]
    assert terms["end_date"]["resolved_value"]["formula"] == "2026-03-03" and terms["loan_type"] is None

    class Silent:
        name = backend.name

        def complete(self, system, user, kind):
            raise AssertionError("asked again")

    again = extract_documents(files.load_documents(spark, str(folder)), Silent(), cache=cache)
    assert {r.doc_id: json.loads(r.json) for r in again.collect()} == got

    sinks.write_json(results, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    sinks.write_json(results, str(tmp_path / "files"), pretty=True, by_document=True)
    assert json.loads((next((tmp_path / "files" / "doc_id=birch.html").glob("*.txt"))).read_text()) == birch
    new = spark.createDataFrame([("birch.html", '{"borrowers": []}')], "doc_id string, json string")
    sinks.merge_key(results, new, "loan_terms", str(tmp_path / "merged"))
    merged = {r.doc_id: json.loads(r.json) for r in spark.read.parquet(str(tmp_path / "merged")).collect()}
    assert merged == {**got, "birch.html": {**birch, "loan_terms": {"borrowers": []}}}
    typed = {r.doc_id: r for r in sinks.opened(results).collect()}
    assert json.loads(typed["birch.html"].financial_covenants[0].resolved_definition)["term"] == "Total Leverage Ratio"


def test_faulty_answers_are_set_aside(spark):
    good = json.dumps(covenant("a", "not_to_exceed", 1.0, "ratio", "q"))
    bad = {
        "enum": '{"financial_covenants": [%s]}' % good.replace("not_to_exceed", "above"),
        "missing": '{"financial_covenants": [%s]}' % good.replace('"name": "a", ', ""),
        "quote": '{"ebitda_addbacks": [{"name": "x", "citation": {}}]}',
        "broken": '{"financial_covenants": [',
        "number": '{"financial_covenants": [%s]}' % good.replace("1.0", '"many"'),
        "list": "[]",
        "null": None,
    }
    fine = {"whole": '{"financial_covenants": [%s]}' % good, "empty": "{}", "more": '{"other": 1}'}
    rows = spark.createDataFrame(list((bad | fine).items()), "k string, response string")
    got = {r.k: r for r in schemas.parsed(rows, "result").collect()}
    assert all(got[k].fault and got[k].value is None for k in bad)
    assert all(got[k].fault is None and got[k].value is not None for k in fine)
    assert "unknown comparison above" in got["enum"].fault and "no name" in got["missing"].fault
    assert got["empty"].value.financial_covenants == []


def test_failing_calls_and_repeated_prompts(spark, tmp_path):
    class Counting:
        name = "counting"

        def complete(self, system, user, kind):
            with open(tmp_path / "asked", "a") as f:
                f.write("x")
            if "bad" in user:
                raise OSError("no answer")
            return '{"formula": "f"}'

    prompts = spark.createDataFrame([(i, "s", "bad" if i % 4 == 0 else f"user {i % 2}") for i in range(12)], "doc_id int, system string, user string").repartition(5)
    cache = str(tmp_path / "cache")
    got = completion.completed(prompts, Counting(), "fragment", cache).collect()
    assert len((tmp_path / "asked").read_text()) == 3
    assert {(r.value and r.value.formula, r.fault) for r in got if r.doc_id % 4 == 0} == {(None, "OSError: no answer")}
    assert {(r.value.formula, r.fault) for r in got if r.doc_id % 4} == {("f", None)}
    completion.completed(prompts, Counting(), "fragment", cache).collect()
    assert len((tmp_path / "asked").read_text()) == 4  # only the failed one again


def test_loan_terms_merge_in_order(spark):
    def cited(v):
        return (v, ("q", None, None))

    rows = [
        (1, 2, ([cited("B two"), cited("b  ONE")], [], None, cited("late"), None, None, None, None)),
        (1, 1, ([cited("B one")], [cited("L")], None, None, cited("5%"), None, None, None)),
        (2, 1, ([], [], None, None, None, None, None, None)),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, ord int, terms {schemas.LOAN_TERMS}")
    got = {r.doc_id: r.loan_terms for r in extraction.merged_terms(df).collect()}
    assert [x.value for x in got[1].borrowers] == ["B one", "B two"] and [x.value for x in got[1].lenders] == ["L"]
    assert (got[1].loan_amount.value, got[1].interest_rate.value, got[1].loan_type) == ("late", "5%", None)
    assert got[2].borrowers == [] and got[2].end_date is None


def test_preamble_then_attributes(spark):
    texts = ["x" * 2000, "y" * 1500, "Maturity Date " + "z" * 50, "interest rate per annum", "the scheduled maturity", "Applicable Margin table"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, chunk_idx int, text string")
    got = [(r.chunk_idx, r.attribute) for r in retrieval.preamble_and_attributes(df).orderBy("ord").collect()]
    assert got == [(0, None), (1, None), (5, "interest_rate"), (2, "maturity")]
    assert retrieval.preamble_and_attributes(df.limit(0)).count() == 0


def test_dense_and_lexical_embedders(spark):
    texts = ["the leverage ratio shall not exceed", "a park with old trees", "", "leverage ratio", "the birds of the north"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, chunk_idx int, text string")
    for embedder in (retrieval.DenseEmbedder(retrieval.hashed_words()), retrieval.TfidfEmbedder()):
        got = retrieval.select_candidates(df, embedder, ("leverage ratio exceed limits",), keywords=("birds",), floor=0.2, k=3).orderBy("rank").collect()
        assert [r.chunk_idx for r in got][0] == 4 and {r.chunk_idx for r in got[1:]} == {0, 3}
        assert all(r.score == r.embedding_score + r.keyword_match for r in got)
    assert retrieval.select_candidates(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="sentence_transformers"):
        retrieval.sentence_model("m")()


def test_formulas_with_cross_references(spark):
    text = 'The pricing grid says "Margin" means the grid rate. And more text.'
    docs = spark.createDataFrame([(1, text)], "doc_id int, full_text string")
    definition = 'the sum of Base and what follows; "Consolidated Margin" has the meaning set forth in Section 2.1, provided that fees are out'
    nodes = [(1, "Top", "Top", definition, "Section 1"), (1, "Top", "Base", "ten", None), (1, "Lost", "Lost", definition.replace("Margin", "Nowhere"), None), (1, "Lost", "Base", "ten", None)]
    edges = [(1, "Top", "Top", "Base"), (1, "Lost", "Lost", "Base")]
    rules = [("ten", "fragment", '{"formula": "10"}'), ("grid rate", "fragment", '{"formula": "10 + grid"}'), ("grid rate", "term", '{"term": "Margin", "definition_text": "the grid rate"}')]
    rules = [rules[2], ("grid rate", "fragment", '{"formula": "10 + grid"}'), rules[0]]
    got = {(r.root, r.term): r for r in formulas.resolve_formulas(
        spark.createDataFrame(nodes, "doc_id int, root string, term string, definition string, source_clause string"),
        spark.createDataFrame(edges, "doc_id int, root string, parent string, child string"), docs, completion.CannedBackend(rules)).collect()}
    top, lost = got["Top", "Top"], got["Lost", "Lost"]
    assert (top.formula, top.status, top.provenance, top.carve_outs) == ("10 + grid", "resolved", ["Section 1"], ["provided that fees are out"])
    assert (lost.formula, lost.status, lost.reason) == ("", "requires_human_review", "unresolved_reference")
    assert json.loads(lost.json)["components"]["Base"]["formula"] == "10"
    assert got["Top", "Base"].formula == "10"


def test_bulk_resolution_with_a_cycle(spark):
    text = '"Alpha Sum" means Beta Part plus one. "Beta Part" means Gamma Part and Alpha Sum. "Gamma Part" means three.'
    chunks = spark.createDataFrame([(1, 0, text, "Definitions")], "doc_id int, chunk_idx int, text string, section_label string")

    class Echo:
        name = "echo"

        def complete(self, system, user, kind):
            body = user.split('"""')[1].strip()
            if kind == "term":
                term, rest = body.split('" means ')
                return json.dumps({"term": term.strip('"'), "definition_text": rest})
            parts = [line.split(" = ")[1] for line in user.splitlines() if line.startswith('- "')]
            return json.dumps({"formula": f"[{body}|{','.join(parts)}]"})

    docs = spark.createDataFrame([(1, text)], "doc_id int, full_text string")
    roots = spark.createDataFrame([(1, "Alpha Sum"), (1, "Unknown Term")], "doc_id int, root string")
    got, cycles = formulas.resolve_in_full(roots, chunks, docs, Echo())
    assert [r.terms for r in cycles.collect()] == [["Alpha Sum", "Beta Part", "Alpha Sum"]]
    rows = {(r.root, r.term): r for r in got.collect()}
    assert rows["Alpha Sum", "Alpha Sum"].formula == "[Beta Part plus one.|[Gamma Part and Alpha Sum.|[three.|]]]"
    assert rows["Unknown Term", "Unknown Term"].reason == "term_not_found_in_definitions_section"
    assert formulas.extract_defined_terms(chunks, Echo()).select(F.max("place")).first()[0] == 2


def test_chat_and_hosted_backends(monkeypatch):
    sent = []

    def fake(url, body, headers, timeout):
        sent.append((url, body, headers))
        if "messages" in url:
            return {"content": [{"type": "text"}, {"type": "tool_use", "input": {"formula": "x"}}]}
        return {"choices": [{"message": {"content": '{"formula": "x"}'}}]}

    monkeypatch.setattr(completion, "_post", fake)
    monkeypatch.setenv("LLM_API_KEY", "k")
    assert completion.ChatServer("http://h/v1", "m").complete("s", "u", "fragment") == '{"formula": "x"}'
    assert json.loads(completion.HostedModel("http://h/v1", "m").complete("s", "u", "result")) == {"formula": "x"}
    assert sent[0][1]["temperature"] == 0 and sent[1][1]["max_tokens"] == 4096 and sent[1][2]["x-api-key"] == "k"
    schema = sent[1][1]["tools"][0]["input_schema"]["properties"]["financial_covenants"]["items"]
    assert schema["properties"]["comparison"]["enum"] == ["not_to_exceed", "not_less_than"] and "threshold" in schema["required"]
