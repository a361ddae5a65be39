"""Queries of the operators on extracted items: prompts, answers, formulas, audits, comparison, reports, sinks.

Texts and results are rendered from the columns of the driver's tables, in several shapes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..plans.documents import extract_documents
from ..plans.stage import materialize
from ..session import table
from ..sources import sinks
from . import audit, catalogue, compare, completion, definitions, extraction, formulas, layout, prompts, reports, retrieval
from .catalogue import RE2_WHITE, first_unused_sql, query

# Text shapes: SQL that both engines read; {x} stands for a money amount in the engine's own function.


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}", "FROM {" + name + "}"), **{name: table(spark, sf_dir, name)})


@query(rf"""SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (line <> ''), '')) AS digest FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents) GROUP BY doc_id HAVING count(*) FILTER (line <> '') > 0""")
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a document joined in order."""
    texts = layout.full_texts(layout.blocks_from_lines(table(spark, sf_dir, "documents")))
    return texts.select("doc_id", F.md5("full_text").alias("digest"))


@query(f"""WITH c AS ({catalogue.DEFINED}) SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_idx) AS definitions_text FROM c
WHERE text LIKE '"%' OR (doc_id, section_label) IN (SELECT (doc_id, section_label) FROM c WHERE text LIKE '"%') GROUP BY doc_id""")
def definitions_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.definitions_text(_sql(spark, sf_dir, catalogue.DEFINED, "customer"))


DECLARED = """SELECT c_custkey, concat('Preface ', c_mktsegment, '. "', c_name, '" means one, provided that fees are out', chr(10), '"Lower term" shall mean two, excluding (a) all', chr(10), ' "curly" is not one. "Last ', c_mktsegment, '" means three') AS t FROM customer"""


@query("""SELECT c_custkey, unnest(range(4))::INTEGER AS place, unnest(['Preface ' || c_mktsegment || '.', '"' || c_name || '" means one, provided that fees are out',
  '"Lower term" shall mean two, excluding (a) all' || chr(10) || ' "curly" is not one.', '"Last ' || c_mktsegment || '" means three']) AS piece FROM customer""")
def split_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, DECLARED, "customer")
    return rows.select("c_custkey", F.posexplode(definitions.split_by_terms("t")).alias("place", "piece")).withColumn("piece", definitions.stripped(F.col("piece")))


@query("""SELECT c_custkey, 'provided that fees are out | excluding (a) all' AS carve_outs FROM customer""")
def carve_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, DECLARED, "customer")
    return rows.select("c_custkey", F.array_join(C.carve_outs("t"), " | ").alias("carve_outs"))


#: Terms, texts with an inline declaration of them, of their shorter form, of neither, and cross references.
INLINE = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('Consolidated ', c_mktsegment) WHEN 1 THEN concat('Applicable ', c_mktsegment) ELSE c_mktsegment END AS term,
  concat('As said, the rate is open. ', CASE WHEN c_custkey % 5 = 0 THEN concat('"', c_mktsegment, '" is a word') ELSE concat('"', c_mktsegment, '" means, the margin of ', c_name) END, '. Then it ends') AS t,
  CASE WHEN c_custkey % 3 = 0 THEN concat('"', c_mktsegment, ' Sum" has the meaning set forth in Section ', cast(c_nationkey AS {s}), '.01(a)') WHEN c_custkey % 3 = 1 THEN 'it has a meaning' ELSE concat('x "Other', '" has the meaning specified in Section 2') END AS definition FROM customer"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 > 1 THEN '"' || c_mktsegment || '" means, the margin of ' || c_name || '.' END AS inline_text,
CASE WHEN c_custkey % 5 <> 0 THEN '"' || c_mktsegment || '" means, the margin of ' || c_name || '.' END AS scoped_text,
CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' Sum' WHEN 2 THEN 'Other' END AS reference, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN c_mktsegment || ' Sum' WHEN c_custkey % 3 = 2 THEN 'Other' END AS unresolved FROM customer""")
def scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations anywhere in a text, also under the shorter form of a term; cross references that no child covers."""
    rows = _sql(spark, sf_dir, INLINE.format(s="string"), "customer")
    term, text = F.col("term"), F.col("t")
    children = F.when(F.expr("c_custkey % 2 = 0"), F.array(F.concat("c_mktsegment", F.lit(" Sum")))).otherwise(F.array().cast("array<string>"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return rows.select("c_custkey", definitions.inline_definition(term, text).alias("inline_text"), definitions.scoped_definition(term, text).alias("scoped_text"), definitions.cross_reference("definition").alias("reference"), definitions.unresolved_reference("definition", children).alias("unresolved"))


VALUES = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('the Other Words or the Final ', c_mktsegment, ' Date then') WHEN 1 THEN '12.5% of the Final Date' WHEN 2 THEN 'no capital words' ELSE 'An Unknown Phrase' END AS v,
  concat('"Other Thing" means x. "Final ', c_mktsegment, ' Dates" means a day') AS d, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('Section ', c_mktsegment) END AS clause FROM customer"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Final ' || c_mktsegment || ' Date' END AS resolvable, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Section ' || c_mktsegment END AS provenance FROM customer""")
def resolvable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that only name a defined term; source clauses as lists."""
    rows = _sql(spark, sf_dir, VALUES, "customer")
    return rows.select("c_custkey", definitions.resolvable_term(F.col("v"), F.col("d")).alias("resolvable"), F.array_join(definitions.provenance("clause"), ",").alias("provenance"))


#: Five terms a region, each defined by the two after it, the first of them the root.
CHAIN = """SELECT n_regionkey AS doc_id, concat('Nation ', name) AS term, concat('the sum of Nation ', lead(name, 1, 'x') OVER w, ' and of Nation ', lead(name, 2, 'x') OVER w, ', and more') AS definition,
  row_number() OVER w - 1 AS pos FROM (SELECT *, translate(n_name, '0123456789_ ', 'abcdefghijkl') AS name FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = materialize(_sql(spark, sf_dir, CHAIN, "nation"), "chain")
    declared = F.concat(F.lit('"'), "term", F.lit('" means '), "definition", F.lit(". "))
    texts = terms.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", declared.alias("t")))), lambda x: x["t"]), "").alias("definitions_text"))
    return terms.where("pos = 0").select("doc_id", F.col("term").alias("root")), texts


@query(f"""WITH c AS ({CHAIN}) SELECT n.doc_id, r.term AS root, n.term, CASE WHEN n.pos = 0 THEN 0 WHEN n.pos <= 2 THEN 1 ELSE 2 END AS depth, CASE WHEN n.pos < 4 THEN n.definition || '.' END AS definition,
CASE n.pos WHEN 1 THEN r.term WHEN 2 THEN r.term WHEN 3 THEN b.term WHEN 4 THEN d.term END AS parent
FROM c n JOIN c r ON r.doc_id = n.doc_id AND r.pos = 0 JOIN c b ON b.doc_id = n.doc_id AND b.pos = 1 JOIN c d ON d.doc_id = n.doc_id AND d.pos = 2 WHERE n.pos <= 4""")
def discovered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first from the root, two steps, at most four definitions: the fifth term is named but not looked up."""
    roots, texts = _chain(spark, sf_dir)
    nodes, edges = definitions.discover_terms(roots, texts, max_terms=4)
    up = edges.select("doc_id", "root", F.col("child").alias("term"), "parent")
    return nodes.join(up, ["doc_id", "root", "term"], "left").select("doc_id", "root", "term", "depth", "definition", "parent")


def _leaf_sql(definition: str) -> str:
    return f"""substr(sha256('Turn this definition into a formula:' || chr(10) || '\"\"\"' || chr(10) || {definition} || chr(10) || '\"\"\"'), 1, 12)"""


def _compose_sql(definition: str, parts: list[tuple[str, str]]) -> str:
    lines = " || chr(10) || ".join(f"""'- "' || {t} || '" = ' || {f}""" for t, f in parts)
    return f"""substr(sha256('Definition:' || chr(10) || '\"\"\"' || chr(10) || {definition} || chr(10) || '\"\"\"' || chr(10) || chr(10) || 'Components:' || chr(10) || {lines}), 1, 12)"""


@query(
    f"""WITH c AS ({CHAIN}), w AS (SELECT c0.doc_id, {", ".join(f"c{i}.term AS t{i}, c{i}.definition || '.' AS d{i}" for i in range(5))} FROM c c0 {" ".join(f"JOIN c c{i} ON c{i}.doc_id = c0.doc_id AND c{i}.pos = {i}" for i in range(1, 5))} WHERE c0.pos = 0),
l AS (SELECT *, {_leaf_sql("d3")} AS f3, {_leaf_sql("d4")} AS f4 FROM w), m AS (SELECT *, {_compose_sql("d1", [("t3", "f3")])} AS f1, {_compose_sql("d2", [("t4", "f4")])} AS f2 FROM l),
r AS (SELECT *, CASE WHEN t1 < t2 THEN {_compose_sql("d0", [("t1", "f1"), ("t2", "f2")])} ELSE {_compose_sql("d0", [("t2", "f2"), ("t1", "f1")])} END AS f0 FROM m)
{" UNION ALL ".join(f"SELECT doc_id, t{i} AS term, f{i} AS formula, 'resolved' AS status, CASE {i} WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n_components FROM r" for i in range(5))}"""
)
def resolved_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas from the leaves up, each a hash of its prompt, which holds the formulas below it."""
    roots, texts = _chain(spark, sf_dir)
    found = formulas.resolve_bounded(roots, texts, texts.withColumnRenamed("definitions_text", "full_text"), completion.DigestBackend())
    return found.select("doc_id", "term", "formula", "status", F.size("components").alias("n_components"))


#: Clauses with and without a covenant; within an order date's clauses some are the same.
CLAUSES = """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey,
  concat('Preface of it. ', CASE o_orderkey % 4 WHEN 0 THEN concat('The Cover Ratio shall not be less than ', cast(o_orderkey % 7 AS {s}), '.25 to 1.00 at any time.') WHEN 1 THEN concat('Total Debt shall not exceed $', cast(o_orderkey % 5 AS {s}), ',000,000 when debt is incurred.') WHEN 2 THEN 'Nothing is stated here.' ELSE 'Leverage Ratio shall not exceed 3.5:1.' END) AS text,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS INT) END AS page, CASE WHEN o_orderkey % 2 = 0 THEN concat('Section ', cast(o_orderkey % 9 AS {s})) END AS section_label FROM orders"""


@query(
    f"""WITH c AS ({CLAUSES.format(s="varchar")}), x AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Cover Ratio' WHEN 1 THEN 'Total Debt' ELSE 'Leverage Ratio' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'not_less_than' ELSE 'not_to_exceed' END AS comparison,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 + 0.25 WHEN 1 THEN (o_orderkey % 5) * 1000000 ELSE 3.5 END::DOUBLE AS threshold, CASE WHEN o_orderkey % 4 = 1 THEN 'USD' ELSE 'ratio' END AS unit, CASE WHEN o_orderkey % 4 = 1 THEN 'incurrence_condition' ELSE 'maintenance' END AS covenant_type, substr(text, 16) AS source_text FROM c WHERE o_orderkey % 4 <> 2)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, name, comparison, threshold, unit, covenant_type, source_text, page, section_label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(source_text) ORDER BY rank) AS n FROM x) WHERE n = 1"""
)
def clause_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covenants by patterns, pinned to the clause's page and label; of equal quotes of a document the first."""
    found = extraction.extract_clauses(_sql(spark, sf_dir, CLAUSES.format(s="string"), "orders"), completion.PatternBackend())["financial_covenants"]
    item = F.col("item")
    return found.select("doc_id", F.col("rank").cast("int").alias("rank"), *[item[c].alias(c) for c in ("name", "comparison", "threshold", "unit", "covenant_type")], *[item["citation"][c].alias(c) for c in ("source_text", "page", "section_label")])


@query(rf"""WITH p AS (SELECT conv_id, turn, role, text, lower(trim(regexp_replace(text, '{RE2_WHITE}', ' ', 'g'))) AS k FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS borrowers FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS n FROM p WHERE role = 'user') WHERE n = 1 GROUP BY conv_id)
SELECT c.conv_id AS doc_id, coalesce(any_value(b.borrowers), '') AS borrowers, arg_min(c.text, c.turn) FILTER (c.role = 'assistant' AND c.text IS NOT NULL) AS loan_type, arg_min(c.text, c.turn) FILTER (c.turn % 3 = 2 AND c.text IS NOT NULL) AS end_date
FROM conversations c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id""")
def merged_loan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of all turns without repeats, of single values the first that is there."""
    turns = table(spark, sf_dir, "conversations")
    cited = F.struct(F.col("text").alias("value"), F.lit(None).cast(schemas.CITATION).alias("citation"))
    there = F.col("text").isNotNull()
    fields = {n: F.lit(None).cast(schemas.CITED) for n in schemas.P.LOAN_FIELDS} | {"loan_type": F.when(there & (F.col("role") == "assistant"), cited), "end_date": F.when(there & (F.col("turn") % 3 == 2), cited)}
    none = F.array().cast(f"array<{schemas.CITED}>")
    terms = F.struct(F.when(there & (F.col("role") == "user"), F.array(cited)).otherwise(none).alias("borrowers"), none.alias("lenders"), *[c.alias(n) for n, c in fields.items()])
    merged = extraction.merged_terms(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), terms.alias("terms")))
    t = F.col("loan_terms")
    return merged.select("doc_id", F.array_join(F.transform(t["borrowers"], lambda x: x["value"]), " | ").alias("borrowers"), t["loan_type"]["value"].alias("loan_type"), t["end_date"]["value"].alias("end_date"))


#: One contract for each nation, with definitions, covenants of its suppliers and boilerplate.
CONTRACTS = """SELECT concat('doc-', cast(s_nationkey AS string)) AS doc_id, s_suppkey AS ord, concat('Section ', cast(s_suppkey AS string), '.1 Supply. The Supply Ratio shall not exceed ', cast(s_suppkey % 9 + 1 AS string), '.50 to 1.00 for ', s_name, ' at any time.') AS text FROM supplier"""


@query("""SELECT 'doc-' || s_nationkey AS doc_id, least(count(*), 10) AS n_covenants, least(count(*), 10) AS n_verified, least(count(*), 10) AS n_grounded, least(count(*), 10) AS n_matching, true AS defined,
'resolved' AS status FROM supplier GROUP BY s_nationkey""")
def document_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to exported results with a backend of patterns: every covenant is quoted, grounded and agrees with its number."""
    rows = _sql(spark, sf_dir, CONTRACTS, "supplier")
    lines = rows.unionByName(rows.select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit('"Supply Ratio" means all goods over all debts of the parties.').alias("text")).distinct())
    own = F.row_number().over(layout.Window.partitionBy("doc_id").orderBy("ord")) - 1
    blocks = lines.select("doc_id", own.alias("block_idx"), "text", F.lit(None).cast("int").alias("page"))
    blocks = layout.with_offsets(layout.carry_label(blocks, layout.label_of("text")))
    embedder = retrieval.TfidfEmbedder(stop=())
    results = sinks.opened(extract_documents(blocks, completion.PatternBackend(), embedder, queries_of=("supply ratio shall not exceed",), floor=0.0, keywords=("supply ratio shall",)))
    items = F.col("financial_covenants")
    count = lambda f: F.size(F.filter(items, f)).cast("long")
    first = items[0]
    return results.select("doc_id", F.size(items).cast("long").alias("n_covenants"), count(lambda c: c["audit"]["citation_verified"]).alias("n_verified"), count(lambda c: c["audit"]["citation_grounded"]).alias("n_grounded"), count(lambda c: c["audit"]["calculator_match"]).alias("n_matching"), (first["definition"] == "all goods over all debts of the parties.").alias("defined"), F.get_json_object(first["resolved_definition"], "$.status").alias("status"))


# Two results of the same documents, twenty customers each.
SIDE = """SELECT CAST(floor(c_custkey / 20) AS INT) AS doc_id, c_custkey AS item_idx, concat(CASE WHEN {side} = 1 THEN ' ' ELSE '' END, c_name) AS name, CASE WHEN (c_custkey + {side}) % 3 = 0 THEN 'not_to_exceed' ELSE 'not_less_than' END AS comparison,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN c_acctbal + {side} * c_acctbal * 0.5 ELSE c_acctbal + {side} * c_acctbal * 0.001 END AS threshold,
  CASE WHEN {side} = 1 THEN ' usd' ELSE 'USD ' END AS unit, CASE WHEN c_custkey % 3 = {side} THEN 'quarterly' WHEN c_custkey % 2 = 0 THEN '' END AS test_frequency FROM customer WHERE c_custkey % (5 + 2 * {side}) <> 0"""
SIDES_SQL = f"a AS ({SIDE.format(side=0)}), b AS ({SIDE.format(side=1)})"
MATCH_SQL = f"""{SIDES_SQL}, d AS (SELECT a.doc_id, a.item_idx AS a, b.item_idx AS b, a.name AS name_a, b.name AS name_b, 1.0::DOUBLE AS name_similarity, a.comparison = b.comparison AS comparison_match,
  coalesce(a.threshold <> 0 AND abs(a.threshold - b.threshold) / abs(a.threshold) <= 0.01, false) OR a.threshold IS NOT DISTINCT FROM b.threshold AS threshold_match, true AS unit_match,
  nullif(a.test_frequency, '') IS NOT DISTINCT FROM nullif(b.test_frequency, '') AS test_frequency_match, round(a.threshold, 6) AS threshold_a, round(b.threshold, 6) AS threshold_b FROM a JOIN b ON a.doc_id = b.doc_id AND a.item_idx = b.item_idx)"""
#: Only equal names match at this similarity.
SAME = 0.95


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(materialize(_sql(spark, sf_dir, SIDE.format(side=s), "customer"), "side") for s in (0, 1))


@query(f"WITH {MATCH_SQL} SELECT * FROM d")
def covenant_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of covenants of two results and in what they agree."""
    details = compare.agreement(*_sides(spark, sf_dir), SAME)[0]
    return details.withColumns({c: F.round(c, 6) for c in ("threshold_a", "threshold_b")})


def _only_sql(name: str, side: str, other: str) -> str:
    return f"""{name} AS (SELECT doc_id, list(name ORDER BY item_idx) AS names FROM {side} x WHERE NOT EXISTS (SELECT 1 FROM {other} y WHERE y.doc_id = x.doc_id AND y.item_idx = x.item_idx) GROUP BY doc_id)"""


ONLY_SQL = f"""{MATCH_SQL}, {_only_sql("oa", "a", "b")}, {_only_sql("ob", "b", "a")}, e AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b)"""


@query(f"""WITH {ONLY_SQL} SELECT e.doc_id, coalesce(any_value(n), 0) AS matched_count, {", ".join(f"coalesce(any_value({m}), 0) AS {m}_agreement" for m in ("comparison", "threshold", "unit", "test_frequency"))}, coalesce(any_value(array_to_string(oa.names, ',')), '') AS only_in_a, coalesce(any_value(array_to_string(ob.names, ',')), '') AS only_in_b
FROM e LEFT JOIN (SELECT doc_id, count(*) AS n, {", ".join(f"round(count(*) FILTER ({m}_match) / count(*), 3) AS {m}" for m in ("comparison", "threshold", "unit", "test_frequency"))} FROM d GROUP BY doc_id) r ON r.doc_id = e.doc_id LEFT JOIN oa ON oa.doc_id = e.doc_id LEFT JOIN ob ON ob.doc_id = e.doc_id GROUP BY e.doc_id""")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of agreement for each document, and what only one side has."""
    rates = compare.agreement(*_sides(spark, sf_dir), SAME)[1]
    return rates.withColumns({c: F.array_join(c, ",") for c in ("only_in_a", "only_in_b")})


@query(f"""WITH {ONLY_SQL} SELECT e.doc_id, coalesce(any_value(n), 0) AS matched_count, round(coalesce(any_value(n), 0) / (coalesce(any_value(n), 0) + coalesce(any_value(len(oa.names)), 0) + coalesce(any_value(len(ob.names)), 0)), 3) AS jaccard_overlap
FROM e LEFT JOIN (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id) r ON r.doc_id = e.doc_id LEFT JOIN oa ON oa.doc_id = e.doc_id LEFT JOIN ob ON ob.doc_id = e.doc_id GROUP BY e.doc_id""")
def addback_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overlap(*_sides(spark, sf_dir), SAME).select("doc_id", "matched_count", "jaccard_overlap")


@query(f"""WITH {SIDES_SQL} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.item_idx AS a, b.item_idx AS b, a.unit AS unit_a, b.unit AS unit_b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.item_idx = b.item_idx""")
def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of both results, matched ones in one row."""
    a, b = _sides(spark, sf_dir)
    pairs, _, _ = compare.match_items(a, b, least=SAME)
    return compare.sides(pairs, a, b).select("doc_id", "a", "b", F.col("left.unit").alias("unit_a"), F.col("right.unit").alias("unit_b"))


#: Exceptions of two lists for each customer: amounts with and without units, percentages, some off by a little and some by more.
BASKETS = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) - 1 AS INT) AS idx, CASE WHEN o_orderkey % 5 = 4 THEN 'no number at all' ELSE concat('up to $', {amount}, CASE WHEN o_orderkey % 2 = 0 THEN ' million' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN concat(' or ', cast(o_orderkey % 4 + 1 AS {s}), '%') ELSE '' END) END AS raw,
  o_orderkey % 5 = 4 AS plain, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE {number} * CASE WHEN o_orderkey % 2 = 0 THEN 1000000 ELSE 1 END END AS amount, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 3 = 0 THEN o_orderkey % 4 + 1 END AS percent FROM orders"""


def _baskets(s: str, side: int) -> str:
    number = "(100 + o_orderkey % 6)" if side == 0 else "(100 + o_orderkey % 6 + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END)"
    return BASKETS.format(order="o_orderkey" if side == 0 else "o_orderkey DESC", amount=f"cast({number} AS {s})", number=number, s=s)


CLOSE = "(({x} IS NULL AND {y} IS NULL) OR coalesce(abs({x} - {y}) <= 0.01 * abs({x}), false))"
BASKETS_SQL = f"""a0 AS ({_baskets("varchar", 0)}), b0 AS ({_baskets("varchar", 1)}), pairs AS (SELECT a0.doc_id, a0.idx AS a, b0.idx AS b FROM a0 JOIN b0 ON a0.doc_id = b0.doc_id AND {CLOSE.format(x="a0.amount", y="b0.amount")} AND {CLOSE.format(x="a0.percent", y="b0.percent")}), {first_unused_sql("doc_id")}"""


def _exceptions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = (_sql(spark, sf_dir, _baskets("string", s), "orders").select("doc_id", "idx", "raw") for s in (0, 1))
    return compare.match_exceptions(a, b, ["doc_id"])


@query(f"WITH RECURSIVE {BASKETS_SQL} SELECT doc_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM chosen")
def matched_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exception with the first free one that is equivalent in amount and percentage."""
    return _exceptions(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {BASKETS_SQL} SELECT doc_id, 'a' AS side, idx, raw FROM a0 WHERE NOT EXISTS (SELECT 1 FROM chosen c JOIN a0 x ON x.doc_id = c.doc_id AND x.idx = c.a WHERE c.doc_id = a0.doc_id AND x.raw = a0.raw)
UNION ALL SELECT doc_id, 'b', idx, raw FROM b0 WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc_id = b0.doc_id AND c.b = b0.idx)""")
def unmatched_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = _exceptions(spark, sf_dir)
    return a.select("doc_id", F.lit("a").alias("side"), "idx", "raw").unionByName(b.select("doc_id", F.lit("b").alias("side"), "idx", "raw"))


@query(f"""WITH RECURSIVE {BASKETS_SQL} SELECT doc_id, round(coalesce(m, 0) / greatest(na, nb, 1), 3) AS exception_match_rate FROM (SELECT doc_id, count(*) AS na FROM a0 GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS nb FROM b0 GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM chosen GROUP BY doc_id) USING (doc_id)""")
def exception_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative covenants of two results, one a customer, and the share of exceptions that match."""
    sides = []
    for s in (0, 1):
        rows = _sql(spark, sf_dir, _baskets("string", s), "orders").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("x"))
        sides.append(materialize(rows.select("doc_id", F.lit(0).alias("item_idx"), F.lit("Debt").alias("name"), F.lit("none").alias("summary"), F.transform("x", lambda x: x["raw"]).alias("exceptions")), "restrictions"))
    return compare.restrictions(*sides).select("doc_id", "exception_match_rate")


@query(rf"""WITH q AS (SELECT doc_id, 'financial_covenants' AS category, substr(text, 11, 60) AS quote FROM documents UNION ALL SELECT doc_id, 'negative_covenants', translate(substr(text, 11, 60), 'aeiou', 'AEIOU') FROM documents UNION ALL SELECT doc_id, 'ebitda_addbacks', '' FROM documents),
n AS (SELECT q.doc_id, category, quote, trim(regexp_replace(quote, '{RE2_WHITE}', ' ', 'g')) AS f, trim(regexp_replace(text, '{RE2_WHITE}', ' ', 'g')) AS s FROM q JOIN documents USING (doc_id))
SELECT doc_id, category, md5(quote) AS quote FROM n WHERE f <> '' AND NOT contains(coalesce(s, ''), f)""")
def unverified_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that don't stand in their document letter by letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))
    quote = F.substring("full_text", 11, 60)
    rows = [("financial_covenants", quote), ("negative_covenants", F.translate(quote, "aeiou", "AEIOU")), ("ebitda_addbacks", F.lit(""))]
    items = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(0).alias("item_idx"), F.lit("n").alias("name"), q.alias("source_text")) for c, q in rows])).alias("x")).select("doc_id", "x.*")
    return compare.unverified_citations(items, docs).select("doc_id", "category", F.md5("source_text").alias("quote"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '—' WHEN o_orderkey % 3 = 0 THEN '$' || format('{:,.0f}', o_totalprice) WHEN o_orderkey % 3 = 1 THEN trim(printf('%g', o_totalprice / 1000) || ' ratio') ELSE printf('%g', o_totalprice * o_totalprice / 7919) END AS threshold,
CASE WHEN o_orderkey % 2 = 0 THEN 'not to exceed' ELSE '—' END AS comparison FROM orders""")
def threshold_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and directions as reports show them: dollars, units, six digits, exponents, nothing."""
    value = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN o_totalprice / 1000 ELSE o_totalprice * o_totalprice / 7919 END")
    unit = F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' usd' WHEN 1 THEN 'ratio' END")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"), unit.alias("u"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'not_to_exceed' END").alias("c"))
    return rows.select("o_orderkey", C.threshold_text("v", "u").alias("threshold"), C.comparison_text("c").alias("comparison"))


# Exported results, one a nation: its suppliers are the covenants, some of its customers the parties.
AUDITED = """SELECT s_nationkey, s_suppkey, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'not_to_exceed' WHEN 1 THEN 'not_less_than' ELSE '' END AS comparison, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS threshold, CASE WHEN s_suppkey % 2 = 0 THEN 'USD' ELSE 'ratio' END AS unit,
  CASE WHEN s_suppkey % 4 <> 0 THEN concat('Section ', cast(s_suppkey AS {s})) END AS section_label, CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey % 100 AS INT) END AS page, concat('quote of <', s_name, '>') AS source_text,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE s_suppkey % 5 <> 0 END AS verified, CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE s_suppkey % 7 <> 0 END AS grounded, CASE WHEN s_suppkey % 5 <> 0 THEN 1.0 ELSE 0.5 END AS similarity FROM supplier"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, AUDITED.format(s="string"), "supplier").selectExpr(
        "s_nationkey", "s_suppkey",
        """named_struct('name', s_name, 'comparison', comparison, 'threshold', cast(threshold AS double), 'unit', unit, 'test_frequency', cast(NULL AS string), 'covenant_type', 'maintenance',
          'citation', named_struct('source_text', source_text, 'page', page, 'section_label', section_label),
          'audit', named_struct('citation_verified', verified, 'citation_similarity', cast(similarity AS double), 'calculator_checked', s_suppkey % 2 = 0, 'calculator_match', s_suppkey % 4 = 0, 'citation_grounded', grounded, 'recomputed_threshold', cast(NULL AS double), 'recomputed_comparison', cast(NULL AS string)),
          'definition', cast(NULL AS string), 'resolved_definition', cast(NULL AS string)) AS c""",
    )
    covenants = rows.where("s_nationkey % 4 <> 3").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "c"))).alias("x")).select("s_nationkey", F.transform("x", lambda x: x["c"]).alias("financial_covenants"))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0 OR c_custkey % 25 = 0")

    def cited(value: str, verified: str = "true", resolved: str = "cast(NULL AS string)") -> str:
        audit_of = f"named_struct('citation_verified', {verified}, 'citation_similarity', 0.25D, 'calculator_checked', cast(NULL AS boolean), 'calculator_match', cast(NULL AS boolean), 'citation_grounded', cast(NULL AS boolean), 'recomputed_threshold', cast(NULL AS double), 'recomputed_comparison', cast(NULL AS string))"
        return f"named_struct('value', {value}, 'citation', named_struct('source_text', {value}, 'page', cast(NULL AS int), 'section_label', cast(NULL AS string)), 'audit', {audit_of}, 'resolved_value', {resolved})"

    parties = customers.selectExpr("c_nationkey", "c_custkey", f"{cited('c_name')} AS p")
    lists = parties.groupBy("c_nationkey").agg(*[F.array_sort(F.collect_list(F.when(F.expr(f"c_custkey % {n} = 0"), F.struct("c_custkey", "p")))).alias(f) for f, n in (("borrowers", 10), ("lenders", 25))])
    lists = lists.select("c_nationkey", *[F.transform(f, lambda x: x["p"]).alias(f) for f in ("borrowers", "lenders")])
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    whole = nations.join(covenants, nations["n_nationkey"] == F.col("s_nationkey"), "left").join(lists, nations["n_nationkey"] == F.col("c_nationkey"), "left")
    none = f"cast(NULL AS {schemas.EXPORTED_CITED})"
    terms = f"""named_struct('borrowers', borrowers, 'lenders', lenders, 'loan_type', {cited("n_name", "n_nationkey % 5 <> 0")}, 'loan_amount', {cited("'an amount'", "cast(NULL AS boolean)", "IF(n_nationkey % 2 = 0, concat('{\"formula\":\"$', n_nationkey, '\"}'), NULL)")},
      'interest_rate', {cited("''")}, 'start_date', {none}, 'end_date', IF(n_nationkey % 3 = 0, {none}, {cited("concat('2030-', n_nationkey)")}), 'principal_repayment_terms', {none})"""
    return whole.selectExpr("n_name AS doc_id", f"coalesce(financial_covenants, cast(array() AS array<{schemas._with(schemas.FINANCIAL, f'audit:{schemas.AUDIT},definition:string,resolved_definition:string')}>)) AS financial_covenants", f"IF(n_nationkey % 6 = 5, NULL, {terms}) AS loan_terms")


def _party_sql(n: int) -> str:
    return f"(SELECT list(c_name ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % {n} = 0)"


def _cell_sql(parties: str) -> str:
    joined = f"array_to_string({parties}, '; ')"
    return f"CASE WHEN n_nationkey % 6 = 5 OR {parties} IS NULL THEN '—' WHEN length({joined}) <= 100 THEN {joined} ELSE {parties}[1] || ' +' || (len({parties}) - 1) || ' more' END"


@query(f"""SELECT n_name AS doc_id, {_cell_sql(_party_sql(10))} AS borrower, {_cell_sql(_party_sql(25))} AS lenders, CASE WHEN n_nationkey % 6 = 5 THEN '—' ELSE n_name END AS type,
CASE WHEN n_nationkey % 6 = 5 THEN '—' WHEN n_nationkey % 2 = 0 THEN '$' || n_nationkey ELSE 'an amount' END AS amount, '—' AS rate, CASE WHEN n_nationkey % 6 = 5 OR n_nationkey % 3 = 0 THEN '—' ELSE '2030-' || n_nationkey END AS maturity FROM nation""")
def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.loan_headers(_results(spark, sf_dir))


@query(f"""WITH a AS ({AUDITED.format(s="varchar")}) SELECT n_name AS doc_id, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS INTEGER) AS item_idx, s_name AS name, 'maintenance' AS covenant_type, coalesce(nullif(replace(comparison, '_', ' '), ''), '—') AS comparison,
CASE WHEN threshold IS NULL THEN '—' WHEN unit = 'USD' THEN '$' || format('{{:,.0f}}', threshold) ELSE printf('%g', threshold) || ' ratio' END AS threshold, coalesce(section_label, '—') AS section FROM nation JOIN a ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3
UNION ALL SELECT n_name, NULL, '—', NULL, '—', '—', '—' FROM nation WHERE n_nationkey % 4 = 3 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def report_covenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.covenant_rows(_results(spark, sf_dir))


@query(f"""WITH a AS ({AUDITED.format(s="varchar")}), x AS (SELECT * FROM nation JOIN a ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3)
SELECT n_name AS doc_id, s_name AS item, printf('%g', threshold) AS value, 'threshold not in citation' AS reason, NULL::DOUBLE AS similarity FROM x WHERE grounded = false
UNION ALL SELECT n_name, s_name, printf('%g', threshold), 'citation not verified', similarity FROM x WHERE verified = false
UNION ALL SELECT n_name, 'loan type', n_name, 'citation not verified', 0.25 FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey % 6 <> 5""")
def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_flags(_results(spark, sf_dir)).drop("ord")


@query("SELECT n_name AS doc_id FROM nation WHERE n_nationkey % 6 = 5")
def report_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stale_documents(_results(spark, sf_dir))


def _note_sql(label: str, parties: str) -> str:
    return f"SELECT n_name AS doc_id, '{label}' AS label, array_to_string(list_slice({parties}, 2, len({parties})), '; ') AS parties FROM nation WHERE n_nationkey % 6 <> 5 AND length(array_to_string({parties}, '; ')) > 100"


@query(f"{_note_sql('Other borrowers', _party_sql(10))} UNION ALL {_note_sql('Other lenders', _party_sql(25))}")
def report_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.party_footnotes(_results(spark, sf_dir))


@query(f"""WITH a AS ({AUDITED.format(s="varchar")}), x AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS i FROM nation JOIN a ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3)
SELECT n_name AS doc_id, 'detail-' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || i AS anchor, s_name AS name, CASE WHEN page > 0 THEN 'page ' || page ELSE coalesce(section_label, 'unknown location') END AS location, source_text,
array_to_string(list_filter([CASE WHEN verified THEN 'citation verified' ELSE 'citation unverified' END || printf(' (%.2f)', similarity), CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'calculator match' ELSE 'calculator mismatch' END END,
  CASE WHEN grounded THEN 'threshold grounded' WHEN NOT grounded THEN 'threshold NOT found in citation' END], lambda x: x IS NOT NULL), ', ') AS badges FROM x""")
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.covenant_details(_results(spark, sf_dir))
    return found.select("doc_id", "anchor", "name", "location", "source_text", F.array_join("badges", ", ").alias("badges"))


@query(f"""WITH a AS ({AUDITED.format(s="varchar")}) SELECT (SELECT count(*) FROM nation) AS documents, count(*) AS covenants, count(*) FILTER (verified = false) AS unverified FROM a WHERE s_nationkey % 4 <> 3""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_counts(_results(spark, sf_dir))


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM (SELECT c_custkey, '<b class="x">' || c_name || ' & ''co''</b>' AS t FROM customer)""")
def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('<b class="x">'), "c_name", F.lit(" & 'co'</b>"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.escaped(text).alias("escaped"))


@query("""SELECT d.doc_id, '{"lang": "' || d.lang || '", "loan_terms": ' || CASE WHEN l.doc_id IS NULL THEN '{"n": ' || d.n_chars || '}' ELSE '{"toxic": ' || l.toxic || '}' END || ', "last": [1, null]}' AS json FROM documents d LEFT JOIN labels l USING (doc_id)""")
def json_merge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of exported results with a new value where there is one; the rest as it was."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    old = docs.select("doc_id", F.format_string('{"lang": "%s", "loan_terms": {"n": %d}, "last": [1, null]}', "lang", "n_chars").alias("json"))
    return sinks.merged_key(old, labels.select("doc_id", F.format_string('{"toxic": %d}', "toxic").alias("json")), "loan_terms")


@query("""SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS rank, printf('[%d] %s | basis=%s | score=%.3f | "%s%s"', CAST(turn AS INTEGER), CASE WHEN turn % 3 > 0 THEN 'page ' || (turn % 3) ELSE 'unknown location' END, CASE WHEN turn % 2 = 0 THEN 'keyword+embedding' ELSE 'embedding' END, turn / 8.0, replace(substr(text, 1, 80), chr(10), ' '), CASE WHEN length(text) > 80 THEN '...' ELSE '' END) AS line FROM conversations""")
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees before anything is asked."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "cast(turn AS int) AS rank", "turn % 3 AS page", "'' AS section_label", "turn % 2 = 0 AS keyword_match", "cast(turn / 8 AS double) AS score", "text")
    return extraction.candidate_lines(turns)


@query("""SELECT c_custkey, c_name AS source_text, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS INTEGER) END AS page, c_mktsegment AS section_label FROM customer""")
def pinned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the real place instead of the answer's."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"cast(named_struct('value', 'v', 'citation', named_struct('source_text', c_name, 'page', 99, 'section_label', 'made up')) AS {schemas.CITED}) AS item", "IF(c_custkey % 2 = 0, c_nationkey, NULL) AS page", "c_mktsegment AS section_label")
    return rows.select("c_custkey", extraction.pinned(F.col("item")).alias("p")).select("c_custkey", "p.citation.*")


@query("""SELECT n_regionkey AS doc_id, md5('Definition:' || chr(10) || '\"\"\"' || chr(10) || 'of ' || n_regionkey || chr(10) || '\"\"\"' || chr(10) || chr(10) || 'Components:' || chr(10) || string_agg('- "' || n_name || '" = ' || CASE WHEN n_nationkey % 3 = 0 THEN '(unresolved)' ELSE 'F' || n_nationkey END, chr(10) ORDER BY n_name)
 || CASE WHEN n_regionkey % 2 = 0 THEN chr(10) || chr(10) || 'A definition from elsewhere in the document:' || chr(10) || '\"\"\"' || chr(10) || 'more' || chr(10) || '\"\"\"' ELSE '' END) AS prompt FROM nation GROUP BY n_regionkey""")
def compose_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with components in order, those without a formula marked, and a supplement where there is one."""
    part = F.struct(F.col("n_name").alias("term"), F.expr("IF(n_nationkey % 3 = 0, NULL, concat('F', n_nationkey))").alias("formula"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("doc_id", F.md5(prompts.compose_prompt(F.concat(F.lit("of "), F.col("doc_id").cast("string")), "parts", F.when(F.expr("doc_id % 2 = 0"), F.lit("more")))).alias("prompt"))


@query("""SELECT c_nationkey AS doc_id, c_mktsegment AS list, min(c_custkey) AS item_idx FROM customer GROUP BY c_nationkey, c_mktsegment, lower(trim(regexp_replace(CASE c_custkey % 3 WHEN 0 THEN 'Same   Quote' WHEN 1 THEN ' same quote ' ELSE c_name END, ' +', ' ', 'g')))""")
def items_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items with equal quotes, white space and case aside, the first of a document's list."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "c_mktsegment AS list", "c_custkey AS item_idx", "CASE c_custkey % 3 WHEN 0 THEN 'Same   Quote' WHEN 1 THEN ' same quote ' ELSE c_name END AS quote")
    return audit.keep_first(rows, [F.col("doc_id"), F.col("list"), C.normalized("quote")], [F.col("item_idx")]).select("doc_id", "list", "item_idx")


@query("SELECT count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations")
def audited_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is quoted from its own conversation: all are verified, in one pass over each conversation's text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), F.col("text").alias("quote"))
    texts = turns.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "quote"))), lambda x: x["quote"]), "\n").alias("full_text"))
    found = audit.audited(turns, texts, ["place"])
    sizes = turns.select("doc_id", "place", F.length("quote").alias("n"))
    return found.where("citation_verified").join(sizes, ["doc_id", "place"]).agg(F.count("*").alias("turns"), F.sum("n").cast("long").alias("n"))
