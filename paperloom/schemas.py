"""Types of what is extracted, and checks of answers against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import patterns as P

CITATION = "struct<source_text:string,page:int,section_label:string>"
FINANCIAL = f"struct<name:string,comparison:string,threshold:double,unit:string,test_frequency:string,covenant_type:string,citation:{CITATION}>"
ADDBACK = f"struct<name:string,description:string,citation:{CITATION}>"
NEGATIVE = f"struct<name:string,summary:string,exceptions:array<string>,citation:{CITATION}>"
#: The lists of an extraction result and the type of their items.
LISTS = {"financial_covenants": FINANCIAL, "ebitda_addbacks": ADDBACK, "negative_covenants": NEGATIVE}
RESULT = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in LISTS.items()) + ">"
CITED = f"struct<value:string,citation:{CITATION}>"
PARTIES = ("borrowers", "lenders")
LOAN_TERMS = "struct<" + ",".join([*(f"{n}:array<{CITED}>" for n in PARTIES), *(f"{n}:{CITED}" for n in P.LOAN_FIELDS)]) + ">"
TERM = "struct<term:string,definition_text:string,source_clause:string>"
FRAGMENT = "struct<formula:string,notes:string>"
TYPES = {"result": RESULT, "loan_terms": LOAN_TERMS, "term": TERM, "fragment": FRAGMENT}

# The types of exported results, which carry audits and what was resolved (nested formulas as JSON text).
AUDIT = (
    "struct<citation_verified:boolean,citation_similarity:double,calculator_checked:boolean,calculator_match:boolean,citation_grounded:boolean,"
    "recomputed_threshold:double,recomputed_comparison:string>"
)


def _with(kind: str, more: str) -> str:
    return f"{kind[:-1]},{more}>"


EXPORTED_CITED = _with(CITED, f"audit:{AUDIT},resolved_value:string")
EXPORTED = ", ".join(
    [
        f"financial_covenants array<{_with(FINANCIAL, f'audit:{AUDIT},definition:string,resolved_definition:string')}>",
        f"ebitda_addbacks array<{_with(ADDBACK, f'audit:{AUDIT}')}>",
        f"negative_covenants array<{_with(NEGATIVE, f'audit:{AUDIT}')}>",
        "loan_terms struct<" + ",".join([*(f"{n}:array<{EXPORTED_CITED}>" for n in PARTIES), *(f"{n}:{EXPORTED_CITED}" for n in P.LOAN_FIELDS)]) + ">",
    ]
)

#: Fields that must be there, by type of item.
REQUIRED = {
    "financial_covenants": ("name", "comparison", "threshold", "unit", "covenant_type", "citation.source_text"),
    "ebitda_addbacks": ("name", "citation.source_text"),
    "negative_covenants": ("name", "summary", "citation.source_text"),
    "cited": ("value", "citation.source_text"),
    "term": ("term", "definition_text"),
    "fragment": ("formula",),
}
ENUMS = {"comparison": P.COMPARISONS, "covenant_type": P.COVENANT_TYPES}


def _field(x: Column, path: str) -> Column:
    for name in path.split("."):
        x = x[name]
    return x


def _wrong(x: Column, kind: str) -> Column:
    """The first fault of one item, null without one."""
    faults = [F.when(_field(x, p).isNull(), F.lit(f"{kind}: no {p}")) for p in REQUIRED[kind]]
    if kind == "financial_covenants":
        faults += [F.when(x[n].isNotNull() & ~x[n].isin(*known), F.concat(F.lit(f"{kind}: unknown {n} "), x[n])) for n, known in ENUMS.items()]
    return F.coalesce(*faults)


def _first_wrong(items: Column, kind: str) -> Column:
    return F.get(F.array_compact(F.transform(F.coalesce(items, F.array()), lambda x: _wrong(x, kind))), F.lit(0))


def fault_of(value: Column, kind: str) -> Column:
    """Why a parsed answer isn't of the type: null if it is."""
    if kind == "result":
        faults = [_first_wrong(value[n], n) for n in LISTS]
    elif kind == "loan_terms":
        faults = [_first_wrong(value[n], "cited") for n in PARTIES] + [F.when(value[n].isNotNull(), _wrong(value[n], "cited")) for n in P.LOAN_FIELDS]
    else:
        faults = [_wrong(value, kind)]
    return F.when(value.isNull(), F.lit("not of the type")).otherwise(F.coalesce(*faults, F.lit(None).cast("string")))


def parsed(answers: DataFrame, kind: str, response: str = "response", value: str = "value", fault: str = "fault") -> DataFrame:
    """``answers`` with ``value``, the JSON of ``response`` as the type, and ``fault``.

    A faulty answer has no value and a reason; rows with one belong in a quarantine table. Unknown
    fields are ignored, missing lists are empty.
    """
    broken = "_broken"
    declared = f"{TYPES[kind][:-1]},{broken}:string>"
    raw = F.from_json(response, declared, {"columnNameOfCorruptRecord": broken})
    opened = answers.withColumn(value, raw).withColumn(value, F.when(F.col(response).rlike(r"^\s*\{") & F.col(value)[broken].isNull(), F.col(value).dropFields(broken)))
    names = {"result": tuple(LISTS), "loan_terms": PARTIES}.get(kind, ())
    filled = F.col(value)
    for n in names:
        filled = filled.withField(n, F.coalesce(F.col(value)[n], F.array()))
    opened = opened.withColumn(value, F.when(F.col(value).isNotNull(), filled)) if names else opened
    checked = opened.withColumn(fault, fault_of(F.col(value), kind))
    return checked.withColumn(value, F.when(F.col(fault).isNull(), F.col(value)))
