"""Reports over exported results: rows for tables, and HTML of them.

``results`` has ``doc_id`` and the columns of ``schemas.EXPORTED``, as ``sources.files.json_results``
or ``plans.documents.opened`` give them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P

CELL = 100


def _values(field: str) -> Column:
    return F.transform(F.coalesce(F.col("loan_terms")[field], F.array()), lambda x: x["value"])


def loan_headers(results: DataFrame) -> DataFrame:
    """``doc_id, borrower, lenders, type, amount, rate, maturity``: one row for each document; dashes where nothing is known."""
    cells = {"type": "loan_type", "amount": "loan_amount", "rate": "interest_rate", "maturity": "end_date"}
    parties = [C.truncated_cell(_values(f), CELL).alias(n) for n, f in (("borrower", "borrowers"), ("lenders", "lenders"))]
    return results.select("doc_id", *parties, *[C.preferred_value(F.col("loan_terms")[f]).alias(n) for n, f in cells.items()])


def covenant_rows(results: DataFrame) -> DataFrame:
    """``doc_id, item_idx, name, covenant_type, comparison, threshold, section``: a row for each covenant, one of dashes for a document without."""
    rows = results.select("doc_id", F.posexplode_outer("financial_covenants").alias("item_idx", "c")).select("doc_id", "item_idx", "c.*")
    none = F.col("item_idx").isNull()
    cells = {
        "name": F.coalesce("name", F.lit("")),
        "comparison": C.comparison_text("comparison"),
        "threshold": C.threshold_text("threshold", "unit"),
        "section": F.coalesce(F.nullif(F.col("citation.section_label"), F.lit("")), F.lit(C.DASH)),
    }
    made = [F.when(none, C.DASH).otherwise(c).alias(n) for n, c in cells.items()]
    return rows.select("doc_id", "item_idx", made[0], "covenant_type", *made[1:])


def review_flags(results: DataFrame) -> DataFrame:
    """``doc_id, ord, item, value, reason, similarity``: what an audit found false; an audit that wasn't made flags nothing."""
    items = results.select("doc_id", F.posexplode("financial_covenants").alias("i", "c"))
    audit = F.col("c.audit")
    common = [F.coalesce("c.name", F.lit("?")).alias("item"), C.shortest(F.col("c.threshold")).alias("value")]
    ungrounded = items.where(~audit["citation_grounded"]).select("doc_id", (F.col("i") * 2).alias("ord"), *common, F.lit("threshold not in citation").alias("reason"), F.lit(None).cast("double").alias("similarity"))
    unverified = items.where(~audit["citation_verified"]).select("doc_id", (F.col("i") * 2 + 1).alias("ord"), *common, F.lit("citation not verified").alias("reason"), audit["citation_similarity"].alias("similarity"))
    fields = [F.struct(F.lit(1_000_000 + k).alias("ord"), F.lit(P.LOAN_LABELS[f]).alias("item"), F.col("loan_terms")[f].alias("x")) for k, f in enumerate(P.LOAN_FIELDS)]
    terms = results.select("doc_id", F.explode(F.array(*fields)).alias("f")).select("doc_id", "f.*").where(~F.col("x.audit.citation_verified"))
    loans = terms.select("doc_id", "ord", "item", F.col("x.value").alias("value"), F.lit("citation not verified").alias("reason"), F.col("x.audit.citation_similarity").alias("similarity"))
    return ungrounded.unionByName(unverified).unionByName(loans)


def stale_documents(results: DataFrame) -> DataFrame:
    """``doc_id`` of results from before loan terms were extracted."""
    return results.where("loan_terms IS NULL").select("doc_id")


def party_footnotes(results: DataFrame) -> DataFrame:
    """``doc_id, label, parties``: what the cells of ``loan_headers`` leave out."""
    notes = [F.struct(F.lit(f"Other {f}").alias("label"), C.left_out(_values(f), CELL).alias("parties")) for f in ("borrowers", "lenders")]
    return results.select("doc_id", F.explode(F.array(*notes)).alias("n")).select("doc_id", "n.*").where("parties IS NOT NULL")


def audit_badges(audit: Column) -> Column:
    """Short texts on what an audit found."""
    verified = F.concat(F.lit("citation "), F.when(audit["citation_verified"], "verified").otherwise("unverified"), F.format_string(" (%.2f)", F.coalesce(audit["citation_similarity"], F.lit(0.0))))
    checked = F.when(audit["calculator_checked"], F.when(audit["calculator_match"], F.lit("calculator match")).otherwise("calculator mismatch"))
    grounded = F.when(audit["citation_grounded"], F.lit("threshold grounded")).when(~audit["citation_grounded"], F.lit("threshold NOT found in citation"))
    return F.array_compact(F.array(verified, checked, grounded))


def covenant_details(results: DataFrame) -> DataFrame:
    """``doc_id, item_idx, anchor, name, covenant_type, comparison, threshold, test_frequency, definition, resolved_definition, location, source_text, badges``."""
    items = results.select("doc_id", F.posexplode("financial_covenants").alias("item_idx", "c")).select("doc_id", "item_idx", "c.*")
    items = items.withColumns({"page": F.col("citation.page"), "section_label": F.col("citation.section_label"), "slug": F.col("doc_id").cast("string")})
    return items.select(
        "doc_id",
        "item_idx",
        F.concat(F.lit("detail-"), C.slug("slug"), F.lit("-"), F.col("item_idx").cast("string")).alias("anchor"),
        F.coalesce("name", F.lit("")).alias("name"),
        "covenant_type",
        C.comparison_text("comparison").alias("comparison"),
        C.threshold_text("threshold", "unit").alias("threshold"),
        "test_frequency",
        "definition",
        "resolved_definition",
        C.location_label("page", "section_label").alias("location"),
        F.coalesce("citation.source_text", F.lit("")).alias("source_text"),
        audit_badges(F.col("audit")).alias("badges"),
    )


def report_counts(results: DataFrame) -> DataFrame:
    """One row: documents, covenants, and citations of covenants that aren't verified."""
    wrong = F.size(F.filter(F.coalesce("financial_covenants", F.array()), lambda c: ~c["audit"]["citation_verified"]))
    n = F.size(F.coalesce("financial_covenants", F.array()))
    return results.agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("covenants"), F.coalesce(F.sum(wrong), F.lit(0)).alias("unverified"))


def formula_html(node: dict) -> str:
    """A resolved formula with its status, carve-outs and components, as nested lists."""
    out: list[str] = []
    todo: list[dict | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        resolved = x.get("status", "resolved") == "resolved"
        badge = "resolved" if resolved else "requires review" + (f": {x['reason']}" if x.get("reason") else "")
        if x.get("formula"):
            out.append(f'<code class="formula">{escape(x["formula"])}</code> ')
        out.append(f'<span class="badge {"ok" if resolved else "warn"}">{escape(badge)}</span>')
        if x.get("carve_outs"):
            out.append("<ul>" + "".join(f"<li>{escape(c)}</li>" for c in x["carve_outs"]) + "</ul>")
        parts = list((x.get("components") or {}).items())
        if parts:
            todo.append("</ul>")
            for name, part in reversed(parts):
                todo += ["</li>", part, f"<li><strong>{escape(name)}:</strong> "]
            todo.append("<ul>")
    return "".join(out)


def _citation(c: dict | None) -> str:
    c = c or {}
    place = f"page {c['page']}" if c.get("page") else c.get("section_label") or "unknown location"
    return f"<blockquote><cite>{escape(place)}</cite>: “{escape(c.get('source_text') or '')}”</blockquote>"


def _badges(audit: dict | None) -> str:
    a = audit or {}
    verified = bool(a.get("citation_verified"))
    found = [(verified, f"citation {'verified' if verified else 'unverified'} ({a.get('citation_similarity') or 0:.2f})")]
    if a.get("calculator_checked"):
        found.append((bool(a.get("calculator_match")), f"calculator {'match' if a.get('calculator_match') else 'mismatch'}"))
    if a.get("citation_grounded") is not None:
        found.append((a["citation_grounded"], f"threshold {'grounded' if a['citation_grounded'] else 'NOT found in citation'}"))
    return " ".join(f'<span class="badge {"ok" if good else "warn"}">{text}</span>' for good, text in found)


def _section(title: str, items: list[str], none: str) -> str:
    return f"<h2>{title}</h2>" + ("".join(f"<section>{x}</section>" for x in items) if items else f'<p class="empty">{none}</p>')


def _definition(text: str | None, resolved: str | None) -> str:
    out = f"<p><strong>Definition:</strong> {escape(text) if text else '<em>not found in the definitions</em>'}</p>"
    return out + (f"<div><strong>Resolved:</strong> {formula_html(json.loads(resolved))}</div>" if resolved else "")


def document_html(name: str, result: dict) -> str:
    """One document's result as a page."""
    terms = result.get("loan_terms") or {}

    def cited(x: dict | None) -> str:
        return f"{escape(x.get('value') or '')}{_citation(x.get('citation'))}" if x else '<em class="empty">not stated</em>'

    rows = [(f.capitalize(), "".join(map(cited, terms.get(f) or [])) or cited(None)) for f in ("borrowers", "lenders")]
    rows += [(label.capitalize(), cited(terms.get(f))) for f, label in P.LOAN_LABELS.items()]

    def covenant(c: dict) -> str:
        often = f", {escape(c['test_frequency'])}" if c.get("test_frequency") else ""
        kind = f' <span class="badge">{escape(c["covenant_type"])}</span>' if c.get("covenant_type") else ""
        head = f"<h3>{escape(c.get('name') or '')}{kind}</h3><p><strong>{escape(c.get('comparison') or '')}</strong> {c.get('threshold')} {escape(c.get('unit') or '')}{often}</p>"
        return head + _definition(c.get("definition"), c.get("resolved_definition")) + _citation(c.get("citation")) + _badges(c.get("audit"))

    def plain(c: dict) -> str:
        more = "".join(f"<li>{escape(e)}</li>" for e in c.get("exceptions") or [])
        text = escape(c.get("summary") or c.get("description") or "")
        return f"<h3>{escape(c.get('name') or '')}</h3><p>{text}</p>" + (f"<ul>{more}</ul>" if more else "") + _citation(c.get("citation")) + _badges(c.get("audit"))

    body = "<h2>Loan terms</h2><dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in rows) + "</dl>"
    body += _section("Financial covenants", list(map(covenant, result.get("financial_covenants") or [])), "No financial covenants extracted.")
    body += _section("EBITDA add-backs", list(map(plain, result.get("ebitda_addbacks") or [])), "No EBITDA add-backs extracted.")
    body += _section("Negative covenants", list(map(plain, result.get("negative_covenants") or [])), "No negative covenants extracted.")
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(name)}</title></head><body><h1>{escape(name)}</h1>{body}</body></html>'


def document_pages(results: DataFrame) -> DataFrame:
    """``doc_id, html``: a page for each document, rendered where the row is."""
    rows = results.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.to_json(F.struct("financial_covenants", "ebitda_addbacks", "negative_covenants", "loan_terms")).alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [document_html(n or "", json.loads(j)) for n, j in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], ["doc_id", "html"])

    return rows.mapInArrow(run, f"doc_id {dict(results.dtypes)['doc_id']}, html string")


def _cells(cells: list[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def combined_report(results: DataFrame, title: str = "Combined covenant report") -> DataFrame:
    """``part, doc_id, ord, html``: pieces of one page over all documents; in this order, joined, they are the page.

    The pieces are rows, so the page may be as large as the corpus and is written by all executors.
    """
    name = C.escaped(F.col("doc_id").cast("string"))
    heads = loan_headers(results).select(
        F.lit(2).alias("part"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(-1).cast("long").alias("ord"),
        F.concat(F.lit('<tr class="loan"><td colspan="4"><strong>'), name, F.lit("</strong>"), *[F.concat(F.lit(f"<br>{n.capitalize()}: "), C.escaped(n)) for n in ("borrower", "lenders", "type", "amount", "rate", "maturity")], F.lit("</td></tr>")).alias("html"),
    )
    anchor = F.concat(F.lit("detail-"), F.expr("trim(BOTH '-' FROM regexp_replace(lower(cast(doc_id AS string)), '[^a-z0-9]+', '-'))"), F.lit("-"), F.col("item_idx").cast("string"))
    kind = F.coalesce(F.concat(F.lit(' <span class="badge">'), C.escaped("covenant_type"), F.lit("</span>")), F.lit(""))
    link = F.when(F.col("item_idx").isNull(), C.escaped("name")).otherwise(F.concat(F.lit('<a href="#'), anchor, F.lit('">'), C.escaped("name"), F.lit("</a>"), kind))
    rows = covenant_rows(results).select(F.lit(2).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("item_idx", F.lit(0)).cast("long").alias("ord"), _cells([link, C.escaped("comparison"), C.escaped("threshold"), C.escaped("section")]).alias("html"))
    similar = F.coalesce(F.format_string(" (similarity %.3f)", F.col("similarity")), F.lit(""))
    flag = F.concat(F.lit("<li><strong>"), name, F.lit("</strong>, <code>"), C.escaped("item"), F.lit("</code> ("), C.escaped(F.coalesce("value", F.lit(""))), F.lit("): "), F.col("reason"), similar, F.lit("</li>"))
    flags = review_flags(results).select(F.lit(0).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.col("ord").cast("long").alias("ord"), flag.alias("html"))
    note = F.concat(F.lit("<li>"), name, F.lit(", "), F.col("label"), F.lit(": "), C.escaped("parties"), F.lit("</li>"))
    notes = party_footnotes(results).select(F.lit(4).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("ord"), note.alias("html"))
    stale = stale_documents(results).select(F.lit(6).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("<li>"), name, F.lit("</li>")).alias("html"))
    details = _detail_cards(results)
    counts = report_counts(results).select(
        F.lit(-1).alias("part"),
        F.lit("").alias("doc_id"),
        F.lit(0).cast("long").alias("ord"),
        F.concat(F.lit(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>'), F.format_string("%d documents, %d covenants, %d unverified", "documents", "covenants", "unverified"), F.lit("</p><h2>For review</h2><ul>")).alias("html"),
    )
    fixed = [
        (1, '</ul><table id="report"><thead><tr><th>Covenant</th><th>Comparison</th><th>Threshold</th><th>Section</th></tr></thead><tbody>'),
        (3, "</tbody></table><h2>All parties</h2><ul>"),
        (5, "</ul><h2>Without loan terms</h2><ul>"),
        (7, "</ul><h2>Details</h2>"),
        (9, "</body></html>"),
    ]
    frame = results.sparkSession.createDataFrame([(p, "", 0, h) for p, h in fixed], "part int, doc_id string, ord long, html string")
    out = counts
    for piece in (frame, flags, heads, rows, notes, stale, details):
        out = out.unionByName(piece)
    return out


def _detail_cards(results: DataFrame) -> DataFrame:
    rows = covenant_details(results).select("doc_id", "item_idx", F.to_json(F.struct("*")).alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cards = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                d = json.loads(text)
                often = f", {escape(d['test_frequency'])}" if d.get("test_frequency") else ""
                kind = f' <span class="badge">{escape(d["covenant_type"])}</span>' if d.get("covenant_type") else ""
                badges = " ".join(f'<span class="badge">{escape(b)}</span>' for b in d.get("badges") or [])
                cards.append(
                    f'<article id="{d["anchor"]}"><p>{escape(str(doc))}</p><h3>{escape(d["name"])}{kind}</h3><p><strong>{escape(d["comparison"])}</strong> {escape(d["threshold"])}{often}</p>'
                    + _definition(d.get("definition"), d.get("resolved_definition"))
                    + f"<blockquote><cite>{escape(d['location'])}</cite>: “{escape(d['source_text'])}”</blockquote><p>{badges}</p><a href=\"#report\">Back to the table</a></article>"
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cards, pa.string())], ["doc_id", "item_idx", "html"])

    kind = dict(results.dtypes)["doc_id"]
    made = rows.mapInArrow(run, f"doc_id {kind}, item_idx int, html string")
    return made.select(F.lit(8).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.col("item_idx").cast("long").alias("ord"), "html")
