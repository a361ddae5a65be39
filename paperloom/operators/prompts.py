"""What the model is asked. Own wording; the clause, definition or term always follows between triple quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAUSE_SYSTEM = (
    "You read clauses of credit agreements and list what they state: financial covenants, EBITDA add-backs, negative covenants. "
    "Take only what the clause says. Quote the words that support an item, letter by letter, in citation.source_text; leave page and "
    "section_label null. Say of a financial covenant whether it is a maintenance covenant, tested on a schedule, or an "
    "incurrence_condition, tested only before a certain act. Lists without items are empty. Answer with one JSON object of the schema."
)
LOAN_SYSTEM = (
    "You read parts of credit agreements and note the terms of the loan that they state: borrowers, lenders, loan type, loan amount, "
    "interest rate, start date, end date and terms of repayment. Name each party by its own name. Take only what the text says and leave "
    "the rest null or empty. Quote the words that support a value, letter by letter, in its citation. Answer with one JSON object of the schema."
)
TERM_SYSTEM = "You copy one defined term from a credit agreement: its name without quotes, its definition word by word, and the section label if it is seen. Answer with one JSON object of the schema."
LEAF_SYSTEM = (
    "You turn a definition into a short formula over short labels, with + - * / and parentheses; a set of things becomes an expression "
    "over sets. Don't copy sentences, don't add what the text lacks, don't expand other terms. Answer with one JSON object of the schema."
)
COMPOSE_SYSTEM = (
    "You put the formulas of components into the definition that names them and give one short formula. Keep signs as the definition has "
    "them, put components in parentheses where they are combined, and take their formulas as final. A component marked (unresolved) stays "
    "as its name. Answer with one JSON object of the schema."
)


def _quoted(intro: str, text: str | Column) -> Column:
    return F.concat(F.lit(intro + ':\n"""\n'), F.col(text) if isinstance(text, str) else text, F.lit('\n"""'))


def clause_prompt(text: str | Column) -> Column:
    return _quoted("List the financial covenants, EBITDA add-backs and negative covenants of this clause", text)


def loan_prompt(text: str | Column) -> Column:
    return _quoted("Note the terms of the loan that this text states", text)


def term_prompt(text: str | Column) -> Column:
    return _quoted("Copy the defined term of this text", text)


def leaf_prompt(definition: str | Column) -> Column:
    return _quoted("Turn this definition into a formula", definition)


def compose_prompt(definition: str | Column, components: str | Column, supplement: str | Column) -> Column:
    """``components``: an ordered array of ``term, formula``, the formula null where it isn't resolved; ``supplement`` may be null."""
    lines = F.transform(components, lambda c: F.concat(F.lit('- "'), c["term"], F.lit('" = '), F.coalesce(F.nullif(c["formula"], F.lit("")), F.lit("(unresolved)"))))
    more = F.coalesce(F.concat(F.lit("\n\n"), _quoted("A definition from elsewhere in the document", supplement)), F.lit(""))
    return F.concat(_quoted("Definition", definition), F.lit("\n\nComponents:\n"), F.array_join(lines, "\n"), more)
