"""Column expressions over one row; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

DASH = "—"
WHITE = r"(?U)[\s\x1c-\x1f]+"


def flattened(text: str | Column) -> Column:
    """White space runs as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, F.lit(WHITE), F.lit(" ")))


def normalized(text: str | Column) -> Column:
    """``flattened`` in lower case."""
    return F.lower(flattened(text))


def first_group(text: str | Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(F.col(text).rlike(pattern) if isinstance(text, str) else text.rlike(pattern), F.regexp_extract(text, pattern, group))


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?iU)(?:" + "|".join(patterns) + ")"


def keyword_match(text: str | Column, patterns: tuple[str, ...] = P.COVENANT_KEYWORDS) -> Column:
    """Whether any pattern occurs, in any case; false for null text."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(any_of(patterns)), F.lit(False))


def location_label(page: str, section: str) -> Column:
    """``page N``, else the section label, else ``unknown location``; page 0 and an empty label count as absent."""
    p = F.col(page)
    return F.coalesce(F.when(p != 0, F.concat(F.lit("page "), p.cast("string"))), F.nullif(F.col(section), F.lit("")), F.lit("unknown location"))


def slug(text: str) -> Column:
    return F.expr(f"trim(BOTH '-' FROM regexp_replace(lower({text}), '[^a-z0-9]+', '-'))")


def comparison_of(text: str | Column) -> Column:
    """The direction that a clause states: an upper limit anywhere comes before a lower one."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(P.UPPER_LIMIT), F.lit("not_to_exceed")).when(t.rlike(P.LOWER_LIMIT), F.lit("not_less_than"))


def threshold_of(text: str | Column) -> Column:
    """The number that a clause with a direction states: a ratio to one, else an amount in dollars."""
    ratio = first_group(text, P.RATIO).cast("double")
    dollars = F.regexp_replace(first_group(text, P.DOLLARS), ",", "").try_cast("double")
    return F.when(comparison_of(text).isNotNull(), F.coalesce(ratio, dollars))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled(x: Column, power: Column) -> Column:
    """``x`` (not negative) times ten to the power, rounded to a whole number by its exact binary value, ties to even.

    The product's rounding error is had from the halves of both factors, so that a value that only
    prints as a tie goes where it belongs. Powers beyond 22 are as good as doubles are.
    """

    def halves(s: Column) -> Column:
        high = [v * 134217729.0 - (v * 134217729.0 - v) for v in (s["x"], s["t"])]
        return let(F.struct(s["x"].alias("x"), s["t"].alias("t"), s["k"].alias("k"), (s["x"] * s["t"]).alias("p"), high[0].alias("xh"), high[1].alias("th")), parts)

    def parts(s: Column) -> Column:
        xl, tl = s["x"] - s["xh"], s["t"] - s["th"]
        error = ((s["xh"] * s["th"] - s["p"]) + s["xh"] * tl + xl * s["th"]) + xl * tl
        up, down = F.floor(s["p"]).cast("double"), F.floor(s["x"] / s["t"]).cast("double")
        base = F.when(s["k"] >= 0, up).otherwise(down)
        twice = F.when(s["k"] >= 0, 2 * ((s["p"] - up) + error)).otherwise(2 * (s["x"] - down * s["t"]) / s["t"])
        return let(F.struct(base.alias("b"), twice.alias("w")), lambda r: let(F.struct((r["b"] - (r["w"] < 0).cast("int")).alias("b"), (r["w"] + 2 * (r["w"] < 0).cast("int")).alias("w")), rounded))

    def rounded(r: Column) -> Column:
        return (r["b"] + ((r["w"] > 1) | ((r["w"] == 1) & (r["b"] % 2 == 1))).cast("int")).cast("long")

    return let(F.struct(x.alias("x"), F.pow(F.lit(10.0), F.abs(power)).alias("t"), power.alias("k")), halves)


def two_decimals(v: Column, grouped: bool = False) -> Column:
    """A number with two decimals, as C's ``%.2f`` prints it; with commas between thousands if grouped."""

    def text(cents: Column) -> Column:
        whole = F.floor(cents / 100).cast("long")
        return F.concat(F.format_number(whole, 0) if grouped else whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))

    exact = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), let(_scaled(F.abs(v), F.lit(2)), text))
    # Beyond this the cents aren't whole numbers of a double.
    return F.when(F.abs(v) < 4.5e13, exact).otherwise(F.format_string("%,.2f" if grouped else "%.2f", v))


def shortest(v: Column) -> Column:
    """A number with six significant digits and no zeros at the end, as C's ``%g`` prints it; null stays null."""

    def digits(s: Column) -> Column:
        six = F.when(s["x"] == 0, F.lit(0).cast("long")).otherwise(_scaled(s["x"], 5 - s["k"]))
        return let(F.struct(six.alias("n"), s["k"].alias("k")), carried)

    def carried(s: Column) -> Column:
        over = s["n"] == 1_000_000
        return let(F.struct(F.when(over, F.lit("100000")).otherwise(F.lpad(s["n"].cast("string"), 6, "0")).alias("d"), (s["k"] + over.cast("int")).alias("k")), pointed)

    def pointed(s: Column) -> Column:
        d, k = s["d"], s["k"]
        far = (k < -4) | (k > 5)
        whole = F.when(far, F.lit(1)).otherwise(k + 1)
        text = F.when(whole > 0, F.concat(F.substring(d, F.lit(1), whole), F.lit("."), F.substring(d, whole + 1, F.lit(6)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), d))
        size = F.abs(k).cast("string")
        power = F.concat(F.when(k < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(size) < 2, F.lit("0")).otherwise(F.lit("")), size)
        return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.when(far, power).otherwise(F.lit("")))

    x = F.abs(v)
    power = F.regexp_extract(F.format_string("%.16e", x), r"e([+-]\d+)$", 1).cast("int")
    text = let(F.struct(x.alias("x"), power.alias("k")), digits)
    return F.when(v.isNotNull(), F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), text))


def threshold_text(threshold: str, unit: str) -> Column:
    """A threshold for a report: dollars without cents, else the shortest form and the unit; a dash for null."""
    v, u = F.col(threshold).cast("double"), F.coalesce(F.col(unit), F.lit(""))
    other = F.when(u == "", shortest(v)).otherwise(F.trim(F.concat(shortest(v), F.lit(" "), u)))
    return F.when(v.isNull(), F.lit(DASH)).when(F.upper(F.trim(u)) == "USD", F.concat(F.lit("$"), F.format_string("%,.0f", F.rint(v)))).otherwise(other)


def comparison_text(comparison: str) -> Column:
    """A comparison in words; a dash for none."""
    return F.coalesce(F.nullif(F.replace(F.col(comparison), F.lit("_"), F.lit(" ")), F.lit("")), F.lit(DASH))


def preferred_value(item: str | Column) -> Column:
    """The formula that a cited value was resolved to, else the value; a dash without either."""
    x = F.col(item) if isinstance(item, str) else item
    return F.coalesce(F.nullif(F.get_json_object(x["resolved_value"], "$.formula"), F.lit("")), F.nullif(x["value"], F.lit("")), F.lit(DASH))


def escaped(text: str | Column) -> Column:
    """Text for HTML: the five characters with a meaning there as references."""
    out = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def threshold_variants(value: str | Column) -> Column:
    """How a number may stand in a text: two decimals and shortest form, with and without commas."""
    v = F.col(value) if isinstance(value, str) else value
    whole = v.cast("long")
    forms = [two_decimals(v), shortest(v), two_decimals(v, grouped=True), F.when(v == whole, whole.cast("string")), F.when(v == whole, F.format_string("%,d", whole))]
    return F.array_compact(F.array(*forms))


def grounded(value: str | Column, quote: str, variants: Callable[[str | Column], Column] = threshold_variants) -> Column:
    """Whether any form of the number occurs in the quote; ``variants`` gives the forms."""
    return F.exists(variants(value), lambda form: F.contains(F.col(quote), form))


def money_variants(value: str | Column) -> Column:
    """The one form of an amount of money: two decimals, commas between thousands."""
    return F.array_compact(F.array(two_decimals(F.col(value) if isinstance(value, str) else value, grouped=True)))


def covenant_checks(quote: str, comparison: str, threshold: str, tolerance: float = 1e-6) -> Column:
    """True unless the quote states another direction or number; a quote without one agrees."""
    stated = threshold_of(quote)
    same = (comparison_of(quote) == F.col(comparison)) & (F.abs(stated - F.col(threshold)) <= tolerance)
    return F.when(stated.isNull(), F.lit(True)).otherwise(F.coalesce(same, F.lit(False)))


def basket(text: str) -> Column:
    """``fixed_amount, percent, percent_base, is_grower`` of an exception's wording."""
    unit = F.lower(F.regexp_extract(text, P.BASKET_DOLLARS, 2))
    times = F.lit(1)
    for word, n in P.MULTIPLIERS.items():
        times = F.when(unit == word, n).otherwise(times)
    amount = F.regexp_replace(first_group(text, P.BASKET_DOLLARS), ",", "").try_cast("double") * times
    percent = first_group(text, P.BASKET_PERCENT).cast("double")
    base = F.rtrim(F.trim(first_group(text, P.BASKET_BASE)))
    grower = F.col(text).rlike("(?i)greater of") & amount.isNotNull() & percent.isNotNull()
    return F.struct(amount.alias("fixed_amount"), percent.alias("percent"), base.alias("percent_base"), grower.alias("is_grower"))


def title_phrases(text: str | Column) -> Column:
    """Distinct runs of two to seven capitalized words in the order in which they occur."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(P.TITLE_PHRASE), F.lit(0)), flattened))


def carve_outs(text: str | Column) -> Column:
    """Proviso clauses of at most 300 further characters, within a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(P.CARVE_OUT), F.lit(0)), F.trim)


def looks_like_definition(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"(?iU)^\s*" + P.OPENER), F.lit(False))


def quoted(text: Column) -> Column:
    """A pattern for the literal text."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def term_appears(term: str, text: str) -> Column:
    """Whether a term, or it with an s, ends at a word boundary in the text; its case counts."""
    return F.contains(F.col(text), F.col(term)) & F.expr(f"rlike({text}, concat('(?U)', regexp_replace({term}, r'([\\\\^$.|?*+()\\[\\]{{}}])', r'\\\\$1'), '\"?s?\\\\b'))")


def truncated_cell(items: str | Column, most: int = 100) -> Column:
    """The items joined; over ``most`` characters the first and how many more there are; a dash for none. Empty and null items don't count."""
    there = F.filter(items, lambda x: x != "")
    full = F.array_join(there, "; ")
    short = F.concat(F.get(there, F.lit(0)), F.lit(" +"), (F.size(there) - 1).cast("string"), F.lit(" more"))
    return F.when(F.coalesce(F.size(there), F.lit(0)) <= 0, F.lit(DASH)).when(F.length(full) <= most, full).otherwise(short)


def left_out(items: str | Column, most: int = 100) -> Column:
    """What ``truncated_cell`` leaves out, joined; null if nothing."""
    there = F.filter(items, lambda x: x != "")
    return F.when(F.length(F.array_join(there, "; ")) > most, F.array_join(F.slice(there, F.lit(2), F.greatest(F.size(there) - 1, F.lit(0))), "; "))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two arrays as doubles; zero vectors give 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
