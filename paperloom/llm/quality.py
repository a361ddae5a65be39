"""Quality rules: counts over words and lines, and line frequencies across documents.

Only DataFrame expressions. Words are runs of characters other than ASCII white space. A document
fails the base rules with fewer than 20 words, or if over 30 % of its words stand in windows of
eight words that the text holds twice. Then lines are normalised (ASCII and other letters in lower
case, inner white space as one space, ends trimmed) and hashed; a line that stands in more distinct
documents of a host than ``LINE_DOCS`` is boilerplate there and removed. A document that loses
over half of its words is depleted and rejected.

Documents are distinct pairs of ``doc_id`` and text, so exact copies count each. A large group of
exact or near copies shares its lines and would be rejected whole. So of
the depleted documents that lose most by the same line (the one of most words), one stays if over half
of the line's documents are depleted: then the line belongs to copies, not around other texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_by_key, small
from ..plans.stage import materialize

LEAST_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
#: A line is boilerplate if more distinct documents of its host hold it, however large the host is.
LINE_DOCS = 10
#: A document that loses more than this share of its words is depleted.
LOST_SHARE = 0.5
#: One of a line's depleted documents stays if they are more than this share of its documents.
COPIES_SHARE = 0.5
#: Tasks that a line's rows are dealt to in the join.
SALTS = 16

KEYS = ["host", "text_key"]
SPACE = r"[\x20\x09-\x0D]+"
TRIMMED = r"btrim(text, ' \t\n\u000B\u000C\r')"


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``.

    Null text has no words. Existing columns of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = docs.drop(*made)
    keep = [f"`{c}`" for c in docs.columns]
    split = docs.selectExpr(*keep, f"CASE WHEN {TRIMMED} <> '' THEN split({TRIMMED}, r'{SPACE}') ELSE array() END AS _words")
    # Hashes of the windows; only a text with two equal ones is looked at closely.
    hashed = split.selectExpr(
        *keep,
        "size(_words) AS n_words",
        "length(array_join(_words, '')) AS word_chars",
        r"regexp_count(coalesce(text, ''), r'[#*$%&|<>]') AS n_symbols",
        r"filter(split(text, r'\n'), l -> l rlike r'[^\x20\x09-\x0D]') AS _lines",
        f"CASE WHEN size(_words) > {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) ELSE array() END AS _windows",
    )
    # Places of windows whose hash equals that of the one before or after it in hash order.
    order = "array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i)))"
    ranked = hashed.selectExpr(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "coalesce(size(_lines) - size(array_distinct(_lines)), 0) AS n_dup_lines",
        f"CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN {order} END AS _order",
    )
    twice = """array_sort(transform(filter(transform(_order, (x, k) -> struct(x.i AS i,
        k > 0 AND x.h = get(_order, k - 1).h OR coalesce(x.h = get(_order, k + 1).h, false) AS twice)), x -> x.twice), x -> x.i))"""
    placed = ranked.selectExpr(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", f"CASE WHEN _order IS NOT NULL THEN {twice} END AS _at")
    covered = f"aggregate(zip_with(_at, slice(_at, 2, size(_at)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x)"
    counted = placed.selectExpr(
        *keep,
        *[f"cast({c} AS long) AS {c}" for c in made[:4]],
        f"CASE WHEN _at IS NOT NULL THEN {covered} ELSE 0L END AS n_repeat_words",
    )
    # A generator of one row: the optimizer would push a filter on these columns below the steps above
    # and repeat each step inside the lambdas of the next, for every word.
    counted = counted.selectExpr(*keep, f"inline(array(struct({', '.join(made[:5])})))")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_of(host: str = "source") -> Column:
    """Documents without a host share the empty one."""
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """``host, text_key, place, line, words, copies`` once for each place of a line with words in each distinct text of a host.

    ``copies`` counts the host's documents with that text.
    """
    copies = docs.select(host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "doc_id").distinct()
    copies = copies.groupBy("host", "text_key").agg(F.count("*").alias("copies")).where("copies > 1")
    lines = docs.select(host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "text").where("text IS NOT NULL")
    lines = lines.selectExpr("host", "text_key", r"posexplode(split(text, r'\n')) AS (place, raw)")
    # Splitting at white space both counts the words and normalises.
    words = lines.selectExpr("host", "text_key", "place", f"filter(split(lower(raw), r'{SPACE}'), w -> w <> '') AS words")
    words = words.where(F.size("words") > 0)
    words = words.selectExpr("host", "text_key", "place", "xxhash64(array_join(words, ' ')) AS line", "size(words) AS words").distinct()
    return words.join(small(materialize(copies, "copies")), ["host", "text_key"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def frequent_lines(lines: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """``host, line, docs`` of lines above the limit, from ``document_lines``."""
    per_line = lines.select("host", "line", "text_key", "copies").distinct().groupBy("host", "line").agg(F.sum("copies").alias("docs"))
    return per_line.where(F.col("docs") > line_docs)


def lost_words(docs: DataFrame, host: str = "source") -> DataFrame:
    """``host, text_key, lost, line, docs``: words of boilerplate lines in each distinct text that has any, and the line of most words with its documents."""
    lines = materialize(document_lines(docs, host), "lines")
    frequent = frequent_lines(lines)
    salted = frequent.select("host", "line", "docs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("text_key", "place"), F.lit(SALTS)).cast("int"))
    lost = dealt.join(salted, ["host", "line", "salt"]).groupBy("host", "text_key").agg(F.sum("words").alias("lost"), F.max(F.struct("words", "line", "docs")).alias("most"))
    return lost.select("host", "text_key", "lost", "most.line", "most.docs")


def depleted(n_words: Column, lost: Column) -> Column:
    return lost > LOST_SHARE * n_words


def depleted_texts(docs: DataFrame, lost: DataFrame, host: str = "source") -> DataFrame:
    """``host, text_key, spared``: the depleted texts, each with the ``doc_id`` and text of the document of its group that stays, if one does."""
    keyed = docs.select("doc_id", host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "text")
    losing = join_by_key(keyed, lost, KEYS, ["doc_id"], "inner", keyed.select(*KEYS))
    # Only the words are counted to find the depleted ones.
    losing = losing.where(depleted(F.expr(f"CASE WHEN {TRIMMED} <> '' THEN size(split({TRIMMED}, r'{SPACE}')) ELSE 0 END"), F.col("lost")))
    rows = materialize(with_counts(losing).select(*KEYS, "line", "docs", "doc_id", "base_failed"), "depleted")
    first = F.min(F.when(~F.col("base_failed"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))).alias("first")
    held = rows.select("host", "line", "docs", "text_key", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("gone"), F.max("docs").alias("docs"))
    copies = held.where(F.col("gone") > COPIES_SHARE * F.col("docs")).select("host", "line")
    spared = rows.groupBy("host", "line").agg(first).join(copies, ["host", "line"]).selectExpr("host", "line", "struct(first.doc_id, first.text_key) AS spared").where("spared.text_key IS NOT NULL")
    texts = materialize(rows.select(*KEYS, "line").distinct(), "depleted-keys")
    return join_by_key(texts, materialize(spared, "spared"), ["host", "line"], ["text_key"]).select(*KEYS, "spared")


def _stays(doc_id: str, text_key: str) -> Column:
    """Whether a row joined with ``depleted_texts`` is the one of its group that stays."""
    return F.coalesce(F.col("spared").isNotNull() & F.col(doc_id).eqNullSafe(F.col("spared.doc_id")) & (F.col(text_key) == F.col("spared.text_key")), F.lit(False))


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, the counts of ``with_counts``, ``lost_words`` and ``kept`` for each row of ``docs``.

    Null text has no words and fails; repeated rows stay; a null host is the empty host; other
    columns are ignored; an empty table gives an empty result.
    """
    lost = materialize(lost_words(docs, host), "lost-words")
    gone = materialize(depleted_texts(docs, lost, host).withColumn("gone", F.lit(True)), "depleted-texts")
    keyed = docs.select("doc_id", host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "text")
    light = keyed.select(*KEYS)
    joined = join_by_key(with_counts(keyed).drop("text"), lost.select(*KEYS, F.col("lost").alias("lost_words")), KEYS, ["doc_id"], counted=light)
    joined = join_by_key(joined, gone, KEYS, ["doc_id"], counted=light).withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("gone").isNull() | _stays("doc_id", "text_key"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", kept.alias("kept"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and with all their columns, whatever their names.

    Nulls, repeated rows and empty tables as in ``verdicts``.
    """
    lost = materialize(lost_words(docs, host), "lost-words")
    gone = materialize(depleted_texts(docs, lost, host).withColumn("gone", F.lit(True)), "depleted-texts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, "doc_id", host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "text")
    counted = with_counts(keyed).where("NOT base_failed").select("row", "doc_id", *KEYS)
    joined = join_by_key(counted, gone, KEYS, ["doc_id"], counted=keyed.select(*KEYS))
    return joined.where(F.col("gone").isNull() | _stays("doc_id", "text_key")).select("row.*")


def clean_texts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` with ``clean_text``: the text without its boilerplate lines (null stays null).

    A column ``clean_text`` of ``docs`` is replaced, all others stay; a null host is the empty host;
    repeated rows stay; an empty table gives an empty result.
    """
    lines = materialize(document_lines(docs, host), "lines")
    salted = frequent_lines(lines).select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("text_key", "place"), F.lit(SALTS)).cast("int"))
    # The places of one text's own lines.
    gone = dealt.join(salted, ["host", "line", "salt"]).groupBy(*KEYS).agg(F.collect_set("place").alias("gone"))
    others = docs.drop("clean_text")
    row = F.struct(*[F.col(f"`{c}`") for c in others.columns]).alias("row")
    keyed = others.select(row, host_of(host).alias("host"), F.xxhash64("text").alias("text_key"), "doc_id")
    found = join_by_key(keyed, materialize(gone, "gone-lines"), KEYS, ["doc_id"], counted=keyed.select(*KEYS))
    left = r"CASE WHEN gone IS NULL THEN row.text ELSE array_join(filter(split(row.text, r'\n'), (l, i) -> NOT array_contains(gone, i)), '\n') END"
    return found.selectExpr("row.*", f"{left} AS clean_text")
