"""Documents to lines, sections and candidate texts.  A document is (company, text); lines have line_no from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import select as S


def lines(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", most: int | None = None) -> DataFrame:
    """One row for each line (of the first most, if given): keys, line_no, line."""
    parts = F.split(F.col(text), "\n")
    return docs.select(*keys, F.posexplode(F.slice(parts, 1, most) if most else parts).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def contents(line_rows: DataFrame, keys: Sequence[str] = ("company",), most: int = 120) -> DataFrame:
    """Table of contents: entries of level-one headings, each once, in order of first sight (column entry_no from 1).

    Section headings first in a line's own order; listed items keep their mark and are indented by two spaces.
    """
    section = F.left(T.strip(F.regexp_extract("line", P.TOC_SECTION, 1)), F.lit(most))
    item = F.concat(F.lit("  "), F.left(T.strip(F.regexp_extract("line", P.TOC_ITEM, 1)), F.lit(most)))
    entry = F.when(F.col("line").rlike(P.TOC_SECTION), section).when(F.col("line").rlike(P.TOC_ITEM), item)
    order = [c for c in line_rows.columns if c not in (*keys, "line")]
    once = S.keep_first(line_rows.withColumn("entry", entry).where("entry is not null"), [*keys, "entry"], order)
    return once.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long").alias("entry_no"), "entry")


#: Marks of level one, section headings in running text, page marks: pattern and group of each tier.
TIERS = ((P.HEADING, 1), (P.HEADING_TEXT, 1), (P.HEADING_PAGE, 0))


def heading_tiers(line_rows: DataFrame, keys: Sequence[str] = ("company",), kinds: Sequence[tuple[str, int]] = TIERS) -> DataFrame:
    """line_rows with title: the heading that opens a section at this line, or null.

    Three tiers by company: level-one marks; if there are two or fewer, section headings in running text; if there
    are none of these, page marks.
    """
    marks, texts, pages = (F.when(F.col("line").rlike(p), T.strip(F.regexp_extract("line", p, g))) for p, g in kinds)
    counted = line_rows.select("*", marks.alias("_t1"), texts.alias("_t2"), pages.alias("_t3"))
    tiers = counted.groupBy(*keys).agg(F.count("_t1").alias("_n1"), F.count("_t2").alias("_n2"))
    tier = F.when(F.col("_n1") > 2, 1).when(F.col("_n2") > 0, 2).otherwise(3).cast("long")
    met = counted.join(tiers.select(*keys, tier.alias("tier")), list(keys))
    return met.withColumn("title", F.when(F.col("tier") == 1, F.col("_t1")).when(F.col("tier") == 2, F.col("_t2")).otherwise(F.col("_t3"))).drop("_t1", "_t2", "_t3")


def tiered_lines(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", kinds: Sequence[tuple[str, int]] = TIERS) -> DataFrame:
    """keys, line_no, line, tier and title of documents, one text a row: heading_tiers(lines(docs)) without a shuffle.

    The tier is chosen by counts over the array of a text's lines, before they become rows.  A null text has no lines.
    """
    split = docs.select(*keys, F.split(F.col(text), "\n").alias("_lines"))
    many = lambda i: F.size(F.filter("_lines", lambda x: x.rlike(kinds[i][0])))
    chosen = split.withColumn("tier", F.when(many(0) > 2, 1).when(many(1) > 0, 2).otherwise(3).cast("long"))
    each = chosen.select(*keys, "tier", F.posexplode("_lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    titles = [F.when((F.col("tier") == i) & F.col("line").rlike(p), T.strip(F.regexp_extract("line", p, g))) for i, (p, g) in enumerate(kinds, 1)]
    return each.withColumn("title", F.coalesce(*titles))


def sections(line_rows: DataFrame, keys: Sequence[str] = ("company",), opens: str = "title", order: Sequence[str] = ("line_no",), line: str = "line") -> DataFrame:
    """Sections: keys, section_id from 1, title, line_idx, content (lines from the heading to the next, stripped), length.

    Lines before the first heading belong to no section.
    """
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = line_rows.withColumn("section_id", F.count(opens).over(over)).where("section_id > 0")
    body = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    out = numbered.groupBy(*keys, "section_id").agg(F.min_by(F.col(opens), F.struct(*order)).alias("title"), F.min(order[-1]).alias("line_idx"), F.array_join(F.transform(body, lambda x: x["_line"]), "\n").alias("content"))
    out = out.withColumn("content", T.strip(F.col("content")))
    return out.withColumn("length", F.length("content").cast("long"))


def carry_heading(line_rows: DataFrame, keys: Sequence[str] = ("company",)) -> DataFrame:
    """Lines that are no headings, with the heading last seen before them (column section)."""
    over = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    title = F.when(F.col("line").rlike(P.HEADING_ANY), T.strip(F.regexp_extract("line", P.HEADING_ANY, 1)))
    return line_rows.withColumn("section", F.last(title, ignorenulls=True).over(over)).where(~F.col("line").rlike(P.HEADING_ANY))


def locate(section_rows: DataFrame, words: Sequence[str] = P.SECTION_WORDS, least: int = 100) -> DataFrame:
    """Sections whose title matches a word (keyword_no: the first that does) and whose content is longer than least."""
    return section_rows.withColumn("keyword_no", T.rule_index(F.col("title"), words)).where(F.col("keyword_no").isNotNull() & (F.col("length") > least))


def _last_at(c: Column, pattern: str) -> Column:
    """Position (from 1) of the last match, or 0."""
    pieces = F.split(c, pattern, -1)
    tail = F.length(F.element_at(pieces, -1))
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.length(c) - tail - F.length(F.element_at(found, -1)) + 1).otherwise(0)


def _core_span(docs: DataFrame, text: str) -> DataFrame:
    """docs with _core (title, start, stop): the span around the first core pattern's first match, null without one."""
    whole = F.col(text)
    pattern_no = T.rule_index(whole, P.CORE_PATTERNS)
    at = F.coalesce(*[F.when(pattern_no == i, F.regexp_instr(whole, F.lit(p))) for i, p in enumerate(P.CORE_PATTERNS, 1)])
    hit = F.coalesce(*[F.when(pattern_no == i, F.regexp_extract(whole, p, 0)) for i, p in enumerate(P.CORE_PATTERNS, 1)])
    found = docs.withColumns({"_at": at, "_hit": hit})
    at, from_ = F.col("_at"), F.greatest(F.col("_at") - 5_000, F.lit(1))
    ahead = F.regexp_instr(F.substring(whole, at, F.lit(20_000)), F.lit(P.NEXT_SECTION))
    behind = _last_at(F.substring(whole, from_, at - from_), P.PREVIOUS_SECTION)
    found = found.withColumns({"_ahead": F.when(at.isNotNull(), ahead), "_behind": F.when(at.isNotNull(), behind)})
    start = F.when(F.col("_behind") > 0, from_ + F.col("_behind") - 1).otherwise(F.greatest(at - 500, F.lit(1)))
    stop = F.least(at + 15_000, F.when(F.col("_ahead") > 0, at + F.col("_ahead") - 1).otherwise(at + 15_000))
    span = F.struct(F.concat(F.lit("全文定位: "), F.left("_hit", F.lit(60))).alias("title"), start.alias("start"), stop.alias("stop"))
    return found.withColumn("_core", F.when(at.isNotNull(), span)).drop("_at", "_hit", "_ahead", "_behind")


def _word_span(docs: DataFrame, text: str, words: Sequence[str], before: int, after: int) -> DataFrame:
    """docs with _word (title, start, stop): the span around the first word that the text holds, null without one."""
    number = F.coalesce(*[F.when(F.col(text).contains(w), i) for i, w in enumerate(words)])
    found = docs.withColumn("_held", F.get(F.array(*[F.lit(w) for w in words]), number)).withColumn("_at", F.expr(f"locate(_held, {text})"))
    span = F.struct(F.concat(F.lit("全文搜索: "), F.col("_held")).alias("title"), F.greatest(F.col("_at") - before, F.lit(1)).alias("start"), (F.col("_at") + after).alias("stop"))
    return found.withColumn("_word", F.when(F.col("_held").isNotNull(), span)).drop("_held", "_at")


def _cut(text: Column, span: Column) -> Column:
    """title, line_idx, content and length of a span of a text."""
    head = F.left(text, span["start"] - 1)
    line = (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("long")
    content = T.strip(F.substring(text, span["start"], span["stop"] - span["start"]))
    return F.when(span.isNotNull(), F.struct(span["title"].alias("title"), line.alias("line_idx"), content.alias("content"), F.length(content).cast("long").alias("length")))


def _rows(found: DataFrame) -> DataFrame:
    """A row for each struct of _each that is not null.

    A filter on what an explode gives stays above it; one on the struct itself would be pushed to the scan, with all
    the searching in it once more.
    """
    others = [c for c in found.columns if c != "_each"]
    return found.select(*others, F.explode_outer("_each").alias("_s")).where("_s is not null").select(*others, "_s.*")


def locate_by_core(docs: DataFrame, least: int = 200) -> DataFrame:
    """Fallback one: company, title, line_idx, content, length around the first core pattern's first match.

    From 500 characters before to 15 000 after it, cut to the next section heading within 20 000 and begun at the
    nearest section heading within 5 000 before.
    """
    found = _core_span(docs.select("company", "text"), "text")
    return _rows(found.select("company", F.array(_cut(F.col("text"), F.col("_core"))).alias("_each"))).where(F.col("length") > least)


def locate_by_word(docs: DataFrame, words: Sequence[str] = P.FALLBACK_WORDS, before: int = 200, after: int = 2_000) -> DataFrame:
    """Fallback two: the text around the first word that the document holds."""
    found = _word_span(docs.select("company", "text"), "text", words, before, after)
    return _rows(found.select("company", F.array(_cut(F.col("text"), F.col("_word"))).alias("_each")))


def sections_of(docs: DataFrame, text: str = "text", kinds: Sequence[tuple[str, int]] = TIERS) -> DataFrame:
    """docs with _sections (title, line_idx, content, length): sections(tiered_lines(docs)) inside each row, without a shuffle."""
    lines_, titles, starts = F.col("_lines"), F.col("_titles"), F.col("_starts")
    title = lambda i: F.transform(lines_, lambda x: F.when(x.rlike(kinds[i][0]), T.strip(F.regexp_extract(x, kinds[i][0], kinds[i][1]))))
    many = lambda i: F.size(F.filter(lines_, lambda x: x.rlike(kinds[i][0])))
    split = docs.withColumn("_lines", F.split(text, "\n"))
    split = split.withColumn("_titles", F.when(many(0) > 2, title(0)).when(many(1) > 0, title(1)).otherwise(title(2)))
    split = split.withColumn("_starts", F.filter(F.transform(titles, lambda t, i: F.when(t.isNotNull(), i)), lambda i: i.isNotNull()))
    content = lambda s, k: T.strip(F.array_join(F.slice(lines_, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines_)) - s), "\n"))
    parts = F.transform(starts, lambda s, k: F.struct(F.get(titles, s).alias("title"), s.cast("long").alias("line_idx"), content(s, k).alias("content")))
    with_length = F.transform(parts, lambda p: F.struct(p["title"], p["line_idx"], p["content"], F.length(p["content"]).cast("long").alias("length")))
    return split.withColumn("_sections", with_length).drop("_lines", "_titles", "_starts")


def locate_all(docs: DataFrame, words: Sequence[str] = P.SECTION_WORDS_BATCH, core_least: int = 200, fallback_words: Sequence[str] = P.FALLBACK_WORDS, kinds: Sequence[tuple[str, int]] = TIERS, least: int = 100) -> DataFrame:
    """Sections by title; for documents without one by fallback one; for those still without by fallback two.

    docs has one row for each company (as company_texts gives), so the row itself tells which way is left for
    it: one scan, no exchange, and a text is searched by a later way only where the ways before it found nothing.
    A null text has no section.
    """
    found = sections_of(docs.select("company", "text"), "text", kinds)
    hits = F.filter("_sections", lambda s: T.rule_index(s["title"], words).isNotNull() & (s["length"] > least))
    found = found.select("company", "text", F.coalesce(hits, F.array().cast("array<struct<title: string, line_idx: long, content: string, length: long>>")).alias("_hits"))
    found = _core_span(found.withColumn("_rest", F.when(F.size("_hits") == 0, F.col("text"))), "_rest")
    found = found.withColumn("_by_core", _cut(F.col("_rest"), F.col("_core"))).withColumn("_by_core", F.when(F.col("_by_core.length") > core_least, F.col("_by_core")))
    found = _word_span(found.withColumn("_rest", F.when(F.col("_by_core").isNull(), F.col("_rest"))), "_rest", fallback_words, 200, 2_000)
    method = F.when(F.size("_hits") > 0, "title").when(F.col("_by_core").isNotNull(), "core").otherwise("word")
    each = F.when(F.size("_hits") > 0, F.col("_hits")).when(F.col("_by_core").isNotNull(), F.array("_by_core")).otherwise(F.array(_cut(F.col("_rest"), F.col("_word"))))
    return _rows(found.select("company", method.alias("method"), each.alias("_each"))).select("company", "title", "line_idx", "content", "length", "method")


def snippets(docs: DataFrame, words: Sequence[str] = P.SNIPPET_WORDS, most: int = 3, ahead: int = 3_000, size: int = 2_000) -> DataFrame:
    """Up to most snippets of the first word that a document holds: company, nth from 1, pos from 0, snippet.

    A snippet begins at the line break before the word (within 2 000 characters) and ends at the next page mark
    past 100 characters, or ahead characters on; it is cut to size.
    """
    number = F.coalesce(*[F.when(F.col("text").contains(w), i) for i, w in enumerate(words)])
    found = docs.withColumn("word", F.get(F.array(*[F.lit(w) for w in words]), number)).where("word is not null")
    # Words are plain, so splitting by one gives the gaps between its places.
    gaps = F.expr("transform(slice(split(text, word, -1), 1, {0}), x -> length(x))".format(most))
    count = F.expr("least({0}, size(split(text, word, -1)) - 1)".format(most))
    starts = F.transform(F.sequence(F.lit(1), count), lambda i: F.aggregate(F.slice("gaps", 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * F.length("word"))
    each = found.withColumn("gaps", gaps).select("company", "text", F.posexplode(starts).alias("nth", "pos"))
    low = F.greatest(F.col("pos") - 2_000, F.lit(0))
    back = F.substring("text", low + 1, F.col("pos") - low)
    line = F.length(back) - F.expr("locate('\n', reverse(substring(text, greatest(pos - 2000, 0) + 1, pos - greatest(pos - 2000, 0))))")
    start = F.when(back.contains("\n"), low + line).otherwise(0)
    page = F.expr("locate('## 第', text, pos + 101)") - 1
    end = F.least(F.when((page > 0) & (page < F.col("pos") + ahead), page).otherwise(F.col("pos") + ahead), F.length("text"))
    return each.select("company", (F.col("nth") + 1).cast("long").alias("nth"), F.col("pos").cast("long").alias("pos"), F.left(F.substring("text", start + 1, end - start), F.lit(size)).alias("snippet"))


def line_context(line_rows: DataFrame, keys: Sequence[str], order: str, line: str, is_hit: Column, before: int = 2, after: int = 4, least: int = 50, most: int = 500) -> DataFrame:
    """Each line that is a hit with the lines around it, joined and cut: keys, order, context; short contexts go."""
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    context = F.array_join(F.collect_list(line).over(over), "\n")
    return line_rows.select(*keys, order, is_hit.alias("_hit"), context.alias("context")).where(F.col("_hit") & (F.length("context") > least)).select(*keys, order, F.left("context", F.lit(most)).alias("context"))


def event_segments(c: Column, ordinals: bool = True) -> Column:
    """Single line breaks joined, then cut before each year; with fewer than three pieces before ordinals as well (if ordinals).

    A piece in front that is empty counts, as a split with a look-ahead at the very start gives one.
    """
    joined = T.join_lines(c)
    years = F.split(joined, r"(?U)(?=\d{4}\s*[年.])")
    if not ordinals:
        return years
    both = F.split(joined, r"(?U)(?=(?:\d{4}\s*[年.]|(?:第[一二三四五六七八九十\d]+次)))")
    pieces = F.size(years) + F.when(joined.rlike(r"(?U)^\d{4}\s*[年.]"), 1).otherwise(0)
    return F.when(pieces < 3, both).otherwise(years)


def event_paragraphs(c: Column) -> Column:
    return F.split(c, r"(?U)\n(?=\d{4}[.年])")
