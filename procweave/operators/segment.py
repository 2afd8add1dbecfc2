"""Document segmentation.

A document is one row holding its pages, so headings, sections and chunks are found inside the row:
nothing here shuffles text, and a scan of any size stays a map over its input splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procweave.functions import fixed
from procweave.functions.text import (
    col,
    heading_level,
    opens_semantic_group,
    or_blank,
    paragraphs,
    strip,
)
from procweave.operators.ordered import first_per_key, scan


def with_pages(documents: DataFrame, text: str) -> DataFrame:
    """Replace a text column by ``pages``: one (page, text) struct per form feed separated part."""
    pages = F.transform(
        F.split(or_blank(text), "\f"),
        lambda t, i: F.struct((i + 1).cast("int").alias("page"), t.alias("text")),
    )
    return documents.withColumn("pages", pages).drop(text)


def gather_pages(pages: DataFrame) -> DataFrame:
    """One row per document from (doc_id, page, text) rows."""
    return pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages")
    )


def page_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline("pages"))


def page_count(pages: Column | str = "pages") -> Column:
    return F.coalesce(F.array_max(F.transform(col(pages), lambda p: p["page"])), F.lit(0))


def _lines(pages: Column) -> Column:
    """Trimmed non-empty lines of all pages, each with its page and heading level."""
    per_page = F.transform(
        pages,
        lambda p: F.transform(
            F.filter(F.transform(F.split(p["text"], "\n"), strip), lambda x: x != ""),
            lambda line: F.struct(
                p["page"].alias("page"), line.alias("line"), heading_level(line).alias("level")
            ),
        ),
    )
    return F.flatten(per_page)


def heading_lines(documents: DataFrame) -> DataFrame:
    """Heading lines with their page, position among the lines and level."""
    lines = documents.select("doc_id", F.posexplode(_lines(F.col("pages"))).alias("pos", "l"))
    return lines.where("l.level IS NOT NULL").select(
        "doc_id", "pos", F.col("l.page").alias("page"), F.col("l.line").alias("heading"), F.col("l.level").alias("level")
    )


def _marked(documents: DataFrame) -> DataFrame:
    """Documents with their lines and headings; positions beside the headings make a section a slice between two of them."""
    # A one-element explode keeps a list from being worked out anew wherever it is used.
    once = lambda c: F.explode(F.array(c))
    staged = documents.select("doc_id", "pages", page_count().alias("page_count"), once(_lines(F.col("pages"))).alias("lines"))
    heads = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("at"), x["page"].alias("page"), x["line"].alias("line"), x["level"].alias("level"))),
        lambda h: h["level"].isNotNull(),
    )
    return staged.select("*", once(heads).alias("heads"))


def _heading_section(h: Column, k: Column) -> Column:
    # ``get`` gives null past the last heading.
    following = F.get(F.col("heads"), k + 1)
    end = F.coalesce(following["at"], F.size("lines"))
    content = F.array_join(
        F.transform(F.slice(F.col("lines"), h["at"] + 1, end - h["at"]), lambda x: F.concat(x["line"], F.lit("\n"))), ""
    )
    return F.struct(
        (k + 1).cast("int").alias("section_no"),
        h["line"].alias("heading"),
        h["level"].alias("level"),
        h["page"].alias("page_from"),
        F.coalesce(F.greatest(h["page"], following["page"] - 1), F.greatest(h["page"], F.col("page_count"))).alias("page_to"),
        content.alias("content"),
    )


def _whole_document() -> Column:
    return F.struct(
        F.lit(1).alias("section_no"),
        F.lit(fixed.WHOLE_DOCUMENT_HEADING).alias("heading"),
        F.lit(1).alias("level"),
        F.lit(1).alias("page_from"),
        F.size("pages").alias("page_to"),
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("content"),
    )


def heading_sections(documents: DataFrame) -> DataFrame:
    """A section per heading; lines before the first heading are dropped.

    The heading is also the first content line. ``page_to`` is the page before the next heading, but
    never before ``page_from``.
    """
    return _marked(documents).where(F.size("heads") > 0).select("doc_id", F.inline(F.transform("heads", _heading_section)))


def whole_document_sections(documents: DataFrame) -> DataFrame:
    """One section over all pages for each document in which no line is a heading."""
    has_heading = F.exists(_lines(F.col("pages")), lambda x: x["level"].isNotNull())
    return documents.where(~has_heading).select("doc_id", F.inline(F.array(_whole_document())))


def split_sections(documents: DataFrame) -> DataFrame:
    """Sections by heading, or the whole document where there is none; lines are split and tested once."""
    sections = F.when(F.size("heads") > 0, F.transform("heads", _heading_section)).otherwise(F.array(_whole_document()))
    return _marked(documents).select("doc_id", F.inline(sections))


def boundary_sections(documents: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Sections from given (doc_id, title, page_from, page_to) rows; empty ranges are dropped."""
    start = F.greatest(F.lit(1), F.col("page_from"))
    joined = (
        documents.join(boundaries, "doc_id")
        .withColumn("page_from", start.cast("int"))
        .withColumn("page_to", F.greatest(F.col("page_from"), F.col("page_to")).cast("int"))
        .withColumn("__last", F.least(F.col("page_to"), page_count()))
    )
    in_range = F.when(
        F.col("__last") >= F.col("page_from"),
        F.transform(
            F.sequence("page_from", "__last"),
            lambda n: F.coalesce(F.get(F.filter("pages", lambda p: p["page"] == n), F.lit(0))["text"], F.lit("")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    title = strip(or_blank("title"))
    return (
        joined.withColumn("content", strip(F.array_join(in_range, "\n\n")))
        .where(F.col("content") != "")
        .select(
            "doc_id",
            F.when(title == "", F.lit(fixed.BOUNDARY_HEADING)).otherwise(title).alias("heading"),
            F.lit(1).alias("level"),
            "page_from",
            "page_to",
            "content",
        )
    )


def choose_strategy(documents: DataFrame, headings: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per document: use heading sections or boundary sections."""
    h = headings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_heading"))
    b = boundaries.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_boundary"), F.min("page_from").alias("first_page"), F.max("page_to").alias("last_page")
    )
    pages = F.col("page_count")
    broad = (F.col("first_page") <= 1) & (F.col("last_page") >= F.greatest(F.lit(1), pages - 1))
    collapsed = (F.col("n_boundary") == 1) & (F.col("n_heading") >= 2) & (broad | (pages >= 6))
    joined = (
        documents.select("doc_id", page_count().alias("page_count")).join(h, "doc_id", "left").join(b, "doc_id", "left")
        .na.fill(0, ["n_heading", "n_boundary"])
    )
    strategy = (
        F.when(F.col("n_heading") == 0, "boundary")
        .when((F.col("n_boundary") == 0) | collapsed, "heading")
        .otherwise("boundary")
    )
    return joined.select("doc_id", "page_count", "n_heading", "n_boundary", strategy.alias("strategy"))


def choose_sections(documents: DataFrame, headings: DataFrame, boundaries: DataFrame) -> DataFrame:
    strategy = choose_strategy(documents, headings, boundaries).select("doc_id", "strategy")
    columns = ["doc_id", "heading", "level", "page_from", "page_to", "content"]
    both = (
        headings.select(*columns, F.lit("heading").alias("strategy"))
        .unionByName(boundaries.select(*columns, F.lit("boundary").alias("strategy")))
    )
    return both.join(strategy, ["doc_id", "strategy"], "left_semi")


def single_section(documents: DataFrame) -> DataFrame:
    """All pages of a document as one section; documents without text give none."""
    content = strip(F.array_join(F.transform("pages", lambda p: strip(p["text"])), "\n\n"))
    pages = F.transform("pages", lambda p: p["page"])
    return (
        documents.withColumn("content", content).where(F.col("content") != "").select(
            "doc_id",
            F.lit(fixed.SINGLE_SECTION_HEADING).alias("heading"),
            F.lit(1).alias("level"),
            F.array_min(pages).alias("page_from"),
            F.array_max(pages).alias("page_to"),
            "content",
        )
    )


_CHUNK_LIST = "array<struct<start:int,text:string>>"


def _tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.right(text, F.lit(n))).otherwise(text) if n > 0 else F.lit("")


def _fill(parts: Column, size: int, overlap: int | None) -> Column:
    """Greedy fill of paragraphs into chunks of about ``size`` characters.

    With an overlap, a chunk after the first starts with the end of the one before and a blank; the
    start offset counts characters of the chunk stream, where neighbours share the overlap. With
    ``None`` chunks are disjoint and start at 0.
    """
    zero = F.struct(
        F.array().cast(_CHUNK_LIST).alias("done"), F.lit("").alias("now"), F.lit(0).alias("start")
    )

    def close(acc: Column) -> Column:
        entry = F.array(F.struct(acc["start"].alias("start"), acc["now"].alias("text")))
        return F.when(acc["now"] != "", F.concat(acc["done"], entry)).otherwise(acc["done"])

    def step(acc: Column, part: Column) -> Column:
        full = F.length(acc["now"]) + F.length(part) > size
        if overlap is None:
            opened, start = part, F.lit(0)
        else:
            kept = _tail(acc["now"], overlap)
            opened = F.concat(kept, F.lit(" "), part)
            start = acc["start"] + F.length(acc["now"]) - F.length(kept)
        grown = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit("\n\n"), part))
        return F.struct(
            F.when(full, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(full, opened).otherwise(grown).alias("now"),
            F.when(full, start).otherwise(acc["start"]).alias("start"),
        )

    return F.aggregate(parts, zero, step, close)


def _as_chunks(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "page",
        F.col("chunk_no").cast("int").alias("chunk_no"),
        F.col("start").alias("span_start"),
        (F.col("start") + F.length("text")).alias("span_end"),
        "text",
        F.md5("text").alias("hash"),
    )


def chunk_fixed(
    documents: DataFrame,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separator: str = r"\n\s*\n",
) -> DataFrame:
    """Overlapping chunks, filled page by page; chunk numbers run through a page."""
    pages = page_rows(documents).where(strip("text") != "")
    chunks = pages.select("doc_id", "page", F.posexplode(_fill(paragraphs("text", separator), size, overlap)).alias("chunk_no", "c"))
    return _as_chunks(chunks.select("doc_id", "page", "chunk_no", "c.start", "c.text"))


def chunk_semantic(
    documents: DataFrame,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separator: str = r"\n\s*\n+",
) -> DataFrame:
    """Chunks that follow headings: paragraphs are grouped over the whole document, a heading closes
    a group of more than half the size, and groups over 1.5 times the size are filled anew."""
    parts = F.flatten(
        F.transform(
            "pages",
            lambda p: F.transform(
                paragraphs(p["text"], separator), lambda t: F.struct(p["page"].alias("page"), t.alias("text"))
            ),
        )
    )
    groups_type = "array<struct<page:int,text:string>>"
    first = F.struct(
        F.array().cast(groups_type).alias("done"), F.lit("").alias("now"), F.lit(0).alias("page")
    )

    def close(acc: Column) -> Column:
        entry = F.array(F.struct(acc["page"].alias("page"), acc["now"].alias("text")))
        return F.when(acc["now"] != "", F.concat(acc["done"], entry)).otherwise(acc["done"])

    def group(acc: Column, part: Column) -> Column:
        cut = opens_semantic_group(part["text"]) & (F.length(acc["now"]) > size * 0.5)
        grown = F.when(acc["now"] == "", part["text"]).otherwise(F.concat(acc["now"], F.lit("\n\n"), part["text"]))
        return F.struct(
            F.when(cut, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(cut, part["text"]).otherwise(grown).alias("now"),
            part["page"].cast("int").alias("page"),
        )

    groups = F.aggregate(parts, first, group, close)
    chunk_type = "array<struct<page:int,start:int,text:string>>"

    def emit(done: Column, g: Column) -> Column:
        oversize = F.transform(
            _fill(paragraphs(g["text"], r"\n\s*\n+"), size, None),
            lambda c: F.struct(g["page"].alias("page"), c["start"].alias("start"), c["text"].alias("text")),
        )
        previous = F.coalesce(F.try_element_at(done, F.lit(-1))["text"], F.lit(""))
        lead_in = _tail(previous, overlap)
        text = F.when(lead_in != "", F.concat(lead_in, F.lit("\n\n"), g["text"])).otherwise(g["text"])
        plain = F.array(F.struct(g["page"].alias("page"), F.lit(0).alias("start"), text.alias("text")))
        return F.concat(done, F.when(F.length(g["text"]) > size * 1.5, oversize).otherwise(plain).cast(chunk_type))

    chunks = F.aggregate(F.col("groups"), F.array().cast(chunk_type), emit)
    out = documents.select("doc_id", groups.alias("groups")).select("doc_id", F.posexplode(chunks).alias("chunk_no", "c"))
    return _as_chunks(out.select("doc_id", "c.page", "chunk_no", "c.start", "c.text"))


def chunk_stats(chunks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(F.length("text")).alias("avg_chars")
    )


def eligible_sections(sections: DataFrame, min_chars: int = fixed.MIN_SECTION_CHARS) -> DataFrame:
    return sections.where(F.length(strip("content")) >= min_chars)


def section_evidence_chunk(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the first chunk on the section's first page."""
    first = first_per_key(
        chunks.select("doc_id", F.col("page").alias("page_from"), "chunk_no", F.col("hash").alias("evidence_hash")),
        ["doc_id", "page_from"],
        ["chunk_no"],
    ).drop("chunk_no")
    return sections.join(first, ["doc_id", "page_from"], "left")


def first_mentions(names: DataFrame, scope: str = "scope") -> DataFrame:
    """Section in which each (scope, kind, name) occurs first: the context of every section, stored once."""
    return names.groupBy(scope, "kind", "name").agg(F.min("section_no").alias("first_section"))


def prior_context(sections: DataFrame, mentions: DataFrame, scope: str = "scope") -> DataFrame:
    """Names known before each given section, as rows."""
    return (
        sections.join(mentions, scope)
        .where(F.col("first_section") < F.col("section_no"))
        .select(*sections.columns, "kind", "name")
    )


def prior_counts(mentions: DataFrame, sections: DataFrame, scope: str = "scope") -> DataFrame:
    """Number of names known before each section, without listing them."""
    fresh = mentions.groupBy(scope, F.col("first_section").alias("section_no")).agg(F.count(F.lit(1)).alias("fresh"))
    joined = sections.join(fresh, [scope, "section_no"], "left").na.fill(0, ["fresh"])
    counted = scan(joined, [scope], ["section_no"], running={"known": F.col("fresh")})
    return counted.select(*sections.columns, (F.col("known") - F.col("fresh")).alias("n_prior"))
