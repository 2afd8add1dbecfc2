"""Document segmentation queries (B) and the document scan (A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.functions.text import merge_unique_lines, or_blank, paragraphs
from procweave.operators import segment
from procweave.plans.base import query, sql_heading_level, sql_strip
from procweave.plans.readings import corpus, dialogue_pages, table

# Pages, lines and heading sections of `documents`, shared by several oracles.
_LINES = f"""
p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS text,
             generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents),
l0 AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw,
              generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM p),
l1 AS (SELECT doc_id, page, ln, {sql_strip('raw')} AS line FROM l0),
l AS (SELECT doc_id, page, line, {sql_heading_level('line')} AS level,
             row_number() OVER (PARTITION BY doc_id ORDER BY page, ln) - 1 AS pos FROM l1 WHERE line <> '')
"""
_SECTIONS = f"""
{_LINES},
s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM l),
last AS (SELECT doc_id, max(page) AS last_page FROM p GROUP BY doc_id),
hs AS (SELECT doc_id, sec, min_by(line, pos) AS heading, min_by(level, pos) AS level, min(page) AS page_from,
              string_agg(line || chr(10), '' ORDER BY pos) AS content
       FROM s WHERE sec > 0 GROUP BY doc_id, sec),
heading_sections AS (SELECT doc_id, CAST(sec AS INTEGER) AS section_no, heading, CAST(level AS INTEGER) AS level,
              CAST(page_from AS INTEGER) AS page_from,
              CAST(coalesce(greatest(page_from, lead(page_from) OVER (PARTITION BY doc_id ORDER BY sec) - 1),
                       greatest(page_from, last_page)) AS INTEGER) AS page_to, content
       FROM hs JOIN last USING (doc_id)),
whole_sections AS (SELECT doc_id, 1 AS section_no, 'Document Content' AS heading, 1 AS level, 1 AS page_from,
              CAST(len(string_split(text, chr(12))) AS INTEGER) AS page_to,
              array_to_string(string_split(text, chr(12)), chr(10)) AS content
       FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM heading_sections)),
sections AS (SELECT * FROM heading_sections UNION ALL SELECT * FROM whole_sections)
"""
_SECTION_OUT = "doc_id, section_no, heading, level, page_from, page_to, md5(content) AS content_hash"

# Paragraph fold of `documents` with single line breaks as separators.
_FOLD = f"""
p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS text,
             generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents),
q0 AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw,
              generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM p),
para AS (SELECT doc_id, page, {sql_strip('raw')} AS part, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS n
         FROM q0 WHERE {sql_strip('raw')} <> ''),
f AS (
  SELECT doc_id, page, n, 0::BIGINT AS start, CASE WHEN length(part) > 1000 THEN ' ' || part ELSE part END AS now,
         NULL::VARCHAR AS emit, NULL::BIGINT AS emit_start
  FROM para WHERE n = 1
  UNION ALL
  SELECT f.doc_id, f.page, q.n,
         CASE WHEN length(now) + length(part) > 1000 THEN start + length(now) - least(200, length(now)) ELSE start END,
         CASE WHEN length(now) + length(part) > 1000 THEN right(now, 200) || ' ' || part ELSE now || chr(10) || chr(10) || part END,
         CASE WHEN length(now) + length(part) > 1000 THEN now END,
         CASE WHEN length(now) + length(part) > 1000 THEN start END
  FROM f JOIN para q ON q.doc_id = f.doc_id AND q.page = f.page AND q.n = f.n + 1),
cut AS (SELECT doc_id, page, n - 1 AS n, emit_start AS start, emit AS text FROM f WHERE emit IS NOT NULL
        UNION ALL
        SELECT doc_id, page, max(n), max_by(start, n), max_by(now, n) FROM f GROUP BY doc_id, page),
chunks AS (SELECT doc_id, CAST(page AS INTEGER) AS page,
                  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY n) - 1 AS INTEGER) AS chunk_no,
                  CAST(start AS INTEGER) AS span_start, CAST(start + length(text) AS INTEGER) AS span_end,
                  text, md5(text) AS hash FROM cut)
"""


def _chunks(spark, sf_dir):
    return segment.chunk_fixed(corpus(spark, sf_dir), separator="\n")


@query(
    "a1_read_documents",
    """SELECT doc_id, source, CAST(len(string_split(text, chr(12))) AS INTEGER) AS page_count,
              CAST(length(text) AS BIGINT) AS n_chars FROM documents""",
)
def a1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    paged = segment.with_pages(docs.withColumn("n_chars", F.length("text").cast("long")), "text")
    return paged.select("doc_id", "source", segment.page_count().alias("page_count"), "n_chars")


@query(
    "b1_merge_unique_lines",
    f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}),
                          lambda x: x <> '') AS base, lang, source FROM documents)
        SELECT doc_id, md5(array_to_string(list_concat(base,
                 list_filter([lang, source], lambda x: NOT list_contains(base, x))), chr(10))) AS merged_hash FROM d""",
)
def b1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    merged = merge_unique_lines("text", F.concat_ws("\n", "lang", "text", "source"))
    return docs.select("doc_id", F.md5(merged).alias("merged_hash"))


@query(
    "b2_detect_headings",
    f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(page AS INTEGER) AS page, line AS heading, level FROM l WHERE level IS NOT NULL",
)
def b2(spark, sf_dir):
    return segment.heading_lines(corpus(spark, sf_dir))


@query("b3_split_sections", f"WITH {_SECTIONS} SELECT {_SECTION_OUT} FROM sections")
def b3(spark, sf_dir):
    sections = segment.split_sections(corpus(spark, sf_dir))
    return sections.withColumn("content_hash", F.md5("content")).drop("content")


@query("b4_whole_document_section", f"WITH {_SECTIONS} SELECT {_SECTION_OUT} FROM whole_sections")
def b4(spark, sf_dir):
    sections = segment.whole_document_sections(corpus(spark, sf_dir))
    return sections.withColumn("content_hash", F.md5("content")).drop("content")


# Boundaries: an answer opens a boundary that reaches two turns on; user turns open blank-titled ones.
_BOUNDS = f"""
b AS (SELECT conv_id AS doc_id, CASE WHEN role = 'user' THEN ' ' ELSE role END AS title, CAST(turn AS INTEGER) AS page_from,
             CAST(turn + 3 AS INTEGER) AS page_to FROM conversations WHERE role <> 'system'),
c AS (SELECT doc_id, title, greatest(1, page_from) AS page_from, greatest(greatest(1, page_from), page_to) AS page_to FROM b),
r AS (SELECT c.*, n FROM c, LATERAL unnest(range(page_from, page_to + 1)) AS t(n)),
j AS (SELECT r.doc_id, title, page_from, page_to,
             {sql_strip("string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY n)")} AS content
      FROM r LEFT JOIN conversations v ON v.conv_id = r.doc_id AND v.turn + 1 = r.n
      GROUP BY r.doc_id, title, page_from, page_to),
bounds AS (SELECT doc_id, CASE WHEN trim(title) = '' THEN 'SOP' ELSE trim(title) END AS heading, 1 AS level, page_from, page_to, content
      FROM j WHERE content <> '')
"""


def _boundaries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return turns.select(
        F.col("conv_id").alias("doc_id"),
        F.when(F.col("role") == "user", " ").otherwise(F.col("role")).alias("title"),
        F.col("turn").cast("int").alias("page_from"),
        (F.col("turn") + 3).cast("int").alias("page_to"),
    )


@query(
    "b5_boundary_sections",
    f"WITH {_BOUNDS} SELECT doc_id, heading, level, page_from, page_to, md5(content) AS content_hash FROM bounds",
)
def b5(spark, sf_dir):
    sections = segment.boundary_sections(dialogue_pages(spark, sf_dir), _boundaries(spark, sf_dir))
    return sections.withColumn("content_hash", F.md5("content")).drop("content")


_TURN_HEADINGS = f"""
tl AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(string_split(text, chr(10))) AS raw FROM conversations),
th AS (SELECT doc_id, count({sql_heading_level(sql_strip('raw'))}) AS n FROM tl GROUP BY doc_id),
h AS (SELECT doc_id, greatest(n, 1) AS n_heading FROM th),
pc AS (SELECT conv_id AS doc_id, CAST(max(turn) + 1 AS INTEGER) AS page_count FROM conversations GROUP BY conv_id),
bb AS (SELECT doc_id, count(*) AS n_boundary, min(page_from) AS first_page, max(page_to) AS last_page FROM bounds GROUP BY doc_id),
strategy AS (SELECT doc_id, page_count, n_heading, coalesce(n_boundary, 0) AS n_boundary,
   CASE WHEN n_boundary IS NULL THEN 'heading'
        WHEN n_boundary = 1 AND n_heading >= 2 AND ((first_page <= 1 AND last_page >= greatest(1, page_count - 1)) OR page_count >= 6)
        THEN 'heading' ELSE 'boundary' END AS strategy
   FROM pc JOIN h USING (doc_id) LEFT JOIN bb USING (doc_id))
"""


@query("b6_choose_section_strategy", f"WITH {_BOUNDS}, {_TURN_HEADINGS} SELECT * FROM strategy")
def b6(spark, sf_dir):
    docs = dialogue_pages(spark, sf_dir)
    return segment.choose_strategy(
        docs, segment.split_sections(docs), segment.boundary_sections(docs, _boundaries(spark, sf_dir))
    )


@query(
    "b7_single_section",
    f"""WITH t AS (SELECT conv_id AS doc_id, min(turn) + 1 AS page_from, max(turn) + 1 AS page_to,
          {sql_strip(f"string_agg({sql_strip('text')}, chr(10) || chr(10) ORDER BY turn)")} AS content FROM conversations GROUP BY conv_id)
        SELECT doc_id, 'Forced Single Section' AS heading, 1 AS level, CAST(page_from AS INTEGER) AS page_from,
               CAST(page_to AS INTEGER) AS page_to, md5(content) AS content_hash FROM t WHERE content <> ''""",
)
def b7(spark, sf_dir):
    sections = segment.single_section(dialogue_pages(spark, sf_dir))
    return sections.withColumn("content_hash", F.md5("content")).drop("content")


@query(
    "b8_split_paragraphs",
    f"""WITH q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda x: {sql_strip('x')}),
              lambda x: x <> '') AS ps FROM documents)
        SELECT doc_id, CAST(generate_subscripts(ps, 1) AS INTEGER) AS para_no, md5(unnest(ps)) AS para_hash FROM q""",
)
def b8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(paragraphs("text", "\n")).alias("para_no", "part"))
    return parts.select("doc_id", (F.col("para_no") + 1).alias("para_no"), F.md5("part").alias("para_hash"))


@query(
    "b9_chunk_fixed",
    f"WITH RECURSIVE {_FOLD} SELECT doc_id, page, chunk_no, span_start, span_end, hash FROM chunks",
)
def b9(spark, sf_dir):
    return _chunks(spark, sf_dir).drop("text")


# Groups closed at headings, then oversize groups filled anew and the rest prefixed by the last tail.
_SEMANTIC = f"""
t AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM conversations),
para AS (SELECT doc_id, page, {sql_strip('raw')} AS part, row_number() OVER (PARTITION BY doc_id ORDER BY page, ln) AS n,
                regexp_matches({sql_strip('raw')}, '^제\\s*\\d+\\s*[장절]|^\\d+\\.\\s+[A-Z가-힣]|^#{{1,3}}\\s+') AS opens
         FROM t WHERE {sql_strip('raw')} <> ''),
g AS (
  SELECT doc_id, n, 1::BIGINT AS grp, page, part AS now FROM para WHERE n = 1
  UNION ALL
  SELECT g.doc_id, q.n, CASE WHEN opens AND length(now) > 200 THEN grp + 1 ELSE grp END, q.page,
         CASE WHEN opens AND length(now) > 200 THEN part ELSE now || chr(10) || chr(10) || part END
  FROM g JOIN para q ON q.doc_id = g.doc_id AND q.n = g.n + 1),
grp AS (SELECT doc_id, grp, max_by(page, n) AS page, max_by(now, n) AS text FROM g GROUP BY doc_id, grp),
op AS (SELECT doc_id, grp, page, unnest(regexp_split_to_array(text, '\\n\\s*\\n+')) AS part,
              generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n+'), 1) AS n FROM grp WHERE length(text) > 600),
o AS (
  SELECT doc_id, grp, page, n, part AS now, NULL::VARCHAR AS emit FROM op WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.grp, o.page, q.n,
         CASE WHEN length(now) + length(part) > 400 THEN part ELSE now || chr(10) || chr(10) || part END,
         CASE WHEN length(now) + length(part) > 400 THEN now END
  FROM o JOIN op q ON q.doc_id = o.doc_id AND q.grp = o.grp AND q.n = o.n + 1),
big AS (SELECT doc_id, grp, page, n - 1 AS n, emit AS text FROM o WHERE emit IS NOT NULL
        UNION ALL SELECT doc_id, grp, page, max(n), max_by(now, n) FROM o GROUP BY doc_id, grp, page),
tail AS (SELECT doc_id, grp, max_by(text, n) AS text FROM big GROUP BY doc_id, grp),
w AS (
  SELECT g.doc_id, g.grp, coalesce(b.text, g.text) AS text FROM grp g LEFT JOIN tail b USING (doc_id, grp) WHERE g.grp = 1
  UNION ALL
  SELECT g.doc_id, g.grp, coalesce(b.text, right(w.text, 50) || chr(10) || chr(10) || g.text)
  FROM w JOIN grp g ON g.doc_id = w.doc_id AND g.grp = w.grp + 1 LEFT JOIN tail b ON b.doc_id = g.doc_id AND b.grp = g.grp),
allc AS (SELECT doc_id, grp, page, n, text FROM big
         UNION ALL SELECT w.doc_id, w.grp, g.page, 0, w.text FROM w JOIN grp g USING (doc_id, grp) WHERE length(g.text) <= 600)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, n) - 1 AS INTEGER) AS chunk_no,
       CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS hash FROM allc
"""


@query("b10_chunk_semantic", f"WITH RECURSIVE {_SEMANTIC}")
def b10(spark, sf_dir):
    chunks = segment.chunk_semantic(dialogue_pages(spark, sf_dir), size=400, overlap=50, separator="\n")
    return chunks.select("doc_id", "page", "chunk_no", F.length("text").alias("n_chars"), "hash")


@query(
    "b11_chunk_identity",
    f"""WITH RECURSIVE {_FOLD} SELECT hash, count(*) AS n_chunks, min(doc_id) AS first_doc,
        CAST(max(length(text)) AS INTEGER) AS n_chars FROM chunks GROUP BY hash""",
)
def b11(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("doc_id").alias("first_doc"), F.max(F.length("text")).alias("n_chars")
    )


@query(
    "b12_chunk_stats",
    f"""WITH RECURSIVE {_FOLD} SELECT doc_id, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_chars FROM chunks GROUP BY doc_id""",
)
def b12(spark, sf_dir):
    stats = segment.chunk_stats(_chunks(spark, sf_dir))
    return stats.withColumn("avg_chars", F.round("avg_chars", 6))


@query(
    "b13_eligible_sections",
    f"WITH {_SECTIONS} SELECT doc_id, section_no, heading FROM sections WHERE length({sql_strip('content')}) >= 50",
)
def b13(spark, sf_dir):
    return segment.eligible_sections(segment.split_sections(corpus(spark, sf_dir))).select("doc_id", "section_no", "heading")


@query(
    "b14_section_evidence_chunk",
    f"""WITH RECURSIVE {_FOLD}, {_SECTIONS.replace('p AS', 'p2 AS', 1).replace('FROM p)', 'FROM p2)').replace('FROM p GROUP', 'FROM p2 GROUP')}
        SELECT s.doc_id, section_no, page_from, hash AS evidence_hash FROM sections s
        LEFT JOIN chunks c ON c.doc_id = s.doc_id AND c.page = s.page_from AND c.chunk_no = 0""",
)
def b14(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    found = segment.section_evidence_chunk(segment.split_sections(docs).drop("content"), _chunks(spark, sf_dir))
    return found.select("doc_id", "section_no", "page_from", "evidence_hash")


_MENTIONS = """
n AS (SELECT conv_id AS scope, turn AS section_no, 'role' AS kind, role AS name FROM conversations
      UNION ALL SELECT conv_id, turn, 'task', split_part(text, chr(10), 1) FROM conversations),
m AS (SELECT scope, kind, name, min(section_no) AS first_section FROM n GROUP BY scope, kind, name)
"""


def _named_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("section_no"), "role", "text")
    names = turns.select(
        "scope",
        "section_no",
        F.inline(
            F.array(
                F.struct(F.lit("role").alias("kind"), F.col("role").alias("name")),
                F.struct(F.lit("task").alias("kind"), F.substring_index(or_blank("text"), "\n", 1).alias("name")),
            )
        ),
    )
    return turns.select("scope", "section_no"), segment.first_mentions(names)


@query(
    "b15_prior_entity_context",
    f"""WITH {_MENTIONS} SELECT c.conv_id AS scope, c.turn AS section_no, kind, name FROM conversations c
        JOIN m ON m.scope = c.conv_id AND m.first_section < c.turn""",
)
def b15(spark, sf_dir):
    sections, mentions = _named_turns(spark, sf_dir)
    return segment.prior_context(sections, mentions)


@query(
    "b15_prior_counts",
    f"""WITH {_MENTIONS} SELECT c.conv_id AS scope, c.turn AS section_no, count(name) AS n_prior FROM conversations c
        LEFT JOIN m ON m.scope = c.conv_id AND m.first_section < c.turn GROUP BY ALL""",
)
def b15_counts(spark, sf_dir):
    sections, mentions = _named_turns(spark, sf_dir)
    return segment.prior_counts(mentions, sections)
