import random
import re

from procweave.operators import segment


def _docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return segment.with_pages(spark.createDataFrame(rows, "doc_id int, text string"), "text")


def test_all_heading_forms_and_page_ranges(spark):
    text = "before\n# One\nx\n제 1 장 둘\f제 2 절 셋\n## Four\n1. Five\n1.1 six\n\f1.1.1 seven\nIV. eight\nB. nine\nlast"
    rows = segment.split_sections(_docs(spark, [text, "no heading\n\fhere"])).orderBy("doc_id", "section_no").collect()
    got = [(r.heading, r.level, r.page_from, r.page_to) for r in rows if r.doc_id == 0]
    assert got == [
        ("# One", 1, 1, 1), ("제 1 장 둘", 1, 1, 1), ("제 2 절 셋", 2, 2, 2), ("## Four", 2, 2, 2), ("1. Five", 1, 2, 2),
        ("1.1 six", 2, 2, 2), ("1.1.1 seven", 3, 3, 3), ("IV. eight", 1, 3, 3), ("B. nine", 2, 3, 3),
    ]
    assert rows[0].content == "# One\nx\n" and rows[8].content == "B. nine\nlast\n"
    whole = [r for r in rows if r.doc_id == 1]
    assert len(whole) == 1 and whole[0].heading == "Document Content" and (whole[0].page_from, whole[0].page_to) == (1, 2)


def _fill(parts, size, overlap):
    out, now = [], ""
    for p in parts:
        if len(now) + len(p) > size:
            if now:
                out.append(now)
            now = (now[-overlap:] if len(now) > overlap else now) + " " + p
        else:
            now += ("\n\n" if now else "") + p
    return out + ([now] if now else [])


def test_fixed_chunks_equal_a_plain_fill(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("w" * rng.randrange(1, 60) + str(i) for i in range(rng.randrange(1, 30))) for _ in range(20)] + ["x" * 300]
    got = {}
    for r in segment.chunk_fixed(_docs(spark, texts), size=100, overlap=20).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.span_end - r.span_start == len(r.text)
    for i, t in enumerate(texts):
        assert got[i] == _fill([p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()], 100, 20)
    assert got[20] == [" " + "x" * 300]  # a first paragraph over the size begins with a blank


def test_semantic_chunks_follow_headings(spark):
    text = "a" * 60 + "\n\n# H\nbody" + "\n\n" + "b" * 50 + "\n\n# K\n" + "c" * 90 + "\n\n" + "d" * 90
    chunks = [r.text for r in segment.chunk_semantic(_docs(spark, [text]), size=100, overlap=10).orderBy("chunk_no").collect()]
    assert chunks[0] == "a" * 60
    assert chunks[1] == "a" * 10 + "\n\n# H\nbody\n\n" + "b" * 50
    assert chunks[2:] == ["# K\n" + "c" * 90, "d" * 90]


def test_boundaries_are_clamped(spark):
    docs = _docs(spark, ["p1\fp2\f\fp4"])
    bounds = spark.createDataFrame([(0, " ", 0, 1), (0, "A", 3, 2), (0, "B", 2, 9)], "doc_id int, title string, page_from int, page_to int")
    got = {(r.heading, r.page_from, r.page_to, r.content) for r in segment.boundary_sections(docs, bounds).collect()}
    assert got == {("SOP", 1, 1, "p1"), ("B", 2, 9, "p2\n\n\n\np4")}
