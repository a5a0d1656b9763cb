import time

from folioscope.operators import layout

ITEM = "doc_id string, page int, item_ord int, str string, x double, y double, size double, width double"
LINE = layout.LINE


def lines(spark, items):
    data = [("d", 1, i, s, float(x), float(y), float(size), float(width or 5.5 * len(s))) for i, (s, x, y, size, width) in enumerate(items)]
    return layout.lines_from_items(spark.createDataFrame(data, ITEM)).orderBy("line_ord").collect()


def test_items_become_lines(spark):
    got = lines(spark, [("world", 80, 700, 11, None), ("Second", 50, 680, 11, None), ("Hello", 50, 701, 11, None), (" ", 60, 701, 11, None)])
    assert [r.text for r in got] == ["Hello world", "Second"]
    assert [r.text for r in lines(spark, [("Credit", 58, 500, 10, 30), ("$50,000", 175, 500, 10, 35)])] == ["Credit | $50,000"]
    assert [r.text for r in lines(spark, [("time  oﬀ", 50, 500, 11, None)])] == ["time off"]


def test_clusters_are_anchored_at_their_first_item(spark):
    got = lines(spark, [(c, 50, y, 11, None) for c, y in zip("abcd", (10, 8, 6, 4), strict=True)])
    assert len(got) == 2 and [r.y for r in got] == [10, 6]


def body(i, text, page=1, y=None, x=50.0, right=560.0, size=11.0):
    return ("d", page, i, float(700 - 16 * i if y is None else y), float(x), float(right), float(size), text)


def test_margins(spark):
    data = [body(i, f"line {i}", right=561) for i in range(30)] + [body(30 + i, f"box {i}", x=64, right=531) for i in range(30)]
    df = spark.createDataFrame(data, LINE)
    got = {r.indent: (r.margin, r.is_narrower) for r in layout.indent_margins(df).collect()}
    assert got == {50: (561.0, False), 64: (531.0, True)}
    few = spark.createDataFrame(data[:30] + data[30:35], LINE)
    assert not any(r.is_narrower for r in layout.indent_margins(few).collect())


def test_sections_of_blocks(spark):
    data = [
        body(0, "My document", size=22, y=780), body(1, "Time off", size=22, y=700),
        body(2, "contents/handbook/people/time-off.md", size=8.5, y=680), body(3, "First line of the text", y=650),
        body(4, "which goes on here.", y=634, right=200), body(5, "A heading", size=15, y=600, right=200),
        body(6, "one", x=80, y=570, right=120), body(7, "two", x=80, y=554, right=120), body(8, "1/2/25, 3:04 PM Some handbook", y=20),
        body(0, "1/2/25, 3:04 PM Some handbook", page=2, y=780), body(1, "An unfinished sentence that wraps to the margin and", page=2, y=700),
        body(2, "time off", size=22, page=2, y=600), body(3, "Last words", page=2, y=560),
    ]
    got = layout.section_blocks(spark.createDataFrame(data, LINE)).orderBy("block_ord").collect()
    assert [(r.kind, r.level, r.list_level, r.text) for r in got] == [
        ("paragraph", None, 0, "First line of the text which goes on here."), ("heading", 2, 0, "A heading"),
        ("paragraph", None, 1, "one"), ("paragraph", None, 1, "two"),
        ("paragraph", None, 0, "An unfinished sentence that wraps to the margin and"), ("paragraph", None, 0, "Last words"),
    ]
    assert {r.section_title for r in got} == {"Time off"} and layout.section_blocks(spark.createDataFrame([], LINE)).count() == 0


def test_continuation_across_pages(spark):
    start = [body(0, "T", size=22, y=700), body(1, "contents/handbook/a.md", size=8.5, y=680)]
    unfinished = [*start, body(2, "The sentence runs to the very margin of", y=40), body(0, "the next page.", page=2, y=700)]
    got = layout.section_blocks(spark.createDataFrame(unfinished, LINE)).orderBy("block_ord").collect()
    assert [(r.text, r.page, r.continued) for r in got][1] == ("the next page.", 2, True)
    finished = [*start, body(2, "The sentence ends at the margin.", y=40), body(0, "the next page.", page=2, y=700)]
    got = layout.section_blocks(spark.createDataFrame(finished, LINE)).orderBy("block_ord").collect()
    assert got[1].continued is None


def test_section_pages(spark):
    blocks = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), ("b", None), (None, 9)], "section_id string, page int")
    assert sorted(tuple(r) for r in layout.section_pages(blocks).collect()) == [("a", 1, 3), ("b", None, None)]


def test_long_texts_are_laid_out_in_linear_time(spark):
    words = [f"w{i}" for i in range(60_000)]
    blocks = [("s", 0, "heading", 2, None, "A  heading ", 1), ("s", 1, "paragraph", None, None, "\u00a0" + "  ".join(words), 1), ("s", 1, "paragraph", None, None, "\u00a0" + "  ".join(words), 1), ("s", 2, "paragraph", None, None, " \u3000", 1), ("gone", 0, "paragraph", None, None, "x", 1)]
    blocks = spark.createDataFrame(blocks, "section_id string, block_ord int, kind string, level int, list_level int, text string, page int")
    sections = spark.createDataFrame([("s", "T", "contents/handbook/t.md", 1)], "section_id string, title string, path string, start_page int")
    began = time.monotonic()
    got = layout.section_lines(sections, blocks).orderBy("page", "line_ord").collect()
    assert time.monotonic() - began < 60  # splitting the text again for every line took minutes
    assert [r.text for r in got[:3]] == ["T", "contents/handbook/t.md", "A heading"]
    assert [r.text for r in got[3:]] == [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]


def test_narrow_margins_reach_the_parser(spark):
    start = [body(0, "T", size=22, y=9000), body(1, "contents/handbook/a.md", size=8.5, y=8980)]
    # A box wraps at 531: its second line goes on with the first, though the page's margin is 600.
    wide = [body(2 + i, f"Line {i}.", y=8900 - 40 * i, right=600) for i in range(3)]
    box = [body(5 + i, "box text", x=64, y=8000 - 16 * i, right=531) for i in range(30)]
    got = layout.section_blocks(spark.createDataFrame([*start, *wide, *box], LINE)).orderBy("block_ord").collect()
    assert [r.text for r in got] == ["Line 0.", "Line 1.", "Line 2.", " ".join(["box text"] * 30)]
