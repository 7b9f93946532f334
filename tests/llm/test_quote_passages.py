"""Quotes of parts of lines, and passages at other widths, are linked."""

FIRST = "The shipment left the harbour on Monday. Nobody signed the papers, which is odd. I disagree.\nCustoms will hold it for a week."
DATA = [
    (1, 0, FIRST),
    (1, 1, "> nobody signed the papers\nWho should have?"),  # part of a line
    (1, 2, "> The shipment left the\n> harbour on Monday. Nobody signed\n> the papers, which is odd.\nsee above"),  # re-wrapped
    (1, 3, "> I disagree. Customs will hold it for a week.\nyes"),  # line breaks joined
    (1, 4, "> I disagree.\nwhy"),  # a short sentence
    (1, 5, ">> nobody signed the papers\n> Who should have?\nthe clerk"),
    (1, 6, "> signed the\nthree words of a line"),  # fewer than a window
    (1, 7, "> the moon is made of cheese\nno"),
    (1, 8, "> Nobody signed the papers, which\n\n> is odd. I disagree.\nhm"),  # a blank line inside
    (2, 0, "Nobody signed the papers, which is odd."),
    (3, 0, "> nobody signed the papers"),  # said in other conversations only
    (4, 0, "one two\n> x\nthree four"),  # own words on both sides of a quote are no passage
    (4, 1, "> one two three four\nno"),
]


def test_partial_and_rewrapped_quotes(spark):
    from churnscope.llm.quotes import reply_ordered

    df = spark.createDataFrame([(c, t, "a", x) for c, t, x in DATA], "conv_id long, turn long, role string, text string")
    rows = reply_ordered(df.repartition(4)).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(DATA)
    assert [got[1, i].parent_turn for i in range(9)] == [None, 0, 0, 0, 0, 1, None, None, 0]
    assert [got[1, i].thread_turn for i in range(9)] == [0, 0, 0, 0, 0, 0, 6, 7, 0]
    assert [got[1, i].quoted_lines for i in range(9)] == [0, 1, 3, 1, 1, 2, 1, 1, 2]
    assert [got[1, i].unlinked_lines for i in range(9)] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    assert got[1, 5].depth == 2 and got[1, 2].text == "see above"
    assert got[3, 0].unlinked_lines == 1 and got[4, 1].parent_turn is None
