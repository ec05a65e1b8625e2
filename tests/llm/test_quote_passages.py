from callspark.llm.quote_links import format_conversations

FIRST = "The meter in the hall was read on Monday, and the bill that came does not fit it at all."


def test_rewrapped_joined_and_partial_quotes(spark):
    rows = [
        (1, 0, "user", FIRST),
        (1, 1, "assistant", "Something else\nis said here today."),
        (1, 2, "user", "> The meter in the hall was\n> read on Monday, and the bill that\n> came does not fit it at all.\nre-wrapped"),
        (1, 3, "user", "> something else is said here today.\njoined"),
        (1, 4, "user", "> > READ  on Monday, and the bill\npart"),
        (1, 5, "user", "> nobody ever said any of this here\n> yes\nnot said"),
        (2, 0, "user", "one two three four five"),
        (2, 1, "user", "> four five\n> said by none\nshort"),
        (2, 2, "user", "> two three four\nwhole"),
        (2, 3, "user", "> read on Monday, and the bill\nof another conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in format_conversations(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0), (1, 1): (None, 0, 0), (1, 2): (0, 3, 3), (1, 3): (1, 1, 1), (1, 4): (0, 1, 1), (1, 5): (None, 2, 0),
        (2, 0): (None, 0, 0), (2, 1): (None, 2, 0), (2, 2): (0, 1, 1), (2, 3): (None, 1, 0),
    }
