"""Line dedup of lines whose words are parted by other characters than the space."""

from __future__ import annotations

from brute import kept_lines

from docspark.llm.line_dedup import dedup_lines


def kept(spark, rows):
    return {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_white_space_parts_words(spark):
    words = [f"w{k}" for k in range(12)]
    line = " ".join(words)
    rows = [
        (1, line + "\nshort line of six words here"),
        (2, "\t".join(words)),
        (3, line + "\r\nother words that are not there"),
        (4, "\t" + "\v".join(words[:6]) + "\f" + " \t ".join(words[6:])),
        (5, "\tshort\tline of six words here\r\nlast line is not a copy"),
        (6, "\t".join([*words[:5], "new", *words[6:]])),
    ]
    assert kept(spark, rows) == {1: rows[0][1], 2: "", 3: "other words that are not there", 4: "", 5: "last line is not a copy", 6: ""}


def test_short_lines(spark):
    rows = [
        (1, "one two three four five\nLes.\n\nAll rights reserved.\na b c d"),
        (2, "one two other four five\nLes.\n\nAll rights reserved.\na b c x"),
        (3, "one two three four five six\nLes mots.\nAll rights"),
        (4, "two three four five six\none two three new four five six"),
        (5, "a b c d\nfive words of another line"),
    ]
    wanted = {1: rows[0][1], 2: "\na b c x", 3: "Les mots.\nAll rights", 4: "", 5: "five words of another line"}
    assert kept(spark, rows) == wanted
    assert {i: t for i, t in kept_lines(rows, 1, 5).items()} == wanted
