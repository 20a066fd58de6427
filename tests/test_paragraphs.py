"""Sections and paragraphs: each step once, in time that grows with the text."""

import time

from pitlens.operators import sections


def plain(text, least):
    out, said = [], ""
    for line in filter(None, (x.strip(" ") for x in text.split("\n"))):
        said += ("" if said == "" or said.endswith("\x01") else " ") + line + ("\x01" if line[-1] in '.?!"”’' else "")
    return [p for p in said.split("\x01") if len(p) >= least]


def test_paragraphs_end_where_a_line_ends_a_sentence(spark):
    texts = ["one\n two.\n\nthree\nfour", "a.", "a\x01\nb. \n c", "", " \n ", "x\ny!\n\"z\"\nend "]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, section string")
    got = {r.id: r.p for r in d.selectExpr("id", f"{sections.split_paragraphs('section', 1)} AS p").collect()}
    assert got == {k: plain(t, 1) for k, t in enumerate(texts)}


def test_a_text_of_many_lines_costs_its_length(spark):
    text = "Item 1A. Risk\n" + "no sentence ends here\n" * 30_000 + "Item 2. Properties"
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    begun = time.time()
    r = sections.extract_section(d, "1A").filter("section IS NOT NULL").selectExpr(f"{sections.split_paragraphs('section')} AS p").first()
    assert [len(p) for p in r.p] == [22 * 30_000 - 1] and time.time() - begun < 15
