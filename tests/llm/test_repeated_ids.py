"""Rows of one doc_id with unlike texts: each component keeps a row."""

from ticketloom.llm import op3_simhash as op3


def test_one_of_each(spark):
    a, b = "one two three four five six seven", "a text that is quite another one, and longer"
    docs = spark.createDataFrame([(4, a), (9, a), (2, b), (4, b)], "doc_id long, text string")
    assert sorted(map(tuple, op3.one_of_each(docs).collect())) == [(2, b), (4, a)]
