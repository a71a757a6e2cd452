from strandlake.llm import quality

from . import brute


def test_lines_of_one_letter_and_of_form_feeds(spark):
    """A line of the letter f is a line with a word; a line of form feeds is not."""
    texts = ["f\nf\nx\nx\n\x0c\n\x0c", " f \n f \nff\nff", "\x0c\n\x0c\n\x0c\n\x0c", "a\x0c\na\x0c\n\x0bf\n\x0bf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.measured(docs).collect()}
    assert [got[i].n_dup_lines for i in range(4)] == [brute.quality(t)[3] for t in texts] == [2, 2, 0, 2]
    assert [got[i].n_lines for i in range(4)] == [4, 4, 0, 4]
