"""A file made of notices costs time in proportion to its length."""

import time

from factloom.llm import licenses


def test_a_file_of_notices_takes_time_in_proportion(spark):
    def took(n):
        docs = spark.createDataFrame([(1, "all rights reserved " * n)], "doc_id long, text string")
        start = time.time()
        r = licenses.scan(docs).first()
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (n, 0, 3 * n - 3, "reserved")
        return time.time() - start

    took(100)
    small, large = took(4000), took(32000)
    assert large < 20 * max(small, 1)      # eight times the words; told apart pair by pair it is 64 times
