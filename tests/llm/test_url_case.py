"""Hosts of list keys have no case, paths have."""

import datetime as d

from scholia.llm.urlfilter import filter_urls


def test_a_listed_path_keeps_its_case(spark):
    day = d.date(2024, 1, 1)
    entries = spark.createDataFrame([("p", "Example.com/News", True, day)], "list string, key string, listed boolean, at date")
    urls = ["http://EXAMPLE.com/News", "http://example.com/News/x", "http://example.com/news"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    assert {r["page_id"]: (r["kept"], r["matched_key"]) for r in filter_urls(captures, entries).collect()} == {0: (False, "example.com/News"), 1: (False, "example.com/News"), 2: (True, None)}
