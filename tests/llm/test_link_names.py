from tallow.llm.jaccard_join import Join


def test_links_do_not_read_as_the_whole_join():
    assert hasattr(Join, "joining_links") and not hasattr(Join, "links")
