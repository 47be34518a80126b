"""The BibTeX scan gives entries out as it goes, so a task holds few of them."""

from citeloom.sources import bibliography


def test_entries_are_given_out_before_more_are_read():
    read = []
    rows = (read.append(i) or ("a", 0, i, i, 0, "article", "raw", None, False, ["title"], [[{"name": False, "text": "x"}]]) for i in range(1000))
    batches = bibliography._given_out(rows, 100)
    assert next(batches).num_rows == 100 and len(read) == 100
    assert [b.num_rows for b in batches] == [100] * 9 and len(read) == 1000
