import __spark_entry__ as entry


def test_every_numbered_query_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(entry.oracle_sql()) <= set(names)
