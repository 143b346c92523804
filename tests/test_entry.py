import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_absent_libraries_leave_the_rest(monkeypatch):
    import importlib

    whole, real = set(entry.queries()), importlib.import_module

    def fail(name, *args):
        if name.startswith("rasterlake.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", fail)
    left = set(entry.queries())
    assert left and not any(n.startswith("op") for n in left) and "pipeline" not in left and left <= whole


def test_queries_have_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
