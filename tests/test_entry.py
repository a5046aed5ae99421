import importlib

import __spark_entry__ as entry


def test_entry_and_registration(spark):
    df = entry.entry(spark)
    assert "doc_id" in df.columns and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_import_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "quillon"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"quillon\.llm|from \.+llm|corpus_pipeline", p.read_text()), p
    importlib.reload(entry)
