"""The driver's contract, with or without the language-model operators."""

import __spark_entry__


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["track", "frame", "event_id", "energy"]
    assert df.count() > 0


def test_names():
    names = __spark_entry__.queries()
    assert {"onset_percentile", "stability_median", "tempo_autocorrelation"} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_library_does_not_need_the_llm_package():
    import ast
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "loomtide"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
