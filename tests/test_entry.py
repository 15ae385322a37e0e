import ast
from pathlib import Path

import __spark_entry__ as entry_point

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_phenotypes(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and {"phenotype", "n"} <= set(rows[0].asDict())


def test_every_oracle_has_its_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_outside_imports_the_training_data_operators():
    for path in (ROOT / "lumenlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or n == "corpus_pipeline" for n in names), path
