import pytest
from oracle import same

from trackloom.llm import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, catalogue.queries()[name], SQL[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(catalogue.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
