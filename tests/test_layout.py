from collections import Counter
from pathlib import Path

import pytest

import trackloom

HERE, PACKAGE = Path(__file__).parent, Path(trackloom.__file__).parent


def test_no_two_test_files_share_a_name():
    assert [n for n, c in Counter(p.name for p in HERE.rglob("test_*.py")).items() if c > 1] == []


@pytest.mark.parametrize("path", sorted(PACKAGE.rglob("*.py")), ids=lambda p: str(p.relative_to(PACKAGE)))
def test_operators_leave_the_session_alone(path):
    assert "conf.set" not in path.read_text()
