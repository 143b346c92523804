import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "rasterlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "rasterlake").parts:
            assert not re.search(r"rasterlake\.llm|from rasterlake import llm", path.read_text()), path
