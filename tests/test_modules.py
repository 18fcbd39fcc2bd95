import ast
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_module_constant_is_assigned_twice():
    for source in sorted((ROOT / "loomwork").rglob("*.py")):
        names = Counter(t.id for node in ast.parse(source.read_text()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name))
        assert [n for n, k in names.items() if k > 1] == [], source
