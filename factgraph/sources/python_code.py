"""Structure of sources: symbols, imports, calls and key accesses, with byte spans; Python by its own parser.

``parse`` reads every language that has a reader.  A call whose receiver is no chain of names is written ``?.name``.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.sources import brace_code

SCHEMA = "path_key string, record string, name string, qualified_name string, kind string, start_byte long, end_byte long"
_NAMES = ["path_key", "record", "name", "qualified_name", "kind", "start_byte", "end_byte"]
#: Calls and subscripts that read a key.
KEY_CALLS = {"os.getenv", "os.environ.get"}
KEY_SUBSCRIPTS = {"os.environ"}


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def records(path: str, raw: bytes) -> list[tuple]:
    """Rows of one file: a STATUS row, then SYMBOL, IMPORT, CALL and KEY rows in order of the source."""
    try:
        tree = ast.parse(raw)
    except (SyntaxError, ValueError):
        return [(path, "STATUS", "", "", "PARTIAL", 0, len(raw))]
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = [(path, "STATUS", "", "", "COMPLETE", 0, len(raw))]

    def span(node: ast.AST) -> tuple[int, int]:
        return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset

    def bound(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> None:
        """Names that a statement outside functions binds."""
        targets = node.targets if isinstance(node, ast.Assign) else [node.name] if isinstance(node, ast.TypeAlias) else [node.target]
        kind = "TYPE_ALIAS" if isinstance(node, ast.TypeAlias) else "FIELD" if in_class else "CONSTANT"
        out.extend((path, "SYMBOL", t.id, ".".join((*scope, t.id)), kind, *span(node)) for t in targets if isinstance(t, ast.Name))

    def visit(node: ast.AST, scope: tuple[str, ...], in_class: bool, local: bool = False) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = (*scope, child.name)
                is_class = isinstance(child, ast.ClassDef)
                out.append((path, "SYMBOL", child.name, ".".join(own), "CLASS" if is_class else "METHOD" if in_class else "FUNCTION", *span(child)))
                visit(child, own, is_class, local or not is_class)
                continue
            if isinstance(child, ast.TypeAlias) or (isinstance(child, (ast.Assign, ast.AnnAssign)) and not local):
                bound(child, scope, in_class)
            if isinstance(child, ast.Import):
                out.extend((path, "IMPORT", a.asname or a.name, a.name, "MODULE", *span(child)) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out.extend((path, "IMPORT", a.asname or a.name, f"{module}:{a.name}", "MEMBER", *span(child)) for a in child.names)
            elif isinstance(child, ast.Call) and (name := dotted(child.func) or (f"?.{child.func.attr}" if isinstance(child.func, ast.Attribute) else None)):
                if name in KEY_CALLS:
                    key = child.args[0] if child.args else None
                    literal = isinstance(key, ast.Constant) and isinstance(key.value, str)
                    out.append((path, "KEY", key.value if literal else "", name, "LITERAL" if literal else "DYNAMIC", *span(child)))
                else:
                    out.append((path, "CALL", name.rpartition(".")[2], name, ".".join(scope), *span(child)))
            elif isinstance(child, ast.Subscript) and dotted(child.value) in KEY_SUBSCRIPTS:
                literal = isinstance(child.slice, ast.Constant) and isinstance(child.slice.value, str)
                out.append((path, "KEY", child.slice.value if literal else "", dotted(child.value), "LITERAL" if literal else "DYNAMIC", *span(child)))
            visit(child, scope, in_class and not isinstance(child, ast.expr), local)

    visit(tree, (), False)
    return out


def records_of(path: str, raw: bytes | None, language: str | None) -> list[tuple]:
    """Rows of a file of any language: UNSUPPORTED without a reader, PARTIAL without content."""
    if language not in ("PYTHON", "RUST", "CSHARP", "JAVASCRIPT", "TYPESCRIPT", "SVELTE"):
        return [(path, "STATUS", "", "", "UNSUPPORTED", 0, len(raw or b""))]
    if raw is None:
        return [(path, "STATUS", "", "", "PARTIAL", 0, 0)]
    try:
        return records(path, raw) if language == "PYTHON" else brace_code.records(path, raw, language)
    except RecursionError:  # nested deeper than a reader follows
        return [(path, "STATUS", "", "", "PARTIAL", 0, len(raw))]


def parse(files: DataFrame) -> DataFrame:
    """Records of all files (path_key, language, content binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (batch.column(c).to_pylist() for c in ("path_key", "language", "content"))
            rows = [x for path, language, raw in zip(*cells, strict=True) for x in records_of(path, raw, language)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k > 4 else pa.string()) for k, c in enumerate(columns)], _NAMES)

    return files.select("path_key", "language", "content").mapInArrow(run, SCHEMA)


def parse_python(files: DataFrame) -> DataFrame:
    """Records of Python files (path_key, content binary)."""
    return parse(files.withColumn("language", F.lit("PYTHON")))
