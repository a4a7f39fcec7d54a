"""Syntax facts of Python files: one parse per file, in Arrow batches; everything after is joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_METRICS = "struct<loc:int,cyclomatic_complexity:int,branch_count:int,call_count:int,assignment_count:int,return_count:int,raise_count:int,exception_handler_count:int,field_count:int,relationship_count:int>"
FACTS = (
    "rel_path string, parsed boolean, "
    f"defs array<struct<seq:int,kind:string,name:string,parent:string,line_start:int,line_end:int,bases:array<string>,decorators:array<string>,metrics:{_METRICS}>>, "
    "imports array<struct<seq:int,local:string,kind:string,module:string,symbol:string,level:int>>, "
    "relations array<struct<seq:int,owner:string,attribute:string,value:string>>, "
    "variables array<struct<seq:int,owner:string,variable:string,annotation:string,constructor:string>>, "
    "calls array<struct<seq:int,owner:string,parent:string,callee:string,receiver:string,constructor:string,method:string,line:int,model:string,text:string>>, "
    "all_imports array<string>, called array<string>, all_decorators array<string>"
)
# What counts as a branch and as a relation.
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert, ast.comprehension)
_RELATIONS = ("ForeignKey", "OneToOneField", "ManyToManyField", "relationship")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST | None) -> str | None:
    """``a.b.c`` of names and attributes; an attribute of anything else keeps its own part; else None."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


def _own(statements: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes in source order, without what lies in nested functions, classes and lambdas."""
    stack = list(reversed(statements))
    while stack:
        node = stack.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            continue
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def metrics(node: ast.AST) -> dict[str, int]:
    """Size and shape of one class, function or method, nested ones left out."""
    statements = [s for s in node.body if not (isinstance(node, ast.ClassDef) and isinstance(s, (*_FUNCTIONS, ast.ClassDef)))]
    n = dict.fromkeys(("branch", "call", "assignment", "return", "raise", "exception_handler", "field", "relationship"), 0)
    if isinstance(node, ast.ClassDef):
        n["field"] = sum(isinstance(s, (ast.Assign, ast.AnnAssign)) for s in statements)
    for x in _own(statements):
        n["branch"] += isinstance(x, _BRANCHES)
        n["exception_handler"] += isinstance(x, ast.ExceptHandler)
        n["assignment"] += isinstance(x, (ast.Assign, ast.AnnAssign, ast.AugAssign))
        n["return"] += isinstance(x, ast.Return)
        n["raise"] += isinstance(x, ast.Raise)
        if isinstance(x, ast.Call):
            n["call"] += 1
            n["relationship"] += (getattr(x.func, "id", None) or getattr(x.func, "attr", "")) in _RELATIONS
    loc = max(1, (node.end_lineno or node.lineno) - node.lineno + 1)
    return {"loc": loc, "cyclomatic_complexity": 1 + n["branch"] + n["exception_handler"], **{f"{k}_count": v for k, v in n.items()}}


def _model_name(func: ast.Attribute) -> str | None:
    if isinstance(func.value, ast.Name):
        return func.value.id
    if isinstance(func.value, ast.Attribute) and func.value.attr in ("objects", "query") and isinstance(func.value.value, ast.Name):
        return func.value.value.id
    return None


def facts(rel_path: str, content: str | None) -> dict:
    out: dict = {"rel_path": rel_path, "parsed": True, **{k: [] for k in ("defs", "imports", "relations", "variables", "calls", "all_imports", "called", "all_decorators")}}
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return out | {"parsed": False}
    seq = 0

    def tick() -> int:
        nonlocal seq
        seq += 1
        return seq

    def define(node, kind: str, parent: str) -> None:
        out["defs"].append({
            "seq": tick(), "kind": kind, "name": node.name, "parent": parent, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno,
            "bases": [ast.unparse(b) for b in node.bases] if kind == "class" else [], "decorators": [ast.unparse(d) for d in node.decorator_list], "metrics": metrics(node),
        })

    def body(node, parent: str) -> None:
        owner = f"{parent}.{node.name}" if parent else node.name
        args = node.args
        for a in (*args.posonlyargs, *args.args, *args.kwonlyargs):
            if a.annotation is not None:
                out["variables"].append({"seq": tick(), "owner": owner, "variable": a.arg, "annotation": _dotted(a.annotation), "constructor": None})
        for x in _own(node.body):
            if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                target, value, note = x.targets[0].id, x.value, None
            elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                target, value, note = x.target.id, x.value, x.annotation
            elif isinstance(x, ast.Call):
                f = x.func
                attribute = isinstance(f, ast.Attribute)
                made = isinstance(f.value, ast.Call) if attribute else False
                out["calls"].append({
                    "seq": tick(), "owner": owner, "parent": parent, "callee": _dotted(f) if attribute or isinstance(f, ast.Name) else None,
                    "receiver": _dotted(f.value) if attribute and isinstance(f.value, (ast.Name, ast.Attribute)) else None, "constructor": _dotted(f.value.func) if made else None,
                    "method": f.attr if attribute else None, "line": x.lineno, "model": _model_name(f) if attribute else None, "text": ast.unparse(x) if attribute else None,
                })
                continue
            else:
                continue
            made = _dotted(value.func) if isinstance(value, ast.Call) else None
            out["variables"].append({"seq": tick(), "owner": owner, "variable": target, "annotation": _dotted(note), "constructor": made})

    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out["imports"].append({"seq": tick(), "local": a.asname or a.name.split(".")[0], "kind": "module", "module": a.name, "symbol": None, "level": 0})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    out["imports"].append({"seq": tick(), "local": a.asname or a.name, "kind": "symbol", "module": node.module or "", "symbol": a.name, "level": node.level})
        elif isinstance(node, ast.ClassDef):
            define(node, "class", "")
            for s in node.body:
                if isinstance(s, ast.Assign) and isinstance(s.value, ast.Name):
                    for t in s.targets:
                        if isinstance(t, ast.Name) and t.id in ("model", "serializer_class"):
                            out["relations"].append({"seq": tick(), "owner": node.name, "attribute": t.id, "value": s.value.id})
            for s in node.body:
                if isinstance(s, _FUNCTIONS):
                    define(s, "method", node.name)
                    body(s, node.name)
        elif isinstance(node, _FUNCTIONS):
            define(node, "function", "")
            body(node, "")
    imports, called, decorators = set(), set(), set()
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            imports.update(a.name for a in x.names)
        elif isinstance(x, ast.ImportFrom) and x.module:
            imports.add(x.module)
        elif isinstance(x, ast.Call):
            called.add(getattr(x.func, "id", None) or getattr(x.func, "attr", None))
        elif isinstance(x, (*_FUNCTIONS, ast.ClassDef)):
            decorators.update(ast.unparse(d).split("(", 1)[0] for d in x.decorator_list)
    return out | {"all_imports": sorted(imports), "called": sorted(called - {None}), "all_decorators": sorted(decorators)}


def python_facts(files: DataFrame) -> DataFrame:
    """One row of facts per Python file (rel_path, content); files that do not parse have parsed = false and empty lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in ("rel_path", "parsed", "defs", "imports", "relations", "variables", "calls", "all_imports", "called", "all_decorators")]
        for batch in batches:
            yield pd.DataFrame([facts(p, c) for p, c in zip(batch["rel_path"], batch["content"], strict=True)], columns=columns)

    wanted = files.where("content IS NOT NULL AND content <> '' AND endswith(rel_path, '.py')").select("rel_path", "content")
    return wanted.mapInPandas(run, FACTS)
