"""Code patterns: detectors over one syntax tree per file, as a table function, and native text rules.

A detector gets every node of its types once and yields (node, kind); the snippet is the lines of that node. All
detectors share one parse and one walk of the code without comments, whose lines they give; those of RAW share a parse
of the code as it is. A file rule gets a whole file and yields (start line, end line, kind, snippet).
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MATCHES = "blob_id string, pattern string, start_line int, end_line int, kind string, snippet string"
DETECTORS: dict[str, list[tuple[tuple[type, ...], Callable]]] = {}
#: name -> (whether it reads the code as it is, not without comments; rule of code and tree)
FILE_RULES: dict[str, tuple[bool, Callable]] = {}
#: Detectors that read the code as it is.
RAW = frozenset({"pep_584h", "pep_614", "pep_616h", "class_prefilter"})
#: Rules with a row for each occurrence, also where these are alike; others give equal rows once.
EACH = frozenset({"pep_515", "pep_584", "pep_584h", "pep_584h2", "pep_593h", "pep_614", "pep_709"})


def detector(name: str, *kinds: type):
    def add(f: Callable) -> Callable:
        DETECTORS.setdefault(name, []).append((kinds, f))
        return f

    return add


def file_rule(name: str, raw: bool) -> Callable:
    def add(f: Callable) -> Callable:
        FILE_RULES[name] = raw, f
        return f

    return add


def _first_line(node: ast.AST) -> ast.AST:
    """A node whose snippet is the first line of ``node`` alone."""
    return ast.Pass(lineno=node.lineno, end_lineno=node.lineno)


def _name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def _call(node: ast.Call, base: str, *names: str) -> bool:
    f = node.func
    return isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == base and f.attr in names


def _annotations(node: ast.AST) -> Iterator[ast.AST]:
    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        a = node.args
        yield from (x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x is not None and x.annotation)
        if node.returns:
            yield node.returns
    elif isinstance(node, ast.AnnAssign):
        yield node.annotation


DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
ANNOTATED = (*DEFS, ast.AnnAssign)


def _own_nodes(node: ast.AST) -> Iterator[ast.AST]:
    """What is inside a function, but not inside functions and classes within it."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, (*DEFS, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(x)


@detector("gh_111123", ast.Try)
def _global_in_except(node):
    for h in node.handlers:
        for g in (x for x in h.body if isinstance(x, ast.Global)):
            used = {x.id for part in (*node.body, *node.orelse) for x in ast.walk(part) if isinstance(x, ast.Name)}
            yield node, "error" if used & set(g.names) else "warning"


@detector("try_else", ast.Try)
def _try_else(node):
    if not (node.handlers and node.orelse):
        return
    declared = lambda body: {n for x in body if isinstance(x, ast.Global) for n in x.names}
    caught = declared([x for h in node.handlers for x in h.body])
    yield node, "block"
    if caught:
        yield node, "global_in_except"
    if caught & {x.id for part in node.orelse for x in ast.walk(part) if isinstance(x, ast.Name)}:
        yield node, "global_used_in_else"
    if declared(node.body):
        yield node, "global_in_try"
    if declared(node.orelse):
        yield node, "global_in_else"


@detector("gh_118216", ast.ImportFrom)
def _relative_future(node):
    if node.level and node.module == "__future__":
        yield node, ""


@detector("pep_468", ast.Call)
def _keyword_order(node):
    if any(k.arg is None and isinstance(k.value, ast.Name) for k in node.keywords):
        yield node, ""


@detector("pep_479", *DEFS)
def _stop_in_generator(node):
    own = list(_own_nodes(node))
    if any(isinstance(x, ast.Yield | ast.YieldFrom) for x in own):
        for x in own:
            if isinstance(x, ast.Raise) and isinstance(x.exc, ast.Name) and x.exc.id == "StopIteration":
                yield x, "raise"


@detector("pep_487", *DEFS)
def _class_hooks(node):
    if node.name in ("__init_subclass__", "__set_name__"):
        yield node, node.name


@detector("pep_495", ast.Attribute)
def _fold(node):
    if node.attr == "fold" and isinstance(node.value, ast.Name):
        yield node, "attribute"


@detector("pep_495", ast.Call)
def _fold_keyword(node):
    if any(k.arg == "fold" for k in node.keywords):
        yield node, "keyword"


@detector("pep_498", ast.JoinedStr)
def _fstring(node):
    yield node, ""


def _is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


@detector("pep_498v", ast.Call)
def _format(node):
    if isinstance(node.func, ast.Attribute) and node.func.attr == "format" and _is_text(node.func.value):
        yield node, "format"


@detector("pep_498v", ast.BinOp)
def _percent(node):
    if isinstance(node.op, ast.Mod) and _is_text(node.left):
        yield node, "percent"


@file_rule("pep_515", raw=False)
def _underscored(code, tree):
    lines = re.split("\r\n|[\r\n]", code)
    for x in ast.walk(tree):
        if isinstance(x, ast.Constant) and isinstance(x.value, int | float | complex):
            # columns count bytes
            if b"_" in lines[x.lineno - 1].encode()[x.col_offset : x.end_col_offset]:
                yield x.lineno, x.lineno, "", lines[x.lineno - 1]


@detector("pep_519", ast.ClassDef)
def _fspath_class(node):
    if any(isinstance(x, DEFS) and x.name == "__fspath__" for x in node.body):
        yield node, "class"


@detector("pep_519", ast.Call)
def _fspath_call(node):
    if _call(node, "os", "fspath"):
        yield node, "call"


@detector("pep_525", ast.AsyncFor)
def _async_for(node):
    yield node, "async for"


@detector("pep_525", ast.AsyncFunctionDef)
def _async_generator(node):
    if any(isinstance(x, ast.Yield) for x in _own_nodes(node)):
        yield node, "async generator"


@detector("pep_526", ast.AnnAssign)
def _annotated(node):
    yield node, ""


@detector("pep_530", ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
def _async_comprehension(node):
    if any(g.is_async for g in node.generators):
        yield node, ""


@detector("pep_553", ast.Call)
def _breakpoint(node):
    if isinstance(node.func, ast.Name) and node.func.id == "breakpoint":
        yield node, ""


@detector("pep_557", ast.ImportFrom)
def _dataclass_import(node):
    if node.module == "dataclasses":
        yield node, "import"


@detector("pep_557", ast.ClassDef)
def _dataclass(node):
    if any(isinstance(d, ast.Name) and d.id == "dataclass" for d in node.decorator_list):
        yield node, "class"


@detector("pep_562", ast.FunctionDef)
def _module_attributes(node):
    if node.name in ("__getattr__", "__dir__"):
        yield node, node.name


@detector("pep_563", ast.ImportFrom)
def _future_annotations(node):
    if node.module == "__future__" and any(a.name == "annotations" for a in node.names):
        yield node, "import"


@detector("pep_563", *ANNOTATED)
def _quoted_annotation(node):
    for a in _annotations(node):
        if isinstance(a, ast.Constant):
            yield a, "quoted"


@detector("pep_567", ast.Import, ast.ImportFrom)
def _context_import(node):
    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module]
    if {"contextvars", "asyncio"} & set(names):
        yield node, "import"


@detector("pep_567", ast.Assign)
def _context_var(node):
    if isinstance(node.value, ast.Call) and _name(node.value.func) == "ContextVar":
        yield node, "variable"


@detector("pep_570", *DEFS)
def _positional_only(node):
    if node.args.posonlyargs:
        yield node, ""


@detector("pep_572", ast.NamedExpr)
def _walrus(node):
    yield node, ""


@detector("pep_578", ast.Call)
def _audit(node):
    if _call(node, "sys", "audit", "addaudithook"):
        yield node, ""


@detector("pep_584", ast.Module)
def _dict_union(node):
    """T-22: one walk gathers names of dicts and operators; which operators join dicts is known at its end."""
    made: dict[str, list[ast.Assign]] = {}
    joined: list[ast.BinOp] = []
    for x in ast.walk(node):
        match x:
            case ast.Assign(targets=targets, value=ast.Dict()):
                for name in map(_name, (t for t in targets if isinstance(t, ast.Name))):
                    made.setdefault(name, []).append(x)
            case ast.BinOp(op=ast.BitOr()):
                joined.append(x)
    sides = lambda x: all(isinstance(s, ast.Dict) or isinstance(s, ast.Name) and s.id in made for s in (x.left, x.right))
    unions = [x for x in joined if sides(x)]
    yield from ((x, "union") for x in unions)
    if unions:
        yield from ((_first_line(x), "init") for own in made.values() for x in own)


GENERICS = frozenset({"List", "Dict", "Set", "FrozenSet", "Tuple", "Type", "Deque", "DefaultDict"})


@detector("pep_585", *ANNOTATED)
def _builtin_generic(node):
    for a in _annotations(node):
        for x in ast.walk(a):
            if isinstance(x, ast.Subscript) and isinstance(x.value, ast.Name) and x.value.id in {g.lower() for g in GENERICS}:
                yield x, "error"


@detector("pep_585", ast.ImportFrom)
def _typing_generic(node):
    if node.module == "typing" and GENERICS & {a.name for a in node.names}:
        yield node, "suggestion"


@detector("pep_585v", ast.FunctionDef, ast.AnnAssign)
def _legacy_generic(node):
    for a in _annotations(node):
        for x in ast.walk(a):
            if isinstance(x, ast.Subscript) and _name(x.value) in GENERICS:
                yield x, _name(x.value)


def _typing_name(name: str, *words: str):
    @detector(name, ast.ImportFrom)
    def imported(node):
        if node.module in ("typing", "typing_extensions") and set(words) & {a.name for a in node.names}:
            yield node, "import"

    @detector(name, *ANNOTATED)
    def annotated(node):
        for a in _annotations(node):
            if any(isinstance(x, ast.Subscript) and _name(x.value) in words for x in ast.walk(a)):
                yield a, "annotation"


_typing_name("pep_586", "Literal")
_typing_name("pep_593", "Annotated")


@detector("pep_593", ast.Assign)
def _annotated_alias(node):
    if isinstance(node.value, ast.Subscript) and isinstance(node.targets[0], ast.Name) and _name(node.value.value) == "Annotated":
        yield node, "assignment"


@detector("pep_589", ast.ImportFrom, ast.ClassDef, ast.Assign)
def _typed_dict(node):
    if isinstance(node, ast.ImportFrom):
        if any(a.name == "TypedDict" for a in node.names):
            yield node, "import"
    elif isinstance(node, ast.ClassDef):
        if any(_name(b) == "TypedDict" for b in node.bases):
            yield node, "class"
    elif isinstance(node.value, ast.Call) and _name(node.value.func) == "TypedDict":
        yield node, "call"


@detector("pep_616", ast.Call)
def _remove_affix(node):
    if isinstance(node.func, ast.Attribute) and node.func.attr in ("removeprefix", "removesuffix"):
        yield node, node.func.attr


@detector("pep_634", ast.Match)
def _match(node):
    yield node, ""


@detector("pep_655", ast.ImportFrom)
def _required_import(node):
    if {"Required", "NotRequired"} & {a.name for a in node.names}:
        yield node, "import"


@detector("pep_655", ast.ClassDef)
def _required_class(node):
    used = any(isinstance(x, ast.Subscript) and _name(x.value) in ("Required", "NotRequired") for x in ast.walk(node))
    if used and any(_name(b) == "TypedDict" for b in node.bases):
        yield node, "class"


COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp)


@dataclass
class _Function:
    """A function as one walk of its file finds it: where it stands, and what is anywhere within it."""

    node: ast.FunctionDef
    place: int
    around: _Function | None
    raises: bool = False
    inlines: bool = False

    def mark(self, what: str) -> None:
        """Sets a flag here and in all functions around, up to one that has it: each function is marked once."""
        own = self
        while own is not None and not getattr(own, what):
            setattr(own, what, True)
            own = own.around


@detector("pep_709", ast.Module)
def _inlined(tree):
    """T-31. A call within nested comprehensions counts for each; a function is traced if it comes after the first setup.

    Every node is visited once, breadth first, with the function around it and the number of comprehensions around it.
    """
    functions: list[_Function] = []
    calls: list[tuple[ast.Call, int]] = []
    setups: list[int] = []
    queue = deque([(tree, None, 0)])
    place = 0
    while queue:
        node, around, depth = queue.popleft()
        place += 1
        match node:
            case ast.FunctionDef():
                around = _Function(node, place, around)
                functions.append(around)
            case ast.ListComp() | ast.SetComp() | ast.DictComp():
                depth += 1
                if around:
                    around.mark("inlines")
            case ast.Raise() if around:
                around.mark("raises")
            case ast.Expr(value=ast.Call(func=ast.Attribute(attr="settrace" | "setprofile"))):
                setups.append(place)
                yield _first_line(node), "tracing/profiling setup"
            case ast.Call(func=ast.Name()) if depth:
                calls.append((node, depth))
            case ast.Call(func=ast.Attribute(attr="warn")):
                yield from ((_first_line(node), "stacklevel warnings") for k in node.keywords if k.arg == "stacklevel")
        queue.extend((child, around, depth) for child in ast.iter_child_nodes(node))
    raising = {f.node.name: f.raises for f in functions}  # of functions of one name, the last
    for call, depth in calls:
        if call.func.id == "locals":
            yield from [(_first_line(call), "locals() includes outer variables")] * depth
        if raising.get(call.func.id):
            yield from [(_first_line(call), "no dedicated frame in traceback")] * depth
    yield from ((_first_line(f.node), "tracing/profiling changes") for f in functions if setups and f.place > setups[0] and f.inlines)


def _stores(node: ast.For) -> list[ast.Subscript]:
    """Subscripts stored to in a loop over the pairs of items()."""
    pair = isinstance(node.target, ast.Tuple) and len(node.target.elts) == 2
    if pair and isinstance(node.iter, ast.Call) and isinstance(node.iter.func, ast.Attribute) and node.iter.func.attr == "items":
        return [x for x in ast.walk(node) if isinstance(x, ast.Subscript) and isinstance(x.ctx, ast.Store)]
    return []


def _is_update(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "update" and len(node.args) == 1


@detector("pep_584h", ast.Call, ast.For)
def _merged(node):
    """T-37. Its rule for unpacking can't match in the reference, since no key of a dict is starred."""
    if _is_update(node):
        yield node, "dict_update"
    elif isinstance(node, ast.For):
        for _ in _stores(node):
            yield node, "manual_items_loop"


@file_rule("pep_584h2", raw=True)
def _rewritten(code, tree):
    """T-38: the rewrite that is suggested, as the snippet; of a loop, into the last subscript it stores to."""
    for x in ast.walk(tree):
        if _is_update(x):
            yield x.lineno, x.end_lineno, "dict_update", f"{ast.unparse(x.func.value)} |= {ast.unparse(x.args[0])}"
        elif isinstance(x, ast.For) and (stores := _stores(x)):
            yield x.lineno, x.end_lineno, "manual_items_loop", f"{ast.unparse(stores[-1].value)} |= {ast.unparse(x.iter.func.value)}"


@detector("pep_614", *DEFS, ast.ClassDef)
def _decorator_expression(node):
    for d in node.decorator_list:
        if isinstance(d, ast.Subscript) or isinstance(d, ast.Call) and isinstance(d.func, ast.Subscript | ast.Call):
            yield d, type(d).__name__


@detector("pep_614", ast.Module)
def _decorator_name(node):
    """T-40: a function's decorator is a name whose last assignment in the walk is a subscript, attribute or call."""
    given = {x.targets[0].id: x.value for x in ast.walk(node) if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name)}
    for x in ast.walk(node):
        if isinstance(x, ast.FunctionDef):
            for d in x.decorator_list:
                if isinstance(d, ast.Name) and isinstance(given.get(d.id), ast.Subscript | ast.Attribute | ast.Call):
                    yield d, f"{x.name}: {d.id} from {type(given[d.id]).__name__}"


@detector("pep_616h", ast.If)
def _sliced_affix(node):
    """T-41: the only statement cuts a name at the side that is tested."""
    t = node.test
    if not (isinstance(t, ast.Call) and isinstance(t.func, ast.Attribute) and t.func.attr in ("startswith", "endswith") and len(node.body) == 1):
        return
    b = node.body[0]
    if not (isinstance(b, ast.Assign) and len(b.targets) == 1 and isinstance(b.targets[0], ast.Name) and isinstance(b.value, ast.Subscript)):
        return
    v = b.value
    if isinstance(v.value, ast.Name) and v.value.id == b.targets[0].id and isinstance(v.slice, ast.Slice):
        if t.func.attr == "startswith" and v.slice.lower and not v.slice.upper:
            yield node, "removeprefix"
        elif t.func.attr == "endswith" and v.slice.upper and not v.slice.lower:
            yield node, "removesuffix"


#: What a comment says of a value, as patterns, and the name of the metadata that this would be.
HINTS = [
    (re.compile(pattern, re.IGNORECASE), kind)
    for pattern, kind in (
        (r"\b(?:must be|should be|has to be|is|are)?\s*(positive|negative|non-negative|non-zero)", "range"),
        (r"\b(?:minimum|min|at least)\s+\d+", "min"),
        (r"\b(?:maximum|max|at most)\s+\d+", "max"),
        (r"\b(may be none|can be none)", "nullable"),
        (r"\bchoices?:?\s*\[.*?\]", "enum"),
        (r"\blength\s+(\d+)\s+(to|-)\s+(\d+)", "length_range"),
        (r"\b(regex|pattern)\b", "regex"),
        (r"\bunit\b:?\s*(seconds|kg|cm|ms)", "unit"),
        (r"\bdeprecated\b", "deprecated"),
    )
]
#: Lines between a hint and an annotation at most.
NEAR = 2


class _Annotations(ast.NodeVisitor):
    """Docstrings, and the annotations of functions and attributes, each with the line that it belongs to."""

    def __init__(self):
        self.docstrings: list[tuple[int, str]] = []
        self.places: list[tuple[int, str, str, ast.expr]] = []

    def generic_visit(self, node):
        if isinstance(node, (ast.Module, ast.ClassDef, *DEFS)):
            text = ast.get_docstring(node)
            if text:
                self.docstrings.append((getattr(node, "lineno", 1), text))
        super().generic_visit(node)

    def visit_FunctionDef(self, node):
        self.places += [(x.lineno, "argument", f"`{x.arg}` in `{node.name}`", x.annotation) for x in node.args.args if x.annotation is not None]
        if node.returns is not None:
            self.places.append((node.lineno, "return", f"return of `{node.name}`", node.returns))
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        named = node.target.id if isinstance(node.target, ast.Name) else None
        self.places.append((node.lineno, "attribute", f"attribute `{named}`", node.annotation))
        self.generic_visit(node)


def _comments(code: str) -> Iterator[tuple[int, str]]:
    """The comments of code whose line ends may be of any kind."""
    whole = re.sub("\r\n?", "\n", code)
    for token in tokenize.generate_tokens(io.StringIO(whole).readline):
        if token.type == tokenize.COMMENT:
            yield token.start[0], token.string.strip("# ")


@file_rule("pep_593h", raw=True)
def _annotated_hints(code, tree):
    """T-39: hints in comments and docstrings within NEAR lines of an annotation. Backslashes are doubled first.

    Hints are sorted by line, so that an annotation looks up those near it.
    """
    if "\\" in code:
        code = code.replace("\\", "\\\\")
        tree = ast.parse(code)
    seen = _Annotations()
    seen.visit(tree)
    hints = sorted((line, kind) for line, text in [*_comments(code), *seen.docstrings] for pattern, kind in HINTS if pattern.search(text.strip()))
    lines = [line for line, _ in hints]
    for at, kind, what, annotation in seen.places:
        near = hints[bisect_left(lines, at - NEAR) : bisect_right(lines, at + NEAR)]
        if near:
            shown = ast.unparse(annotation)
            yield from ((at, at, kind, f"{what}: Annotated[{shown}, {hint}=...]") for _, hint in near)


@detector("class_prefilter", ast.ClassDef)
def _value_class(node):
    if any(isinstance(x, DEFS) and x.name in ("__repr__", "__eq__") for x in node.body):
        yield node, ""


_QUOTED = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''", re.S)


def strip_comments(code: str) -> str:
    bare = re.sub(r"#.*", "", _QUOTED.sub("", code))
    return "\n".join(x for x in bare.split("\n") if x.strip())


def _parse(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def fault(code: str | None) -> str | None:
    """Why a file can't be looked at: ``syntax`` or ``depth``; None where it can. An empty one can."""
    try:
        ast.parse(code or "")
    except (RecursionError, MemoryError):
        return "depth"
    except (SyntaxError, ValueError) as e:
        return "depth" if "too many nested" in str(e) or "too complex" in str(e) else "syntax"
    return None


def names() -> frozenset[str]:
    """The patterns that there are detectors of."""
    return frozenset(DETECTORS) | frozenset(FILE_RULES)


def detect(code: str | None, patterns: frozenset[str] | None = None) -> list[tuple[str, int, int, str, str]]:
    """All matches in a file; none in one that can't be parsed or is nested too deep."""
    out: list[tuple[str, int, int, str, str]] = []
    bare = strip_comments(code or "")
    for raw, text in ((False, bare), (True, code or "")):
        tree = _parse(text)
        if tree is None:
            continue
        by_type: dict[type, list[tuple[str, Callable]]] = {}
        for name, own in DETECTORS.items():
            if (name in RAW) == raw and (patterns is None or name in patterns):
                for kinds, f in own:
                    for kind in kinds:
                        by_type.setdefault(kind, []).append((name, f))
        all_lines = re.split("\r\n|[\r\n]", text)
        for node in ast.walk(tree):
            for name, f in by_type.get(type(node), ()):
                try:
                    for at, kind in f(node):
                        start = getattr(at, "lineno", 1)
                        end = getattr(at, "end_lineno", None) or start
                        out.append((name, start, end, kind, "\n".join(all_lines[start - 1 : end])))
                except RecursionError:
                    continue
        for name, (own_raw, rule) in FILE_RULES.items():
            if own_raw == raw and (patterns is None or name in patterns):
                try:
                    out += [(name, *m) for m in rule(text, tree)]
                except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
                    continue
    return sorted([m for m in out if m[0] in EACH] + list({m for m in out if m[0] not in EACH}))


def find_patterns(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """T-01 to T-31, T-35 and T-37 to T-42 over (blob_id, content): one row per match, in long form.

    T-32 to T-34 and T-36 are column functions below.
    """
    wanted = frozenset(patterns) if patterns is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(blob, *m) for blob, code in zip(pdf["blob_id"], pdf["content"], strict=True) for m in detect(code, wanted)]
            yield pd.DataFrame(rows, columns=["blob_id", "pattern", "start_line", "end_line", "kind", "snippet"])

    return files.select(F.col("blob_id").cast("string").alias("blob_id"), "content").mapInPandas(run, MATCHES)


def find_patterns_counted(files: DataFrame, patterns: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """As ``find_patterns``, and what the one pass sees: ``files``, and those with a fault of ``syntax`` or ``depth``.

    The counts are there once an action has read the matches to their end.
    """
    wanted = frozenset(patterns) if patterns is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for blob, code in zip(pdf["blob_id"], pdf["content"], strict=True):
                rows.append((blob, None, None, None, fault(code), None))
                rows += [(blob, *m) for m in detect(code, wanted)]
            yield pd.DataFrame(rows, columns=["blob_id", "pattern", "start_line", "end_line", "kind", "snippet"]).astype({"start_line": "Int32", "end_line": "Int32"})

    seen, file = Observation(), F.col("pattern").isNull()
    rows = files.select(F.col("blob_id").cast("string").alias("blob_id"), "content").mapInPandas(run, MATCHES)
    count = lambda test: F.count(F.when(file & test, 1))
    counted = rows.observe(seen, count(F.lit(True)).alias("files"), count(F.col("kind") == "syntax").alias("syntax"), count(F.col("kind") == "depth").alias("depth"))
    return counted.where(~file), seen


def token_rules(line: Column) -> Column:
    """T-32, T-34: text rules of a line. Quoted strings don't count, nor lines of 500 characters or more."""
    bare = F.regexp_replace(line, "\"[^\"]*\"|'[^']*'", "")
    return F.array_compact(F.array(F.when(F.contains(line, F.lit(":=")), F.lit("walrus")), F.when((F.length(line) < 500) & bare.rlike("[A-Za-z0-9_]:=[A-Za-z0-9_]"), F.lit("walrus_strict"))))


def generic_class(line: Column) -> Column:
    """T-33: the header of a class with type parameters."""
    return line.rlike(r"class[ \t]+[A-Za-z0-9_]+[ \t]*\[[^\]]*\]:")


def unsafe_random(code: Column) -> Column:
    """T-36: a secret-like name is assigned from the random module, the secrets module isn't used, nor any call that is never for secrets."""
    safe = r"\bimport secrets\b|\bsecrets\.|\brandom\.(shuffle|seed|setstate|getstate)\b"
    return code.rlike(r"\brandom\b") & ~code.rlike(safe) & code.rlike(r"(?i)(password|token|secret|auth|otp|key)\s*=\s*[^\n]*?random\.")
