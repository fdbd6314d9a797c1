"""Queries of the code detectors over snippets: every document stands for a file, whose code its id chooses.

The documents themselves are prose, in which no detector finds anything. A ``$`` in a snippet is the document's id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintloom.operators import patterns
from lintloom.plans.base import query
from lintloom.sources.scratch import Scratch

#: Code, and what is found in it: (pattern, first line, last line, kind) or, where the snippet isn't those lines, with it.
SNIPPETS: list[tuple[str, list[tuple]]] = [
    ("""try:
    x_$ = f()
except E:
    global x_$
try:
    y()
except E:
    z_$ = 1
try:
    y()
except E:
    global w""", [("gh_111123", 1, 4, "error"), ("gh_111123", 9, 12, "warning")]),
    ("""from .__future__ import a_$
from __future__ import annotations
from .other import b""", [("gh_118216", 1, 1, ""), ("pep_563", 2, 2, "import")]),
    ("""f_$(**kw)
f_$(**{'a': 1})
f_$(a=1)""", [("pep_468", 1, 1, "")]),
    ("""def g_$():
    yield 1
    raise StopIteration
def h_$():
    raise StopIteration""", [("pep_479", 3, 3, "raise")]),
    ("""class A_$:
    def __set_name__(self, o, n):
        pass
    def __init_subclass__(cls):
        pass
    def other(self):
        pass""", [("pep_487", 2, 3, "__set_name__"), ("pep_487", 4, 5, "__init_subclass__")]),
    ("""t_$.fold
f(fold=1)
a.b.fold""", [("pep_495", 1, 1, "attribute"), ("pep_495", 2, 2, "keyword")]),
    ("""s_$ = f'{x}'
t = 'x'""", [("pep_498", 1, 1, "")]),
    ("""a = '%s' % x_$
b = '{}'.format(x_$)
c = y.format(1)
d = 5 % 2""", [("pep_498v", 1, 1, "percent"), ("pep_498v", 2, 2, "format")]),
    ("""p_ = 1_000 + $
q_ = 1000""", [("pep_515", 1, 1, "")]),
    ("""class P_$:
    def __fspath__(self):
        return ''
os.fspath(p)
pathlib.fspath(p)""", [("pep_519", 1, 3, "class"), ("pep_519", 4, 4, "call")]),
    ("""async def g_$():
    async for x in y:
        yield x
async def h_$():
    return 1""", [("pep_525", 1, 3, "async generator"), ("pep_525", 2, 3, "async for")]),
    ("""x_$: int = 1
y = 1""", [("pep_526", 1, 1, "")]),
    ("""async def f_$():
    return [x async for x in y]
async def g_$():
    return [x for x in y]""", [("pep_530", 2, 2, "")]),
    ("""breakpoint()
pdb.set_trace($)""", [("pep_553", 1, 1, "")]),
    ("""from dataclasses import dataclass
@dataclass
class A_$:
    pass
@dataclass(frozen=True)
class B_$:
    pass""", [("pep_557", 1, 1, "import"), ("pep_557", 3, 4, "class")]),
    ("""def __getattr__(name):
    return $
def __dir__():
    return []
def other(name):
    return name""", [("pep_562", 1, 2, "__getattr__"), ("pep_562", 3, 4, "__dir__")]),
    ("""from __future__ import annotations
def f_$(x: 'int') -> 'str':
    pass
y: 'int' = 1
z: int = 2""", [("pep_563", 1, 1, "import"), ("pep_563", 2, 2, "quoted"), ("pep_563", 4, 4, "quoted"), ("pep_526", 4, 4, ""), ("pep_526", 5, 5, "")]),
    ("""import contextvars
import asyncio, os
v_$ = ContextVar('v')
w = contextvars.ContextVar('w')
import json""", [("pep_567", 1, 1, "import"), ("pep_567", 2, 2, "import"), ("pep_567", 3, 3, "variable"), ("pep_567", 4, 4, "variable")]),
    ("""def f_$(a, /, b):
    pass
def g(a, *, b):
    pass""", [("pep_570", 1, 2, "")]),
    ("""if (n_$ := 10) > 5:
    pass
n = 10""", [("pep_572", 1, 1, "")]),
    ("""sys.audit('e_$')
sys.addaudithook(h)
sys.exit()""", [("pep_578", 1, 1, ""), ("pep_578", 2, 2, "")]),
    ("""a_$ = {}
b_$ = {'k': 1}
c = a_$ | b_$
d = x | y""", [("pep_584", 1, 1, "init"), ("pep_584", 2, 2, "init"), ("pep_584", 3, 3, "union")]),
    ("""from typing import List, Any
def f_$(x: list[int]) -> dict[str, int]:
    pass
y: set = 1""", [("pep_585", 1, 1, "suggestion"), ("pep_585", 2, 2, "error"), ("pep_526", 4, 4, "")]),
    ("""def f_$(x: List[int], y: typing.Dict[str, int]):
    pass
async def g(x: List[int]):
    pass""", [("pep_585v", 1, 1, "List"), ("pep_585v", 1, 1, "Dict")]),
    ("""from typing import Literal
def f_$(x: Literal['a']):
    pass
from typing import Any""", [("pep_586", 1, 1, "import"), ("pep_586", 2, 2, "annotation")]),
    ("""from typing import TypedDict
class T_$(TypedDict):
    a: int
U = TypedDict('U', {})
class V(dict):
    pass""", [("pep_589", 1, 1, "import"), ("pep_589", 2, 3, "class"), ("pep_589", 4, 4, "call"), ("pep_526", 3, 3, "")]),
    ("""from typing_extensions import Annotated
def f_$(x: Annotated[int, 1]):
    pass
X = Annotated[int, 2]""", [("pep_593", 1, 1, "import"), ("pep_593", 2, 2, "annotation"), ("pep_593", 4, 4, "assignment")]),
    ("""x_$.removeprefix('a')
x.removesuffix('b')
x.strip('c')""", [("pep_616", 1, 1, "removeprefix"), ("pep_616", 2, 2, "removesuffix")]),
    ("""match x_$:
    case 1:
        pass
match = 1""", [("pep_634", 1, 3, "")]),
    ("""from typing import NotRequired
class T_$(TypedDict):
    a: NotRequired[int]
class U(TypedDict):
    b: int""", [("pep_655", 1, 1, "import"), ("pep_655", 2, 3, "class"), ("pep_589", 2, 3, "class"), ("pep_589", 4, 5, "class"), ("pep_526", 3, 3, ""), ("pep_526", 5, 5, "")]),
    ("""def f_$(y):
    return [locals() for x in y]
def g():
    raise E_$
def h():
    return [g() for x in y]
sys.settrace(f)
def j():
    return {x for x in y}
w.warn('a', stacklevel=2)
w.warn('b')""", [
        ("pep_709", 2, 2, "locals() includes outer variables"), ("pep_709", 6, 6, "no dedicated frame in traceback"), ("pep_709", 7, 7, "tracing/profiling setup"),
        ("pep_709", 8, 8, "tracing/profiling changes"), ("pep_709", 10, 10, "stacklevel warnings")]),
    ("""try:
    a_$ = 1
except E:
    global a_$
else:
    b = a_$
try:
    c()
finally:
    d()""", [("gh_111123", 1, 6, "error"), ("try_else", 1, 6, "block"), ("try_else", 1, 6, "global_in_except"), ("try_else", 1, 6, "global_used_in_else")]),
    ("""d_$.update(x)
for k, v in a.items():
    b_$[k] = v
for k in a.items():
    b_$[k] = 1""", [
        ("pep_584h", 1, 1, "dict_update"), ("pep_584h", 2, 3, "manual_items_loop"), ("pep_584h2", 1, 1, "dict_update", "d_$ |= x"), ("pep_584h2", 2, 3, "manual_items_loop", "b_$ |= a")]),
    ("""def f_$(a: int) -> str:  # must be positive
    pass
def g(a: int) -> str:
    pass""", [
        ("pep_593h", 1, 1, "argument", "`a` in `f_$`: Annotated[int, range=...]"), ("pep_593h", 1, 1, "return", "return of `f_$`: Annotated[str, range=...]"),
        ("pep_593h", 3, 3, "argument", "`a` in `g`: Annotated[int, range=...]"), ("pep_593h", 3, 3, "return", "return of `g`: Annotated[str, range=...]")]),
    ("""d_$ = b[0]
@d_$
def f():
    pass
g = h
@g
def i():
    pass""", [("pep_614", 2, 2, "f: d_$ from Subscript")]),
    ("""if x.startswith('a_$'):
    x = x[1:]
if x.endswith('a'):
    x = x[:-1]
if x.startswith('a'):
    y = x[1:]""", [("pep_616h", 1, 2, "removeprefix"), ("pep_616h", 3, 4, "removesuffix")]),
    ("""class A_$:
    def __eq__(self, o):
        pass
class B:
    def f(self):
        pass""", [("class_prefilter", 1, 3, "")]),
    ("def (", []),
]

#: Lines, and the text rules that hold for them.
LINES: list[tuple[str, list[str]]] = [
    ("n_$:=10", ["walrus", "walrus_strict"]),
    ("(n_$ := 10)", ["walrus"]),
    ("s = 'a:=b' + x_$", ["walrus"]),
    ("n_$ = 10", []),
    ("class A_$[T]:", ["generic"]),
    ("class A_$ [K, V]:", ["generic"]),
    ("class A_$(T):", []),
    ("token = random.random() + $", ["unsafe"]),
    ("api_key = f(random.choice(x_$))", ["unsafe"]),
    ("import secrets; token = random.random() + $", []),
    ("x_$ = random.random()", []),
]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chosen(key: Column, texts: list[str]) -> Column:
    """The text that an id chooses, with the id in it."""
    some = F.element_at(F.array(*(F.lit(x) for x in texts)), (F.pmod(key, F.lit(len(texts))) + 1).cast("int"))
    return F.replace(some, F.lit("$"), key.cast("string"))


def _expected() -> str:
    rows = []
    for i, (code, found) in enumerate(SNIPPETS):
        for name, start, end, kind, *snippet in found:
            text = snippet[0] if snippet else "\n".join((code if name in patterns.RAW else patterns.strip_comments(code)).split("\n")[start - 1 : end])
            rows.append(f"({i}, {_sql(name)}, {start}, {end}, {_sql(kind)}, {_sql(text)})")
    return ",\n".join(rows)


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS blob_id, e.pattern, CAST(e.start_line AS INTEGER) AS start_line, CAST(e.end_line AS INTEGER) AS end_line,
  replace(e.kind, '$', CAST(doc_id AS VARCHAR)) AS kind, replace(e.snippet, '$', CAST(doc_id AS VARCHAR)) AS snippet
FROM documents JOIN (VALUES {_expected()}) AS e(i, pattern, start_line, end_line, kind, snippet) ON e.i = doc_id % {len(SNIPPETS)}""")
def detector_snippets(t):
    """T-01 to T-31, T-35, T-37 to T-42, J-17: what each detector finds, and doesn't, in code of which that is known."""
    code = _chosen(F.col("doc_id"), [c for c, _ in SNIPPETS])
    return patterns.find_patterns(t.documents.select(F.col("doc_id").alias("blob_id"), code.alias("content")))


@query(f"""SELECT doc_id, e.rule FROM documents
  JOIN (VALUES {", ".join(f"({i}, {_sql(rule)})" for i, (_, rules) in enumerate(LINES) for rule in rules)}) AS e(i, rule) ON e.i = doc_id % {len(LINES)}""")
def text_rule_snippets(t):
    """T-32, T-33, T-34, T-36: the text rules over lines of which the answer is known."""
    line = F.col("line")
    rows = t.documents.select("doc_id", _chosen(F.col("doc_id"), [x for x, _ in LINES]).alias("line"))
    more = F.array(F.when(patterns.generic_class(line), "generic"), F.when(patterns.unsafe_random(line), "unsafe"))
    return rows.select("doc_id", F.explode(F.concat(patterns.token_rules(line), F.array_compact(more))).alias("rule"))


@query("""SELECT 'found' AS what, count(*) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'files', count(*) FROM documents
UNION ALL SELECT 'syntax', count(*) FROM documents WHERE text IS NULL UNION ALL SELECT 'depth', 0""")
def counted_faults(t):
    """O-03, T-35: code made of documents, that of a null text broken: matches, and how many files had a fault, from one pass."""
    code = F.coalesce(F.concat(F.lit("if (n := 'R"), F.length("text").cast("string"), F.lit("'):\n    pass\n")), F.lit("if (:\n"))
    found, seen = patterns.find_patterns_counted(t.documents.select(F.col("doc_id").alias("blob_id"), code.alias("content")), ["pep_572"])
    n = Scratch(t.spark).put(found, "found").count()
    return t.spark.createDataFrame([("found", n), *((k, int(v)) for k, v in seen.get.items())], "what string, n long")
