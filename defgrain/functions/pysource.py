"""The only code that runs in Python workers: one function's facts and one rename.

The standard library parses and prints; Spark partitions the corpus, feeds these helpers
Arrow batches of nothing but the code column, and does everything else.
The module is pickled by value (see operators.extract), so executors need no install.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import warnings
from collections import namedtuple
from collections.abc import Iterable, Iterator

import pyarrow as pa

# Body text used when a statement cannot be printed, and when there is none.
UNPRINTABLE_BODY = "# unparse failed"
EMPTY_BODY = "pass"

# What became of a text. Only the first gives facts; the column of messages is made from these
# in SQL (operators.extract).
FUNCTION, EMPTY, SYNTAX, UNPARSABLE, NO_FUNCTION, UNREADABLE = range(6)

FUNCTION_FIELDS = [
    ("code", "string", pa.string()),
    ("function_name", "string", pa.string()),
    ("parameters", "array<string>", pa.list_(pa.string())),
    ("return_annotation", "string", pa.string()),
    ("docstring_in_code", "string", pa.string()),
    ("body_without_docstring", "string", pa.string()),
    ("is_async", "boolean", pa.bool_()),
    ("signature", "string", pa.string()),
    ("local_names", "array<string>", pa.list_(pa.string())),
    ("ast_hash", "string", pa.string()),
    ("outcome", "int", pa.int32()),
    ("detail", "string", pa.string()),
]
FUNCTION_DDL = "struct<" + ",".join(f"{name}:{ddl}" for name, ddl, _ in FUNCTION_FIELDS) + ">"
FUNCTION_ARROW = pa.struct([(name, arrow) for name, _, arrow in FUNCTION_FIELDS])
RENAME_DDL = f"struct<status:string,function:{FUNCTION_DDL}>"
RENAME_ARROW = pa.struct([("status", pa.string()), ("function", FUNCTION_ARROW)])

Facts = namedtuple("Facts", [name for name, _, _ in FUNCTION_FIELDS], defaults=[None] * len(FUNCTION_FIELDS))
NO_FACTS = Facts(parameters=[], is_async=False, local_names=[])

# The memo spares repeated parses of popular texts within a task; both bounds keep a
# worker's memory flat whatever the corpus holds.
MEMO_ENTRIES = 2048
MEMO_TEXT_CHARS = 16384
SLICE_ROWS = 500  # rows of a batch whose Python objects a worker holds at once


def _utf8(text: str | None) -> str | None:
    """Escapes in source can spell lone surrogates, which no UTF-8 column can hold."""
    return text and text.encode("utf-8", "replace").decode("utf-8")


def without_facts(outcome: int, error: BaseException | None = None) -> Facts:
    return NO_FACTS._replace(outcome=outcome, detail=_utf8(f"{type(error).__name__}: {error}") if error else None)


class _Printer:
    """Prints parts of one function. Printing recurses, so parts of a very deep tree may fail to
    print although the text parsed; each part then has its own stand-in."""

    def __init__(self, fn):
        self.fn = fn

    def part(self, node, stand_in: str | None) -> str | None:
        try:
            return _utf8(ast.unparse(node))
        except Exception:
            return stand_in

    def header(self) -> str | None:
        """The function without decorators and body prints as its signature."""
        bare = type(self.fn)(name=self.fn.name, args=self.fn.args, returns=self.fn.returns, body=[], decorator_list=[])
        return self.part(ast.fix_missing_locations(bare), None)

    def body(self, skip: int) -> str:
        lines = [self.part(statement, None) for statement in self.fn.body[skip:]]
        return UNPRINTABLE_BODY if None in lines else "\n".join(lines) or EMPTY_BODY


# How each statement kind that makes a local name lists its targets.
BINDERS = {
    ast.Assign: lambda node: node.targets,
    ast.For: lambda node: [node.target],
    ast.AugAssign: lambda node: [node.target],
    ast.With: lambda node: [item.optional_vars for item in node.items],
}


def _outline(node: ast.AST, targets: list) -> str:
    """Text that is equal for equal trees and for no others: kinds, fields in order and
    constants, without positions. The bound targets are gathered on the way."""
    binder = BINDERS.get(type(node))
    if binder is not None:
        targets += binder(node)
    fields = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, ast.AST):
            fields.append(_outline(value, targets))
        elif isinstance(value, list):
            fields.append(f"[{','.join([_outline(v, targets) if isinstance(v, ast.AST) else repr(v) for v in value])}]")
        else:
            fields.append(repr(value))
    return f"{type(node).__name__}({','.join(fields)})"


def outline_and_locals(fn) -> tuple[str | None, list[str]]:
    """Hash of the tree, and the plain names the function binds by assignment, ``for``,
    ``with`` or augmented assignment without its positional, * and ** parameters."""
    targets: list = []
    try:
        digest = hashlib.sha256(_outline(fn, targets).encode("utf-8")).hexdigest()
    except Exception:  # a tree too deep to walk this way still has its names
        digest, targets = None, [t for n in ast.walk(fn) if type(n) in BINDERS for t in BINDERS[type(n)](n)]
    stars = [a for a in (fn.args.vararg, fn.args.kwarg) if a is not None]
    names = {t.id for t in targets if type(t) is ast.Name} - {a.arg for a in fn.args.args + stars}
    return digest, sorted(names)


def facts_of(fn, text: str | None) -> Facts:
    """The facts of one function node; ``text`` replaces the row's code unless it is None."""
    printed = _Printer(fn)
    try:
        documented = ast.get_docstring(fn, clean=False)
        digest, names = outline_and_locals(fn)
        returns = None if fn.returns is None else _utf8(ast.unparse(fn.returns))
    except Exception as error:
        return without_facts(UNREADABLE, error)
    return Facts(
        outcome=FUNCTION,
        code=text,
        function_name=fn.name,
        is_async=type(fn) is ast.AsyncFunctionDef,
        parameters=[a.arg for a in fn.args.args],
        return_annotation=returns,
        signature=printed.header(),
        docstring_in_code=documented and _utf8(inspect.cleandoc(documented)),
        body_without_docstring=printed.body(0 if documented is None else 1),
        local_names=names,
        ast_hash=digest,
    )


def read_text(source: str | None) -> list[Facts]:
    """One entry per top-level function, else a single entry that says what is wrong."""
    tree = ast.Module(body=[], type_ignores=[])
    outcome, error = (NO_FUNCTION, None) if source else (EMPTY, None)
    if source:
        try:
            tree = ast.parse(source)
        except Exception as problem:
            outcome, error = (SYNTAX if isinstance(problem, SyntaxError) else UNPARSABLE), problem
    top = [n for n in tree.body if type(n) in (ast.FunctionDef, ast.AsyncFunctionDef)]
    if len(top) == 1:
        return [facts_of(top[0], None)]
    return [facts_of(n, _Printer(n).part(n, None)) for n in top] or [without_facts(outcome, error)]


class Memo:
    """Results by text, emptied when full; long texts are not kept."""

    def __init__(self):
        self.entries: dict = {}

    def get(self, key, source: str | None, make):
        known = self.entries.get(key)
        if known is None:
            known = make()
            if source is not None and len(source) <= MEMO_TEXT_CHARS:
                if len(self.entries) >= MEMO_ENTRIES:
                    self.entries.clear()
                self.entries[key] = known
        return known


def _struct_array(entries: Iterable[Facts | None]) -> pa.StructArray:
    """Facts turned into columns at once, with null where there are none."""
    entries = list(entries)
    columns = zip(*[e or NO_FACTS for e in entries]) if entries else [[] for _ in FUNCTION_FIELDS]
    arrays = [pa.array(column, type=arrow) for column, (_, _, arrow) in zip(columns, FUNCTION_FIELDS)]
    missing = pa.array([e is None for e in entries], type=pa.bool_())
    return pa.StructArray.from_arrays(arrays, fields=list(FUNCTION_ARROW), mask=missing)


def _by_slices(function, *columns: pa.Array) -> pa.Array:
    """``function`` of a batch, made a slice at a time, so that objects of few rows are alive."""
    return pa.concat_arrays([function(*[c.slice(at, SLICE_ROWS) for c in columns]) for at in range(0, max(len(columns[0]), 1), SLICE_ROWS)])


def parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = Memo()

    def parsed(sources: pa.Array) -> pa.Array:
        entries, offsets = [], [0]
        for source in sources.to_pylist():
            entries.extend(memo.get(source, source, lambda: read_text(source)))
            offsets.append(len(entries))
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), _struct_array(entries), type=pa.list_(FUNCTION_ARROW))

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for batch in batches:
            yield _by_slices(parsed, batch)


# Names that a rewrite of Name nodes does not reach, per node kind that holds some.
OUTSIDE_NAMES = {
    ast.Global: lambda node: node.names,
    ast.Nonlocal: lambda node: node.names,
    ast.arg: lambda node: [node.arg],
    ast.alias: lambda node: [node.asname or node.name.split(".")[0]],
    ast.MatchMapping: lambda node: [node.rest],
    **dict.fromkeys(
        [
            ast.FunctionDef,
            ast.AsyncFunctionDef,
            ast.ClassDef,
            ast.ExceptHandler,
            ast.MatchAs,
            ast.MatchStar,
            ast.TypeVar,
            ast.ParamSpec,
            ast.TypeVarTuple,
        ],
        lambda node: [node.name],
    ),
}


def _names_in(tree: ast.AST) -> tuple[list[ast.Name], set[str]]:
    """Name nodes, and the names that stand anywhere else."""
    nodes, outside = [], set()
    for node in ast.walk(tree):
        if type(node) is ast.Name:
            nodes.append(node)
        elif type(node) in OUTSIDE_NAMES:
            outside.update(OUTSIDE_NAMES[type(node)](node))
    return nodes, outside


def rename_one(source: str | None, old: list[str] | None, new: list[str] | None) -> tuple[str, Facts | None]:
    """Rename names throughout the text and read the facts off the renamed tree, or say why not."""
    if not source or not old:
        return "no_locals", None
    mapping = dict(zip(old, new))
    try:
        tree = ast.parse(source)
        nodes, outside = _names_in(tree)
        used = {node.id for node in nodes}
        # A target that is already in use would merge two variables, and a source bound
        # outside Name nodes would be renamed only in part.
        if (used | outside) & set(mapping.values()) or outside & set(mapping):
            return "unsafe", None
        for node in nodes:
            node.id = mapping.get(node.id, node.id)
        text = _utf8(ast.unparse(tree))
        top = next(n for n in tree.body if type(n) in (ast.FunctionDef, ast.AsyncFunctionDef))
    except Exception:
        return "failed", None
    facts = facts_of(top, text)
    return ("renamed", facts) if facts.outcome == FUNCTION else ("failed", None)


def rename_batches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    memo = Memo()

    def renamed(*columns: pa.Array) -> pa.Array:
        results = [
            memo.get((source, tuple(old or ())), source, lambda: rename_one(source, old, new))
            for source, old, new in zip(*[c.to_pylist() for c in columns])
        ]
        return pa.StructArray.from_arrays(
            [pa.array([status for status, _ in results], pa.string()), _struct_array(facts for _, facts in results)],
            fields=list(RENAME_ARROW),
        )

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for columns in batches:
            yield _by_slices(renamed, *columns)
