"""Symbols and chunks of source code.

Python is read with the standard ``ast`` module; a source that it rejects is read block by
block, so that one broken function leaves the others whole. Rust and TypeScript/JavaScript
are read by their items and braces after masking; an item whose brace is never closed ends
where the next one of its level starts. These run as pandas UDFs.
"""

from __future__ import annotations

import ast
import keyword
import re
import textwrap
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.operators import chunking
from quernstone.operators.masking import masked, without_comments

# given as types: a string would need a session when executors import this module
_STRINGS = ArrayType(StringType())
SYMBOLS = StructType([StructField("defines", _STRINGS), StructField("imports", _STRINGS)])
CHUNK = ArrayType(StructType([StructField(n, StringType()) for n in ("text", "type", "name")] + [StructField(n, _STRINGS) for n in ("defines", "calls")]))


def _chunk(text: str, kind: str, name: str, defines=(), calls=()) -> dict:
    return {"text": text, "type": kind, "name": name, "defines": list(defines), "calls": list(calls)}


def _python_calls(node: ast.AST) -> list[str]:
    found = set()
    for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
        if isinstance(call.func, ast.Name):
            found.add(call.func.id)
        elif isinstance(call.func, ast.Attribute):
            found.add(call.func.attr)
    return sorted(found)


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


_HEADER = re.compile(r"(?:async[ \t]+)?(def|class)[ \t]+(\w+)[^\n]*:[ \t]*(?:\#[^\n]*)?$", re.M)
#: Lines that go on with the statement before them.
_GOES_ON = re.compile(r"[\s)\]}#]|(?:else|elif|except|finally|case)\b|$")
#: Blocks that are tried together, for strings over several lines that hold lines without indentation.
_TOGETHER = 40


def _parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _python_blocks(source: str) -> list[tuple[ast.Module | None, str]]:
    """A source in statements without indentation, each with its tree or, where it can't
    be read, None. Decorators belong to what follows them."""
    starts, lines = [], source.splitlines(keepends=True)
    for k, line in enumerate(lines):
        if not _GOES_ON.match(line) and not (k and lines[k - 1].startswith("@")):
            starts.append(k)
    blocks = ["".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)][: len(starts)], strict=True)]
    out, k = [], 0
    while k < len(blocks):
        for n in range(1, min(_TOGETHER, len(blocks) - k) + 1):
            text = "".join(blocks[k : k + n])
            if (tree := _parsed(text)) is not None or not re.search(r"\"{3}|'{3}|\\\n", text):
                break
        if tree is None:
            n, text = 1, blocks[k]
        out.append((tree, text))
        k += n
    return out


@dataclass
class _Item:
    """A statement: its node in ``base``, or of a broken one, whose header can be read, its
    kind and name alone."""

    text: str
    base: str
    node: ast.AST | None = None
    kind: str = ""
    name: str = ""

    def __post_init__(self):
        if isinstance(self.node, (*_DEF, ast.ClassDef)):
            self.kind, self.name = "class" if isinstance(self.node, ast.ClassDef) else "def", self.node.name

    def calls(self) -> list[str]:
        return _python_calls(self.node) if self.node else _plain_calls(self.text)

    def members(self) -> list[_Item]:
        if self.node:
            return [_Item(ast.get_source_segment(self.base, m) or "", self.base, m) for m in self.node.body]
        return _python_items(textwrap.dedent("".join(self.text.splitlines(keepends=True)[1:])))


def _python_items(source: str) -> list[_Item]:
    tree, out = _parsed(source), []
    for part, text in [(tree, source)] if tree is not None else _python_blocks(source):
        if part is not None:
            out += [_Item(ast.get_source_segment(text, n) or "", text, n) for n in part.body]
        elif (m := _HEADER.search(text)) and _parsed(m[0].split("#")[0].rstrip() + " pass") is not None:
            out.append(_Item(text[m.start() :].rstrip(), text, None, m[1], m[2]))
    return out


def _plain_calls(text: str) -> list[str]:
    """Names before an opening bracket in a source that can't be read."""
    bare = re.sub(r"\#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", " ", text)
    found = {m[1] for m in re.finditer(r"([A-Za-z_]\w*)\s*\(", bare) if not re.search(r"\b(?:def|class)\s+$", bare[: m.start()])}
    return sorted(n for n in found if not keyword.iskeyword(n))


def python_chunks(source: str) -> list[dict]:
    """Functions, classes, and methods led by their class and the module's imports. A
    source that can't be read and has no such item is one raw chunk."""
    items, out = _python_items(source), []
    imports = "\n".join(i.text for i in items if isinstance(i.node, (ast.Import, ast.ImportFrom)))
    led = lambda lead, text: f"{lead}\n\n{text}" if lead else text
    for item in items:
        if item.kind == "def":
            out.append(_chunk(led(imports, item.text), "function", item.name, [item.name], item.calls()))
        elif item.kind == "class":
            out.append(_chunk(item.text, "class", item.name, [item.name], item.calls()))
            lead = f"Class {item.name}:" + (f"\n{imports}" if imports else "")
            out += [_chunk(led(lead, m.text), "function", m.name, [m.name], m.calls()) for m in item.members() if m.kind == "def"]
    return out or [_chunk(source, "script", "__main__") if _parsed(source) is not None else _chunk(source, "raw", "file_content")]


def python_symbols(source: str) -> dict:
    defines: set[str] = set()
    imports: set[str] = set()
    waiting = _python_items(source)
    while waiting:
        item = waiting.pop()
        if item.node is None:
            defines.add(item.name)
            waiting += item.members() if item.kind == "class" else []
            continue
        for n in ast.walk(item.node):
            if isinstance(n, (*_DEF, ast.ClassDef)):
                defines.add(n.name)
            elif isinstance(n, ast.Import):
                imports |= {a.name.split(".")[0] for a in n.names}
            elif isinstance(n, ast.ImportFrom) and n.module:
                imports.add(n.module.split(".")[0])
    return {"defines": sorted(defines), "imports": sorted(imports)}


def python_calls(source: str) -> list[str]:
    return sorted({name for item in _python_items(source) for name in item.calls()})


def _close(text: str, start: int, end: int | None = None) -> int | None:
    """Just past the brace that closes the first one at or after ``start``, or past the
    semicolon that ends the item before any brace opens; None if nothing closes it."""
    depth = inner = 0
    for m in re.compile(r"[{}()\[\];]").finditer(text, start, len(text) if end is None else end):
        if m[0] in "([":
            inner += 1
        elif m[0] in ")]":
            inner = max(0, inner - 1)
        elif m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth, inner = depth - 1, 0
            if depth <= 0:
                return m.end()
        elif not depth and not inner:
            return m.end()
    return None


def _column(text: str, at: int) -> int:
    return at - (text.rfind("\n", 0, at) + 1)


def _stop(text: str, begin: int, start: int, end: int, item: re.Pattern) -> int:
    """The end of the item at ``begin``. One that nothing closes ends where the next item
    begins that stands no deeper than itself, or where its surroundings do."""
    if (found := _close(text, start, end)) is not None:
        return found
    for m in item.finditer(text, start, end):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if text.rfind("\n", begin, at) >= 0 and _column(text, at) <= _column(text, begin):
            return begin + len(text[begin:at].rstrip())
    return begin + len(text[begin:end].rstrip())


def _inside(text: str, stop: int) -> int:
    """The end of the body of an item that ends at ``stop``: before its brace, if it has one."""
    return stop - 1 if text[stop - 1 : stop] == "}" else stop


def _past_angles(text: str, at: int) -> int:
    """Behind the angle bracket that closes the one at ``at``; arrows don't close any."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "<":
            depth += 1
        elif text[k] == ">" and text[k - 1] not in "-=":
            depth -= 1
            if not depth:
                return k + 1
    return len(text)


# masked comments are white space, and much of it: no pattern may try the same run twice
_CALL = re.compile(r"(?:\b|\.)([A-Za-z_$][\w$]*)(?:\s*::<[^>]*>+|<[^<>()&|;]*(?:<[^<>()&|;]*>[^<>()&|;]*)*>)?\s*\(")
_NAMED = re.compile(r"\b(?:fn|function)\s+(?=\S)")
_NO_CALL = {"if", "for", "while", "match", "switch", "return", "fn", "function", "catch", "loop", "async", "await", "in", "let", "const", "new", "super", "constructor"}


def _brace_calls(text: str) -> list[str]:
    named = {m.end() for m in _NAMED.finditer(text)}
    found = {m[1] for m in _CALL.finditer(text) if m.start(1) not in named}
    return sorted(found - _NO_CALL)


_RUST_ITEM = re.compile(r"(?:^|(?<=[{};]))[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*(fn|struct|enum|trait|impl|mod)\b([^{;]*)", re.M)


def _rust_items(clean: str, start: int = 0, end: int | None = None):
    """(kind, head, start, end) of the items at this level."""
    at, end = start, len(clean) if end is None else end
    while m := _RUST_ITEM.search(clean, at, end):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        stop = _stop(clean, begin, m.start(2), end, _RUST_ITEM)
        yield m[1], m[2].strip(), begin, stop
        at = max(stop, m.start(2) + 1)


def _impl_type(head: str) -> str:
    head = head[_past_angles(head, 0) :].strip() if head.startswith("<") else head
    head = re.split(r"\swhere\s", head)[0]
    return (head.split(" for ")[-1] if " for " in head else head).strip()


def _word(head: str) -> str:
    m = re.match(r"[A-Za-z_]\w*", head)
    return m[0] if m else "item"


def rust_chunks(source: str) -> list[dict]:
    """Functions, types, and methods wrapped in their impl."""
    clean, out = masked(source, "rs"), []
    for kind, head, begin, stop in _rust_items(clean):
        text, calls = source[begin:stop], _brace_calls(clean[begin:stop])
        if kind == "fn":
            out.append(_chunk(text, "function", _word(head), [_word(head)], calls))
        elif kind == "mod":
            continue
        elif kind != "impl":
            out.append(_chunk(text, "type", _word(head), [_word(head)], calls))
        else:
            of, body = _impl_type(head), clean.find("{", begin) + 1
            for inner, name, b, s in _rust_items(clean, body, _inside(clean, stop)):
                if inner == "fn":
                    out.append(_chunk(f"impl {of} {{\n{source[b:s]}\n}}", "method", _word(name), [f"{of}::{_word(name)}", _word(name)], _brace_calls(clean[b:s])))
    return out


_USE = re.compile(r"^[^\S\n]*+(?:pub\s+)?use\s+([^;]+);", re.M)


def rust_symbols(source: str) -> dict:
    """Qualified definitions, and the paths and last names of ``use``."""
    clean = masked(source, "rs")
    defines: set[str] = set()

    def walk(start: int, end: int, path: str) -> None:
        for kind, head, begin, stop in _rust_items(clean, start, end):
            body = clean.find("{", begin, stop) + 1
            if kind == "mod":
                if body:
                    walk(body, _inside(clean, stop), f"{path}{_word(head)}::")
            elif kind == "impl":
                of = _impl_type(head)
                defines.update(f"{path}{of}::{_word(n)}" for k, n, _, _ in _rust_items(clean, body, _inside(clean, stop)) if k == "fn")
            else:
                defines.add(path + _word(head))

    walk(0, len(clean), "")
    imports: set[str] = set()
    for m in _USE.finditer(clean, 0, clean.rfind(";") + 1):
        head, _, group = m[1].partition("{")
        names = [n.split(" as ")[0].strip() for n in group.rstrip("} \n").split(",")] if group else [""]
        for n in names:
            path = re.sub(r"\s+", "", head + n).split("as")[0] if " as " in head else re.sub(r"\s+", "", head + n)
            path = path.rstrip(":")
            if path:
                imports |= {path, path.split("::")[-1]}
    return {"defines": sorted(defines), "imports": sorted(imports - {"*", "self", ""})}


_TS_ITEM = re.compile(r"^[ \t]*+(export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|const|let|var)\s+([A-Za-z_$][\w$]*)", re.M)
_TS_MEMBER = re.compile(r"(?:^|(?<=[{};]))[^\S\n]*+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?:\*\s*)?([A-Za-z_$#][\w$]*)\s*(?=[<(])", re.M)


def _past_group(text: str, at: int, end: int) -> int:
    """Behind the bracket of any kind that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at, end):
        depth += 1 if m[0] in "([{" else -1
        if depth <= 0:
            return m.end()
    return end


def _ts_body(text: str, at: int, end: int) -> int:
    """Behind the type parameters, the parameters and the type of what they return, where
    there are any: where a body would start."""
    skip = lambda k: re.compile(r"\s*").match(text, k, end).end()
    at = skip(at)
    if text[at : at + 1] == "<":
        at = skip(min(_past_angles(text, at), end))
    if text[at : at + 1] == "(":
        at = skip(_past_group(text, at, end))
        if text[at : at + 1] == ":":
            at = skip(at + 1)
            at = skip(_past_group(text, at, end)) if text[at : at + 1] == "{" else at
    return at


def _ts_items(clean: str):
    """(match, begin, stop) of the declarations, those inside others left out."""
    at = 0
    while m := _TS_ITEM.search(clean, at):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        body = _ts_body(clean, m.end(), len(clean)) if m[2][:5] in ("funct", "class") else m.end()
        stop = _stop(clean, begin, body if _close(clean, body) is not None else m.end(), len(clean), _TS_ITEM)
        yield m, begin, stop
        at = max(stop, m.end())


def _class_body(clean: str, m: re.Match) -> int:
    return clean.find("{", _ts_body(clean, m.end(), len(clean))) + 1


def _ts_methods(clean: str, start: int, end: int):
    """(match, begin, stop) of the methods of a class body: a name, type parameters,
    parameters, and a body behind them."""
    at = start
    while m := _TS_MEMBER.search(clean, at, end):
        at = m.end() + 1
        body = re.compile(r"[^;{}()]*\{").match(clean, _ts_body(clean, m.end(), end), end)
        if not body:
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        stop = _stop(clean, begin, body.end() - 1, end, _TS_MEMBER)
        if m[1] not in _NO_CALL or m[1] == "constructor":
            yield m, begin, stop
        at = max(stop, body.end())


def _without_method_names(clean: str) -> str:
    """The names before methods' own brackets are no calls."""
    for m, begin, stop in _ts_items(clean):
        if m[2] == "class":
            for n, b, _ in _ts_methods(clean, _class_body(clean, m), _inside(clean, stop)):
                clean = clean[:b] + re.sub(r"[^\n]", " ", clean[b : n.end(1)]) + clean[n.end(1) :]
    return clean


def ts_chunks(source: str, ext: str = "ts") -> list[dict]:
    """Functions, classes with their methods, interfaces, types and exported constants."""
    clean, out = masked(source, ext), []
    bare = _without_method_names(clean)
    for m, begin, stop in _ts_items(clean):
        kind, name = m[2].rstrip("*"), m[3]
        if kind in ("const", "let", "var") and not m[1]:
            continue
        label = {"const": "constant", "let": "constant", "var": "constant"}.get(kind, kind)
        out.append(_chunk(source[begin:stop], label, name, [name], _brace_calls(bare[begin:stop])))
        if kind == "class":
            for n, b, e in _ts_methods(clean, _class_body(clean, m), _inside(clean, stop)):
                out.append(_chunk(f"Class {name}:\n\n{source[b:e]}", "method", n[1], [n[1]], _brace_calls(bare[b:e])))
    return out or [_chunk(source, "script", "__main__")]


def ts_symbols(source: str, ext: str = "ts") -> dict:
    defines = {m[3] for m in _TS_ITEM.finditer(masked(source, ext))}
    imports: set[str] = set()
    for m in re.finditer(r"""import\s+([^'";]*)['"]([^'"]+)['"]""", without_comments(source)):
        imports.add(m[2].lstrip("./@").split("/")[0] or m[2])
        if group := re.search(r"\{([^}]*)\}", m[1]):
            imports |= {n.split(" as ")[0].strip() for n in group[1].split(",") if n.strip()}
    return {"defines": sorted(defines), "imports": sorted(imports - {""})}


def rust_calls(source: str) -> list[str]:
    return _brace_calls(masked(source, "rs"))


def ts_calls(source: str, ext: str = "ts") -> list[str]:
    return _brace_calls(_without_method_names(masked(source, ext)))


_PARSERS = {
    "py": (python_chunks, python_symbols, python_calls), "rs": (rust_chunks, rust_symbols, rust_calls),
    **{e: tuple(partial(f, ext=e) for f in (ts_chunks, ts_symbols, ts_calls)) for e in ("ts", "tsx", "js", "jsx")},
}


@F.pandas_udf(CHUNK)
def code_chunks(text: pd.Series, ext: pd.Series) -> pd.Series:
    """Semantic chunks by extension; empty for other extensions."""
    return pd.Series([_PARSERS[e][0](t) if e in _PARSERS and t else [] for t, e in zip(text, ext, strict=True)])


@F.pandas_udf(SYMBOLS)
def code_symbols(text: pd.Series, ext: pd.Series) -> pd.DataFrame:
    """Definitions and imports by extension."""
    return pd.DataFrame([_PARSERS[e][1](t) if e in _PARSERS and t else {"defines": [], "imports": []} for t, e in zip(text, ext, strict=True)], columns=["defines", "imports"])


#: The same for Spark to leave where it stands: a deterministic function goes below a limit.
code_symbols_here = F.pandas_udf(code_symbols.func, SYMBOLS).asNondeterministic()


@F.pandas_udf(_STRINGS)
def code_calls(text: pd.Series, ext: pd.Series) -> pd.Series:
    """Names called anywhere in a source, sorted and without repeats."""
    return pd.Series([_PARSERS[e][2](t) if e in _PARSERS and t else [] for t, e in zip(text, ext, strict=True)])


def plain_calls(text: Column) -> Column:
    """Names before an opening bracket, by a pattern alone."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def chunk_files(files: DataFrame) -> DataFrame:
    """(source, chunk_idx, chunk_id, text, type, name, defines, calls) of files (source,
    text): by syntax, by markdown sections, or by windows, as the extension says. Minified
    sources go to windows; so does a source in which nothing is found."""
    typed = files.withColumn("ext", extension(F.col("source"))).withColumn("bypass", chunking.bypasses_parser(F.col("text")))
    coded = F.col("ext").isin(*_PARSERS) & ~F.col("bypass")
    headed = F.col("ext").isin("md", "markdown", "mdx", "txt") & F.col("text").rlike(r"(?m)^\s*#{1,6}[ \t]*[^#\s]|^[^\n]*\S[^\n]*\n(=+|-{3,})[ \t]*$")
    windows = F.transform(
        chunking.char_windows(F.col("text")),
        lambda t: F.struct(t.alias("text"), F.lit("text").alias("type"), F.lit("").alias("name"), F.array().cast("array<string>").alias("defines"), F.array().cast("array<string>").alias("calls")),
    )
    # one pass: as filters, these conditions would make each text anew for every branch
    parts = typed.withColumn("parts", code_chunks(F.when(coded, F.col("text")), "ext")).where(F.col("ext").isNotNull() & ~F.coalesce(headed & ~coded, F.lit(False)))
    parts = parts.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(windows))
    out = parts.select("source", F.posexplode(F.slice("parts", 1, fixed.MAX_CHUNKS_PER_FILE)).alias("chunk_idx", "c"))
    out = out.select("source", F.col("chunk_idx").cast("long").alias("chunk_idx"), "c.*")
    sections = chunking.markdown_sections(typed.where(headed & ~coded), "source", "text", leading=True)
    none = F.array().cast("array<string>")
    sections = sections.select(F.col("id").alias("source"), F.col("section").alias("chunk_idx"), "text", F.lit("section").alias("type"), F.coalesce("name", F.lit("")).alias("name"), none.alias("defines"), none.alias("calls"))
    every = out.unionByName(sections)
    return every.withColumn("chunk_id", F.concat("source", F.lit("#"), F.col("chunk_idx").cast("string")))


def symbol_index(chunks: DataFrame) -> DataFrame:
    """(symbol, chunk_id) of all definitions."""
    return chunks.select(F.explode("defines").alias("symbol"), "chunk_id")


def reference_index(chunks: DataFrame) -> DataFrame:
    """(symbol, chunk_id) of calls and of the file's imports."""
    return chunks.select(F.explode(F.array_distinct(F.concat("calls", "imports"))).alias("symbol"), "chunk_id")


def related_code(symbols: DataFrame, references: DataFrame, names: DataFrame, most_references: int = 25, most: int = 100) -> DataFrame:
    """(symbol, place, chunk_id, is_definition): definitions first, then references that
    aren't among them."""
    # joined behind the union (a semi join would move into it): a union of halves dealt alike counts as dealt
    # too, and fails where Spark then coalesces or splits one of them alone
    both = symbols.withColumn("is_definition", F.lit(True)).unionByName(references.withColumn("is_definition", F.lit(False)))
    w = Window.partitionBy("symbol", "is_definition").orderBy("chunk_id")
    both = both.join(names.select("symbol").distinct(), "symbol").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(most, most_references))
    both = both.where(F.col("_r") <= F.when(F.col("is_definition"), most).otherwise(most_references))
    both = both.groupBy("symbol", "chunk_id").agg(F.max("is_definition").alias("is_definition"))
    order = Window.partitionBy("symbol").orderBy(F.col("is_definition").desc(), "chunk_id")
    return both.withColumn("place", F.row_number().over(order).cast("long")).select("symbol", "place", "chunk_id", "is_definition")


def callees(chunks: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(chunk_id, place, callee, callee_chunk): the first different names each chunk
    calls that are defined somewhere, with where."""
    calls = chunks.select("chunk_id", F.posexplode(F.array_distinct("calls")).alias("at", "callee"))
    found = calls.join(symbols.select(F.col("symbol").alias("callee"), F.col("chunk_id").alias("callee_chunk")), "callee")
    first = found.groupBy("chunk_id", "at", "callee").agg(F.min("callee_chunk").alias("callee_chunk"))
    w = Window.partitionBy("chunk_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("chunk_id", "place", "callee", "callee_chunk")


def outline(files: DataFrame, most_files: int = 500, most: int = 2000, depth: int = 8, defines: Column | None = None) -> DataFrame:
    """(place, line): ``path: symbol`` of the first files (source, defines) and symbols by
    path and name; deeper folders are left out. With ``defines``, files are (source, text)
    and parsed by it once the first are chosen."""
    first = files.where(F.size(F.split("source", "/")) <= depth).orderBy("source").limit(most_files)
    first = first if defines is None else first.withColumn("defines", defines)
    lines = first.select("source", F.explode(F.array_sort("defines")).alias("symbol")).orderBy("source", "symbol").limit(most)
    # at most ``most`` rows are put in order
    place = F.row_number().over(Window.orderBy("source", "symbol")).cast("long")
    return lines.select(place.alias("place"), F.concat("source", F.lit(": "), "symbol").alias("line"))


def _joined(parts: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["x"]), between)


def related_text(related: DataFrame, chunks: DataFrame, symbols: DataFrame, names: DataFrame, most_callees: int = 3) -> DataFrame:
    """(symbol, text) for each of ``names``: its chunks in order with what they call, then
    where the first names that they call are defined."""
    rows = related.join(chunks.select("chunk_id", "source", "text", "calls"), "chunk_id")
    path, body = T.xml_attribute("source"), T.xml_text("text")
    outgoing = F.when(F.size("calls") > 0, F.concat(F.lit("\nOutgoing calls: "), F.array_join("calls", ", "))).otherwise("")
    element = F.concat(F.lit('<source_file path="'), path, F.lit('">\n'), body, outgoing, F.lit("\n</source_file>"))
    main = rows.groupBy("symbol").agg(F.collect_list(F.struct("place", element.alias("x"))).alias("parts")).select("symbol", _joined("parts", "\n\n").alias("main"))
    called = rows.select("symbol", "place", F.posexplode("calls").alias("at", "callee"))
    called = called.groupBy("symbol", "callee").agg(F.min(F.struct("place", "at")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("first"))
    called = called.withColumn("nth", nth).where(F.col("nth") <= most_callees)
    defined = symbols.groupBy(F.col("symbol").alias("callee")).agg(F.min("chunk_id").alias("chunk_id"))
    found = called.join(defined, "callee").join(chunks.select("chunk_id", "source", "text"), "chunk_id")
    element = F.concat(F.lit('<source_file path="'), path, F.lit('" symbol="'), F.col("callee"), F.lit('">\n'), body, F.lit("\n</source_file>"))
    context = found.groupBy("symbol").agg(F.collect_list(F.struct("nth", element.alias("x"))).alias("parts"))
    context = context.select("symbol", F.concat(F.lit("\n\n<callee_context>\n"), _joined("parts", "\n\n"), F.lit("\n</callee_context>")).alias("context"))
    every = names.select("symbol").distinct().join(main, "symbol", "left").join(context, "symbol", "left")
    text = F.when(F.col("main").isNull(), "No defining or importing chunks found.").otherwise(F.concat("main", F.coalesce("context", F.lit(""))))
    return every.select("symbol", text.alias("text"))


def symbol_xml(related: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(symbol, xml) for each of ``names``: its definitions, then each symbol that refers
    to it once, as a dependency if its file imports the name and as a consumer if not."""
    rows = related.join(chunks.select("chunk_id", "source", "text", "defines", "imports"), "chunk_id").withColumn("own", F.array_contains("defines", F.col("symbol")))
    path = T.xml_attribute("source")
    source = F.concat(F.lit('<source path="'), path, F.lit('" rel="implementation">'), T.xml_text(T.trimmed("text")), F.lit("</source>"))
    definition = rows.where("own").groupBy("symbol").agg(F.collect_list(F.struct("place", source.alias("x"))).alias("parts")).select("symbol", _joined("parts", "").alias("definition"))
    others = rows.where("NOT own").withColumn("rel", F.when(F.array_contains("imports", F.col("symbol")), "dependency").otherwise("consumer"))
    base = F.element_at(F.split("source", "/"), -1)
    named = others.select("symbol", "place", "rel", base.alias("base"), T.context_snippet("text").alias("context"), F.posexplode("defines").alias("at", "other")).where("other <> ''")
    first = named.groupBy("symbol", "other").agg(F.min(F.struct("place", "at", "rel", "base", "context")).alias("f"))
    ref = F.concat(
        F.lit('<ref rel="'), F.col("f.rel"), F.lit('" path="graph://symbol/'), T.xml_attribute("other"), F.lit('" context="'), T.xml_attribute(F.col("f.context")), F.lit('">'),
        T.xml_text("other"), F.lit(" (in "), T.xml_text(F.col("f.base")), F.lit(")</ref>"),
    )
    refs = first.groupBy("symbol").agg(F.collect_list(F.struct(F.col("f.place").alias("place"), F.col("f.at").alias("at"), ref.alias("x"))).alias("parts")).select("symbol", _joined("parts", "").alias("refs"))
    seen = rows.select("symbol").distinct().withColumn("seen", F.lit(True))
    every = names.select("symbol").distinct().join(seen, "symbol", "left").join(definition, "symbol", "left").join(refs, "symbol", "left")
    name = T.xml_attribute("symbol")
    whole = F.concat(
        F.lit('<symbol name="'), name, F.lit('"><definition>'), F.coalesce("definition", F.lit("No defining chunk in index.")), F.lit("</definition><references>"),
        F.coalesce("refs", F.lit("")), F.lit("</references></symbol>"),
    )
    missing = F.concat(F.lit('<symbol name="'), name, F.lit('"><definition>Not found in index.</definition><references/></symbol>'))
    invalid = F.lit('<symbol name=""><definition>Invalid symbol name.</definition><references/></symbol>')
    xml = F.when(T.trimmed("symbol") == "", invalid).when(F.col("seen").isNull(), missing).otherwise(whole)
    return every.select("symbol", xml.alias("xml"))
