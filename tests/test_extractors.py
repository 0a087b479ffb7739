"""Symbol extractors: one case per rule, and the symbol table of a project."""

import pytest

from sightline.sources import code, lang_python, lang_rust, lang_typescript
from sightline.sources.tree import rows, total_lines


def shape(nodes):
    """(label, name, first line, last line) of every node, children after them in a list."""
    return [(n.label, n.name, *n.lines, *([shape(n.children)] if n.children else [])) for n in nodes]


def flat(nodes):
    return [x for n in nodes for x in (f"{n.label} {n.name}", *(f"  {y}" for y in flat(n.children)))]


PYTHON = [
    ("", []),
    ("import os\n# c\nx = 42\nmyVar = 1\nA, B = 1, 2\nobj.MAX = 1\nx += 1\n_ = 3\n", []),
    ("def foo():\n    pass\n\nasync def bar():\n    def inner(): pass\n", [("def", "foo", 1, 2), ("def", "bar", 4, 5)]),
    ("class Foo:\n    MAX = 1\n    x: int\n    @property\n    def m(self):\n        pass\n    class In:\n        def k(self): pass\n", [("class", "Foo", 1, 8, [("var", "MAX", 2, 2), ("var", "x", 3, 3), ("def", "m", 4, 6), ("class", "In", 7, 8, [("def", "k", 8, 8)])])]),
    ("@a\n@b(\n 1)\nclass P:\n    y: int = 2\n", [("class", "P", 1, 5, [("var", "y", 5, 5)])]),
    ("MAX_SIZE = 100; HTTP2 = 1\nx: int\ntype V[T] = list[T]\n", [("var", "MAX_SIZE", 1, 1), ("var", "HTTP2", 1, 1), ("var", "x", 2, 2), ("type", "V[T]", 3, 3)]),
    ("if a:\n    def f(): pass\nelif b:\n    def g(): pass\nelse:\n    def h(): pass\n", [("def", "f", 2, 2), ("def", "g", 4, 4), ("def", "h", 6, 6)]),
    ("try:\n    class A: pass\nexcept E:\n    class B: pass\nelse:\n    C = 1\nfinally:\n    D = 1\n", [("class", "A", 2, 2), ("class", "B", 4, 4), ("var", "C", 6, 6), ("var", "D", 8, 8)]),
    ("for i in x:\n    F = 1\nelse:\n    G = 1\nwhile 1:\n    H = 2\nwith o() as f:\n    if 1:\n        def d(): pass\nmatch x:\n    case 1:\n        K = 1\n", [("var", "F", 2, 2), ("var", "H", 6, 6), ("def", "d", 9, 9), ("var", "K", 12, 12)]),
    ("def ok():\n    return 1\n\ndef broken(:\n    pass\n\nclass Later:\n    Z = 1\n", [("def", "ok", 1, 2), ("class", "Later", 7, 8, [("var", "Z", 8, 8)])]),
]
RUST = [
    ("", []),
    ("fn foo() {}\n/// doc\n#[inline]\npub(crate) async unsafe fn bar<T: Into<u8>>(x: [u8; 3]) -> Vec<T>\nwhere T: Clone {\n  let s = \"}\"; let c = '}'; let r = r#\"}\"#; // }\n}\n", [("fn", "foo", 1, 1), ("fn", "bar", 4, 7)]),
    ("struct A;\nstruct B(u8);\npub struct C<'a> { x: &'a str }\nenum E { X, Y }\nunion U { a: u8 }\nuse a::{b, c};\nextern crate x;\n", [("struct", "A", 1, 1), ("struct", "B", 2, 2), ("struct", "C", 3, 3), ("enum", "E", 4, 4)]),
    ("const N: usize = { 3; 4 };\nstatic mut S: [u8; 2] = [1, 2];\ntype T<A> = Vec<A>;\nmacro_rules! m { ($x:expr) => { $x; } }\nmacro_rules! k ( () => () );\nmod outer;\n", [("const", "N", 1, 1), ("static", "S", 2, 2), ("type", "T", 3, 3), ("macro", "m", 4, 4), ("macro", "k", 5, 5), ("mod", "outer", 6, 6)]),
    ("trait Tr: Sized {\n    const X: u8;\n    type Out;\n    fn sig(&self);\n    fn has(&self) -> u8 { 1 }\n}\n", [("trait", "Tr", 1, 6, [("const", "X", 2, 2), ("fn", "has", 5, 5)])]),
    ("mod inner {\n    fn bar() {}\n    struct No;\n    mod deep { fn no() {} }\n    type Y = u8;\n}\n", [("mod", "inner", 1, 6, [("fn", "bar", 2, 2), ("type", "Y", 5, 5)])]),
    ("impl Point { fn new() -> Self { Self { x: 0 } } const Q: u8 = 1; }\nimpl<T> fmt::Display for Wrap<T> where T: Clone { fn f() {} }\nimpl Foo for &str {}\nimpl From<u8> for u32 {}\nunsafe impl Send for X {}\nimpl<'a> Iterator for a::B<'a> { type Item = u8; }\nimpl [u8] {}\n",
     [("impl", "Point", 1, 1, [("fn", "new", 1, 1), ("const", "Q", 1, 1)]), ("impl", "fmt::Display for Wrap<T>", 2, 2, [("fn", "f", 2, 2)]), ("impl", "Foo for", 3, 3), ("impl", "From<u8> for", 4, 4), ("impl", "Send for X", 5, 5), ("impl", "a::B<'a>".join(["Iterator for ", ""]), 6, 6, [("type", "Item", 6, 6)])]),
    ("/* a /* nested { */ fn no() {} */\nfn yes() { /* } */ }\nextern \"C\" { fn c(); }\npub extern \"C\" fn d() {}\nlazy! { fn no2() {} }\nthread_local!(static X: u8 = 1);\nconst fn e() {}\n", [("fn", "yes", 2, 2), ("fn", "d", 4, 4), ("fn", "e", 7, 7)]),
]
TYPESCRIPT = [
    ("", []),
    ("function greet(name: string): string { return name; }\nfunction* gen() { yield 1; }\nasync function f(): Promise<void> {}\nfunction over(a: string): void;\nfunction over(a: any): { x: number } { return a; }\n", ["function greet", "function gen", "function f", "function over"]),
    ("const h = () => {};\nlet g = function() {};\nvar k = async <T>(x: T): Promise<T> => x\nconst p = (d: string): { a: number } => {\n  return d;\n}, q = 1, r = x => x\nconst n = 42, o = { a: () => 1 }, a = [1], c = (() => 1)(), t = a ? () => 1 : b\n", ["function h", "function g", "function k", "function p", "function r"]),
    ("class A extends B<C> implements D {\n  host: string;\n  port = 1\n  #secret?: number\n  static readonly z: () => void = () => { return; };\n  constructor(private db: Db) {}\n  get v(): number { return 1; }\n  set v(x: number) { }\n  async *run<T>(): AsyncGenerator<T> { yield 1; }\n  over(a: string): void;\n  over(a: any) {}\n  @dec() method() { return `a${ { b: `}` }.b }`; }\n  [key: string]: any;\n  static { init(); }\n  get = 5;\n  [Symbol.iterator]() {}\n  'quoted'(): void {}\n}\n",
     ["class A", "  property host", "  property port", "  property #secret", "  property z", "  method constructor", "  get v", "  set v", "  method run", "  method over", "  method over", "  method method", "  property get", "  method [Symbol.iterator]", "  method 'quoted'"]),
    ("abstract class Base {\n  abstract doWork(): void;\n  abstract x: number;\n  concrete(): void {}\n}\n", ["abstract class Base", "  method doWork", "  property x", "  method concrete"]),
    ("interface Config extends A, B<{ q: 1 }> {\n  host: string;\n  port?: number,\n  connect(): void\n  on(force?: boolean): Promise<void>;\n  cb: (a: string) => void;\n  (call: number): string;\n  new (x: number): Config;\n  [i: number]: string;\n  readonly r: { a: 1; b: 2 }\n  get g(): string;\n}\n", ["interface Config", "  property host", "  property port", "  method connect", "  method on", "  property cb", "  property r", "  method g"]),
    ("type Id = string;\ntype R<T> = { ok: true; value: T } | { ok: false }\ntype F =\n  | 'a'\n  | 'b'\nenum S { A, B }\nconst enum D { Up }\nlet type = 3;\n", ["type Id", "type R", "type F", "enum S", "enum D"]),
    ("namespace V {\n  export function ok(s: string): boolean { return /[/}]/.test(s); }\n  namespace W.X { class In { m() {} } }\n}\nmodule M { export class I {} }\n", ["namespace V", "  function ok", "  namespace W.X", "    class In", "      method m", "namespace M", "  class I"]),
    ("declare function require(id: string): any;\ndeclare const a: string, b: number;\ndeclare module 'express' { export interface Request {} }\ndeclare class Buf { constructor(s: string); }\ndeclare global { interface Window {} }\ndeclare enum E { A }\ndeclare type T = string;\ndeclare namespace N.O { const x: 1; }\ndeclare let c\n", ["declare require", "declare a", "declare b", "declare 'express'", "declare Buf", "declare E", "declare T", "declare N.O", "declare c"]),
    ("export function f(): void {}\nexport class S {}\nexport interface I { host: string; }\nexport type Id = string;\nexport enum C { R }\nexport const h = () => {};\nexport default function main() {}\nexport { foo } from './foo';\nexport * from './u';\nexport type { Q } from './q';\nexport default class App {}\nexport default () => 1;\nexport declare const z: number;\nexport abstract class Ab {}\nexport = foo;\nimport { type X } from 'y';\nexport default function () {}\nexport function last() {}\n",
     ["function f", "class S", "interface I", "  property host", "type Id", "enum C", "function h", "function main", "class App", "declare z", "abstract class Ab", "function last"]),
    ("if (a) { function no() {} }\nfor (const i of x) { const f = () => 1; }\nfoo(() => { class No {} });\nconst x = a\n  .b(() => 1)\n  .c\nlabel: while (1) {}\nswitch (x) { case 1: function no2() {} }\ntry { } catch (e) { }\nfunction yes() {}\n", ["function yes"]),
]


@pytest.mark.parametrize(("source", "want"), PYTHON)
def test_python(source, want):
    assert shape(lang_python.extract(source)) == want


@pytest.mark.parametrize(("source", "want"), RUST)
def test_rust(source, want):
    assert shape(lang_rust.extract(source)) == want


@pytest.mark.parametrize(("source", "want"), TYPESCRIPT)
def test_typescript(source, want):
    assert flat(lang_typescript.extract(source)) == want


def test_ranges_are_those_of_the_source():
    cut = lambda e, s: [(n.name, s.encode()[n.start : n.end].decode(), n.lines) for n in e(s)]
    ts = "// é\n@dec\nexport class A {\n  m() {}\n}\nexport const f = () => {\n  1\n};\n@d class B {}\ndeclare const x: 1,\n  y: 2;\n"
    assert cut(lang_typescript.extract, ts) == [
        ("A", "@dec\nexport class A {\n  m() {}\n}", (3, 5)), ("f", "const f = () => {\n  1\n};", (6, 8)), ("B", "@d class B {}", (9, 9)),
        ("x", "declare const x: 1,\n  y: 2;", (10, 10)), ("y", "declare const x: 1,\n  y: 2;", (11, 11)),
    ]
    assert cut(lang_rust.extract, "// ü\n#[a]\npub fn f() {\n}\nstruct S;") == [("f", "pub fn f() {\n}", (3, 4)), ("S", "struct S;", (5, 5))]
    assert cut(lang_python.extract, "﻿é = 1\n@d\ndef f():\n    'ü'\n") == [("f", "@d\ndef f():\n    'ü'", (2, 4))]
    members = lang_typescript.extract("class A {\n  @i() a = 1;\n  @o() m(): void {}\n}")[0].children
    assert [(n.start, n.end) for n in members] == [(12, 22), (31, 43)]


@pytest.mark.parametrize("extract", [lang_python.extract, lang_rust.extract, lang_typescript.extract])
def test_odd_texts_end(extract):
    for text in ("}" * 50, "{" * 50, "(" * 30 + ")]}" * 9, "'", '"', "`${", "/* a", "impl", "pub", "fn", "class", "@", "export", "export default", "declare", "const", "type =", "\x00", "impl for", "macro_rules! x", "r#\"", "interface", "namespace a.", "class A { x", "function f(", "async", "#"):
        extract(text)
        extract(text + "\nfn f() {}\ndef g(): pass\n")


def test_rows_are_nested_sets():
    got = list(rows("a.rs", "impl P { fn a() {} fn b() {} }\nfn c() {}", lang_rust.extract("impl P { fn a() {} fn b() {} }\nfn c() {}")))
    assert [(r[1], r[2], r[3], r[4], r[5], r[7]) for r in got] == [(0, 2, None, 0, "a.rs::P", "P"), (1, 1, 0, 1, "a.rs::P/a", "P/a"), (2, 2, 0, 1, "a.rs::P/b", "P/b"), (3, 3, None, 0, "a.rs::c", "c")]
    assert got[1][14] == got[1][15] and got[0][14] != got[0][15]
    assert [total_lines(x) for x in ("", "a", "a\n", "a\nb", "\n\n")] == [0, 1, 1, 2, 2]


def test_scan_of_a_project(spark, tmp_path):
    from pyspark.sql import functions as F

    from sightline import functions as X

    (tmp_path / ".git").mkdir()
    for path, text in {"src/a.rs": "fn é() {}\n", "src/b/c.py": "class A:\n    def m(self): pass", "src-x/d.ts": "function f() {}", "out/e.rs": "fn no() {}", ".hid/f.rs": "fn no() {}", "g.txt": "x", "src/skip_me.rs": "fn no() {}", "src/keep_me.rs": "", "h[1].py": "X = 1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("/out/\n*_me.rs\n!keep_me.rs\n")
    assert code.project_files(str(tmp_path)) == ["h[1].py", "src/a.rs", "src/b/c.py", "src/keep_me.rs", "src-x/d.ts"]
    assert code.project_files(str(tmp_path), lambda p: p.startswith("src/")) == ["src/a.rs", "src/b/c.py", "src/keep_me.rs"]
    files, symbols = code.scan(spark, str(tmp_path))
    assert {r.file_path: r.total_lines for r in files.collect()} == {"h[1].py": 1, "src/a.rs": 1, "src/b/c.py": 2, "src/keep_me.rs": 0, "src-x/d.ts": 1}
    got = {r.id: r for r in symbols.collect()}
    assert set(got) == {"h[1].py::X", "src/a.rs::é", "src/b/c.py::A", "src/b/c.py::A/m", "src-x/d.ts::f"} and got["src/a.rs::é"].byte_end == 10
    text = "def m(self): pass"
    hashed = spark.range(1).select(X.content_hash(F.lit(text)).alias("h"), X.estimate_tokens(F.lit(text)).alias("n")).first()
    assert (got["src/b/c.py::A/m"].content_hash, got["src/b/c.py::A/m"].estimated_tokens) == (hashed.h, hashed.n)
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'")
    with pytest.raises(Exception, match="not UTF-8"):
        code.scan(spark, str(tmp_path))[1].collect()
