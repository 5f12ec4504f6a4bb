"""Recognizers: programs that are valid, and texts that are not."""

import pytest

from sourcelume.llm.invalid_source import error_rates, parse_errors
from sourcelume.llm.syntax import first_error

VALID = {
    "python": [
        "", "# only a comment", "x = 1", "def f(a, /, b: int = 2, *args, c=3, **kw) -> dict[str, int]:\n    return {**kw, 'a': a}\n",
        "async def g():\n    async with a() as b, c() as d:\n        yield await b\n    return [x async for x in y if x]\n",
        "match x:\n    case {'a': [1, *rest], **kw} if rest:\n        pass\n    case Point(x=0, y=-1.5) | None:\n        pass\n    case _:\n        pass\n",
        "try:\n    pass\nexcept* (ValueError, KeyError) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n",
        "with (open('a') as f, open('b')):\n    pass\n", "type A[T: int] = list[T]\nclass C[T](Base, metaclass=M):\n    x: int\n    y = lambda *a, k=1: (yield)\n",
        "if (n := len(a)) > 10: print(f\"{n!r:>{width}} {d['k']}\")\nelif a: pass\nelse:\n\tpass\n", "a = b = c, *d = e[1:2, ::3, ...]\ndel a[0], b.c\nassert x, 'no'\nglobal z\n",
        "x = '''<<<<<<< HEAD\n=======\n>>>>>>> x\n'''\n", "match = 1\ntype = case = _ = match\nprint(match, type)\n", "@a.b(c)\n@d\nclass E: pass\n", "0x_ff + 1_000.5e-3j + 0b10 + 0o17\n", "x = (1,\n     2)  # c\n\n\n",
    ],
    "javascript": [
        "", "// c\n/* d */", "import a, { b as c, default as d } from 'e'\nimport * as f from \"g\"\nexport * from 'h'\nexport default class {}\n", "a\nb\n++c\nlet x = a\n  .b()\n  .c\nreturn_(1)",
        "const f = async ({ a, b: [c = 1, ...d], ...e }, g = {}) => { for await (const x of y) z(x); }", "label: for (let i = 0, n = 3; i < n; i++) { if (i) continue label; else break }",
        "class A extends (B, C) { #p = 1; static x = 2; static { y() } get z() { return this.#p } async *[Symbol.iterator]() { yield* a } constructor(...r) { super(...r) } }",
        "const r = /[/\\]]+/gi.test(a) ? b / c / d : `t ${a + `${b}`} ${{ k: 1 }.k}`", "x = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, set e(v) {}, async f() {}, *g() {}, ...h, if: 3 }",
        "do x++; while (x < 5)\nvar y = a ?? b?.c?.[0]?.(1)", "switch (a) { case 1: case 2: b(); break; default: c() }", "try { a() } catch { b() } finally { c() }", "x = y ** 2 >>> 3n; z ||= a && b", "if (a) function_(); else { }\n;[1].map(x => x)",
        "export const a = 1, b = function* () {}\nexport { a as default, b }\nnew Foo\nnew a.b.C(1).d()",
    ],
    "typescript": [
        "interface A<T extends object = {}> extends B, C<T> { readonly a?: string; [k: string]: any; (x: number): void; new (): A<T>; m?<U>(u: U): u is U }",
        "type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never } | 'a' | `x${string}` | (new () => void)[] | typeof x.y | [a: string, b?: number, ...rest: T[]]",
        "abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(public a: string, protected b?: number) { super() } abstract f(): void; static g<T>(x: T): x is T { return true } declare y: string }",
        "enum E { A = 1, B = 'x' }\nconst enum F { A }\ndeclare module 'm' { export function f(x: number): string }\nnamespace N.M { export const x = 1 }", "function f(x: string): void\nfunction f(x: any) { return <T>(y: T) => y as unknown as string }",
        "const a = b!.c satisfies D; let x: Array<Array<number>> = []; f<string>(1); import type { T } from 'm'; import x = require('y'); export type { T }; export = a", "let g = (a: number, b?: string): Promise<any> => null, h = async <T,>(x: T) => x; for (const k in o as any) {}", "@Dec({ a: 1 }) class X { @In() y!: string; @Out() z = new E<string>() }",
    ],
    "tsx": ["export function A({ b }: { b: string }): JSX.Element { return (<div className=\"x\" {...p} on={() => f(1)}>{b} text's {/* c */}<B.C /><>{a ? <i>1</i> : null}</></div>); }", "const x = <T,>(y: T) => y < 3; const z = a < b;"],
    "go": [
        "package a\n", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n\t. \"x\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tm map[string][]chan<- int\n}\n\ntype I interface {\n\tF(a, b int, c ...string) (x int, err error)\n\t~int | ~string\n}\n",
        "package a\nfunc (r *T[K]) F(a int) (int, error) {\n\tif x, ok := m[a]; !ok {\n\t\treturn 0, nil\n\t} else if y {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor k, v := range m {\n\t\tswitch t := v.(type) {\n\t\tcase int, *T:\n\t\tdefault:\n\t\t}\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase x := <-d:\n\t}\n\tgo func() { defer f() }()\n\treturn a[1:2:3][0], &T{A: 1, B: []int{1, 2}[0]}\n}\n",
        "package a\n\nvar x, y = 1, `raw\n`\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc f[T any](x T) T { return g[T](x) }\nfunc h() { x := []struct{ a int }{{1}, {2}}; for { break }; L: for ; ; { goto L } }\n", "package a\nfunc f() { for x < 6600 { x += 0x1p-2 + 'a' + '\\n' }; i++; a, b = b, a; p := func(a int) {}; _ = [...]string{2: \"a\"} }\n",
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\npublic final class A<T extends B & C> extends D<T> implements E, F { int[] x = {1, 2}, y[]; static { z(); } A() throws X { this(1); } @Override public <U> U f(final int a, String... b) { return (U) null; } }",
        "sealed interface S permits A, B {}\nrecord A(int x, @N String y) implements S { A { if (x < 0) throw new E(\"\"); } }\nnon-sealed class B implements S {}\nenum G { X(1) { void f() {} }, Y; int z; }\n@interface An { String v() default \"a\"; int[] w() default {1}; }",
        "class A { Object f(Object o) { if (o instanceof String s && s.length() > 1) return s; var r = switch (o.hashCode()) { case 1, 2 -> \"a\"; case 3 -> { yield \"b\"; } default -> throw new X(); }; for (var x : y) {} for (int i = 0, j = 1; i < 3; i++, j--) {} try (var c = d(); e) {} catch (A | B e) {} finally {} synchronized (this) {} l: while (true) break l; do x--; while (x > 0); return a ? b : (c) -> d; } }",
        "class A { void f() { Map<String, List<Integer>> m = new HashMap<>() {{ put(\"a\", null); }}; g(Integer::sum, int[]::new, A::<T>h, this::x); int x = (int) 1L >>> 2; Runnable r = () -> {}; a.new B(); String s = \"\"\"\n  t\n  \"\"\"; assert x > 0 : \"no\"; int[][] q = new int[3][]; char c = '\\u0041'; x = y = 3; } }",
    ],
    "rust": [
        "", "//! d\n#![allow(x)]\nuse std::{collections::HashMap, io::{self, Read as R, *}};\npub(crate) mod a { pub use super::b; }\nextern crate c as d;\n",
        "impl<'a, T: ?Sized + Clone + 'a, const N: usize> Tr<T> for S<'a, T, N> where T: Fn(u8) -> u8, for<'b> &'b T: Q { type X = Vec<T>; const Y: u8 = 1; fn f(&mut self, (a, b): (u8, &str)) -> Result<(), Box<dyn Error + Send>> { Ok(()) } }",
        "fn main() { let x = if a { 1 } else { 2 }; let Some(y) = z else { return; }; match x { 0..=9 | 11 if y => {} Foo { a, ref b, .. } => b?, &[p, .., q] => {}, n @ 1.. => (), _ => {} } while let Some(i) = it.next() { continue } 'l: loop { break 'l 3 } let c = move |a: u8, _| -> u8 { a }; println!(\"{}\", x); vec![1; 3]; S { a: 1, ..d }; a as u8 < b; (1..2).for_each(|_| {}); unsafe { *p += 1 } for i in 0..n {} async {}.await; x.0.1 = 2; r#\"a\"b\"#; b'a' }",
        "enum E { A = 1, B(u8), C { x: u8 } }\nstruct U;\nstruct P(pub u8, #[x] u8);\nstatic mut X: &[&str] = &[\"a\"];\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\ntrait T: A + B { fn f(self: Box<Self>); }\nconst fn g<T>() -> impl Iterator<Item = T> + '_ { h::<T, { 1 + 2 }>() }\npub unsafe extern \"C\" fn k(x: *const u8, f: fn(u8) -> u8, _: ...) -> ! { loop {} }",
    ],
}
INVALID = {
    "python": ["def f(:\n", "if x\n    y\n", "x = (1,\n", "def f():\nreturn 1\n", "  x = 1\n", "if a:\n    b\n  c\n", "<<<<<<< HEAD\n", "print 'a'\n", "x = 'abc\n", "class A:\n", "a b\n", "x = 1__0\n", "for x in:\n    pass\n", "try:\n    a\n", "x = f'{a'\n", "package main\n", "x = 0123\n"],
    "javascript": ["function f( {", "let x = ;", "{ \"a\": 1, \"b\": 2 }", "interface A {}", "let x: number = 1", "a b", "const f = (a) = > a", "<<<<<<< HEAD\nx\n=======\n", "import x from y", "`abc", "var a = 'x\n'", "class { }", "<div>a</div>", "if (a { b }", "x = [1, 2", "def f():\n    pass\n", "return x as any"],
    "typescript": ["type A = ;", "interface A { x: }", "function f(a: ) {}", "class A { private }}", "<!DOCTYPE html>\n<html></html>", "let x: Array<string = 1;", "enum { A }"],
    "tsx": ["const x = <div>a</span>;", "const x = <div>", "const x = <div a=>b</div>;"],
    "go": ["// only\n", "func f() {}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { if x { } else y }\n", "package a\nimport fmt\n", "package a\nvar x = \"abc\n", "package a\nfunc f()\n{\n}\n", "package a\ntype T struct { a, }\n"],
    "java": ["class A {", "class A { void f() { int x = ; } }", "public void f() {}", "class A { f( { } }", "import a.b.C\nclass A {}", "class A { String s = \"abc; }", "def f(): pass", "class A { int x = 1 int y; }", "class A { void f() { a b c; } }"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct S { a u8 }", "fn f() { match x { 1 => } }", "use a::;", "fn f() { x = \"abc }", "impl S { x }", "fn f() -> { }", "let x = 1;", "fn f() { a b }", "class A {}"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_programs(lang):
    assert [t for t in VALID[lang] if first_error(lang, t) is not None] == []


@pytest.mark.parametrize("lang", sorted(INVALID))
def test_invalid_texts(lang):
    assert [t for t in INVALID[lang] if first_error(lang, t) is None] == []


def test_first_error_line():
    assert first_error("python", "a = 1\nb = 2\nc = = 3\nd = 4\n") == 3
    assert first_error("java", "class A {\n  int x = 1;\n  int y = ;\n}\n") == 3
    assert first_error("javascript", "f(1)\nlet y = 3 4\n") == 2
    assert first_error("go", "package a\n\nfunc f() {\n\tx := := 1\n}\n") == 4


def test_long_and_deep_texts():
    assert first_error("javascript", "x = " + "(" * 3000 + "1" + ")" * 3000) is None
    assert first_error("python", "x = [" + "1, " * 200_000 + "]\n") is None
    assert first_error("rust", "fn f() { " + "{" * 2000) is not None


def test_operator(spark):
    rows = [(1, 1, "python", "x = 1", "extra"), (2, 1, "python", "x = (", "e"), (2, 1, "python", "x = (", "e"), (3, None, "go", "", None), (4, 2, None, "x = (", None), (5, 2, "cobol", "x", None), (6, 2, "java", None, None), (7, None, "go", "x", None)]
    files = spark.createDataFrame(rows, "id int, repo_id int, lang string, content string, error_line string")
    out = parse_errors(files, ["id", "repo_id"])
    assert {(r["id"], r["error_line"] is None) for r in out.collect()} == {(1, True), (2, False), (3, True), (7, False)}
    assert out.count() == 5
    rates = {(r["repo_id"], r["lang"]): (r["files"], r["invalid"], r["rate"]) for r in error_rates(out, "repo_id", "lang").collect()}
    assert rates == {(1, "python"): (3, 2, 0.666667), (None, "go"): (2, 1, 0.5)}
    assert parse_errors(files.limit(0), ["id"]).count() == 0


def test_memory_is_shared_and_dropped(monkeypatch):
    """Whatever the languages, the recognizers together stay within one budget; results do not depend on it."""
    from sourcelume.llm.syntax import glr

    texts = [("python", "x = [i for i in range(3)]\n"), ("go", "package p\nfunc f() int { return 1 }\n"), ("java", "class A { int f() { return 1; } }\n"), ("rust", "fn f() -> u8 { 1 }\n"), ("python", "def f(:\n"), ("go", "package p\nfunc {\n")]
    want = [first_error(lang, t) for lang, t in texts]
    monkeypatch.setattr(glr, "ROOM", 50)
    assert [first_error(lang, t) for lang, t in texts * 3] == want * 3
    assert sum(r.held() for r in glr._all if len(r.step) > 200) == 0 or max(r.held() for r in glr._all) < 3_000
