"""Code, leakage and span operators against brute force and independent parsers."""

import ast
import random
import re
from datetime import datetime
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import docpairs, leakage, spans, syntax
from lodestone.llm.codelex import combine, cut, summarise, verdict

JAVA = """package a.b;
import java.util.*;
/** Class comment with enough words here. */
public sealed class X<T extends Comparable<T>> extends Y implements Z permits Q {
  private static final Map<String, List<int[]>> M = new HashMap<>();
  enum E { A, B(1) { void f() {} }, C; int x; }
  record P(int a, String... b) { P { if (a < 0) throw new IllegalArgumentException("}"); } }
  @interface An { int v() default 3; }
  /** Loads every row { of the table once. @see x */
  @Override @SuppressWarnings({"a", "b"})
  public <R> Map<String, R> load(final int[] a, List<? super T>... b) throws IOException, E2 {
    for (int i = 0, j = 1; i < a.length; i++, j >>>= 1) { a[i] <<= 2; }
    for (var s : b) { label: while (true) { break label; } }
    Runnable r = () -> { int q = a.length > 3 ? (int) 4L : -1; };
    Function<String, Integer> f = Integer::parseInt; Supplier<int[]> g = () -> new int[] {1, 2};
    String t = switch (a[0]) { case 1, 2 -> "x"; default -> { yield "y"; } };
    if (t instanceof String s2 && s2.length() > 0) { synchronized (this) { assert a != null : "m"; } }
    try (var in = open(); in2) { do { x++; } while (x < 3); } catch (A | B e) { throw e; } finally { ; }
    String block = \"\"\"
      not " a // comment \\\"\"\" here
      \"\"\";
    switch (x) { case 'a': case '\\u0041': return null; default: }
    int[][] m = new int[3][]; Object o = new Object() { int z; }; char c = '\\'';
    this.<R>call(X.super::load, int[]::new);
    return (Map<String, R>) M;
  }
  /** todo write this down some day */
  void skip() {}
  /* Not a documentation comment at all here. */
  abstract int none();
}
"""
TS = """#!/usr/bin/env node
import type { A } from "./a"; import B, * as C from 'c'; export * from "d"; export { x as default };
declare module "m" { export const v: number }
/** Sums all given numbers into one value. */
export async function sum<T extends number = 1>(this: Foo, { a, b: [c] = [] }: X, ...rest: number[]): Promise<void> {
  const re = /[/"]+\\/(?<n>a)/gi, half = a / b / c, t = `x ${fn(`y ${{ a: 1 }.a}`)} z`;
  for (const [k, v] of Object.entries(m)) { if (k in m) continue; else break }
  for (let i = 0, n = 1; i < n; i++) {}
  let f = async <U,>(x: U): Promise<U> => x, g = x => ({ ...x, y, [z]: 1, get q() { return 1 }, async *r() {} })
  const h = a < b ? (c) : d, i = cond ? (x): number => 1 : 2
  label: do { x!.y?.[0]?.(1) } while (x as unknown as string)
  return new Map<string, Array<Array<number>>>() as never
  /** Inner function that has a comment too. */
  function inner(): x is string { return x satisfies T }
}
abstract class K<T> extends (Base as any)<T> implements I, J {
  static { init(); }
  #p = 1; declare readonly q?: string; [key: string]: any; static async *gen(): AsyncGenerator<{ a: number }> {}
  constructor(private readonly a: A, public b = 2) { super(); }
  /** Reads the whole configuration file {@link a} once. */
  @dec({ a: 1 }) public get value(): { a: number } | null { return null }
  abstract f(): void
  over(a: string): void; over(a: any) {}
}
interface I2 extends I<string> { (a: number): string; new (x: any): I2; readonly [k: string]: unknown; /** Gives the name of this thing back. */ name?(a: typeof import("x")): asserts a is string, m: { [K in keyof T as `get${K}`]?: T[K] } }
type Z<T> = T extends (infer U extends string)[] ? U | null : { -readonly [K in keyof T]-?: T[K] } & (new () => void) | `a${string}` | readonly [a?: string, ...b: number[]];
const enum E { A = 1, B = "x".length }
namespace N.M { export function deep() {} }
export default class {}
"""


def test_grammars_take_the_language():
    assert syntax.parses(JAVA, "java") and syntax.parses(TS, "typescript")
    assert syntax.parses("", "java") and syntax.parses("", "typescript") and syntax.parses("", "python")
    assert syntax.parses("\ufeffx = 1\r\n", "python")


@pytest.mark.parametrize("lang", ["java", "typescript"])
def test_truncation_is_seen(lang):
    text = JAVA if lang == "java" else TS.split("namespace N.M")[0] + "function last() { return 1 }\n"
    body = text.rindex("}")
    begin = text.index("class" if lang == "java" else "export async")
    wrong = [i for i in range(begin + 40, body if lang == "java" else text.index("abstract class K"), 7) if syntax.parses(text[:i], lang)]
    # A signature without a body is an overload for the parser.
    assert not [i for i in wrong if not re.search(r"\): \w+(<void>)?\s*$", text[:i])]


@pytest.mark.parametrize(
    ("lang", "text"),
    [
        ("java", "class A { int f() { a + b; } }"), ("java", "class A { <<<<<<< HEAD\n }"), ("java", "def f():\n  pass"), ("java", "class A { int x = ; }"), ("java", "class A { void f() { if (x) } }"),
        ("java", "class A { String s = 'ab'; }"), ("java", "class A { void f() { try { } } }"), ("java", '{"a": 1}'), ("java", "class A {} }"), ("java", "# Readme\n\ntext"), ("java", "class A { void f() { int class = 1; } }"),
        ("typescript", "package a.b;"), ("typescript", "public class A { }"), ("typescript", "const x = ;"), ("typescript", "=======\n"), ("typescript", "def f():\n  return 1"), ("typescript", '{"a": 1, "b": 2}'),
        ("typescript", "const a = `x ${1 `;"), ("typescript", "function f( { }"), ("typescript", "let x: = 1"), ("typescript", "class A { f() { }"), ("typescript", "a b"), ("typescript", "try { }"), ("typescript", "<html><p>x</p>"),
        ("python", "def f(:\n  pass"), ("python", "x = (1\n"), ("python", "\0"), ("python", "if x:\nprint(1)"),
    ],
)
def test_broken(lang, text):
    assert not syntax.parses(text, lang)


@pytest.mark.parametrize("lang", ["java", "typescript", "python"])
def test_chunks_reduce_associatively(lang):
    text = {"java": JAVA, "typescript": TS.replace("`x ${fn(`y ${{ a: 1 }.a}`)} z`", "`x\n{ ( ${\nfn(`y\n ${{\n a: { b: 1 }\n }.a}\n`)\n}\n ) z`"), "python": 'def f(a,\n  b):\n  """Doc (\n [ {\n"""\n  return {"a": [1,\n 2]}\n' * 3}[lang]
    for size in (10, 60, 300):
        parts = cut(text, size)
        assert "".join(parts) == text
        maps, begin = [], 0
        for p in parts:
            maps.append(summarise(p, lang, begin))
            begin += len(p)
        left = reduce(combine, maps)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = combine(m, right)
        assert left == right and verdict(left)
        assert not verdict(reduce(combine, maps[: len(maps) // 2] or [summarise("(", lang)])) or len(maps) == 1 or lang == "python"


@pytest.mark.parametrize(("lang", "text", "ok"), [
    ("typescript", "const a = `\n${\nf({\n a: 1\n})\n}\n`\n", True), ("typescript", "const a = `\n${\nf({\n a: 1\n}\n}\n`\n", False), ("typescript", "function f() {\n}\n}\n", False),
    ("typescript", "const a = `\n}\n${\n`\n${\n1\n}\n`\n}\n`\nif (a) {\n}\n", True), ("typescript", "{\n`\n", False), ("typescript", "/*\n`{\n*/\n", True), ("typescript", "let x = 1\n  / 2\nlet y = {\n}\n", True),
    ("java", "class A {\n/*\n}}\n*/\n}\n", True), ("java", "class A {\n/*\n}}\n}\n", False), ("java", 'class A {\nString s = """\n  } " (\n""";\n}\n', True), ("java", "class A {\n(\n}\n)\n", False),
])
def test_maps_of_lines(lang, text, ok):
    """Every line a chunk of its own, so that strings, comments and templates are entered in the middle."""
    assert all(syntax.balanced(text, lang, size) is ok for size in (1, 8, 20, 10_000))


@pytest.mark.parametrize(("lang", "text"), [("java", "class A {{ int x = %s1%s; }}"), ("typescript", "const x = %s1%s"), ("typescript", "const x = %s%s")])
def test_deep_nesting_is_no_fault(lang, text):
    n = 4_000
    a, b = ("[", "]") if text.endswith("%s%s") else ("(", ")")
    assert syntax.parses(text.replace("{{", "{").replace("}}", "}") % (a * n, b * n), lang) and not syntax.parses(text.replace("{{", "{").replace("}}", "}") % (a * n, b * (n - 1)), lang)


def test_python_runs_agree_with_the_whole():
    text = "".join(f'@d\ndef f{i}(a):\n    """D\nx = (\n"""\n    if a:\n        pass\n    else:\n        return [\n1]\n\nif f{i}:\n  pass\nelif 1:\n  pass\n' for i in range(40))
    for size in (5, 50, 500):
        runs = list(syntax.python_statements(text, size))
        assert "".join(runs) == text and all(syntax._python_parses(r) for r in runs)
    assert syntax.parses(text, "python", 50) and not syntax.parses(text + "def g(:\n", "python", 50)


FILES = "file_id string, repository_id string, language string, path string, content string, indexed_at timestamp_ntz, lang string, broken string"


def files(spark, rows):
    return spark.createDataFrame([(i, "r", lang, p, c, datetime(2025, 1, day), "clash", "clash") for i, lang, p, c, day in rows], FILES)


def test_broken_files(spark):
    long = "class A {\n" + "  int f(int a) { return (a); } // {\n" * 400 + "}\n"
    rows = [
        ("f1 ", " PYTHON", "a.py", "x = 1", 1), ("f1", "python", "a.py", "x = (", 2), ("f2", "Java ", "A.java", long, 1), ("f3", "java", "B.java", long[:-2], 1), ("f4", "java", None, None, 1), ("f5", None, "x", "(", 1),
        ("f6", "cobol", "x", "(", 1), ("f7", "typescript", "x.ts", "", 1), (None, "java", "x", "(", 1), ("f8", "python", "x.py", "y = 2\n" * 500, 1), ("f8", "python", "x.py", "y = 2\n" * 500, 1), ("f9", "java", "C.java", long.replace("return (a)", "return a +", 1), 1),
    ]
    want = {"f1": True, "f2": False, "f3": True, "f7": False, "f8": False, "f9": True}
    df = files(spark, rows)
    for chunk, limit in ((64_000, 1_000_000), (500, 2_000)):
        assert {r.file_id: r.broken for r in syntax.broken_files(df, chunk, limit).collect()} == want
    rates = {r.language: (r.n_files, r.n_broken) for r in syntax.broken_rates(syntax.broken_files(df)).collect()}
    assert rates == {"python": (2, 1), "java": (3, 2), "typescript": (1, 0)}
    assert syntax.broken_files(files(spark, [])).count() == 0


def test_documented_functions(spark):
    py = 'class A:\n  def f(self):\n    r"""Reads all of the rows.\n    :param x: y\n    """\n    def g():\n      "One two three four five"\n  def h(self): """Gives it back to them."""\n  async def k(x=(1,\n  2)) -> int:\n    """FIXME do it some day"""\n  def f2(): f"""Not a real docstring here"""\n  def the_read_rows(): """Read the rows of the"""\n'
    df = files(spark, [("p", "python", "./src\\m/n.py", py, 1), ("p", "python", "./src\\m/n.py", py, 1), ("j", "java", "X.java", JAVA, 1), ("t", "TypeScript", "lib/t.ts", TS, 1), ("b", "python", "b.py", py + "(", 1), ("n", "java", "N.java", None, 1)])
    got = {(r.file_id, r.qualified_name): r for r in docpairs.documented_functions(df).collect()}
    assert set(got) == {
        ("p", "src.m.n.A.f"), ("p", "src.m.n.A.f.g"), ("p", "src.m.n.A.h"), ("j", "a.b.X.load"), ("t", "lib.t.sum"), ("t", "lib.t.sum.inner"), ("t", "lib.t.K.value"), ("t", "lib.t.I2.name"),
    }
    assert got["p", "src.m.n.A.f"].description == "Reads all of the rows." and got["p", "src.m.n.A.h"].code.endswith('them."""')
    assert got["j", "a.b.X.load"].code.endswith("}") and got["j", "a.b.X.load"].description.startswith("Loads every row")
    assert got["t", "lib.t.K.value"].description == "Reads the whole configuration file   once."
    assert docpairs.documented_functions(files(spark, [])).count() == 0


def test_python_pairs_agree_with_ast():
    rng = random.Random(1)
    text = "".join(f"{'  ' * d}{'class' if rng.random() < 0.4 else 'def'} n{i}{'' if rng.random() < 0 else '()'}:\n{'  ' * (d + 1)}\"\"\"words {i}\n{'  ' * (d + 1)}and more here\"\"\"\n" for i, d in enumerate([0, 1, 2, 1, 0, 1, 1, 2, 3, 0]))
    want = []

    def walk(node, way):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.ClassDef)):
                if isinstance(c, ast.FunctionDef):
                    want.append((".".join((*way, c.name)), ast.get_docstring(c, clean=False)))
                walk(c, (*way, c.name))

    walk(ast.parse(text), ())
    assert sorted((f.name, f.comment) for f in docpairs.indented(text)) == sorted(want)


@pytest.mark.parametrize(("text", "name", "out"), [("one two three", "f", True), ("TBD one two three four", "f", True), ("Load the nightly manifest of it", "loadNightlyManifest", True), ("Load the nightly manifest again", "loadNightlyManifest", False), ("", "f", True)])
def test_trivial(text, name, out):
    assert docpairs.trivial(text, name) is out


DOCS, ITEMS = "doc_id bigint, text string, source string, item_id string", "item_id bigint, text string, doc_id string"


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 13, 40]))), "clash") for i in range(20)] + [(90, None, ""), (91, "", ""), (None, "a b", "")]
    docs = []
    for d in range(80):
        t = rng.choices(words, k=rng.randrange(60))
        if d % 4 == 0:
            w = items[d % 20][1].split()
            a = rng.randrange(max(1, len(w) - 12))
            t[10:10] = [x.upper() + rng.choice([" ", ", ", "\r\n", "-"]) for x in w[a : a + rng.choice([12, 13, 20])]]
        docs.append((d, " ".join(t), "s", "clash"))
    docs += [(200, None, "s", ""), (201, "", "s", ""), docs[0], (202, " ".join(["same"] * 3000), "s", "")]
    items += [(92, " ".join(["same"] * 20), "")]

    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t, *_ in docs for i, u, _ in items if i is not None and grams(t) & grams(u)}
    D, I = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for edits, most in ((0, 500_000), (0, 10), (1, 500_000), (1, 10)):
        got = leakage.leaks(D, I, max_edits=edits, broadcast_keys=most)
        rows = [(r.doc_id, r.item_id) for r in got.where("least_edits = 0").collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert leakage.leaks(spark.createDataFrame([], DOCS), I).count() == 0 and leakage.leaks(D, spark.createDataFrame([], ITEMS)).count() == 0


def edited(words, k, rng, fresh):
    """words after k edits: insertions, deletions and replacements by new words."""
    out = list(words)
    for _ in range(k):
        kind = rng.randrange(3)
        at = rng.randrange(kind == 0, len(out))  # a word put in front would leave the passage whole
        out[at : at + (kind > 0)] = [] if kind == 1 else [next(fresh)]
    return out


@pytest.mark.parametrize("k", [1, 2])
def test_edit_recall(spark, k):
    """Of all edited windows, insertions and deletions too, each in a document of its own, at least 0.9 are found."""
    rng, fresh = random.Random(k), iter(f"n{i}" for i in range(10**6))
    items = [(i, " ".join(next(fresh) for _ in range(13)), "") for i in range(800)]
    docs = [(i, " ".join([*(next(fresh) for _ in range(20)), *edited(t.split(), k, rng, fresh), *(next(fresh) for _ in range(20))]), "", "") for i, t, _ in items]
    got = {(r.doc_id, r.item_id): r.least_edits for r in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), max_edits=k).collect()}
    assert all(a == b for a, b in got) and max(got.values()) <= k
    assert len(got) >= 0.9 * len(items)


def test_items_shorter_than_a_passage_are_windows_of_their_own(spark):
    items = [(1, "alpha beta gamma delta epsilon", ""), (2, "one two", "")]
    docs = [(1, "x Alpha, beta gamma-delta epsilon y", "", ""), (2, "alpha beta gamma delta epsilon", "", ""), (3, "one two", "", ""), (4, "alpha beta gamma new delta epsilon", "", ""), (5, "beta gamma delta epsilon", "", "")]
    D, I = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): r.least_edits for r in leakage.leaks(D, I, min_words=3).collect()}
    assert got.items() >= {(1, 1): 0, (2, 1): 0}.items() and set(got) <= {(k, 1) for k in (1, 2, 4, 5)} and leakage.leaks(D, I).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=4, max_size=4), st.lists(st.integers(0, 3), min_size=0, max_size=6), st.integers(0, 2))
def test_banded_edits(a, b, most):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (u != v)))
            row = new
        return row[-1]

    wide = (b + [-1] * 6)[: 4 + most]
    want = min(distance(a, wide[:n]) for n in range(max(0, 4 - most), 4 + most + 1))
    got = int(leakage.edits(np.array([a]), np.array([wide]), most)[0])
    assert got == want if want <= most else got > most


def brute_pairs(docs, n):
    grams = {d: {t[i : i + n] for i in range(len(t) - n + 1)} for d, t in docs if d is not None and t is not None}
    ids = sorted(grams)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if grams[a] & grams[b]}


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(4)
    letters = "ab𝄞é "
    docs = [(i, "".join(rng.choices(letters, k=rng.randrange(200)))) for i in range(40)]
    for i in range(40, 70):
        s = docs[rng.randrange(30)][1]
        a = rng.randrange(max(1, len(s) - 30))
        docs.append((i, "".join(rng.choices(letters, k=20)) + s[a : a + rng.choice([29, 30, 31, 60])] + "".join(rng.choices(letters, k=20))))
    docs += [(70, "x" * 500), (71, "x" * 30), (72, "xy" * 100), (73, docs[3][1]), (74, docs[3][1]), (75, None), (76, ""), (77, "ab" * 300 + "q" + "ab" * 40), (None, "x" * 99), docs[5]]
    df = spark.createDataFrame([(d, t, "s", "clash") for d, t in docs], DOCS)
    assert {tuple(r) for r in spans.document_pairs(*spans.shared_spans(df, 30, 10, broadcast_ids=0)).collect()} == brute_pairs(docs, 30)
    classes, links = spans.shared_spans(df, 30, 10)
    pairs = spans.document_pairs(classes, links)
    assert {tuple(r) for r in pairs.collect()} == brute_pairs(docs, 30) and pairs.count() == len(brute_pairs(docs, 30))
    text = dict(docs)
    shares = {r.doc_id: r for r in spans.shared_shares(classes, links).collect()}
    for d, r in shares.items():
        others = {text[o][i : i + 30] for o in shares if o != d for i in range(len(text[o]) - 29)}
        at = {j for i in range(len(text[d]) - 29) if text[d][i : i + 30] in others for j in range(i, i + 30)}
        assert r.shared_chars == len(at), d
    empty = spark.createDataFrame([], DOCS)
    assert spans.document_pairs(*spans.shared_spans(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=80), st.integers(1, 20))
def test_sliding_min(values, t):
    h = np.array(values, dtype=np.uint64)
    want = [min(values[i : i + t]) for i in range(len(values) - t + 1)]
    assert spans.sliding_min(h, t).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=80), st.integers(1, 20), st.sampled_from([20, 5]))
def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree(values, t, bits):
    h = np.array(values, dtype=np.uint64) << np.uint64(40)
    nodes = []  # (value, place, first start, last start) of each node that is the leftmost minimum of a sequence of t

    def node(lo, hi):
        if hi - lo >= t:
            place = min(range(lo, hi), key=lambda i: (values[i], i))
            first, last = max(lo, place - t + 1), min(place, hi - t)
            if first <= last:
                nodes.append((values[place] << 40, place, first, last))
            node(lo, place)
            node(place + 1, hi)

    node(0, len(values))
    was, spans.PLACE_BITS = spans.PLACE_BITS, bits
    try:
        got = spans.compact_windows(h, t)
    finally:
        spans.PLACE_BITS = was
    if bits == 20:
        assert list(zip(*(x.tolist() for x in got))) == sorted(nodes, key=lambda n: n[2])
    # every start has one window, however the text was cut
    by = {s: (v, p) for v, p, a, b in nodes for s in range(a, b + 1)}
    assert [(v, p) for v, p, a, b in zip(*(x.tolist() for x in got)) for _ in range(a, b + 1)] == [by[s] for s in range(max(0, len(values) - t + 1))]


def test_a_span_in_many_records_stays_one_group(spark):
    """20,000 records hold one text: rows grow with the records, no pair is formed, and the whole of it is seen."""
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgh ", k=400))
    df = spark.range(20_000).selectExpr("id AS doc_id", f"concat(sha2(cast(id AS string), 256), '{text}', sha2(cast(-id AS string), 256)) AS text", "'' AS source", "'' AS item_id")
    classes, groups = spans.shared_spans(df)
    assert groups.count() < 30 * 20_000
    got = spans.shared_shares(classes, groups).selectExpr("min(shared_chars) AS a", "max(shared_chars) AS b", "count(*) AS n").first()
    assert got.n == 20_000 and 400 <= got.a <= got.b < 420


DOC = "/** Gives back what it is asked for. */ "


def documented(text, lang):
    text = text.replace("DOC", DOC)
    assert syntax.parses(text, lang)
    return {q: c for q, c, _ in docpairs.pairs(text, "x.ts", lang)}


@pytest.mark.parametrize(
    ("lang", "text", "names"),
    [
        ("typescript", "describe('x', () => {\n  DOC function helper() { return 1 }\n  it('y', function () { DOC function deep(a: { b: number }) {} })\n})\nDOC function next({ a }: X) {}\n", ["helper", "deep", "next"]),
        ("typescript", "(function () { DOC function inner() {} })();", ["inner"]),
        ("typescript", "foo(1, [() => { DOC function inner() {} }], class K extends B<C, D> { DOC m() {} });", ["inner", "m"]),
        ("typescript", "const o = { a: 1, DOC load(x: number): { b: number } { return f({ x }) }, DOC async save() {}, in: { DOC get deep() { return 1 } } }", ["load", "save", "deep"]),
        ("typescript", "function f() { return { DOC m() {} } }\nexport default { DOC n() {} }", ["f.m", "n"] ),
        ("typescript", "use({ DOC m() {} }, { DOC n() { DOC function k() {} } })", ["m", "n", "n.k"]),
        ("typescript", "namespace N.M { DOC export function f(a: number) {} class C { DOC m() {} } namespace I { DOC function g() {} } }", ["N.M.f", "N.M.C.m", "N.M.I.g"]),
        ("typescript", "declare namespace N { DOC function f(): void; }", ["N.f"]),
        ("typescript", "const K = class extends B { DOC m() {} }\nclass L { DOC @dec({ a: 1 }) n() {} }", ["m", "L.n"]),
        ("java", "class A { Runnable r = new Runnable() { DOC public void run() { } }; DOC void last() {} }", ["A.run", "A.last"]),
        ("java", "class A { void f() { call(1, new B<C, D>(x(), 2) { DOC @Override int m() { return 0; } }); DOC class L { DOC void n() {} } } }", ["A.f.m", "A.f.L.n"]),
        ("java", "class A { void f() { run(() -> { class L { DOC void n() {} } }); if (a) { g(); } } }", ["A.f.L.n"]),
        ("java", "enum E { DOC A, DOC B(1) { DOC void f() {} }, C; DOC E(int... x) {} DOC void g() {} }", ["E.f", "E.E", "E.g"]),
    ],
)
def test_functions_inside_of_brackets_and_nameless_bodies(lang, text, names):
    prefix = "" if lang == "java" else "x."
    assert sorted(documented(text, lang)) == sorted(prefix + n for n in names)


def test_calls_are_not_methods():
    text = "switch (a) { case 1: { DOC foo(x); } default: { DOC bar(x) } }\nlabel: { DOC baz(x); }\nf(() => { DOC call(x); if (a) { g({}) } }, { a: 1, b: h(1) })\nconst g = (DOC function h() {})\nf(\n  DOC function k() {})\n"
    assert not documented(text, "typescript")
    assert documented("f(() => {\n  DOC function g() { return 1 }\n});", "typescript") == {"x.g": "function g() { return 1 }"}
