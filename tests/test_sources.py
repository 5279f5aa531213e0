"""Sources, versions, parsing and streams on small folders."""

import subprocess
from datetime import datetime

import pytest

from lodestone.operators import context, folds, questions
from lodestone.sources import files, parsing, store
from lodestone.streaming import incremental


def test_tree_scan(spark, tmp_path):
    for p, b in {"a.py": b"x = 1", "b/C.java": b"class C {}", ".git/d.py": b"no", "b/node_modules/e.ts": b"no", "f.txt": b"no", "g.ts": b"\xff\xfe"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = files.scan_tree(spark, str(tmp_path), "r").collect()
    assert sorted((r.path, r.language, r.content) for r in got) == [("a.py", "python", "x = 1"), ("b/C.java", "java", "class C {}")]


def test_git_source(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    (tmp_path / "b.py").write_text("y = 1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").rename(tmp_path / "moved.py")
    (tmp_path / "b.py").write_text("y = 2\n")
    (tmp_path / "c.py").write_text("z\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    files.register_git(spark)
    read = spark.read.format("git").option("path", str(tmp_path))
    got = read.option("commits", "HEAD~1,HEAD").option("mode", "changes").load().collect()
    assert [(r.path, r.change_type, r.previous_path) for r in got] == [("b.py", "MODIFIED", None), ("c.py", "ADDED", None), ("moved.py", "RENAMED", "a.py")]
    assert read.option("commits", "HEAD,HEAD").option("mode", "changes").load().count() == 0
    assert {(r.path, r.content) for r in read.option("commits", "HEAD").option("mode", "files").load().collect()} >= {("b.py", "y = 2\n"), ("c.py", "z\n")}
    with pytest.raises(ValueError, match="no commit"):
        files.full_sha(str(tmp_path), "--upload-pack=x")


def test_python_entities(spark):
    text = 'import os\nfrom . import q\nclass A(B, c.D):\n  """Doc."""\n  x: int = 1\n  @staticmethod\n  async def f(self, a=1) -> int:\n    def inner(): pass\n  class N: pass\ndef _g(): pass\n'
    df = spark.createDataFrame([("f", "p/__init__.py", "Python ", text), ("b", "q.py", "python", "x = ("), ("n", "n.py", "python", None), ("j", "j.java", "java", "class")], "file_id string, path string, language string, content string")
    rows = parsing.parse_python(df).collect()
    got = {(r.kind, r.qualified_name) for r in rows if r.row_kind == "entity"}
    assert got == {("module", "p"), ("class", "p.A"), ("variable", "p.A.x"), ("method", "p.A.f"), ("class", "p.A.N"), ("function", "p._g")}
    assert {(r.kind, r.qualified_name, r.target) for r in rows if r.row_kind == "reference"} == {("import", "p", "os"), ("import", "p", ".q"), ("extends", "p.A", "B"), ("extends", "p.A", "c.D"), ("decorator", "p.A.f", "staticmethod")}
    f = next(r for r in rows if r.name == "f")
    assert f.is_async and f.is_static and f.signature == "f(self, a=1) -> int"
    assert [r.file_id for r in rows if r.row_kind == "diagnostic"] == ["b"]


JAVA = """package a.b;
import java.util.*; import static x.Y.z;
/** Class comment. */
public sealed class X<T extends Comparable<T>> extends Y<T> implements Z, W<Q> permits Q {
  private static final Map<String, List<int[]>> M = new HashMap<>(), N = null;
  enum E { A, B(1) { void f() {} }, C; int x; void g() {} }
  record P(int a, String... b) { P { if (a < 0) throw new Q("}"); } }
  /** Loads { all. */
  @Override @SuppressWarnings({"a", "b"})
  public <R> Map<String, R> load(final int[] a, List<? super T>... b) throws IOException { for (int i = 0; i < 3; i++) { a[i] = 1; } Runnable r = () -> { int q = 1; }; return null; }
  X(int q) { super(q); }
  abstract int none();
  int[] arr = {1, 2};
}
"""
TS = """import type { A } from "./a"; import B, * as C from 'c'
import './side'
export interface I extends J<K>, L { name?(a: string): void; (x: number): I; readonly v: { a: number } }
export type Z<T> = T extends string ? { a: 1 } : null
export async function sum<T>(this: Foo, { a, b }: X, ...rest: number[]): Promise<{ a: number }> {
  const t = `x ${fn(`y ${{ a: 1 }.a}`)} {`; const re = /[{]+/g
  function inner(q: Map<string, number>) { return 1 }
}
const add = async (a: number, b = 2): Promise<void> => { a }
abstract class K<T> extends Base<T> implements I, J {
  #p = 1
  declare readonly q?: string
  constructor(private readonly a: A, public b = 2) { super() }
  /** Reads. */
  @dec({ a: 1 }) public get value(): { a: number } | null { return null }
  static async *gen(): AsyncGenerator<number> {}
  abstract f(): void
  private h = (x) => { y }
}
namespace N.M { export function deep() {} class D { m() {} } }
"""


def test_java_and_typescript_entities(spark):
    df = spark.createDataFrame([("j", "X.java", " Java", JAVA), ("t", "lib/t.ts", "typescript", TS), ("b", "B.java", "java", "class B { void f() {"), ("n", "n.ts", "typescript", None), ("e", "e.ts", "typescript", ""), ("c", "c.x", "cobol", "x")], "file_id string, path string, language string, content string")
    rows = parsing.parse_sources(df).collect()
    of = lambda f, kind: {(r.kind, r.qualified_name.removeprefix({"j": "a.b.", "t": "lib.t."}[f])) for r in rows if r.file_id == f and r.row_kind == kind}
    assert of("j", "entity") == {
        ("module", "a.b"), ("class", "X"), ("variable", "X.M"), ("variable", "X.N"), ("enum", "X.E"), ("variable", "X.E.x"), ("method", "X.E.g"), ("class", "X.P"), ("method", "X.load"), ("constructor", "X.X"),
        ("method", "X.none"), ("variable", "X.arr"),
    }
    assert of("t", "entity") == {
        ("module", "lib.t"), ("interface", "I"), ("method", "I.name"), ("variable", "I.v"), ("type", "Z"), ("function", "sum"), ("function", "sum.inner"), ("function", "add"), ("class", "K"), ("variable", "K.#p"), ("variable", "K.q"),
        ("constructor", "K.constructor"), ("method", "K.value"), ("method", "K.gen"), ("method", "K.f"), ("variable", "K.h"), ("module", "N.M"), ("function", "N.M.deep"), ("class", "N.M.D"), ("method", "N.M.D.m"),
    }
    assert {(r.kind, r.target) for r in rows if r.file_id == "j" and r.row_kind == "reference"} == {("import", "java.util.*"), ("import", "x.Y.z"), ("extends", "Y"), ("implements", "Z"), ("implements", "W")}
    assert {(r.kind, r.target) for r in rows if r.file_id == "t" and r.row_kind == "reference"} == {("import", "./a"), ("import", "c"), ("import", "./side"), ("extends", "J"), ("extends", "L"), ("extends", "Base"), ("implements", "I"), ("implements", "J")}
    load = next(r for r in rows if r.name == "load")
    assert load.visibility == "public" and load.doc_comment.startswith("/** Loads") and (load.start_line, load.end_line) == (9, 10)
    assert {(r.name, r.target) for r in rows if r.row_kind == "parameter" and r.parent == "a.b.X.load"} == {("a", "int[]"), ("b", "List<? super T>")}
    assert {(r.name, r.target) for r in rows if r.row_kind == "parameter" and r.parent == "lib.t.sum"} == {("this", "Foo"), ("rest", "number[]")}
    assert {r.file_id for r in rows if r.row_kind == "diagnostic"} == {"b"} and {r.file_id for r in rows} == {"j", "t", "b", "e"}


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for sha in ("s1", "s2"):
        store.write_version(df, str(tmp_path / "t"), "r", sha)
    store.write_version(df.limit(1), str(tmp_path / "t"), "r", "s2")
    assert store.read_version(spark, str(tmp_path / "t"), "r", "s1").count() == 2 and store.read_version(spark, str(tmp_path / "t"), "r", "s2").count() == 1
    with pytest.raises(KeyError):
        store.read_version(spark, str(tmp_path / "t"), "r", "s3")
    log = str(tmp_path / "log")
    for sha, status in (("s1", "building"), ("s1", "ready"), ("s2", "building"), ("s2", "failed")):
        store.mark(spark, log, "r", sha, status)
    assert [tuple(r) for r in store.active_version(spark, log).collect()] == [("r", "s1")]
    assert store.conflicts(df.unionByName(df).unionByName(spark.createDataFrame([(1, "z")], df.schema)), "id").count() == 1
    assert {r.rule: r.n for r in store.violations(df, {"small": "id < 2", "known": "v is not null"}).collect()} == {"small": 1, "known": 0}


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "k string, at timestamp, v int"
    day = lambda d: datetime(2025, 1, d)
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", day(1), 1), ("b", day(5), 2), (None, day(1), 0)], schema).coalesce(1).write.mode("append").parquet(src)
    for more in (None, [("a", day(3), 3), ("b", day(2), 4), ("b", day(5), 2)]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.keep_latest(spark, stream, "k", "at", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "state/version=1")).collect()
    assert {(r.k, r.v) for r in got} == {("a", 3), ("b", 2)}
    rates = incremental.event_rates(spark.read.parquet(src), "at", "k", "1 day").collect()
    assert sum(r.n for r in rates) == 6


def test_duplicate_stars_match_a_plain_model(spark):
    rows = [("q", f"c{i}", i, ["f", "g", None][i % 3], i % 4, i % 4 + 1, f"s{i % 5}", [f" N{i % 6}", "n1", None, ""][i % 4], "class") for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, candidate_id string, rank int, file_path string, start_line int, end_line int, symbol_name string, qualified_name string, node_kind string")
    got = {r.candidate_id: r.survivor_id for r in context.duplicate_groups(df).collect()}
    stars, want = [], {}
    for r in rows:
        name = (r[7] or "").strip().lower()
        hit = next((s for s in stars if (r[3] is not None and s[3:6] == r[3:6]) or (name and (s[7] or "").strip().lower() == name)), None)
        want[r[1]] = (hit or r)[1]
        if hit is None:
            stars.append(r)
    assert got == want
    assert context.duplicate_groups(df.limit(0)).count() == 0


def test_fold_goes_in_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2)], "g string, x int")

    def step(s, r):
        s["t"] += r["x"]
        return {"t": s["t"]}

    got = folds.ordered_fold(df, "g", [df["x"]], lambda: {"t": 0}, step, "t bigint").collect()
    assert {(r.g, r.x): r.t for r in got} == {("a", 1): 1, ("a", 2): 3, ("a", 3): 6, ("b", 2): 2}


@pytest.mark.parametrize(
    ("text", "kind", "intent", "relation"),
    [
        ("PaymentService", "IDENTIFIER", "SYMBOL", "NONE"), ("app.core.Pay", "QUALIFIED_IDENTIFIER", "SYMBOL", "NONE"), ("src/a/b.py", "PATH_OR_FILE", "SEARCH", "NONE"), ("who calls loadUser", "RELATIONSHIP", "DEPENDENCY", "CALLERS"),
        ("how does it work", "NATURAL_LANGUAGE", "EXPLANATION", "NONE"), ("how does loadUser work", "MIXED", "EXPLANATION", "NONE"), ("", "UNKNOWN", "SEARCH", "NONE"), (None, "UNKNOWN", "SEARCH", "NONE"),
    ],
)
def test_questions(spark, text, kind, intent, relation):
    r = questions.understand(spark.createDataFrame([(1, text)], "query_id int, text string")).first()
    assert (r.kind, r.intent, r.relation) == (kind, intent, relation)
