import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import budget, graph, references, scan, symbols
from corpusloom.plans import fixture, maintenance
from corpusloom.plans.engine import Engine
from corpusloom.plans.store import IndexStore, VectorStore, derived
from corpusloom.sources import embedding, tree
from corpusloom.sources.config import ProjectConfig
from corpusloom.sources.ignore import IgnoreRules


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("build") / "project"  # a parent named like an ignored folder
    for p, t in {**fixture.PROJECT, "node_modules/x/a.js": "function a() {}", "gen/out.rs": "fn gen() {}", "a/secret.txt": "x", ".gitignore": "# no\n/gen/\n!keep\n*.log\nsecret.txt\n", "x.log": "", "pkg/__init__.py": ""}.items():
        f = top / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    return str(top)


def test_tree_leaves_out_what_is_ignored(spark, root):
    got = {r.path for r in tree.read_tree(spark, root).collect()}
    assert got == {*fixture.PROJECT, ".gitignore", "pkg/__init__.py"}
    with pytest.raises(ValueError):
        tree.guarded(root, "../x")


@pytest.mark.parametrize(("lines", "path", "want"), [
    (["target/"], "x/target/y", True), (["/docs"], "a/docs", True), (["*.log"], "a/b.log", True), (["a/*.rs"], "a/b/c.rs", True), (["#x", "!y", ""], "y", False), ([], "NODE_MODULES/x", True), ([], "a/entry/build/x", True), ([], "entry/builds", False),
])
def test_ignore_rules(lines, path, want):
    assert IgnoreRules.of(lines).ignores(path) is want


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[ignore]\npaths = ["x"]\n[embedding]\nbackend = "ollama"\ndimensions = 64\n[context]\nmax_tokens = 9\n')
    c = ProjectConfig.load(str(f))
    assert (c.ignore_paths, c.embedding_backend, c.dimensions(), c.max_context_tokens) == (["x"], "ollama", 64, 9)
    assert ProjectConfig.load("/nowhere") == ProjectConfig()
    assert embedding.EmbeddingConfig.of(c).endpoint.startswith("http://localhost")


def test_classification(spark):
    rows = scan.classified(spark.createDataFrame([("a/main.rs", 1), ("Cargo.toml", 2), ("x.TSX", 3), (".hidden", 4), ("Makefile", 5)], "path string, size_bytes long"))
    got = {r.path: (r.language, r.is_config, r.is_entry, r.is_text) for r in rows.collect()}
    assert got == {"a/main.rs": ("Rust", False, True, True), "Cargo.toml": (None, True, False, True), "x.TSX": ("TypeScript", False, False, True), ".hidden": (None, False, False, False), "Makefile": (None, False, False, False)}
    assert scan.complexity(rows).first().mode == "Full" and scan.complexity(rows.limit(0)).first().mode == "Explorer"


def test_symbols():
    got = {(s[0], s[1], s[2], s[3], s[5]) for p, t in fixture.PROJECT.items() for s in symbols.symbols_of(p, t)}
    assert {("Basket", "Struct", 2, 4, "Public"), ("total_price", "Function", 7, 9, "Public"), ("LIMIT", "Const", 5, 5, "Unknown"), ("Report", "Class", 5, 9, "Unknown"), ("rows", "Function", 6, 9, "Unknown"), ("Props", "Interface", 1, 3, "Public"), ("EntryAbility", "Class", 1, 5, "Public"), ("onCreate", "Method", 2, 4, "Unknown")} <= got
    assert symbols.symbols_of("a.ts", "export { one, two as three };") == [("one", "Export", 1, 1, "export { one, two as three };", "Public"), ("two", "Export", 1, 1, "export { one, two as three };", "Public")]
    assert symbols.symbols_of("a.go", "func (s *S) Run() {\n}\ntype T struct {\n}\n") == [("Run", "Function", 1, 2, "func (s *S) Run() {", "Unknown"), ("T", "Struct", 3, 4, "type T struct {", "Unknown")]
    assert symbols.symbols_of("a.java", "class A {}") == [] and symbols.symbols_of("a.rs", "") == []


@pytest.mark.parametrize(("path", "source", "want"), [
    ("a.rs", "/* fn no() {} */\n#[derive(Debug)]\npub(crate) const fn size() -> u8 { let s = \"fn x() {\"; 'a' }\nimpl X {\n    async fn go(&self) {}\n}\nconst N: u8 = 1;", {("size", "Function", 3, "Public"), ("go", "Function", 5, "Unknown"), ("N", "Const", 7, "Unknown")}),
    ("a.ts", "export default async function f() {\n  if (a) { run(); }\n}\nexport const enum E { A }\nclass K<T> {\n  private get(x: T): void {\n    call(x);\n  }\n  static of<U>(u: U) { return u; }\n}\nexport {\n  K,\n  f as g,\n};\nlet a = 'class Z {';", {("f", "Function", 1, "Public"), ("E", "Enum", 4, "Public"), ("K", "Class", 5, "Unknown"), ("get", "Method", 6, "Internal"), ("of", "Method", 9, "Unknown"), ("K", "Export", 12, "Public"), ("f", "Export", 13, "Public"), ("a", "Const", 15, "Unknown")}),
    ("a.cpp", "#include <x.h>\nnamespace n {\nstatic int add(int a, int b) {\n  return mul(a, b);\n}\nclass Box : public Base {\n  int size() const { return 1; }\n};\nstruct Box *use(struct Box *b);\nvoid Box::grow(int n) {\n}\nenum class Color { Red };\n}", {("add", "Function", 3, "Internal"), ("Box", "Class", 6, "Unknown"), ("size", "Method", 7, "Unknown"), ("grow", "Function", 10, "Unknown"), ("Color", "Enum", 12, "Unknown")}),
    ("a.go", "type A interface {\n}\ntype B = int\nfunc Map[T any](x T) T {\n}", {("A", "Interface", 1, "Unknown"), ("Map", "Function", 4, "Unknown")}),
    ("a.py", "class A:\n    @x\n    def b(self): ...\ntext = 'def no(): pass'\n", {("A", "Class", 1, "Unknown"), ("b", "Function", 3, "Unknown")}),
    ("a.py", "print 'old'\ndef c(): pass\n", {("c", "Function", 2, "Unknown")}),
])
def test_declarations(path, source, want):
    assert {(s[0], s[1], s[2], s[5]) for s in symbols.symbols_of(path, source)} == want


def test_references(spark):
    files = spark.createDataFrame([("a.rs", "fn login() {}\nlogin(); <login> x.login")], "path string, text string")
    s = spark.createDataFrame([("a.rs", "login", 1)], "file_path string, name string, line_start int")
    got = references.references(files, s).orderBy("column_start").collect()
    assert [(r.line_number, r.column_start, r.kind) for r in got] == [(2, 1, "Call"), (2, 11, "ComponentUse"), (2, 20, "Identifier")]


def test_import_candidates(spark):
    got = spark.createDataFrame([("src/ui/Page.ts", "./components/Button"), ("src/a.rs", "crate::auth::x"), ("src/a.rs", "session"), ("a/b.ts", "../../c"), ("a.py", "x.y")], "p string, i string").select("p", "i", graph.import_candidates(F.col("p"), F.col("i")).alias("c")).collect()
    c = [r.c for r in got]
    assert "src/ui/components/Button.ts" in c[0] and "src/ui/components/Button/index.ts" in c[0]
    assert c[1] == ["src/auth.rs", "src/auth/mod.rs"] and "src/session.rs" in c[2] and "c.ts" in c[3] and c[4] == []


def test_callish(spark):
    got = spark.createDataFrame([("login(x) Foo { <TgRow a> token 1go(",)], "t string").select(graph.callish(F.col("t")).alias("c")).first().c
    assert {(x.name, x.tag) for x in got} == {("login", False), ("Foo", False), ("TgRow", True), ("go", False)}


def test_graph_and_reach(spark):
    f = scan.classified(fixture.project(spark))
    nodes, edges = graph.build(f, symbols.extract_symbols(f.where("is_source")))
    e = {(r.from_id, r.to_id, r.kind) for r in edges.collect()}
    assert {("file:src/lib.rs", "file:src/basket.rs", "Imports"), ("file:web/index.ts", "file:web/ui/Button.ts", "Imports"), ("file:tests/basket_test.rs", "file:src/basket.rs", "Tests"), ("file:src/basket.rs", "symbol:src/prices.rs:load_prices:1", "Calls"), ("file:entry/EntryAbility.ets", "config:Cargo.toml", "NativeBinding"), ("config:Cargo.toml", "module:src", "Configures")} <= e
    near = {r.path for r in graph.expand_files(nodes, edges, spark.createDataFrame([("web/index.ts",)], "path string"), 1).collect()}
    assert near == {"web/index.ts", "web/ui/Button.ts"}
    shown, inner = graph.explorer(nodes, edges, "Button")
    assert "file:web/ui/Button.ts" in {r.id for r in shown.collect()} and inner.count() > 0


def test_refresh_gives_what_a_rebuild_gives(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    assert store.version() is None
    before = fixture.project(spark)
    assert store.refresh(before).mode == "Rebuilt" and store.is_fresh(before) and store.refresh(before).mode == "Unchanged"
    changed = dict(fixture.PROJECT)
    changed["src/prices.rs"] = "pub fn load_prices(u: &str) -> u32 {\n    discount(u)\n}\n\npub fn discount(u: &str) -> u32 { 1 }\n"
    changed["src/extra.rs"] = "use crate::prices;\nfn extra() { discount(\"x\"); }\n"
    del changed["README.md"], changed["tests/basket_test.rs"]
    after = fixture.project(spark, changed)
    done = store.refresh(after)
    assert done.mode == "Incremental" and done.touched == 4
    for name, df in derived(after).items():
        assert sorted(map(str, store.read(name).select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    assert store.refresh(before, limit=1).mode == "Rebuilt"


def test_vectors_follow_chunks(spark, tmp_path):
    chunks = derived(fixture.project(spark))["chunks"].persist()
    v = VectorStore(spark, str(tmp_path / "v"))
    assert v.refresh(chunks, 32).mode == "Rebuilt" and v.refresh(chunks, 32).mode == "Unchanged"
    assert "src/basket.rs" in {r.file_path for r in v.search("total_price basket", 3).collect()}
    edited = chunks.withColumn("text_hash", F.when(F.col("file_path") == "src/prices.rs", "new").otherwise(F.col("text_hash")))
    done = v.refresh(edited, 32)
    assert (done.mode, done.touched) == ("Incremental", 1) and v.refresh(edited, 32).mode == "Unchanged"
    assert v.refresh(edited, 16).mode == "Rebuilt"
    body = embedding.points(v.read("vectors")).first().body
    assert '"points"' in body and embedding.hits({"result": [{"id": 1, "score": 0.5}]}) == [("1", 0.5, {})]


def test_http_embeddings_are_sorted_and_unit(spark):
    c = embedding.EmbeddingConfig("custom", "m", "http://x", 2)
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").coalesce(1)
    post = lambda url, body, key: {"data": [{"index": i, "embedding": [3.0, 4.0]} for i in reversed(range(len(body["input"])))]}
    assert [r.vector for r in embedding.embedder(c, post)(df).collect()] == [[0.6, 0.8], [0.6, 0.8]]
    with pytest.raises(ValueError):
        embedding.checked_collection("a/b")


def test_retrieve_and_context(spark, root, tmp_path):
    e = Engine.open(spark, root)
    result = e.retrieve(fixture.QUESTION)
    assert result.chunks[0].path == "src/basket.rs" and "symbol" in result.chunks[0].reasons
    assert "src/lib.rs" in [c.path for c in result.chunks[:3]] and result.report.confidence > 0.5
    assert e.remember(result).memory.files and not e.memory.files
    text, used, sections = budget.build_context("t", result.skeleton, e.memory.render(), [budget.render_chunk(c, i) for i, c in enumerate(result.chunks)], "g", 100)
    assert used <= 100 and sections[0].included
    assert "Confidence" in result.panel() and "src/basket.rs" in result.render()


def test_doctor_and_heal(spark, root, tmp_path):
    index = str(tmp_path / "idx")
    assert {c.name: c.status for c in maintenance.doctor(spark, root, index)} == {"root": "Ok", "scan": "Ok", "index": "Warning", "vectors": "Warning"}
    assert all(c.status == "Ok" for c in maintenance.heal(spark, root, index, "ensure", 16))
    assert maintenance.doctor(spark, os.path.join(root, "none"), index)[0].status == "Error"


def test_paths(spark):
    row = spark.createDataFrame([("a/b.test.ts",)], "p string").select(paths.stem(F.col("p")).alias("s"), paths.extension(F.col("p")).alias("e"), paths.parent(F.col("p")).alias("d"), paths.folded(F.lit("a/./b/../c")).alias("f")).first()
    assert (row.s, row.e, row.d, row.f) == ("b.test", "ts", "a", "a/c")
