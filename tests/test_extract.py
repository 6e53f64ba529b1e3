"""Facts, nodes and edges of small source trees."""

import pytest
from pyspark.sql import functions as F

from arborist.extract import facts as X
from arborist.extract import graph as B
from arborist.operators import rules
from arborist.sources.files import language_of


@pytest.fixture
def tree(spark):
    def build(**sources):
        rows = [(1, path, text) for path, text in sources.items()]
        return spark.createDataFrame(rows, "graph_id long, file_path string, content string").withColumn("language", F.coalesce(language_of(F.col("file_path")), F.lit("?")))

    return build


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_comments_are_masked_and_strings_kept(tree):
    texts = {
        "a.java": 'int a = 1; // ghost()\nString s = "// kept"; /* ghost2()\n */ b();', "a.py": "x = '# kept' # ghost\n\"\"\"# kept too\"\"\"", "a.rs": "let a: &'a str = b; // ghost",
        "a.ts": "const s = `/* kept */`; // ghost", "b.java": None,
    }
    code = {r.file_path: r.code for r in X.masked(tree(**texts)).collect()}
    assert all("ghost" not in (c or "") for c in code.values()) and code["a.java"].count("kept") == 1 and code["a.py"].count("kept") == 2 and "&'a str = b;" in code["a.rs"] and "/* kept */" in code["a.ts"]


def test_functions_calls_and_comments(tree):
    f = tree(**{
        "A.java": "package a;\n// the file\nclass A {\n  // adds up\n  @Override\n  public int sum(int a) throws X {\n    if (a > check(1)) { return Other.twice(a); }\n    return sum(2) + new Thing(3).go();\n  }\n  private static void check(int b) { helper(b); }\n  void sumAll() {}\n}\n",
        "I.java": "interface I {\n  String name(int a);\n  default void both() { name(1); }\n}\n", "m.py": "# top\nimport os\ndef load(a):\n    return parse(a)\n\nasync def parse(b):\n    register(load)\n",
        "c.ts": "export const run = async (a) => { go(a); };\nfunction go(b) { return 1 }\nclass C {\n  async stop(x): void {\n    if (x) { run(x); }\n  }\n}\n", "g.go": "func (c *Ctx) Bind(a int) {\n\tc.Other(1)\n}\nfunc Other() {\n}\n",
    })
    assert got(X.functions(f), "file_path", "name", "defs") == [("A.java", "check", 1), ("A.java", "sum", 1), ("A.java", "sumAll", 1), ("I.java", "both", 1), ("I.java", "name", 1), ("c.ts", "go", 1), ("c.ts", "run", 1), ("c.ts", "stop", 1), ("g.go", "Bind", 1), ("g.go", "Other", 1), ("m.py", "load", 1), ("m.py", "parse", 1)]
    calls = {(r.file_path, r.caller, r.target_class, r.callee) for r in X.calls(f).collect()}
    assert calls == {("A.java", "sum", None, "check"), ("A.java", "sum", "Other", "twice"), ("A.java", "sum", None, "twice"), ("A.java", "sum", None, "go"), ("A.java", "check", None, "helper"), ("I.java", "both", None, "name"), ("c.ts", "run", None, "go"), ("c.ts", "stop", None, "run"), ("g.go", "Bind", None, "Other"), ("m.py", "load", None, "parse"), ("m.py", "parse", None, "register")}
    assert got(X.file_comments(f), "file_path", "comment") == [("A.java", "the file"), ("m.py", "top")]
    assert ("A.java", "sum", "adds up") in got(X.function_comments(f), "file_path", "name", "comment")
    assert got(X.async_methods(f), "file_path", "name") == [("c.ts", "run"), ("m.py", "parse")]
    assert got(X.value_references(f), "file_path", "name") == [("c.ts", "run"), ("m.py", "load")]
    assert got(X.framework_methods(f), "name") == [("sum",)] and got(X.interface_methods(f), "name") == [("both",), ("name",)] and got(X.instantiated(f), "class_name") == [("Thing",)]


def test_imports_of_each_language(tree):
    f = tree(**{"a.java": "import a.b.C;\nimport static x.y;\n", "a.ts": "import { q } from './q';\nimport z from \"@/z\"", "a.py": "from a.b import c\nimport os, sys\n", "a.go": 'import (\n  "fmt"\n  x "a/b"\n)\nimport "net/http"\n', "a.rs": "use a::b;", "a.php": "use A\\B;", "a.rb": "require_relative 'q/r'"})
    assert got(X.imports(f), "file_path", "import") == [("a.go", "a/b"), ("a.go", "fmt"), ("a.go", "net/http"), ("a.java", "a.b.C"), ("a.php", "A\\B"), ("a.py", "a.b"), ("a.py", "os, sys"), ("a.rb", "q/r"), ("a.rs", "a::b"), ("a.ts", "./q"), ("a.ts", "@/z")]


def test_import_edges_follow_paths(tree):
    f = B.Facts(tree(**{
        "src/a/One.java": "import com.b.Two;\n", "x/com/b/Two.java": "", "y/xcom/b/Two.java": "", "src/ui/p.ts": "from './q' from '../lib' from '@/ui/r' from 'react'", "src/ui/q.ts": "", "src/lib/index.ts": "", "src/ui/r.tsx": "", "src/react/react.ts": "", "src/tool.py": "import os\n", "src/os.py": "",
    }))
    ids = {r.id: r.file_path for r in B.nodes(f).where("type = 'FILE'").collect()}
    assert sorted((ids[r.src], ids[r.tgt]) for r in B.import_edges(f).collect()) == [("src/a/One.java", "x/com/b/Two.java"), ("src/tool.py", "src/os.py"), ("src/ui/p.ts", "src/lib/index.ts"), ("src/ui/p.ts", "src/ui/q.ts"), ("src/ui/p.ts", "src/ui/r.tsx")]


def calls_of(f, build=B.call_edges):
    ids = {r.id: f"{r.file_path}#{r.name}" for r in B.nodes(f).collect()}
    return sorted((ids[r.src], ids[r.tgt], r.same_file) for r in build(f).collect())


def fn(name, *callees):
    return f"  public void {name}(int a) {{ {' '.join(c + '(1);' for c in callees)} }}\n"


def test_calls_are_resolved_in_order(tree):
    f = B.Facts(tree(**{
        "p/A.java": "import p.B;\nclass A extends Base {\n" + fn("go", "own", "shared", "inherited", "alone", "twice", "size", "getCode", "Q.stat", "Optional.of") + fn("own") + "}",
        "p/B.java": "class B {\n" + fn("shared") + "}", "p/C.java": "class C {\n" + fn("shared") + fn("twice") + fn("own") + "}", "p/D.java": "class D {\n" + fn("twice") + "}", "p/Base.java": "class Base extends Root {\n}", "p/Root.java": "class Root {\n" + fn("inherited") + "}",
        "q/E.java": "class E {\n" + fn("alone") + fn("size") + fn("inherited") + fn("getCode") + fn("of") + "}", "q/Q.java": "class Q {\n" + fn("stat") + "}", "q/F.java": "@Entity\nclass F {\n  private String code;\n}",
    }))
    assert calls_of(f) == [("p/A.java#go", "p/A.java#own", True), ("p/A.java#go", "p/B.java#shared", False), ("p/A.java#go", "p/Root.java#inherited", False), ("p/A.java#go", "q/E.java#alone", False), ("p/A.java#go", "q/Q.java#stat", False)]


def test_implementations_beat_interfaces(tree):
    f = B.Facts(tree(**{"p/Port.java": "public interface Port {\n  void send(int a);\n}", "p/Mail.java": "class Mail implements Port {\n" + fn("send") + "}", "p/User.java": "class User {\n" + fn("go", "send") + "}"}))
    assert calls_of(f) == [("p/User.java#go", "p/Mail.java#send", False)]
    assert calls_of(f, B.implementation_edges) == [("p/Port.java#send", "p/Mail.java#send", False)]
    n, e = B.nodes(f), B.edges(f)
    assert rules.broken_interface_chain(n, e).isEmpty() and rules.broken_interface_chain(n, e.where("NOT is_interface_impl")).count() == 1


def test_tables_columns_and_accesses(tree):
    f = B.Facts(tree(**{
        "m/User.java": '@Entity\n@Table(name = "users")\nclass User {\n  private Long id;\n  @Column(name = "mail")\n  @Convert(c = X.class)\n  private String emailAddress;\n  private static final long serialVersionUID = 1;\n  private String nickName;\n}',
        "m/UserRepository.java": "interface UserRepository extends JpaRepository<User, Long> {\n  User findByMail(String m);\n  void deleteByMail(String m);\n  void odd(int x);\n}", "m/Raw.java": 'class Raw {\n  String a = "SELECT * FROM Audit WHERE x = 1"; String b = "update the docs"; String c = "DELETE FROM users WHERE id = ?";\n}',
        "m/models.py": "class Order(models.Model):\n    n = models.CharField()\n\nclass Base(models.Model):\n    class Meta:\n        abstract = True\n\nclass Item(Base):\n    __tablename__ = 'items'\n    id = Column(1)\n", "m/views.py": "def v(r):\n    Order.objects.filter(a=1)\n    Order.objects.create(a=1)\n    Item.query.all()\n",
        "m/s.prisma": "model Cart {\n}\n", "m/a.go": 'type Car struct {\n  gorm.Model\n}\nfunc (Car) TableName() string { return "cars_x" }\n', "m/x.ts": "class S {\n constructor(private r: Repository<Post>) {}\n go() { this.r.save(1); this.r.find(2); }\n}", "m/Post.ts": "@Entity('posts')\nclass Post {\n}",
    }))
    assert got(f.tables, "table_name", "class_name") == [("Cart", "Cart"), ("cars_x", "Car"), ("items", "Item"), ("order", "Order"), ("posts", "Post"), ("users", "User")]
    assert got(f.columns, "field_name", "column_name", "has_converter") == [("emailAddress", "mail", True), ("id", "id", False), ("nickName", "nick_name", False)]
    assert rules.missing_converter_migration(B.table_columns(f)).count() == 1
    ids = {r.id: (r.file_path if r.type != "DB_TABLE" else r.name) + ("#" + r.name if r.type == "FUNCTION" else "") for r in B.nodes(f).collect()}
    edges = sorted((ids[r.src], r.type, ids[r.tgt]) for part in (B.repository_edges, B.sql_edges, B.orm_edges) for r in part(f).collect())
    repo = "m/UserRepository.java"
    assert edges == sorted([(repo, "DB_READ", "users"), (repo, "DB_DELETE", "users"), (f"{repo}#findByMail", "DB_READ", "users"), (f"{repo}#deleteByMail", "DB_DELETE", "users"), (f"{repo}#odd", "DB_READ", "users"), (f"{repo}#odd", "DB_WRITE", "users"), ("m/Raw.java", "DB_READ", "audit"), ("m/Raw.java", "DB_WRITE", "users"), ("m/views.py", "DB_READ", "order"), ("m/views.py", "DB_WRITE", "order"), ("m/views.py", "DB_READ", "items"), ("m/x.ts", "DB_READ", "posts"), ("m/x.ts", "DB_WRITE", "posts")])


def test_endpoints_and_clients(tree):
    f = B.Facts(tree(**{
        "c/U.java": '@RequestMapping("/api/users")\nclass U {\n  @GetMapping\n  public void all(int a) { }\n  @GetMapping("/{id}")\n  public void one(int a) { }\n}', "c/r.ts": "app.get('/health', check);\nfunction check(a) { }\n", "c/v.py": "@app.post('/login')\ndef login(a):\n    pass\nurlpatterns = [path('about/', x)]\n",
        "w/api.tsx": "api.get(`/api/users/${id}?x=1`); fetch('/login', { method: 'POST' }); fetch('/api/users'); fetch('nope'); return <Card a/>", "w/Card.tsx": "", "c/k.cs": '[Route("api/[controller]")]\nclass CartController {\n  [HttpGet("list")]\n  public void List(int a) { }\n}', "c/n.ts": "@Controller('cats')\nclass N {\n  @Get(':id')\n  find(a) { }\n}",
    }))
    assert got(f.endpoints.fillna("-", ["handler"]), "mapping", "handler") == [("/api/users", "all"), ("/api/users/{id}", "one"), ("GET:/about/", "-"), ("GET:/cats/:id", "find"), ("GET:/health", "check"), ("GET:api/cart/list", "List"), ("POST:/login", "login")]
    assert got(X.client_calls(f.files), "method", "path") == [("GET", "/api/users"), ("GET", "/api/users/*?x=1"), ("GET", "/health"), ("POST", "/login")]
    ids = {r.id: r.file_path for r in B.nodes(f).collect()}
    assert sorted((ids[r.src], ids[r.tgt]) for r in B.api_edges(f).collect()) == [("w/api.tsx", "c/U.java"), ("w/api.tsx", "c/v.py")]
    assert [(ids[r.src], ids[r.tgt]) for r in B.render_edges(f).collect()] == [("w/api.tsx", "w/Card.tsx")] and B.handler_edges(f).count() == 5  # List is a keyword


def test_hosts_beans_and_fields(tree):
    f = B.Facts(tree(**{
        "compose.yml": "services:\n  a:\n    environment:\n      - USERS_URL=http://users:80\n      ORDERS: 'http://orders/x'\n", "application.yml": "app:\n  urls:\n    users: http://users:8080/api\n  name: x\nother: \"http://o\"\n", "application.properties": "a.b=http://q:1\n",
        "A.java": '@Service\nclass A {\n  private final B b;\n  A(@Lazy B b) { }\n}', "B.java": "@Component\nclass B {\n  private A a;\n  private Port p;\n}", "Port.java": "interface Port { }", "C.java": "@Service\nclass C implements Port {\n}", "F.java": '@FeignClient(name = "customers", url = "x")\ninterface F { }',
    }))
    assert got(X.compose_hosts(f.files), "key", "host") == [("ORDERS", "orders"), ("USERS_URL", "users")]
    assert got(X.property_hosts(f.files), "key", "host") == [("a.b", "q"), ("app.urls.users", "users"), ("other", "o")]
    assert got(X.feign_targets(f.files), "service") == [("customers",)]
    ids = {r.id: r.file_path for r in B.nodes(f).collect()}
    assert sorted((ids[r.src], ids[r.tgt], r.is_lazy) for r in B.field_edges(f).collect()) == [("A.java", "B.java", True), ("B.java", "A.java", False), ("B.java", "C.java", False)]


def test_a_cycle_of_files_is_found_from_their_text(tree):
    f = B.Facts(tree(**{"src/a.ts": "import { b } from './b';\nexport function fa(x) { b(1); }", "src/b.ts": "import { a } from './a';\nexport function b(x) { }", "src/c.ts": "import { a } from './a';"}))
    assert rules.cyclic_import(B.nodes(f), B.edges(f)).count() == 1


def test_names_of_nodes_need_no_flags(spark):
    """``node_names`` are the nodes' own ids and names, and the plan reads no text again; calls keep one edge a pair without a hash a call."""
    files = [
        (1, "a/User.java", "Java", '@Entity\n@Table(name = "users")\npublic class User {\n  private Long id;\n  public void go(int a) {\n    Other.run2(1);\n    Other.run2(2);\n    go2(1);\n  }\n  public void go2(int a) {\n  }\n}\n'),
        (1, "a/Other.java", "Java", 'public class Other {\n  static String q = "SELECT * FROM plain_t WHERE id = 1";\n  @GetMapping("/x")\n  public void run2(int a) {\n  }\n}\n'),
    ]
    f = B.Facts(spark.createDataFrame(files, "graph_id long, file_path string, language string, content string"))
    columns = ["graph_id", "id", "type", "file_path", "name"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(B.node_names(f)) == rows(B.nodes(f)) and {r[2] for r in rows(B.node_names(f))} == {"FILE", "FUNCTION", "DB_TABLE", "API_ENDPOINT"}
    names = {r.id: r.name for r in B.node_names(f).collect()}
    assert sorted((names[r.src], names[r.tgt], r.same_file) for r in B.call_edges(f).collect()) == [("go", "go2", True), ("go", "run2", False)]


def test_facts_of_lines_stay_with_their_file(spark):
    """Nodes of one type read that type's facts alone; fields and annotated methods need no shuffle of lines; overloads' calls are one row each."""
    text = "@Entity\npublic class A {\n  @Column(name = \"a_b\")\n\n  @Convert(converter = X.class)\n  private String ab;\n  private Long cd;\n  @Transactional\n  // why\n  public void go(int a) {\n    run2(1);\n    Other.run2(1);\n  }\n  public void go(long a) {\n    run2(2);\n    run3(2);\n  }\n}\n"
    files = spark.createDataFrame([(1, "a/A.java", "Java", text), (1, "a/B.java", "Java", None)], "graph_id long, file_path string, language string, content string")
    f = B.Facts(files)
    assert B.nodes(f, ("API_ENDPOINT",)).count() == 0 and B.nodes(f, ("FILE",)).count() == 2 and not {"definitions", "tables", "raw_sql"} & set(f.__dict__)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(X.entity_columns(files)) and "Window" not in plan(X.transactional_methods(files)) and "Window" not in plan(X.function_comments(files))
    assert sorted(tuple(r)[2:] for r in X.entity_columns(files).collect()) == [(6, "ab", "a_b", "String", True), (7, "cd", "cd", "Long", False)]
    assert [r.name for r in X.transactional_methods(files).collect()] == ["go"] and [(r.name, r.comment) for r in X.function_comments(files).collect()] == [("go", "why")]
    assert sorted((r.caller, r.target_class or "", r.callee) for r in X.calls(files).collect()) == [("go", "", "run2"), ("go", "", "run3"), ("go", "Other", "run2")]
