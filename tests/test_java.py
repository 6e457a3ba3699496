"""The Java parser on small sources."""

from codeloom.sources.java import parse

SOURCE = """package a.b;
import java.util.List; import static x.Y.*; import static x.Y.z; import q.*;
@Service("x") public class Foo<T extends Bar<T>> extends Base<T> implements I1, java.io.Closeable {
  private final Map<String, List<Foo>> m = make(), k; int[] arr = {1, 2};
  static { System.out.println("not counted"); }
  enum Level { LOW(1), HIGH { void x() {} }; int v; Level(int v) { this.v = v; } int get() { return helper(v); } }
  public Foo(int x, String... rest) throws IOException { super(x); this.run(x, null, "s", 1L, 2.0f, 'c', (Object) y, Foo.class, new int[3], helper(1), m.get("a")); }
  @Override public <X> List<X> run(int x, Bar b) {
    Bar q = b.next(); for (int i = 0; i < 3; i++) { q.go(i); } for (Foo f : all) f.bar();
    if (x > 1 && b instanceof Baz z) { foo(a < b, c); } else { new Thread(new Runnable() { Bar w; public void run() { w.hit(); } }).start(); }
    try (In s = open()) { s.read(); } catch (IOException e) { e.print(); } finally { done(); }
    xs.stream().map(t -> t.trim()).map(Foo::new);
    int y = switch (x) { case 1 -> one(); default -> { yield two(); } };
    this.m.clear(); a.b.c.call(); return x >> 2 > 1 ? null : l; }
  interface In { int MAX = 3; void f(int a); default int g() { return f2(); } }
  record R(int a) { int z() { return 1; } }
  @interface Ann { String v() default "x"; }
}
"""


def _parsed():
    return parse(SOURCE)


def test_declarations():
    p = _parsed()
    assert p.package == "a.b" and p.top_level_types == ["a.b.Foo"] and not p.has_error
    names = {n["qualified_name"]: n for n in p.nodes}
    assert set(names) == {
        "a.b.Foo", "a.b.Foo#m", "a.b.Foo#k", "a.b.Foo#arr", "a.b.Foo.Level", "a.b.Foo.Level.LOW", "a.b.Foo.Level.HIGH", "a.b.Foo.Level#<init>(int)",
        "a.b.Foo.Level#get()", "a.b.Foo#<init>(int)", "a.b.Foo#run(int,Bar)", "a.b.Foo.In", "a.b.Foo.In#f(int)", "a.b.Foo.In#g()", "a.b.Foo.Ann",
    }
    assert names["a.b.Foo"]["signature"] == "class Foo extends Base<T> implements I1, java.io.Closeable"
    assert names["a.b.Foo"]["annotations"] == ["Service"] and (names["a.b.Foo"]["span_start"], names["a.b.Foo"]["span_end"]) == (3, 18)
    assert names["a.b.Foo#run(int,Bar)"]["signature"] == "List<X> run(int, Bar)"
    assert names["a.b.Foo#m"]["signature"] == "Map<String, List<Foo>> m"


def test_imports_and_supertypes():
    p = _parsed()
    assert [(i["imported_name"], i["is_wildcard"], i["is_static"]) for i in p.imports] == [("java.util.List", False, False), ("x.Y", True, True), ("x.Y.z", False, True), ("q", True, False)]
    assert [(r["supertype"], r["edge_type"]) for r in p.type_refs] == [("Base", "EXTENDS"), ("I1", "IMPLEMENTS"), ("Closeable", "IMPLEMENTS")]


def test_calls():
    by = {(c["name"], c["caller"].split("#")[1]): c for c in _parsed().calls}
    run = by["run", "<init>(int)"]
    assert run["receiver_kind"] == "this" and run["argument_count"] == 11
    assert run["argument_hints"] == ["int", "null", "String", "long", "float", "char", "Object", "Class", "int", "@call:this:helper:1", "@call:Map:get:1"]
    body = "run(int,Bar)"
    kinds = {n: (by[n, body]["receiver_kind"], by[n, body]["receiver_hint"]) for n in ("next", "go", "bar", "foo", "start", "hit", "read", "clear", "call", "one", "two")}
    assert kinds == {
        "next": ("variable", "Bar"), "go": ("variable", "Bar"), "bar": ("type", "f"), "foo": ("unqualified", None), "start": ("chain", None), "hit": ("variable", "Bar"),
        "read": ("type", "s"), "clear": ("variable", "Map"), "call": ("chain", None), "one": ("unqualified", None), "two": ("unqualified", None),
    }
    assert by["foo", body]["argument_count"] == 2
    assert not {"println", "make"} & {c["name"] for c in _parsed().calls}


def test_type_uses():
    uses = {(u["type_name"], u["context"]) for u in _parsed().type_uses}
    assert {("Map", "field_type"), ("String", "generic_arg"), ("List", "generic_arg"), ("Foo", "generic_arg"), ("IOException", "throws"), ("Object", "cast"), ("Baz", "instanceof"), ("Thread", "object_creation"), ("Override", "annotation_type"), ("Bar", "param_type"), ("Bar", "local_var_type"), ("Foo", "class_literal")} <= uses
    assert not any(t in ("int", "void") for t, _ in uses)


def test_broken_sources_never_raise():
    for cut in range(0, len(SOURCE), 37):
        parse(SOURCE[:cut])
    assert parse("class A { void f( { } int x }").has_error
    assert parse("").nodes == [] and parse("class A { " + "{" * 5000).has_error is True
    assert [n["simple_name"] for n in parse("class A { int a = ; void ok() { b(); } }").nodes][:1] == ["A"]
