"""Each test holds one tiny file with something that misleads simple extraction."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions import java
from codequarry.operators import extraction as X
from codequarry.operators import graph as G
from codequarry.operators import relations as R
from codequarry.operators.blocks import blocks, declarations

PARTS = ['"', "'", "\\", "/", "*", "/*", "*/", "//", "\n", "{", "}", ";", " ", "a", "é", '"""', "class A "]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lexemes_give_the_text_back(spark):
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
    def gather(text):
        seen.append(text)

    gather()
    df = spark.createDataFrame([(t,) for t in seen], "t string")
    wrong = df.filter(F.array_join(java.lexemes(F.col("t")), "") != F.col("t"))
    assert wrong.count() == 0
    blank = df.filter(F.length(java.blank_hidden(F.col("t"))) != F.length("t"))
    assert blank.count() == 0


def test_long_literals_do_not_overflow(spark, files):
    big = "x" * 200_000
    f = files(A='class A { String s = "' + big + '"; /* ' + "{" * 200_000 + ' */ void f() { } }')
    assert rows(X.extract_methods(declarations(f)), "name") == [("f",)]


def test_comment_removal(files):
    f = files(A='int a; // x\nString s = "// no"; /* y */ int b;')
    assert X.strip_comments(f).first().content == 'int a; \nString s = "// no";  int b;'


def test_offsets_count_characters(files):
    f = files(A="// é 漢\nclass A { void f() { } }")
    assert rows(X.snippets(f), "kind", "content") == [
        ("class", "class A { void f() { } }"), ("method", "void f() { }"),
    ]


def test_commented_out_code_is_ignored(files):
    d = declarations(files(A="/* class Ghost { */ class A { // class Dead {\n int x; }"))
    assert rows(X.extract_types(d), "name") == [("A",)]


def test_body_ends_at_its_own_brace(files):
    f = files(A="class A { void f() { if (a) { b(); } } int x; } class B { int y; }")
    d = declarations(f)
    assert rows(X.extract_type_body(X.extract_types(d), f), "name", "body") == [
        ("A", " void f() { if (a) { b(); } } int x; "), ("B", " int y; "),
    ]


def test_name_prefix_is_not_enough(files):
    f = files(A="class FooBar { int x; } class Foo { int y; }")
    d = declarations(f)
    assert rows(X.extract_fields(d), "type_name", "name") == [("Foo", "y"), ("FooBar", "x")]


def test_interfaces_have_methods_and_common_classes_are_skipped(files):
    d = declarations(files(A="interface I { int f(); } class List { int x; } class A extends String { }"))
    types = X.extract_types(d)
    assert rows(types, "name", "kind") == [("A", "class"), ("I", "interface")]
    assert rows(X.extract_methods(d), "type_name", "name") == [("I", "f")]
    assert R.extends_edges(types).count() == 0


def test_calls_make_uses_edges_once(files):
    f = files(A="class A { void f() { B.go(); x.go(); } }", B="class B { void go() { } }")
    d = declarations(f)
    known = R.known_names(X.extract_types(d), X.extract_imports(f))
    assert rows(R.uses_edges(X.extract_calls(d), known), "source", "target", "relation") == [("A", "B", "uses")]


def test_calls_belong_to_the_nearest_method(files):
    f = files(
        A="class A { void f() { a.b(); class L { void g() { c.d(); } } e.f(); Runnable r = () -> { h.i(); }; } int x = j.k(); }"
    )
    assert rows(X.extract_calls(declarations(f)), "caller_type", "caller_method", "receiver") == [
        ("A", "f", "a"), ("A", "f", "e"), ("A", "f", "h"), ("L", "g", "c"),
    ]


def test_associates_does_not_depend_on_file_order(files):
    f = files(A="class A { Z z; String s; Q q; }", Z="class Z { }")
    d = declarations(f)
    known = R.known_names(X.extract_types(d), X.extract_imports(f))
    assert rows(R.associates_edges(X.extract_fields(d), known), "source", "target") == [("A", "Z")]


def test_hot_names_give_the_same_edges(files):
    f = files(**{f"A{i}": f"class A{i} {{ Z z; Z y; Q q; }}" for i in range(20)}, Z="class Z { }")
    d = declarations(f)
    known, fields = R.known_names(X.extract_types(d), X.extract_imports(f)), X.extract_fields(d)
    spread = R.associates_edges(fields, known, hot_rows=2)
    assert rows(spread, "source", "target") == rows(R.associates_edges(fields, known), "source", "target")
    assert spread.count() == 40


def test_statements_are_not_members(files):
    d = declarations(
        files(A="class A { int f() { return x; } void g() { if (a) { } else if (b) { } new C(1) { }; Foo y; } }")
    )
    assert rows(X.extract_methods(d), "name") == [("f",), ("g",)]
    assert X.extract_fields(d).count() == 0


def test_generics_annotations_and_initialisers(files):
    d = declarations(
        files(
            A="@Entity(name = \"x\") class A<T extends Map<K, V>> extends Base<T> implements I<A>, J {\n"
            " @Id private Map<String, List<T>> m = new HashMap<>(); int[] a = {1, 2}; final int b = 3, c;\n"
            " @Override public <X> List<X> f(@Nn List<X> x) throws E { } A(int q) { } Runnable r = () -> { }; }"
        )
    )
    types = X.extract_types(d)
    assert rows(types, "name", "parent") == [("A", "Base")]
    assert rows(X.explode_implements(types), "interface") == [("I",), ("J",)]
    assert rows(X.extract_methods(d), "name") == [("f",)]
    assert rows(X.extract_fields(d), "field_type", "name") == [
        ("Map", "m"), ("Runnable", "r"), ("int", "a"), ("int", "b"),
    ]


def test_constructors_enums_records_and_annotation_types(files):
    d = declarations(
        files(A="enum E { P, Q; int f() { } } record R(int x) { int g() { return x; } } @interface N { int v(); } class C { C() { } }")
    )
    assert rows(X.extract_types(d), "name") == [("C",)]
    assert rows(X.extract_methods(d), "type_name", "name") == [("E", "f"), ("R", "g")]


def test_anonymous_class_methods_are_declarations(files):
    f = files(A="class A { void f() { run(new B(x()) { int g() { return 1; } }); } }")
    assert rows(X.snippets(f), "name", "depth") == [("A", 0), ("f", 1), ("g", 3)]


def test_unbalanced_file_reads_to_its_end(files):
    f = files(A="class A { void f() { int x;", B="} class B { }")
    assert rows(X.snippets(f), "name", "content") == [
        ("A", "class A { void f() { int x;"), ("B", "class B { }"), ("f", "void f() { int x;"),
    ]


def test_spans_nest(files):
    f = files(A="class A { int a; static class B { void f() { { } } } } interface I { void g(); }")
    found = [r for r in blocks(f).collect()]
    by_id = {r.block_id: r for r in found}
    for r in found:
        assert r.start < r.end
        if r.parent_id is not None:
            outer = by_id[r.parent_id]
            assert outer.start < r.start and r.end <= outer.end and r.depth == outer.depth + 1


def test_imports(files):
    f = files(A="package p.q;\nimport a.B; import a.c.*; import static d.E.f; import java.util.List;\n// import x.Y;\nclass A { }")
    assert rows(X.extract_imports(f), "simple_name", "full_name") == [("B", "a.B")]
    assert rows(X.extract_packages(f), "package", "class_name") == [("p.q", "A")]
    d = declarations(f)
    assert rows(X.declared_imports(d), "simple_name", "full_name") == [("B", "a.B")]
    assert rows(X.declared_packages(d), "package", "class_name") == [("p.q", "A")]
    two = files(A="import a.B;", Z="import z.B;")
    assert rows(X.last_imports(X.extract_imports(two)), "simple_name", "full_name") == [("B", "z.B")]


def test_interface_and_later_file_win(files):
    d = declarations(files(A="class T { }", B="interface T { }", C="class T { int x; }", D="class U { }", E="class U { }"))
    assert rows(R.type_catalogue(X.extract_types(d)), "name", "kind", "path") == [
        ("T", "interface", "src/B.java"), ("U", "class", "src/E.java"),
    ]


def test_graph_overloads_and_isolated_files(files):
    f = files(A="class A { void f() { } void f(int x) { } }", B="// nothing", C="")
    snips = X.snippets(f)
    nodes = G.nodes(f, snips)
    assert rows(nodes, "node_id", "content") == [
        ("src/A.java", "class A { void f() { } void f(int x) { } }"),
        ("src/A.java::A", "class A { void f() { } void f(int x) { } }"),
        ("src/A.java::f", "void f(int x) { }"),
        ("src/B.java", "// nothing"),
    ]
    assert G.edges(snips).count() == 2
    assert tuple(G.graph_counts(nodes, G.edges(snips)).first()) == (4, 2)
    best = nodes.sparkSession.createDataFrame([(7, "src/A.java")], "query_id long, node_id string")
    context = G.graph_context(best, nodes, G.edges(snips)).orderBy("rank").collect()
    assert [r.node_id for r in context] == ["src/A.java", "src/A.java::A", "src/A.java::f"]


def test_empty_corpus(files, spark):
    f = spark.createDataFrame([], "path string, content string")
    assert X.snippets(f).count() == 0
    assert X.extract_calls(declarations(f)).count() == 0


def test_names_of_any_script_and_dollar(files):
    f = files(A="class Größe extends Über$Klasse { private Ann$Type ähnlich; void öffne() { Foo$Bar.los(); newÄ x; } }")
    d = declarations(f)
    assert rows(X.extract_types(d), "name", "parent") == [("Größe", "Über$Klasse")]
    assert rows(X.extract_fields(d), "field_type", "name") == [("Ann$Type", "ähnlich")]
    assert rows(X.extract_methods(d), "name") == [("öffne",)]
    assert rows(X.extract_calls(d), "receiver", "callee") == [("Foo$Bar", "los")]


def test_annotation_arguments_hide_nothing(files):
    f = files(
        A='@SuppressWarnings({"a","b"}) class A { @Named({"x"}) private Ann other; @A(b=@B(c(d=1))) int z; @Deprecated void f() { } }'
    )
    d = declarations(f)
    assert rows(X.extract_fields(d), "field_type", "name") == [("Ann", "other"), ("int", "z")]
    assert [r.content[:5] for r in X.snippets(f, d).sort("start").collect()] == ["@Supp", "@Depr"]


def test_deep_generics(files):
    d = declarations(files(A="class A<T extends B<C<D<E<F<G<H>>>>>>> extends P<Q<R<S<T<U<V>>>>>> { Map<A<B<C<D<E<F>>>>>, G> m; }"))
    assert rows(X.extract_types(d), "name", "parent") == [("A", "P")]
    assert rows(X.extract_fields(d), "field_type", "name") == [("Map", "m")]


def test_diagrams_of_the_default_package_and_of_the_whole(files):
    from codequarry.operators.rendering import class_diagram

    f = files(A="class A extends B { int x; }", B="package p; class B { }")
    d = declarations(f)
    types, fields = X.extract_types(d), X.extract_fields(d)
    drawn = R.all_relations(types, fields, X.extract_calls(d), X.declared_imports(d))
    parts = (R.type_catalogue(types), fields, X.extract_methods(d), drawn, X.declared_packages(d))
    lines = rows(class_diagram(*parts), "package", "line")
    assert ("", "    class A {") in lines and ("p", "    class B {") in lines and ("", "        int x") in lines
    whole = rows(class_diagram(*parts, by_package=False), "package", "line")
    assert len(whole) == len(lines) - 3 and {p for p, _ in whole} == {""}


def test_declarations_sort_nothing_and_keep_unbalanced_files(spark, files):
    """Braces are matched inside the file's row: no sort of its pieces, whatever their number."""
    plan = declarations(files(A="class A { }"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    f = files(A="} int q; } class A { int x; void f() { A.b(); }", B="class B { class C { } } { D.e(); } ;")
    got = declarations(f).filter("kind IS NOT NULL").orderBy("path", "start")
    assert [tuple(r) for r in got.filter("path LIKE '%A.java'").select("kind", "name", "parent_name", "depth").collect()] == [
        ("class", "A", None, -2), ("field", "x", "A", -1), ("method", "f", "A", -1)
    ]
    assert [tuple(r) for r in got.filter("path LIKE '%B.java'").select("kind", "name", "parent_name").collect()] == [
        ("class", "B", None), ("class", "C", "B"), ("other", None, None)
    ]


def test_files_of_one_path_are_read_piece_by_piece(spark):
    twice = spark.createDataFrame([("A.java", "class A { int x; }")] * 2, "path string, content string")
    got = declarations(twice).select("depth", "name", F.coalesce("parent_name", F.lit("")))
    assert rows(got, "*") == [(0, "A", ""), (1, "A", "A"), (2, "x", "A"), (2, "x", "A")]


def test_a_block_is_handed_on_once_for_all_that_it_holds():
    """Its header came with every piece in it before, and was read once for each."""
    import pyarrow as pa

    from codequarry.operators.blocks import _pieces

    found = _pieces(pa.array([["class A { int b; int c; void f() { d.e(); } }"], [""], []])).to_pylist()
    listed = [[(block["parent_text"], [piece["text"].strip() for piece in block["held"]]) for block in file] for file in found]
    assert listed == [[(None, ["class A"]), ("class A ", ["int b", "int c", "void f()"]), ("void f() ", ["d.e()"])], [], []]


def test_both_names_of_a_call_come_from_one_search(files):
    d = declarations(files(A="class A { void f() { a.b(c.d.e(), x); } }"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count(java.CALL) == 1
    assert [[tuple(c) for c in r.calls] for r in d.filter("calls IS NOT NULL").collect()] == [[("a", "b"), ("d", "e")]]


def test_comments_and_literals_are_blanked_alike_in_both_engines(spark):
    import random

    from codequarry.operators.blocks import _shown

    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(java.blank_literals(F.col("t")).alias("s")).collect()] == [_shown(t) for t in texts]


def test_pieces_know_what_they_have():
    import pyarrow as pa

    from codequarry.operators.blocks import ANGLED, BLANKS, DOTTED, EQUALS, ROUND, _pieces

    found = _pieces(pa.array([["{ a; b<c> d; é = e.f();g  h; }"], ["i\nj;"]])).to_pylist()
    pieces = {piece["text"]: piece["has"] for file in found for block in file for piece in block["held"]}
    assert pieces == {"": 0, "a": 0, "b<c> d": ANGLED, "é = e.f()": EQUALS | DOTTED | ROUND, "g  h": BLANKS, "i\nj": BLANKS}


def test_only_wanted_kinds_are_searched(files):
    """All patterns were searched whatever the next step kept."""
    f = files(
        A="package p; import q.R; @X(y = 1) class A<T> { R r = s.t(); int[] u; A(int v) { } void w() { x.y(); Z z = a; } interface I { int g(); } }",
        B="} import c.D; class E { enum F { G; H h; } record J(int k) { } void l() { new M() { int n; void o() { } }; } }",
    )
    every, shown = declarations(f), lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for kinds in (["class", "interface"], ["class", "method"], ["field"], ["package", "import"], ["record", "enum", "import", "field"]):
        want = every.filter(F.col("kind").isin(kinds)).withColumn("calls", F.lit(None))
        key = lambda r: (r.path, r.start)
        assert sorted(declarations(f, kinds).collect(), key=key) == sorted(want.collect(), key=key)
    types = shown(declarations(f, ["class"]))
    assert java.CALL not in types and java.METHOD_HEADER not in types and java.FIELD not in types
    assert java.CALL not in shown(declarations(f, ["field"])) and java.METHOD_HEADER not in shown(declarations(f, ["field"]))


def test_snippets_carry_their_text_along(spark, files):
    """The files were read again and joined by path before."""
    f = files(A="class A { void f() { } /* é */ void g() { } }", B="class B { }")
    assert "Join" not in X.snippets(f)._jdf.queryExecution().optimizedPlan().toString()
    odd = f.union(f).union(spark.createDataFrame([("src/B.java", None), (None, "class N { }")], f.schema))
    columns = ["path", "kind", "name", "start", "depth"]
    shown = lambda df: sorted((*map(str, r), r.content or "") for r in df.select(*columns, "content").collect())
    got = shown(X.snippets(odd))
    assert got == shown(X.snippets(odd, declarations(odd))) and len(got) == 14
