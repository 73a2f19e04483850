"""Java files derived from the relational tables, one file per row.

The templates hold what trips simple extraction: commented-out classes, braces in
literals, a text block, nested and anonymous classes, lambdas, array initialisers,
constructors, deep generic types, static imports, non-ASCII text and names, names with $,
annotations with arrays and nested arguments, a file without package. ``sql_concat`` renders a
template as a concatenation that any SQL engine reads, so expected contents can be written
with the same helper. No file grows with the size of a group.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.documents import read_table

STEP = "  public void step{i}(int a) { if (a > {i}) { Customer{k}.touch(); } }\n"
ORDER_HEAD = """\
/* class Ghost{o} extends Nowhere { */
package r{r}.n{n};
import model.Customer{k};
import java.util.List;
import static x.Y.z;
// é ü } class Dead{o} {
"""
ORDER_FIELDS = """\

  private Customer{k} owner;
  List<String> tags;
  String label = "} \\" {"; char q = '"'; char b = '{';
  public Order{o}() { }
"""
INNER = "static class Inner{o} { void ping() { owner.notify(1); } }"
CUSTOMER_HEAD = "package model;\n"
TOUCH = "public static void touch() { }"
CUSTOMER = "public abstract class Customer{k} extends Nation{n} {\n  Nation{n} home;\n  " + TOUCH + "\n}"
NATION = "public abstract class Nation{n} {\n  " + TOUCH + "\n}"
STATUS = "public interface Status{s} {\n  void audit(int level);\n}"
REGION = "public interface Region{r} {\n  String label(int level);\n}"
PAY = "abstract void pay();"
INNER_RUN = "public void run() { }"
RUN = "void run() { Runnable r = () -> { Nation{n}.touch(); }; new Thread() { " + INNER_RUN + " }; }"
SUPPLIER_FIELDS = (
    '\n  List<Nation{n}> homes;\n  int[] sizes = {1, 2};\n'
    '  String note = """\n  { "x" } """;\n  '
)
SUPPLIER_OPEN = "abstract class Supplier{s} extends Party<String> implements Region{r} {"
SIZE_OPEN = '@SuppressWarnings({"a", "b"})\npublic class Größe{r} extends Über$Basis{r} implements Region{r} {'
NAMED = '@Named(value = {"x"}, of = @At(by = @In(c(d = 1)))) private Ann$Type{r} ähnlich;'
DEEP = "Map<A<B<C<D<E<String>>>>>, int[]> tief;"
OPEN_METHOD = "@Deprecated public void öffne() { Nation$X.erste(); Größe{r}.zweite(); }"
SIZE_BODY = "\n  " + NAMED + "\n  " + DEEP + "\n  " + OPEN_METHOD + "\n"


def sql_concat(template: str, columns: Mapping[str, str]) -> str:
    """SQL that fills ``{name}`` placeholders with column expressions."""
    parts = []
    for piece in re.split(r"(\{[a-z]\}|[\n'\\])", template):
        if not piece:
            continue
        if piece[0] == "{" and piece[1:-1] in columns:
            parts.append(f"CAST({columns[piece[1:-1]]} AS STRING)")
        elif piece in "\n'\\":
            parts.append(f"chr({ord(piece)})")
        else:
            parts.append(f"'{piece}'")
    return "(" + " || ".join(parts) + ")"


def order_steps_sql(columns: Mapping[str, str], priority: str) -> str:
    """One method per step up to the order's priority digit."""
    return " || ".join(
        f"CASE WHEN {priority} >= {i} THEN {sql_concat(STEP.replace('{i}', str(i)), columns)} ELSE '' END"
        for i in range(1, 6)
    )


ORDER_COLUMNS = {"o": "o_orderkey", "k": "o_custkey", "n": "n_nationkey", "r": "n_regionkey", "s": "o_orderstatus"}
CUSTOMER_COLUMNS = {"k": "c_custkey", "n": "c_nationkey"}
SUPPLIER_COLUMNS = {"s": "s_suppkey", "n": "n_nationkey", "r": "n_regionkey"}
PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INT)"


def order_class_sql() -> str:
    c = ORDER_COLUMNS
    return (
        sql_concat("public class Order{o} extends Customer{k} implements Status{s}, Region{r} {" + ORDER_FIELDS, c)
        + " || " + order_steps_sql(c, PRIORITY)
        + " || " + sql_concat("  " + INNER + "\n}", c)
    )


def corpus_sql() -> str:
    """``path, content`` over the tables orders, customer, nation, region, supplier."""
    o, k, s = ORDER_COLUMNS, CUSTOMER_COLUMNS, SUPPLIER_COLUMNS
    nation = {"n": "n_nationkey"}
    region = {"r": "r_regionkey"}
    status = {"s": "o_orderstatus"}
    supplier = SUPPLIER_OPEN + SUPPLIER_FIELDS + PAY + "\n  " + RUN + "\n}\n"
    return f"""
SELECT {sql_concat('src/r{r}/n{n}/Order{o}.java', o)} AS path,
       {sql_concat(ORDER_HEAD, o)} || {order_class_sql()} || chr(10) AS content
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT {sql_concat('src/model/Customer{k}.java', k)},
       {sql_concat(CUSTOMER_HEAD + CUSTOMER, k)} || chr(10)
FROM customer
UNION ALL
SELECT {sql_concat('src/model/Nation{n}.java', nation)},
       {sql_concat(CUSTOMER_HEAD + NATION, nation)} || chr(10)
FROM nation
UNION ALL
SELECT {sql_concat('src/model/Region{r}.java', region)},
       {sql_concat(CUSTOMER_HEAD + REGION, region)} || chr(10)
FROM region
UNION ALL
SELECT {sql_concat('Größe{r}.java', region)},
       {sql_concat(SIZE_OPEN + SIZE_BODY + '}', region)} || chr(10)
FROM region
UNION ALL
SELECT {sql_concat('src/model/Status{s}.java', status)},
       {sql_concat(CUSTOMER_HEAD + STATUS, status)} || chr(10)
FROM (SELECT DISTINCT o_orderstatus FROM orders) st
UNION ALL
SELECT {sql_concat('src/model/Supplier{s}.java', s)},
       CASE WHEN s_acctbal < 0 THEN '' ELSE {sql_concat(CUSTOMER_HEAD + supplier, s)} END
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


#: Brackets nested so deep that only counting matches them.
LEVELS = 43
DEEP_TYPE = "A<" * LEVELS + "B" + ">" * LEVELS
DEEP_ARGUMENT = "(" * LEVELS + "x = {1;}" + ")" * LEVELS
PART = (
    """\
package shop.z{z};
import tools.b.Tool{z};
/* { home.ghost(); */
public class Part{p} extends Base{z} implements Visible {
  private Nation home;
"""
    + f"  Map<{DEEP_TYPE}, int[]> far;\n  @At({DEEP_ARGUMENT}) Tool{{z}} tool;\n"
    + """\
  enum Color { RED, BLUE; Brush brush; void paint(Brush brush) { brush.draw(); this.brush.dry(); } }
  record Pair(Left left, Right<Left> right) { int sum() { return left.size() + right.size(); } }
  class Local{p} { }
  Part{p}(Owner owner) { this.home = owner.home(); this.run(null); }
  <X> void run(final Guest home, int... n) throws Oops {
    home.touch(); this.home.touch();
    for (Item item : items()) { item.pack(); }
    for (Cursor c = home.first(); n < c.size() && c > n; c.next()) c.use();
    if (home instanceof Star star) { star.shine(); }
    star.late();
  }
  void walk() {
    home.touch(); Guest tool = new Guest(); tool.use(); this.tool.use();
    Runnable r = () -> { Lamp home = null; home.light(); };
    home.again(); list.forEach((Bolt home) -> home.turn());
    var own = new Local{p}(); own.go();
    try (Stream in = open()) { in.read(); } catch (Oops oops) { oops.print(); }
    Tool{z}.touch(); helper().more(); a.b.c();
    F<Part{p}, B> f = x -> x.run();
    new Thread() { Lens lens; void see() { lens.look(); home.touch(); } };
    switch (k) { case 1 -> home.one(); default -> home.two(); }
  }
}
"""
)
PART_COLUMNS = {"p": "p_partkey", "z": "p_size"}
SIZES = {
    "src/shop/z{z}/Base{z}.java": "package shop.z{z};\npublic class Base{z} { Tool{z} tool; }\n",
    "src/other/z{z}/Base{z}.java": "package other.z{z};\npublic class Base{z} extends Visible { }\n",
    "src/tools/a/Tool{z}.java": "package tools.a;\npublic class Tool{z} { }\n",
    "src/tools/b/Tool{z}.java": "package tools.b;\npublic class Tool{z} extends Base{z} { void touch() { } }\n",
}
VISIBLE = "public interface Visible { }\n"


def shop_sql() -> str:
    """``path, content``: files with shadowed names, types of one name in several packages and deep
    brackets, over the table part."""
    size = {"z": "p_size"}
    rows = [f"SELECT {sql_concat('src/shop/z{z}/Part{p}.java', PART_COLUMNS)} AS path, {sql_concat(PART, PART_COLUMNS)} AS content FROM part"]
    rows += [f"SELECT {sql_concat(p, size)}, {sql_concat(c, size)} FROM (SELECT DISTINCT p_size FROM part) s" for p, c in SIZES.items()]
    return "\nUNION ALL\n".join([*rows, f"SELECT 'src/Visible.java', {sql_concat(VISIBLE, {})}"])


def shop_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``shop_sql``."""
    tables = {"part": read_table(spark, folder, "part")}
    return spark.sql(_with_tables(shop_sql(), tables), **tables)


def java_files(spark: SparkSession, folder: str) -> DataFrame:
    """The derived corpus as a ``files`` table."""
    tables = {
        name: read_table(spark, folder, name)
        for name in ("orders", "customer", "nation", "region", "supplier")
    }
    return spark.sql(_with_tables(corpus_sql(), tables), **tables).withColumn(
        "content_md5", F.md5("content")
    )


def _with_tables(sql: str, tables: Mapping[str, DataFrame]) -> str:
    """Point table names at the data frames handed to ``spark.sql``."""
    return re.sub(
        rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", lambda m: f"{m[1]} {{{m[2]}}}", sql.replace("{", "{{").replace("}", "}}")
    )
