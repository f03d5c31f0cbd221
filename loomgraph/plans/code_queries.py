"""Parsing, extraction, artifacts and maintenance over data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as is_
from loomgraph.functions import text as texts
from loomgraph.operators import incremental, renames, tables
from loomgraph.operators.extract import Extracted, extract
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.lookups import first_by, heavy_keys, salted_lookup
from loomgraph.operators.ranges import first_covering
from loomgraph.plans.registry import query
from loomgraph.plans.star_graph import STAR_SQL, star_graph, table
from loomgraph.session import ensure_checkpoint_dir, stored, widen
from loomgraph.sources import artifacts, snapshot
from loomgraph.sources.source_tree import content_state, parse_sources

# -- source files written from table rows ----------------------------------------------

_PART_FILE = """import os, lib_{s}

class Part{k}:
    def weigh(self, unit):
        return convert_{s}(unit)

def convert_{k}(unit):
    item = Part{k}()
    logger.info(unit)
    return item

def test_weigh_ok():
    assert convert_{k}(1)
"""

_SUPPLIER_FILE = """package n{n};
import java.util.List;
public class Supplier{k} {
  private int balance;
  public Supplier{k}(int balance) { this.balance = balance; }
  public void ship(Item item) { log.info("x"); track(item); }
  void track(Item item) { new Parcel{n}(item); }
}
"""

_SUPPLIER_TEST = """package n{n};
public class Supplier{k}Test {
  @Test public void testShip() { new Supplier{k}(1).ship(null); }
}
"""


def _filled(template: str, **values: str) -> Column:
    text = F.lit(template)
    for name, column in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.col(column).cast("string"))
    return text


def _part_path() -> Column:
    return F.concat(
        F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/part_"),
        F.col("p_partkey").cast("string"), F.lit(".py"),
    )


def part_files(spark, sf) -> DataFrame:
    """One Python file per part."""
    return table(spark, sf, "part").select(
        _part_path().alias("file_path"),
        _filled(_PART_FILE, k="p_partkey", s="p_size").cast("binary").alias("content"),
    )


def supplier_files(spark, sf) -> DataFrame:
    """A Java class and its test per supplier."""
    rows = table(spark, sf, "supplier")

    def path(tree: str, suffix: str) -> Column:
        return F.concat(
            F.lit(f"app/src/{tree}/java/n"), F.col("s_nationkey").cast("string"), F.lit("/Supplier"),
            F.col("s_suppkey").cast("string"), F.lit(suffix),
        )

    pair = F.array(
        F.struct(path("main", ".java").alias("file_path"), _filled(_SUPPLIER_FILE, k="s_suppkey", n="s_nationkey").alias("text")),
        F.struct(path("test", "Test.java").alias("file_path"), _filled(_SUPPLIER_TEST, k="s_suppkey", n="s_nationkey").alias("text")),
    )
    return rows.select(F.explode(pair).alias("f")).select("f.file_path", F.col("f.text").cast("binary").alias("content"))


_PART_SQL = """f AS (SELECT *, replace(replace(path, '/', '_'), '.', '_') AS c FROM (
  SELECT 'src/' || lower(replace(p_brand, '#', '_')) || '/part_' || p_partkey || '.py' AS path, p_partkey AS k, p_size AS s
  FROM part) x),
head AS (SELECT min(path) AS path, min_by(c, path) AS c FROM f),
libs AS (SELECT s, min_by(c, path) AS c FROM f GROUP BY s)"""

_SUPPLIER_SQL = """f AS (SELECT *, replace(replace(path, '/', '_'), '.', '_') AS c, replace(replace(tpath, '/', '_'), '.', '_') AS t
  FROM (SELECT s_suppkey AS k, s_nationkey AS n, 'app/src/main/java/n' || s_nationkey || '/Supplier' || s_suppkey || '.java' AS path,
    'app/src/test/java/n' || s_nationkey || '/Supplier' || s_suppkey || 'Test.java' AS tpath FROM supplier) x),
head AS (SELECT min_by(c, path) AS c, min(path) AS path FROM f),
parcels AS (SELECT n, min_by(c, path) AS c FROM f GROUP BY n)"""


@query(
    "syntax_events",
    """SELECT kind, count(*) * n AS cnt FROM part, (VALUES ('file', 1), ('import', 2), ('class', 1), ('method', 1),
    ('function', 2), ('call', 4), ('assign', 1), ('return', 1)) v(kind, n) GROUP BY kind, n""",
)
def syntax_events(spark, sf):
    return parse_sources(part_files(spark, sf)).groupBy("kind").agg(F.count("*").alias("cnt"))


def _parts(spark, sf) -> Extracted:
    return extract(parse_sources(part_files(spark, sf)), published=True)


def _shown(entities: DataFrame) -> DataFrame:
    return entities.select("id", "name", "type", "file_path", "line_start", "line_end")


@query(
    "source_entities",
    f"""WITH {_PART_SQL}
    SELECT 'file_' || c AS id, 'part_' || k || '.py' AS name, 'file' AS type, path AS file_path, NULL::BIGINT AS line_start, NULL::BIGINT AS line_end FROM f
    UNION ALL SELECT c || '_class_Part' || k, 'Part' || k, 'class', path, 3, 5 FROM f
    UNION ALL SELECT c || '_function_weigh', 'weigh', 'function', path, 4, 5 FROM f
    UNION ALL SELECT c || '_function_convert_' || k, 'convert_' || k, 'function', path, 7, 10 FROM f
    UNION ALL SELECT c || '_test_test_weigh_ok', 'test_weigh_ok', 'test', path, 12, 13 FROM f
    UNION ALL SELECT c || '_import_os', 'os', 'import', path, NULL, NULL FROM f
    UNION ALL SELECT c || '_import_lib_' || s, 'lib_' || s, 'import', path, NULL, NULL FROM f
    UNION ALL SELECT c || '_placeholder_class_info', 'info', 'class', path, NULL, NULL FROM head
    UNION ALL SELECT c || '_placeholder_resource_logger', 'logger', 'resource', path, NULL, NULL FROM head
    UNION ALL SELECT 'unknown_function_logger.info', 'logger.info', 'unknown_function', '', NULL, NULL FROM head""",
)
def source_entities(spark, sf):
    return _shown(_parts(spark, sf).entities)


_PART_EDGES = f"""WITH {_PART_SQL}, conv AS (SELECT f.c, g.c || '_function_convert_' || g.k AS target
    FROM f JOIN f g ON g.k = f.s), edges AS (
    SELECT c || x AS src, 'file_' || c AS dst, 'BELONGS_TO' AS type FROM (SELECT c, unnest(['_class_Part' || k, '_function_weigh',
      '_function_convert_' || k, '_test_test_weigh_ok', '_import_os', '_import_lib_' || s]) AS x FROM f)
    UNION ALL SELECT f.c || '_import_os', head.c || '_import_os', 'IMPORTS' FROM f, head
    UNION ALL SELECT f.c || '_import_lib_' || f.s, libs.c || '_import_lib_' || f.s, 'IMPORTS' FROM f JOIN libs ON libs.s = f.s
    UNION ALL SELECT c || '_function_weigh', target, unnest(['CALLS', 'CREATES']) FROM conv
    UNION ALL SELECT c || '_function_convert_' || k, c || '_class_Part' || k, unnest(['CALLS', 'CREATES']) FROM f
    UNION ALL SELECT c || '_function_convert_' || k, 'unknown_function_logger.info', 'CALLS' FROM f
    UNION ALL SELECT f.c || '_function_convert_' || k, head.c || '_placeholder_class_info', 'CREATES' FROM f, head
    UNION ALL SELECT f.c || '_function_convert_' || k, head.c || '_placeholder_resource_logger', 'USES' FROM f, head
    UNION ALL SELECT c || '_test_test_weigh_ok', c || '_function_convert_' || k, unnest(['CALLS', 'CREATES']) FROM f
    UNION ALL SELECT c || '_test_test_weigh_ok', c || '_function_weigh', 'TESTS' FROM f)"""


@query("source_relationships", f"{_PART_EDGES} SELECT * FROM edges")
def source_relationships(spark, sf):
    return _parts(spark, sf).relationships.select("src", "dst", "type").distinct()


@query(
    "java_entities",
    f"""WITH {_SUPPLIER_SQL}
    SELECT 'file_' || c AS id, 'Supplier' || k || '.java' AS name, 'file' AS type, path AS file_path, NULL::BIGINT AS line_start, NULL::BIGINT AS line_end FROM f
    UNION ALL SELECT c || '_class_Supplier' || k, 'Supplier' || k, 'class', path, 3, 8 FROM f
    UNION ALL SELECT c || '_function_Supplier' || k, 'Supplier' || k, 'function', path, 5, 5 FROM f
    UNION ALL SELECT c || '_function_ship', 'ship', 'function', path, 6, 6 FROM f
    UNION ALL SELECT c || '_function_track', 'track', 'function', path, 7, 7 FROM f
    UNION ALL SELECT c || '_import_List', 'List', 'import', path, NULL, NULL FROM f
    UNION ALL SELECT 'file_' || t, 'Supplier' || k || 'Test.java', 'file', tpath, NULL, NULL FROM f
    UNION ALL SELECT t || '_class_Supplier' || k || 'Test', 'Supplier' || k || 'Test', 'class', tpath, 2, 4 FROM f
    UNION ALL SELECT t || '_test_testShip', 'testShip', 'test', tpath, 3, 3 FROM f
    UNION ALL SELECT parcels.c || '_placeholder_class_Parcel' || n, 'Parcel' || n, 'class', min(path), NULL, NULL
      FROM parcels JOIN f USING (n) GROUP BY parcels.c, n
    UNION ALL SELECT c || '_placeholder_resource_log', 'log', 'resource', path, NULL, NULL FROM head
    UNION ALL SELECT 'unknown_function_log.info', 'log.info', 'unknown_function', '', NULL, NULL FROM head
    UNION ALL SELECT 'unknown_function_new Supplier' || k, 'new Supplier' || k, 'unknown_function', '', NULL, NULL FROM f""",
)
def java_entities(spark, sf):
    return _shown(extract(parse_sources(supplier_files(spark, sf)), published=True).entities)


@query(
    "java_relationships",
    f"""WITH {_SUPPLIER_SQL}, covered AS (SELECT f.k, min_by(g.c, g.path) AS c FROM f JOIN f g ON contains(g.c, 'Supplier' || f.k) GROUP BY f.k)
    SELECT c || x AS src, 'file_' || c AS dst, 'BELONGS_TO' AS type FROM (SELECT c, unnest(['_class_Supplier' || k,
      '_function_Supplier' || k, '_function_ship', '_function_track', '_import_List']) AS x FROM f)
    UNION ALL SELECT t || x, 'file_' || t, 'BELONGS_TO' FROM (SELECT t, unnest(['_class_Supplier' || k || 'Test', '_test_testShip']) AS x FROM f)
    UNION ALL SELECT f.c || '_import_List', head.c || '_import_List', 'IMPORTS' FROM f, head
    UNION ALL SELECT c || '_function_ship', 'unknown_function_log.info', 'CALLS' FROM f
    UNION ALL SELECT c || '_function_ship', c || '_function_track', 'CALLS' FROM f
    UNION ALL SELECT f.c || '_function_ship', head.c || '_placeholder_resource_log', 'USES' FROM f, head
    UNION ALL SELECT f.c || '_function_track', parcels.c || '_placeholder_class_Parcel' || n, 'CREATES' FROM f JOIN parcels USING (n)
    UNION ALL SELECT t || '_test_testShip', 'unknown_function_new Supplier' || k, 'CALLS' FROM f
    UNION ALL SELECT t || '_test_testShip', c || '_class_Supplier' || k, 'CREATES' FROM f
    UNION ALL SELECT f.t || '_test_testShip', covered.c || '_function_ship', 'TESTS' FROM f JOIN covered USING (k)""",
)
def java_relationships(spark, sf):
    found = extract(parse_sources(supplier_files(spark, sf)), published=True)
    return found.relationships.select("src", "dst", "type").distinct()


_PACKAGE_MODULE = """from .shared import helper
from ..{o}.shared import helper as other
from lib.{o}.part_{m} import Part{m}
from . import part_{f}
from lib.{b} import VERSION
import lib.{b}.shared.missing
import {b}.shared
import json
from outside.kit import part_{k}

class Part{k}:
    pass
"""


def package_files(spark, sf) -> DataFrame:
    """A package per brand with equal names in every package, and a module per part."""
    brand = F.lower(F.translate("p_brand", "#", "_"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), brand.alias("b"))
    brands = parts.groupBy("b").agg(F.min("k").alias("f"), F.max("k").alias("m"))
    # The next brand by name, round and round; there are 25 at most.
    ring = Window.orderBy("b")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = brands.select(
        "b", "f", F.coalesce(F.lead("b").over(ring), F.first("b").over(whole)).alias("o"), F.coalesce(F.lead("m").over(ring), F.first("m").over(whole)).alias("m"),
    )
    rows = parts.join(F.broadcast(after), "b")
    modules = rows.select(
        F.format_string("lib/%s/part_%d.py", "b", "k").alias("file_path"), _filled(_PACKAGE_MODULE, k="k", b="b", o="o", m="m", f="f").alias("text"),
    )
    fixed = F.array(
        F.struct(F.concat(F.lit("lib/"), "b", F.lit("/__init__.py")).alias("file_path"), F.lit("VERSION = 1\n").alias("text")),
        F.struct(F.concat(F.lit("lib/"), "b", F.lit("/shared.py")).alias("file_path"), F.lit("def helper():\n    return 1\n").alias("text")),
    )
    rest = brands.select(F.explode(fixed).alias("x")).select("x.*")
    return modules.unionByName(rest).select("file_path", F.col("text").cast("binary").alias("content"))


@query(
    "source_imports_intended",
    """WITH p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '_')) AS b FROM part),
    g AS (SELECT b, min(k) AS f, max(k) AS m FROM p GROUP BY b),
    h AS (SELECT b, f, coalesce(lead(b) OVER w, first_value(b) OVER w) AS o, coalesce(lead(m) OVER w, first_value(m) OVER w) AS m FROM g WINDOW w AS (ORDER BY b)),
    x AS (SELECT p.k, p.b, f, o, m, 'lib_' || p.b || '_part_' || k || '_py_import_' AS i FROM p JOIN h USING (b))
    SELECT DISTINCT i || e.a AS src, e.z AS dst FROM (SELECT i, unnest([
      {'a': 'helper', 'z': 'lib_' || b || '_shared_py_function_helper'},
      {'a': 'helper', 'z': 'lib_' || o || '_shared_py_function_helper'},
      {'a': 'Part' || m, 'z': 'lib_' || o || '_part_' || m || '_py_class_Part' || m},
      {'a': 'part_' || f, 'z': 'file_lib_' || b || '_part_' || f || '_py'},
      {'a': 'VERSION', 'z': 'file_lib_' || b || '___init___py'},
      {'a': 'lib.' || b || '.shared.missing', 'z': 'file_lib_' || b || '_shared_py'},
      {'a': b || '.shared', 'z': 'file_lib_' || b || '_shared_py'},
      {'a': 'json', 'z': 'external_module_json'},
      {'a': 'part_' || k, 'z': 'external_module_outside_kit_part_' || k}]) AS e FROM x)""",
)
def source_imports_intended(spark, sf):
    """Imports of modules, packages and definitions by absolute and relative names."""
    found = extract(parse_sources(package_files(spark, sf)), published=False)
    return found.relationships.filter("type = 'IMPORTS'").select("src", "dst").distinct()


@query(
    "code_entity_table",
    f"""WITH {_PART_SQL} SELECT c || '_function_convert_' || k AS id, 'convert_' || k AS name, path AS file_path,
    7::BIGINT AS line_start, 10::BIGINT AS line_end, '[''unit'']' AS parameters, false AS is_test, '' AS methods,
    0::BIGINT AS line, false AS is_placeholder FROM f""",
)
def code_entity_table(spark, sf):
    rows = tables.node_rows(_parts(spark, sf).entities, "CodeEntity", text_lists=True)
    return rows.filter("type = 'function' AND name LIKE 'convert%'").select(
        "id", "name", "file_path", "line_start", "line_end", "parameters", "is_test", "methods", "line", "is_placeholder"
    )


# -- lookups ---------------------------------------------------------------------------

@query(
    "line_enclosing_entity",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders)
    SELECT a.k AS o_orderkey, min(b.k) AS enclosing FROM o a LEFT JOIN o b
      ON b.c = a.c AND a.d BETWEEN b.d AND b.d + b.k % 400 GROUP BY a.k""",
)
def line_enclosing_entity(spark, sf):
    """For each order the lowest order of its customer whose window of days covers it."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day")
    )
    windows = rows.select("o_custkey", "o_orderkey", F.col("day").alias("low"), (F.col("day") + F.col("o_orderkey") % 400).alias("high"))
    met = first_covering(
        rows, windows, ["o_custkey"], "day", "low", "high", F.col("o_orderkey"), F.col("o_orderkey"), "enclosing", ["o_orderkey", "o_custkey"]
    )
    return met.select("o_orderkey", "enclosing")


@query(
    "name_resolution_first_match",
    """WITH brand AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY p_brand, p_name),
    other AS (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') GROUP BY p_name)
    SELECT o.o_orderkey, l.l_partkey, l.l_suppkey, l.cnt, coalesce('brand:' || brand.k, 'any:' || other.k, 'unknown:' || p.p_name) AS target
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS cnt FROM lineitem GROUP BY ALL) l
    JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
    LEFT JOIN brand ON brand.p_brand = 'Brand#' || (l.l_suppkey % 25 + 1) AND brand.p_name = p.p_name
    LEFT JOIN other ON other.p_name = p.p_name""",
)
def name_resolution_first_match(spark, sf):
    """Line items name a part: the first of that name in the supplier's brand, else
    the first of some types anywhere, else an unknown one."""
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("cnt"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    names = part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    asked = salted_lookup(salted_lookup(lines, orders, ["l_orderkey"], "inner"), names, ["l_partkey"], "inner")
    asked = asked.withColumn("p_brand", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")))
    near = first_by(part, ["p_brand", "p_name"], F.col("p_partkey"), near=F.col("p_partkey"))
    far = first_by(part.filter(F.col("p_type").isin("ECONOMY", "STANDARD")), ["p_name"], F.col("p_partkey"), far=F.col("p_partkey"))
    met = salted_lookup(salted_lookup(asked, near, ["p_brand", "p_name"]), far, ["p_name"])
    target = F.coalesce(
        F.concat(F.lit("brand:"), F.col("near").cast("string")), F.concat(F.lit("any:"), F.col("far").cast("string")),
        F.concat(F.lit("unknown:"), F.col("p_name")),
    )
    return met.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "cnt", target.alias("target"))


# -- classification over texts --------------------------------------------------------------

_CREATION_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in is_.CREATION_PATTERNS)


@query(
    "call_predicates",
    f"""SELECT doc_id, ({_CREATION_SQL} OR regexp_matches(split_part(split_part(text, '(', 1), '.', -1), '^\\p{{Lu}}')) AS is_constructor,
    regexp_matches(lower(text), '({"|".join(is_.PYTHON_RESOURCES)})\\.') AS is_usage,
    md5(CASE WHEN contains(text, '(') THEN split_part(split_part(text, '(', 1), '.', -1) ELSE text END) AS created,
    md5(CASE WHEN contains(text, '.') THEN split_part(text, '.', 1) ELSE split_part(text, '(', 1) END) AS used FROM documents""",
)
def call_predicates(spark, sf):
    text = F.col("text")
    return widen(table(spark, sf, "documents")).select(
        "doc_id", is_.is_constructor_call(text).alias("is_constructor"), is_.is_python_usage(text).alias("is_usage"),
        F.md5(is_.created_class(text)).alias("created"), F.md5(is_.used_resource(text)).alias("used"),
    )


@query(
    "java_predicates",
    f"""SELECT page_id, regexp_matches(html, '({"|".join(is_.JAVA_RESOURCES)})\\.') AS is_usage,
    split_part(url, '.', -1) AS module, CASE WHEN contains(url, '.') THEN array_to_string(string_split(url, '.')[:-2], '.') END AS from_module
    FROM pages""",
)
def java_predicates(spark, sf):
    moved = is_.java_import(F.concat(F.lit("import "), F.col("url"), F.lit(";")))
    return table(spark, sf, "pages").select(
        "page_id", is_.is_java_usage(F.col("html")).alias("is_usage"), moved["module"].alias("module"), moved["from_module"].alias("from_module")
    )


def _test_names(spark, sf) -> DataFrame:
    """Method names in several styles, from customers."""
    key = F.col("c_custkey")
    styles = F.array(*[F.lit(s) for s in ("test_load_", "testShould", "when", "check_", "runTest", "TestCase", "plain")])
    style = F.get(styles, (key % 7).cast("int"))
    word = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 100)))
    tail = F.when(key % 11 == 0, "_test").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", F.concat(style, word, tail).alias("name"))


_TEST_NAMES_SQL = """names AS (SELECT c_custkey, ['test_load_', 'testShould', 'when', 'check_', 'runTest', 'TestCase', 'plain'][(c_custkey % 7)::INT + 1]
    || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 11 = 0 THEN '_test' ELSE '' END AS name FROM customer)"""


@query(
    "test_predicates",
    f"""WITH {_TEST_NAMES_SQL} SELECT c_custkey, name, (starts_with(name, 'test_') OR ends_with(name, '_test')) AS python_test,
    (starts_with(name, 'test') OR starts_with(name, 'should') OR starts_with(name, 'when') OR starts_with(name, 'given')
      OR (contains(name, 'Test') AND name <> 'Test')) AS java_test FROM names""",
)
def test_predicates(spark, sf):
    none = F.array().cast("array<string>")
    name = F.col("name")
    return _test_names(spark, sf).select(
        "c_custkey", "name", is_.is_python_test(name, none).alias("python_test"),
        is_.is_java_test(name, F.lit(None).cast("string"), none, none, F.lit("")).alias("java_test"),
    )


@query("tested_names")
def tested_names(spark, sf):
    """Names a test may stand for (the camel-case rule needs a lookahead the SQL check lacks)."""
    tested = is_.tested_name(F.col("name"))
    return _test_names(spark, sf).select(
        "c_custkey", tested.alias("tested"), F.array_join(is_.test_target_names(tested), ",").alias("targets"),
        F.array_join(is_.keyword_target_names(tested), ",").alias("fallbacks"),
    )


@query("camel_split")
def camel_split(spark, sf):
    joined = F.concat(F.initcap("p_name"), F.initcap("p_type"))
    name = texts.lower_first(F.replace(joined, F.lit(" "), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(is_.camel_parts(name), ",").alias("parts"))


@query(
    "path_functions",
    """SELECT page_id, split_part(url, '/', -1) AS base, translate(url, '/\\.', '___') AS clean, 'file_' || translate(url, '/\\.', '___') AS file_id,
    len(list_filter(string_split(url, '/'), lambda p: p IN ('build', 'dist', 'env', 'bin', 'target'))) = 0 AND regexp_matches(url || '.py', '\\.(py|java)$') AS is_source
    FROM pages""",
)
def path_functions(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", texts.base_name(url).alias("base"), texts.clean_path(url).alias("clean"), texts.file_id(url).alias("file_id"),
        is_.is_source_path(F.concat(url, F.lit(".py"))).alias("is_source"),
    )


@query(
    "repository_urls",
    """SELECT c_custkey, 'owner' || c_nationkey AS owner, 'repo' || c_custkey AS name FROM customer""",
)
def repository_urls(spark, sf):
    """https, ssh and short references of the same repository, with and without ``.git``."""
    key = F.col("c_custkey")
    prefix = F.get(F.array(F.lit("https://github.com/"), F.lit("git@github.com:"), F.lit("")), (key % 3).cast("int"))
    url = F.concat(
        prefix, F.lit("owner"), F.col("c_nationkey").cast("string"), F.lit("/repo"), key.cast("string"),
        F.when(key % 2 == 0, ".git").otherwise(""),
    )
    found = texts.repository_from_url(url)
    return table(spark, sf, "customer").select("c_custkey", found["owner"].alias("owner"), found["name"].alias("name"))


# -- artifacts -------------------------------------------------------------------------------

def _pulls(spark, sf) -> DataFrame:
    """Labelled documents as pull requests."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id")
    return docs.select(
        F.col("doc_id").alias("number"), F.col("source").alias("title"), F.col("text").alias("body"), F.lit("open").alias("state"),
        F.col("lang").alias("author"), F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("merged_at"),
        F.array(F.concat(F.lit("src/"), F.col("lang"), F.lit(".py")), F.lit("README.md")).alias("files_changed"),
    )


def _issues(spark, sf) -> DataFrame:
    """Conversation turns that open a conversation as issues."""
    return table(spark, sf, "conversations").filter("turn = 0").select(
        F.col("conv_id").alias("number"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("open").alias("state"),
        F.lit("someone").alias("author"), F.lit("2024-01-01").alias("created_at"), F.array("role").alias("labels"),
    )


def _commits(spark, sf) -> DataFrame:
    """Orders as commits that touch a file of their customer, an unknown file and a Java file."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.md5(key.cast("binary")).alias("sha"),
        F.concat(F.lit("update of order "), key, F.lit(" with priority "), F.col("o_orderpriority"), F.lit(" and more words to cut")).alias("message"),
        F.col("o_custkey").cast("string").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.array(F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".py")), F.lit("src/Main.java")).alias("files_changed"),
    )


@query(
    "artifact_nodes",
    """SELECT 'pr_' || d.doc_id AS id, 'PR #' || d.doc_id || ': ' || source AS name, 'pull_request' AS type, d.doc_id AS number, md5(text) AS body_hash
      FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'issue_' || conv_id, 'Issue #' || conv_id || ': ' || role, 'issue', conv_id, md5(text) FROM conversations WHERE turn = 0
    UNION ALL SELECT 'commit_' || substr(md5(o_orderkey::VARCHAR), 1, 8), 'Commit ' || substr(md5(o_orderkey::VARCHAR), 1, 8) || ': ' ||
      substr('update of order ' || o_orderkey || ' with priority ' || o_orderpriority || ' and more words to cut', 1, 50) || '...', 'commit', NULL, NULL FROM orders
    UNION ALL SELECT 'repo_' || r_name || '/' || n_name, n_name, 'repository', NULL, NULL FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def artifact_nodes(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    repositories = nations.select(
        F.col("r_name").alias("owner"), F.col("n_name").alias("name"), F.concat("r_name", F.lit("/"), "n_name").alias("full_name"),
        F.lit("").alias("description"), F.lit("Python").alias("language"), F.lit(None).cast("long").alias("stars"), F.lit(None).cast("long").alias("forks"),
    )
    parts = [
        artifacts.pull_nodes(_pulls(spark, sf)), artifacts.issue_nodes(_issues(spark, sf)),
        artifacts.commit_nodes(_commits(spark, sf)), artifacts.repository_nodes(repositories),
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    return nodes.select("id", "name", "type", "number", F.md5("body").alias("body_hash"))


@query(
    "artifact_edges",
    """SELECT 'pr_' || d.doc_id AS src, 'file_src_' || lang || '_py' AS dst, 'MODIFIES' AS type FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'commit_' || substr(md5(o_orderkey::VARCHAR), 1, 8), 'file_src_c' || o_custkey || '_py', 'MODIFIES' FROM orders""",
)
def artifact_edges(spark, sf):
    pulls = artifacts.modifies_edges(_pulls(spark, sf), "pull_request")
    return pulls.unionAll(artifacts.modifies_edges(_commits(spark, sf), "commit"))


@query(
    "newest_artifacts",
    """SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 200""",
)
def newest_artifacts(spark, sf):
    """The scan rule for issues: those of one kind left out, newest first, 200 at most."""
    rows = table(spark, sf, "events").filter("event_type <> 'error'")
    return rows.orderBy(F.desc("ts"), "event_id").limit(model.MAX_ISSUES).select("event_id")


# -- snapshots -----------------------------------------------------------------------------------

@query("snapshot_round_trip_edges", f"WITH {STAR_SQL} SELECT * FROM edges")
def snapshot_round_trip_edges(spark, sf):
    lines = snapshot.snapshot_lines(star_graph(spark, sf), metadata=False)
    return snapshot.graph_from_lines(lines).edges.select("src", "dst", "type")


@query("snapshot_round_trip_nodes", f"WITH {STAR_SQL} SELECT * FROM nodes")
def snapshot_round_trip_nodes(spark, sf):
    lines = snapshot.snapshot_lines(star_graph(spark, sf), metadata=False)
    return snapshot.graph_from_lines(lines).nodes.select("id", "name", "type", "file_path")


# -- change detection -------------------------------------------------------------------------------

def _part_entities(spark, sf) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("file_path"), F.concat(F.lit("part:"), key).alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("type"), F.col("p_size").alias("line_start"), (F.col("p_size") + 5).alias("line_end"),
        F.array("p_brand", "p_type").alias("parameters"), "p_partkey",
    )


def _edited_entities(spark, sf) -> DataFrame:
    """A later version: each tenth part gone, the next of each ten moved, some added."""
    rows = _part_entities(spark, sf)
    moved = rows.filter("p_partkey % 10 <> 0").withColumn(
        "line_start", F.when(F.col("p_partkey") % 10 == 1, F.col("line_start") + 100).otherwise(F.col("line_start"))
    )
    added = rows.filter("p_partkey % 10 = 2").withColumn("id", F.concat("id", F.lit(":new")))
    return moved.unionAll(added)


_HASH_SQL = "md5(p_name || '_' || p_type || '_' || {start} || '_' || (p_size + 5) || '_params_' || p_brand || ',' || p_type)"


@query("entity_hash", f"SELECT 'part:' || p_partkey AS id, {_HASH_SQL.format(start='p_size')} AS entity_hash FROM part")
def entity_hash(spark, sf):
    rows = _part_entities(spark, sf)
    return rows.select("id", incremental.entity_hash(rows.columns).alias("entity_hash"))


@query(
    "snapshot_diff",
    """SELECT p_brand AS file_path, 'part:' || p_partkey AS entity_id, CASE p_partkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'modified' ELSE 'unchanged' END AS change FROM part
    UNION ALL SELECT p_brand, 'part:' || p_partkey || ':new', 'added' FROM part WHERE p_partkey % 10 = 2""",
)
def snapshot_diff(spark, sf):
    old = incremental.entity_state(_part_entities(spark, sf))
    return incremental.snapshot_diff(old, incremental.entity_state(_edited_entities(spark, sf)))


def _document_listing(spark, sf, edited: bool) -> DataFrame:
    docs = table(spark, sf, "documents")
    text = F.col("text")
    if edited:
        docs = docs.filter("doc_id % 7 <> 0")
        text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(text)
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.select(path.alias("file_path"), text.cast("binary").alias("content"), F.length("text").alias("size"))


@query(
    "change_feed",
    """SELECT 'docs/' || doc_id || '.py' AS file_path, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change_type
    FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""",
)
def change_feed(spark, sf):
    return incremental.change_feed(
        content_state(_document_listing(spark, sf, False)), content_state(_document_listing(spark, sf, True))
    )


_MARK = "# moved to folder "


def _moved_listing(spark, sf, later: bool) -> DataFrame:
    """Documents as files; later a third of them lies in other folders, a part of those with one more line.

    Every tenth has gone by then.
    """
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    folder, text = F.lit("docs/"), F.col("text")
    if later:
        docs = docs.filter("doc_id % 10 <> 0")
        moved, edited = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
        folder = F.when(moved & edited, "edited/").when(moved, "moved/").otherwise("docs/")
        text = F.when(moved & edited, F.concat(F.lit(_MARK), number, F.lit("\n"), "text")).otherwise(text)
    return docs.select(F.concat(folder, number, F.lit(".py")).alias("file_path"), text.cast("binary").alias("content"))


@query(
    "change_feed_renames",
    f"""WITH d AS (SELECT doc_id, text, lpad(doc_id::VARCHAR, 12, '0') AS num, md5(text) AS h FROM documents WHERE text IS NOT NULL),
    gone AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY num) AS n FROM d WHERE doc_id % 10 = 0 OR doc_id % 3 = 0),
    come AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY num) AS n FROM d WHERE doc_id % 10 <> 0 AND doc_id % 6 = 3),
    same AS (SELECT g.num AS old_num, c.num AS new_num FROM gone g JOIN come c USING (h, n)),
    edited AS (SELECT num, h, strlen(text) + 1 AS size, strlen(text) + 2 + {len(_MARK) + 12} AS grown,
        row_number() OVER (PARTITION BY h ORDER BY num) AS n FROM d WHERE doc_id % 10 <> 0 AND doc_id % 6 = 0),
    still AS (SELECT num, h, row_number() OVER (PARTITION BY h ORDER BY num) AS n FROM gone WHERE num NOT IN (SELECT old_num FROM same)),
    changed AS (SELECT s.num AS old_num, e.num AS new_num FROM still s JOIN edited e USING (h, n) WHERE 2 * e.size >= e.grown)
    SELECT 'moved/' || new_num || '.py' AS file_path, 'renamed' AS change_type, 'docs/' || old_num || '.py' AS old_path FROM same
    UNION ALL SELECT 'edited/' || new_num || '.py', 'renamed', 'docs/' || old_num || '.py' FROM changed
    UNION ALL SELECT 'docs/' || num || '.py', 'deleted', NULL FROM still WHERE num NOT IN (SELECT old_num FROM changed)
    UNION ALL SELECT 'edited/' || num || '.py', 'added', NULL FROM edited WHERE num NOT IN (SELECT new_num FROM changed)
    UNION ALL SELECT 'moved/' || num || '.py', 'added', NULL FROM come WHERE num NOT IN (SELECT new_num FROM same)""",
)
def change_feed_renames(spark, sf):
    """Moved files are found by equal contents, moved and edited ones by their lines."""
    before, after = (renames.line_profile(_moved_listing(spark, sf, later)) for later in (False, True))
    return renames.with_renames(incremental.change_feed(before, after), renames.renames(before, after))


@query(
    "changed_files",
    """SELECT 'docs/' || doc_id || '.py' AS file_path, md5(text || '!') AS content_hash FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0""",
)
def changed_files(spark, sf):
    """Files left to parse after those with a known content hash are skipped."""
    state = content_state(_document_listing(spark, sf, False))
    return content_state(incremental.changed_files(state, _document_listing(spark, sf, True)))


@query(
    "change_summary",
    """SELECT 'docs/' || doc_id || '.py' AS file_path, CASE WHEN doc_id % 7 = 0 THEN 'deleted' END AS status,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 = 0 END AS content_changed, CASE WHEN doc_id % 7 <> 0 THEN false END AS ast_changed, length(text)::INT AS entity_count,
    CASE WHEN doc_id % 7 <> 0 THEN substr(md5(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END), 1, 8) END AS current_hash,
    CASE WHEN doc_id % 7 <> 0 THEN substr(md5(text), 1, 8) END AS stored_hash FROM documents""",
)
def change_summary(spark, sf):
    def listing(edited: bool) -> DataFrame:
        return _document_listing(spark, sf, edited).select(
            "file_path", F.md5("content").alias("content_hash"), F.lit("same").alias("ast_hash"), F.col("size").alias("entity_count")
        )

    return incremental.change_summary(listing(False), listing(True))


def _edited_parts(spark, sf) -> DataFrame:
    """Every third part's file loses its test and gets a second function."""
    edited = F.replace(
        F.col("content").cast("string"), F.lit("def test_weigh_ok():\n    assert "), F.lit("def extra(unit):\n    return ")
    )
    key = F.regexp_extract("file_path", r"part_(\d+)", 1).cast("long")
    return part_files(spark, sf).filter(key % 3 == 0).select("file_path", edited.cast("binary").alias("content"))


@query(
    "incremental_rebuild",
    f"""{_PART_EDGES}, odd AS (SELECT c, k FROM f WHERE k % 3 = 0)
    SELECT * FROM edges WHERE src NOT IN (SELECT c || '_test_test_weigh_ok' FROM odd)
    UNION ALL SELECT c || '_function_extra', 'file_' || c, 'BELONGS_TO' FROM odd
    UNION ALL SELECT c || '_function_extra', c || '_function_convert_' || k, unnest(['CALLS', 'CREATES']) FROM odd""",
)
def incremental_rebuild(spark, sf):
    """Intended maintenance: only changed files are parsed, links across files survive."""
    stored = parse_sources(part_files(spark, sf))
    fresh = incremental.refreshed(stored, parse_sources(_edited_parts(spark, sf)))
    return extract(fresh, published=True).relationships.select("src", "dst", "type").distinct()


@query(
    "incremental_apply",
    f"""WITH {_PART_SQL} SELECT (SELECT count(*) FROM f WHERE k % 3 = 0) AS entities_added, 0::BIGINT AS entities_updated,
    (SELECT count(*) FROM f WHERE k % 3 = 0) AS entities_removed, (SELECT count(*) * 20 FROM f WHERE k % 3 = 0) AS relationships_added,
    (SELECT count(*) FROM f WHERE k % 3 = 0) AS files_processed, (SELECT count(*) * 2 FROM f WHERE k % 3 = 0) AS fine_grained_updates""",
)
def incremental_apply(spark, sf):
    """Published maintenance over the edited files; every file was analysed on its own before."""
    before = extract(parse_sources(part_files(spark, sf)), published=True, per_file=True)
    snapshot_rows = stored(incremental.entity_state(before.entities), sized=True)
    nodes = before.entities.drop("scope", "ord").dropDuplicates(["id"])
    edges = before.relationships.select("src", "dst", "type", "line", "call_text").dropDuplicates(["src", "dst", "type"])
    graph = PropertyGraph(stored(nodes, sized=True), stored(edges, sized=True))
    return incremental.apply_changes(graph, snapshot_rows, parse_sources(_edited_parts(spark, sf))).counters


# -- behaviour at the edges ----------------------------------------------------------------------

@query(
    "heavy_key_lookup",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey",
)
def heavy_key_lookup(spark, sf, rows_per_task: int = 400):
    """Suppliers of line items; one with over ``rows_per_task`` lines is spread over several tasks."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    heavy = heavy_keys(lines, ["l_suppkey"], rows_per_task)
    return salted_lookup(lines, names, ["l_suppkey"], "left", heavy=heavy)


@query(
    "repository_artifact_nodes",
    """SELECT 'pr_' || event_type || '#' || (event_id % 100) AS id, 'PR #' || (event_id % 100) || ': ' || min(event_id) AS name, 'pull_request' AS type
    FROM events GROUP BY event_type, event_id % 100""",
)
def repository_artifact_nodes(spark, sf):
    """Event types as repositories whose pull requests have the same numbers."""
    events = table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 100).alias("number")).agg(F.min("event_id").cast("string").alias("title"))
    missing = ("body", "state", "author", "created_at", "merged_at")
    rows = events.select("event_type", "number", "title", *[F.lit("").alias(c) for c in missing], F.array(F.lit("a.py")).alias("files_changed"))
    return artifacts.pull_nodes(rows, F.col("event_type")).select("id", "name", "type")


@query(
    "wide_intervals",
    """SELECT o_orderkey, min(p_partkey) AS covering FROM orders LEFT JOIN part ON p_partkey % 25 = o_orderkey % 25
      AND (o_orderkey % 4000) * 562949953421312 + o_orderkey BETWEEN (p_partkey % 2000) * 562949953421312 AND (p_partkey % 2000 + p_size) * 562949953421312
    GROUP BY o_orderkey""",
)
def wide_intervals(spark, sf):
    """Points and intervals far apart, as positions in a concatenation of all files would be."""
    unit = F.lit(1 << 49)
    points = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("k"), ((F.col("o_orderkey") % 4000) * unit + F.col("o_orderkey")).alias("at"))
    low = F.col("p_partkey") % 2000
    parts = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 25).alias("k"), (low * unit).alias("low"), ((low + F.col("p_size")) * unit).alias("high")
    )
    met = first_covering(points, parts, ["k"], "at", "low", "high", F.col("p_partkey"), F.col("p_partkey"), "covering", ["o_orderkey"])
    return met.select("o_orderkey", "covering")


@query(
    "snapshot_folder_round_trip",
    """SELECT 'part:' || p_partkey AS id, p_partkey AS ord, 'about ' || p_name AS docstring, 'def ' || p_brand AS code, p_type AS kind, '[' || p_size || ',1]' AS sizes
    FROM part""",
)
def snapshot_folder_round_trip(spark, sf):
    """Order, texts and columns that a snapshot does not know survive a folder of JSON lines."""
    part = table(spark, sf, "part")
    nodes = part.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit("function").alias("type"),
        F.lit("").alias("file_path"), F.col("p_partkey").alias("ord"), F.concat(F.lit("about "), "p_name").alias("docstring"),
        F.concat(F.lit("def "), "p_brand").alias("code"), F.col("p_type").alias("kind"), F.array("p_size", F.lit(1)).alias("sizes"),
    )
    graph = PropertyGraph(nodes, spark.createDataFrame([], model.EDGE_SCHEMA))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshot_{uuid.uuid4().hex}"
    snapshot.export_snapshot(graph, folder)
    found = snapshot.import_snapshot(spark, folder).nodes
    return found.select("id", "ord", "docstring", "code", F.col("props")["kind"].alias("kind"), F.col("props")["sizes"].alias("sizes"))
