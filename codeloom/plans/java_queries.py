"""Registered queries of the parser, the resolver and the compiler overlay, over a small repository of their own (``fixture``).

What each must return is written out beside it, as the rules of the Java language and of resolution give it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.operators import graph
from codeloom.plans import fixture, overlay
from codeloom.plans.build import build, node_table
from codeloom.plans.engine import named_members
from codeloom.plans.registry import query, values
from codeloom.sources.scip import parse_symbols
from codeloom.work import Work


def _graph(spark) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Parsed files, nodes, and the tables built from them, of the fixture."""
    work = Work(spark, "fixture")
    parsed = work.save(fixture.parsed(spark), "parsed")
    nodes = work.save(node_table(parsed, "repo", suffixes={"Animal": "CREATURE"}), "nodes")
    return parsed, nodes, build(parsed, nodes)


def _name(id: str):
    """The qualified name in a node's id."""
    return F.element_at(F.split(id, ":"), -1)


@query(
    values(
        "file kind qualified_name signature span_start:INTEGER span_end:INTEGER annotations",
        """
kitchen/Food.java | class | kitchen.Food | class Food | 2 | 4 | 
kitchen/Food.java | method | kitchen.Food#size(int,Map) | int size(int, Map) | 3 | 3 | 
kitchen/Oven.java | class | kitchen.Oven | class Oven | 2 | 4 | 
kitchen/Oven.java | method | kitchen.Oven#heat(Food) | void heat(Food) | 3 | 3 | 
kitchen/Soup.java | class | kitchen.Soup | class Soup extends Food | 2 | 3 | Deprecated
kitchen/Tools.java | class | kitchen.Tools | class Tools | 2 | 4 | 
kitchen/Tools.java | method | kitchen.Tools#weigh(Food) | int weigh(Food) | 3 | 3 | 
park/Broken.java | class | park.Broken | class Broken | 2 | 3 | 
park/Guide.java | class | park.Guide | class Guide | 3 | 10 | RestController
park/Guide.java | method | park.Guide#tour(Lion,Radio) | void tour(Lion, Radio) | 5 | 9 | GetMapping
park/Horn.java | class | park.Horn | class Horn | 2 | 4 | 
park/Horn.java | method | park.Horn#both() | void both() | 3 | 3 | 
park/Radio.java | class | park.Radio | class Radio | 2 | 5 | 
park/Radio.java | method | park.Radio#both() | void both() | 4 | 4 | 
park/Radio.java | method | park.Radio#hum() | void hum() | 3 | 3 | 
zoo/Animal.java | interface | zoo.Animal | interface Animal | 2 | 5 | 
zoo/Animal.java | method | zoo.Animal#legs() | int legs() | 4 | 4 | 
zoo/Animal.java | method | zoo.Animal#name() | String name() | 3 | 3 | 
zoo/Base.java | class | zoo.Base | class Base implements Animal | 3 | 12 | Service
zoo/Base.java | constructor | zoo.Base#<init>(Feeder) | Base(Feeder) | 7 | 7 | 
zoo/Base.java | enum | zoo.Base.Mood | enum Mood | 11 | 11 | 
zoo/Base.java | enum_constant | zoo.Base.Mood.CALM | Mood.CALM | 11 | 11 | 
zoo/Base.java | enum_constant | zoo.Base.Mood.WILD | Mood.WILD | 11 | 11 | 
zoo/Base.java | field | zoo.Base#feeder | Feeder feeder | 5 | 5 | 
zoo/Base.java | field | zoo.Base#kin | List<Base> kin | 6 | 6 | 
zoo/Base.java | method | zoo.Base#eat(Food) | void eat(Food) | 10 | 10 | 
zoo/Base.java | method | zoo.Base#label() | String label() | 9 | 9 | 
zoo/Base.java | method | zoo.Base#name() | String name() | 8 | 8 | 
zoo/Feeder.java | class | zoo.Feeder | class Feeder | 3 | 9 | 
zoo/Feeder.java | method | zoo.Feeder#serve(Food) | void serve(Food) | 6 | 6 | 
zoo/Feeder.java | method | zoo.Feeder#serve(Food,int) | void serve(Food, int) | 5 | 5 | 
zoo/Feeder.java | method | zoo.Feeder#serve(Food,long) | void serve(Food, long) | 4 | 4 | 
zoo/Feeder.java | method | zoo.Feeder#serve(Object) | void serve(Object) | 7 | 7 | 
zoo/Feeder.java | method | zoo.Feeder#serve(String) | void serve(String) | 8 | 8 | 
zoo/Lion.java | class | zoo.Lion | class Lion extends Base<Food> | 5 | 29 | 
zoo/Lion.java | class | zoo.Lion.Cub | class Cub extends Lion | 25 | 28 | 
zoo/Lion.java | constructor | zoo.Lion#<init>(Feeder) | Lion(Feeder) | 6 | 6 | 
zoo/Lion.java | constructor | zoo.Lion.Cub#<init>(int) | Cub(int) | 26 | 26 | 
zoo/Lion.java | method | zoo.Lion#eat(Food) | void eat(Food) | 7 | 8 | Override
zoo/Lion.java | method | zoo.Lion#feed(Feeder,Food) | void feed(Feeder, Food) | 9 | 24 | 
zoo/Lion.java | method | zoo.Lion.Cub#play() | void play() | 27 | 27 | 
""",
    ),
    False,
)
def java_extract(spark, sf):
    n = fixture.parsed(spark).select("file", F.explode("nodes").alias("n"))
    return n.select("file", "n.kind", "n.qualified_name", "n.signature", "n.span_start", "n.span_end", F.array_join("n.annotations", " ").alias("annotations"))


@query(
    values(
        "file what owner name detail line:INTEGER",
        """
kitchen/Food.java | use | kitchen.Food#size(int,Map) | Food | generic_arg | 3
kitchen/Food.java | use | kitchen.Food#size(int,Map) | Map | param_type | 3
kitchen/Food.java | use | kitchen.Food#size(int,Map) | String | generic_arg | 3
kitchen/Oven.java | use | kitchen.Oven#heat(Food) | Food | param_type | 3
kitchen/Soup.java | EXTENDS | kitchen.Soup | Food | ~ | 3
kitchen/Soup.java | use | kitchen.Soup | Deprecated | annotation_type | 2
kitchen/Tools.java | use | kitchen.Tools#weigh(Food) | Food | param_type | 3
park/Guide.java | call | park.Guide#tour(Lion,Radio) | eat | variable Lion null | 7
park/Guide.java | call | park.Guide#tour(Lion,Radio) | hum | variable Radio | 8
park/Guide.java | import | zoo.Lion | name | ~ | 2
park/Guide.java | use | park.Guide | RestController | annotation_type | 3
park/Guide.java | use | park.Guide#tour(Lion,Radio) | GetMapping | annotation_type | 5
park/Guide.java | use | park.Guide#tour(Lion,Radio) | Lion | param_type | 6
park/Guide.java | use | park.Guide#tour(Lion,Radio) | Lost | throws | 6
park/Guide.java | use | park.Guide#tour(Lion,Radio) | Radio | param_type | 6
zoo/Animal.java | use | zoo.Animal#name() | String | return_type | 3
zoo/Base.java | IMPLEMENTS | zoo.Base | Animal | ~ | 4
zoo/Base.java | call | zoo.Base#name() | label | unqualified - | 8
zoo/Base.java | import | java.util.List | name | ~ | 2
zoo/Base.java | use | zoo.Base | Service | annotation_type | 3
zoo/Base.java | use | zoo.Base#<init>(Feeder) | Feeder | param_type | 7
zoo/Base.java | use | zoo.Base#eat(Food) | Food | param_type | 10
zoo/Base.java | use | zoo.Base#feeder | Feeder | field_type | 5
zoo/Base.java | use | zoo.Base#kin | Base | generic_arg | 6
zoo/Base.java | use | zoo.Base#kin | List | field_type | 6
zoo/Base.java | use | zoo.Base#label() | String | return_type | 9
zoo/Base.java | use | zoo.Base#name() | String | return_type | 8
zoo/Feeder.java | import | kitchen | wildcard | ~ | 2
zoo/Feeder.java | use | zoo.Feeder#serve(Food) | Food | param_type | 6
zoo/Feeder.java | use | zoo.Feeder#serve(Food,int) | Food | param_type | 5
zoo/Feeder.java | use | zoo.Feeder#serve(Food,long) | Food | param_type | 4
zoo/Feeder.java | use | zoo.Feeder#serve(Object) | Object | param_type | 7
zoo/Feeder.java | use | zoo.Feeder#serve(String) | String | param_type | 8
zoo/Lion.java | EXTENDS | zoo.Lion | Base | ~ | 5
zoo/Lion.java | EXTENDS | zoo.Lion.Cub | Lion | ~ | 25
zoo/Lion.java | call | zoo.Lion#eat(Food) | feed | unqualified - unknown Food | 8
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | <init> | type Cub int | 22
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | <init> | type Soup | 15
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | both | unqualified - | 21
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | call | type lost | 23
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | heat | unqualified - Food | 19
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | hum | unqualified - | 20
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | legs | unqualified - | 17
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | name | super - | 16
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | name | unqualified - | 14
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | play | chain - | 22
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder @call:this:name:0 | 14
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder Food int | 10
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder Food long | 11
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder Object | 12
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder Soup | 15
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | serve | variable Feeder null | 13
zoo/Lion.java | call | zoo.Lion#feed(Feeder,Food) | weigh | unqualified - Food | 18
zoo/Lion.java | call | zoo.Lion.Cub#play() | eat | this - null | 27
zoo/Lion.java | import | kitchen.Food | name | ~ | 2
zoo/Lion.java | import | kitchen.Oven | static wildcard | ~ | 4
zoo/Lion.java | import | kitchen.Tools.weigh | static name | ~ | 3
zoo/Lion.java | use | zoo.Lion#<init>(Feeder) | Feeder | param_type | 6
zoo/Lion.java | use | zoo.Lion#eat(Food) | Food | param_type | 8
zoo/Lion.java | use | zoo.Lion#eat(Food) | Override | annotation_type | 7
zoo/Lion.java | use | zoo.Lion#feed(Feeder,Food) | Cub | object_creation | 22
zoo/Lion.java | use | zoo.Lion#feed(Feeder,Food) | Feeder | param_type | 9
zoo/Lion.java | use | zoo.Lion#feed(Feeder,Food) | Food | param_type | 9
zoo/Lion.java | use | zoo.Lion#feed(Feeder,Food) | Object | cast | 12
zoo/Lion.java | use | zoo.Lion#feed(Feeder,Food) | Soup | object_creation | 15
""",
    ),
    False,
)
def java_references(spark, sf):
    p = Work(spark, "fixture").save(fixture.parsed(spark), "parsed")
    of = lambda what: p.select("file", F.explode(what).alias("r")).select("file", "r.*")
    form = F.concat(F.when(F.col("is_static"), "static ").otherwise(""), F.when(F.col("is_wildcard"), "wildcard").otherwise("name"))
    call = F.concat_ws(" ", "receiver_kind", F.coalesce("receiver_hint", F.lit("-")), F.array_join("argument_hints", " "))
    parts = [
        of("imports").select("file", F.lit("import").alias("what"), F.col("imported_name").alias("owner"), form.alias("name"), F.lit(None).cast("string").alias("detail"), "line"),
        of("type_refs").select("file", F.col("edge_type").alias("what"), F.col("subtype").alias("owner"), F.col("supertype").alias("name"), F.lit(None).cast("string").alias("detail"), "line"),
        of("calls").select("file", F.lit("call").alias("what"), F.col("caller").alias("owner"), "name", F.rtrim(call).alias("detail"), "line"),
        of("type_uses").select("file", F.lit("use").alias("what"), F.col("caller").alias("owner"), F.col("type_name").alias("name"), F.col("context").alias("detail"), "line"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT file, file = 'park/Broken.java' AS has_error, 1::BIGINT AS top_level FROM (VALUES " + ", ".join(f"('{f}')" for f in fixture.FILES) + ") AS t(file)", False)
def java_parse_errors(spark, sf):
    return fixture.parsed(spark).select("file", "has_error", F.size("top_level_types").cast("long").alias("top_level"))


@query(
    values(
        "type from_name to_name confidence:DOUBLE",
        """
CALLS | park.Guide#tour(Lion,Radio) | park.Radio#hum() | 0.95
CALLS | park.Guide#tour(Lion,Radio) | zoo.Lion#eat(Food) | 0.95
CALLS | zoo.Base#name() | zoo.Base#label() | 0.95
CALLS | zoo.Lion#eat(Food) | zoo.Lion#feed(Feeder,Food) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | kitchen.Oven#heat(Food) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | kitchen.Tools#weigh(Food) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | park.Radio#hum() | 0.7
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Animal#legs() | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Base#name() | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Food,int) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Food,long) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Object) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(String) | 0.95
CALLS | zoo.Lion#feed(Feeder,Food) | zoo.Lion.Cub#<init>(int) | 0.95
CALLS | zoo.Lion.Cub#play() | zoo.Lion#eat(Food) | 0.95
EXTENDS | kitchen.Soup | kitchen.Food | 1.0
EXTENDS | zoo.Lion | zoo.Base | 1.0
EXTENDS | zoo.Lion.Cub | zoo.Lion | 1.0
IMPLEMENTS | zoo.Base | zoo.Animal | 1.0
IMPORTS | park.Guide | zoo.Lion | 1.0
IMPORTS | zoo.Lion | kitchen.Food | 1.0
IMPORTS | zoo.Lion | kitchen.Oven | 1.0
IMPORTS | zoo.Lion | kitchen.Tools | 1.0
REFERENCES | kitchen.Food#size(int,Map) | kitchen.Food | 0.95
REFERENCES | kitchen.Oven#heat(Food) | kitchen.Food | 0.95
REFERENCES | kitchen.Tools#weigh(Food) | kitchen.Food | 0.95
REFERENCES | park.Guide#tour(Lion,Radio) | park.Radio | 0.95
REFERENCES | park.Guide#tour(Lion,Radio) | zoo.Lion | 0.95
REFERENCES | zoo.Base#<init>(Feeder) | zoo.Feeder | 0.95
REFERENCES | zoo.Base#feeder | zoo.Feeder | 0.95
REFERENCES | zoo.Base#kin | zoo.Base | 0.95
REFERENCES | zoo.Feeder#serve(Food) | kitchen.Food | 0.95
REFERENCES | zoo.Feeder#serve(Food,int) | kitchen.Food | 0.95
REFERENCES | zoo.Feeder#serve(Food,long) | kitchen.Food | 0.95
REFERENCES | zoo.Lion#<init>(Feeder) | zoo.Feeder | 0.95
REFERENCES | zoo.Lion#eat(Food) | kitchen.Food | 0.95
REFERENCES | zoo.Lion#feed(Feeder,Food) | kitchen.Food | 0.95
REFERENCES | zoo.Lion#feed(Feeder,Food) | zoo.Feeder | 0.95
REFERENCES | zoo.Lion#feed(Feeder,Food) | zoo.Lion.Cub | 0.95
""",
    ),
    False,
)
def java_resolve(spark, sf):
    return _graph(spark)[2]["edge"].select("type", _name("from_id").alias("from_name"), _name("to_id").alias("to_name"), "confidence")


@query(
    values(
        "from_name to_name line:INTEGER",
        """
park.Guide#tour(Lion,Radio) | park.Radio#hum() | 8
park.Guide#tour(Lion,Radio) | zoo.Lion#eat(Food) | 7
zoo.Base#name() | zoo.Base#label() | 8
zoo.Lion#eat(Food) | zoo.Lion#feed(Feeder,Food) | 8
zoo.Lion#feed(Feeder,Food) | kitchen.Oven#heat(Food) | 19
zoo.Lion#feed(Feeder,Food) | kitchen.Tools#weigh(Food) | 18
zoo.Lion#feed(Feeder,Food) | park.Radio#hum() | 20
zoo.Lion#feed(Feeder,Food) | zoo.Animal#legs() | 17
zoo.Lion#feed(Feeder,Food) | zoo.Base#name() | 14
zoo.Lion#feed(Feeder,Food) | zoo.Base#name() | 16
zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Food,int) | 10
zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Food,long) | 11
zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Object) | 12
zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(String) | 14
zoo.Lion#feed(Feeder,Food) | zoo.Lion.Cub#<init>(int) | 22
zoo.Lion.Cub#play() | zoo.Lion#eat(Food) | 27
""",
    ),
    False,
)
def java_call_evidence(spark, sf):
    t = _graph(spark)[2]
    e = t["edge"].where("type = 'CALLS'").select(F.col("id").alias("edge_id"), _name("from_id").alias("from_name"), _name("to_id").alias("to_name"))
    return t["evidence"].join(e, "edge_id").select("from_name", "to_name", "line")


@query(
    values(
        "type from_name target_name candidates reason line:INTEGER site_count:INTEGER",
        """
CALLS | zoo.Lion#feed(Feeder,Food) | both | park.Horn#both() park.Radio#both() | ambiguous_global_fallback | 21 | 1
CALLS | zoo.Lion#feed(Feeder,Food) | serve | zoo.Feeder#serve(Food) zoo.Feeder#serve(Object) zoo.Feeder#serve(String) | ambiguous_owner_chain | 13 | 2
""",
    ),
    False,
)
def java_unresolved(spark, sf):
    u = _graph(spark)[2]["unresolved_reference"]
    return u.select("type", _name("from_id").alias("from_name"), "target_name", F.array_join(F.transform("candidates", _name), " ").alias("candidates"), "reason", "line", "site_count")


@query(
    values(
        "type ancestor dist:INTEGER",
        """
kitchen.Food | kitchen.Food | 0
kitchen.Soup | kitchen.Food | 1
kitchen.Soup | kitchen.Soup | 0
zoo.Animal | zoo.Animal | 0
zoo.Base | zoo.Animal | 1
zoo.Base | zoo.Base | 0
zoo.Lion | zoo.Animal | 2
zoo.Lion | zoo.Base | 1
zoo.Lion | zoo.Lion | 0
zoo.Lion.Cub | zoo.Animal | 3
zoo.Lion.Cub | zoo.Base | 2
zoo.Lion.Cub | zoo.Lion | 1
zoo.Lion.Cub | zoo.Lion.Cub | 0
""",
    ),
    False,
)
def java_supertypes(spark, sf):
    return graph.ancestors(_graph(spark)[2]["supertypes"])


@query(
    values(
        "qualified_name entry_point_kind",
        """
park.Guide | HTTP_CONTROLLER
park.Guide#tour(Lion,Radio) | HTTP_ROUTE
zoo.Base | CREATURE
""",
    ),
    False,
)
def java_entry_points(spark, sf):
    nodes = node_table(fixture.parsed(spark), "repo", suffixes={"Animal": "CREATURE"})
    return nodes.where("is_entry_point").select("qualified_name", "entry_point_kind")


_LOOKUPS = ["Lion#eat", "zoo.Lion#feed(zoo.Feeder, Food)", "serve(Food, int)", "Cub#<init>", "Base.name()", "Animal.legs", "Nobody#eat", "a bare question"]


@query(
    values(
        "query qualified_name",
        """
Lion#eat | zoo.Lion#eat(Food)
zoo.Lion#feed(zoo.Feeder, Food) | zoo.Lion#feed(Feeder,Food)
serve(Food, int) | zoo.Feeder#serve(Food,int)
Cub#<init> | zoo.Lion.Cub#<init>(int)
Base.name() | zoo.Base#name()
Animal.legs | zoo.Animal#legs()
""",
    ),
    False,
)
def java_lookup(spark, sf):
    nodes = Work(spark, "fixture").save(node_table(fixture.parsed(spark), "repo"), "nodes")
    return reduce(DataFrame.unionByName, (named_members(nodes, q).select(F.lit(q).alias("query"), "qualified_name") for q in _LOOKUPS))


@query(
    values(
        "qualified_name enclosing returns normal",
        """
zoo.Lion.Cub#play() | zoo.Lion.Cub zoo.Lion zoo | void | play()
zoo.Lion.Cub#<init>(int) | zoo.Lion.Cub zoo.Lion zoo | ~ | <init>(int)
kitchen.Food#size(int,Map) | kitchen.Food kitchen | int | size(int,Map)
zoo.Base#kin | zoo.Base zoo | ~ | kin
""",
    ),
    False,
)
def java_names(spark, sf):
    nodes = node_table(fixture.parsed(spark), "repo").where(F.col("qualified_name").rlike("Cub#|size|kin$"))
    q = F.col("qualified_name")
    enclosing = F.array_join(N.enclosing_types(N.owner_of(q)), " ")
    return nodes.select("qualified_name", enclosing.alias("enclosing"), N.return_type(F.col("signature")).alias("returns"), N.normal_signature(F.substring_index(q, "#", -1)).alias("normal"))


# Compiler overlay

_P = "semanticdb maven . . "
_SYMBOLS = [
    f"{_P}com/x/Outer#Inner#run(+1).", f"{_P}com/x/A#`<init>`().", f"{_P}com/x/A#", f"{_P}com/x/A#size.", f"{_P}com/x/A#f().(p)", "local 3", "nonsense", f"{_P}com/x/",
]


@query(
    values(
        "n:INTEGER owner member kind disambiguator skip_reason",
        """
0 | com.x.Outer.Inner | run | method | +1 | ~
1 | com.x.A | <init> | method |  | ~
2 | com.x.A | ~ | type | ~ | ~
3 | com.x.A | size | term | ~ | ~
4 | ~ | ~ | ~ | ~ | unsupported_descriptor
5 | ~ | ~ | ~ | ~ | local_symbol
6 | ~ | ~ | ~ | ~ | malformed_symbol
7 | com.x | ~ | type | ~ | ~
""",
    ),
    False,
)
def symbol_decode(spark, sf):
    rows = spark.createDataFrame(list(enumerate(_SYMBOLS)), "n int, symbol string")
    return rows.join(parse_symbols(rows), "symbol").select("n", "owner", "member", "kind", "disambiguator", "skip_reason")


def _occurrences(spark) -> DataFrame:
    """What a compiler would say of a few places: (document, n, begin, symbol, scope of a definition)."""
    food, lion, feeder = "kitchen/Food#", "zoo/Lion#", "zoo/Feeder#"
    rows = [
        ("zoo/Lion.java", 0, [4, 13], lion, [4, 0, 28, 1]), ("zoo/Lion.java", 1, [4, 26], "zoo/Base#", None), ("zoo/Lion.java", 2, [8, 7], f"{lion}feed().", [8, 2, 23, 3]),
        ("zoo/Lion.java", 3, [12, 11], f"{feeder}serve(+4).", None), ("zoo/Lion.java", 4, [12, 11], f"{feeder}serve(Ljava/lang/Object;).", None), ("zoo/Lion.java", 5, [9, 11], f"{feeder}serve(Lkitchen/Food;I).", None),
        ("zoo/Lion.java", 6, [8, 27], food, None), ("zoo/Lion.java", 7, [9, 4], "local 1", None), ("zoo/Lion.java", 8, [24, 15], f"{lion}Cub#", [24, 2, 27, 3]), ("zoo/Lion.java", 9, [26, 9], f"{lion}Cub#play().", [26, 4, 26, 35]),
        ("zoo/Lion.java", 10, [26, 23], f"{lion}eat().", None), ("zoo/Lion.java", 11, [0, 0], food, None), ("zoo/Lion.java", 12, [14, 9], "zoo/Nowhere#", None),
    ]
    rows = [(d, n, *at, s if s.startswith("local") else _P + s, scope is not None, scope and scope[:2], scope and scope[2:]) for d, n, at, s, scope in rows]
    return spark.createDataFrame(rows, "document string, n int, begin_line int, begin_col int, symbol string, is_definition boolean, scope_begin array<int>, scope_end array<int>")


@query(
    values(
        "type from_name to_name confidence:DOUBLE provenance line:INTEGER",
        """
CALLS_TYPED | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Food,int) | 0.95 | java_parser+scip_java | 10
CALLS_TYPED | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Object) | 0.95 | java_parser+scip_java | 12
CALLS_TYPED | zoo.Lion#feed(Feeder,Food) | zoo.Feeder#serve(Object) | 0.95 | java_parser+scip_java | 13
CALLS_TYPED | zoo.Lion.Cub#play() | zoo.Lion#eat(Food) | 0.95 | java_parser+scip_java | 27
EXTENDS_TYPED | zoo.Lion | zoo.Base | 1.0 | java_parser+scip_java | 5
REFERENCES_TYPED | zoo.Lion#feed(Feeder,Food) | kitchen.Food | 0.95 | java_parser+scip_java | 9
""",
    ),
    False,
)
def scip_overlay(spark, sf):
    _, nodes, t = _graph(spark)
    found = overlay.typed_layer(_occurrences(spark), nodes, Work(spark, "layer"))
    edges, proof = overlay.merged_tables(t["edge"], t["evidence"], found["pairs"])
    e = edges.where(F.col("type").endswith("_TYPED")).select(F.col("id").alias("edge_id"), "type", _name("from_id").alias("from_name"), _name("to_id").alias("to_name"), "confidence", "provenance")
    return e.join(proof.select("edge_id", "line"), "edge_id").drop("edge_id")


@query(
    values(
        "reason n:BIGINT",
        """
ambiguous_overload_unaligned | 1
local_symbol | 1
owner_not_found | 1
""",
    ),
    False,
)
def scip_skip_reasons(spark, sf):
    found = overlay.typed_layer(_occurrences(spark), node_table(fixture.parsed(spark), "repo"), Work(spark, "layer"))
    return overlay.skip_reasons(found["refs"], found["mapped"])
