"""Registered relational queries: each runs a library operator over the given tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import closure, diff, gate, joins, merge, rules

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registered(sql: str):
    """Adds a query over ``Tables`` and the SQL beside it."""

    def add(query):
        _QUERIES[query.__name__] = lambda spark, folder: query(Tables(spark, folder))
        _SQL[query.__name__] = sql
        return query

    return add


@registered("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def scan_content_hash(t):
    return t("documents").select("doc_id", T.content_hash("text").alias("content_hash"))


_LINES = """
    SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS part, len(parts) AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)"""
_LINE_ROWS = f"""
    SELECT doc_id, line, CASE WHEN line < n THEN part || chr(10) ELSE part END AS body FROM ({_LINES})
    WHERE line < n OR part <> ''"""


@registered(f"""
    SELECT doc_id, CAST(line AS INTEGER) AS line,
           CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_from,
           CAST(strlen(body) AS BIGINT) AS n_bytes, CAST(length(body) AS BIGINT) AS n_chars
    FROM ({_LINE_ROWS})""")
def line_table(t):
    return T.line_table(t("documents"), "doc_id", "text")


@registered("""
    SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
           CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS end_line,
           CAST(length(string_split(text, chr(10))[-1]) + 1 AS INTEGER) AS end_col
    FROM documents WHERE text <> ''""")
def span_bytes(t):
    span = T.whole_span("text")
    return t("documents").where("text <> ''").select("doc_id", span["n_bytes"].alias("n_bytes"), span["end_line"].alias("end_line"), span["end_col"].alias("end_col"))


@registered("""
    SELECT doc_id, string_split(text, chr(10))[1] AS first_line FROM documents WHERE text <> ''""")
def body_slice(t):
    ends = F.octet_length(F.substring_index("text", "\n", 1))
    return t("documents").where("text <> ''").select("doc_id", T.slice_bytes("text", F.lit(0), ends).alias("first_line"))


@registered("SELECT p_partkey, (p_type LIKE '%BRASS%' OR p_type LIKE '%STEEL%' OR p_name LIKE '%green%') AS hit FROM part")
def rule_contains_any(t):
    hit = rules.contains_any(F.col("p_type"), ["BRASS", "STEEL"]) | rules.contains_any(F.col("p_name"), ["green"])
    return t("part").select("p_partkey", hit.alias("hit"))


@registered("SELECT page_id, ends_with(url, '0') AS round, starts_with(url, 'https') AS secure FROM pages")
def rule_endswith(t):
    return t("pages").select("page_id", F.col("url").endswith("0").alias("round"), F.col("url").startswith("https").alias("secure"))


@registered("""
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'WRITE' WHEN event_type LIKE '%c%' THEN 'NAMED' WHEN value > 50 THEN 'READ' END AS kind FROM events""")
def rule_priority(t):
    kind = rules.first_match([(F.col("event_type") == "purchase", "WRITE"), (F.col("event_type").contains("c"), "NAMED"), (F.col("value") > 50, "READ")])
    return t("events").select("event_id", kind.alias("kind"))


@registered("""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'DELETE' WHEN l_returnflag = 'A' THEN 'UPDATE' ELSE 'READ' END AS op
    FROM lineitem""")
def crud_rules(t):
    rows = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "a.TypedQuery").otherwise("a.EntityManager").alias("receiver_type"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "remove")
        .when(F.col("l_returnflag") == "A", "merge")
        .when(F.col("l_returnflag") == "N", "getResultList")
        .otherwise("find")
        .alias("method_name"),
    )
    return rows.select("l_orderkey", "l_linenumber", rules.crud_operation().alias("op"))


@registered("SELECT DISTINCT event_type, upper(regexp_replace('on' || upper(event_type[1]) || event_type[2:], '([a-z])([A-Z]+)', '\\1_\\2', 'g')) AS snake FROM events")
def camel_to_snake(t):
    name = F.concat(F.lit("on"), F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"))
    return t("events").select("event_type", T.upper_snake(name).alias("snake")).distinct()


@registered("SELECT url, regexp_extract(url, '[^/]*$') AS simple, array_to_string(string_split(url, '.')[1:-2], '.') AS package FROM (SELECT DISTINCT url FROM pages)")
def name_parts(t):
    return t("pages").select("url").distinct().select("url", F.substring_index("url", "/", -1).alias("simple"), T.package_of("url").alias("package"))


@registered("""
    SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\\bthe\\b')) + 2 * len(regexp_extract_all(text, '\\band\\b')) AS BIGINT) AS complexity FROM documents""")
def weighted_branch_count(t):
    count = lambda word: F.regexp_count("text", F.lit(rf"\b{word}\b"))
    return t("documents").select("doc_id", (1 + count("the") + 2 * count("and")).cast("long").alias("complexity"))


_NODES = """
    SELECT 'Region' AS label, 'r' || r_regionkey AS key, r_name AS name, NULL AS unit FROM region
    UNION ALL SELECT 'Nation', 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'Customer', 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 'Supplier', 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'Order', 'o' || o_orderkey, o_orderstatus, 'c' || o_custkey FROM orders"""
_EDGES = """
    SELECT 'HAS_NATION' AS type, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'HAS_CUSTOMER', 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'HAS_SUPPLIER', 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    UNION ALL SELECT 'HAS_ORDER', 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _nodes(t) -> DataFrame:
    parts = [
        t("region").select(F.lit("Region").alias("label"), _key("r", "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("unit")),
        t("nation").select(F.lit("Nation").alias("label"), _key("n", "n_nationkey").alias("key"), F.col("n_name").alias("name"), _key("r", "n_regionkey").alias("unit")),
        t("customer").select(F.lit("Customer").alias("label"), _key("c", "c_custkey").alias("key"), F.col("c_name").alias("name"), _key("n", "c_nationkey").alias("unit")),
        t("supplier").select(F.lit("Supplier").alias("label"), _key("s", "s_suppkey").alias("key"), F.col("s_name").alias("name"), _key("n", "s_nationkey").alias("unit")),
        t("orders").select(F.lit("Order").alias("label"), _key("o", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("name"), _key("c", "o_custkey").alias("unit")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _edges(t) -> DataFrame:
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    out = edge(t("nation"), "HAS_NATION", _key("r", "n_regionkey"), _key("n", "n_nationkey"))
    out = out.unionByName(edge(t("customer"), "HAS_CUSTOMER", _key("n", "c_nationkey"), _key("c", "c_custkey")))
    out = out.unionByName(edge(t("supplier"), "HAS_SUPPLIER", _key("n", "s_nationkey"), _key("s", "s_suppkey")))
    return out.unionByName(edge(t("orders"), "HAS_ORDER", _key("c", "o_custkey"), _key("o", "o_orderkey")))


@registered(_NODES)
def project_nodes(t):
    return _nodes(t)


@registered(_EDGES)
def project_edges(t):
    return _edges(t)


@registered("""
    SELECT c_custkey, arg_max(c_name, seq) FILTER (c_name IS NOT NULL) AS c_name,
           arg_max(c_mktsegment, seq) FILTER (c_mktsegment IS NOT NULL) AS c_mktsegment
    FROM (SELECT c_custkey, c_name, c_mktsegment, 1 AS seq FROM customer
          UNION ALL SELECT c_custkey, NULL, lower(c_mktsegment), 2 FROM customer WHERE c_custkey % 3 = 0
          UNION ALL SELECT c_custkey, upper(c_name), NULL, 3 FROM customer WHERE c_custkey % 5 = 0)
    GROUP BY c_custkey""")
def merge_nodes_last_wins(t):
    base = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    none = F.lit(None).cast("string")
    later = base.where("c_custkey % 3 = 0").select("c_custkey", none.alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment"), F.lit(2).alias("seq"))
    last = base.where("c_custkey % 5 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), none.alias("c_mktsegment"), F.lit(3).alias("seq"))
    return merge.merge_nodes(base.withColumn("seq", F.lit(1)).unionByName(later).unionByName(last), ["c_custkey"], "seq")


@registered("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Symbol|Customer|Marked' ELSE 'Symbol|Customer' END AS labels FROM customer""")
def union_labels(t):
    base = t("customer").select("c_custkey", F.lit(1).alias("seq"), F.array(F.lit("Symbol"), F.lit("Customer")).alias("labels"))
    more = base.where("c_custkey % 2 = 0").select("c_custkey", F.lit(2).alias("seq"), F.array(F.lit("Marked"), F.lit("Symbol")).alias("labels"))
    merged = merge.merge_nodes(base.unionByName(more), ["c_custkey"], "seq", labels="labels")
    return merged.select("c_custkey", F.array_join("labels", "|").alias("labels"))


@registered("""
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_edges_last_wins(t):
    seq = F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("seq")
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", seq)
    return merge.dedupe_edges(rows, ["l_orderkey", "l_partkey"], "seq").drop("seq")


@registered("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def keyed_first_wins(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("seq"))
    return merge.first_wins(rows, ["l_orderkey"], "seq").drop("seq")


_PAIRS = """SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"""


def _pairs(t) -> DataFrame:
    from pyspark.sql import Window

    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select(F.col("event_type").alias("src"), following.alias("dst")).where("dst is not null")


@registered(f"SELECT src, dst, count(*) AS weight FROM ({_PAIRS}) WHERE dst IS NOT NULL GROUP BY src, dst")
def call_edges_weighted(t):
    return merge.weighted_edges(_pairs(t), drop_self=False)


@registered(f"SELECT src, dst, count(*) AS weight FROM ({_PAIRS}) WHERE src <> dst GROUP BY src, dst")
def drop_self_edges(t):
    return merge.weighted_edges(_pairs(t))


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def gate_semi(t):
    edges = t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return gate.gate_edges(edges, t("customer").where("c_acctbal > 0"), "c_custkey").select(F.col("src").alias("o_orderkey"), F.col("dst").alias("o_custkey"))


@registered("""
    SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def gate_both_ends(t):
    edges = t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    nodes = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    edges = gate.gate_edges(edges, nodes, "key", mode="source")
    return gate.gate_edges(edges, t("part").where("p_size > 25").select(F.col("p_partkey").alias("key")), "key", mode="target")


@registered("""
    SELECT n_nationkey AS src, n_regionkey AS dst, n_name AS from_name, r_name AS to_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT n_nationkey FROM nation)""")
def attach_ends(t):
    nations = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    regions = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    edges = t("nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    keyed = lambda frame, kind: frame.select(F.struct(F.lit(kind).alias("kind"), "key").alias("key"), "name")
    marked = edges.select(*[F.struct(F.lit(k).alias("kind"), F.col(end).alias("key")).alias(end) for end, k in (("src", "nation"), ("dst", "region"))])
    found = gate.attach_ends(marked, keyed(nations, "nation").unionByName(keyed(regions, "region")), "key", ["name"])
    return found.select(F.col("src.key").alias("src"), F.col("dst.key").alias("dst"), "from_name", "to_name")


@registered("""
    WITH s AS (SELECT p_partkey AS site, p_brand AS owner, p_size AS name, string_split(p_name, ' ') AS params FROM part),
         d AS (SELECT min(p_partkey) AS id, p_brand AS owner, p_size AS name, list_transform(string_split(p_name, ' '), lambda x: right(x, 2)) AS params
               FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL)
    SELECT s.site, min(d.id) AS declared_id FROM s LEFT JOIN d
      ON s.owner = d.owner AND s.name = d.name AND len(s.params) = len(d.params)
     AND len(list_filter(list_zip(s.params, d.params), lambda x: NOT (ends_with(x[1], x[2]) OR ends_with(x[2], x[1])))) = 0
    GROUP BY s.site""")
def fuzzy_signature_join(t):
    sites = t("part").select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("owner"), F.col("p_size").alias("name"), F.split("p_name", " ").alias("params"))
    declared = sites.where("site % 4 = 0").withColumn("params", F.transform("params", lambda x: F.right(x, F.lit(2))))
    declared = declared.groupBy("owner", "name", "params").agg(F.min("site").alias("declared_id"))
    return joins.fuzzy_signature_join(sites, declared, "site").select("site", "declared_id")


_OLD = "SELECT o_orderkey, sha256(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 7 <> 0"
_NEW = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN sha256('x' || o_orderpriority)
          ELSE sha256(o_orderstatus || o_orderpriority) END AS h FROM orders WHERE o_orderkey % 13 <> 0"""


def _versions(t) -> tuple[DataFrame, DataFrame]:
    plain = T.content_hash(F.concat("o_orderstatus", "o_orderpriority"))
    old = t("orders").where("o_orderkey % 7 <> 0").select("o_orderkey", plain.alias("h"))
    fresh = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 0, T.content_hash(F.concat(F.lit("x"), "o_orderpriority"))).otherwise(plain)
    return old, t("orders").where("o_orderkey % 13 <> 0").select("o_orderkey", fresh.alias("h"))


@registered(f"""
    SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.h IS NULL OR n.h IS DISTINCT FROM o.h THEN 'changed' ELSE 'same' END AS status
    FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.o_orderkey = o.o_orderkey""")
def hash_diff_changed(t):
    old, new = _versions(t)
    return diff.hash_diff(new, old, "o_orderkey", "h")


@registered(f"SELECT o_orderkey FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}))")
def vanished_anti(t):
    old, new = _versions(t)
    return diff.vanished(new, old, "o_orderkey")


@registered(f"""
    SELECT o_orderkey, h, false AS is_modified FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}) WHERE o_orderkey % 2 = 0)
    UNION ALL SELECT o_orderkey, h, true FROM ({_NEW}) WHERE o_orderkey % 2 = 0""")
def overlay_upsert(t):
    old, new = _versions(t)
    return diff.overlay(old, new.where("o_orderkey % 2 = 0"), "o_orderkey")


@registered("""
    WITH u AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_custkey % 4 = 0),
         gone AS (SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_custkey % 9 = 1),
         oldn AS (SELECT o_orderkey AS key, o_custkey AS unit, o_orderstatus AS name FROM orders),
         newn AS (SELECT o_orderkey AS key, o_custkey AS unit, lower(o_orderstatus) AS name FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 9 <> 1),
         touched AS (SELECT unit FROM u UNION SELECT unit FROM oldn WHERE unit NOT IN (SELECT unit FROM newn))
    SELECT key, unit, name FROM oldn WHERE unit NOT IN (SELECT unit FROM touched)
    UNION ALL SELECT key, unit, name FROM newn WHERE unit IN (SELECT unit FROM touched)""")
def incremental_replace_unit(t):
    old = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("name"))
    new = old.where("key % 3 <> 0 and unit % 9 <> 1").withColumn("name", F.lower("name"))
    edges = old.limit(0).select(F.lit("E").alias("type"), F.col("key").alias("src"), F.col("key").alias("dst"), "unit")
    changed = old.where("unit % 4 = 0").select("unit").distinct()
    return diff.replace_units(old, edges, new, edges, changed)[0]


@registered(f"""
    WITH RECURSIVE e AS ({_EDGES}), w(ancestor, descendant, depth) AS (
        SELECT src, dst, 1 FROM e UNION ALL SELECT w.ancestor, e.dst, w.depth + 1 FROM w JOIN e ON w.descendant = e.src)
    SELECT ancestor, descendant, depth FROM w""")
def containment_closure(t):
    return closure.closure(_edges(t), "src", "dst")


@registered("""
    WITH RECURSIVE e AS (SELECT s_suppkey AS c, s_suppkey // 3 AS p FROM supplier WHERE s_suppkey > 0), w(ancestor, descendant, depth) AS (
        SELECT p, c, 1 FROM e UNION ALL SELECT e.p, w.descendant, w.depth + 1 FROM w JOIN e ON w.ancestor = e.c)
    SELECT ancestor, descendant, depth FROM w""")
def ancestor_closure(t):
    edges = t("supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("c"), F.expr("s_suppkey div 3").alias("p"))
    return closure.closure(edges, "p", "c")


@registered("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal FROM lineitem")
def ordinal_within_owner(t):
    return merge.number_within(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@registered("""
    SELECT label, key, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY key) - 1) / 500) AS BIGINT) AS batch
    FROM (SELECT c_mktsegment AS label, c_custkey AS key FROM customer)""")
def batch_chunks(t):
    return merge.in_batches(t("customer").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("key")), ["label"], ["key"])


@registered("""
    SELECT o_custkey AS owner, CAST(o_orderkey AS VARCHAR) AS member FROM orders
    UNION ALL SELECT c_custkey, '<init>()' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def implicit_member_synthesis(t):
    owners = t("customer").select(F.col("c_custkey").alias("owner"))
    members = t("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("string").alias("member"))
    return merge.implicit_members(owners, members, "owner", {"member": F.lit("<init>()")})


@registered("""
    SELECT p_partkey, '{"name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"brand":"' || p_brand || '"' ELSE '' END || '}' AS props FROM part""")
def prune_nulls_json(t):
    return t("part").select("p_partkey", T.pruned_json(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand")).alias("props"))


@registered("""
    SELECT p_partkey, '{"name":"' || p_name || '","brand":' || CASE WHEN p_size > 25 THEN '"' || p_brand || '"' ELSE 'null' END || '}' AS props FROM part""")
def props_map_json(t):
    return t("part").select("p_partkey", T.full_json(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand")).alias("props"))


@registered("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS joined FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def docstring_join(t):
    return merge.joined_text(t("conversations").where("text is not null"), ["conv_id"], "turn", "text")


@registered("""
    SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY p_brand) AS brands
    FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey""")
def refs_sorted_set(t):
    rows = t("lineitem").select("l_suppkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return merge.sorted_set(rows, ["l_suppkey"], "p_brand", "brands").select("l_suppkey", F.array_join("brands", ",").alias("brands"))


@registered("SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_assert(t):
    return merge.duplicate_keys(t("lineitem"), ["l_orderkey", "l_suppkey"])


@registered("""
    SELECT doc_id, '''' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '''', chr(92) || ''''), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '''' AS literal
    FROM documents""")
def cypher_literal(t):
    return t("documents").select("doc_id", T.cypher_string("text").alias("literal"))


@registered("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_json_member(t):
    return t("events").select("event_id", T.json_member("props", "k").alias("k"))


@registered(f"SELECT label, count(*) AS nodes, count(DISTINCT unit) AS units FROM ({_NODES}) GROUP BY label")
def label_counts(t):
    return _nodes(t).groupBy("label").agg(F.count("*").alias("nodes"), F.countDistinct("unit").alias("units"))


@registered("""
    WITH sub AS (SELECT DISTINCT n_regionkey AS ancestor, n_nationkey + 100 AS descendant, 1 AS depth FROM nation
                 UNION ALL SELECT r_regionkey, r_regionkey, 0 FROM region UNION ALL SELECT n_nationkey + 100, n_nationkey + 100, 0 FROM nation),
         live AS (SELECT DISTINCT ancestor AS receiver, descendant AS runtime FROM sub WHERE descendant IN (SELECT DISTINCT c_nationkey + 100 FROM customer WHERE c_acctbal > 0)),
         decl AS (SELECT s_suppkey AS callable_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 5 ELSE s_nationkey + 100 END AS owner, s_suppkey % 10 AS signature FROM supplier),
         near AS (SELECT s.descendant AS runtime, d.signature, arg_min(d.callable_id, (s.depth, d.callable_id)) AS callee FROM sub s JOIN decl d ON s.ancestor = d.owner GROUP BY ALL),
         site AS (SELECT o_orderkey AS site, o_custkey AS caller, o_orderkey % 5 AS receiver, o_orderkey % 10 AS signature FROM orders)
    SELECT DISTINCT site.caller, near.callee, site.site FROM site JOIN live USING (receiver) JOIN near ON near.runtime = live.runtime AND near.signature = site.signature""")
def rta_targets(t):
    regions = t("region").select(F.col("r_regionkey").alias("ancestor"), F.col("r_regionkey").alias("descendant"), F.lit(0).alias("depth"))
    nation = F.col("n_nationkey") + 100
    own = t("nation").select(nation.alias("ancestor"), nation.alias("descendant"), F.lit(0).alias("depth"))
    subtypes = t("nation").select(F.col("n_regionkey").alias("ancestor"), nation.alias("descendant"), F.lit(1).alias("depth")).distinct().unionByName(regions).unionByName(own)
    created = t("customer").where("c_acctbal > 0").select((F.col("c_nationkey") + 100).alias("type"))
    owner = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") % 5).otherwise(F.col("s_nationkey") + 100)
    declared = t("supplier").select(F.col("s_suppkey").alias("callable_id"), owner.alias("owner"), (F.col("s_suppkey") % 10).alias("signature"))
    sites = t("orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 5).alias("receiver"), (F.col("o_orderkey") % 10).alias("signature"))
    return joins.virtual_targets(sites, subtypes, created, declared)


def _java_sources(t) -> DataFrame:
    """A class for each nation with a method for each customer; each method calls the next one's."""
    from pyspark.sql import Window

    rows = t("customer").join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("next", F.lead("c_custkey").over(Window.partitionBy("n_nationkey").orderBy("c_custkey")))
    mark = F.when(F.col("c_acctbal") > 0, F.format_string('@GetMapping("/%d") ', "c_custkey")).otherwise("")
    call = F.when(F.col("next").isNotNull(), F.format_string("if (n > 0) { c%d(n - 1); }", "next")).otherwise("")
    method = F.concat(F.lit("  "), mark, F.format_string("void c%d(int n) { ", "c_custkey"), call, F.lit(" } // done\n"))
    body = rows.groupBy("n_regionkey", "n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", method.alias("m")))), lambda x: x["m"]), "").alias("body"))
    source = F.concat(F.format_string("package r%d;\nclass N%d extends Base {\n", "n_regionkey", "n_nationkey"), "body", F.lit("}\n"))
    return body.select(F.lit("app").alias("app"), F.format_string("r%d/N%d.java", "n_regionkey", "n_nationkey").alias("file_key"), source.alias("source"))


@registered("""
    SELECT 'r' || n_regionkey || '.N' || n_nationkey AS type_id, count(*) + 1 AS n_callables, count(*) FILTER (c_acctbal > 0) AS n_entrypoints,
           count(*) - 1 AS n_calls, 2 * count(*) AS complexity
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def java_entrypoints(t):
    from ..sources import java_source
    from .analyze import analyze

    found = analyze(java_source.from_rows(_java_sources(t)))
    callables = found.callables.groupBy("type_id").agg(
        F.count("*").alias("n_callables"), F.count(F.when(F.col("is_entrypoint"), 1)).alias("n_entrypoints"), F.sum("cyclomatic").cast("long").alias("complexity")
    )
    calls = found.call_edges.groupBy(F.substring_index("src", "#", 1).alias("type_id")).agg(F.count("*").alias("n_calls"))
    return callables.join(calls, "type_id").select("type_id", "n_callables", "n_entrypoints", "n_calls", "complexity")


@registered("""
    SELECT 'r' || n_regionkey || '/N' || n_nationkey || '.java' AS file_key, CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS digits, count(*) AS comments
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def java_tokens(t):
    from ..sources import java_source

    tokens = java_source.tokens(java_source.from_rows(_java_sources(t)))
    declared = F.when((F.col("kind") == "word") & F.col("text").rlike("^c[0-9]+$") & (F.lag("text").over(_token_order()) == "void"), F.length("text") - 1)
    rows = tokens.withColumn("digits", declared)
    return rows.groupBy("file_key").agg(F.sum("digits").cast("long").alias("digits"), F.count(F.when(F.col("kind") == "comment", 1)).alias("comments"))


def _token_order():
    from pyspark.sql import Window

    return Window.partitionBy("file_key").orderBy("n")


def queries() -> dict[str, Query]:
    from . import flow_twins, project_twins, varied_twins  # noqa: F401  (they register their queries here)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import flow_twins, project_twins, varied_twins  # noqa: F401

    return dict(_SQL)
