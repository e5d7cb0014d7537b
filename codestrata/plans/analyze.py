"""From files to symbol tables, facts, a call graph and a property graph, all as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cypher_list, cypher_string, durable_id
from ..operators import closure, gate, intervals, joins, merge, resolution, rules
from ..session import checkpointed
from ..sources import java_source as J
from . import typing


@dataclass
class Analysis:
    files: DataFrame
    packages: DataFrame
    imports: DataFrame
    comments: DataFrame
    types: DataFrame
    supertypes: DataFrame
    callables: DataFrame
    variables: DataFrame
    call_sites: DataFrame
    call_edges: DataFrame
    arguments: DataFrame
    enum_constants: DataFrame
    record_components: DataFrame
    references: DataFrame
    # What other files resolve their names by, and the words of each file.
    headers: DataFrame
    methods: DataFrame
    field_types: DataFrame
    above: DataFrame
    words: DataFrame


def analyze(files: DataFrame, compat: bool = False, context: Analysis | None = None) -> Analysis:
    """All tables of a project. ``compat`` keeps rules as literal as they are, quirks included.

    Tokens are computed once and checkpointed; every later table is a join on
    ``(file_key, brace)`` or on names.

    With ``context``, the tables of other files of the project, only ``files`` are
    read and all tables but ``above`` are theirs alone; names are looked up in both.
    ``call_edges`` are then empty, as they depend on all calls: see ``call_edges``.
    """
    whole = lambda own, other: own if context is None else checkpointed(own.unionByName(getattr(context, other)))
    mine = lambda rows: rows if context is None else rows.join(files.select("file_key"), "file_key", "left_semi")
    all_tokens = checkpointed(J.tokens(files))
    code = checkpointed(J.enclosed(all_tokens))
    parts = checkpointed(J.segments(code))
    scope = checkpointed(J.scopes(code, parts))
    package, imported = checkpointed(J.packages(parts)), checkpointed(J.imports(parts))
    headers = checkpointed(J.types(scope, package))

    every_type, supers, known = supertypes(whole(headers, "headers"), whole(imported, "imports"), whole(package, "packages"))
    typed, supers = mine(every_type), mine(supers)

    found = J.with_implicit_constructors(J.callables(scope, typed, parts), typed)
    found = found.join(J.complexity(code, scope).withColumnRenamed("in_callable", "open"), ["file_key", "open"], "left").withColumn("cyclomatic", F.coalesce("cyclomatic", F.lit(1)))
    found = found.withColumn("callable_id", F.concat_ws("#", "type_id", "signature"))
    typed, found = rules.mark_entrypoints(typed, found)
    # The body of a callable as it stands in the source, and the line of its brace; none of an abstract or implicit one.
    bodies = found.where("open is not null").select("file_key", F.col("open").cast("long").alias("begin_n"), F.col("last").cast("long").alias("close_n"), F.col("open").cast("long").alias("id"))
    lines = code.select("file_key", F.col("n").cast("long").alias("id"), F.col("line").cast("int").alias("code_start_line"))
    bodies = J.source_texts(files, code, bodies, "code").join(lines, ["file_key", "id"]).withColumnRenamed("id", "open")
    found = J.byte_spans(found.withColumn("open", F.col("open").cast("long")).join(bodies, ["file_key", "open"], "left"), code)
    found = found.withColumns({"code": F.coalesce("code", F.lit("")), "code_start_line": F.coalesce("code_start_line", F.lit(-1))})
    # An anonymous class is its body: what is before the brace belongs to the callable that creates it.
    unnamed = F.col("name").startswith("$anon$") | F.col("name").startswith("$enum$")
    typed = J.byte_spans(typed.withColumn("from_n", F.when(unnamed, F.col("scope")).otherwise(F.col("first"))), code, "from_n").drop("from_n")
    typed, found = checkpointed(typed), checkpointed(found)

    declared = J.variables(scope, parts, code)
    inside = typed.select("file_key", F.col("scope").alias("in_type"), "type_id")
    own = found.where("open is not null").select("file_key", F.col("open").alias("in_callable"), "callable_id")
    declared = checkpointed(declared.join(inside, ["file_key", "in_type"], "left").join(own, ["file_key", "in_callable"], "left"))

    sites = checkpointed(J.call_sites(code, scope).join(inside, ["file_key", "in_type"]).join(own, ["file_key", "in_callable"], "left"))
    local = declared.where("owner = 'local' and callable_id is not null").select("callable_id", F.col("name").alias("receiver"), F.col("type").alias("by_local"))
    params = found.select("callable_id", F.explode("parameters").alias("p")).select("callable_id", F.col("p.name").alias("receiver"), F.col("p.type").alias("by_local"))
    local = merge.first_wins(local.unionByName(params), ["callable_id", "receiver"], "by_local")
    field = declared.where("owner = 'field'").groupBy("type_id", F.col("name").alias("receiver")).agg(F.min("type").alias("by_field"))
    walked = checkpointed(J.call_arguments(code, sites, declared))
    calls = walked.where("not is_value").drop("is_value")
    values = walked.where("is_value").select("file_key", F.col("open_n").alias("equals_n"), "begin_n", "close_n")
    texts = J.source_texts(files, code, values.withColumnRenamed("equals_n", "id"), "initializer").withColumnRenamed("id", "equals_n")
    declared = checkpointed(declared.join(texts, ["file_key", "equals_n"], "left"))
    scopes = typing.Scopes(code, parts, scope, typed, supers, known, found, declared, sites, calls, values, context)
    facts, given = typing.typed_sites(scopes, code, sites, calls)
    access = F.coalesce(*[F.when(F.array_contains("modifiers", m), m) for m in ("public", "protected", "private")], F.lit("package_private"))
    about = scopes.methods.select(F.col("callable_id").alias("callee_id"), access.alias("accessibility"), F.array_contains("modifiers", "static").alias("callee_static"))
    sites = sites.join(facts, ["file_key", "open_n"], "left").join(calls.select("file_key", "open_n", "begin_n", "close_n", "argument_expr", "argument_ids"), ["file_key", "open_n"], "left").join(about, "callee_id", "left")
    none = F.array().cast("array<string>")
    static = ~F.col("is_constructor_call") & (F.coalesce("static", F.lit(False)) | F.coalesce("callee_static", F.lit(False)))
    sites = sites.select(
        "file_key", "type_id", "callable_id", "method_name", "receiver", "receiver_type", "is_constructor_call", static.alias("is_static_call"), "local_id", "line", "col", "open_n",
        F.coalesce("argument_expr", none).alias("argument_expr"), F.coalesce("argument_ids", none).alias("argument_ids"), "return_type", "callee_id", "accessibility", F.coalesce("begin_n", "open_n").alias("begin_n"), "close_n",
    )
    sites = J.byte_spans(sites, code, "begin_n", "close_n").drop("begin_n", "close_n")
    sites = checkpointed(sites.withColumns({"crud_operation": rules.crud_operation(compat=compat), "crud_query": rules.crud_query(compat=compat)}))
    arguments = argument_rows(sites, local, field, given)
    erased = F.concat("name", F.lit("("), F.array_join("wanted", ", "), F.lit(")"))
    found = found.join(scopes.methods.select("callable_id", erased.alias("erased_signature"), F.col("returns").alias("erased_return")), "callable_id", "left")

    edges = call_edges(sites, typed, known.above, found)
    if context is not None:
        edges = edges.limit(0)
    components = J.record_defaults(J.record_components(typed), scope, parts, typed)
    # What a callable refers to: types of its variables and creations, and fields of its type.
    named = declared.where("callable_id is not null").select("file_key", "callable_id", F.col("type").alias("spelling"))
    named = named.join(J.resolved(named, every_type, imported, package), ["file_key", "spelling"]).select("callable_id", F.lit("type").alias("kind"), F.col("resolved").alias("target"))
    made = sites.where("is_constructor_call and callable_id is not null").select("callable_id", F.lit("type").alias("kind"), F.col("receiver_type").alias("target"))
    used = J.accessed_fields(code, scope, declared).join(own, ["file_key", "in_callable"]).select("callable_id", F.lit("field").alias("kind"), F.col("field_id").alias("target"))
    raised = J.thrown(code, scope).join(own, ["file_key", "in_callable"]).join(local.withColumnRenamed("receiver", "name"), ["callable_id", "name"], "left")
    raised = raised.withColumn("spelling", F.coalesce("created_type", "by_local")).where("spelling is not null")
    raised = raised.join(J.resolved(raised, every_type, imported, package), ["file_key", "spelling"]).groupBy("callable_id").agg(F.sort_array(F.collect_set("resolved")).alias("raised"))
    found = checkpointed(found.join(raised, "callable_id", "left").withColumn("raised", F.coalesce("raised", none)))
    seen = J.tested_types(parts, scope).join(own, ["file_key", "in_callable"])
    seen = seen.join(J.resolved(seen, every_type, imported, package), ["file_key", "spelling"]).select("callable_id", F.lit("type").alias("kind"), F.col("resolved").alias("target"))
    references = named.unionByName(seen).unionByName(made).unionByName(used).where("target is not null").distinct()
    noted = owned_comments(J.comments(all_tokens), typed, found, declared)
    return Analysis(
        files, package, imported, noted, typed, supers, found, declared, sites, edges, arguments, J.enum_constants(scope, parts, typed), components, references,
        headers, scopes.own_methods, scopes.own_fields, known.above, all_tokens.where("kind = 'word'").select("file_key", F.col("text").alias("word")).distinct(),
    )


def supertypes(typed: DataFrame, imported: DataFrame, package: DataFrame) -> tuple[DataFrame, DataFrame, resolution.Names]:
    """``typed`` with ``ancestors``, the supertype table and what names mean.

    Headers are resolved in the types around them, first without and then with the
    member types that these inherit. What an anonymous class is made of is its
    interface if it is one.
    """
    listed = lambda role: typed.select("file_key", "type_id", F.col("parent_id").alias("scope"), F.lit(role).alias("role"), F.posexplode(f"{role}_list").alias("ordinal", "spelling"))
    rows = checkpointed(listed("extends").unionByName(listed("implements")).withColumn("scope", F.coalesce("scope", F.lit(""))))
    known = resolution.names(typed, imported, package, None, J.JAVA_LANG)

    def supers_and_above(known: resolution.Names) -> tuple[DataFrame, DataFrame]:
        supers = checkpointed(rows.join(resolution.resolve(rows, known).drop("verdict"), ["file_key", "scope", "spelling"]).drop("scope"))
        return supers, checkpointed(closure.closure(supers, "type_id", "resolved").toDF("type_id", "ancestor", "depth"))

    supers, above = supers_and_above(known)
    if not known.members.isEmpty():
        known.above = above
        supers, above = supers_and_above(known)
    known.above = above
    face = typed.where("kind in ('interface', 'annotation')").select(F.col("type_id").alias("resolved"), F.lit(True).alias("face"))
    of_anonymous = F.regexp_extract("type_id", r"([^.]*)$", 1).startswith("$anon$") & (F.coalesce("face", F.lit(False)) | F.col("resolved").isin([f"java.lang.{x}" for x in J.INTERFACES]))
    supers = checkpointed(supers.join(face, "resolved", "left").withColumn("role", F.when(of_anonymous, "implements").otherwise(F.col("role"))).drop("face"))
    faced = supers.where("role = 'implements'").where(F.regexp_extract("type_id", r"([^.]*)$", 1).startswith("$anon$")).select("type_id", F.array("spelling").alias("faces"))
    typed = typed.join(faced, "type_id", "left")
    empty = F.array().cast("array<string>")
    typed = typed.withColumns({"implements_list": F.coalesce("faces", "implements_list"), "extends_list": F.when(F.col("faces").isNotNull(), empty).otherwise(F.col("extends_list"))}).drop("faces")
    ancestors = above.groupBy("type_id").agg(F.sort_array(F.collect_set("ancestor")).alias("ancestors"))
    typed = checkpointed(typed.join(ancestors, "type_id", "left").withColumn("ancestors", F.coalesce("ancestors", empty)))
    known.typed = typed
    return typed, supers, known


def argument_rows(sites: DataFrame, local: DataFrame, field: DataFrame, given: DataFrame) -> DataFrame:
    """``callable_id, local_id, ordinal, argument_id, expression, type``: a row for each argument; variables and literals as declared, other expressions as ``given``."""
    each = sites.where("callable_id is not null").select("file_key", "open_n", "type_id", "callable_id", "local_id", F.posexplode(F.arrays_zip("argument_expr", "argument_ids")).alias("ordinal", "x"))
    each = each.select("file_key", "open_n", "type_id", "callable_id", "local_id", "ordinal", F.col("x.argument_ids").alias("argument_id"), F.col("x.argument_expr").alias("expression"))
    each = each.join(given, ["file_key", "open_n", "ordinal"], "left").withColumn("given", F.when(~F.col("given").isin(resolution.UNKNOWN, resolution.LAMBDA, resolution.NULL), F.col("given")))
    each = each.join(local.withColumnRenamed("receiver", "expression"), ["callable_id", "expression"], "left").join(field.withColumnRenamed("receiver", "expression"), ["type_id", "expression"], "left")
    text = F.col("expression")
    kind = (
        F.when(text.rlike(r'^"'), "java.lang.String")
        .when(text.rlike("^'"), "char")
        .when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?\d[\d_]*[lL]$"), "long")
        .when(text.rlike(r"^-?(\d[\d_]*|0[xXbB][\da-fA-F_]+)$"), "int")
        .when(text.rlike(r"^-?[\d.][\d._]*([eE][-+]?\d+)?[fF]$"), "float")
        .when(text.rlike(r"^-?[\d.][\d._]*([eE][-+]?\d+)?[dD]?$"), "double")
        .otherwise(F.nullif(F.regexp_extract(text, r"^new ([\w$.]+)(<[^()]*>)?\(", 1), F.lit("")))
    )
    return each.select("callable_id", "local_id", "ordinal", "argument_id", "expression", F.coalesce("by_local", "by_field", kind, "given").alias("type"))


def owned_comments(comments: DataFrame, typed: DataFrame, found: DataFrame, declared: DataFrame) -> DataFrame:
    """``comments`` with ``owner`` and ``owner_kind``: what is declared right after; null where nothing is, for the file itself."""
    own = typed.select("file_key", "first", F.col("type_id").alias("owner"), F.lit("type").alias("owner_kind"))
    own = own.unionByName(found.where("first is not null").select("file_key", "first", F.col("callable_id").alias("owner"), F.lit("callable").alias("owner_kind")))
    field = declared.where("owner = 'field' and type_id is not null").groupBy("file_key", "first").agg(F.min(F.concat("type_id", F.lit("#field#"), "name")).alias("owner"))
    own = own.unionByName(field.withColumn("owner_kind", F.lit("field")))
    return comments.join(merge.first_wins(own, ["file_key", "first"], "owner"), ["file_key", "first"], "left").drop("first")


def properties(frame: DataFrame, **names: str) -> Column:
    """A map of properties as literals of the graph script, without nulls and empty lists: name by column."""
    kinds = dict(frame.select(*[F.col(c).alias(k) for k, c in names.items()]).dtypes)

    def literal(name: str) -> Column:
        value, kind = F.col(names[name]), kinds[name]
        if kind == "array<string>":
            return F.when(F.size(value) > 0, cypher_list(value))
        return F.when(value.isNotNull(), cypher_string(value) if kind == "string" else value.cast("string"))

    return F.map_filter(F.create_map(*[x for k in names for x in (F.lit(k), literal(k))]), lambda _, v: v.isNotNull())


def call_edges(sites: DataFrame, typed: DataFrame, above: DataFrame, found: DataFrame) -> DataFrame:
    """``src, dst, weight`` between callables of the project: types that are created answer virtual calls.

    A constructor or static call, and one through ``super``, means the one callable
    it resolves to. Any other is answered by each live type below the receiver, of
    the project or of a library, with its nearest callable of the callee's
    signature; where no callee is known, or it has type variables, of that name and
    number of arguments. Calls of a callable to itself are left out.
    """
    subtypes = typed.select(F.col("type_id").alias("ancestor"), F.col("type_id").alias("descendant"), F.lit(0).alias("depth")).unionByName(above.select("ancestor", F.col("type_id").alias("descendant"), "depth"))
    by_arity = F.concat(F.col("name"), F.lit("/"), F.size("parameters"))
    keyed = found.select("callable_id", F.col("type_id").alias("owner"), F.explode(F.array("erased_signature", by_arity)).alias("signature"))
    variables = F.filter("parameter_types", lambda p: F.exists("variables", lambda v: F.array_contains(F.split(p, r"\W+"), v)))
    own = typed.select(F.col("type_id").alias("t"), F.transform("type_parameters", lambda p: p["name"]).alias("class_variables"))
    mine = F.transform(F.coalesce("type_parameters", F.array().cast("array<struct<name:string,bounds:array<string>>>")), lambda p: p["name"])
    callee = found.join(own, F.col("type_id") == F.col("t")).withColumn("variables", F.concat("class_variables", mine))
    callee = callee.select(F.col("callable_id").alias("callee_id"), F.when(F.size(variables) == 0, F.col("erased_signature")).alias("exact"))
    base = sites.where("callable_id is not null and receiver_type is not null").join(callee, "callee_id", "left")
    arity = F.concat(F.col("method_name"), F.lit("/"), F.size("argument_expr"))
    base = base.select(
        F.concat_ws("@", "callable_id", "local_id").alias("site"), F.col("callable_id").alias("caller"), F.col("receiver_type").alias("receiver"), F.coalesce("exact", arity).alias("signature"), "callee_id",
        (F.col("is_constructor_call") | F.col("is_static_call") | F.coalesce(F.col("receiver") == "super", F.lit(False))).alias("direct"),
    )
    direct = base.where("direct and callee_id is not null").select("caller", F.col("callee_id").alias("callee"), "site")
    # What is created, and types whose callables may be entered from outside: a type answers for itself.
    created = sites.where("is_constructor_call").select(F.col("receiver_type").alias("type")).unionByName(typed.where("name like '$anon$%' or name like '$enum$%' or kind = 'enum'").select(F.col("type_id").alias("type")))
    created = created.unionByName(found.select(F.col("type_id").alias("type")))
    virtual = joins.virtual_targets(base.where("not direct").drop("callee_id", "direct"), subtypes, created, keyed)
    pairs = direct.unionByName(virtual).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return merge.weighted_edges(pairs)


def property_graph(a: Analysis, app: str) -> tuple[DataFrame, DataFrame]:
    """``nodes (merge_label, key, labels, name, module, props, seq)`` and ``edges (type, src, dst, props)``: merged, gated, one each.

    ``props`` map names to literals of the graph script; absent facts are left out.
    """
    no_props = F.create_map().cast("map<string,string>")

    def node(frame, label, key, name, module="file_key", merge_label=None, mark=None, **props):
        labels = F.array(F.lit(merge_label or label), *([F.lit(label)] if merge_label else []))
        if mark is not None:
            labels = F.when(mark, F.concat(labels, F.array(F.lit("JEntrypoint")))).otherwise(labels)
        owner = F.col(module) if module else F.lit(None).cast("string")
        given = properties(frame, **props) if props else F.lit(None).cast("map<string,string>")
        return frame.select(F.lit(merge_label or label).alias("merge_label"), key.alias("key"), labels.alias("labels"), name.alias("name"), owner.alias("module"), given.alias("props"))

    def edge(frame, kind, src, dst, **props):
        return frame.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), (properties(frame, **props) if props else no_props).alias("props"))

    def named(*columns, **renamed):
        return {c: c for c in columns} | renamed

    c, text = F.col, lambda *x: F.concat(*x)
    listed = lambda frame, key: frame.select(key, F.explode("annotations").alias("name"), "file_key")
    notes = a.comments.where("content != ''")
    docs = notes.where("owner is not null").groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "col", "content"))), lambda x: x["content"]), "\n").alias("docstring"))
    docs = docs.withColumnRenamed("owner", "documented")
    units = a.files.join(a.packages, "file_key", "left").join(a.comments.groupBy("file_key").agg(F.count("*").alias("comment_count")), "file_key", "left")
    units = units.withColumns({"comment_count": F.coalesce("comment_count", F.lit(0)), "package_name": F.nullif(F.col("package"), F.lit(""))})
    kinds = a.types.join(docs, c("type_id") == c("documented"), "left").withColumns({"is_interface": c("kind") == "interface", "is_nested_type": c("parent_id").isNotNull(), "is_inner_class": c("parent_id").isNotNull() & ~F.array_contains("modifiers", "static") & (c("kind") == "class")})
    target = lambda kind, name: a.references.where(c("kind") == kind).groupBy(c("callable_id").alias("of")).agg(F.sort_array(F.collect_set("target")).alias(name))
    bodies = a.callables.join(docs, c("callable_id") == c("documented"), "left")
    for kind, name in (("type", "referenced_types"), ("field", "accessed_fields")):
        bodies = bodies.join(target(kind, name), c("callable_id") == c("of"), "left").drop("of")
    bodies = bodies.withColumns({"is_constructor": c("kind") == "constructor", "thrown_exceptions": F.array_distinct(F.concat("thrown", "raised"))})
    bodies = bodies.where("kind != 'initializer'")
    in_block = r"#<(?:clinit|instance-init)>\$(\d+)\(\)$"
    around = F.regexp_replace("callable_id", in_block, "#init#$1")
    param = a.callables.select("file_key", "callable_id", F.posexplode("parameters").alias("i", "p")).select("file_key", "callable_id", "i", "p.*").withColumn("id", text(c("callable_id"), F.lit("#param#"), c("i")))
    field = a.variables.where("owner = 'field' and type_id is not null").withColumn("id", text(c("type_id"), F.lit("#field#"), c("name")))
    local = a.variables.where("owner = 'local' and callable_id is not null").withColumn("callable_id", around).withColumn("id", text(c("callable_id"), F.lit("#var#"), c("name"), F.lit("@"), c("line")))
    given = a.arguments.groupBy("callable_id", "local_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("type", F.lit("")).alias("type")))), lambda x: x["type"]).alias("argument_types"))
    site = a.call_sites.where("callable_id is not null").join(given, ["callable_id", "local_id"], "left").withColumn("callable_id", around).withColumn("id", text(c("callable_id"), F.lit("@"), c("local_id")))
    site = checkpointed(site.withColumn("callee_signature", F.nullif(F.regexp_extract("callee_id", "#(.*)$", 1), F.lit(""))))
    owned = a.types.select("type_id", "file_key")
    constant = a.enum_constants.join(owned, "type_id").withColumn("id", text(c("type_id"), F.lit("#enum#"), c("name")))
    component = a.record_components.join(owned, "type_id").withColumn("id", text(c("type_id"), F.lit("#rec#"), c("name")))
    block = a.callables.where("kind = 'initializer'").withColumns({"id": text(c("type_id"), F.lit("#init#"), F.regexp_extract("name", r"(\d+)$", 1)), "is_static": c("name").startswith("<clinit>")})
    note = notes.withColumn("id", text(c("file_key"), F.lit("#comment@"), c("line"), F.lit(":"), c("col")))
    marks = listed(a.types, "type_id").toDF("owner", "name", "file_key").unionByName(listed(a.callables, "callable_id").toDF("owner", "name", "file_key"))
    single = a.imports.where("not is_static and not is_wildcard")
    pack = a.imports.where("is_static or is_wildcard").withColumn("target", F.when(c("is_wildcard"), c("path")).otherwise(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)))

    def facts(column: str, mark: str) -> DataFrame:
        """The fact of each call site, once for the site and once for the callable around it, numbered there."""
        has = site.where(c(column).isNotNull())
        of_site = has.select("file_key", c("id").alias("owner"), F.lit(0).cast("long").alias("i"), c(column).alias("kind"), "line", "argument_expr")
        of_callable = merge.number_within(has, ["callable_id"], ["line", "col"], "i").select("file_key", c("callable_id").alias("owner"), "i", c(column).alias("kind"), "line", "argument_expr")
        return of_site.unionByName(of_callable).withColumn("id", text(c("owner"), F.lit(mark), c("i")))

    fact, query = facts("crud_operation", "#crudop#"), facts("crud_query", "#crudq#")
    parts = [
        a.files.select(F.lit("JApplication").alias("merge_label"), F.lit(app).alias("key"), F.array(F.lit("JApplication")).alias("labels"), F.lit(app).alias("name"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("map<string,string>").alias("props")).limit(1),
        node(single, "JType", c("path"), c("name"), None, "JSymbol"),
        node(pack, "JPackage", c("target"), c("target"), None),
        node(marks, "JAnnotation", c("name"), c("name"), None),
        node(units, "JCompilationUnit", c("file_key"), c("file_key"), **named("package_name", "content_hash", "comment_count", file_path="file_key")),
        node(kinds, "JType", c("type_id"), c("name"), "file_key", "JSymbol", c("is_entrypoint_class"), **named("kind", "modifiers", "annotations", "extends_list", "implements_list", "is_interface", "is_nested_type", "is_inner_class", "is_local_class", "is_entrypoint_class", "docstring", fqn="type_id", parent_type="parent_id")),
        node(bodies, "JCallable", c("callable_id"), c("name"), "file_key", "JSymbol", c("is_entrypoint"), **named("signature", "declaration", "return_type", "modifiers", "annotations", "thrown_exceptions", "parameter_types", "referenced_types", "accessed_fields", "start_line", "end_line", "code", "code_start_line", "is_constructor", "is_implicit", "is_entrypoint", "docstring", cyclomatic_complexity="cyclomatic")),
        node(param, "JParameter", c("id"), c("name"), **named("type", "is_variadic")),
        node(field, "JField", c("id"), c("name"), **named("type", "initializer", start_line="line")),
        node(local, "JVariable", c("id"), c("name"), **named("type", "initializer", start_line="line")),
        node(site, "JCallSite", c("id"), c("method_name"), **named("method_name", "receiver_type", "callee_signature", "argument_types", "argument_expr", "is_static_call", "is_constructor_call", receiver_expr="receiver", start_line="line", start_column="col")),
        node(constant, "JEnumConstant", c("id"), c("name"), **named("arguments")),
        node(component, "JRecordComponent", c("id"), c("name"), **named("type", "is_variadic", "default_value")),
        node(block, "JInitializationBlock", c("id"), c("name"), **named("start_line", "end_line", "is_static", cyclomatic_complexity="cyclomatic")),
        node(fact, "JCrudOperation", c("id"), c("kind"), **named(operation_type="kind", line_number="line")),
        node(query, "JCrudQuery", c("id"), c("kind"), **named(query_type="kind", line_number="line", query_arguments="argument_expr")),
        node(note, "JComment", c("id"), c("content"), **named("content", "is_javadoc", start_line="line", end_line="end_line")),
    ]
    rows = parts[0].withColumn("seq", F.lit(0))
    for seq, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("seq", F.lit(seq)))
    nodes = checkpointed(merge.merge_nodes(rows, ["merge_label", "key"], "seq", labels="labels"))

    nested = a.types.where("parent_id is not null")
    sure = [
        edge(a.files, "J_HAS_UNIT", F.lit(app), c("file_key")),
        edge(a.types.where("parent_id is null"), "J_DECLARES_TYPE", c("file_key"), c("type_id")),
        edge(nested, "J_HAS_NESTED_TYPE", c("parent_id"), c("type_id")),
        edge(a.callables.where("kind != 'initializer'"), "J_HAS_CALLABLE", c("type_id"), c("callable_id")),
        edge(param, "J_HAS_PARAMETER", c("callable_id"), c("id")),
        edge(field, "J_HAS_FIELD", c("type_id"), c("id")),
        edge(local, "J_DECLARES_VAR", c("callable_id"), c("id")),
        edge(site, "J_HAS_CALLSITE", c("callable_id"), c("id")),
        edge(constant, "J_HAS_ENUM_CONSTANT", c("type_id"), c("id")),
        edge(component, "J_HAS_RECORD_COMPONENT", c("type_id"), c("id")),
        edge(block, "J_HAS_INIT_BLOCK", c("type_id"), c("id")),
        edge(fact, "J_HAS_CRUD_OPERATION", c("owner"), c("id")),
        edge(query, "J_HAS_CRUD_QUERY", c("owner"), c("id")),
        edge(note, "J_HAS_COMMENT", F.coalesce("owner", "file_key"), c("id")),
        edge(marks, "J_ANNOTATED_BY", c("owner"), c("name")),
        edge(single, "J_IMPORTS", c("file_key"), c("path"), **named("is_static", "is_wildcard")),
        edge(pack, "J_IMPORTS", c("file_key"), c("target"), **named("is_static", "is_wildcard")),
    ]
    calls = a.call_edges.where(~c("src").rlike(in_block)).withColumn("kind", F.lit("CALL_DEP"))
    gated = [
        edge(a.supertypes.where("role = 'extends'"), "J_EXTENDS", c("type_id"), c("resolved")),
        edge(a.supertypes.where("role = 'implements'"), "J_IMPLEMENTS", c("type_id"), c("resolved")),
        edge(calls, "J_CALLS", c("src"), c("dst"), **named("weight", type="kind")),
    ]
    out, doubtful = sure[0], gated[0]
    for part in sure[1:]:
        out = out.unionByName(part)
    for part in gated[1:]:
        doubtful = doubtful.unionByName(part)
    symbols = nodes.where("merge_label = 'JSymbol'")
    resolved = edge(site.where("callee_id is not null"), "J_RESOLVES_TO", c("id"), c("callee_id"))
    edges = out.unionByName(gate.gate_edges(doubtful, symbols, "key", mode="both")).unionByName(gate.gate_edges(resolved, symbols, "key"), allowMissingColumns=True)
    edges = edges.groupBy("type", "src", "dst").agg(F.max_by("props", F.size("props")).alias("props"))
    return nodes, checkpointed(edges)


def innermost_owners(a: Analysis) -> DataFrame:
    """``file_key, callable_id, local_id, owner``: the innermost type or callable whose bytes hold each call site."""
    spans = a.types.select("file_key", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("type_id").alias("owner"))
    spans = spans.unionByName(a.callables.select("file_key", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("callable_id").alias("owner")))
    sites = a.call_sites.select("file_key", "callable_id", "local_id", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    return intervals.innermost(sites, spans, "file_key").drop("start", "end")


def durable_ids(a: Analysis, app: str) -> DataFrame:
    """``callable_id, can_id`` of every callable."""
    path = F.replace(F.col("type_id"), F.lit("."), F.lit("/"))
    return a.callables.select("callable_id", durable_id(F.lit(app), "file_key", path, F.col("signature")).alias("can_id"))
