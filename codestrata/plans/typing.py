"""Types of expressions and callees of calls, from the inside out.

The expressions of calls form a forest: a call hangs on the call it is made on, on
calls that are its arguments, and on the call that gave a ``var`` its type. A round
types all calls whose dependencies are typed, so there are as many rounds as the
deepest nesting has levels; each is a few joins over distinct types and names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resolution
from ..operators.resolution import LAMBDA, NULL, OBJECT, UNKNOWN, Names
from ..session import checkpointed
from ..sources import java_source as J

WORDS = r"^[\p{L}_$][\p{L}\p{N}_$]*(\.[\p{L}_$][\p{L}\p{N}_$]*)*$"
#: A cast at the start of an expression; a receiver that is a cast in brackets; an element of an array.
CAST = r"^\(((?:[a-z][\w$]*\.)*[A-Z][\w$.]*(?:<[^()]*>)?(?:\[\])*|(?:int|long|short|byte|char|boolean|float|double)(?:\[\])*)\)"
ELEMENT = r"^([\p{L}_$][\p{L}\p{N}_$]*)((?:\[[^\[\]]*\])+)$"


def literal_type(text: Column) -> Column:
    """Type of a literal, creation, lambda or class literal by its text; null for any other expression."""
    made = F.nullif(F.regexp_extract(text, r"^new ([\w$.]+)(<[^()]*>)?\(", 1), F.lit(""))
    return (
        F.when(text.rlike(r"^\"(?:[^\"\\]|\\.)*\"$"), "java.lang.String")
        .when(text.rlike(r"^'(?:[^'\\]|\\.)*'$"), "char")
        .when(text.isin("true", "false"), "boolean")
        .when(text == "null", NULL)
        .when(text.rlike(r"^-?\d[\d_]*[lL]$"), "long")
        .when(text.rlike(r"^-?(\d[\d_]*|0[xXbB][\da-fA-F_]+)$"), "int")
        .when(text.rlike(r"^-?[\d.][\d._]*([eE][-+]?\d+)?[fF]$"), "float")
        .when(text.rlike(r"^-?[\d.][\d._]*([eE][-+]?\d+)?[dD]?$"), "double")
        .when(text.rlike(r"^(\([\w$, ]*\)|[\w$]+)->"), LAMBDA)
        .when(text.rlike(r"^[\w$.]+::[\w$]+$"), LAMBDA)
        .when(text.rlike(r"^[\w$.\[\]]+\.class$"), "java.lang.Class")
        .when(made.isNotNull() & ~text.rlike(r"\)\."), made)
    )


class Scopes:
    """What names mean in types and callables: declared types, erased, as tables."""

    def __init__(self, code, parts, scope, typed, supers, known: Names, found, declared, sites, calls, values, context=None):
        self.known, self.typed = known, known.typed
        self.variables = checkpointed(resolution.type_variables(typed, found, known))
        own = found.where("open is not null").select("file_key", F.col("open").alias("in_callable"), "callable_id", "type_id")
        bound = J.bound_names(parts, scope).join(own, ["file_key", "in_callable"])
        places = declared.select("file_key", F.coalesce("callable_id", "type_id").alias("owner"), F.col("type_id").alias("scope"), F.col("type").alias("spelling"))
        params = found.select("file_key", "callable_id", "type_id", F.posexplode("parameters").alias("i", "p"))
        params = params.withColumn("spelling", F.concat("p.type", F.when(F.col("p.is_variadic"), "[]").otherwise("")))
        of_callable = lambda rows, spelling: rows.select("file_key", F.col("callable_id").alias("owner"), F.col("type_id").alias("scope"), spelling.alias("spelling"))
        spelled = [places, of_callable(params, F.col("spelling")), of_callable(found, F.col("return_type")), of_callable(bound, F.col("type"))]
        used = sites.select("file_key", F.coalesce("callable_id", "type_id").alias("owner"), F.col("type_id").alias("scope"), "created_type", "open_n")
        cast = calls.select("file_key", "open_n", F.explode(F.concat("argument_expr", F.array("head"))).alias("text"))
        cast = cast.select("file_key", "open_n", F.regexp_extract(F.regexp_replace("text", r"^\((?=\()", ""), CAST, 1).alias("spelling")).where("spelling != ''")
        made = calls.select("file_key", "open_n", F.explode("argument_expr").alias("text")).select("file_key", "open_n", F.regexp_extract("text", r"^new ([\w$.]+)", 1).alias("spelling")).where("spelling != ''")
        spelled += [used.select("file_key", "owner", "scope", F.col("created_type").alias("spelling")), used.join(cast.unionByName(made), ["file_key", "open_n"]).select("file_key", "owner", "scope", "spelling")]
        kinds = [k for k in J.PRIMITIVE if k != "var"] + ["var"]
        self.meaning = checkpointed(resolution.erased(reduce(DataFrame.unionByName, spelled), self.variables, known, kinds).select("file_key", "owner", "spelling", "erased"))

        listed = self._meant(params.withColumn("owner", F.col("callable_id")))
        wanted = listed.groupBy("callable_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("erased", F.lit(UNKNOWN)).alias("t")))), lambda x: x["t"]).alias("wanted"))
        returned = self._meant(found.select("file_key", "callable_id", F.col("callable_id").alias("owner"), F.col("return_type").alias("spelling"))).select("callable_id", F.col("erased").alias("returns"))
        none = F.array().cast("array<string>")
        last = F.element_at(F.col("parameters"), -1)["is_variadic"]
        methods = found.join(wanted, "callable_id", "left").join(returned, "callable_id", "left")
        self.own_methods = checkpointed(
            methods.select("callable_id", F.col("type_id").alias("declarer"), "name", F.coalesce("wanted", none).alias("wanted"), F.coalesce(F.when(F.size("parameters") > 0, last), F.lit(False)).alias("variadic"), "returns", "modifiers")
        )
        self.methods = self.own_methods if context is None else checkpointed(self.own_methods.unionByName(context.methods))
        fields = self._meant(declared.where("owner = 'field' and type_id is not null").select("file_key", "type_id", "name", F.col("type").alias("spelling"), F.col("type_id").alias("owner")))
        components = J.record_components(typed).join(typed.select("type_id", "file_key"), "type_id")
        components = self._meant(components.select("file_key", "type_id", "name", F.col("type").alias("spelling"), F.col("type_id").alias("owner")))
        constants = J.enum_constants(scope, parts, typed).select("type_id", "name", F.col("type_id").alias("erased"))
        fields = fields.select("type_id", "name", "erased").unionByName(components.select("type_id", "name", "erased")).unionByName(constants)
        self.own_fields = checkpointed(fields.groupBy(F.col("type_id").alias("holder"), F.col("name").alias("field")).agg(F.min("erased").alias("field_type")))
        self.fields = self.own_fields if context is None else checkpointed(self.own_fields.unionByName(context.field_types))
        local = self._meant(declared.where("owner = 'local' and callable_id is not null").select("file_key", "callable_id", "name", "first", "equals_n", "initializer", F.col("callable_id").alias("owner"), F.col("type").alias("spelling")))
        given = self._meant(params.select("file_key", "callable_id", F.col("p.name").alias("name"), F.lit(-1).alias("first"), F.lit(None).cast("long").alias("equals_n"), F.lit(None).cast("string").alias("initializer"), F.col("callable_id").alias("owner"), "spelling"))
        held = self._meant(bound.select("file_key", "callable_id", "name", "first", F.lit(None).cast("long").alias("equals_n"), F.lit(None).cast("string").alias("initializer"), F.col("callable_id").alias("owner"), F.col("type").alias("spelling")))
        columns = ["file_key", "callable_id", "name", F.col("first").cast("long").alias("first"), F.col("equals_n").cast("long").alias("equals_n"), "initializer", "erased"]
        local = local.select(*columns).unionByName(given.select(*columns)).unionByName(held.select(*columns))
        self.locals = checkpointed(self._inferred(local, calls, values))
        self.top = supers.where("role = 'extends' and ordinal = 0").join(typed.where("kind = 'class'").select("type_id"), "type_id").select("type_id", F.array("resolved").alias("up"))

    def _meant(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.meaning, ["file_key", "owner", "spelling"], "left")

    @staticmethod
    def _inferred(local: DataFrame, calls: DataFrame, values: DataFrame) -> DataFrame:
        """``var`` takes the type of its initializer: a literal's, or that of the call that is all of it (``dep``)."""
        whole = calls.select("file_key", "begin_n", "close_n", F.col("open_n").alias("dep"))
        spans = values.join(whole, ["file_key", "begin_n", "close_n"]).select("file_key", "equals_n", "dep")
        local, spans = checkpointed(local), checkpointed(spans)
        waits = F.col("erased") == "var"
        out = local.join(spans, ["file_key", "equals_n"], "left").withColumn("dep", F.when(waits, F.col("dep")))
        known = F.when(~waits, F.col("erased")).otherwise(literal_type(F.col("initializer")))
        return out.select("callable_id", "name", "first", known.alias("type"), "dep")

    def field_types(self, rows: DataFrame, holder: str, field: str) -> DataFrame:
        """Distinct ``holder, field`` with ``found``: the field's type in the nearest type upwards, or the member type of that name."""
        asked = rows.select(F.col(holder).alias("h"), F.col(field).alias("f")).where("h is not null and f is not null").distinct()
        up = asked.join(self.known.upwards(), F.col("h") == F.col("type_id")).join(self.fields, (F.col("ancestor") == F.col("holder")) & (F.col("f") == F.col("field")))
        near = up.groupBy("h", "f").agg(F.min_by("field_type", F.struct("depth", "field_type")).alias("found"))
        inner = self.known.members.select(F.col("owner").alias("h"), F.col("name").alias("f"), F.col("type_id").alias("member"))
        out = asked.join(near, ["h", "f"], "left").join(inner, ["h", "f"], "left")
        size = F.when(F.col("h").endswith("[]") & (F.col("f") == "length"), "int")
        return out.select(F.col("h").alias(holder), F.col("f").alias(field), F.coalesce("found", "member", size).alias("found"))

    def paths(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``type``, ``dep`` (a call whose type the first word has) and ``static`` (the words name a type).

        ``rows`` has ``id, file_key, type_id, callable_id, n, words``: local variables
        declared before ``n`` (the last one), fields of the types around and above,
        statically imported fields, type names, qualified names.
        """
        rows = checkpointed(rows.withColumns({"w": F.get("words", 0), "k": F.size("words")}))
        local = rows.join(self.locals.select(F.col("callable_id").alias("c"), "name", "first", "type", F.col("dep").alias("d")), (F.col("callable_id") == F.col("c")) & (F.col("w") == F.col("name")) & (F.col("first") <= F.col("n")))
        local = checkpointed(local.groupBy("id").agg(F.max_by(F.struct(F.col("type").alias("t"), F.col("d").alias("d"), F.lit(True).alias("is_local")), "first").alias("local")))
        asked = rows.select("type_id", "w").distinct()
        around = asked.join(self.known.around, "type_id").join(self.known.upwards().select(F.col("type_id").alias("outer"), "ancestor", F.col("depth").alias("step")), "outer")
        field = around.join(self.fields, (F.col("ancestor") == F.col("holder")) & (F.col("w") == F.col("field"))).groupBy("type_id", "w").agg(F.min_by("field_type", F.struct("depth", "step", "field_type")).alias("by_field"))
        field = checkpointed(field)
        static = self.known.imported.where("is_static and not is_wildcard").select("file_key", F.col("name").alias("w"), F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("from_type"))
        static = static.join(self.fields, (F.col("from_type") == F.col("holder")) & (F.col("w") == F.col("field"))).groupBy("file_key", "w").agg(F.min("field_type").alias("by_import"))
        named = resolution.resolve(rows.select("file_key", F.col("type_id").alias("scope"), F.col("w").alias("spelling")), self.known).where((F.col("verdict") == "found") | F.col("spelling").rlike(r"^\p{Lu}"))
        named = named.select("file_key", F.col("scope").alias("type_id"), F.col("spelling").alias("w"), F.col("resolved").alias("by_name"), (F.col("verdict") != "ambiguous").alias("one"))
        named = checkpointed(named)
        # The shortest run of words that is the id of a type.
        runs = rows.where("k > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("k"))).alias("j"), "words").withColumn("qualified", F.array_join(F.slice("words", F.lit(1), F.col("j")), "."))
        runs = runs.join(self.typed.select(F.col("type_id").alias("qualified")), "qualified").groupBy("id").agg(F.min(F.struct("j", "qualified")).alias("run"))
        out = rows.join(local, "id", "left").join(field, ["type_id", "w"], "left").join(static, ["file_key", "w"], "left").join(named, ["file_key", "type_id", "w"], "left").join(runs, "id", "left")
        out = out.join(self.top, "type_id", "left")
        up = F.coalesce(F.get("up", 0), F.lit(OBJECT))
        is_local = F.coalesce(F.col("local.is_local"), F.lit(False))
        variable = F.coalesce("by_field", "by_import")
        first = F.when(F.col("w") == "this", F.col("type_id")).when(F.col("w") == "super", up).when(is_local, F.col("local.t")).otherwise(F.coalesce(variable, F.when(F.col("one"), F.col("by_name"))))
        by_run = ~is_local & first.isNull() & F.col("run").isNotNull()
        is_type = ~is_local & variable.isNull() & ~F.col("w").isin("this", "super")
        out = out.select("id", "words", "k", F.when(by_run, F.col("run.qualified")).otherwise(first).alias("type"), F.when(is_local, F.col("local.d")).alias("dep"), (is_type & F.coalesce(first, F.col("run.qualified")).isNotNull()).alias("static"), F.when(by_run, F.col("run.j")).otherwise(F.lit(1)).alias("at"))
        return self.along(checkpointed(out))

    def along(self, rows: DataFrame) -> DataFrame:
        """Follows the words behind ``at`` through fields and member types, as far as ``type`` is known."""
        left = rows.agg(F.max(F.when(F.col("type").isNotNull(), F.col("k") - F.col("at")))).first()[0] or 0
        for _ in range(left):
            rows = rows.withColumn("next", F.when(F.col("type").isNotNull() & (F.col("at") < F.col("k")), F.get("words", F.col("at").cast("int"))))
            step = self.field_types(rows, "type", "next")
            moved = F.col("next").isNotNull()
            kept = F.when(F.col("next") == "this", F.col("type")).otherwise(F.col("found"))
            rows = rows.join(step, ["type", "next"], "left")
            inner = F.col("static") & (F.col("found") == F.concat_ws(".", "type", "next"))
            rows = rows.select("id", "words", "k", F.when(moved, kept).otherwise(F.col("type")).alias("type"), "dep", F.when(moved, F.coalesce(inner, F.lit(False))).otherwise(F.col("static")).alias("static"), (F.col("at") + moved.cast("int")).alias("at"))
        return rows

    def candidates(self, groups: DataFrame) -> DataFrame:
        """``group, callable_id, wanted, variadic`` of distinct ``group, own, lookup, method``: the members that a call can mean, without overridden ones.

        A call without a receiver means members of the innermost type around it that
        has one of the name, itself or from above; else statically imported ones.
        """
        inside = groups.where("own").join(self.known.around, F.col("lookup") == F.col("type_id")).select("group", "method", F.col("outer").alias("start"), "depth")
        start = inside.unionByName(groups.where("not own").select("group", "method", F.col("lookup").alias("start"), F.lit(0).alias("depth")))
        up = self.known.upwards().select(F.col("type_id").alias("start"), F.col("ancestor").alias("declarer"), F.col("depth").alias("step"))
        member = start.join(up, "start").where("method != '<init>' or step = 0").join(self.methods.withColumnRenamed("name", "method"), ["declarer", "method"])
        imported = self.known.imported.where("is_static").select("file_key", F.when(F.col("is_wildcard"), F.col("path")).otherwise(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).alias("declarer"), F.when(~F.col("is_wildcard"), F.col("name")).alias("only"))
        static = groups.where("own").join(self.typed.select(F.col("type_id").alias("lookup"), "file_key"), "lookup").join(imported, "file_key").where("only is null or only = method")
        static = static.select("group", "method", "declarer", F.lit(1_000).alias("depth"), F.lit(0).alias("step")).join(self.methods.withColumnRenamed("name", "method"), ["declarer", "method"])
        columns = ["group", "depth", "step", "callable_id", "wanted", "variadic"]
        rows = member.select(*columns).unionByName(static.select(*columns))
        nearest = rows.groupBy("group").agg(F.min("depth").alias("nearest"))
        rows = rows.join(nearest, "group").where("depth = nearest")
        return rows.groupBy("group", "wanted").agg(F.min_by(F.struct("callable_id", "variadic"), F.struct("step", "callable_id")).alias("x")).select("group", "x.callable_id", "wanted", "x.variadic")


def typed_sites(scopes: Scopes, code: DataFrame, sites: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file_key, open_n, receiver_type, static, return_type, callee_id`` of each call, and ``file_key, open_n, ordinal, given`` of each argument."""
    site = sites.join(calls, ["file_key", "open_n"], "left").join(J.receiver_paths(code, sites), ["file_key", "n"], "left")
    site = checkpointed(site.withColumn("owner", F.coalesce("callable_id", "type_id")))
    # What a call is made on: a path of words, another call, a cast or an array element; or nothing.
    closing = calls.select("file_key", F.col("close_n").alias("stem_n"), F.col("open_n").alias("root"))
    site = site.join(closing, ["file_key", "stem_n"], "left").withColumn("rooted", F.coalesce("rooted", F.lit(False)))
    cast = F.nullif(F.regexp_extract(F.regexp_replace("head", r"^\(", ""), CAST, 1), F.lit(""))
    element = F.nullif(F.regexp_extract("head", ELEMENT, 1), F.lit(""))
    here = {"id": F.concat_ws("@", "file_key", "open_n"), "spelling": F.coalesce("created_type", F.when(F.col("root").isNull(), cast)), "element": F.when(F.col("root").isNull(), element)}
    site = site.withColumns(here).join(scopes.meaning, ["file_key", "owner", "spelling"], "left").drop("spelling")
    words = F.when(F.col("rooted"), F.col("path")).otherwise(F.when(F.col("element").isNotNull(), F.array("element")))
    text = F.posexplode_outer(F.arrays_zip("argument_expr", "argument_calls")).alias("i", "x")
    each = site.select("id", "file_key", "owner", "type_id", "callable_id", "n", text).where("i is not null")
    each = each.select("id", "file_key", "owner", "type_id", "callable_id", "n", "i", F.col("x.argument_expr").alias("text"), F.col("x.argument_calls").alias("dep"))
    asked = site.where(words.isNotNull()).select("id", "file_key", "type_id", "callable_id", "n", words.alias("words"))
    plain = each.where((F.col("dep") == -1) & F.col("text").rlike(WORDS) & ~F.col("text").isin("true", "false", "null") & ~F.col("text").endswith(".class"))
    plain = plain.select(F.concat_ws("#", "id", "i").alias("id"), "file_key", "type_id", "callable_id", "n", F.split("text", r"\.").alias("words"))
    met = checkpointed(scopes.paths(asked.unionByName(plain)))
    dims = F.length(F.regexp_replace(F.regexp_replace(F.regexp_extract("head", ELEMENT, 2), r"\[[^\[\]]*\]", "x"), "[^x]", ""))
    base = site.join(met.select("id", F.col("type").alias("by_path"), F.col("dep").alias("path_dep"), "static", (F.col("at") == F.col("k")).alias("all_words"), F.slice("words", F.col("at") + 1, F.col("k") - F.col("at")).alias("open_words")), "id", "left")
    by_path = F.when(F.col("element").isNotNull(), F.expr("substring(by_path, 1, length(by_path) - 2 * n_dims)")).otherwise(F.when(F.col("all_words"), F.col("by_path")))
    base = base.withColumn("n_dims", dims)
    own = F.col("stem_n").isNull() & F.col("created_type").isNull()
    literal = F.when(F.col("stem").startswith('"'), "java.lang.String")
    ups = scopes.top.withColumnRenamed("type_id", "t")
    base = base.join(ups, F.col("type_id") == F.col("t"), "left")
    explicit = F.when(F.col("word") == "super", F.get("up", 0)).otherwise(F.col("type_id"))
    start = F.when(F.col("is_constructor_call") & F.col("created_type").isNull(), explicit).when(own, F.col("type_id")).otherwise(F.coalesce("erased", by_path, literal))
    base = base.select(
        "id", "file_key", "open_n", "type_id", "method_name", "is_constructor_call", (own & ~F.col("is_constructor_call")).alias("own"), start.alias("receiver"),
        F.when(start.isNull(), F.coalesce("root", "path_dep")).alias("dep"), F.when(F.col("root").isNotNull(), F.coalesce("path", F.array().cast("array<string>"))).otherwise(F.coalesce("open_words", F.array().cast("array<string>"))).alias("rest"),
        F.coalesce("static", F.lit(False)).alias("static"), "created_type", F.col("erased").alias("created"),
    )
    spelled = F.coalesce(F.nullif(F.regexp_extract("text", CAST, 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^new ([\w$.]+)", 1), F.lit("")))
    each = each.withColumn("spelling", spelled).join(scopes.meaning, ["file_key", "owner", "spelling"], "left")
    by_word = met.select(F.col("id").alias("argument"), F.when(F.col("at") == F.col("k"), F.col("type")).alias("by_word"), F.when(F.col("k") == 1, F.col("dep")).alias("word_dep"))
    each = each.withColumn("argument", F.concat_ws("#", "id", "i")).join(by_word, "argument", "left")
    simple = literal_type(F.col("text"))
    fixed = F.coalesce(F.when(simple.isin(LAMBDA, NULL) | ~F.col("text").startswith("new "), simple), F.when(F.col("text").rlike(CAST) | (simple.isNotNull() & (F.col("dep") == -1)), F.col("erased")), F.when(F.col("text") == "this", F.col("type_id")), F.col("by_word"))
    each = checkpointed(each)
    each = checkpointed(each.select("id", "file_key", "i", fixed.alias("given"), F.when(fixed.isNull(), F.coalesce(F.nullif(F.col("dep"), F.lit(-1)), F.col("word_dep"))).alias("dep")))
    base = checkpointed(base)

    place = lambda rows: rows.select("id", F.concat_ws("@", "file_key", "dep").alias("needs")).where("needs is not null")
    waits = checkpointed(place(base.where("dep is not null")).unionByName(place(each.where("dep is not null"))).join(base.select(F.col("id").alias("needs")), "needs", "left_semi"))
    spark = base.sparkSession
    done = spark.createDataFrame([], "id string, receiver_type string, return_type string, callee_id string")
    pending = base
    while not pending.isEmpty():
        blocked = waits.join(done.select(F.col("id").alias("needs")), "needs", "left_anti").select("id")
        ready = checkpointed(pending.join(blocked, "id", "left_anti"))
        if ready.isEmpty():  # calls that hang on each other: what they hang on stays unknown
            ready = pending
        result = _round(scopes, ready, each, done)
        pending = checkpointed(pending.join(ready.select("id"), "id", "left_anti"))
        done = checkpointed(done.unionByName(result))
    types = done.select(F.col("id").alias("needs"), "return_type")
    arguments = each.withColumn("needs", F.concat_ws("@", "file_key", "dep")).join(types, "needs", "left")
    arguments = arguments.select("id", F.col("i").alias("ordinal"), F.coalesce("given", "return_type").alias("given"))
    where = base.select("id", "file_key", "open_n", "static")
    return where.join(done, "id").drop("id"), where.join(arguments, "id").select("file_key", "open_n", "ordinal", "given")


def _round(scopes: Scopes, ready: DataFrame, each: DataFrame, done: DataFrame) -> DataFrame:
    """Receiver, callee and type of calls whose dependencies are in ``done``."""
    types = done.select(F.col("id").alias("needs"), "return_type")
    rows = ready.withColumn("needs", F.concat_ws("@", "file_key", "dep")).join(types, "needs", "left")
    rows = rows.withColumns({"type": F.col("return_type"), "words": F.col("rest"), "k": F.size("rest"), "at": F.lit(0)})
    later = scopes.along(rows.where("dep is not null").select("id", "words", "k", "type", F.lit(None).cast("string").alias("dep"), F.lit(False).alias("static"), "at"))
    later = later.where("at = k").select("id", F.col("type").alias("later"))
    rows = rows.select("id", "type_id", "method_name", "is_constructor_call", "own", "receiver", "created_type", "created").join(later, "id", "left").withColumn("lookup", F.coalesce("receiver", "later"))
    given = each.join(ready.select("id"), "id", "left_semi").withColumn("needs", F.concat_ws("@", "file_key", "dep")).join(types, "needs", "left")
    given = given.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("given", "return_type", F.lit(UNKNOWN)).alias("t")))), lambda x: x["t"]).alias("given"))
    rows = rows.join(given, "id", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    rows = checkpointed(rows.withColumn("group", F.when(F.col("lookup").isNotNull(), F.concat_ws("|", F.col("own").cast("string"), "lookup", "method_name"))))
    # Calls of one shape mean the same, however many there are.
    rows = rows.withColumn("shape", F.concat_ws("|", "group", F.array_join("given", ",")))
    asked = rows.where("group is not null")
    groups = checkpointed(asked.select("group", "own", "lookup", F.col("method_name").alias("method")).distinct())
    shapes = asked.select("shape", "group", "given").distinct()
    chosen = resolution.choose(shapes, checkpointed(scopes.candidates(groups)), scopes.known).withColumnRenamed("callable_id", "callee_id")
    about = scopes.methods.select(F.col("callable_id").alias("callee_id"), "declarer", "returns")
    out = rows.join(chosen, "shape", "left").join(about, "callee_id", "left")
    # A call without a receiver that means another type's member is made on that type.
    inherits = out.join(scopes.known.upwards().select(F.col("type_id").alias("t"), F.col("ancestor").alias("a"), F.lit(True).alias("inherited")), (F.col("type_id") == F.col("t")) & (F.col("declarer") == F.col("a")), "left")
    receiver = F.when(F.col("own") & F.col("declarer").isNotNull() & F.col("inherited").isNull(), F.col("declarer")).otherwise(F.col("lookup"))
    returns = F.when(F.col("is_constructor_call"), F.coalesce("created", "lookup")).otherwise(F.col("returns"))
    return inherits.select("id", receiver.alias("receiver_type"), returns.alias("return_type"), "callee_id").dropDuplicates(["id"])
