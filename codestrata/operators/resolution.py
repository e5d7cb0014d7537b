"""Names, type variables and overloads of Java, resolved by ranked joins.

A name has candidates of several ranks (members of the types around it, imports,
its package, ...). All are found by equi-joins, the least rank wins, and two
different candidates of that rank leave the name as it is spelled. Overloads are
chosen in the same way: candidates, applicability by phase, and of those that are
left the one whose parameters are below all others'.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import closure

# Primitive types from narrow to wide, their boxes, and what common library types are below.
WIDER = {
    "byte": ["short", "int", "long", "float", "double"],
    "short": ["int", "long", "float", "double"],
    "char": ["int", "long", "float", "double"],
    "int": ["long", "float", "double"],
    "long": ["float", "double"],
    "float": ["double"],
    "double": [],
    "boolean": [],
}
BOXES = {"byte": "Byte", "short": "Short", "char": "Character", "int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean"}
ABOVE = {
    "Byte": ["Number", "Comparable"],
    "Short": ["Number", "Comparable"],
    "Integer": ["Number", "Comparable"],
    "Long": ["Number", "Comparable"],
    "Float": ["Number", "Comparable"],
    "Double": ["Number", "Comparable"],
    "Character": ["Comparable"],
    "Boolean": ["Comparable"],
    "String": ["CharSequence", "Comparable"],
    "StringBuilder": ["CharSequence"],
    "StringBuffer": ["CharSequence"],
    "RuntimeException": ["Exception", "Throwable"],
    "Exception": ["Throwable"],
    "Error": ["Throwable"],
    "Thread": ["Runnable"],
}
OBJECT = "java.lang.Object"
#: Reductions of a type variable to its bound, as many as signatures are reduced at most.
BOUNDS = 16
#: Ranks of places that are not types around a name.
IMPORTED, NEAR, ON_DEMAND, SAME_FILE = 1_000, 2_000, 3_000, 4_000
UNKNOWN, LAMBDA, NULL = "?", "->", "null"


def _lang(name: str) -> str:
    return f"java.lang.{name}"


@dataclass
class Names:
    """What names can mean: all tables have type ids.

    ``around`` (type_id, outer, depth): the types that enclose one, itself at 0;
    ``above`` (type_id, ancestor, depth): what it extends or implements, library types too;
    ``members`` (owner, name, type_id): member types.
    """

    typed: DataFrame
    imported: DataFrame
    package: DataFrame
    around: DataFrame
    above: DataFrame
    members: DataFrame
    language: list[str]
    _libraries: DataFrame | None = None

    def libraries(self) -> DataFrame:
        """Project types of whose ancestors one is not of the project: they may be below more than is known."""
        if self._libraries is None:
            project = self.typed.select(F.col("type_id").alias("t"))
            self._libraries = checkpointed(self.above.join(project, F.col("ancestor") == F.col("t"), "left_anti").where(F.col("ancestor") != OBJECT).select("type_id").distinct())
        return self._libraries

    def upwards(self) -> DataFrame:
        """``type_id, ancestor, depth`` with each type itself at 0."""
        return self.typed.select("type_id", F.col("type_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(self.above)


def names(typed: DataFrame, imported: DataFrame, package: DataFrame, above: DataFrame | None, language: list[str]) -> Names:
    own = typed.select("type_id", F.col("type_id").alias("outer"), F.lit(0).alias("depth"))
    out = closure.closure(typed.where("parent_id is not null"), "type_id", "parent_id").toDF("type_id", "outer", "depth")
    if above is None:
        above = typed.sparkSession.createDataFrame([], "type_id string, ancestor string, depth int")
    members = typed.where("parent_id is not null").select(F.col("parent_id").alias("owner"), "name", "type_id")
    return Names(typed, imported, package, checkpointed(own.unionByName(out)), above, members, language)


def plain_name(spelling: Column) -> Column:
    """A spelling without type arguments, to any depth of them, and array marks."""
    # Innermost arguments first: what is left of a balanced spelling after k rounds is what nests deeper than k.
    steps = F.sequence(F.lit(0), F.length(spelling) - F.length(F.replace(spelling, F.lit("<"), F.lit(""))))
    flat = F.aggregate(steps, spelling, lambda text, _: F.regexp_replace(text, r" ?<[^<>]*>", ""))
    return F.regexp_replace(F.regexp_replace(flat, r"\.\.\.$", ""), r"(\[\])+$", "")


def dimensions(spelling: Column) -> Column:
    return F.when(spelling.endswith("..."), "[]").otherwise("") if spelling is None else F.regexp_extract(F.regexp_replace(spelling, r"\.\.\.$", "[]"), r"((?:\[\])*)$", 1)


def resolve(spellings: DataFrame, known: Names) -> DataFrame:
    """``file_key, scope, spelling, resolved, verdict`` of each distinct name.

    ``spellings`` has ``file_key, scope (type id or null), spelling``. Ranks, least
    first: member types of the scope, then those it inherits (nearer ones first),
    then the same for each type around it; single imports; the own package; imports
    on demand and java.lang; a type of that name elsewhere in the file. ``verdict``
    is found, ambiguous (two candidates of one rank; the name stays as spelled) or
    unknown.
    """
    rows = spellings.select("file_key", F.coalesce("scope", F.lit("")).alias("scope"), "spelling").where("spelling is not null").distinct()
    rows = checkpointed(rows.withColumn("plain", plain_name(F.col("spelling"))).withColumn("first", F.substring_index("plain", ".", 1)))
    asked = rows.select("file_key", "scope", F.col("first").alias("name")).distinct()
    # A name is looked up once for each type it stands in, however many files and callables spell it.
    scoped = asked.where("scope != ''").select("scope", "name").distinct().join(known.around.withColumnRenamed("type_id", "scope"), "scope")
    member = known.members.withColumnRenamed("type_id", "target")
    at = lambda rank, *more: F.struct(F.lit(rank).alias("place") if isinstance(rank, int) else rank.alias("place"), (more[0] if more else F.lit(0)).alias("step")).alias("rank")
    declared = scoped.join(member, (F.col("outer") == F.col("owner")) & (scoped["name"] == member["name"])).select("scope", scoped["name"], at(2 * F.col("depth")), "target")
    heirs = scoped.join(known.above.select(F.col("type_id").alias("t"), "ancestor", F.col("depth").alias("step")), F.col("outer") == F.col("t"))
    inherited = heirs.join(member, (F.col("ancestor") == F.col("owner")) & (heirs["name"] == member["name"])).select("scope", heirs["name"], at(2 * F.col("depth") + 1, F.col("step")), "target")
    by_scope = asked.join(declared.unionByName(inherited), ["scope", "name"]).select("file_key", "scope", "name", "rank", "target")

    files = asked.select("file_key", "name").distinct()
    types = known.typed.select(F.col("type_id").alias("target"), F.col("name").alias("simple"), F.col("package").alias("p"), "parent_id", F.col("file_key").alias("f"))
    single = known.imported.where("not is_wildcard")
    ordinary = files.join(single.where("not is_static").select("file_key", "name", F.col("path").alias("target")), ["file_key", "name"]).select("file_key", "name", at(IMPORTED), "target")
    static = files.join(single.where("is_static").select("file_key", "name", F.col("path").alias("target")), ["file_key", "name"]).join(types.select("target"), "target", "left_semi").select("file_key", "name", at(IMPORTED), "target")
    here = files.join(known.package, "file_key", "left").withColumn("package", F.coalesce("package", F.lit("")))
    top = types.where("parent_id is null")
    near = here.join(top, (F.col("package") == F.col("p")) & (F.col("name") == F.col("simple"))).select("file_key", "name", at(NEAR), "target")
    demand = files.join(known.imported.where("is_wildcard").select("file_key", "path", "is_static"), "file_key")
    packed = demand.where("not is_static").join(top, (F.col("path") == F.col("p")) & (F.col("name") == F.col("simple"))).select("file_key", "name", at(ON_DEMAND), "target")
    nested = demand.join(member.withColumnRenamed("name", "simple"), (F.col("path") == F.col("owner")) & (F.col("name") == F.col("simple"))).select("file_key", "name", at(ON_DEMAND), "target")
    language = files.where(F.col("name").isin(known.language)).select("file_key", "name", at(ON_DEMAND), F.concat(F.lit("java.lang."), "name").alias("target"))
    beside = files.join(types.where("parent_id is not null"), (F.col("file_key") == F.col("f")) & (F.col("name") == F.col("simple"))).select("file_key", "name", at(SAME_FILE), "target")
    by_file = reduce(DataFrame.unionByName, [ordinary, static, near, packed, nested, language, beside])
    found = by_scope.unionByName(asked.join(by_file, ["file_key", "name"]).select("file_key", "scope", "name", "rank", "target"))
    each = found.groupBy("file_key", "scope", "name", "rank").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    best = each.groupBy("file_key", "scope", "name").agg(F.min(F.struct("rank", "target", "other")).alias("best"))
    best = best.select("file_key", "scope", F.col("name").alias("first"), "best.target", (F.col("best.target") == F.col("best.other")).alias("sure"))
    out = rows.join(best, ["file_key", "scope", "first"], "left")
    rest = F.expr("substring(plain, length(first) + 1)")
    verdict = F.when(F.col("sure"), "found").when(F.col("sure").isNull(), "unknown").otherwise("ambiguous")
    return out.select("file_key", "scope", "spelling", F.when(F.col("sure"), F.concat("target", rest)).otherwise(F.col("plain")).alias("resolved"), verdict.alias("verdict"))


def type_variables(typed: DataFrame, found: DataFrame, known: Names) -> DataFrame:
    """``owner, variable, bound``: the type variables that a type or callable sees and the spelling that each erases to.

    A bound that is itself a variable is followed until one is not: bounds shrink
    in rounds until none changes.
    """
    own = typed.select(F.col("type_id").alias("declares"), F.explode("type_parameters").alias("p"))
    bound = F.coalesce(F.get("p.bounds", 0), F.lit(OBJECT))
    of_type = own.select("declares", F.col("p.name").alias("variable"), bound.alias("bound"))
    seen = known.around.join(of_type, F.col("outer") == F.col("declares")).select(F.col("type_id").alias("owner"), "variable", "bound", (F.col("depth") + 1).alias("rank"))
    mine = found.where("type_parameters is not null").select(F.col("callable_id").alias("owner"), F.explode("type_parameters").alias("p")).select("owner", F.col("p.name").alias("variable"), bound.alias("bound"), F.lit(0).alias("rank"))
    passed = found.select("callable_id", "type_id").join(seen, F.col("type_id") == F.col("owner")).select(F.col("callable_id").alias("owner"), "variable", "bound", "rank")
    rows = seen.unionByName(mine).unionByName(passed).groupBy("owner", "variable").agg(F.min_by("bound", "rank").alias("bound"))
    rows = checkpointed(rows.withColumn("bound", plain_name(F.col("bound"))))
    for _ in range(BOUNDS):
        over = rows.select(F.col("owner").alias("o"), F.col("variable").alias("v"), F.col("bound").alias("next")).where("next != v")
        longer = rows.join(over, (F.col("owner") == F.col("o")) & (F.col("bound") == F.col("v")))
        if longer.isEmpty():
            break
        rows = checkpointed(rows.join(over, (F.col("owner") == F.col("o")) & (F.col("bound") == F.col("v")), "left").select("owner", "variable", F.coalesce("next", "bound").alias("bound")))
    return rows


def erased(rows: DataFrame, variables: DataFrame, known: Names, primitive: list[str]) -> DataFrame:
    """``file_key, owner, scope, spelling, erased``: each distinct spelling as a resolved type without type arguments or variables, arrays marked ``[]``.

    ``rows`` has ``file_key, owner (callable or type id), scope (type id), spelling``.
    """
    each = rows.select("file_key", "owner", F.coalesce("scope", F.lit("")).alias("scope"), "spelling").where("spelling is not null").distinct()
    each = each.withColumns({"variable": plain_name(F.col("spelling")), "marks": F.regexp_extract(F.regexp_replace("spelling", r"\.\.\.$", "[]"), r"((?:\[\])*)$", 1)})
    each = each.join(variables, ["owner", "variable"], "left").withColumn("name", F.coalesce("bound", "variable"))
    asked = each.where(~F.col("name").isin(primitive)).select("file_key", "scope", F.col("name").alias("spelling"))
    found = resolve(asked, known).select("file_key", "scope", F.col("spelling").alias("name"), "resolved")
    out = each.join(found, ["file_key", "scope", "name"], "left")
    return out.select("file_key", "owner", "scope", "spelling", F.concat(F.coalesce("resolved", "name"), "marks").alias("erased"))


_WIDENED = [f"{a}<{b}" for a, wide in WIDER.items() for b in wide]
_LISTED = [f"{_lang(a)}<{_lang(b)}" for a, up in ABOVE.items() for b in up]
_BOXED = [f"{a}<{_lang(b)}" for a, box in BOXES.items() for b in [box, *ABOVE[box]]]
_UNBOXED = [f"{_lang(box)}<{b}" for a, box in BOXES.items() for b in [a, *WIDER[a]]]


def fits(pairs: DataFrame, known: Names) -> DataFrame:
    """``given, wanted, phase, doubt`` of each distinct pair where an argument of type ``given`` can go to a parameter ``wanted``.

    Phase 1 is identity, widening or subtyping, phase 2 boxing or unboxing.
    ``doubt`` is 1 where a type is unknown, or of a library whose supertypes are.
    """
    each = checkpointed(pairs.select("given", "wanted").distinct())
    base, other = F.regexp_replace("given", r"\[\]$", ""), F.regexp_replace("wanted", r"\[\]$", "")
    both = F.col("given").endswith("[]") & F.col("wanted").endswith("[]")
    each = each.withColumns({"a": F.when(both, base).otherwise(F.col("given")), "b": F.when(both, other).otherwise(F.col("wanted"))})
    above = known.above.select(F.col("type_id").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("below")).distinct()
    project = known.typed.select(F.col("type_id").alias("t"))
    libraries = known.libraries().select(F.col("type_id").alias("a"), F.lit(True).alias("open"))
    each = each.join(above, ["a", "b"], "left").join(libraries, "a", "left")
    each = each.join(project.select(F.col("t").alias("a"), F.lit(True).alias("a_own")), "a", "left").join(project.select(F.col("t").alias("b"), F.lit(True).alias("b_own")), "b", "left")
    primitives = list(WIDER)
    a, b = F.col("a"), F.col("b")
    a_simple, b_simple = a.isin(primitives), b.isin(primitives)
    pair = F.concat(a, F.lit("<"), b)
    listed = F.coalesce(F.col("below"), F.lit(False)) | pair.isin(_LISTED)
    known_up = a.isin([_lang(k) for k in ABOVE]) | (F.col("a_own").isNotNull() & F.col("open").isNull())
    sure = (
        F.when(a == b, 1)
        .when(both & (a_simple | b_simple), None)
        .when(a_simple & b_simple, F.when(pair.isin(_WIDENED), 1))
        .when(a == NULL, F.when(~b_simple, 1))
        .when(a_simple, F.when(pair.isin(_BOXED) | (b == OBJECT), 2))
        .when(b_simple, F.when(pair.isin(_UNBOXED), 2))
        .when((b == OBJECT) & ~a.isin(UNKNOWN, LAMBDA), 1)
        .when(listed, 1)
    )
    perhaps = (a == UNKNOWN) | ((a == LAMBDA) & ~b_simple & (b != _lang("String"))) | (~a.isin(LAMBDA, NULL) & ~a_simple & ~b_simple & ~known_up & F.col("b_own").isNull() & ~both)
    each = each.select("given", "wanted", sure.alias("sure"), (perhaps & ~(a_simple | (b_simple & (a != UNKNOWN)))).alias("perhaps"))
    out = each.select("given", "wanted", F.coalesce("sure", F.when(F.col("perhaps"), 1)).alias("phase"), F.when(F.col("sure").isNull(), 1).otherwise(0).alias("doubt"))
    return checkpointed(out.where("phase is not null"))


def choose(shapes: DataFrame, candidates: DataFrame, known: Names) -> DataFrame:
    """``shape, callable_id``: the callable that each call means; no row where none fits or several do equally.

    ``shapes`` has ``shape`` (an id), ``group`` and ``given (array of types)``;
    ``candidates`` ``group, callable_id, wanted (array of types), variadic``. All
    applicable by subtyping come before those that need boxing, those before a
    variable number of arguments; doubtful ones come last in each. Of several
    candidates left the one whose every parameter is below the others' is meant.
    """
    n = F.size("given")
    joined = shapes.join(candidates, "group").withColumn("n", F.size("wanted"))
    fixed = joined.where(n == F.col("n")).withColumns({"mode": F.lit(0), "params": F.col("wanted")})
    element = F.regexp_replace(F.element_at("wanted", -1), r"\[\]$", "")
    last = F.array_repeat(element, F.greatest(n - F.col("n") + 1, F.lit(0)))
    spread = joined.where(F.col("variadic") & (n >= F.col("n") - 1)).withColumns({"mode": F.lit(3), "params": F.concat(F.slice("wanted", 1, F.col("n") - 1), last)})
    calls = checkpointed(fixed.unionByName(spread).select("shape", "callable_id", "mode", "given", "params"))
    pairs = calls.select("shape", "callable_id", "mode", F.explode(F.arrays_zip("given", "params")).alias("x")).select("shape", "callable_id", "mode", F.col("x.given").alias("given"), F.col("x.params").alias("wanted"))
    level = fits(pairs, known)
    fit = pairs.join(level, ["given", "wanted"], "left").groupBy("shape", "callable_id", "mode").agg(F.max(F.col("phase").isNull()).alias("no"), F.max("phase").alias("phase"), F.max("doubt").alias("doubt"))
    graded = calls.select("shape", "callable_id", "mode", "params").join(fit, ["shape", "callable_id", "mode"], "left").where(~F.coalesce("no", F.lit(False)))
    graded = graded.select("shape", "callable_id", "params", F.struct(F.when(F.col("mode") == 3, 3).otherwise(F.coalesce("phase", F.lit(1))).alias("phase"), F.coalesce("doubt", F.lit(0)).alias("doubt")).alias("grade"))
    best = graded.groupBy("shape").agg(F.min("grade").alias("least"))
    left = checkpointed(graded.join(best, "shape").where("grade = least").select("shape", "callable_id", "params"))
    single = checkpointed(left.groupBy("shape").agg(F.count("*").alias("k"), F.min("callable_id").alias("callable_id")))
    if single.where("k > 1").isEmpty():
        return single.select("shape", "callable_id")
    several = left.join(single.where("k > 1").select("shape", "k"), "shape")
    other = several.select(F.col("shape").alias("s"), F.col("callable_id").alias("c"), F.col("params").alias("against"))
    versus = several.join(other, (F.col("shape") == F.col("s")) & (F.col("callable_id") != F.col("c"))).where(F.size("params") == F.size("against"))
    versus = versus.select("shape", "k", "callable_id", "c", F.posexplode(F.arrays_zip("params", "against")).alias("i", "x"))
    versus = checkpointed(versus.select("shape", "k", "callable_id", "c", F.col("x.params").alias("given"), F.col("x.against").alias("wanted")))
    below = versus.join(fits(versus, known).where("phase = 1 and doubt = 0"), ["given", "wanted"], "left").groupBy("shape", "k", "callable_id", "c").agg(F.min(F.col("phase").isNotNull()).alias("all_below"))
    least = below.where("all_below").groupBy("shape", "k", "callable_id").agg(F.count("*").alias("beaten")).where("beaten = k - 1")
    least = least.groupBy("shape").agg(F.count("*").alias("winners"), F.min("callable_id").alias("callable_id")).where("winners = 1")
    return checkpointed(single.where("k = 1").select("shape", "callable_id").unionByName(least.select("shape", "callable_id")))
