"""Java source trees as tables: files, tokens, scopes and the declarations in them.

Everything is columns, windows and joins. A regular expression cuts a file into
tokens; running sums over the tokens of a file give offsets, lines and brace
depths; the last open brace of a depth is what encloses a token; tokens between
braces and semicolons make segments, and the text of a segment tells what its
brace opens. Only the walk up from a brace to its type and callable, over the
few braces of one file, is a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, simple_name
from .groups import by_group

# The lexical grammar, source roots that are left out, and words that no declaration starts with.
TOKEN = (
    r"/\*[\s\S]*?\*/|//[^\r\n]*"
    r'|"""[\s\S]*?"""|"[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+"|' + r"'(?:[^'\\\r\n]|\\[^'\r\n]*'?)'"
    r"|[\p{L}_$][\p{L}\p{N}_$]*|\.?\d[\w.]*"
    r"|->|::|\.\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/&|^%]=|\s+|[\s\S]"
)
EXCLUDED_ROOTS = ["src/test/resources", "src/it/resources", "src/xdocs-examples"]
CONTROL = "if for while switch catch synchronized try do else return throw new case default assert finally yield instanceof super this".split()
MODIFIERS = "public protected private static final abstract native synchronized transient volatile strictfp default sealed".split()
JAVA_LANG = (
    "Object String StringBuilder StringBuffer CharSequence Comparable Iterable Runnable Thread Math System Integer Long Short Byte Character Boolean Double Float Number "
    "Void Class Enum Record Exception RuntimeException Error Throwable IllegalArgumentException IllegalStateException NullPointerException IndexOutOfBoundsException "
    "UnsupportedOperationException ClassCastException ArithmeticException InterruptedException CloneNotSupportedException Override Deprecated SuppressWarnings FunctionalInterface SafeVarargs AutoCloseable Cloneable Process"
).split()
INTERFACES = "Runnable Comparable Iterable CharSequence AutoCloseable Cloneable Appendable Readable".split()
PRIMITIVE = "int long short byte char boolean double float void var".split()


def scan_files(spark: SparkSession, path: str, app: str | None = None) -> DataFrame:
    """``app, file_key, source, content_hash, size_bytes`` of every ``.java`` file below ``path``."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root)
    key = F.regexp_replace(F.substring_index("path", root.split(":")[-1] + "/", -1), "^/+", "")
    return from_rows(files.select(F.lit(app or root.rsplit("/", 1)[-1]).alias("app"), key.alias("file_key"), F.decode("content", "UTF-8").alias("source")))


# Parts of paths that a listing of sources leaves out.
UNLISTED = ["build/", "target/", "main/resources/", "test/resources/"]


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path, size_bytes`` of the files below ``root`` with ``suffix`` (java, class or jar); no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    below = F.substring_index("path", root.split(":")[-1], -1)
    left_out = F.lit(False)
    for part in UNLISTED if suffix == "java" else []:
        left_out = left_out | below.contains(part)
    return found.where(~left_out).select("path", F.col("length").alias("size_bytes"))


def from_rows(rows: DataFrame) -> DataFrame:
    """The table of files from ``app, file_key, source``, without excluded roots."""
    keep = ~F.col("file_key").rlike("|".join(f"(^|/){r}(/|$)" for r in EXCLUDED_ROOTS))
    return rows.where(keep).withColumns({"content_hash": content_hash("source"), "size_bytes": F.octet_length("source").cast("long")})


def only_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The target files alone."""
    return files.join(keys.select("file_key").distinct(), "file_key", "left_semi")


def tokens(files: DataFrame) -> DataFrame:
    """``file_key, n, text, kind, start, line, col, end_line, end_col``: all but white space; comments too."""
    raw = files.select("file_key", F.posexplode(F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0))).alias("n", "text"))
    before = Window.partitionBy("file_key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size, breaks = F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    raw = raw.withColumns({"start": F.coalesce(F.sum(size).over(before), F.lit(0)), "byte": F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)), "line": F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1, "breaks": breaks})
    after_break = F.when(F.col("breaks") > 0, F.col("start") + size - F.length(F.substring_index("text", "\n", -1)))
    raw = raw.withColumn("line_start", F.coalesce(F.max(after_break).over(before), F.lit(0)))
    kind = (
        F.when(F.col("text").rlike(r"^\s"), "space")
        .when(F.col("text").rlike("^/[/*]"), "comment")
        .when(F.col("text").rlike("^[\"']"), "literal")
        .when(F.col("text").rlike(r"^\.?\d"), "number")
        .when(F.col("text").rlike(r"^[\p{L}_$]"), "word")
        .otherwise("mark")
    )
    col = F.col("start") - F.col("line_start") + 1
    end_col = F.when(F.col("breaks") > 0, F.length(F.substring_index("text", "\n", -1))).otherwise(col + size - 1)
    out = raw.select("file_key", "n", "text", kind.alias("kind"), "start", "byte", "line", col.alias("col"), (F.col("line") + F.col("breaks")).alias("end_line"), end_col.alias("end_col"))
    return out.where("kind != 'space'")


def comments(all_tokens: DataFrame) -> DataFrame:
    """``file_key, content, is_javadoc``, the span of each comment, and ``first``: the code token after the last of several in a row."""
    order = Window.partitionBy("file_key").orderBy("n")
    code = F.first(F.when(F.col("kind") != "comment", F.col("n")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    followed = F.lead("kind").over(order) != "comment"
    all_tokens = all_tokens.withColumn("first", F.when(followed, code))
    content = F.trim(F.regexp_replace(F.regexp_replace("text", r"^(//|/\*+)|\*+/$", ""), r"(?m)^\s*\*", ""))
    found = all_tokens.where("kind = 'comment'")
    return found.select("file_key", content.alias("content"), F.col("text").startswith("/**").alias("is_javadoc"), "line", "col", "end_line", "end_col", "first")


#: Stand for the braces of array values, which enclose no statements.
_ARRAY = "\u0002\u0003"


def _array_braces(code: DataFrame) -> DataFrame:
    """``code`` with other marks for the braces of array values: those after a bracket, a comma, ``=`` or ``default``."""
    order = Window.partitionBy("file_key").orderBy("n")
    braces = code.withColumn("opens_array", F.lag("text").over(order).isin("(", ",", "=", "]", "default")).where("text in ('{', '}')")
    is_open = F.col("text") == "{"
    depth = F.sum(F.when(is_open, 1).otherwise(-1)).over(order) + F.when(is_open, 0).otherwise(1)
    paired = F.lag("opens_array").over(Window.partitionBy("file_key", "depth").orderBy("n"))
    braces = braces.withColumn("depth", depth).withColumn("is_array", F.when(is_open, F.col("opens_array")).otherwise(paired))
    found = braces.where("is_array").select("file_key", "n", "is_array")
    return code.join(found, ["file_key", "n"], "left").withColumn("text", F.when(F.col("is_array"), F.translate("text", "{}", _ARRAY)).otherwise(F.col("text"))).drop("is_array")


def _restored(text: Column) -> Column:
    return F.translate(text, _ARRAY, "{}")


def enclosed(all_tokens: DataFrame) -> DataFrame:
    """Code tokens with ``brace`` (the open brace that encloses each, -1 for none), ``segment`` and neighbours.

    An open brace belongs to the segment that it ends and is enclosed by the
    brace around it; so does a closing one.
    """
    code = _array_braces(all_tokens.where("kind != 'comment'"))
    order = Window.partitionBy("file_key").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_open, is_close = F.col("text") == "{", F.col("text") == "}"
    step = lambda opens, closes: F.when(F.col("text").isin(*opens), 1).when(F.col("text").isin(*closes), -1).otherwise(0)
    code = code.withColumn("depth", F.coalesce(F.sum(step("{", "}")).over(before), F.lit(0)) - is_close.cast("int"))
    code = code.withColumn("level", F.coalesce(F.sum(step("{([", "})]")).over(before), F.lit(0)) - F.col("text").isin("}", ")", "]").cast("int"))
    # The last brace that leads to this depth, and the last bracket of any kind that leads to this level.
    inside = Window.partitionBy("file_key", "key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda wanted: F.last(F.when(wanted, F.col("n")), True).over(inside)
    code = code.withColumn("key", F.col("depth") + is_open.cast("int"))
    opener = code.where(is_open).select("file_key", F.col("n").alias("o"), F.col("key").alias("d"))
    marked = code.select("*", F.lit(False).alias("__opener")).withColumn("key", F.col("depth"))
    marked = marked.unionByName(
        opener.select("file_key", F.col("o").alias("n"), F.col("d").alias("key"), F.lit(True).alias("__opener")), allowMissingColumns=True
    )
    marked = marked.withColumn("brace", F.coalesce(last(F.col("__opener")), F.lit(-1))).where("not __opener").drop("__opener", "key")
    opened = F.col("text").isin("{", "(", "[")
    levels = marked.withColumn("key", F.col("level"))
    marks = marked.where(opened).select("file_key", "n", (F.col("level") + 1).alias("key"), F.col("text").alias("bracket"), F.lit(True).alias("__opener"))
    levels = levels.withColumn("__opener", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    bracket = F.last(F.when(F.col("__opener"), F.col("bracket")), True).over(inside)
    levels = levels.withColumn("within", F.coalesce(bracket, F.lit("{"))).where("not __opener").drop("__opener", "bracket", "key")
    ends = (F.col("text").isin("{", "}") | ((F.col("text") == ";") & (F.col("within") == "{"))).cast("int")
    levels = levels.withColumn("segment", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    beside = {"before": F.lag("text").over(order), "before2": F.lag("text", 2).over(order), "after": F.lead("text").over(order), "after_n": F.lead("n").over(order)}
    # What stands before a name and its qualifiers.
    other = ~(((F.col("kind") == "word") & (F.col("text") != "new")) | (F.col("text") == "."))
    return levels.withColumns(beside | {"stem": F.last(F.when(other, F.struct("n", "text")), True).over(before)})


def segments(code: DataFrame) -> DataFrame:
    """``file_key, segment, brace, first, last, ends, body``: statements and headers, tokens joined by one space."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    out = code.groupBy("file_key", "segment").agg(
        texts.alias("texts"), F.max("brace").alias("brace"), F.min("n").alias("first"), F.max("n").alias("last"), F.min("line").alias("line"), F.max("end_line").alias("end_line")
    )
    stop = F.element_at("texts", -1)
    closed = stop.isin("{", "}", ";")
    body = F.array_join(F.when(closed, F.slice("texts", F.lit(1), F.size("texts") - 1)).otherwise(F.col("texts")), " ")
    return out.select("file_key", "segment", "brace", "first", "last", "line", "end_line", F.when(closed, stop).otherwise("").alias("ends"), body.alias("body"))


_ANNOTATION = r"@ (?!interface\b)[\w$]+( \. [\w$]+)*( \((?: [^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)? ?\))?"


def annotations_of(body: Column) -> Column:
    """Annotations of a header as compact text."""
    return F.transform(F.regexp_extract_all(body, F.lit(_ANNOTATION), F.lit(0)), lambda x: _restored(F.regexp_replace(x, rf" ?([@.(){_ARRAY}]) ?", "$1")))


def decorators(annotations: Column) -> Column:
    """Array of (name, args) of annotations: each argument as ``key=value`` or its value alone."""

    def one(text: Column) -> Column:
        inside = F.regexp_replace(F.regexp_extract(text, r"(?s)\((.*)\)$", 1), r"^ +| +$", "")
        for opening, closing in ("{}", "()"):
            inside = F.regexp_replace(inside, rf"(\{opening}[^\{opening}\{closing}]*),([^\{opening}\{closing}]*\{closing})", "$1\u0001$2")
        args = F.transform(F.split(inside, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.regexp_replace(F.trim(F.replace(x, F.lit("\u0001"), F.lit(","))), r"^([\w$]+) ?= ?", "$1="))
        return F.struct(F.regexp_extract(text, r"^@([\w$.]+)", 1).alias("name"), F.filter(args, lambda x: x != "").alias("args"))

    return F.transform(annotations, one)


def bare(body: Column) -> Column:
    """A header without annotations."""
    return F.trim(F.regexp_replace(body, _ANNOTATION + " ?", ""))


def _without_arguments(text: Column, rounds: int = 4) -> Column:
    """A spelling without type arguments."""
    for _ in range(rounds):
        text = F.regexp_replace(text, r" ?<[^<>]*>", "")
    return text


def _protected(text: Column, rounds: int = 4) -> Column:
    """Commas inside type arguments as semicolons, so that commas split a list."""
    for _ in range(rounds):
        text = F.regexp_replace(text, r"(<[^<>]*),([^<>]*>)", "$1;$2")
    return text


def _spelled(text: Column) -> Column:
    """Tokens of a type put together again."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(";"), F.lit(",")), r" ?([.,<>\[\]]) ?", "$1"))


def _type_parameters(text: Column) -> Column:
    """Array of (name, bounds) of ``< T , U extends A & B >``, in order; no bounds where none are named."""
    inside = F.regexp_replace(F.replace(text, F.lit(";"), F.lit(",")), r"^ ?<|>$", "")
    items = F.filter(F.split(_protected(inside), ","), lambda x: F.trim(x) != "")

    def one(item: Column) -> Column:
        plain = F.trim(bare(item))
        bounds = F.split(F.regexp_extract(plain, r"^[\w$]+ extends (.*)$", 1), " & ")
        return F.struct(F.regexp_extract(plain, r"^([\w$]+)", 1).alias("name"), F.filter(F.transform(bounds, _spelled), lambda x: x != "").alias("bounds"))

    return F.transform(items, one)


def _owners(opens: list[int], braces: list[int], kinds: list[str], names: list[str]) -> list[tuple]:
    """For each brace of one file: the type, callable and named path around it and its own."""
    known: dict[int, tuple] = {-1: (None, None, "")}
    rows = []
    for open_, brace, kind, name in zip(opens, braces, kinds, names, strict=True):
        of_type, of_callable, path = known.get(brace, known[-1])
        own = (of_type, of_callable, path)
        if kind == "type":
            own = (open_, None, f"{path}.{name}" if path else name)
        elif kind == "callable":
            own = (of_type, open_, path)
        known[open_] = own
        rows.append((open_, of_type, of_callable, path, *own))
    return rows


def scopes(code: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each brace: ``kind`` (type, callable, block), what it declares, and its owners."""
    heads = parts.where("ends = '{'").select("file_key", F.col("last").alias("open"), "brace", "line", "first", "body").withColumn("text", bare(F.col("body")))
    declared = F.regexp_extract("text", r"(?:^|.* )(class|interface|enum|record|@ interface) ([\w$]+)", 1)
    head = F.regexp_extract("text", r"^((?:[^()=]|\([^()]*\)(?= ))*?)([\w$]+) \(", 2)
    first_word = F.regexp_extract("text", r"^(?:(?:" + "|".join(MODIFIERS) + r") )*([\w$]+)", 1)
    created = F.regexp_extract("text", r"(?:^|.* )new ([\w$. ]+?)(?: <[^()]*>)? \((?:[^()]|\([^()]*\))*\)$", 1)
    is_type = (declared != "") & ~F.col("text").rlike(r"[=(].*\b(class|interface|enum|record)\b")
    method = (head != "") & ~first_word.isin(*CONTROL) & ~head.isin(*CONTROL) & ~F.col("text").rlike(r"(^|[^=!<>])=([^=]|$)|->|\bnew\b|^\. |^\) ")
    kind = F.when(is_type, "type").when(created != "", "anonymous").when(method, "method").when(F.col("text").isin("", "static"), "initializer").otherwise("block")
    heads = heads.withColumns({"shape": kind, "declares": declared, "name": F.when(is_type, F.regexp_extract("text", r"(?:class|interface|enum|record|@ interface) ([\w$]+)", 1)).otherwise(head), "created": created})
    # In an enum, a name that is not the enum's, with arguments or without, is a constant with a body.
    enums = heads.where("shape = 'type' and declares = 'enum'").select(F.col("file_key").alias("f"), F.col("open").alias("o"), F.col("name").alias("enum_name"))
    constant = F.regexp_extract("text", r"^(?:.*, )?([\w$]+)(?: \([^()]*(?:\([^()]*\)[^()]*)*\))?$", 1)
    heads = heads.join(enums, (F.col("file_key") == F.col("f")) & (F.col("brace") == F.col("o")), "left").drop("f", "o").withColumn("constant", constant)
    is_constant = (F.col("constant") != "") & (F.col("constant") != F.col("enum_name")) & F.col("shape").isin("method", "block")
    heads = heads.withColumn("shape", F.when(is_constant, "constant").otherwise(F.col("shape")))
    # A method or initializer lies right in a type; a lone name in a record is its compact constructor.
    around = heads.select(F.col("file_key").alias("f"), F.col("open").alias("o"), F.col("shape").alias("outer_shape"), F.col("name").alias("outer_name"))
    heads = heads.join(around, (F.col("file_key") == F.col("f")) & (F.col("brace") == F.col("o")), "left")
    in_type = F.col("outer_shape").isin("type", "anonymous", "constant")
    lone = F.regexp_extract("text", r"^(?:(?:public|protected|private) )?([\w$]+)$", 1)
    compact = (F.col("outer_shape") == "type") & (lone != "") & (lone == F.col("outer_name"))
    named_alike = (F.col("outer_shape") == "type") & (F.col("name") == F.col("outer_name"))
    heads = heads.withColumn(
        "kind", F.when(F.col("shape").isin("type", "anonymous", "constant"), "type").when(in_type & (F.col("shape").isin("method", "initializer") | F.coalesce(compact, F.lit(False))), "callable").otherwise("block")
    )
    number = F.row_number().over(Window.partitionBy("file_key", "brace", "shape").orderBy("open")) - 1
    heads = heads.withColumn("ordinal", number)
    label = (
        F.when(F.col("shape") == "anonymous", F.concat(F.lit("$anon$"), F.col("ordinal")))
        .when(F.col("shape") == "constant", F.concat(F.lit("$enum$"), F.col("constant")))
        .when((F.col("kind") == "callable") & (F.col("shape") == "initializer"), F.concat(F.when(F.col("text") == "static", "<clinit>$").otherwise("<instance-init>$"), F.col("ordinal")))
        .when(F.coalesce(compact, F.lit(False)) | ((F.col("kind") == "callable") & F.coalesce(named_alike, F.lit(False))), "<init>")
        .otherwise(F.col("name"))
    )
    heads = heads.withColumn("name", label).drop("f", "o", "outer_shape", "outer_name")
    schema = "file_key string, open int, outer_type int, outer_callable int, outer_path string, in_type int, in_callable int, path string"
    paths = by_group(heads.select("file_key", "open", F.col("brace").cast("int").alias("brace"), "kind", "name"), ["file_key"], ["open"], _owners, schema)
    # A closing brace is enclosed by what is around its pair; the pair is the last open brace of that depth before it.
    pairs = code.where("text in ('{', '}')").withColumn("pair", F.lag("n").over(Window.partitionBy("file_key", "depth").orderBy("n")))
    closing = pairs.where("text = '}'").select("file_key", F.col("pair").alias("open"), F.col("n").alias("close"), F.col("end_line").alias("close_line"))
    return heads.join(paths, ["file_key", "open"]).join(closing, ["file_key", "open"], "left")


def packages(parts: DataFrame) -> DataFrame:
    name = F.replace(F.regexp_extract("body", r"package ([\w. $]+)$", 1), F.lit(" "), F.lit(""))
    return parts.where("brace = -1 and ends = ';'").where(bare(F.col("body")).startswith("package ")).groupBy("file_key").agg(F.max(name).alias("package"))


def imports(parts: DataFrame) -> DataFrame:
    """``file_key, path, name, is_static, is_wildcard``; the path of a wildcard ends before it."""
    rows = parts.where("brace = -1 and ends = ';'").where(F.col("body").startswith("import "))
    text = F.replace(F.regexp_replace("body", r"^import (static )?", ""), F.lit(" "), F.lit(""))
    rows = rows.select("file_key", "segment", F.regexp_replace(text, r"\.\*$", "").alias("path"), F.col("body").startswith("import static ").alias("is_static"), text.endswith(".*").alias("is_wildcard"))
    return rows.withColumn("name", simple_name("path")).withColumn("ordinal", F.row_number().over(Window.partitionBy("file_key").orderBy("segment")) - 1).drop("segment")


def _type_list(text: Column) -> Column:
    items = F.split(_protected(text), " ?, ?")
    return F.filter(F.transform(items, _spelled), lambda x: x != "")


def types(scope: DataFrame, package: DataFrame) -> DataFrame:
    """``type_id`` (qualified name), ``kind, name, parent_id`` and header facts of each type."""
    found = scope.where("kind = 'type'").join(package, "file_key", "left")
    qualified = lambda path: F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), path)
    text = F.regexp_replace("text", r"^.*?\b(class|interface|enum|record) ", "")
    plain = F.regexp_replace(_protected(text), r"^([\w$]+)( <.*?>(?= (extends|implements|permits|\()|$))?", "$1")
    generic = F.regexp_extract(_protected(text), r"^[\w$]+ (<.*?>)(?= (extends|implements|permits|\()|$)", 1)
    clause = lambda word: F.regexp_extract(plain, rf"\b{word} (.*?)( (?:extends|implements|permits) |$)", 1)
    kind = F.when(F.col("shape").isin("anonymous", "constant"), "class").when(F.col("declares") == "@ interface", "annotation").otherwise(F.col("declares"))
    extends = F.when(F.col("shape") == "anonymous", F.array(_spelled(F.col("created")))).when(F.col("shape") == "constant", F.array("enum_name")).otherwise(_type_list(clause("extends")))
    return found.select(
        "file_key",
        F.col("open").alias("scope"),
        qualified(F.col("path")).alias("type_id"),
        F.when(F.col("outer_path") != "", qualified(F.col("outer_path"))).alias("parent_id"),
        F.col("name"),
        kind.alias("kind"),
        F.coalesce("package", F.lit("")).alias("package"),
        F.filter(F.split("text", " "), lambda w: w.isin(*MODIFIERS)).alias("modifiers"),
        annotations_of(F.col("body")).alias("annotations"),
        extends.alias("extends_list"),
        F.when(F.col("shape").isin("anonymous", "constant"), F.array().cast("array<string>")).otherwise(_type_list(clause("implements"))).alias("implements_list"),
        F.when(F.col("declares") == "record", F.regexp_extract("text", r"\((.*)\)", 1)).alias("components"),
        _type_parameters(generic).alias("type_parameters"),
        "first",
        F.col("close").alias("last"),
        F.col("outer_callable").isNotNull().alias("is_local_class"),
        F.col("line").alias("start_line"),
        F.col("close_line").alias("end_line"),
    )


def _parameters(text: Column) -> Column:
    """Array of (name, type, is_variadic) of a parameter list without annotations."""
    items = F.filter(F.split(_protected(text), " ?, ?"), lambda x: F.trim(x) != "")

    def one(item: Column) -> Column:
        plain = F.trim(F.regexp_replace(item, r"\bfinal ", ""))
        name = F.regexp_extract(plain, r"([\w$]+)( \[ \])*$", 1)
        kind = F.regexp_replace(plain, r" ?(\.\.\.)? ?[\w$]+( \[ \])*$", "")
        return F.struct(name.alias("name"), _spelled(kind).alias("type"), plain.contains("...").alias("is_variadic"))

    return F.transform(items, one)


def callables(scope: DataFrame, typed: DataFrame, parts: DataFrame) -> DataFrame:
    """Methods, constructors and initializers, also those without a body; ``signature`` has erased parameter types."""
    with_body = scope.where("kind = 'callable'").select("file_key", F.col("in_type").alias("scope"), F.col("open"), "name", "shape", "text", "body", "first", F.col("close").alias("last"), F.col("line").alias("start_line"), F.col("close_line").alias("end_line"))
    owners = typed.select("file_key", "scope", "type_id", F.col("kind").alias("owner_kind"), F.col("components"))
    abstract = parts.where("ends = ';'").withColumn("text", bare(F.col("body"))).where(F.col("text").rlike(r"^[^=]*[\w$] \([^=]*\)( throws [\w$., ]+)?( default .*)?$") & ~F.col("text").rlike(r"^(return|throw|new|this|super|assert)\b|\bnew\b|->"))
    abstract = abstract.where(F.col("text").rlike(r"^[\w$<>\[\]., ?&]+ [\w$]+ \(")).withColumn("scope", F.col("brace"))
    abstract = abstract.select("file_key", "scope", F.lit(None).cast("int").alias("open"), F.regexp_extract("text", r"([\w$]+) \(", 1).alias("name"), F.lit("method").alias("shape"), "text", "body", "first", "last", F.col("line").alias("start_line"), "end_line")
    rows = with_body.unionByName(abstract).join(owners, ["file_key", "scope"])
    compact = (F.col("name") == "<init>") & ~F.col("text").contains("(")
    listed = F.when(compact, F.col("components")).otherwise(F.regexp_extract("text", r"\((.*?)\)(?: throws|(?: \[ \])*$| default)", 1))
    before = F.regexp_replace(F.regexp_extract("text", r"^(.*?)[\w$]+ \(", 1), r"\b(" + "|".join(MODIFIERS) + r") ", "")
    generic = F.regexp_extract(before, r"^(<.*?>) [\w$]", 1)
    returns = _spelled(F.when(generic != "", F.expr("substring(before, length(generic) + 1)")).otherwise(F.col("before")))
    rows = rows.withColumns({"parameters": _parameters(bare(F.coalesce(listed, F.lit("")))), "before": before}).withColumn("generic", F.regexp_extract("before", r"^(<.*?>) [\w$]", 1))
    rows = rows.withColumn("return_type", F.when(F.col("name").startswith("<"), F.lit(None)).otherwise(returns))
    erased = F.transform("parameters", lambda p: F.concat(_without_arguments(p["type"]), F.when(p["is_variadic"], "[]").otherwise("")))
    return rows.select(
        "file_key",
        "type_id",
        "owner_kind",
        "open",
        F.col("name"),
        F.when(F.col("name") == "<init>", "constructor").when(F.col("shape") == "initializer", "initializer").otherwise("method").alias("kind"),
        F.concat("name", F.lit("("), F.array_join(erased, ", "), F.lit(")")).alias("signature"),
        "parameters",
        F.transform("parameters", lambda p: p["type"]).alias("parameter_types"),
        "return_type",
        F.filter(F.split("text", " "), lambda w: w.isin(*MODIFIERS)).alias("modifiers"),
        annotations_of(F.col("body")).alias("annotations"),
        _type_list(F.regexp_extract("text", r"\) throws ([\w$., ]+)", 1)).alias("thrown"),
        _type_parameters(F.col("generic")).alias("type_parameters"),
        F.when(F.col("shape") != "initializer", F.trim(F.regexp_replace(_spelled(F.col("text")), r" ?([()]) ?", "$1"))).alias("declaration"),
        F.lit(False).alias("is_implicit"),
        "first",
        "last",
        "start_line",
        "end_line",
    )


def with_implicit_constructors(found: DataFrame, typed: DataFrame) -> DataFrame:
    """Adds ``<init>()`` to classes and enums without a constructor, and a record's canonical one unless it is there."""
    plain = typed.where("kind in ('class', 'enum') and name not like '$anon$%' and name not like '$enum$%'").join(found.where("kind = 'constructor'").select("type_id"), "type_id", "left_anti")
    record = typed.where("kind = 'record'").withColumn("parameters", _parameters(bare(F.coalesce("components", F.lit("")))))
    erased = F.transform("parameters", lambda p: F.concat(_without_arguments(p["type"]), F.when(p["is_variadic"], "[]").otherwise("")))
    record = record.withColumn("signature", F.concat(F.lit("<init>("), F.array_join(erased, ", "), F.lit(")"))).join(found.select("type_id", "signature"), ["type_id", "signature"], "left_anti")
    made = plain.withColumns({"signature": F.lit("<init>()"), "parameters": F.array().cast("array<struct<name:string,type:string,is_variadic:boolean>>")})
    columns = ["file_key", "type_id", "signature", "parameters"]
    made = made.select(*columns, F.col("kind").alias("owner_kind")).unionByName(record.select(*columns, F.col("kind").alias("owner_kind")))
    made = made.withColumns({"name": F.lit("<init>"), "kind": F.lit("constructor"), "is_implicit": F.lit(True), "parameter_types": F.transform("parameters", lambda p: p["type"])})
    empty = F.array().cast("array<string>")
    return found.unionByName(made.withColumns({"modifiers": empty, "annotations": empty, "thrown": empty}), allowMissingColumns=True)


def variables(scope: DataFrame, parts: DataFrame, code: DataFrame) -> DataFrame:
    """``file_key, scope, owner, name, type, equals_n, line``: fields (owner ``field``) and locals, a row for each variable; ``equals_n`` is the sign before its initializer."""
    places = scope.select("file_key", F.col("open").alias("brace"), F.col("in_type"), F.col("in_callable"), F.col("kind").alias("place"))
    rows = parts.where("ends in (';', '{')").withColumn("text", F.regexp_replace(bare(F.col("body")), r"^(for|try) \( ?", "")).join(places, ["file_key", "brace"])
    shape = r"^(?:(?:" + "|".join(MODIFIERS) + r") )*([\w$]+(?: \. [\w$]+)*(?: <[\w$<>\[\]., ?&]*>)?(?: \[ \])*) ([\w$]+)(?: \[ \])*(?: (=|:) (.*?)|( ,.*))?$"
    kind = F.regexp_extract("text", shape, 1)
    rows = rows.withColumns({"type_text": kind, "name": F.regexp_extract("text", shape, 2), "value": F.regexp_extract("text", shape, 4), "more": F.regexp_extract("text", shape, 5)})
    words = F.split("type_text", " ")
    rows = rows.where((F.col("name") != "") & ~F.get(words, 0).isin(*CONTROL, "package", "import", "class", "interface", "enum", "record", "break", "continue", "goto"))
    # More variables follow a comma that is in no call, type arguments or text.
    flat = F.regexp_replace(F.coalesce("value", F.lit("")), r"\([^()]*(\([^()]*\)[^()]*)*\)|<[^<>]*>|\"[^\"]*\"", "")
    later = F.slice(F.split(F.concat(flat, "more"), " , ?"), 2, 1000)
    names = F.concat(F.array("name"), F.filter(F.transform(later, lambda x: F.regexp_extract(x, r"^ ?([\w$]+)(?: =.*|(?: \[ \])*)$", 1)), lambda x: x != ""))
    signs = code.where("kind = 'word' and after = '='").groupBy("file_key", "segment", F.col("text").alias("name")).agg(F.min("after_n").alias("equals_n"))
    rows = rows.select(
        "file_key",
        "segment",
        F.when(F.col("place") == "type", F.lit("field")).otherwise("local").alias("owner"),
        "in_type",
        "in_callable",
        F.explode(names).alias("name"),
        _spelled(F.col("type_text")).alias("type"),
        "first",
        "line",
    )
    return rows.join(signs, ["file_key", "segment", "name"], "left").drop("segment")


def source_texts(files: DataFrame, code: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``file_key, id`` and ``name``: the source text of each span from token ``begin_n`` to ``close_n``; a file's text is read once."""
    place = code.select("file_key", "n", "start", F.length("text").alias("size"))
    begin = place.select("file_key", F.col("n").alias("begin_n"), F.col("start").alias("from_at"))
    end = place.select("file_key", F.col("n").alias("close_n"), (F.col("start") + F.col("size")).alias("to_at"))
    at = spans.join(begin, ["file_key", "begin_n"]).join(end, ["file_key", "close_n"])
    each = at.groupBy("file_key").agg(F.collect_list(F.struct("id", "from_at", "to_at")).alias("spans")).join(files.select("file_key", "source"), "file_key")
    cut = F.transform("spans", lambda s: F.struct(s["id"].alias("id"), F.substring(F.col("source"), (s["from_at"] + 1).cast("int"), (s["to_at"] - s["from_at"]).cast("int")).alias(name)))
    return each.select("file_key", F.explode(cut).alias("x")).select("file_key", "x.*")


def byte_spans(rows: DataFrame, code: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """``rows`` with ``start_byte, end_byte``: the UTF-8 bytes ``[from, to)`` from token ``first`` to token ``last``."""
    begin = code.select("file_key", F.col("n").cast("long").alias(first), F.col("byte").alias("start_byte"))
    end = code.select("file_key", F.col("n").cast("long").alias(last), (F.col("byte") + F.octet_length("text")).alias("end_byte"))
    typed = rows.withColumns({first: F.col(first).cast("long"), last: F.col(last).cast("long")})
    return typed.join(begin, ["file_key", first], "left").join(end, ["file_key", last], "left").select(*rows.columns, "start_byte", "end_byte")


def creations(code: DataFrame) -> DataFrame:
    """``file_key, n, created_type, thrown, open_n``: each ``new`` with a bracket, also of qualified and generic types.

    ``n`` is the last word of the name, ``open_n`` the bracket of the arguments;
    ``thrown`` tells whether ``throw`` stands before it.
    """
    chain = code.where("stem.text = 'new' and kind = 'word' and text != 'new'")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), ".")
    last = F.max(F.struct("n", "after", "after_n"))
    made = chain.groupBy("file_key", "stem.n").agg(names.alias("created_type"), last.alias("last"), (F.min(F.struct(F.col("n"), F.col("before2").alias("b")))["b"] == "throw").alias("thrown"))
    # The bracket that closes type arguments is the next one that leads back to the same level.
    order = Window.partitionBy("file_key").orderBy("n")
    angles = code.where("text in ('<', '>')").withColumn("angle", F.sum(F.when(F.col("text") == "<", 1).otherwise(-1)).over(order) + (F.col("text") == ">").cast("int"))
    partner = F.lead(F.struct("text", "after", "after_n")).over(Window.partitionBy("file_key", "angle").orderBy("n"))
    pairs = angles.withColumn("partner", partner).where("text = '<' and partner.text = '>' and partner.after = '('").select("file_key", F.col("n").alias("angle_n"), F.col("partner.after_n").alias("generic_n"))
    found = made.select("file_key", "created_type", "thrown", "last.*").withColumn("angle_n", F.when(F.col("after") == "<", F.col("after_n"))).join(pairs, ["file_key", "angle_n"], "left")
    return found.where("after = '(' or generic_n is not null").select("file_key", "n", "created_type", F.coalesce("thrown", F.lit(False)).alias("thrown"), F.coalesce("generic_n", "after_n").alias("open_n"))


def call_sites(code: DataFrame, scope: DataFrame) -> DataFrame:
    """Calls and creations: name, receiver word, anchor ``line:col`` and the callable around them."""
    named = (F.col("kind") == "word") & (F.col("after") == "(") & ~F.col("text").isin(*[w for w in CONTROL if w not in ("this", "super")])
    places = scope.select("file_key", F.col("open").alias("brace"), "in_type", "in_callable", F.col("kind").alias("place"))
    # Right in a type only initializers call: what stands behind an equals sign of its statement.
    equals = code.where((F.col("text") == "=") & (F.col("within") == "{")).groupBy("file_key", "segment").agg(F.min("n").alias("equals"))
    found = code.where((F.col("kind") == "word") & F.col("after").isin("(", "<")).join(creations(code).drop("thrown"), ["file_key", "n"], "left")
    created = F.col("created_type").isNotNull()
    found = found.where(named | created).join(places, ["file_key", "brace"]).join(equals, ["file_key", "segment"], "left")
    found = found.where((F.col("place") != "type") | (F.col("n") > F.col("equals")))
    call = created | F.col("before").isin(".", "(", ",", "=", ";", "{", "}", "!", "&&", "||", "+", "-", "?", ":", "return", "->", ")", "==", "!=", "<", ">", "*", "/", "throw", "else", "[", "%", "+=")
    receiver = F.when(~created & (F.col("before") == ".") & F.col("before2").rlike(r"^[\w$\"]"), F.col("before2"))
    own = F.col("text").isin("this", "super") & (F.col("before") != ".")
    return found.where(call & F.col("in_type").isNotNull()).select(
        "file_key",
        "in_type",
        "in_callable",
        F.when(created | own, "<init>").otherwise(F.col("text")).alias("method_name"),
        "created_type",
        receiver.alias("receiver"),
        (created | own).alias("is_constructor_call"),
        F.col("text").alias("word"),
        F.concat_ws(":", "line", "col").alias("local_id"),
        F.coalesce("open_n", "after_n").alias("open_n"),
        "n",
        F.when(~created & (F.col("before") == "."), F.col("stem.n")).alias("stem_n"),
        F.when(~created & (F.col("before") == "."), F.col("stem.text")).alias("stem"),
        "line",
        "col",
    )


def receiver_paths(code: DataFrame, sites: DataFrame) -> DataFrame:
    """``file_key, n, path, rooted``: the words before each call with a receiver, and whether they begin the receiver (else what is before them does)."""
    asked = sites.where("stem_n is not null").select("file_key", "n", "stem_n")
    words = code.where("kind = 'word' and after = '.'").select("file_key", F.col("stem.n").alias("stem_n"), F.struct(F.col("n").alias("at"), "text", "before").alias("word"))
    near = asked.join(words, ["file_key", "stem_n"]).where("word.at < n").groupBy("file_key", "n").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return near.select("file_key", "n", F.transform("words", lambda w: w["text"]).alias("path"), (F.get("words", 0)["before"] != ".").alias("rooted"))


def bound_names(parts: DataFrame, scope: DataFrame) -> DataFrame:
    """``file_key, in_callable, name, type, first``: names that patterns and catch clauses of callables bind."""
    rest = r"(?: \. [\w$]+)*(?: <[\w$<>\[\]., ?&]*>)?(?: \[ \])*"
    pattern = F.regexp_extract_all("body", F.lit(rf"\binstanceof (?:final )?[\w$]+{rest} (?!instanceof\b)[\w$]+(?= [&)|?;:]|$)"), F.lit(0))
    caught = F.regexp_extract_all("body", F.lit(rf"\bcatch \( (?:final )?[\w$]+{rest} [\w$]+ \)"), F.lit(0))
    texts = F.transform(F.concat(pattern, caught), lambda x: F.regexp_replace(x, r"^(?:instanceof|catch \() (?:final )?| \)$", ""))
    found = parts.select("file_key", "brace", "first", F.explode(texts).alias("text"))
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), "in_callable")
    kind = _spelled(F.regexp_extract("text", r"^(.*) [\w$]+$", 1))
    return found.join(places, ["file_key", "brace"]).select("file_key", "in_callable", F.regexp_extract("text", r" ([\w$]+)$", 1).alias("name"), kind.alias("type"), "first")


def _written(tokens: list[str]) -> str:
    """Tokens of an expression as source text, a blank only where two words would meet."""
    out = ""
    for token in tokens:
        out += " " + token if out and (out[-1].isalnum() or out[-1] in "_$") and (token[0].isalnum() or token[0] in "_$") else token
    return out.replace(_ARRAY[0], "{").replace(_ARRAY[1], "}")


#: Words after which an expression begins.
_BEFORE = {"return", "throw", "case", "else", "assert", "yield", "do", "instanceof"}


def _arguments(numbers: list[int], texts: list[str], places: list[str], calls: list[bool], values: list[bool]) -> list[tuple]:
    """The calls of one file: arguments, and where each call's expression begins and ends.

    Commas in brackets and type arguments split nothing. A call is the whole of an
    argument if its expression begins and ends with it. ``head`` is the text of what
    a call is made on, if that ends with a bracket that is no call's.
    """
    open_calls: list[dict] = []
    open_values: list[dict] = []
    # For each depth: where the expression at hand begins, and whether it is still the type behind `new`.
    begun: list[list] = [[None, False]]
    ended: set[int] = set()
    out = []
    for i, (n, text, at, is_call, is_value) in enumerate(zip(numbers, texts, places, calls, values, strict=True)):
        closes, opens = text in ")]}" + _ARRAY[1], text in "([{" + _ARRAY[0]
        if closes and len(begun) > 1:
            begun.pop()
        if closes and open_calls and open_calls[-1]["depth"] == len(begun):
            call = open_calls.pop()
            parts = [p for p in call["parts"] if p]
            whole = [call["whole"].get((p[0][2], p[-1][2]), -1) for p in parts]
            out.append((call["n"], n, call["begin"], call["head"], [_written([t for t, _, _ in p]) for p in parts], [p[0][1] for p in parts], whole, False))
            ended.add(i)
            if open_calls:
                open_calls[-1]["whole"][call["begin"], n] = call["n"]
        # A value ends at a semicolon, where its bracket closes, or at the comma before another variable.
        while open_values and len(begun) <= open_values[-1]["depth"]:
            value, inside = open_values[-1], len(begun) == open_values[-1]["depth"]
            another = text == "," and value["angles"] <= 0 and i + 2 < len(texts) and texts[i + 2] in ("=", ",", ";", "[")
            if inside and not (text == ";" or another):
                value["angles"] += (text == "<") - (text == ">")
                break
            open_values.pop()
            if value["i"] + 1 < i:
                out.append((value["n"], numbers[i - 1], numbers[value["i"] + 1], None, [], [], [], True))
        if is_value:
            open_values.append({"n": n, "i": i, "depth": len(begun), "angles": 0})
        for call in open_calls:
            now = call["parts"][-1]
            typed = now and now[0][0] == "new" and sum((t == "<") - (t == ">") for t, _, _ in now) > 0
            if text == "," and len(begun) == call["depth"] + 1 and not typed:
                call["parts"].append([])
            else:
                now.append((text, at, n))
        here, before = begun[-1], texts[i - 1] if i else ""
        word = text[0].isalnum() or text[0] in "_$\"'"
        if not closes and not here[1]:
            if text in _BEFORE or text in "{" + _ARRAY[0] or not (word or opens or text == "."):
                here[:] = [None, False]
            elif here[0] is None or (word and before != "."):
                here[:] = [i, text == "new"]
        if opens:
            here[1] = False
            if is_call:
                bracketed = i > 2 and texts[i - 2] == "." and texts[i - 3] in ")]" and i - 3 not in ended and here[0] is not None
                begin = None if here[0] is None else numbers[here[0]]
                open_calls.append({"n": n, "depth": len(begun), "parts": [[]], "begin": begin, "head": _written(texts[here[0] : i - 2]) if bracketed else None, "whole": {}})
            begun.append([None, False])
    return out


def call_arguments(code: DataFrame, sites: DataFrame, declared: DataFrame) -> DataFrame:
    """``file_key, open_n, close_n, begin_n, head, argument_expr, argument_ids, argument_calls, is_value`` of each call and initializer.

    Of a call: source text and anchor of each argument, the bracket of the call that
    is the whole of it (-1 for none), the tokens with which the call's expression
    begins and ends, and the text of a receiver in brackets. Of an initializer, whose
    ``open_n`` is the sign before it: its first and last token. The tokens of one
    file go through one call of a small function, a walk over its brackets.
    """
    marks = sites.select("file_key", F.col("open_n").alias("n"), F.lit(1).alias("mark")).unionByName(declared.where("equals_n is not null").select("file_key", F.col("equals_n").alias("n"), F.lit(2).alias("mark")))
    marks = marks.groupBy("file_key", "n").agg(F.max("mark").alias("mark"))
    rows = code.select("file_key", "n", "text", F.concat_ws(":", "line", "col").alias("at")).join(marks, ["file_key", "n"], "left")
    rows = rows.select("file_key", "n", "text", "at", F.coalesce(F.col("mark") == 1, F.lit(False)).alias("is_call"), F.coalesce(F.col("mark") == 2, F.lit(False)).alias("is_value"))
    schema = "file_key string, open_n long, close_n long, begin_n long, head string, argument_expr array<string>, argument_ids array<string>, argument_calls array<long>, is_value boolean"
    return by_group(rows, ["file_key"], ["n"], _arguments, schema)


def thrown(code: DataFrame, scope: DataFrame) -> DataFrame:
    """``file_key, in_callable, created_type, name``: what each ``throw`` of a callable throws, a new object or a variable."""
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), "in_callable")
    name = code.where("before = 'throw' and kind = 'word' and after = ';'").select("file_key", "brace", F.lit(None).cast("string").alias("created_type"), F.col("text").alias("name"))
    made = creations(code).where("thrown").join(code.select("file_key", "n", "brace"), ["file_key", "n"]).select("file_key", "brace", "created_type", F.lit(None).cast("string").alias("name"))
    return made.unionByName(name).join(places, ["file_key", "brace"]).select("file_key", "in_callable", "created_type", "name")


def complexity(code: DataFrame, scope: DataFrame) -> DataFrame:
    """``file_key, in_callable, cyclomatic``: 1 and a point for each branch in the callable's own scope; the arms of a switch that is an expression are none."""
    valued = ~F.col("text").rlike(r"^(?:[\w$]+ : )?switch \(") & F.col("text").rlike(r"\bswitch \([^;]*\)$")
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), "in_callable", valued.alias("valued"))
    branch = F.col("text").isin("if", "for", "while", "catch") | (F.col("text").isin("case", "default") & ~F.col("valued")) | ((F.col("text") == "?") & ~F.col("before").isin("<", ","))
    points = code.join(places, ["file_key", "brace"]).groupBy("file_key", "in_callable").agg(F.sum(F.when(branch & (F.col("before") != "@"), 1).otherwise(0)).alias("points"))
    return points.select("file_key", "in_callable", (F.col("points") + 1).alias("cyclomatic"))


def resolved(spellings: DataFrame, typed: DataFrame, imported: DataFrame, package: DataFrame) -> DataFrame:
    """``file_key, spelling, resolved``: by import, own file, own package, then java.lang; else as spelled.

    Prioritised equi-joins over distinct spellings; type arguments are dropped.
    """
    names = spellings.select("file_key", "spelling").distinct().withColumn("plain", F.regexp_replace(_without_arguments(F.col("spelling")), r"(\[\])+$", ""))
    names = names.join(package, "file_key", "left").withColumn("package", F.coalesce("package", F.lit("")))
    single = imported.where("not is_static and not is_wildcard").select("file_key", F.col("name").alias("plain"), F.col("path").alias("by_import")).dropDuplicates(["file_key", "plain"])
    mine = typed.groupBy("file_key", F.col("name").alias("plain")).agg(F.min("type_id").alias("by_file"))
    near = typed.where("parent_id is null").groupBy("package", F.col("name").alias("plain")).agg(F.min("type_id").alias("by_package"))
    out = names.join(single, ["file_key", "plain"], "left").join(mine, ["file_key", "plain"], "left").join(near, ["package", "plain"], "left")
    language = F.when(F.col("plain").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), F.col("plain")))
    return out.select("file_key", "spelling", F.coalesce("by_import", "by_file", "by_package", language, F.col("plain")).alias("resolved"))


def enum_constants(scope: DataFrame, parts: DataFrame, typed: DataFrame) -> DataFrame:
    """``type_id, name, arguments, ordinal``: the constants of each enum, with or without bodies of their own."""
    enums = typed.where("kind = 'enum'").select("file_key", F.col("scope").alias("brace"), "type_id")
    own = parts.join(enums, ["file_key", "brace"])
    # Constants end at the first semicolon that lies right in the enum, or where the enum does.
    stop = own.where("ends = ';'").groupBy(F.col("type_id").alias("t")).agg(F.min("first").alias("stop"))
    own = own.join(stop, F.col("type_id") == F.col("t"), "left").where("stop is null or first <= stop")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", bare(F.col("body")).alias("body")))), lambda x: x["body"]), " ")
    lists = own.groupBy("type_id").agg(whole.alias("body"))
    items = F.split(F.regexp_replace(F.col("body"), r" ,(?=[^()]*\))", "\u0001"), " *, ?")
    rows = lists.select("type_id", F.posexplode(F.filter(items, lambda x: F.trim(x) != "")).alias("ordinal", "item"))
    arguments = F.filter(F.split(F.regexp_extract("item", r"\( (.*) \)", 1), "\u0001"), lambda x: F.trim(x) != "")
    return rows.select("type_id", F.regexp_extract("item", r"^ *([\w$]+)", 1).alias("name"), F.transform(arguments, lambda x: _restored(F.trim(x))).alias("arguments"), "ordinal").where("name != ''")


def tested_types(parts: DataFrame, scope: DataFrame) -> DataFrame:
    """``file_key, in_callable, spelling``: types of casts, of ``instanceof`` and of ``catch`` in callables."""
    rest = r"(?: \. [\w$]+)*(?: <[\w$<>\[\]., ?&]*>)?(?: \[ \])*"
    name = rf"[\w$]+{rest}"
    cast = F.regexp_extract_all("body", F.lit(rf"(?<![\w$)\]>] )\( ((?:[a-z][\w$]* \. )*[A-Z][\w$]*{rest}) \) (?=[\w$\"'(!~])"), F.lit(1))
    kind = F.regexp_extract_all("body", F.lit(rf"\binstanceof (?:final )?({name})"), F.lit(1))
    caught = F.split(F.regexp_extract("body", rf"(?:^|\W)catch \( (?:final )?({name}(?: \| {name})*) [\w$]+ \)$", 1), r" \| ")
    found = parts.select("file_key", "brace", F.explode(F.concat(cast, kind, caught)).alias("spelling")).where("spelling != ''").withColumn("spelling", _spelled(F.col("spelling")))
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), "in_callable")
    return found.join(places, ["file_key", "brace"]).select("file_key", "in_callable", "spelling").distinct()


def record_components(typed: DataFrame) -> DataFrame:
    """``type_id, name, type, is_variadic, ordinal``: the components of each record."""
    rows = typed.where("kind = 'record'").select("type_id", F.posexplode(_parameters(bare(F.coalesce("components", F.lit(""))))).alias("ordinal", "p"))
    return rows.select("type_id", "p.*", "ordinal")


def record_defaults(components: DataFrame, scope: DataFrame, parts: DataFrame, typed: DataFrame) -> DataFrame:
    """``components`` with ``default_value``: what a constructor of the record assigns to the bare name, the first if several."""
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), F.col("in_type").alias("scope"))
    shape = r"^([\w$]+) = (.+)$"
    found = parts.where("ends = ';'").join(places, ["file_key", "brace"]).where(F.col("body").rlike(shape))
    found = found.join(typed.where("kind = 'record'").select("file_key", "scope", "type_id"), ["file_key", "scope"])
    values = found.groupBy("type_id", F.regexp_extract("body", shape, 1).alias("name")).agg(F.min_by(F.regexp_extract("body", shape, 2), "first").alias("default_value"))
    return components.join(values, ["type_id", "name"], "left")


def accessed_fields(code: DataFrame, scope: DataFrame, fields: DataFrame) -> DataFrame:
    """``file_key, in_callable, field_id``: fields of the own type that a callable names, bare or after ``this``."""
    places = scope.where("in_callable is not null").select("file_key", F.col("open").alias("brace"), "in_type", "in_callable")
    bare_name = (F.col("kind") == "word") & (F.col("after") != "(") & ((F.col("before") != ".") | (F.col("before2") == "this"))
    used = code.where(bare_name).select("file_key", "brace", F.col("text").alias("name")).join(places, ["file_key", "brace"])
    own = fields.where("owner = 'field'").select("file_key", "in_type", "name", F.concat_ws(".", "type_id", "name").alias("field_id")).distinct()
    return used.join(own, ["file_key", "in_type", "name"]).select("file_key", "in_callable", "field_id").distinct()
