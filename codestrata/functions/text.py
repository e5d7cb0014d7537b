"""Scalar functions over names, source text and byte spans, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_name(name: Column | str) -> Column:
    """What follows the last dot."""
    return F.substring_index(_c(name), ".", -1)


def package_of(name: Column | str) -> Column:
    """What precedes the last dot, else the empty string."""
    return F.regexp_extract(_c(name), r"^(.*)\.[^.]*$", 1)


def callable_name(signature: Column | str) -> Column:
    """The bare name of ``pkg.Type.name(args)``."""
    return F.substring_index(F.substring_index(_c(signature), "(", 1), ".", -1)


def constructor_display(signature: Column | str, type_name: Column | str) -> Column:
    """``<init>`` and ``<clinit>`` shown as the simple class name."""
    return F.replace(F.replace(_c(signature), F.lit("<init>"), simple_name(type_name)), F.lit("<clinit>"), simple_name(type_name))


def dotted_name(descriptor: Column | str) -> Column:
    """A binary class name with ``/`` and ``$`` as dots."""
    return F.translate(_c(descriptor), "/$", "..")


def upper_snake(name: Column | str) -> Column:
    """``getResultList`` as ``GET_RESULT_LIST``."""
    return F.upper(F.regexp_replace(_c(name), "([a-z])([A-Z]+)", "$1_$2"))


def first_of_union(spelling: Column | str) -> Column:
    """The first branch of ``A | B``."""
    return F.get(F.split(_c(spelling), r" \| "), 0)


def strip_line_comments(declaration: Column | str) -> Column:
    return F.regexp_replace(_c(declaration), r"//.*?\n", "")


def int_or_null(x: Column | str) -> Column:
    return _c(x).try_cast("int")


def first_non_blank(*values: Column | str) -> Column:
    """The first value that is neither null nor white space, trimmed of nothing."""
    return F.coalesce(*[F.when(F.trim(_c(v)) != "", _c(v)) for v in values])


def content_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def durable_id(app: Column | str, file_key: Column | str, *path: Column | str) -> Column:
    """``can://java/<app>/<file>/<type>/…``: separators become ``/`` and leading dots and slashes go."""
    clean = F.regexp_replace(F.replace(_c(file_key), F.lit("\\"), F.lit("/")), "^[./]+", "")
    return F.concat_ws("/", F.concat(F.lit("can://java/"), _c(app)), clean, *[_c(p) for p in path])


def slice_bytes(source: Column | str, start: Column | str, end: Column | str) -> Column:
    """The text in the UTF-8 bytes [start, end)."""
    return F.decode(F.substring(F.encode(_c(source), "UTF-8"), _c(start).cast("int") + 1, (_c(end) - _c(start)).cast("int")), "UTF-8")


def split_lines(source: Column | str) -> Column:
    r"""Lines with their terminators (``\n``, ``\r\n`` or ``\r``)."""
    return F.regexp_extract_all(_c(source), F.lit(r"[^\r\n]*(\r\n|\r|\n)|[^\r\n]+$"), F.lit(0))


def line_table(files: DataFrame, key: str, source: str) -> DataFrame:
    """``key, line (from 1), byte_from, n_bytes, n_chars``: a row for each line, with its terminator."""
    lines = files.select(key, F.posexplode(split_lines(source)).alias("at", "text"))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    return lines.select(
        key,
        (F.col("at") + 1).alias("line"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("byte_from"),
        size.alias("n_bytes"),
        F.length("text").cast("long").alias("n_chars"),
    )


def byte_offset(spans: DataFrame, lines: DataFrame, files: DataFrame, key: str, source: str, line: str = "line", column: str = "col") -> DataFrame:
    """``spans`` with ``byte``: where ``column`` characters of ``line`` end, in UTF-8 bytes of the file."""
    text = F.substring(F.get(split_lines(F.col(source)), F.col(line) - 1), F.lit(1), F.col(column))
    joined = spans.join(files.select(key, source), key).join(lines.select(key, F.col("line").alias("__line"), "byte_from"), [key])
    return joined.where(F.col("__line") == F.col(line)).select(*spans.columns, (F.col("byte_from") + F.octet_length(text)).alias("byte"))


def whole_span(source: Column | str) -> Column:
    """End line, end column and byte length of a whole file; the end lies past a final terminator."""
    lines = split_lines(source)
    ends = _c(source).rlike(r"[\r\n]$")
    last = F.get(lines, F.size(lines) - 1)
    return F.struct(
        F.when(ends, F.size(lines) + 1).otherwise(F.greatest(F.size(lines), F.lit(1))).alias("end_line"),
        F.when(ends | (F.size(lines) == 0), F.lit(1)).otherwise(F.length(last) + 1).alias("end_col"),
        F.octet_length(_c(source)).cast("long").alias("n_bytes"),
    )


def cypher_string(text: Column | str) -> Column:
    r"""A quoted literal; backslash, quote and line ends are escaped, null is ``null``."""
    out = F.replace(_c(text), F.lit("\\"), F.lit("\\\\"))
    for char, name in (("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.coalesce(F.concat(F.lit("'"), out, F.lit("'")), F.lit("null"))


def cypher_list(items: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(items), cypher_string), ", "), F.lit("]"))


def pruned_json(*columns: Column | str) -> Column:
    """A JSON object without null members."""
    return F.to_json(F.struct(*[_c(c) for c in columns]))


def full_json(*columns: Column | str) -> Column:
    """A JSON object with its null members."""
    return F.to_json(F.struct(*[_c(c) for c in columns]), {"ignoreNullFields": "false"})


def json_member(text: Column | str, key: str) -> Column:
    """The member ``key`` of a JSON object as text, whatever its type; null if it is null or missing, or if the text is no object.

    Numbers are spelled as Spark spells them (``1.50`` is ``1.5``).
    """
    return F.from_json(_c(text), "map<string,string>").getItem(key)
