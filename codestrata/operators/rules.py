"""Declarative predicates as columns: entry points and data-access facts.

Tables of types have ``annotations, extends_list, implements_list`` (arrays of
text), tables of callables ``annotations, parameter_types`` and, joined from
their type, ``owner_extends``. Framework rules are entries of a registry, and a
verdict is one expression over columns, so that Catalyst evaluates it in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the rules look for.
SERVLET_ANNOTATIONS = ["WebServlet", "WebFilter", "WebListener", "ServerEndpoint", "MessageDriven", "WebService"]
SERVLET_BASES = ["HttpServlet", "GenericServlet"]
SERVLET_INTERFACES = ["ServletContextListener", "HttpSessionListener", "ServletRequestListener", "MessageListener"]
SERVLET_PARAMETERS = ["HttpServletRequest", "HttpServletResponse"]
SPRING_ANNOTATIONS = ["Controller", "HandleInterceptor", "HandlerInterceptor", "SpringBootApplication", "Configuration", "Component", "Service", "Repository"]
SPRING_INTERFACES = ["CommandLineRunner", "ApplicationRunner"]
SPRING_METHODS = (
    "GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping EventListener Scheduled KafkaListener RabbitListener "
    "JmsListener PreAuthorize PostAuthorize PostConstruct PreDestroy Around Before After JobScope StepScope"
).split()
STRUTS_ANNOTATIONS = ["Action", "Namespace", "InterceptorRef"]
STRUTS_ANCESTORS = ["ActionSupport", "Interceptor"]
STRUTS_METHODS = ["Action", "ValidationMethod", "InputConfig", "After", "Before", "Result"]
CAMEL_ANNOTATIONS = ["Component"]
CAMEL_ANCESTORS = ["RouteBuilder", "Processor", "Producer", "Consumer"]
REST_VERBS = ["POST", "PUT", "GET", "HEAD", "DELETE"]
QUERY_METHODS = {"GET_RESULT_LIST": "READ", "GET_SINGLE_RESULT": "READ", "GET_FIRST_RESULT": "READ", "GET_MAX_RESULTS": "READ", "EXECUTE_UPDATE": "UPDATE"}


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return F.coalesce(out, F.lit(False))


def any_contains(items: Column, parts: list[str]) -> Column:
    """Whether some item of an array contains some part; false for a null array."""
    return F.coalesce(F.exists(items, lambda x: contains_any(x, parts)), F.lit(False))


def first_match(rules: list[tuple[Column, str]]) -> Column:
    """The value of the first rule that holds, else null."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def annotation_name(text: Column) -> Column:
    """``@a.b.Name(args)`` as ``a.b.Name``."""
    return F.regexp_extract(text, r"^@?([\w.]+)", 1)


def _names(column: str) -> Column:
    return F.transform(F.col(column), annotation_name)


def servlet_class() -> Column:
    return any_contains(_names("annotations"), SERVLET_ANNOTATIONS) | any_contains(F.col("extends_list"), SERVLET_BASES) | any_contains(F.col("implements_list"), SERVLET_INTERFACES)


def servlet_method() -> Column:
    return any_contains(F.col("parameter_types"), SERVLET_PARAMETERS)


def spring_class() -> Column:
    simple = F.transform(F.col("implements_list"), lambda x: F.substring_index(F.substring_index(x, "<", 1), ".", -1))
    runner = F.coalesce(F.arrays_overlap(simple, F.array(*map(F.lit, SPRING_INTERFACES))), F.lit(False))
    return any_contains(_names("annotations"), SPRING_ANNOTATIONS) | runner


def spring_method() -> Column:
    return any_contains(F.col("annotations"), SPRING_METHODS)


def struts_class(ancestors: str = "ancestors") -> Column:
    return any_contains(_names("annotations"), STRUTS_ANNOTATIONS) | any_contains(F.col(ancestors), STRUTS_ANCESTORS)


def struts_method() -> Column:
    return any_contains(F.col("owner_extends"), ["Action"]) & (any_contains(F.col("annotations"), STRUTS_METHODS) | (F.col("name") == "execute"))


def camel_class(ancestors: str = "ancestors") -> Column:
    return any_contains(_names("annotations"), CAMEL_ANNOTATIONS) | any_contains(F.col(ancestors), CAMEL_ANCESTORS)


def rest_method() -> Column:
    return any_contains(F.col("annotations"), REST_VERBS)


ENTRYPOINT_CLASS: dict[str, Callable[[], Column]] = {"jakarta": servlet_class, "spring": spring_class, "struts": struts_class, "camel": camel_class}
ENTRYPOINT_METHOD: dict[str, Callable[[], Column]] = {"jakarta": servlet_method, "spring": spring_method, "struts": struts_method, "jax-rs": rest_method, "camel": lambda: F.lit(False)}


def entrypoint_rule(kind: str, framework: str) -> Column:
    """The rule of one framework, by name."""
    registry = {"class": ENTRYPOINT_CLASS, "method": ENTRYPOINT_METHOD}[kind]
    if framework not in registry:
        raise ValueError(f"no {kind} rule for {framework!r}")
    return registry[framework]()


def mark_entrypoints(types: DataFrame, callables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``types`` with ``is_entrypoint_class`` and ``callables`` with ``is_entrypoint``.

    ``types`` need ``type_id, extends_list, implements_list, annotations,
    ancestors``; ``callables`` need ``type_id, name, annotations, parameter_types``.
    A type is an entry point too if a callable of it has a REST verb.
    """
    owners = types.select("type_id", F.col("extends_list").alias("owner_extends"))
    verdict = F.lit(False)
    for name in ENTRYPOINT_METHOD:
        verdict = verdict | entrypoint_rule("method", name)
    methods = callables.join(owners, "type_id", "left").withColumn("is_entrypoint", F.coalesce(verdict, F.lit(False)))
    rest = methods.where(rest_method()).select(F.col("type_id").alias("rest_type")).distinct()
    of_class = F.col("rest_type").isNotNull()
    for name in ENTRYPOINT_CLASS:
        of_class = of_class | entrypoint_rule("class", name)
    marked = types.join(rest, F.col("type_id") == F.col("rest_type"), "left").withColumn("is_entrypoint_class", F.coalesce(of_class, F.lit(False)))
    return marked.drop("rest_type"), methods.drop("owner_extends")


def query_operation(method: Column) -> Column:
    """READ or UPDATE for a method of a query object, else null."""
    snake = F.upper(F.regexp_replace(method, "([a-z])([A-Z]+)", "$1_$2"))
    return first_match([(snake == name, kind) for name, kind in QUERY_METHODS.items()])


def crud_operation(receiver: str = "receiver_type", method: str = "method_name", compat: bool = True) -> Column:
    """CREATE, READ, UPDATE or DELETE of a persistence call, else null.

    ``compat=False`` looks through type arguments, so ``TypedQuery<X>`` counts.
    """
    of = F.coalesce(F.col(receiver), F.lit("")) if compat else F.regexp_replace(F.coalesce(F.col(receiver), F.lit("")), "<.*", "")
    name, manager, query = F.col(method), of.endswith("EntityManager"), of.endswith("Query")
    return first_match(
        [
            (manager & (name == "persist"), "CREATE"),
            ((manager & (name == "find")) | (query & (query_operation(name) == "READ")), "READ"),
            ((query & (query_operation(name) == "UPDATE")) | (manager & (name == "merge")), "UPDATE"),
            (manager & (name == "remove"), "DELETE"),
        ]
    )


def crud_query(receiver: str = "receiver_type", method: str = "method_name", arguments: str = "argument_expr", compat: bool = True) -> Column:
    """READ, WRITE or NAMED of a query creation, else null.

    Arguments are source text, so a literal starts with its quote and no literal
    ever matches; ``compat=False`` takes the quote off.
    """
    first = F.lower(F.get(F.col(arguments), 0))
    first = first if compat else F.regexp_replace(first, '^"+\\s*', "")
    manager = F.coalesce(F.col(receiver), F.lit("")).endswith("EntityManager")
    creation = manager & F.col(method).isin("createQuery", "createNamedQuery")
    return first_match(
        [
            (creation & first.startswith("select"), "READ"),
            (creation & first.rlike("^(update|delete|insert)"), "WRITE"),
            (manager & (F.col(method) == "createNamedQuery"), "NAMED"),
        ]
    )


#: Data-access rules by framework, in the order in which they are asked; two have none yet.
CRUD_RULES: dict[str, tuple[Callable[..., Column], Callable[..., Column]]] = {
    "jakarta": (crud_operation, crud_query),
    "spring": (lambda **_: F.lit(None).cast("string"), lambda **_: F.lit(None).cast("string")),
    "jdbc": (lambda **_: F.lit(None).cast("string"), lambda **_: F.lit(None).cast("string")),
}


def crud_rule(kind: str, framework: str, **options) -> Column:
    """The ``operation`` or ``query`` rule of one framework, by name."""
    if framework not in CRUD_RULES or kind not in ("operation", "query"):
        raise ValueError(f"no {kind} rule for {framework!r}")
    return CRUD_RULES[framework][kind == "query"](**options)


def data_access(kind: str, **options) -> Column:
    """The first framework's verdict that is not null."""
    return F.coalesce(*[crud_rule(kind, name, **options) for name in CRUD_RULES])
