"""Scalar functions of paths, names, ids and messages, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def make_id(kind: str, *parts: Column) -> Column:
    """kind, a colon, and the first 8 hex digits of the SHA-1 of the parts, which colons join; null parts are empty."""
    return F.concat(F.lit(kind + ":"), F.left(F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), F.lit(8)))


def normalize_http_path(path: Column) -> Column:
    """Template parameters become :param, runs of slashes one, one slash at the end goes; empty: /."""
    p = F.regexp_replace(path, r"\{[^}]+\}", ":param")
    p = F.regexp_replace(p, r":[A-Za-z_][A-Za-z0-9_]*", ":param")
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"/$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def clean_path(url: Column) -> Column:
    """${x} becomes :param, the query goes."""
    return F.split_part(F.regexp_replace(url, r"\$\{[^}]+\}", ":param"), F.lit("?"), F.lit(1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def join_http_paths(*parts: Column) -> Column:
    trimmed = [F.regexp_replace(F.coalesce(p, F.lit("")), r"^/+|/+$", "") for p in parts]
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "/"))


def path_params(path: Column) -> Column:
    """Names of :x, {x}, <x> and <type:x> parameters, in order."""
    found = F.regexp_extract_all(path, F.lit(r"(<(?:[^<>:]*:)?[A-Za-z_][A-Za-z0-9_]*>|\{[A-Za-z_][A-Za-z0-9_]*[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_extract(F.regexp_replace(x, r"^<[^<>:]*:", ""), r"([A-Za-z_][A-Za-z0-9_]*)", 1))


def kebab(name: Column) -> Column:
    x = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")


def snake(name: Column) -> Column:
    x = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, r"[^A-Za-z0-9]+"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")


def sanitize(text: Column, most: int = 300) -> Column:
    """Control characters become spaces, white space one space; trimmed and cut."""
    x = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r" +", " ")
    return F.left(F.trim(x), F.lit(most))


def sanitize_all(texts: Column, most: int = 300) -> Column:
    """sanitize() of each text of an array."""
    return F.transform(texts, lambda x: sanitize(x, most))


#: Keys whose values are hidden.
SECRET_KEY = r"(?i)token|secret|password|passwd|authorization|auth|apikey|api_key|credential|private"


def is_secret(key: Column) -> Column:
    return key.rlike(SECRET_KEY)


def redact(context: Column, most: int = 500) -> Column:
    """Values of secret keys of a map are hidden, others cut."""
    return F.transform_values(context, lambda k, v: F.when(is_secret(k), F.lit("[redacted]")).otherwise(F.left(v, F.lit(most))))


def redact_struct(value: Column, kind: T.DataType, most: int = 500, items: int = 20, depth: int = 0, deepest: int = 4) -> Column:
    """redact() for nested values of type `kind`: fields of structs and keys of maps at every depth; arrays are cut to `items`, what is deeper than `deepest` goes. Values of secret fields become text."""
    if isinstance(kind, T.StringType):
        return F.left(value, F.lit(most))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(value, 1, items), lambda x: redact_struct(x, kind.elementType, most, items, depth + 1, deepest))
    if isinstance(kind, (T.StructType, T.MapType)) and depth > deepest:
        return F.create_map(F.lit("[truncated]"), F.lit("max depth exceeded"))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return redact(value, most)
        return F.transform_values(value, lambda k, v: F.when(~is_secret(k), redact_struct(v, kind.valueType, most, items, depth + 1, deepest)))
    if isinstance(kind, T.StructType):
        one = lambda f: F.lit("[redacted]") if re.search(SECRET_KEY, f.name) else redact_struct(value[f.name], f.dataType, most, items, depth + 1, deepest)
        return F.when(value.isNotNull(), F.struct(*[one(f).alias(f.name) for f in kind.fields]))
    return value


#: Categories of log messages by language, tried in this order on the message in lower case.
LOG_CATEGORIES = {
    "typescript": [
        ("request", "request|incoming|received|req"),
        ("response", "response|respond|reply|res"),
        ("error", "error|exception|fail|crash"),
        ("performance", "performance|duration|latency|took|elapsed|ms"),
        ("security", "auth|login|logout|token|jwt|session|permission|role"),
        ("lifecycle", "start|stop|ready|boot|shutdown|connect|disconnect"),
        ("performance", "metric|trace|span|otel"),
    ],
    "go": [
        ("request", "request|incoming|received"),
        ("response", "response|respond|reply"),
        ("error", "error|fail"),
        ("performance", "duration|latency|elapsed|ms"),
        ("security", "auth|login|token|session"),
        ("lifecycle", "start|stop|ready|shutdown"),
    ],
    "java": [
        ("request", "request|incoming|received"),
        ("response", "response|respond|reply"),
        ("error", "error|exception|fail"),
        ("performance", "performance|duration|latency|elapsed"),
        ("security", "auth|login|logout|token|session"),
        ("lifecycle", "start|stop|ready|boot|shutdown"),
    ],
}
LOG_CATEGORIES["python"] = LOG_CATEGORIES["java"]
#: Levels whose messages are errors, or security where this matches.
LOG_ERRORS, LOG_DENIED = ("error", "fatal"), "auth|unauthorized|forbidden"


def log_category(message: Column, level: Column, language: str = "typescript") -> Column:
    """By level first: errors are `security` or `error`; of other levels the first category whose pattern the message matches, else `general`."""
    low = F.lower(message)
    out = F.when(level.isin(*LOG_ERRORS), F.when(low.rlike(LOG_DENIED), F.lit("security")).otherwise(F.lit("error")))
    for name, pattern in LOG_CATEGORIES[language]:
        out = out.when(low.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("general"))


def log_ids(args: Column) -> Column:
    """Whether the arguments of a log call name a trace, a user, a request."""
    return F.struct(args.rlike("trace[Ii]d|traceID|trace_id|spanId").alias("trace_id"), args.rlike("user[Ii]d|userId|user_id").alias("user_id"), args.rlike("req[Ii]d|request[Ii]d|correlationId").alias("request_id"))


#: HTTP statuses of error classes, by language. Other languages have none.
ERROR_STATUS = {
    "typescript": {
        "NotFoundException": 404, "BadRequestException": 400, "UnauthorizedException": 401, "ForbiddenException": 403, "ConflictException": 409,
        "InternalServerErrorException": 500, "UnprocessableEntityException": 422, "NotImplementedException": 501, "ServiceUnavailableException": 503,
        "HttpException": 400, "NotFoundError": 404, "ValidationError": 400, "AuthenticationError": 401, "AuthorizationError": 403,
    },
    "java": {
        "ResponseStatusException": 400, "NotFoundException": 404, "EntityNotFoundException": 404, "ResourceNotFoundException": 404, "BadRequestException": 400,
        "UnauthorizedException": 401, "ForbiddenException": 403, "AccessDeniedException": 403, "ConflictException": 409, "DataIntegrityViolationException": 409,
        "ValidationException": 422, "ConstraintViolationException": 422, "InternalServerErrorException": 500, "IllegalArgumentException": 400,
        "IllegalStateException": 500, "UnsupportedOperationException": 501,
    },
    "python": {"HTTPException": 400, "Http404": 404, "PermissionDenied": 403, "ValidationError": 400, "NotFound": 404, "Unauthorized": 401, "Forbidden": 403},
}
for _same, _as in (("javascript", "typescript"), ("kotlin", "java")):
    ERROR_STATUS[_same] = ERROR_STATUS[_as]


def error_status(name: Column, language: str = "typescript") -> Column:
    """The status of an error class; null for one that isn't known."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ERROR_STATUS[language].items() for x in kv]), name)


#: Categories of database and broker engines; others are nosql and queue.
DATABASE_CATEGORIES = {
    "sql": ["postgresql", "mysql", "mariadb", "sqlite", "sqlserver"],
    "nosql": ["mongodb", "dynamodb", "couchdb", "firestore"],
    "kv": ["redis", "memcached", "valkey"],
    "search": ["elasticsearch", "opensearch", "meilisearch"],
    "analytics": ["clickhouse", "bigquery", "redshift", "snowflake"],
    "graph": ["neo4j", "neptune", "arangodb"],
    "timeseries": ["timescaledb", "influxdb"],
}
BROKER_CATEGORIES = {"stream": ["kafka", "kinesis", "pulsar"], "queue": ["sqs", "rabbitmq", "nats"], "event-bus": ["sns", "pubsub", "eventbridge"], "pubsub": ["redis-streams"]}


def _category(engine: Column, names: dict[str, list[str]], other: str) -> Column:
    out = F
    for name, engines in names.items():
        out = out.when(engine.isin(engines), F.lit(name))
    return out.otherwise(F.lit(other))


def database_category(engine: Column) -> Column:
    return _category(engine, DATABASE_CATEGORIES, "nosql")


def broker_category(engine: Column) -> Column:
    return _category(engine, BROKER_CATEGORIES, "queue")


def normalize_url(url: Column) -> Column:
    """${x} becomes :param, two slashes one."""
    return F.regexp_replace(F.regexp_replace(url, r"\$\{[^}]+\}", ":param"), "//", "/")


def escape_regex(text: Column) -> Column:
    """Text as a pattern that matches just it."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def json_in(text: Column) -> Column:
    """The first {...} or [...] of a text, from its first opening to its last closing bracket; null if that isn't JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def clamp_score(score: Column) -> Column:
    """Within 0 to 100; null is 50."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(score.cast("double"), F.lit(50.0))))


def sections(markdown: Column) -> Column:
    """A map from titles of `## ` headings to what follows each; of equal titles the last stays, and text before the first is left out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), markdown), r"\n##\s+"), 2, 1 << 30)
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    entry = lambda p: F.struct(bare(F.split_part(p, F.lit("\n"), F.lit(1))).alias("key"), bare(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("value"))
    pairs = F.transform(parts, entry)
    last = F.filter(pairs, lambda x, i: F.size(F.filter(F.slice(pairs, i + 2, F.lit(1 << 30)), lambda y: y["key"] == x["key"])) == 0)
    return F.map_from_entries(last)


def node_size(endpoints: Column) -> Column:
    """Pixels of a service in a drawing."""
    return F.least(F.lit(56), F.lit(26) + 2 * endpoints)


def date_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def sniff_sql(sql: Column) -> tuple[Column, Column]:
    """(operation, first table) of a SQL text."""
    verb = F.lower(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))
    table = F.lower(F.regexp_extract(sql, r"(?i)(?:FROM|INTO|UPDATE|JOIN)\s+[\"`]?([A-Za-z0-9_]+)", 1))
    op = F.when(verb == "select", "findMany").when(verb == "insert", "create").when(verb == "update", "update").when(verb == "delete", "delete").otherwise("raw")
    return op, table


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100
