"""Source files as node rows: endpoints, functions, calls, flow, returns, throws, logs, database and event operations.

One table-generating step turns (service, path, language, text) into rows; all that
follows is relational. Python is read with its own syntax tree. The other
languages share a lexer that knows strings, comments and braces, with rules for
each language in tables; it sees what is written in a usual layout, not all that
their grammars allow.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import ERROR_STATUS
from graphloom.sources import rules

SCHEMA = "service string, path string, language string, ord long, type string, name string, kind string, line int, col int, end_line int, meta map<string,string>"


@dataclass
class Node:
    type: str
    name: str
    kind: str | None
    line: int
    col: int
    end_line: int
    meta: dict[str, str] = field(default_factory=dict)


#: Log verbs and levels; HTTP verbs; database verbs and operations.
LEVELS = {"trace": "trace", "debug": "debug", "info": "info", "log": "info", "warn": "warn", "warning": "warn", "error": "error", "exception": "error", "critical": "fatal", "fatal": "fatal"}
VERBS = {"get", "post", "put", "patch", "delete", "head", "options"}
DB_OPS = {
    "find": "findMany", "findall": "findMany", "findmany": "findMany", "all": "findMany", "filter": "findMany", "filter_by": "findMany", "findone": "findOne", "findfirst": "findFirst", "findunique": "findUnique", "findbyid": "findUnique", "findbypk": "findUnique", "first": "findFirst", "one": "findOne", "take": "findFirst",
    "add": "create", "create": "create", "insert": "create", "save": "upsert", "saveall": "upsert", "bulkcreate": "createMany", "createmany": "createMany", "add_all": "createMany", "merge": "upsert", "upsert": "upsert", "update": "update", "updates": "update", "updatemany": "updateMany", "delete": "delete", "deletemany": "deleteMany", "destroy": "delete", "remove": "delete", "deletebyid": "delete",
    "count": "count", "exists": "count", "aggregate": "aggregate", "groupby": "groupBy", "execute": "raw", "raw": "raw", "query": "raw", "exec": "raw", "commit": "transaction", "rollback": "transaction", "transaction": "transaction",
}
DB_RECEIVER = re.compile(r"(?i)(^|\.)(db|session|prisma(\.\w+)?|tx|conn|cursor|objects|\w*repo(sitory)?|em|entitymanager|jdbctemplate|gorm)$")
LOG_RECEIVER = re.compile(r"(?i)(^|\.)(log|logger|logging|console|slf4j|log4j|winston|pino|zap|logrus|slog)$")
HTTP_RECEIVER = re.compile(r"(?i)(^|\.)(requests|httpx|axios|http|httpclient|client|resttemplate|webclient|got|ky|superagent|\w*api)$")
ROUTER = re.compile(r"(?i)(^|\.)(app|router|api|server|fastify|blueprint|bp|r|e|g|v1|v2|mux|group|\w*router)$")
EVENT_SEND, EVENT_TAKE = {"send", "publish", "emit", "sendtoqueue", "basic_publish", "dispatch", "convertandsend", "writemessages", "apply_async"}, {"subscribe", "consume", "basic_consume", "on", "addlistener", "readmessage"}
BROKER = re.compile(r"(?i)(producer|consumer|kafka|channel|rabbit|amqp|nats|broker|bus|emitter|events?|writer)")


def called(callee: str, args: list[str], awaited: bool, line: int, col: int, end: int) -> Iterator[Node]:
    """The nodes that one call makes: the call itself, and the log, database, event or HTTP operation that it is. args: strings as they are, other arguments as text."""
    receiver, _, verb = callee.rpartition(".")
    low, first = verb.lower(), (args[0] if args else "")
    yield Node("call", callee, None, line, col, end, {"awaited": str(awaited).lower(), "args": ", ".join(args)[:200]})
    text = first.strip("\"'`") if first[:1] in "\"'`" and first else None
    if (receiver and low in LEVELS and LOG_RECEIVER.search(receiver)) or callee in ("print", "println", "fmt.Println", "fmt.Printf", "System.out.println", "System.err.println"):
        level = "error" if ".err." in callee else LEVELS.get(low, "info")
        yield Node("log", callee, level, line, col, end, {"message": (text or first)[:300]})
    elif receiver and (low in DB_OPS or rules.operation_of(verb)) and DB_RECEIVER.search(receiver):
        op = DB_OPS.get(low) or rules.operation_of(verb)
        meta = {"operation": op, "model": receiver.rpartition(".")[2]}
        if text and (m := re.search(r"(?i)\b(?:FROM|INTO|UPDATE|JOIN)\s+[\"`]?(\w+)", text)):
            meta["table"] = m[1].lower()
        yield Node("dbProcess", callee, op, line, col, end, meta)
    elif receiver and BROKER.search(receiver) and low in EVENT_SEND | EVENT_TAKE:
        topic = next((a.strip("\"'`") for a in args if a[:1] in "\"'`"), None) or next((m[1] for a in args if (m := re.search(r"(?i)topics?\"?\s*[:=]\s*\[?[\"'`]([^\"'`]+)", a))), None)
        yield Node("event", topic or callee, "publish" if low in EVENT_SEND else "consume", line, col, end, {"channel": receiver.rpartition(".")[2]})
    elif callee == "fetch" or (receiver and HTTP_RECEIVER.search(receiver) and (low in VERBS or low in ("getforobject", "getforentity", "postforobject", "exchange", "request")) and text and re.match(r"(https?:/|/|\$\{)", text)):
        method = next((v for v in VERBS if low.startswith(v)), "get").upper()
        url = re.sub(r"\$?\{[^}]*\}", ":param", text or first).split("?")[0]
        m = re.match(r"(https?://[^/]+)?(.*)", url)
        yield Node("externalCall", f"{method} {url}", method, line, col, end, {"baseUrl": m[1] or "", "path": re.sub("/+", "/", m[2]) or "/"})


#: Comparisons as ast.unparse() writes them.
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}


def _atom(x: ast.AST) -> str | None:
    """ast.unparse(x) of names, plain constants, and attributes and calls of these, which need no parentheses anywhere; None for all else."""
    kind = type(x)
    if kind is ast.Name:
        return x.id
    if kind is ast.Constant:
        return repr(x.value) if x.kind is None and type(x.value) in (str, int, bool, type(None)) else None
    if kind is ast.Attribute:
        base = None if type(x.value) is ast.Constant else _atom(x.value)
        return None if base is None else f"{base}.{x.attr}"
    if kind is ast.Call:
        parts = [_atom(x.func), *[_atom(a) for a in x.args]]
        given = [(k.arg, _atom(k.value)) for k in x.keywords]
        if type(x.func) is ast.Constant or None in parts or any(k is None or v is None for k, v in given):
            return None
        return f"{parts[0]}({', '.join(parts[1:] + [f'{k}={v}' for k, v in given])})"
    return None


def source(x: ast.AST) -> str:
    """ast.unparse(x), without its detour for what most expressions are."""
    kind = type(x)
    found = None
    if kind is ast.Await:
        found = _atom(x.value)
        found = found and f"await {found}"
    elif kind is ast.Compare:
        sides = [_atom(y) for y in (x.left, *x.comparators)]
        found = None if None in sides else sides[0] + "".join(f" {_COMPARE[type(o)]} {y}" for o, y in zip(x.ops, sides[1:]))
    elif kind is ast.Raise:
        found = _atom(x.exc) if x.exc and not x.cause else None
        found = found and f"raise {found}"
    else:
        found = _atom(x)
    return ast.unparse(x) if found is None else found


#: Nodes of the syntax tree that walk() has nothing to say of, nor of what is below; those that it tells of; and of each kind of node the fields that others can be in.
_PLAIN = {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal}
_TOLD = {ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Call, ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.Try, ast.Return, ast.Raise}
_FIELDS: dict[type, list[str]] = {}


def _children(x: ast.AST) -> Iterator[ast.AST]:
    """What ast.iter_child_nodes() gives, without _PLAIN ones, operators and contexts."""
    kind = type(x)
    names = _FIELDS.get(kind)
    if names is None:
        names = _FIELDS[kind] = [f for f in kind._fields if f not in ("ctx", "op", "ops")]
    for name in names:
        value = getattr(x, name, None)
        if type(value) is list:
            for y in value:
                if isinstance(y, ast.AST) and type(y) not in _PLAIN:
                    yield y
        elif isinstance(value, ast.AST) and type(value) not in _PLAIN:
            yield value


def python_nodes(path: str, text: str) -> list[Node]:
    out: list[Node] = []
    literal = lambda x: repr(x.value) if isinstance(x, ast.Constant) and isinstance(x.value, str) else source(x)

    def node(type_: str, name: str, kind: str | None, x: ast.AST, **meta: str) -> None:
        out.append(Node(type_, name, kind, x.lineno, x.col_offset, x.end_lineno or x.lineno, meta))

    def endpoints(f: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for dec in f.decorator_list:
            if not isinstance(dec, ast.Call):
                continue
            callee = source(dec.func)
            receiver, _, verb = callee.rpartition(".")
            route = dec.args[0].value if dec.args and isinstance(dec.args[0], ast.Constant) else ""
            methods: list[str] = []
            if verb in VERBS and ROUTER.search(receiver):
                methods = [verb.upper()]
            elif verb in ("route", "api_view"):
                given = next((k.value for k in dec.keywords if k.arg == "methods"), dec.args[0] if verb == "api_view" and dec.args else None)
                methods = [e.value.upper() for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
                route = route if verb == "route" else "/" + f.name
            for m in methods:
                params = re.findall(r"[{<](?:\w+:)?(\w+)[}>]", str(route))
                out.append(Node("endpoint", f.name, m, dec.lineno, dec.col_offset, f.end_lineno or f.lineno, {"path": str(route) or "/", "params": ",".join(params)}))

    def walk(x: ast.AST, owner: str, awaited: bool) -> None:
        inside, is_await = owner, False
        if type(x) not in _TOLD:
            is_await = type(x) is ast.Await
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            endpoints(x)
            name = f"{owner}.{x.name}" if owner else x.name
            node("function", name, "constructor" if x.name == "__init__" else "method" if owner else "function", x, **{"async": str(isinstance(x, ast.AsyncFunctionDef)).lower(), "decorators": ",".join(source(dc) for dc in x.decorator_list)[:200], "params": ",".join(a.arg for a in x.args.args)})
            if "View" in owner and x.name in VERBS:
                node("endpoint", name, x.name.upper(), x, path="/" + owner.lower(), params="")
            inside = ""
        elif isinstance(x, ast.ClassDef):
            inside = x.name
            node("data", x.name, "class", x, extends=",".join(source(b) for b in x.bases))
            for a in x.body:
                if isinstance(a, ast.Assign) and isinstance(a.targets[0], ast.Name) and a.targets[0].id == "__tablename__" and isinstance(a.value, ast.Constant):
                    node("table", str(a.value.value), "table", a, entity=x.name)
                elif isinstance(a, (ast.Assign, ast.AnnAssign)) and isinstance(a.value, ast.Call) and source(a.value.func).rpartition(".")[2] in ("Column", "mapped_column"):
                    target = a.targets[0] if isinstance(a, ast.Assign) else a.target
                    node("column", source(target), source(a.value.args[0])[:100] if a.value.args else None, a, entity=x.name, primaryKey=str(any(k.arg == "primary_key" for k in a.value.keywords)).lower())
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            for a in x.names:
                node("data", a.name, "import", x, module=getattr(x, "module", None) or a.name)
        elif isinstance(x, ast.Call):
            callee = source(x.func)
            if re.fullmatch(r"[\w.]+", callee):
                out.extend(called(callee, [literal(a) for a in x.args] + [f"{k.arg}={literal(k.value)}" for k in x.keywords], awaited, x.lineno, x.col_offset, x.end_lineno or x.lineno))
                if callee in ("path", "re_path", "url") and "urls" in path and x.args and isinstance(x.args[0], ast.Constant):
                    node("endpoint", source(x.args[1]) if len(x.args) > 1 else "", "GET", x, path="/" + str(x.args[0].value).lstrip("/^"), params=",".join(re.findall(r"<(?:\w+:)?(\w+)>", str(x.args[0].value))))
                if callee.endswith("KafkaConsumer"):
                    for a in x.args:
                        if isinstance(a, ast.Constant):
                            node("event", str(a.value), "consume", x, channel="kafka")
        elif isinstance(x, (ast.If, ast.IfExp)):
            node("flowControl", "if", "if", x, condition=source(x.test)[:200])
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            kind = "while" if isinstance(x, ast.While) else "for_of"
            node("flowControl", kind, kind, x, condition=source(x.test if isinstance(x, ast.While) else x.iter)[:200])
        elif isinstance(x, ast.Match):
            node("flowControl", "switch", "switch", x, condition=source(x.subject)[:200])
        elif isinstance(x, ast.Try):
            node("flowControl", "try", "try", x)
            for h in x.handlers:
                node("flowControl", "catch", "catch", h, condition=source(h.type) if h.type else "")
            if x.finalbody:
                out.append(Node("flowControl", "finally", "finally", x.finalbody[0].lineno, x.finalbody[0].col_offset, x.finalbody[-1].end_lineno or x.lineno))
        elif isinstance(x, ast.Return):
            node("return", source(x.value)[:200] if x.value else "", None, x)
        elif isinstance(x, ast.Raise):
            cls = source(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) if x.exc else ""
            given = re.search(r"status_code\s*=\s*(\d{3})", source(x))
            node("throw", cls, None, x, status=given[1] if given else str(ERROR_STATUS["python"].get(cls, 500)))
        for child in _children(x):
            walk(child, inside, is_await)

    walk(ast.parse(text), "", False)
    return out


#: Rules of the languages with braces. function: name of a function whose body opens; endpoint: (pattern, groups of verb and path).
F_TS = r"(?:^|\n)[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?:function\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|\w+)\s*(?::[^=\n]+)?=>|(?!if|for|while|switch|catch|return|else|do|new)(\w+))\s*(?:<[^>\n]*>)?\s*(?:\([^{};]*?\))?\s*(?::[^{;=\n]+)?\s*\{"
F_JAVA = r"(?:^|\n)[ \t]*(?:(?:public|private|protected|static|final|synchronized|abstract|override|open|suspend|internal|async|virtual|sealed|readonly)\s+)*(?:fun\s+(?:\w+\.)?|[\w<>\[\],.?]+\s+)?(?!if|for|while|switch|catch|return|else|do|new|when|class|try)(\w+)\s*\([^{};]*?\)\s*(?::\s*[\w<>?., ]+)?(?:\s*throws\s+[\w, .]+)?\s*\{"
F_GO = r"(?:^|\n)func\s*(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*\([^{]*?\{"
F_RUST = r"(?:^|\n)[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)[^{;]*\{"
F_SWIFT = r"(?:^|\n)[ \t]*(?:(?:public|private|internal|static|open|override|mutating)\s+)*func\s+(\w+)[^{]*\{"
CALL_ROUTE = r"([\w.]+)\.(get|post|put|patch|delete|head|options|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*[\"'`](/?[^\"'`]*)[\"'`]\s*,"
MAPPING = r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*(?:\"([^\"]*)\")?[^)]*\))?"
LANGUAGE = {
    "typescript": (F_TS, [("call", CALL_ROUTE), ("mark", r"@(Get|Post|Put|Patch|Delete|All|Head|Options)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?[^)]*\)")], r"@Controller\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?"),
    "java": (F_JAVA, [("mark", MAPPING)], r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:public\s+)?class"),
    "go": (F_GO, [("call", CALL_ROUTE), ("handle", r"http\.HandleFunc\(\s*\"([^\"]+)\"")], None),
    "rust": (F_RUST, [("mark", r"#\[(get|post|put|patch|delete)\(\"([^\"]*)\"\)\]"), ("axum", r"\.route\(\s*\"([^\"]+)\"\s*,\s*(get|post|put|patch|delete)\(")], None),
    "swift": (F_SWIFT, [("call", r"(\w+)\.(get|post|put|patch|delete)\(\s*\"([^\"]*)\"\s*[,)]")], None),
    "csharp": (F_JAVA, [("mark", r"\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*\"([^\"]*)\"[^)]*\))?\]")], r"\[Route\(\s*\"([^\"]*)\"\s*\)\]"),
}
LANGUAGE["javascript"], LANGUAGE["kotlin"] = LANGUAGE["typescript"], LANGUAGE["java"]
FLOW = re.compile(r"\b(if|for|while|switch|when|select|match|try|catch|finally|do)\b(?=\s*[({\w!])")
SKIP = {"if", "for", "while", "switch", "catch", "return", "function", "when", "match", "select", "func", "fun", "fn", "new", "throw", "throws", "class", "super", "this", "String", "Number", "Boolean", "parseInt", "parseFloat", "else", "do", "await", "typeof", "and", "or", "not", "panic"}


def mask(text: str) -> str:
    """text with the insides of strings and comments blanked, in place."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'", blank, text, flags=re.S)


def brace_nodes(language: str, text: str, path: str = "") -> list[Node]:
    code = mask(text)
    breaks = [-1] + [i for i, c in enumerate(code) if c == "\n"]
    import bisect

    place = lambda at: (bisect.bisect_left(breaks, at), at - breaks[bisect.bisect_left(breaks, at) - 1] - 1)
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, c in enumerate(code):
        if c in "{(":
            stack.append(i)
        elif c in "})":
            while stack:
                j = stack.pop()
                if code[j] == ("{" if c == "}" else "("):
                    close[j] = i
                    break
    out: list[Node] = []

    def node(type_: str, name: str, kind: str | None, at: int, end: int, **meta: str) -> Node:
        line, col = place(at)
        n = Node(type_, name, kind, line, col, place(end)[0], meta)
        out.append(n)
        return n

    function, routes, base = LANGUAGE[language]
    classes = [(m.start(), m[1], close.get(code.find("{", m.end()), len(code) - 1)) for m in re.finditer(r"\b(?:class|interface|enum|record|struct|object)\s+([A-Z]\w*)", code)]
    owner = lambda at: next((n for a, n, e in reversed(classes) if a <= at <= e), "")
    for a, name, end in classes:
        head = code[a : code.find("{", a)] if "{" in code[a:] else code[a : a + 200]
        extends, implements = re.search(r"\bextends\s+([\w.]+)", head), re.search(r"\bimplements\s+([\w., ]+)", head)
        node("data", name, head.split()[0] if head else "class", a, end, extends=extends[1] if extends else "", implements=implements[1].strip() if implements else "")
    named: list[tuple[int, int, str]] = []
    for m in re.finditer(function, code):
        groups = [g for g in m.groups() if g]
        if not groups or groups[-1] in SKIP:
            continue
        brace = m.end() - 1
        start = m.start() + (len(m[0]) - len(m[0].lstrip()))
        own = owner(start)
        name = ".".join(groups) if language == "go" else f"{own}.{groups[-1]}" if own and own != groups[-1] else groups[-1]
        kind = "constructor" if groups[-1] in ("constructor", own) else "method" if "." in name else "function"
        end = close.get(brace, len(code) - 1)
        named.append((start, end, name))
        node("function", name, kind, start, end, **{"async": str(bool(re.search(r"\basync\b", m[0]))).lower()})
    prefix = re.search(base, text) if base else None
    # groups of routes have a prefix, which groups of groups add to
    groups_of: dict[str, str] = {}
    for m in re.finditer(r"(\w+)\s*:?=\s*([\w.]+)\.Group\(\s*[\"'`]([^\"'`]*)", text):
        groups_of[m[1]] = groups_of.get(m[2], "") + "/" + m[3].strip("/")
    # interfaces of clients have marks like those of endpoints
    clients = [(m.start(), close.get(code.find("{", m.end()), m.end())) for m in re.finditer(r"@FeignClient\b[^{]*?\binterface\s+\w+", text)]
    for how, pattern in routes:
        for m in re.finditer(pattern, text):
            if code[m.start()] != text[m.start()] or any(a <= m.start() <= b for a, b in clients):
                continue  # in a comment, or of a client
            if how == "call":
                if not ROUTER.search(m[1]) and m[1] not in groups_of:
                    continue
                verb, path = m[2].upper(), groups_of.get(m[1], "") + "/" + m[3]
            elif how == "handle":
                verb, path = "GET", m[1]
            elif how == "axum":
                verb, path = m[2].upper(), m[1]
            else:
                if base and language == "java" and re.match(r"\s*(?:public\s+)?class", text[m.end() :]):
                    continue
                verb, path = m[1].upper(), "/".join([(prefix[1] or "") if prefix else "", m[2] or ""])
                given = re.search(r"RequestMethod\.(\w+)", m[0])
                verb = given[1] if given else "GET" if verb in ("ALL", "REQUEST") else verb
            path = "/" + "/".join(p for p in path.split("/") if p)
            after = next((f for f in named if f[0] >= m.start()), None) if how == "mark" else None
            # a route is named after the function that its last argument names
            given = re.search(r"(?:^|,)\s*((?:\w+\.)*\w+)\s*$", text[m.end() : close.get(text.find("(", m.start()), m.end())]) if how == "call" else None
            node("endpoint", after[2] if after else given[1] if given else f"{verb} {path}", verb, m.start(), after[1] if after else close.get(text.find("(", m.start()), m.end()), path=path, params=",".join(re.findall(r"[:{](\w+)", path)))
    for m in FLOW.finditer(code):
        kind = {"when": "switch", "select": "switch", "match": "switch"}.get(m[1], m[1])
        paren = re.match(r"\s*\(", code[m.end() :])
        open_at = m.end() + paren.end() - 1 if paren else None
        after = close.get(open_at, m.end()) if open_at is not None else m.end()
        brace = code.find("{", after)
        end = close.get(brace, after) if brace >= 0 and not code[after + 1 : brace].strip(" \n\t)") or language == "go" and brace >= 0 else after
        node("flowControl", kind, kind, m.start(), end, condition=text[open_at + 1 : after][:200] if open_at is not None else "")
    for m in re.finditer(r"\breturn\b([^;\n}]*)", code):
        node("return", text[m.start(1) : m.end(1)].strip()[:200], None, m.start(), m.end(), **rules.answer(text[max(0, m.start() - 200) : m.end(1)].rpartition("\n")[2]))
    for m in re.finditer(r"\bthrow\s+(?:new\s+)?([\w.]+)|\bpanic\s*\(", code):
        cls = m[1] or "panic"
        node("throw", cls, None, m.start(), m.end(), status=str(ERROR_STATUS.get(language, {}).get(cls, 500)))
    for m in re.finditer(r"\b(?:import|use|using)\b[^\n;]*", code):
        node("data", text[m.start() : m.end()][:200], "import", m.start(), m.end())
    for m in re.finditer(r"([A-Za-z_][\w]*(?:(?:\?\.|\.|::)[A-Za-z_]\w*)*)\s*\(", code):
        callee = m[1].replace("?.", ".").replace("::", ".")
        if callee in SKIP or re.search(r"\b(?:function|func|fun|fn|class|record)\s+$", code[: m.start()][-12:]) or any(a <= m.start() < a + 400 and code.find("{", a) > m.start() and n.endswith(callee) for a, _, n in named):
            continue
        end = close.get(m.end() - 1, m.end())
        args, depth, last = [], 0, m.end()
        for i in range(m.end(), end + 1):
            c = code[i]
            if c in "([{":
                depth += 1
            elif c in ")]}" and i < end:
                depth -= 1
            if i == end or c == "," and not depth:
                if text[last:i].strip():
                    args.append(text[last:i].strip())
                last = i + 1
        line, col = place(m.start())
        out.extend(called(callee, args, code[: m.start()].rstrip().endswith("await"), line, col, place(end)[0]))
    for r in rules.RULES:
        if language in r.languages:
            for m in r.pattern.finditer(text):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if code[at] == text[at]:
                    end = close.get(code.find("{", m.end()), m.end()) if r.block else m.end()
                    out.extend(_by_rule(r, m, language, text, at, end, place))
    if language in ("typescript", "javascript") and rules.FRONTEND.search("/" + path):
        for type_, name, kind, start, end, facts in rules.screens(path, code, text, close):
            node(type_, name, kind, start, end, **facts)
    out.sort(key=lambda n: (n.line, n.col))
    return out


def _by_rule(r: rules.Rule, m: re.Match, language: str, text: str, at: int, end: int, place) -> Iterator[Node]:
    g = {k: v for k, v in m.groupdict().items() if v is not None}
    name = g.get("name") or g.get("name2") or ""
    (line, col), last = place(at), place(end)[0]
    if r.type == "feign":
        base = re.search(r"\burl\s*=\s*\"([^\"]*)\"", g["args"]) or re.search(r"(?:name|value)\s*=\s*\"([^\"]*)\"", g["args"]) or re.search(r"\"([^\"]*)\"", g["args"])
        for k in re.finditer(MAPPING, text[m.end() : end]):
            verb = "GET" if k[1] == "Request" else k[1].upper()
            where = place(m.end() + k.start())
            yield Node("externalCall", f"{verb} {k[2] or '/'}", verb, *where, where[0], {"baseUrl": base[1] if base else "", "path": k[2] or "/", "client": name})
    elif r.type == "route":
        url = re.search(r"(?:url|path)\s*:\s*[\"'`]([^\"'`]*)", g["body"])
        for verb in re.findall(r"[\"'`](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[\"'`]", g["body"]) or ["GET"]:
            if url:
                yield Node("endpoint", f"{verb} {url[1]}", verb, line, col, last, {"path": url[1], "params": ",".join(re.findall(r"[:{](\w+)", url[1]))})
    elif r.type == "entity":
        body = text[m.end() : end]
        found = rules.columns(language, body, m.end())
        if language == "go" and "gorm" not in body:
            return
        given = re.search(r"[\"'](\w+)[\"']", g.get("args", ""))
        yield Node("table", given[1] if given else name.lower() + "s" if language == "go" else name.lower(), "table", line, col, last, {"entity": name, "hasTimestamps": str(bool(re.search(r"(?i)created_?at|gorm\.Model", body))).lower(), "hasSoftDelete": str(bool(re.search(r"(?i)deleted_?at|gorm\.Model", body))).lower()})
        for column, kind, where, facts in found:
            yield Node("column", column, kind, *place(where), place(where)[0], {"entity": name, **facts})
    else:
        yield Node(r.type, name, r.kind or g.get("kind"), line, col, last, dict(r.meta))


#: Parsers of other languages, or in place of those here: functions of a path and a text.
PARSERS: dict[str, Callable[[str, str], list[Node]]] = {}


def nodes_of(path: str, language: str, text: str, parsers: dict[str, Callable[[str, str], list[Node]]] | None = None) -> list[Node]:
    """All nodes of a file; one of type diagnostic if it can't be read."""
    own = PARSERS if parsers is None else parsers
    try:
        if language in own:
            return own[language](path, text)
        return python_nodes(path, text) if language == "python" else brace_nodes(language, text, path) if language in LANGUAGE else []
    except (SyntaxError, ValueError, RecursionError) as e:
        return [Node("diagnostic", f"{type(e).__name__}: {e}"[:300], "warning", int(getattr(e, "lineno", None) or 1), 0, 1)]


#: The columns of SCHEMA as Arrow has them.
ARROW = pa.schema([("service", pa.string()), ("path", pa.string()), ("language", pa.string()), ("ord", pa.int64()), ("type", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("meta", pa.map_(pa.string(), pa.string()))])

#: Rows that are handed on at once.
ROWS = 1 << 15


def parse(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Node rows of files(service, path, language, text), or of these only those of the given types. ord is the order of a file's nodes, of all types; with_ids() adds ids."""

    parsers = dict(PARSERS)  # tasks import this module anew: what was registered goes with the function
    wanted = None if types is None else frozenset(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
        for batch in batches:
            for service, path, language, text in zip(*[batch.column(c).to_pylist() for c in ("service", "path", "language", "text")]):
                for k, n in enumerate(nodes_of(path, language, text or "", parsers)):
                    if wanted is None or n.type in wanted:
                        rows.append((service, path, language, k, n.type, n.name, n.kind, n.line, n.col, n.end_line, list(n.meta.items())))
                if len(rows) >= ROWS:
                    yield give()
                    rows.clear()
        if rows:
            yield give()

    return files.select("service", "path", "language", "text").mapInArrow(run, SCHEMA)


def with_ids(nodes: DataFrame) -> DataFrame:
    """nodes with ids of their own: 96 bits of a hash of service, path and order in the file, which no two nodes share."""
    key = F.concat_ws("\n", F.coalesce("service", F.lit("")), "path", F.col("ord").cast("string"))
    return nodes.withColumn("id", F.concat("type", F.lit(":"), F.left(F.sha1(key), F.lit(24))))
