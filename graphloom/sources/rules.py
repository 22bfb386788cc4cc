"""Rules of the parse layer as a table: what a pattern finds becomes a node of a type, with named groups as its fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TS, JVM = ("typescript", "javascript"), ("java", "kotlin")
#: A string's inside as group `name`.
STRING = r"[\"'`](?P<{}>[^\"'`]*)[\"'`]"


@dataclass
class Rule:
    languages: tuple[str, ...]
    type: str
    pattern: re.Pattern
    kind: str | None = None  # fixed, else group `kind`
    meta: dict[str, str] = field(default_factory=dict)
    block: bool = False  # the node ends where the braces after it do


def _r(languages: tuple[str, ...], type_: str, pattern: str, kind: str | None = None, block: bool = False, **meta: str) -> Rule:
    return Rule(languages, type_, re.compile(pattern, re.S if block else 0), kind, meta, block)


def s(name: str) -> str:
    return STRING.format(name)


RULES = [
    # telemetry
    _r(TS, "telemetry", r"\b\w*[tT]racer\w*\.(?:startSpan|startActiveSpan)\(\s*" + s("name"), "span"),
    _r(TS, "telemetry", r"\b\w*[mM]eter\w*\.create(?P<name>Counter|Histogram|UpDownCounter|ObservableGauge)\(", "metric"),
    _r(TS, "telemetry", r"\b(?P<name>context\.with|propagation\.(?:inject|extract)|trace\.setSpan)\(", "context"),
    _r((*TS, *JVM), "telemetry", r"@(?P<name>Span|Trace|WithSpan|Traced)\b", "span"),
    _r(("go",), "telemetry", r"\b\w*[tT]racer\w*\.Start\(\s*\w+\s*,\s*" + s("name"), "span"),
    _r(JVM, "telemetry", r"\b\w*[tT]racer\w*\.spanBuilder\(\s*" + s("name"), "span"),
    # listeners and signals
    _r(JVM, "event", r"@KafkaListener\([^)]*?topics\s*=\s*\{?\s*" + s("name"), "consume", channel="kafka"),
    _r(JVM, "event", r"@RabbitListener\([^)]*?queues\s*=\s*\{?\s*" + s("name"), "consume", channel="rabbitmq"),
    _r(JVM, "event", r"@EventListener\b[^\n]*\n\s*(?:public\s+)?\w+\s+\w+\(\s*(?P<name>\w+)", "consume", channel="spring"),
    _r(JVM, "event", r"\bpublishEvent\(\s*new\s+(?P<name>\w+)", "publish", channel="spring"),
    _r(TS, "event", r"@(?:EventPattern|MessagePattern)\(\s*" + s("name"), "consume", channel="nest"),
    # outbound calls of interfaces
    _r(JVM, "feign", r"@FeignClient\((?P<args>[^)]*)\)\s*(?:public\s+)?interface\s+(?P<name>\w+)", block=True),
    # endpoints in other layouts
    _r(TS, "route", r"\.route\(\s*\{(?P<body>[^}]*?(?:url|path)\s*:\s*[^}]*)\}", block=False),
    # schemas
    _r((*TS, *JVM), "entity", r"@Entity\((?P<args>[^)]*)\)[^{]*?\bclass\s+(?P<name>\w+)|@Entity\b[^{(]*?\bclass\s+(?P<name2>\w+)", block=True),
    _r(("go",), "entity", r"\btype\s+(?P<name>[A-Z]\w*)\s+struct\s*(?=\{)", block=True),
    # data and assignments
    _r(TS, "data", r"(?:^|\n)[ \t]*(?:export\s+)?type\s+(?P<name>[A-Z]\w*)(?:<[^=\n]*>)?\s*=", "type"),
    _r(TS, "data", r"(?:^|\n)(?:export\s+)?(?P<kind>const|let)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?!async\b|\(|function\b)", None, scope="module"),
    _r(TS, "process", r"(?:^|\n)[ \t]+(?P<name>(?:this\.)?\w+(?:\.\w+)*)\s*(?P<kind>=|\+=|-=|\*=|\?\?=|\|\|=|&&=)(?![=>])[^\n]*", None),
]

#: Prefixes of repository methods and what they do.
PREFIXES = [("findFirst", "findFirst"), ("findBy", "findMany"), ("findAllBy", "findMany"), ("deleteBy", "deleteMany"), ("countBy", "count"), ("existsBy", "count")]
#: Marks of what a return answers with, the first that is there.
RESPONSES = [("json", (".json(", "JSON.stringify")), ("redirect", (".redirect(",)), ("html", (".render(",)), ("file", (".sendFile(", ".download(")), ("stream", (".pipe(", "stream"))]


def operation_of(verb: str) -> str | None:
    """What a repository method does by its prefix."""
    return next((op for p, op in PREFIXES if verb.startswith(p) and verb[len(p) : len(p) + 1].isupper()), None)


def answer(text: str) -> dict[str, str]:
    """The status and kind of answer that a return's text shows."""
    out = {}
    if m := re.search(r"\.status\((\d{3})\)|statusCode\s*:\s*(\d{3})", text):
        out["status"] = m[1] or m[2]
    if kind := next((k for k, marks in RESPONSES if any(x in text for x in marks)), None):
        out["responseType"] = kind
    return out


def columns(language: str, body: str, at: int) -> list[tuple[str, str, int, dict[str, str]]]:
    """(name, type, place, facts) of the columns in an entity's body, which starts at `at`."""
    out = []
    if language == "go":
        for m in re.finditer(r"(?:^|\n)[ \t]*([A-Z]\w*)[ \t]+([\w.*\[\]]+)(?:[ \t]+`([^`]*)`)?", body):
            tag = re.search(r'gorm:"([^"]*)"', m[3] or "")
            facts = (tag[1] if tag else "").lower()
            named = re.search(r"column:(\w+)", facts)
            out.append((named[1] if named else re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", m[1]).lower(), m[2], at + m.start(1), {"primaryKey": str("primarykey" in facts or m[1] == "ID").lower(), "unique": str("unique" in facts).lower()}))
        return out
    pattern = r"@(PrimaryGeneratedColumn|PrimaryColumn|Column|Id|ManyToOne|JoinColumn)\b(?:\(([^)]*)\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|public|protected|final|readonly)\s+)*(?:([\w<>\[\]]+)\s+(\w+)\s*[;=]|(\w+)[?!]?\s*:\s*([\w<>\[\]]+))"
    for m in re.finditer(pattern, body):
        name, kind = (m[4], m[3]) if m[4] else (m[5], m[6])
        given = re.search(r"name\s*[:=]\s*[\"'](\w+)[\"']", m[2] or "")
        out.append((given[1] if given else name, kind, at + m.start(), {"primaryKey": str(m[1] in ("PrimaryGeneratedColumn", "PrimaryColumn", "Id")).lower(), "unique": str(bool(re.search(r"unique\s*[:=]\s*true", m[2] or ""))).lower()}))
    return out


#: Attributes of screens and what triggers them; kinds of components by name, in order.
TRIGGERS = {"onClick": "click", "onPress": "press", "onChange": "change", "onSubmit": "submit", "onFocus": "focus", "onBlur": "blur", "onKeyDown": "keydown", "onMouseEnter": "hover", "onScroll": "scroll", "onLoad": "load"}
COMPONENT_KINDS = [("form", "Form$"), ("modal", "Modal|Dialog|Drawer"), ("list", "List|Table|Grid"), ("navigation", "Nav|Menu|Sidebar|Header|Footer"), ("input", "Input|Select|Button|Field"), ("card", "Card|Item"), ("layout", "Layout|Container")]
FRONTEND = re.compile(r"(?:\.(?:tsx|jsx)$)|/(?:pages|screens|views|components|ui|app)/")


def screens(path: str, code: str, text: str, close: dict[int, int]) -> list[tuple[str, str, str, int, int, dict[str, str]]]:
    """(type, name, kind, start, end, facts) of screens, components, their events and calls, in a frontend file: capitalised functions that return markup."""
    out = []
    for m in re.finditer(r"(?:^|\n)[ \t]*(?:export\s+)?(?:default\s+)?(?:function\s+([A-Z]\w*)\s*\([^)]*\)[^{]*\{|const\s+([A-Z]\w*)\s*(?::[^=\n]+)?=\s*\([^)]*\)[^{\n]*=>\s*[{(])", code):
        name = m[1] or m[2]
        end = close.get(m.end() - 1, len(code) - 1)
        body = text[m.end() : end]
        tags = re.findall(r"<([A-Za-z][\w.]*)[\s/>]", body)
        if not tags:
            continue
        is_screen = bool(re.search(r"(?:Page|Screen|View)$", name) or re.search(r"/(?:pages|screens|views|app)/", "/" + path))
        kind = next((k for k, p in COMPONENT_KINDS if re.search(p, name)), "component")
        hooks = sorted(set(re.findall(r"\b(use[A-Z]\w*)\(", body)))
        facts = {"hooks": ",".join(hooks), "references": ",".join(dict.fromkeys(t for t in tags if t[0].isupper())), "state": ",".join(re.findall(r"\[\s*(\w+)\s*,\s*set\w+\s*\]\s*=\s*useState", body))}
        if is_screen:
            base = re.sub(r"(?:Page|Screen|View)$", "", name) or name
            facts["route"] = "/" + base.lower()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append(("screen" if is_screen else "component", name, "screen" if is_screen else kind, start, end, facts))
        for e in re.finditer(r"\b(on[A-Z]\w*)=\{\s*(?:\(\)\s*=>\s*)?([\w.]+)", body):
            if e[1] in TRIGGERS:
                at = m.end() + e.start()
                out.append(("frontendEvent", e[2], TRIGGERS[e[1]], at, at, {"in": name, "action": action(e[2], body)}))
    return out


def action(handler: str, body: str) -> str:
    """What a handler does, by its text: the first of these that is there."""
    own = re.search(rf"\b{re.escape(handler)}\b\s*=\s*[^;]*?=>\s*\{{(.*?)\n\s*\}}|function\s+{re.escape(handler)}\s*\([^)]*\)\s*\{{(.*?)\n\s*\}}", body, re.S)
    text = (own[1] or own[2] or "") if own else handler
    for kind, pattern in (("api_call", r"\bfetch\(|axios|\bapi\.|\.mutate\("), ("navigate", r"navigate\(|router\.push|history\.push"), ("analytics", r"\btrack\(|analytics"), ("state_update", r"\bset[A-Z]\w*|dispatch\(")):
        if re.search(pattern, text):
            return kind
    return "side_effect"
