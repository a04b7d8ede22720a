"""Structure and calls of source files in languages with braces: TypeScript, JavaScript, Go, Rust, Java and PHP.

A scanner of scopes and no grammar: comments and literals are told apart from code, and the words before each
brace say what it opens. Bad code gives what was understood of it. Not seen: Go types in ``type (...)`` groups,
PHP heredocs and code within template literals. Definitions inside functions are part of the function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LINE = r'"(?:\\.|[^"\\\n])*"'
_LINES = r'"(?:\\.|[^"\\])*"'
_QUOTED = r"'(?:\\.|[^'\\\n])*'"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};])|(?<=return))\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_LITERALS = {
    "typescript": rf"{_REGEX}|{_LINE}|{_QUOTED}|`(?:\\.|[^`\\])*`",
    "javascript": rf"{_REGEX}|{_LINE}|{_QUOTED}|`(?:\\.|[^`\\])*`",
    "go": rf"{_LINE}|{_QUOTED}|`[^`]*`",
    "rust": rf"\bb?r(?P<fence>\#*)\".*?\"(?P=fence)|{_LINES}|'(?:\\[^'\n]*|[^'\\\n])'",
    "java": rf'""".*?"""|{_LINE}|{_QUOTED}',
    "php": rf"{_LINES}|'(?:\\.|[^'\\])*'",
}
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_SCAN = {
    k: re.compile(rf"(?P<comment>{_COMMENT}{r'|\#(?!\[)[^\n]*' if k == 'php' else ''})|(?P<literal>{v})|(?P<word>[^\W\d][\w$]*|\$[\w$]+)|\d[\w.]*|(?P<mark>=>|->|::|\S)", re.S)
    for k, v in _LITERALS.items()
}
#: Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for foreach while switch catch match return function fn func typeof await yield new in of and or not elseif array list isset unset empty echo print throw case select go defer range synchronized try do else use import export extends implements where move loop super constructor".split())
_ENDLESS = ("typescript", "javascript", "go")  # statements end with their line
_CLASS = {
    "typescript": r"\b(?:class|interface|enum) ([\w$]+)(.*)",
    "javascript": r"\bclass ([\w$]+)(.*)",
    "go": r"\btype (\w+) (?:\[ .* \] )?(?:struct|interface)()$",
    "rust": r"\b(?:struct|enum|trait|union) (\w+)()",
    "java": r"(?<!\. )\b(?:class|interface|enum|record) (\w+)(.*)",
    "php": r"\b(?:class|interface|trait|enum) (\w+)(.*)",
}
_FUNCTION = {
    "typescript": r"\bfunction (?:\* )?([\w$]+) ((?:<.*> )?\(.*)",
    "javascript": r"\bfunction (?:\* )?([\w$]+) (\(.*)",
    "go": r"^func (\w+) ((?:\[ .* \] )?\(.*)",
    "rust": r"\bfn (\w+) ((?:<.*> )?\(.*)",
    "php": r"\bfunction (?:& )?(\w+) (\(.*)",
}
_MEMBER = {
    "typescript": r"([\w$]+) (?:\? )?((?:<.*?> )?\(.*)",
    "javascript": r"([\w$]+) (\(.*)",
    "java": r"(\w+) (\(.*)",
    "rust": _FUNCTION["rust"],
    "php": _FUNCTION["php"],
}
_ARROW = re.compile(r"\b(?:const|let|var) ([\w$]+) (?:: .*?)?= (?:async )?((?:<.*?> )?\(.*\)(?: : .*?)?|[\w$]+) =>")
_RECEIVER = re.compile(r"^func \( (?:(\w+) )?(?:\* )?(\w+)(?: \[ .*? \])? \) (\w+) (\(.*)")
_SPACE = re.compile(r"\b(?:namespace|mod|module|extern)\b")
_OWN = {"this", "self", "Self", "static", "$this"}


@dataclass
class _Scope:
    kind: str  # class, function, space, plain, or list for the braces of an import
    name: str | None = None
    entity: int | None = None  # its place among the entities, for the last line
    receiver: str | None = None
    caller: _Scope | None = None  # the function around
    shut: bool = False  # in a function or an unknown block, where nothing is defined
    head: list = field(default_factory=list)  # of the statement that goes on after the brace
    depth: int = 0


#: Literals and annotations define nothing.
_ANNOTATION = re.compile(r"@ \w+(?: \. \w+)*(?: \((?:[^()]|\([^()]*\))*\))? ?")


def _text(head: list[tuple[str, int]], language: str) -> str:
    text = " ".join('""' if t[0] in "\"'`" and len(t) > 1 and t[-1] == t[0] else t for t, _ in head)
    return _ANNOTATION.sub("", text) if language in ("java", "typescript", "javascript") else text


def _bare(name: str) -> str:
    return re.split(r"[.\\:]+", name.replace(" ", "").strip("\\"))[-1]


def _bases(tail: str) -> list[str]:
    """Names after extends and implements, without type arguments and qualifiers."""
    flat, before = tail, None
    while flat != before:
        before, flat = flat, re.sub(r"<[^<>]*>", "", flat)
    listed = re.findall(r"\b(?:extends|implements)\b(.*?)(?=\b(?:extends|implements|permits)\b|$)", flat)
    return [b for part in listed for x in part.split(",") if (b := _bare(x)) and re.fullmatch(r"[\w$]+", b)]


def _impl(text: str) -> tuple[str, str] | None:
    """(type, trait or nothing) of an ``impl`` block's head; a function that takes or gives an ``impl`` is none."""
    first = re.search(r"\b(?:impl|fn)\b", text)
    if first is None or first[0] == "fn":
        return None
    flat, depth, before = [], 0, ""
    for w in text[first.end():].split():
        if w == "where" and not depth:
            break
        if w in "<>":
            depth = max(0, depth + (1 if w == "<" else -1))
        elif not depth and before != "'" and w not in ("mut", "dyn", "const") and re.fullmatch(r"\w+|::", w):
            flat.append(w)
        before = w
    base, name = ("".join(flat[: flat.index("for")]), "".join(flat[flat.index("for") + 1:])) if "for" in flat else ("", "".join(flat))
    return (_bare(name), _bare(base) if base else "") if name else None


def _imports(head: list, language: str) -> list[str]:
    words = [t for t, _ in head]
    if language in _ENDLESS:
        quoted = [t[1:-1] for t in words if t[:1] in "\"'`"]
        return quoted if words[0] == "import" else quoted[-1:] if words[0] == "export" and "from" in words else []
    if words[0] == "pub" and language == "rust":
        words = words[words.index("use"):] if "use" in words else words
    if words[0] != {"java": "import"}.get(language, "use"):
        return []
    drop = {"static"} if language == "java" else {"function", "const"}
    path = " ".join(w for w in words[1:] if w not in drop)
    path = re.sub(r" as [^\s,}]+", "", path).replace(" ", "")
    while group := re.search(r"([\w:\\]*)\{([^{}]*)\}", path):
        path = path[: group.start()] + ",".join(group[1] + x for x in group[2].split(",") if x) + path[group.end():]
    return [p.removeprefix("\\").removesuffix("::self") for p in path.split(",") if p]


def parse(source: str, module: str, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(entities, links, calls) of a file, as the parser of Python files gives them."""
    if language == "php":  # text outside the tags is no code
        source = re.sub(r"(?:\A|\?>).*?(?:<\?(?:php\b|=)|\Z)", lambda m: ";" + "\n" * m[0].count("\n"), source, flags=re.S)
    package = {"go": r"^\s*package\s+(\w+)", "java": r"^\s*package\s+([\w.]+)", "php": r"^\s*namespace\s+([\w\\]+)"}.get(language)
    if package and (m := re.search(package, source, re.M)):
        module = m[1]
    last = source.count("\n") + 1
    entities: list[tuple] = [("module", module, 1, last, None, None, "public")]
    links: list[tuple] = []
    calls: list[tuple] = []
    stack: list[_Scope] = []
    head: list[tuple[str, int]] = []
    pending: list[tuple[str, int]] = []
    depth = 0

    def push(scope: _Scope) -> None:
        above = stack[-1] if stack else _Scope("space")
        scope.caller = scope if scope.kind == "function" else above.caller
        scope.shut = above.shut or scope.kind in ("function", "plain")
        stack.append(scope)

    def around() -> _Scope | None:
        return stack[-1].caller if stack else None

    def visibility(name: str, text: str) -> str:
        if language == "go":
            return "public" if name[:1].isupper() else "private"
        if language == "rust":
            return "public" if re.search(r"\bpub\b", text) else "private"
        return "private" if name.startswith("_") or re.search(r"\b(?:private|protected)\b", text.split("(")[0]) else "public"

    def define(kind: str, name: str, owner: str | None, signature: str | None, text: str) -> int:
        line = head[0][1]
        full = f"{owner}.{name}" if owner else name
        entities.append((kind, full, line, line, signature, None, visibility(name, text)))
        links.append((owner or module, full, "DEFINES", line))
        return len(entities) - 1

    def opens() -> _Scope:
        """What the words of ``head`` define, at top level or in a class."""
        text = _text(head, language)
        owner = stack[-1] if stack and stack[-1].kind == "class" else None
        if not head or (stack and stack[-1].shut):
            return _Scope("plain")
        if language == "rust" and not owner and (implemented := _impl(text)):
            name, base = implemented
            if base:
                links.append((name, base, "INHERITS_FROM", head[0][1]))
            return _Scope("class", name)
        if language == "go" and (m := _RECEIVER.match(text)):
            return _Scope("function", f"{m[2]}.{m[3]}", define("method", m[3], m[2], m[4], text), m[1])
        inside = owner is not None and language in _MEMBER
        pattern = _MEMBER[language] if inside else _FUNCTION.get(language)
        m = re.search(pattern, text) if pattern else None
        if m and m[1] not in _NO_CALL - {"constructor"} and not (inside and "=" in text[: m.start()]):
            return _Scope("function", f"{owner.name}.{m[1]}" if inside else m[1], define("method" if inside else "function", m[1], owner.name if inside else None, m[2], text))
        if not owner and language in ("typescript", "javascript") and (m := _ARROW.search(text)):
            return _Scope("function", m[1], define("function", m[1], None, m[2], text))
        if (m := re.search(_CLASS[language], text)) is not None:
            at = define("class", m[1], None, None, text)
            links.extend((m[1], b, "INHERITS_FROM", head[0][1]) for b in _bases(m[2]))
            return _Scope("class", m[1], at)
        return _Scope("space" if _SPACE.search(text) else "plain")

    def called(caller: str | None) -> None:
        if caller:
            calls.extend((caller, name, "CALLS", line) for name, line in pending)
        pending.clear()

    def ends() -> None:
        """The statement in ``head`` ends without a brace."""
        caller = f.name if (f := around()) else None
        if head and not caller:
            if not stack or stack[-1].kind == "space":
                links.extend((module, target, "IMPORTS", head[0][1]) for target in _imports(head, language))
            text = _text(head, language)
            # Members without a body, structs without braces and one-line arrows are defined here.
            in_class = bool(stack) and stack[-1].kind == "class"
            if (in_class and language != "go" and re.search(r"\)", text)) or re.search(r"\bstruct \w+", text) and language == "rust" or (_ARROW.search(text) and not in_class):
                caller = opens().name
                pending[:] = [] if in_class else pending
        called(caller)
        head.clear()

    tokens = [(m.lastgroup if m.lastgroup != "fence" else "literal", m[0].strip(), m.start() + len(m[0]) - len(m[0].lstrip())) for m in _SCAN[language].finditer(source) if m.lastgroup != "comment"]
    line, seen = 1, 0
    for i, (kind, text, start) in enumerate(tokens):
        step = source.count("\n", seen, start)
        line, seen = line + step, start
        if step and head and depth == 0 and language in _ENDLESS:
            before = tokens[i - 1]
            if (before[0] in ("word", "literal") or before[1] in (")", "]", "}", ">")) and before[1] not in ("extends", "implements", "default", "export") and kind in ("word", "literal") and text not in ("extends", "implements", "from", "of", "in", "instanceof"):
                ends()
        if text == "{" and kind == "mark":
            words = [t for t, _ in head]
            listing = bool(stack) and stack[-1].kind == "list" or depth == 0 and (words[:1] in (["import"], ["use"]) or words in (["export"], ["export", "type"]) or words[:2] == ["pub", "use"])
            if listing:
                head.append((text, line))
                push(_Scope("list", depth=depth))
                depth += 1
                continue
            if depth:
                scope = _Scope("plain", head=head[:], depth=depth)
            else:
                scope = opens()
                if scope.kind in ("function", "class"):
                    pending.clear()
            called(f.name if (f := around()) else None)
            push(scope)
            head, depth = [], 0
        elif text == "}" and kind == "mark":
            if stack and stack[-1].kind == "list":
                depth = stack.pop().depth
                head.append((text, line))
                continue
            ends()
            if stack:
                scope = stack.pop()
                if scope.entity is not None:
                    e = entities[scope.entity]
                    entities[scope.entity] = (*e[:3], line, *e[4:])
                head, depth = scope.head, scope.depth
        elif text == ";" and kind == "mark" and depth == 0:
            ends()
        else:
            head.append((text, line))
            if kind == "mark":
                depth = max(0, depth + (text in "([") - (text in ")]"))
            elif kind == "word" and i + 1 < len(tokens) and tokens[i + 1][1] == "(" and text not in _NO_CALL:
                link = tokens[i - 1][1] if i else ""
                holder = tokens[i - 2][1] if i > 1 and link in (".", "->", "::") else ""
                f = around()
                owner = f.name.rpartition(".")[0] if f and f.name else ""
                own = owner and (holder in _OWN or (f.receiver and holder == f.receiver))
                if link not in ("function", "fn", "func", "@"):
                    pending.append((f"{owner}.{text}" if own else text, line))
    ends()
    return entities, links, calls
