"""Which elements the style sheets of a page hide: ``display`` and ``visibility`` by the cascade.

Read: selectors of tags, classes, ids, attributes, ``:root`` and ``:not()`` of these, joined by descent or ``>``; ``@media`` (and the
``media`` of a sheet) as a desktop screen of WIDTH x HEIGHT CSS pixels answers it, ``@supports`` as a present-day
browser does, and ``@layer``. Of several declarations the cascade decides: importance, the ``style`` attribute, layers, specificity, order.

Left aside, so that they neither hide nor show: other pseudo-classes, sibling selectors, rules nested in
rules, ``@container`` and ``@scope``, and sheets in other files.
"""

from __future__ import annotations

import re

#: The screen that answers media queries.
WIDTH, HEIGHT = 1280, 720
SCREEN = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "forced-colors": "none", "hover": "hover", "any-hover": "hover",
    "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "display-mode": "browser", "update": "fast", "color": "8", "monochrome": "0", "grid": "0",
}
UNITS = {"px": 1, "": 1, "em": 16, "rem": 16, "pt": 4 / 3, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54}
VALUES = {
    "display": re.compile(r"(?:(?:inline|block|run-in|flow|flow-root|flex|grid|table|ruby|math|list-item|contents|none|inline-\w+|(?:table|ruby)-[a-z-]+|-webkit-(?:inline-)?(?:box|flex)|inherit|initial|unset|revert|revert-layer)\b(?!-)\s*)+|.*var\(.*", re.S),
    "visibility": re.compile(r"visible|hidden|collapse|inherit|initial|unset|revert|revert-layer|.*var\(.*", re.S),
}
DECLARATION = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([^;{}]*)", re.I)
QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|\\.|<!--|-->", re.S)
NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
PIECE = re.compile(rf"([.#])({NAME})|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|{NAME})\s*([iIsS])?\s*)?\]|(:root)(?![\w(-])|:not\(((?:[^()])*)\)|({NAME}|\*)")
COMMAS = re.compile(r"(?:\\.|\[[^\]]*\]|\([^()]*\)|[^,])+")
#: A compound selector: tests of (kind, name, operator, value), all of which hold.
Compound = tuple[tuple, ...]


def plain(css: str) -> str:
    """Without comments, and without strings that hold what structures a sheet."""

    def one(m: re.Match) -> str:
        s = m.group()
        if s[0] == "\\":
            return s if s[1] not in "{};," else f"\\{ord(s[1]):x} "
        return ("" if s[0] in "/<-" else '"\x00"' if set(s) & set("{};,") else s)

    return QUOTED.sub(one, css)


def unescape(name: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], name, flags=re.S) if "\\" in name else name


def compound(source: str) -> tuple[Compound, tuple[int, int, int]] | None:
    """Tests and specificity; None where the selector isn't read."""
    tests, rank, at = [], [0, 0, 0], 0
    while at < len(source):
        m = PIECE.match(source, at)
        if not m or (m[9] and at):
            return None
        at = m.end()
        if m[1]:
            tests.append((m[1], unescape(m[2])))
            rank[m[1] == "."] += 1
        elif m[3]:
            value = unescape(m[5][1:-1] if m[5][0] in "\"'" else m[5]) if m[5] else ""
            tests.append(("[", m[3].lower(), m[4] or "", value.lower() if (m[6] or "") in "iI" and m[6] else value, (m[6] or "").lower() == "i"))
            rank[1] += 1
        elif m[7]:
            tests.append(("root",))
            rank[1] += 1
        elif m[8] is not None:
            parts = [compound(x.strip()) for x in COMMAS.findall(m[8])]
            if not parts or not all(parts):
                return None
            tests.append(("not", tuple(p[0] for p in parts)))
            most = max(p[1] for p in parts)
            rank = [a + b for a, b in zip(rank, most, strict=True)]
        elif m[9] != "*":
            tests.append(("tag", unescape(m[9]).lower()))
            rank[2] += 1
    return (tuple(tests), tuple(rank)) if source else None


def selector(source: str) -> tuple[tuple[tuple[str, Compound], ...], tuple[int, int, int]] | None:
    """((what joins it to the one before, compound), ...) from left to right, and the specificity."""
    parts, rank, join = [], (0, 0, 0), ""
    for x in re.findall(r">|(?:\\[0-9a-fA-F]{1,6}\s?|\\.|\[[^\]]*\]|\([^()]*\)|[^\s>])+", source):
        if x == ">":
            if join == ">" or not parts:
                return None
            join = ">"
            continue
        got = compound(x)
        if not got:
            return None
        parts.append((join if parts else "", got[0]))
        rank, join = tuple(a + b for a, b in zip(rank, got[1], strict=True)), " "
    return (tuple(parts), rank) if parts and join != ">" else None


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """Property -> whether important, and value: what wins of one block's."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value in DECLARATION.findall(body):
        value, important = re.subn(r"\s*!\s*important\s*$", "", value.strip().lower())
        name = name.lower()
        if VALUES[name].fullmatch(value) and (important or not found.get(name, (False,))[0]):
            found[name] = (bool(important), value)
    return found


def length(value: str) -> float | None:
    m = re.fullmatch(r"(-?[\d.]+)\s*([a-z]*)", value.strip())
    try:
        return float(m[1]) * UNITS[m[2]] if m else None
    except (KeyError, ValueError):
        return None


def feature(source: str) -> bool | None:
    """Of the screen; None if it isn't known."""
    sizes = {"width": WIDTH, "height": HEIGHT, "device-width": WIDTH, "device-height": HEIGHT}
    name, colon, value = (x.strip() for x in source.partition(":"))
    if colon:
        least, most, name = name.startswith("min-"), name.startswith("max-"), re.sub(r"^(min|max)-", "", name)
        if name in sizes:
            n = length(value)
            return None if n is None else sizes[name] >= n if least else sizes[name] <= n if most else sizes[name] == n
        if name in ("aspect-ratio", "device-aspect-ratio", "resolution"):
            m = re.fullmatch(r"([\d.]+)\s*(?:/\s*([\d.]+))?\s*(dppx|x|dpi)?", value)
            try:
                n, have = float(m[1]) / float(m[2] or 1) / (96 if m[3] == "dpi" else 1), 1 if name == "resolution" else WIDTH / HEIGHT
            except (TypeError, ValueError, ZeroDivisionError):
                return None
            return have >= n if least else have <= n if most else have == n
        return None if name not in SCREEN else int(SCREEN[name]) >= int(value) if least and value.isdigit() else int(SCREEN[name]) <= int(value) if most and value.isdigit() else SCREEN[name] == value
    bits = re.split(r"\s*(<=|>=|<|>|=)\s*", name)
    if len(bits) in (3, 5):
        numbers = [sizes.get(x, length(x)) for x in bits[::2]]
        if None in numbers:
            return None
        return all({"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "=": a == b}[op] for a, op, b in zip(numbers, bits[1::2], numbers[1:]))
    return True if name in sizes else SCREEN[name] not in ("0", "none") if name in SCREEN else None


def condition(source: str, leaf) -> bool | None:
    """Of parenthesised tests with not, and, or; None: unknown."""
    source, parts, words, depth, begin = source.strip(), [], [], 0, 0
    for m in re.finditer(r"[()]|[a-z-]+(?=[\s(])", source):
        if m[0] == "(":
            begin = m.end() if not depth else begin
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if depth < 0:
                return None
            if not depth:
                parts.append(source[begin : m.start()].strip())
        elif not depth:
            words.append(m[0])
    if depth or not parts:
        return None
    values = [condition(x, leaf) if x.startswith("(") or re.match(r"not\s*\(", x) else leaf(x) for x in parts]
    if words[:1] == ["not"] and len(parts) == 1:
        return None if values[0] is None else not values[0]
    if set(words) & {"or"}:
        return True if True in values else None if None in values else False
    return False if False in values else None if None in values else True


def media(source: str) -> bool:
    """Whether a list of media queries applies to the screen."""

    def one(query: str) -> bool:
        m = re.fullmatch(r"(?:(not|only)\s+)?([a-z][a-z-]*)(?:\s+and\b(.*))?", query, re.S)
        if not m or m[2] == "not":
            return condition(query, feature) is True
        holds = condition(m[3], feature) if m[3] is not None else True
        holds = holds if m[2] in ("all", "screen") else False
        return holds is False if m[1] == "not" else holds is True

    source = source.strip().lower()
    return not source or any(one(q.strip()) for q in COMMAS.findall(source))


def supports(source: str) -> bool:
    return condition(source.lower(), lambda x: not re.match(r"-(ms|moz|o)-", x)) is True


class Sheet:
    """The rules of a page's sheets, in their order, by a key of their last compound."""

    def __init__(self, sheets: list[tuple[str, str]]):
        self.rules: dict[tuple, list[tuple]] = {}
        self.layers: dict[str, int] = {}
        self.n = 0
        for query, css in sheets:
            if media(query):
                self.read(plain(css))

    def read(self, css: str) -> None:
        """A stack of open blocks: rules apply (with their layer), are skipped, or are a rule's own."""
        stack: list[tuple[str, str | None]] = []
        body: list[str] = []
        prelude, start = "", 0
        for m in re.finditer(r"[{};]", css):
            kind, layer = stack[-1] if stack else ("apply", None)
            text = css[start : m.start()].strip()
            if m[0] == ";":
                if kind == "rule":
                    body.append(text)
                elif kind == "apply" and (names := re.fullmatch(r"@layer\s+(.+)", text, re.S | re.I)):
                    for x in names[1].split(","):
                        self.layers.setdefault((layer + "." if layer else "") + x.strip(), len(self.layers))
            elif m[0] == "{":
                at = re.match(r"@([\w-]+)\s*(.*)", text, re.S)
                if kind != "apply":
                    stack.append(("skip", None))
                elif not at:
                    stack.append(("rule", layer))
                    prelude, body = text, []
                elif at[1].lower() == "layer":
                    name = (layer + "." if layer else "") + (at[2].strip() or f" {len(self.layers)}")
                    self.layers.setdefault(name, len(self.layers))
                    stack.append(("apply", name))
                else:
                    holds = {"media": media, "supports": supports}.get(at[1].lower())
                    stack.append(("apply" if holds and holds(at[2]) else "skip", layer))
            elif stack:
                stack.pop()
                if kind == "rule":
                    self.add(prelude, [*body, text], layer)
            else:
                continue
            start = m.end()
        for kind, layer in stack:
            if kind == "rule":
                self.add(prelude, [*body, css[start:] if stack[-1][0] == "rule" else ""], layer)

    def add(self, selectors: str, body: list[str], layer: str | None) -> None:
        found = declarations(";".join(body))
        if not found:
            return
        for source in COMMAS.findall(selectors):
            if got := selector(source):
                parts, rank = got
                self.n += 1
                last = parts[-1][1]
                key = next((t[:2] for kind in ("#", ".", "tag") for t in last if t[0] == kind), ())
                self.rules.setdefault(key, []).append((parts, rank, self.n, layer, found))

    def matching(self, node) -> list[tuple]:
        if not self.rules:
            return []
        keys = [(), ("tag", node.tag), *([("#", node.attrs["id"])] if "id" in node.attrs else []), *((".", c) for c in dict.fromkeys(node.attrs.get("class", "").split()))]
        return [r for k in keys for r in self.rules.get(k, ())]


def meets(node, tests: Compound) -> bool:
    attrs = node.attrs
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = node.tag == t[1]
        elif kind == ".":
            ok = t[1] in attrs.get("class", "").split()
        elif kind == "#":
            ok = attrs.get("id") == t[1]
        elif kind == "root":
            ok = node.parent is None
        elif kind == "not":
            ok = not any(meets(node, x) for x in t[1])
        else:
            _, name, op, want, fold = t
            have = attrs.get(name)
            if have is not None and fold:
                have = have.lower()
            ok = have is not None and (
                not op or (have == want if op == "=" else want != "" and (want in have.split() if op == "~=" else have == want or have.startswith(want + "-") if op == "|=" else have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have))
            )
        if not ok:
            return False
    return True


class Cascade:
    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.memo: dict[tuple, bool] = {}

    def holds(self, parts: tuple, k: int, node) -> bool:
        if not meets(node, parts[k][1]):
            return False
        if k == 0:
            return True
        if parts[k][0] == ">":
            return node.parent is not None and self.holds(parts, k - 1, node.parent)
        return self.above(parts, k - 1, node)

    def above(self, parts: tuple, k: int, node) -> bool:
        """Whether an element that encloses node meets parts up to k."""
        up, key = node.parent, (id(node.parent), id(parts), k)
        if up is None:
            return False
        if key not in self.memo:
            self.memo[key] = self.holds(parts, k, up) or self.above(parts, k, up)
        return self.memo[key]

    def values(self, node) -> dict[str, str]:
        """What sheets and the style attribute say of display and visibility."""
        best: dict[str, tuple[tuple, str]] = {}
        last = len(self.sheet.layers)
        for parts, rank, order, layer, found in self.sheet.matching(node):
            if self.holds(parts, len(parts) - 1, node):
                level = last if layer is None else self.sheet.layers[layer]
                for name, (important, value) in found.items():
                    key = (important, False, -level if important else level, rank, order)
                    if name not in best or key > best[name][0]:
                        best[name] = (key, value)
        style = node.attrs.get("style") if node.attrs else None
        if style:
            for name, (important, value) in declarations(plain(style)).items():
                if name not in best or (important, True) > best[name][0][:2]:
                    best[name] = ((important, True), value)
        return {name: value for name, (_, value) in best.items()}
