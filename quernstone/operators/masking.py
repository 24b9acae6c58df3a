"""Sources of brace languages with all that isn't code blanked: comments, strings, raw
strings, templates, regular expressions and the text of JSX elements. Lengths and line
breaks stay, so a place in the masked source is the same place in the source. What is not
closed ends where its kind allows it: a string of one line with the line, all else with the
source. Expressions inside templates and JSX stay, without their braces.
"""

from __future__ import annotations

import re

# neighbouring lines of comments are one token
_RUST = re.compile(r"""//[^\n]*(?:\n[ ]*//[^\n]*)*|/\*|\b(?:b|c)?r(\#*)"|b?"(?:\\.|[^"\\])*"?|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^\\'\n])'""", re.S)
_NESTED = re.compile(r"/\*|\*/")
_TS = re.compile(r"""//[^\n]*(?:\n[ ]*//[^\n]*)*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[\w$]+|\s+|.""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_TAG = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*)?(?=[\s/>{])")
#: What an expression may follow; after anything else a slash divides and < compares.
_BEFORE_VALUE = set("(,=:[!&|?{};+-*%^~<>}") | {"", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default"}


class _Mask:
    def __init__(self, source: str):
        self.source, self.out = source, list(source)

    def hide(self, start: int, end: int) -> int:
        self.out[start:end] = "\n".join(" " * len(line) for line in self.source[start:end].split("\n"))
        return end

    def text(self) -> str:
        return "".join(self.out)


def _rust(source: str) -> str:
    mask, at = _Mask(source), 0
    while m := _RUST.search(source, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (n := _NESTED.search(source, end)):
                depth, end = depth + (1 if n[0] == "/*" else -1), n.end()
            end = len(source) if depth else end
        elif m[1] is not None:
            close = source.find('"' + m[1], end)
            end = len(source) if close < 0 else close + 1 + len(m[1])
        at = mask.hide(m.start(), end)
    return mask.text()


class _Script(_Mask):
    """TypeScript and JavaScript, with JSX where it may stand."""

    def __init__(self, source: str, jsx: bool):
        super().__init__(source)
        self.jsx = jsx

    def code(self, at: int, inside: bool = False) -> int:
        """Masks from ``at`` to the end, or to the brace that closes an expression."""
        source, depth, before = self.source, 0, ""
        while at < len(source):
            m = _TS.match(source, at)
            token, end = m[0], m.end()
            if token[:2] in ("//", "/*"):
                at = self.hide(at, end)
                continue
            if token[0] in "\"'":
                at, before = self.hide(at, end), '"'
                continue
            if token == "`":
                at, before = self.template(at), '"'
                continue
            if token == "/" and before in _BEFORE_VALUE and (r := _REGEX.match(source, at)):
                at, before = self.hide(at, r.end()), '"'
                continue
            if token == "<" and self.jsx and before in _BEFORE_VALUE and _TAG.match(source, at):
                at, before = self.element(at), '"'
                continue
            if token == "}" and not depth and inside:
                return at
            depth += (token == "{") - (token == "}" and depth > 0)
            before = before if token.isspace() else token
            at = end
        return at

    def expression(self, at: int) -> int:
        """An expression in braces of a template or of JSX, from behind the opening one."""
        end = self.code(at, True)
        return self.hide(end, min(end + 1, len(self.source)))

    def template(self, at: int) -> int:
        start, at = at, at + 1
        while m := _TEMPLATE.search(self.source, at):
            at = m.end()
            if m[0] == "`":
                return self.hide(start, at)
            if m[0] == "${":
                self.hide(start, at)
                start = at = self.expression(at)
        return self.hide(start, len(self.source))

    def element(self, at: int) -> int:
        source = self.source
        at = self.hide(at, _TAG.match(source, at).end())
        while at < len(source) and source[at] != ">":  # attributes
            if source.startswith("/>", at):
                return self.hide(at, at + 2)
            if source[at] in "\"'":
                end = source.find(source[at], at + 1)
                at = self.hide(at, len(source) if end < 0 else end + 1)
            elif source[at] == "{":
                at = self.expression(self.hide(at, at + 1))
            else:
                at = self.hide(at, at + 1)
        at = self.hide(at, min(at + 1, len(source)))
        while at < len(source):  # children
            if source.startswith("</", at):
                end = source.find(">", at)
                return self.hide(at, len(source) if end < 0 else end + 1)
            if source[at] == "{":
                at = self.expression(self.hide(at, at + 1))
            elif _TAG.match(source, at):
                at = self.element(at)
            else:
                at = self.hide(at, at + 1)
        return at


def masked(source: str, ext: str) -> str:
    """The source with what isn't code blanked."""
    if ext == "rs":
        return _rust(source)
    mask = _Script(source, ext != "ts")
    try:
        mask.code(0)
    except RecursionError:  # elements within elements beyond reason: what is masked so far
        pass
    return mask.text()


def without_comments(source: str) -> str:
    """A script with its comments blanked and its strings kept."""
    mask, at = _Mask(source), 0
    while at < len(source):
        m = _TS.match(source, at)
        at = mask.hide(at, m.end()) if m[0][:2] in ("//", "/*") else m.end()
    return mask.text()
