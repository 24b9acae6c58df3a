"""Front matter whose plain values YAML can't read, quoted.

Every line is scanned by YAML's rules for what a value may be: a quoted scalar, a flow
sequence or mapping, a block scalar, an alias, an anchor or tag, or a plain scalar, which
must not start with an indicator nor hold a colon that a blank or its end follows. A text
is changed only if some value of it breaks one of these rules and can be quoted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signs that a plain scalar can't start with, and those that end one in a flow.
INDICATORS = ",[]{}#&*!|>'\"%@`"
FLOW_SIGNS = ",[]{}"

#: Kinds of finding: a value reads well, reads as something else than its text, or not at all.
FINE, LOST, BROKEN, HOPELESS = range(4)

_BLOCK = re.compile(r"[|>][-+0-9]{0,2}(\s+#.*)?$")
_NAMED = re.compile(r"([&!]\S*(\s|$))|(\*[^\s,\[\]{}]+$)")


@dataclass
class Line:
    """A line before, at and behind its value."""

    head: str
    value: str = ""
    finding: int = FINE
    better: str = field(default="")


def quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _end_of_quote(text: str, at: int) -> int:
    """The place behind the quoted scalar that starts at ``at``, or -1."""
    sign, k = text[at], at + 1
    while k < len(text):
        if sign == '"' and text[k] == "\\":
            k += 2
        elif text[k] != sign:
            k += 1
        elif sign == "'" and text[k + 1 : k + 2] == "'":
            k += 2
        else:
            return k + 1
    return -1


def _plain(value: str, in_flow: bool) -> int:
    """What YAML makes of a plain scalar."""
    if value[0] == "#":
        # a comment; in a flow it takes the closing sign along
        return BROKEN if in_flow else LOST if value[1:2].strip() else FINE
    if value[0] in INDICATORS or (value[0] in "-?:" and value[1:2] in ("", " ", "\t")):
        return BROKEN
    text = re.split(r"\s#", value, maxsplit=1)[0].rstrip()
    if text.endswith(":") or re.search(r":\s", text) or (in_flow and set(text) & set(FLOW_SIGNS)):
        return BROKEN
    return FINE


def _sequence(value: str) -> tuple[int, str]:
    """A flow sequence with its items quoted where they have to be."""
    items, at, depth, start = [], 1, 1, 1
    while at < len(value) and depth:
        if value[at] in "\"'" and not value[start:at].strip():
            end = _end_of_quote(value, at)
            if end < 0:
                return HOPELESS, value
            at = end
            continue
        if value[at] in "[{":
            depth += 1
        elif value[at] in "]}":
            depth -= 1
        if not depth or (depth == 1 and value[at] == ","):
            items.append(value[start:at].strip())
            start = at + 1
        at += 1
    if depth or value[at:].strip():
        return HOPELESS, value
    worst, out = FINE, []
    for item in items:
        finding = FINE if not item or item[0] in "\"'[{" else _plain(item, True)
        worst = max(worst, finding)
        out.append(quoted(item) if finding > FINE else item)
    return worst, "[" + ", ".join(out) + "]"


def _value(value: str) -> tuple[int, str]:
    """What YAML makes of the value of a key, and the value that says the same."""
    if not value or _BLOCK.match(value) or _NAMED.match(value):
        return FINE, value
    if value[0] == "[":
        return _sequence(value)
    if value[0] == "{":
        return (FINE if value.rstrip().endswith("}") else HOPELESS), value
    if value[0] in "\"'":
        end = _end_of_quote(value, 0)
        rest = value[end:].strip() if end > 0 else "?"
        return (FINE, value) if not rest or rest.startswith("#") else (BROKEN, quoted(value))
    finding = _plain(value, False)
    return finding, quoted(value) if finding else value


def scanned(lines: list[str]) -> list[Line]:
    out, inside = [], -1  # inside: indentation of the key whose block scalar goes on
    for text in lines:
        indent = len(text) - len(text.lstrip(" "))
        if inside >= 0 and (not text.strip() or indent > inside):
            out.append(Line(text))
            continue
        inside = -1
        key = re.match(r"( *(?:- +)*[^\s:#\"'\[\]{}&*!|>%@`,][^:#]*:)[ \t]+(?=\S)", text)
        item = None if key else re.match(r"( *(?:- +)+)(?=\S)", text)
        found = key or item
        if not found:
            out.append(Line(text))
            continue
        value = text[found.end() :].rstrip()
        finding, better = _value(value)
        if item and re.match(r"[^\s\"'\[{][^:]*:(\s|$)", value):
            finding, better = FINE, value  # a mapping in a list
        out.append(Line(text[: found.end()], value, finding, better))
        if _BLOCK.match(value):
            inside = indent
    return out


def repaired(content: str) -> str:
    """A text with the values of its front matter quoted that break it; as it is where
    there are none, or where quoting values isn't enough."""
    if not content.startswith("---") or (end := content.find("---", 3)) < 0:
        return content
    lines = scanned(content[3:end].splitlines())
    worst = max((line.finding for line in lines), default=FINE)
    if worst != BROKEN:
        return content
    return "---" + "\n".join(line.head + (line.better if line.finding else line.value) for line in lines) + "\n" + content[end:]


@F.pandas_udf(StringType())
def repaired_front_matter(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repaired(t))
