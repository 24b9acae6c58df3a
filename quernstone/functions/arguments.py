"""Checks of command lines and tool arguments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import text as T


def argv(command) -> Column:
    """Words of a command; a part in quotes is one word, without them."""
    parts = F.regexp_extract_all(T._col(command), F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0))
    return F.transform(parts, lambda w: F.regexp_replace(w, "[\"']", ""))


def program(words: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.get(words, F.lit(0))), r"\.exe$", ""))


def program_allowed(words: Column, programs=fixed.SHELL_PROGRAMS) -> Column:
    return F.coalesce(program(words).isin(*programs), F.lit(False))


def arguments_safe(words: Column) -> Column:
    """Whether a command of a program with blocked subcommands or flags has none of them."""
    sub = F.lower(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    fine = F.lit(True)
    for name, blocked in fixed.BLOCKED_SUBCOMMANDS.items():
        fine = fine & ((program(words) != name) | ~sub.isin(*blocked))
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0)))
    flagged = F.exists(rest, lambda w: F.lower(w).isin(*fixed.BLOCKED_GIT_FLAGS))
    return F.coalesce(fine & ~((program(words) == "git") & flagged), F.lit(False))


def resolved(path: Column, root: str) -> Column:
    """A path with what it is relative to in front, ``.`` and ``x/..`` taken out."""
    bare = F.trim(path)
    whole = F.when(bare == "", root).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), bare))
    kept = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda got, part: F.when(part.isin("", "."), got).when(part == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.concat(got, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def under(path: Column, roots: list[str]) -> Column:
    fine = F.lit(False)
    for root in roots:
        fine = fine | (path == root) | path.startswith(root.rstrip("/") + "/")
    return fine


def tool_warnings(tool: Column, arguments: Column, roots: list[str]) -> Column:
    """Warnings for a tool's JSON arguments: paths outside the roots. No warning, valid."""
    out = F.array().cast("array<string>")
    for name, key, passes, warning in fixed.PATH_ARGUMENTS:
        value = F.get_json_object(arguments, f"$.{key}")
        bad = (tool == name) & value.isNotNull() & ~under(resolved(value, roots[0]), roots)
        bad = bad & (F.trim(value) != "") if passes else bad
        out = F.concat(out, F.when(bad, F.array(F.concat(F.lit(warning), value))).otherwise(F.array().cast("array<string>")))
    for name, key, warning in fixed.PATH_LISTS:
        values = F.coalesce(F.from_json(F.get_json_object(arguments, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
        outside = F.filter(values, lambda v: ~under(resolved(v, roots[0]), roots))
        found = F.transform(outside, _warned(warning))
        out = F.concat(out, F.when(tool == name, found).otherwise(F.array().cast("array<string>")))
    return out


def _warned(warning: str):
    return lambda value: F.concat(F.lit(warning), value)
