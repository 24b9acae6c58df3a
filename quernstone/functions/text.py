"""Scalar text functions: column in, column out, all built on JVM-side functions."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    """White space off both ends (not only spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def tokens(c) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _accented() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with marks, and these letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in string.ascii_lowercase and all(map(unicodedata.combining, parts[1:])):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accented()
#: Combining marks; they have no counterpart, so they go.
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def terms(c) -> Column:
    """Tokens as keyword search sees them: without accents."""
    low = F.lower(_col(c))
    # looked up letter by letter, so not where all are ASCII
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED + _MARKS, _PLAIN))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def words(c) -> Column:
    return F.filter(F.split(_col(c), r"\s+"), lambda t: t != "")


def contains_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def like_literal(c) -> Column:
    """Escapes what LIKE would read as a pattern; the backslash first."""
    c = _col(c)
    for sign in ("\\", "%", "_"):
        c = F.replace(c, F.lit(sign), F.lit("\\" + sign))
    return c


def phrase_query(c) -> Column:
    """Every word of a query as a quoted phrase, joined by OR."""
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def xml_text(c) -> Column:
    c = _col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def xml_attribute(c) -> Column:
    c = _col(c)
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def cdata_guard(c) -> Column:
    return F.replace(_col(c), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def truncated(c, most: int = fixed.BUDGET_CHARS) -> Column:
    """At most ``most`` characters, the suffix included; 0 leaves the text as it is."""
    c = _col(c)
    if not most:
        return c
    take = max(0, most - len(fixed.TRUNCATION_SUFFIX))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(take)), F.lit(fixed.TRUNCATION_SUFFIX)))


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes: among the prefixes
    of most/4 to most characters the length in bytes grows, so the count of those that
    fit tells where to cut."""
    fit = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (n <= F.length(c)) & (F.octet_length(F.substring(c, F.lit(1), n)) <= most)))
    return F.when(F.octet_length(F.left(c, F.lit(most))) <= most, F.left(c, F.lit(most))).otherwise(F.substring(c, F.lit(1), fit))


def stub_summary(c, most: int = 120) -> Column:
    """The first line that isn't blank, trimmed; past ``most`` bytes, cut and dotted."""
    line = trimmed(F.regexp_extract(_col(c), r"(?m)^[^\n]*\S[^\n]*$", 0))
    return F.when(line == "", F.lit("(no summary)")).when(F.octet_length(line) > most, F.concat(cut_bytes(line, most - 3), F.lit("..."))).otherwise(line)


def json_summary(c, most: int = 500) -> Column:
    c = _col(c)
    return F.when(F.octet_length(c) > most, F.concat(cut_bytes(c, most - 3), F.lit("..."))).otherwise(c)


def context_snippet(c, most: int = 80) -> Column:
    line = F.split(_col(c), "\n")[0]
    return F.when(F.octet_length(line) > most, F.concat(cut_bytes(line, most), F.lit("..."))).otherwise(line)


def keywords(c) -> Column:
    """Words of over two bytes that aren't stop words, stripped of signs at both ends."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    kept = F.filter(words(F.lower(_col(c))), lambda w: (F.octet_length(w) > 2) & ~bare(w).isin(*fixed.STOPWORDS))
    return F.filter(F.transform(kept, bare), lambda w: w != "")


def is_relevant(query, context) -> Column:
    """Two keywords found, or over 30 % of at most four; without keywords, true."""
    names, low = keywords(query), F.lower(_col(context))
    hits = F.size(F.filter(names, lambda k: F.instr(low, k) > 0))
    return (F.size(names) == 0) | (hits >= 2) | ((F.size(names) <= 4) & (hits / F.size(names) > 0.3))


def low_value_query(c) -> Column:
    return trimmed(c).rlike(fixed.LOW_VALUE_QUERY)


def low_value_response(c) -> Column:
    bare = trimmed(c)
    return (F.octet_length(bare) < fixed.LEAST_RESPONSE_BYTES) | F.lower(bare).isin(*fixed.LOW_VALUE_RESPONSES)


def redacted(c) -> Column:
    c = _col(c)
    for pattern in fixed.REDACT:
        c = F.regexp_replace(c, pattern, fixed.REDACTED.replace("[", "\\[").replace("]", "\\]"))
    return c


def holds_secret(line) -> Column:
    line = trimmed(line)
    return ~contains_any(line, fixed.SECRET_PASS) & reduce(lambda a, b: a | b, [line.rlike(p) for p in fixed.SECRETS])


def may_hold_secret(c) -> Column:
    """Whether a whole text matches a pattern of secrets: true wherever a line of it does."""
    return _col(c).contains('"') & _col(c).rlike("|".join(f"(?:{p})" for p in fixed.SECRETS))


def masked(line, most: int = 80) -> Column:
    """Quoted values of eight characters or more hidden, then cut for display."""
    return F.left(F.regexp_replace(trimmed(line), r'"[^"]{8,}"', '"\\[REDACTED\\]"'), F.lit(most))


def domain_of(source) -> Column:
    c = _col(source)
    low = F.lower(c)
    second = F.lower(F.split(c, "/")[1])
    rule = F.when(c.startswith("web/"), F.when(second.isin("rust_std", "react_docs"), second).otherwise("external_docs"))
    rule = rule.when(c.startswith("https://"), F.when(low.contains("rust-lang.org"), "rust_std").when(contains_any(low, ("react.dev", "reactjs.org")), "react_docs").otherwise("external_docs"))
    for name, parts in fixed.DOMAIN_RULES:
        rule = rule.when(contains_any(low, parts), name)
    return rule.otherwise("general")


def web_kind(url) -> Column:
    low = F.lower(_col(url))
    rule = None
    for name, parts in fixed.WEB_RULES:
        rule = (F if rule is None else rule).when(contains_any(low, parts), name)
    return rule.otherwise("external")


def source_bonus(kind) -> Column:
    rule = None
    for name, value in fixed.SOURCE_BONUS.items():
        rule = (F if rule is None else rule).when(_col(kind) == name, F.lit(value))
    return rule.otherwise(F.lit(0.0))


def is_private_host(url) -> Column:
    """Whether a URL names this machine or a private, link-local or shared network."""
    host = F.lower(F.regexp_extract(_col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    part = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    a, b = part(1), part(2)
    four = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    six = host.rlike(r"^\[(::1|f[cd][0-9a-f]{0,2}:.*|fe[89ab][0-9a-f]?:.*)\]$")
    return (host == "localhost") | host.endswith(".localhost") | F.coalesce(four, F.lit(False)) | six


def may_fetch(url) -> Column:
    return F.lower(_col(url)).startswith("https://") & ~is_private_host(url)


def chunk_number(chunk_id) -> Column:
    """The number after the last ``#``, or null."""
    return F.regexp_extract(_col(chunk_id), r"#([^#]*)$", 1).try_cast("int")


def chunk_source(chunk_id) -> Column:
    return F.regexp_replace(_col(chunk_id), r"#[^#]*$", "")


def slug(c, most: int = 64) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(most))


def name_query(c) -> Column:
    """A search query from a name: letters, digits, blanks and hyphens, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"[^A-Za-z0-9 -]+", " "), r" +", " "))


def graph_id(c) -> Column:
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9_]", "_")


def display_path(c) -> Column:
    return F.replace(_col(c), F.lit("\\"), F.lit("/"))


def token_estimate(c) -> Column:
    return F.floor(F.length(_col(c)) / 4).cast("long")


def meta_line(key: str, number, estimate, cost_per_million: float | None = None) -> Column:
    """The closing line of a response; with a price, what its tokens would have
    cost (a half of the last digit goes up)."""
    parts = [F.lit(f'\n\n_meta: {{ "{key}": '), _col(number).cast("string"), F.lit(', "tokens_estimated": '), _col(estimate).cast("string")]
    if cost_per_million is not None and cost_per_million >= 0:
        parts += [F.lit(', "cost_avoided_usd": '), F.format_string("%.6f", _col(estimate).cast("double") / 1_000_000 * cost_per_million)]
    return F.concat(*parts, F.lit("}"))


def skill_content(c) -> Column:
    """A skill's text; of a long one the first words and a suffix."""
    found = words(c)
    short = F.concat(F.array_join(F.slice(found, 1, fixed.MAX_SKILL_WORDS), " "), F.lit(fixed.TRUNCATION_SUFFIX))
    return F.when(F.size(found) > fixed.MAX_SKILL_WORDS, short).otherwise(_col(c))


def config_hash(values: dict[str, str | Column]) -> Column:
    """Hash of the settings that an index depends on, in the order of their names."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.lit(values[k])) for k in sorted(values)]), 256)


def compact(c) -> Column:
    return F.to_json(F.named_struct(F.lit("t"), _col(c)))


def verdict(c) -> Column:
    """(ingest, reason) of a reviewer's answer; without a mark, it is to be ingested."""
    up = F.upper(trimmed(c))
    no, yes = up.contains("[INGEST=FALSE]"), up.contains("[INGEST=TRUE]")
    lines = F.filter(F.transform(F.split(trimmed(c), "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.upper(s).startswith("[INGEST="))
    return F.struct(((~no & ~yes) | (yes & ~no)).alias("ingest"), F.when(F.size(lines) > 0, lines[0]).otherwise("No reason given.").alias("reason"))


def canonical_hash(args) -> Column:
    """First 16 hex digits of the hash of a map in key order."""
    entries = F.array_sort(F.map_entries(_col(args)))
    return F.left(F.sha2(F.to_json(F.map_from_entries(entries)), 256), F.lit(16))


def content_hash(c) -> Column:
    return F.sha2(trimmed(c), 256)


def json_list(c) -> Column:
    """A JSON array of strings, empty where it can't be read."""
    return F.coalesce(F.from_json(_col(c), "array<string>"), F.array().cast("array<string>"))


def unix_day(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_col(seconds)), "yyyy-MM-dd")


def front_matter(content) -> dict[str, Column]:
    """Name, description, domain, category and tags of a skill text. A value is what
    stands between the first and the second colon of its line."""
    c = trimmed(content)
    has = c.startswith("---")
    head = F.regexp_extract(c, r"(?s)^---.(.*?)\n---", 1)
    value = lambda keys: trimmed(F.regexp_extract(head, rf"(?m)^(?:{keys}):([^:\n]*)", 1))
    plain = F.split(c, "\n")
    bare_name = trimmed(F.regexp_replace(trimmed(plain[0]), r"^#+", ""))
    named = F.when(head.rlike(r"(?m)^(name|title):"), value("name|title")).otherwise("Skill")
    described = F.when(head.rlike(r"(?m)^description:"), value("description")).otherwise("")
    short = F.array_join(F.slice(words(F.when(has, described).otherwise(F.coalesce(F.get(plain, F.lit(1)), F.lit("")))), 1, 100), " ")
    listed = value("tags")
    tags = F.when(listed.startswith("["), json_list(listed)).otherwise(F.filter(F.transform(F.split(listed, ","), lambda t: F.trim(t)), lambda t: t != ""))
    return {
        "name": F.when(has, named).otherwise(bare_name),
        "description": short,
        "domain": F.nullif(F.when(has, value("domain")), F.lit("")),
        "category": F.nullif(F.when(has, value("category")), F.lit("")),
        "tags": F.when(has, tags).otherwise(F.array().cast("array<string>")),
    }


def skill_findings(content) -> dict[str, Column]:
    """(valid, errors, warnings) of a skill text."""
    c = _col(content)
    has = trimmed(c).startswith("---")
    head = F.regexp_extract(trimmed(c), r"(?s)^---.(.*?)\n---", 1)
    note = lambda cond, text: F.when(cond, F.lit(text) if isinstance(text, str) else text)
    errors = F.array(
        note(has & ~head.rlike(r"(?m)^(name|title):"), "Frontmatter must contain 'name:' or 'title:'."),
        note(has & ~head.rlike(r"(?m)^description:"), "Frontmatter must contain 'description:'."),
    )
    large = F.concat(F.lit("Skill exceeds 50000 chars ("), F.octet_length(c).cast("string"), F.lit("); consider splitting."))
    warnings = F.array(
        note(F.octet_length(c) > 50_000, large),
        note(~has, "No YAML frontmatter; consider adding name, description."),
        *[note(~c.contains(h), f"Consider adding section '{h}'.") for h in fixed.SKILL_HEADINGS],
    )
    errors, warnings = F.array_compact(errors), F.array_compact(warnings)
    return {"valid": F.size(errors) == 0, "errors": errors, "warnings": warnings}


def ui_findings(snippet) -> Column:
    """What a fragment of a page breaks of the layout rules."""
    c = _col(snippet)
    wide = c.contains("flex-row") | (c.contains("grid") & (c.contains("grid-cols") | c.contains("lg:grid")))
    shadows = [F.when(c.contains(s), F.lit(f"Forbidden shadow: {s} (use shadow-sm at most per DESIGN_AXIOMS)")) for s in fixed.FORBIDDEN_SHADOWS]
    stacked = F.when((F.regexp_count(c, F.lit("w-full")) >= 2) & ~wide, F.lit("Stacking red flag: multiple w-full without horizontal layout (add flex flex-row or grid with columns for desktop per DESIGN_AXIOMS)"))
    return F.array_compact(F.array(*shadows, stacked))
