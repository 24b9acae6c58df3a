"""Chunkers that built-in functions express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import text as T


def char_windows(text: Column, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before. Blank windows
    go; if all are blank, the whole text is the one chunk; an empty text has none. A text
    whose length is whole steps beyond the first window has a last one of overlap alone."""
    step = size - overlap
    last = F.when(F.length(text) < size, F.lit(0)).otherwise(F.floor((F.length(text) - size) / step) + 1)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.substring(text, (k * step + 1).cast("int"), F.lit(size)))
    full = F.filter(parts, lambda p: p.rlike(r"\S"))
    # named by a lambda, as Spark would cut the text anew in each branch
    some = F.transform(F.array(full), lambda f: F.when(F.size(f) == 0, F.array(text)).otherwise(f))[0]
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(some)


def word_windows(text: Column, size: int = fixed.WINDOW_WORDS, overlap: int = fixed.WINDOW_OVERLAP) -> Column:
    """Windows of ``size`` words, each ``overlap`` words into the one before."""
    step = max(1, size - overlap)
    all_words = T.words(text)
    last = F.when(F.size(all_words) <= size, F.lit(0)).otherwise(F.ceil((F.size(all_words) - size) / step))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.array_join(F.slice(all_words, (k * step + 1).cast("int"), F.lit(size)), " "))
    return F.filter(parts, lambda p: p != "")


def chunked(docs: DataFrame, parts: Column, source: str = "source", most: int | None = fixed.MAX_CHUNKS_PER_FILE) -> DataFrame:
    """One row a chunk, with its place and the id ``source#place``."""
    kept = F.slice(parts, 1, most) if most else parts
    out = docs.select("*", F.posexplode(kept).alias("chunk_idx", "chunk"))
    return out.withColumn("chunk_id", F.concat(F.col(source).cast("string"), F.lit("#"), F.col("chunk_idx").cast("string")))


def markdown_sections(docs: DataFrame, id_col: str, text_col: str, leading: bool = False) -> DataFrame:
    """(id, section, name, text): from each heading to the next. Headings are ATX with a
    text, or a line underlined by === or --- alone. With ``leading``, what stands before
    the first heading is section 0 without a name."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    by_line = Window.partitionBy("id").orderBy("line_no")
    atx = F.trim(F.regexp_extract("line", r"^\s*#{1,6}\s*(.*)$", 1))
    after = F.trim(F.lead("line").over(by_line))
    bare = F.trim("line")
    is_atx = F.col("line").rlike(r"^\s*#{1,6}[^#]") & (atx != "")
    is_setext = ~is_atx & (bare != "") & F.coalesce(after.rlike(r"^(=+|-{3,})$"), F.lit(False)) & ~bare.rlike(r"^(=+|-{3,})$")
    marked = rows.withColumn("name", F.when(is_atx, atx).when(is_setext, bare))
    placed = marked.withColumn("section", F.sum(F.when(F.col("name").isNotNull(), 1).otherwise(0)).over(by_line))
    lines = placed.groupBy("id", "section").agg(
        F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("body")
    )
    kept = lines.withColumn("text", T.trimmed("body")).where(F.col("text") != "")
    return kept.where(F.lit(leading) | (F.col("section") > 0)).select("id", F.col("section").cast("long").alias("section"), "name", "text")


def titled_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, title, slug, body) of the parts that ``## `` starts; what precedes the
    first is left out."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text_col)), "\n## ")).alias("place", "part")).where("place > 0")
    title = F.trim(F.split("part", "\n")[0])
    body = T.trimmed(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return parts.select("id", F.col("place").cast("long").alias("place"), title.alias("title"), T.slug(title).alias("slug"), body.alias("body"))


def bypasses_parser(text: Column) -> Column:
    """Whether a source looks minified: one line of 10 000 characters, any line over
    50 000, or over 2000 characters a line."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    per_line = F.floor(F.length(text) / F.size(lines))
    longest = F.array_max(F.transform(lines, lambda s: F.length(s)))
    return ((F.size(lines) <= 1) & (F.length(text) >= 10_000)) | (longest > 50_000) | (per_line > 2000)
