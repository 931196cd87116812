"""Integrity of documents: placeholders, references, citations, as rows (severity, gate, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), value."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def placeholders(rows: DataFrame) -> DataFrame:
    """Lines with a placeholder that aren't comments."""
    return rows.where(F.col("value").rlike(r"\\(RESULT|TODO)\{") & ~F.ltrim("value").startswith("%"))


def keys_of(rows: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """The lines with each `name` that the pattern finds; names between commas are taken apart."""
    found = F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group)))
    return rows.withColumn("__x", found).withColumn("name", F.explode(F.split("__x", r"\s*,\s*"))).drop("__x")


def dangling(uses: DataFrame, defined: DataFrame, name: str = "name") -> DataFrame:
    """name, line: what is used and not defined, by its first line."""
    return uses.groupBy(name).agg(F.min("line").alias("line")).join(defined.select(name).distinct(), name, "left_anti")


def bib_entries(text: str) -> list[tuple[str, str, str]]:
    """(type, key, body) of each entry of a bibliography: braces are counted, so bodies may hold braces. Driver side."""
    out, at = [], 0
    while (at := text.find("@", at)) >= 0:
        brace = text.find("{", at)
        if brace < 0:
            break
        depth, end = 1, brace + 1
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        key, _, body = text[brace + 1 : end - 1].partition(",")
        out.append((text[at + 1 : brace].strip().lower(), key.strip(), body.strip()))
        at = end
    return out


def bibliography(files: DataFrame, text: str = "value") -> DataFrame:
    """type, key, body: the entries of each file's text, a task for each file; other columns are kept."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    kept = [f for f in files.schema.fields if f.name not in (text, "type", "key", "body")]
    schema = T.StructType([*kept, *(T.StructField(c, T.StringType()) for c in ("type", "key", "body"))])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*own, *entry) for own, value in zip(batch[[f.name for f in kept]].itertuples(index=False), batch[text]) for entry in bib_entries(value or "")]
            yield pd.DataFrame(rows, columns=schema.names)

    return files.select(*[f.name for f in kept], text).mapInPandas(parse, schema)


def violations(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """severity, gate, message: one row for each row of each check (severity, gate, frame with `message`)."""
    from functools import reduce

    frames = [f.select(F.lit(s).alias("severity"), F.lit(g).alias("gate"), F.col("message").cast("string").alias("message")) for s, g, f in checks]
    return reduce(lambda a, b: a.unionByName(b), frames)


def exit_code(found: DataFrame, strict: bool = False) -> int:
    """1 if there is an error, or with `strict` a warning."""
    bad = found if strict else found.where("severity = 'error'")
    return int(bad.limit(1).count() > 0)
