"""Checks of Markdown files, rows (path, body): links that lead nowhere, counts that aren't true, and parts that are missing.

A file is read line by line; lines inside fences are code and no links. A link's target is what CommonMark takes for it: in angle
brackets, or without white space and with its brackets in balance, and a title after it is not part of it. Anchors follow the rule
of code hosts: the heading's text in lower case, without punctuation, a hyphen for every space, and -1, -2 ... for repeats.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType


def _lines(body: str) -> Iterator[tuple[int, str]]:
    """Lines that are no code, with their numbers; a fence ends at one of the same kind and at least its length."""
    fence = ""
    for k, line in enumerate(body.split("\n"), 1):
        bare = line.lstrip(" ")
        mark = bare[: len(bare) - len(bare.lstrip(bare[0]))] if bare[:1] in ("`", "~") else ""
        if fence:
            if mark.startswith(fence) and not bare[len(mark) :].strip():
                fence = ""
        elif len(mark) >= 3 and len(line) - len(bare) < 4:
            fence = mark
        else:
            yield k, line


def _close(text: str, at: int, opening: str, closing: str) -> int:
    """The place of the bracket that closes the one at `at`, or -1."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return at
        at += 1
    return -1


def _without_code(line: str) -> str:
    """line with its code spans blanked, so that places stay."""
    out, at = [], 0
    while (start := line.find("`", at)) >= 0:
        size = len(line[start:]) - len(line[start:].lstrip("`"))
        end = line.find("`" * size, start + size)
        if end < 0:
            break
        out += [line[at:start], " " * (end + size - start)]
        at = end + size
    return "".join([*out, line[at:]])


def targets(body: str | None) -> list[tuple[int, str]]:
    """(line, target) of the inline links and images of one file."""
    out = []
    for k, line in _lines(body or ""):
        line, at = _without_code(line), 0
        while (at := line.find("](", at)) >= 0:
            end = _close(line, at + 1, "(", ")")
            inside = line[at + 2 : end].strip() if end >= 0 else ""
            if inside.startswith("<") and ">" in inside:
                out.append((k, inside[1 : inside.index(">")]))
            elif inside:
                out.append((k, inside.split()[0]))
            at += 2
    return out


def plain(text: str) -> str:
    """A heading's text as it is shown: links by their words, and without marks of emphasis and code."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "[" and (end := _close(text, at, "[", "]")) >= 0 and text[end + 1 : end + 2] == "(" and (stop := _close(text, end + 1, "(", ")")) >= 0:
            out.append(plain(text[at + 1 : end]))
            at = stop + 1
            continue
        if c not in "`*":
            out.append(c)
        at += 1
    return "".join(out)


def slug(text: str) -> str:
    """The anchor of a heading's text, before repeats are told apart."""
    shown = unicodedata.normalize("NFKC", plain(text)).strip().lower()
    kept = (c for c in shown if c in " -_" or unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Mn")
    return "".join("-" if c == " " else c for c in kept)


def anchors(body: str | None) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for _, line in _lines(body or ""):
        marks = len(line) - len(line.lstrip("#"))
        if not 1 <= marks <= 6 or line[marks : marks + 1] not in (" ", "\t"):
            continue
        name = slug(line[marks:].strip().rstrip("#").rstrip())
        if name:
            n = seen.get(name, 0)
            seen[name] = n + 1
            out.append(f"{name}-{n}" if n else name)
    return out


@F.pandas_udf(ArrayType(StructType().add("line", IntegerType()).add("target", StringType())))
def _targets(body: pd.Series) -> pd.Series:
    return body.map(lambda b: [{"line": k, "target": t} for k, t in targets(b)])


@F.pandas_udf(ArrayType(StringType()))
def _anchors(body: pd.Series) -> pd.Series:
    return body.map(anchors)


def resolved(folder: Column, file: Column) -> Column:
    """A path seen from a folder, without steps to itself and up."""
    steps = F.filter(F.split(F.concat(folder, F.lit("/"), file), "/"), lambda s: ~s.isin("", "."))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(walk, "/")


def links(files: DataFrame) -> DataFrame:
    """Rows (path, line, target, file, anchor) of all links that stay inside; anchor is null for those without one. Targets with a scheme lead outside, those to lines (#L7) can't be checked."""
    each = files.select("path", F.explode(_targets("body")).alias("x")).select("path", "x.line", "x.target")
    inside = each.where(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#L[0-9]"))
    name, folder = F.regexp_extract("target", "^[^#?]*", 0), F.regexp_replace("path", "[^/]*$", "")
    file = F.when(name == "", F.col("path")).otherwise(resolved(folder, F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))))
    mark = F.when(F.col("target").contains("#"), F.regexp_extract("target", "#(.*)$", 1))
    return inside.select("path", "line", "target", file.alias("file"), mark.alias("anchor"))


def broken_links(files: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Distinct rows (path, target, problem): `file` where no file is, `anchor` where the file has no such heading.

    Paths are relative to one top folder. others (path): files that exist besides. A null body has neither links nor headings.
    """
    known = files.select("path") if others is None else files.select("path").union(others.select("path"))
    known = known.distinct().select(F.col("path").alias("file"), F.lit(True).alias("is_file"))
    marks = files.select(F.col("path").alias("file"), F.explode(_anchors("body")).alias("anchor")).distinct().withColumn("is_anchor", F.lit(True))
    met = links(files).join(known, "file", "left").join(marks, ["file", "anchor"], "left")
    problem = F.when(F.col("is_file").isNull(), "file").when(F.col("anchor").isNotNull() & F.col("is_anchor").isNull(), "anchor")
    return met.select("path", "target", problem.alias("problem")).where("problem is not null").distinct()


def count_claims(files: DataFrame, source: str, pattern: str, things: Sequence[str]) -> DataFrame:
    """(path, line, claimed, actual): lines that name the file `source` and say another number of `things` than it has matches of pattern."""
    truth = files.where(F.col("path") == source).select(F.size(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("actual"))
    words = "|".join(things)
    lines = files.select("path", F.posexplode(F.split("body", "\n")).alias("k", "text")).where(F.col("text").contains(source.rpartition("/")[2]))
    said = lines.select("path", (F.col("k") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(rf"(?<![\w.%])(\d+)\s*(?:{words})\b"), F.lit(1))).alias("claimed"))
    return said.crossJoin(F.broadcast(truth)).select("path", "line", F.col("claimed").cast("int").alias("claimed"), "actual").where("claimed <> actual")


def front_matter(body: Column) -> tuple[Column, Column]:
    """What stands between the first line --- and the next one, null without; and the rest."""
    has = body.rlike(r"(?s)\A---\n.*?\n---\n")
    return F.when(has, F.regexp_extract(body, r"(?s)\A---\n(.*?)\n---\n", 1)), F.when(has, F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")).otherwise(body)


def structure(files: DataFrame, sections: Sequence[str], fields: Sequence[str] = ("name",)) -> DataFrame:
    """(path, problem): files without front matter, without one of its fields, or without a section that they must have. A file without front matter isn't looked at further."""
    head, rest = front_matter(F.coalesce("body", F.lit("")))
    rows = files.select("path", head.alias("head"), rest.alias("rest"))
    # (field or section, where it is looked for, what says that it is there)
    checks = [(F.col("head").isNull(), "no front matter")]
    checks += [(F.col("head").isNotNull() & ~F.col("head").rlike(rf"(?m)^{f}:[ \t]*\S"), f"no {f}") for f in fields]
    checks += [(F.col("head").isNotNull() & ~F.concat(F.lit("\n"), F.col("rest"), F.lit("\n")).contains(f"\n{s}\n"), f"no section {s}") for s in sections]
    each = F.array(*(F.struct(on.alias("on"), F.lit(what).alias("problem")) for on, what in checks))
    return rows.select("path", F.explode(each).alias("x")).where("x.on").select("path", "x.problem")


def sample(spark: SparkSession) -> DataFrame:
    """Three small files with a fault of each kind."""
    files = [
        ("a/one.md", "---\nname: one\n---\n# One (1)\n## Use\n[two](two.md#second-part) [x](two.md#Absent \"a title\") [y](<../gone.md>) [z](../b.md#it-is-so)\n```\n[no](nowhere.md)\n```\n[w](https://e.org/x) `[c](d.md)` [self](#one-1)"),
        ("a/two.md", "---\nname: two\n---\n# Two\n## Second *part*\n## Use\n## Use\n[again](#use-1) [up](./../a/one.md)"),
        ("b.md", "# It is [so](a/one.md)\nlist.md has 7 entries, not 3 cases\n[bad](#nope) 12% of list.md"),
        ("list.md", "---\ntitle: x\n---\n- a\n- b\n- c"),
    ]
    return spark.createDataFrame(files, "path string, body string")
