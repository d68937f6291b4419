"""Mapping files as DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import unescape_tiny
from ..operators.renames import canonical_desc

# Descriptors of the primitive types.
PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def lines(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Rows (file, at, line) of text files, line ends removed.  A file is one record."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffix)
    return files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "line"))


def _owner(df: DataFrame, is_class: Column) -> DataFrame:
    """Adds ``class_at``, the position of the class line that each line belongs to."""
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("class_at", F.last(F.when(is_class, F.col("at")), ignorenulls=True).over(w))


def tiny_v2(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, errors) of tiny v2 files.

    classes(file, class_at, names), members(file, class_at, at, kind, desc, names); an empty
    name is null.  A file with the property ``escaped-names`` has its names unescaped from there on.  A file
    without the header is an error row and gives nothing else.
    """
    cells = F.split("line", "\t", -1)
    head = rows.where("at = 0").select("file", (F.slice(cells, 1, 3) == F.array(F.lit("tiny"), F.lit("2"), F.lit("0"))).alias("ok"))
    good = rows.join(head.where("ok"), "file", "left_semi")
    escapes = good.where((F.col("at") > 0) & F.col("line").rlike("^\t?escaped-names(\t|$)")).groupBy("file").agg(F.min("at").alias("_from"))
    good = good.join(escapes, "file", "left").withColumn("_esc", F.coalesce(F.col("at") > F.col("_from"), F.lit(False)))
    names = lambda skip: F.transform(F.slice(cells, skip + 1, F.greatest(F.size(cells) - skip, F.lit(0))), lambda x: F.when(x != "", F.when(F.col("_esc"), unescape_tiny(x)).otherwise(x)))
    marked = _owner(good.where("at > 0"), F.col("line").startswith("c\t"))
    classes = marked.where(F.col("line").startswith("c\t")).select("file", "class_at", names(1).alias("names"))
    member = F.regexp_extract("line", "^\t([mf])\t", 1)
    members = marked.where(member != "").select("file", "class_at", "at", F.when(member == "m", "method").otherwise("field").alias("kind"), cells[2].alias("desc"), names(3).alias("names"))
    return classes, members, head.where("not ok").select("file", F.lit("no tiny v2 header").alias("error"))


def descriptor(source_type: Column) -> Column:
    """JVM descriptor of a source type such as ``a.b.C[]``."""
    base = F.trim(F.regexp_replace(source_type, r"\[\]", ""))
    depth = (F.length(source_type) - F.length(F.replace(source_type, F.lit("[]"), F.lit("")))) / 2
    names = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    return F.concat(F.repeat(F.lit("["), depth.cast("int")), F.coalesce(F.try_element_at(names, base), F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";"))))


def proguard(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of ProGuard mapping files, with descriptors on both sides.

    classes(file, class_at, source, obf); members(file, class_at, at, kind, source_name,
    obf_name, desc_source, desc_obf).  Comments and blank lines are skipped.  Repeated member
    lines stay.
    """
    body = rows.where(~F.ltrim("line").startswith("#") & (F.trim("line") != ""))
    of_class, field = r"^(\S+) -> (\S+):\s*$", r"^\s+(?:\d+:\d+:)?(\S+) ([^\s(]+)(\([^)]*\))?\S* -> (\S+)\s*$"
    marked = _owner(body, F.col("line").rlike(of_class))
    slash = lambda g: F.translate(F.regexp_extract("line", of_class, g), ".", "/")
    classes = marked.where(F.col("line").rlike(of_class)).select("file", "class_at", slash(1).alias("source"), slash(2).alias("obf"))
    part = lambda g: F.regexp_extract("line", field, g)
    args = F.substr(part(3), F.lit(2), F.length(part(3)) - 2)
    params = F.when(args == "", F.array().cast("array<string>")).otherwise(F.split(args, ","))
    method = F.concat(F.lit("("), F.array_join(F.transform(params, lambda p: descriptor(F.trim(p))), ""), F.lit(")"), descriptor(part(1)))
    members = marked.where(F.col("line").rlike(field) & ~F.col("line").rlike(of_class)).select(
        "file", "class_at", "at", F.when(part(3) == "", "field").otherwise("method").alias("kind"), part(2).alias("source_name"), part(4).alias("obf_name"), F.when(part(3) == "", descriptor(part(1))).otherwise(method).alias("desc")
    )
    both = canonical_desc(members.withColumn("desc_source", F.col("desc")), classes.select(F.col("source").alias("from"), F.col("obf").alias("to")).distinct())
    return classes, both.withColumnRenamed("desc", "desc_obf")


def named_surface(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (owner, kind, name, desc) of the source side."""
    met = members.join(classes, ["file", "class_at"])
    return met.select(F.col("source").alias("owner"), "kind", F.col("source_name").alias("name"), F.col("desc_source").alias("desc")).distinct()


def properties(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, suspects) of properties files; spans are offsets in the file, from 0.

    Lines that continue, or that have no key, are suspects and never entries.
    """
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    pattern = r"^(\s*([^\s=:#!]+)\s*[=:]\s*)(.*?)\s*$"
    code = placed.where((F.trim("line") != "") & ~F.trim("line").rlike("^[#!]"))
    odd = F.col("line").endswith("\\") | ~F.col("line").rlike(pattern)
    part = lambda g: F.regexp_extract("line", pattern, g)
    start = F.col("offset") + F.length(part(1))
    entries = code.where(~odd).select("file", "at", part(2).alias("key"), part(3).alias("value"), start.alias("start"), (start + F.length(part(3))).alias("end"))
    return entries, code.where(odd).select("file", "at", "line")
