"""Nested scans as one table of checks (F17), and paths that a walk leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar as G

#: Folders of tools and of what they build.
SKIPPED = ("node_modules", ".git", ".gradle", "build", "out", "bin", "target", ".idea", "dist")


def skipped(path: Column, folders: Sequence[str] = SKIPPED) -> Column:
    """Whether a folder above the file is one of ``folders``; the file's own name may be any."""
    above = F.split(F.translate(path, "\\", "/"), "/")
    return F.arrays_overlap(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))), F.array(*[F.lit(x) for x in folders]))


def target_checks(scans: DataFrame) -> DataFrame:
    """Rows (file, line, surface, owner, name, desc, note, raw) of nested scans, none dropped that says something.

    ``scans(file, targets, injectors, shadows)``: targets array<struct<line, name, note>>, injectors array<struct<line,
    annotation, specs array<string>, ats array<struct<line, value, target>>>>, shadows array<struct<line, annotation,
    implied, note>>.  A target without a name and a selector that does not parse are checks of the surface
    unparseable with the reason; points without a target and shadows without a member say nothing.
    """
    none = F.lit(None).cast("string")

    def check(line: Column, surface: Column, owner: Column, name: Column, desc: Column, note: Column, raw: Column) -> list[Column]:
        return ["file", line.alias("line"), surface.alias("surface"), owner.alias("owner"), name.alias("name"), desc.alias("desc"), F.when(note != "", note).alias("note"), raw.alias("raw")]

    t = F.col("t")
    named = t["name"].isNotNull()
    targets = scans.select("file", F.explode("targets").alias("t")).select(*check(t["line"], F.when(named, "class").otherwise("unparseable"), t["name"], none, none, F.coalesce(t["note"], F.when(~named, "class is not resolved")), t["name"]))
    inj = scans.select("file", F.explode("injectors").alias("t"))
    spec = inj.select("file", t["line"].alias("line"), t["annotation"].alias("annotation"), F.explode(t["specs"]).alias("raw")).withColumn("s", G.method_spec(F.col("raw")))
    info = F.col("s.info")
    fine = info["error"].isNull()
    notes = F.concat_ws("; ", F.when(info["owner"].isNull(), "owner is the target"), F.when(F.col("s.wildcard"), "wildcard").when(info["kind"] == "unknown", "no descriptor"), F.when(F.col("annotation") == "Overwrite", "descriptor is the handler's"))
    keep = lambda c: F.when(fine, c)
    specs = spec.select(*check(F.col("line"), F.when(fine, "method-spec").otherwise("unparseable"), keep(info["owner"]), keep(info["name"]), keep(info["desc"]), F.when(fine, notes).otherwise(F.concat("annotation", F.lit(": "), info["error"])), F.col("raw")))
    at = inj.select("file", F.explode(t["ats"]).alias("a")).where("a.target is not null").withColumn("s", G.method_spec(F.col("a.target")))
    surface = G.at_surface(F.col("a.value"), info["kind"])
    at_note = F.when(~fine, F.concat(F.lit("point: "), info["error"])).when(surface.isNull(), "the kind of the point is open")
    ats = at.select(*check(F.col("a.line"), F.when(fine, F.coalesce(surface, F.lit("unparseable"))).otherwise("unparseable"), keep(info["owner"]), keep(info["name"]), keep(info["desc"]), at_note, F.col("a.target")))
    sh = scans.select("file", F.explode("shadows").alias("t")).where("t.implied is not null")
    shadows = sh.select(*check(t["line"], F.lower(t["annotation"]), none, t["implied"], none, F.concat_ws("; ", F.lit("owner is the target"), t["note"]), t["implied"]))
    return targets.unionByName(specs).unionByName(ats).unionByName(shadows)
