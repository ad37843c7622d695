"""From a position in a source file to the symbol used there, its dependency and what to search for.

Ranges of uses may nest and overlap, and a file may have millions. Each range goes to the
level whose bins are the smallest not shorter than it, so that it lies in two bins at
most; a position asks one bin of each level that some range has. The join is then by equality, and what meets in a
bin are ranges of about its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.provenance import NO_DEPENDENCY, NO_GENERATION, first_dependencies
from quirework.operators.skew import FEW_KEYS, chosen, join_back
from quirework.plans.reconcile import KEY
from quirework.session import stored

#: Columns of a line: a position is line * COLUMNS + column. Bits of the bins' sizes.
COLUMNS = 1 << 20
LEVELS = tuple(range(6, 63, 4))
#: Ranges of an array, so that a crowded bin is several.
USES = 1024


def _at(line: Column, column: Column) -> Column:
    return line.cast("long") * COLUMNS + F.least(F.greatest(column.cast("long"), F.lit(0)), F.lit(COLUMNS - 1))


def _located(sites: DataFrame, uses: DataFrame, told: list[str]) -> DataFrame:
    """``sites`` without their positions, with the columns ``told`` of the innermost use around each; a site in no use has no row.

    The ranges of a bin are arrays, so each probe is one row before and after it meets them: pairs of
    positions and ranges around them are never rows, which a sort would spill. What is told goes
    along with the ranges, so neither they nor the sites are looked up by their ids afterwards.
    """
    start, end = _at(F.col("line"), F.col("column")), _at(F.col("end_line"), F.col("end_column"))
    ranges = uses.filter("file is not null").select("file", (end - start).alias("length"), (-start).alias("late"), "use_id", *[c for c in told if c != "use_id"]).filter("length > 0")
    bits = F.lit(LEVELS[-1])
    for level in reversed(LEVELS):
        bits = F.when(F.col("length") <= F.lit(1 << level), level).otherwise(bits)
    binned = ranges.withColumn("level", bits)
    binned = binned.withColumn("bin", F.explode(F.expr("sequence(shiftright(-late, level), shiftright(length - late - 1, level))")))
    among = Window.partitionBy("file", "level", "bin").orderBy("late")
    use = F.struct("length", "late", "use_id", F.struct(*told).alias("told"))
    around = binned.withColumn("part", F.floor((F.row_number().over(among) - 1) / USES)).groupBy("file", "level", "bin", "part")
    cells = around.agg(F.collect_list(use).alias("around"), F.min(-F.col("late")).alias("low"), F.max(F.col("length") - F.col("late")).alias("high"))
    asked = sites.withColumn("place", F.struct("file", _at(F.col("line"), F.col("column")).alias("at"))).drop("file", "line", "column")
    places = asked.groupBy("place").agg(F.count("*").alias("times_"))
    found = {r.level for r in binned.select("level").distinct().collect()}  # at most LEVELS
    at = F.col("place.at")
    probes = F.array(*[F.struct(F.lit(b).alias("level"), F.shiftright(at, b).alias("bin")) for b in LEVELS if b in found or not found])
    wanted = places.select("times_", F.col("place.file").alias("file"), at.alias("at"), F.explode(probes).alias("p")).select("times_", "file", "at", "p.level", "p.bin")
    met = wanted.join(cells, ["file", "level", "bin"]).filter("low <= at and at < high")
    least = F.array_min(F.filter("around", lambda u: (-u["late"] <= F.col("at")) & (F.col("at") < u["length"] - u["late"])))
    hits = met.select("file", "at", "times_", least.alias("use")).repartition("file", "at")
    best = hits.groupBy("file", "at").agg(F.min("use").alias("use"), F.first("times_").alias("times_")).filter("use is not null")
    best = best.select(F.struct("file", "at").alias("place"), "use.told.*", "times_")
    return join_back(asked, best, "place")


def innermost(sites: DataFrame, uses: DataFrame) -> DataFrame:
    """(site_id, use_id) of each site that lies in a use: of those around it the shortest, then the one that starts last, then the least id.

    ``sites``: site_id, file, line, column; ``uses``: use_id, file, line, column, end_line, end_column
    (the end is not part of it). Sites at one position are looked up once.
    """
    return _located(sites.select("site_id", "file", "line", "column"), uses, ["use_id"]).select("site_id", "use_id")


def resolved_sites(sites: DataFrame, uses: DataFrame, dependencies: DataFrame, pointers: DataFrame) -> DataFrame:
    """(site_id, symbol, ecosystem, package, version, generation, query_text, error): where to search for each call site, and what.

    ``sites`` have project and text besides; an empty text asks for the symbol's qualified
    name. ``uses`` have module, ecosystem (empty if unknown) and symbol of what is
    referred to; one without a module is internal, and a site at none or at an internal
    one has no row: there is nothing to search. A module that the project doesn't
    resolve and a version without an active generation have an error.

    Dependencies of projects without a site are left out before they are summed up, and get
    their generations before the sites meet them: in place, where they are few.
    """
    projects = stored(sites.select("project").distinct(), "projects")
    known = stored(first_dependencies(chosen(dependencies, projects, ["project"], projects.count())), "known")
    n = known.count()
    at = known.select("project", "module", F.col("ecosystem").alias("asked_"), F.col("first.found_in").alias("ecosystem"), F.col("module").alias("package"), F.col("first.version").alias("version"))
    known = at.join(chosen(pointers.select(*KEY, "generation"), at, KEY, n), KEY, "left")
    known = F.broadcast(known) if n <= FEW_KEYS else known
    found = _located(sites.select("site_id", "project", "text", "file", "line", "column"), uses.withColumn("asked_", F.coalesce("ecosystem", F.lit(""))), ["module", "asked_", "symbol"])
    found = found.filter(F.coalesce("module", F.lit("")) != "").join(known, ["project", "module", "asked_"], "left")
    error = F.when(F.col("version").isNull(), NO_DEPENDENCY).when(F.col("generation").isNull(), NO_GENERATION)
    what = F.when(F.coalesce("text", F.lit("")) == "", F.col("symbol")).otherwise(F.col("text"))
    return found.select("site_id", "symbol", "ecosystem", F.col("module").alias("package"), "version", "generation", what.alias("query_text"), error.alias("error"))
