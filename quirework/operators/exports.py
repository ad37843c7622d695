"""What a package exports, from rows of the definitions and imports of its modules.

Names that an entry module imports from its siblings are looked up there, one hop or
several: each hop is a join of the names that are left with the definitions and imports
of the module they point to, so chains and cycles end after the hops asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import stored

ENTRY = "__init__"


def public(name: Column) -> Column:
    return ~F.startswith(name, F.lit("_")) | (name == "__init__")


def _last(rows: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """A row a key: the content that stands last, at the place where it stood first."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*what), "ordinal").alias("r"), F.min("ordinal").alias("ordinal")).select(*key, "ordinal", *[F.col("r")[c].alias(c) for c in what])


def definitions_with_stubs(definitions: DataFrame) -> DataFrame:
    """(package, module, ordinal, name, kind, signature, doc): a stub's signature wins, its doc only where the source has none.

    ``definitions``: package, module (``a.b``), stub (whether of a ``.pyi``), ordinal, name, kind,
    signature, doc. Names that only a stub has come after the others.
    """
    what = ["kind", "signature", "doc"]
    plain = _last(definitions.filter("not stub"), ["package", "module", "name"], what)
    stub = _last(definitions.filter("stub"), ["package", "module", "name"], what)
    stub = stub.select("package", "module", "name", F.col("ordinal").alias("stub_ordinal"), F.struct(*what).alias("s"))
    there = plain.withColumn("there", F.lit(True))
    both = there.join(stub, ["package", "module", "name"], "full_outer")
    doc = F.when(F.coalesce("doc", F.lit("")) != "", F.col("doc")).otherwise(F.coalesce("s.doc", F.lit("")))
    place = F.struct(F.col("there").isNull().alias("late"), F.coalesce("ordinal", "stub_ordinal").alias("at"))
    return both.select("package", "module", place.alias("ordinal"), "name", F.coalesce("kind", "s.kind").alias("kind"), F.coalesce("s.signature", "signature").alias("signature"), doc.alias("doc"))


def exports(definitions: DataFrame, imports: DataFrame, listed: DataFrame, hops: int = 1) -> DataFrame:
    """(package, position, name, kind, signature, doc, found_in): the symbols of each package's entry module, in order.

    ``imports``: package, module, ordinal, name (as it is called here), source (the sibling
    module, null for the package itself), original; ``listed``: package, names (``__all__``; a
    package without a row exports what is public). A name that is defined is not looked
    for elsewhere; one that can't be found within ``hops`` is left out.
    """
    by = ["package", "module", "name"]
    known = stored(definitions_with_stubs(definitions), "definitions")
    plain = stored(_last(definitions.filter("not stub"), by, ["kind", "signature", "doc"]).drop("ordinal"), "plain")
    taken = stored(_last(imports, by, ["source", "original"]), "imports")
    entry = F.col("module") == ENTRY
    own = known.filter(entry).select("package", "name", F.struct(F.lit(0).alias("group"), F.col("ordinal.late").alias("late"), F.col("ordinal.at").alias("at")).alias("place"))
    lent = taken.filter(entry).select("package", "name", F.struct(F.lit(1).alias("group"), F.lit(False).alias("late"), F.col("ordinal").alias("at")).alias("place"))
    explicit = listed.select("package", F.posexplode("names").alias("at", "name")).groupBy("package", "name").agg(F.min("at").alias("at"))
    explicit = explicit.select("package", "name", F.struct(F.lit(0).alias("group"), F.lit(False).alias("late"), F.col("at").cast("long").alias("at")).alias("place"))

    def long(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.struct("place.group", "place.late", F.col("place.at").cast("long").alias("at")))

    free = long(own).unionByName(long(lent)).filter(public(F.col("name"))).join(listed.select("package").distinct(), "package", "left_anti")
    wanted = explicit.unionByName(free.groupBy("package", "name").agg(F.min("place").alias("place")))
    here = known.filter(entry).select("package", "name", "kind", "signature", "doc", F.lit(ENTRY).alias("found_in"))
    found = wanted.join(here, ["package", "name"])
    open_ = wanted.join(here.select("package", "name"), ["package", "name"], "left_anti")
    open_ = open_.join(taken.filter(entry).select("package", "name", "source", "original"), ["package", "name"])
    for _ in range(hops):
        # a name of the package itself may be a module of that name
        target = open_.select("package", "name", "place", F.coalesce("source", "original").alias("module"), F.col("original").alias("wanted"))
        hit = target.join(plain.withColumnRenamed("name", "wanted"), ["package", "module", "wanted"])
        found = found.unionByName(hit.select("package", "name", "place", "kind", "signature", "doc", F.col("module").alias("found_in")))
        left = target.join(hit.select("package", "name"), ["package", "name"], "left_anti")
        onward = taken.select("package", "module", F.col("name").alias("wanted"), "source", "original")
        open_ = stored(left.join(onward, ["package", "module", "wanted"]).select("package", "name", "place", "source", "original"), "open") if hops > 1 else left
    position = F.row_number().over(Window.partitionBy("package").orderBy("place", "name")) - 1
    return found.withColumn("position", position).select("package", "position", "name", "kind", "signature", "doc", "found_in")
