"""Text formats of weights: readers give (focal, neighbor, weight) or a Graph; writers stream rows in order of ids."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from .files import fields, whole_lines, write_lines


def _typed(g: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """ids as bigint if all can be cast, else as text."""
    fits = g.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS bigint)").isNull()).alias(c) for c in columns]).first()
    return g.select([F.expr(f"try_cast(`{c}` AS bigint)").alias(c) if c in columns and not any(fits) else F.col(c) for c in g.columns])


def read_gal(spark: SparkSession, path: str) -> Graph:
    """Header (``n``, or ``0 n file id``), then a line ``id k`` and a line of k neighbors for each id. Binary."""
    body = whole_lines(spark, path).filter("pos > 0").withColumn("pair", F.floor((F.col("pos") - 1) / 2))
    both = body.groupBy("pair").agg(F.max(F.when(F.col("pos") % 2 == 1, F.col("line"))).alias("head"), F.max(F.when(F.col("pos") % 2 == 0, F.col("line"))).alias("tail")).filter(F.trim("head") != "")
    split = lambda c: F.array_remove(F.split(F.trim(c), r"\s+"), "")
    e = both.select(split("head")[0].alias("focal"), F.explode_outer(split(F.coalesce("tail", F.lit("")))).alias("neighbor"))
    e = _typed(e.select("focal", F.coalesce("neighbor", "focal").alias("neighbor"), F.col("neighbor").isNotNull().cast("double").alias("weight")), ("focal", "neighbor"))
    return Graph(e)


def write_gal(g: Graph, path: str) -> None:
    rows = g.neighbors().orderBy("id")
    n = rows.count()

    def lines() -> Iterator[str]:
        yield str(n)
        for r in rows.toLocalIterator():
            yield f"{r['id']} {len(r['neighbors'])}"
            yield " ".join(map(str, r["neighbors"]))

    write_lines(g.edges.sparkSession, path, lines())


def read_triples(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """``i j w`` lines; lines with another number of fields are headers. Serves GWT, KWT, DAT and ArcGIS text."""
    f = fields(spark, path).filter((F.size("f") == 3) & F.expr("try_cast(f[2] AS double)").isNotNull())
    return _typed(f.select(F.col("f")[0].alias("focal"), F.col("f")[1].alias("neighbor"), F.col("f")[2].cast("double").alias("weight")), ("focal", "neighbor"))


def read_gwt(spark: SparkSession, path: str) -> Graph:
    return Graph(read_triples(spark, path))


read_kwt = read_dat = read_arcgis_text = read_gwt


def _ordered(g: Graph) -> Iterator:
    return g.links().orderBy("focal", "neighbor").toLocalIterator()


def write_gwt(g: Graph, path: str) -> None:
    """Spaces in ids become underscores; 7 decimals."""
    n = g.nodes.count()
    clean = lambda i: str(i).replace(" ", "_")
    write_lines(g.edges.sparkSession, path, (x for part in ([f"0 {n} Unknown Unknown"], (f"{clean(r['focal'])} {clean(r['neighbor'])} {r['weight']:.7f}" for r in _ordered(g))) for x in part))


def write_dat(g: Graph, path: str) -> None:
    write_lines(g.edges.sparkSession, path, (f"{r['focal']} {r['neighbor']} {r['weight']:.6G}" for r in _ordered(g)))


def write_arcgis_text(g: Graph, path: str, id_name: str = "UNIQUE_ID") -> None:
    write_lines(g.edges.sparkSession, path, (x for part in ([id_name], (f"{r['focal']} {r['neighbor']} {r['weight']:.6G}" for r in _ordered(g))) for x in part))


def read_mtx(spark: SparkSession, path: str) -> Graph:
    """Matrix Market coordinates, 1-based; nodes are all 1 .. n of the size line."""
    raw = whole_lines(spark, path).filter("NOT startswith(line, '%') AND trim(line) <> ''")
    first = raw.orderBy("pos").limit(1)
    part = lambda c: F.split(F.trim(c), r"\s+")
    n = first.select(F.explode(F.sequence(F.lit(1).cast("bigint"), part("line")[0].cast("bigint"))).alias("id"))
    body = raw.join(F.broadcast(first.select(F.col("pos").alias("head"))), F.col("pos") > F.col("head"))  # one row
    return Graph(body.select(part("line")[0].cast("bigint").alias("focal"), part("line")[1].cast("bigint").alias("neighbor"), part("line")[2].cast("double").alias("weight")), n)


def write_mtx(g: Graph, path: str) -> None:
    """ids must be 1 .. n."""
    n, m = g.nodes.count(), g.links().count()
    head = ["%%MatrixMarket matrix coordinate real general", f"{n} {n} {m}"]
    write_lines(g.edges.sparkSession, path, (x for part in (head, (f"{r['focal']} {r['neighbor']} {r['weight']:.6G}" for r in _ordered(g))) for x in part))


def read_stata(spark: SparkSession, path: str) -> Graph:
    """``n``, then ``id neighbors...`` (sparse) or ``id w1 .. wn`` (full, when all lines have n + 1 fields)."""
    raw = whole_lines(spark, path).filter("trim(line) <> ''").select("pos", F.split(F.trim("line"), r"\s+").alias("f"))
    n = int(float(raw.filter("pos = 0").select(F.col("f")[0]).first()[0]))
    body = raw.filter("pos > 0").select((F.col("pos") - 1).cast("int").alias("ord"), F.col("f")[0].alias("id"), F.slice("f", 2, F.size("f")).alias("r"))
    if body.filter(F.size("r") != n).isEmpty():
        cells = body.select(F.col("id").alias("focal"), F.posexplode("r").alias("j", "w")).filter("cast(w as double) <> 0")
        e = cells.join(body.select(F.col("ord").alias("j"), F.col("id").alias("neighbor")), "j").select("focal", "neighbor", F.col("w").cast("double").alias("weight"))
        lone = body.filter(~F.exists("r", lambda w: w.cast("double") != 0)).select(F.col("id").alias("focal"), F.col("id").alias("neighbor"), F.lit(0.0).alias("weight"))
        return Graph(_typed(e.unionByName(lone), ("focal", "neighbor")))
    e = body.select(F.col("id").alias("focal"), F.explode_outer("r").alias("neighbor"))
    return Graph(_typed(e.select("focal", F.coalesce("neighbor", "focal").alias("neighbor"), F.col("neighbor").isNotNull().cast("double").alias("weight")), ("focal", "neighbor")))


def write_stata(g: Graph, path: str, full: bool = False) -> None:
    n = g.nodes.count()
    rows = g.neighbors().orderBy("id")
    ids = [r["id"] for r in g.nodes.orderBy("id").toLocalIterator()] if full else []

    def lines() -> Iterator[str]:
        yield str(n)
        for r in rows.toLocalIterator():
            if full:
                w = dict(zip(r["neighbors"], r["weights"], strict=True))
                yield " ".join([str(r["id"]), *(f"{w.get(i, 0):.6G}" for i in ids)])
            else:
                yield " ".join(map(str, [r["id"], *r["neighbors"]]))

    write_lines(g.edges.sparkSession, path, lines())


def read_geobugs(spark: SparkSession, path: str) -> Graph:
    """``list(num=c(...), adj=c(...), weights=c(...), sumNumNeigh=...)``; ids are 1 .. n."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s", "").alias("v"))
    get = lambda k: F.split(F.regexp_extract("v", rf"[(,]{k}=c\(([^)]*)\)", 1), ",")
    p = text.select(F.transform(get("num"), lambda x: x.cast("int")).alias("num"), get("adj").alias("n"), get("weights").alias("x"))
    owner = F.flatten(F.transform("num", lambda k, i: F.array_repeat((i + 1).cast("bigint"), k))).alias("f")  # the focal node of each place in the lists
    each = p.select(F.explode(F.arrays_zip(owner, "n", "x")).alias("z")).filter("z.f IS NOT NULL")
    w = F.coalesce(F.expr("try_cast(z.x AS double)"), F.when(F.col("z.n").isNotNull(), 1.0).otherwise(0.0))
    lone = p.select(F.posexplode("num").alias("i", "k")).filter("k = 0").select((F.col("i") + 1).cast("bigint").alias("focal"))
    links = each.select(F.col("z.f").alias("focal"), F.coalesce(F.col("z.n").cast("bigint"), F.col("z.f")).alias("neighbor"), w.alias("weight"))
    return Graph(links.unionByName(lone.select("focal", F.col("focal").alias("neighbor"), F.lit(0.0).alias("weight"))))


def write_geobugs(g: Graph, path: str) -> None:
    """ids must be 1 .. n. Each of the three lists is a pass over the rows, which are worked out once."""
    from ..scratch import remove, write

    spark = g.edges.sparkSession
    held, held_path = write(g.neighbors())
    rows = held.orderBy("id")

    def lists(name: str, get) -> Iterator[bytes]:
        yield f"{name}=c(".encode()
        first = True
        for r in rows.toLocalIterator():
            for x in get(r):
                yield (b"" if first else b", ") + str(x).encode()
                first = False
        yield b"),\n"

    def parts() -> Iterator[bytes]:
        yield b"list(\n"
        yield from lists("num", lambda r: [len(r["neighbors"])])
        yield from lists("adj", lambda r: r["neighbors"])
        yield from lists("weights", lambda r: r["weights"])
        yield f"sumNumNeigh={held.agg(F.sum(F.size('neighbors'))).first()[0] or 0})\n".encode()

    from .files import write_bytes

    write_bytes(spark, path, parts())
    remove(spark, held_path)


def read_geoda_text(spark: SparkSession, path: str) -> DataFrame:
    """``n,k``, a line of names, then rows: a table of text columns cast to double where all values are numbers."""
    raw = whole_lines(spark, path).filter("trim(line) <> ''")
    names = [x.strip().strip('"') for x in raw.filter("pos = 1").first()["line"].split(",")]
    rows = raw.filter("pos > 1").select(F.split("line", ",").alias("f")).select([F.trim(F.col("f")[k]).alias(n) for k, n in enumerate(names)])
    bad = rows.agg(*[F.count_if(F.expr(f"try_cast(`{n}` AS double)").isNull()).alias(n) for n in names]).first()
    return rows.select([F.col(f"`{n}`").cast("double").alias(n) if not bad[n] else F.col(f"`{n}`") for n in names])


def read_parquet(spark: SparkSession, path: str) -> Graph:
    """Edges, with the transformation in the column's metadata."""
    e = spark.read.parquet(path)
    return Graph(e, transformation=e.schema["weight"].metadata.get("transformation", "O"))


def write_parquet(g: Graph, path: str) -> None:
    g.edges.select("focal", "neighbor", F.col("weight").alias("weight", metadata={"transformation": g.transformation})).write.mode("overwrite").parquet(path)


READERS = {"gal": read_gal, "gwt": read_gwt, "kwt": read_kwt, "dat": read_dat, "mtx": read_mtx, "parquet": read_parquet, "stata_text": read_stata, "geobugs_text": read_geobugs, "arcgis_text": read_arcgis_text}
WRITERS = {"gal": write_gal, "gwt": write_gwt, "kwt": write_gwt, "dat": write_dat, "mtx": write_mtx, "parquet": write_parquet, "stata_text": write_stata, "geobugs_text": write_geobugs, "arcgis_text": write_arcgis_text}


def write_grid_gal(spark: SparkSession, path: str, k: int = 10) -> None:
    """The GAL file of rook contiguity on a k x k grid."""
    from ..operators.builders import lattice

    write_gal(lattice(spark, k, k), path)


def read(spark: SparkSession, path: str, form: str | None = None) -> Graph:
    """By the file's extension, unless a format is given (``.txt`` needs one)."""
    form = form or path.rstrip("/").rpartition(".")[2].lower()
    if form not in READERS:
        raise ValueError(f"no reader for {form!r}; one of {', '.join(READERS)}")
    return READERS[form](spark, path)


def write(g: Graph, path: str, form: str | None = None) -> None:
    form = form or path.rstrip("/").rpartition(".")[2].lower()
    if form not in WRITERS:
        raise ValueError(f"no writer for {form!r}; one of {', '.join(WRITERS)}")
    WRITERS[form](g, path)


def convert(spark: SparkSession, source: str, target: str, source_form: str | None = None, target_form: str | None = None) -> None:
    write(read(spark, source, source_form), target, target_form)
