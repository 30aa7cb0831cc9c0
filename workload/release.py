"""Two annotation releases derived from the relational test tables.

Customers play genes, orders transcripts and line items the regions of a transcript. The target
release is the data as it stands; the query release is a revision of the same rows, made by
rules on their values (some regions dropped, moved or lengthened, some ids and biotypes changed).
Both releases cover the whole tables. Contigs hold 250 consecutive customers of one market
segment, so their number grows with the data while their density stays the same.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annodelta.annotation import PART, Annotation, introns_in_lists

SIDES = ("target", "query")
LOCUS_SPACING = 140_000
DAY_WIDTH = 60
CUSTOMERS_PER_CONTIG = 250


_tables: dict[tuple, DataFrame] = {}
_releases: dict[tuple, Annotation] = {}
_listed: dict[tuple, tuple[Annotation, Annotation]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. The lazy DataFrame is kept per application, sparing repeated schema reads."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _tables[key]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that has fewer splits than there are cores (a small single file).

    Inputs of many files or row groups are read as they are, without this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _contig() -> Column:
    return F.concat("c_mktsegment", F.lit("_"), F.expr(f"c_custkey div {CUSTOMERS_PER_CONTIG}").cast("string"))


def _forward() -> Column:
    return F.col("c_nationkey") <= 12


def _gene_id(side: str) -> Column:
    renamed = F.lit(side == "query") & (F.col("c_acctbal") < -800)
    return F.concat(F.lit("G"), F.col("c_custkey").cast("string"), F.when(renamed, "n").otherwise(""))


def _customers(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        _contig().alias("contig"),
        _gene_id(side).alias("gene_id"),
        F.when(F.col("c_nationkey") != 7, F.col("c_name")).alias("gene_name"),
        F.when(F.col("c_nationkey") == 24, F.lit(None))
        .when(F.col("c_acctbal") > 0, "protein_coding").otherwise("lncRNA").alias("gene_biotype"),
        F.when(F.col("c_nationkey") == 3, "protein_coding").otherwise("havana").alias("source"),
        _forward().alias("fwd"),
    )


def _present(side: str) -> Column:
    return F.col("o_totalprice") <= 495_000 if side == "target" else F.col("o_totalprice") >= 6_000


def _transcript_id(side: str) -> Column:
    renamed = F.lit(side == "query") & (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return F.concat(F.lit("T"), F.col("o_orderkey").cast("string"), F.when(renamed, ".2").otherwise(""))


def _orders(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    revised = F.lit(side == "query")
    return table(spark, sf_dir, "orders").where(_present(side)).select(
        "o_orderkey",
        "o_custkey",
        _transcript_id(side).alias("transcript_id"),
        F.when(revised & (priority == "1-URGENT") & (status == "F"), "retained_intron")
        .when(priority.isin("1-URGENT", "2-HIGH"), "protein_coding")
        .when(priority == "3-MEDIUM", "nonsense_mediated_decay")
        .when(priority == "5-LOW", "lncRNA").alias("transcript_biotype"),
    )


def _hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("int")


def _kept(side: str, tax: Column) -> Column:
    """Whether a release has the line."""
    return tax != 8 if side == "query" else F.lit(True)


def _offsets(side: str, discount: Column) -> tuple[Column, Column]:
    """Start and end of a line's region from the place of its gene."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) * DAY_WIDTH
    shift = F.when(discount == 0, 3).otherwise(0) if side == "query" else F.lit(0)
    growth = F.when(discount == 10, 7).otherwise(0) if side == "query" else F.lit(0)
    return ((day + 1 + shift).cast("long"),
            (day + growth + F.col("l_quantity").cast("int") * 10 + F.col("l_linenumber")).cast("long"))


def _read_lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if side == "query":
        lines = lines.where(_kept(side, _hundredths("l_tax")))
    offset, offset_end = _offsets(side, _hundredths("l_discount"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        offset.alias("offset"), offset_end.alias("offset_end"),
    )


def _lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    # By order only: what is done per order then needs no second shuffle.
    return spread(_read_lines(spark, sf_dir, side), "l_orderkey")


def _ranked(lines: DataFrame) -> DataFrame:
    """The place of a line in its order stands for the values it follows from; equal lines share a place."""
    of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.withColumn("line", F.rank().over(of_order).cast("long")).drop("l_partkey", "l_suppkey", "l_extendedprice")


def _children(start: Column, end: Column, ln: Column, flag: Column, status: Column) -> Column:
    """The features of a line at ``start`` and ``end``."""
    def child(kind: str, start: Column, end: Column, rank: Column | int) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"),
            (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("sub"),
        )

    return F.array_compact(F.array(
        child("exon", start, end, 1),
        F.when(flag != "N", child("CDS", start + ln, end, F.when(flag == "A", 0).otherwise(2))),
        F.when(flag == "A", child("five_prime_utr", start, start + ln - 1, 3)),
        F.when((flag == "R") & (status == "F"), child("stop_codon", end - 2, end, 4)),
    ))


def _features(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    lines = _ranked(_lines(spark, sf_dir, side))
    # Orders meet their customers first, so that lines are shuffled once, by order.
    orders = _orders(spark, sf_dir, side).join(_customers(spark, sf_dir, side), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "contig", "gene_id", "transcript_id", "fwd", (F.col("c_custkey") * LOCUS_SPACING).alias("locus"))
    located = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("start", F.col("locus") + F.col("offset"))
        .withColumn("end", F.col("locus") + F.col("offset_end"))
    )
    children = _children(*(F.col(c) for c in ("start", "end", "l_linenumber", "l_returnflag", "l_linestatus")))
    return located.select(
        "contig", "gene_id", "transcript_id", "fwd", "line", F.col("l_orderkey").alias(PART), F.explode(children).alias("child"),
    ).select(
        "contig", "gene_id", "transcript_id", "child.type", "child.start", "child.end", "fwd",
        (F.col("line") * 8 + F.col("child.sub")).alias("ord"), PART,
    )


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its lines, with the places and presence of each in both releases: one row per order."""
    places = {side: _offsets(side, _hundredths("l_discount")) for side in SIDES}
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        *(place.alias(f"{side}_{name}") for side in SIDES for place, name in zip(places[side], ("start", "end"))),
        *(F.coalesce(_kept(side, _hundredths("l_tax")), F.lit(False)).alias(f"{side}_kept") for side in SIDES))
    return lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(*(c for c in lines.columns if c != "l_orderkey"))).alias("lines"))


def listed_features(spark: SparkSession, sf_dir: str, by_gene: bool = False) -> DataFrame:
    """The features of both releases as lists, one row per transcript (and ``gene_id``, on request), at their places (see ``Annotation``).

    Lines are shuffled once for both releases. An order that comes several times, or whose customer does, is one transcript
    with the features of all.
    """
    ids = [F.when(_present(side), _transcript_id(side)).alias(side) for side in SIDES]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *ids).join(
        table(spark, sf_dir, "customer").select("c_custkey", _contig().alias("contig"), _forward().alias("fwd"), *(
            _gene_id(side).alias(f"{side}_gene") for side in SIDES if by_gene)), F.col("o_custkey") == F.col("c_custkey"))
    genes = [c for c in orders.columns if c.endswith("_gene")]
    placed = orders.groupBy("o_orderkey").agg(F.collect_list(F.struct(
        "contig", "fwd", (F.col("c_custkey") * LOCUS_SPACING).alias("locus"), *SIDES, *genes)).alias("places"))

    def ids_of(side: str) -> Column:
        present = F.filter("places", lambda p: p[side].isNotNull())
        return F.array_distinct(F.transform(present, lambda p: F.struct(
            F.lit(side == "query").alias("is_query"), p["contig"].alias("contig"), *(
                p[f"{side}_gene"].alias("gene_id") for _ in genes[:1]), p[side].alias("transcript_id"))))

    def features(side: str) -> Column:
        def of(place: Column) -> Column:
            def line_features(line: Column) -> Column:
                start, end = (place["locus"] + line[f"{side}_{name}"] for name in ("start", "end"))
                return F.transform(_children(start, end, *(line[c] for c in ("l_linenumber", "l_returnflag", "l_linestatus"))), lambda child: F.struct(
                    child["type"].alias("type"), child["start"].alias("start"), child["end"].alias("end"), F.struct(
                        *(line[c].alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), child["sub"].alias("sub")).alias("ord"),
                    place["fwd"].alias("fwd")))

            return F.flatten(F.transform(F.filter("lines", lambda line: line[f"{side}_kept"]), line_features))

        mine = F.filter("places", lambda p: p["contig"].eqNullSafe(F.col("of.contig")) & p[side].eqNullSafe(F.col("of.transcript_id")) & (
            p[f"{side}_gene"].eqNullSafe(F.col("of.gene_id")) if genes else F.lit(True)))
        return F.flatten(F.transform(mine, of))

    rows = _gathered(spark, sf_dir).join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias(PART), "lines", "places", F.explode(F.concat(*map(ids_of, SIDES))).alias("of"))
    return rows.select("of.*", PART, F.when(F.col("of.is_query"), features("query")).otherwise(features("target")).alias("features"))


def listed_releases(spark: SparkSession, sf_dir: str, introns: bool = True) -> tuple[Annotation, Annotation]:
    """Both releases with their features as lists, with ``introns`` or as given; transcripts know the part they lie in."""
    key = (spark.sparkContext.applicationId, sf_dir, introns)
    if key not in _listed:
        features = listed_features(spark, sf_dir)
        features = introns_in_lists(features) if introns else features
        _listed[key] = tuple(replace(_derive(spark, sf_dir, side, [PART]), features=features) for side in SIDES)
    return _listed[key]


def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, contig, gene_id, transcript_id, fwd, features (type, start, end, ord), part: one row per transcript of either release.

    Lines are shuffled once for both releases and gathered by order as they are; what an order knows is joined to the gathered
    rows, and features exist only inside the lists. Starts and ends count from the place of the gene.
    """
    gathered = _gathered(spark, sf_dir)
    ids = [F.when(_present(side), _transcript_id(side)).alias(f"{side}_transcript") for side in SIDES]
    genes = [_gene_id(side).alias(f"{side}_gene") for side in SIDES]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *ids).join(
        table(spark, sf_dir, "customer").select("c_custkey", _contig().alias("contig"), _forward().alias("fwd"), *genes),
        F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")

    def features(side: str) -> Column:
        def of(line: Column) -> Column:
            values = (line[c] for c in (f"{side}_start", f"{side}_end", "l_linenumber", "l_returnflag", "l_linestatus"))
            return F.transform(_children(*values), lambda child: F.struct(
                child["type"].alias("type"), child["start"].alias("start"), child["end"].alias("end"), F.struct(
                    line["l_linenumber"], line["l_partkey"], line["l_suppkey"], line["l_extendedprice"], child["sub"]).alias("ord")))

        return F.flatten(F.transform(F.filter("lines", lambda line: line[f"{side}_kept"]), of))

    revised = [F.when(F.col(f"{side}_transcript").isNotNull(), F.struct(
        F.lit(side).alias("side"), F.col(f"{side}_gene").alias("gene_id"), F.col(f"{side}_transcript").alias("transcript_id"),
        features(side).alias("features"))) for side in SIDES]
    located = gathered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "contig", "fwd", F.col("l_orderkey").alias(PART), F.explode(F.array_compact(F.array(*revised))).alias("of"))
    return located.select("of.side", "contig", "of.gene_id", "of.transcript_id", "fwd", "of.features", PART)


def with_extents(spark: SparkSession, sf_dir: str, side: str, transcripts: DataFrame) -> Annotation:
    """A release whose genes take their extent from ``transcripts`` (contig, gene_id, start, end from the place of the gene)."""
    locus = F.col("c_custkey") * LOCUS_SPACING
    spans = transcripts.groupBy("contig", "gene_id").agg(F.min("start").alias("offset"), F.max("end").alias("offset_end"))
    genes = _customers(spark, sf_dir, side).join(spans, ["contig", "gene_id"], "left").select(
        "contig", "gene_id", "gene_name", "gene_biotype", "source", (locus + F.col("offset")).alias("start"),
        (locus + F.col("offset_end")).alias("end"), "fwd")
    return replace(release(spark, sf_dir, side), genes=genes)


def release(spark: SparkSession, sf_dir: str, side: str) -> Annotation:
    """The target or query release; transcripts without line items keep null coordinates."""
    key = (spark.sparkContext.applicationId, sf_dir, side)
    if key not in _releases:
        _releases[key] = _derive(spark, sf_dir, side)
    return _releases[key]


def _derive(spark: SparkSession, sf_dir: str, side: str, more: list[str] | None = None) -> Annotation:
    # The lines of an order combine where they are read.
    extent = _read_lines(spark, sf_dir, side).groupBy("l_orderkey").agg(
        F.min("offset").alias("offset"), F.max("offset_end").alias("offset_end")
    )
    customers, locus = _customers(spark, sf_dir, side), F.col("c_custkey") * LOCUS_SPACING
    located = (
        _orders(spark, sf_dir, side)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(extent, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("start", locus + F.col("offset"))
        .withColumn("end", locus + F.col("offset_end"))
        .withColumn(PART, F.col("o_orderkey"))
    )
    transcripts = located.select(
        "contig", "gene_id", "transcript_id", F.lit(None).cast("string").alias("transcript_name"),
        "transcript_biotype", "source", "start", "end", "fwd", *(more or []),
    )
    # Genes take their extent from the orders of a customer, by its key: the ids and names of transcripts stay out of it.
    spans = _orders(spark, sf_dir, side).select("o_orderkey", "o_custkey").join(
        extent, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(
        F.min("offset").alias("offset"), F.max("offset_end").alias("offset_end"))
    genes = customers.join(spans, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "contig", "gene_id", "gene_name", "gene_biotype", "source", (locus + F.col("offset")).alias("start"),
        (locus + F.col("offset_end")).alias("end"), "fwd"
    )
    return Annotation(genes, transcripts, _features(spark, sf_dir, side))


def releases(spark: SparkSession, sf_dir: str) -> tuple[Annotation, Annotation]:
    return release(spark, sf_dir, "target"), release(spark, sf_dir, "query")


def release_sql() -> str:
    """The same two releases as SQL common table expressions (t_gene, t_tx, t_feat, q_…)."""
    parts = []
    for side, p in (("target", "t"), ("query", "q")):
        q = side == "query"
        present = "o_totalprice >= 6000" if q else "o_totalprice <= 495000"
        gene_tail = "CASE WHEN c_acctbal < -800 THEN 'n' ELSE '' END" if q else "''"
        tx_tail = "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '.2' ELSE '' END" if q else "''"
        retained = "WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'retained_intron'" if q else ""
        shift = "CASE WHEN CAST(round(l_discount * 100) AS INT) = 0 THEN 3 ELSE 0 END" if q else "0"
        growth = "CASE WHEN CAST(round(l_discount * 100) AS INT) = 10 THEN 7 ELSE 0 END" if q else "0"
        dropped = "WHERE CAST(round(l_tax * 100) AS INT) <> 8" if q else ""
        parts.append(f"""
{p}_cust AS (
  SELECT c_custkey, c_mktsegment || '_' || CAST(c_custkey // {CUSTOMERS_PER_CONTIG} AS VARCHAR) AS contig,
    'G' || CAST(c_custkey AS VARCHAR) || {gene_tail} AS gene_id,
    CASE WHEN c_nationkey <> 7 THEN c_name END AS gene_name,
    CASE WHEN c_nationkey = 24 THEN NULL WHEN c_acctbal > 0 THEN 'protein_coding' ELSE 'lncRNA' END AS gene_biotype,
    CASE WHEN c_nationkey = 3 THEN 'protein_coding' ELSE 'havana' END AS source,
    c_nationkey <= 12 AS fwd
  FROM customer),
{p}_ord AS (
  SELECT o_orderkey, o_custkey, 'T' || CAST(o_orderkey AS VARCHAR) || {tx_tail} AS transcript_id,
    CASE {retained} WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'protein_coding'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'nonsense_mediated_decay'
      WHEN o_orderpriority = '5-LOW' THEN 'lncRNA' END AS transcript_biotype
  FROM orders WHERE {present}),
{p}_line AS (
  SELECT c.contig, c.gene_id, o.transcript_id, c.fwd,
    l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS px, l_returnflag AS rf, l_linestatus AS ls,
    c.c_custkey * {LOCUS_SPACING} + date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * {DAY_WIDTH} + 1 + {shift} AS s,
    c.c_custkey * {LOCUS_SPACING} + date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * {DAY_WIDTH} + {growth}
      + CAST(l_quantity AS INT) * 10 + l_linenumber AS e
  FROM (SELECT * FROM lineitem {dropped}) l
  JOIN {p}_ord o ON l.l_orderkey = o.o_orderkey JOIN {p}_cust c ON o.o_custkey = c.c_custkey),
{p}_feat AS (
  SELECT contig, gene_id, transcript_id, fwd, ln, pk, sk, px, 'exon' AS type, s AS start, e AS "end", 1 AS sub FROM {p}_line
  UNION ALL SELECT contig, gene_id, transcript_id, fwd, ln, pk, sk, px, 'CDS', s + ln, e, CASE WHEN rf = 'A' THEN 0 ELSE 2 END
    FROM {p}_line WHERE rf <> 'N'
  UNION ALL SELECT contig, gene_id, transcript_id, fwd, ln, pk, sk, px, 'five_prime_utr', s, s + ln - 1, 3 FROM {p}_line WHERE rf = 'A'
  UNION ALL SELECT contig, gene_id, transcript_id, fwd, ln, pk, sk, px, 'stop_codon', e - 2, e, 4
    FROM {p}_line WHERE rf = 'R' AND ls = 'F'),
{p}_tx AS (
  SELECT c.contig, c.gene_id, o.transcript_id, CAST(NULL AS VARCHAR) AS transcript_name, o.transcript_biotype, c.source, x.start, x."end", c.fwd
  FROM {p}_ord o JOIN {p}_cust c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT transcript_id, min(start) AS start, max("end") AS "end" FROM {p}_feat GROUP BY 1) x
    ON x.transcript_id = o.transcript_id),
{p}_gene AS (
  SELECT c.contig, c.gene_id, c.gene_name, c.gene_biotype, c.source, x.start, x."end", c.fwd
  FROM {p}_cust c LEFT JOIN (SELECT contig, gene_id, min(start) AS start, max("end") AS "end" FROM {p}_feat GROUP BY 1, 2) x
    ON x.contig = c.contig AND x.gene_id = c.gene_id)""")
    return "WITH RECURSIVE " + ",".join(parts)
