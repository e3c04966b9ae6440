"""Upserts, resumable ingest and upload checks on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.session import materialize, sized


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """K1-K3: `old` with the rows of `new` in place of those with equal keys; of new rows with equal keys the one of
    highest version stays. Null keys equal each other."""
    if version:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where("__n = 1").drop("__n", version)
    cond = None
    fresh = new.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = c if cond is None else cond & c
    return old.join(fresh, cond, "left_anti").unionByName(new)


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """K1, K2: nulls replaced by the value, or the first column that is not null, that a column falls back to."""
    fall = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({c: F.coalesce(F.col(c), fall(v)) for c, v in defaults.items()})


def patch(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """K4: `column` replaced where `updates` has a value for the key."""
    u = updates.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    return table.join(u, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")


def missing(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is not known yet."""
    return candidates.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def document_url(root: str, cik: Column, accession: Column, filename: Column) -> Column:
    """S3."""
    return F.concat_ws("/", F.lit(root), cik, F.translate(accession, "-", ""), filename)


def exhibits(hits: DataFrame, most: int = 2000) -> DataFrame:
    """Of paged hits each once, at its first query and rank, exhibits of kind 10 with accession and filer alone,
    the id parted at its first colon, in order, at most `most`."""
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("hit_id").orderBy("query_ord", "rank"))).where("__n = 1")
    some = first.where(F.col("file_type").startswith("EX-10") & F.col("cik").isNotNull() & F.col("adsh").isNotNull())
    some = some.withColumn("filename", F.expr("substring(hit_id, locate(':', hit_id) + 1)"))
    return some.orderBy("query_ord", "rank").limit(most).select("hit_id", "cik", "adsh", "filename", company_name(F.col("name")).alias("company"))


def company_name(c: Column) -> Column:
    """Without the filer number and then a ticker in parentheses at the end."""
    c = F.trim(F.regexp_replace(c, r"\s*\(CIK\s+\d+\)", ""))
    return F.trim(F.regexp_replace(c, r"\s*\([A-Z0-9, -]+\)\s*$", ""))


# Fixed value: what marks an agreement of the wanted kind.
WANTED = r"master\s+service[s]?\s+agreement|software\s+as\s+a\s+service|SaaS|subscription\s+agreement|cloud\s+service[s]?\s+agreement"


def accepted_exhibits(docs: DataFrame, text: str = "text", least: int = 2000, most: int = 500_000, pattern: str = WANTED) -> DataFrame:
    """Texts of at least `least` characters that have the pattern in their first 5000, cut to `most`."""
    t = F.col(text)
    return docs.where((F.length(t) >= least) & F.rlike(F.left(t, F.lit(5000)), F.lit("(?iu)" + pattern))).withColumn(text, F.left(t, F.lit(most)))


def numbered(new: DataFrame, known: DataFrame, order: str, key: str = "accession", prefix: str = "edgar_", target: int | None = None) -> DataFrame:
    """New rows that are not known yet, with ids that go on from the number of known ones; with `target`, the
    first ones, until there are so many in all. Rows are ranked by ranges of `order`, not in one task."""
    left = missing(new, known, key)
    n = known.count()
    at = F.monotonically_increasing_id()
    dealt = left.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialize(dealt.withColumns({"__pid": F.shiftright(at, 33), "__idx": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy("__pid").agg((F.max("__idx") + 1).alias("__n"))  # a row for a partition
    starts = counts.select("__pid", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.col("__idx") + 1
    out = placed.join(sized(starts, "numbered-starts"), "__pid").withColumn("__rank", rank + n)
    if target is not None:
        out = out.where(F.col("__rank") <= target)
    return out.withColumn("contract_id", F.format_string(prefix + "%04d", F.col("__rank"))).drop("__pid", "__idx", "__start", "__rank")


def upload_problem(filename: Column, size: Column, magic: Column) -> Column:
    """Why an upload is refused; null if it is not. magic: its first four bytes as text."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(~ext.isin(".pdf", ".txt"), "type").when(size > 10 * 1024 * 1024, "size").when((ext == ".pdf") & (magic != "%PDF"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def html_text(html: Column) -> Column:
    """S5 as patterns: scripts and styles gone, block tags to line feeds, other tags gone, common entities decoded,
    runs of spaces collapsed and blank lines limited to two line feeds."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?i)</?(br|p|div|tr|li|h[1-4])(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str):
    """ST6: the query that writes a stream of rows into the table at `path`, each key once, in its highest version.

    Each batch is merged with the table as it stands and written beside it as the next generation; a batch that is run
    again after a failure writes the same generation. current() reads the newest one. Old generations are deleted two
    batches later, so that a reader of the last one is not cut off.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, number - 1)
        newest = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where("__n = 1").drop("__n")
        if before is not None:
            old = before.select(*keys, F.col(version).alias("__old"))
            newest = newest.join(old, keys, "left").where(F.col("__old").isNull() | (F.col(version) >= F.col("__old"))).drop("__old").select(batch.columns)
            newest = before.join(newest.select(*keys), keys, "left_anti").unionByName(newest)
        newest.write.mode("overwrite").parquet(f"{path}/generation={number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark, path: str, number: int | None = None) -> DataFrame | None:
    """The newest whole generation that ingest() has written at `path`, up to `number`; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    found = [s.getPath() for s in fs.listStatus(p)]
    whole = [int(f.getName().split("=")[1]) for f in found if f.getName().startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    whole = [n for n in whole if number is None or n <= number]
    return spark.read.parquet(f"{path}/generation={max(whole)}") if whole else None
