"""Registers of files: types, lookups by several keys, differences, duplicates, replacement, time estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.sources.workdir import fresh

#: File endings by type. Images are taken as documents when both could hold.
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "heic", "heif", "avif"]
EXTENSIONS = {
    "video": ["mp4", "avi", "mov", "mkv", "wmv", "webm", "flv", "m4v", "mpg", "mpeg", "3gp", "ts", "mts", "m2ts"],
    "audio": ["mp3", "wav", "m4a", "aac", "flac", "ogg", "wma", "opus", "aiff", "aif", "amr"],
    "doc": ["pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "odt", "odp", "ods", "rtf", "hwp", "hwpx", "txt", "md", "markdown", "rst", "log", "csv", "tsv", "html", "htm", "epub"] + IMAGES,
}
#: Seconds to index a file and each of its megabytes by type, and to skip one that is indexed.
SECONDS = {"doc": (5.0, 1.0), "image": (0.4, 0.1), "video": (3.0, 0.5), "audio": (2.0, 0.8)}
SKIPPED = (0.05, 0.005)
#: Endings that have an estimate.
ESTIMATED = {
    "doc": ["pdf", "docx", "doc", "hwp", "hwpx", "pptx", "ppt", "txt", "md", "html", "htm", "xlsx", "xls"],
    "image": ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff"],
    "video": ["mp4", "mov", "mkv", "avi", "webm", "flv", "m4v"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac", "wma", "opus"],
}
UPLOAD_MOST = 100 << 20


def ending(path: Column) -> Column:
    """Lower-cased, without the dot; empty if the file's name has none."""
    return F.lower(F.regexp_extract(path, r"[^./\\][^/\\]*\.([^./\\]+)$", 1))


def file_type(path: Column, table: dict[str, list[str]] = EXTENSIONS) -> Column:
    """The type of a path's ending, null for others."""
    end = ending(path)
    return reduce(lambda out, kv: F.when(end.isin(kv[1]), kv[0]).otherwise(out), reversed(table.items()), F.lit(None).cast("string"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The file's name without its last ending."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def sanitised(name: Column) -> Column:
    """Characters that paths must not have become ``_``; blanks around and dots behind go."""
    out = F.rtrim(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_")), F.lit("."))
    return F.when(out == "", "unnamed").otherwise(out)


def stem_key(key: Column) -> Column:
    """Sanitised stem and the first eight hex digits of the key's MD5: unlike for equal names in two folders."""
    return F.concat(sanitised(stem(key)), F.lit("__"), F.substring(F.md5(key.cast("binary")), 1, 8))


def normal(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, kind, type, size) of a folder's entries: folders first, then by name without case.

    Spark's own file system answers, so any store that it reads can be listed; one folder's entries
    are as many rows as the driver gets.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    rows = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), None if s.isDirectory() else s.getLen()) for s in found]
    df = spark.createDataFrame(rows, "name string, path string, folder boolean, size long")
    kind = F.when(F.col("folder"), "folder").otherwise("file")
    return df.orderBy(F.desc("folder"), F.lower("name")).select("name", "path", kind.alias("kind"), F.when(~F.col("folder"), file_type(F.col("path"))).alias("type"), "size")


def lookup(paths: DataFrame, registered: DataFrame, on_disk: DataFrame, root: str = "/raw") -> DataFrame:
    """(path, domain) of each path: by absolute path or alias, else by key below ``root``, else by size and name.

    registered: key, domain, abs, alias; on_disk: path, size, file_name. Where several entries share a
    key of one kind the greatest entry's domain counts. Unknown paths have a null domain.
    """
    best = F.max_by("domain", "key").alias("domain")
    named = registered.where("abs is not null").select(normal(F.col("abs")).alias("k"), "key", "domain")
    named = named.union(registered.where("alias is not null").select(normal(F.col("alias")), "key", "domain"))
    by_path = named.groupBy("k").agg(best)
    by_key = registered.select(normal(F.concat(F.lit(root + "/"), "domain", F.lit("/"), "key")).alias("k"), "key", "domain").groupBy("k").agg(best)
    sizes = on_disk.select(normal(F.col("path")).alias("k"), "size", F.lower("file_name").alias("name"))
    # an entry's own size is that of the file on disk that it names
    by_size = named.join(sizes, "k").groupBy("size", "name").agg(best)
    p = paths.select("path").distinct().withColumn("k", normal(F.col("path")))
    p = p.join(by_path.withColumnRenamed("domain", "d1"), "k", "left").join(by_key.withColumnRenamed("domain", "d2"), "k", "left")
    p = p.join(sizes, "k", "left").join(by_size.withColumnRenamed("domain", "d3"), ["size", "name"], "left")
    return p.select("path", F.coalesce("d1", "d2", "d3").alias("domain"))


def stem_sources(stems: DataFrame, registered: DataFrame) -> DataFrame:
    """(stem, path, file_name) of the registered document behind each page stem, null if there is none.

    By hashed stem; else, the hash taken off, by the key's sanitised or plain stem; else by the stem of
    the absolute path; else by that of an alias. Of several entries the smallest key counts.
    """
    base = F.when(F.col("stem").contains("__"), F.regexp_replace("stem", "__(?:(?!__).)*$", "")).otherwise(F.col("stem"))
    r = registered.withColumn("file", base_name(F.col("key"))).withColumn("at", F.coalesce("abs", F.lit("")))
    cand = [
        r.select(stem_key(F.col("key")).alias("k"), F.lit(1).alias("prio"), "key", "at", "file"),
        r.select(sanitised(stem(F.col("key"))).alias("k"), F.lit(2), "key", "at", "file"),
        r.select(stem(F.col("key")).alias("k"), F.lit(2), "key", "at", "file"),
        r.where("abs is not null").select(stem(F.col("abs")).alias("k"), F.lit(3), "key", "at", base_name(F.col("abs"))),
        r.where("alias is not null").select(stem(F.col("alias")).alias("k"), F.lit(4), "key", F.col("alias"), base_name(F.col("alias"))),
    ]
    keys = reduce(DataFrame.union, cand)
    s = stems.select("stem").distinct()
    asked = s.select("stem", F.col("stem").alias("k"), F.lit(True).alias("hashed")).union(s.select("stem", base, F.lit(False)))
    hit = asked.join(keys, "k").where("hashed = (prio = 1)")
    best = hit.groupBy("stem").agg(F.min_by(F.struct("at", "file"), F.struct("prio", "key", "at")).alias("b"))
    return s.join(best, "stem", "left").select("stem", F.col("b.at").alias("path"), F.col("b.file").alias("file_name"))


def orphans(registered: DataFrame, on_disk: DataFrame, folder: str = "/") -> DataFrame:
    """(abs, domain) of entries below a folder whose file is gone."""
    base = folder.lower().replace("\\", "/").rstrip("/")
    n = normal(F.col("abs"))
    under = registered.where(F.col("abs").isNotNull() & ((n == base) | n.startswith(base + "/")))
    return under.join(on_disk.select(F.col("path").alias("abs")), "abs", "left_anti").select("abs", "domain")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, state) of two registers (key, sha): new, deleted, modified or same."""
    o, n = old.select("key", F.col("sha").alias("o")), new.select("key", F.col("sha").alias("n"))
    state = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("same")
    return o.join(n, "key", "full").select("key", state.alias("state"))


def replace_by_file(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of the keys in ``new``, then ``new``: nothing old stays of a file that is indexed again."""
    return rows.join(new.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def removed_count(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(rows, removed): how many rows there are after ``replace_by_file`` and how many old ones went."""
    gone = rows.join(new.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("removed"))
    return replace_by_file(rows, new, key).agg(F.count("*").alias("rows")).crossJoin(gone)


def keep_one(registered: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(sha, key, keep) of entries with equal content. Kept is, of those not staged, the first whose file exists, else the first; else the first staged one."""
    r = registered.join(on_disk.select(F.col("path").alias("abs"), F.lit(True).alias("there")).distinct(), "abs", "left")
    staged = F.col("key").startswith("staged/")
    group = Window.partitionBy("sha")
    order = group.orderBy(staged, F.coalesce(~staged & F.col("there"), F.lit(False)).desc(), "doc_id")
    r = r.where("sha is not null").withColumn("n", F.count("*").over(group)).where("n > 1")
    return r.select("sha", "key", (F.row_number().over(order) == 1).alias("keep"))


def keep_one_media(registered: DataFrame) -> DataFrame:
    """The same for recordings: the first relative key is kept, else the first."""
    absolute = F.col("key").rlike(r"^(?:C:|/)|^.{0,4}\\")
    group = Window.partitionBy("sha")
    r = registered.where("sha is not null").withColumn("n", F.count("*").over(group)).where("n > 1")
    return r.select("sha", "key", (F.row_number().over(group.orderBy(absolute, "doc_id")) == 1).alias("keep"))


def estimate(files: DataFrame, indexed: Column) -> DataFrame:
    """(type, files, skipped, seconds) to index files (path, size in bytes), by type; unsupported ones under null. ``indexed`` tells those that are."""
    kind = file_type(F.col("path"), ESTIMATED)
    mb = F.col("size") / (1 << 20)
    table = F.create_map(*[x for k, v in SECONDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    f = files.select(kind.alias("type"), mb.alias("mb"), indexed.alias("skip"))
    cost = F.when(F.col("type").isNull(), 0.0).when(F.col("skip"), SKIPPED[0] + SKIPPED[1] * F.col("mb")).otherwise(table[F.col("type")][0] + table[F.col("type")][1] * F.col("mb"))
    return f.groupBy("type").agg(F.count("*").alias("files"), F.count(F.when(F.col("skip") & F.col("type").isNotNull(), 1)).alias("skipped"), F.sum(cost).alias("seconds"))


def metadata_of(names: DataFrame, metadata: DataFrame, head: int = 30, least: int = 3) -> DataFrame:
    """(file_name, text) of the metadata (ord, key, text) that fits each name best.

    By stem; else by whole name; else the first key that starts the stem or is started by its first
    ``head`` characters; else the first of ``least`` characters or more that, blanks aside, the stem
    holds. One join on equal values: a name asks for the starts of its stem that are as long as some
    key, and for those parts that are as long as some key of the same first ``least`` characters; keys
    answer as a whole, by their starts and without blanks. Of equal answers only the first is kept, so a name
    meets one row for each part it asks for, however many keys share a start. Both sides are written once.
    """
    spark, path = names.sparkSession, fresh(names.sparkSession, "metadata")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def lengths(text: Column) -> Column:
        return F.collect_set(F.length(text)).alias("lengths")

    def parts(text: Column, at: Column) -> Column:
        """A text's parts from a place on, of the lengths that are wanted and there."""
        return F.explode(F.transform(F.filter("lengths", lambda i: at + i - 1 <= F.length(text)), lambda i: F.substring(text, at, i))).alias("part")

    kind = lambda k: F.lit(k).alias("kind")
    m = metadata.where("key != ''").withColumn("bare", F.replace("key", F.lit(" "), F.lit("")))
    m = kept(m.select("ord", "key", "text", "bare"), "keys")
    n = names.select("file_name").distinct().withColumn("stem", F.lower(stem(F.col("file_name")))).withColumn("bare_stem", F.regexp_replace("stem", "[ \\x{200B}]", ""))
    n = kept(n, "names")
    start = F.substring("stem", 1, head)
    bare = m.where(F.length("bare") >= least)
    # the lengths that occur: few numbers, kept so that their size is known
    of_keys, of_starts = kept(m.agg(lengths(F.col("key"))), "key_lengths"), kept(n.agg(lengths(start)), "start_lengths")
    grams = kept(bare.groupBy(F.substring("bare", 1, least).alias("gram")).agg(lengths(F.col("bare"))), "grams")

    answers = m.select(kind("key"), F.col("key").alias("part"), "ord", "text")
    answers = answers.union(m.crossJoin(F.broadcast(of_starts)).select(kind("start"), parts(F.col("key"), F.lit(1)), "ord", "text"))
    answers = answers.union(bare.select(kind("bare"), "bare", "ord", "text"))
    answers = answers.groupBy("kind", "part").agg(F.min_by(F.struct("ord", "text"), F.struct("ord")).alias("first"))

    asked = n.crossJoin(F.broadcast(of_keys)).select("file_name", "stem", parts(F.col("stem"), F.lit(1)))
    asked = asked.select("file_name", kind("key"), "part", F.when(F.col("stem") == F.col("part"), 1).otherwise(3).alias("prio"))  # the whole stem is its last start
    asked = asked.union(n.select("file_name", kind("key"), F.lower("file_name"), F.lit(2)))
    asked = asked.union(n.select("file_name", kind("start"), start, F.lit(3)))
    places = n.where(F.length("bare_stem") >= least).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("bare_stem") - (least - 1))))
    within = places.withColumn("gram", F.substring("bare_stem", F.col("at"), F.lit(least))).join(grams, "gram")
    asked = asked.union(within.select("file_name", kind("bare"), parts(F.col("bare_stem"), F.col("at")), F.lit(4)))
    hits = asked.join(answers, ["kind", "part"]).select("file_name", "prio", "first.*")
    best = hits.groupBy("file_name").agg(F.min_by("text", F.struct("prio", "ord")).alias("text"))
    return n.select("file_name").join(best, "file_name", "left")


def purge_pages(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """Pages (id ``page_images/<stem>/p0001.jpg``) of documents that are not among the changed keys."""
    at = pages.withColumn("__stem", F.regexp_extract("id", "^page_images/([^/]+)/", 1))
    return at.join(changed.select(stem_key(F.col("key")).alias("__stem")).distinct(), "__stem", "left_anti").drop("__stem")


def append(df: DataFrame, path: str, columns: str) -> None:
    """Adds rows of a stored table, cast to its columns (DDL); Spark's committer makes them visible together."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(columns)
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)


def aligned(vectors: DataFrame, ids: DataFrame, channel: DataFrame) -> DataFrame:
    """(ord, vec, id, value): rows of three files by their place.

    vectors: ord, vec; ids: ord, id; channel: ord, value. The vectors say how many rows there are: ids
    beyond them go, missing ones are empty. A channel of another length is left out as a whole.
    """
    sizes = vectors.agg(F.count("*").alias("n")).crossJoin(channel.agg(F.count("*").alias("m"))).select((F.col("n") == F.col("m")).alias("fits"))
    rows = vectors.join(ids, "ord", "left").join(channel, "ord", "left").crossJoin(F.broadcast(sizes))
    return rows.select("ord", "vec", F.coalesce("id", F.lit("")).alias("id"), F.when(F.col("fits"), F.col("value")).alias("value"))


def expired(files: DataFrame, prefixes: list[str], seconds: float, now: Column) -> DataFrame:
    """(folder, last, bytes, stale) of temporary folders, those whose name starts with a prefix, from files (folder, changed, size).

    A folder lives as long as its files change: it is stale if the last change is more than ``seconds`` before ``now``.
    """
    mine = reduce(lambda a, b: a | b, [F.col("folder").startswith(p) for p in prefixes])
    per = files.where(mine).groupBy("folder").agg(F.max("changed").alias("last"), F.sum("size").alias("bytes"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return per.select("folder", "last", "bytes", (age > seconds).alias("stale"))
