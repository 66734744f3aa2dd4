"""Upkeep of registers and indexes: stale keys, reconciling, audits, double results, links by content, deletion; and measures by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.registers import base_name, file_type, normal, stem_key
from orrery.sources.versioned import VersionedTable

#: The share of a domain's ids above which reconciling is left to a person, and captions of a group.
MOST_GONE, CAPTIONS = 0.80, 10


def prune(rows: DataFrame, registered: DataFrame, current: DataFrame) -> DataFrame:
    """``rows`` (key, ...) without those of stale keys: registered, but not among the current ones. Rows of unknown keys stay."""
    stale = registered.select("key").join(current.select("key"), "key", "left_anti").distinct()
    return rows.join(stale, "key", "left_anti").select(*rows.columns)


def reconcile(index: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of an index (domain, id, ...) held against a register (domain, key).

    Rows go whose key is not registered; of the domain Doc those whose page ``page_images/<stem>/...`` is of no
    registered document, or that are no page at all. A domain without registered keys is skipped, one
    that would lose more than MOST_GONE of its ids is aborted: their rows stay. report: domain, total,
    to_delete, action (delete, skip or abort).
    """
    page = F.regexp_extract("id", "^page_images/([^/]+)/", 1)
    doc = F.col("domain") == "Doc"
    keyed = index.withColumn("__k", F.when(doc, page).otherwise(F.col("id")))
    known = registered.select("domain", F.when(F.col("domain") == "Doc", stem_key(F.col("key"))).otherwise(F.col("key")).alias("__k"), F.lit(True).alias("__known")).distinct()
    seen = keyed.join(known, ["domain", "__k"], "left").withColumn("__gone", F.col("__known").isNull())
    has = registered.select("domain", F.lit(True).alias("__has")).distinct()
    per = seen.groupBy("domain").agg(F.count("*").alias("total"), F.count(F.when(F.col("__gone"), 1)).alias("to_delete")).join(has, "domain", "left")
    action = F.when(F.col("__has").isNull(), "skip").when(F.col("to_delete") > MOST_GONE * F.col("total"), "abort").otherwise("delete")
    report = per.select("domain", "total", "to_delete", action.alias("action"))
    kept = seen.join(report.select("domain", "action"), "domain").where(~F.col("__gone") | (F.col("action") != "delete"))
    return kept.select(*index.columns), report


def audit(registered: DataFrame, on_disk: DataFrame, rows: DataFrame) -> DataFrame:
    """(domain, files, entries, rows, orphans, missing, no_sha, sha_doubles, name_doubles) of a register (domain, key, sha, abs, alias), files (domain, path) and index rows (domain).

    orphans: entries whose file is gone; missing: files that no entry or alias names; doubles: entries of
    content, or of a name, that another one has.
    """
    count = lambda df, name: df.groupBy("domain").agg(F.count("*").alias(name))
    paths = registered.select("domain", normal(F.col("abs")).alias("p")).union(registered.select("domain", normal(F.col("alias")))).where("p IS NOT NULL").distinct()
    disk = on_disk.select("domain", normal(F.col("path")).alias("p"))
    orphans = registered.where("abs IS NOT NULL").select("domain", normal(F.col("abs")).alias("p")).join(disk.distinct(), ["domain", "p"], "left_anti")
    missing = disk.join(paths, ["domain", "p"], "left_anti")
    doubled = lambda c: registered.withColumn("v", c).where("v IS NOT NULL").groupBy("domain", "v").agg(F.count("*").alias("n")).where("n > 1").groupBy("domain").agg(F.sum("n").alias("n"))
    out = count(registered, "entries").join(count(on_disk, "files"), "domain", "full")
    for part in (count(rows, "rows"), count(orphans, "orphans"), count(missing, "missing"), count(registered.where("sha IS NULL"), "no_sha"), doubled(F.col("sha")).withColumnRenamed("n", "sha_doubles"), doubled(base_name(F.col("key"))).withColumnRenamed("n", "name_doubles")):
        out = out.join(part, "domain", "full")
    names = ("files", "entries", "rows", "orphans", "missing", "no_sha", "sha_doubles", "name_doubles")
    return out.select("domain", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names])


def keep_first(results: DataFrame, rule: str) -> DataFrame:
    """results (qid, domain, id, file_path, file_name, confidence) without double ones; of each key the most confident stays, of equal ones the smallest id.

    rule ``path``: the file's path, else the id. ``name``: the file's name (else the path's last part) in
    lower case. ``domain``: of images the id's last part, of pages (doc_page) the file's name, else the id's last
    part; rows of other domains all stay.
    """
    leaf = base_name(F.col("id"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    if rule == "path":
        key = F.coalesce(given("file_path"), F.col("id"))
    elif rule == "name":
        key = F.lower(F.coalesce(given("file_name"), base_name(F.coalesce("file_path", F.lit("")))))
    elif rule == "domain":
        key = F.when(F.col("domain") == "image", F.concat(F.lit("i:"), leaf)).when(F.col("domain") == "doc_page", F.concat(F.lit("d:"), F.coalesce(given("file_name"), leaf))).otherwise(F.concat(F.lit("o:"), F.col("domain"), F.lit(":"), F.col("id")))
    else:
        raise ValueError(f"no rule {rule}")
    w = Window.partitionBy("qid", "__key").orderBy(F.desc("confidence"), "id")
    first = results.withColumn("__key", key).withColumn("__n", F.row_number().over(w))
    alone = (F.col("__n") == 1) if rule != "domain" else (F.col("__n") == 1) | ~F.col("domain").isin("image", "doc_page")
    return first.where(alone).select(*results.columns)


def link_unregistered(registered: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(key, alias): paths on disk that no entry names, by path or alias, but whose content one has; of several such entries the last registered takes it.

    registered: ord, key, sha, abs, alias; on_disk: path, sha.
    """
    known = registered.select(normal(F.col("abs")).alias("p")).union(registered.select(normal(F.col("alias")))).where("p IS NOT NULL").distinct()
    owner = registered.where("sha IS NOT NULL").groupBy("sha").agg(F.max_by("key", "ord").alias("key"))
    new = on_disk.withColumn("p", normal(F.col("path"))).join(known, "p", "left_anti").groupBy("p", "sha").agg(F.min("path").alias("alias"))
    return new.join(owner, "sha").select("key", "alias")


def delete_documents(index: VersionedTable, names: DataFrame, recent: DataFrame) -> tuple[int, DataFrame]:
    """(version, recent): takes the documents of ``names`` (name) out of an index keyed by document, and their keys out of the list of recent uploads.

    One new version: until it is there, readers have the old one. recent (key) loses the blank keys and, case aside,
    those that are a name or end in one.
    """
    names = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    version = index.delete(names.select(F.col("name").alias(index.key)))
    low = names.select(F.lower("name").alias("n"))
    r = recent.withColumn("key", F.trim("key")).where("key <> ''").withColumns({"__k": F.lower("key"), "__b": F.lower(base_name(F.col("key")))})
    kept = r.join(low, r["__k"] == low["n"], "left_anti").join(low, F.col("__b") == low["n"], "left_anti")
    return version, kept.select(*recent.columns)


def caption_groups(captions: DataFrame, key: str, order: str, text: str, size: int = CAPTIONS) -> DataFrame:
    """(key, i, forward, backward): a recording's captions in groups of ``size``, joined by ``. ``, from the first on and from the last back."""
    ahead, back = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    rows = captions.select(key, F.col(text).alias("__t"), (F.row_number().over(ahead) - 1).alias("__f"), (F.row_number().over(back) - 1).alias("__b"))
    of = lambda c: rows.groupBy(key, F.floor(F.col(c) / size).cast("int").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "__t"))), lambda x: x["__t"]), ". ").alias(c))  # noqa: E731 (a group holds ``size``)
    return of("__f").join(of("__b"), [key, "i"]).select(key, "i", F.col("__f").alias("forward"), F.col("__b").alias("backward"))


def class_metrics(judged: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support, accuracy, macro_f1) of rows (truth, guess): each label's measures, and those of all.

    Pairs of which one is no label count for accuracy alone. A ratio over nothing is 0; macro_f1 is the
    mean over all labels, also those without rows.
    """
    cells = judged.groupBy("truth", "guess").agg(F.count("*").alias("n"))  # labels squared
    both = cells.where(F.col("truth").isin(labels) & F.col("guess").isin(labels))
    hit = F.col("truth") == F.col("guess")
    names = judged.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    per_truth = both.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    per_guess = both.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    of = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = names.join(per_truth, "label", "left").join(per_guess, "label", "left").na.fill(0)
    m = m.withColumns({"precision": of(F.col("tp"), F.col("guessed")), "recall": of(F.col("tp"), F.col("support"))})
    m = m.withColumn("f1", of(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    every = m.agg(F.avg("f1").alias("macro_f1")).crossJoin(cells.agg(of(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy")))
    r = lambda c: F.round(c, 4).alias(c)
    return m.crossJoin(F.broadcast(every)).select("label", r("precision"), r("recall"), r("f1"), F.col("support").cast("long").alias("support"), r("accuracy"), r("macro_f1"))  # one row


def listing(files: DataFrame, folder: str) -> DataFrame:
    """(place, name, path, kind, type, size): what lies in a folder by a table of files (path, size): folders first, then by name without case."""
    base = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    below = files.where(F.col("path").startswith(base) & (F.length(rest) > 0)).withColumns({"name": F.split(rest, "/")[0], "folder": F.contains(rest, F.lit("/"))})
    kinds: Column = F.when(F.col("folder"), "folder").otherwise("file")
    each = below.groupBy("name", "folder").agg(F.max(F.when(~F.col("folder"), F.col("size"))).alias("size"))
    each = each.withColumn("path", F.concat(F.lit(base), "name"))
    place = F.row_number().over(Window.orderBy(F.desc("folder"), F.lower("name"), "name"))  # the entries of one folder
    return each.select(place.alias("place"), "name", "path", kinds.alias("kind"), F.when(~F.col("folder"), file_type(F.col("path"))).alias("type"), "size")
