"""Tables of images, results, history, pipelines, presets and jobs, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_UPLOAD = 25 * 1024 * 1024
CACHE_ENTRIES, CACHE_BYTES = 400, 256 * 1024 * 1024
HISTORY, VERSIONS, JOBS = 500, 20, 100
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff", ".webp")


def newest(df: DataFrame, order: list[Column], keep: int) -> DataFrame:
    return df.orderBy(*order).limit(keep)


# Images


def split_uploads(files: DataFrame, limit: int = MAX_UPLOAD) -> DataFrame:
    """``files(name, content, …)`` with status: skipped beyond the limit, ignored when empty, else saved."""
    size = F.octet_length("content")
    return files.withColumn("status", F.when(F.coalesce(size, F.lit(0)) == 0, "ignored").when(size > limit, "skipped").otherwise("saved"))


def content_id(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def dedupe_by_content(files: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """One row per content, the first by ``order``; contents that ``known(id)`` has are left out. An aggregation, so copies combine before they are shuffled."""
    named = files.withColumn("id", content_id(F.col("content"))).drop("content")
    first = named.groupBy("id").agg(F.min_by(F.struct(*(c for c in named.columns if c != "id")), order).alias("f")).select("id", "f.*")
    return first if known is None else first.join(known.select("id"), "id", "left_anti")


def extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    return F.when(ext.isin(*EXTENSIONS), ext).otherwise(".png")


def update_meta(images: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``changes(id, tags, note, filename)``: only these fields, null leaves a field as it is."""
    new = changes.select("id", *(F.col(c).alias(f"__{c}") for c in ("tags", "note", "filename")), F.lit(True).alias("__hit"))
    out = images.join(new, "id", "left")
    out = out.withColumns({c: F.coalesce(f"__{c}", c) for c in ("tags", "note", "filename")} | {"updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))})
    return out.drop("__tags", "__note", "__filename", "__hit")


def add_annotation(annotations: Column, box: Column, label: Column, color: Column, created_at: Column) -> Column:
    return F.array_append(annotations, F.struct(box.alias("box"), label.alias("label"), color.alias("color"), created_at.alias("created_at")))


def delete_annotation(annotations: Column, index: Column) -> Column:
    """By place from 0; out of range changes nothing."""
    return F.filter(annotations, lambda a, i: i != index)


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def without(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")


def pick(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """The rows that ``ids`` name."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def listing(df: DataFrame, newest_by: str, tie: str) -> DataFrame:
    """Newest first."""
    return df.orderBy(F.desc(newest_by), F.desc(tie))


def orphan_files(files: DataFrame, records: DataFrame, on: str = "id") -> DataFrame:
    """Files that no record knows, and that are no temporary ones: what a cleaning removes."""
    known = files.join(records.select(on), on, "left_anti")
    return known.where(~F.col("name").startswith(".tmp-")) if "name" in files.columns else known


def reconcile(records: DataFrame, files: DataFrame, on: str = "id") -> DataFrame:
    """(id, kind): records without a file and files without a record, both directions in one full join."""
    r = records.select(on).distinct().withColumn("__r", F.lit(True))
    f = files.select(on).distinct().withColumn("__f", F.lit(True))
    both = r.join(f, on, "full").where("__r IS NULL OR __f IS NULL")
    return both.select(on, F.when(F.col("__f").isNull(), "orphan_meta").otherwise("orphan_file").alias("kind"))


# Result cache


def cache_key(*parts: Column) -> Column:
    zero = F.lit(b"\0")
    return F.sha2(F.concat(*(x for p in parts for x in (p.cast("string").cast("binary"), zero))), 256)


def probe(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests(key, …)`` with result_id and cache_hit: a hit needs an entry and its file (``present``)."""
    live = cache.where("present").select("key", "result_id")
    return requests.join(live, "key", "left").withColumn("cache_hit", F.col("result_id").isNotNull())


def touch(cache: DataFrame, used: DataFrame) -> DataFrame:
    """last_access moved up to the latest use ``used(key, at)``."""
    last = used.groupBy("key").agg(F.max("at").alias("__at"))
    return cache.join(last, "key", "left").withColumn("last_access", F.greatest("last_access", "__at")).drop("__at")


def latest_per_key(entries: DataFrame, key: str = "key", order: str = "created_at", tie: str = "result_id") -> DataFrame:
    """Upsert: of all writes the last one per key."""
    cols = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, tie)).alias("e")).select(key, "e.*")


def evict(cache: DataFrame, entries: int = CACHE_ENTRIES, total: int = CACHE_BYTES) -> DataFrame:
    """The most recently used entries that fit both limits. No more than ``entries`` rows are ever summed in order, whatever the cache's size."""
    order = [F.desc("last_access"), F.desc("result_id")]
    top = cache.orderBy(*order).limit(entries)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("__sum", F.sum("size_bytes").over(w)).where(F.col("__sum") <= total).drop("__sum")


# History, pipelines, presets


def add_history(history: DataFrame, entries: DataFrame, keep: int = HISTORY) -> DataFrame:
    return newest(history.unionByName(entries, allowMissingColumns=True), [F.desc("created_at"), F.desc("id")], keep)


def with_versions(updates: DataFrame, keep: int = VERSIONS) -> DataFrame:
    """From all saves ``(pipeline_id, saved_at, save_id, nodes)``: each with its version number, current or not, for the current and the ``keep`` versions before it."""
    ordered = Window.partitionBy("pipeline_id").orderBy("saved_at", "save_id")
    back = Window.partitionBy("pipeline_id").orderBy(F.desc("saved_at"), F.desc("save_id"))
    out = updates.withColumns({"version": F.row_number().over(ordered), "__back": F.row_number().over(back)})
    return out.where(F.col("__back") <= keep + 1).withColumn("is_current", F.col("__back") == 1).drop("__back")


def delete_history(history: DataFrame, results: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History without ``ids``, and results without those that the entries link to, shared or not."""
    linked = pick(history, ids).where("result_id IS NOT NULL").select("result_id").distinct()
    return without(history, ids), without(results, linked, "result_id")


def record_history(runs: DataFrame, name: Column, node_count: Column) -> DataFrame:
    """History entries of ``runs(image_id, result_id, cache_hit, error, began, ended, …)``, seconds as milliseconds."""
    status = F.when(F.col("error").isNull(), "ok").otherwise("error")
    added = {"pipeline_name": name, "node_count": node_count, "status": status, "duration_ms": F.floor((F.col("ended") - F.col("began")) * 1000).cast("long")}
    return runs.withColumns(added).drop("began", "ended")


def with_scope(presets: DataFrame) -> DataFrame:
    return presets.withColumn("scope", F.coalesce("scope", F.lit("filter")))


def add_presets(presets: DataFrame, new: DataFrame) -> DataFrame:
    """New ones before the others; without a scope they are for filters."""
    return with_scope(new).unionByName(presets)


def update_preset(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(id, name, params)``: null leaves a field as it is."""
    new = changes.select("id", F.col("name").alias("__name"), F.col("params").alias("__params"))
    return presets.join(new, "id", "left").withColumns({"name": F.coalesce("__name", "name"), "params": F.coalesce("__params", "params")}).drop("__name", "__params")


def restored(history: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """A first-version pipeline from each entry's snapshot, taken to be valid."""
    name = F.concat(F.lit("restored: "), F.coalesce("pipeline_name", F.lit("history")))
    return history.select(new_id.alias("id"), name.alias("name"), F.col("pipeline_snapshot").alias("nodes"), F.lit(1).alias("version"), F.lit(True).alias("valid"), now.alias("created_at"), now.alias("updated_at"))


def restore(history: DataFrame, entry_id: str, new_id: Column, now: Column) -> DataFrame:
    """:func:`restored` of one entry."""
    return restored(history.where(F.col("id") == entry_id), new_id, now)


def health(**tables: DataFrame) -> DataFrame:
    """Row counts by name, one aggregate a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Jobs


def job_state(results: DataFrame) -> DataFrame:
    """``results(job_id, image_id, status)``, status null while an image waits: totals over distinct images, progress, state."""
    once = results.groupBy("job_id", "image_id").agg(F.max("status").alias("status"), F.max((F.col("status") == "error").cast("int")).alias("bad"))
    out = once.groupBy("job_id").agg(F.count("*").alias("total"), F.count("status").alias("done"), F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"))
    state = F.when(F.col("done") < F.col("total"), "running").when(F.col("errors") > 0, "partial").otherwise("done")
    return out.withColumns({"progress": F.floor(F.col("done") * 100.0 / F.col("total") + 0.5).cast("int"), "status": state})


def queued(jobs: DataFrame) -> DataFrame:
    """New jobs of ``jobs(id, image_ids, created_at, …)``; an image counts once."""
    images = F.array_distinct("image_ids")
    return jobs.withColumns({"image_ids": images, "total": F.size(images), "done": F.lit(0), "status": F.lit("queued")})


def enqueue(jobs: DataFrame, new: DataFrame, keep: int = JOBS) -> DataFrame:
    """The newest ``keep`` of all jobs, the new ones queued."""
    return newest(jobs.unionByName(queued(new), allowMissingColumns=True), [F.desc("created_at"), F.desc("id")], keep)


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Queued and running jobs of ``ids(id)`` become cancelled, and stay so."""
    hit = ids.select("id", F.lit(True).alias("__hit"))
    out = jobs.join(hit, "id", "left")
    return out.withColumn("status", F.when(F.col("__hit") & F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status"))).drop("__hit")
