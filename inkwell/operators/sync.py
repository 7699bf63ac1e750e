"""Incremental runs: what to convert, to push, to delete, and the next state of the registry.

State is a table (a snapshot per run); every operator takes the previous state and the current scan and returns
a DataFrame. Joins are on hashed keys of both sides, so that they shuffle once, and co-locate on bucketed tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renamed(df: DataFrame, key: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"old_{c}") for c in df.columns)).withColumn("_key", F.col(f"old_{key}"))


def needs_convert(current: DataFrame, registry: DataFrame, key: str, version: str) -> DataFrame:
    """current with reason: new, changed, version, failed or null (skip); registry: key, hash, status, version."""
    joined = current.join(_renamed(registry, key), F.col(key) == F.col("_key"), "left")
    reason = (
        F.when(F.col("_key").isNull(), "new")
        .when(~F.col("old_hash").eqNullSafe(F.col("hash")), "changed")
        .when(~F.col("old_version").eqNullSafe(F.lit(version)), "version")
        .when(~F.col("old_status").eqNullSafe(F.lit("converted")), "failed")
    )
    return joined.select(*current.columns, reason.alias("reason"))


def skip_complete(current: DataFrame, registry: DataFrame, outputs: DataFrame, on_disk: DataFrame, key: str, version: str) -> DataFrame:
    """Keys to skip: nothing changed, and each recorded output is on disk. outputs: key, path; on_disk: path."""
    same = needs_convert(current, registry, key, version).filter("reason IS NULL").select(key)
    missing = outputs.join(on_disk.select(F.col("path").alias("_path")), F.col("path") == F.col("_path"), "left_anti").select(F.col(key).alias("_key"))
    return same.join(missing, F.col(key) == F.col("_key"), "left_anti")


def page_diff(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """key and change (added, modified, gone, same) of a full outer join on hash."""
    before = old.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("hash").alias("_hash"))
    on = None
    for k in key:
        on = F.col(k).eqNullSafe(F.col(f"_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = new.join(before, on, "full_outer")
    change = F.when(F.col("_hash").isNull(), "added").when(F.col("hash").isNull(), "gone").when(F.col("hash") != F.col("_hash"), "modified").otherwise("same")
    return joined.select(*(F.coalesce(k, f"_{k}").alias(k) for k in key), change.alias("change"))


def changed_pages(diff: DataFrame, group: str, known: DataFrame) -> DataFrame:
    """group and what to push: all (no earlier state), some (n_push pages), none."""
    some = diff.groupBy(group).agg(F.sum(F.col("change").isin("added", "modified").cast("long")).alias("n_push"), F.sum((F.col("change") == "gone").cast("long")).alias("n_gone"))
    before = known.select(F.col(group).alias("_g")).distinct()
    kind = F.when(F.col("_g").isNull(), "all").when(F.col("n_push") > 0, "some").otherwise("none")
    return some.join(before, F.col(group) == F.col("_g"), "left").select(group, kind.alias("push"), "n_push", "n_gone")


def vanished(registry: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """Registry rows that the scan lacks; none where the scan is empty, which is taken for a failure to read."""
    seen = scan.select(F.col(key).alias("_key"))
    some = scan.select(F.lit(True).alias("_some")).limit(1)
    return registry.join(seen, F.col(key) == F.col("_key"), "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")


def upsert(registry: DataFrame, converted: DataFrame, key: str) -> DataFrame:
    """The next snapshot: converted rows replace old ones, keep their outputs, and are not pushed yet."""
    joined = converted.withColumn("_new", F.lit(True)).join(_renamed(registry, key), F.col(key) == F.col("_key"), "full_outer")

    def pick(c: str) -> Column:
        if c == "pushed":
            return F.when(F.col("_new"), F.lit(False)).otherwise(F.col("old_pushed"))
        if c == "outputs":
            return F.coalesce("old_outputs", F.array().cast("array<string>"))
        return F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"old_{c}"))

    return joined.select(*(pick(c).alias(c) for c in registry.columns))


def longest_prefix(paths: DataFrame, path: str, mapping: dict[str, str], default: str) -> DataFrame:
    """paths with target: that of the longest mapped prefix (whole path segments), or the default.

    The mapping is configuration, so it becomes one expression without a join; empty values are left out.
    """
    out = F.lit(default)
    for prefix, target in sorted(mapping.items(), key=lambda kv: (len(kv[0]), kv[0])):
        if target:
            hit = (F.col(path) == prefix) | F.col(path).startswith(prefix.rstrip("/") + "/")
            out = F.when(hit, F.lit(target)).otherwise(out)
    return paths.withColumn("target", out)


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (ref) with id: that of the base with this id or, failing that, this name. known: id, name (string)."""
    by_id = wanted.join(known.select(F.col("id").alias("_id")), F.col("ref") == F.col("_id"), "left")
    names = known.groupBy("name").agg(F.min("id").alias("_by_name"))
    return by_id.join(names, F.col("ref") == F.col("name"), "left").select("ref", F.coalesce("_id", "_by_name").alias("id"))


def page_hashes_of(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """group, key and hash of rendered pages."""
    return df.select(group, key, F.sha2(text, 256).alias("hash"))


def outbox(diff: DataFrame, group: str, key: str, remote: DataFrame) -> DataFrame:
    """What to send after a page diff, in order: new and modified pages are put first, then the documents that they replace and those of gone pages are deleted.

    diff: group, key, change; remote: group, key, doc (the remote id of what was pushed before). Result: group, key, action, doc, step.
    """
    before = remote.select(F.col(group).alias("_g"), F.col(key).alias("_k"), "doc")
    joined = diff.filter("change <> 'same'").join(before, (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_k")), "left")
    put = F.when(F.col("change") != "gone", F.struct(F.lit("put").alias("action"), F.lit(None).cast("string").alias("doc"), F.lit(1).alias("step")))
    delete = F.when(F.col("doc").isNotNull(), F.struct(F.lit("delete").alias("action"), F.col("doc").cast("string").alias("doc"), F.lit(2).alias("step")))
    return joined.select(group, key, F.explode(F.array_compact(F.array(put, delete))).alias("x")).select(group, key, "x.action", "x.doc", "x.step")


def vanished_documents(gone: DataFrame, key: str) -> DataFrame:
    """key and the remote ids to delete of registry rows whose source went: those of all outputs and those of the record, each once."""
    recorded = F.transform(F.split(F.coalesce("doc_id", F.lit("")), ","), lambda x: F.trim(x))
    ids = F.filter(F.array_union(recorded, F.coalesce(F.map_values("output_docs"), F.array().cast("array<string>"))), lambda x: x != "")
    return gone.select(key, F.explode(F.array_distinct(ids)).alias("doc"))


def render_plan(docs: DataFrame, manifest: DataFrame, on_disk: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """docs (key, hash) with plan: added (also all, where the fingerprint of the manifest's run is another), modified (another hash, or no output), same.

    manifest: key, hash, fingerprint; on_disk: key.
    """
    before = manifest.select(F.col(key).alias("_k"), F.col("hash").alias("_hash"), F.col("fingerprint").alias("_f"))
    there = on_disk.select(F.col(key).alias("_there")).distinct()
    joined = docs.join(before, F.col(key) == F.col("_k"), "left").join(there, F.col(key) == F.col("_there"), "left")
    new = F.col("_k").isNull() | (F.col("_f") != fingerprint)
    plan = F.when(new, "added").when((F.col("_hash") != F.col("hash")) | F.col("_there").isNull(), "modified").otherwise("same")
    return joined.select(*docs.columns, plan.alias("plan"))


def stale_outputs(on_disk: DataFrame, docs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Outputs on disk (key) that no document has, whatever earlier runs recorded; `keep` names the run's own files."""
    own = on_disk.filter(F.col(key).endswith(".md") & ~F.col(key).isin(*keep)) if keep else on_disk.filter(F.col(key).endswith(".md"))
    return own.select(key).join(docs.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def chapters(listed: DataFrame, files: DataFrame, rest: str) -> DataFrame:
    """chapter, at, file: each file in the first chapter that lists it, in order; files (file) that none lists in the chapter `rest`."""
    first = listed.groupBy("file").agg(F.min(F.struct("chapter", "at")).alias("x")).select("x.chapter", "x.at", "file")
    left = files.join(first.select(F.col("file").alias("_f")), F.col("file") == F.col("_f"), "left_anti")
    return first.unionByName(left.select(F.lit(rest).cast(first.schema["chapter"].dataType).alias("chapter"), F.lit(None).cast(first.schema["at"].dataType).alias("at"), "file"))


def registry_json(registry: DataFrame) -> DataFrame:
    """The registry's nested columns as JSON text."""
    return registry.withColumns({"outputs": F.to_json("outputs"), "output_docs": F.to_json("output_docs"), "page_hashes": F.to_json("page_hashes")})


def registry_of_json(stored: DataFrame) -> DataFrame:
    """Back from JSON; what can't be read is empty."""
    text = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return stored.withColumns(
        {
            "outputs": F.coalesce(F.from_json("outputs", "array<string>"), F.array().cast("array<string>")),
            "output_docs": F.coalesce(F.from_json("output_docs", "map<string,string>"), text),
            "page_hashes": F.coalesce(F.from_json("page_hashes", "map<string,string>"), text),
        }
    )


def new_uploads(sent: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """sent (name) with file, its base name, and verdict: uploaded, or skipped where a file of that name is there or came before. existing: file."""
    named = sent.withColumn("file", F.substring_index(F.translate("name", "\\", "/"), "/", -1))
    there = existing.select(F.col("file").alias("_file")).distinct()
    k = F.row_number().over(Window.partitionBy("file").orderBy("name"))
    joined = named.withColumn("_k", k).join(there, F.col("file") == F.col("_file"), "left")
    taken = F.lit(False) if overwrite else F.col("_file").isNotNull() | (F.col("_k") > 1)
    return joined.select(*sent.columns, "file", F.when(taken, "skipped").otherwise("uploaded").alias("verdict"))
