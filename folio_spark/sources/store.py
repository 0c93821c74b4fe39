"""Writing: keyed upserts, refresh or reload, guarded deletes, release builds, exports, snapshot repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, key: str = "law_id", keep: tuple[str, ...] = ("work_id",)) -> DataFrame:
    """Target with batch's rows in place of theirs; columns in `keep` stay where the new value is null."""
    old = target.select(key, *[F.col(c).alias("__" + c) for c in keep]).dropDuplicates([key])
    new = batch.join(old, key, "left")
    for c in keep:
        new = new.withColumn(c, F.coalesce(c, "__" + c)).drop("__" + c)
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(new.select(*target.columns))


def replace_children(target: DataFrame, batch: DataFrame, parents: DataFrame, key: str = "law_id") -> DataFrame:
    """All children of the parents that came anew are replaced by the batch's."""
    return target.join(parents.select(key).distinct(), key, "left_anti").unionByName(batch.select(*target.columns))


def replace_declared(target: DataFrame, batch: DataFrame, parents: DataFrame) -> DataFrame:
    """Relations after documents came anew: those that a document itself declared are replaced, reviewed ones stay.

    target: from_law_id, relation_type, to_law_id, origin ('document' or what reviewed it), any others; batch: the same
    columns, as the documents of parents (law_id) now declare them. A relation that is reviewed is not declared again.
    """
    again = parents.select(F.col("law_id").alias("from_law_id")).distinct()
    key = ["from_law_id", "relation_type", "to_law_id"]
    stays = target.where(~F.col("origin").eqNullSafe("document")).unionByName(target.where("origin <=> 'document'").join(again, "from_law_id", "left_anti").select(*target.columns))
    fresh = batch.withColumn("origin", F.lit("document")).join(again, "from_law_id", "left_semi").select(*target.columns).dropDuplicates(key)
    return stays.unionByName(fresh.join(stays.select(*key), key, "left_anti").select(*target.columns))


def plan_refresh(target: DataFrame, batch: DataFrame) -> DataFrame:
    """law_id, action (insert, keep, refresh, reload). Both: law_id, content_hash, metadata_hash, text_hash.

    An unchanged content hash only refreshes metadata, unless the text as parsed now differs from what is stored.
    """
    t = target.select("law_id", *[F.col(c).alias("t_" + c) for c in ("content_hash", "metadata_hash", "text_hash")], F.lit(True).alias("__t"))
    b = batch.select("law_id", "content_hash", "metadata_hash", "text_hash", F.lit(True).alias("__b"))
    j = b.join(t, "law_id", "full_outer")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col("t_" + c))
    action = F.when(F.col("__b").isNull(), "keep").when(F.col("__t").isNull(), "insert").when(differs("content_hash") | differs("text_hash"), "reload").when(differs("metadata_hash"), "refresh").otherwise("keep")
    return j.select("law_id", action.alias("action"))


def plan_delete(ids: DataFrame, references: dict[str, DataFrame], owned: dict[str, DataFrame], key: str = "law_id") -> DataFrame:
    """S13's dry run: id, blocked_by (tables that still refer to it), and how many owned rows would go.

    references, owned: tables with the column `key`.
    """
    out = ids.select(key).distinct()
    for name, t in {**references, **owned}.items():
        counts = t.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(counts, key, "left").fillna(0, [f"n_{name}"])
    blocked = F.array_compact(F.array(*[F.when(F.col(f"n_{n}") > 0, n) for n in references]))
    total = F.lit(0).cast("long")
    for n in owned:
        total = total + F.col(f"n_{n}")
    return out.select(key, F.array_join(blocked, ",").alias("blocked_by"), total.alias("owned_rows"))


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, references: dict[str, DataFrame], key: str = "law_id") -> dict[str, DataFrame]:
    """The tables without the ids that nothing refers to; blocked ids stay everywhere."""
    plan = plan_delete(ids, references, {}, key)
    gone = plan.where("blocked_by = ''").select(key)
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def build_release(tables: dict[str, DataFrame], whitelist: dict[str, list[str]], private: dict[str, DataFrame], problems: DataFrame, out: str) -> DataFrame:
    """Writes the whitelisted columns of each table and returns the manifest: table, rows, digest.

    Refused while private tables have rows or the reports of checks have.
    """
    for name, t in private.items():
        if t.limit(1).count():
            raise ValueError(f"private table {name} is not empty")
    if problems.limit(1).count():
        raise ValueError("there are open problems")
    manifest = None
    for name, columns in whitelist.items():
        kept = tables[name].select(*columns)
        kept.write.mode("overwrite").parquet(f"{out}/{name}")
        row = release_digest(kept.sparkSession.read.parquet(f"{out}/{name}"), name)
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def release_digest(df: DataFrame, name: str) -> DataFrame:
    """table, rows, digest: a digest that does not depend on the order of rows, with no row leaving its task."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *parts).select(F.lit(name).alias("table"), "rows", F.sha2(F.concat_ws("|", "rows", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def export_nested(parents: DataFrame, children: DataFrame, key: str, name: str, with_text: bool = True, sensitivity: str = "internal") -> DataFrame:
    """Parents with their children nested in order of position, without texts if asked, and a sensitivity label."""
    cols = [c for c in children.columns if c != key and (with_text or c != "text")]
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", *[c for c in cols if c != "position"]))).alias(name))
    return parents.join(nested, key, "left").withColumn("sensitivity", F.lit(sensitivity))


def repair_snapshots(revisions: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions with the payload of equal (work_id, content_hash, effective_at), and those that find none."""
    key = ["work_id", "content_hash", "effective_at"]
    one = payloads.dropDuplicates(key).select(*key, F.col("payload").alias("__p"))
    wrong = revisions.where(~F.col("snapshot_id").eqNullSafe(F.col("law_id")))
    fixed = wrong.join(one, key).withColumn("snapshot_json", F.col("__p")).withColumn("snapshot_id", F.col("law_id")).drop("__p")
    lost = wrong.join(one, key, "left_anti")
    return revisions.where(F.col("snapshot_id").eqNullSafe(F.col("law_id"))).unionByName(fixed.select(*revisions.columns)), lost
