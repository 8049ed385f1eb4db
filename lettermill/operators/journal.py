"""The append-only journal of actions: runs, orphans, undo; planning of actions; folders; the message cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.config import Config


def runs(journal: DataFrame) -> DataFrame:
    """(runId, ts, intents, applied, n_intents, undone, first_seq) of each run; journal has ``seq``, the order of lines."""
    intent, undone = F.col("phase") == "intent", (F.col("phase") == "note") & (F.col("type") == "undone")
    return journal.groupBy("runId").agg(
        F.min_by("ts", "seq").alias("ts"), F.min("seq").alias("first_seq"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(intent, F.struct("seq", "actions")))), lambda x: F.coalesce(x["actions"], F.array()))).alias("intents"),
        F.count_if((F.col("phase") == "result") & F.col("applied")).alias("applied"), F.bool_or(undone).alias("undone"),
    ).withColumn("n_intents", F.size("intents"))


def orphaned(run_rows: DataFrame) -> DataFrame:
    """Runs whose intents weren't all applied; a run of which every action failed is one too."""
    return run_rows.where(~F.col("undone") & (F.col("n_intents") > 0) & (F.col("applied") < F.col("n_intents")))


def last_run(run_rows: DataFrame) -> DataFrame:
    """The latest run with intents that isn't undone, by the order in which runs began."""
    return run_rows.where(~F.col("undone") & (F.col("n_intents") > 0)).orderBy(F.col("first_seq").desc()).limit(1)


def inverted(a: Column) -> Column:
    """The action that undoes one; null if none does."""
    swap = F.struct(F.lit("move").alias("action"), a["uid"].alias("uid"), a["messageId"].alias("messageId"), a["to"].alias("from"), a["from"].alias("to"), a["flags"].alias("flags"), a["label"].alias("label"))
    other = lambda name: F.struct(F.lit(name).alias("action"), *(a[f].alias(f) for f in ("uid", "messageId", "from", "to", "flags", "label")))
    return F.when(a["action"] == "move", swap).when(a["action"] == "flag", other("unflag")).when(a["action"] == "unflag", other("flag"))


def undo_actions(run_rows: DataFrame) -> DataFrame:
    """The inverse of each intent of the last run, last first (``position`` is the intent's)."""
    each = last_run(run_rows).select("runId", F.posexplode("intents").alias("position", "a"))
    return each.withColumn("undo", inverted(F.col("a"))).where("undo is not null").select("runId", "position", "undo.*").orderBy(F.desc("position"))


def plan_actions(decisions: DataFrame, config: Config = Config()) -> DataFrame:
    """What to do with each message: flag what is for now, move the rest to its label's folder; labels without a folder are left."""
    folder = F.create_map(*(F.lit(x) for pair in config.folders.items() for x in pair))[F.col("label")]
    return decisions.where((F.col("label") == "now") | F.nullif(folder, F.lit("")).isNotNull()).select(
        F.when(F.col("label") == "now", "flag").otherwise("move").alias("action"), "uid", "messageId", F.col("folder").alias("from"),
        F.when(F.col("label") == "now", "").otherwise(folder).alias("to"), F.when(F.col("label") == "now", F.array(F.lit("\\Flagged"))).otherwise(F.array().cast("array<string>")).alias("flags"), "label",
    )


def apply_actions(mailbox: DataFrame, actions: DataFrame) -> DataFrame:
    """The mailbox table (uid, folder, flags, ...) after the actions; of several for a message all take effect, moves last."""
    per = actions.groupBy("uid").agg(F.max(F.when(F.col("action") == "move", F.col("to"))).alias("__to"), F.flatten(F.collect_list(F.when(F.col("action") == "flag", F.col("flags")))).alias("__add"), F.flatten(F.collect_list(F.when(F.col("action") == "unflag", F.col("flags")))).alias("__drop"))
    none = F.array().cast("array<string>")
    flags = F.array_union(F.array_except("flags", F.coalesce("__drop", none)), F.coalesce("__add", none))
    return mailbox.join(per, "uid", "left").withColumns({"folder": F.coalesce("__to", "folder"), "flags": flags}).drop("__to", "__add", "__drop")


def missing_folders(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    return wanted.select("name").distinct().join(existing.select("name"), "name", "left_anti")


def special_folders(listing: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(kind, name): for each kind (flag, name pattern) the first folder with the flag, else the first whose name matches; listing has ``position``."""
    found = [listing.select(F.lit(kind).alias("kind"), "name", F.struct(F.when(F.array_contains("flags", flag), 0).when(F.col("name").rlike(pattern), 1).alias("how"), "position").alias("at")).where("at.how is not null") for kind, (flag, pattern) in kinds.items()]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("kind").agg(F.min_by("name", "at").alias("name"))


def epoch_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(folder, epoch, previous, changed): a folder's epoch changed if one was stored and differs."""
    joined = current.join(stored.withColumnRenamed("epoch", "previous"), "folder", "left")
    return joined.withColumn("changed", F.coalesce(F.col("previous") != F.col("epoch"), F.lit(False)))


def dedupe_last(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each message the last line's value, at the place of its first (``position``); the key is the id, else the uid."""
    key = F.coalesce(F.nullif("messageId", F.lit("")), F.concat(F.lit("uid:"), F.col("uid").cast("string")))
    values = F.struct(*(F.col(c) for c in lines.columns))
    return lines.groupBy(key.alias("__key")).agg(F.max_by(values, seq).alias("v"), F.min(seq).alias("position")).select("v.*", "position")


def newest(messages: DataFrame, n: int, by: str = "date", tie: str = "position") -> DataFrame:
    """The newest n messages, ascending in time."""
    return messages.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n).orderBy(by, tie)


def uid_ranges(ids: DataFrame, uid: str = "uid", block: int = 1_000_000) -> DataFrame:
    """(first, last) of each run of consecutive ids.

    Runs are found in blocks of ids first; runs that meet at a block's edge are joined after, when few are left.
    """
    once = ids.select(F.col(uid).cast("long").alias("uid")).where("uid is not null").distinct().withColumn("block", F.floor(F.col("uid") / block))
    run = once.withColumn("island", F.col("uid") - F.row_number().over(Window.partitionBy("block").orderBy("uid")))
    part = run.groupBy("block", "island").agg(F.min("uid").alias("a"), F.max("uid").alias("b"))
    edge = (F.col("a") % block == 0) | ((F.col("b") + 1) % block == 0)
    inner, outer = part.where(~edge).select("a", "b"), part.where(edge).select("a", "b")
    order = Window.orderBy("a")
    outer = outer.withColumn("new", F.coalesce(F.lag("b").over(order) + 1 != F.col("a"), F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(order)).groupBy("g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")
    return inner.unionByName(outer).select(F.col("a").alias("first"), F.col("b").alias("last"))


def uid_set(ranges: DataFrame) -> DataFrame:
    """The ranges as one text, as mail servers take it: 1:3,7."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit(":"), F.col("last").cast("string")))
    return ranges.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", one.alias("t")))), lambda x: x["t"]), ",").alias("uid_set"))
