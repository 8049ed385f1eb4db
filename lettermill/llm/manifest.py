"""A Merkle tree over documents, keyed by rank: leaves, roots, and a proof for each document.

Ranks come without a global sort. The digits of an id are counted from the last to the first, each
level's histogram from that of the finer one; a document's rank is the sum of what stands before it
among its siblings on each level, and a window never holds more than the children of one node. Digits of
the rank to the base of the fan-out key the trie: nodes that share all but their last digits make
a run, three levels at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, stored

#: Children of a node, as bits of the rank; levels that one grouping reduces.
BITS, LEVELS = 3, 3
SPAN = BITS * LEVELS
#: Equal rows that are told apart at once.
COPIES = 1 << 16
#: Where an id's 17 digits (a null flag, 16 hexadecimal ones), a leaf's and a language's are cut into levels.
ID_CUTS, LEAF_CUTS, GROUP_CUTS = (1, 5, 9, 13, 15), (4,), (5,)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else changed: the tampering of the query."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def starts(keys: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(g, key, start): rows of the group g whose key is less, for distinct (g, key) that n rows have.

    Counts of key beginnings of the lengths ``cuts``, each level from the finer one; sums run among siblings only.
    """
    levels = [keys.select("g", "key", "n")]
    for cut in reversed(cuts):
        levels.append(levels[-1].groupBy("g", F.substring("key", 1, cut).alias("key")).agg(F.sum("n").alias("n")))
    found = None
    for cut, level in zip((0, *cuts), reversed(levels), strict=True):
        siblings = Window.partitionBy("g", "above").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("above", F.substring("key", 1, cut) if cut else F.lit(""))
        level = level.withColumn("start", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        if found is not None:
            level = level.join(found.select("g", F.col("key").alias("above"), F.col("start").alias("base")), ["g", "above"]).withColumn("start", F.col("start") + F.col("base"))
        found = level.select("g", "key", "start")
    return found


def _depth(n: Column) -> Column:
    """Levels of a tree over n leaves: octal digits of the last rank, none for one leaf."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, 1 << BITS))).otherwise(0)


def _up(a: Column) -> Column:
    """Digests of the runs of an array of nodes."""
    run = 1 << BITS
    last = F.ceil(F.size(a) / run).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(a, i * run + 1, F.lit(run)), "").cast("binary"), 256))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes under a common beginning, stage by stage, and (g, hash) of what remains.

    ``nodes`` (g, rank, hash, levels, own): ranks of a group are 0 to its size less one.
    """
    stages = []
    while True:
        met = nodes.groupBy("g", F.shiftright("rank", SPAN).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rank", "hash", "own"))).alias("members"), F.max("levels").alias("levels"))
        met = met.withColumn("a0", F.transform("members", lambda m: m["hash"]))
        for k in range(LEVELS):
            met = met.withColumn(f"a{k + 1}", F.when(F.col("levels") > k, _up(F.col(f"a{k}"))).otherwise(F.col(f"a{k}")))
        met = stored(met.withColumn("hash", F.col(f"a{LEVELS}")[0]).drop(f"a{LEVELS}"), "merkle")
        stages.append(met)
        if (met.agg(F.max("levels")).first()[0] or 0) <= LEVELS:
            return stages, met.select("g", "hash")
        nodes = met.select("g", F.col("chunk").alias("rank"), "hash", (F.col("levels") - LEVELS).alias("levels"), F.lit(None).cast("string").alias("own"))


def _descend(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, rank, hash, own, path, top) of the leaves: ``path`` has the siblings to the left and right on each level.

    ``tops`` (g, path, top): the way on from what remains of each group, and what all of its leaves carry.
    """
    run = 1 << BITS

    def step(a: str, k: Column) -> Column:
        at = k.bitwiseAND(run - 1)
        a = F.col(a)
        return F.struct(F.array_join(F.slice(a, k - at + 1, at), "").alias("left"), F.array_join(F.slice(a, k + 2, F.lit(run - 1) - at), "").alias("right"))

    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for met in reversed(stages):
        above = above.select("g", F.col("rank").alias("chunk"), "path", "top")
        each = met.drop("hash").join(above, ["g", "chunk"]).withColumn("m", F.explode("members")).drop("members")
        local = F.col("m.rank").bitwiseAND((1 << SPAN) - 1).cast("int")
        steps = F.array(*(step(f"a{k}", F.shiftright(local, BITS * k)) for k in range(LEVELS)))
        path = F.concat(F.slice(steps, F.lit(1), F.least(F.col("levels"), F.lit(LEVELS))), F.col("path"))
        above = each.select("g", F.col("m.rank").alias("rank"), F.col("m.hash").alias("hash"), F.col("m.own").alias("own"), path.alias("path"), "top")
    return above


def document_leaves(docs: DataFrame, tampered: Column, columns=("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(g, key, doc_id, leaf, tampered, n): distinct leaves of each language and how many rows have them.

    ``tampered`` is the text that a check finds now; the leaf of rows whose text it leaves alone is null there.
    """
    rows = docs.select(*columns, tampered.alias("now"))
    one = {c: _field(F.col(c)) for c in columns}
    leaf, now = _digest(*one.values()), _digest(*(one | {"text": _field(F.col("now"))}).values())
    key = F.when(F.col("doc_id").isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")))
    g = F.coalesce(F.concat(F.lit("1"), F.hex(F.encode("lang", "UTF-8"))), F.lit("0"))
    return rows.select(g.alias("g"), key.alias("key"), "doc_id", leaf.alias("leaf"), F.when(~F.col("text").eqNullSafe(F.col("now")), now).alias("tampered")).groupBy("g", "key", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n"))


def ranked(leaves: DataFrame) -> DataFrame:
    """A row for each document row, with its rank in its language: by id (null first), then by leaf; equal rows follow each other."""
    ids = stored(leaves.groupBy("g", "key").agg(F.sum("n").alias("n"), F.count("*").alias("variants")), "ids")
    leaves = leaves.join(starts(ids, ID_CUTS), ["g", "key"])
    # ids that come with several leaves are ranked by digits of the leaf
    several = leaves.join(ids.where("variants > 1").select("g", "key"), ["g", "key"]).select(F.concat_ws(" ", "g", "key").alias("g"), F.col("leaf").alias("key"), "n")
    inside = starts(several, LEAF_CUTS).select(F.split("g", " ")[0].alias("g"), F.split("g", " ")[1].alias("key"), F.col("key").alias("leaf"), F.col("start").alias("more"))
    leaves = leaves.join(inside, ["g", "key", "leaf"], "left")
    first = F.col("start") + F.coalesce("more", F.lit(0))
    leaves = leaves.select("g", "doc_id", "leaf", "tampered", first.alias("first"), (first + F.col("n") - 1).alias("last"))
    # equal rows, however many, are told apart a stretch at a time
    leaves = leaves.select("*", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(COPIES).cast("long"))).alias("from"))
    return leaves.select("g", "doc_id", "leaf", "tampered", F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + COPIES - 1))).alias("rank"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A row a document: leaf, subroot of its language, root, digest of its proof, and the root that its present text folds to.

    ``tampered`` is a column of the text as it is found when it is checked (default: unchanged);
    ``verified`` tells whether leaf and siblings still fold to the root.
    Nulls count as ``-``; rows without an id come first in their language, rows without a language are a group of their
    own, which comes first. Rows that repeat an id follow by their leaves; equal rows are leaves of their own.
    An empty text is a value of 0 bytes. No rows: no result. Other columns don't matter.
    """
    prepare(docs.sparkSession)
    leaves = stored(document_leaves(docs, F.col("text") if tampered is None else tampered), "leaves")
    groups = stored(leaves.groupBy("g").agg(F.sum("n").alias("rows")), "groups")
    nodes = ranked(leaves).join(groups, "g").select("g", "rank", F.col("leaf").alias("hash"), _depth(F.col("rows")).alias("levels"), F.struct("doc_id", "tampered").alias("own"))
    stages, subroots = _climb(nodes)
    order = starts(groups.select(F.lit("").alias("g"), F.col("g").alias("key"), F.lit(1).alias("n")), GROUP_CUTS)
    langs = order.join(subroots.withColumnRenamed("g", "key"), "key").select("g", F.col("start").alias("rank"), "hash", _depth(F.lit(groups.count())).alias("levels"), F.col("key").alias("own"))
    upper, root = _climb(langs)
    none = F.array().cast("array<struct<left:string,right:string>>")
    lang_paths = _descend(upper, root.select("g", none.alias("path"), F.col("hash").alias("top")))
    tops = lang_paths.select(F.col("own").alias("g"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = _descend(stages, tops)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate("path", F.coalesce("own.tampered", "hash"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))
    return found.select(
        F.col("own.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"),
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
