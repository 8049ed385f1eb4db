"""Canonical exact fingerprints, with DataFrame functions only.

A text is brought to a canonical form (Unicode compatibility composition, case folding, white space
folded) and hashed to 128 bits. Where a hash occurs more than once the canonical bytes themselves
are compared, and different texts under one hash get different fingerprints.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import stored

#: A side of a join is broadcast up to so many bytes; beyond it, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of a stretch of ids, and stretches at most; so many keys are looked at for each stretch to place its ends.
STRETCH_ROWS, STRETCHES, LOOKS = 20_000, 20_000, 20


def canonical(text: Column) -> Column:
    """NFKC and case folding (plain lower case where the text is ASCII), runs of white space as one space, trimmed."""
    normal = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(normal(folded))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def wide_hash(text: Column) -> list[Column]:
    """Two independent 64-bit xxhashes."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), text, F.char_length(text))]


def _hex(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _small(df: DataFrame, width: int) -> DataFrame:
    """The stored table, to be broadcast if its rows of ``width`` bytes are known to be few."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _collisions(members: DataFrame) -> DataFrame | None:
    """(h1, h2, canon, ordinal) of hashes that stand for more than one canonical text, if there are any; columns of members: h1, h2, canon.

    Equal texts are put together where they are read, so a large group of copies is a row a task.
    """
    mixed = stored(members.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("h1", "h2"), "mixed-hashes")
    if mixed.isEmpty():
        return None
    texts = members.join(_small(mixed, 16), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "canon").agg(F.lit(1).alias("one"))
    # different texts of one 128-bit hash: few
    return stored(texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon"))).drop("one"), "collisions")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add fingerprint (hex) and copies (how many rows have it) to the rows.

    Null texts count as empty. Equal canonical texts have equal fingerprints, others have different
    ones. Repeated rows stay; null ids are like any others; an empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = df.drop("fingerprint", "copies")
    rows = keep.withColumn("__canon", canonical(text)).withColumns(dict(zip(("__h1", "__h2"), wide_hash(F.col("__canon")), strict=True)))
    hashes = rows.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col("__canon").alias("canon"))
    groups = _small(stored(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "equal-hashes"), 24)
    odd = _collisions(hashes.join(groups.drop("n"), ["h1", "h2"], "left_semi"))
    if odd is None:  # a hash is a text
        named = rows.join(groups.toDF("__g1", "__g2", "__n"), (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")), "left")
        return named.select(*keep.columns, _hex("__h1", "__h2").alias("fingerprint"), F.coalesce("__n", F.lit(1)).cast("long").alias("copies"))
    named = rows.join(odd.toDF("__g1", "__g2", "__text", "__o"), (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")) & (F.col("__canon") == F.col("__text")), "left")
    named = named.select(*keep.columns, F.concat(_hex("__h1", "__h2"), F.coalesce(F.concat(F.lit("-"), F.col("__o")), F.lit(""))).alias("fingerprint"))
    counts = stored(named.groupBy("fingerprint").agg(F.count("*").alias("copies")), "copies")
    return named.join(_small(counts, 60), "fingerprint").select(*keep.columns, "fingerprint", "copies")


def _stretches(rows: DataFrame) -> Column:
    """A column that deals rows (id, x) to stretches of similar counts, rising with (id, x); a null id comes first.

    The ends are quantiles of keys chosen by their hash, whatever the range of ids.
    """
    n = rows.count()
    want = min(STRETCHES, max(n // STRETCH_ROWS, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n < 2 * want:
        return F.lit(0)
    every = max(1, n // (want * LOOKS))
    kind = dict(rows.dtypes)["id"]
    keys = sorted({(r.id is not None, r.id, r.x) for r in rows.where(F.pmod(F.xxhash64("id", "x"), F.lit(every)) == 0).select("id", "x").collect()}, key=lambda k: (k[0], k[1] if k[0] else 0, k[2]))
    if not keys:
        return F.lit(0)
    ends = [keys[i * len(keys) // want] for i in range(1, want)]
    ends = [k for i, k in enumerate(ends) if not i or k != ends[i - 1]]
    # two steps, so that a row is held against a few ends only
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    as_json = lambda xs: [{"id": i, "x": x} for _, i, x in xs]
    key_type = f"struct<id: {kind}, x: long>"
    firsts = F.from_json(F.lit(json.dumps(as_json([g[0] for g in groups]))), f"array<{key_type}>")
    each = F.from_json(F.lit(json.dumps([as_json(g) for g in groups])), f"array<array<{key_type}>>")
    key = F.struct("id", "x")
    group = F.size(F.filter(firsts, lambda e: e <= key))
    within = F.size(F.filter(F.get(each, group - 1), lambda e: e <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the next document's beginning.

    The next document is the one before in ascending id; after the first comes the last. Columns:
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1 if the
    fingerprints are equal, else 0: an exact digest knows no nearer or farther). Null texts count
    as empty; a single document is its own next; equal ids are ordered by their texts' hashes, null
    ids come last; an empty table gives an empty result. Ids are integers (any) or strings.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("x", F.xxhash64("text"))
    rows = rows.withColumn("part", _stretches(rows.select("id", "x")))
    # the first row of each stretch is also put at the end of the stretch above it; a row a stretch is collected
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "x")).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    edges = [(part, tops[below].id, tops[below].x) for part, below in zip(order, order[1:] + order[:1], strict=True)]
    edge = F.broadcast(spark.createDataFrame(edges, f"above int, id {dict(rows.dtypes)['id']}, x long"))
    ghosts = rows.join(edge, rows["id"].eqNullSafe(edge["id"]) & (rows["x"] == edge["x"])).select(rows["id"], "text", rows["x"], F.col("above").alias("part")).dropDuplicates(["part"])
    window = Window.partitionBy("part").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("x").desc())
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    both = both.withColumn("canon", canonical(F.col("text"))).select("id", "x", "text", "part", "ghost", *(h.alias(c) for h, c in zip(wide_hash(F.col("canon")), ("h1", "h2"), strict=True)))
    ahead = both.select("id", "x", "ghost", "text", "h1", "h2", *(F.lead(c).over(window).alias(f"next_{c}") for c in ("id", "x", "text", "h1", "h2"))).where("not ghost")
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - third), F.left("next_text", third))
    done = ahead.select("id", "x", "next_id", "next_x", F.char_length("text").cast("long").alias("n_chars"), "h1", "h2", "next_h1", "next_h2", edited.alias("edited"))
    done = done.withColumn("canon", canonical(F.col("edited")))
    done = done.select("id", "x", "next_id", "next_x", "n_chars", "h1", "h2", "next_h1", "next_h2", F.sha2("edited", 256).alias("edited_sha256"), *(h.alias(c) for h, c in zip(wide_hash(F.col("canon")), ("e1", "e2"), strict=True)))
    done = stored(done, "fingerprints")

    # bytes are compared where a hash occurs more than once
    row, after = F.struct("id", "x").alias("row"), F.struct(F.col("next_id").alias("id"), F.col("next_x").alias("x")).alias("after")
    hashes = done.select(row, after, F.lit(0).alias("kind"), "h1", "h2").unionByName(done.select(row, after, F.lit(1).alias("kind"), F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    often = stored(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "equal-hashes")
    members = stored(hashes.join(_small(often, 16), ["h1", "h2"], "left_semi").distinct(), "members")
    texts = rows.select(F.struct("id", "x").alias("row"), "text")
    own = texts.join(_small(members, 64), "row")
    plain = own.where("kind = 0").select("h1", "h2", canonical(F.col("text")).alias("canon"))
    wanted = stored(members.where("kind = 1").select("after").distinct(), "next-rows")
    following = rows.select(F.struct("id", "x").alias("after"), F.col("text").alias("next_text")).join(_small(wanted, 24), "after", "left_semi").dropDuplicates(["after"])
    altered = own.where("kind = 1").join(following, "after").select("h1", "h2", edited.alias("edited")).select("h1", "h2", canonical(F.col("edited")).alias("canon"))
    odd = _collisions(plain.unionByName(altered))
    print_, eprint, nprint = _hex("h1", "h2"), _hex("e1", "e2"), _hex("next_h1", "next_h2")
    if odd is not None:
        done, (print_, eprint, nprint) = _told_apart(done, rows, odd, edited)
    done = done.select("*", print_.alias("p"), eprint.alias("e"), nprint.alias("q"))
    return done.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("p").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), (F.col("p") == F.col("e")).cast("double").alias("near_edited"), (F.col("p") == F.col("q")).cast("double").alias("near_next"))


def _told_apart(done: DataFrame, rows: DataFrame, odd: DataFrame, edited: Column) -> tuple[DataFrame, list[Column]]:
    """Rows with the texts' numbers under their hashes, where a hash stands for several; and the three fingerprints."""
    texts = rows.dropDuplicates(["id", "x"]).select(F.col("id").alias("t_id"), F.col("x").alias("t_x"), "text")
    nexts = texts.toDF("n_id", "n_x", "next_text")
    full = done.join(texts, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("x") == F.col("t_x")))
    full = full.join(nexts, F.col("next_id").eqNullSafe(F.col("n_id")) & (F.col("next_x") == F.col("n_x"))).drop("t_id", "t_x", "n_id", "n_x")
    full = full.withColumns({"c0": canonical(F.col("text")), "c1": canonical(edited), "c2": canonical(F.col("next_text"))}).drop("text", "next_text")
    out = []
    for a, b, c in (("h1", "h2", "c0"), ("e1", "e2", "c1"), ("next_h1", "next_h2", "c2")):
        number = odd.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), F.col("canon").alias(f"{c}t"), F.col("ordinal").alias(f"{c}o"))
        full = full.join(number, (full[a] == number[f"{c}1"]) & (full[b] == number[f"{c}2"]) & (full[c] == number[f"{c}t"]), "left")
        out.append(F.concat(_hex(a, b), F.coalesce(F.concat(F.lit("-"), F.col(f"{c}o")), F.lit(""))))
    return full, out
