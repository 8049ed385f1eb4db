"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: its token count, then its leading tokens, with variable
fields (tokens that hold a digit) masked. In a leaf, lines that agree with a template's first line
on enough places belong to that template, and their other places are its fields. Templates that
recur across documents are dropped from all but the first document that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import stored

#: Leading tokens that choose the leaf.
LEADING = 2
#: A side of a join is broadcast up to so many bytes; beyond it, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Lines of fewer tokens stay by default; 1 counts every line that isn't empty.
MIN_TOKENS = 4
#: Lines recur from so many documents on.
MIN_DOCS = 2
#: Share of a line's places, and least number of them, that must agree with its template's first line.
FIXED, FIXED_PLACES = 0.6, 3
#: So many lines of each leaf are judged together, and how often, before what is left meets by its rarest tokens.
TOGETHER, ROUNDS = 64, 2


def _squeezed(line: Column) -> Column:
    """One space between tokens, none around them."""
    odd = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\v")) | F.contains(line, F.lit("\f")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)


def _masked(line: Column) -> Column:
    """Tokens that hold a digit become one variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])(?=[^ 0-9]*[0-9])[^ ]+", "<*>")).otherwise(line)


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells a document from others: its id and the hash of its text."""
    return [F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")]


def masked_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hash, pos, words): each line with its variable fields masked."""
    rows = df.select(*_document(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    return rows.select("doc", "hash", "pos", _squeezed(F.col("raw")).alias("raw")).select("doc", "hash", "pos", _masked(F.col("raw")).alias("words"))


def line_places(df: DataFrame, id_col: str, text_col: str, min_tokens: int = 1) -> DataFrame:
    """(doc, hash, pos, leaf, line): the leaf and masked text, as hashes, of each line that counts."""
    tokens = F.when(F.col("words") == "", 0).otherwise(F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    rows = masked_lines(df, id_col, text_col).withColumn("tokens", tokens).where(F.col("tokens") >= max(min_tokens, 1))
    return rows.select("doc", "hash", "pos", F.xxhash64("tokens", F.substring_index("words", " ", LEADING)).alias("leaf"), F.xxhash64("words").alias("line"))


def _order(pos: Column | None = None) -> Column:
    """Documents by id, those without an id last, then by text."""
    return F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("hash").alias("hash"), *([pos.alias("pos")] if pos is not None else []))


def _needed(tokens: Column) -> Column:
    """On how many places a line must agree with another."""
    return F.greatest(F.ceil(F.size(tokens) * FIXED), F.lit(FIXED_PLACES)).cast("int")


def _agree(x: Column, y: Column) -> Column:
    """Whether two lines of one leaf have enough tokens in common."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) >= _needed(x)


def _leads(rows: DataFrame) -> DataFrame:
    """(leaf, leads): the lines that begin templates among the first ``TOGETHER`` of each leaf by hash, in that order."""
    place = F.row_number().over(Window.partitionBy("leaf").orderBy("line"))
    first = rows.withColumn("place", place).where(F.col("place") <= TOGETHER)
    one = first.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("line", "tokens"))).alias("g"))
    none = F.filter("g", lambda x: F.lit(False))
    leads = F.aggregate("g", none, lambda acc, x: F.when(F.exists(acc, lambda y: _agree(y["tokens"], x["tokens"])), acc).otherwise(F.array_append(acc, x)))
    return one.select("leaf", leads.alias("leads"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(u, v), u before v: the lines of a leaf that agree.

    Leading tokens are a leaf's own, so that lines which agree share k - need + 1 others at least: among the rarest
    so many of each (place, token) there must be a common one.
    """
    free = F.slice(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t.alias("token"))), F.lit(LEADING + 1), F.size("tokens") - LEADING)
    each = rows.select("leaf", "line", (_needed(F.col("tokens")) - LEADING).alias("need"), F.explode(free).alias("x")).select("leaf", "line", "need", "x.at", "x.token")
    often = stored(each.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")), "token-counts")
    back = each.join(_small(often, 40), ["leaf", "at", "token"]).groupBy("leaf", "line", "need").agg(F.sort_array(F.collect_list(F.struct("n", "at", "token"))).alias("t"))
    rare = back.select("leaf", "line", F.explode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("x")).where("x.n > 1")
    keyed = stored(rare.select(F.xxhash64("leaf", "x.at", "x.token").alias("key"), "line"), "rare-tokens")
    met = keyed.select("key", F.col("line").alias("u")).join(keyed.select("key", F.col("line").alias("v")), "key").where("u < v").select("u", "v").distinct()
    x, y = (rows.select(F.col("line").alias(c), F.col("tokens").alias(f"{c}_tokens"), F.col("leaf").alias(f"{c}_leaf")) for c in "uv")
    return met.join(x, "u").join(y, "v").where((F.col("u_leaf") == F.col("v_leaf")) & _agree(F.col("u_tokens"), F.col("v_tokens"))).select("u", "v")


def _first_agreeing(edges: DataFrame) -> DataFrame:
    """(line, lead) of lines that agree with a line that begins a template before them: the first such one.

    In rounds: what no undecided line before it agrees with begins a template, what agrees with one of these doesn't.
    """
    edges = stored(edges, "agreeing")
    left, begins = edges, None
    while not left.isEmpty():
        later = left.select(F.col("v").alias("line")).distinct()
        new = left.select(F.col("u").alias("line")).distinct().join(later, "line", "left_anti")
        new = stored(new, "begins")
        begins = new if begins is None else begins.unionByName(new)
        gone = new.unionByName(left.join(new.withColumnRenamed("line", "u"), "u", "left_semi").select(F.col("v").alias("line")).distinct())
        gone = stored(gone, "decided")
        # lines whose last undecided neighbour goes may begin templates of their own: edges between undecided lines stay
        waiting = left.join(gone.withColumnRenamed("line", "u"), "u", "left_anti").join(gone.withColumnRenamed("line", "v"), "v", "left_anti")
        freed = left.select(F.col("u").alias("line")).unionByName(left.select(F.col("v").alias("line"))).distinct().join(gone, "line", "left_anti")
        waiting = stored(waiting.select("u", "v"), "waiting")
        held = waiting.select(F.col("u").alias("line")).unionByName(waiting.select(F.col("v").alias("line"))).distinct()
        begins = begins.unionByName(freed.join(held, "line", "left_anti"))
        left = waiting
    if begins is None:
        return edges.select(F.col("v").alias("line"), F.col("u").alias("lead"))
    begins = stored(begins.distinct(), "leads")
    return edges.join(begins.withColumnRenamed("line", "u"), "u", "left_semi").join(begins.withColumnRenamed("line", "v"), "v", "left_anti").groupBy(F.col("v").alias("line")).agg(F.min("u").alias("lead"))


def _templates(wide: DataFrame) -> DataFrame:
    """(line, template) of lines that share a template with another of their leaf; columns of wide: leaf, line, words.

    Lines of a leaf come in the order of their hashes. One that agrees with none of the first lines of the templates so
    far begins a template, otherwise it belongs to the first that it agrees with. Leaves of all sizes go the same way: the
    first lines of each leaf are judged together, twice, and all others held against the templates that they
    begin, which settles small leaves and large templates; what is left meets by the rarest tokens.
    """
    hashes = F.transform(F.split("words", " "), lambda w: F.xxhash64(w))
    rows = wide.select("leaf", "line", hashes.alias("tokens"))
    rows = rows.where(F.size("tokens") >= FIXED_PLACES)  # shorter ones agree with nothing
    settled = None
    for _ in range(ROUNDS):
        leads = _small(stored(_leads(rows), "leads"), 1 << 13)
        lead = F.get(F.filter("leads", lambda y: _agree(y["tokens"], F.col("tokens"))), F.lit(0))["line"]
        judged = stored(rows.join(leads, "leaf").select("leaf", "line", "tokens", lead.alias("lead")), "judged")
        found = judged.where("lead is not null").select("leaf", "line", "lead")
        settled = found if settled is None else settled.unionByName(found)
        rows = judged.where("lead is null").drop("lead")
    leaf = rows.select("line", "leaf")
    rest = _first_agreeing(_pairs(rows)).join(leaf, "line").select("leaf", "line", "lead")
    own = rest.select("leaf", F.col("lead").alias("line"), "lead").distinct()
    return settled.unionByName(rest).unionByName(own).select("line", F.xxhash64("leaf", "lead").alias("template"))


def _small(df: DataFrame, width: int) -> DataFrame:
    """The stored table, to be broadcast if its rows of ``width`` bytes are few."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def find_templates(places: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, template, first): masked lines of recurring templates, and the first document (none, doc, hash) that has the template.

    ``places`` is the stored table of ``line_places(df)``.
    """
    # each line's first and last document, and a place to read it at
    known = places.groupBy("line").agg(F.first("leaf").alias("leaf"), F.min(_order(F.col("pos"))).alias("at"), F.max(_order()).alias("last"))
    known = stored(known, "masked-lines")
    leaves = known.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("leaf")
    mixed = stored(known.join(leaves, "leaf", "left_semi").select("leaf", "line", "at.doc", "at.hash", "at.pos"), "mixed-leaves")
    few = mixed.count() * 64 <= BROADCAST_BYTES  # beyond that the texts are shuffled
    where = F.broadcast(mixed) if few else mixed
    holders = mixed.select("doc", "hash").distinct()
    texts = df.select(*_document(id_col, text_col), F.col(text_col).alias("text"))
    on = lambda x, y, *more: x["doc"].eqNullSafe(y["doc"]) & (x["hash"] == y["hash"]) & (x["pos"] == y["pos"] if more else F.lit(True))
    holders = F.broadcast(holders) if few else holders
    held = masked_lines(texts.join(holders, on(texts, holders), "left_semi").select("doc", "text"), "doc", "text")
    wide = stored(held.join(where, on(held, where, "pos")).select("leaf", "line", "words").dropDuplicates(["line"]), "leaf-lines")
    general = stored(_templates(wide), "templates")
    template = F.coalesce("template", F.col("line"))
    named = known.join(general, "line", "left").select("line", template.alias("template"), F.struct("at.none", "at.doc", "at.hash").alias("first"), "last")
    total = named.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    if min_docs > 2:
        held = places.join(named.select("line", "template"), "line")
        docs = held.groupBy("template", "doc", "hash").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        total = total.join(docs.select("template"), "template", "left_semi")
    elif min_docs == 2:
        total = total.where("first <> last")
    return named.select("line", "template").join(total.select("template", "first"), "template")


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Rows with the lines of recurring templates taken out, but in the first document that has the template.

    Lines of fewer than ``min_tokens`` tokens stay. All columns stay; n_lines and n_dropped are added
    (columns of those names are replaced). Documents that lose every line keep their row with an
    empty text. Null texts stay null with no lines. A document is an id with a text: rows that repeat
    both lose the same lines, rows that repeat an id with another text are documents of their own,
    and so are rows without an id, which come after all others. Repeated lines within the first
    document stay; an empty table gives an empty result. Ids are of any type that can be ordered.
    """
    places = stored(line_places(df, id_col, text_col, min_tokens), "line-places")
    found = _small(stored(find_templates(places, df, id_col, text_col, min_docs), "recurring-lines"), 64)
    drop = places.join(found, "line").where(_order() != F.col("first"))
    drop = drop.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    keep = df.drop("n_lines", "n_dropped")
    joined = keep.join(drop, keep[id_col].eqNullSafe(drop["doc"]) & (F.xxhash64(keep[text_col]) == drop["hash"]), "left")
    lines = F.split(keep[text_col], "\n", -1)
    left = F.when(F.col("__drop").isNull(), keep[text_col]).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n"))
    return joined.select(
        *(left.alias(c) if c == text_col else keep[c] for c in keep.columns),
        F.when(keep[text_col].isNull(), 0).otherwise(F.char_length(keep[text_col]) - F.char_length(F.replace(keep[text_col], F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).alias("n_dropped"),
    )
