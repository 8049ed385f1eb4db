"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.bpe import bpe_encode
from lettermill.llm.decontaminate import find_contamination
from lettermill.llm.fingerprints import fingerprint_edits
from lettermill.llm.html import extract_text
from lettermill.llm.licenses import scan_licenses
from lettermill.llm.lines import drop_recurring_lines
from lettermill.llm.manifest import lowered, merkle_manifest
from lettermill.llm.multiindex import nearest
from lettermill.llm.neardup import near_duplicates
from lettermill.llm.negatives import hard_negatives
from lettermill.llm.quality import score_quality
from lettermill.llm.sharding import shard_documents
from lettermill.llm.toxicity import fit, score_toxicity

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), VOCAB, with_ids=False, with_decoded=False)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1  # labels of the other third are never read
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(seen))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"), min_tokens=1).select("doc_id", "text", "n_lines", "n_dropped")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), F.when(hit, lowered(F.col("text"))).otherwise(F.col("text")))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_shards, op3_quality, op4_toxicity, op5_neardup, op6_decontaminate, op7_licenses, op8_fingerprints, op9_lines, op10_html, op11_negatives, op12_nearest, op13_manifest)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _merkle_sql(depth: int = 9) -> str:
    """The trees as SQL, unrolled to ``depth`` levels (8^9 rows a language).

    Level tables t0, t1, .. have the group (-1 for the tree of languages), rank and digest of each node; u0, u1, ..
    are those of the tree of languages. A document's fold and siblings follow its rank through both.
    """
    text = "CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # crc32 by its polynomial, bit by bit
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))"
    octets = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: {bits}), 4294967295)"
    with_ = [
        f"d AS (SELECT *, coalesce({crc} % 3 = 0, false) AS hit FROM documents)",
        f"e AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(text)} AS now FROM d)",
        "l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS n FROM e GROUP BY lang)",
        "r AS (SELECT e.*, g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM e JOIN l ON e.lang IS NOT DISTINCT FROM l.lang)",
        "t0 AS (SELECT g, rank, leaf AS h, n FROM r)",
    ]
    up = "SELECT g, rank // 8 AS rank, sha256(string_agg(h, '' ORDER BY rank)) AS h, (n + 7) // 8 AS n FROM {0} WHERE n > 1 GROUP BY g, rank // 8, n UNION ALL SELECT g, rank, h, n FROM {0} WHERE n = 1"
    with_ += [f"t{k + 1} AS ({up.format(f't{k}')})" for k in range(depth)]
    with_ += [f"u0 AS (SELECT -1 AS g, g AS rank, h, (SELECT count(*) FROM l) AS n FROM t{depth})"]
    with_ += [f"u{k + 1} AS ({up.format(f'u{k}')})" for k in range(3)]
    state, step = "r", 0
    with_ += ["s0 AS (SELECT doc_id, leaf, g, g AS lang_rank, rank, now AS f, '' AS p FROM r)"]
    for k, name in enumerate([f"t{k}" for k in range(depth)] + [f"u{k}" for k in range(3)]):
        tree = name[0] == "u"
        g, rank = ("-1", "lang_rank") if tree else ("s.g", "s.rank")
        keep = "s.lang_rank // 8 AS lang_rank, s.rank" if tree else "s.lang_rank, s.rank // 8 AS rank"
        runs = f"SELECT g, rank // 8 AS run, max(n) AS n, list(h ORDER BY rank) AS hs FROM {name} GROUP BY 1, 2"
        at = f"{rank} % 8"
        left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        with_.append(
            f"s{k + 1} AS (SELECT doc_id, leaf, s.g, {keep}, CASE WHEN x.n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN x.n > 1 THEN p || {left} || {right} ELSE p END AS p"
            f" FROM s{k} s JOIN ({runs}) x ON x.g = {g} AND x.run = {rank} // 8)"
        )
    last = f"s{depth + 3}"
    return "WITH " + ",\n ".join(with_) + f"\nSELECT doc_id, leaf, t.h AS subroot, u3.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u3.h AS verified FROM {last} s JOIN t{depth} t ON t.g = s.g CROSS JOIN u3"


#: Where SQL can express a query; the others are tested against brute force, a library or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 i AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
 wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS k FROM i),
 p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
 hit AS (SELECT doc_id, item_id, pos, p.n FROM p JOIN wins ON wins.n = p.n AND wins.k = array_to_string(list_slice(w, pos, pos + p.n - 1), ' ')),
 h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM hit) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
 p AS (SELECT anchor, id AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op13_manifest": _merkle_sql(),
}
