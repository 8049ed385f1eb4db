"""How one writes: lengths, greetings, sign-offs and habits in one's own sent messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.numbers import half_up
from lettermill.functions.text import word_count

_A, _Z = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
# The words that count.
GREETINGS = rf"(?i)\A(hi|hello|hey|dear|good morning|good afternoon|thanks|thank you){_Z}"
SIGN_OFFS = rf"(?i){_A}(best|thanks|cheers|regards|best regards|talk soon|sincerely){_Z}"
CONTRACTIONS = rf"(?i){_A}(don't|can't|it's|we'll|I'm|that's){_Z}"


def sample(sent: DataFrame, most: int = 200, least: int = 20) -> DataFrame:
    """The last ``most`` messages with more than ``least`` characters."""
    return sent.where(F.char_length("bodyText") > least).orderBy(F.col("seq").desc()).limit(most)


def _lines(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")


def greeting(body: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.get(_lines(body), F.lit(0)), GREETINGS, 1)), F.lit(""))


def sign_off(body: Column, last: int = 3) -> Column:
    """The first sign-off within the ``last`` lines that aren't blank."""
    lines = F.transform(_lines(body), F.trim)
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - (last - 1), F.lit(1)), last), " ")
    return F.nullif(F.lower(F.regexp_extract(tail, SIGN_OFFS, 1)), F.lit(""))


def examples(rows: DataFrame, most: int = 3, lines: int = 4) -> DataFrame:
    """(seq, example): the beginnings of the last messages, as quoted lines."""
    last = rows.orderBy(F.col("seq").desc()).limit(most)
    return last.select("seq", F.array_join(F.transform(F.slice(_lines(F.col("bodyText")), 1, lines), lambda x: F.concat(F.lit("> "), x)), "\n").alias("example"))


def tally(df: DataFrame, value: Column, most: int = 3) -> DataFrame:
    """(word, n): the most frequent values, of equal ones the first seen."""
    return df.select(value.alias("word"), "seq").where("word is not null").groupBy("word").agg(F.count("*").alias("n"), F.max("seq").alias("__last"), F.min("seq").alias("__first")).orderBy(F.col("n").desc(), "__first").limit(most).select("word", "n")


def profile(rows: DataFrame) -> DataFrame:
    """messages, median_words (the upper one of two middles), and the rates of exclamation marks and contractions in percent."""
    counted = rows.select(word_count(F.col("bodyText")).alias("w"), F.contains("bodyText", F.lit("!")).alias("e"), F.col("bodyText").rlike(CONTRACTIONS).alias("c"))
    rate = lambda c: half_up(F.avg(F.col(c).cast("int")) * 100).cast("int")
    return counted.agg(F.count("*").alias("messages"), F.get(F.sort_array(F.collect_list("w")), F.floor(F.count("*") / 2).cast("int")).alias("median_words"), rate("e").alias("exclamation_pct"), rate("c").alias("contraction_pct"))
