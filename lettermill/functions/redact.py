"""Masking of secrets: ten rules, one after the other, each on what the ones before left."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _Z = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"  # edges of ASCII words
_URL = r"(?i)https?://[^\s<>\"']*"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    #: What stands for a match; the default is a mark with the rule's name.
    by: str | None = None
    #: Mask only digits that pass the checksum of payment cards.
    luhn: bool = False
    #: A text without any of these (lower-cased) has no match; nor has one without ``shape``, which begins with a digit and is cheap to look for.
    marks: tuple[str, ...] = ()
    shape: str | None = None

    def may_match(self, text: Column, lower: Column) -> Column:
        """A test that costs little and is true wherever the pattern matches, before or after earlier rules have masked the text."""
        if self.shape:
            return F.regexp_like(text, F.lit(self.shape))
        return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(m)) for m in self.marks)) if self.marks else F.lit(True)


# The shapes of secrets, in the order in which they are masked.
RULES = (
    Rule("api-key", rf"{_A}(?:sk-ant-[A-Za-z0-9_-]{{16,}}|sk-[A-Za-z0-9]{{20,}}|ghp_[A-Za-z0-9]{{20,}}|gho_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{10,}}|AKIA[0-9A-Z]{{16}}|AIza[0-9A-Za-z_-]{{30,}}){_Z}", marks=("sk-", "ghp_", "gho_", "github_pat_", "xox", "akia", "aiza")),
    Rule("bearer-token", rf"(?i){_A}(?:Authorization\s*:\s*)?(?:Bearer|Token)\s+[A-Za-z0-9._~+/=-]{{16,}}", marks=("bearer", "token")),
    Rule("jwt", rf"{_A}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}{_Z}", marks=("eyj",)),
    Rule("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", marks=("private key-----",)),
    Rule("credential-url", rf"{_URL}[?&](?:token|key|secret|password|passwd|auth|access_token|api_key)=[^\s<>\"'&]+", marks=("://",)),
    Rule("reset-link", rf"{_URL}/(?:reset|verify|confirm|activate|magic|login)/[A-Za-z0-9._-]{{12,}}", marks=("://",)),
    Rule("otp", rf"(?i)({_A}(?:code|otp|pin|passcode|verification code|security code){_Z}\D{{0,24}}{_A})\d{{4,8}}{_Z}", "$1[REDACTED:otp]", marks=("code", "otp", "pin")),
    Rule("ssn", rf"{_A}\d{{3}}-\d{{2}}-\d{{4}}{_Z}", shape=r"[0-9]{2}-[0-9]{4}"),
    Rule("card-number", rf"{_A}(?:\d[ -]?){{13,19}}{_Z}", luhn=True, shape=r"(?:[0-9][ -]?){13}"),
    Rule("password-assignment", rf"(?i){_A}(?:password|passwd|pwd|secret)\s*[:=]\s*\S{{6,}}", marks=("password", "passwd", "pwd", "secret")),
)


def is_card(text: Column) -> Column:
    """Whether the digits of a text are 13 to 19 and pass the checksum."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _masked_cards(text: Column, found: Column, pattern: str) -> Column:
    """Text with card numbers masked: what stands between matches, and the matches, are put together again."""
    masked = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.concat(gap, F.coalesce(F.when(is_card(m), F.lit("[REDACTED:card-number]")).otherwise(m), F.lit(""))))
    return F.array_join(masked, "")


def redacted(df: DataFrame, column: str, out: str = "redacted", counts: str = "redactions", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the masked text, and a struct with the number of matches of each rule.

    Each rule counts, then masks where there is something to mask, as projections of their own that read the text at
    their step; a rule is tried only where its cheap test allows a match. Null stays null and counts 0.
    """
    lower = F.lower(F.col(column))
    df = df.withColumn("__lower", lower)
    df = df.withColumns({"__text": F.col(column)} | {f"__may{i}": F.coalesce(r.may_match(F.col(column), F.col("__lower")), F.lit(False)) for i, r in enumerate(rules)}).drop("__lower")
    for i, rule in enumerate(rules):
        text, n, may = F.col("__text"), f"__n{i}", F.col(f"__may{i}")
        if rule.luhn:
            df = df.withColumn("__found", F.when(may, F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))))
            df = df.withColumn(n, F.coalesce(F.when(may, F.size(F.filter("__found", is_card))), F.lit(0)))
            new = _masked_cards(text, F.col("__found"), rule.pattern)
        else:
            df = df.withColumn(n, F.coalesce(F.when(may, F.regexp_count(text, F.lit(rule.pattern))), F.lit(0)))
            new = F.regexp_replace(text, rule.pattern, rule.by or f"[REDACTED:{rule.name}]")
        df = df.withColumn("__text", F.when(F.col(n) > 0, new).otherwise(text))
    struct = F.struct(*(F.col(f"__n{i}").alias(r.name) for i, r in enumerate(rules)))
    return df.withColumns({out: F.col("__text"), counts: struct}).drop("__text", "__found", *(f"__{c}{i}" for c in ("n", "may") for i in range(len(rules))))


def contains_secrets(df: DataFrame, column: str, out: str = "has_secrets") -> DataFrame:
    marked = redacted(df, column, "__masked", "__counts")
    total = sum((F.col("__counts").getField(r.name) for r in RULES), F.lit(0))
    return marked.withColumn(out, total > 0).drop("__masked", "__counts")
