"""What headers say: authentication, addressing, kept headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers that are kept.
KEPT_HEADERS = (
    "list-unsubscribe", "list-id", "precedence", "auto-submitted", "x-autoreply", "x-autorespond", "return-path", "reply-to", "importance",
    "x-priority", "content-type", "authentication-results", "arc-authentication-results", "received-spf", "dkim-signature",
)


def kept_headers(headers: Column) -> Column:
    """The first value of each header worth keeping, from a map of name to values."""
    first = F.transform_values(headers, lambda k, v: F.get(v, F.lit(0)))
    return F.map_filter(first, lambda k, v: k.isin(*KEPT_HEADERS) & (v != ""))


def authentication(headers: Column) -> Column:
    """pass, fail or none: DMARC's verdict before those of DKIM and SPF."""
    parts = [F.coalesce(headers[h], F.lit("")) for h in ("authentication-results", "arc-authentication-results", "received-spf")]
    said = F.lower(F.concat_ws(" ", *parts))
    dkim, spf = said.rlike("dkim=(fail|permerror|temperror)"), said.rlike(r"spf=(fail|softfail)|\A\s*fail(?![0-9a-z_])")
    return (
        F.when(said.rlike("dmarc=(fail|reject|quarantine)"), "fail")
        .when(said.rlike("dmarc=pass"), "pass")
        .when(dkim & spf, "fail")
        .when(said.rlike("dkim=pass|spf=pass"), "pass")
        .when(dkim | spf, "fail")
        .otherwise("none")
    )


def is_self(email: Column, own: Sequence[str]) -> Column:
    return email.isin(*(a.lower() for a in own)) if own else F.lit(False)


def addressing(to: Column, cc: Column, own: Sequence[str]) -> Column:
    """direct, group, cc or bcc: how one's own addresses stand among the recipients."""
    among = lambda xs: F.exists(xs, lambda a: is_self(a["email"], own))
    return F.when(among(to) & (F.size(to) == 1), "direct").when(among(to), "group").when(among(cc), "cc").otherwise("bcc")


def recipients(to: Column, cc: Column) -> Column:
    return F.filter(F.concat(to, cc), lambda a: a["email"] != "")
