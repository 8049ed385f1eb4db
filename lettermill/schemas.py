"""Schemas of messages, correspondence, rules and the journal, as DDL."""

ADDRESS = "struct<name: string, email: string, domain: string>"
ATTACHMENT = "struct<filename: string, contentType: string, size: bigint>"
ACTION = "struct<action: string, uid: bigint, messageId: string, `from`: string, `to`: string, flags: array<string>, label: string>"
MESSAGE = (
    f"uid bigint, folder string, messageId string, threadId string, `from` {ADDRESS}, `to` array<{ADDRESS}>, cc array<{ADDRESS}>, replyTo array<{ADDRESS}>, "
    f"subject string, date timestamp, flags array<string>, size bigint, headers map<string, string>, bodyText string, attachments array<{ATTACHMENT}>, hasBody boolean"
)
EDGE = "email string, domain string, direction string, ts_ms bigint, name string, seq bigint"
RULES = "email string, is_vip boolean, is_muted boolean"
JOURNAL = f"runId string, ts string, phase string, actions array<{ACTION}>, action {ACTION}, applied boolean, error string, type string, reversed int, undoneAt string, usd double, input bigint, output bigint, calls bigint"
