"""Messages as tables: what bounced and why, who answered which message."""

from __future__ import annotations

import email
import email.header
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col

BOUNCES = "uid string, subject string, sent_at string, address string, hard boolean, code string, reason string"
CODE = re.compile(r"\b([245])\.(\d{1,3})\.(\d{1,3})\b")
#: Reports of these actions are no failures.
DELIVERED = {"delivered", "relayed", "expanded"}


def read(part: email.message.Message) -> str:
    """The text of a part; an unknown charset is read as Latin-1, as is what the declared one cannot read."""
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace") if not part.get_content_charset() else data.decode("latin-1")


def header(message: email.message.Message, name: str) -> str:
    """A header's text; words in an unknown charset are read as Latin-1."""
    out = []
    for said, charset in email.header.decode_header(str(message.get(name) or "")):
        try:
            out.append(said if isinstance(said, str) else said.decode(charset or "utf-8"))
        except (LookupError, UnicodeDecodeError):
            out.append(said.decode("latin-1"))
    return " ".join("".join(out).split())


def _recipients(message: email.message.Message) -> Iterator[tuple[str, bool, str, str]]:
    """(address, hard, code, reason) of each failed recipient of a delivery report."""
    for part in message.walk():
        if part.get_content_type() == "message/delivery-status":
            for block in part.get_payload():
                who = re.search(fixed.EMAIL_IN_TEXT, block.get("Final-Recipient") or block.get("Original-Recipient") or "")
                action = (block.get("Action") or "").strip().lower()
                if who and action not in DELIVERED:
                    code = CODE.search(block.get("Status") or "")
                    why = re.sub(r"^\s*smtp;", "", block.get("Diagnostic-Code") or "", flags=re.IGNORECASE)
                    yield who[0].lower(), bool(code) and code[1] == "5" and action != "delayed", code[0] if code else "", " ".join(why.split())[:160]


def _mentioned(message: email.message.Message) -> Iterator[tuple[str, bool, str, str]]:
    """The same out of the plain text of a report without a status part; the caller keeps addresses that were written to only."""
    body = "\n".join(read(p) for p in message.walk() if p.get_content_type() == "text/plain" and not p.is_multipart())
    code = CODE.search(body)
    line = next((x for x in body.splitlines() if code and code[0] in x), "")
    for who in dict.fromkeys(x.lower() for x in re.findall(fixed.EMAIL_IN_TEXT, body)):
        if not who.startswith(("mailer-daemon@", "postmaster@")):
            yield who, bool(code) and code[1] == "5", code[0] if code else "", " ".join(line.split())[:160]


def bounces(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """messages: (uid, raw). One row for each failed recipient of each report, the first of equal ones; only addresses in ``sent`` (to_address, status Sent)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, raw in zip(batch["uid"], batch["raw"], strict=True):
                m = email.message_from_bytes(raw or b"", policy=email.policy.compat32)
                subject = header(m, "Subject")
                sender, kind = header(m, "From").lower(), m.get_content_type()
                if re.search("mailer-daemon|postmaster", sender) or kind == "multipart/report" or re.search(r"undeliver|delivery status|returned mail|退信", subject, re.IGNORECASE):
                    reported = any(p.get_content_type() == "message/delivery-status" for p in m.walk())
                    found = list(_recipients(m) if reported else _mentioned(m))
                    for who in {f[0]: f for f in reversed(found)}.values():
                        rows.append((uid, subject, m.get("Date"), *who))
            yield pd.DataFrame(rows, columns=["uid", "subject", "sent_at", "address", "hard", "code", "reason"])

    to = sent.filter("status = 'Sent'").select(F.lower("to_address").alias("_to"))
    return messages.select("uid", "raw").mapInPandas(run, BOUNCES).join(to, F.col("address") == F.col("_to"), "left_semi")


def worst(found: DataFrame) -> DataFrame:
    """For each address its hardest bounce, the first of equals by uid."""
    return found.groupBy("address").agg(F.min(F.struct((~F.col("hard")).alias("soft"), "uid", "code", "reason")).alias("b")).select("address", (~F.col("b.soft")).alias("hard"), "b.uid", "b.code", "b.reason")


def replied_to(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """replies (uid, address, references) with company_id and matched_by: the first referenced message that was sent, else the latest message to the address."""
    ids = sent.filter("status = 'Sent'")
    tokens = replies.select("uid", F.posexplode(F.regexp_extract_all("references", F.lit("(<[^<>]+>)"), F.lit(1))).alias("pos", "message_id"))
    by_id = tokens.join(ids.select("message_id", "company_id"), "message_id").groupBy("uid").agg(F.min_by("company_id", "pos").alias("by_id"))
    by_address = ids.groupBy(F.lower("to_address").alias("_to")).agg(F.max(F.struct("sent_at", "id", "company_id"))["company_id"].alias("by_address"))
    both = replies.join(by_id, "uid", "left").join(by_address, F.lower("address") == F.col("_to"), "left").drop("_to")
    matched = F.when(F.col("by_id").isNotNull(), "message_id").when(F.col("by_address").isNotNull(), "address")
    return both.withColumn("company_id", F.coalesce("by_id", "by_address")).withColumn("matched_by", matched).drop("by_id", "by_address")


def signature(body: Column | str) -> Column:
    """struct<company, title, phone, url> out of the last 600 characters of a message."""
    tail = F.substring(col(body), -600, 600)
    line = lambda pattern: F.nullif(F.trim(F.regexp_extract(tail, pattern, 1)), F.lit(""))
    marker = "|".join(m.replace(".", r"\.") for m in fixed.COMPANY_MARKERS)
    return F.struct(
        line(rf"(?im)^(.*(?:{marker}).*)$").alias("company"),
        line(r"(?im)^(.*(?:manager|director|engineer|sales|經理|主任|業務|專員).*)$").alias("title"),
        line(r"(?im)(?:tel|phone|電話)\s*[:：]?\s*([+0-9()\-# ]{7,24})").alias("phone"),
        line(r"(?i)(https?://[^\s>]+|www\.[^\s>]+)").alias("url"),
    )
