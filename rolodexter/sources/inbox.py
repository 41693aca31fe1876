"""A mailbox read once: every message parsed into one tagged row, from which bounces, answers and new contacts are told."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.text import blank_to_null
from ..operators import outreach
from ..operators.staging import spread, stage
from . import mail

#: Headers of automatic answers, what begins a signature, and what its lines hold.
AUTO_HEADERS = ["Auto-Submitted", "X-Autoreply", "X-Autorespond", "X-Auto-Response-Suppress"]
SIGNATURE_MARKERS = ["-- ", "--\n", "敬祝", "順頌商祺", "Best regards", "Kind regards", "Regards,"]
COMPANY_LINE = r"(?im)^([^\n]{2,60}?(?:股份有限公司|有限公司|企業社|工作室|實業|科技|Co\.?,?\s*Ltd\.?|Inc\.?|Corp\.?|LLC))\s*$"
TITLE_LINE = r"(?im)^([^\n]{0,30}?(?:經理|總監|協理|副理|主任|工程師|業務|專員|負責人|Manager|Director|Engineer|Sales|CEO|CTO))\s*$"
PHONE_LINE = r"(?:TEL|Tel|電話|手機|Mobile|M)\s*[:：]?\s*((?:\+886|0)[\d\s\-()]{7,15}(?:\s*(?:#|轉|分機)\s*\d{1,6})?)"
URL_LINE = r"(https?://[^\s<>\"]+|www\.[^\s<>\"]+)"
SNIPPET_CHARS, BODY_CHARS, SIGNATURE_CHARS, LAST_LINES = 80, 100_000, 1200, 12

MESSAGES = (
    "uid string, kind string, sender string, person string, subject string, sent_at timestamp, said_at string, refers array<string>, body string, organization string, automatic boolean, precedence string, "
    "failures array<struct<address:string,hard:boolean,code:string,reason:string>>, reported boolean"
)


def _body(message: email.message.Message) -> str:
    """The plain text of a message, its HTML where there is none; not of attached files. As much as is asked of."""
    parts, pages = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_filename():
            continue
        if part.get_content_type() == "text/plain":
            parts.append(mail.read(part))
        elif part.get_content_type() == "text/html":
            pages.append(re.sub(r"(?s)<[^>]*>", " ", mail.read(part)))
        if sum(map(len, parts)) >= BODY_CHARS:
            break
    return "\n".join(parts or pages)[:BODY_CHARS].replace("\r\n", "\n")


def _when(said: str):
    try:
        at = email.utils.parsedate_to_datetime(said)
        return at if at.tzinfo else at.replace(tzinfo=None)
    except (TypeError, ValueError, IndexError):
        return None


def _parsed(uid: str, raw: bytes | None) -> tuple:
    m = email.message_from_bytes(raw or b"", policy=email.policy.compat32)
    subject, sender, kind = mail.header(m, "Subject"), mail.header(m, "From"), m.get_content_type()
    person, address = next(((n, a) for n, a in email.utils.getaddresses([sender]) if a), ("", ""))
    bounce = bool(re.search("mailer-daemon|postmaster", sender.lower())) or kind == "multipart/report" or bool(re.search(r"undeliver|delivery (?:status|failure)|returned mail|退信", subject, re.IGNORECASE))
    reported = any(p.get_content_type() == "message/delivery-status" for p in m.walk())
    failures = list({f[0]: f for f in reversed(list(mail._recipients(m) if reported else mail._mentioned(m)))}.values()) if bounce else []
    refers = list(dict.fromkeys(t for h in ("In-Reply-To", "References") for t in re.findall(r"<[^<>@\s]+@[^<>\s]+>", mail.header(m, h))))
    automatic = any((v := mail.header(m, h).lower()) and v != "no" for h in AUTO_HEADERS)
    said = mail.header(m, "Date")
    at = _when(said)
    at = pd.Timestamp(at).tz_convert("UTC").tz_localize(None) if at is not None and at.tzinfo else pd.Timestamp(at) if at is not None else pd.NaT
    return uid, "bounce" if bounce else "message", address.strip().lower(), person.strip(), subject, at, said, refers, _body(m), mail.header(m, "Organization"), automatic, mail.header(m, "Precedence").lower(), failures, reported


def read(messages: DataFrame) -> DataFrame:
    """MESSAGES of (uid, raw), written: the one pass that parses. Everything else reads its rows.

    A message in an unknown charset is read as Latin-1; a broken or empty one is a row with what can be told of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", MESSAGES)]
        for batch in batches:
            out = pd.DataFrame([_parsed(u, r) for u, r in zip(batch["uid"], batch["raw"], strict=True)], columns=names)
            out["sent_at"] = pd.to_datetime(out["sent_at"])
            yield out

    return stage(spread(messages.select(F.col("uid").cast("string").alias("uid"), "raw")).mapInPandas(run, MESSAGES), "inbox")


def _sent_addresses(sent: DataFrame) -> DataFrame:
    return sent.filter("status = 'Sent'").select(F.lower(F.trim("to_address")).alias("_to")).filter("_to <> ''").distinct()


def bounces(inbox: DataFrame, sent: DataFrame) -> DataFrame:
    """(uid, subject, sent_at, address, hard, code, reason): a row for each failed recipient of each report, only of addresses that were written to."""
    each = inbox.filter("kind = 'bounce'").select("uid", "subject", "sent_at", F.inline("failures"))
    return each.join(_sent_addresses(sent), F.col("address") == F.col("_to"), "left_semi").select("uid", "subject", "sent_at", "address", "hard", "code", "reason")


def answers(inbox: DataFrame, sent: DataFrame) -> DataFrame:
    """(uid, address, subject, sent_at, matched_by, message_nr, kind, snippet) of messages that answer one that was sent: by the first id they refer to, else by their sender. Bounces are none.

    sent: id, to_address, message_id, status. kind: unsubscribe, auto or human.
    """
    m = inbox.filter("kind = 'message' and sender <> ''")
    ids = sent.filter("status = 'Sent'").select(F.trim("message_id").alias("_mid"), F.col("id").alias("_nr")).filter("_mid <> ''").groupBy("_mid").agg(F.max("_nr").alias("_nr"))
    named = m.select("uid", F.posexplode("refers").alias("pos", "_mid")).join(ids, "_mid").groupBy("uid").agg(F.min_by("_nr", "pos").alias("message_nr")).withColumnRenamed("uid", "_uid")
    both = m.join(named, F.col("uid") == F.col("_uid"), "left").join(_sent_addresses(sent), F.col("sender") == F.col("_to"), "left")
    found = both.filter(F.col("message_nr").isNotNull() | F.col("_to").isNotNull())
    snippet = F.substring(F.trim(F.regexp_replace(F.substring("body", 1, fixed.UNSUBSCRIBE_BODY_CHARS), r"(?U)\s+", " ")), 1, SNIPPET_CHARS)
    kind = outreach.reply_kind(F.col("subject"), F.col("body"), F.col("automatic"), F.col("precedence"))
    return found.select("uid", F.col("sender").alias("address"), "subject", "sent_at", F.when(F.col("message_nr").isNotNull(), "message-id").otherwise("address").alias("matched_by"), "message_nr", kind.alias("kind"), snippet.alias("snippet"))


def signature(body: Column) -> Column:
    """What is behind the last of the first marker that a text has, 1,200 characters; else its last twelve lines that are not blank."""
    cut = F.lit(None).cast("string")
    for marker in reversed(SIGNATURE_MARKERS):
        at = F.length(body) - F.locate(marker[::-1], F.reverse(body)) - len(marker) + 2
        cut = F.when(F.contains(body, F.lit(marker)), F.substring(body, at, F.lit(SIGNATURE_CHARS))).otherwise(cut)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    last = F.when(F.size(lines) > LAST_LINES, F.slice(lines, -LAST_LINES, LAST_LINES)).otherwise(lines)
    return F.coalesce(cut, F.array_join(last, "\n"))


def contacts(inbox: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """(uid, company_name, email, phone, website, contact_person, title, source, source_url) of each message's sender, as raw records; not of bounces and of domains to ignore.

    The company is the organization of the header, a line of the signature, or the name of the domain; telephone, site and title come from the signature, the telephone else from the text and the site from the domain.
    """
    rows = inbox.filter("kind = 'message' and sender like '%@%'").withColumns({"domain": F.substring_index("sender", "@", -1), "tail": signature(F.col("body"))})
    if ignore:
        rows = rows.filter(~F.col("domain").isin([d.lower() for d in ignore]))
    found = lambda c, pattern, k=1: blank_to_null(F.regexp_extract(c, pattern, k))
    label = F.initcap(F.translate(F.substring_index("domain", ".", 1), "-_", "  "))
    company = F.coalesce(blank_to_null("organization"), found("tail", COMPANY_LINE), label)
    phone = text.phone(F.coalesce(found("tail", PHONE_LINE), found("body", PHONE_LINE)))
    site = F.coalesce(text.website(found("tail", URL_LINE)), text.website(F.col("domain")))
    return rows.select("uid", F.coalesce(text.company_name(company), company).alias("company_name"), F.col("sender").alias("email"), phone.alias("phone"), site.alias("website"), text.person(F.col("person")).alias("contact_person"), found("tail", TITLE_LINE).alias("title"), F.lit("gmail").alias("source"), F.concat(F.lit("imap://"), F.col("uid")).alias("source_url"))


def summary(inbox: DataFrame, sent: DataFrame) -> DataFrame:
    """One row: messages, bounce messages, failures of addresses that were and were not written to, answers, of these wishes for no more mail."""
    to = _sent_addresses(sent)
    failed = inbox.select(F.inline("failures")).join(to.withColumn("known", F.lit(True)), F.col("address") == F.col("_to"), "left").agg(F.count_if("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("unmatched"))
    told = answers(inbox, sent).agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("kind") == "unsubscribe").alias("asking_out"))
    return inbox.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("kind") == "bounce").alias("bounce_messages")).crossJoin(failed).crossJoin(told)
