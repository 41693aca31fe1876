"""Who may be written to, and what answers mean. Nothing is sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blank_to_null, col
from ..functions.validate import is_email
from .merge import advanced
from .windows import with_quota



def skip_reason(dnc: Column, mail: Column, verdict: Column, last_sent: Column, now: Column, days: int = 30, need_valid: bool = False) -> Column:
    """Why a row is not written to, or null. Not-to-contact comes first and nothing overrides it."""
    return (
        F.when(F.coalesce(dnc, F.lit(False)), "DO_NOT_CONTACT")
        .when(verdict == "Bounced", "BOUNCED")
        .when(blank_to_null(mail).isNull(), "NO_EMAIL")
        .when(~is_email(F.lower(F.trim(mail))), "INVALID_EMAIL")
        .when(F.lit(need_valid) & ~verdict.eqNullSafe(F.lit("Valid")), "UNVERIFIED")
        .when(last_sent >= now - F.make_dt_interval(days=F.lit(days)), "RECENTLY_EMAILED")
    )


def plan(rows: DataFrame, reason: Column, order: list[Column], left: int, id_col: str = "id") -> DataFrame:
    """rows with skip_reason; of those without one the first ``left``, by the order, stay and the others get DAILY_CAP."""
    judged = with_quota(rows.withColumn("skip_reason", reason), F.col("skip_reason").isNull(), order, left, id_col)
    return judged.withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & ~F.col("in_quota"), "DAILY_CAP").otherwise(F.col("skip_reason"))).drop("in_quota")


def wants_out(subject: Column, body: Column) -> Column:
    """Whether an answer asks for no more mail; of the body only the start counts, as quotations follow."""
    said = "(?i)" + "|".join(fixed.UNSUBSCRIBE_WORDS)
    return F.coalesce(subject.rlike(said), F.lit(False)) | F.coalesce(F.substring(body, 1, fixed.UNSUBSCRIBE_BODY_CHARS).rlike(said), F.lit(False))


def is_automatic(subject: Column, auto_header: Column | None = None, precedence: Column | None = None) -> Column:
    """Whether no person wrote it. auto_header: whether a header of automatic replies says other than no."""
    out = F.coalesce(subject.rlike("(?i)" + "|".join(fixed.AUTO_SUBJECT_WORDS)), F.lit(False))
    if auto_header is not None:
        out = out | F.coalesce(auto_header, F.lit(False))
    if precedence is not None:
        out = out | F.coalesce(F.lower(F.trim(precedence)).isin(fixed.AUTO_PRECEDENCE), F.lit(False))
    return out


def reply_kind(subject: Column, body: Column, auto_header: Column | None = None, precedence: Column | None = None) -> Column:
    """unsubscribe, auto or human. A wish for no more mail counts whoever says it, an automatic answer included."""
    return F.when(wants_out(subject, body), "unsubscribe").when(is_automatic(subject, auto_header, precedence), "auto").otherwise("human")


def suggested(kind: Column) -> Column:
    """Whether an answer is ticked at first: all but automatic ones."""
    return kind != "auto"


def reply_action(kind: Column, stage: Column, to: str = "Replied") -> Column:
    """What adopting an answer does: mark, advance or note."""
    return F.when(kind == "unsubscribe", "mark").when(advanced(stage, to) != stage, "advance").otherwise("note")


def recipients(among: dict[str, list]) -> Column:
    """Who a schedule writes to: with an address, may be contacted, and in the lists."""
    from .filters import Search

    return Search(presence={"email": True}, among=among).predicate() & ~F.coalesce(F.col("do_not_contact"), F.lit(False))


def reply_rank(kind: Column) -> Column:
    return F.when(kind == "unsubscribe", 2).when(kind == "human", 1).otherwise(0)


def is_bounce(sender: Column, content_type: Column, subject: Column) -> Column:
    return F.coalesce(F.lower(sender).rlike("mailer-daemon|postmaster"), F.lit(False)) | F.coalesce(F.lower(content_type).rlike("multipart/report|delivery-status"), F.lit(False)) | F.coalesce(subject.rlike(r"(?i)undeliver|delivery (status|failure)|returned mail|退信"), F.lit(False))


def is_hard(status: Column, action: Column) -> Column:
    return F.coalesce(status.startswith("5"), F.lit(False)) & ~F.coalesce(F.lower(action) == "delayed", F.lit(False))


def bounced_verdict(verdict: Column, hard: Column) -> Column:
    return F.when(F.coalesce(hard, F.lit(False)), "Bounced").otherwise(verdict)


def answered(replies: DataFrame, sent: DataFrame, address: str = "address", to: str = "to_address") -> DataFrame:
    """Replies from addresses that were written to; others may not change a record."""
    return replies.join(sent.filter("status = 'Sent'").select(F.lower(F.col(to)).alias("_to")), F.lower(F.col(address)) == F.col("_to"), "left_semi")


def unsubscribed(companies: DataFrame, requests: DataFrame, mail: str = "email", address: str = "address") -> DataFrame:
    """companies with do_not_contact set for every row that shares a requesting address; it is never cleared."""
    asks = requests.select(F.lower(F.trim(F.col(address))).alias("_ask")).distinct()
    out = companies.join(asks, F.lower(F.trim(F.col(mail))) == F.col("_ask"), "left")
    return out.withColumn("do_not_contact", F.coalesce(F.col("do_not_contact"), F.lit(False)) | F.col("_ask").isNotNull()).drop("_ask")


#: What stands for a field that a company lacks, the start of an address that is its city, and elements that make a template markup.
TEMPLATE_DEFAULTS = {"company_name": "貴公司", "contact_person": "您好", "industry": "貴產業"}
CITY = r"^[^0-9]{2,3}[縣市]"
MARKUP = r"(?i)<(?:p|br|div|span|b|i|u|strong|em|a|ul|ol|li|h[1-6]|table|html|body|font|img)\b[^>]*>"


def escaped(c: Column) -> Column:
    """Text as it stands in markup."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def template_values(columns: dict[str, Column | str]) -> dict[str, Column]:
    """Values for rendered(): blanks get their stand-in, and a missing city is the start of the address."""
    named = {k: blank_to_null(v) for k, v in columns.items()}
    if "address" in named:
        start = F.regexp_extract(F.trim(col(columns["address"])), CITY, 0)
        named["city"] = F.coalesce(named.get("city", F.lit(None).cast("string")), F.when(start != "", start))
    return {k: F.coalesce(v, F.lit(TEMPLATE_DEFAULTS.get(k, ""))) for k, v in named.items()}


def unsubscribed_with_history(companies: DataFrame, requests: DataFrame, now: Column, mail: str = "email") -> tuple[DataFrame, DataFrame]:
    """unsubscribed(), and a history row (company_id, kind, body, occurred_at) for each company that was not marked before."""
    out = unsubscribed(companies.withColumn("_before", F.coalesce(F.col("do_not_contact"), F.lit(False))), requests, mail)
    history = out.filter("do_not_contact and not _before").select(F.col("id").alias("company_id"), F.lit("unsubscribe").alias("kind"), F.col(mail).alias("body"), now.alias("occurred_at"))
    return out.drop("_before"), history


def rendered(template: str, values: dict[str, Column | str]) -> Column:
    """A template with {placeholders} as one expression; values are not rendered again, and are escaped where the template is markup. Unknown placeholders are an error."""
    import re

    out, markup = [], re.search(MARKUP, template) is not None
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            if part not in values:
                raise ValueError(f"unknown placeholder: {part}")
            said = F.coalesce(col(values[part]).cast("string"), F.lit(""))
            out.append(escaped(said) if markup else said)
        elif part:
            out.append(F.lit(part))
    return F.concat(*out) if out else F.lit("")


def sent_today(messages: DataFrame, now: Column) -> DataFrame:
    return messages.filter((F.col("status") == "Sent") & (F.col("created_at") >= F.date_trunc("day", now))).agg(F.count(F.lit(1)).alias("n"))


def size_gate(files: DataFrame, plan_col: str, size: str, limit: int) -> DataFrame:
    return files.groupBy(plan_col).agg(F.sum(size).alias("total"), F.bool_and(F.col(size).isNotNull()).alias("all_there")).withColumn("fits", F.col("all_there") & (F.col("total") <= limit))


def history(rows: DataFrame, key: str, when: str, tie: str, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when), F.desc(tie)))).filter(F.col("place") <= n)
