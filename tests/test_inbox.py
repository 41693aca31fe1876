"""One pass over a mailbox: bounces, answers and contacts, odd charsets and broken messages."""

from datetime import datetime

import pytest

from rolodexter.sources import inbox, mail


def message(sender, subject, body, extra="", charset="utf-8"):
    return f"From: {sender}\r\nSubject: {subject}\r\nDate: Thu, 01 Feb 2024 10:00:00 +0800\r\n{extra}Content-Type: text/plain; charset={charset}\r\n\r\n{body}".encode("utf-8" if charset.startswith("x-") else charset)


REPORT = b"""From: MAILER-DAEMON@b.tw\r\nSubject: Undeliverable: offer\r\nContent-Type: multipart/report; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nfailed\r\n--B\r\nContent-Type: message/delivery-status\r\n\r
Reporting-MTA: dns; b.tw\r\n\r\nFinal-Recipient: rfc822; One@Sent.tw\r\nAction: failed\r\nStatus: 5.1.1\r\nDiagnostic-Code: smtp; 550 no such user\r\n\r\nFinal-Recipient: rfc822; late@sent.tw\r\nAction: delayed\r\nStatus: 4.2.2\r\n\r\nFinal-Recipient: rfc822; never@written.tw\r\nAction: failed\r\nStatus: 5.0.0\r\n\r\n--B--\r\n"""
SIGNED = "你好，請報價。\n\n-- \n林水秀\n東嶼繩索股份有限公司\n業務經理\nTEL: 02-2581-6407 #12\nhttps://www.islandrope.tw/?utm_source=mail"


@pytest.fixture(scope="module")
def box(spark):
    raws = {
        "1": REPORT,
        "2": message("Lin <LIN@islandrope.tw>", "Re: offer", SIGNED, "In-Reply-To: <none@x>\r\nReferences: <a@me.tw> <b@me.tw>\r\n"),
        "3": message("one@sent.tw", "=?utf-8?B?5Ye65beu?= out of office", "back on Monday", "Auto-Submitted: auto-replied\r\n"),
        "4": message("two@sent.tw", "hi", "Please unsubscribe me\n> unsubscribe"),
        "5": message("Wu <wu@no-answer_co.tw>", "=?x-unknown?Q?caf=E9?=", "strange é", charset="x-strange"),
        "6": b"\xff\xfe not a message at all \x00",
        "7": None,
        "8": message("postmaster@c.tw", "note", "could not reach late@sent.tw 4.4.1 later"),
        "9": "From: Kai <kai@html.tw>\r\nSubject: x\r\nOrganization: Harbour =?big5?B?pKSk5Q==?=\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>only <b>html</b></p>\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nunsubscribe\r\n--B--\r\n".encode(),
    }
    return inbox.read(spark.createDataFrame(list(raws.items()), "uid string, raw binary").repartition(3))


@pytest.fixture(scope="module")
def sent(spark):
    rows = [(1, "one@sent.tw", "<a@me.tw>", "Sent"), (2, " Two@sent.tw ", "<b@me.tw>", "Sent"), (3, "late@sent.tw", None, "Sent"), (4, "never@written.tw", "<c@me.tw>", "Failed")]
    return spark.createDataFrame(rows, "id long, to_address string, message_id string, status string")


def test_one_row_a_message(box):
    assert box.count() == 9 and {r["uid"] for r in box.filter("kind = 'bounce'").collect()} == {"1", "8"}
    rows = {r["uid"]: r for r in box.collect()}
    assert rows["5"]["subject"] == "café" and "strange" in rows["5"]["body"] and rows["9"]["body"].split() == ["only", "html"]
    assert rows["2"]["sent_at"] == datetime(2024, 2, 1, 2) and rows["9"]["organization"] == "Harbour 中文"
    assert rows["7"]["sender"] == "" and rows["6"]["failures"] == []


def test_bounces_answers_contacts(box, sent):
    assert sorted((r["uid"], r["address"], r["hard"], r["code"]) for r in inbox.bounces(box, sent).collect()) == [("1", "late@sent.tw", False, "4.2.2"), ("1", "one@sent.tw", True, "5.1.1"), ("8", "late@sent.tw", False, "4.4.1")]
    got = {r["uid"]: (r["address"], r["matched_by"], r["message_nr"], r["kind"], r["snippet"]) for r in inbox.answers(box, sent).collect()}
    assert got == {
        "2": ("lin@islandrope.tw", "message-id", 1, "human", " ".join(SIGNED.split())[:80]),
        "3": ("one@sent.tw", "address", None, "auto", "back on Monday"),
        "4": ("two@sent.tw", "address", None, "unsubscribe", "Please unsubscribe me > unsubscribe"),
    }
    people = {r["uid"]: r for r in inbox.contacts(box, ["sent.tw"]).collect()}
    assert set(people) == {"2", "5", "9"}
    lin = people["2"]
    assert (lin["company_name"], lin["email"], lin["phone"], lin["website"], lin["contact_person"], lin["title"], lin["source_url"]) == ("東嶼繩索股份有限公司", "lin@islandrope.tw", "02-25816407#12", "https://www.islandrope.tw", "Lin", "業務經理", "imap://2")
    assert people["5"]["company_name"] == "No Answer Co" and people["9"]["company_name"] == "Harbour 中文" and people["9"]["website"] == "https://html.tw"
    told = inbox.summary(box, sent).first()
    assert tuple(told) == (9, 2, 3, 1, 3, 1)


def test_nothing_is_parsed_again(box, sent):
    for df in (inbox.bounces(box, sent), inbox.answers(box, sent), inbox.contacts(box), inbox.summary(box, sent)):
        assert "MapInPandas" not in df._jdf.queryExecution().toString()


def test_strange_charsets_in_bounces(spark, sent):
    raw = b"From: mailer-daemon@b.tw\r\nSubject: =?x-none?Q?=E9?= returned mail\r\nContent-Type: text/plain; charset=x-none\r\n\r\n5.1.1 one@sent.tw \xe9"
    assert [r["address"] for r in mail.bounces(spark.createDataFrame([("1", raw)], "uid string, raw binary"), sent).collect()] == ["one@sent.tw"]
