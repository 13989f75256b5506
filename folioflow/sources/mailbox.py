"""Messages: files of mail as a data source, and ``conversations`` dressed as a mailbox with headers."""

from __future__ import annotations

import glob
import mailbox as boxes
import os
import re
from email import message_from_bytes, policy
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflow.sources.pages import read

MESSAGE = "message_id string, in_reply_to string, references string, sender string, recipients string, subject string, date string, headers map<string,string>, received array<string>, attachments array<string>, html string, plain string, flags string, uid long, folder string"


def read_message(raw: bytes, uid: int, folder: str) -> tuple:
    """One message as a row of ``MESSAGE``: header names in lower case, the last of a name counts.

    An attachment without a name is a null among the others.
    """
    m: EmailMessage = message_from_bytes(raw, policy=policy.default)
    headers = {k.lower(): str(v) for k, v in m.items()}

    def body(kind: str) -> str | None:
        part = m.get_body((kind,))
        try:
            return part.get_content() if part else None
        except (LookupError, UnicodeError):
            return None

    flags = " ".join(f"\\{name}" for letter, name in zip("RAFTD", ("Seen", "Answered", "Flagged", "Deleted", "Draft"), strict=True) if letter in f"{m.get('Status', '')}{m.get('X-Status', '')}")
    return (
        headers.get("message-id"), headers.get("in-reply-to"), headers.get("references"), headers.get("from", ""), headers.get("to", ""), headers.get("subject", ""), headers.get("date"),
        headers, [str(x) for x in m.get_all("received", [])], [p.get_filename() for p in m.iter_attachments()], body("html"), body("plain"), flags, uid, folder,
    )


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _MailReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        found = sorted(glob.glob(self.path) if any(c in self.path for c in "*?[") else glob.glob(f"{self.path}/**/*", recursive=True) if os.path.isdir(self.path) else [self.path])
        return [_File(p) for p in found if os.path.isfile(p)]

    def read(self, partition: _File):
        name = os.path.splitext(os.path.basename(partition.path))[0]
        if partition.path.endswith(".mbox"):
            for uid, m in enumerate(boxes.mbox(partition.path, create=False), 1):
                yield read_message(m.as_bytes(), uid, name)
        else:
            with open(partition.path, "rb") as f:
                yield read_message(f.read(), 1, os.path.basename(os.path.dirname(partition.path)))


class MailFiles(DataSource):
    """``spark.read.format("mailfiles").load(path)``: ``.eml`` and ``.mbox`` files, a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> DataSourceReader:
        return _MailReader(self.options["path"])


CARD = "uid string, name string, emails array<string>, properties map<string,array<string>>"


def read_cards(text: str) -> list[tuple]:
    """The contacts of a vCard file: folded lines joined, parameters left out, values by property in lower case."""
    out = []
    for block in re.findall(r"(?is)BEGIN:VCARD\s*\n(.*?)END:VCARD", re.sub(r"\r\n?", "\n", text)):
        found: dict[str, list[str]] = {}
        for line in re.sub(r"\n[ \t]", "", block).split("\n"):
            head, mark, value = line.partition(":")
            if mark:
                name = head.split(";")[0].split(".")[-1].strip().lower()
                values = value.split(",") if name in ("categories", "nickname") else [value]
                found.setdefault(name, []).extend(v.strip().replace("\\,", ",").replace("\\n", "\n") for v in values)
        first = lambda k, f=found: f.get(k, [None])[0]
        out.append((first("uid"), first("fn"), [e.lower() for e in found.get("email", [])], found))
    return out


class _CardReader(_MailReader):
    def read(self, partition: _File):
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from read_cards(f.read())


class Contacts(DataSource):
    """``spark.read.format("contacts").load(path)``: vCard files, a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "contacts"

    def schema(self) -> str:
        return CARD

    def reader(self, schema) -> DataSourceReader:
        return _CardReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the file formats of this module known to a session."""
    for source in (MailFiles, Contacts):
        spark.dataSource.register(source)


SENDERS = ["Ann Lee <ann@example.org>", "Billing <service@pay.example>", "No Reply <no-reply@shop.example>", "Account Team <account@bank.example>", "Chat <notification@chat.example>", "Tax Office <info@tax.example>", "System <system@example.org>", "News <news@letters.example>"]
SUBJECTS = ["Hello again", "Invoice of the month", "New conditions of use", "Verify your login", "Re: plan", "Weekly letter", "Meeting", "Order confirmation", "A question"]


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a mailbox: headers, routes, flags, attachments and folders that follow from the numbers of conversation and turn."""
    c = read(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    ident = lambda x: F.concat(F.lit("<"), n.cast("string"), F.lit("."), x.cast("string"), F.lit("@mail>"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    k = F.pmod(n * 5 + t * 3, F.lit(16))
    last = F.pmod(n + t, F.lit(200)).cast("string")
    refs = F.when(t > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(t - 1, F.lit(0).cast("bigint"))), ident), " "))
    given = {
        "list-unsubscribe": F.when(F.pmod(k, F.lit(4)) == 3, "<mailto:off@letters.example>, <https://letters.example/off>"),
        "precedence": F.when(F.pmod(k, F.lit(8)) == 3, "bulk").when(F.pmod(k, F.lit(8)) == 7, "list").when(k == 5, "bulk"),
        "list-id": F.when(k == 3, "<news.letters.example>"),
        "x-spam-flag": F.when(F.pmod(n, F.lit(13)) == 0, "YES"),
        "x-mailer": F.when(F.col("role") == "assistant", "folioflow"),
        "references": refs,
    }
    every = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(h).alias("k"), v.alias("v")) for h, v in given.items()]), lambda e: e["v"].isNotNull()))
    hop = lambda host, net, by: F.concat(F.lit(f"from {host} ({host} ["), F.lit(net), last, F.lit(f"]) by {by} with SMTP id 7 (envelope-from <bounce@{host}>) for <me@example.net>; Mon, 1 Jan 2024 00:00:00 +0000"))
    flags = F.concat_ws(" ", F.when(F.pmod(t, F.lit(2)) == 0, r"\Seen"), F.when(F.pmod(n, F.lit(5)) == 0, r"\Flagged"), F.when(F.pmod(n, F.lit(7)) == 0, "Leave"))
    return c.select(
        ident(t).alias("message_id"), F.when(t > 0, ident(t - 1)).alias("in_reply_to"), pick(SENDERS, n * 3 + t).alias("sender"), pick(SUBJECTS, n + t * 2).alias("subject"), F.col("text").alias("body"),
        every.alias("headers"), F.array(hop("mx.example.org", "203.0.113.", "in.example.net"), hop("host.sender.example", "198.51.100.", "mx.example.org")).alias("received"), flags.alias("flags"),
        F.when(F.pmod(n, F.lit(6)) == 0, F.array(F.lit(None).cast("string"), F.lit("invite.ics"))).when(F.pmod(n, F.lit(6)) == 1, F.array(F.lit("notes.txt"), F.lit("other.ics"))).otherwise(F.array().cast("array<string>")).alias("attachments"),
        F.timestamp_seconds(F.lit(1_704_067_200) + n * 3600 + t * 60).alias("date"), F.when(F.pmod(n, F.lit(11)) == 0, "Junk").otherwise("INBOX").alias("folder"), n.alias("conv_id"), t.alias("turn"), F.col("role"),
    )


def _picked(values: list[str], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(({k}) % {len(values)} + 1)::INT]"


#: The same view for DuckDB; headers are columns of their own.
SQL_DRESSED = rf"""dressed AS (SELECT *, CASE WHEN k % 4 = 3 THEN '<mailto:off@letters.example>, <https://letters.example/off>' END AS h_unsubscribe,
  CASE WHEN k % 8 = 3 OR k = 5 THEN 'bulk' WHEN k % 8 = 7 THEN 'list' END AS h_precedence, CASE WHEN k = 3 THEN '<news.letters.example>' END AS h_list_id,
  CASE WHEN conv_id % 13 = 0 THEN 'YES' END AS h_spam, CASE WHEN role = 'assistant' THEN 'folioflow' END AS h_mailer, turn > 0 AS has_references
  FROM (SELECT conv_id, turn, role, text AS body, (conv_id * 5 + turn * 3) % 16 AS k, '<' || conv_id || '.' || turn || '@mail>' AS message_id,
  CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@mail>' END AS in_reply_to, {_picked(SENDERS, "conv_id * 3 + turn")} AS sender, {_picked(SUBJECTS, "conv_id + turn * 2")} AS subject,
  turn % 2 = 0 AS seen, conv_id % 5 = 0 AS flagged, conv_id % 7 = 0 AS on_leave, CASE WHEN conv_id % 6 = 0 THEN 'invite.ics' WHEN conv_id % 6 = 1 THEN 'notes.txt' END AS first_named,
  (TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT)) AS date, CASE WHEN conv_id % 11 = 0 THEN 'Junk' ELSE 'INBOX' END AS folder, (conv_id + turn) % 200 AS last_octet FROM conversations))"""
