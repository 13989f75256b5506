"""Rules over messages as data: registries, the usual rules, lists of senders, replies and folders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.mail import ADDRESS, Rule, has_flag, header, is_in

#: Words of the usual rules. Every list can be given in its place.
WORDS = {
    "taxes": ["tax.example", "finance.example"],
    "payments": ["service@pay.", "member@pay.", "notifications@card.", "support@card."],
    "invoices": ["confirmation", "invoice", "billing", "receipt", "order", "facture", "commande"],
    "security_sender": ["account"],
    "security": ["account", "password", "security", "verify", "login", "code", "compte", "mot de passe", "identifiant", "sécurité", "vérifier"],
    "conditions": ["conditions"],
    "notifications": ["no-reply", "noreply", "no_reply", "autoreply", "notification", "cpanel@", "wordpress@", "ne-pas-repondre", "ne_pas_repondre", "nepasrepondre"],
}
SOCIAL = {"notification@chat.example": "Social.Chat", "no-reply@shop.example": "Social.Shop"}
_FILE = r"^(LEARN|[0-9]{2})-([a-z]+)-(.+)\.py$"


def registry(files: DataFrame) -> DataFrame:
    """``priority``, ``protocol``, ``name``, ``path``: the rules that file names declare.

    ``files`` has ``path`` and ``local``. Names are ``NN-protocol-name.py``;
    of one priority and protocol a local file takes the place of a common
    one, the first name among equals. Those that learn come last, numbered on.
    """
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.regexp_extract(name, _FILE, i)
    rows = files.where(name.rlike(_FILE)).select("path", "local", part(1).alias("mark"), part(2).alias("protocol"), part(3).alias("name"))
    numbered = rows.where("mark <> 'LEARN'").withColumn("priority", F.col("mark").cast("int"))
    best = Window.partitionBy("priority", "protocol").orderBy(F.desc("local"), "name")
    kept = numbered.withColumn("n", F.row_number().over(best)).where("n = 1")
    learning = rows.where("mark = 'LEARN'").withColumn("priority", F.lit(99) + F.row_number().over(Window.orderBy("name", F.desc("local"), "path")))
    columns = ["priority", "protocol", "name", "path"]
    return kept.select(*columns).unionByName(learning.select(*columns))


def first_attachment(attachments: Column) -> Column:
    """The first attachment that has a name; null without one."""
    return F.try_element_at(F.filter(attachments, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def with_context(mails: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Messages with what rules need to know beyond them.

    ``parent_mailer`` and ``grandparent``: what sent the message that is
    answered, and what that one answers. ``busy_unread``, ``busy_flagged``:
    counts of the folder. ``white`` and ``black``: whether ``lists``
    (``kind``, ``value``, ``status``) knows a sender or an IP of the message.
    """
    parent = mails.select(F.col("message_id").alias("in_reply_to"), header(F.col("headers"), "x-mailer").alias("parent_mailer"), F.col("in_reply_to").alias("grandparent"))
    counts = mails.groupBy("folder").agg(F.count_if(~has_flag(F.col("flags"), "Seen")).alias("busy_unread"), F.count_if(has_flag(F.col("flags"), "Flagged")).alias("busy_flagged"))
    out = mails.join(parent, "in_reply_to", "left").join(counts, "folder")
    if lists is None:
        return out.withColumns({"white": F.lit(False), "black": F.lit(False)})
    known = correspondents(mails).join(lists, ["kind", "value"]).groupBy("message_id").agg(F.bool_or(F.col("status") == "white").alias("white"), F.bool_or(F.col("status") == "black").alias("black"))
    return out.join(known, "message_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("white", "black")})


def usual_rules(now: Column, leave: tuple[Column, Column] | None = None, words: dict[str, list[str]] | None = None, mailer: str = "folioflow", social: dict[str, str] | None = None) -> list[Rule]:
    """The usual rules over messages with context, in order of priority."""
    w, h = WORDS | (words or {}), F.col("headers")
    unread, age = ~has_flag(F.col("flags"), "Seen"), F.unix_seconds(now) - F.unix_seconds("date")
    bulk, unsubscribe = header(h, "precedence") == "bulk", header(h, "list-unsubscribe") != ""
    urgent = is_in(["URGENT"], F.col("body"), case_sensitive=True)
    first = F.lit(None).cast("string")
    for needle, folder in reversed(list((SOCIAL if social is None else social).items())):
        first = F.when(F.contains(F.lower("sender"), F.lit(needle)), F.lit(folder)).otherwise(first)
    start, stop = leave or (F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    return [
        Rule("spam", 0, ~F.col("white") & (F.col("black") | (header(h, "x-spam-flag") == "YES") | (bulk & ~unsubscribe)), "spam"),
        Rule("taxes", 1, is_in(w["taxes"], F.col("sender")), "move:Money.Taxes"),
        Rule("payments", 2, is_in(w["payments"], F.col("sender")), "move:Money.Payments"),
        Rule("invoices", 3, is_in(w["invoices"], F.col("subject")), "move:Money.Invoices"),
        Rule("security", 4, is_in(w["security_sender"], F.col("sender")) | is_in(w["security"], F.col("subject")), "move:Services.Accounts", -1),
        Rule("conditions", 5, is_in(w["conditions"], F.col("subject")), "move:Services.Conditions"),
        Rule("rsvp", 6, F.lower(first_attachment(F.col("attachments"))).endswith(".ics"), "tag:RSVP"),
        Rule("newsletters", 7, bulk | unsubscribe, "move:Newsletters", -1),
        Rule("social", 9, first.isNotNull(), "move:Social"),
        Rule("notifications", 10, is_in(w["notifications"], F.col("sender")), "move:Services.Notifications", -1),
        Rule("absence", 30, (F.col("date") > start) & (F.col("date") < stop) & unread, "reply:absence"),
        Rule("busy", 31, (age <= 86_400) & unread & ((F.col("busy_unread") > 10) | (F.col("busy_flagged") > 5)) & ~F.array_contains(F.split("flags", " "), "Leave") & ~urgent, "reply:busy"),
        Rule("urgent", 32, (age <= 7 * 86_400) & (header(h, "references") != "") & urgent & (F.col("parent_mailer") == mailer), "flag:grandparent"),
        Rule("unsubscribe", 98, unsubscribe, "unsubscribe", -1),
    ]


def unsubscribe_ways(mails: DataFrame) -> DataFrame:
    """``message_id``, ``way`` and ``address``: every address by which a mailing can be ended."""
    ways = F.transform(F.split(header(F.col("headers"), "list-unsubscribe"), ","), lambda x: F.regexp_extract(x, "<([^>]+)>", 1))
    rows = mails.select("message_id", F.explode(F.filter(ways, lambda x: x != "")).alias("address"))
    return rows.select("message_id", F.when(F.lower("address").startswith("mailto:"), "mail").otherwise("web").alias("way"), "address")


IP = r"\[(?:IPv6:)?((?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})\]"
_LOCAL = r"^(127\.|192\.168\.|10\.|fe80:)"


def hops(received: Column) -> Column:
    """The way of a message, first sender first: hosts and addresses of both ends and the envelope's sender of each hop."""
    def host(h: Column, word: str) -> Column:
        name = F.regexp_extract(h, rf"(?i)(?:^|\s){word}\s+\[?([\w.-]+)", 1)
        return F.when(name.rlike(rf"^localhost|{_LOCAL}"), "localhost").otherwise(name)

    def end(h: Column, word: str, until: str) -> Column:
        piece = F.regexp_extract(h, rf"(?is)(?:^|\s){word}\s+(.*?)(?=\s(?:{until})\s|;|$)", 1)
        ips = F.filter(F.regexp_extract_all(piece, F.lit(IP), F.lit(1)), lambda x: ~x.rlike(_LOCAL))
        return F.struct(ips.alias("ip"), host(h, word).alias("domain"))

    hop = lambda h: F.struct(end(h, "from", "by|with|for").alias("from"), end(h, "by", "with|for|from|id").alias("by"), F.regexp_extract_all(h, F.lit(r"(?i)envelope-from <([^>]+)>"), F.lit(1)).alias("envelope_from"))
    return F.reverse(F.transform(received, hop))


def correspondents(mails: DataFrame) -> DataFrame:
    """``message_id``, ``kind`` (``ip`` or ``mail``) and ``value``: who each message came from and by."""
    ips = F.array_distinct(F.flatten(F.transform(hops(F.col("received")), lambda h: h["from"]["ip"])))
    people = F.array_distinct(F.transform(F.regexp_extract_all("sender", F.lit(ADDRESS), F.lit(0)), lambda x: F.lower(x)))
    both = F.concat(F.transform(ips, lambda v: F.struct(F.lit("ip").alias("kind"), v.alias("value"))), F.transform(people, lambda v: F.struct(F.lit("mail").alias("kind"), v.alias("value"))))
    return mails.select("message_id", F.explode(both).alias("c")).select("message_id", "c.kind", "c.value")


def fold_lists(mails: DataFrame, lists: DataFrame, junk: str = "Junk", own: Iterable[str] = ()) -> DataFrame:
    """``kind``, ``value``, ``status`` after the junk folder and then all others are read.

    Junk turns the unknown black; what is white loses its place once and
    turns black after that (addresses keep it, as they are forged). Other
    folders clear what is black once and make it white after that; the
    unknown becomes white. Only how often a value occurs matters, so the
    fold is one aggregate. ``status`` of ``lists`` is ``white``, ``black`` or
    ``both``; values that end in no list have no row. Messages of ``own``
    addresses tell nothing.
    """
    mine = F.exists(F.transform(F.regexp_extract_all("sender", F.lit(ADDRESS), F.lit(0)), F.lower), lambda x: x.isin(*own)) if own else F.lit(False)
    seen = correspondents(mails.where(~mine)).join(mails.select("message_id", (F.col("folder") == junk).alias("junk")), "message_id")
    counts = seen.groupBy("kind", "value").agg(F.count_if("junk").alias("m"), F.count_if(~F.col("junk")).alias("n"))
    both = counts.join(lists, ["kind", "value"], "full")
    m, n, s = F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0)), F.coalesce("status", F.lit("none"))
    shaken = (s == "both") | ((s == "white") & (F.col("kind") == "ip"))
    after = F.when(m == 0, s).when(s == "none", "black").when(shaken, F.when(m == 1, "none").otherwise("black")).otherwise(s)
    last = F.when(n == 0, after).when(after.isin("black", "both"), F.when(n == 1, "none").otherwise("white")).otherwise("white")
    return both.select("kind", "value", last.alias("status")).where("status <> 'none'")


def scored(headers_status: Column, known: dict[str, int], age_days: Column) -> Column:
    """The points of a verdict; failures of messages older than 180 days count for nothing."""
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.lower(headers_status)), F.lit(0))
    return F.when((points < 0) & (age_days > 180), 0).otherwise(points)


SPF = {"none": 0, "neutral": 1, "pass": 2, "temperror": 0, "permerror": 0, "softfail": -1, "fail": -2}
SIGNED = {"none": 0, "expired": 1, "pass": 2, "fail": -2}


def authenticity(spf: Column, dkim: Column, arc: Column, age_days: Column) -> Column:
    """The sum of the points of the three checks' verdicts, -6 to 6; 0 or more is authentic."""
    return scored(spf, SPF, age_days) + scored(dkim, SIGNED, age_days) + scored(arc, SIGNED, age_days)


def contact_of(mails: DataFrame, contacts: DataFrame) -> DataFrame:
    """``message_id`` and the ``uid`` and ``name`` of the contacts that have one of the sender's addresses."""
    book = contacts.select("uid", "name", F.explode("emails").alias("value")).distinct()
    return correspondents(mails).where("kind = 'mail'").join(book, "value").select("message_id", "uid", "name").distinct()


def reply(mails: DataFrame, body: Column, sender: str) -> DataFrame:
    """Answers to messages as rows for a sink: subject, thread and references follow from the message."""
    subject = F.when(F.col("subject").startswith("Re:"), F.col("subject")).otherwise(F.concat(F.lit("Re: "), "subject"))
    refs = F.trim(F.concat_ws(" ", F.nullif(header(F.col("headers"), "references"), F.lit("")), "message_id"))
    return mails.select(F.lit(sender).alias("sender"), F.col("sender").alias("recipient"), subject.alias("subject"), F.col("message_id").alias("in_reply_to"), refs.alias("references"), body.alias("body"))


def folders(lines: DataFrame, line: str = "line") -> DataFrame:
    """``name``, ``separator`` and ``use`` of the folders that a server lists."""
    g = lambda i: F.regexp_extract(line, r'^(?:\* LIST )?\(([^)]*)\) "?([^" ]+)"? "?([^"]+?)"?\s*$', i)
    use = F.regexp_extract(g(1), r"\\(All|Archive|Drafts|Flagged|Junk|Sent|Trash)\b", 1)
    return lines.where(F.col(line).rlike(r"\([^)]*\) ")).select(g(3).alias("name"), g(2).alias("separator"), F.nullif(use, F.lit("")).alias("use"))


def folder_path(parts: Column, separator: str = ".") -> Column:
    """A folder's name from its parts, the inbox as the first."""
    named = F.when(F.upper(parts[0]) == "INBOX", parts).otherwise(F.concat(F.array(F.lit("INBOX")), parts))
    return F.array_join(named, separator)


def newest(mails: DataFrame, n: int, by: str = "uid") -> DataFrame:
    """The newest ``n`` messages; the limit is the feature."""
    return mails.orderBy(F.desc(by)).limit(n)


def uid_and_flags(raw: Column) -> Column:
    """The number and the flags in a server's answer."""
    number = F.regexp_extract(raw, r"UID (\d+)", 1)
    return F.struct(F.nullif(number, F.lit("")).cast("bigint").alias("uid"), F.regexp_extract(raw, r"FLAGS \(([^)]*)\)", 1).alias("flags"))


def social_messages(media: DataFrame) -> DataFrame:
    """Media with nested comments and replies as messages: each answers the one above it.

    ``media`` has ``id``, ``caption``, ``owner``, ``time`` and ``comments``,
    which have ``id``, ``text``, ``user``, ``time`` and ``replies`` of the same.
    """
    ident = lambda c: F.concat(F.lit("<"), c, F.lit("@social>"))
    row = lambda i, p, who, text, when: [ident(i).alias("message_id"), p.alias("in_reply_to"), who.alias("sender"), F.substring(F.coalesce(text, F.lit("")), 1, 80).alias("subject"), text.alias("body"), when.alias("date")]
    none = F.lit(None).cast("string")
    top = media.select(*row(F.col("id"), none, F.col("owner"), F.col("caption"), F.col("time")))
    c = media.select("id", F.explode("comments").alias("c"))
    comments = c.select(*row(F.col("c.id"), ident(F.col("id")), F.col("c.user"), F.col("c.text"), F.col("c.time")))
    r = c.select("c.id", F.explode("c.replies").alias("r"))
    return top.unionAll(comments).unionAll(r.select(*row(F.col("r.id"), ident(F.col("id")), F.col("r.user"), F.col("r.text"), F.col("r.time"))))
