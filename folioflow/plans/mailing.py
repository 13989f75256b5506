"""Queries over messages, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import dates
from folioflow.functions import tokens as K
from folioflow.operators import mail, mailrules
from folioflow.plans.registered import query
from folioflow.sources.mailbox import SQL_DRESSED, dressed

NOW = "2024-01-05 00:00:00"
_LEAVE = ("2024-01-02 00:00:00", "2024-01-03 12:00:00")
_W = mailrules.WORDS
_has = lambda words, field: "(" + " OR ".join(f"contains(lower({field}), '{w}')" for w in words) + ")"
_CONTEXT = f"""{SQL_DRESSED}, ctx AS (SELECT d.*, p.h_mailer AS parent_mailer, busy_unread, busy_flagged, epoch(TIMESTAMP '{NOW}' - d.date) AS age FROM dressed d LEFT JOIN (SELECT message_id, h_mailer FROM dressed) p ON d.in_reply_to = p.message_id
JOIN (SELECT folder, count(*) FILTER (NOT seen) AS busy_unread, count(*) FILTER (flagged) AS busy_flagged FROM dressed GROUP BY folder) USING (folder)),
lists(kind, value, status) AS (VALUES ('mail', 'ann@example.org', 'white'), ('mail', 'news@letters.example', 'black'), ('ip', '203.0.113.7', 'white'), ('ip', '198.51.100.9', 'black'), ('mail', 'info@tax.example', 'both')),
who AS (SELECT message_id, 'ip' AS kind, unnest(['203.0.113.' || last_octet, '198.51.100.' || last_octet]) AS value FROM dressed UNION ALL SELECT message_id, 'mail', lower(regexp_extract(sender, '<([^>]+)>', 1)) FROM dressed),
known AS (SELECT message_id, bool_or(status = 'white') AS white, bool_or(status = 'black') AS black FROM who JOIN lists USING (kind, value) GROUP BY message_id),
r AS (SELECT ctx.*, coalesce(white, false) AS white, coalesce(black, false) AS black FROM ctx LEFT JOIN known USING (message_id))"""
_RULES = {
    "spam": "NOT white AND (black OR h_spam = 'YES' OR (h_precedence = 'bulk' AND h_unsubscribe IS NULL))",
    "taxes": _has(_W["taxes"], "sender"),
    "payments": _has(_W["payments"], "sender"),
    "invoices": _has(_W["invoices"], "subject"),
    "security": f"{_has(_W['security_sender'], 'sender')} OR {_has(_W['security'], 'subject')}",
    "conditions": _has(_W["conditions"], "subject"),
    "rsvp": "ends_with(lower(first_named), '.ics')",
    "newsletters": "h_precedence = 'bulk' OR h_unsubscribe IS NOT NULL",
    "social": _has(list(mailrules.SOCIAL), "sender"),
    "notifications": _has(_W["notifications"], "sender"),
    "absence": f"date > TIMESTAMP '{_LEAVE[0]}' AND date < TIMESTAMP '{_LEAVE[1]}' AND NOT seen",
    "busy": "age <= 86400 AND NOT seen AND (busy_unread > 10 OR busy_flagged > 5) AND NOT on_leave AND NOT contains(body, 'URGENT')",
    "urgent": "age <= 604800 AND has_references AND contains(body, 'URGENT') AND parent_mailer = 'folioflow'",
    "unsubscribe": "h_unsubscribe IS NOT NULL",
}


def _lists(spark):
    rows = [("mail", "ann@example.org", "white"), ("mail", "news@letters.example", "black"), ("ip", "203.0.113.7", "white"), ("ip", "198.51.100.9", "black"), ("mail", "info@tax.example", "both")]
    return spark.createDataFrame(rows, "kind string, value string, status string")


@query(f"WITH {_CONTEXT} {' UNION ALL '.join(f'SELECT message_id, {chr(39)}{k}{chr(39)} AS rule FROM r WHERE coalesce({v}, false)' for k, v in _RULES.items())}")
def usual_rules(spark, sf_dir):
    """The usual rules over all messages."""
    m = mailrules.with_context(dressed(spark, sf_dir), _lists(spark))
    at = lambda t: F.lit(t).cast("timestamp")
    rules = mailrules.usual_rules(at(NOW), leave=(at(_LEAVE[0]), at(_LEAVE[1])))
    state = spark.createDataFrame([], "message_id string, rule string, processed long")
    return mail.run_rules(m, rules, state).select("message_id", "rule")


@query(f"WITH {_CONTEXT} SELECT message_id, kind, value FROM who")
def correspondents(spark, sf_dir):
    """The addresses of every message's way and senders."""
    return mailrules.correspondents(dressed(spark, sf_dir))


@query(
    f"""WITH {_CONTEXT}, c AS (SELECT kind, value, count(*) FILTER (folder = 'Junk') AS m, count(*) FILTER (folder <> 'Junk') AS n FROM who JOIN dressed USING (message_id) GROUP BY ALL),
b AS (SELECT kind, value, coalesce(m, 0) AS m, coalesce(n, 0) AS n, coalesce(status, 'none') AS s FROM c FULL JOIN lists USING (kind, value)),
j AS (SELECT *, CASE WHEN m = 0 THEN s WHEN s = 'none' THEN 'black' WHEN s = 'both' OR (s = 'white' AND kind = 'ip') THEN CASE WHEN m = 1 THEN 'none' ELSE 'black' END ELSE s END AS a FROM b),
z AS (SELECT kind, value, CASE WHEN n = 0 THEN a WHEN a IN ('black', 'both') THEN CASE WHEN n = 1 THEN 'none' ELSE 'white' END ELSE 'white' END AS status FROM j) SELECT * FROM z WHERE status <> 'none'"""
)
def folded_lists(spark, sf_dir):
    """White and black lists after all folders have been read."""
    return mailrules.fold_lists(dressed(spark, sf_dir), _lists(spark))


@query(f"WITH {SQL_DRESSED} SELECT message_id, h_unsubscribe IS NOT NULL AND h_precedence = 'list' AS mailing_list, h_unsubscribe IS NOT NULL AND (h_list_id IS NOT NULL OR coalesce(h_precedence = 'bulk', false)) AS newsletter, seen, flagged, NOT seen AS unread, on_leave AS tagged, first_named AS attachment FROM dressed")
def mail_predicates(spark, sf_dir):
    """What headers, flags and attachments tell."""
    m, h, flag = dressed(spark, sf_dir), F.col("headers"), lambda name: mail.has_flag(F.col("flags"), name)
    return m.select("message_id", mail.is_mailing_list(h).alias("mailing_list"), mail.is_newsletter(h).alias("newsletter"), flag("Seen").alias("seen"), flag("Flagged").alias("flagged"), (~flag("Seen")).alias("unread"), F.array_contains(F.split("flags", " "), "Leave").alias("tagged"), mailrules.first_attachment(F.col("attachments")).alias("attachment"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, 'mail' AS way, 'mailto:off@letters.example' AS address FROM dressed WHERE h_unsubscribe IS NOT NULL UNION ALL SELECT message_id, 'web', 'https://letters.example/off' FROM dressed WHERE h_unsubscribe IS NOT NULL")
def unsubscribe_ways(spark, sf_dir):
    """How mailings can be ended."""
    return mailrules.unsubscribe_ways(dressed(spark, sf_dir))


@query(f"WITH {SQL_DRESSED}, book(uid, name, emails) AS (VALUES ('1', 'Ann', ['ann@example.org', 'ann@home.example']), ('2', 'Bank', ['account@bank.example']), ('3', 'Nobody', []::VARCHAR[])) SELECT message_id, uid, name FROM dressed JOIN book ON list_contains(emails, lower(regexp_extract(sender, '<([^>]+)>', 1)))")
def contact_lookup(spark, sf_dir):
    """Messages with the contacts that have one of the sender's addresses."""
    book = spark.createDataFrame([("1", "Ann", ["ann@example.org", "ann@home.example"]), ("2", "Bank", ["account@bank.example"]), ("3", "Nobody", [])], "uid string, name string, emails array<string>")
    return mailrules.contact_of(dressed(spark, sf_dir), book)


@query(f"WITH {SQL_DRESSED} SELECT 'me@example.net' AS sender, sender AS recipient, CASE WHEN starts_with(subject, 'Re:') THEN subject ELSE 'Re: ' || subject END AS subject, message_id AS in_reply_to, array_to_string(list_transform(range(0, turn + 1), lambda t: '<' || conv_id || '.' || t || '@mail>'), ' ') AS \"references\", 'Got it: ' || subject AS body FROM dressed WHERE NOT seen")
def replies(spark, sf_dir):
    """Answers to all unread messages, ready for a sink."""
    m = dressed(spark, sf_dir).where(~mail.has_flag(F.col("flags"), "Seen"))
    return mailrules.reply(m, F.concat(F.lit("Got it: "), "subject"), "me@example.net")


@query(f"WITH {SQL_DRESSED} SELECT d.message_id, p.message_id AS ancestor, (d.turn - p.turn)::BIGINT AS distance FROM dressed d JOIN dressed p ON d.conv_id = p.conv_id AND p.turn < d.turn")
def mail_ancestors(spark, sf_dir):
    """Every message that a message refers to and that is there, nearest first."""
    m = dressed(spark, sf_dir)
    named = m.select("message_id", F.posexplode(mail.references(mail.header(F.col("headers"), "references"))).alias("place", "ancestor"))
    return named.join(m.select(F.col("message_id").alias("ancestor")), "ancestor").select("message_id", "ancestor", (F.col("place") + 1).cast("bigint").alias("distance"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, epoch(date)::BIGINT || '-' || md5(message_id) AS hash, round(epoch(TIMESTAMP '{NOW}' - date) / 86400, 6) AS age, CASE conv_id % 3 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN epoch(TIMESTAMP '{NOW}' - date) / 86400 > 180 THEN 0 ELSE -2 END ELSE 0 END + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS score FROM dressed")
def mail_identity(spark, sf_dir):
    """Stable hashes, ages, and points of given verdicts."""
    m = dressed(spark, sf_dir)
    age = dates.age_days(F.col("date"), F.lit(NOW).cast("timestamp"))
    spf = F.element_at(F.array(F.lit("pass"), F.lit("fail"), F.lit("none")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    dkim = F.when(F.pmod("turn", F.lit(2)) == 0, "expired").otherwise("none")
    return m.select("message_id", mail.message_hash(F.col("date"), F.lit(""), F.col("message_id")).alias("hash"), F.round(age, 6).alias("age"), mailrules.authenticity(spf, dkim, F.lit("none"), age).alias("score"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, CASE turn % 4 WHEN 0 THEN date_trunc('second', date) WHEN 1 THEN date_trunc('day', date) WHEN 2 THEN date ELSE TIMESTAMP '1970-01-01' END AS sent FROM dressed")
def mail_dates(spark, sf_dir):
    """Dates of messages: the header in either form, the delivery, the epoch."""
    m, t = dressed(spark, sf_dir), F.pmod("turn", F.lit(4))
    form = lambda p: F.date_format("date", p)
    stated = F.when(t == 0, F.concat(form("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(t == 1, form("dd-MM-yyyy"))
    both = F.map_from_entries(F.filter(F.array(F.struct(F.lit("date").alias("k"), stated.alias("v")), F.struct(F.lit("delivery-date").alias("k"), F.when(t == 2, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("v"))), lambda e: e["v"].isNotNull()))
    return m.select("message_id", dates.mail_date(both).cast("timestamp_ntz").alias("sent"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, date::TIMESTAMP AS date FROM dressed ORDER BY date DESC, message_id LIMIT 25")
def newest_mails(spark, sf_dir):
    """L1: the newest messages; the limit is the feature."""
    return dressed(spark, sf_dir).orderBy(F.desc("date"), "message_id").limit(25).select("message_id", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, folder, 'INBOX.' || folder || '.' || role AS path, len(string_split(folder || '/' || role, '/'))::BIGINT AS depth, [folder, folder || '/' || role] AS prefixes FROM dressed WHERE folder <> 'INBOX'")
def mail_folders(spark, sf_dir):
    """Folder names from parts, and every folder on the way."""
    m = dressed(spark, sf_dir).where("folder <> 'INBOX'")
    full = F.concat("folder", F.lit("/"), "role")
    return m.select("message_id", "folder", mailrules.folder_path(F.array("folder", "role")).alias("path"), F.size(mail.folder_prefixes(full)).cast("bigint").alias("depth"), mail.folder_prefixes(full).alias("prefixes"))


@query("SELECT '<m' || conv_id || '@social>' AS message_id, NULL AS in_reply_to, 'user0' AS sender, text AS body FROM conversations WHERE turn = 0 UNION ALL SELECT '<c' || conv_id || '.' || turn || '@social>', '<m' || conv_id || '@social>', role, text FROM conversations WHERE turn = 1 UNION ALL SELECT '<r' || conv_id || '.' || r.turn || '@social>', '<c' || conv_id || '.1@social>', r.role, r.text FROM conversations r WHERE turn > 1")
def social_messages(spark, sf_dir):
    """Media with comments and replies as messages."""
    from folioflow.sources.pages import read

    c = read(spark, sf_dir, "conversations")
    ident = lambda letter: F.concat(F.lit(letter), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    said = F.collect_list(F.when(F.col("turn") > 1, F.struct(ident("r").alias("id"), "text", F.col("role").alias("user"), F.lit(None).cast("timestamp").alias("time"))))
    one = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("caption"), said.alias("replies"), F.max(F.when(F.col("turn") == 1, F.struct(ident("c").alias("id"), "text", F.col("role").alias("user")))).alias("c"))
    comment = F.struct(F.col("c.id").alias("id"), F.col("c.text").alias("text"), F.col("c.user").alias("user"), F.lit(None).cast("timestamp").alias("time"), "replies")
    none = F.slice(F.array(comment), 1, F.when(F.col("c").isNotNull(), 1).otherwise(0))
    media = one.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("id"), "caption", F.lit("user0").alias("owner"), F.lit(None).cast("timestamp").alias("time"), none.alias("comments"))
    return mailrules.social_messages(media).select("message_id", "in_reply_to", "sender", "body")


@query("SELECT doc_id, regexp_extract_all(text, 'https?://[^\\s<>\"'')]+') AS links FROM documents WHERE regexp_matches(text, 'https?://[^\\s<>\"'')]+')")
def body_links(spark, sf_dir):
    """Web addresses in texts."""
    from folioflow.sources.pages import read

    return read(spark, sf_dir, "documents").where(F.col("text").rlike(mail.LINK)).select("doc_id", mail.links(F.col("text")).alias("links"))


@query(f"WITH {SQL_DRESSED} SELECT message_id, folder FROM dressed")
def folder_codec(spark, sf_dir):
    """Folder names through the UTF-7 of IMAP and back; each comes back as it was."""
    m = dressed(spark, sf_dir).select("message_id", F.concat("folder", F.lit(" & Größe ✓")).alias("name"))
    return m.select("message_id", F.regexp_replace(K.decode_folder(K.encode_folder(F.col("name"))), " & Größe ✓$", "").alias("folder"))
