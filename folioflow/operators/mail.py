"""Rules over messages: predicates, threads, routes, and runs with counted state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A predicate, what to do where it holds, and how often; ``runs`` below 0 is without limit."""

    name: str
    priority: int
    predicate: Column
    action: str
    runs: int = 1


def is_in(needles: list[str], field: Column, case_sensitive: bool = False, mode: str = "any") -> Column:
    """Whether a field holds any or all of the strings; only the field is lowered. An empty field holds none."""
    if mode not in ("any", "all"):
        raise ValueError("mode is any or all")
    body = field if case_sensitive else F.lower(field)
    tests = [F.contains(body, F.lit(x)) for x in needles]
    out = F.lit(mode == "all")
    for t in tests:
        out = out | t if mode == "any" else out & t
    return F.coalesce(out & (field != ""), F.lit(False))


def header(headers: Column, name: str) -> Column:
    """A header's value by lower-case name, else the empty string."""
    return F.coalesce(F.try_element_at(headers, F.lit(name.lower())), F.lit(""))


def is_mailing_list(headers: Column) -> Column:
    """Has a way to unsubscribe and the precedence of a list."""
    return (header(headers, "list-unsubscribe") != "") & (F.lower(header(headers, "precedence")) == "list")


def is_newsletter(headers: Column) -> Column:
    """Has a way to unsubscribe and some sign of a bulk mailing."""
    signs = (header(headers, "list-id") != "") | (F.lower(header(headers, "precedence")) == "bulk") | (header(headers, "feedback-id") != "") | (header(headers, "x-csa-complaints") != "")
    return (header(headers, "list-unsubscribe") != "") & signs


def has_flag(flags: Column, flag: str) -> Column:
    """Whether the flags hold a system flag, such as ``Seen``."""
    return F.contains(flags, F.lit("\\" + flag))


def message_hash(date: Column, *candidates: Column) -> Column:
    """Epoch seconds, a hyphen and the MD5 of the first candidate that isn't empty."""
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
    return F.concat(F.unix_seconds(date).cast("string"), F.lit("-"), F.md5(first))


ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
LINK = r"https?://[^\s<>\"')]+"


def addresses(text: Column) -> Column:
    """All mail addresses of a text."""
    return F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0))


def links(text: Column) -> Column:
    """All web addresses of a text."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(0))


def route(received: Column) -> Column:
    """Hops of ``Received`` headers, first sender first: IP addresses and host names of ``from`` and ``by``."""

    def hop(h: Column) -> Column:
        ips = F.filter(F.regexp_extract_all(h, F.lit(r"\[?((?:\d{1,3}\.){3}\d{1,3}|IPv6:[0-9A-Fa-f:]+)\]?"), F.lit(1)), lambda x: ~x.startswith("127.") & ~x.startswith("192.168.") & ~x.startswith("10."))
        return F.struct(ips.alias("ips"), F.regexp_extract(h, r"from\s+([\w.-]+)", 1).alias("sender"), F.regexp_extract(h, r"by\s+([\w.-]+)", 1).alias("receiver"))

    return F.reverse(F.transform(received, hop))


def references(refs: Column) -> Column:
    """Message ids of a References header, nearest first."""
    return F.reverse(F.filter(F.split(refs, r"\s+"), lambda x: x != ""))


def folder_prefixes(folder: Column, separator: str = "/") -> Column:
    """Every folder on the way to a folder."""
    parts = F.split(folder, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def parents(mails: DataFrame) -> DataFrame:
    """Each reply with the message that it answers."""
    p = mails.select(F.col("message_id").alias("in_reply_to"), F.col("sender").alias("parent_sender"), F.col("subject").alias("parent_subject"))
    return mails.join(p, "in_reply_to")


def run_rules(mails: DataFrame, rules: list[Rule], state: DataFrame, key: str = "message_id") -> DataFrame:
    """A row for each message and rule whose predicate holds and whose runs aren't used up.

    ``state`` has the key, ``rule`` and ``processed``. All rules are applied
    in one pass over the messages.
    """
    hits = F.filter(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.action).alias("action"), F.lit(r.runs).alias("runs"), F.coalesce(r.predicate, F.lit(False)).alias("hit")) for r in rules]),
        lambda x: x["hit"],
    )
    matched = mails.select(key, F.explode(hits).alias("r")).select(key, "r.rule", "r.priority", "r.action", "r.runs")
    known = state.select(key, "rule", "processed")
    joined = matched.join(known, [key, "rule"], "left")
    return joined.where((F.col("runs") < 0) | (F.coalesce("processed", F.lit(0)) < F.col("runs"))).drop("runs", "processed")


def log_runs(state: DataFrame, outcome: DataFrame, key: str = "message_id") -> DataFrame:
    """The state after the actions: ``processed`` and ``errored`` are counted apart. ``outcome`` has the key, ``rule``, ``ok``."""
    new = outcome.select(key, "rule", F.col("ok").cast("int").alias("processed"), (~F.col("ok")).cast("int").alias("errored"))
    both = state.select(key, "rule", "processed", "errored").unionByName(new)
    return both.groupBy(key, "rule").agg(F.sum("processed").alias("processed"), F.sum("errored").alias("errored"))


def authenticity(spf: Column, dkim: Column, arc: Column, age_days: Column) -> Column:
    """The sum of given mail-authentication results; failures of mails older than 180 days count as none."""

    def points(status: Column) -> Column:
        base = F.when(F.lower(status) == "pass", 1.0).when(F.lower(status).isin("fail", "softfail"), -1.0).otherwise(0.0)
        return F.when((base < 0) & (age_days > 180), 0.0).otherwise(base)

    return points(spf) + points(dkim) + points(arc)
