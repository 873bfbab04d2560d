"""URL filters: pattern rules, indexed by their rarest literal token.

A URL is judged by its address: the host in lower case (A-Z), then path,
query and fragment as they are.  A rule's pattern is literal text with ``*``
(anything), ``^`` (a character other than a letter, digit, ``_``, ``.``,
``%`` or ``-``, or the end), ``||`` in front (the start of a host or of one
of its parent domains), ``|`` in front or at the end (the address's start or
end).  Tokens are runs of a-z and 0-9 in lower case.  A literal run of a
pattern that can't be a part of a longer run is a token of every address
that the pattern fits, so each rule is filed under the one of them that the
corpus has least often (counted over all URLs); the tokens of an address
fetch the rules filed under them, and only those run as regular expressions.
Rules without such a run are filed under the empty token, which every
address has.

Up to ``INLINE_RULES`` rules the index is a hash table inside the plan and
rows stay where they are: no shuffle.  Beyond that it is a table, joined
with the tokens of distinct URLs, salted, since a third of all addresses may
share a token.

Of the rules that fit, the one of the highest tier decides, then the longest
pattern, then ``allow`` before ``block``, then the least name.

Defined cases: a null URL, or one without ``://``, has an empty host and
path, no rule fits it, and the default verdict holds; repeated rows are
judged each for itself; columns of the input named as new ones are replaced,
others kept; an empty table gives no rows; without rules the default holds.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import ascii_lower, fresh, join_groups, let, staged

ALLOW, BLOCK = "allow", "block"
# Rules that are inlined into the plan (about 200 bytes each).
INLINE_RULES = 5_000
# Parts that each token's addresses are dealt to in the join.
SALTS = 64
_RULE = "token string, tier int, size int, verdict string, name string, regex string"
_TOKEN = "[a-z0-9]+"


class Rule(NamedTuple):
    """``name`` is what the result shows; a rule of a higher tier decides
    before those of lower ones."""
    name: str
    pattern: str
    verdict: str
    tier: int = 0


def host_rule(place: str, verdict: str, tier: int = 0) -> Rule:
    """Rule for a host with its subdomains and a path prefix (``net/es/``)."""
    return Rule(place, f"||{place}", verdict, tier)


# Addresses of no use for training: link farms, pharmacies, betting, adult
# pages, trackers, and pages of software rather than of people.
DEFAULT_RULES = [Rule(p, p, BLOCK) for p in (
    "||spam-farm.", "||cheap-pills.", "||casino-win.", "||free-bets.", "||adult-x.", "||ads-track.",
    "/wp-login.php", "/wp-admin/", "/phpmyadmin/", "/cgi-bin/", "/.git/", "/xmlrpc.php|", "/checkout/*/payment^")]


def _split(pattern: str) -> tuple[str, str, bool]:
    """Anchor in front, body, anchor at the end."""
    front = "||" if pattern.startswith("||") else "|" if pattern.startswith("|") else ""
    body = pattern[len(front):]
    return front, body.removesuffix("|"), body.endswith("|")


def rule_regex(pattern: str) -> str:
    """The Java regular expression of a pattern, to be found in an address."""
    front, body, end = _split(pattern)
    special = {"*": "(?s:.*)", "^": r"(?:[^A-Za-z0-9_.%\-]|\z)"}
    made = "".join(special.get(c) or (c if c.isalnum() else "\\" + c) for c in body)
    return {"||": r"^(?:[^/?#]*\.)?", "|": "^", "": ""}[front] + made + (r"\z" if end else "")


def rule_tokens(pattern: str) -> list[str]:
    """The literal runs that are whole tokens of every address that fits."""
    front, body, end = _split(pattern)
    text = body.translate({c: c + 32 for c in range(65, 91)})
    whole = []
    for run in re.finditer(_TOKEN, text):
        left = text[run.start() - 1] != "*" if run.start() else bool(front)
        right = text[run.end()] != "*" if run.end() < len(text) else end
        if left and right:
            whole.append(run.group())
    return sorted(set(whole))


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and address (host, then the rest of the URL); empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_replace(rest, "^[^/?#]*", ""))


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(address), F.lit(_TOKEN), F.lit(0)))


def _rarest(df: DataFrame, rules: list[Rule], url_col: str) -> dict[str, str]:
    """Pattern -> the token it is filed under.  What comes to the driver is
    at most one count per token of the rules."""
    tokens = {r.pattern: rule_tokens(r.pattern) for r in rules}
    chosen = sorted({t for ts in tokens.values() if len(ts) > 1 for t in ts})
    counts = {}
    if chosen:
        wanted = df.sparkSession.createDataFrame([(t,) for t in chosen], "token string")
        if len(chosen) <= INLINE_RULES:
            wanted = F.broadcast(wanted)
        seen = df.select(F.explode(tokens_of(host_and_path(F.col(url_col))[2])).alias("token"))
        counts = {r["token"]: r["count"] for r in seen.join(wanted, "token", "left_semi").groupBy("token").count().collect()}
    return {p: min(ts, key=lambda t: (counts.get(t, 0), -len(t), t)) if ts else "" for p, ts in tokens.items()}


def _filed(rules: list[Rule], rarest: dict[str, str]) -> list[tuple]:
    return [(rarest[r.pattern], r.tier, len(r.pattern), r.verdict, r.name, rule_regex(r.pattern)) for r in rules]


def _order(tier, size, verdict, name) -> Column:
    """The rule that decides has the least of these."""
    return F.struct((-tier).alias("tier"), (-size).alias("size"), verdict.alias("verdict"), name.alias("name"))


def _inline(address: Column, filed: list[tuple]) -> Column:
    """The deciding rule by a hash table inside the plan: a token's rules are
    in the slot of its checksum."""
    names = [f.split()[0] for f in _RULE.split(", ")]
    slots: list[list[dict]] = [[] for _ in range(1 << max(1, (2 * len(filed)).bit_length()))]
    for entry in filed:
        slots[zlib.crc32(entry[0].encode()) % len(slots)].append(dict(zip(names, entry)))
    index = F.from_json(F.lit(json.dumps(slots)), f"array<array<struct<{_RULE.replace(' ', ':')}>>>"
                        .replace(",:", ","))

    def fetch(token):
        slot = F.element_at(index, (F.crc32(token.cast("binary")) % len(slots) + 1).cast("int"))
        return F.filter(slot, lambda r: r["token"] == token)

    def decide(a):
        candidates = F.flatten(F.transform(F.concat(tokens_of(a), F.array(F.lit(""))), fetch))
        fits = F.filter(candidates, lambda r: F.rlike(a, r["regex"]))
        return F.array_min(F.transform(fits, lambda r: _order(r["tier"], r["size"], r["verdict"], r["name"])))
    return let(address, decide)


def _joined(df: DataFrame, filed: list[tuple], url_col: str, key: str, best: str) -> DataFrame:
    """``df`` with ``best``, by a join of the distinct URLs' tokens with the index."""
    spark = df.sparkSession
    keyed = df.withColumn(key, F.coalesce(F.col(url_col), F.lit("")))
    urls = staged(keyed.groupBy(key).agg(F.count("*").alias("group_size")), "urls")
    index = spark.createDataFrame(filed, _RULE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    address = urls.select(key, host_and_path(F.col(key))[2].alias("address"),
                          F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    tokens = address.withColumn("token", F.explode(F.concat(tokens_of(F.col("address")), F.array(F.lit("")))))
    fits = tokens.join(index, ["token", "salt"]).where(F.rlike("address", F.col("regex")))
    order = _order(F.col("tier"), F.col("size"), F.col("verdict"), F.col("name"))
    decided = fits.groupBy(key).agg(F.min(order).alias(best))
    groups = staged(urls.join(decided, key, "left"), "url-verdicts")
    return join_groups(keyed, groups, key).drop("group_size")


def judge(df: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", default: str = ALLOW,
          inline_rules: int = INLINE_RULES) -> DataFrame:
    """All columns of ``df``, then host, path, rule (the deciding rule's name,
    or null), rule_tier and verdict."""
    rules = DEFAULT_RULES if rules is None else rules
    new = ["host", "path", "rule", "rule_tier", "verdict"]
    if url_col in new:
        raise ValueError(f"{url_col} would be replaced")
    kept = df.drop(*new)
    best = fresh(kept, "_best")
    filed = _filed(rules, _rarest(kept, rules, url_col))
    host, path, address = host_and_path(F.col(url_col))
    if not filed:
        found = kept.withColumn(best, F.lit(None).cast("struct<tier:int,size:int,verdict:string,name:string>"))
    elif len(filed) <= inline_rules:
        found = kept.withColumn(best, _inline(F.coalesce(address, F.lit("")), filed))
    else:
        if clash := {"group_size", "_hot"} & {c.lower() for c in kept.columns}:
            renamed = {c: fresh(kept, f"_own_{c}") for c in kept.columns if c.lower() in clash}
            back = {new_name: old for old, new_name in renamed.items()}
            return judge(df.withColumnsRenamed(renamed), rules, url_col, default, inline_rules).withColumnsRenamed(back)
        found = _joined(kept, filed, url_col, fresh(kept, "_key"), best)
    return found.select(*kept.columns, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
                        F.col(f"{best}.name").alias("rule"), (-F.col(f"{best}.tier")).alias("rule_tier"),
                        F.coalesce(F.col(f"{best}.verdict"), F.lit(default)).alias("verdict"))
