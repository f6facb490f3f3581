"""Judge urls by host rules and by a weighted vocabulary matched with Aho-Corasick.

One automaton holds the strict and the soft terms and reads host and path once. A hit
counts only if no letter or digit touches it on either side. One strict term, or
``SOFT_NEEDED`` different soft terms, rejects a url. A rule that fits (host or parent
domain, and path prefix) decides instead, the longest rule first.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed. Repeated urls are judged alike; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.words import batched

STRICT = ("porn", "xxx", "hentai", "escort", "casino", "warez", "viagra", "malware")
SOFT = ("bet", "bets", "betting", "poker", "slots", "free", "jackpot", "adult", "nude", "sex",
        "dating", "pills", "loan", "loans", "crack", "torrent", "hot", "cheap", "win", "bonus",
        "x", "ads", "track", "tracker", "spam", "farm")
SOFT_NEEDED = 2
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def automaton(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT):
    out = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for term in terms:
            out.add_word(term, (kind, term))
    out.make_automaton()
    return out


def hits(machine, text: str) -> tuple[set[str], set[str]]:
    """Different strict and soft terms that stand alone in the text."""
    found = (set(), set())
    if len(machine):
        for last, (kind, term) in machine.iter(text):
            first = last - len(term)
            if (first < 0 or not text[first].isalnum()) and (
                    last + 1 == len(text) or not text[last + 1].isalnum()):
                found[kind].add(term)
    return found


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    best = None
    for at, start, verdict in rules:
        if host and (host == at or host.endswith("." + at)) and path.startswith(start):
            if best is None or len(at + start) > len(best[0]):
                best = (at + start, verdict)
    return best


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED,
               rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the different terms found."""
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in (
        "host", "path", "rule", "verdict")), ("n_strict", pa.int64()), ("n_soft", pa.int64())])
    strict, soft, rules = tuple(strict), tuple(soft), tuple(rules)

    def fill(batch, made=[]):  # noqa: B006 - one automaton a task
        if not made:
            made.append(automaton(strict, soft))
        for page_id, url in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist()):
            host, path = split_url(url)
            hard, gentle = hits(made[0], (host + path).translate(_UPPER))
            rule = fitting_rule(host, path, rules)
            bad = hard or len(gentle) >= soft_needed
            yield (page_id, host, path, rule and rule[0],
                   rule[1] if rule else "block" if bad else "allow", len(hard), len(gentle))

    return pages.select(F.col("page_id").cast("bigint"), "url").mapInArrow(
        batched(schema, fill), "page_id bigint, host string, path string, rule string, "
                               "verdict string, n_strict bigint, n_soft bigint")
