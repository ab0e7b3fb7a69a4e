"""Judges urls by host rules, and where none fits by a weighted vocabulary.

A rule names a host, which stands for its subdomains too, and the beginning of a path; the
longest rule that fits decides.  Elsewhere one pass of an Aho-Corasick automaton over the
whole url counts the terms of a vocabulary that stand alone, that is, without a letter or digit
at either end.  A term weighs as much as ``Vocabulary`` says: a strict one reaches the limit
by itself, soft ones only together, and a term counts once however often it occurs.

No rows meet, so nothing is shuffled.  Work is linear in a url's length: of a host only the
suffixes no longer than the longest rule's host are looked up.

Defined cases: a url that is null or has no ``://`` has an empty host and path and fits no
rule; null is allowed, as it holds no term; escapes (%41) are decoded for the vocabulary and
not for host and path; repeated rows are judged alike; a null page_id stays; an empty table
gives an empty result; columns other than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, texts_of

# The rules of the query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: One of these is enough.
STRICT = (
    "porn", "porno", "pornhub", "xxx", "xxxx", "nsfw", "hentai", "milf", "camgirl", "camgirls", "escort", "escorts", "x-rated", "adult-x", "sex-cam", "sexcam", "live-sex", "fetish", "erotica",
    "casino", "casinos", "online-casino", "gambling", "slot-machine", "sportsbook", "betting", "viagra", "cialis", "levitra", "tramadol", "warez", "keygen", "crackz", "torrentz", "spam", "spam-farm", "phishing", "malware", "payday-loan", "payday-loans",
)
#: Several of these are.
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "naked", "hot", "girls", "dating", "hookup", "webcam", "cam", "cams", "bet", "bets", "poker", "slots", "bingo", "jackpot", "roulette", "lottery", "win", "winner", "bonus", "free", "cheap", "discount", "pills", "pill", "pharmacy", "meds", "drugs", "loan", "loans", "credit",
    "crack", "hack", "serial", "torrent", "download", "ads", "adserver", "track", "tracker", "tracking", "popup", "click", "clicks", "banner", "affiliate", "farm", "links", "seo", "replica", "replicas", "rolex", "forex", "crypto", "airdrop", "giveaway",
)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case and their weights.  Distinct terms found in a url that weigh ``limit`` or more together reject it."""

    weights: dict[str, int] = field(default_factory=lambda: {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, 2)})
    limit: int = 2

    def __post_init__(self) -> None:
        if not self.weights or "" in self.weights or min(self.weights.values()) <= 0:
            raise ValueError("a vocabulary has terms, and positive weights")

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (term, weight))
        out.make_automaton()
        return out


class Rules:
    """Rules by host.  ``fitting`` gives the longest one's text and verdict."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks; got {verdict!r}")
            self.by_host.setdefault(host, []).append((path, verdict))
        self.longest = max(map(len, self.by_host), default=0)

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """Ties go to the longer host."""
        best: tuple[int, int, str, str] | None = None
        at = len(host)
        while at >= 0 and len(host) - at <= self.longest:
            if at == 0 or host[at - 1] == ".":
                suffix = host[at:]
                for start, verdict in self.by_host.get(suffix, ()):
                    if path.startswith(start) and (best is None or (len(suffix) + len(start), len(suffix)) > best[:2]):
                        best = (len(suffix) + len(start), len(suffix), suffix + start, verdict)
            at -= 1
        return best and best[2:]


def split(url: str) -> tuple[str, str]:
    """Host in lower case, and path; both empty without ``://``."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


def hits(url: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, int]]:
    """Term and weight of every occurrence that stands alone."""
    text = unquote(url).translate(_LOWER)
    for last, (term, weight) in automaton.iter(text):
        first = last + 1 - len(term)
        if (first == 0 or not text[first - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
            yield term, weight


_JUDGED = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, n_soft_terms long"


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; counted occurrences of strict and soft terms, and how many soft terms there are."""
    words = vocabulary or Vocabulary()
    book = Rules(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = words.automaton()
        for batch in byte_chunks(batches, "url"):
            rows = []
            for url in texts_of(batch, "url"):
                host, path = split(url)
                fit = book.fitting(host, path)
                found = list(hits(url, automaton))
                distinct = dict(found)
                strict = sum(w >= words.limit for _, w in found)
                soft_terms = sum(w < words.limit for w in distinct.values())
                own = "block" if sum(distinct.values()) >= words.limit else "allow"
                rows.append((host, path, fit[0] if fit else None, fit[1] if fit else own, strict, len(found) - strict, soft_terms))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "n_soft_terms"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(work, _JUDGED)
