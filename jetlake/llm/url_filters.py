"""URL filters: host and path rules first, then a weighted vocabulary.

A rule (verdict, host, path) fits its host and all subdomains if the path of the
url starts with its path; the longest rule wins (then the longer host, then
block).  Urls that no rule fits are judged by the vocabulary: one Aho-Corasick
automaton of all terms reads the url once, and a hit counts if neither neighbour
is a letter or digit.  A strict term weighs as much as the threshold, a soft one
weighs 1 and counts once, however often it stands there: one strict hit or
``several`` distinct soft hits reject the url.  A-Z are lower-cased and a
percent escape is read as a boundary.

Nothing is exchanged: each task reads its urls with the rules and terms, which
are configuration and therefore bounded (``ENTRIES``; more raise an error).

Defined results: a null url or one without ``://`` has an empty host and path,
so that no rule with a host fits it; the vocabulary still reads it (null: no
hits, allowed).  An empty path does not start with ``/``.  Rows that repeat stay,
rows without page_id too; very long urls are read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jetlake.llm.common import columns

ENTRIES = 1_000_000  # rules and terms that a worker holds
SEVERAL = 2

#: Fixed values of the registered query: rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
STRICT = ("casino", "escort", "hentai", "jackpot", "malware", "phishing", "porn", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "dating", "download", "free", "loan", "nude", "pills", "poker",
        "sex", "sexy", "slots", "torrent", "viagra", "win")

_ESCAPE = re.compile("%[0-9a-f]{2}")
_JUDGED = ("page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, "
           "strict_terms array<string>, soft_terms array<string>")


def lowered(text: str) -> str:
    """A-Z lower-cased, other letters as they are."""
    return text if text.islower() else re.sub("[A-Z]+", lambda found: found.group().lower(), text)


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return lowered(host), slash + path


class Rules:
    """Rules by host; a lookup walks the parent domains of a host only."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple]] = {}
        for verdict, host, path in rules:
            rank = (len(host) + len(path), len(host), verdict == "block")
            self.by_host.setdefault(lowered(host), []).append((rank, path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, name = None, host
        while name:
            for rank, start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or rank > best[0]):
                    best = rank, name + start, verdict
            name = name.partition(".")[2]
        return best[1:] if best else (None, None)


class Vocabulary:
    """All terms in one automaton; ``hits`` gives each occurrence that stands between boundaries."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):  # a term in both lists is strict
            for term in map(lowered, terms):
                if term:
                    self.automaton.add_word(term, (term, kind))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> list[tuple[str, str]]:
        if not len(self.automaton):
            return []
        text = _ESCAPE.sub(" ", lowered(url))
        found = []
        for end, (term, kind) in self.automaton.iter(text):
            start = end - len(term) + 1
            if not (start and _inner(text[start - 1])) and not (end + 1 < len(text) and _inner(text[end + 1])):
                found.append((term, kind))
        return found


def _inner(letter: str) -> bool:
    return letter.isascii() and letter.isalnum()


def _judged(batches, rules, strict, soft, several):
    book, vocabulary = Rules(rules), Vocabulary(strict, soft)
    for batch in batches:
        out: dict[str, list] = {name: [] for name in (
            "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "strict_terms", "soft_terms")}
        for url in batch.column("url").to_pylist():
            host, path = host_and_path(url)
            rule, verdict = book.find(host, path)
            hits = vocabulary.hits(url or "")
            bad, mild = ([term for term, kind in hits if kind == wanted] for wanted in ("strict", "soft"))
            weight = several * len(bad) + len(set(mild))
            row = (host, path, rule, verdict or ("block" if weight >= several else "allow"), len(bad), len(mild),
                   sorted(set(bad)), sorted(set(mild)))
            for values, value in zip(out.values(), row):
                values.append(value)
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.list_(pa.string())] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds))],
            names=["page_id", *out])


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, several: int = SEVERAL) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, counts of hits and the distinct terms found."""
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    if several < 1 or len(rules) + len(strict) + len(soft) > ENTRIES:
        raise ValueError(f"at least one soft hit and at most {ENTRIES} rules and terms")
    rows = columns(pages, "page_id", "url").selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url")
    return rows.mapInArrow(lambda batches: _judged(batches, rules, strict, soft, several), _JUDGED)


def accepted_pages(pages: DataFrame, **options) -> DataFrame:
    """The pages whose urls are allowed, columns as they came; a page of unknown url is allowed."""
    verdicts = {name: options.get(name, default) for name, default in (
        ("rules", RULES), ("strict", STRICT), ("soft", SOFT), ("several", SEVERAL))}
    names = pages.columns

    def kept(batches):
        book, vocabulary = Rules(verdicts["rules"]), Vocabulary(verdicts["strict"], verdicts["soft"])
        for batch in batches:
            keep = []
            for url in batch.column(names.index("url")).to_pylist():
                verdict = book.find(*host_and_path(url))[1]
                if not verdict:
                    hits = set(vocabulary.hits(url or ""))
                    weight = sum(verdicts["several"] if kind == "strict" else 1 for _, kind in hits)
                    verdict = "block" if weight >= verdicts["several"] else "allow"
                keep.append(verdict == "allow")
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pages.mapInArrow(kept, pages.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms")
