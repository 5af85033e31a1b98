"""URL rules found through their rarest literal token.

Two kinds of rule, both compiled to a pattern with the literal tokens every matching URL must hold: host rules
(``example.org/es/``: a host with its subdomains and a path prefix) and pattern rules (a regular expression with its tokens
written out). The frequency of the rules' tokens among the URLs' own tokens is counted over the whole table; each rule is
indexed by its rarest token. A URL fetches the rules of its tokens, and only those run their expression. Alternatives are
rules of their own, each with its token; a rule without a token is tried on every URL. The rules and their index go to each
executor once; their size is that of the rules given, not of the table.

The longest fitting host rule decides (of equal length: block before allow, then the smaller text). If none fits, the
pattern rules do: a fitting block pattern blocks, anything else is allowed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """Fits a host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"\A(?:[^\x00]*\.)?{re.escape(self.host)}\x00{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens whose ends the rule fixes; the last one of a path may go on in the URL, so it doesn't count."""
        path = self.path.lower()
        return TOKEN.findall(self.host) + [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]


@dataclass(frozen=True)
class PatternRule:
    """Fits URLs (host, NUL, rest) in which the expression is found; each of ``tokens`` is in all of them."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    PatternRule("block", r"[?&]utm_source=", ("utm", "source")),
    PatternRule("block", r"[?&]sessionid=", ("sessionid",)),
    PatternRule("block", r"/login(?:[/?#.]|\Z)", ("login",)),
    PatternRule("block", r"/logout(?:[/?#.]|\Z)", ("logout",)),
    PatternRule("block", r"\A[^\x00]*\.adserver\.[^\x00]*\x00", ("adserver",)),
    PatternRule("block", r"\A[^\x00]*\.tracker\.[^\x00]*\x00", ("tracker",)),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is no ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def rest_of(url: Column) -> Column:
    """What follows the host; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(.*)\z", 1), F.lit(""))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)


def keys_of(host: str, rest: str) -> set[str]:
    """The tokens of a URL. Lower-casing can shorten or lengthen letters outside ASCII only; tokens are ASCII."""
    return set(TOKEN.findall(f"{host}/{rest}".lower()))


def token_counter(wanted):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for host, rest in zip(batch.column("host").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                held.update(keys_of(host, rest) & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    return count


def token_counts(urls: DataFrame, rules: Sequence[HostRule | PatternRule]) -> dict[str, int]:
    """In how many of ``urls`` (host, rest) each token of the rules occurs; at most one row per rule token."""
    wanted = frozenset(t for r in rules for t in r.tokens)
    if not wanted:
        return {}
    shared = urls.sparkSession.sparkContext.broadcast(wanted)
    # At most as many rows per task as the rules have tokens.
    held = urls.select("host", "rest").mapInArrow(token_counter(shared), "token string, n long")
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    shared.destroy()
    return counts


def index_of(rules: Sequence[HostRule | PatternRule], counts: dict[str, int]) -> dict[str, list[HostRule | PatternRule]]:
    """Rules by their rarest token; under the empty token those that have none."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def matcher(index, default: str):
    """``index`` is a broadcast of rules by token."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token = index.value
        always = by_token.get("", [])
        # Expressions are compiled when a URL first fetches their rule.
        patterns: dict[HostRule | PatternRule, re.Pattern] = {}

        def fits(rule: HostRule | PatternRule, subject: str) -> bool:
            if rule not in patterns:
                patterns[rule] = re.compile(rule.pattern)
            return patterns[rule].search(subject) is not None

        for batch in batches:
            found, verdicts, tried = [], [], []
            for host, rest in zip(batch.column("host").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                subject = "\0".join(part.replace("\0", "\1") for part in (host, rest))
                rules = always + [r for k in keys_of(host, rest) for r in by_token.get(k, ())]
                fitting = [r for r in rules if fits(r, subject)]
                hosts = [r for r in fitting if isinstance(r, HostRule)]
                if hosts:
                    best = min(hosts, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
                    found.append(best.text)
                    verdicts.append(best.verdict)
                else:
                    found.append(None)
                    verdicts.append("block" if any(r.verdict == "block" for r in fitting) else default)
                tried.append(len(rules))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int64())],
                names=["id", "host", "path", "rule", "verdict", "n_tried"],
            )

    return match


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_tried), one row per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, which no host rule fits; it gets the default verdict.
    URLs of any length are judged whole. Repeated rows are judged each; an empty table gives an empty result; other columns
    are never read. ``n_tried`` is the number of rules whose expression ran.
    """
    rules = [*host_rules, *pattern_rules]
    url = F.col(f"`{url_column}`")
    urls = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), host_of(url).alias("host"), rest_of(url).alias("rest"))
    index = pages.sparkSession.sparkContext.broadcast(index_of(rules, token_counts(urls, rules)))
    whole = urls.select("id", "host", "rest", path_of(F.col("rest")).alias("path"))
    judged = whole.mapInArrow(matcher(index, default), "id long, host string, path string, rule string, verdict string, n_tried long")
    return judged.withColumnRenamed("id", "page_id")
