"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it fits
must contain. A rule is indexed under that token of its own which occurs in the
fewest URLs of the corpus; a URL's tokens fetch the candidate rules, and only
those run. Rules without a literal token are candidates for every URL.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, lower_ascii, materialise, table

#: Bytes of patterns that one pass over the pages applies; more rules take more passes.
PASS_BYTES = 32 << 20
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` are patterns that must both be found in host and path, or one of them if ``either``.

    ``tokens`` are literals that a fitting URL has as whole tokens. Of the
    rules that fit, the one with the highest ``weight`` decides; ties by name,
    then the one given last.
    """

    name: str
    host: str
    path: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int
    either: bool = False


def site_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the path starts with the rule's path.

    The last path token may go on in a longer one of the URL, so only those
    that a separator ends are required.
    """
    host, slash, rest = rule.partition("/")
    path = slash + rest
    ended = path if path and not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = TOKEN.findall(host.lower()) + TOKEN.findall(ended.lower())
    return Rule(rule, rf"(?s)(?:\A|\.){re.escape(host)}\Z", rf"\A{re.escape(path)}", verdict, tuple(tokens), len(rule))


#: Words that mark a page as unwanted where one is a whole token of host or path.
UNWANTED = ("adserver", "betting", "casino", "doubleclick", "gambling", "porn", "torrent", "viagra", "warez", "xxx")


def word_rules(words=UNWANTED) -> list[Rule]:
    """Block rules of the method itself, below every site rule."""
    fits = [rf"(?ai)(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" for w in words]
    return [Rule(f"word:{w}", p, p, "block", (w,), 0, either=True) for w, p in zip(words, fits)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; path: from there to ``? #`` or the end.

    A null URL, and one without ``://``, has an empty host and path.
    """
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)?", 1)


def filter_urls(pages: DataFrame, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``; existing columns of these names are replaced.

    ``rule`` names the deciding rule or is null, where ``verdict`` is ``default``.
    Only the URL tokens that some rule has are counted, over all URLs. Hosts
    and paths may hold any character, line ends included, and have any length;
    repeated rows are judged each; a null URL has an empty host and path.
    """
    host, path = host_and_path(F.col(url))
    known = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.concat_ws("\n", host, path)), F.lit("[a-z0-9]+"), 0))
    seen = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))).alias("t")).groupBy("t").count()
    freq = {r["t"]: r["count"] for r in seen.collect()}  # a row for each token of the rules at most
    rank = {id(r): k for k, r in enumerate(sorted(rules, key=lambda r: (r.weight, r.name)))}  # stable: of equals the later ranks higher
    passes: list[dict[str, list[tuple[int, Rule]]]] = [{}]
    size = 0
    for r in rules:
        if size > PASS_BYTES:
            passes.append({})
            size = 0
        size += len(r.host) + len(r.path) + len(r.name)
        passes[-1].setdefault(min(r.tokens, key=lambda t: (freq.get(t, 0), t)) if r.tokens else "", []).append((rank[id(r)], r))
    h, p, best = free_name(pages, "host"), free_name(pages, "path"), free_name(pages, "best")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, host.alias(h), path.alias(p), F.lit(None).cast("struct<rank:int,rule:string,verdict:string>").alias(best))
    for k, index in enumerate(passes):
        if k:
            out = materialise(out, "url-verdicts")
        found = _judge(index)(h, p)
        out = out.withColumn(best, F.greatest(best, F.when(found["rank"].isNotNull(), found)))
    return out.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))


def _judge(index: dict[str, list[tuple[int, Rule]]]):
    """A UDF of hosts and paths: the highest-ranking rule of ``index`` that fits. A worker compiles a rule once, when it is first a candidate."""
    compiled: dict[int, tuple] = {}

    def fits(rank: int, rule: Rule, host: str, path: str) -> bool:
        if rank not in compiled:
            compiled[rank] = (re.compile(rule.host).search, re.compile(rule.path).search)
        in_host, in_path = compiled[rank]
        return bool(in_host(host) or in_path(path)) if rule.either else bool(in_host(host) and in_path(path))

    @F.pandas_udf("struct<rank int, rule string, verdict string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            rows = []
            for host, path in zip(hosts, paths):
                best = None
                for t in {*TOKEN.findall(f"{host}\n{path}".encode().lower().decode()), ""}:
                    for rank, rule in index.get(t, ()):
                        if (best is None or rank > best[0]) and fits(rank, rule, host, path):
                            best = (rank, rule.name, rule.verdict)
                rows.append(best or (None, None, None))
            yield pd.DataFrame(rows, columns=["rank", "rule", "verdict"]).astype({"rank": "Int32", "rule": object, "verdict": object})

    return judge


#: The contract's rules.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op2_url_filters(spark, sf_dir):
    rules = [site_rule(r, v) for r, v in SITE_RULES]
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", rules + word_rules())
    named = F.col("rule").isin([r for r, _ in SITE_RULES])
    return out.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict")


def _sql() -> str:
    cases, verdicts = [], []
    for rule, verdict in sorted(SITE_RULES, key=lambda x: (-len(x[0]), x[0])):
        host, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{verdict}'")
    words = "|".join(UNWANTED)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM r),
m AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(verdicts)} WHEN regexp_matches(translate(host || chr(10) || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({words})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict FROM m"""


OP2_SQL = _sql()
