"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are spans of fixed kinds. The values of all candidates of the corpus
are hashed and counted by distinct owners and repositories: a value that many
owners hold is a copied example, one that a few hold looks live. Spans are
code-point offsets, end exclusive.

Spark has no function that returns the places of all matches, so they come
from splitting: with n matches a text splits into n + 1 pieces, and the running
sum of piece and match lengths gives every start and end. All of it takes time
in proportion to a text's length and spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, let, light, materialise, running, table

#: The contract's kinds, in its order: name, pattern, group whose length counts (0: match), least length.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a shorter maximal run holds no longer match, so the least length may stand in the pattern
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the method adds where few owners hold the value.
MORE_KINDS = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
#: What a text must contain for a kind's pattern to fit at all; a plain search is far cheaper than the pattern.
HINTS = {"access": ["AKIA"], "jwt": ["eyJ"], "github": ["ghp_", "gho_", "ghr_", "ghs_", "ghu_"], "slack": ["xox"], "google": ["AIza"], "pem": ["PRIVATE KEY-----"]}
SPAN = "struct<start:int,end:int,kind:string,value:string>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The kind's spans, leftmost and non-overlapping; ``value`` is the counted group."""
    rx = F.lit(pattern)

    def place(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        values = F.regexp_extract_all(text, rx, group) if group else found
        rows = F.arrays_zip(found.alias("whole"), values.alias("value"))
        steps = F.zip_with(pieces, found, lambda x, y: (F.length(x) + F.length(y)).cast("long"))
        span = lambda x, b: F.struct((b - F.length(x["whole"])).cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        all_spans = let(running(steps, lambda x, y: x + y), lambda ends: F.transform(rows, lambda x, i: span(x, F.get(ends, i))))
        return F.filter(all_spans, lambda s: F.length(s["value"]) >= least) if least else all_spans

    none = F.array().cast(f"array<{SPAN}>")
    spans = F.when(F.regexp_like(text, rx), let(F.regexp_extract_all(text, rx, 0), place)).otherwise(none)
    if kind in HINTS:
        any_hint = F.lit(False)
        for h in HINTS[kind]:
            any_hint = any_hint | F.contains(text, F.lit(h))
        spans = F.when(any_hint, spans).otherwise(none)
    return spans


def by_place(spans: Column) -> Column:
    """Spans by start, then kind: the base kinds as listed, then the others."""
    order = {k[0]: i for i, k in enumerate((*BASE_KINDS, *MORE_KINDS))}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def scan_secrets(docs: DataFrame, text: str, owner: str, repository: str, keep: list[str], live_owners: int = 2, live_repositories: int = 100, example_share: float | None = None) -> DataFrame:
    """The columns ``keep``, with ``base_spans``, ``more_spans`` and ``live_spans``.

    base_spans: the contract's spans; more_spans: the added kinds' spans whose
    value ``live_owners`` distinct owners and ``live_repositories`` distinct
    repositories hold at most; live_spans: those of either that so few hold. A null text is empty; null owners or repositories
    count as one more owner or repository; repeated rows count once an owner
    and repository. Columns of ``docs`` with the new names are replaced.

    With ``example_share`` a value is live unless it is proven an example:
    distinct texts (copies of one count once, for the least of its owners) of
    more than ``live_owners`` owners and of that share of all owners hold it.
    How many texts of few owners hold it doesn't matter then.
    """
    kept = [c for c in keep if c not in ("base_spans", "more_spans", "live_spans")]
    uid, own, repo, t, base, more, body, every = (free_name(docs, x) for x in ("uid", "own", "repo", "text", "base", "more", "body", "every"))
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(t, whole).select(
        *kept, F.col(owner).cast("string").alias(own), F.col(repository).cast("string").alias(repo), F.monotonically_increasing_id().alias(uid), *([] if example_share is None else [F.sha2(t, 256).alias(body)]),
        by_place(F.concat(*[_spans(F.col(t), *k) for k in BASE_KINDS])).alias(base), by_place(F.concat(*[_spans(F.col(t), *k) for k in MORE_KINDS])).alias(more),
    )
    found = materialise(found, "secrets")  # the row number is fixed from here on
    key = F.sha2("value", 256).alias("key")
    found = found.withColumn(every, by_place(F.concat(base, more)))
    values = F.array_distinct(F.transform(every, lambda s: s["value"]))
    # distinct (value, owner) pairs first: a value in a third of all documents is summed up where it is read
    if example_share is None:
        held = found.select(own, repo, F.explode(values).alias("value")).select(own, repo, key)
        by_repo = held.groupBy("key", own, repo).agg(F.lit(1).alias("one"))
        by_owner = by_repo.groupBy("key", own).agg(F.count("*").alias("repositories"))
        told = by_owner.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")).filter((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)).select("key")
    else:
        owners = found.agg(F.count_distinct(own) + F.max(F.col(own).isNull().cast("int"))).first()[0] or 0
        least = max(live_owners + 1, math.ceil(example_share * owners))
        # copies of a text hold the same values, so a text's owner may be told value by value
        by_text = found.select(own, body, F.explode(values).alias("value")).groupBy(key, body).agg(F.min(F.coalesce(own, F.lit(""))).alias(own))
        by_owner = by_text.groupBy("key", own).agg(F.lit(1).alias("one"))
        told = light(by_owner.groupBy("key").agg(F.count("*").alias("owners")).filter(F.col("owners") >= least).select("key"), "examples")
    # places of the spans with such a value; values of few owners make no hot key, examples are few
    places = found.select(uid, F.posexplode(F.transform(every, lambda s: s["value"])).alias("at", "value")).select(uid, "at", key).join(told, "key")
    places = light(places.groupBy(uid).agg(F.sort_array(F.collect_list("at")).alias("places")), "places", 500_000, F.size("places"))
    out = found.join(places, uid, "left")
    at = F.coalesce("places", F.array().cast("array<int>"))
    if example_share is not None:  # all but the examples
        at = F.when(F.size(every) > 0, F.array_except(F.sequence(F.lit(0), F.size(every) - 1), at)).otherwise(at)
    live = F.transform(at, lambda i: F.get(every, i))
    kinds = [k[0] for k in MORE_KINDS]
    return out.select(*kept, F.col(base).alias("base_spans"), F.filter(live, lambda s: s["kind"].isin(kinds)).alias("more_spans"), live.alias("live_spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 4096) -> Column:
    """``text`` with the characters of all spans (sorted by start) replaced by ``mark``, once a run of overlapping spans.

    What stays is cut from blocks of the text, as a cut from the text itself
    would count its characters from the start each time.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), 0)

    def cleaned(bs: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            i = F.floor(a / block).cast("int")
            return F.substring(F.array_join(F.slice(bs, i + 1, F.greatest(F.floor((b - 1) / block).cast("int") - i + 1, F.lit(0))), ""), a.cast("int") - i * block + 1, (b - a).cast("int"))

        def pieces(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
            gaps = F.transform(spans, lambda s, i: F.struct(before(i).alias("a"), s["start"].cast("long").alias("b")))
            gaps = F.filter(gaps, lambda g: g["b"] >= g["a"])
            return F.array_join(F.concat(F.transform(gaps, lambda g: cut(g["a"], g["b"])), F.array(cut(before(F.size(ends)), F.length(text).cast("long")))), mark)

        return let(running(F.transform(spans, lambda s: s["end"].cast("long")), lambda x, y: F.greatest(x, y)), pieces)

    return let(blocks, cleaned)


def op9_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = scan_secrets(docs, "text", "source", "doc_id", ["doc_id"])
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k[0]) for k in BASE_KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(by_place(F.concat("base_spans", "more_spans"))).alias("spans"), F.size("live_spans").cast("long").alias("n_live"))


def _sql() -> str:
    kinds = []
    for order, (kind, pattern, group, least) in enumerate((*BASE_KINDS, *MORE_KINDS)):
        rx = "'" + pattern.replace("'", "''") + "'"
        lengths = "coalesce(list_sum([length(x) for x in {}]), 0)"
        start = f"{lengths.format('pieces[1 : j]')} + {lengths.format('found[1 : j - 1]')}"
        kinds.append(
            f"SELECT r, doc_id, source, '{kind}' AS kind, {order} AS k, {start} AS a, {start} + length(found[j]) AS b, vals[j] AS value FROM "
            f"(SELECT r, doc_id, source, regexp_extract_all(t, {rx}) AS found, regexp_extract_all(t, {rx}, {group}) AS vals, string_split_regex(t, {rx}) AS pieces FROM d WHERE regexp_matches(t, {rx})), unnest(range(1, len(found) + 1)) u(j) WHERE length(vals[j]) >= {least}"
        )
    count = lambda kind: f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"
    listed = lambda where: f"coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER ({where}), '')"
    base = f"k < {len(BASE_KINDS)}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(kinds)}),
few AS (SELECT value, TRUE AS live FROM spans GROUP BY value HAVING count(DISTINCT coalesce(source, chr(1))) <= 2 AND count(DISTINCT coalesce(source, chr(1)) || ' ' || coalesce(CAST(doc_id AS VARCHAR), '')) <= 100)
SELECT d.doc_id, {', '.join(count(k[0]) for k in BASE_KINDS)}, sha256({listed(base)}) AS base_sha256, {listed(f'{base} OR live')} AS spans, CAST(count(*) FILTER (live) AS BIGINT) AS n_live
FROM d LEFT JOIN spans USING (r) LEFT JOIN few USING (value) GROUP BY d.r, d.doc_id"""


OP9_SQL = _sql()
