"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Each rule rejects a document whose feature exceeds a cutoff. Cutoffs come from
labelled documents: for each stratum and rule, from a fixed grid, one for which
the exact binomial test shows a false-rejection rate below the rule's share of
``alpha``, which the rules divide equally. The tests share the error ``delta``
over strata and rules (Bonferroni) and go through the grid in a fixed sequence.
So with probability 1 - ``delta`` all rules together reject less than ``alpha``
of each stratum's good documents. A stratum with too few labels for any proof
rejects nothing by that rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, let, light, materialise, table, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Window length in words, least words, most repeated words in percent.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: The rules' features (larger is worse), each a share between 0 and 1.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "long_word_share")
#: Cutoffs tried for every rule.
GRID = tuple(round(x / 50, 2) for x in range(1, 50))
BASE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


def _repeat_words(w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first time included.

    Only texts with windows of equal hashes pay for the second part: equal
    windows meet in a sort, and each repeated start covers the words up to the
    next one, WINDOW of them at most. Windows of equal hashes are compared word
    by word; where two differ, they are sorted by their words instead.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def doubles(p: Column) -> Column:
            n = F.size(p)
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            return F.filter(p, lambda x, i: same(x, i - 1) | same(x, F.least(i + 1, n)))

        def starts(p: Column) -> Column:
            window = lambda x: F.slice(w, x["i"] + 1, WINDOW)
            clash = F.exists(F.transform(p, lambda x, i: F.coalesce((F.get(p, i - 1)["h"] == x["h"]) & (window(F.get(p, i - 1)) != window(x)), F.lit(False))), lambda x: x)

            def by_words() -> Column:
                named = F.sort_array(F.transform(p, lambda x: F.struct(F.array_join(window(x), " ").alias("h"), x["i"].alias("i"))))
                return let(named, lambda q: F.transform(doubles(q), lambda x: x["i"]))

            return F.sort_array(F.when(clash, by_words()).otherwise(F.transform(p, lambda x: x["i"])))

        def total(s: Column) -> Column:
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(s, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n")), lambda acc: acc["n"])

        return let(let(let(pairs, doubles), starts), total)

    def windows(ws: Column) -> Column:
        n = F.size(ws) - WINDOW
        return F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    repeated = let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) > WINDOW, repeated).otherwise(F.lit(0).cast("long"))


def base_features(text: Column) -> Column:
    """The contract's counts of a whole text as one struct; a null text has none of anything."""
    whole = F.coalesce(text, F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    without = lambda chars: F.length(F.translate(whole, chars, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, blank, "")) > 0)
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            without(blank).cast("long").alias("word_chars"),
            (F.length(whole) - without(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def shares(base: Column) -> dict[str, Column]:
    """The rules' features from the counts: shares of symbols, repeated lines and repeated words, and word length."""
    n = F.greatest(base["n_words"], F.lit(1)).cast("double")
    return {
        "symbol_share": base["n_symbols"] / F.greatest(base["word_chars"], F.lit(1)),
        "dup_line_share": F.least(F.lit(1.0), F.lit(8.0) * base["n_dup_lines"] / n),
        "repeat_share": base["n_repeat_words"] / n,
        "long_word_share": F.least(F.lit(1.0), base["word_chars"] / n / F.lit(32.0)),
    }


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, shifted by 8: error under 1e-12."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = F.log(n.cast("double") + 1.0)
    for k in range(2, 9):
        shift = shift + F.log(n.cast("double") + float(k))
    return series - shift


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial(n, p), where k < n p; else 0, as then nothing is proven.

    Terms from k down in logarithms. Below the mean they shrink at least as
    fast as a normal tail, so 40 standard deviations of them are all that a
    double can tell.
    """
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    depth = F.least(k, (F.lit(40.0) * F.sqrt(n.cast("double"))).cast("long") + 40)
    start = F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, j: Column) -> Column:  # the term for k - j from the one before it
        i = k - j + 1
        t = acc["t"] + F.log(i.cast("double") * (1 - p) / ((n - i + 1).cast("double") * p))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(depth, F.lit(1).cast("long"))), start, step, lambda acc: acc["s"])).otherwise(F.lit(1.0))
    return F.when(k.cast("double") < n * p, first + F.log(terms)).otherwise(F.lit(0.0))


def cutoffs(labelled: DataFrame, stratum: str, good: str, alpha: float, delta: float, least_gain: float = 0.02) -> DataFrame:
    """(stratum, rule, cutoff) for the rules in use. ``labelled`` has the stratum, the RULES and a boolean ``good``.

    ``alpha`` is each rule's own, ``delta`` that of all tests together.
    A rule's cutoffs are tested from the mildest on and the first failure ends
    the sequence, which needs no share of ``delta`` for each cutoff. Of the
    proven ones that cutoff is chosen which rejects the most of the bad less
    the most of the good (shares; ties: the mildest), if that gains
    ``least_gain``. Counts by stratum, rule and grid cell come first, so that
    no stratum's rows meet in one task; the rest works on grid cells.
    """
    exceeded = lambda x: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: x > c))
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), exceeded(F.col(r)).alias("cell")) for r in RULES])
    one = lambda c: F.count(F.when(c, 1))
    cells = labelled.select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.explode(pairs).alias("x")).groupBy("stratum", "x.rule", "x.cell").agg(one(F.col("good")).alias("good"), one(~F.col("good")).alias("bad"))
    # a cell is how many of the cutoffs a feature exceeds, by the comparison that judges too; the cutoff c rejects all cells >= c
    counts = lambda c: F.map_from_entries(F.collect_list(F.struct("cell", c)))
    grid = cells.groupBy("stratum", "rule").agg(counts("good").alias("g"), counts("bad").alias("b"), F.sum("good").alias("total"), F.sum("bad").alias("total_bad"))
    grid = grid.select("stratum", "rule", "total", "total_bad", "g", "b", F.posexplode(F.array(*map(F.lit, GRID))).alias("at", "cutoff"))
    above = lambda m: F.aggregate(F.transform(F.sequence(F.col("at") + 1, F.lit(len(GRID))), lambda c: F.coalesce(F.try_element_at(m, c), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y)
    tests = cells.agg((F.count_distinct("stratum") + F.max(F.when(F.col("stratum").isNull(), 1).otherwise(0))).alias("strata"))
    grid = grid.withColumn("rejected", above("g")).withColumn("caught", above("b")).crossJoin(F.broadcast(tests))  # one row
    proven = log_binomial_tail(F.col("rejected"), F.col("total"), alpha) <= math.log(delta) - F.log(F.col("strata") * float(len(RULES)))
    failed = F.max(F.when(~proven, F.col("cutoff"))).over(Window.partitionBy("stratum", "rule"))
    valid = grid.withColumn("failed", failed).filter(F.col("failed").isNull() | (F.col("cutoff") > F.col("failed")))
    gain = F.col("caught") / F.greatest("total_bad", F.lit(1)) - F.col("rejected") / F.greatest("total", F.lit(1))
    best = valid.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("best"))
    return best.filter(F.col("best.gain") >= least_gain).select("stratum", "rule", "best.cutoff")


def judge(docs: DataFrame, labels: DataFrame, key: str, text: str, stratum: str, keep: list[str], alpha: float = 0.08, delta: float = 0.05) -> DataFrame:
    """The columns ``keep`` with ``base`` (struct), ``base_failed``, ``kept`` and ``broken`` (names of the rules broken).

    With probability 1 - ``delta`` the cutoffs reject less than ``alpha`` of
    the good documents of every stratum, all rules together.

    ``labels`` has ``key`` and ``quality`` (1: good); documents without a label,
    or with contradicting ones, calibrate nothing. Null strata form one
    stratum. A null text has no words and fails. Columns of ``docs`` with the
    new names are replaced; without labels only the base rules reject.
    """
    kept = [c for c in keep if c.lower() not in ("base", "base_failed", "kept", "broken")]
    ident, strat, base = (free_name(docs, x) for x in ("key", "stratum", "base"))
    found = materialise(docs.select(*kept, F.col(key).alias(ident), F.col(stratum).cast("string").alias(strat), base_features(F.col(text)).alias(base)), "quality")
    marks = labels.groupBy(F.col(key).alias(ident)).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi").select(ident, (F.col("lo") == 1).alias("good"))
    features = found.select(ident, strat, *[c.alias(r) for r, c in shares(F.col(base)).items()])
    limits = cutoffs(features.join(marks, ident), strat, "good", alpha / len(RULES), delta)
    limits = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    limits = light(limits, "limits", 10_000)  # a row for each stratum
    out = found.join(limits, F.col(strat).eqNullSafe(F.col("stratum")), "left")
    of = shares(F.col(base))
    broken = F.array_compact(F.array(*[F.when(of[r] > F.try_element_at("limits", F.lit(r)), F.lit(r)) for r in RULES]))
    b = F.col(base)
    failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * b["n_words"])
    return out.select(*kept, b.alias("base"), failed.alias("base_failed"), (~failed & (F.coalesce(F.size(broken), F.lit(0)) == 0)).alias("kept"), broken.alias("broken"))


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "lang", ["doc_id"])
    return out.select("doc_id", "base.*", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def _sql(alpha: float = 0.02, delta: float = 0.05, least_gain: float = 0.02) -> str:
    rules = f"""[{{'rule': 'symbol_share', 'x': n_symbols / greatest(word_chars, 1)}}, {{'rule': 'dup_line_share', 'x': least(1.0, 8.0 * n_dup_lines / greatest(n_words, 1))}},
      {{'rule': 'repeat_share', 'x': n_repeat_words / greatest(n_words, 1)}}, {{'rule': 'long_word_share', 'x': least(1.0, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) / 32.0)}}]"""
    places = " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, k, w[k : k + {WINDOW - 1}] AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) u(k) WHERE len(w) >= {WINDOW}),
twice AS (SELECT r, g FROM places GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT x) AS n FROM places JOIN twice USING (r, g), unnest(range(k, k + {WINDOW})) u(x) GROUP BY r),
lines AS (SELECT r, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
base AS (SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)),
shares AS (SELECT r, doc_id, lang, s.rule, CAST(s.x AS DOUBLE) AS x FROM (SELECT r, doc_id, lang, unnest({rules}) AS s FROM base)),
marks AS (SELECT doc_id, min(quality) = 1 AS good FROM labels GROUP BY doc_id HAVING min(quality) = max(quality)),
cells AS (SELECT lang, rule, CAST(least({len(GRID)}, greatest(0, ceil(x * 50 - 1e-9) - 1)) AS INT) AS cell, good FROM shares JOIN marks USING (doc_id)),
tests AS (SELECT lang, rule, c, round(c / 50, 2) AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS bad, count(*) FILTER (good AND cell >= c) AS k, count(*) FILTER (NOT good AND cell >= c) AS caught
  FROM cells, unnest(range(1, {len(GRID) + 1})) u(c) GROUP BY lang, rule, c),
tails AS (SELECT *, CASE WHEN k < n * {alpha} THEN ln((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))) FROM unnest(range(0, k + 1)) v(i))) ELSE 0 END AS tail FROM tests),
proven AS (SELECT *, max(CASE WHEN tail > ln({delta}) - ln((SELECT count(DISTINCT coalesce(lang, chr(1))) FROM cells) * {len(RULES)}) THEN cutoff END) OVER (PARTITION BY lang, rule) AS failed, caught / greatest(bad, 1) - k / greatest(n, 1) AS gain FROM tails),
chosen AS (SELECT lang, rule, cutoff FROM proven WHERE failed IS NULL OR cutoff > failed QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1 AND gain >= {least_gain}),
broken AS (SELECT s.r, string_agg(s.rule, ',' ORDER BY CASE s.rule {places} END) AS names FROM shares s JOIN chosen c ON s.rule = c.rule AND s.lang IS NOT DISTINCT FROM c.lang AND s.x > c.cutoff GROUP BY s.r),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(names, '') AS broken FROM base LEFT JOIN broken USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM judged"""


OP5_SQL = _sql()
