"""Quality rules whose cutoffs are certified on labelled documents.

Every rule rejects a document whose measure reaches the rule's cutoff.  For each stratum and rule the candidate
cutoffs, fixed in advance, are tested from the mildest to the strictest on the labelled good documents: a cutoff is
certified while the exact binomial probability of seeing so few false rejections, were the true rate `rate / rules`,
stays under delta / (strata * rules).  The first failure ends the sequence, so within a sequence no further correction
is due, and Bonferroni's covers the sequences.  With probability 1 - delta the certified cutoffs of every stratum then
reject, all rules together, under `rate` of its good documents, whichever of them are used.  The bound is on documents
that pass the base rule, which is fixed and not certified.  The one used separates the labels best; of equals the
mildest.  A stratum with too few labels to certify anything gets no rule and keeps its documents.

DataFrame functions only.  A null text counts as empty and fails the base rule of 50 words; a null stratum is a
stratum of its own; documents without a label, label rows without a document, and null labels teach nothing; a repeated
label or document is one draw, of the least label and the row of the least measures; very long texts are measured whole.
Documents keep their columns, also those named like a measure.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: rule: (measure in whole percents of the words or lines, candidate cutoffs from mild to strict)
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("case when n_words > 0 then (100 * n_symbols) div n_words else 0 end", [400, 200, 150, 100, 75, 50, 30, 20, 10]),
    "duplicate_lines": ("case when n_lines > 0 then (100 * n_dup_lines) div n_lines else 0 end", [90, 80, 70, 60, 50, 40, 30, 20]),
    "long_words": ("case when n_words > 0 then (100 * word_chars) div n_words else 0 end", [4000, 3000, 2500, 2000, 1600, 1400, 1200, 1000]),
}
#: The share of good documents that all rules of a stratum together may reject, and the chance that one does so nonetheless.
RATE, DELTA = 0.06, 0.1
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that is found twice or more among the words."""

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["g"] == e["g"]) | (F.get(s, j + 1)["g"] == e["g"]), e["i"]))
            return F.array_sort(F.array_compact(twice))

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        return let(let(ordered, starts), union)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    found = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def measures(text: Column) -> Column:
    """A struct of MEASURES of a whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column, lines: Column) -> Column:
        parts = {
            "n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeated_words(words), "n_lines": F.size(lines),
        }
        return F.struct(*(parts[m].cast("long").alias(m) for m in MEASURES))

    return let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda w: let(lines, lambda li: of(w, li)))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, none of whose columns may be named as a measure, with the measures of a text and base_failed."""
    found = docs.withColumn("_m", F.explode(F.array(measures(F.col(text)))))
    failed = (F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))
    return found.select(*docs.columns, *(F.col(f"_m.{m}").alias(m) for m in MEASURES), failed.alias("base_failed"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, for x >= 1, after eight steps up; good to about 1e-13."""
    y, steps = x + 8.0, x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p): the last term, and those before it by their ratios, until they no longer count."""
    k, n = k.cast("double"), n.cast("double")
    last = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(60 * F.sqrt(n)) + 200).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, d: Column) -> Column:
        term = a["term"] * (k - d + 1) / (n - k + d) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    down = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), start, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    # above the expected number of rejections the tail is no evidence, whatever its exact value
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(last) * down)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", rules: dict = RULES, rate: float = RATE, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff), a row for each rule that a stratum gets.

    measured: with_measures of all documents, with doc_id; labels: doc_id, quality.  At most one row per stratum,
    rule and candidate leaves the aggregation.
    """
    once = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.where(~F.col("base_failed")).join(once, "doc_id").select("doc_id", "quality", F.col(stratum).alias("_stratum"), F.struct(*MEASURES).alias("_m"))
    seen = known.groupBy("doc_id").agg(F.min(F.struct("_stratum", "quality", "_m")).alias("_s")).select("_s._stratum", "_s.quality", "_s._m.*")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    key = F.coalesce(F.col("_stratum").cast("string"), F.lit("")).alias("stratum")
    at = [(r, k, c, F.expr(m) >= c) for r, (m, cutoffs) in rules.items() for k, c in enumerate(cutoffs)]
    counts = seen.groupBy(key).agg(
        F.count_if(good).alias("n"), F.count_if(bad).alias("n_bad"),
        F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff"), F.count_if(good & hit).alias("k"), F.count_if(bad & hit).alias("k_bad")) for r, k, c, hit in at)).alias("tests"),
    )
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    tests = counts.withColumn("strata", strata).select("stratum", "n", "n_bad", "strata", F.inline("tests"))
    level = delta / len(rules) / F.col("strata")
    tests = tests.withColumn("passes", binomial_tail(F.col("k"), F.col("n"), rate / len(rules)) <= level)
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    gain = F.col("k_bad") / F.col("n_bad") - F.col("k") / F.col("n")
    passing = tests.withColumn("certified", F.min("passes").over(upto)).where("certified and n > 0 and n_bad > 0").withColumn("gain", gain).where("gain > 0")
    best = passing.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    return best


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: dict = RULES) -> DataFrame:
    """measured with `kept`: false for what the base rule or a certified cutoff of its stratum rejects."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in rules))
    hits = [F.coalesce(F.expr(m) >= F.col(f"_{r}"), F.lit(False)) for r, (m, _) in rules.items()]
    rejected = F.col("base_failed")
    for hit in hits:
        rejected = rejected | hit
    joined = measured.withColumn("_s", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))).join(wide, F.col("_s") == F.col("stratum"), "left")
    return joined.withColumn("kept", ~rejected).drop("_s", "stratum", *(f"_{r}" for r in rules))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document, measured once."""
    measured = materialize(with_measures(docs.select("doc_id", F.col("text"), F.col(stratum))).drop("text"), "measures")
    return judge(measured, certified_cutoffs(measured, labels, stratum), stratum).drop(stratum)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents, columns as they are, that the rules keep. They are measured once, where they lie, and written with
    their measures; the cutoffs are learned from the measures alone, and are what is joined."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id"), F.col(stratum).alias("_stratum"))
    measured = materialize(with_measures(whole, "_doc.text"), "measured")
    cutoffs = materialize(certified_cutoffs(measured, labels, "_stratum"), "cutoffs")
    return judge(measured, cutoffs, "_stratum").where("kept").select("_doc.*")


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') x from documents),
w as (select *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') ws,
  list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) ls from t),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
d as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from d) group by 1),
m as (select w.doc_id, lang, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
  coalesce(c.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines from w left join c on w.doc_id = c.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  case when n_words > 0 then (100 * n_symbols) // n_words else 0 end v1, case when n_lines > 0 then (100 * n_dup_lines) // n_lines else 0 end v2,
  case when n_words > 0 then (100 * word_chars) // n_words else 0 end v3 from m),
r as (select unnest([__RULES__]) r),
s as (select lang, r.rule as rule, r.step as step, r.cutoff as cutoff, count(*) filter (quality = 1) n, count(*) filter (quality = 0) n_bad,
  count(*) filter (quality = 1 and v >= r.cutoff) k, count(*) filter (quality = 0 and v >= r.cutoff) k_bad
  from (select b.lang, r, quality, case r.rule when 'symbols' then v1 when 'duplicate_lines' then v2 else v3 end v from b join (select doc_id, min(quality) quality from labels group by 1) l on b.doc_id = l.doc_id, r where not base_failed)
  group by all),
p as (select *, case when k > n * __RATE__ then 1.0 else list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(__RATE__) + (n - j) * ln(1 - __RATE__)))) end
  <= __DELTA__ / __N__ / (select count(distinct lang) from s) passes from s),
q as (select *, bool_and(passes) over (partition by lang, rule order by step) certified, k_bad / n_bad - k / n gain from p where n > 0 and n_bad > 0),
u as (select lang, rule, arg_max(cutoff, gain - step * 1e-12) cutoff from q where certified and gain > 0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or coalesce(v1 >= u1.cutoff, false) or coalesce(v2 >= u2.cutoff, false) or coalesce(v3 >= u3.cutoff, false)) kept
from b left join u u1 on u1.lang = b.lang and u1.rule = 'symbols' left join u u2 on u2.lang = b.lang and u2.rule = 'duplicate_lines'
left join u u3 on u3.lang = b.lang and u3.rule = 'long_words'
"""
ORACLE_SQL = ORACLE_SQL.replace("__RULES__", ", ".join(f"{{'rule': '{r}', 'step': {k}, 'cutoff': {c}}}" for r, (_, cs) in RULES.items() for k, c in enumerate(cs)))
ORACLE_SQL = ORACLE_SQL.replace("__RATE__", str(RATE / len(RULES))).replace("__DELTA__", str(DELTA)).replace("__N__", str(len(RULES)))
