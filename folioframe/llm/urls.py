"""URL filter: rules first, then the ratio of two variable-order Markov models of characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import materialize, release, tidied

#: (verdict, rule): host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Longest context, times a context must be seen to be used, and the share of urls held back to set the limit.
ORDER, LEAST, HELD_BACK = 5, 2, 4
#: Steps in which ratios are counted for the limit.
STEP = 1e-4


def split_url(url):
    """Host and path as columns: see the contract of the query."""
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    fits = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(fits, host).otherwise(""), F.when(fits, path).otherwise("")


def rule_columns(host, path, rules=RULES):
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.find("/")
        name, start = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def train(texts: DataFrame, order: int = ORDER) -> kn.Model:
    """Witten-Bell smoothed model of all rows (t): each context backs off to the one that is a character shorter, and
    contexts seen fewer than LEAST times are left out, so their order varies with what has been seen."""
    spark, size = texts.sparkSession, order + 1

    def run(batches):
        for b in tidied(batches):
            grams: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                s = kn.BOS * order + kn.clean(t) + kn.EOS
                for i in range(len(s) - order):
                    g = s[i : i + size]
                    grams[g] = grams.get(g, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["g", "n"])

    grams = texts.select("t").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    levels = grams.select("n", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("k"), "g").groupBy("k", F.expr("right(g, k)").alias("g")).agg(F.sum("n").alias("c"))
    counts = materialize(levels.withColumn("ctx", F.expr("substring(g, 1, k - 1)")), "markov-counts")
    weights = counts.groupBy("k", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where(f"k = 1 or total >= {LEAST}")
    weights = materialize(weights.withColumn("w", F.col("kinds") / (F.col("kinds") + F.col("total"))).withColumn("lw", kn.log_of(F.col("w"))), "markov-weights")
    kept = counts.join(weights, ["k", "ctx"]).select("k", "g", (F.col("c") / (F.col("total") + F.col("kinds"))).alias("p"), "w")
    kinds = weights.where("k = 1").select("kinds").first()
    model = kn.Model(spark, size, *kn.interpolated(kept, size, 1 / ((kinds[0] if kinds else 0) + 1)), weights)
    release(counts)
    return model


def ratios(rows: DataFrame, accepted: kn.Model, rejected: kn.Model, most: int | None = None) -> DataFrame:
    """rows (with column t) and ratio: the log-likelihood difference a character; above 0: more like the accepted."""
    limit = kn.MOST_BROADCAST if most is None else most
    if accepted.size() + rejected.size() <= limit:
        place, sent = rows.columns.index("t"), (accepted.packed(), rejected.packed())
        schema = rows.withColumn("ratio", F.lit(0.0)).schema

        def run(batches):
            scorers = [kn.Scorer(x.value) for x in sent]
            for b in tidied(batches):
                texts = b.column(place).dictionary_encode()
                words = texts.dictionary.to_pylist()
                a, r = (s.words(words) for s in scorers)
                each = (a[:, 0] - r[:, 0]) / (kn.SCALE * a[:, 1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(each[texts.indices.to_numpy(zero_copy_only=False)])], [*b.schema.names, "ratio"])

        return rows.mapInArrow(run, schema)
    cleaned = F.translate("t", kn.BOS + kn.EOS + kn.REPEAT, "   ")
    words = materialize(rows.select(cleaned.alias("word")).distinct(), "markov-words")
    a, r = (kn.word_scores(m, words) for m in (accepted, rejected))
    both = a.join(r.select("word", F.col("lp").alias("less")), "word").select(F.col("word").alias("_word"), ((F.col("lp") - F.col("less")) / (F.lit(float(kn.SCALE)) * F.col("symbols"))).alias("ratio"))
    return rows.join(both, cleaned == F.col("_word")).drop("_word")


def calibrate(counts: list[tuple[str, float, int]]) -> float:
    """The limit that misjudges the least shares of both verdicts, in the middle of those that do so equally."""
    total = {v: sum(n for w, _, n in counts if w == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    at: dict[float, dict[str, int]] = {}
    for v, x, n in counts:
        at.setdefault(x, {"allow": 0, "block": 0})[v] += n
    values = sorted(at)
    cuts = [values[0] - 1, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1]
    below, cost = {"allow": 0, "block": 0}, []
    for x in (None, *values):
        for v, n in at.get(x, {}).items():
            below[v] += n
        cost.append(below["allow"] / total["allow"] + 1 - below["block"] / total["block"])
    best = [c for c, x in zip(cuts, cost) if x <= min(cost) + 1e-12]
    return best[len(best) // 2]


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page.

    All distinct urls that rules decide are the models' examples; a quarter of them, by hash, sets the limit instead.
    Others are judged by the limit; a ratio equal to it is allowed. Null urls and urls without :// have empty host and
    path and are judged as the empty text. Without examples of both kinds all else is allowed. Repeated rows are judged
    alike.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "t": F.concat("host", "path")})
    examples = materialize(rows.where("ruled is not null").select("ruled", "t").distinct().withColumn("held", F.pmod(F.xxhash64("t"), F.lit(HELD_BACK)) == 0), "url-examples")
    models = [train(examples.where((F.col("ruled") == v) & ~F.col("held"))) for v in ("allow", "block")]
    if all(m.size() for m in models):
        held = ratios(examples.where("held"), *models)
        counts = held.groupBy("ruled", F.round(F.col("ratio") / STEP).alias("x")).count().collect()  # as many as there are steps
        limit = calibrate([(r["ruled"], r["x"] * STEP, r["count"]) for r in counts])
        found = ratios(rows, *models)
    else:
        limit, found = float("-inf"), rows.withColumn("ratio", F.lit(0.0))
    judged = F.coalesce("ruled", F.when(F.col("ratio") >= limit, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", "rule", judged.alias("verdict"), "ratio")
