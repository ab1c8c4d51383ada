"""URL filters: longest-rule lookup, then a character language-model ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: The rules of the query, as verdict and host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 5
#: Windows, or urls, that occur more often than one in HOT are broadcast: at most HOT of them.
HOT = 1000
#: Step in which scores are counted to set the cut.
STEP = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no '://'."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    # only A-Z is folded
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null where none does).

    Longest counts code points of the whole rule; the rule list is a small fixed parameter and
    becomes one CASE expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(text: Column, n: int = ORDER) -> Column:
    """All windows of n characters over n - 1 start marks, the text and an end mark."""
    t = F.concat(F.lit("\x02" * (n - 1)), text, F.lit("\x03"))
    # characters are split off once: a substring at each place would walk there from the beginning
    return C.let(F.split(t, ""), lambda cs: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.array_join(F.slice(cs, i, n), "")))


def interpolated(full: DataFrame, order: int = ORDER) -> DataFrame:
    """full (gram, a, b: how often accepted and rejected urls hold a window; m) with llr, their log ratio.

    Where a class has not seen a context, its estimate is the shorter context's, down to one
    character of 256. So a window of count 0 changes no estimate and is judged by its longest
    known suffixes in both classes. Each length takes its estimates from the next shorter one, by
    joins on a window's first and last characters; a key has at most as many rows as there are
    characters.
    """
    levels = [full.select("gram", "a", "b")]
    for k in range(order - 1, 0, -1):
        levels.append(C.cut(levels[-1].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))))
    shorter = None
    for k, counts in enumerate(reversed(levels), 1):
        x = counts.withColumn("ctx", F.substring("gram", 1, k - 1))
        # followers of a context: their number, and how often each class saw the context
        x = x.join(x.groupBy("ctx").agg(*(f(F.col(c)).alias(f"{n}{c}") for c in "ab" for n, f in (("n", F.sum), ("t", lambda y: F.sum((y > 0).cast("long")))))), "ctx")
        if shorter is None:
            x = x.select("*", *(F.lit(1 / 256).alias(f"q{c}") for c in "ab"))
        else:
            x = x.join(shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), F.right("gram", F.lit(k - 1)) == F.col("tail"))
        shorter = x.select("gram", "a", "b", *(F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"q{c}")).alias(f"p{c}") for c in "ab"))
    out = shorter.select("gram", "a", "b", F.log(F.col("pb") / F.col("pa")).alias("llr"))
    return out.join(full.select("gram", "m"), "gram")


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """Log ratio of two smoothed variable-order Markov models for each window of labelled.

    labelled: url string, blocked boolean, n long (how often; urls of n 0 teach nothing, but their
    windows are judged). Witten-Bell interpolation: each order's estimate gives way to the shorter
    context's by the number of different characters that followed the context, so contexts that
    were seen often use their full length and new ones fall back. The counts of all orders come
    from those of the full windows. Returns gram, a, b (counts), llr (rejected minus accepted), m
    (rows of labelled that hold it, with repeats), as many rows as there are windows, and so grows
    with the corpus.
    """
    full = (labelled.select("blocked", "n", F.explode(grams(F.col("url"), order)).alias("gram"))
            .groupBy("gram").agg(*(F.sum(F.when(F.col("blocked") == F.lit(c == "b"), F.col("n")).otherwise(0)).alias(c) for c in "ab"), F.count("*").alias("m")))
    return interpolated(C.cut(full), order)


def score(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """key, score: mean log ratio of a url's windows; those that the model lacks fall back to shorter contexts.

    urls: key, url with one row per key. Each different new window is judged once, from the model's
    counts. Windows such as '://' occur in every url: those that make up more than one in HOT of all
    are at most HOT, are broadcast and are summed before the shuffle; the others join by window.
    """
    x = urls.select("key", F.explode(grams(F.col("url"), order)).alias("gram"))
    new = C.cut(x.select("gram").distinct().join(model.select("gram"), "gram", "left_anti"))
    if not new.isEmpty():
        zero = F.lit(0).cast("long")
        model = C.cut(interpolated(C.cut(model.select("gram", "a", "b", "m").union(new.select("gram", zero, zero, zero))), order))
    total = model.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot = F.broadcast(model.where(F.col("m") * HOT > total).select("gram", "llr"))
    parts = x.join(hot, "gram").unionByName(x.join(hot.select("gram"), "gram", "left_anti").join(model.select("gram", "llr"), "gram"))
    return parts.groupBy("key").agg((F.sum("llr") / F.count("*")).alias("score"))


def calibrated(scores: DataFrame) -> float:
    """The cut at which the two classes' shares of wrong verdicts add up to the least, from score, blocked, n.

    Scores are counted in steps of STEP; of several best cuts in a row the middle one is taken. 0 where
    a class has no rows.
    """
    cells = scores.groupBy(F.round(F.col("score") / STEP).cast("long").alias("at"), "blocked").agg(F.sum("n").alias("n")).collect()
    ends = {c: sum(r["n"] for r in cells if r["blocked"] == c) for c in (True, False)}
    if not all(ends.values()):
        return 0.0
    at = sorted({r["at"] for r in cells})
    share = {(r["at"], r["blocked"]): r["n"] / ends[r["blocked"]] for r in cells}
    # a cut lies between two steps that occur; below all of them every accepted url is wrong
    wrong, errors = 1.0, [(1.0, at[0] - 1.0)]
    for k, x in enumerate(at):
        wrong += share.get((x, True), 0.0) - share.get((x, False), 0.0)
        errors.append((wrong, (x + at[k + 1]) / 2 if k + 1 < len(at) else x + 1.0))
    least = min(e for e, _ in errors)
    best = [x for e, x in errors if e <= least + 1e-9]
    return best[(len(best) - 1) // 2] * STEP


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    The rules label the urls that they fit. Both models are trained on four fifths of those, by
    crc32 of the url, and score all whole urls; the last fifth sets the cut (see calibrated), and a
    url without a rule is blocked if its mean log ratio exceeds it. A null url scores as an empty
    text; host and path of it, and of a url without '://', are empty. Equal urls get equal scores
    and are scored once; those that many rows share are joined by a broadcast of at most HOT urls.
    Very long urls are scored whole. Repeated rows each get their row; other columns are not read;
    an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("ruled"))
    per = C.cut(p.groupBy("url", "ruled").agg(F.count("*").alias("n")).withColumn("aside", F.crc32("url") % 5 == 0))
    # those that teach nothing are there with n 0, so that the model has their windows too
    known = per.select("url", F.when(F.col("ruled").isNull() | F.col("aside"), 0).otherwise(F.col("n")).alias("n"), (F.col("ruled") == "block").alias("blocked"))
    model = C.cut(train(known, order))
    scored = score(per.select(F.col("url").alias("key"), "url"), model, order)
    scored = C.cut(per.join(scored, per.url == scored.key).select("key", "score", "n", "ruled", "aside"))
    at = calibrated(scored.where("aside and ruled is not null").select("score", (F.col("ruled") == "block").alias("blocked"), "n"))
    rows = scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = scored.where(F.col("n") * HOT > rows).select(F.col("key").alias("hot_key"), F.col("score").alias("hot_score"))
    out = p.join(F.broadcast(hot), F.col("url") == F.col("hot_key"), "left")
    # rows that are done keep out of the others' way
    rest = F.when(F.col("hot_score").isNotNull(), F.concat(F.lit("\x00"), F.xxhash64("page_id").cast("string"))).otherwise(F.col("url"))
    out = out.withColumn("rest", rest).join(scored.select("key", "score"), F.col("rest") == F.col("key"), "left")
    out = out.withColumn("score", F.coalesce("hot_score", "score"))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("ruled", F.when(F.col("score") > at, "block").otherwise("allow")).alias("verdict"), "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op8_url_filters": (op8_url_filters, None)}
