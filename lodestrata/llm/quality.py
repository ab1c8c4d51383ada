"""Quality rules: distribution divergence from language references, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Common words of the languages that have a word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "für"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Character classes besides a-z and the rest, as members of a regular expression's class.
CLASSES = {"upper": "A-Z", "digit": "0-9", "space": "\\x20\\x09-\\x0D", "stop": ".,;:!?'\"()\\-", "symbol": "#*$%&|<>"}
#: Words below which a method histogram is not judged.
MIN_CHAR_WORDS, MIN_COMMON_WORDS = 40, 60
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) from the language's reference.
MAX_CHAR, MAX_COMMON = 0.26, 0.262
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
LANGUAGES_BROADCAST = 10_000


def _among(words: list):
    return lambda x: x.isin(words)


def histograms(docs: DataFrame) -> DataFrame:
    """docs (text, lang and others) with w (words), n_words, n_symbols, word_chars, chars and common.

    chars counts a-z, CLASSES and the rest; common counts the language's common words and all other
    words, and is null for a language without a list. What a-z leaves of a text is short, and all
    other classes are counted on that.
    """
    d = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    d = d.withColumn("__rest", F.regexp_replace("__t", "[a-z]+", ""))
    for name, members in CLASSES.items():
        d = d.withColumn(f"__{name}", F.length(F.regexp_replace("__rest", f"[^{members}]+", "")))
    d = d.withColumn("__n", F.length("__t")).withColumn("__lower", F.col("__n") - F.length("__rest"))
    d = d.withColumn("w", C.words(F.col("__t")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    lists = own = F.lit(None).cast("array<string>")
    for lang, v in COMMON.items():
        lists = F.when(F.col("lang") == lang, F.array(*map(F.lit, v))).otherwise(lists)
        own = F.when(F.col("lang") == lang, F.filter("w", _among(v))).otherwise(own)
    d = d.withColumn("__own", own)
    own = F.col("__own")
    d = d.withColumn("__counts", F.transform(lists, lambda c: (F.size(own) - F.size(F.array_remove(own, c))).cast("double")))
    known = [F.col(f"__{x}") for x in ("lower", *CLASSES)]
    rest = F.col("__n")
    for k in known:
        rest = rest - k
    chars = F.array(*(x.cast("double") for x in (*known, rest)))
    common = F.concat("__counts", F.array((F.col("n_words") - F.size("__own")).cast("double")))
    return d.withColumns({"word_chars": (F.col("__n") - F.col("__space")).cast("long"), "n_symbols": F.col("__symbol").cast("long"), "chars": chars, "common": common}).drop(
        "__n", "__own", "__counts", "__lower", "__rest", *(f"__{x}" for x in CLASSES))


def references(hists: DataFrame) -> DataFrame:
    """For each language the summed histograms over all its documents: ref_lang, ref_chars, ref_common."""
    n = len(CLASSES) + 2
    most = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(most)]
    g = hists.groupBy("lang").agg(*sums)
    return g.select(F.col("lang").alias("ref_lang"), F.array(*(f"c{i}" for i in range(n))).alias("ref_chars"), F.array(*(f"w{i}" for i in range(most))).alias("ref_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays; null if either has no counts or is null."""
    def part(h):
        total = F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, F.transform(h, lambda x: x / total))

    def term(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    div = F.aggregate(F.zip_with(part(a), part(b), lambda p, q: (term(p, q) + term(q, p)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.sqrt(F.when(div < 0, 0.0).otherwise(div)), 6)


def repeats(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of w inside windows of WINDOW words that are found twice or more.

    Windows are compared by 64-bit hash. Only where some repeat are their places sorted by hash;
    the words covered are the sum of the gaps between the places that repeat, each at most WINDOW.
    """
    n = F.size("w") - WINDOW
    d = d.withColumn("__w", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("__h", F.when(n > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(WINDOW))))))
    d = d.withColumn("__again", F.coalesce(F.size(F.array_distinct("__h")) < F.size("__h"), F.lit(False)))
    d = d.withColumn("__s", F.when(F.col("__again"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    near = lambda x, i: F.coalesce((F.get(s, i)["h"] == x["h"]), F.lit(False))
    twins = F.filter(s, lambda x, i: near(x, i - 1) | near(x, i + 1))
    d = d.withColumn("__p", F.when(F.col("__again"), F.array_sort(F.transform(twins, lambda x: x["i"]))))
    p = F.col("__p")
    gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.when(F.col("__again"), total).otherwise(F.lit(0)).cast("long")).drop("__w", "__h", "__again", "__s", "__p")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """docs (text, lang and others) with BASE, chars and common, for each row by itself."""
    d = histograms(docs)
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(f"[^{C.SPACES}]")))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return repeats(d).drop("__lines", "__t", "w")


def verdict(d: DataFrame, refs: DataFrame) -> DataFrame:
    """measured() rows with base_failed, char_distance, common_distance and kept."""
    d = d.join(F.broadcast(refs) if refs.count() <= LANGUAGES_BROADCAST else refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    d = d.withColumns({"char_distance": distance(F.col("chars"), F.col("ref_chars")), "common_distance": distance(F.col("common"), F.col("ref_common"))})
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    far = (F.col("n_words") >= MIN_CHAR_WORDS) & (F.col("char_distance") > MAX_CHAR) | (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("common_distance") > MAX_COMMON)
    return d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("chars", "common", "ref_chars", "ref_common", "ref_lang")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id with BASE, base_failed, char_distance, common_distance and kept, for each row of docs.

    docs: doc_id, text, lang. Texts are read once and become narrow rows; the references are sums
    of those, one row a language. kept is false where base_failed, or where a histogram of enough
    words is farther from the language's reference than its limit. Null and empty texts have no
    words and fail the base rules. A null language has a reference of its own and no common words.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    d = C.cut(measured(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))).drop("text"))
    return verdict(d, C.cut(references(d))).drop("lang")


def clean(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang and others) that judge() keeps, with all their columns.

    References come from a first pass; the second judges and keeps rows where they are read, so no
    text is shuffled.
    """
    inner = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    refs = C.cut(references(histograms(inner.select("text", "lang"))))
    # a random column keeps the optimizer from moving the filter below, where it would repeat all that it rests on
    judged = verdict(measured(inner).withColumn("__r", F.rand()), refs)
    return judged.where(F.col("kept") & (F.col("__r") >= 0)).select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _class(members: str) -> str:
    return f"length(regexp_replace(t, '[^{members}]+', '', 'g'))".replace("[^.,;:!?'", "[^.,;:!?''")


def _jsd(a: str, b: str) -> str:
    p, q = (f"list_transform({x}, lambda y: y / list_sum({x}))" for x in (a, b))
    return (f"case when list_sum({a}) > 0 and list_sum({b}) > 0 then round(sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: "
            "(case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end + case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end) / 2)))), 6) end")


_LISTS = " ".join(f"when '{k}' then {v}" for k, v in COMMON.items())
_N = len(CLASSES) + 2
SQL = f"""
with a as (select doc_id, lang, coalesce(text, '') as t, case lang {_LISTS} end as list from documents),
b as (select *, list_filter(regexp_split_to_array(t, '[{C.SPACES}]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{C.SPACES}]')) as lines,
    [length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')), {', '.join(_class(m) for m in CLASSES.values())}]::double[] as c from a),
d as (select doc_id, lang, len(w)::bigint as n_words, (length(t) - c[4])::bigint as word_chars, c[6]::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, list_append(c, length(t) - list_sum(c)) as chars,
    list_transform(list, lambda k: len(list_filter(w, lambda x: x = k))::double) as k, w from b),
h as (select *, case when k is not null then list_append(k, n_words - list_sum(k)) end as common from d),
r as (select lang, [{', '.join(f'sum(chars[{i + 1}])' for i in range(_N))}] as rc, [{', '.join(f'sum(common[{i + 1}])' for i in range(13))}] as rw from h group by lang),
p as (select doc_id, n_words, unnest(range(1, n_words - {WINDOW} + 2)) as i, w from d where n_words >= {WINDOW}),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) as m from p),
e as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from g, range({WINDOW}) as x(j) where m > 1 group by 1),
f as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    {_jsd('chars', 'rc')} as char_distance, {_jsd('common', 'rw')} as common_distance
  from h left join r on h.lang is not distinct from r.lang left join e using (doc_id))
select *, not base_failed and not coalesce(n_words >= {MIN_CHAR_WORDS} and char_distance > {MAX_CHAR}, false)
  and not coalesce(n_words >= {MIN_COMMON_WORDS} and common_distance > {MAX_COMMON}, false) as kept from f
"""
QUERIES = {"op2_quality_rules": (op2_quality_rules, SQL)}
