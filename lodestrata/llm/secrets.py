"""Secret scans: candidates, features, and a random forest as DataFrame expressions."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Words near a secret, words near something that only looks like one, and place holders.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private_key")
PLAIN_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "version", "revision", "uuid", "guid", "example", "http", "https", "isbn", "doi", "phone", "id")
HOLDERS = ("changeme", "example", "placeholder", "xxxx", "your", "dummy", "sample", "redacted", "123456", "test", "none", "null", "todo")
#: What is given behind a secret word and a sign, from six characters; what stands for a password in an
#: address; three parts or more with dots between; and runs of twelve key characters or more.
_KEY = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[A-Za-z0-9_-]{0,8}"
_GIVEN = r"[ \t]{0,2}[=:][ \t]{0,2}[\"']{0,1}"
_EDGE = r"(?:(?<![A-Za-z0-9_+/%-])(?<!%[0-9A-Fa-f])|(?<=%[0-9A-Fa-f]{2}))"
RUN = "|".join((
    rf"(?<=[=:][ \t]{{0,2}}[\"']{{0,1}})(?<={_KEY}[\"']{{0,1}}{_GIVEN})[^\s\"'<>,;]{{5,}}[^\s\"'<>,;.)]",
    r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]{4,}+(?=@)",
    rf"{_EDGE}(?:[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]{{8,}}+){{2,}}+|[A-Za-z0-9_+/\-]{{12,}}+={{0,2}}+)"))
CONTEXT, CUT = 48, 0.5
#: Words of the dictionary, the most frequent ones of the corpus; letters of a transition: a to z, and all else.
DICTIONARY, LETTERS = 4000, 27
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "changes", "transitions", "coverage", "path", "near_secret", "near_plain", "holder", "assigned", "quoted", "hexlike", "longest_word", "prefix", "different", "in_address", "parts")
TREES, DEPTH, SEED = 25, 8, 20_240_613
MASK = "[SECRET]"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The most frequent words of 4 to 16 letters a-z, beside no digit, in all texts, with their numbers; ties by word.

    Counts are combined before the shuffle; the size bounds what is collected. An empty table has none.
    """
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9])[a-z]{4,16}+(?![a-z0-9])"), F.lit(0))).alias("word"))
    return [(r["word"], r["n"]) for r in w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()]


def transitions(words: list[tuple[str, int]]) -> list[float]:
    """Log-likelihood of each letter behind each other one, in the dictionary's words by their numbers, smoothed.

    A transition from or to what is no letter has the likelihood of chance.
    """
    c = np.ones((LETTERS, LETTERS))
    for w, n in words:
        for a, b in zip(w, w[1:]):
            c[ord(a) - 97, ord(b) - 97] += n
    p = np.log(c / c.sum(1, keepdims=True))
    p[-1, :] = p[:, -1] = -math.log(LETTERS)
    return np.round(p, 6).ravel().tolist()


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")


def features(v: Column, before: Column, after: Column, words: list[tuple[str, int]]) -> dict[str, Column]:
    """FEATURES of a candidate and its context, as double columns.

    Candidate length; shares of character kinds and of changes between kinds; the mean log-likelihood
    of its letters' transitions; the share that dictionary words cover; whether it looks like a path,
    stands in an address or has parts; and words beside it.
    """
    low, near = F.lower(v), F.lower(F.concat_ws(" ", before, after))
    n = F.length(v)
    left = lambda p: (n - F.length(F.regexp_replace(v, p, ""))).cast("double")
    kind = F.translate(v, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26)
    runs = F.length(F.regexp_replace(kind, r"(.)\1*", "x"))
    word = lambda ws: r"(?<![a-z0-9])(" + "|".join(ws) + r")(?![a-z])"
    flag = lambda x: x.cast("double")
    longest = F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda w: F.length(w)))
    code = lambda c: F.coalesce(F.when(c.between("a", "z"), F.ascii(c) - 97), F.lit(LETTERS - 1))
    table = F.array(*map(F.lit, transitions(words)))
    # letters are split off once: a substring at each place would walk there from the beginning
    pairs = C.let(F.transform(F.split(low, ""), code), lambda cs: F.zip_with(F.slice(cs, 1, n - 1), F.slice(cs, 2, n - 1), lambda a, b: F.coalesce(a, F.lit(LETTERS - 1)) * LETTERS + F.coalesce(b, F.lit(LETTERS - 1))))
    likely = F.aggregate(pairs, F.lit(0.0), lambda s, k: s + F.get(table, k))
    parts = F.transform(F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower)
    known = [w for w, _ in words] or [""]
    covered = F.aggregate(F.filter(parts, lambda w: w.isin(known)), F.lit(0), lambda s, w: s + F.length(w))
    return {
        "length": flag(n), "digits": _share(left("[0-9]"), n), "uppers": _share(left("[A-Z]"), n), "lowers": _share(left("[a-z]"), n), "marks": _share(left("[^A-Za-z0-9]"), n),
        "changes": _share(runs - 1, n - 1), "transitions": _share(likely, n - 1), "coverage": _share(covered, n), "path": flag(v.rlike(r"^/|/.*/|\.[a-z]{2,4}$") | before.rlike(r"(://|/|\\)\S*$")),
        "near_secret": flag(F.lower(before).rlike(word(SECRET_WORDS) + r"[^.\n]{0,24}$")), "near_plain": flag(near.rlike(word(PLAIN_WORDS))), "holder": flag(low.rlike("|".join(HOLDERS))),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$") | v.rlike(r"^[A-Za-z_]+=")), "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")), "hexlike": flag(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$")),
        "longest_word": _share(longest, n), "prefix": flag(v.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|sk_live_|pk_live_|AIza|eyJ)")), "different": _share(F.size(F.array_distinct(F.split(v, ""))).cast("double"), n),
        "in_address": flag(before.rlike(r"://[^\s/:@]*:$") & after.rlike("^@")), "parts": flag(F.size(F.split(v, r"\.")) - 1),
    }


def labelled_findings(words: list[tuple[str, int]], n: int = 4000, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """value, before, after, label: findings labelled by how they were made, by a seeded generator.

    True ones: cloud key ids, service tokens, hex and base64 keys, tokens of three parts, passwords of
    words, digits and signs, beside words of their kind, in addresses or bare. False ones: long words,
    names and addresses, hashes and ids named as such, paths, place holders, numbers, dates, versions,
    and plain words behind a secret word. Plain words come from the dictionary; n is a documented bound.
    """
    r = random.Random(seed)
    plain = [w for w, _ in words] or ["word", "plain", "other", "these", "about", "there"]
    hexes, b64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: r.choice(plain)
    prose = lambda: " ".join(word() for _ in range(6))
    dotted = lambda: f"eyJ{some(alnum, r.randrange(12, 30))}.{some(alnum + '_-', r.randrange(16, 60))}.{some(alnum + '_-', r.randrange(20, 44))}"
    pad = lambda w: w if len(w) >= 12 else pad(w + word())

    def password():
        w = word()
        if r.random() < 0.5:
            w = "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "$"}.get(c, c) if r.random() < 0.5 else c for c in w)
        w = r.choice([w, w.capitalize(), w.upper()])[:r.randrange(4, 12)] + r.choice(["", some("0123456789", r.randrange(1, 5))]) + r.choice(["", some("!$&#%*-_?+^", r.randrange(1, 3))]) + some(alnum, r.randrange(1, 5))
        return w if len(w) >= 6 else w + some("0123456789", 6)

    def true():
        key = r.choice(SECRET_WORDS)
        given = lambda: r.choice([(f"{prose()} {key}=", " " + prose()), (f'{prose()} {key} = "', '" ' + prose()), (f"{prose()} {key}: ", " " + prose()), (f"{prose()} {key.upper()}='", "' " + prose()), (f"{prose()} my_{key}=", "\n" + prose())])
        kind = r.random()
        if kind < 0.25:
            return password(), *given()
        if kind < 0.35:
            return r.choice([password, lambda: some(alnum, r.randrange(8, 24))])(), f"{prose()} {r.choice(['https', 'postgres', 'mysql', 'ftp', 'redis'])}://{word()}:", f"@{word()}.{word()}/{word()}"
        if kind < 0.45:
            return dotted(), *r.choice([given(), (prose() + " ", " " + prose()), (prose() + " bearer ", " " + prose())])
        v = r.choice([lambda: "AKIA" + some(alnum[:26] + r.choice(["", "234567", "0123456789"]), 16), lambda: r.choice(["AKIA", "ASIA"]) + some(alnum[:26] + "234567", 16), lambda: "ghp_" + some(alnum, 36), lambda: some(hexes, r.choice([18, 32, 40, 64])), lambda: some(b64, r.choice([24, 40, 44])), lambda: "sk_live_" + some(alnum, 24), lambda: some(alnum, r.randrange(14, 33))])()
        if v.startswith(("AKIA", "ASIA", "ghp_", "sk_live_")):
            return v, prose() + r.choice([" ", " ", ".", "="]), " " + prose()
        return r.choice([(v, *given()), (f"{key}={v}" if r.random() < 0.3 else v, f"{prose()} {key} ", " " + prose())])

    def false():
        near = lambda: r.choice([prose() + " ", prose() + " " + r.choice(PLAIN_WORDS) + " ", prose() + ": "])
        return r.choice([
            lambda: (pad(word()), near(), " " + prose()), lambda: (pad(word()).upper(), near().upper(), "!! " + prose().upper()), lambda: (pad(word()).capitalize(), near(), ", " + prose()), lambda: ("-".join(word() for _ in range(4)), near(), " " + prose()),
            lambda: (some("0123456789", r.randrange(12, 20)), near(), " " + prose()), lambda: (some(hexes, r.choice([32, 40, 64])), f"{prose()} {r.choice(PLAIN_WORDS[:8])} ", " " + prose()), lambda: ("/".join(word() for _ in range(4)), prose() + " /", " " + prose()),
            lambda: (f"{word()}_{word()}_{word()}_{r.randrange(99)}", near(), " " + prose()), lambda: (r.choice(HOLDERS) + some("0123456789", 6) + word(), f"{prose()} {r.choice(SECRET_WORDS)}=", " " + prose()),
            lambda: (f"20{r.randrange(10, 30)}-0{r.randrange(1, 9)}-{r.randrange(10, 29)}T{r.randrange(10, 24)}", near(), " " + prose()), lambda: ("-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), f"{prose()} {r.choice(('uuid', 'guid', 'id'))} ", " " + prose()),
            lambda: (f"{pad(word())}{r.randrange(1000)}", near(), " " + prose()), lambda: (r.choice("-_") * r.randrange(12, 40), near(), "\n"), lambda: (pad(f"{word()}-{word()}"), prose() + " ", f"@{word()}.{word()}"), lambda: (pad(word()), f"{prose()} {r.choice(['www', word()])}.", f".{word()} " + prose()),
            lambda: (pad(word()), f"{prose()} https://{word()}/", f"?{word()}"), lambda: (f"{pad(word())}.{pad(word())}.{pad(word())}", near(), " " + prose()), lambda: (word() if r.random() < 0.7 else f"{word()}-{word()}", f"{prose()} {r.choice(SECRET_WORDS)}: ", " " + prose()),
            lambda: (pad(word()), f"{prose()} {r.choice(SECRET_WORDS)} ", " " + prose()), lambda: (r.choice(HOLDERS), f'{prose()} {r.choice(SECRET_WORDS)}="', '"'), lambda: (some("0123456789", r.randrange(3, 8)) + "-" + some("0123456789", r.randrange(6, 9)), near(), " " + prose())])()

    return [(*true(), 1) if i % 2 else (*false(), 0) for i in range(n)]


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Bagged trees with random features at each split; a tree is (feature, cut, left, right) or a share."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.round(x, 9)  # no cut between values that differ by an error of rounding only
    tries = max(2, round(2 * math.sqrt(x.shape[1])))

    def grow(at, level):
        share = float(y[at].mean())
        if level == depth or len(at) < 8 or share in (0.0, 1.0):
            return round(share, 6)
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False).tolist():
            v = np.unique(x[at, f])
            for cut in ((v[1:] + v[:-1]) / 2)[:: max(1, len(v) // 16)].tolist():
                left = x[at, f] <= cut
                if left.all():  # neighbours too close for a cut between them
                    continue
                n, p, q = left.sum(), y[at[left]].mean(), y[at[~left]].mean()
                gini = n * p * (1 - p) + (len(at) - n) * q * (1 - q)
                if best is None or gini < best[0]:
                    best = gini, f, cut, left
        if best is None:
            return round(share, 6)
        _, f, cut, left = best
        return f, cut, grow(at[left], level + 1), grow(at[~left], level + 1)

    return [grow(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]


def tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, cut, left, right = tree
    return f"if(f.{FEATURES[f]} <= {cut!r}D, {tree_sql(left)}, {tree_sql(right)})"


_forests: dict = {}


def forest(spark: SparkSession, words: list[tuple[str, int]]) -> list:
    """The forest over labelled_findings(): their few thousand rows are on the driver anyway."""
    C.trim(spark)
    key = TREES, DEPTH, SEED, tuple(words)
    if key not in _forests:
        _forests.clear()
        x = _measured(spark.createDataFrame(labelled_findings(words), "value string, before string, after string, label int"), words)
        _forests[key] = fit_forest(np.array([list(r)[1:] for r in x], float), np.array([r["label"] for r in x], float))
    return _forests[key]


def _measured(rows: DataFrame, words) -> list:
    f = features(F.col("value"), F.col("before"), F.col("after"), words)
    return rows.select("label", *(f[k].alias(k) for k in FEATURES)).collect()


def judged(docs: DataFrame, words: list[tuple[str, int]], trees: list) -> DataFrame:
    """row (all columns of docs as a struct), t (its text, null as empty), found (an element for each candidate: value,
    score, secret) and gaps (the text between candidates).

    A text is cut at its candidates: what lies between two of them is the context of both, at most
    CONTEXT characters, and on the left the candidate before it too. So a long text is passed over
    twice, however many candidates it holds, and nothing is shuffled.
    """
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("row", "t", F.regexp_extract_all("t", F.lit(RUN), F.lit(0)).alias("v")).withColumn("gaps", F.when(F.size("v") > 0, F.split("t", RUN, -1)).otherwise(F.array("t")))
    # arrays side by side, as a column that a lambda names may be computed for each element
    n = F.size("v")
    beside = F.arrays_zip(F.col("v").alias("value"), F.concat(F.array(F.lit("")), "v").alias("last"), F.slice("gaps", F.lit(1), n).alias("left"), F.slice("gaps", F.lit(2), n).alias("right"))
    d = d.withColumn("z", F.slice(beside, F.lit(1), n))
    d = d.withColumn("c", F.transform("z", lambda x: F.struct(x["value"].alias("value"), F.right(F.concat(x["last"], x["left"]), F.lit(CONTEXT)).alias("before"), F.left(x["right"], F.lit(CONTEXT)).alias("after"))))
    d = d.withColumn("c", F.transform("c", lambda c: F.struct(*(x.alias(k) for k, x in features(c["value"], c["before"], c["after"], words).items()))))
    total = " + ".join(f"({tree_sql(t)})" for t in trees)
    d = d.withColumn("s", F.expr(f"transform(c, f -> round(({total}) / {len(trees)}, 6))"))
    found = F.zip_with("v", "s", lambda v, s: F.struct(v.alias("value"), s.alias("score"), (s >= CUT).alias("secret")))
    return d.select("row", "t", found.alias("found"), "gaps")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, at, value_sha256, chars, score, secret for each candidate of docs (doc_id, text).

    Every row is scanned whole where it is read; only the dictionary's counts are shuffled. Null and
    empty texts hold no candidate; repeated rows and equal values give repeated findings; an empty
    table none. Values are digests only. Other columns are not read, whatever their names.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    words = dictionary(docs)
    d = judged(docs, words, forest(docs.sparkSession, words)).select("row.doc_id", F.posexplode_outer("found").alias("at", "f")).where("f is not null")  # a plain explode would test found in a filter, and so compute it twice
    return d.select("doc_id", F.col("at").cast("long").alias("at"), F.sha2("f.value", 256).alias("value_sha256"), F.length("f.value").cast("long").alias("chars"), "f.score", "f.secret")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by MASK (n_chars, if there, follows); all rows and columns are kept.

    Texts are masked where they are read, without a shuffle. Texts without a secret, nulls too, pass
    as they are. The row is kept apart as a struct, so columns may have any names.
    """
    words = dictionary(docs)
    d = judged(docs, words, forest(docs.sparkSession, words))
    masked = F.zip_with("found", F.slice("gaps", F.lit(2), F.size("found")), lambda f, g: F.concat(F.when(f["secret"], F.lit(MASK)).otherwise(f["value"]), g))
    new = F.concat(F.get("gaps", F.lit(0)), F.array_join(masked, ""))
    d = d.select("row", F.exists("found", lambda f: f["secret"]).alias("any"), new.alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return d.select(*(F.when(F.col("any"), changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_secret_scans": (op3_secret_scans, None)}
