"""Secret scans: patterns find candidates, a random forest trained from labelled findings removes the false ones.

DataFrame functions only. The forest is fitted by Spark's own library and then written as one column
expression, so that documents are scanned, judged and redacted in a single pass without a shuffle.
"""

from __future__ import annotations

import json
from functools import cache, reduce
from itertools import islice
from pathlib import Path

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import cut, double_array

#: Key prefixes, assignments and long mixed strings that may be secrets. Only the secret itself is matched.
CANDIDATE = "|".join([
    r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
    r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|npm_|hf_|eyJ)[A-Za-z0-9_\-.]{16,}",
    r"(?<=[:= \"'])(?<=(?i:pass|pwd|password|passwd|secret|token|key|auth|credential)[\"']{0,1}[ ]{0,2}[:=][ ]{0,2}[\"']{0,1})[^\s\"'<>]{8,}",
    r"(?<![A-Za-z0-9+/=_\-.:])(?=[A-Za-z0-9]*[+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z/]*[0-9+])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9_\-])",
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----",
    r"(?<=:)(?<=://[A-Za-z0-9._~%+\-]{0,64}:)[^\s:@/\"'<>]{6,}(?=@[A-Za-z0-9])",
    r"\b(?=[A-Za-z_\-]{0,200}[0-9])[A-Za-z0-9_\-]{24,}\b",
])
PREFIX = r"^(?:AKIA|ASIA|ABIA|ACCA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|hf_|-----BEGIN )"
#: Words that name a secret, that belong to other long strings, and that show up in placeholders.
NAMING = r"(?i)(?:pass|pwd|secret|token|api|auth|credential|key|login|bearer)"
OTHER = r"(?i)\b(?:commit|sha[0-9]{0,3}|md5|checksum|hash|digest|uuid|guid|revision|etag|integrity|version|order|invoice|phone|card)\b"
MOCK_PATH = r"(?i)(?:test|example|sample|fixture|mock|docs?/|readme)"
PLACEHOLDERS = (
    "account", "admin", "change", "client", "code", "config", "data", "default", "demo", "dummy", "enter", "example", "fake", "file", "foo", "get", "here",
    "insert", "item", "list", "load", "local", "manager", "mode", "module", "name", "number", "object", "password", "path", "placeholder", "replace", "sample", "secret", "server", "service",
    "set", "string", "temp", "test", "text", "time", "token", "type", "update", "user", "value", "view", "welcome", "xxx", "your", "1234",
)
#: Words of prose that may follow a naming word and a colon.
LONG_WORDS = (
    "absolutely", "background", "communication", "description", "environment", "foundation", "generation", "highlights", "information", "knowledge", "leadership", "management",
    "necessary", "opportunity", "performance", "questions", "relationship", "strength", "technology", "understanding", "volunteers", "whatever", "something", "important",
)
FEATURES = ("length", "transitions", "digits", "capitals", "distinct", "hex", "covered", "vowels", "prefix", "naming", "other", "mock_path", "longest_run")
REDACTED = "[SECRET]"
_MARK, _END = "\x01\x03", "\x01\x02"

#: Words of the dictionary: the first so many of a public vocabulary, which is ordered by use.
MOST_WORDS, LEAST_LETTERS = 3_000, 4
LABELLED = 6_000
TREES, DEPTH, SEED, THRESHOLD = 16, 6, 7, 0.5


@cache
def dictionary(path: str | None = None, most: int = MOST_WORDS) -> str:
    """A pattern of common words, each branch taken letter by letter: whole words of a public tokenizer's vocabulary, and the placeholders.

    ``path`` is the vocabulary's file (the driver reads it)."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("word_bpe_49k.json"))
    vocabulary = json.loads(Path(path).read_text())["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>"))
    words = list(islice((w for w in whole if len(w) >= LEAST_LETTERS and w.isascii() and w.isalpha()), most))
    tree: dict = {}
    for w in {*words, *PLACEHOLDERS}:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        branches = [c + pattern(below) for c, below in sorted(at.items()) if c]
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})" if branches else ""
        return f"(?:{body})?" if "" in at and body else body

    return pattern(tree)


def candidate_features(value: Column, left: Column, right: Column, path: Column, words: str | None = None) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n  # noqa: E731  of what stays
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    letters = F.greatest(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(1))
    near = F.concat_ws(" ", left, right)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": F.length(value).cast("double"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": flag(value.rlike("^[0-9a-f]+$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), words or dictionary(), "")) / n,
        "vowels": F.length(F.regexp_replace(value, "[^AEIOUaeiou]", "")) / letters,
        "prefix": flag(value.rlike(PREFIX)),
        "naming": flag(left.rlike(NAMING)),
        "other": flag(near.rlike(OTHER)),
        "mock_path": flag(path.rlike(MOCK_PATH)),
        "longest_run": F.length(F.regexp_extract(value, r"((.)\2{3,})", 1)) / n,
    }


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """Made findings (value, left, right, path, label, kind): a rule for each kind of secret and of look-alike.

    A team's own triaged findings have the same columns and may be used instead or beside."""
    word = lambda salt: F.element_at(F.lit(["the", "request", "from", "server", "will", "return", "each", "value", "section", "page", "after", "with"]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(12)) + 1).cast("int"))
    hexes = F.concat(F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "")
    pick = lambda k, salt=0: F.pmod(F.xxhash64("id", F.lit(100 + salt)), F.lit(k))
    dict_word = lambda salt: F.element_at(F.lit(list(PLACEHOLDERS)), (pick(len(PLACEHOLDERS), salt) + 1).cast("int"))
    long_word = lambda salt: F.element_at(F.lit(list(LONG_WORDS)), (pick(len(LONG_WORDS), salt) + 1).cast("int"))
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    uuid = F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*", "$1-$2-$3-$4-$5")
    code, mock = F.concat(F.lit("src/"), word(5), F.lit(".py")), F.concat(F.lit("tests/fixtures/"), word(5), F.lit(".json"))
    shapes = [  # value, left, path, label
        (F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)), prose, code, 1),
        (F.substring(hexes, 1, 40), F.concat(prose, F.lit(' token = "')), code, 1),
        (F.expr("substring(h, 1, cast(12 + pmod(id, 20) as int))"), F.concat(prose, F.lit(" password=")), code, 1),
        (F.expr("substring(m, 1, cast(16 + pmod(id, 30) as int))"), F.concat(prose, F.lit(" api_key: ")), code, 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), prose, code, 1),
        (F.expr("substring(m, 1, cast(32 + pmod(id, 33) as int))"), F.concat(prose, F.lit(" secret = '")), code, 1),
        (F.expr("substring(h, 1, if(pmod(id, 2) = 0, 40, 64))"), F.concat(F.element_at(F.lit(["commit", "sha256", "checksum", "integrity"]), (pick(4) + 1).cast("int")), F.lit(" ")), code, 0),
        (uuid, F.concat(prose, F.lit(" uuid ")), code, 0),
        (F.concat_ws("_", dict_word(1), dict_word(2), dict_word(3)), F.concat(prose, F.lit(" password=")), code, 0),
        (F.concat(F.initcap(dict_word(1)), F.initcap(dict_word(2)), F.initcap(dict_word(3)), F.initcap(dict_word(4)), F.lit("2")), prose, code, 0),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 9), F.lit("EXAMPLE")), prose, mock, 0),
        (F.regexp_replace(hexes, ".*?([0-9]).*?([0-9]).*", "$1$2$1$2$1$2$1$2$1$2$1$2$1$2$1$2$1$2$1$2$1$2$1$2"), F.concat(prose, F.lit(" order ")), code, 0),
        (F.expr("repeat(substring('x0*', cast(1 + pmod(id, 3) as int), 1), cast(12 + pmod(id, 20) as int))"), F.concat(prose, F.lit(' token = "')), code, 0),
        (F.concat_ws("-", dict_word(1), dict_word(2), dict_word(3), dict_word(4), (F.col("id") % 100).cast("string")), prose, code, 0),
        (F.expr("lower(substring(m, 1, cast(12 + pmod(id, 13) as int)))"), F.concat(prose, F.lit(" DB_PASSWORD=")), code, 1),
        (F.expr("substring(lower(m), 1, cast(10 + pmod(id, 13) as int))"), F.concat(prose, F.lit(' {"password": "')), code, 1),
        (F.expr("concat(substring(l, 1, 4), substring(d, 1, 4), substring(l, 5, 4), substring(d, 5, 4))"), F.concat(prose, F.element_at(F.lit([" DB_PASSWORD=", " API_KEY=", ' "token": "']), (pick(3, 15) + 1).cast("int"))), code, 1),
        (F.concat(F.translate(dict_word(16), "aeos", "4305"), dict_word(17), (F.col("id") % 100).cast("string")), F.concat(prose, F.element_at(F.lit([" password=", " PASSWORD: ", ' "password": "']), (pick(3, 18) + 1).cast("int"))), code, 1),
        (F.expr("substring(b, 1, cast(40 + 4 * pmod(id, 10) as int))"), F.concat(prose, F.element_at(F.lit([" Bearer ", " AccountKey ", " login "]), (pick(3, 9) + 1).cast("int"))), code, 1),
        (F.concat(long_word(11), F.element_at(F.lit(["", ",", ".", "-based"]), (pick(4, 12) + 1).cast("int"))), F.concat(prose, F.element_at(F.lit([" Key: ", " Token: ", " Pass: "]), (pick(3, 13) + 1).cast("int"))), code, 0),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.col("b"), F.lit("\n-----END RSA PRIVATE KEY-----")), prose, code, 1),
        (F.expr("substring(m, 1, cast(8 + pmod(id, 16) as int))"), F.concat(prose, F.lit(" postgres://admin:")), code, 1),
        (F.element_at(F.lit(["password", "changeme", "username", "example", "secret"]), (pick(5, 19) + 1).cast("int")), F.concat(prose, F.lit(" mysql://user:")), code, 0),
        (F.concat_ws("/", dict_word(1), F.initcap(dict_word(2)), F.concat(F.initcap(dict_word(3)), (F.col("id") % 10).cast("string")), dict_word(4), long_word(14)), F.concat(prose, F.lit(" ")), code, 0),
    ]
    made = spark.range(0, n, 1, 4).select("id", hexes.alias("h"), mixed.alias("m"), F.base64(F.unhex(hexes)).alias("b"), F.translate(hexes, "0123456789", "ghjkmnprst").alias("l"), F.translate(hexes, "abcdef", "274953").alias("d"))
    at = F.pmod(F.col("id"), F.lit(len(shapes)))
    case = lambda k: reduce(lambda acc, i: acc.when(at == i, shapes[i][k] if k < 3 else F.lit(shapes[i][k])), range(1, len(shapes)), F.when(at == 0, shapes[0][k] if k < 3 else F.lit(shapes[0][k])))
    finding = F.struct(case(0).alias("value"), case(1).alias("left"), prose.alias("right"), case(2).alias("path"), case(3).alias("label"), at.alias("kind"))
    return made.select(F.inline(F.transform(F.array("id"), lambda _: finding)))  # in a lambda, where branches aren't compiled


def fit_forest(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest from labelled findings; rows with a null value or label are left out."""
    known = findings.where("value is not null and label is not null")
    cols = candidate_features(F.col("value"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.coalesce("path", F.lit("")))
    data = known.select(F.col("label").cast("double").alias("label"), *(c.alias(k) for k, c in cols.items()))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("label", "features").coalesce(1)
    vectors = cut(vectors)  # the fit's jobs read vectors; otherwise each plans and compiles the findings' and features' expressions again
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def forest_column(model: RandomForestClassificationModel, feature) -> Column:
    """The forest's mean vote for label 1, as an expression over ``feature(name)`` columns.

    Nodes are entries of constant arrays, and each tree is walked from its root; a leaf is its own child. The expression
    is as small as one node's, whatever the size of the forest, so the driver plans it at once."""
    column: list[int] = []
    threshold: list[float] = []
    low: list[int] = []
    high: list[int] = []
    vote: list[float] = []

    def add(node) -> int:
        at = len(column)
        for values, start in ((column, 0), (threshold, 0.0), (low, at), (high, at), (vote, 0.0)):
            values.append(start)
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            vote[at] = float(stats[1] / (stats[0] + stats[1])) if len(stats) > 1 and stats[0] + stats[1] else float(node.prediction())
        else:
            split = node.split()
            column[at], threshold[at] = split.featureIndex(), float(split.threshold())
            low[at], high[at] = add(node.leftChild()), add(node.rightChild())
        return at

    tops = [t._java_obj.rootNode() for t in model.trees]
    levels = max(t.subtreeDepth() for t in tops)
    roots = [add(t) for t in tops]
    of_column, of_low, of_high = (F.split(F.lit(",".join(map(str, v))), ",").cast("array<int>") for v in (column, low, high))
    of_threshold, of_vote = double_array(threshold), double_array(vote)
    down = lambda x, at: F.when(F.get(x, F.get(of_column, at)) <= F.get(of_threshold, at), F.get(of_low, at)).otherwise(F.get(of_high, at))
    leaf = lambda x, root: F.aggregate(F.lit([0] * levels).cast("array<int>"), root, lambda at, _: down(x, at))
    votes = lambda x: F.aggregate(F.lit(roots).cast("array<int>"), F.lit(0.0), lambda total, root: total + F.get(of_vote, leaf(x, root)))
    return F.get(F.transform(F.array(F.array(*(feature(k) for k in FEATURES))), votes), F.lit(0)) / len(roots)


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_candidates, secrets (array of value and score, in text order) and redacted.

    In ``redacted`` each secret is replaced by ``[SECRET]`` and all else is kept to the letter; a text
    without secrets equals itself. Null texts have no candidates and stay null. Control characters are
    kept. A text may have any number of candidates; each is judged by itself."""
    text, path = F.col(text_col), F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    guarded = F.replace(text, F.lit("\x01"), F.lit(_END))
    marked = F.regexp_replace(guarded, CANDIDATE, f"{_MARK}$0{_MARK}")
    step = docs.withColumn("__parts", F.split(marked, _MARK))  # candidates at odd places
    parts = F.col("__parts")
    odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    found = F.transform(odd, lambda i: F.struct(F.get(parts, i).alias("value"), F.right(F.get(parts, i - 1), F.lit(48)).alias("left"), F.left(F.get(parts, i + 1), F.lit(32)).alias("right")))
    featured = F.transform(found, lambda c: F.struct(c["value"].alias("value"), F.struct(*(v.alias(k) for k, v in candidate_features(c["value"], c["left"], c["right"], path).items())).alias("f")))
    judged = F.transform(featured, lambda c: F.struct(c["value"].alias("value"), forest_column(model, lambda k: c["f"][k]).alias("score")))
    step = step.withColumn("__judged", judged)
    verdicts = F.col("__judged")
    whole = F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (F.get(verdicts, F.floor(i / 2).cast("int"))["score"] >= threshold), F.lit(REDACTED)).otherwise(p)), "")
    return step.withColumns({
        "n_candidates": F.coalesce(F.size("__judged"), F.lit(0)).cast("long"),
        "secrets": F.coalesce(F.filter("__judged", lambda c: c["score"] >= threshold), F.array().cast("array<struct<value:string,score:double>>")),
        "redacted": F.when(F.size(parts) > 1, F.replace(whole, F.lit(_END), F.lit("\x01"))).otherwise(text),
    }).drop("__parts", "__judged")


def op3_secret_scans(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_candidates, n_secrets, secrets, redacted_chars, redacted_sha256 (null text: null)."""
    model = fit_forest(labelled_findings(docs.sparkSession))
    found = scan(docs, model)
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.transform("secrets", lambda s: s["value"]).alias("secrets"),
        F.length("redacted").cast("long").alias("redacted_chars"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"),
    )
