"""Secret scanning: every candidate string of whole texts, judged by a random forest trained from labelled findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, join_back, keyed, text_of, words_of

#: What may stand before a value: an assignment to a name that reads as a secret's, or the user of a URL.
ASSIGNED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[A-Za-z0-9_-]{0,20}[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?"
USER = r"://[^ \t\n\x0B\f\r/:@]{1,64}:"
ASSIGNED_VALUE = r"[^ \t\n\x0B\f\r\"',;<>]{6,}"
USER_VALUE = r"[^ \t\n\x0B\f\r/@]{3,}(?=@)"
#: A private key; a run of at least 12 token characters with a digit, or of 20 without one, points inside long tokens included.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"
_NAMED = "(?i:pass|pwd|secret|token|key|auth|credential)"
#: Every repetition of a group is possessive, so that a text of many parts costs neither a call of its own for each part nor a second look at what was read; a run that has such a
#: name before a sign of assignment is no value, which is told from its first name alone.
RUN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z+/_-]{20})"
    rf"(?!(?:(?!{_NAMED})[A-Za-z0-9_-])*+{_NAMED}[A-Za-z0-9_-]*+[\"']?[ \t]{{0,4}}[:=])"
    r"[A-Za-z0-9+/_-]{12,}+(?:\.[A-Za-z0-9_-]{10,}+)*+={0,2}+"
)
CANDIDATE = f"{KEY_BLOCK}|{ASSIGNED}{ASSIGNED_VALUE}|{USER}{USER_VALUE}|{RUN}"
#: The part of a match that is before its value.
LEAD = f"^(?:({ASSIGNED}){ASSIGNED_VALUE}|({USER})[^ \\t\\n\\x0B\\f\\r/@]{{3,}})$"
CONTEXT = 64
#: Names that assign a secret, and those that assign something that only looks like one.
SECRET_NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?([_-]?[0-9]+)?$"
PUBLIC_NAMES = r"(?i)(commit|sha\d*|md5|crc\d*|digest|checksum|etag|uuid|guid|revision|version|id)$"
HASHED = 16


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each candidate: __row, doc_id, path, start (code points), value, before, after.

    Candidates are values assigned to a name that reads as a secret's (6 characters or more), passwords in
    URLs, private keys, and long runs of token characters. ``before`` and ``after`` are up to CONTEXT code points
    around the value, as far as the neighbouring candidates' own ends. A text is cut at its candidates once; starts are
    running sums of the pieces.
    """
    rows = _cut(docs, text_col, col(id_col).alias("doc_id"), col(path_col).cast("string").alias("path"))
    before = F.concat(F.coalesce("beside", F.lit("")), "piece", "lead")
    return rows.select(
        "__row",
        "doc_id",
        "path",
        "start",
        F.substr("match", F.char_length("lead") + 1).alias("value"),
        F.right(before, F.lit(CONTEXT)).alias("before"),
        F.left(F.concat("next", F.coalesce("behind", F.lit(""))), F.lit(CONTEXT)).alias("after"),
    )


def _cut(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """A row for each match: __row, ``columns``, k, piece (what is before it), match, next (what is behind), beside and behind (the matches there), lead, start of the value.

    Each row holds its own pieces alone, and starts are running sums over the matches of a text, so a text costs as much as it is long.
    """
    rows = keyed(docs, *columns, text_of(text_col).alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    rows = rows.select("*", F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)).alias("__m")).filter(F.size("__m") > 0)
    rows = rows.select(*names, "__m", F.split("__text", CANDIDATE, -1).alias("__p"))

    def part(m, k):
        beside = F.when(k > 0, F.get("__m", F.greatest(k - 1, F.lit(0))))
        return F.struct(m.alias("match"), F.get("__p", k).alias("piece"), F.get("__p", k + 1).alias("next"), beside.alias("beside"), F.get("__m", k + 1).alias("behind"))

    rows = rows.select(*names, F.posexplode(F.transform("__m", part)).alias("k", "__x")).select(*names, "k", "__x.*")
    rows = rows.withColumn("lead", F.concat(F.regexp_extract("match", LEAD, 1), F.regexp_extract("match", LEAD, 2)))
    earlier = Window.partitionBy("__row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.char_length("piece") + F.char_length("match")).over(earlier), F.lit(0))
    return rows.withColumn("start", (passed + F.char_length("piece") + F.char_length("lead")).cast("long"))


def dictionary(docs: DataFrame, min_count: int = 20, text_col: str = "text") -> DataFrame:
    """(word): lower-case letter words of at least three letters that the texts use ``min_count`` times or more."""
    words = docs.select(F.explode(words_of(F.lower(text_of(text_col)))).alias("w")).filter(F.col("w").rlike(r"^\p{L}{3,}[.,]?$"))
    words = words.groupBy(F.regexp_replace("w", "[.,]$", "").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.filter(F.col("n") >= min_count).select("word")


def features(found: DataFrame, known_words: DataFrame) -> DataFrame:
    """Numeric features of each candidate, in columns f0, f1, ...

    Length; shares of digits, upper case and lower case; changes between these kinds for each pair
    of neighbours; distinct characters; share of letters in runs that the dictionary has; marks
    around it (quote, assignment, slash before, point after); the path's and the neighbouring
    words' hash buckets; whether the assigned name reads as a secret's.
    """
    value = F.col("value")
    n = F.char_length(value).cast("double")
    runs = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda r: F.char_length(r) >= 3)
    found = found.withColumn("runs", runs)
    pieces = found.select("__row", "start", F.explode("runs").alias("run"))
    covered = pieces.join(known_words, pieces["run"] == known_words["word"]).groupBy(F.col("__row").alias("__r"), F.col("start").alias("__at")).agg(F.sum(F.char_length("run")).alias("covered"))
    found = found.join(covered, (F.col("__row") == F.col("__r")) & (F.col("start") == F.col("__at")), "left").drop("__r", "__at", "runs")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    name = F.regexp_extract("before", r"([A-Za-z_][A-Za-z0-9_.-]*)[\"']?[ \t]*[=:][ \t]*[\"']?$", 1)
    last = F.regexp_extract("before", r"([^ \t\n\x0B\f\r]+)[ \t\n\x0B\f\r\"'=:]*$", 1)
    first = F.regexp_extract("after", r"^[ \t\n\x0B\f\r\"',;.]*([^ \t\n\x0B\f\r]+)", 1)
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    flag = lambda c: c.cast("double")
    bucket = lambda c: F.pmod(F.xxhash64(F.lower(F.coalesce(c, F.lit("")))), F.lit(HASHED)).cast("double")
    listed = [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("[+/_=-]") / n,
        F.regexp_count(value, F.lit(change)).cast("double") / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        F.coalesce(F.col("covered"), F.lit(0)).cast("double") / n,
        flag(F.col("before").rlike("[\"']$")),
        flag(F.col("before").rlike(r"[=:][ \t]*[\"']?$")),
        flag(F.col("before").rlike("/$")),
        flag(F.col("after").rlike(r"^\.[A-Za-z]")),
        flag(name.rlike(SECRET_NAMES)),
        flag(name.rlike(PUBLIC_NAMES)),
        bucket(F.col("path")),
        bucket(last),
        bucket(first),
    ]
    found = found.withColumn("name", name)
    return found.select("__row", "doc_id", "start", "value", "name", *[c.alias(f"f{k}") for k, c in enumerate(listed)])


def _shapes(h, words) -> list[tuple[float, str, Column, Column, str]]:
    """(label, kind, lead, value, tail) of the findings that are planted, from random hex digits ``h(k)`` and words of the text."""
    mixed = lambda k, n: F.left(F.translate(F.base64(F.unhex(h(k))), "+/=", "xYz"), F.lit(n))
    upper = lambda k, n: F.left(F.upper(mixed(k, 64)), F.lit(n))
    number = lambda k, n: F.left(F.translate(h(k), "abcdef", "012345"), F.lit(n))
    word = lambda k: F.coalesce(F.get(words, F.pmod(F.xxhash64(h(k)), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit("letter"))
    t, cat = F.lit, F.concat
    hexes = lambda k, n: F.left(h(k), F.lit(n))
    uuid = cat(hexes(1, 8), t("-"), hexes(2, 4), t("-4"), hexes(3, 3), t("-a"), hexes(4, 3), t("-"), hexes(5, 12))
    return [
        (1.0, "access id", t("use "), cat(t("AKIA"), upper(1, 16)), ""),
        (1.0, "named hex", cat(F.element_at(F.array(t("token"), t("secret"), t("api_key")), F.pmod(F.xxhash64(h(9)), t(3)).cast("int") + 1), t(' = "')), hexes(1, 40), '"'),
        (1.0, "named mixed", t("access_key: '"), mixed(1, 32), "'"),
        (1.0, "password", t("password="), cat(mixed(1, 5), t("!"), mixed(2, 4)), ""),
        (1.0, "quoted password", t('passwd: "'), cat(mixed(1, 4), t("&"), number(2, 3), mixed(3, 3)), '"'),
        (1.0, "URL password", t("postgres://admin:"), mixed(1, 12), "@db.local/main"),
        (1.0, "web token", t("Bearer "), cat(t("eyJ"), mixed(1, 24), t(".eyJ"), mixed(2, 30), t("."), mixed(3, 40)), ""),
        (1.0, "prefixed", t("use "), cat(t("ghp_"), mixed(1, 36)), ""),
        (1.0, "bare mixed", t("key "), mixed(1, 40), ""),
        (1.0, "private key", t(""), cat(t("-----BEGIN PRIVATE KEY-----\n"), mixed(1, 42), t("\n"), mixed(2, 42), t("\n-----END PRIVATE KEY-----")), ""),
        (0.0, "commit", cat(F.element_at(F.array(t("commit: "), t("commit "), t("sha1 = ")), F.pmod(F.xxhash64(h(9)), t(3)).cast("int") + 1)), hexes(1, 40), ""),
        (0.0, "digest", t("sha256: "), hexes(1, 64), ""),
        (0.0, "checksum", t('checksum = "'), hexes(1, 32), '"'),
        (0.0, "uuid", t("id="), uuid, ""),
        (0.0, "bare uuid", t("see "), uuid, ""),
        (0.0, "number", t("call "), number(1, 16), ""),
        (0.0, "slug", t("page "), cat(word(1), t("-"), word(2), t("-"), word(3), t("-"), number(4, 4)), ""),
        (0.0, "path", t("in "), cat(t("/assets/"), word(1), t("/"), word(2), t("_"), number(3, 3)), ".png"),
        (0.0, "words as password", t("password: "), cat(word(1), t("-"), word(2)), ""),
        (0.0, "word as token", t("token: "), cat(word(1), word(2)), ""),
        (0.0, "joined words", t("the "), cat(word(1), word(2), word(3), word(4), number(5, 2)), ""),
        (0.0, "serial", t("order "), cat(t("AB-2024-"), number(1, 6), t("-"), upper(2, 3)), ""),
    ]


def planted(docs: DataFrame, max_docs: int = 600, seed: int = 7, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Labelled texts to learn from: __pid, text, path, value, kind, label.

    Of the ``max_docs`` rows of smallest hash, a stretch of 200 code points from a random place gets, in its middle,
    one secret or one string that only looks like one, of each kind in turn. What was planted decides the label, not how it reads.
    """
    text = text_of(text_col)
    at = F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(F.char_length(text) - 200, F.lit(1))).cast("int")
    rows = docs.select(F.substring(text, at + 1, F.lit(200)).alias("text"), col(path_col).cast("string").alias("path"))
    rows = rows.withColumn("h", F.xxhash64("text", "path", F.lit(seed))).orderBy("h", "text", "path").limit(max_docs)
    rows = scratch.materialize(rows.withColumn("n", F.monotonically_increasing_id()), "stretches")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3)
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(seed), F.col("n"), F.col("h"), F.lit(k)).cast("binary"), 256)
    kinds = [F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), lead.alias("lead"), value.alias("value"), F.lit(tail).alias("tail")) for label, kind, lead, value, tail in _shapes(h, words)]
    rows = rows.select("text", "path", F.explode(F.array(*kinds)).alias("s"))
    whole = F.concat(F.left("text", F.lit(100)), F.lit(" "), F.col("s.lead"), F.col("s.value"), F.col("s.tail"), F.lit(" "), F.substring("text", 101, 100))
    rows = rows.select(F.monotonically_increasing_id().alias("__pid"), whole.alias("text"), "path", "s.value", "s.kind", "s.label")
    return scratch.materialize(rows, "planted")


def planted_findings(docs: DataFrame, known_words: DataFrame, max_docs: int = 600, seed: int = 7, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """The planted strings that ``candidates`` finds, with ``features``, kind and label."""
    texts = planted(docs, max_docs, seed, text_col, path_col)
    found = features(scratch.materialize(candidates(texts, "__pid", "text", "path"), "planted_candidates"), known_words)
    truth = texts.select("__pid", F.col("value").alias("__value"), "kind", "label")
    found = found.join(truth, (F.col("doc_id") == F.col("__pid")) & (F.col("value") == F.col("__value"))).drop("__pid", "__value")
    return scratch.materialize(found, "planted_findings")


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """Fit on at most ``max_rows`` labelled findings, those of smallest hash. None if there are not two labels."""
    names = [c for c in labelled.columns if c.startswith("f") and c[1:].isdigit()]
    sample = labelled.select("label", *names, F.xxhash64("value", "start", F.lit(seed)).alias("h")).orderBy("h", "label", *names).limit(max_rows)
    sample = scratch.materialize(sample.drop("h"), "labelled_findings").coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add score, the forest's probability of a secret; 1 for all without a model, so nothing is removed."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    names = [c for c in found.columns if c.startswith("f") and c[1:].isdigit()]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(found)
    model.setPredictionCol("")
    model.setRawPredictionCol("")
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "probability")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates of all texts: __row, doc_id, start, length, value, name, score, is_secret.

    ``labelled`` are reviewed findings with the columns of ``features`` and a label; by default secrets and look-alikes
    that are planted into stretches of ``docs`` (``planted``). Null and empty texts have no candidates; a null path
    is a bucket of its own; very long texts are searched whole; repeated rows, ties included, give repeated findings. Without
    labels of both kinds all candidates stay findings. An empty table gives no rows.
    """
    docs = scratch.as_files(docs)
    words = scratch.materialize(dictionary(docs, text_col=text_col), "dictionary")
    found = scratch.materialize(candidates(docs, id_col, text_col, path_col), "candidates")
    found = scratch.materialize(features(found, words), "findings")
    if labelled is None:
        labelled = planted_findings(docs, words, text_col=text_col, path_col=path_col)
    model = train(labelled, max_rows)
    out = judge(found, model)
    return out.select("__row", "doc_id", "start", F.char_length("value").cast("long").alias("length"), "value", "name", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with the values of the findings of ``scan`` replaced, rows without findings unchanged. A text is cut at its candidates and put together again."""
    docs = scratch.as_files(docs)
    secret = findings.filter("is_secret").select(F.col("__row").alias("__r"), F.col("start").alias("__at")).distinct()
    parts = _cut(docs, text_col)
    told = parts.join(secret, (F.col("__row") == F.col("__r")) & (F.col("start") == F.col("__at")), "left")
    shown = F.when(F.col("__at").isNull(), F.col("match")).otherwise(F.concat("lead", F.lit(mark)))
    last = F.max(F.struct("k", "next"))["next"]
    whole = told.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("piece", shown).alias("s")))).alias("l"), last.alias("end"), F.count("__at").alias("n"))
    clean = whole.filter("n > 0").select("__row", F.concat(F.array_join(F.transform("l", lambda x: x["s"]), ""), "end").alias("clean"))
    rows, got = join_back(docs, clean, "left")
    return rows.select(*[(F.coalesce(got["clean"], col(c)).alias(c) if c == text_col else col(c)) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "name", F.round("score", 6).alias("score"), "is_secret")
