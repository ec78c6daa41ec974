"""Secret scanning with SQL functions only: candidates by pattern, false positives removed by a random forest.

A candidate is a long token with digits, a known key format, or whatever is
assigned to a name like ``password``, of any length and alphabet.  The forest
looks at its length, its characters and the transitions between their classes,
how much of it dictionary words cover, the parts of the path (here: the
document's source) and the words around it.  It learns from labelled findings: a table of them if
there is one, else findings whose nature a rule settles (provider formats and
assignments to names like ``password`` against numbers and plain words); it
then decides on all candidates, those without a rule included.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, join_small

# fixed values: formats of well-known access keys
PROVIDERS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
#: Names whose assigned value is a secret.
NAMES = r"(?:pass|passwd|password|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)"
#: A long token with a digit, or a provider's format.
TOKEN = (rf"(?<![A-Za-z0-9+/_-])(?:{PROVIDERS}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{16,}}={{0,2}})"
         r"(?![A-Za-z0-9+/_-])")
_ASSIGNS = rf"(?i:{NAMES})[\w-]{{0,64}}[\"']?[ \t]*[:=][ \t]*"
#: What stands before a candidate (groups 1 and 3) and the candidate (groups 2, 4, 5): a quoted value of such a name, an
#: unquoted one without punctuation at its end, or a token.
CANDIDATE = rf"({_ASSIGNS}[\"'])([^\"'\n]+)(?=[\"'])|({_ASSIGNS})([^\s\"']*[^\s\"'.,;:!?)\]}}>])|({TOKEN})"
#: Stands around candidates while a text is cut; where the text has such characters they are spelt out until it is whole again.
_MARK, _ESCAPE = "\x01", "\x02"
_SPELT = ((_ESCAPE, _ESCAPE + "\x04"), (_MARK, _ESCAPE + "\x03"))
#: The forest, and the most labelled findings of either kind that it is fitted on (those with the smallest hash).
TREES, TREE_DEPTH, TRAINING_ROWS, SEED = 24, 7, 20_000, 11
#: A candidate is a secret from this share of the trees' votes on.
VOTES = 0.5
#: Shortest word that counts as covered.
WORD_LETTERS = 3

FEATURES = ["length", "digits", "upper", "lower", "distinct", "class_changes", "case_changes", "hex", "padded", "covered",
            "assigned", "named", "quoted", "before_known", "after_known", "before_letters", "after_letters",
            "path_depth", "path_config", "path_code", "path_test"]


def _pieces(text: Column) -> Column:
    """The text, spelt out, cut around its candidates: every second element is one."""
    for plain, spelt in _SPELT:
        text = F.replace(text, F.lit(plain), F.lit(spelt))
    return F.split(F.regexp_replace(text, CANDIDATE, f"$1$3{_MARK}$2$4$5{_MARK}"), _MARK, -1)


def _whole(piece: Column) -> Column:
    for plain, spelt in reversed(_SPELT):
        piece = F.replace(piece, F.lit(spelt), F.lit(plain))
    return piece


def document_keys(text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(F.lit(21), text), "k2": F.xxhash64(text, F.lit(22))}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, place (from 1 in its text), candidate, the text around it up to 80 characters, k1, k2."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.rlike(CANDIDATE)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"),
        *[c.alias(n) for n, c in document_keys(text).items()], _pieces(text).alias("pieces"))
    found = F.transform(F.sequence(F.lit(1), F.floor(F.size("pieces") / 2).cast("int")), lambda i: F.struct(
        i.alias("place"), _whole(F.element_at("pieces", i * 2)).alias("candidate"),
        F.right(_whole(F.element_at("pieces", i * 2 - 1)), F.lit(80)).alias("before"),
        F.left(_whole(F.element_at("pieces", i * 2 + 1)), F.lit(80)).alias("after")))
    return rows.withColumn("found", F.explode(found)).select("doc_id", "path", "found.*", "k1", "k2")


def words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the dictionary, all words of letters of these texts in lower case."""
    parts = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}]+")
    return texts.select(F.explode(F.array_distinct(parts)).alias("word")).where(
        F.char_length("word") >= WORD_LETTERS).distinct()


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The candidates with the columns :data:`FEATURES`."""
    c = F.col("candidate")
    n = F.char_length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    last = F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1)
    first = F.regexp_extract("after", r"^[^\p{L}]*(\p{L}+)", 1)
    path = F.coalesce(F.col("path"), F.lit(""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = found.withColumns({
        "last": F.lower(last), "first": F.lower(first), "length": n.cast("double"),
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "class_changes": share("(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_-])(?=[A-Za-z0-9])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "hex": flag(c.rlike("^[0-9a-f]+$") & c.rlike("[a-f]")), "padded": flag(c.rlike("=$")),
        "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"']?$")),
        "named": flag(F.col("before").rlike(rf"{_ASSIGNS}[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "before_letters": F.char_length(last).cast("double"), "after_letters": F.char_length(first).cast("double"),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_config": flag(path.rlike(r"(?i)\.(?:env|ini|ya?ml|json|toml|conf|cfg|properties|pem|key|tf)$|(?:^|/)\.env|config")),
        "path_code": flag(path.rlike(r"(?i)\.(?:py|js|ts|java|go|rb|rs|c|cc|cpp|cs|php|sh|sql|ipynb|scala|kt)$|code|repo|git")),
        "path_test": flag(path.rlike("(?i)test|example|sample|doc"))})
    # dictionary words in the candidate and beside it, looked up once for each distinct candidate and neighbours
    key = ["candidate", "last", "first"]
    inside = F.transform(F.split(F.lower(c), "[^a-z]+"), lambda w: F.struct(F.lit("in").alias("where"), w.alias("word")))
    beside = F.array(F.struct(F.lit("last").alias("where"), F.col("last").alias("word")),
                     F.struct(F.lit("first").alias("where"), F.col("first").alias("word")))
    known = rows.select(*key).distinct().withColumn("w", F.explode(F.concat(inside, beside))).select(*key, "w.*").where(
        F.char_length("word") >= WORD_LETTERS).join(dictionary, "word").groupBy(*key).agg(
        F.sum(F.when(F.col("where") == "in", F.char_length("word")).otherwise(0)).alias("letters"),
        F.max(F.col("where") == "last").alias("l"), F.max(F.col("where") == "first").alias("f"))
    rows = rows.join(known, key, "left").withColumns({
        "covered": F.coalesce(F.col("letters") / F.col("length"), F.lit(0.0)),
        "before_known": flag(F.col("l")), "after_known": flag(F.col("f"))})
    return rows.drop("letters", "l", "f", "last", "first")


def settled(rows: DataFrame) -> Column:
    """1 for findings that a rule calls a secret, 0 for those it calls none, null for the others."""
    c = F.col("candidate")
    # a short word of letters after a name may be either
    telling = c.rlike("[A-Za-z]") & (c.rlike("[^A-Za-z]") | (F.col("length") >= 8))
    secret = c.rlike(f"^(?:{PROVIDERS})$") | ((F.col("named") == 1) & telling & (F.col("covered") < 0.5))
    plain = c.rlike("^[0-9_/+-]+=*$") | c.rlike("^[A-Za-z]{1,3}$") | (F.col("covered") > 0.6) | c.rlike(r"^[A-Za-z]{1,3}(?:[/_-][A-Za-z]*)*[0-9]{1,4}$")
    return F.when(secret, 1.0).when(plain, 0.0)


def scanned(docs: DataFrame, dictionary: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id",
            text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate with its score and whether it is a secret.

    labelled: optional (candidate, label 0 or 1) of judged findings.  Null and
    empty texts have no candidates; a null path is the empty path; a null id
    stays null; repeated rows are reported each.  With labelled findings of
    one kind only there is nothing to learn: candidates then count as secrets
    unless a rule calls them plain.  An empty table gives no rows; other
    columns are ignored.

    Returns doc_id, place, candidate, length, score, secret, k1, k2.
    """
    rows = cut(features(cut(candidates(docs, id_col, text_col, path_col)), dictionary))
    if labelled is None:
        known = rows.withColumn("label", settled(rows))
    else:
        judged = labelled.groupBy("candidate").agg(F.max(F.col("label").cast("double")).alias("label"))
        known = rows.join(judged, "candidate", "left")
    known = known.where("label is not null").select("candidate", "label", *FEATURES).distinct()
    known = known.withColumn("hash", F.xxhash64("candidate", *FEATURES))
    training = None
    for label in (0.0, 1.0):
        some = known.where(F.col("label") == label).orderBy("hash").limit(TRAINING_ROWS)
        training = some if training is None else training.unionByName(some)
    training = cut(training)
    kinds = {r["label"] for r in training.select("label").distinct().collect()}
    out = ["doc_id", "place", "candidate", F.col("length").cast("int").alias("length"), "score",
           (F.col("score") >= VOTES).alias("secret"), "k1", "k2"]
    if len(kinds) < 2:
        return rows.withColumn("score", F.coalesce(settled(rows), F.lit(1.0))).select(*out)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    # the same rows in the same order give the same forest on any cluster
    ordered = training.orderBy("hash", "candidate").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(
        vectors.transform(ordered).select("label", "features"))
    votes = forest.transform(vectors.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return votes.select(*out)


def redacted(docs: DataFrame, dictionary: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars",
             mask: str = "[SECRET]", **options) -> DataFrame:
    """All documents with every secret replaced by ``mask``; n_chars follows where it was the text's length."""
    found = scanned(docs, dictionary, text_col=text_col, **options).where("secret").select("k1", "k2", "place").distinct()
    found = cut(found.groupBy("k1", "k2").agg(F.collect_set("place").alias("__places")))
    text = F.col(text_col).cast("string")
    keys = {f"__{n}": c for n, c in document_keys(text).items()}
    out = join_small(docs.withColumns(keys), found.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left",
                     found.count())
    # places are 1, 2, ..., their pieces 2, 4, ...
    masked = F.array_join(F.transform(_pieces(text), lambda p, i: F.when(
        (i % 2 == 1) & F.array_contains("__places", ((i + 1) / 2).cast("int")), F.lit(mask)).otherwise(p)), "")
    masked = _whole(masked)
    out = out.withColumn("__text", F.when(F.col("__places").isNotNull(), masked).otherwise(text))
    if n_chars_col and n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(F.col("__places").isNotNull() & (F.col(n_chars_col) == F.char_length(text)),
                                                 F.char_length("__text")).otherwise(F.col(n_chars_col)).cast(docs.schema[n_chars_col].dataType))
    return out.withColumn(text_col, F.col("__text")).select(*[F.col(f"`{c}`") for c in docs.columns])
