"""Secret scans whose false positives a random forest removes, in DataFrame functions only.

Candidates are long tokens, and whatever is given to a keyword. Each is described by its length, how
often neighbouring characters change class, how much of it common words cover,
the path it was found under and the words around it. A random forest trained on
labelled findings (findings with a column ``label``) tells secrets from the rest.

Where no person has labelled findings, ``certain_labels`` labels those whose
form leaves no doubt, either way; the forest decides on all others. What those
labels are read from, the known prefix and the keyword, is kept from the forest
(see LEARNED), so that it learns what secrets look like otherwise.

No pattern repeats a group unless possessively: Java would descend once for each
repetition, and a token of some ten thousand signs would end the whole process.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import row_key, written

SIGN = "[A-Za-z0-9+/=_.@-]"
"""What candidates consist of. Only they are consumed, so that neighbours stay whole; the text around is looked at."""
NEAR = r"[A-Za-z_]{0,24}[\s\"'=:]{0,4}"
NEAR_SIGNS = 32
"""It is sought in so many signs, which are more than it and an end of line can have: each place of them is tried."""
MARGIN = "\x01" * 60
"""Put before a line, so that there are 60 characters before each place."""
_AFTER = "[^A-Za-z0-9+/=_.@-]{0,2}[A-Za-z]{0,12}"
RUN = rf"(?<!{SIGN})(?={SIGN}{{10}})(?<=(?=([\x{{0}}-\x{{FFFF}}]{{60}}{SIGN}{{10,}}+{_AFTER}))[\x{{0}}-\x{{FFFF}}]{{60}}){SIGN}++"
"""The 60 characters before a whole run, the run, and what is after it: one group, so that texts are searched once."""
KEYWORDS = "pass|pwd|secret|token|key|auth|cred|bearer"
_NAME = "[A-Za-z0-9_.-]"
_GIVEN = r"\\*[\"']?\s*[=:]+>?\s*"
_NEXT = f"[&;,](?!{_NAME}*?(?:{KEYWORDS}){_NAME}*=)"
KEYED = rf"(?i)(?<!{_NAME})(?={_NAME}*?(?:{KEYWORDS}))({_NAME}++\\*+[\"']?\s*+[=:]++>?\s*+)"
ASSIGNED = (
    rf"{KEYED}(?=(\\+\"[^\"\\]++|\\+'[^'\\]++|\"[^\"]++|'[^']++|(?=[^\s\"'])[^\s\"'&;,]*+(?:{_NEXT}[^\s\"'&;,]*+)*+)(?!{SIGN})({_AFTER}))"
)
"""A name with a keyword and = or :, and the value up to the quote that ends it, or to a blank, a quote or the next
such name. Values are looked at only, so that names inside of them are found too."""
COVERED = [f"(?i)(?:{KEYWORDS}){_NAME}*{_GIVEN}(?:\\\\*[\"'])?$", f"(?i)^(?=[A-Za-z_.-]*?(?:{KEYWORDS}))[A-Za-z_.-]++=+[^=]"]
"""Text before a token, or its own form, that tells that an assigned value holds it."""
# Forms of keys whose issuers begin them alike.
KEY_FORMATS = [
    "(?:AKIA|ASIA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{30,}", "github_pat_[A-Za-z0-9_]{22,}", "gl[a-z]{2,5}-[A-Za-z0-9_-]{20,}",
    "(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}", "whsec_[A-Za-z0-9+/=]{16,}", "xox[a-z]-[A-Za-z0-9-]{10,}", "xapp-[0-9]-[A-Za-z0-9-]{10,}",
    "npm_[A-Za-z0-9]{30,}", "pypi-[A-Za-z0-9_-]{16,}", "hf_[A-Za-z0-9]{30,}", "AIza[A-Za-z0-9_-]{35}", r"ya29\.[A-Za-z0-9_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "sk-[A-Za-z0-9_-]{20,}", "shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", "do[opr]_v1_[0-9a-f]{64}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
KEY_FORMAT = f"(?<![A-Za-z0-9])(?:{'|'.join(KEY_FORMATS)})(?![A-Za-z0-9])"
CHANCE = "(?:(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,})"
"""A long part in which letters and digits are mixed."""
PLAIN_PATHS = "test|example|sample|doc|readme|fixture"
WORDS = "mail|example|test|user|name|the|and|http|www|com|org|info|home|page|item|data|file"
"""Common words whose share of a token tells against chance characters."""
FEATURES = [
    "length", "digits", "uppers", "letters", "changes", "changes_per_char", "covered", "dots", "at_signs",
    "distinct_share", "hex_only", "keyword_before", "quoted", "assigned", "word_after", "plain_path", "path_length",
    "key_format",
]
LEARNED = [f for f in FEATURES if f not in ("key_format", "keyword_before", "assigned", "quoted")]
"""What the forest sees."""
TRAIN_ROWS = 50_000
"""The forest is fitted on about so many labelled findings, a hash of the finding choosing; all if there are fewer."""
TREES, DEPTH = 20, 6


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, line, nth, before, candidate, after) for every candidate of every whole text.

    These are the runs of ten or more signs, then the values given to names
    with a keyword, of any length and signs; runs that such a value holds from
    its beginning are not listed twice. ``line`` and ``nth`` count from 0. Null
    and empty texts have none; a null path is empty.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    lines = docs.select("doc_id", *row_key(), where.alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    content = F.col("content")
    # A character of two code units before a run counts as one of the 60.
    ascii_only = F.octet_length(content) == F.length(content)
    padded = F.concat(F.lit(MARGIN), F.when(ascii_only, content).otherwise(F.regexp_replace(content, r"[^\x{0}-\x{FFFF}]", "\ufffd")))
    group = lambda text, pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    kind = "array<struct<behind:string,ahead:string,value:string>>"
    none = F.array().cast("array<string>")
    # Of a run all three are in one text, which is parted once there is a row for each.
    runs = F.arrays_zip(group(padded, RUN, 1), none, none).cast(kind)
    given = F.arrays_zip(group(content, ASSIGNED, 1), group(content, ASSIGNED, 3), group(content, ASSIGNED, 2)).cast(kind)
    some_given = F.when(content.rlike("[=:]") & content.rlike(KEYED), given).otherwise(F.array().cast(kind))
    spots = F.when(content.rlike(f"{SIGN}{{10}}"), F.concat(runs, some_given)).otherwise(some_given)
    # Not posexplode, for which the patterns would be searched once more to leave out lines that have none.
    found = lines.select("doc_id", "path", "line", F.posexplode_outer(spots).alias("nth", "spot")).where("spot IS NOT NULL")
    value, whole = F.col("spot.value"), F.col("spot.behind")
    behind = F.when(value.isNull(), F.substring(whole, 1, len(MARGIN))).otherwise(whole)
    ahead = F.when(value.isNull(), F.substring(whole, len(MARGIN) + 1, 2**31 - 1)).otherwise(F.col("spot.ahead"))
    found = found.select("doc_id", "path", "line", "nth", value.alias("value"), behind.alias("behind"), ahead.alias("ahead"))
    behind, ahead, value, token = map(F.col, ("behind", "ahead", "value", "token"))
    run = F.regexp_extract(ahead, f"^{SIGN}+", 0)
    found = found.select("*", F.coalesce(value, run).alias("token"))
    given_before = behind.rlike("[=:]") & behind.rlike(COVERED[0])
    found = found.where(value.isNotNull() | ~(given_before | token.contains("=") & token.rlike(COVERED[1])))
    quote = F.regexp_extract(token, r"^\\*[\"']", 0)
    assigned = value.isNotNull()
    found = found.select(
        "doc_id", "path", "line", "nth",
        F.when(assigned, F.concat(behind, quote)).otherwise(F.regexp_extract(F.substring(behind, -NEAR_SIGNS, NEAR_SIGNS), f"{NEAR}$", 0)).alias("before"),
        F.when(assigned, F.substring(token, F.length(quote) + 1, F.length(token))).otherwise(token).alias("candidate"),
        F.when(assigned, ahead).otherwise(F.substring(ahead, F.length(token) + 1, F.lit(14))).alias("after"),
    )
    return found.where("candidate <> ''")


def described(found: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES, all doubles."""
    token = F.col("candidate")
    kept = lambda pattern: F.length(F.regexp_replace(token, pattern, ""))
    length = F.length(token)
    # Each run's class, then one character for each run of a class. Runs are replaced whole: each replacement costs a copy.
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    runs = F.length(F.regexp_replace(classes, r"(.)(?=\1)", ""))
    features = {
        "length": length,
        "digits": kept("[^0-9]+") / length,
        "uppers": kept("[^A-Z]+") / length,
        "letters": kept("[^A-Za-z]+") / length,
        "changes": runs,
        "changes_per_char": runs / length,
        "covered": 1 - F.length(F.regexp_replace(F.lower(token), WORDS, "")) / length,
        "dots": kept("[^.]+"),
        "at_signs": kept("[^@]+"),
        "distinct_share": F.size(F.array_distinct(F.split(token, ""))) / length,
        "hex_only": token.rlike("^[0-9a-f]+$"),
        "keyword_before": F.lower("before").rlike(KEYWORDS) | F.lower(token).rlike(f"^({KEYWORDS})[a-z_]*="),
        "quoted": F.col("before").rlike("[\"']$"),
        "assigned": F.col("before").rlike("[=:]") | token.rlike("^[a-z_]+="),
        "word_after": F.col("after").rlike("[A-Za-z]$"),
        "plain_path": F.lower("path").rlike(PLAIN_PATHS),
        "path_length": F.length("path"),
        "key_format": ~token.rlike("^[A-Z]?[a-z]+$") & token.rlike(KEY_FORMAT),
    }
    return found.select("*", *(features[name].cast("double").alias(name) for name in FEATURES))


def certain_label() -> Column:
    """1 for findings that are a known key format (see KEY_FORMATS) or a long hex value given to a keyword, 0 for addresses,
    numbers, dates, host names and paths without a long part of mixed letters and digits, version numbers and words; else null."""
    token, before = F.col("candidate"), F.lower("before")
    named = before.rlike(f"({KEYWORDS})[a-z0-9_.-]*[\\s\"'=:>\\\\]+$") | F.lower(token).rlike(f"^({KEYWORDS})[a-z_]*=")
    issued = ~token.rlike("^[A-Z]?[a-z]+$") & token.rlike(KEY_FORMAT)
    hexadecimal = named & token.rlike("(?<![0-9a-f])[0-9a-f]{16,}+[,;.)]?$")
    plain = (
        token.rlike(r"^[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+$")
        | token.rlike(r"^[+]?[0-9][0-9./-]*[0-9.]$")
        | token.rlike(r"^[A-Za-z]++(?:[._/-][A-Za-z0-9]++)++[.]?$") & ~named & ~token.rlike(CHANCE)
        | token.rlike(r"^[A-Za-z]?[a-z]+[.]?$") & ~named
    )
    # Each pattern stands here once, as they are searched as often as they stand.
    return F.when(issued, 1.0).when(plain, F.when(~hexadecimal, 0.0)).when(hexadecimal, 1.0)


def settled(found: DataFrame) -> DataFrame:
    """``found`` with :func:`certain_label` as the column ``settled``, for tables that are read more than once."""
    return found.withColumn("settled", certain_label())


def _settled(found: DataFrame) -> Column:
    return F.col("settled") if "settled" in found.columns else certain_label()


def certain_labels(found: DataFrame) -> DataFrame:
    """Findings whose form settles it, with their ``label``."""
    return found.withColumn("label", _settled(found)).where("label IS NOT NULL")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> RandomForestClassificationModel | None:
    """Forest from findings with FEATURES and ``label`` (1: a secret); None where they are not of both kinds.

    Equal findings are one row that counts as often as they occur, so that no
    task gets all of a frequent one. Null labels are left out.
    """
    labelled = labelled.where("label IS NOT NULL")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if set(kinds) != {0.0, 1.0}:
        return None
    mark = F.xxhash64("doc_id", "line", "nth", "candidate")
    # The rarer kind may take up half of the rows: few words among very many are secrets.
    rare = min(kinds, key=kinds.__getitem__)
    few = min(kinds[rare], rows / 2)
    part = {rare: few / kinds[rare], 1 - rare: min(1.0, (rows - few) / kinds[1 - rare])}
    threshold = F.when(F.col("label") == rare, int(part[rare] * 2**31)).otherwise(int(part[1 - rare] * 2**31))
    sample = labelled.where(mark.bitwiseAND(2**31 - 1) < threshold)
    sample = sample.groupBy(*LEARNED, "label").agg(F.count(F.lit(1)).cast("double").alias("times"))
    # Written, as fitting reads it many times. The same rows in the same partitions and order: the forest's own
    # sampling depends on them.
    sample = written(sample, "findings")
    sample = sample.repartition(8, *LEARNED, "label").sortWithinPartitions(*LEARNED, "label")
    data = VectorAssembler(inputCols=LEARNED, outputCol="features").transform(sample).select("features", "label", "times")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="times").fit(data)


def judged(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` (with FEATURES) with the forest's ``probability`` of a secret, and ``is_secret``.

    ``is_secret`` is what the form says where it settles it (:func:`certain_label`),
    else whether the probability is 0.5 or more. Without a model nothing is taken
    out: the probability is null, and ``is_secret`` true or null.
    """
    certain = _settled(found)
    if model is None:
        return found.withColumns({"probability": F.lit(None).cast("double"), "is_secret": F.when(certain == 1, True)})
    vectors = VectorAssembler(inputCols=LEARNED, outputCol="features").transform(found)
    chance: Column = F.get(vector_to_array("probability"), F.lit(1))
    out = model.transform(vectors).withColumn("probability", F.round(chance, 6))
    return out.select(*found.columns, "probability", F.coalesce(certain == 1, F.col("probability") >= 0.5).alias("is_secret"))
