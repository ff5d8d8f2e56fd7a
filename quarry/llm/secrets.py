"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates, found from left to right in the whole text, none within another:

* private keys between their BEGIN and END lines;
* assigned values: what follows a name with a word like password or token, a
  sign (: = := =>) and perhaps the word Bearer or Basic; in quotes all up to
  the closing one, else all up to white space, a quote or one of , ; ) } ];
* runs of at least 16 letters, digits and + / _ - (= only at the end) that
  hold a digit or a capital after a small letter; shorter ones that nothing names are words.

Features: length, character transitions, variety of characters, the share
covered by dictionary words, words of the path, and neighbouring words: the
three before (from the candidate before it on) and the two behind.

The forest is trained on labelled findings: texts, the value in them that is
meant, their path, and whether it is a secret. They go through the same
extraction. A bounded table of them is made by rule here; callers may give
their own. The trained trees become one SQL expression, so that a scan is a
plain projection: only DataFrame functions, no Python on the executors.

Defined results: a null text or path counts as empty; texts without a candidate
give no row; each occurrence of a repeated value is a finding of its own; a tie
of the trees counts as a secret;
repeated rows give repeated findings; a text of any length is searched whole;
an empty table gives no finding; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, durable, running

# Names of secrets, words that speak against one, words of a small dictionary, words of paths.
KEY_WORDS = "token secret key apikey password passwd pwd auth credential credentials bearer private access signature"
OTHER_WORDS = "example sample test dummy fake your placeholder commit sha checksum hash uuid id md5 digest build version order phone card revision call tel invoice account iban mail color"
DICTIONARY = "about access account admin after again align article background before block body border build button change class client color commit config content count create custom data date default demo description display document dummy element email error event example false file first font footer form format from function group header height host html https image index info input insert item label last left level line link list local login main master message method model module name network number object option order page param password path payment placeholder point position post print private process product profile project public query release remove replace report request response result right sample script search secret section select server service session setting simple source start state status style submit system table target test text time title token true type undefined update user value version video view width window word xxxx your"
RISKY_PATHS = "env config settings secret secrets credential credentials deploy prod"
HARMLESS_PATHS = "test tests spec example examples sample docs doc mock mocks fixture fixtures lock"

# Names: words that make one wherever they stand in it, and words that have to be a part of their own.
NAMED = r"(?i:token|secret|passw(?:or)?d|passphrase|apikey|credential|private|signature)"
PART = r"(?:(?<![A-Za-z])(?i:key|pwd|auth|authorization|access)|(?<=[a-z])(?:Key|Pwd|Auth|Access))"
LEAD = rf"""(?<![\w.-])[\w.-]*?(?:{NAMED}|{PART})[\w.-]*+["'`]?+[ \t]*+(?>:=|=>|[:=])[ \t]*+(?:(?i:bearer|basic)[ \t]++)?+"""
ASSIGNED = rf"""{LEAD}(?:"[^"\n]+"|'[^'\n]+'|`[^`\n]+`|[^\s"'`,;)}}\]]+)"""
# A run is looked at from where it begins only, so that a long one is gone through once.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*+[0-9]|[A-Z0-9+/_-]*+[a-z](?:[a-z0-9+/_-]*+)[A-Z])[A-Za-z0-9+/_-]++={0,2}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+-----END [A-Z ]*PRIVATE KEY-----"
CANDIDATE = rf"{PEM}|{ASSIGNED}|{RUN}"
FEATURES = ["length", "transitions", "turns", "variety", "digits", "capitals", "symbols", "code", "hexadecimal", "dictionary", "key_words", "other_words", "assigned", "quoted", "risky_path", "harmless_path"]
TREES, DEPTH, SEED = 24, 8, 7
FINDINGS = 4000


def _either(words: str) -> str:
    return "|".join(words.split())


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start (code points from 0), value, before (the words in front, name and sign), after and path of each candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), place.alias("path"))
    # Most texts hold no candidate; they go before anything is split.
    rows = rows.where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), 1).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    n = F.size("found")
    rows = rows.select("doc_id", "path", "found", F.slice("gaps", 1, n).alias("gap"), F.slice("gaps", 2, n).alias("following"))
    lengths = F.zip_with("gap", "found", lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint"))
    rows = rows.withColumn("before", running(lengths))
    # Each candidate takes only what lies beside it along.
    one = F.transform(F.arrays_zip("found", "gap", "following", "before"), lambda c: F.struct((c["before"] + F.char_length(c["gap"])).alias("at"), c["found"].alias("match"), _tail(c["gap"]).alias("gap"), _head(c["following"]).alias("following")))
    rows = rows.select("doc_id", "path", F.explode(one).alias("c")).select("doc_id", "path", "c.*")
    lead = F.regexp_extract("match", rf"""^({LEAD}["'`]?)(?=[^"'`])""", 1)
    rows = rows.withColumn("lead", F.when(F.col("match").startswith("-----BEGIN"), "").otherwise(lead))
    behind = F.substr("match", F.char_length("lead") + 1)
    value = F.when(F.col("lead").rlike("[\"'`]\\z"), F.regexp_replace(behind, "[\"'`]\\z", "")).otherwise(behind)
    return rows.select("doc_id", (F.col("at") + F.char_length("lead")).alias("start"), value.alias("value"), F.concat(F.regexp_replace("gap", r"\s+", " "), F.col("lead")).alias("before"), F.regexp_replace("following", r"\s+", " ").alias("after"), "path")


def _tail(c: Column) -> Column:
    """The last three words of a text, and the white space behind them."""
    return F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit(""), F.lit("")), F.split(c, r"\s+", -1)), -4, 4), " ")


def _head(c: Column) -> Column:
    """The first two words of a text, with what follows the candidate directly."""
    return F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), r"\s+", 4), 1, 3), " ")


def with_features(found: DataFrame) -> DataFrame:
    """found with the columns FEATURES (double), from value, before, after and path."""
    v, low = F.col("value"), F.lower("value")
    n = F.char_length(v).cast("double")
    around = F.lower(F.concat_ws(" ", "before", "after"))
    covered = F.aggregate(F.regexp_extract_all(low, F.lit(f"({_either(DICTIONARY)})"), 1), F.lit(0), lambda a, w: a + F.char_length(w))
    bounded = lambda words: rf"(?:^|[^a-z])(?:{_either(words)})(?:$|[^a-z])"
    made = {
        "length": n,
        "transitions": _count(v, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "turns": _count(low, r"(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])|(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])") / n,
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40.0)),
        "digits": _count(v, "[0-9]") / n,
        "capitals": _count(v, "[A-Z]") / n,
        "symbols": _count(v, r"[^A-Za-z0-9\s]") / n,
        "code": _count(v, r"[$(){}<>\[\]]|\w\.\w"),
        "hexadecimal": v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z").cast("double"),
        "dictionary": covered / n,
        "key_words": _count(around, bounded(KEY_WORDS)),
        "other_words": _count(around, bounded(OTHER_WORDS)),
        "assigned": F.col("before").rlike(r"""[:=]\s*["']?\s*\z""").cast("double"),
        "quoted": F.col("before").rlike(r"""["']\s*\z""").cast("double"),
        "risky_path": _count(F.lower("path"), bounded(RISKY_PATHS)),
        "harmless_path": _count(F.lower("path"), bounded(HARMLESS_PATHS)),
    }
    return found.withColumns({k: F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = FINDINGS, salt: str = "") -> DataFrame:
    """text, value, path, label and shape of n findings made by rule: half are secrets."""
    draw = lambda what, m: F.pmod(F.xxhash64("id", F.lit(what + salt)), F.lit(m)).cast("int")
    pick = lambda words, what: F.element_at(F.array(*[F.lit(w) for w in (words.split() if isinstance(words, str) else words)]), draw(what, len(words.split() if isinstance(words, str) else words)) + 1)
    wide = lambda low, high, what: draw(what, high - low + 1) + low
    part = lambda c, size: F.substr(c, F.lit(1), size if isinstance(size, Column) else F.lit(size))
    number = F.col("id").cast("string")
    hexes = F.sha2(F.concat(number, F.lit("hex" + salt)), 256)
    more = F.base64(F.unhex(F.sha2(F.concat(number, F.lit("base" + salt)), 512)))
    mixed = F.regexp_replace(more, "[+/=]", "x")
    digits = F.regexp_replace(F.translate(hexes, "abcdef", "314159"), "^0", "7")
    plain = pick("of the in and for with said was haus monde casa rien", "plain")
    odd = pick("horse battery staple purple tiger sunset dragon winter monkey coffee hunter shadow", "w1")
    odd2 = pick("horse battery staple purple tiger sunset dragon winter monkey coffee hunter shadow", "w2")
    mark = pick("! @ # % & ? * !! $", "mark")
    name = pick("password passwd token secret api_key API_KEY apiKey auth_token client_secret DB_PASSWORD accessKey private_key session.token x-api-key", "name")
    sign = pick([" = ", "=", ": ", " : ", ":", " := "], "sign")
    quote = pick(["\"", "'", "\"", ""], "quote")
    given = F.concat(name, sign, quote)
    json = F.concat(F.lit('{"user":"bob","'), name, F.lit('":"'))
    secret = {
        "hex": part(hexes, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), draw("h", 3) + 1)),
        "base64": part(more, wide(24, 64, "long")),
        "mixed": part(mixed, wide(16, 60, "long")),
        "prefixed": F.concat(pick("ghp_ sk_live_ AKIA xoxb- glpat- key_ tok_", "prefix"), part(mixed, wide(16, 40, "long"))),
        "short": F.concat(odd, draw("n", 100).cast("string"), mark),
        "phrase": F.concat(odd, pick("- _ . ! +", "join"), odd2, F.when(draw("m", 2) == 0, mark).otherwise(pick("- _ .", "join")), F.when(draw("k", 2) == 0, draw("n", 1000).cast("string")).otherwise(pick("river garden window silver mountain", "w3"))),
        "wordy": F.concat(part(mixed, wide(12, 24, "long")), F.upper(pick(DICTIONARY, "a")), F.lit("/"), F.substr(mixed, F.lit(30), wide(6, 12, "rest"))),
        "pem": F.concat(F.lit("-----BEGIN "), pick(["", "RSA ", "EC ", "OPENSSH "], "a"), F.lit("PRIVATE KEY-----\n"), part(more, wide(10, 88, "long")), F.lit("\n-----END "), pick(["", "RSA ", "EC ", "OPENSSH "], "a"), F.lit("PRIVATE KEY-----")),
        "leet": F.concat(F.translate(F.initcap(odd), "aeiost", "431057"), draw("n", 1000).cast("string"), F.when(draw("m", 2) == 0, mark).otherwise("")),
        "simple": F.concat(odd, draw("n", 1000).cast("string")),
    }
    free = ("base64", "mixed", "prefixed")
    other = {
        "card": part(digits, wide(16, 19, "long")),
        "slug": F.concat(F.concat_ws("-", *[pick(DICTIONARY, f"word{k}") for k in range(4)], plain), wide(1, 99, "number").cast("string")),
        "uuid": F.regexp_replace(part(hexes, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "commit": part(hexes, wide(16, 40, "long")),
        "camel": F.concat(pick(DICTIONARY, "a"), F.initcap(pick(DICTIONARY, "b")), F.initcap(odd), F.initcap(pick("very some any bean entity handler factory provider", "c")), F.initcap(odd2), F.when(draw("m", 2) == 0, wide(1, 99, "number").cast("string")).otherwise("")),
        "path": F.concat_ws("/", pick(DICTIONARY, "a"), pick(DICTIONARY, "b"), pick(DICTIONARY, "c"), F.concat(pick(DICTIONARY, "d"), wide(1, 99, "number").cast("string"))),
        "account": F.concat(part(digits, 8), F.lit("-"), F.substr(digits, F.lit(9), F.lit(9))),
    }
    held = {
        "placeholder": F.concat(pick("your_ my_ <your- example_ test_ dummy-", "a"), pick(KEY_WORDS, "b"), pick(["_here", "", ">", "_123", "-xxxx"], "c")),
        "reference": F.concat(pick(["${", "os.environ[", "getenv(", "process.env.", "{{", "config."], "a"), F.upper(pick(KEY_WORDS, "b")), pick(["}", "]", ")", "", "}}"], "c")),
        "word": pick("required string none null true false optional missing invalid expired password token text hidden varchar unknown here is the a value field undefined", "a"),
        "repeat": F.repeat(pick("x * X 0 .", "a"), wide(4, 20, "long")),
    }
    context = pick("card phone order call commit sha checksum revision uuid id digest hash invoice version", "context")
    said = F.concat(plain, F.lit(" "), context, pick([" ", ": ", " = ", "="], "sign"))
    kinds = len(secret), len(other) + len(held)
    label = F.col("id") % 2
    kind = F.when(label == 1, draw("kind", kinds[0])).otherwise(draw("kind", kinds[1]))
    take = lambda cs: F.element_at(F.array(*cs), kind + 1)
    value = F.when(label == 1, take(list(secret.values()) + [F.lit(None)] * max(0, kinds[1] - kinds[0]))).otherwise(take(list(other.values()) + list(held.values())))
    shape = F.when(label == 1, take([F.lit(x) for x in secret] + [F.lit(None)] * max(0, kinds[1] - kinds[0]))).otherwise(take([F.lit(x) for x in [*other, *held]]))
    open_ = (label == 1) & (draw("free", 3) == 0) & shape.isin(*free)
    pem = shape == "pem"
    asked = ((label == 1) & ~open_ & ~pem) | shape.isin(*held)
    in_json = asked & (draw("json", 3) == 0)
    after = F.concat(pick([" ", "\n", " ", ", "], "gap"), plain, F.lit(" "), pick(DICTIONARY, "later"))
    front = F.concat(plain, F.lit(" "))
    field = F.concat(F.lit('{"'), pick("id commit uuid sha hash order version digest revision", "field"), F.lit('":"'), value, F.lit('","user":"bob"}'))
    unquoted = F.regexp_replace(value, r"""[\s"'`,;)}\]]""", "")
    bare = asked & ~in_json & (quote == "")
    value = F.when(bare, unquoted).otherwise(value)
    text = F.when(in_json, F.concat(json, value, F.lit('"}'))).when(asked, F.concat(front, given, value, quote, after)).when(open_ | pem, F.concat(front, value, after)).when((label == 0) & (draw("json", 3) == 0), field).when(shape.isin("card", "uuid", "commit", "account"), F.concat(said, value, after)).otherwise(F.concat(front, plain, F.lit(" "), value, after))
    path = F.concat(F.lit("src/"), F.when(label == 1, pick("main config app env deploy lib settings src0", "path")).otherwise(pick("main app tests docs lib example src0 spec", "path")))
    return spark.range(0, n, 1, 1).select("id", text.alias("text"), value.alias("value"), path.alias("path"), label.cast("double").alias("label"), shape.alias("shape"))


def extracted(findings: DataFrame) -> DataFrame:
    """The labelled findings (text, value, path, label) as candidates(): those that are found, with their features."""
    rows = findings.withColumn("doc_id", F.xxhash64("text", "value", "path"))
    labels = rows.select(F.col("doc_id").alias("__id"), F.col("value").alias("__value"), "label").dropDuplicates(["__id"])
    found = candidates(rows.select("doc_id", "text", "path").dropDuplicates(["doc_id"]), "path")
    return with_features(found.join(labels, (F.col("doc_id") == F.col("__id")) & (F.col("value") == F.col("__value"))))


def train(findings: DataFrame) -> str:
    """A SQL expression over FEATURES: the share of the forest's trees that take a finding for a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = durable(extracted(findings).select("doc_id", "start", "label", *FEATURES), "secret-findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found.orderBy("doc_id", "start"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))
    discard(found)
    return forest_expression(forest.toDebugString)


def forest_expression(told: str) -> str:
    """The printed trees of a forest as SQL; each leaf says 0 or 1."""
    trees, lines = [], [x.strip() for x in told.splitlines()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return str(int(float(m[1])))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        at += 1  # the line "Else (...)"
        return f"CASE WHEN {FEATURES[int(m[1])]} <= {m[2]}D THEN {yes} ELSE {node()} END"

    while at < len(lines):
        if re.match(r"Tree \d+ ", lines[at]):
            at += 1
            trees.append(node())
        else:
            at += 1
    total = f"aggregate(array({', '.join(trees)}), 0, (a, x) -> a + x)"
    return f"cast({total} as double) / {len(trees)}"


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, value, votes (share of trees) and is_secret of every candidate in every text."""
    votes = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    return with_features(candidates(docs, path)).select("doc_id", "start", "value", F.expr(votes).alias("votes")).withColumn("is_secret", F.col("votes") >= 0.5)


def digests(docs: DataFrame) -> DataFrame:
    """The findings with the value's length and digest in place of the value."""
    return scan(docs, path="source").select("doc_id", "start", F.char_length("value").cast("bigint").alias("length"), F.sha2("value", 256).alias("value_sha256"), "votes", "is_secret")
